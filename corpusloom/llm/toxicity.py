"""Toxicity by a weighted finite-state pattern grammar.

Words become a few symbols: insult, threat, target, negation, reporting, or any other.  Small transducers read them in turn, each
rewriting what it recognises at a weight: insults that follow each other, threats with a target, insults aimed at one (before or after them), what
stands under a negation, and what is reported speech.  They are composed into one deterministic machine, which reads every clause with an insult or threat
in it; a clause counts by the strongest pattern that it matches, with the weights of its words and arcs.  Insult stems are learned from labelled rows of
one fold, and how much each kind of clause says from those of another.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import doc_fold, documents, own_name, tidy

#: Labelled rows that the model is fitted on, stems that it holds, word counts that a task holds before it hands them on.
SAMPLE, LEXICON, HELD = 32_768, 4096, 300_000
#: A learned stem: letters (or a whole word), the least lower bound of its log odds, and the different words it must have followed in toxic texts.
STEM_LETTERS, LEAST_ODDS, LEAST_CONTEXTS = (4, 5, 6, 7, 8), 2.5, 4
THRESHOLD = 0.7

#: Cue words of English, German, French and Spanish, whole words but for insults and threats, which are stems.
INSULTS = "idiot moron stupid imbecil imbécil dumb loser scum trash pathetic worthless disgusting trottel dummkopf abschaum crétin connard estúpid basura"
THREATS = "kill murder strangl stab umbring töte ermord assassin étrangl matar asesin"
TARGETS = "you your yours yourself he him she her they them these those people du dich dir euch ihr ihn sie tu toi te vous lui elle eux tú usted ustedes él ella ellos ellas"
NEGATIONS = "not no never neither nor nobody without nicht kein keine nie niemals ohne ne pas jamais sans ni nunca jamás sin"
REPORTING = "said says say saying told tells wrote writes called claimed quoted reported sagte sagt schrieb nannte behauptete dit disait écrit appelé dijo dice escribió llamó"
SEED_WEIGHT = 3.0

#: Symbols of words, those that the machine writes for a match, and the kinds of clauses from the strongest match down.
WORDS = ["word", "insult", "threat", "target", "negation", "reporting"]
KINDS = ["directed", "aimed", "piled", "insult", "threat", "reported", "denied"]
MATCHES = set(KINDS)
_SEPARATORS = bytes(c if chr(c).isalpha() or c > 127 else 32 for c in range(256))
_CLAUSES = bytes(10 if chr(c) in ".!?;\n\r" else c if chr(c).isalpha() or c > 127 else 32 for c in range(256))


class Transducer:
    """A deterministic weighted transducer: ``arcs[state, symbol]`` is the next state, the symbol written, and a weight; it starts in state 0."""

    def __init__(self, arcs: dict[tuple[int, str], tuple[int, str, float]]):
        self.arcs = arcs

    def then(self, other: Transducer) -> Transducer:
        """The composition: ``other`` reads what this one writes; weights add up.  Only states that can be reached are kept."""
        number, todo, arcs = {(0, 0): 0}, [(0, 0)], {}
        for mine, theirs in todo:
            for symbol in WORDS:
                a, written, w = self.arcs[mine, symbol]
                b, out, v = other.arcs[theirs, written]
                if (a, b) not in number:
                    number[a, b] = len(number)
                    todo.append((a, b))
                arcs[number[mine, theirs], symbol] = number[a, b], out, w + v
        return Transducer(arcs)

    def read(self, symbols: Iterable[str]) -> Iterator[tuple[str, float]]:
        state = 0
        for s in symbols:
            state, out, weight = self.arcs[state, s]
            yield out, weight


def within(openers: set[str], reach: int, rewrite: dict[str, tuple[str, float]]) -> Transducer:
    """Up to ``reach`` symbols after an opener, the symbols of ``rewrite`` are written anew; the state counts the symbols that are left."""
    arcs = {}
    for left in range(reach + 1):
        for symbol in [*WORDS, *(k for k in KINDS if k not in WORDS)]:
            out, weight = rewrite[symbol] if left and symbol in rewrite else (symbol, 0.0)
            arcs[left, symbol] = reach if symbol in openers else max(0, left - 1), out, weight
    return Transducer(arcs)


@functools.cache
def grammar() -> Transducer:
    """All transducers composed, in the order in which they rewrite."""
    machine = within({"insult"}, 3, {"insult": ("piled", 0.5)})
    for step in (
        within({"threat"}, 3, {"target": ("directed", 2.0)}),
        within({"target", "directed"}, 3, {"insult": ("aimed", 1.0), "piled": ("aimed", 1.0)}),
        within({"insult", "piled"}, 2, {"target": ("aimed", 1.0)}),
        within({"negation"}, 3, {k: ("denied", -1.0) for k in ("insult", "piled", "aimed", "threat", "directed")}),
        within({"reporting"}, 8, {k: ("reported", -0.5) for k in ("insult", "piled", "aimed", "threat", "directed")}),
    ):
        machine = machine.then(step)
    return machine


def plain(text: str | None) -> bytes:
    return (text or "").lower().replace("n't", " not").encode("utf-8", "surrogatepass")


def text_words(text: str | None) -> list[bytes]:
    """Lower-case runs of ASCII letters and characters beyond ASCII."""
    return plain(text).translate(_SEPARATORS).split()


class Lexicon:
    """Stems with weights: of learned ones as given (those that end in a space are whole words), of fixed ones ``SEED_WEIGHT``."""

    def __init__(self, learned: dict[str, float]):
        self.weight: dict[bytes, tuple[str, float]] = {w.encode(): ("insult", SEED_WEIGHT) for w in INSULTS.split()} | {w.encode(): ("threat", SEED_WEIGHT) for w in THREATS.split()}
        for stem, w in learned.items():
            self.weight[stem.encode("utf-8", "surrogatepass")] = ("insult", w)
        self.lengths = sorted({len(s) for s in self.weight})
        self.cues = {w.encode(): s for s, ws in (("target", TARGETS), ("negation", NEGATIONS), ("reporting", REPORTING)) for w in ws.split()}

    @functools.cached_property
    def finder(self) -> ahocorasick.Automaton:
        """Finds stems at the beginning of words."""
        found = ahocorasick.Automaton()
        for s in self.weight:
            found.add_word(f" {s.decode('latin-1')}", 0)
        found.make_automaton()
        return found

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "finder"}

    def symbol(self, word: bytes) -> tuple[str, float]:
        """A word's symbol and weight; of several stems the heaviest counts."""
        whole = word + b" "
        best = max((self.weight[whole[:n]] for n in self.lengths if whole[:n] in self.weight), key=lambda x: x[1], default=None)
        return best or (self.cues.get(word, "word"), 0.0)

    def clauses(self, text: str | None) -> Iterator[list[bytes]]:
        """Words of the clauses that hold an insult or a threat."""
        raw = plain(text)
        spaced, cut, done = f" {raw.translate(_SEPARATORS).decode('latin-1')} ", raw.translate(_CLAUSES), -1
        for at, _ in self.finder.iter(spaced):
            at = min(at - 1, len(raw) - 1)
            # a whole word's match ends in the space after it, which may be the clause's end
            while at > 0 and cut[at] in b" \n":
                at -= 1
            if at > done:
                begin, end = cut.rfind(b"\n", 0, at) + 1, cut.find(b"\n", at)
                done = len(cut) if end < 0 else end
                yield cut[begin:done].split()

    def evidence(self, text: str | None) -> list[float]:
        """For each kind of clause the summed weight of those clauses, and the number of words, each as the logarithm of itself plus one."""
        sums = dict.fromkeys(KINDS, 0.0)
        machine = grammar()
        for words in self.clauses(text):
            read = [self.symbol(w) for w in words]
            matched = [(out, w + own) for (out, w), (_, own) in zip(machine.read(s for s, _ in read), read) if out in MATCHES]
            if matched:
                sums[min((out for out, _ in matched), key=KINDS.index)] += max(0.0, sum(w for _, w in matched))
        return [*np.log1p(list(sums.values())), np.log1p(len(text or "") / 6)]


#: What a kind of clause says before any label is seen (then length and constant), and how firmly.
PRIOR = np.array([1.6, 1.4, 1.2, 1.0, 0.8, 0.5, 0.2, 0.0, -2.0])
FIRM = np.array([1.0] * len(KINDS) + [0.1, 0.01])


def fit_weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method, held to the prior."""
    x, w = np.c_[x, np.ones(len(x))], PRIOR.copy()

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + FIRM @ (w - PRIOR) ** 2 / 2)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(FIRM), x.T @ (y - p) - FIRM * (w - PRIOR))
        size = 1.0
        while size > 1e-4 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def score(self, text: str | None) -> float:
        z = float(np.dot(self.lexicon.evidence(text), self.weights[:-1]) + self.weights[-1])
        return 1 / (1 + np.exp(-min(30.0, max(-30.0, z))))


def learn_stems(docs: DataFrame) -> dict[str, float]:
    """Stems of ``docs`` (``text, toxic``) and their weights: the lower bound (one standard error) of the log odds that a text with such a word is toxic.

    Counted are pairs of a word and a text that holds it; a stem must have followed several different words in toxic texts, so that
    a passage in many copies makes none.  Of stems none is kept beside a shorter one that weighs as much.  What reaches the driver are ``4 * LEXICON`` rows.
    """

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"].to_pylist()):
                words, seen = text_words(text.as_py()), {}
                for before, w in zip([b"", *words], words):
                    seen[w] = seen.get(w, 0) | 1 << zlib.crc32(before) % 62
                for w, after in seen.items():
                    row = held.setdefault(w, [0, 0, 0])
                    row[toxic] += 1
                    row[2] |= after * toxic
                if len(held) > HELD:
                    yield rows(held)
                    held = {}
        if held:
            yield rows(held)

    def rows(held: dict) -> pa.RecordBatch:
        neg, pos, after = zip(*held.values())
        return pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in held]), pa.array(neg, pa.int64()), pa.array(pos, pa.int64()), pa.array(after, pa.int64())], ["word", "neg", "pos", "after"])

    total = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    if not total.toxic or total.toxic == total.n:
        return {}
    sums = [F.sum("neg").alias("neg"), F.sum("pos").alias("pos"), F.bit_or("after").alias("after")]
    words = docs.select("text", "toxic").mapInArrow(count, "word string, neg long, pos long, after long").groupBy("word").agg(*sums)
    stems = F.array(F.concat("word", F.lit(" ")), *(F.when(F.length("word") > n, F.substring("word", 1, n)) for n in STEM_LETTERS))
    counted = words.select(F.explode(stems).alias("stem"), "neg", "pos", "after").where("stem IS NOT NULL").groupBy("stem").agg(*sums)
    pos, neg = F.col("pos") + 0.5, F.col("neg") + 0.5
    odds = F.log(pos / (total.toxic + 1)) - F.log(neg / (total.n - total.toxic + 1)) - F.sqrt(1 / pos + 1 / neg)
    found = counted.where(F.bit_count("after") >= LEAST_CONTEXTS).withColumn("weight", F.round(odds, 4)).where(F.col("weight") >= LEAST_ODDS)
    best = {r["stem"]: r["weight"] for r in found.orderBy(F.desc("weight"), "stem").limit(4 * LEXICON).select("stem", "weight").collect()}
    lean = {s: w for s, w in best.items() if not any(best.get(s[:n], -1.0) >= w for n in range(STEM_LETTERS[0], len(s)))}
    return dict(list(lean.items())[:LEXICON])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from about ``sample`` rows of ``labels`` (``doc_id, toxic``; a hash of the id chooses), stems from every other one and weights from the rest.

    Ids and marks that are null teach nothing; a document is toxic if any of its marks is 1.  Without labelled rows, or with those of
    one kind alone, fixed stems and the prior decide.
    """
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    n = marked.count()
    h = F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(1 << 31))
    few = marked.where(h <= min((1 << 31) - 1, (sample << 31) // max(n, 1))).withColumn("odd", h % 2)
    # the sample's ids are bounded and go to every task; texts stay where they are
    text = own_name(docs, "_text")
    known = docs.select("doc_id", F.col("text").alias(text)).join(F.broadcast(few), F.col("doc_id") == F.col("_id")).select(F.col(text).alias("text"), "toxic", "odd")
    lexicon = Lexicon(learn_stems(known.where("odd = 0")))

    @tidy
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([lexicon.evidence(t.as_py()) for t in batch["text"]], pa.list_(pa.float64())), batch["toxic"]], ["x", "toxic"])

    seen = known.where("odd = 1").select("text", "toxic").mapInArrow(look, "x array<double>, toxic int").toArrow()
    y = seen["toxic"].to_numpy().astype(float)
    # rows come in any order: sums in one order give the same weights in every run
    x = np.array(seen["x"].to_pylist()).reshape(len(y), len(PRIOR) - 1)
    order = np.lexsort(np.c_[x, y].T) if len(y) else []
    return Model(lexicon, fit_weights(x[order], y[order]) if 0 < y.sum() < len(y) else PRIOR)


def score_texts(docs: DataFrame, model: Model, text_col: str = "text", col: str = "toxicity") -> DataFrame:
    """``docs`` with ``score``, from 0 to 1, of each whole text in column ``col``.

    A null text counts as empty; texts without a matching clause, empty ones too, have the low score that the model gives to no evidence.  Each row is judged by
    its text alone, so ties and repeated rows do not matter; an empty table gives an empty result; other columns pass through untouched.
    """

    @F.pandas_udf("double")
    @tidy
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.score(t) for t in texts], dtype="float64")

    return docs.withColumn(col, run(F.col(text_col)))


def matched_clauses(docs: DataFrame, model: Model, text_col: str = "text", col: str = "clauses") -> DataFrame:
    """``docs`` with the clauses that match, as evidence for a reader: ``array<struct<clause, kinds, weight>>``."""

    @F.pandas_udf("array<struct<clause: string, kinds: string, weight: double>>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            mine = []
            for words in model.lexicon.clauses(t):
                read = [model.lexicon.symbol(w) for w in words]
                matched = [(k, w + own) for (k, w), (_, own) in zip(grammar().read(s for s, _ in read), read) if k in MATCHES]
                if matched:
                    mine.append({"clause": b" ".join(words).decode("utf-8", "replace"), "kinds": " ".join(k for k, _ in matched), "weight": sum(w for _, w in matched)})
            out.append(mine)
        return pd.Series(out)

    return docs.withColumn(col, run(F.col(text_col)))


def _fold(doc_id: Column) -> Column:
    return doc_fold(doc_id, 3)


def op11_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(_fold(F.col("doc_id")) != 1)
    scored = score_texts(docs, train(docs, labels), col="score")
    return scored.select("doc_id", (_fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
