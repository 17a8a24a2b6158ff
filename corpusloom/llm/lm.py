"""Language-model scores by a Brown class-based bigram model.

A word's probability after another is the class transition times the word's share of its class.  Words get their
classes by exchange: each moves to the class that raises the likelihood of the class bigrams most.  The most frequent words, and the endings
of rare words, are exchanged one by one until none moves.  Then all frequent words are exchanged in distributed sweeps: tasks count
each word's neighbours by class over all training texts, and every other word moves at a time, given the same class table.  A sweep
that does not raise the likelihood is taken back.  Rare words fall into classes by their last two bytes, which take part as such.
Counts cover all training documents; what the driver sees are a bounded number of frequent words and of class counts.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import doc_fold, documents, materialize, tidy

#: Words that are exchanged one by one first, word endings, classes, rounds of that; sweeps over all frequent words.
WORDS, ENDINGS, CLASSES, ROUNDS, SWEEPS = 480, 31, 64, 12, 4
#: Frequent words (at most so many, of so many bytes at most, so 8 MB) are held by tasks and exchanged; the counts of all others are joined.
HEAD, HEAD_BYTES = 131_072, 64
#: Distinct words that a task counts before it hands them on; added counts; parts of the table of neighbours; words and neighbour counts that a task packs at once.
HELD, ADD, PARTS, PACKED = 400_000, 0.5, 64, 1 << 22


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; the end token is implied."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def ending(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % ENDINGS


def word_counts(texts: DataFrame) -> DataFrame:
    """``word binary, n long`` over all texts."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                held.update(tokens(text.as_py()))
                if len(held) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "n"])
                    held.clear()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "n"])

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame) -> list:
    """Rows of the most frequent words, most frequent first: all that are at least so frequent that there are ``HEAD`` of them at most.

    The limit comes from a histogram of counts (exact below 1024, 64 steps for each doubling above), so no more rows than these reach the driver.
    """
    step = F.when(F.col("n") < 1024, F.col("n")).otherwise(1024 + F.floor((F.log2("n") - 10) * 64)).cast("long")
    known = counts.where(F.length("word") <= HEAD_BYTES).withColumn("step", step)
    room, least = HEAD, 1 << 62
    for r in sorted(known.groupBy("step").count().collect(), key=lambda r: -r["step"]):
        room -= r["count"]
        if room < 0:
            break
        least = r["step"]
    return sorted(known.where(F.col("step") >= least).select("word", "n").collect(), key=lambda r: (-r["n"], bytes(r["word"])))


class Head:
    """Frequent words, most frequent first, with their counts.  Units are these words, then endings of all others, then the end token."""

    def __init__(self, words: list[bytes], counts: list[int]):
        self.at = {w: i for i, w in enumerate(words)}
        self.counts = np.array(counts, np.float64)

    @property
    def end(self) -> int:
        return len(self.at) + ENDINGS

    def units(self, words: list[bytes]) -> np.ndarray:
        get, n = self.at.get, len(self.at)
        unit = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        for i in np.flatnonzero(unit < 0).tolist():
            unit[i] = n + ending(words[i])
        return unit


def encoded(texts: DataFrame, head) -> DataFrame:
    """The units of all texts, packed: every text begins after and ends with the end token."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head.value
        end, held, size = np.array([known.end]), [], 0
        for batch in batches:
            for text in batch["text"]:
                held += [known.units(tokens(text.as_py())), end]
                size += len(held[-2]) + 1
                if size > PACKED:
                    yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).astype("<u4").tobytes()], pa.binary())], ["units"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).astype("<u4").tobytes()], pa.binary())], ["units"])

    return materialize(texts.select("text").mapInArrow(run, "units binary"), "lm-units")


def _rows(units: DataFrame):
    """For helpers: the packed units of a batch, each row with the end token in front."""

    def each(batches: Iterator[pa.RecordBatch], end: int) -> Iterator[np.ndarray]:
        for batch in batches:
            for raw in batch["units"]:
                yield np.r_[end, np.frombuffer(raw.as_buffer(), "<u4").astype(np.int64)]

    return each


def unit_bigrams(units: DataFrame, n_head: int) -> np.ndarray:
    """Counts of neighbours among the first ``WORDS`` words, the endings and the end token; other words count by a cell that is left out."""
    first, end = min(WORDS, n_head), n_head + ENDINGS
    total = first + ENDINGS + 1
    each = _rows(units)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((total + 1) ** 2, np.int64)
        for row in each(batches, end):
            cell = np.where(row < first, row, np.where(row >= n_head, row - n_head + first, total))
            table += np.bincount(cell[:-1] * (total + 1) + cell[1:], minlength=len(table))
        some = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(table[some], pa.int64())], ["cell", "n"])

    table = np.zeros((total + 1) ** 2)
    for r in units.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # as many rows as cells at most
        table[r["cell"]] = r["n"]
    return table.reshape(total + 1, total + 1)[:total, :total]


def neighbours(units: DataFrame, of, n_units: int) -> DataFrame:
    """``part, counts``: for each unit (``part`` and below, ``PARTS`` apart) how often each class comes after it, then before it; over all texts."""
    each, end, width = _rows(units), n_units - 1, 2 * CLASSES

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls = of.value
        held, size = [], 0

        def pack() -> pa.RecordBatch:
            keys, n = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            keys, n = keys[cuts], np.add.reduceat(n, cuts)
            part = keys // width % PARTS
            order = np.argsort(part, kind="stable")
            keys, n = keys[order], n[order]
            ends = np.searchsorted(part[order], np.arange(PARTS + 1))
            cols = [pa.array([x[a:b].astype("<u4").tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary()) for x in (keys, n)]
            return pa.RecordBatch.from_arrays([pa.array(np.arange(PARTS), pa.int32()), *cols], ["part", "keys", "n"])

        for row in each(batches, end):
            for at in range(0, len(row) - 1, 1 << 20):
                a, b = row[at : at + (1 << 20)], row[at + 1 : at + 1 + (1 << 20)]
                a = a[: len(b)]
                keys = np.concatenate([a * width + cls[b], b * width + CLASSES + cls[a]]).astype(np.uint32)
                keys.sort()
                cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                held.append((keys[cuts].astype(np.int64), np.diff(np.r_[cuts, len(keys)])))
                size += len(cuts)
            if size > PACKED:
                yield pack()
                held, size = [], 0
        if held:
            yield pack()

    @tidy
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, keys, n in zip(batch["part"].to_pylist(), batch["keys"].to_pylist(), batch["n"].to_pylist()):
                table = tables.setdefault(part, np.zeros(-(-n_units // PARTS) * width))
                keys = np.frombuffer(keys, "<u4").astype(np.int64)
                table[keys // width // PARTS * width + keys % width] += np.frombuffer(n, "<u4")
        for part, table in tables.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([table.astype("<f8").tobytes()], pa.binary())], ["part", "counts"])

    sent = units.mapInArrow(count, "part int, keys binary, n binary")
    return materialize(sent.repartition(PARTS, "part").mapInArrow(add, "part int, counts binary"), "lm-neighbours")


def _log_sum(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(table: np.ndarray) -> float:
    return float(_log_sum(table).sum() - _log_sum(table.sum(0)).sum() - _log_sum(table.sum(1)).sum())


def better_classes(right: np.ndarray, left: np.ndarray, of: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The best class of each unit, given how often each class comes after and before it, with all other units where they are.

    Classes but the last and empty ones are free.  A unit's own bigrams with itself count as with its present class.
    """
    free = CLASSES - 1
    best = of.copy()
    after, before = table.sum(1), table.sum(0)
    empty = after[:free] + before[:free] == 0  # units that move at the same time would all meet there
    for u in range(len(of)):
        j, i = np.flatnonzero(right[u]), np.flatnonzero(left[u])
        a, r, c = of[u], right[u, j], left[u, i]
        out, into = table[:free, j].copy(), table[i, :free].T.copy()
        out[a] -= r
        into[a] -= c
        rows, cols = after[:free].copy(), before[:free].copy()
        rows[a] -= r.sum()
        cols[a] -= c.sum()
        gain = (_log_sum(out + r) - _log_sum(out)).sum(1) + (_log_sum(into + c) - _log_sum(into)).sum(1)
        gain -= _log_sum(rows + r.sum()) - _log_sum(rows) + _log_sum(cols + c.sum()) - _log_sum(cols)
        gain[empty] = -np.inf
        k = int(gain.argmax())
        if gain[k] > gain[a] + 1e-9:
            best[u] = k
    return best


def class_table(counts: DataFrame, of, n_units: int) -> np.ndarray:
    """Bigrams of classes from :func:`neighbours`; a small table from each part comes to the driver."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in zip(batch["part"].to_pylist(), batch["counts"]):
                own = of.value[part::PARTS]
                right = np.frombuffer(raw.as_buffer(), "<f8").reshape(-1, 2 * CLASSES)[: len(own), :CLASSES]
                table = np.zeros((CLASSES, CLASSES))
                np.add.at(table, own, right)
                yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary())], ["table"])

    got = counts.mapInArrow(run, "table binary").collect()
    return sum((np.frombuffer(r["table"]).reshape(CLASSES, CLASSES) for r in got), np.zeros((CLASSES, CLASSES)))


def swept(units: DataFrame, of: np.ndarray, n_head: int, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all units after the distributed sweeps, and the bigrams of classes."""
    context, n_units = units.sparkSession.sparkContext, len(of)
    best, best_table, best_value = of, None, -np.inf
    for sweep in range(sweeps + 1):
        shared = context.broadcast(of)
        counts = neighbours(units, shared, n_units)
        table = class_table(counts, shared, n_units)
        value = likelihood(table)
        if value <= best_value:
            break
        best, best_table, best_value = of, table, value
        if sweep == sweeps:
            break

        @tidy
        def move(batches: Iterator[pa.RecordBatch], sweep=sweep, shared=shared, table=table) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, raw in zip(batch["part"].to_pylist(), batch["counts"]):
                    own = shared.value[part::PARTS]
                    both = np.frombuffer(raw.as_buffer(), "<f8").reshape(-1, 2 * CLASSES)[: len(own)]
                    unit = np.arange(part, n_units, PARTS)
                    some = np.flatnonzero((unit < n_head) & (unit // PARTS % 2 == sweep % 2))
                    own = own.copy()
                    own[some] = better_classes(both[some, :CLASSES], both[some, CLASSES:], own[some], table)
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([own.astype(np.uint8).tobytes()], pa.binary())], ["part", "of"])

        of = best.copy()
        for r in counts.mapInArrow(move, "part int, of binary").collect():  # a byte for each unit
            of[r["part"] :: PARTS] = np.frombuffer(r["of"], np.uint8)
    return best, best_table


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = ROUNDS) -> np.ndarray:
    """Class of each unit by exchange clustering; the last unit keeps the last class for itself."""
    n = len(bigrams)
    free = classes - 1
    order = np.argsort(-bigrams.sum(1)[: n - 1], kind="stable")
    of = np.empty(n, np.int64)
    of[order] = np.minimum(np.arange(n - 1), free - 1)  # the most frequent start alone, the rest together
    of[n - 1] = free

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1))

    one = np.eye(classes)
    table = one[of].T @ bigrams @ one[of]
    k = np.arange(free)
    for _ in range(sweeps):
        moved = 0
        for u in order:
            a, own = of[u], bigrams[u, u]
            row, col = bigrams[u] @ one[of], bigrams[:, u] @ one[of]
            row[a] -= own
            col[a] -= own
            table[a, :] -= row
            table[:, a] -= col
            table[a, a] -= own
            left, right = table.sum(1), table.sum(0)
            new_row, new_col = table[:free] + row, table.T[:free] + col
            diagonal = table[k, k] + row[:free] + col[:free] + own
            gain = f(new_row).sum(1) - f(new_row[k, k]) + f(new_col).sum(1) - f(new_col[k, k]) + f(diagonal)
            gain -= f(table[:free]).sum(1) + f(table.T[:free]).sum(1) - f(table[k, k])
            gain -= f(left[:free] + row.sum() + own) - f(left[:free]) + f(right[:free] + col.sum() + own) - f(right[:free])
            b = int(gain.argmax()) if gain.max() > gain[a] + 1e-9 else a
            table[b, :] += row
            table[:, b] += col
            table[b, b] += own
            of[u] = b
            moved += a != b
        if not moved:
            break
    return of


class ClassModel:
    """Log10 of class transitions, and of the size of each unit's class, from counts over all training texts."""

    def __init__(self, of: np.ndarray, table: np.ndarray, unit_tokens: np.ndarray, unit_types: np.ndarray):
        self.of = of.astype(np.uint8)
        tokens_of, types_of = (np.bincount(of, x, CLASSES) for x in (unit_tokens, unit_types))
        self.step = np.log10((table + ADD) / (table.sum(1, keepdims=True) + ADD * CLASSES))
        self.size = np.log10(tokens_of + ADD * (types_of + 1))

    def path(self, units: np.ndarray) -> float:
        """Transitions and class sizes of a text; what is left to add are the logs of the words' own counts."""
        of = self.of[np.r_[len(self.of) - 1, units, len(self.of) - 1]]
        return float(self.step[of[:-1], of[1:]].sum() - self.size[of[1:]].sum())


def fit(train: DataFrame, counts: DataFrame, n_texts: int) -> tuple[Head, ClassModel]:
    """The frequent words, and the class model learned from all texts of ``train`` with their word ``counts``."""
    context = train.sparkSession.sparkContext
    top = frequent(counts)
    words, n = [bytes(r["word"]) for r in top], [r["n"] for r in top]
    del top
    head = Head(words, n)
    # tokens and types of each unit: frequent words, then endings of the others, then the end token
    unit_tokens, unit_types = np.r_[head.counts, np.zeros(ENDINGS), n_texts], np.r_[np.ones(len(words)), np.zeros(ENDINGS), int(n_texts > 0)]
    last = F.substring("word", -2, 2)
    at = len(words)
    for r in counts.groupBy((F.crc32(last) % ENDINGS).alias("ending")).agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect():
        unit_tokens[at + r["ending"]], unit_types[at + r["ending"]] = r["n"], r["types"]
    endings = np.array([ending(w) for w in words], np.int64)
    unit_tokens[at : at + ENDINGS] -= np.bincount(endings, head.counts, ENDINGS)
    unit_types[at : at + ENDINGS] -= np.bincount(endings, minlength=ENDINGS)
    units = encoded(train, context.broadcast(head))
    first = exchange(unit_bigrams(units, at))
    some = min(WORDS, at)
    # the other frequent words start with their endings
    of = np.r_[first[:some], first[some + endings[some:]], first[some:]]
    return head, ClassModel(*swept(units, of, at), unit_tokens, unit_types)


def score_texts(docs: DataFrame, train: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, held_out, text``) under the model learned from the texts of ``train``.

    Null and empty texts are the end token alone; words never seen count ``ADD``; with nothing to train on all counts are 0.
    Repeated rows are scored each by itself; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    counts = materialize(word_counts(train), "lm-counts")
    n_texts = train.count()
    total, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, types = total + n_texts, types + (n_texts > 0)
    head, model = map(spark.sparkContext.broadcast, fit(train, counts, n_texts))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, classes = head.value, model.value
        logs = np.log10(known.counts + ADD)
        names = ["rid", "doc_id", "held_out", "n_tokens", "known", "logs", "path", "word", "tf"]
        for batch in batches:
            out: list[tuple] = []
            for rid, doc, held, text in zip(batch["rid"].to_pylist(), batch["doc_id"].to_pylist(), batch["held_out"].to_pylist(), batch["text"]):
                words = tokens(text.as_py())
                units = known.units(words)
                inside = units < len(known.at)
                rare = Counter([words[i] for i in np.flatnonzero(~inside).tolist()])
                n_known = int(inside.sum()) + (n_texts > 0)
                s = float(logs[units[inside]].sum()) + float(np.log10(n_texts + ADD))
                # the text's figures travel with its first rare word; without one, with a key that no word can have
                (first, tf), *rest = rare.items() or [(b" %d" % rid, 0)]
                out.append((rid, doc, held, len(words) + 1, n_known, s, classes.path(units), first, tf))
                out += [(rid, None, None, None, None, None, None, w, k) for w, k in rest]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    own = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text")
    each = own.mapInArrow(run, "rid long, doc_id long, held_out boolean, n_tokens long, known long, logs double, path double, word binary, tf long")
    joined = each.join(counts, "word", "left")
    n = F.coalesce("n", F.lit(0))
    sums = joined.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        (F.max("known") + F.coalesce(F.sum(F.when(n > 0, F.col("tf"))), F.lit(0))).alias("n_known"),
        (F.max("logs") + F.sum(F.col("tf") * F.log10(n + F.lit(ADD)))).alias("logs"), F.max("path").alias("path"),
    )
    base = F.col("logs") - F.col("n_tokens") * F.lit(float(np.log10(total + ADD * (types + 1))))
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("logs") + F.col("path")).alias("score"))


def op8_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", (doc_fold(F.col("doc_id")) == 1).alias("held_out"))
    return score_texts(docs, docs.where("NOT held_out"))
