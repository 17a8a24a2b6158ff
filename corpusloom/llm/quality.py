"""Quality rules by distribution divergence.

Each text's histogram of character classes and of common words is compared with that of every language of the
corpus by the Jensen-Shannon distance (base 2, so 0 to 1); the nearest language counts.  Short texts are
not judged by histograms that they cannot fill.  Language references are counted over all documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import documents, own_name, tidy

#: A text is rejected beyond these distances, if it has so many code points in words, or so many words.
MAX_CLASS, MAX_WORD, GUARD_CHARS, GUARD_WORDS = 0.3, 0.75, 150, 60
#: Common words of a language: so many, without ASCII punctuation at either end, lower case; distinct words that a task counts before it hands them on.
COMMON, HELD = 24, 300_000
SYMBOLS = b"#*$%&|<>"
_EDGES = bytes(c for c in range(33, 127) if not chr(c).isalnum())

#: Character class of each byte: lower, upper, digit, space, sentence marks, symbols, other ASCII, lead byte of another character; 8: goes uncounted.
CLASSES = 8
_CLASS = np.full(256, 6)
for _i, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"\t\n\x0b\x0c\r ", b".,;:!?'\"()-", SYMBOLS)):
    _CLASS[list(_set)] = _i
_CLASS[0x80:0xC0], _CLASS[0xC0:] = 8, 7
_CLASS_ROWS = np.eye(9)[_CLASS][:, :CLASSES]
_POINT = np.r_[np.ones(128), np.zeros(64), np.ones(64)].astype(np.int64)
_SPACE, _SYMBOL = list(b"\t\n\x0b\x0c\r "), list(SYMBOLS)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of histogram ``p`` to each row of ``q`` (base 2)."""
    p, m = p[None, :], (p[None, :] + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = np.where(p > 0, p * np.log2(p / m), 0), np.where(q > 0, q * np.log2(q / m), 0)
    return np.sqrt(np.clip((a.sum(1) + b.sum(1)) / 2, 0, 1))


def _bare(times: Counter) -> Counter:
    """Counts of words without ASCII punctuation at either end, from counts of words as they stand."""
    bare: Counter = Counter()
    for w, n in times.items():
        bare[w.strip(_EDGES).lower()] += n
    del bare[b""]
    return bare


def language_references(docs: DataFrame) -> list[tuple[str, np.ndarray, list[bytes], np.ndarray]]:
    """Per language of all ``docs`` (null counts as one more): class histogram, common words, their histogram with the rest as last cell.

    What comes to the driver are the counts of the classes and of the most common words of each language.
    """

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[Counter, np.ndarray, list[int]]] = {}
        cells = 0
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"].to_pylist()):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                words, classes, total = held.setdefault(lang or "*", (Counter(), np.zeros(CLASSES), [0]))
                classes += np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS_ROWS
                all_words = raw.split()
                total[0] += len(all_words)
                words.update(all_words)
            cells = sum(len(x[0]) for x in held.values())
            if cells > HELD:
                yield rows(held)
                held = {}
        if held:
            yield rows(held)

    def rows(held: dict) -> pa.RecordBatch:
        out = [(lang, "w", w.decode("latin-1"), float(n)) for lang, x in held.items() for w, n in _bare(x[0]).items()]
        out += [(lang, "c", str(i), float(n)) for lang, x in held.items() for i, n in enumerate(x[1])] + [(lang, "n", "", float(x[2][0])) for lang, x in held.items()]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["lang", "kind", "key", "n"])

    got = docs.select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(count, "lang string, kind string, key string, n double")
    total = got.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("lang", "kind").orderBy(F.desc("n"), "key"))
    kept = total.withColumn("r", rank).where(f"r <= {COMMON}").collect()
    found = []
    for lang in sorted({r["lang"] for r in kept}):
        mine = [r for r in kept if r["lang"] == lang]
        classes = np.zeros(CLASSES)
        for r in mine:
            if r["kind"] == "c":
                classes[int(r["key"])] = r["n"]
        words = sorted((r for r in mine if r["kind"] == "w"), key=lambda r: r["r"])
        n = sum(r["n"] for r in mine if r["kind"] == "n")
        if not classes.sum() or not n:
            continue
        counts = np.array([r["n"] for r in words] + [0.0])
        counts[-1] = max(0, n - counts.sum())
        found.append((lang, classes / classes.sum(), [r["key"].encode("latin-1") for r in words], counts / max(n, counts.sum())))
    return found


def measure(text: str | None, refs: list) -> tuple:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_distance, word_distance``; a distance is 0 below its guard."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    word_chars = int(counts @ _POINT - counts[_SPACE].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    if n >= 4:
        ids: dict[bytes, int] = {}
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
        v = len(ids)
        pair = w[:-1] * v + w[1:]
        if v > 2_000_000:
            pair = np.unique(pair, return_inverse=True)[1]
        _, at, times = np.unique(pair[:-1] * v + w[2:], return_inverse=True, return_counts=True)
        twice = times[at] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= twice
        repeated = int(covered.sum())
    near_class = near_word = 0.0
    if refs and word_chars >= GUARD_CHARS:
        p = counts @ _CLASS_ROWS
        near_class = float(js_distance(p / p.sum(), np.stack([r[1] for r in refs])).min())
    if refs and n >= GUARD_WORDS:
        bare = _bare(Counter(words))
        near_word = 1.0
        for _, _, common, q in refs:
            p = np.array([bare[x] for x in common] + [0.0])
            p[-1] = n - p.sum()
            near_word = min(near_word, float(js_distance(p / n, q[None, :])[0]))
    return n, word_chars, int(counts[_SYMBOL].sum()), len(lines) - len(set(lines)), repeated, near_class, near_word


def quality_report(docs: DataFrame, col: str = "quality") -> DataFrame:
    """``docs`` with a struct of counts, distances, ``base_failed`` and ``kept``.

    A null text counts as one without words.  Every row is judged by itself, so ties and repeated rows do
    not matter; an empty table gives an empty result; other columns pass through untouched.
    """
    refs = language_references(docs)
    fields = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, class_distance double, word_distance double"
    names = [x.split()[0] for x in fields.split(", ")]

    @F.pandas_udf(f"struct<{fields.replace(' ', ':').replace(',:', ',')}>")
    @tidy
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([measure(x, refs) for x in texts], columns=names)

    raw = own_name(docs, "measured")
    failed = (F.col(f"{raw}.n_words") < 50) | (100 * F.col(f"{raw}.n_repeat_words") > 50 * F.col(f"{raw}.n_words"))
    fine = (F.col(f"{raw}.class_distance") <= MAX_CLASS) & (F.col(f"{raw}.word_distance") <= MAX_WORD)
    out = docs.withColumn(raw, judge(F.col("text")))
    return out.withColumn(col, F.struct(f"{raw}.*", failed.alias("base_failed"), (~failed & fine).alias("kept"))).drop(raw)


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    col = own_name(docs, "quality")
    return quality_report(docs, col).where(F.col(f"{col}.kept")).select(*docs.columns)


def op9_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = quality_report(documents(spark, sf_dir).select("doc_id", "text", "lang"))
    return docs.select("doc_id", "quality.*")
