"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Pieces are range-sorted by length and get a rank among the pieces of their length.  A round takes all pieces of one
length, longest first, and the runs of open sequences by gap; the successor of the length among the gaps is
filled first, ranks say which piece goes to which sequence, and the gaps are updated before the next round.  As
lengths and gaps are whole numbers up to the capacity, a round works on runs (a length and a count, a gap and
a range of sequences), so the rounds cost the same at any input size; only the ranks, and the placing by rank, touch
the pieces, both distributed.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.llm.common import documents, materialize, tidy

CAPACITY, END_ID = 2048, 0
#: The tokenizer file's one added token, which it finds in texts before words are cut, and its id.
ADDED, ADDED_ID = "<|endoftext|>", 50256
#: Words that a Python worker keeps with their ids.
MEMO = 250_000


def tokenizer_paths() -> tuple[str, str]:
    """Places of the byte-level BPE file and of the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class ByteBpe:
    """Ids of whole texts as little-endian 32-bit numbers.

    Words are split from each other before a space that follows no white space; no piece of the byte-level
    pattern reaches across such a place, so a word's ids do not depend on its neighbours and can be kept.  New words go through the
    rank file, which holds the vocabulary of the tokenizer file; the tests hold both against each other.
    """

    _cut = re.compile(r"(?<=\S)(?= )")
    _space_run = re.compile(r"\s ")

    def __init__(self, ranks_path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encode = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._memo: dict[str, bytes] = {}

    def encode_whole(self, text: str) -> bytes:
        """As the tokenizer file by default: the added token is one id wherever it stands, and what stands between is encoded by itself."""
        if ADDED not in text:
            return self.encode(text)
        return np.array([ADDED_ID], "<u4").tobytes().join([self.encode(x) if x else b"" for x in text.split(ADDED)])

    def _plain(self, text: str) -> bytes:
        return np.array(self._encode(text), "<u4").tobytes()

    def _spaced(self, word: str) -> bytes:
        ids = self._plain(" " + word)
        if len(self._memo) < MEMO and len(word) <= 64:
            self._memo[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self._space_run.search(text):
            first, *rest = self._cut.split(text)
            rest = [x[1:] for x in rest]
        else:
            first, *rest = text.split(" ")
            if not first:  # a leading space belongs to the first word
                return self._words(rest)
        return self._plain(first) + self._words(rest)

    def _words(self, words: list[str]) -> bytes:
        memo = self._memo
        try:
            return b"".join([memo[w] for w in words])
        except KeyError:
            return b"".join([memo[w] if w in memo else self._spaced(w) for w in words])


_loaded: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    """One per Python worker and file."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` ids: the first takes what is left over, the others are full."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(a, capacity) for a in range(first, n, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, ranks_path: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of whole texts, the end id included."""
    path = ranks_path or tokenizer_paths()[1]
    end = np.array([END_ID], "<u4").tobytes()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(path).encode_whole
        for batch in batches:
            out: list[tuple] = []
            for i, text in enumerate(batch["text"]):
                ids = encode(text.as_py() or "") + end
                out += [(i, k, a, n, zlib.crc32(ids[4 * a : 4 * (a + n)])) for k, (a, n) in enumerate(cut(len(ids) // 4, capacity))]
            if out:
                at, *cols = zip(*out)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(at)), *(pa.array(c, t) for c, t in zip(cols, kinds))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return small.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Best-fit rounds over runs.  ``counts[n]`` pieces have length ``n``.

    Columns: length, first rank, pieces, first sequence, pieces in each sequence, offset of the first of them.
    """
    runs: dict[int, list[tuple[int, int]]] = {}
    gaps: list[int] = []
    made, next_seq = [], 0

    def open_gap(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in runs:
                runs[gap] = []
                insort(gaps, gap)
            runs[gap].append((first, n))

    for length in range(capacity, 0, -1):
        rank, left = 0, int(counts[length])
        while left:
            at = bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, n = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], gaps[at]
            else:  # no gap is wide enough: as many new sequences as these pieces need
                gap, first, n = capacity, next_seq, -(-left // (capacity // length))
                next_seq += n
            each = gap // length
            full = min(n, left // each)
            if full:
                made.append((length, rank, full * each, first, each, capacity - gap))
                open_gap(gap - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left and left < each:
                made.append((length, rank, left, first + full, each, capacity - gap))
                open_gap(gap - left * length, first + full, 1)
                open_gap(gap, first + full + 1, n - full - 1)
                rank, left = rank + left, 0
            elif full < n:
                open_gap(gap, first + full, n - full)
    return np.array(made, np.int64).reshape(-1, 6)


def ranked(own: DataFrame) -> DataFrame:
    """``own`` with ``rank``, from 0, among the pieces of its length; no length is gathered in one task."""
    n = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.repartitionByRange(n, "length", "ids_crc32", "doc_id", "piece").withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, "pack-sorted")
    local = F.row_number().over(W.partitionBy("part", "length").orderBy("ids_crc32", "doc_id", "piece"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = dealt.groupBy("part", "length").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(before, F.lit(0))).drop("n")
    return dealt.withColumn("local", local).join(offsets, ["part", "length"]).withColumn("rank", F.col("before") + F.col("local") - 1).drop("part", "local", "before")


def pack(docs: DataFrame, capacity: int = CAPACITY, ranks_path: str | None = None) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null and empty texts are one piece of the end id alone; repeated rows are packed each by itself; an empty table gives an
    empty result.  Only documents above the capacity are cut.
    """
    own = materialize(pieces(docs, capacity, ranks_path), "pack-pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in own.groupBy("length").count().collect():  # as many rows as the capacity at most
        counts[row["length"]] = row["count"]
    made = plan(counts, capacity)
    made = made[np.lexsort((made[:, 1], made[:, 0]))]
    starts = made[:, 0] * (1 << 48) + made[:, 1]

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), rank.to_numpy()
        if not len(n):
            return pd.DataFrame({"sequence_id": n, "offset": n})
        at = np.searchsorted(starts, n * (1 << 48) + r, "right") - 1
        k, each = r - made[at, 1], made[at, 4]
        return pd.DataFrame({"sequence_id": made[at, 3] + k // each, "offset": made[at, 5] + k % each * n})

    placed = ranked(own).withColumn("place", place("length", "rank"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset")


def op3_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
