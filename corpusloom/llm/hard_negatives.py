"""Hard-negative mining over one-dimensional distance keys.

The largest inner product is the smallest distance once every vector gets one more component, which brings all of them to the
length of the longest, and anchors get a zero there.  Each vector is keyed by its nearest pivot and its distance from it, and stored
sorted by that key, cut into cells of consecutive keys.  By the triangle inequality what lies within a radius of an anchor lies, for every
pivot, in one interval of keys (an annulus), so an anchor's search scans the cells of those intervals, and widens them round by round,
until the bound of all cells not yet scanned says that none of them can hold a row of its top k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.llm.common import discard, materialize, tidy

#: Pivots, rows that they are fitted on (a sample by hash; all rows are keyed), passes of that fit, histogram buckets of distances for each pivot.
PIVOTS, SAMPLE, FIT, BUCKETS = 32, 4096, 8, 1024
#: Rows of a cell and anchors of a group that meet in a task at most, and anchors that are multiplied at once.
CELL, SLOT, BLOCK = 16_384, 16_384, 256
#: Share of all rows that the first scan of an anchor takes in, and by what it grows from round to round.
START, GROW = 0.05, 4
LEAST, MOST = -(1 << 62), 1 << 62

ANCHOR = ["anchor_id", "twin"]


def quantised(vectors: DataFrame, label: Column, scale: int = 256) -> DataFrame:
    """``vec_id, label, code``: whole numbers ``floor(scale * x)`` as 4-byte integers; without rows that have a null id, label, vector or component, or one that is not finite.

    A number is held to the square root of 2^62 over the vector's length (for 64 components 2^28), so that every inner product fits 64 bits.
    Rows that repeat id, label and vector count once.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch["x"]
            flat, offsets = vec.flatten(), vec.offsets.to_numpy()
            flat = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
            odd = np.r_[0, np.cumsum(~np.isfinite(flat))]
            begin, end = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
            fine = odd[end] == odd[begin]
            with np.errstate(invalid="ignore", over="ignore"):
                held = np.sqrt(2.0**62 / np.maximum(1, end - begin))
                limit = np.repeat(np.minimum(np.floor(held), 2.0**31 - 1), end - begin)
                codes = np.nan_to_num(np.clip(np.floor(flat * scale), -limit, limit)).astype("<i4")
            raw, at = codes.tobytes(), np.flatnonzero(fine)
            out = [batch["vec_id"].take(pa.array(at)), batch["label"].take(pa.array(at)), pa.array([raw[4 * begin[i] : 4 * end[i]] for i in at], pa.binary())]
            yield pa.RecordBatch.from_arrays(out, ["vec_id", "label", "code"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("int").alias("label"), F.col("embedding").alias("x")).where("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL")
    return rows.mapInArrow(run, "vec_id long, label int, code binary").dropDuplicates(["code", "label", "vec_id"])


def unpack(codes: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows of ``dim`` numbers; shorter vectors end in zeros."""
    got = [np.frombuffer(x, "<i4") for x in codes.to_pylist()]
    out = np.zeros((len(got), dim))
    if got and all(len(x) == dim for x in got):
        return np.stack(got).astype(np.float64)
    for row, x in zip(out, got):
        row[: len(x)] = x
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows; by floating point where no sum can leave its whole numbers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class Keys:
    """Pivots and the cells of the sorted store: what a search must know to choose its annuli.

    Holds ``PIVOTS`` vectors and four numbers for each cell; cells hold up to ``CELL`` rows, but for those of equal distance buckets, which are
    dealt by hash into cells with the same bounds.
    """

    def __init__(self, dim: int, longest: float, sample: np.ndarray, seed: int = 7):
        self.dim, self.longest = dim, longest
        aug = self.augment(sample)
        rng = np.random.default_rng(seed)
        self.pivots = aug[rng.permutation(len(aug))[:PIVOTS]]
        for _ in range(FIT):
            near = self.distances(aug).argmin(1)
            self.pivots = np.stack([aug[near == j].mean(0) if (near == j).any() else p for j, p in enumerate(self.pivots)])
        # no two augmented vectors lie further apart than twice the longest
        self.width = max(2 * np.sqrt(longest), 1.0) * (1 + 1e-9) / BUCKETS
        self.slack = 1e-6 * max(1.0, np.sqrt(longest))

    def augment(self, x: np.ndarray) -> np.ndarray:
        return np.c_[x, np.sqrt(np.maximum(0, self.longest - (x * x).sum(1)))]

    def distances(self, aug: np.ndarray) -> np.ndarray:
        p = self.pivots
        return np.sqrt(np.maximum(0, (aug * aug).sum(1)[:, None] + (p * p).sum(1) - 2 * (aug @ p.T)))

    def cut(self, counts: np.ndarray, rows: int) -> None:
        """Cells from the counts (pivots, buckets) of all rows."""
        size = min(CELL, max(256, rows // (4 * PIVOTS)))
        self.first = np.zeros(counts.shape, np.int64)
        self.parts = np.ones(counts.shape, np.int64)
        cells = []
        for j, row in enumerate(counts):
            at = 0
            while at < BUCKETS:
                end, n = at, 0
                while end < BUCKETS and (end == at or n + row[end] <= size):
                    n, end = n + int(row[end]), end + 1
                if n:
                    parts = -(-n // CELL)
                    self.first[j, at:end], self.parts[j, at:end] = len(cells), parts
                    # bounds are those of the buckets that have rows
                    some = at + np.flatnonzero(row[at:end])
                    cells += [(j, some[0] * self.width, (some[-1] + 1) * self.width, n / parts)] * parts
                at = end
        self.pivot, self.low, self.high, self.rows = (np.array(c) for c in zip(*cells)) if cells else (np.zeros(0, int),) * 4

    def far(self, norm: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance from an anchor of squared length ``norm`` at which a row has that score."""
        return np.sqrt(np.maximum(0, self.longest + norm - 2.0 * score))

    def reach(self, anchors: np.ndarray, before: np.ndarray, lows: list, highs: list, found: list, share: float) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Next radius of each anchor, the cells that it takes in, and whether nothing is left beyond it."""
        norm = (anchors * anchors).sum(1)
        d = self.distances(np.c_[anchors, np.zeros(len(anchors))])[:, self.pivot]
        least, most = np.maximum(0, np.maximum(d - self.high, self.low - d)), d + self.high
        radius, cells, over = np.zeros(len(anchors)), [], np.zeros(len(anchors), bool)
        for i in range(len(anchors)):
            need = self.far(norm[i], np.array(lows[i], float)).max() + self.slack
            order = np.argsort(least[i], kind="stable")
            at = min(np.searchsorted(np.cumsum(self.rows[order]), share * self.rows.sum()), len(order) - 1)
            # with k rows found for every window, what they leave is the last scan
            radius[i] = need if all(found[i]) else min(need, least[i][order[at]])
            over[i] = radius[i] >= need or radius[i] >= least[i][order[-1]]
            begin = self.far(norm[i], np.array(highs[i], float)).min() - self.slack
            cells.append(np.flatnonzero((least[i] > before[i]) & (least[i] <= radius[i]) & (most[i] >= begin)))
        return radius, cells, over


def store_of(rows: DataFrame) -> tuple[DataFrame, Keys] | None:
    """The rows (``vec_id, label, code``) with their cells, sorted by (pivot, distance) in the shared folder, and the keys; None without rows."""

    @F.pandas_udf("double")
    def squared(codes: pd.Series) -> pd.Series:
        return codes.map(lambda x: float((np.frombuffer(x, "<i4").astype(np.float64) ** 2).sum()))

    total = rows.agg(F.count("*").alias("n"), F.max(F.length("code") / 4).alias("dim"), F.max(squared("code")).alias("longest")).first()
    if not total.n:
        return None
    dim = max(1, int(total.dim))
    h = F.pmod(F.xxhash64("vec_id", "label", "code"), F.lit(1 << 31))
    # what reaches the driver is a share of the rows that the count sets; at least one row where the hash leaves none
    sample = rows.where(h <= min((1 << 31) - 1, (SAMPLE << 31) // total.n)).select("code").toArrow()
    sample = unpack((sample if sample.num_rows else rows.select("code").limit(1).toArrow())["code"], dim)
    keys = Keys(dim, total.longest, sample[np.lexsort(sample.T)])

    @tidy
    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = keys.distances(keys.augment(unpack(batch["code"], dim)))
            near = d.argmin(1).astype(np.int32)
            own = d[np.arange(len(d)), near]
            bucket = np.minimum((own / keys.width).astype(np.int32), BUCKETS - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near), pa.array(own), pa.array(bucket)], [*batch.schema.names, "pivot", "distance", "bucket"])

    keyed = materialize(rows.select("vec_id", "label", "code", h.alias("h")).mapInArrow(key, "vec_id long, label int, code binary, h long, pivot int, distance double, bucket int"), "mining-keys")
    counts = np.zeros((len(keys.pivots), BUCKETS), np.int64)
    for r in keyed.groupBy("pivot", "bucket").count().collect():
        counts[r["pivot"], r["bucket"]] = r["count"]
    keys.cut(counts, total.n)

    @F.pandas_udf("int")
    def cell(pivot: pd.Series, bucket: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(keys.first[pivot, bucket] + h.to_numpy() % keys.parts[pivot, bucket], dtype="int32")

    tasks = max(1, min(len(keys.pivot), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    placed = keyed.select(cell("pivot", "bucket", "h").alias("cell"), "pivot", "distance", "vec_id", "label", "code")
    placed = materialize(placed.repartitionByRange(tasks, "cell", "distance").sortWithinPartitions("cell", "pivot", "distance"), "mining-store")
    discard(keyed)
    return placed, keys


def search(store: DataFrame, keys: Keys, anchors: DataFrame, k: int, same: bool) -> DataFrame:
    """``anchor_id, twin, w, rank, vec_id, score``: the first ``k`` stored rows (highest score, then smallest id) for each anchor's windows of scores.

    ``anchors`` has ``anchor_id, twin, label, code`` and arrays ``lows, highs``, a window for each place ``w`` of them.  Rows have the anchor's label and
    another id if ``same``, another label if not.
    """
    dim, spark = keys.dim, store.sparkSession
    state = "anchor_id long, twin int, label int, code binary, lows array<long>, highs array<long>, found array<boolean>, before double"

    def aimed_at(active: DataFrame, share: float) -> DataFrame:
        @tidy
        def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, BLOCK):
                    batch = whole.slice(at, BLOCK)
                    before = batch["before"].to_numpy(zero_copy_only=False)
                    radius, cells, over = keys.reach(unpack(batch["code"], dim), before, batch["lows"].to_pylist(), batch["highs"].to_pylist(), batch["found"].to_pylist(), share)
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(radius), pa.array(cells, pa.list_(pa.int32())), pa.array(over)], [*batch.schema.names, "cells", "over"])

        return materialize(active.mapInArrow(aim, f"{state}, cells array<int>, over boolean"), "mining-aimed", collect=False)

    aimed = aimed_at(anchors.select(*ANCHOR, "label", "code", "lows", "highs", F.transform("lows", lambda _: F.lit(False)).alias("found"), F.lit(-1.0).alias("before")), START)
    best, share, n = None, START, aimed.count()
    while n:
        slots = -(-n // SLOT)
        asked = aimed.select(*ANCHOR, "label", "code", "lows", "highs", F.explode("cells").alias("cell"), F.pmod(F.xxhash64(*ANCHOR), F.lit(slots)).cast("int").alias("slot"))
        needed = [r["cell"] for r in asked.select("cell").distinct().collect()]
        scanned = store.where(F.col("cell").isin(needed)).select("cell", "vec_id", "label", "code", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
        hits = asked.groupBy("cell", "slot").cogroup(scanned.groupBy("cell", "slot")).applyInArrow(_meeting(dim, k, same), "anchor_id long, twin int, w int, vec_id long, score long")
        rank = F.row_number().over(W.partitionBy(*ANCHOR, "w").orderBy(F.desc("score"), "vec_id"))
        ranked = (best.drop("rank").unionByName(hits) if best is not None else hits).withColumn("rank", rank).where(F.col("rank") <= k)
        best = materialize(ranked, "mining-best")
        # windows with k rows need nothing below the last of them from now on
        full = best.where(F.col("rank") == k).groupBy(*ANCHOR).agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("last"))
        rest = aimed.where("NOT over").join(full, ANCHOR, "left")
        low = F.transform("lows", lambda x, w: F.coalesce(F.col("last")[w], x))
        found = F.transform("lows", lambda x, w: F.coalesce(F.col("last")[w].isNotNull(), F.lit(False)))
        before, share = aimed, share * GROW
        aimed = aimed_at(rest.select(*ANCHOR, "label", "code", low.alias("lows"), "highs", found.alias("found"), "before"), share)
        discard(before)
        n = aimed.count()
    return best if best is not None else spark.createDataFrame([], "anchor_id long, twin int, w int, vec_id long, score long, rank int")


def _meeting(dim: int, k: int, same: bool):
    """What a group of anchors finds in one cell: for each window the first ``k`` rows."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            right = right.take(pa.compute.sort_indices(right["vec_id"]))
            rows, ids, labels = unpack(right["code"], dim), right["vec_id"].to_numpy(), right["label"].to_numpy()
            own, anchor, twin, lows, highs = left["label"].to_numpy(), left["anchor_id"].to_numpy(), left["twin"].to_numpy(), left["lows"].to_pylist(), left["highs"].to_pylist()
            asked = unpack(left["code"], dim)
            for label in np.unique(own):
                cols = np.flatnonzero((labels == label) == same)
                mine = np.flatnonzero(own == label)
                for at in range(0, len(mine) if len(cols) else 0, BLOCK):
                    some = mine[at : at + BLOCK]
                    scores = products(asked[some], rows[cols])
                    if same:
                        scores[anchor[some][:, None] == ids[cols]] = LEAST
                    out += _first(scores, ids[cols], k, [lows[i] for i in some], [highs[i] for i in some], anchor[some], twin[some])
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 5
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("anchor_id", "twin", "w", "vec_id", "score"), cols, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))})

    return meet


def _first(scores: np.ndarray, ids: np.ndarray, k: int, lows: list, highs: list, anchor: np.ndarray, twin: np.ndarray) -> Iterator[tuple]:
    """Of each row of scores and each of its windows the first ``k``; ``ids`` rise, so equal scores are in order already."""
    for w in range(max(map(len, lows))):
        # a row without this window gets an empty one
        low = np.array([x[w] if w < len(x) else MOST for x in lows])
        high = np.array([x[w] if w < len(x) else LEAST for x in highs])
        held = np.where((scores >= low[:, None]) & (scores <= high[:, None]) & (scores > LEAST), scores, LEAST)
        least = np.partition(held, -k, axis=1)[:, -k] if held.shape[1] > k else np.full(len(held), LEAST)
        r, c = np.nonzero((held >= least[:, None]) & (held > LEAST))
        s = held[r, c]
        order = np.lexsort((c, -s, r))
        r, c, s = r[order], c[order], s[order]
        begin = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, int)
        rank = np.arange(len(r)) - np.repeat(begin, np.diff(np.r_[begin, len(r)]))
        r, c, s = (x[rank < k] for x in (r, c, s))
        yield anchor[r], twin[r], np.full(len(r), w), ids[c], s


def _share(x: Column, part: int, of: int) -> Column:
    """``floor(x * part / of)`` of whole numbers, without a product that could leave 64 bits: by the quotient and the rest apart."""
    rest = F.pmod(x, F.lit(of))
    quotient = F.call_function("div", x - rest, F.lit(of))
    return quotient * part + F.call_function("div", rest * part, F.lit(of))


def hard_negatives(rows: DataFrame, anchors: DataFrame, n_positives: int = 5, n_negatives: int = 3, least: tuple[int, int] = (1, 2), most: tuple[int, int] = (19, 20)) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` over rows ``vec_id, label, code`` as :func:`quantised` makes them.

    An anchor's positives are its first ``n_positives`` other rows of its label by inner product, all if fewer, ties by smaller id; for each of them come the
    first ``n_negatives`` rows of another label whose score is at least ``least`` and at most ``most`` of the positive's (fractions).  A positive score below
    zero has none, as no number is at least half and at most 19/20 of it; of zero, those of zero.  ``anchors`` are some of the rows; two of one id are two anchors.
    Of equal vectors of one label those with the smallest ids alone can be among the first, so that a vector in any number of copies is a few rows here.
    An empty table, or one without anchors, gives an empty result.
    """
    rank = F.row_number().over(W.partitionBy("code", "label").orderBy("vec_id"))
    few = rows.withColumn("r", rank).where(F.col("r") <= max(n_positives + 1, n_negatives)).drop("r")
    few = materialize(few, "mining-rows")
    twin = F.row_number().over(W.partitionBy("vec_id").orderBy("label", "code"))
    asked = materialize(anchors.select(F.col("vec_id").alias("anchor_id"), twin.alias("twin"), "label", "code"), "mining-asked")
    built = store_of(few)
    if built is None:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    store, keys = built
    every = asked.withColumns({"lows": F.array(F.lit(LEAST)), "highs": F.array(F.lit(MOST))})
    positives = search(store, keys, every, n_positives, True).select(*ANCHOR, F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("w"))
    p = F.col("positive_score")
    wanted = positives.withColumns({"low": -_share(-p, *least), "high": _share(p, *most)})
    windows = wanted.groupBy(*ANCHOR).agg(F.array_sort(F.collect_list(F.struct("w", "low", "high"))).alias("s"))
    # windows stand at the place of their positive; places run from 0 without gaps
    windows = windows.select(*ANCHOR, F.col("s.low").alias("lows"), F.col("s.high").alias("highs"))
    negatives = search(store, keys, asked.join(windows, ANCHOR), n_negatives, False)
    out = positives.join(negatives.select(*ANCHOR, "w", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), [*ANCHOR, "w"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op12_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = materialize(quantised(vectors, label), "mining-vectors")
    return hard_negatives(rows, rows.where("vec_id % 50 = 0"))


OP12_SQL = """
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.c, b.c), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same),
n AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE r <= 5 AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""
