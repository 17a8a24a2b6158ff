"""Nearest vectors: exactly, block by block, or by an index of coarse cells and residual codes.

The index has cells around centres, and for each vector a code of a byte for each group of components of what its cell's centre leaves.  A query reads the codes of
its nearest cells, ranks them by table look-ups, and measures the best of them exactly.  How many cells and how many exact distances that takes is
measured when the index is fitted, on the sample that it is fitted on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.functions.lineage import cut_lineage

#: Queries and vectors of a pair of blocks at most, and queries whose distances are held at once.
QUERIES, VECTORS, AT_ONCE = 4096, 16_384, 128
#: The sample that an index is fitted on (by a hash of the id, whatever the number of vectors), its cells, bytes of a code, passes of a fit.
SAMPLE, CELLS, BYTES, PASSES = 8192, 64, 8, 10
#: The share of true neighbours that the sample's queries must find, and how many of those queries there are.
RECALL, TRIALS = 0.97, 256
HITS = "query_id long, vec_id long, distance double"


def _stack(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(np.float64) if len(col) else np.zeros((0, 0))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows, summed as differences, so that equal vectors are at zero."""
    return np.stack([((b - x) ** 2).sum(1) for x in a]) if len(a) else np.zeros((0, len(b)))


def _first(distance: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and column numbers of the first ``k`` of each row; ``ids`` rise, so a stable order breaks ties."""
    keep = min(k, distance.shape[1])
    best = np.argsort(distance, axis=1, kind="stable")[:, :keep]
    return np.repeat(np.arange(len(distance)), keep), best.ravel()


def _usable(vectors: DataFrame, name: str) -> DataFrame:
    """Without rows that lack the id or a vector, or any of its components."""
    return vectors.select(F.col(name), "embedding").where(F.col(name).isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)))


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "vec_id", "rank", F.round(1 / (1 + F.col("distance")), 4).alias("score"))


def vector_search(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` nearest vectors (``vec_id, embedding``) of each query (``query_id, embedding``) by squared distance d, ties by id; score ``1 / (1 + d)``.

    Every block of queries meets every block of vectors; blocks have a fixed size, and a pair of them returns its own first ``k`` a query.
    Rows with a null id, vector or component take no part.
    """
    v, q = _usable(vectors, "vec_id"), _usable(queries, "query_id")
    vb, qb = (max(1, -(-df.count() // size)) for df, size in ((v, VECTORS), (q, QUERIES)))
    v = v.withColumn("vb", F.pmod(F.xxhash64("vec_id"), F.lit(vb)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))))
    q = q.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(qb)).cast("int")).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(vb - 1))))

    def near(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            right = right.sort_values("vec_id")
            a, b, ids, of = _stack(left["embedding"]), _stack(right["embedding"]), right["vec_id"].to_numpy(), left["query_id"].to_numpy()
            for at in range(0, len(a), AT_ONCE):
                d = squared(a[at : at + AT_ONCE], b)
                r, c = _first(d, ids, k)
                out.append(pd.DataFrame({"query_id": of[at : at + AT_ONCE][r], "vec_id": ids[c], "distance": d[r, c]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "distance": []})

    return _ranked(q.groupBy("vb", "qb").cogroup(v.groupBy("vb", "qb")).applyInPandas(near, HITS), k)


def means(x: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Centres by Lloyd's passes; fewer than ``n`` if there are fewer different rows."""
    centres = np.unique(x, axis=0)
    centres = centres[rng.permutation(len(centres))[:n]]
    for _ in range(PASSES):
        near = nearest(x, centres)
        centres = np.stack([x[near == j].mean(0) if (near == j).any() else c for j, c in enumerate(centres)])
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)


class Codes:
    """Centres of cells and, for each group of components, the centres of what they leave."""

    def __init__(self, sample: np.ndarray, k: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.cells = means(sample, max(1, min(CELLS, len(sample) // 16)), rng)
        self.cuts = np.linspace(0, sample.shape[1], min(BYTES, sample.shape[1]) + 1).astype(int)
        rest = sample - self.cells[nearest(sample, self.cells)]
        self.books = [means(rest[:, a:b], 256, rng) for a, b in zip(self.cuts, self.cuts[1:])]
        self.probes, self.depth = self._tuned(sample, k, rng)

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell and the code of each row."""
        cell = nearest(x, self.cells)
        rest = x - self.cells[cell]
        return cell, np.stack([nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)], 1).astype(np.uint8)

    def probed(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest cells of each row."""
        return np.argsort(squared(x, self.cells), axis=1, kind="stable")[:, :n]

    def rough(self, query: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Distances of a query to coded rows of one cell, by tables of its distances to the books' entries."""
        rest = query - self.cells[cell]
        return sum(((book - rest[a:b]) ** 2).sum(1)[codes[:, j]] for j, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books)))

    def _tuned(self, sample: np.ndarray, k: int, rng: np.random.Generator) -> tuple[int, int]:
        """The fewest cells, then the fewest exact distances, with which queries of the sample find enough of their true neighbours in it."""
        asked = rng.permutation(len(sample))[:TRIALS]
        d = squared(sample[asked], sample)
        true = np.argsort(d, axis=1, kind="stable")[:, :k]
        cell, codes = self.code(sample)
        order = self.probed(sample[asked], len(self.cells))
        place = np.argsort(order, axis=1)
        at = np.sort(place[np.arange(len(asked))[:, None], cell[true]], axis=1)
        probes = next((n for n in range(1, len(self.cells) + 1) if (at < n).mean() >= (1 + RECALL) / 2), len(self.cells))
        rough = np.full(d.shape, np.inf)
        for i in range(len(asked)):
            for c in order[i, :probes]:
                mine = np.flatnonzero(cell == c)
                rough[i, mine] = self.rough(sample[asked[i]], c, codes[mine])
        rank = np.argsort(np.argsort(rough, axis=1, kind="stable"), axis=1)[np.arange(len(asked))[:, None], true]
        # a larger corpus is denser, so the depth that the sample needs is doubled
        depth = next((n for n in (2 * k, 4 * k, 8 * k, 16 * k, 32 * k) if (rank < n).mean() >= RECALL), 64 * k)
        return probes, 2 * depth


@dataclass(frozen=True)
class VectorIndex:
    """``codes``: what the driver and tasks know; ``lists``: ``cell, part, vec_id, code`` of all vectors; ``vectors``: ``vec_id, embedding``."""

    codes: Codes
    lists: DataFrame
    vectors: DataFrame
    parts: dict[int, int]


def index_vectors(vectors: DataFrame, k: int = 10) -> VectorIndex | None:
    """Fit on about ``SAMPLE`` vectors and index all of them; None if there is none.

    Rows with a null id, vector or component take no part; all vectors have one length.  A cell of more than ``VECTORS`` rows, say of
    copies of one vector, is dealt into parts.
    """
    own = _usable(vectors, "vec_id")
    n = own.count()
    if not n:
        return None
    h = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 31))
    sample = own.where(h <= min((1 << 31) - 1, (SAMPLE << 31) // n)).toPandas()
    sample = (sample if len(sample) else own.limit(1).toPandas()).sort_values("vec_id", kind="stable")
    codes = Codes(_stack(sample["embedding"]), k)

    def coded(batches):
        for b in batches:
            cell, code = codes.code(_stack(b["embedding"])) if len(b) else (np.zeros(0, int), np.zeros((0, 1), np.uint8))
            yield pd.DataFrame({"cell": cell.astype(np.int32), "vec_id": b["vec_id"], "code": [c.tobytes() for c in code]})

    lists = cut_lineage(own.mapInPandas(coded, "cell int, vec_id long, code binary"))
    # one row for each cell
    parts = {r["cell"]: -(-r["count"] // VECTORS) for r in lists.groupBy("cell").count().collect()}
    spread = F.create_map(*(F.lit(x) for kv in parts.items() for x in kv))
    lists = lists.withColumn("part", F.pmod(F.xxhash64("vec_id"), spread[F.col("cell")]).cast("int"))
    return VectorIndex(codes, lists, own, parts)


def index_search(queries: DataFrame, index: VectorIndex | None, k: int = 10, probes: int | None = None, depth: int | None = None) -> DataFrame:
    """As :func:`vector_search`, among the candidates that the index gives; with all cells as ``probes`` and every row as ``depth`` it is exact."""
    q = _usable(queries, "query_id")
    if index is None:
        return q.sparkSession.createDataFrame([], "query_id long, vec_id long, rank int, score double")
    codes, probes, depth = index.codes, probes or index.codes.probes, depth or index.codes.depth
    parts = index.parts

    def aim(batches):
        for b in batches:
            cells = codes.probed(_stack(b["embedding"]), probes) if len(b) else np.zeros((0, 1), int)
            rows = [(i, c, p) for i, cs in enumerate(cells) for c in cs for p in range(parts.get(c, 0))]
            i, c, p = (np.array(x, dtype=int) for x in zip(*rows)) if rows else (np.zeros(0, int),) * 3
            yield pd.DataFrame({"query_id": b["query_id"].to_numpy()[i], "embedding": b["embedding"].to_numpy()[i], "cell": c.astype(np.int32), "part": p.astype(np.int32)})

    qb = max(1, -(-q.count() // QUERIES))
    asked = q.mapInPandas(aim, "query_id long, embedding array<float>, cell int, part int").withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(qb)).cast("int"))
    lists = index.lists.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))))

    def near(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            right = right.sort_values("vec_id")
            ids, code, cell = right["vec_id"].to_numpy(), np.frombuffer(b"".join(right["code"]), np.uint8).reshape(len(right), -1), int(right["cell"].iloc[0])
            for query, x in zip(left["query_id"], left["embedding"]):
                d = codes.rough(np.asarray(x, np.float64), cell, code)
                best = np.argsort(d, kind="stable")[:depth]
                out.append(pd.DataFrame({"query_id": query, "vec_id": ids[best], "distance": d[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "distance": []})

    key = ["cell", "part", "qb"]
    rough = asked.groupBy(*key).cogroup(lists.groupBy(*key)).applyInPandas(near, HITS)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "vec_id"))
    few = rough.withColumn("r", rank).where(F.col("r") <= depth).select("query_id", "vec_id")
    met = few.join(index.vectors, "vec_id").join(q.select("query_id", F.col("embedding").alias("asked")), "query_id")
    apart = F.aggregate(F.zip_with("asked", "embedding", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return _ranked(met.select("query_id", "vec_id", apart.alias("distance")), k)
