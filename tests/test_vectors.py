"""Vector search exactly, and the recall of the index against it."""

import numpy as np
import pytest

from corpusloom.jobs import catalog
from corpusloom.operators import vectors as V

VECTOR = "vec_id long, embedding array<float>"
QUERY = "query_id long, embedding array<float>"


def table(spark, x, ids=None, schema=VECTOR):
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids if ids is not None else range(len(x)), x)], schema)


def brute(q, x, k):
    d = ((q[:, None].astype(np.float64) - x[None].astype(np.float64)) ** 2).sum(2)
    return {i: [int(j) for j in np.argsort(row, kind="stable")[:k]] for i, row in enumerate(d)}


def found(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 12)).astype(np.float32)
    x[::3] = x[0]  # a third of all vectors is one
    return x[:40] + 0.01 * rng.normal(size=(40, 12)).astype(np.float32), x


def test_small_blocks(spark, data, monkeypatch):
    """Blocks bounded on both sides, ties by id."""
    q, x = data
    monkeypatch.setattr(V, "QUERIES", 16)
    monkeypatch.setattr(V, "VECTORS", 100)
    monkeypatch.setattr(V, "AT_ONCE", 7)
    assert found(V.vector_search(table(spark, q, schema=QUERY), table(spark, x), 7)) == brute(q, x, 7)


def test_index_with_all_cells_is_exact(spark, data, monkeypatch):
    q, x = data
    monkeypatch.setattr(V, "QUERIES", 16)
    monkeypatch.setattr(V, "VECTORS", 100)
    index = V.index_vectors(table(spark, x), 7)
    assert max(index.parts.values()) >= 3 and index.lists.groupBy("cell", "part").count().agg({"count": "max"}).first()[0] < 200
    assert found(V.index_search(table(spark, q, schema=QUERY), index, 7, probes=len(index.codes.cells), depth=len(x))) == brute(q, x, 7)


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (None, [0.0, 1.0]), (4, [0.0, None]), (5, [3.0, 1.0]), (6, [float("nan"), 1.0])], VECTOR)
    asked = spark.createDataFrame([(7, [0.0, 1.0]), (8, None)], QUERY)
    assert found(V.vector_search(asked, rows, 3)) == found(V.index_search(asked, V.index_vectors(rows), 3)) == {7: [1, 5]}
    assert V.vector_search(asked, rows.where("false")).count() == 0 and V.index_search(asked, V.index_vectors(rows.where("false"))).count() == 0


@pytest.mark.parametrize("sf", ["sf0.1"])
def test_recall_of_the_index(spark, sf):
    """Recall at 10 of the registered query over all given vectors, against the exact one, and how much it leaves out."""
    q = catalog.queries()
    exact, got = found(q["vector_search"](spark, f"/root/testdata/{sf}")), found(q["vector_index_search"](spark, f"/root/testdata/{sf}"))
    recall = np.mean([len(set(exact[i]) & set(got[i])) / len(exact[i]) for i in exact])
    print(f"recall at 10: {recall:.3f}")
    assert recall >= 0.9


def test_recall_on_clusters(spark):
    """Vectors in clusters: a fifth of the cells is enough."""
    rng = np.random.default_rng(9)
    x = (rng.normal(size=(60, 16))[rng.integers(0, 60, 4000)] + 0.2 * rng.normal(size=(4000, 16))).astype(np.float32)
    index = V.index_vectors(table(spark, x), 10)
    q = x[:100]
    want, got = brute(q, x, 10), found(V.index_search(table(spark, q, schema=QUERY), index, 10))
    assert np.mean([len(set(want[i]) & set(got[i])) / 10 for i in want]) >= 0.9
    assert index.codes.probes <= len(index.codes.cells) / 5
