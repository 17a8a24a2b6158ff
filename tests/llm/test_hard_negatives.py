"""Hard negatives against brute force over all pairs, in whole numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, score string, cell int"


def brute(given, n_positives=5, n_negatives=3):
    """The contract row by row; ``given``: (vec_id, vector, label)."""
    rows = set()
    for i, v, label in given:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        rows.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    out = []
    for a, label, c in (r for r in rows if r[0] % 50 == 0):
        scored = [(-sum(x * y for x, y in zip(c, d)), i, other == label) for i, other, d in rows]
        positives = sorted((s, i) for s, i, same in scored if same and i != a)[:n_positives]
        for s, p in positives:
            fit = sorted((t, i) for t, i, same in scored if not same and 50 * -s <= 100 * -t <= 95 * -s)[:n_negatives]
            out += [(a, p, rank, i, -s, -t) for rank, (t, i) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, given, **how):
    df = spark.createDataFrame([(i, v, label, "x", 0) for i, v, label in given], SCHEMA)
    flipped = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hn.quantised(df, flipped)
    got = hn.hard_negatives(rows, rows.where("vec_id % 50 = 0"), **how)
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got.collect())


def clustered(n, dim, seed=3, spread=0.6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    return [(i, [float(x) for x in np.float32(centres[i % 12] + spread * rng.normal(size=dim))], int(rng.integers(0, 10))) for i in range(n)]


@pytest.mark.parametrize(("cell", "slot", "start"), [(64, 3, 0.01)])
def test_brute_force(spark, monkeypatch, cell, slot, start):
    """Also with many small cells, anchors in several slots, and narrow first annuli."""
    monkeypatch.setattr(hn, "CELL", cell)
    monkeypatch.setattr(hn, "SLOT", slot)
    monkeypatch.setattr(hn, "START", start)
    given = clustered(700, 8)
    want = brute(given)
    assert len(want) > 100 and mined(spark, given) == want


def test_ties_copies_and_odd_rows(spark):
    """A third of all rows is one vector; nulls, infinities, zeros, vectors of other lengths, repeated rows, ids below zero."""
    given = clustered(240, 5, seed=5)
    given = [(i, given[0][1] if i % 3 == 0 else v, label) for i, v, label in given]
    given += [given[7], given[50], (None, given[0][1], 1), (1000, None, 1), (1001, given[0][1], None), (1050, [1.0, None, 1.0, 1.0, 1.0], 2), (1100, [float("nan")] * 5, 2), (1102, [float("inf")] * 5, 2)]
    given += [(1150, [0.0] * 5, 3), (1151, [0.0] * 5, 4), (1152, [0.0] * 5, 3), (1200, [], 3), (1250, [1.5, -2.0], 3), (1251, [1.0] * 9, 5), (-50, [2.0] * 5, 6), (-51, [2.0] * 5, 6)]
    assert mined(spark, given) == brute(given)


def test_one_label_and_few_rows(spark):
    assert mined(spark, [(50, [1.0, 2.0], 1), (51, [1.0, 1.0], 1)]) == []
    assert mined(spark, [(50, [1.0, 2.0], 1), (51, [1.0, 1.0], 1), (52, [1.0, 0.5], 2)]) == [(50, 51, 1, 52, 196608, 131072)]
    assert mined(spark, []) == []


def test_huge_numbers(spark):
    """Numbers beyond the bound are held to it, and whole numbers are exact where floating point would not be."""
    given = [(50, [1e5, 3e5], 1), (51, [2e5, 1.5e5], 1), (52, [1.2e5, 1.1e5], 2), (53, [0.9e5, 1.7e5], 2)]
    assert mined(spark, given) == brute(given) != []
    assert mined(spark, [(50, [3e38, 1.0], 1), (51, [3e38, 2.0], 1), (52, [4e6, 1.0], 2)])


def test_shares(spark):
    values = [*range(-45, 46), 10**18 + 7, -(10**18) - 7]
    got = spark.createDataFrame([(v,) for v in values], "x long").select("x", hn._share(F.col("x"), 19, 20).alias("down"), (-hn._share(-F.col("x"), 1, 2)).alias("up")).collect()
    assert all(r.down == r.x * 19 // 20 and r.up == -(-r.x // 2) for r in got)


def test_annuli_leave_cells_out(spark):
    """With well separated clusters a certified search does not scan all cells."""
    given = clustered(1500, 6, spread=0.02)
    rows = hn.quantised(spark.createDataFrame([(i, v, i % 12, "x", 0) for i, v, _ in given], SCHEMA), F.col("label"))
    store, keys = hn.store_of(rows)
    asked = np.stack([np.floor(256 * np.array(v)) for i, v, _ in given if i % 50 == 0])
    norm = (asked * asked).sum(1)
    # a window down to the score of a close row
    lows = [[int(0.99 * n)] for n in norm]
    _, cells, over = keys.reach(asked, np.full(len(asked), -1.0), lows, [[hn.MOST]] * len(asked), [[True]] * len(asked), 1.0)
    assert over.all() and np.mean([len(c) for c in cells]) < len(keys.pivot) / 3
    assert store.count() == 1500 and store.select("cell").distinct().count() == len(keys.pivot)
