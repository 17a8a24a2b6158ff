"""The filter audit against a plain simulation of every order, document by document."""

from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from corpusloom.llm import filter_audit


def words(text):
    out = [""]
    for c in text:
        if c in "\t\n\x0b\x0c\r ":
            out.append("")
        else:
            out[-1] += c
    return [w for w in out if w]


def simulate(docs, labels):
    """Counter of (part, order, step, outcome) by letting each order run over all documents."""
    found, parts = Counter(), set()
    for doc_id, text, lang in docs:
        text, part = text or "", lang or ""
        parts.add(part)
        w = words(text)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), "D": any(c in "#$%&*|" for c in text),
            "E": doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in docs),
        }
        good = any(i == doc_id and q == 1 for i, q, _ in labels if i is not None)
        toxic = any(i == doc_id and x == 1 for i, _, x in labels if i is not None)
        for order in map("".join, permutations("ABCDE")):
            there = True
            for step, f in enumerate(order, 1):
                key = (part, order, step)
                if fails[f] and there:
                    found[key, "removed"] += 1
                    found[key, "good_lost"] += good
                    found[key, "toxic_lost"] += toxic
                    found[part, f] += 1
                    there = False
                elif fails[f]:
                    found[key, "redundant"] += 1
                found[key, "kept"] += there
                found[key, "unique_fails"] += [f] == [x for x in fails if fails[x]]
    return found, parts


def check(spark, docs, labels):
    d = spark.createDataFrame([(*r, "x", 1, 2) for r in docs], "doc_id long, text string, lang string, part string, mask int, n long")
    got = filter_audit.audit(d, spark.createDataFrame([(*r, 1) for r in labels], "doc_id long, quality int, toxic int, lang int")).collect()
    want, parts = simulate(docs, labels)
    assert len(got) == 600 * len(parts) == len({(r.part, r.filter_order, r.step) for r in got})
    for r in got:
        key = (r.part, r.filter_order, r.step)
        assert {k: r[k] for k in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")} == {k: want[key, k] for k in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")}, key
        assert r.shapley == want[r.part, r.filter_order[r.step - 1]]


def test_audit(spark):
    """Nulls in every column, copies over languages, repeated rows and ids, labels that repeat or name no document, a very long text."""
    many = " ".join(f"w{i}" for i in range(120))
    docs = [
        (1, many, "en"), (2, many, "de"), (2, many, "de"), (2, many, "en"), (None, many, "en"), (0, many + "x", None), (3, None, "en"), (4, "", ""), (5, "", None), (None, None, None),
        (6, "AB " * 200, "en"), (7, "AB " * 200, "fr"), (8, many + " #", "fr"), (9, "\x0bone\x0ctwo x\n", "fr"), (10, "Wort " * 30_000, "de"), (11, " ".join(f"{'É' * 3}{i}" for i in range(101)), "en"),
        (12, " ".join(["a"] * 20 + [f"w{i}" for i in range(80)]), "de"), (13, " ".join(["a"] * 21 + [f"w{i}" for i in range(79)]), "de"), (-5, "short | text", "de"), (-4, "short | text", "de"),
    ]
    check(spark, docs, [(1, 1, 0), (2, 1, 1), (2, 0, None), (3, None, 1), (None, 1, 1), (99, 1, 1), (6, 1, 0), (7, 1, 1), (10, 0, 1), (-4, 1, 1)])


def test_audit_of_a_hot_group(spark):
    """A third of the rows are copies: before the digests move they are a row or two for each task and part."""
    check(spark, [(i, "the same text" if i % 3 == 0 else f"text {i}", ("en", "de")[i % 2]) for i in range(300)], [(i, i % 2, int(i % 5 == 0)) for i in range(0, 300, 3)])


def test_audit_of_nothing(spark):
    assert filter_audit.audit(spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    one = filter_audit.audit(spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert one.count() == 600


def test_matrices():
    """Every mask but 0 is removed once in each order; a filter's sums over all orders are 120 divided by the failures of the mask."""
    by = filter_audit.outcome_matrices()
    assert all(m.shape == (32, 600) for m in by.values())
    per_order = by["removed"].reshape(32, 120, 5).sum(2)
    assert (per_order[0] == 0).all() and (per_order[1:] == 1).all()
    fails = np.array([bin(m).count("1") for m in range(32)])
    at = np.array([filter_audit.FILTERS.index(f) for o in filter_audit.ORDERS for f in o])
    for m in range(1, 32):
        want = np.where(m >> at & 1, 120 // fails[m], 0)
        assert (by["shapley"][m] == want).all()


@pytest.mark.parametrize("outcome", ["kept", "redundant", "unique_fails"])
def test_plain_mask(outcome):
    """A document that fails B and D alone, in the order ABCDE."""
    by = filter_audit.outcome_matrices()
    at = filter_audit.ORDERS.index("ABCDE") * 5
    assert by[outcome][0b1010, at : at + 5].tolist() == {"kept": [1, 0, 0, 0, 0], "redundant": [0, 0, 0, 1, 0], "unique_fails": [0] * 5}[outcome]
