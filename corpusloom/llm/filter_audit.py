"""Filter interaction audit by products of incidence matrices.

What five filters do to a document depends only on which of them it fails: one of 32 masks.  So one pass counts, for each
part, the documents, good documents and toxic documents of each mask; these histograms are stacked as rows of
32 columns and multiplied by integer matrices of 32 rows and 600 columns (120 orders of the filters, five steps
each), which say for a mask whether it is kept, removed, redundant or a unique failure at a step.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.llm.common import documents

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MASKS = 1 << len(FILTERS)
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Parts that a task multiplies at once.
BLOCK = 256


def own_failures(text: Column) -> Column:
    """Bits of the filters that look at a text alone: A 1, B 2, C 4, D 8."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    rules = [n < 100, F.lit(100) * distinct < F.lit(80) * n, F.lit(100) * upper > F.lit(10) * F.length(text), text.rlike(r"[#$%&*|]")]
    return sum((r.cast("int") * (1 << k) for k, r in enumerate(rules)), F.lit(0))


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Histograms ``part, mask, n, good, toxic``: documents of each part by the filters that they fail.

    A text is identical to another if their SHA-256 is; it fails E (16) if a document with a smaller id has it too.  Rows of one id never
    make each other fail; a null id is not smaller than any and has no smaller one; a null text counts as empty, a null language as the
    part ``""``.  A document is good (toxic) if any row of ``labels`` with its id says so; labels of no document do not count.

    Copies are counted by (digest, part, label) before they move, so a group of copies is a few rows however large it is.
    """
    text = F.coalesce("text", F.lit(""))
    # ids that are null meet no label: they are dealt by their text and not all to one task
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), own_failures(text).alias("own"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    rows = rows.withColumn("lost", F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long")))
    marks = [F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c) for c in ("quality", "toxic")]
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(*marks).withColumn("lost", F.lit(0).cast("long"))
    rows = rows.join(known, ["lost", "id"], "left").fillna(0, ["quality", "toxic"])
    ids = rows.groupBy("lost", "id", "digest", "part", "own", "quality", "toxic").agg(F.count("*").alias("copies"))
    group = ["digest", "part", "own", "quality", "toxic"]
    # of each group the rows, those without an id, and its smallest id with the rows that have it
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "copies")))
    groups = ids.groupBy(*group).agg(F.sum("copies").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("copies")).otherwise(0)).alias("no_id"), first.alias("first"))
    least = F.min("first.id").over(W.partitionBy("digest"))
    stay = F.col("no_id") + F.when(F.col("first.id") == F.col("least"), F.col("first.copies")).otherwise(0)
    split = groups.withColumn("least", least).withColumn("stay", stay).select("part", "own", "quality", "toxic", F.explode(F.array(F.struct(F.col("own").alias("mask"), F.col("stay").alias("n")), F.struct((F.col("own") + 16).alias("mask"), (F.col("n") - F.col("stay")).alias("n")))).alias("m"))
    counts = [F.sum("m.n").alias("n"), F.sum(F.col("m.n") * F.col("quality")).alias("good"), F.sum(F.col("m.n") * F.col("toxic")).alias("toxic")]
    return split.groupBy("part", F.col("m.mask").alias("mask")).agg(*counts)


def outcome_matrices() -> dict[str, np.ndarray]:
    """Integer matrices of 32 masks by 600 (order, step): what a document that fails a mask adds to each outcome."""
    made = {k: np.zeros((MASKS, len(ORDERS) * len(FILTERS)), np.int64) for k in ("kept", "removed", "redundant", "unique_fails", "shapley")}
    mask = np.arange(MASKS)
    for o, order in enumerate(ORDERS):
        before = np.zeros(MASKS, bool)
        for s, name in enumerate(order):
            bit, col = 1 << FILTERS.index(name), o * len(FILTERS) + s
            fails = mask & bit > 0
            made["removed"][:, col], made["redundant"][:, col], made["unique_fails"][:, col] = fails & ~before, fails & before, mask == bit
            before = before | fails
            made["kept"][:, col] = ~before
    # a filter's removals summed over all orders: the product of each order's column of that filter with ones
    at = np.array([FILTERS.index(name) for order in ORDERS for name in order])
    for f in range(len(FILTERS)):
        made["shapley"][:, at == f] = made["removed"][:, at == f].sum(1, keepdims=True)
    return made


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step: ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    Null and repeated rows count as :func:`failure_masks` says; every part has all 600 rows, zeros included; an empty table has no parts and so no
    rows.  Extra columns of ``docs`` and ``labels`` are not looked at.
    """
    hist = failure_masks(docs, labels)
    cell = F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic"))))

    def dense(count: str) -> Column:
        """One row of the stack: a count for each mask, in order."""
        return F.transform(F.sequence(F.lit(0), F.lit(MASKS - 1)), lambda m: F.coalesce(F.col("cells")[m][count], F.lit(0).cast("long"))).alias(count)

    stacked = hist.groupBy("part").agg(cell.alias("cells")).select("part", *map(dense, ("n", "good", "toxic")))
    outcomes = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = outcome_matrices()
        orders, steps = [o for o in ORDERS for _ in FILTERS], np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS))
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                n, good, toxic = (batch[k].flatten().to_numpy(zero_copy_only=False).reshape(-1, MASKS) for k in ("n", "good", "toxic"))
                made = {k: n @ m for k, m in by.items()} | {"good_lost": good @ by["removed"], "toxic_lost": toxic @ by["removed"]}
                parts = len(n)
                cols = [batch["part"].take(pa.array(np.repeat(np.arange(parts), len(orders)))), pa.array(orders * parts), pa.array(np.tile(steps, parts)), *(pa.array(made[k].ravel()) for k in outcomes)]
                yield pa.RecordBatch.from_arrays(cols, ["part", "filter_order", "step", *outcomes])

    return stacked.mapInArrow(multiply, "part string, filter_order string, step int, " + ", ".join(f"{k} long" for k in outcomes))


def op13_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: By recursion over orders and a plain look at each prefix of an order, without matrices.
OP13_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, len(ws) < 100 AS a, 100 * len(list_distinct(ws)) < 80 * len(ws) AS b, 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) AS c,
  regexp_matches(text, '[#$%&*|]') AS d, coalesce(w.doc_id > least, false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN l USING (doc_id)),
h AS (SELECT part, concat(if(a, 'A', ''), if(b, 'B', ''), if(c, 'C', ''), if(d, 'D', ''), if(e, 'E', '')) AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT x AS o FROM letters UNION ALL SELECT o || x FROM o, letters WHERE NOT contains(o, x)),
s AS (SELECT o AS filter_order, step, substr(o, step, 1) AS x, substr(o, 1, step - 1) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) WHERE length(o) = 5),
m AS (SELECT part, filter_order, step, x, n, good, toxic, contains(fails, x) AS fail, fails = x AS only_x, length(translate(fails, before, '')) < length(fails) AS gone FROM h, s),
r AS (SELECT part, filter_order, step, x, sum(n) FILTER (NOT fail AND NOT gone) AS kept, sum(n) FILTER (fail AND NOT gone) AS removed, sum(n) FILTER (fail AND gone) AS redundant, sum(n) FILTER (only_x) AS unique_fails,
  sum(good) FILTER (fail AND NOT gone) AS good_lost, sum(toxic) FILTER (fail AND NOT gone) AS toxic_lost FROM m GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM r"""
