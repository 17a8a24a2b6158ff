"""Exact dedup by stateful streaming (native DataFrame operations only).

Arrivals (digest, id, length, locator) run through Structured Streaming into keyed state that lies on
disk (RocksDB) and never expires.  For each digest the state holds how many rows came, and of the row that stays
its length and its stable identifier, which is also the content locator.  A digest met twice is a
hit; every hit is checked byte for byte against the text that the locator names, and digests whose texts differ
after all are settled by the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import documents, materialize, own_name, scratch_path

SPACES = "\t\n\x0b\x0c\r "
#: Rows of a group that meet the text that stays in one part.
MEET = 1000
#: State on disk; it writes changes only, and takes no disk in advance, as each partition has a store of its own.  What all stores of an executor hold in
#: memory outside its heap is bounded, however many partitions there are.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "160",
}


def normalized(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _best(rows: DataFrame, *by: str) -> DataFrame:
    """Per group: rows, and of the row that stays length and id (longest first, then smallest id, null last)."""
    rank = F.struct((-F.col("n_points")).alias("neg_points"), F.col("doc_id").isNull().alias("no_id"), "doc_id")
    best = rows.groupBy(*by).agg(F.sum("copies").alias("group_size"), F.min(rank).alias("best"))
    return best.select(*by, "group_size", (-F.col("best.neg_points")).alias("best_points"), F.col("best.doc_id").alias("keep_id"))


def run_state(spark: SparkSession, arrivals_path: str, schema, max_files: int | None = None) -> DataFrame:
    """Stream the arrivals into the keyed state and return its last value for every digest.

    ``max_files`` bounds the files of a micro-batch; the state carries over from batch to batch.
    """
    out, state = scratch_path(spark, "dedup-state-out"), scratch_path(spark, "dedup-state")
    reader = spark.readStream.schema(schema)
    stream = (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(arrivals_path)
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        query = (
            _best(stream, "digest").writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", state)
            .foreachBatch(lambda df, batch: df.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{out}/part={batch}"))
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    states = "digest string, group_size long, best_points int, keep_id long, batch long, part int"
    if not query.recentProgress or all(p["batchId"] < 0 or p["numInputRows"] == 0 for p in query.recentProgress):
        return spark.createDataFrame([], states).drop("batch", "part")
    last = F.max(F.struct("batch", "group_size", "best_points", "keep_id")).alias("v")
    return spark.read.schema(states).parquet(out).groupBy("digest").agg(last).select("digest", "v.group_size", "v.best_points", "v.keep_id")


def _grouped(docs: DataFrame, max_files: int | None = None, digest=sha256) -> DataFrame:
    """One row per distinct (id, length, normalised text): its number of copies, its group, and whether it stays."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    norm = normalized(F.col("text"))
    arrivals = materialize(texts.select("doc_id", F.length("text").alias("n_points"), sha256(norm).alias("sha"), digest(norm).alias("digest"), F.lit(1).cast("long").alias("copies")), "dedup-arrivals")
    # rows that repeat an id, a length and a text are one row with a count from here on
    rows = arrivals.groupBy("digest", "sha", "doc_id", "n_points").agg(F.sum("copies").alias("copies"))
    path = arrivals.inputFiles()
    state = run_state(spark, path[0].rsplit("/", 1)[0], arrivals.schema, max_files) if path else None
    if state is None:
        return spark.createDataFrame([], "doc_id long, n_points int, copies long, sha string, group_size long, keep_id long, stays boolean")
    state = materialize(state, "dedup-groups")

    # hits: full bytes against the text at the locator; a large group meets its text in parts, each with a copy of it
    hits = state.where("group_size > 1")
    found = texts.select("doc_id", F.length("text").alias("n_points"), norm.alias("norm")).withColumn("digest", digest(F.col("norm"))).join(hits, "digest")
    found = materialize(found, "dedup-hits")
    stays = found.where(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("best_points"))).groupBy("digest").agg(F.first("norm").alias("kept_norm"))
    parts = F.ceil(F.col("group_size") / MEET).cast("int")
    stays = stays.join(hits.select("digest", "group_size"), "digest").select("digest", "kept_norm", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    dealt = found.select("digest", "norm", F.pmod(F.xxhash64("doc_id", "norm"), parts).cast("int").alias("part"))
    differ = dealt.join(stays, ["digest", "part"]).where(F.col("norm") != F.col("kept_norm")).select("digest").distinct()
    differ = materialize(differ, "dedup-collisions")

    clean = rows.join(state, "digest").join(differ, "digest", "left_anti")
    # colliding digests, if any: the whole text is the key
    rest = found.join(differ, "digest", "left_semi").select("digest", "norm", "doc_id", "n_points", F.lit(1).cast("long").alias("copies"))
    rest = rest.groupBy("digest", "norm", "doc_id", "n_points").agg(F.sum("copies").alias("copies"))
    rest = rest.join(_best(rest, "digest", "norm"), ["digest", "norm"]).withColumn("sha", sha256(F.col("norm")))
    cols = ["doc_id", "n_points", "copies", "sha", "group_size", "best_points", "keep_id"]
    both = clean.select(*cols).unionByName(rest.select(*cols))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("best_points"))
    return both.withColumn("stays", stays).drop("best_points")


def exact_groups(docs: DataFrame, max_files: int | None = None, digest=sha256) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical without ASCII white space.  Of equal texts the row with the most code
    points in its own text stays, then the one with the smallest id; of rows that repeat id and text, one is kept.
    Null texts count as empty, null ids lose ties; an empty table gives an empty result.
    ``digest`` is a function of a column; a weak one costs time, not results.
    """
    copy = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    rows = _grouped(docs, max_files, digest).select("*", copy)
    return rows.select("doc_id", "keep_id", "group_size", (F.col("stays") & (F.col("copy") == 1)).alias("kept"), F.col("sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, by the rules of :func:`exact_groups`."""
    keep = materialize(_grouped(docs).where("stays").select(F.col("doc_id").alias("_id"), F.col("sha").alias("_sha"), F.col("n_points").alias("_points"), "copies"), "dedup-stays")

    def those(rows: DataFrame) -> DataFrame:
        text = F.coalesce(docs["text"], F.lit(""))
        same = docs["doc_id"].eqNullSafe(rows["_id"]) & (F.length(text) == rows["_points"]) & (sha256(normalized(text)) == rows["_sha"])
        return docs.join(rows, same, "left_semi")

    out, repeated = those(keep.where("copies = 1")), keep.where("copies > 1")
    if repeated.isEmpty():
        return out
    sha = own_name(docs, "sha")
    return out.unionByName(those(repeated).withColumn(sha, sha256(normalized(F.col("text")))).dropDuplicates(["doc_id", sha]).drop(sha))


def op10_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n_points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
r AS (SELECT *, count(*) OVER (PARTITION BY h) AS group_size, first_value(doc_id) OVER (PARTITION BY h ORDER BY n_points DESC, doc_id NULLS LAST) AS keep_id,
  row_number() OVER (PARTITION BY h ORDER BY n_points DESC, doc_id NULLS LAST) AS k FROM d)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, k = 1 AS kept, h AS text_sha256 FROM r"""
