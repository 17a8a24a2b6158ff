"""Incremental adds: chunks of newly arrived documents go to the index once, and term statistics stay current.

Two streams.  The first cuts documents into chunks and keeps the keys that it has seen as keyed state, so a batch reads nothing of what is stored.
The second reads the chunks that the first has added and keeps running counts for each term of a data set; it writes those that a batch has changed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpusloom.functions.store import exists
from corpusloom.functions.text import keyword_tokens
from corpusloom.operators.chunks import chunks_from_documents
from corpusloom.operators.index import idf

KEY = ["dataset_id", "input_id", "seg_ord", "chunk_ord"]
#: Keys of a data set are held in so many groups.
BUCKETS = 256
#: State on disk, of which changes alone are written.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


class SeenChunks(StatefulProcessor):
    """Lets a chunk pass whose key its group has not seen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "key string", "times int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            fresh = []
            for k in part["key"]:
                new = not self.seen.containsKey((k,))
                if new:
                    self.seen.updateValue((k,), (1,))
                fresh.append(new)
            if any(fresh):
                yield part[fresh].drop(columns="key")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for k in initialState["key"]:
            self.seen.updateValue((k,), (1,))

    def close(self) -> None:
        pass


def _grouped(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("key", F.to_json(F.struct(*KEY))).withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS)).cast("int"))


def _folder(path: str, checkpoint: str, batch: int) -> str:
    return f"{path}/run={zlib.crc32(checkpoint.encode()):08x}/batch={batch}"


def _start(df: DataFrame, mode: str, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch in a folder of its own; one that is run again after it was written is not written again, so readers of the folder meet no file twice."""

    def put(batch: DataFrame, number: int) -> None:
        folder = _folder(path, checkpoint, number)
        if exists(batch.sparkSession, f"{folder}/_SUCCESS"):
            batch.write.format("noop").mode("overwrite").save()  # the state still has to be made
        else:
            batch.write.mode("overwrite").parquet(folder)

    spark = df.sparkSession
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        return df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def index_stream(docs: DataFrame, index_path: str, checkpoint: str) -> StreamingQuery:
    """Keep the index of chunks up to date from a stream of documents (``dataset_id, input_id, title, text``).

    A document that comes again, in the same batch, a later one or a batch that is run again, adds no chunk twice.  A stream with a new
    checkpoint takes the keys of an index that is there already as its first state.
    """
    spark = docs.sparkSession
    chunks = chunks_from_documents(docs)
    known = None
    if exists(spark, index_path) and not exists(spark, f"{checkpoint}/commits"):
        known = _grouped(spark.read.parquet(index_path).select(*KEY)).select("dataset_id", "bucket", "key").groupBy("dataset_id", "bucket")
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in _grouped(chunks).drop("key").schema)
    fresh = _grouped(chunks).groupBy("dataset_id", "bucket").transformWithStateInPandas(SeenChunks(), out, "Append", "None", initialState=known)
    return _start(fresh.drop("bucket"), "append", index_path, checkpoint)


def stats_stream(spark: SparkSession, index_path: str, stats_path: str, checkpoint: str) -> StreamingQuery:
    """Keep the counts of terms current from the chunks that :func:`index_stream` adds: the chunks of a data set that hold a term, and all of them (a null term)."""
    schema = spark.read.parquet(index_path).drop("run", "batch").schema
    chunks = spark.readStream.schema(schema).parquet(f"{index_path}/run=*/batch=*")
    none = F.array(F.lit(None).cast("string"))
    each = chunks.select("dataset_id", F.explode(F.concat(F.array_distinct(F.coalesce(keyword_tokens(F.col("text")), F.array().cast("array<string>"))), none)).alias("term"))
    return _start(each.groupBy("dataset_id", "term").agg(F.count("*").alias("chunks")), "update", stats_path, checkpoint)


def current_stats(spark: SparkSession, stats_path: str) -> DataFrame:
    """``dataset_id, term, df, n, idf`` as the last batch left them."""
    last = spark.read.parquet(stats_path).groupBy("dataset_id", "term").agg(F.max_by("chunks", "batch").alias("df"))
    n = last.where("term IS NULL").select("dataset_id", F.col("df").alias("n"))
    return last.where("term IS NOT NULL").join(n, "dataset_id").withColumn("idf", idf(F.col("n"), F.col("df")))
