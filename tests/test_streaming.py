"""Streams into the index: documents that come again, late, in a batch that is run again; counts as a rebuild gives them."""

import shutil

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chunks as C
from corpusloom.operators import retrieve as R
from corpusloom.streaming import incremental as IN

DOCS = "dataset_id string, input_id long, title string, text string"


@pytest.fixture
def arrive(spark, tmp_path):
    """Puts documents into the source as one more file."""

    def put(rows):
        spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    return put


def run(spark, tmp_path, checkpoint="c"):
    stream = spark.readStream.schema(DOCS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    IN.index_stream(stream, str(tmp_path / "index"), str(tmp_path / checkpoint)).awaitTermination()
    IN.stats_stream(spark, str(tmp_path / "index"), str(tmp_path / "stats"), str(tmp_path / "s")).awaitTermination()
    return spark.read.parquet(str(tmp_path / "index")).drop("run", "batch")


def text(i):
    return "\n".join(f"Line {k} of text {i} has the word w{(i * k) % 11} in it." for k in range(i % 3 * 40 + 1))


def same(spark, tmp_path, docs):
    """The index is the chunks of all documents, each once; the statistics are those of a rebuild."""
    want = C.chunks_from_documents(spark.createDataFrame(docs, DOCS))
    got = spark.read.parquet(str(tmp_path / "index")).drop("run", "batch")
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    cols = ["dataset_id", "term", "df", "n", F.round("idf", 9)]
    assert sorted(map(str, IN.current_stats(spark, str(tmp_path / "stats")).select(*cols).collect())) == sorted(map(str, R.term_stats(want).select(*cols).collect()))


def test_arrivals(spark, tmp_path, arrive):
    """Two data sets in several batches; copies in a batch and in later ones; a document of an early id that comes late; empty and null texts."""
    docs = [("ab"[i % 2], i, "t", text(i)) for i in range(12)] + [("a", 50, "t", ""), ("a", 51, "t", None)]
    arrive(docs[4:8] + docs[5:6])
    arrive(docs[8:])
    run(spark, tmp_path)
    same(spark, tmp_path, docs[4:])
    arrive(docs[6:] + docs[:4])  # late ones among those that were there
    run(spark, tmp_path)
    same(spark, tmp_path, docs)
    run(spark, tmp_path)
    same(spark, tmp_path, docs)


def test_a_batch_that_is_run_again(spark, tmp_path, arrive):
    """The batch was written, but its commit was lost: neither its chunks nor their counts come twice."""
    docs = [("a", i, "t", text(i)) for i in range(6)]
    arrive(docs[:3])
    run(spark, tmp_path)
    arrive(docs[3:])
    run(spark, tmp_path)
    commits = sorted((tmp_path / "c" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in (tmp_path / "c" / "commits").glob(f"*{commits[-1].name}*"):
        p.unlink()
    run(spark, tmp_path)
    same(spark, tmp_path, docs)


def test_a_new_checkpoint_knows_the_index(spark, tmp_path, arrive):
    docs = [("a", i, "t", text(i)) for i in range(5)]
    arrive(docs)
    assert run(spark, tmp_path).count() == run(spark, tmp_path, "other").count()
    same(spark, tmp_path, docs)
    shutil.rmtree(tmp_path / "c")
    assert run(spark, tmp_path).count() == C.chunks_from_documents(spark.createDataFrame(docs, DOCS)).count()
