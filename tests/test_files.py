"""Files in and tables out: bytes that are no text, ragged rows, and writers that are lost."""

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import files as IO


def test_text_files(spark, tmp_path):
    """Bytes that are no UTF-8, other kinds of files, folders in folders, upper-case endings."""
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name, raw in (("a.txt", b"one\r\ntw\xffo"), ("deep/b.MD", "über".encode()), ("c.csv", b"x,y"), ("d.markdown", b"last")):
        (tmp_path / "in" / name).write_bytes(raw)
    got = {r.name: (r.dataset_id, r.text) for r in IO.read_text_corpus(spark, str(tmp_path / "in"), "set").collect()}
    assert got == {"a.txt": ("set", "one\r\ntwo"), "b.MD": ("set", "über"), "d.markdown": ("set", "last")}


def test_text_stream(spark, tmp_path):
    """Each file once, also those that come later."""
    (tmp_path / "in").mkdir()
    for run in range(3):
        (tmp_path / "in" / f"f{run}.txt").write_text(f"text {run}")
        stream = IO.stream_text_corpus(spark, str(tmp_path / "in"), "set", 1)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [f"text {i}" for i in range(run + 1)]


def test_ragged_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,name,price\n1,"a, b",2.5\n2,short\n3,x,4.5,more\nnot,y,1.0\n4,,\n')
    schema = "id int, name string, price double"
    got = {r._malformed or r.id: (r.id, r.name, r.price) for r in IO.read_table(spark, str(tmp_path / "t.csv"), schema, malformed="_malformed").collect()}
    assert got[1] == (1, "a, b", 2.5) and got[4] == (4, None, None) and {k for k in got if isinstance(k, str)} == {"2,short", "3,x,4.5,more", "not,y,1.0"}
    assert IO.read_table(spark, str(tmp_path / "t.csv")).columns == ["id", "name", "price"]
    (tmp_path / "n.csv").write_text("a,b\n1,2.5\n2,3.5\n")
    assert IO.read_table(spark, str(tmp_path / "n.csv")).dtypes == [("a", "int"), ("b", "double")]


def rows(spark, n):
    return spark.range(n).withColumn("x", F.col("id") * 2)


def test_a_lost_writer_changes_nothing(spark, tmp_path):
    """Between the write and the swap readers see the old rows; so they do after a write that fails."""
    path = str(tmp_path / "table")
    IO.swap_in(rows(spark, 3), path)
    version = IO.write_version(rows(spark, 5), path)  # and its writer is lost here
    assert IO.read_current(spark, path).count() == 3
    with pytest.raises(Exception, match="lost"):
        IO.swap_in(rows(spark, 9).withColumn("x", F.raise_error(F.lit("lost")).cast("long")), path)
    assert IO.read_current(spark, path).count() == 3
    before = IO.read_current(spark, path)
    IO.swap_version(spark, path, version)
    assert IO.read_current(spark, path).count() == 5 and before.count() == 3  # who reads keeps what it reads


def test_tables_are_replaced_as_a_whole(spark):
    name = "files_test_table"
    try:
        IO.write_table(rows(spark, 4), name)
        with pytest.raises(Exception, match="lost"):
            IO.write_table(rows(spark, 9).withColumn("x", F.raise_error(F.lit("lost")).cast("long")), name)
        assert spark.table(name).count() == 4
        IO.write_table(rows(spark, 2).withColumn("y", F.lit("z")), name)
        assert spark.table(name).columns == ["id", "x", "y"] and spark.table(name).count() == 2
        assert [t.name for t in spark.catalog.listTables() if t.name.startswith(name)] == [name]
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
