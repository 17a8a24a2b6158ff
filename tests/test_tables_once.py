"""Tables in text: rows by hand, and each text read once."""

import contextlib
import io

from pyspark.sql import functions as F

from corpusloom.operators import tables as X


def _table(df):
    rows = sorted(df.collect(), key=lambda r: (r.input_id, r.row_no, r.col_no))
    return [(r.input_id, r.row_no, r.col_no, r.col_name, r.value) for r in rows]


def test_rows_by_hand(spark):
    texts = {
        1: "a,b,c\r\n1, x\u00a0 y ,|3|\x1cq,r\u2028n,m,\u3000o\u00857,8,9,10\n\n",  # widths 3, 3, 2 marks too few, 3, 4
        2: "x,y,z\n1,2,3",  # too few rows
        3: None,
    }
    own = spark.createDataFrame([("d", i, 0, t) for i, t in texts.items()], "dataset_id string, input_id long, seg_ord int, text string")
    assert _table(X.csv_tables(own)) == [(1, 0, 0, "a", "1"), (1, 0, 1, "b", "x y"), (1, 0, 2, "c", "3"), (1, 1, 0, "a", "n"), (1, 1, 1, "b", "m"), (1, 1, 2, "c", "o")]
    pipes = spark.createDataFrame([("d", 1, 0, "| A | A ||\n|---|:-:|-|\n|1||3|\n| 4|5 |6\nno"), ("d", 2, 0, "|a|b|\n|--|--|")], own.schema)
    assert _table(X.pipe_tables(pipes)) == [(1, 0, 0, "1", "4"), (1, 0, 1, "column_2", "5"), (1, 0, 2, "3", "6")]
    more = pipes.withColumn("text", F.concat("text", F.lit("\n|7|8|9|")))
    assert [r[4] for r in _table(X.pipe_tables(more)) if r[0] == 1] == ["4", "5", "6", "7", "8", "9"]


def test_each_text_is_read_once(spark):
    """Filters on made rows were pushed below what makes them, and made them anew."""
    own = spark.range(3).select(F.lit("d").alias("dataset_id"), F.col("id").alias("input_id"), F.lit(0).alias("seg_ord"), F.concat(F.lit("a,b,c"), "id").alias("text"))
    for find in (X.csv_tables, X.pipe_tables):
        said = io.StringIO()
        with contextlib.redirect_stdout(said):
            find(own).explain("simple")
        assert said.getvalue().count("ArrowEvalPython") == 1 and "regexp" not in said.getvalue() and "split(" not in said.getvalue()
