"""Files in and tables out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import strip

#: File kinds by extension.
KINDS = {"table": ["csv", "xlsx", "xls"], "pdf": ["pdf"], "docx": ["docx"], "text": ["txt", "md", "markdown"]}


def _texts(files: DataFrame, dataset_id: str) -> DataFrame:
    endings, raw = "|".join(KINDS["text"]), F.col("value")
    # only texts with wrong bytes lose the marks that stand for them, so a mark that is a character of its own stays elsewhere
    text = F.when(F.is_valid_utf8(raw), raw).otherwise(F.replace(F.make_valid_utf8(raw), F.lit("\ufffd"), F.lit("")))
    files = files.select("value", F.col("_metadata.file_path").alias("input_id"), F.col("_metadata.file_name").alias("name"))
    return files.where(F.lower("name").rlike(rf"\.({endings})$")).select(F.lit(dataset_id).alias("dataset_id"), "input_id", "name", text.alias("text"))


def read_text_corpus(spark: SparkSession, path: str, dataset_id: str) -> DataFrame:
    """``dataset_id, input_id, name, text`` of whole text files under a path, by their extensions; bytes that are no UTF-8 are dropped, an empty file has an empty text or no row."""
    return _texts(spark.read.text(path, wholetext=True, recursiveFileLookup=True), dataset_id)


def stream_text_corpus(spark: SparkSession, path: str, dataset_id: str, per_batch: int = 1000) -> DataFrame:
    """The same files as a stream: each that arrives is read once, ``per_batch`` at a time."""
    return _texts(spark.readStream.option("maxFilesPerTrigger", per_batch).option("wholetext", True).option("recursiveFileLookup", True).text(path), dataset_id)


def read_table(spark: SparkSession, path: str, schema=None, malformed: str | None = None) -> DataFrame:
    """A CSV file with a header; types are inferred unless given.

    With ``malformed`` a column of that name holds the whole line of a row that has too few or too many cells, or one that is not of its column's type (null elsewhere).
    """
    reader = spark.read.option("header", True)
    found = reader.schema(schema) if schema else reader.option("inferSchema", True)
    if malformed is None:
        return found.csv(path)
    known = found.csv(path).schema
    return reader.schema(T.StructType([*known.fields, T.StructField(malformed, T.StringType())])).option("columnNameOfCorruptRecord", malformed).csv(path)


def catalog_inputs(paths: DataFrame) -> DataFrame:
    """``path, name, extension, kind, warning``; unknown kinds stay, with a warning."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    kind = F.when(F.lit(False), "")
    for name, endings in KINDS.items():
        kind = kind.when(ext.isin([f".{e}" for e in endings]), name)
    df = paths.select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), ext.alias("extension"), kind.otherwise("unknown").alias("kind"))
    return df.withColumn("warning", F.when(F.col("kind") == "unknown", "unsupported file type"))


def write_table(df: DataFrame, name: str) -> None:
    """Save as a table of this name, in place of any other; the rows are written beside it first, so a write that fails leaves the old table as it was."""
    spark, fresh = df.sparkSession, f"{name}_{uuid.uuid4().hex[:12]}"
    try:
        df.write.saveAsTable(fresh)
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {fresh}")
        raise
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"ALTER TABLE {fresh} RENAME TO {name}")


def write_version(df: DataFrame, path: str) -> str:
    """Write rows as a new version under a path; it is not read until :func:`swap_version`."""
    version = uuid.uuid4().hex[:12]
    df.write.parquet(f"{path}/{version}")
    return version


def swap_version(spark: SparkSession, path: str, version: str) -> None:
    """From now on readers get this version: one rename of a small file, so there is no moment without one, and versions that lost their writer are never read."""
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs
    context = fs.FileContext.getFileContext(fs.Path(path).toUri(), spark.sparkContext._jsc.hadoopConfiguration()) if "://" in path else fs.FileContext.getLocalFSFileContext()
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").text(f"{path}/next-{version}")
    part = next(x for x in spark.read.text(f"{path}/next-{version}").inputFiles())
    over = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    over[0] = fs.Options.Rename.OVERWRITE
    context.rename(fs.Path(part), fs.Path(f"{path}/current"), over)
    context.delete(fs.Path(f"{path}/next-{version}"), True)


def swap_in(df: DataFrame, path: str) -> None:
    """Write rows and let readers of the path see them, all at once."""
    swap_version(df.sparkSession, path, write_version(df, path))


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The rows that were swapped in last."""
    return spark.read.parquet(f"{path}/{spark.read.text(f'{path}/current').first()[0]}")


def document_line_text(parts: DataFrame) -> DataFrame:
    """``input_id, text`` of extracted parts (``input_id, kind, ord, cells``): paragraphs in order, then table rows joined by `` | ``; pages have a head line ``Page N``."""
    cells = F.transform("cells", strip)
    line = F.when(F.col("kind") == "row", F.array_join(cells, " | ")).when(F.col("kind") == "page", F.concat(F.lit("Page "), F.col("ord"), F.lit("\n"), F.array_join(cells, " "))).otherwise(F.array_join(cells, " "))
    keyed = parts.select("input_id", F.struct((F.col("kind") == "row").alias("late"), "ord", line.alias("line")).alias("p"), (F.col("kind") == "page").alias("paged")).where("p.line <> ''")
    packed = keyed.groupBy("input_id").agg(F.array_sort(F.collect_list("p")).alias("ps"), F.max("paged").alias("paged"))
    return packed.select("input_id", F.array_join(F.col("ps.line"), "\x00").alias("t"), "paged").select("input_id", F.replace("t", F.lit("\x00"), F.when(F.col("paged"), "\n\n").otherwise("\n")).alias("text"))
