"""Tables found in text, as one long table of cells, and the catalog of tables."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.lineage import cut_lineage
from corpusloom.operators.segments import KEY_VALUE, TABLE_FROM

SEGMENT = ["dataset_id", "input_id", "seg_ord"]


def column_base(name: str, place: int) -> str:
    """Lower case, other characters as ``_``, none at the ends; ``column_i`` for nothing."""
    return re.sub(r"[^A-Za-z0-9_]+", "_", name.strip().lower()).strip("_") or f"column_{place}"


def dedupe_columns(names: Column) -> Column:
    """:func:`_names` of a column of headers; in one pass, as headers may be long."""

    @F.arrow_udf("array<string>")
    def run(headers: pa.Array) -> pa.Array:
        return pa.array([_names(header or []) for header in headers.to_pylist()], pa.list_(pa.string()))

    return run(names)


#: As in :mod:`corpusloom.functions.text`: line ends, and white space of any kind.
_LINE_END = re.compile(r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]")
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_WHITES = re.compile(f"[{_WHITE}]+")


def _lines(text: str, mark: str) -> list[str]:
    """Lines that hold a mark twice at least."""
    return [x for x in _LINE_END.split(text) if x.count(mark) >= 2] if text.count(mark) >= 2 else []


def _clean(cell: str) -> str:
    return _WHITES.sub(" ", cell.strip(_WHITE).strip("|")).strip(" ")


def _names(header: list[str]) -> list[str]:
    """Column names of a header; the second, third ... of a name get ``_2``, ``_3`` ..."""
    times: Counter[str] = Counter()
    named = []
    for i, name in enumerate(header, 1):
        base = column_base(name, i)
        times[base] += 1
        named.append(base if times[base] == 1 else f"{base}_{times[base]}")
    return named


def _cells(segments: DataFrame, rows_of: Callable[[str], list[list[str]]], least: int) -> DataFrame:
    """Of the rows of each text (arrays of cells in order) those of the most frequent width (the smallest of equals), the first as header.  A text is read once, in sequence."""

    @F.arrow_udf("array<struct<names: array<string>, rows: array<array<string>>>>")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            rows = rows_of(text or "")
            if len(rows) >= least:
                widths = Counter(map(len, rows))
                width = min(widths, key=lambda w: (-widths[w], w))
                rows = [r for r in rows if len(r) == width]
            out.append([{"names": _names(rows[0]), "rows": rows[1:]}] if len(rows) >= least else [])
        return pa.array(out, pa.list_(pa.struct([("names", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string())))])))

    found = segments.select(*SEGMENT, F.explode(run(F.col("text"))).alias("t"))
    each = found.select(*SEGMENT, F.col("t.names").alias("columns"), F.posexplode("t.rows").alias("row_no", "cells"))
    return each.select(*SEGMENT, "row_no", F.posexplode(F.arrays_zip(F.col("columns").alias("c"), F.col("cells").alias("v"))).alias("col_no", "x")).select(*SEGMENT, "row_no", "col_no", F.col("x.c").alias("col_name"), F.col("x.v").alias("value"))


def pipe_tables(segments: DataFrame) -> DataFrame:
    """Cells of lines with two pipes or more; separator rows go; a header and a row at least."""
    rule = re.compile("[-: ]+")

    def rows_of(text: str) -> list[list[str]]:
        rows = [[_clean(c) for c in x.strip(_WHITE).strip("|").split("|")] for x in _lines(text, "|")]
        return [r for r in rows if len(r) >= 2 and not all(map(rule.fullmatch, r))]

    return _cells(segments, rows_of, 2)


def csv_tables(segments: DataFrame) -> DataFrame:
    """Cells of lines with two commas or more, cut at every comma; a header and two rows at least."""
    return _cells(segments, lambda text: [[_clean(c) for c in x.split(",")] for x in _lines(text, ",")], 3)


def key_value_records(segments: DataFrame) -> DataFrame:
    """Cells of records of ``key: value`` lines.  A blank line, or a key that comes again, ends a record; records need two keys, and tables two records that share two keys."""
    pattern = re.compile(KEY_VALUE)

    def records(text: str) -> list[dict[str, str]]:
        done: list[dict[str, str]] = [{}]
        for line in map(str.strip, (text or "").splitlines()):
            found = pattern.match(line)
            if not line:
                done.append({})
            elif found:
                key = column_base(found[1], 1)
                if key in done[-1] and len(done[-1]) >= 2:
                    done.append({})
                done[-1][key] = " ".join(found[2].strip().strip("|").split())
        return [r for r in done if len(r) >= 2]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for *key, text in f[[*SEGMENT, "text"]].itertuples(index=False):
                found = records(text)
                order = list(dict.fromkeys(k for r in found for k in r))
                if len(found) >= 2 and sum(sum(k in r for r in found) >= 2 for k in order) >= 2:
                    out += [(*key, i, order.index(k), k, v) for i, r in enumerate(found) for k, v in r.items()]
            yield pd.DataFrame(out, columns=[*SEGMENT, "row_no", "col_no", "col_name", "value"])

    kinds = ", ".join(f"{c} {segments.schema[c].dataType.simpleString()}" for c in SEGMENT)
    return segments.select(*SEGMENT, "text").mapInPandas(run, f"{kinds}, row_no int, col_no int, col_name string, value string")


def extract_tables(segments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Catalog, cells, and the segments with ``table_name``.  Only sure table candidates; pipe rows go before comma rows, those before records."""
    sure = segments.where(f"segment_type = 'sql_candidate' AND confidence >= {TABLE_FROM}")
    # written, so that texts are classified once and not for each kind of table
    sure = cut_lineage(sure.select(*SEGMENT, "text"))
    found = [f(sure).withColumn("kind", F.lit(i)) for i, f in enumerate((pipe_tables, csv_tables, key_value_records))]
    every = found[0].unionByName(found[1]).unionByName(found[2])
    sizes = every.groupBy(*SEGMENT, "kind").agg((F.max("row_no") + 1).cast("long").alias("row_count"), F.countDistinct("col_no").alias("width"), F.array_sort(F.collect_set(F.struct("col_no", "col_name"))).alias("cs"))
    first = sizes.where("row_count >= 1 AND width >= 2").groupBy(*SEGMENT).agg(F.min_by(F.struct("kind", "row_count", "cs"), "kind").alias("t"))
    name = F.concat_ws("_", F.lit("text_table"), *SEGMENT)
    catalog = first.select(*SEGMENT, name.alias("table_name"), F.col("t.cs.col_name").alias("columns"), "t.row_count", F.col("t.kind").alias("kind"))
    cells = every.join(catalog.select(*SEGMENT, "kind", "table_name"), [*SEGMENT, "kind"]).drop("kind")
    return catalog.drop("kind"), cells, segments.join(catalog.select(*SEGMENT, "table_name"), SEGMENT, "left")


def table_catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, columns, row_count, source_name`` of file tables, by name."""
    every = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), F.array(*map(F.lit, df.columns)).alias("columns"), "row_count", F.lit(name).alias("source_name"))
        every = row if every is None else every.unionByName(row)
    return every
