"""License scan by diagonal voting (native DataFrame operations only).

All rolling word pairs of all texts are joined with the pairs of a small set of templates.  A pair at word ``p`` of
a text and at word ``t`` of a template votes for diagonal ``p - t``.  Votes are counted by text, template and
diagonal; diagonals that lie close to each other (words added or left out) are merged.  A merged span is verified place by
place: each place of the template counts once, at the text's pair nearest to the strongest diagonal, and only if it comes after
all places before it; what counts is the share of places that stand in order, and the span's length.  The three base phrases are
templates too: such a phrase stands wherever its diagonal has all its votes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.llm.common import documents

#: Phrases with their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Opening or notice passages of public licenses, lower case, with their labels.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "mit-text"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-text"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "apache-text"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version", "gpl-text"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd-text"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc-text"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mpl-text"),
    ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "unlicense-text"),
    ("this work is licensed under a creative commons attribution", "cc-text"),
]

#: Diagonals at most so far apart are merged; a span must hold this share of the template's pairs in order and be at most so many times as long
#: (so its diagonals lie within half the template of the strongest one).
BAND, COVER, STRETCH = 4, 0.6, 1.5

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-case words.  The two letters outside ASCII whose lower case holds an ASCII letter are kept apart first, so that only A-Z change into a-z."""
    apart = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")), F.lit("İ"), F.lit("ı"))
    return F.array_remove(F.split(F.lower(apart), _SEPARATORS), "")


def pairs(frame: DataFrame, word_array: str) -> DataFrame:
    """One row for each word and the next one: ``pos, w0, w1, gram`` (the last word has no next one; no word at all gives one row of nulls)."""
    array = F.col(word_array)
    zipped = F.arrays_zip(array.alias("w0"), F.slice(array, F.lit(2), F.greatest(F.size(array), F.lit(1))).alias("w1"))
    rest = [c for c in frame.columns if c != word_array]
    each = frame.select(*rest, F.posexplode_outer(zipped).alias("pos", "pair"))
    return each.select(*rest, "pos", F.col("pair.w0").alias("w0"), F.col("pair.w1").alias("w1")).withColumn("gram", F.when(F.col("w1").isNotNull(), F.xxhash64("w0", "w1")))


def template_pairs(spark: SparkSession, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """The pairs of all templates with their places.  Its size depends on the templates alone, so it may be broadcast."""
    rows = [(i, text, label, i < len(phrases)) for i, (text, label) in enumerate([*phrases, *templates])]
    values = ", ".join(f"({i}, '{text}', '{label}', {str(is_phrase).lower()})" for i, text, label, is_phrase in rows)
    named = spark.sql(f"SELECT * FROM VALUES {values} AS t(template, body, label, is_phrase)").withColumn("ws", words(F.col("body"))).withColumn("n_pairs", F.size("ws") - 1).drop("body")
    return pairs(named, "ws").where("gram IS NOT NULL").select("template", "label", "is_phrase", "n_pairs", F.col("pos").alias("t_pos"), F.col("w0").alias("t0"), F.col("w1").alias("t1"), "gram")


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans``.

    ``spans`` lists what the method found beside the phrases: label, first and last word, share of the template
    covered.  ``score`` is the largest share, 1 where a phrase stands.  Null and empty texts give no words and empty
    labels; repeated rows are scanned each by itself; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    own = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id"), words(F.col("text")).alias("ws"))
    own = own.select("rid", "doc_id", F.size("ws").cast("long").alias("n_words"), "ws")
    table = F.broadcast(template_pairs(spark, templates, phrases))
    each = pairs(own, "ws").alias("d").join(table.alias("t"), F.expr("d.gram = t.gram AND d.w0 = t.t0 AND d.w1 = t.t1"), "left")
    # a diagonal holds each place of a template once at most
    votes = (
        each.groupBy("rid", "doc_id", "n_words", "template", "label", "is_phrase", "n_pairs", (F.col("pos") - F.col("t_pos")).alias("diagonal"))
        .agg(F.collect_list("t_pos").alias("places")).withColumn("votes", F.size("places"))
    )

    # neighbouring diagonals of one text and template form a run; for phrases each diagonal stands alone
    order = W.partitionBy("rid", "template").orderBy("diagonal")
    gap = F.when(F.col("is_phrase"), F.lit(1)).otherwise((F.col("diagonal") - F.lag("diagonal").over(order) > BAND).cast("int"))
    runs = votes.withColumn("gap", F.coalesce(gap, F.lit(1))).withColumn("run", F.sum("gap").over(order.rowsBetween(W.unboundedPreceding, 0)))
    strongest = F.max(F.struct("votes", (-F.col("diagonal")).alias("neg"))).over(W.partitionBy("rid", "template", "run"))
    off = F.col("diagonal") - F.col("peak")
    runs = runs.withColumn("peak", -strongest["neg"]).where(F.col("template").isNull() | (F.abs(off) <= (STRETCH - 1) * (F.col("n_pairs") + 1)))
    at = F.transform("places", lambda t: F.struct(t.alias("t"), F.abs(off).alias("off"), F.col("diagonal").alias("d")))
    enough = ~F.col("is_phrase") & (F.sum("votes").over(W.partitionBy("rid", "template", "run")) >= COVER * F.col("n_pairs"))
    spans = runs.withColumn("at", F.when(enough, at)).groupBy("rid", "doc_id", "n_words", "template", "label", "is_phrase", "n_pairs", "run").agg(
        F.sum("votes").alias("votes"), F.min("diagonal").alias("diagonal"), F.array_sort(F.flatten(F.collect_list("at"))).alias("at")
    )
    # places in order; of those that are one place of the template the nearest to the strongest diagonal comes first
    none = F.lit(-1).cast("int")
    start = F.struct(none.alias("t"), none.alias("last"), F.lit(0).alias("n"), none.alias("first"))

    def step(seen: Column, x: Column) -> Column:
        word, new = (x["t"] + x["d"]).cast("int"), x["t"] > seen["t"]
        counts = new & (word > seen["last"])
        return F.struct(
            x["t"].cast("int").alias("t"), F.when(counts, word).otherwise(seen["last"]).alias("last"), (seen["n"] + counts.cast("int")).alias("n"), F.when(counts & (seen["n"] == 0), word).otherwise(seen["first"]).alias("first")
        )

    spans = spans.withColumn("seen", F.aggregate("at", start, step)).withColumn("first", F.col("seen.first")).withColumn("last", F.col("seen.last") + 1)
    cover = F.col("seen.n") / F.col("n_pairs")
    phrase = F.col("is_phrase") & (F.col("votes") == F.col("n_pairs"))
    span = ~F.col("is_phrase") & (cover >= COVER) & (F.col("last") - F.col("first") <= STRETCH * (F.col("n_pairs") + 1))
    found = F.when(phrase | span, F.col("label"))
    out = spans.groupBy("rid", "doc_id", "n_words").agg(
        F.count(F.when(phrase, 1)).alias("n_base"),
        F.min(F.when(phrase, F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(phrase, F.col("diagonal"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(phrase, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(found)), ",").alias("labels"),
        F.round(F.coalesce(F.max(F.when(phrase, F.lit(1.0)).when(span, cover)), F.lit(0.0)), 6).alias("score"),
        F.array_sort(F.collect_list(F.when(span, F.struct("label", "first", "last", cover.alias("cover"))))).alias("spans"),
    )
    return out.drop("rid")


def op2_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir)).drop("spans")


def op2_sql(templates=TEMPLATES, phrases=PHRASES) -> str:
    rows = [(i, text, label, i < len(phrases)) for i, (text, label) in enumerate([*phrases, *templates])]
    values = ", ".join(f"({i}, '{text}', '{label}', {str(p).lower()})" for i, text, label, p in rows)
    return rf"""
WITH t AS (SELECT template, label, is_phrase, string_split(body, ' ') AS ws FROM (VALUES {values}) v(template, body, label, is_phrase)),
tp AS (SELECT template, label, is_phrase, len(ws) - 1 AS n_pairs, unnest(range(0, len(ws) - 1)) AS t_pos, unnest(ws[:-2]) AS t0, unnest(ws[2:]) AS t1 FROM t),
d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT rid, unnest(range(0, len(ws) - 1)) AS pos, unnest(ws[:-2]) AS w0, unnest(ws[2:]) AS w1 FROM d),
hits AS (SELECT rid, template, label, is_phrase, n_pairs, pos, t_pos, pos - t_pos AS diagonal FROM p JOIN tp ON w0 = t0 AND w1 = t1),
votes AS (SELECT rid, template, is_phrase, diagonal, count(*) AS votes FROM hits GROUP BY ALL),
gaps AS (SELECT *, CASE WHEN is_phrase THEN 1 ELSE coalesce(CAST(diagonal - lag(diagonal) OVER w > {BAND} AS INTEGER), 1) END AS gap FROM votes WINDOW w AS (PARTITION BY rid, template ORDER BY diagonal)),
runs AS (SELECT *, sum(gap) OVER (PARTITION BY rid, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS run FROM gaps),
peaks AS (SELECT *, first_value(diagonal) OVER (PARTITION BY rid, template, run ORDER BY votes DESC, diagonal) AS peak FROM runs),
-- for each place of the template the text's word nearest to the strongest diagonal, and whether it comes after all before it
near AS (SELECT h.*, run, peak, row_number() OVER (PARTITION BY h.rid, h.template, run, t_pos ORDER BY abs(h.diagonal - peak), h.diagonal) AS k
  FROM hits h JOIN peaks p ON h.rid = p.rid AND h.template = p.template AND h.diagonal = p.diagonal WHERE abs(h.diagonal - peak) <= {STRETCH - 1} * (n_pairs + 1)),
ordered AS (SELECT *, pos > coalesce(max(pos) OVER (PARTITION BY rid, template, run ORDER BY t_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS counts FROM near WHERE k = 1),
spans AS (SELECT rid, template, label, is_phrase, n_pairs, count(*) FILTER (counts) AS held, min(pos) FILTER (counts) AS first, max(pos) FILTER (counts) + 1 AS last, min(diagonal) AS diagonal FROM ordered GROUP BY rid, template, label, is_phrase, n_pairs, run),
judged AS (SELECT *, is_phrase AND held = n_pairs AS phrase, NOT is_phrase AND held / n_pairs >= {COVER} AND last - first <= {STRETCH} * (n_pairs + 1) AS span FROM spans),
found AS (SELECT rid, count(*) FILTER (phrase) AS n_base, min(diagonal) FILTER (phrase) AS first_word, max(diagonal) FILTER (phrase) AS last_word,
  coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (phrase)), ','), '') AS base_labels, coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (phrase OR span)), ','), '') AS labels,
  round(coalesce(max(CASE WHEN phrase THEN 1.0::DOUBLE WHEN span THEN (held / n_pairs)::DOUBLE END), 0), 6) AS score FROM judged GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN found USING (rid)"""
