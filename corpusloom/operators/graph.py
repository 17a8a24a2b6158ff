"""The graph of names that stand in the same chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.functions.text import contains_any, squeeze, strip

#: The pattern of names and the words of each type, tested in this order inside of words too.
ENTITY = r"\b[A-Z][A-Za-z0-9&.-]*(?:\s+[A-Z][A-Za-z0-9&.-]*){0,3}\b"
TYPES = [
    ("Department", ["department", "engineering", "science", "biotechnology", "electronics", "computer"]),
    ("Program", ["b.tech", "m.tech", "ph.d", "program", "course"]),
    ("Committee", ["committee", "cell", "council", "body", "iqac"]),
    ("Document", ["pdf", "doc", "report", "form", "calendar", "handbook"]),
    ("Person", ["prof", "dr", "mr", "mrs", "ms", "thomas"]),
]
MAX_NODES, MAX_EDGES, PAIRED, VIEW_NODES, VIEW_EDGES, HINT_NODES = 30, 60, 10, 18, 32, 8


def chunk_entities(chunks: DataFrame) -> DataFrame:
    """``entities`` of each chunk: distinct capitalised phrases of more than two characters, sorted."""
    found = F.transform(F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0)), strip)
    return chunks.withColumn("entities", F.array_sort(F.array_distinct(F.filter(found, lambda e: F.length(e) > 2))))


def entity_type(name: Column) -> Column:
    low = F.lower(name)
    out = None
    for label, words in TYPES:
        test = contains_any(low, words)
        if label == "Person":
            test = test | F.size(F.split(squeeze(name), " ")).isin(2, 3)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise("Entity")


def entity_nodes(entities: DataFrame, max_nodes: int = MAX_NODES) -> DataFrame:
    """The names of most chunks in each data set, ties by name: ``dataset_id, entity, weight, type, rank``."""
    counts = entities.select("dataset_id", F.explode("entities").alias("entity")).groupBy("dataset_id", "entity").agg(F.count("*").alias("weight"))
    rank = F.row_number().over(W.partitionBy("dataset_id").orderBy(F.desc("weight"), "entity"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= max_nodes).withColumn("type", entity_type(F.col("entity")))


def cooccurrence_edges(entities: DataFrame, nodes: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    """Pairs among the first ten names of a chunk, both ends being nodes; the most frequent of each data set, ties by name."""
    # a data set's nodes are few: a chunk keeps those of its first names that are nodes, and pairs these alone
    known = nodes.groupBy("dataset_id").agg(F.collect_set("entity").alias("known"))
    some = entities.select("dataset_id", F.slice("entities", 1, PAIRED).alias("es")).join(known, "dataset_id")
    some = some.select("dataset_id", F.filter("es", lambda e: F.array_contains("known", e)).alias("es"))
    pairs = F.flatten(F.transform("es", lambda a, i: F.transform(F.slice("es", i + 2, PAIRED), lambda b: F.struct(a.alias("source"), b.alias("target")))))
    both = some.select("dataset_id", F.explode(pairs).alias("p")).groupBy("dataset_id", "p.source", "p.target").agg(F.count("*").alias("weight"))
    rank = F.row_number().over(W.partitionBy("dataset_id").orderBy(F.desc("weight"), "source", "target"))
    return both.withColumn("rank", rank).where(F.col("rank") <= max_edges).select("dataset_id", "source", "target", "weight", "rank")


def entity_type_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("dataset_id", "type").agg(F.count("*").alias("n"))


def graph_hint(nodes: DataFrame, datasets: DataFrame | None = None) -> DataFrame:
    """A sentence that names the first eight nodes of each data set; those of ``datasets`` without any get one that says so."""
    first = nodes.where(F.col("rank") <= HINT_NODES).groupBy("dataset_id").agg(F.array_sort(F.collect_list(F.struct("rank", "entity"))).alias("ns"))
    said = F.concat(F.lit("The lightweight graph layer found these prominent entities for relationship-style reasoning: "), F.array_join(F.col("ns.entity"), ", "), F.lit("."))
    hints = first.select("dataset_id", said.alias("hint"))
    if datasets is None:
        return hints
    return datasets.select("dataset_id").distinct().join(hints, "dataset_id", "left").withColumn("hint", F.coalesce("hint", F.lit("No strong entity relationships were extracted yet.")))


def graph_view(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What a picture shows: edges among the first 18 nodes, 32 at most."""
    shown = nodes.where(F.col("rank") <= VIEW_NODES).select("dataset_id", "entity")
    both = edges.join(shown.withColumnRenamed("entity", "source"), ["dataset_id", "source"], "left_semi").join(shown.withColumnRenamed("entity", "target"), ["dataset_id", "target"], "left_semi")
    rank = F.row_number().over(W.partitionBy("dataset_id").orderBy("rank"))
    return both.withColumn("view_rank", rank).where(F.col("view_rank") <= VIEW_EDGES).drop("rank")
