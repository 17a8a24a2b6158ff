"""Understanding of questions: spelling, intent, target, role, expansion, and the route to a retrieval method."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from corpusloom.functions.text import strip

#: Spellings, phrases and word lists of the rules.  Later intents overrule earlier ones.
SPELLINGS = [("princiapl", "principal"), ("collage", "college"), ("sahrdaya", "sahrdaya"), ("ceo", "CEO"), ("cto", "CTO")]
CASUAL = r"(?i)^\s*(hi|hello|hey|yo|sup|thanks|thank you|ok|okay|cool|nice|good morning|good evening|good afternoon|bye|goodbye)[!?.\s]*$"
INTENTS = [
    ("point_lookup", "who is|who's|current|principal|ceo|cto|founder|hod|head|chairman|director|manager|speaker|organizer"),
    ("list", "list|all|show all|which|speakers|people|members|departments|products|events"),
    ("aggregate", "how many|count|total|sum|average|avg|maximum|minimum"),
    ("location", "where|venue|location|address"),
    ("time", "when|date|time|schedule"),
    ("relationship", "related|relationship|connected|depends|owns|associated|works on"),
    ("comparison", "compare|difference|versus|vs"),
]
EXPANSIONS = [
    ("principal", "administrator leadership head"), ("ceo", "chief executive officer founder leadership"), ("cto", "chief technology officer technology head"),
    ("hod", "head of department"), ("venue", "location address place"), ("speaker", "presenter guest"),
]
TARGET = r"\b(?:who is|who's|current|list all|list|where is|when is|what is)\s+(?:the\s+)?([a-zA-Z0-9 &/-]{2,50})"
TARGET_WORDS = ["principal", "ceo", "cto", "venue", "speaker", "organizer", "chairman", "hod", "head of department"]
ROLE_ALIASES = [("hod", "head of department")] + [(r, r) for r in ("head of department", "principal", "ceo", "cto", "chairman", "director", "manager", "speaker", "organizer")]
QUALIFIER = r"\b(?:of|for|in)\s+([a-zA-Z0-9 &/-]{2,40})"
SQL_HINTS = r"(?i)\b(total|sum|average|avg|count|how many|top|highest|lowest|min|max|revenue|sales|owner|owns|team|endpoint)\b"
GRAPH_HINTS = r"(?i)\b(relationship|related|connect(?:ed|ion|s)?|dependency|depends|between|entity|graph|link(?:ed|s)?|programs?|associated|offers?)\b"
KEYWORD_HINTS = r"(?i)\b(who is|where is|contact|email|phone|faculty|hod|principal|department|acronym|full form)\b"
TABLE_HINTS = r"(?i)\b(owner|owns|team|endpoint|venue|speaker|date|schedule|how many|count|list)\b"
VOCABULARY = 8
#: Terms of one automaton and questions that it reads at most.
SHARD, SLOT = 50_000, 20_000


def normalize_question(col: Column) -> Column:
    out = F.regexp_replace(strip(col), r"(?U)\s+", " ")
    for wrong, right in SPELLINGS:
        out = F.regexp_replace(out, rf"(?i)\b{wrong}\b", right)
    return out


def normalize_questions(questions: DataFrame) -> DataFrame:
    return questions.withColumn("normalized", normalize_question(F.col("question")))


def is_casual(col: Column) -> Column:
    return col.rlike(CASUAL)


def casual_filter(questions: DataFrame) -> DataFrame:
    """Questions that are more than a greeting or thanks."""
    return questions.where(~is_casual(normalize_question(F.col("question"))))


def question_intent(col: Column) -> Column:
    """Of a normalised question: ``casual_chat``, else the last intent that has a word in it, else ``factual``."""
    low, out = F.lower(col), F.when(is_casual(col), "casual_chat")
    for name, words in reversed(INTENTS):
        out = out.when(low.rlike(rf"\b({words})\b"), name)
    return out.otherwise("factual")


def question_target(col: Column) -> Column:
    low = F.lower(col)
    out = F.when(is_casual(col), "").when(low.rlike(TARGET), F.regexp_replace(F.regexp_extract(low, TARGET, 1), r"^[ ?.]+|[ ?.]+$", ""))
    for word in TARGET_WORDS:
        out = out.when(F.contains(low, F.lit(word)), word)
    return out.otherwise("")


def role_and_qualifier(col: Column) -> tuple[Column, Column]:
    low, role = F.lower(col), F.when(is_casual(col), "")
    for alias, name in ROLE_ALIASES:
        role = role.when(low.rlike(rf"\b{alias}\b"), name)
    qualifier = F.when(is_casual(col), "").otherwise(F.regexp_replace(F.regexp_extract(low, QUALIFIER, 1), r"^[ ?.]+|[ ?.]+$", ""))
    return role.otherwise(""), qualifier


def understand(questions: DataFrame) -> DataFrame:
    """``normalized, intent, target, role_target, qualifier`` of each ``question``."""
    df = normalize_questions(questions)
    role, qualifier = role_and_qualifier(F.col("normalized"))
    return df.withColumns({"intent": question_intent(F.col("normalized")), "target": question_target(F.col("normalized")), "role_target": role, "qualifier": qualifier})


def vocabulary_hits(questions: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``dataset_id, question_id, term, ord``: the terms of a data set (``dataset_id, term, ord``) that stand anywhere in a question's text ``low``, in any case.

    The vocabulary of a data set is dealt into shards; each is one automaton, which finds all its terms in one reading of a question, however many
    there are and however alike they begin.  Questions are dealt too, so neither side fills a task.
    """
    own = vocabulary.select("dataset_id", "term", "ord", F.lower("term").alias("form"))
    shards = own.groupBy("dataset_id").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"))
    slots = questions.groupBy("dataset_id").agg(F.ceil(F.count("*") / SLOT).cast("int").alias("slots"))
    # a row for each data set
    sizes = shards.join(slots, "dataset_id")
    v = own.join(sizes, "dataset_id").select("dataset_id", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), "term", "ord", "form")
    q = questions.join(sizes, "dataset_id").select("dataset_id", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.pmod(F.xxhash64("question_id"), F.col("slots")).cast("int").alias("slot"), "question_id", "low")

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        asked, terms = [], []
        if left.num_rows and right.num_rows:
            # terms that differ in case alone are one form
            rows: dict[str, list[int]] = {}
            for i, form in enumerate(right["form"].to_pylist()):
                rows.setdefault(form, []).append(i)
            automaton = ahocorasick.Automaton()
            for form, at in rows.items():
                automaton.add_word(form, at)
            automaton.make_automaton()
            for j, low in enumerate(left["low"].to_pylist()):
                found = {i for _, at in automaton.iter(low or "") for i in at}
                asked += [j] * len(found)
                terms += found
        at, of = pa.array(asked, pa.int64()), pa.array(terms, pa.int64())
        return pa.table({"dataset_id": left["dataset_id"].take(at), "question_id": left["question_id"].take(at), "term": right["term"].take(of), "ord": right["ord"].take(of)})

    key = ["dataset_id", "shard", "slot"]
    kinds = T.StructType([T.StructField("dataset_id", q.schema["dataset_id"].dataType), T.StructField("question_id", q.schema["question_id"].dataType), T.StructField("term", T.StringType()), T.StructField("ord", v.schema["ord"].dataType)])
    return q.groupBy(*key).cogroup(v.groupBy(*key)).applyInArrow(find, kinds)


def expand_questions(understood: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """``expanded``: the question, other words for its roles, and the first eight vocabulary terms that stand in it; each word once.

    ``vocabulary``: ``dataset_id, term, ord``, three characters at least.
    """
    low = F.lower("normalized")
    parts = [F.col("normalized")] + [F.when(low.rlike(rf"\b{w}\b"), more).otherwise("") for w, more in EXPANSIONS]
    df = understood
    if vocabulary is None:
        df = df.withColumn("vocabulary", F.array().cast("array<string>"))
    else:
        rank = F.row_number().over(W.partitionBy("dataset_id", "question_id").orderBy("ord", "term"))
        hits = vocabulary_hits(df.select("dataset_id", "question_id", low.alias("low")), vocabulary).withColumn("r", rank).where(F.col("r") <= VOCABULARY)
        found = hits.groupBy("dataset_id", "question_id").agg(F.array_sort(F.collect_list(F.struct("r", "term"))).alias("ts"))
        df = df.join(found.select("dataset_id", "question_id", F.col("ts.term").alias("vocabulary")), ["dataset_id", "question_id"], "left").withColumn("vocabulary", F.coalesce("vocabulary", F.array().cast("array<string>")))
    words = F.array_distinct(F.filter(F.split(F.concat_ws(" ", *parts, F.array_join("vocabulary", " ")), r"\s+"), lambda w: w != ""))
    return df.withColumn("expanded", F.when(F.col("intent") == "casual_chat", F.col("normalized")).otherwise(F.array_join(words, " "))).drop("vocabulary")


def route_questions(expanded: DataFrame, profile: DataFrame, override: str = "auto") -> DataFrame:
    """``route, route_confidence, route_reason`` from the question and its data set's ``profile`` (``dataset_id, has_tables, has_chunks, has_nodes, has_facts, has_long``)."""
    if override != "auto":
        return expanded.withColumns({"route": F.lit(override), "route_confidence": F.lit(1.0), "route_reason": F.lit(f"Manual route override selected: {override}.")})
    df = expanded.join(profile, "dataset_id", "left").fillna(False, ["has_tables", "has_chunks", "has_nodes", "has_facts", "has_long"])
    q, intent = F.col("expanded"), F.col("intent")
    linked, tabular = (intent == "relationship") | q.rlike(GRAPH_HINTS), q.rlike(TABLE_HINTS)
    sql = (q.rlike(SQL_HINTS) | intent.isin("aggregate", "list", "location", "time") | (linked & tabular)) & F.col("has_tables")
    graph = linked & F.col("has_nodes")
    keyword = (intent.isin("point_lookup", "location", "time") | q.rlike(KEYWORD_HINTS)) & (F.col("has_chunks") | F.col("has_facts"))
    # fixed values: confidences and reasons of the routes
    rules = [
        (sql & F.col("has_chunks") & F.lower("normalized").rlike("why|explain|compare"), "hybrid", 0.82, "Question has analytical language and may need narrative context."),
        (graph & ~tabular, "graph", 0.82, "Relationship-style phrasing matched extracted graph entities."),
        (graph & sql, "hybrid", 0.84, "Question has relationship wording plus structured table evidence."),
        (sql, "sql", 0.9, "Numeric or aggregation phrasing matched available structured tables."),
        (keyword & graph, "hybrid", 0.82, "Exact lookup and relationship signals matched keyword, semantic, and graph evidence."),
        (keyword, "keyword", 0.88, "Exact lookup phrasing matched keyword/name retrieval."),
        (graph, "graph", 0.74, "Relationship-style phrasing matched extracted entity graph."),
        (F.col("has_long"), "hierarchical", 0.79, "Broad factual question can use section-level parent context."),
        (F.col("has_chunks"), "semantic", 0.84, "Factual long-form phrasing is best served by semantic retrieval."),
        (F.lit(True), "semantic", 0.35, "Factual long-form phrasing is best served by semantic retrieval."),
    ]

    def first(k: int) -> Column:
        out = F.when(rules[0][0], rules[0][k])
        for r in rules[1:]:
            out = out.when(r[0], r[k])
        return out

    return df.withColumns({"route": first(1), "route_confidence": first(2), "route_reason": first(3)})
