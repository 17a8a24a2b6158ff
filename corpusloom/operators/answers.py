"""Answers from evidence: fact matching, reranking, extraction, validation, and how much context was saved."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.functions.text import clean_evidence, contains_any, keyword_tokens, split_sentences, strip

QUESTION = ["dataset_id", "question_id"]
#: Weights, limits, word lists and sentences of the rules.
CUES = ["is", ":", "-", "held", "by", "serves", "as", "principal", "ceo", "venue", "speaker", "head"]
ACRONYM_SKIPS = ["and", "of", "the", "for", "in", "at", "to"]
LOOKUPS, SUBJECT_OF = ["point_lookup", "location", "time"], {"location": ["venue", "location", "address", "office"], "time": ["date", "time"]}
FACT_FROM, FACT_SCORE = 2.4, 999.0
#: Scores that are less apart may be equal.
NEAR = 1e-6
NOT_FOUND = "I could not find that in the uploaded data."
CASUAL_REPLY = "Hi, I am ready. Ask me something from the uploaded data and I will answer with the best RAG route."
CASUAL_REASON = "Casual chat was detected, so retrieval was skipped."
SKIPPED = {
    "sql": "No reliable SQLite tables exist for this dataset.", "graph": "No graph entities were extracted.", "semantic": "No unstructured chunks are indexed.",
    "keyword": "No text chunks are indexed.", "hierarchical": "No source segments are available.", "all": "Casual chat does not need retrieval.",
}
ROUTES_OF = {"semantic": ["semantic", "hybrid", "graph"], "keyword": ["keyword", "hybrid"], "hierarchical": ["hierarchical", "hybrid"], "sql": ["sql", "hybrid"], "graph": ["graph", "hybrid"]}
TABLE_CONFIDENCE = 0.86
#: Why an answer has its status (our own words).
REASONS = {
    "casual": "small talk", "sure": "sure result of a table or a fact", "fact": "a fact matches", "missing": "no evidence to answer from", "lost": "the asked name is not in the evidence",
    "unsure": "too little confidence for a lookup", "weak": "weak evidence", "supported": "supported by the evidence",
}
#: Said when there is nothing to answer from (our own words).
EMPTY = "Add a document, a table or a site before asking."


def terms(col: Column) -> Column:
    return F.array_distinct(keyword_tokens(col))


def proximity_bonus(target: Column, text: Column) -> Column:
    """4 if a cue (inside of words too) stands near the first place of any target term, from 120 before to 180 after."""
    low = F.lower(text)

    def near(t: Column) -> Column:
        pos = F.instr(low, t)
        return (pos > 0) & contains_any(F.substring(low, F.greatest(pos - 120, F.lit(1)), F.least(pos - 1, F.lit(120)) + 180), CUES)

    return F.when(F.exists(keyword_tokens(target), near), 4.0).otherwise(0.0)


def acronym_match(words: Column, text: Column) -> Column:
    """Whether any of the words, of two to six letters, spells the initials of neighbouring words of the text."""
    found = F.filter(F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0)), lambda w: (F.length(w) > 2) & ~F.lower(w).isin(ACRONYM_SKIPS))
    initials = F.lower(F.array_join(F.transform(found, lambda w: F.substring(w, 1, 1)), ""))
    return F.exists(words, lambda t: F.length(t).between(2, 6) & F.contains(initials, t))


def _facts_of(facts: DataFrame) -> DataFrame:
    """Facts with their terms ``ft``, their subject's terms ``st``, and the kinds of questions that take any of them: of a place, of a time, without a term."""
    whole = F.concat_ws(" ", "fact_type", "subject", "predicate", "object", "qualifier", "fact_text")
    kinds = [F.when(F.col("subject").isin(subjects), F.array(F.lit(kind))).otherwise(F.array().cast("array<string>")) for kind, subjects in SUBJECT_OF.items()]
    return facts.select(
        "dataset_id", F.col("input_id").alias("fact_input"), F.col("seg_ord").alias("fact_seg"), "rule", "n", "fact_type", "subject", "predicate", "object", "qualifier", "confidence", "fact_text",
        terms(whole).alias("ft"), terms(F.col("subject")).alias("st"), F.concat(F.array(F.lit("any")), *kinds).alias("kinds"),
    )


def _sure(intent: Column) -> list[Column]:
    """What a fact is worth to a question of an intent by itself, in the order in which a score adds it."""
    subject = F.col("subject")
    place = F.when((intent == "location") & subject.isin("venue", "location", "address"), 3).when((intent == "time") & subject.isin("date", "time"), 3).otherwise(0)
    return [F.col("confidence"), F.when(F.col("fact_type").isin("role", "contact", "event"), 1.2).otherwise(0.0), place]


def _fact_score() -> Column:
    """Of rows that hold a question's terms ``qt, tt, ql`` and ``intent``, and a fact."""

    def shared(a: str) -> Column:
        return F.size(F.array_intersect(a, "ft"))

    confidence, kind, place = _sure(F.col("intent"))
    return shared("qt") + 2 * shared("tt") + confidence + 2 * shared("ql") + kind + place


FACT_KEY = ["fact_input", "fact_seg", "rule", "n"]


def _first_fact(scored: DataFrame) -> DataFrame:
    """Of each ``asked`` the fact of the highest ``fact_score``, then of the smallest key."""
    rank = F.row_number().over(W.partitionBy("dataset_id", "asked").orderBy(F.desc("fact_score"), *FACT_KEY))
    return scored.withColumn("r", rank).where("r = 1").drop("r")


def fact_candidates(asked: DataFrame, facts: DataFrame) -> DataFrame:
    """``dataset_id, asked, FACT_KEY``: the facts that can win for questions that take any fact of a ``kind``.

    A fact is worth something by itself, and more for each term that it shares.  So it needs no look unless it is the best by itself of its kind, or the best by itself of those
    that share some term (the heads), or shares a term of the question's rarer lists: what shares the commonest term alone cannot beat the head of that list.
    The heads' scores bound the winner's from below; lists, from the commonest on, whose terms together cannot lift any fact above that are left out, and so are facts that fall short with all
    terms, or that could only equal the best head behind it.
    """
    intent = F.col("intent")
    own = facts.select("dataset_id", *FACT_KEY, "confidence", "fact_type", "subject", "ft", F.explode("kinds").alias("kind"))
    kind_intent = F.when(F.col("kind") == "any", "point_lookup").otherwise(F.col("kind"))
    own = own.withColumn("sure", functools.reduce(lambda a, b: a + b, _sure(kind_intent)))
    head = F.min(F.struct((-F.col("sure")).alias("minus"), *FACT_KEY)).alias("head")
    top = own.groupBy("dataset_id", "kind").agg(head)
    weights = asked.select("dataset_id", "kind", "asked", *[F.explode(F.array_union(F.array_union("qt", "tt"), "ql")).alias("term")], "qt", "tt", "ql")
    weights = weights.select("dataset_id", "kind", "asked", "term", sum((F.array_contains(c, F.col("term")).cast("int") * w for c, w in (("qt", 1), ("tt", 2), ("ql", 2))), F.lit(0)).alias("w"))
    wanted = weights.select("dataset_id", "kind", "term").distinct()
    lists = own.select("dataset_id", "kind", F.explode("ft").alias("term"), "sure", *FACT_KEY).join(wanted, ["dataset_id", "kind", "term"], "left_semi")
    stats = lists.groupBy("dataset_id", "kind", "term").agg(F.count("*").alias("df"), head)
    known = weights.join(stats, ["dataset_id", "kind", "term"])
    heads = known.select("dataset_id", "asked", "head.*").unionByName(asked.join(top, ["dataset_id", "kind"]).select("dataset_id", "asked", "head.*")).drop("minus").distinct()
    lead = _first_fact(heads.join(facts, ["dataset_id", *FACT_KEY]).join(asked, ["dataset_id", "asked"]).withColumn("fact_score", _fact_score()))
    lead = lead.select("dataset_id", "asked", F.col("fact_score").alias("floor"), F.struct(*FACT_KEY).alias("first"))
    # lists from the commonest on: the first always goes, the next as long as what they add up to falls short
    by_size = W.partitionBy("dataset_id", "asked").orderBy(F.desc("df"), "term")
    known = known.withColumns({"place": F.row_number().over(by_size), "sum": F.sum("w").over(by_size), "total": F.sum("w").over(W.partitionBy("dataset_id", "asked"))})
    known = known.drop("head").join(top.select("dataset_id", "kind", (-F.col("head.minus")).alias("most")), ["dataset_id", "kind"]).join(lead, ["dataset_id", "asked"])
    needed = known.where((F.col("place") > 1) & (F.col("sum") + F.col("most") >= F.col("floor") - NEAR))
    bound = F.col("sure") + F.col("total")
    may_win = (bound > F.col("floor") + NEAR) | ((bound >= F.col("floor") - NEAR) & (F.struct(*FACT_KEY) < F.col("first")))
    more = needed.join(lists, ["dataset_id", "kind", "term"]).where(may_win).select("dataset_id", "asked", *FACT_KEY)
    return heads.unionByName(more).distinct()


def match_facts(questions: DataFrame, facts: DataFrame) -> DataFrame:
    """The best fact for each lookup question, if one scores enough.

    Questions that ask the same are looked up once.  One of a place or a time takes any fact of such a subject, one without any term takes any fact (:func:`fact_candidates`); the others meet
    the facts whose subject shares a term that they ask for.
    """
    name = F.coalesce(F.nullif("role_target", F.lit("")), F.nullif("target", F.lit("")), F.col("normalized"))
    q = questions.where(F.col("intent").isin(LOOKUPS)).select(*QUESTION, "intent", "role_target", F.sort_array(terms(name)).alias("tt"), F.sort_array(terms(F.col("qualifier"))).alias("ql"), F.sort_array(terms(F.col("expanded"))).alias("qt"))
    same = ["intent", "role_target", "tt", "ql", "qt"]
    q = q.withColumn("asked", F.sha2(F.to_json(F.struct(*same)), 256))
    once = q.dropDuplicates(["dataset_id", "asked"]).drop("question_id")
    once = once.withColumn("kind", F.when(F.col("intent").isin(*SUBJECT_OF), F.col("intent")).when(F.size("tt") == 0, "any"))
    f = _facts_of(facts)
    open_to_all = once.where("kind IS NOT NULL")
    pairs = fact_candidates(open_to_all, f).join(open_to_all, ["dataset_id", "asked"]).join(f, ["dataset_id", *FACT_KEY])
    about = (F.col("role_target") == "") | (F.col("role_target") == F.col("subject"))
    about = about & ((F.size("ql") == 0) | F.arrays_overlap("ql", "ft") | acronym_match(F.col("ql"), F.concat_ws(" ", "qualifier", "object", "fact_text")))
    named = once.where("kind IS NULL").withColumn("meets", F.explode("tt")).join(f.withColumn("meets", F.explode("st")), ["dataset_id", "meets"]).where(about)
    cols = ["dataset_id", "asked", *FACT_KEY, "fact_type", "subject", "predicate", "object", "qualifier", "confidence", "fact_text", _fact_score().alias("fact_score")]
    best = _first_fact(pairs.select(*cols).unionByName(named.select(*cols)).where(F.col("fact_score") >= FACT_FROM))
    out = q.select(*QUESTION, "asked").join(best, ["dataset_id", "asked"])
    return out.select(*QUESTION, "fact_input", "fact_seg", "fact_type", "subject", "predicate", "object", F.col("qualifier").alias("fact_qualifier"), F.col("confidence").alias("fact_confidence"), "fact_text", "fact_score")


def rerank(questions: DataFrame, hits: DataFrame, facts: DataFrame | None = None, k: int = 8) -> DataFrame:
    """The best ``k`` sources of each question: score plus shared terms, target terms and nearness; a matched fact comes first.

    ``hits``: ``source_id, title, text, score, ord``.  Of sources alike in id and first 120 characters the best stays.
    """
    q = questions.select(*QUESTION, terms(F.col("expanded")).alias("qt"), terms(F.col("target")).alias("tt"), "target")
    df = hits.join(q, QUESTION).withColumn("st", terms(F.concat_ws(" ", "title", "text")))
    df = df.withColumns({"qs": F.array_intersect("qt", "st"), "ts": F.array_intersect("tt", "st"), "near": proximity_bonus(F.col("target"), F.col("text"))})
    said = F.concat_ws(
        "; ", F.when(F.size("ts") > 0, F.concat(F.lit("matched target terms: "), F.array_join(F.slice(F.array_sort("ts"), 1, 4), ", "))),
        F.when(F.size("qs") > 0, F.concat(F.lit("matched query terms: "), F.array_join(F.slice(F.array_sort("qs"), 1, 5), ", "))),
        F.when(F.col("near") > 0, "role/entity terms appear near each other"),
    )
    df = df.select(*QUESTION, "source_id", "title", "text", F.round(F.col("score") + F.size("qs") * 1.2 + F.size("ts") * 2.4 + F.col("near"), 4).alias("score"), said.alias("match_reason"), "ord")
    if facts is not None:
        words = F.coalesce(F.nullif("fact_text", F.lit("")), F.concat_ws(" ", "subject", "predicate", "object"))
        own = facts.select(*QUESTION, F.concat_ws(":", "fact_input", "fact_seg").alias("source_id"), F.concat(F.col("fact_type"), F.lit(": "), F.col("subject")).alias("title"), words.alias("text"), F.lit(FACT_SCORE).alias("score"), F.lit("matched extracted structured fact").alias("match_reason"), F.lit(-1).alias("ord"))
        df = df.unionByName(own)
    first = F.row_number().over(W.partitionBy(*QUESTION, "source_id", F.substring("text", 1, 120)).orderBy(F.desc("score"), "ord"))
    rank = F.row_number().over(W.partitionBy(*QUESTION).orderBy(F.desc("score"), "ord", "source_id"))
    return df.withColumn("first", first).where("first = 1").drop("first").withColumn("rank", rank).where(F.col("rank") <= k)


def extractive_answer(questions: DataFrame, sources: DataFrame, variant: str = "router") -> DataFrame:
    """``answer`` of the sentences that share most terms with the question, each with the number of its source.

    ``router``: cleaned sentences of 25 characters or more from six sources; a list of six for list questions, else four in a row.
    ``keyword``: sentences of 30 characters or more from all sources, four in a row.  Without any, the closest source is told.
    """
    router = variant == "router"
    asked = questions.select(*QUESTION, "intent", terms(F.col("expanded")).alias("qt"))
    each = sources.where(F.col("rank") <= 6) if router else sources
    each = each.select(*QUESTION, "rank", F.posexplode(split_sentences(F.col("text"))).alias("pos", "raw"))
    each = each.withColumn("sentence", clean_evidence(F.col("raw")) if router else strip(F.col("raw"))).where(F.length("sentence") >= (25 if router else 30))
    each = each.join(asked, QUESTION).withColumn("shared", F.size(F.array_intersect("qt", terms(F.col("sentence"))))).where("shared > 0")
    many = F.when(F.col("intent") == "list", 6).otherwise(4) if router else F.lit(4)
    k = F.row_number().over(W.partitionBy(*QUESTION).orderBy(F.desc("shared"), "rank", "pos"))
    picked = each.withColumn("k", k).where(F.col("k") <= many).groupBy(*QUESTION).agg(F.array_sort(F.collect_list(F.struct("k", "sentence", "rank"))).alias("ss"))
    # fixed values: what is said around evidence
    listed = F.concat(F.lit("Here is what I found:\n"), F.array_join(F.transform("ss", lambda s: F.concat(F.lit("- "), s["sentence"], F.lit(" ["), s["rank"], F.lit("]"))), "\n"))
    row = F.array_join(F.transform("ss", lambda s: F.concat(s["sentence"], F.lit(" ["), s["rank"], F.lit("]"))), " ")
    best = sources.where("rank = 1").select(*QUESTION, F.col("text").alias("best"))
    closest = F.concat(F.lit("I found related evidence, but not a direct answer: "), F.substring(clean_evidence(F.col("best")), 1, 450), F.lit(" [1]")) if router else F.concat(F.lit("Closest exact-match source: "), F.substring("best", 1, 500), F.lit(" [1]"))
    none = F.lit(None).cast("string") if router else F.lit("I could not find a strong exact-match source for that question.")
    text = F.when(F.col("ss").isNotNull(), F.when(F.col("intent") == "list", listed).otherwise(row) if router else row).when(F.col("best").isNotNull(), closest).otherwise(none)
    return asked.drop("qt").join(picked, QUESTION, "left").join(best, QUESTION, "left").select(*QUESTION, text.alias("answer"))


def fact_sentence() -> Column:
    """The sentences of facts."""
    context = F.when(F.col("fact_type") == "role", " This is in the context of ").otherwise(" This is listed under ")
    tail = F.when(F.col("fact_qualifier") != "", F.concat(context, F.col("fact_qualifier"), F.lit("."))).otherwise("")
    return F.concat(F.lit("The "), F.col("subject"), F.lit(" is "), F.col("object"), F.lit("."), tail)


def synthesize(questions: DataFrame, sources: DataFrame, facts: DataFrame) -> DataFrame:
    """``direct_answer, answer, confidence``: a fact's sentence, else nothing found, else for lookups the closest evidence, else an extract."""
    best = sources.where("rank = 1").select(*QUESTION, F.substring(clean_evidence(F.col("text")), 1, 360).alias("closest"))
    df = questions.join(facts, QUESTION, "left").join(best, QUESTION, "left").join(extractive_answer(questions, sources).withColumnRenamed("answer", "extract"), QUESTION, "left")
    name = F.coalesce(F.nullif("role_target", F.lit("")), F.nullif("target", F.lit("")), F.lit("that fact"))
    unsure = F.concat(F.lit("I could not find a confirmed answer for '"), name, F.lit("' in the uploaded data. The closest evidence I found says: "), F.col("closest"), F.lit(" [1]"))
    known, none, lookup = F.col("fact_type").isNotNull(), F.col("closest").isNull(), F.col("intent").isin(LOOKUPS)
    answer = F.when(known, fact_sentence()).when(none, NOT_FOUND).when(lookup, unsure).otherwise(F.col("extract"))
    sure = F.when(known, F.greatest(F.lit(0.82), F.col("fact_confidence"))).when(none, 0.0).when(lookup, 0.28).when(F.coalesce("extract", F.lit("")) != "", 0.62).otherwise(0.0)
    return df.withColumns({"direct_answer": F.when(known | ~(none | lookup), answer).otherwise(""), "answer": answer, "confidence": sure, "has_fact": known}).drop("closest", "extract")


def validate(answers: DataFrame) -> DataFrame:
    """``status`` and ``reasons`` from ``intent, target, answer, confidence, has_fact, evidence`` (the first five sources joined)."""
    lookup = F.col("intent").isin(LOOKUPS) & ~F.col("has_fact")
    seen = terms(F.lower(F.concat_ws(" ", "evidence", "answer")))
    lost = (F.size(terms(F.col("target"))) > 0) & ~F.arrays_overlap(terms(F.col("target")), seen)
    missing = (F.coalesce("answer", F.lit("")) == "") | F.contains(F.lower("answer"), F.lit("could not find"))
    casual, sure = F.col("intent") == "casual_chat", (F.col("confidence") >= 0.8) & (F.col("answer") != "")
    status = F.when(casual, "casual_chat").when(sure, "grounded").when(missing, "not_found")
    status = status.when(lookup & (lost | (F.col("confidence") < 0.55)), "weak_evidence").when(~lookup & (F.col("confidence") < 0.45), "weak_evidence").otherwise("grounded")
    why = F.array_compact(F.array(
        F.when(F.col("has_fact"), REASONS["fact"]), F.when(missing, REASONS["missing"]), F.when(~missing & lookup & lost, REASONS["lost"]),
        F.when(~missing & lookup & (F.col("confidence") < 0.55), REASONS["unsure"]), F.when(~missing & ~lookup & (F.col("confidence") < 0.45), REASONS["weak"]),
    ))
    reasons = F.when(casual, F.array(F.lit(REASONS["casual"]))).when(sure, F.array(F.lit(REASONS["sure"]))).when(F.size(why) > 0, why).otherwise(F.array(F.lit(REASONS["supported"])))
    return answers.withColumns({"status": status, "reasons": reasons})


def compose(made: DataFrame, tables: DataFrame, hints: DataFrame) -> DataFrame:
    """The whole answer of each row of ``synthesize``, with ``retrievers_used`` and ``retrievers_skipped``.

    ``made`` has ``route`` and the flags of its data set (``has_tables, has_chunks, has_nodes``, null counts as false); ``tables``: ``summary, n_rows`` of
    questions that went to a table; ``hints``: ``hint`` of each data set.  Parts stand in the order table, graph, evidence; rows of a
    table lift the confidence, and their summary is the direct answer if there is none.  Casual messages get a fixed reply.
    """
    df = made.join(tables.select(*QUESTION, "summary", "n_rows"), QUESTION, "left").join(hints.select("dataset_id", "hint"), "dataset_id", "left")
    route, casual, fact = F.col("route"), F.col("intent") == "casual_chat", F.coalesce("has_fact", F.lit(False))
    has = {"sql": F.col("n_rows").isNotNull(), "graph": F.coalesce("has_nodes", F.lit(False)), **{r: F.coalesce("has_chunks", F.lit(False)) for r in ("semantic", "keyword", "hierarchical")}}
    fact_by = F.when(fact & F.col("fact_type").isin("role", "contact", "event"), "sql").when(fact, "keyword")
    used = [F.when(route.isin(ROUTES_OF[r]) & has[r], r) for r in ("semantic", "keyword", "hierarchical")] + [fact_by] + [F.when(route.isin(ROUTES_OF[r]) & has[r], r) for r in ("sql", "graph")]
    missed = {r: route.isin(["sql"] if r == "sql" else ROUTES_OF[r]) & ~has[r] for r in ROUTES_OF}
    skipped = [F.when(missed[r], F.struct(F.lit(r).alias("retriever"), F.lit(SKIPPED[r]).alias("reason"))) for r in ROUTES_OF]
    parts = [F.when(route.isin(ROUTES_OF["sql"]), F.col("summary")), F.when(route.isin(ROUTES_OF["graph"]), F.col("hint")), F.when((route != "sql") | fact, F.col("answer"))]
    text = F.trim(F.concat_ws("\n\n", *[F.nullif(p, F.lit("")) for p in parts]))
    sure = F.when(F.coalesce("n_rows", F.lit(0)) > 0, F.greatest("confidence", F.lit(TABLE_CONFIDENCE))).otherwise(F.col("confidence"))
    direct = F.when((F.coalesce("n_rows", F.lit(0)) > 0) & (F.coalesce("direct_answer", F.lit("")) == ""), F.col("summary")).otherwise(F.col("direct_answer"))
    nothing = F.array(F.struct(F.lit("all").alias("retriever"), F.lit(SKIPPED["all"]).alias("reason")))
    return df.select(
        *[c for c in made.columns if c not in ("answer", "direct_answer", "confidence", "route", "route_confidence", "route_reason")],
        F.when(casual, "semantic").otherwise(route).alias("route"), F.when(casual, 0.0).otherwise(F.col("route_confidence")).alias("route_confidence"),
        F.when(casual, CASUAL_REASON).otherwise(F.col("route_reason")).alias("route_reason"),
        F.when(casual, CASUAL_REPLY).when(text == "", EMPTY).otherwise(text).alias("answer"), F.when(casual, CASUAL_REPLY).otherwise(direct).alias("direct_answer"),
        F.when(casual, 1.0).when(text == "", 0.0).otherwise(sure).alias("confidence"),
        F.when(casual, F.array().cast("array<string>")).otherwise(F.array_distinct(F.array_compact(F.array(*used)))).alias("retrievers_used"),
        F.when(casual, nothing).otherwise(F.array_compact(F.array(*skipped))).alias("retrievers_skipped"),
    )


def table_chars(catalog: DataFrame) -> DataFrame:
    """Characters of all tables of a data set: headers, and twelve to a cell."""
    size = F.length(F.array_join("columns", " ")) + F.col("row_count") * F.greatest(F.size("columns"), F.lit(1)) * 12
    return catalog.groupBy("dataset_id").agg(F.sum(size).alias("table_chars"))


def context_budget(datasets: DataFrame, answers: DataFrame) -> DataFrame:
    """Estimated tokens of the data set (``chunk_chars, segment_chars, table_chars``), of the evidence (``evidence_chars``), what was saved, and the share in percent."""
    df = answers.join(datasets, "dataset_id")
    whole = F.floor((F.greatest("chunk_chars", "segment_chars") + F.col("table_chars") + 3) / 4)
    df = df.withColumns({"dataset_tokens": whole, "evidence_tokens": F.floor((F.col("evidence_chars") + 3) / 4)})
    df = df.withColumn("saved_tokens", F.greatest(F.lit(0), F.col("dataset_tokens") - F.col("evidence_tokens")))
    return df.withColumn("reduction_percent", F.when(F.col("dataset_tokens") > 0, F.round(F.col("saved_tokens") / F.col("dataset_tokens") * 100, 1)).otherwise(0.0))
