"""Vocabulary automata and fact matching against brute force, and what they leave out."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import answers as N
from corpusloom.operators import questions as Q

FACTS = "dataset_id string, input_id long, seg_ord int, rule int, n int, fact_type string, subject string, predicate string, object string, qualifier string, confidence double, fact_text string"
ASKED = "dataset_id string, question_id long, intent string, role_target string, target string, qualifier string, normalized string, expanded string"


def vocabulary(spark, rows):
    return spark.createDataFrame(rows, "dataset_id string, term string, ord int")


@pytest.mark.parametrize(("shard", "slot"), [(50_000, 20_000), (7, 3)])
def test_vocabulary_as_brute_force(spark, monkeypatch, shard, slot):
    """Terms inside of words, terms within terms, forms that differ in case alone, other data sets, also in many shards."""
    monkeypatch.setattr(Q, "SHARD", shard)
    monkeypatch.setattr(Q, "SLOT", slot)
    rng = random.Random(2)
    terms = ["the", "The", "there", "her", "theme park", "ÜBER", "e t", "日本語", "aaa", *("".join(rng.choice("abt h") for _ in range(rng.randint(3, 5))) for _ in range(60))]
    v = [(d, t, rng.randrange(5)) for d in "ab" for t in dict.fromkeys(terms)]
    asked = [(rng.choice("abc"), i, "".join(rng.choice("aabtth ") for _ in range(40)) + rng.choice(["There", "aaaa", "über theme park", "日本語"])) for i in range(50)] + [("a", 90, ""), ("a", 91, None)]
    q = spark.createDataFrame(asked, "dataset_id string, question_id long, question string").select("dataset_id", "question_id", F.lower("question").alias("low"))
    got = {(r.dataset_id, r.question_id, r.term, r.ord) for r in Q.vocabulary_hits(q, vocabulary(spark, v)).collect()}
    assert got == {(d, i, t, o) for d, i, text in asked for e, t, o in v if d == e and t.lower() in (text or "").lower()} and got


def test_vocabulary_that_begins_alike(spark):
    """A hundred thousand terms with one beginning are several automata; each question takes the first eight in order."""
    v = spark.range(100_000).select(F.lit("a").alias("dataset_id"), F.concat(F.lit("document "), F.col("id")).alias("term"), F.col("id").alias("ord"))
    asked = spark.createDataFrame([("a", i, f"find document {i * 997 % 100_000} please") for i in range(40)], "dataset_id string, question_id long, question string")
    got = {r.question_id: r.expanded for r in Q.expand_questions(Q.understand(asked), v).collect()}
    for i in range(40):
        number = str(i * 997 % 100_000)
        assert got[i] == " ".join(["find", "document", number, "please", *(number[:n] for n in range(1, len(number)) if str(int(number[:n])) == number[:n])])
    assert Q.vocabulary_hits(asked.select("dataset_id", "question_id", F.lower("question").alias("low")), v.where("false")).count() == 0


def facts_and_questions(seed=6, n=400):
    rng = random.Random(seed)
    words = ["hall", "seven", "north", "south", "desk", "computer", "science", "maya", "raman", "venue", "date"]
    facts, asked = [], []
    for i in range(n):
        subject = rng.choice(["venue", "location", "date", "time", "address", "ceo", "head of department", "office"])
        kind = rng.choice(["role", "contact", "event", "fact"])
        facts.append((rng.choice("aab"), i // 3, 0, rng.randrange(4), i, kind, subject, "is", " ".join(rng.choice(words) for _ in range(2)), rng.choice(["", "computer science", "north hall"]), rng.choice([0.86, 0.9, 0.92]), " ".join(rng.choice(words) for _ in range(5))))
    for i in range(150):
        intent = rng.choice(["location", "time", "point_lookup", "list"])
        role = rng.choice(["", "", "ceo", "head of department"])
        target = rng.choice(["venue", "date", "", "hall seven", role])
        asked.append((rng.choice("abc"), i, intent, role, target, rng.choice(["", "", "cs", "computer science", "hall"]), rng.choice(["is it", "where", "the venue hall"]), " ".join(rng.choice([*words, "zz", "of"]) for _ in range(rng.randint(0, 4)))))
    return facts, asked


def brute(spark, facts, asked):
    """Every question with every fact of its data set, by the rules of the matching."""
    q, f = spark.createDataFrame(asked, ASKED), N._facts_of(spark.createDataFrame(facts, FACTS))
    name = F.coalesce(F.nullif("role_target", F.lit("")), F.nullif("target", F.lit("")), F.col("normalized"))
    q = q.where(F.col("intent").isin(N.LOOKUPS)).select("dataset_id", "question_id", "intent", "role_target", N.terms(name).alias("tt"), N.terms(F.col("qualifier")).alias("ql"), N.terms(F.col("expanded")).alias("qt"))
    best = {}
    for r in q.join(f, "dataset_id").withColumn("acronym", N.acronym_match(F.col("ql"), F.concat_ws(" ", "qualifier", "object", "fact_text"))).withColumn("score", N._fact_score()).collect():
        if r.intent in N.SUBJECT_OF:
            fits = r.subject in N.SUBJECT_OF[r.intent]
        else:
            fits = not r.tt or (set(r.tt) & set(r.st) and r.role_target in ("", r.subject) and (not r.ql or set(r.ql) & set(r.ft) or r.acronym))
        if fits and r.score >= N.FACT_FROM:
            best.setdefault((r.dataset_id, r.question_id), []).append((-r.score, r.fact_input, r.fact_seg, r.rule, r.n))
    return {k: min(v) for k, v in best.items()}


@pytest.mark.parametrize("seed", [6, 7])
def test_facts_as_brute_force(spark, seed):
    facts, asked = facts_and_questions(seed)
    f = spark.createDataFrame(facts, FACTS)
    got = {(r.dataset_id, r.question_id): (-r.fact_score, r.fact_input, r.fact_seg) for r in N.match_facts(spark.createDataFrame(asked, ASKED), f).collect()}
    want = brute(spark, facts, asked)
    assert len(want) > 60 and got == {k: v[:3] for k, v in want.items()}
    assert N.match_facts(spark.createDataFrame(asked, ASKED), f.where("false")).count() == 0


def test_many_place_questions_meet_few_venues(spark):
    """Ten thousand equal questions and some of one's own against a hundred thousand venues: the pairs that are scored are a few for each different question."""
    venue = F.concat(F.lit("hall h"), F.col("id"))
    facts = spark.range(100_000).select(
        F.lit("a").alias("dataset_id"), F.col("id").alias("input_id"), F.lit(0).alias("seg_ord"), F.lit(0).alias("rule"), F.lit(0).alias("n"), F.lit("event").alias("fact_type"), F.lit("venue").alias("subject"),
        F.lit("is").alias("predicate"), venue.alias("object"), F.lit("").alias("qualifier"), F.lit(0.9).alias("confidence"), F.concat(F.lit("Venue: "), venue).alias("fact_text"),
    )
    asked = spark.range(10_020).select(F.lit("a").alias("dataset_id"), F.col("id").alias("question_id"), F.when(F.col("id") < 10_000, "").otherwise(F.concat(F.lit("h"), F.col("id") * 7)).alias("more"))
    text = F.concat_ws(" ", F.lit("where is the venue"), "more")
    asked = asked.select("dataset_id", "question_id", F.lit("location").alias("intent"), F.lit("").alias("role_target"), F.lit("venue").alias("target"), F.lit("").alias("qualifier"), text.alias("normalized"), text.alias("expanded"))
    got = {r.question_id: r.fact_input for r in N.match_facts(asked, facts).collect()}
    assert got == {i: 0 if i < 10_000 else i * 7 for i in range(10_020)}
    once = asked.where("question_id >= 9999").select("dataset_id", F.col("question_id").cast("string").alias("asked"), "intent", F.lit("").alias("role_target"), N.terms(F.col("target")).alias("tt"), N.terms(F.col("qualifier")).alias("ql"), N.terms(F.col("expanded")).alias("qt"), F.lit("location").alias("kind"))
    assert N.fact_candidates(once, N._facts_of(facts)).count() <= 3 * 21
