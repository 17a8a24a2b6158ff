"""The inverted index: phrases and scores against brute force, blocks that are left out, plans without tokenising, and stored steps."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.store import DatasetBuild
from corpusloom.operators import index as I
from corpusloom.operators import retrieve as R

CHUNKS = "dataset_id string, input_id long, seg_ord int, chunk_ord int, text string"
ASKED = "dataset_id string, question_id long, question string"


def corpus(seed=1, n=300):
    rng = random.Random(seed)
    vocabulary = ["red", "fox", "foxes", "provide", "id", "über", "naïve", "the", "a", "hen", "co-op", "don't", "x_1", "42", "日本", "語", "e.g.", "...", "Iİ", "K"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\n", ", ", ". ", "-", "\t"]) for _ in range(rng.randint(0, 30)))
        rows.append((rng.choice("ab"), i, 0, i % 3, text))
    return rows + [("a", n, 0, 0, None), ("c", n + 1, 0, 0, "")]


def phrases(rows, seed=2):
    """Pieces of the texts, whole words or cut anywhere, and phrases that stand nowhere."""
    rng = random.Random(seed)
    made = ["id", "I", "fox", "the fox", "...", "-", "\t", "  ", "", "日", "no such phrase here", "e.g. 42", "D'S", "hen.  ", "语", "ox the re", None]
    for _ in range(120):
        _, _, _, _, text = rng.choice(rows)
        if text:
            at = rng.randrange(len(text))
            made.append(text[at : at + rng.choice([1, 2, 4, 9, 17, 30])].upper())
    return [(rng.choice("abd"), i, p) for i, p in enumerate(made)]


def lower(spark, texts):
    """As Spark lowers and trims, so that the test is of the search alone."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return {r.i: (r.low, r.trimmed) for r in df.select("i", F.lower("t").alias("low"), F.trim(F.lower("t")).alias("trimmed")).collect()}


def test_phrases_as_brute_force(spark):
    rows = corpus()
    asked = phrases(rows)
    bodies, said = lower(spark, [r[4] for r in rows]), lower(spark, [q[2] for q in asked])
    want = {(q[0], q[1], *r[1:4]) for j, q in enumerate(asked) for i, r in enumerate(rows) if q[0] == r[0] and said[j][1] and bodies[i][0] is not None and said[j][1] in bodies[i][0]}
    index = I.index_chunks(spark.createDataFrame(rows, CHUNKS), ("word",))
    got = {tuple(r) for r in I.phrase_hits(spark.createDataFrame(asked, ASKED), index).select("dataset_id", "question_id", *I.CHUNK[1:]).collect()}
    assert len(want) > 500 and got == want


def zipf(spark, n=2000, seed=4):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(n * 25)]
    rows = [("d", i, 0, 0, " ".join(words[i * 25 : i * 25 + rng.randint(1, 25)] + [f"w{i % 7}"] * rng.randint(0, 5))) for i in range(n)]
    asked = [("d", i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))) for i in range(60)]
    return rows, asked, spark.createDataFrame(rows, CHUNKS), spark.createDataFrame(asked, ASKED)


def brute_keyword(rows, asked, k):
    docs = {r[1]: Counter(r[4].split()) for r in rows}
    df = Counter(t for d in docs.values() for t in d)
    out = {}
    for _, q, text in asked:
        qtf = Counter(text.split())
        idf = {t: math.log((len(rows) + 1) / (df[t] + 0.5)) + 1 for t in qtf if t in df}
        score = {i: sum(d[t] * qtf[t] * idf[t] for t in idf) + (12 if text in r[4] else 0) for r, (i, d) in zip(rows, docs.items())}
        out[q] = sorted(((-round(s, 4), i) for i, s in score.items() if s > 0))[:k]
    return out


@pytest.mark.parametrize("part", [300])
def test_blocks_left_out_change_nothing(spark, monkeypatch, part):
    """Small blocks, also in several parts: the first hits are those of scoring every chunk, though most blocks are not opened."""
    monkeypatch.setattr(I, "BLOCK", 8)
    monkeypatch.setattr(I, "PART", part)
    rows, asked, chunks, questions = zipf(spark)
    got = {}
    for r in R.keyword_search(questions, chunks, 5).collect():
        got.setdefault(r.question_id, []).append((-r.score, r.input_id))
    want = brute_keyword(rows, asked, 5)
    assert {q: sorted(h) for q, h in got.items()} == {q: h for q, h in want.items() if h}
    index = I.index_chunks(chunks, ("keyword",))
    terms = I.asked_terms(questions, index, "keyword", I.keyword_tokens).where("df IS NOT NULL").withColumn("qw", F.col("qtf") * I.idf(F.col("n"), F.col("df")))
    opened, every = I.candidates(terms, index, I.CHUNK, 5).count(), terms.agg(F.sum("df")).first()[0]
    assert opened < 0.75 * every


def test_cosines_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(I, "BLOCK", 8)
    rows, asked, chunks, questions = zipf(spark, 400)
    docs = {r[1]: Counter(r[4].split()) for r in rows}
    df = Counter(t for d in docs.values() for t in d)
    idf = {t: math.log((len(rows) + 1) / (n + 0.5)) + 1 for t, n in df.items()}
    norm = {i: math.sqrt(sum((n * idf[t]) ** 2 for t, n in d.items())) for i, d in docs.items()}
    for q in R.tfidf_search(questions, chunks, 4).groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "input_id", "score"))).alias("h")).collect():
        qtf = Counter(asked[q.question_id][2].split())
        q_norm = math.sqrt(sum((n * idf.get(t, 1.0)) ** 2 for t, n in qtf.items()))
        score = {i: sum(d[t] * idf[t] * n * idf[t] for t, n in qtf.items() if t in d) / (q_norm * norm[i]) for i, d in docs.items()}
        assert [h.input_id for h in q.h] == [i for _, i in sorted((-round(s, 4), i) for i, s in score.items() if s > 0)[:4]]


def test_stored_searches_do_not_read_texts_anew(spark, tmp_path):
    """Plans over stored lists: no tokens of chunks are cut, no chunk meets a question by its data set alone."""
    build = DatasetBuild(spark.createDataFrame(corpus(), CHUNKS), root=str(tmp_path))
    lists = build.step("lists", lambda own: I.index_chunks(own).lists, I.LIST)
    index = I.TextIndex(lists, build.step("terms", I.terms_of, of=lists), build.step("sizes", lambda own: I.index_chunks(own).sizes), build.step("chunks", lambda own: own, tuple(I.CHUNK)))
    questions = spark.createDataFrame(phrases(corpus()), ASKED)
    for hits in (R.keyword_search(questions, index), R.tfidf_search(questions, index)):
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        joins = re.findall(r"(?:SortMergeJoin|HashJoin) \[([^\]]*)\]", plan)
        assert joins and all("term" in j or "_id" in j.replace("dataset_id", "") or "phrase" in j or "gram" in j or "kind" in j or "dataset_id" == re.sub(r"#\d+", "", j) for j in joins)
    assert sorted(map(str, R.keyword_search(questions, index).collect())) == sorted(map(str, R.keyword_search(questions, spark.createDataFrame(corpus(), CHUNKS)).collect()))


def test_steps_are_made_once_for_each_content(spark, tmp_path):
    """A changed, a new and a lost data set: only what changed is made again, and nothing of old contents is read."""
    made = []

    def lengths(own):
        made.append(sorted(r.dataset_id for r in own.select("dataset_id").distinct().collect()))
        return own.select("dataset_id", "input_id", F.length("text").alias("n"))

    def run(rows, buckets=()):
        df = spark.createDataFrame(rows, "dataset_id string, input_id long, text string")
        return sorted(tuple(r) for r in DatasetBuild(df, root=str(tmp_path)).step(f"lengths{len(buckets)}", lengths, buckets).collect())

    first = [("a", 1, "x"), ("a", 2, "yy"), ("b", 3, "zzz"), ("c", 4, None)]
    for buckets in ((), ("dataset_id", "input_id")):
        made.clear()
        want = [(d, i, None if t is None else len(t)) for d, i, t in first]
        assert run(first, buckets) == sorted(want, key=str) or run(first, buckets) == want
        assert run(first[::-1], buckets) == want and made == [["a", "b", "c"]]
        second = [("a", 1, "x"), ("a", 2, "yyyy"), ("b", 3, "zzz"), ("d", 5, "new")]
        assert run(second, buckets) == [("a", 1, 1), ("a", 2, 4), ("b", 3, 3), ("d", 5, 3)] and made[1:] == [["a", "d"]]
        assert run(first, buckets) == want and len(made) == 2
    assert run([]) == []


def test_a_build_that_fails_is_not_read(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "dataset_id string, x long")

    def fails(own):
        return own.withColumn("x", F.raise_error(F.lit("lost")).cast("long"))

    with pytest.raises(Exception, match="lost"):
        DatasetBuild(df, root=str(tmp_path)).step("s", fails)
    assert DatasetBuild(df, root=str(tmp_path)).step("s", lambda own: own).count() == 2
