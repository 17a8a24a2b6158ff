"""Every registered query of the library against its SQL, and helpers against values worked out by hand."""

import pytest
from compare import same_rows
from pyspark.sql import functions as F

from corpusloom.jobs import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, name):
    assert same_rows(catalog.queries()[name](spark, SF), catalog.oracle_sql()[name], SF) >= 0


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - {"answer_questions"}))
def test_runs(spark, name):
    df = catalog.queries()[name](spark, SF)
    assert len(df.collect()) > 0 and len(set(df.columns)) == len(df.columns)


def test_answers(spark):
    """Every route but the semantic one, which no data set without long sections asks for; and whole answers: a fact, a sum with its statement and rows, the graph, small talk."""
    rows = catalog.queries()["answer_questions"](spark, SF).collect()
    got = {(r.route, r.status) for r in rows}
    assert {("hierarchical", "grounded"), ("sql", "grounded"), ("sql", "weak_evidence"), ("keyword", "grounded"), ("keyword", "not_found"), ("hybrid", "grounded"), ("graph", "grounded"), ("semantic", "casual_chat")} <= got
    by = {}
    for r in rows:
        by.setdefault(r.normalized, r)
    secretary = by["Who is the secretary?"]
    assert secretary.answer.startswith("The secretary is Ola N") and secretary.reasons == "sure result of a table or a fact" and secretary.candidates >= 1
    total = spark.read.parquet(f"{SF}/lineitem.parquet").agg(F.sum("l_quantity")).first()[0]
    explained = by["Explain the total l_extendedprice"]
    assert explained.statement == 'SELECT SUM("l_quantity") FROM "lineitem"' and explained.table_rows == f'[{{"total_l_quantity":"{total:.0f}"}}]'
    assert explained.answer.split("\n\n")[0] == f"The answer from the structured data is {total:.0f}." and explained.confidence == 0.86
    graph = by["Which entities are connected?"]
    assert graph.answer.startswith("The lightweight graph layer found") and graph.retrievers_used == "semantic, graph" and graph.sources <= 8 and graph.candidates >= graph.sources
    thanks = by["Thanks!"]
    assert (thanks.candidates, thanks.sources, thanks.evidence_tokens, thanks.retrievers_skipped, thanks.reasons) == (0, 0, 0, "all", "small talk")
    for r in rows:
        assert r.saved_tokens == max(0, r.dataset_tokens - r.evidence_tokens) and 0 <= r.reduction_percent <= 100
        assert (r.statement is not None) == (r.route in ("sql", "hybrid"))


def test_questions_meet_all_kinds_of_facts(spark, tmp_path):
    """Not contacts alone: roles and dates answer, and give terms."""
    text = "OFFICE DIRECTORY\nCEO: Maya Raman\nVenue: Hall Seven\nContact: desk@example.org\n"
    spark.createDataFrame([(1, text, "en", "src0", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("customer", "supplier"):  # no offices, and no questions to them
        spark.read.parquet(f"{SF}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    asked = [(0, 1, "user", "Who is the CEO?"), (0, 2, "user", "Where is the venue?")]
    spark.createDataFrame(asked, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.question_id: r.object for r in catalog.queries()["match_facts"](spark, str(tmp_path)).collect()}
    assert got == {1: "Maya Raman", 2: "Hall Seven"}
    with_terms = {r.question_id: r.expanded for r in catalog.queries()["expand_questions"](spark, str(tmp_path)).collect()}
    assert "venue" in with_terms[2].lower()
