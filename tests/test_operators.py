"""Small inputs of our own with values worked out by hand, and properties."""

import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import urls as U
from corpusloom.operators import answers as N
from corpusloom.operators import chunks as C
from corpusloom.operators import facts as FA
from corpusloom.operators import questions as Q
from corpusloom.operators import retrieve as R
from corpusloom.operators import segments as S
from corpusloom.operators import structured as ST
from corpusloom.operators import tables as X
from corpusloom.operators import web as W

OFFICE = """OFFICE DIRECTORY
CEO: Maya Raman
Head: Dr. Paul Thomas
Contact: desk@example.org

| Product | Owner Team | Owner Team |
|---------|------------|------------|
| Invoice | Billing    | Audit      |
| Search  | Index      | Core       |
"""
PEOPLE = """Name: Asha Nair
Role: HOD
Department: Computer Science
Email: asha@example.org

Name: Ravi Kumar
Role: Dean
Email: ravi@example.org
"""


def segment(spark, text, title="t"):
    return spark.createDataFrame([("d", 1, 0, title, title, text)], "dataset_id string, input_id long, seg_ord int, title string, source_name string, text string")


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def test_windows_cover_and_overlap():
    text = "\n".join(f"Line {i} has some words in it." for i in range(400))
    parts = list(C.windows(text))
    assert all(0 < len(p) <= C.MAX_CHARS for p in parts)
    at = 0
    for p in parts:
        here = text.find(p, max(0, at - C.OVERLAP - 2))
        assert 0 <= here <= at
        at = here + len(p)
    assert at == len(text)
    assert list(C.windows(" \n ")) == []


def test_table_segment(spark):
    own = S.classify_segments(segment(spark, OFFICE))
    row = own.first()
    assert (row.segment_type, row.method, row.confidence) == ("sql_candidate", "sql", 0.94)
    catalog, cells, named = X.extract_tables(own)
    assert catalog.first().columns == ["product", "owner_team", "owner_team_2"] and catalog.first().row_count == 2
    assert {(r.row_no, r.col_name, r.value) for r in cells.collect()} >= {(0, "product", "Invoice"), (1, "owner_team_2", "Core")}
    assert named.first().table_name == catalog.first().table_name


def test_records(spark):
    cells = {(r.row_no, r.col_name): r.value for r in X.key_value_records(segment(spark, PEOPLE)).collect()}
    assert cells[0, "department"] == "Computer Science" and cells[1, "name"] == "Ravi Kumar" and (1, "department") not in cells


def test_facts(spark):
    got = {(r.fact_type, r.subject, r.object, r.qualifier, r.confidence) for r in FA.extract_facts(segment(spark, OFFICE + PEOPLE)).collect()}
    assert ("role", "ceo", "Maya Raman", "t", 0.92) in got and ("role", "head", "Dr. Paul Thomas", "t", 0.92) in got
    assert ("role", "head of department", "Asha Nair", "Computer Science", 0.9) in got and ("contact", "email", "ravi@example.org", "Ravi Kumar", 0.86) in got
    said = FA.role_sentence_facts(segment(spark, "We met. The principal is Dr. Anna Bell today. Bye.")).collect()
    assert any(r.subject == "principal" and "Anna Bell" in r.object for r in said)
    dates = [r.object for r in FA.date_facts(segment(spark, "On 12 March 2026 or March 5, 2025 or 1/2/2024.")).collect()]
    assert dates == ["12 March 2026", "March 5, 2025", "1/2/2024"]


def test_sections(spark):
    text = "# First\n" + "word " * 60 + "\n# Second\n" + "other " * 60 + "\nSHORT HEADING\nfew words"
    found = S.sections(text, "file")
    assert [t for t, _ in found] == ["First", "Second"] and found[1][1].endswith("few words")
    assert S.sections("", "file") == [("file", "")]


@pytest.mark.parametrize(
    "question, intent, target, role, qualifier",
    [
        ("who is the princiapl?", "point_lookup", "principal", "principal", ""),
        ("who is the hod of cse?", "point_lookup", "hod of cse", "head of department", "cse"),
        ("how many products are listed?", "aggregate", "", "", ""),
        ("where is the venue?", "location", "venue", "", ""),
        ("hi", "casual_chat", "", "", ""),
        ("compare a and b", "comparison", "", "", ""),
    ],
)
def test_questions(spark, question, intent, target, role, qualifier):
    row = Q.understand(spark.createDataFrame([("d", 1, question)], "dataset_id string, question_id long, question string")).first()
    assert (row.intent, row.target, row.role_target, row.qualifier) == (intent, target, role, qualifier)


def test_routes(spark):
    asked = Q.expand_questions(Q.understand(spark.createDataFrame([("d", 1, "what is the total revenue?"), ("d", 2, "who is Aaron Thomas?"), ("d", 3, "how are things connected?")], "dataset_id string, question_id long, question string")))
    profile = spark.createDataFrame([("d", True, True, True, True, False)], "dataset_id string, has_tables boolean, has_chunks boolean, has_nodes boolean, has_facts boolean, has_long boolean")
    assert [r.route for r in Q.route_questions(asked, profile).orderBy("question_id").collect()] == ["sql", "keyword", "graph"]
    assert {(r.route, r.route_confidence) for r in Q.route_questions(asked, profile, "graph").collect()} == {("graph", 1.0)}


def test_plans(spark):
    def plan(q):
        op, term = ST.plan_question(F.lit(q))
        return value(spark, op), value(spark, term)

    assert plan("what is the total revenue?") == ("total", None) and plan("my account") == ("count", None)
    assert plan("which team owns the invoice endpoint?") == ("search", "invoice") and plan("a b") == ("browse", None)
    sales = spark.createDataFrame([("North", 10), ("South", 20)], "region string, revenue int")
    assert ST.total_metric(sales, "revenue").first()[0] == 30 and ST.top_rows(sales, "revenue", 1).first().region == "South"
    assert ST.search_rows(sales, "nor").count() == 1
    with pytest.raises(ValueError):
        ST.run_query(spark, "DROP TABLE x")


def test_search_is_per_dataset(spark):
    """Adding a data set changes nothing in another; the order of rows does not matter."""
    rows = [("a", 1, 0, 0, "red fox jumps"), ("a", 2, 0, 0, "red red hen"), ("a", 3, 0, 0, "blue sky")]
    schema = "dataset_id string, input_id long, seg_ord int, chunk_ord int, text string"
    asked = spark.createDataFrame([("a", 1, "red fox")], "dataset_id string, question_id long, question string")
    one = R.keyword_search(asked, spark.createDataFrame(rows, schema)).orderBy("rank").collect()
    two = R.keyword_search(asked, spark.createDataFrame([("b", 1, 0, 0, "red fox")] + rows[::-1], schema)).orderBy("rank").collect()
    assert one == two and [r.input_id for r in one] == [1, 2] and one[0].score > 12
    assert [r.input_id for r in R.tfidf_search(asked, spark.createDataFrame(rows, schema)).orderBy("rank").collect()] == [1, 2]


def test_top_k_is_limited_before_the_shuffle(spark):
    hits = spark.range(100).select(F.lit("d").alias("dataset_id"), F.col("id").alias("question_id"), F.col("id").alias("input_id"), F.lit(0).alias("seg_ord"), F.lit(0).alias("chunk_ord"), F.rand(1).alias("score"))
    assert "WindowGroupLimit" in R.top_k(hits, 3)._jdf.queryExecution().executedPlan().toString()


def test_urls(spark):
    assert value(spark, U.normalize_url(F.lit(" https://A.example.org/x/?q=1#f "))) == "https://A.example.org/x?q=1"
    assert value(spark, U.normalize_url(F.lit("https://a.org"))) == "https://a.org/"
    assert value(spark, W.resolve(F.lit("https://a.org/x/y.html"), F.lit("../z?q=1"))) == "https://a.org/z?q=1"
    assert not value(spark, U.is_crawlable(F.lit("https://a.org/logo.PNG"), F.lit("a.org")))
    assert value(spark, U.is_document(F.lit("https://b.org/f.pdf")))


def test_crawl(spark):
    page = '<title>T</title><body>text <a href="{}">x</a><script>no</script></body>'
    stored = [("https://www.a.org/", page.format("/one#x")), ("https://www.a.org/one", page.format("two/")), ("https://www.a.org/two", page.format("https://b.org/f.pdf")), ("https://www.a.org/about", page.format("/gone"))]
    pages = spark.createDataFrame(stored, "url string, html string")
    seeds = spark.createDataFrame([("https://www.a.org/",)], "site string")
    got = W.crawl(seeds, pages, W.page_links(pages)).orderBy("rank").collect()
    assert [(r.url[17:], r.depth) for r in got] == [("/", 0), ("/about", 1), ("/one", 1), ("/two", 2)]
    assert [r.url for r in W.crawl(seeds, pages, W.page_links(pages), max_pages=2).orderBy("rank").collect()] == ["https://www.a.org/", "https://www.a.org/about"]
    assert W.page_text(pages).first().text == "T\ntext\nx" or "no" not in W.page_text(pages).first().text


def test_sitemaps(spark):
    docs = spark.createDataFrame([("https://a.org/sitemap.xml", "<loc>https://a.org/posts.xml</loc>"), ("https://a.org/posts.xml", "<loc>https://a.org/b</loc><loc> https://a.org/a/ </loc><loc>https://c.org/x</loc>")], "url string, body string")
    seeds = spark.createDataFrame([("https://a.org/",)], "site string")
    assert [r.url for r in W.expand_sitemaps(seeds, docs, 10).orderBy("url").collect()] == ["https://a.org/a", "https://a.org/b"]


def test_lines_and_evidence(spark):
    assert value(spark, T.lines(F.lit("a\r\nb\x0bc\n"))) == ["a", "b", "c"]
    assert value(spark, T.clean_evidence(F.lit("=== URL: x\nTitle: y\n  one \n\n two  three"))) == "one two three"


def test_links_of_plain_attributes_and_entities(spark):
    html = """<a href=/one>x</a> <a href="/two?a=1&amp;b=2">y</a> <area href='/three.pdf'> <div data-href="/four"></div> <script>go({url: "/five"})</script>"""
    got = {(r.dst, r.kind) for r in W.page_links(spark.createDataFrame([("https://site.org/", html)], "url string, html string")).collect()}
    assert got == {("https://site.org/one", "page"), ("https://site.org/two?a=1&b=2", "page"), ("https://site.org/three.pdf", "document"), ("https://site.org/four", "page"), ("https://site.org/five", "page")}


def test_site_maps_of_any_depth(spark):
    """Ten maps below each other, and one that names itself."""
    roots = spark.createDataFrame([("https://site.org/",)], "site string")
    rows = [("https://site.org/sitemap.xml", "<loc>https://site.org/m1.xml</loc><loc>https://site.org/sitemap.xml</loc>")]
    rows += [(f"https://site.org/m{k}.xml", f"<loc>https://site.org/m{k + 1}.xml</loc><loc>https://site.org/p{k}</loc>") for k in range(1, 11)]
    got = {r.url for r in W.expand_sitemaps(roots, spark.createDataFrame(rows, "url string, body string"), 50).collect()}
    assert got == {f"https://site.org/p{k}" for k in range(1, 11)}


def sales(spark):
    cells = [("d", "sales", i, [f"Item{i}", str(i * 10), "North" if i % 2 else "South"]) for i in range(1, 31)]
    rows = spark.createDataFrame(cells, "dataset_id string, table_name string, ord int, cells array<string>")
    tables = [("d", "sales", ["item", "amount", "Region"], "sales.csv"), ("d", "zz", ["Place", "place"], "zz")]
    return rows, spark.createDataFrame(tables, "dataset_id string, table_name string, columns array<string>, source_name string")


def test_batch_of_questions_to_tables(spark):
    rows, catalog = sales(spark)
    asked = ["how many amount", "average amount", "total amount", "top amount", "Item2 amount", "I_em3 amount", "amount nowhere", "count a place", "the sum of a place"]
    q = spark.createDataFrame([("d", i, t) for i, t in enumerate(asked)], "dataset_id string, question_id int, question string")
    got = {r.question_id: r for r in ST.summarize_rows(ST.rows_for_questions(q, catalog, rows)).collect()}
    assert len(got) == len(asked)
    said = "The answer from the structured data is "
    assert [got[i].summary for i in range(3)] == [f"{said}30.", f"{said}155.", f"{said}4650."]
    assert [r["item"] for r in got[3].found] == [f"Item{i}" for i in range(30, 20, -1)]
    assert [r["item"] for r in got[4].found] == ["Item2"] + [f"Item{i}" for i in range(20, 30)]
    assert [r["item"] for r in got[5].found] == ["Item3", "Item30"]
    assert got[6].n_rows == 0 and "did not return" in got[6].summary
    assert (got[7].table_name, got[7].summary, got[8].summary) == ("zz", f"{said}0.", f"{said}None.")


def test_batch_search_as_one_by_one(spark):
    """The first rows of each searched word, against every row and word."""
    rows, catalog = sales(spark)
    words = ["item1", "north", "item_", "_tem2", "outh", "2900", "item30"]
    q = spark.createDataFrame([("d", i, f"{w} amount") for i, w in enumerate(words)], "dataset_id string, question_id int, question string")
    got = {r.question_id: [x["item"] for x in r.found] for r in ST.rows_for_questions(q, catalog, rows).collect()}
    for i, w in enumerate(words):
        own = rows.orderBy("ord").select("cells").collect()
        pattern = w.replace("_", ".")
        assert got[i] == [r.cells[0] for r in own if any(re.search(pattern, c, re.I) for c in r.cells)][:20], w


def test_answers_are_composed_by_route(spark):
    kinds = "dataset_id string, question_id int, intent string, route string, answer string, direct_answer string, confidence double, has_fact boolean, fact_type string, has_tables boolean, has_chunks boolean, has_nodes boolean"
    made = [
        ("d", 1, "aggregate", "sql", "extract", "", 0.62, False, None, True, True, True),
        ("d", 2, "list", "hybrid", "extract", "direct", 0.62, False, None, True, True, True),
        ("d", 3, "casual_chat", "keyword", "x", "", 0.0, False, None, True, True, True),
        ("e", 4, "relationship", "graph", N.NOT_FOUND, "", 0.0, False, None, False, False, None),
        ("d", 5, "point_lookup", "sql", "The CEO is Maya.", "The CEO is Maya.", 0.9, True, "role", True, True, True),
        ("e", 6, "aggregate", "sql", "", "", 0.0, False, None, False, False, False),
    ]
    made = spark.createDataFrame(made, kinds).withColumns({"route_confidence": F.lit(0.9), "route_reason": F.lit("r")})
    tables = spark.createDataFrame([("d", 1, "Sum.", 1), ("d", 2, "Rows.", 3), ("d", 5, "None.", 0)], "dataset_id string, question_id int, summary string, n_rows int")
    hints = spark.createDataFrame([("d", "Hint."), ("e", "No hint.")], "dataset_id string, hint string")
    got = {r.question_id: r for r in N.compose(made, tables, hints).collect()}
    assert (got[1].answer, got[1].direct_answer, got[1].confidence, got[1].retrievers_used) == ("Sum.", "Sum.", 0.86, ["sql"])
    assert (got[2].answer, got[2].direct_answer) == ("Rows.\n\nHint.\n\nextract", "direct")
    assert got[2].retrievers_used == ["semantic", "keyword", "hierarchical", "sql", "graph"]
    assert (got[3].answer, got[3].route, got[3].confidence, got[3].retrievers_skipped[0].retriever) == (N.CASUAL_REPLY, "semantic", 1.0, "all")
    assert got[4].answer == f"No hint.\n\n{N.NOT_FOUND}" and {s.retriever for s in got[4].retrievers_skipped} == {"semantic", "graph"}
    assert (got[5].answer, got[5].confidence, got[5].retrievers_used) == ("None.\n\nThe CEO is Maya.", 0.9, ["sql"])
    assert (got[6].answer, got[6].confidence, [s.retriever for s in got[6].retrievers_skipped]) == (N.EMPTY, 0.0, ["sql"])
