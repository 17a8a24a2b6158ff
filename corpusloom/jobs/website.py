"""Registered queries on stored pages, files and incremental adds, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import urls as U
from corpusloom.functions.lineage import shared_root
from corpusloom.jobs import sql_parts as P
from corpusloom.operators import web as W
from corpusloom.sources import files as IO


def pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def seeds(spark, sf_dir):
    """The first stored page of each host, as the seed of its site."""
    df = pages(spark, sf_dir).withColumn("host", U.canonical_host(U.part(F.col("url"), 2)))
    return df.groupBy("host").agg(F.min_by("url", "page_id").alias("site")).select("site")


def _urls(spark, sf_dir):
    u = F.col("url")
    host = U.part(u, 2)
    return pages(spark, sf_dir).select("page_id", U.normalize_url(F.concat(u, F.lit("/?a=1#top"))).alias("normal"), U.canonical_host(host).alias("host"), U.is_crawlable(u, F.concat(F.lit("www."), host)).alias("crawlable"), U.is_document(u).alias("document"))


def linked_pages(spark, sf_dir):
    """Stored pages, which link to none of each other, with two links more: to the next page of their host and the third after it, by ``page_id``."""
    of = Window.partitionBy(U.canonical_host(U.part(F.col("url"), 2))).orderBy("page_id")
    links = [F.when(F.lead("url", k).over(of).isNotNull(), F.concat(F.lit('<a href="'), F.lead("url", k).over(of), F.lit('">more</a>'))) for k in (1, 3)]
    return pages(spark, sf_dir).withColumn("html", F.concat("html", F.coalesce(links[0], F.lit("")), F.coalesce(links[1], F.lit(""))))


def site_maps(spark, sf_dir):
    """Site maps that Spark makes of the stored pages: each site's map names three others, each of those its share of the site's pages, and a deeper one that names the first again."""
    df = pages(spark, sf_dir)
    host = U.canonical_host(U.part(F.col("url"), 2))
    own = seeds(spark, sf_dir).select(U.canonical_host(U.part(F.col("site"), 2)).alias("host"), F.concat(U.part(F.col("site"), 1), F.lit("://"), U.part(F.col("site"), 2)).alias("origin"))
    loc = lambda c: F.concat(F.lit("<loc> "), c, F.lit("</loc>"))
    number = F.explode(F.array(*map(F.lit, range(3)))).alias("k")
    first = own.select(F.concat("origin", F.lit("/sitemap.xml")).alias("url"), F.concat(*(loc(F.concat("origin", F.lit(f"/map{k}.xml"))) for k in range(3))).alias("body"))
    second = own.select("origin", number).select(F.concat("origin", F.lit("/map"), "k", F.lit(".xml")).alias("url"), loc(F.concat("origin", F.lit("/deep"), "k", F.lit(".xml"))).alias("body"))
    named = df.select(host.alias("host"), (F.col("page_id") % 3).alias("k"), "url").join(own, "host")
    deep = named.groupBy("origin", "k").agg(F.array_join(F.array_sort(F.collect_list(loc(F.col("url")))), "").alias("all"))
    deep = deep.select(F.concat("origin", F.lit("/deep"), "k", F.lit(".xml")).alias("url"), F.concat("all", loc(F.concat("origin", F.lit("/sitemap.xml")))).alias("body"))
    return first.unionByName(second).unionByName(deep)


def _crawled(spark, sf_dir):
    """With what the site maps name."""
    linked = linked_pages(spark, sf_dir)
    return W.crawl(seeds(spark, sf_dir), linked, W.page_links(linked), _sitemaps(spark, sf_dir, 5))


def _sitemaps(spark, sf_dir, most=50):
    return W.expand_sitemaps(seeds(spark, sf_dir), site_maps(spark, sf_dir), most)


def _report(spark, sf_dir):
    linked = linked_pages(spark, sf_dir)
    return W.crawl_report(_crawled(spark, sf_dir), W.page_text(linked), W.page_links(linked), 8)


def _report_pages(spark, sf_dir):
    linked = linked_pages(spark, sf_dir)
    return W.crawled_pages(_crawled(spark, sf_dir), W.page_text(linked), W.page_links(linked))


def _catalog(spark, sf_dir):
    """Addresses as file paths."""
    return IO.catalog_inputs(pages(spark, sf_dir).select(F.concat(F.regexp_replace("url", "/$", ""), F.when(F.col("page_id") % 3 == 0, ".PDF").when(F.col("page_id") % 3 == 1, ".csv").otherwise(".bin")).alias("path")))


def _document_lines(spark, sf_dir):
    """Messages of a conversation as paragraphs (first ten turns) and table rows."""
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return IO.document_line_text(talk.select(F.col("conv_id").alias("input_id"), F.when(F.col("turn") < 2, "paragraph").otherwise("row").alias("kind"), F.col("turn").alias("ord"), F.array("role", "text").alias("cells")))


def _scratch(spark, name):
    return f"{shared_root(spark)}/files/{name}-{uuid.uuid4().hex[:12]}"


def _table_file(spark, sf_dir):
    """Every part written as a CSV file, read back with inferred types, swapped in as the current version of a table, and read from there."""
    path, cols = _scratch(spark, "parts"), ["p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"]
    df = spark.read.parquet(f"{sf_dir}/part.parquet")
    cols = [c for c in cols if c in df.columns]
    df.select(*cols).write.option("header", True).csv(f"{path}/csv")
    IO.swap_in(IO.read_table(spark, f"{path}/csv", malformed="_malformed").where("_malformed IS NULL").drop("_malformed"), f"{path}/table")
    return IO.read_current(spark, f"{path}/table").select(F.col("p_partkey").cast("long").alias("p_partkey"), F.col("p_name").alias("p_name"), F.round(F.col("p_retailprice").cast("double"), 4).alias("p_retailprice"))


def _text_files(spark, sf_dir):
    """A text file for each supplier, read as a corpus."""
    path = _scratch(spark, "suppliers")
    df = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.concat("s_name", F.lit("\nNation "), "s_nationkey").alias("value"))
    # as many tasks as there are cores, each of which moves its own files: a fixed number is not made one by size, and the driver moves none
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    df.repartition(n, "s_suppkey").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("s_suppkey").text(path)
    got = IO.read_text_corpus(spark, path, "suppliers")
    return got.select("dataset_id", F.regexp_extract("input_id", "s_suppkey=([0-9]+)", 1).cast("long").alias("s_suppkey"), "text")


QUERIES = {
    "table_file": _table_file,
    "text_files": _text_files,
    "normalize_url": _urls,
    "page_text": lambda s, d: W.page_text(pages(s, d)),
    "page_links": lambda s, d: W.page_links(pages(s, d)),
    "discovery_candidates": lambda s, d: W.discovery_candidates(seeds(s, d)),
    "expand_sitemaps": _sitemaps,
    "crawl": _crawled,
    "crawl_report": _report,
    "crawled_pages": _report_pages,
    "catalog_inputs": _catalog,
    "document_line_text": _document_lines,
}

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
_HOST = rf"regexp_replace(lower(regexp_extract(url, '{_PARTS}', 2)), '^www\.', '')"
_PATH = rf"regexp_extract(url, '{_PARTS}', 3)"
_SEEDS = f"seeds AS (SELECT min_by(url, page_id) AS site FROM pages GROUP BY {_HOST})"


def _unescaped(col: str) -> str:
    """The entities that stored pages hold; the ampersand comes last, as what it makes is not read again."""
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&"), ("&amp", "&")):
        col = f"replace({col}, '{entity}', '{char}')"
    return col


def _page_text(source: str) -> str:
    """CTE ``texts``: the text between tags, a line for each piece."""
    gone = "script|style|noscript|svg|canvas|form"
    piece = rf"trim(regexp_replace({_unescaped('x')}, '[\s\x{{A0}}]+', ' ', 'g'))"
    return rf"""texts AS (SELECT url, CASE WHEN title = '' THEN url ELSE title END AS title, description, text FROM (SELECT url, trim({_unescaped("regexp_extract(html, '<title>([^<]*)', 1)")}) AS title, {_unescaped("regexp_extract(html, '<meta name=\"description\" content=\"([^\"]*)\"', 1)")} AS description,
  array_to_string(list_filter(list_transform(string_split_regex(h, '<[^>]*>|[\n\r\x0B\x0C\x1C-\x1E\x85\x{{2028}}\x{{2029}}]'), lambda x: {piece}), lambda x: x <> ''), chr(10)) AS text
  FROM (SELECT *, regexp_replace(regexp_replace(html, '<!--.*?-->', '<x>', 'gs'), '<({gone})\b[^>]*>.*?</({gone})\s*>', '<x>', 'gs') AS h FROM {source})) WHERE text <> '')"""


def _part(u: str, k: int) -> str:
    return f"regexp_extract({u}, '{_PARTS}', {k})"


def _normal(u: str) -> str:
    u = f"regexp_replace(trim({u}), '#.*$', '')"
    path = _part(u, 3)
    path = f"CASE WHEN {path} = '' THEN '/' WHEN {path} <> '/' THEN regexp_replace({path}, '/$', '') ELSE {path} END"
    return f"(CASE WHEN {_part(u, 1)} <> '' THEN lower({_part(u, 1)}) || ':' ELSE '' END || CASE WHEN {_part(u, 2)} <> '' THEN '//' || {_part(u, 2)} ELSE '' END || {path} || CASE WHEN {_part(u, 4)} <> '' THEN '?' || {_part(u, 4)} ELSE '' END)"


def _canon(u: str) -> str:
    return rf"regexp_replace(lower({_part(u, 2)}), '^www\.', '')"


def _is_page(u: str, site: str) -> str:
    return rf"(lower({_part(u, 1)}) IN ('http', 'https') AND {_canon(u)} = {_canon(site)} AND NOT regexp_matches(lower({_part(u, 3)}), '\.({'|'.join(U.SKIPPED)}|xml)$'))"


def _is_document(u: str) -> str:
    return rf"regexp_matches(lower({_part(u, 3)}), '\.({'|'.join(U.DOCUMENTS)})$')"


def _links(source: str) -> str:
    """CTE ``links``: stored pages name addresses in ``href`` alone, whole or from the host's root."""
    origin = f"{_part('src', 1)} || '://' || {_part('src', 2)}"
    return f"""links AS (SELECT DISTINCT src, dst, CASE WHEN {_is_document('dst')} THEN 'document' ELSE 'page' END AS kind FROM (SELECT src, {_normal('href')} AS dst FROM (
  SELECT src, CASE WHEN starts_with(h, '/') THEN {origin} || h ELSE h END AS href FROM (SELECT url AS src, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS h FROM {source}))) WHERE {_is_document('dst')} OR {_is_page('dst', 'src')})"""


_LINKED = f"""linked AS (SELECT page_id, url, html || coalesce('<a href="' || lead(url, 1) OVER w || '">more</a>', '') || coalesce('<a href="' || lead(url, 3) OVER w || '">more</a>', '') AS html FROM pages WINDOW w AS (PARTITION BY {_HOST} ORDER BY page_id))"""
#: Maps as rows (map, named address), met from the sites' first maps on by recursion.
_MAPS = f"""own AS (SELECT site, {_canon('site')} AS host, {_part('site', 1)} || '://' || {_part('site', 2)} AS origin FROM seeds), ks AS (SELECT unnest([0, 1, 2]) AS k),
maps AS (SELECT origin || '/sitemap.xml' AS map, origin || '/map' || k || '.xml' AS u FROM own, ks UNION ALL SELECT origin || '/map' || k || '.xml', origin || '/deep' || k || '.xml' FROM own, ks
  UNION ALL SELECT origin || '/deep' || (page_id % 3) || '.xml', url FROM (SELECT url, page_id, {_HOST} AS host FROM pages) JOIN own USING (host) UNION ALL SELECT origin || '/deep' || k || '.xml', origin || '/sitemap.xml' FROM own JOIN (SELECT DISTINCT {_HOST} AS host, page_id % 3 AS k FROM pages) USING (host)),
met(site, map) AS (SELECT site, {_normal("origin || '/sitemap.xml'")} FROM own UNION SELECT site, {_normal('u')} FROM met JOIN maps USING (map) WHERE ends_with(u, '.xml')),
mapped AS (SELECT DISTINCT site, {_normal('u')} AS url FROM met JOIN maps USING (map) WHERE {_is_page('u', 'site')} AND NOT {_is_document('u')}),
sitemap AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY url) AS r FROM mapped)"""
_CANDIDATES = f"""candidates AS (SELECT DISTINCT site, {_normal("s || '://' || h || p")} AS url FROM (SELECT site, s, unnest([h, CASE WHEN starts_with(h, 'www.') THEN h[5:] ELSE 'www.' || h END]) AS h FROM (SELECT site, {_part('site', 1)} AS s, {_part('site', 2)} AS h FROM seeds)), (SELECT unnest([{', '.join(f"'{p}'" for p in W.COMMON_PATHS)}]) AS p))"""


def _crawl(most: int = 8, depth: int = W.MAX_DEPTH) -> str:
    """CTE ``crawled``: a step for each depth."""
    out = f"stored AS (SELECT DISTINCT {_normal('url')} AS url FROM linked), lk AS (SELECT DISTINCT {_normal('src')} AS url, dst FROM links WHERE kind = 'page' AND dst IN (SELECT url FROM stored)), level0 AS (SELECT site, {_normal('site')} AS url, 0 AS g, 0 AS parent FROM seeds)"
    for d in range(depth + 1):
        seen = "".join(f" AND NOT EXISTS (SELECT 1 FROM visit{e} v WHERE v.site = l.site AND v.url = l.url)" for e in range(d))
        if d:
            waiting = " UNION ALL SELECT site, url, 1, 0 FROM candidates UNION ALL SELECT site, url, 0, 0 FROM sitemap WHERE r <= 5" if d == 1 else ""
            out += f", level{d} AS (SELECT site, dst AS url, 2 AS g, k AS parent FROM visit{d - 1} JOIN lk USING (url){waiting})"
        out += f""", first{d} AS (SELECT site, url, min(ROW(g, parent, url)) AS o FROM level{d} l WHERE {_is_page('url', 'site')} AND NOT {_is_document('url')} AND url IN (SELECT url FROM stored){seen} GROUP BY 1, 2),
visit{d} AS (SELECT * FROM (SELECT site, url, {d} AS depth, row_number() OVER (PARTITION BY site ORDER BY o) AS k FROM first{d}) WHERE k <= {most})"""
    every = " UNION ALL ".join(f"SELECT * FROM visit{d}" for d in range(depth + 1))
    return f"{out}, crawled AS (SELECT site, url, depth, rank FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY depth, k) AS rank FROM ({every})) WHERE rank <= {most})"


_CRAWLED = f"WITH RECURSIVE {_SEEDS}, {_LINKED}, {_links('linked')}, {_MAPS}, {_CANDIDATES}, {_crawl()}"
_VISITED = f"""{_CRAWLED}, {_page_text('linked')}, dl AS (SELECT src AS url, count(*) AS document_links FROM links WHERE kind = 'document' GROUP BY 1),
seen AS (SELECT c.site, c.rank, c.url, coalesce(title, '') AS title, coalesce(description, '') AS description, CAST(coalesce(length(text), 0) AS BIGINT) AS text_chars, coalesce(document_links, 0) AS document_links FROM crawled c LEFT JOIN texts USING (url) LEFT JOIN dl USING (url))"""
SQL = {
    "table_file": "SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_name, round(CAST(p_retailprice AS DOUBLE), 4) AS p_retailprice FROM part",
    "text_files": "SELECT 'suppliers' AS dataset_id, CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name || chr(10) || 'Nation ' || s_nationkey || chr(10) AS text FROM supplier",
    "page_text": f"WITH {_page_text('pages')} SELECT * FROM texts",
    "page_links": f"WITH {_links('pages')} SELECT * FROM links",
    "expand_sitemaps": f"WITH RECURSIVE {_SEEDS}, {_MAPS} SELECT site, url FROM sitemap WHERE r <= 50",
    "crawl": f"{_CRAWLED} SELECT site, url, depth, rank FROM crawled",
    "crawled_pages": f"{_VISITED} SELECT * FROM seen",
    "crawl_report": f"{_VISITED} SELECT site, count(*) AS pages, CAST(sum(text_chars) AS BIGINT) AS text_chars, CAST(sum(document_links) AS BIGINT) AS document_links, 8 AS requested_pages, CASE WHEN count(*) >= 8 THEN 'complete' ELSE 'partial' END AS status, true AS recursive FROM seen GROUP BY 1",
    "normalize_url": rf"""WITH p AS (SELECT page_id, url, regexp_replace(url || '/?a=1#top', '#.*$', '') AS u FROM pages),
q AS (SELECT *, regexp_extract(u, '{_PARTS}', 1) AS s, regexp_extract(u, '{_PARTS}', 2) AS h, regexp_extract(u, '{_PARTS}', 3) AS p, regexp_extract(u, '{_PARTS}', 4) AS r FROM p)
SELECT page_id, s || '://' || h || CASE WHEN p = '' THEN '/' WHEN p <> '/' THEN regexp_replace(p, '/$', '') ELSE p END || CASE WHEN r <> '' THEN '?' || r ELSE '' END AS normal, {_HOST} AS host,
  NOT regexp_matches(lower({_PATH}), '\.({'|'.join(U.SKIPPED)}|xml)$') AND regexp_matches(url, '^https?:') AND NOT starts_with(lower(h), 'www.') AS crawlable, regexp_matches(lower({_PATH}), '\.({'|'.join(U.DOCUMENTS)})$') AS document FROM q""",
    "discovery_candidates": rf"""WITH {_SEEDS}, h AS (SELECT site, regexp_extract(site, '{_PARTS}', 1) AS s, regexp_extract(site, '{_PARTS}', 2) AS h FROM seeds), b AS (SELECT site, s, unnest([h, CASE WHEN starts_with(h, 'www.') THEN h[5:] ELSE 'www.' || h END]) AS h FROM h)
SELECT DISTINCT site, s || '://' || h || p AS url FROM b, (SELECT unnest([{', '.join(f"'{p}'" for p in W.COMMON_PATHS)}]) AS p)""",
    "catalog_inputs": r"""WITH p AS (SELECT regexp_replace(url, '/$', '') || CASE page_id % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.csv' ELSE '.bin' END AS path, page_id % 3 AS k FROM pages)
SELECT path, regexp_extract(path, '([^/]*)$', 1) AS name, CASE k WHEN 0 THEN '.pdf' WHEN 1 THEN '.csv' ELSE '.bin' END AS extension, CASE k WHEN 0 THEN 'pdf' WHEN 1 THEN 'table' ELSE 'unknown' END AS kind, CASE WHEN k = 2 THEN 'unsupported file type' END AS warning FROM p""",
    "document_line_text": f"SELECT conv_id AS input_id, string_agg(CASE WHEN turn < 2 THEN {P.strip('role')} || ' ' || {P.strip('text')} ELSE {P.strip('role')} || ' | ' || {P.strip('text')} END, chr(10) ORDER BY turn >= 2, turn) AS text FROM conversations GROUP BY 1",
}
