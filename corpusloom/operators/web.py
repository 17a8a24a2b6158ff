"""Jobs over a table of fetched pages (``url, html``): text, links, site maps, reachability and reports."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.functions.lineage import cut_lineage
from corpusloom.functions.urls import canonical_host, is_crawlable, is_document, normalize_url, part

#: Elements without text of their own, paths that sites often have, and words that start links inside of scripts.
DROPPED = {"script", "style", "noscript", "svg", "canvas", "form"}
COMMON_PATHS = [
    "/", "/about", "/about-us", "/contact", "/team", "/people", "/faculty", "/departments", "/department", "/programs", "/programmes", "/admissions", "/admission", "/events", "/news",
    "/blog", "/products", "/services", "/docs", "/documentation", "/support", "/faq",
]
ROOT_WORDS = "about|contact|team|people|faculty|department|departments|programs|programmes|admission|admissions|events|news|blog|products|services|docs|documentation|support|faq|research|library|iqac|placement"
MAX_PAGES, MAX_DEPTH = 50, 3


class _Page(HTMLParser):
    """Title, description and text nodes of a page; skipped elements are counted, so nested ones end where they should."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.description, self.texts, self.skip, self.in_title = None, "", [], 0, False

    def handle_starttag(self, tag, attrs):
        found = dict(attrs)
        if tag in DROPPED:
            self.skip += 1
        if tag == "title" and self.title is None:
            self.in_title, self.title = True, ""
        if tag == "meta" and found.get("name") == "description" and not self.description:
            self.description = (found.get("content") or "").strip()

    def handle_endtag(self, tag):
        if tag in DROPPED and self.skip:
            self.skip -= 1
        if tag == "title":
            self.in_title = False

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        if not self.skip:
            self.texts.append(data)


def page_text(pages: DataFrame) -> DataFrame:
    """``url, title, description, text``: visible text, a line for each text node, blank ones out; pages without text are dropped."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for url, html in zip(f["url"], f["html"]):
                page = _Page()
                page.feed(html or "")
                page.close()
                rows = [" ".join(x.split()) for x in "\n".join(page.texts).splitlines()]
                text = "\n".join(filter(None, rows))
                if text:
                    out.append((url, (page.title or "").strip() or url, page.description, text))
            yield pd.DataFrame(out, columns=["url", "title", "description", "text"])

    return pages.select("url", "html").mapInPandas(run, "url string, title string, description string, text string")


def resolve(base, href):
    """An address relative to a page, with ``.`` and ``..`` steps taken."""
    scheme, host, path = part(base, 1), part(base, 2), part(base, 3)
    origin = F.concat(scheme, F.lit("://"), host)
    folder = F.regexp_replace(F.when(path == "", "/").otherwise(path), "[^/]*$", "")
    own_path, query = part(href, 3), F.regexp_extract(href, r"(\?[^#]*)", 1)
    joined = F.when(own_path == "", path).when(own_path.startswith("/"), own_path).otherwise(F.concat(folder, own_path))
    steps = F.split(joined, "/")
    kept = F.aggregate(
        steps, F.array().cast("array<string>"),
        lambda done, s: F.when(s == ".", done).when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(s))),
    )
    path = F.when(joined.rlike(r"(^|/)\.\.?(/|$)"), F.array_join(kept, "/")).otherwise(joined)
    return F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, F.lit(":"), href)).otherwise(F.concat(origin, path, query))


class _Links(HTMLParser):
    """Addresses that a page's elements name, entities resolved."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        self.found += [v for k, v in attrs if v and (k == "data-href" or (k == "href" and tag in ("a", "area", "link")))]


def page_links(pages: DataFrame) -> DataFrame:
    """``src, dst, kind``: documents of any site and pages of the same site that a page's elements and scripts name; each once."""

    @F.arrow_udf("array<string>")
    def named(html: pa.Array) -> pa.Array:
        out = []
        for text in html.to_pylist():
            page = _Links()
            page.feed(text or "")
            page.close()
            out.append(page.found)
        return pa.array(out, pa.list_(pa.string()))

    html = F.coalesce("html", F.lit(""))
    code = F.regexp_extract_all(html, F.lit(r"""(?:href|url|to)\s*[:=]\s*["']([^"']+)["']"""), F.lit(1))
    # what scripts name; the elements' own attributes are read above, with their entities
    code = F.filter(code, lambda x: ~F.contains(x, F.lit("&")))
    roots = F.regexp_extract_all(html, F.lit(rf"""(?i)["'](/(?:{ROOT_WORDS})[^"'\s<&]*)["']"""), F.lit(1))
    each = pages.select(F.col("url").alias("src"), F.explode(F.array_distinct(F.concat(named(F.col("html")), code, roots))).alias("href"))
    each = each.withColumn("dst", normalize_url(resolve(F.col("src"), F.trim("href"))))
    kind = F.when(is_document(F.col("dst")), "document").when(is_crawlable(F.col("dst"), part(F.col("src"), 2)), "page")
    return each.withColumn("kind", kind).where("kind IS NOT NULL").select("src", "dst", "kind").distinct()


def discovery_candidates(sites: DataFrame) -> DataFrame:
    """``site, url``: common paths on the site's host and on its twin with or without ``www.``."""
    scheme, host = part(F.col("site"), 1), part(F.col("site"), 2)
    twin = F.when(host.startswith("www."), F.regexp_replace(host, r"^www\.", "")).otherwise(F.concat(F.lit("www."), host))
    hosts = sites.select("site", scheme.alias("scheme"), F.explode(F.array(host, twin)).alias("host"))
    paths = F.explode(F.array(*map(F.lit, COMMON_PATHS)))
    return hosts.select("site", "scheme", "host", paths.alias("path")).select("site", normalize_url(F.concat("scheme", F.lit("://"), "host", "path")).alias("url")).distinct()


def expand_sitemaps(roots: DataFrame, docs: DataFrame, max_pages: int) -> DataFrame:
    """``site, url``: pages that site maps name, from ``roots`` (``site``) over stored ``docs`` (``url, body``); per site the first ``max_pages`` by name
    (not by the order in which they were found, which tasks do not keep).

    Each round joins the frontier of site maps with the stored bodies; nested ``.xml`` entries that are new make the next frontier, until there is none.
    """
    scheme, host = part(F.col("site"), 1), part(F.col("site"), 2)
    origin = F.concat(scheme, F.lit("://"), host)
    robots = roots.withColumn("url", F.concat(origin, F.lit("/robots.txt"))).join(docs, "url").select("site", F.explode(F.regexp_extract_all("body", F.lit(r"(?im)^sitemap:\s*(\S+)"), F.lit(1))).alias("url"))
    default = roots.select("site", F.explode(F.array(F.concat(origin, F.lit("/sitemap.xml")), F.concat(origin, F.lit("/sitemap_index.xml")))).alias("url"))
    frontier = default.unionByName(robots).select("site", normalize_url(F.col("url")).alias("url")).distinct()
    seen, found = frontier, None
    while True:
        loc = F.explode(F.regexp_extract_all("body", F.lit(r"(?i)<loc>\s*([^<]*?)\s*</loc>"), F.lit(1)))
        named = frontier.join(docs, "url").select("site", loc.alias("u")).select("site", normalize_url(F.col("u")).alias("url")).distinct()
        pages = named.where(is_crawlable(F.col("url"), host) & ~is_document(F.col("url")))
        found = pages if found is None else found.unionByName(pages)
        frontier = cut_lineage(named.where(F.lower(part(F.col("url"), 3)).endswith(".xml")).join(seen, ["site", "url"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    rank = F.row_number().over(W.partitionBy("site").orderBy("url"))
    return found.distinct().withColumn("r", rank).where(F.col("r") <= max_pages).drop("r")


def crawl(seeds: DataFrame, pages: DataFrame, links: DataFrame, sitemap: DataFrame | None = None, max_pages: int = 8, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``site, url, depth, rank``: breadth-first visits from each seed ``site`` over stored pages.

    Site map pages and common paths join at depth 1, before the seed's own links; the first visit counts; pages that are not
    stored are not counted and lead nowhere; the cap cuts in this order.
    """
    max_pages = max(1, min(max_pages, MAX_PAGES))
    stored = cut_lineage(pages.select(normalize_url(F.col("url")).alias("url")).distinct())
    links = cut_lineage(links.where("kind = 'page'").select(normalize_url(F.col("src")).alias("url"), "dst").join(stored.withColumnRenamed("url", "dst"), "dst", "left_semi"))
    start = seeds.select("site", normalize_url(F.col("site")).alias("url"), F.lit(0).alias("depth"), F.lit(0).alias("g"), F.lit(0).alias("parent"))
    extra = [discovery_candidates(seeds).withColumn("g", F.lit(1))] + ([sitemap.withColumn("g", F.lit(0))] if sitemap is not None else [])
    waiting = extra[0] if len(extra) == 1 else extra[0].unionByName(extra[1])
    waiting = waiting.select("site", "url", F.lit(1).alias("depth"), "g", F.lit(0).alias("parent"))
    visited, level = None, start
    for depth in range(max_depth + 1):
        if depth == 1:
            level = level.unionByName(waiting)
        fresh = level.where(is_crawlable(F.col("url"), part(F.col("site"), 2)) & ~is_document(F.col("url"))).join(stored, "url", "left_semi")
        if visited is not None:
            fresh = fresh.join(visited.select("site", "url"), ["site", "url"], "left_anti")
        first = fresh.groupBy("site", "url").agg(F.min(F.struct("g", "parent", "url")).alias("o")).withColumn("depth", F.lit(depth))
        ranked = first.withColumn("k", F.row_number().over(W.partitionBy("site").orderBy("o"))).select("site", "url", "depth", "k")
        # ranks beyond the cap stay out of the result, and so does what only they lead to
        ranked = cut_lineage(ranked.where(F.col("k") <= max_pages))
        visited = ranked if visited is None else visited.unionByName(ranked)
        level = ranked.join(links, "url").select("site", F.col("dst").alias("url"), F.lit(depth + 1).alias("depth"), F.lit(2).alias("g"), F.col("k").alias("parent"))
    rank = F.row_number().over(W.partitionBy("site").orderBy("depth", "k"))
    return visited.withColumn("rank", rank).where(F.col("rank") <= max_pages).select("site", "url", "depth", "rank")


def crawled_pages(crawled: DataFrame, texts: DataFrame, links: DataFrame) -> DataFrame:
    """``site, rank, url, title, description, text_chars, document_links`` of each visited page."""
    documents = links.where("kind = 'document'").groupBy(F.col("src").alias("url")).agg(F.count("*").alias("document_links"))
    own = texts.select("url", "title", "description", F.length("text").cast("long").alias("text_chars"))
    df = crawled.join(own, "url", "left").join(documents, "url", "left")
    return df.select("site", "rank", "url", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce("text_chars", F.lit(0)).alias("text_chars"), F.coalesce("document_links", F.lit(0)).alias("document_links"))


def crawl_report(crawled: DataFrame, texts: DataFrame, links: DataFrame, requested: int) -> DataFrame:
    """Per site: pages, requested pages, status, recursion, characters and document links."""
    documents = links.where("kind = 'document'").groupBy(F.col("src").alias("url")).agg(F.count("*").alias("document_links"))
    sizes = texts.select("url", F.length("text").cast("long").alias("text_chars"))
    df = crawled.join(sizes, "url", "left").join(documents, "url", "left")
    out = df.groupBy("site").agg(F.count("*").alias("pages"), F.coalesce(F.sum("text_chars"), F.lit(0)).alias("text_chars"), F.coalesce(F.sum("document_links"), F.lit(0)).alias("document_links"))
    return out.withColumns({"requested_pages": F.lit(requested), "status": F.when(F.col("pages") >= requested, "complete").otherwise("partial"), "recursive": F.lit(requested > 1)})
