"""URL expressions.  Parts are cut by the generic URL syntax: scheme, host, path, query; the fragment goes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Path endings that are no pages, and those of documents.
SKIPPED = ["css", "js", "ico", "woff", "woff2", "ttf", "eot", "png", "jpg", "jpeg", "gif", "webp", "svg", "mp4", "webm", "mp3", "zip", "rar", "7z"]
DOCUMENTS = ["pdf", "doc", "docx", "ppt", "pptx", "xls", "xlsx", "csv", "txt", "md"]

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def part(url: Column, k: int) -> Column:
    """1 scheme, 2 host, 3 path, 4 query; empty where there is none."""
    return F.regexp_extract(url, _PARTS, k)


def normalize_url(url: Column) -> Column:
    """Trimmed, without fragment, ``/`` for an empty path, without one slash at the path's end; host case and query stay."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme, host, path, query = (part(u, k) for k in (1, 2, 3, 4))
    path = F.when(path == "", "/").when(path.endswith("/") & (path != "/"), F.regexp_replace(path, "/$", "")).otherwise(path)
    return F.concat(F.when(scheme != "", F.concat(F.lower(scheme), F.lit(":"))).otherwise(""), F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def canonical_host(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def same_site(url: Column, host: Column) -> Column:
    return canonical_host(part(url, 2)) == canonical_host(host)


def is_crawlable(url: Column, host: Column) -> Column:
    """A web page of the site: neither an asset nor a site map."""
    asset = F.lower(part(url, 3)).rlike(rf"\.({'|'.join(SKIPPED)}|xml)$")
    return F.lower(part(url, 1)).isin("http", "https") & same_site(url, host) & ~asset


def is_document(url: Column) -> Column:
    return F.lower(part(url, 3)).rlike(rf"\.({'|'.join(DOCUMENTS)})$")
