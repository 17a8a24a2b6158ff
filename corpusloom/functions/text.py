"""Text expressions: lines, tokens, sentences, evidence.  All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a keyword search leaves out.
STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "by", "for", "from", "in", "is", "it", "of", "on", "or", "the", "to", "what", "where", "when", "who", "which",
    "with", "about", "all", "show", "list",
]
#: Where lines end, beyond the plain newline.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def strip(col: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def lines(col: Column) -> Column:
    """The lines of a text; a line end at the very end makes no further line."""
    parts = F.split(col, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def squeeze(col: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def keyword_tokens(col: Column) -> Column:
    """Lower-case runs of letters, digits and ``_.'-``, without ``.'-`` at the ends; one-letter words and stopwords go."""
    found = F.transform(F.regexp_extract_all(col, F.lit(r"[A-Za-z0-9_.'-]+"), F.lit(0)), lambda t: F.regexp_replace(F.lower(t), r"^[.'-]+|[.'-]+$", ""))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(STOPWORDS))


def semantic_tokens(col: Column) -> Column:
    """Lower-case runs of letters, digits and ``_``; nothing is left out."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(col, r"[^\x00-\x7F]", " ")), F.lit(r"[a-z0-9_]+"), F.lit(0))


def split_sentences(col: Column) -> Column:
    """Parts after ``.!?`` and white space, or at newlines."""
    return F.split(col, r"(?<=[.!?])\s+|\n+")


def clean_evidence(col: Column) -> Column:
    """Lines that say something, as one line: blank ones, page marks and head fields go."""
    kept = F.filter(F.transform(lines(col), strip), lambda x: (x != "") & ~x.startswith("=== URL:") & ~F.lower(x).rlike("^(title:|description:|document links:)"))
    return squeeze(F.array_join(kept, " "))


def estimate_tokens(chars: Column) -> Column:
    """Four characters to a token, rounded up."""
    return F.floor((chars + 3) / 4)


def contains_any(col: Column, words: list[str]) -> Column:
    """Whether any of the words stands anywhere in the text, inside of other words too."""
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(col, w))
