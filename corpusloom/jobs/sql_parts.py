"""SQL fragments (DuckDB) that several oracle statements share."""

from corpusloom.functions.text import STOPWORDS

STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
SPLIT_LINES = r"'\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}]'"


def lines(col: str) -> str:
    parts = f"string_split_regex({col}, {SPLIT_LINES})"
    return f"(CASE WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END)"


def strip(col: str) -> str:
    return rf"regexp_replace({col}, '^\s+|\s+$', '', 'g')"


def squeeze(col: str) -> str:
    return rf"trim(regexp_replace({col}, '\s+', ' ', 'g'))"


def keyword_tokens(col: str) -> str:
    found = f"list_transform(regexp_extract_all({col}, '[A-Za-z0-9_.''-]+'), lambda t: regexp_replace(lower(t), '^[.''-]+|[.''-]+$', '', 'g'))"
    return f"list_filter({found}, lambda t: length(t) > 1 AND t NOT IN ({STOP}))"


def semantic_tokens(col: str) -> str:
    return f"list_transform(regexp_extract_all({col}, '[A-Za-z0-9_]+'), lambda t: lower(t))"


def sentences(col: str) -> str:
    """Split after ``.!?`` and white space or at newlines; a mark is put in first, as there is no look-behind."""
    return rf"string_split_regex(regexp_replace({col}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1) || '|\n+')"


def clean_evidence(col: str) -> str:
    kept = rf"list_filter(list_transform({lines(col)}, lambda x: {strip('x')}), lambda x: x <> '' AND NOT starts_with(x, '=== URL:') AND NOT regexp_matches(lower(x), '^(title:|description:|document links:)'))"
    return squeeze(f"array_to_string({kept}, ' ')")


def word_safe(col: str) -> str:
    """Letters outside ASCII as ``_``, so that word boundaries fall as they do with Unicode letters."""
    return rf"regexp_replace({col}, '[^\x00-\x7F]', '_', 'g')"


def _end(s: str) -> str:
    win = f"substr(b, {s} + 1, 1400)"
    line = f"CASE WHEN instr(reverse({win}), chr(10)) > 0 THEN length({win}) - instr(reverse({win}), chr(10)) ELSE -1 END"
    stop = f"CASE WHEN instr(reverse({win}), ' .') > 0 THEN length({win}) - instr(reverse({win}), ' .') - 1 ELSE -1 END"
    return f"CASE WHEN {s} + 1400 < length(b) AND greatest({line}, {stop}) > 770 THEN {s} + greatest({line}, {stop}) + 1 ELSE least({s} + 1400, length(b)) END"


def chunks_of(source: str, keys: str, text: str = "text") -> str:
    """CTEs ``body, steps, chunks(keys, chunk_ord, text)`` of a relation, for ``WITH RECURSIVE``."""
    return rf"""body AS (SELECT {keys}, array_to_string(list_filter(list_transform({lines(f"coalesce({text}, '')")}, lambda x: {strip('x')}), lambda x: x <> ''), chr(10)) AS b FROM {source}),
steps({keys}, chunk_ord, b, s, e) AS (
  SELECT {keys}, 0, b, 0, {_end('0')} FROM body WHERE b <> ''
  UNION ALL SELECT {keys}, chunk_ord + 1, b, n, {_end('n')} FROM (SELECT *, greatest(0, e - 160) AS n FROM steps WHERE e < length(b))),
chunks AS (SELECT {keys}, chunk_ord, {strip('substr(b, s + 1, e - s)')} AS text FROM steps)"""


#: Whole documents, a data set for each source.
DOC_CHUNKS = chunks_of("(SELECT source AS dataset_id, doc_id AS input_id, 0 AS seg_ord, text FROM documents) d0", "dataset_id, input_id, seg_ord")
QUESTIONS = "questions AS (SELECT 'src' || (item_id % 20) AS dataset_id, item_id AS question_id, text AS question FROM benchmark)"
