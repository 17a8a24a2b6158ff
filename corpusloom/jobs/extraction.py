"""Registered queries on segments, tables in text, facts and the name graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.text import strip
from corpusloom.jobs import sql_parts as P
from corpusloom.jobs.retrieval import corpus
from corpusloom.jobs.stored import Corpus
from corpusloom.operators import chunks as C
from corpusloom.operators import facts as FA
from corpusloom.operators import graph as G
from corpusloom.operators import retrieve as R
from corpusloom.operators import segments as S
from corpusloom.operators import tables as X


#: Ids of offices lie above those of documents.
OFFICE_IDS = 1_000_000_000_000


def whole(spark, sf_dir):
    """Every document as one segment."""
    return corpus(spark, sf_dir).withColumn("seg_ord", F.lit(0)).withColumn("source_name", F.col("title"))


def _letters(number):
    return F.translate(number.cast("string"), "0123456789", "abcdefghij")


def offices(spark, sf_dir):
    """Every customer as a directory text: two records of ``key: value`` lines, a role line, a role in a sentence, and a date."""
    of = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key = F.col("c_custkey")
    one, two = F.concat(F.initcap("c_mktsegment"), F.lit(" K"), _letters(key)), F.concat(F.lit("Ola N"), _letters(F.col("c_nationkey")))
    section, hall = F.concat(F.lit("Section "), key % 7), F.concat(F.lit("Hall "), key % 9)

    def record(name, role, mail):
        return [F.concat(F.lit(k), v) for k, v in (("Name: ", name), ("Role: ", F.lit(role)), ("Department: ", section), (f"Email: {mail}", F.concat(key, F.lit("@example.org"))), ("Venue: ", hall))]

    rest = [F.lit("These are the people of the office."), F.concat(F.lit("Director: "), one), F.concat(F.lit("The secretary is "), two, F.lit(".")), F.lit("12 March 2019 was the first day.")]
    text = F.concat_ws("\n", *record(one, "HOD", "c"), F.lit(""), *record(two, "Chairperson", "d"), F.lit(""), *rest)
    return of.select(F.concat(F.lit("src"), key % 20).alias("dataset_id"), (key + OFFICE_IDS).alias("input_id"), F.concat(F.lit("office "), key).alias("title"), text.alias("text"))


def mixed(spark, sf_dir):
    """Documents and offices, each as one segment."""
    return whole(spark, sf_dir).unionByName(offices(spark, sf_dir).withColumn("seg_ord", F.lit(0)).withColumn("source_name", F.col("title")))


def decisions(spark, sf_dir):
    """Outside decisions made from the labels: good texts by keyword, others as tables; toxic ones are called unreliable."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"), "doc_id")
    good = F.col("quality") == 1
    return labels.select(
        F.col("source").alias("dataset_id"), F.col("doc_id").alias("input_id"), F.lit(0).alias("seg_ord"), F.when(good, " Keyword ").otherwise("sql").alias("primary"),
        F.array(F.lit("semantic"), F.lit("graph"), F.lit("none"), F.lit("graph")).alias("decided_secondary"), (F.col("doc_id") % 3 / 2).alias("decided_confidence"),
        F.when(good, "a plain text").alias("decided_reason"), F.array(F.lit("label"), F.lit(" ")).alias("decided_signals"), (F.col("toxic") == 0).alias("reliable"),
    )


def _table_scores(spark, sf_dir):
    df = S.table_scores(whole(spark, sf_dir))
    return df.select("input_id", *[F.round(c, 6).alias(c) for c in ("pipe_score", "csv_score", "kv_score")])


def _entity_score(spark, sf_dir):
    return S.entity_score(whole(spark, sf_dir)).select("input_id", "entity_count", F.round("entity_score", 6).alias("entity_score"))


def _classified(spark, sf_dir):
    return S.classify_segments(whole(spark, sf_dir)).select("input_id", "segment_type", "method", "confidence", "reason")


def _annotated(spark, sf_dir):
    df = S.annotate_segments(S.classify_segments(whole(spark, sf_dir)))
    return df.select("input_id", F.array_join("secondary", ",").alias("secondary"), F.array_join("signals", ",").alias("signals"), "decision_reason", "classifier")


def _decided(spark, sf_dir):
    df = S.apply_decisions(S.annotate_segments(S.classify_segments(whole(spark, sf_dir))), decisions(spark, sf_dir))
    return df.select("input_id", "method", "confidence", "reason", "classifier", "heuristic", F.array_join("secondary", ",").alias("secondary"), F.array_join("signals", ",").alias("signals"))


def segmented(spark, sf_dir):
    return S.segment_text(corpus(spark, sf_dir))


def _segment_rows(spark, sf_dir):
    df = segmented(spark, sf_dir)
    return df.select("dataset_id", "input_id", "seg_ord", "title", "segment_type", "method", "confidence", "reason", F.array_join("secondary", ",").alias("secondary"), F.array_join("signals", ",").alias("signals"), "preview")


def _sections(spark, sf_dir):
    return S.split_sections(corpus(spark, sf_dir)).select("input_id", "seg_ord", "title", "text")


def _site(spark, sf_dir):
    df = S.site_segments(C.chunks_from_documents(corpus(spark, sf_dir)))
    return df.select("input_id", "seg_ord", "title", "method", "confidence")


def _found_sections(spark, sf_dir):
    from corpusloom.jobs.retrieval import questions

    return R.section_search(questions(spark, sf_dir), Corpus(spark, sf_dir).section_index(), 8)


def _pipe(spark, sf_dir):
    return X.pipe_tables(whole(spark, sf_dir)).drop("dataset_id", "seg_ord")


def _csv(spark, sf_dir):
    return X.csv_tables(whole(spark, sf_dir)).drop("dataset_id", "seg_ord")


def _catalog(spark, sf_dir):
    catalog, _, _ = X.extract_tables(S.classify_segments(mixed(spark, sf_dir)))
    return catalog.select("dataset_id", "input_id", "seg_ord", "table_name", F.array_join("columns", ",").alias("columns"), "row_count")


def _records(spark, sf_dir):
    return X.key_value_records(mixed(spark, sf_dir))


def _header(spark, sf_dir):
    """Column names made of the first line of each text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.array_join(X.dedupe_columns(F.split(F.split("text", "\n")[0], " ")), " ").alias("columns"))


def _segment_chunks(spark, sf_dir):
    return C.chunks_from_segments(S.classify_segments(whole(spark, sf_dir))).select("input_id", "chunk_ord", "segment_type", "method", "text")


def _facts(rule):
    def run(spark, sf_dir):
        return rule(mixed(spark, sf_dir)).select("input_id", "n", "fact_type", "subject", "predicate", "object", "qualifier", "confidence", "fact_text")

    return run


def _all_facts(spark, sf_dir):
    return FA.extract_facts(mixed(spark, sf_dir))


def _names(spark, sf_dir):
    """Which lines of texts look like a name."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return docs.select("doc_id", "n", FA.looks_like_name(F.col("line")).alias("is_name"))


def _around(spark, sf_dir):
    """The sentence in the middle of each text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", FA.sentence_around(F.col("text"), F.floor(F.length("text") / 2).cast("int")).alias("sentence"))


def _roles(spark, sf_dir):
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    word = F.explode(F.split(strip(F.col("text")), r"\s+"))
    return talk.select(word.alias("word")).distinct().select("word", FA.normalize_role(F.col("word")).alias("role"))


def _vocabulary(spark, sf_dir):
    own = mixed(spark, sf_dir)
    words = FA.dataset_vocabulary(own, FA.extract_facts(own))
    return words.select("dataset_id", "term", F.col("ord.g").alias("g"), F.col("ord.input_id").alias("first_input"))


def _entities(spark, sf_dir):
    return G.chunk_entities(C.chunks_from_documents(corpus(spark, sf_dir)))


def _chunk_entities(spark, sf_dir):
    return _entities(spark, sf_dir).select("input_id", "chunk_ord", F.size("entities").cast("long").alias("n"), F.array_join("entities", "|").alias("entities"))


def nodes_and_edges(spark, sf_dir):
    found = _entities(spark, sf_dir)
    nodes = G.entity_nodes(found)
    return nodes, G.cooccurrence_edges(found, nodes)


QUERIES = {
    "split_sections": _sections,
    "table_scores": _table_scores,
    "entity_score": _entity_score,
    "classify_segments": _classified,
    "annotate_segments": _annotated,
    "apply_decisions": _decided,
    "classification_counts": lambda s, d: S.classification_counts(S.classify_segments(whole(s, d))),
    "segment_text": _segment_rows,
    "site_segments": _site,
    "section_search": _found_sections,
    "chunks_from_segments": _segment_chunks,
    "pipe_tables": _pipe,
    "csv_tables": _csv,
    "key_value_records": _records,
    "dedupe_columns": _header,
    "extract_tables": _catalog,
    "kv_facts": _facts(FA.kv_facts),
    "role_line_facts": _facts(FA.role_line_facts),
    "role_sentence_facts": _facts(FA.role_sentence_facts),
    "contact_facts": _facts(FA.contact_facts),
    "date_facts": _facts(FA.date_facts),
    "looks_like_name": _names,
    "sentence_around": _around,
    "normalize_role": _roles,
    "extract_facts": _all_facts,
    "dataset_vocabulary": _vocabulary,
    "chunk_entities": _chunk_entities,
    "entity_nodes": lambda s, d: nodes_and_edges(s, d)[0],
    "cooccurrence_edges": lambda s, d: nodes_and_edges(s, d)[1],
    "entity_type_counts": lambda s, d: G.entity_type_counts(nodes_and_edges(s, d)[0]),
    "graph_hint": lambda s, d: G.graph_hint(nodes_and_edges(s, d)[0], s.read.parquet(f"{d}/conversations.parquet").select(F.concat(F.lit("src"), F.col("conv_id") % 23).alias("dataset_id"))),
    "graph_view": lambda s, d: G.graph_view(*nodes_and_edges(s, d)),
}

# --- SQL -----------------------------------------------------------------------------------------


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def any_of(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


SEG = "seg AS (SELECT source AS dataset_id, doc_id AS input_id, 0 AS seg_ord, 'document ' || doc_id AS title, text FROM documents)"
_LETTERS = "translate({}::VARCHAR, '0123456789', 'abcdefghij')"
_MAIL = "{}' || id || '@example.org"
#: What the offices' texts say, straight from the table: names, section, hall, and the records as lines.
OFFICES = f"""off0 AS (SELECT 'src' || (c_custkey % 20) AS dataset_id, c_custkey + {OFFICE_IDS} AS input_id, 0 AS seg_ord, 'office ' || c_custkey AS title, c_custkey AS id, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' K' || {_LETTERS.format('c_custkey')} AS one,
  'Ola N' || {_LETTERS.format('c_nationkey')} AS two, 'Section ' || (c_custkey % 7) AS section, 'Hall ' || (c_custkey % 9) AS hall FROM customer),
off AS (SELECT *, 'name: ' || one || chr(10) || 'role: HOD' || chr(10) || 'department: ' || section || chr(10) || 'email: {_MAIL.format("c")}' || chr(10) || 'venue: ' || hall AS r1,
  'name: ' || two || chr(10) || 'role: Chairperson' || chr(10) || 'department: ' || section || chr(10) || 'email: {_MAIL.format("d")}' || chr(10) || 'venue: ' || hall AS r2 FROM off0),
seg AS (SELECT source AS dataset_id, doc_id AS input_id, 0 AS seg_ord, 'document ' || doc_id AS title, text FROM documents UNION ALL
  SELECT dataset_id, input_id, seg_ord, title, array_to_string(['Name: ' || one, 'Role: HOD', 'Department: ' || section, 'Email: {_MAIL.format("c")}', 'Venue: ' || hall, '', 'Name: ' || two, 'Role: Chairperson', 'Department: ' || section, 'Email: {_MAIL.format("d")}', 'Venue: ' || hall, '',
    'These are the people of the office.', 'Director: ' || one, 'The secretary is ' || two || '.', '12 March 2019 was the first day.'], chr(10)) FROM off)"""
_FILLED = f"list_filter({P.lines('text')}, lambda x: {P.strip('x')} <> '')"


def _marks(mark: str) -> str:
    return f"list_filter(list_transform({_FILLED}, lambda x: length(x) - length(replace(x, '{mark}', ''))), lambda c: c >= 2)"


def _share(ws: str) -> str:
    return f"(list_max(list_transform({ws}, lambda w: len(list_filter({ws}, lambda x: x = w)))) / len({ws}))"


_KV = S.KEY_VALUE.replace("'", "''")
_SCORES = f"""base AS (SELECT *, {_marks('|')} AS pw, {_marks(',')} AS cw, {_FILLED} AS ls FROM seg),
scores AS (SELECT dataset_id, input_id, seg_ord, title, text,
  CASE WHEN len(pw) >= 2 THEN least(0.95::DOUBLE, 0.45::DOUBLE + {_share('pw[:8]')} * 0.45::DOUBLE + least(len(pw), 10) * 0.01::DOUBLE) ELSE 0 END AS pipe_score,
  CASE WHEN len(cw) >= 3 THEN least(0.9::DOUBLE, 0.35::DOUBLE + {_share('cw[:10]')} * 0.45::DOUBLE) ELSE 0 END AS csv_score,
  CASE WHEN len(list_filter(ls, lambda x: regexp_matches(x, '{_KV}'))) >= 4 THEN least(0.88::DOUBLE, 0.35::DOUBLE + len(list_filter(ls, lambda x: regexp_matches(x, '{_KV}'))) / greatest(len(ls), 1) * 0.5::DOUBLE) ELSE 0 END AS kv_score FROM base)"""
_ENT = f"list_distinct(list_filter(list_transform(regexp_extract_all({P.word_safe('text')}, '{S.ENTITY.replace(chr(39), chr(39) * 2)}'), lambda e: {P.strip('e')}), lambda e: length(e) > 4))"
_NWORDS = f"CASE WHEN {P.squeeze('text')} = '' THEN 0 ELSE len(string_split({P.squeeze('text')}, ' ')) END"
_CLASSES = f"""ents AS (SELECT *, len({_ENT}) AS entity_count, {_NWORDS} AS nw FROM scores),
escores AS (SELECT *, least(0.92::DOUBLE, entity_count / greatest(1.0::DOUBLE, nw / 120) / 8) AS entity_score, greatest(pipe_score, csv_score, kv_score) AS tscore FROM ents),
cls0 AS (SELECT *, CASE WHEN tscore >= 0.72 THEN 1 WHEN entity_score >= 0.45 AND entity_count >= 8 THEN 2 WHEN length(text) > 1800 THEN 3 WHEN {any_of('lower(text)', S.KEYWORD_MARKERS)} THEN 4 ELSE 5 END AS c FROM escores),
cls AS (SELECT *, ['sql_candidate','graph_candidate','hierarchical_parent','keyword_candidate','semantic'][c] AS segment_type, ['sql','graph','hierarchical','keyword','semantic'][c] AS method,
  round(CASE c WHEN 1 THEN tscore WHEN 2 THEN entity_score WHEN 3 THEN 0.76 WHEN 4 THEN 0.7 ELSE 0.74 END::DOUBLE, 2) AS confidence,
  ['Reliable repeated table-like structure was detected.', 'Entity-heavy section detected with about ' || entity_count || ' named entities.', 'Long section benefits from parent-child section context.', 'Exact names, acronyms, or institutional terms benefit from keyword retrieval.', 'Narrative or descriptive text is best suited to semantic retrieval.'][c] AS reason FROM cls0)"""
_EVERY = f"lower(title || ' ' || substr({P.squeeze('text')}, 1, 360) || ' ' || text)"
_ANN = f"""ann AS (SELECT *, list_filter([CASE WHEN method <> 'keyword' AND {any_of(_EVERY, S.EXACT_WORDS)} THEN 'keyword' END, CASE WHEN method <> 'graph' AND {any_of(_EVERY, S.LINK_WORDS)} THEN 'graph' END,
  CASE WHEN method <> 'hierarchical' AND length(text) > 1600 THEN 'hierarchical' END, CASE WHEN method <> 'semantic' AND {any_of(_EVERY, S.PROSE_WORDS)} THEN 'semantic' END], lambda x: x IS NOT NULL)[:3] AS secondary,
  list_filter([segment_type, CASE WHEN regexp_matches(text, '[|,]') THEN 'structured delimiters' END, CASE WHEN {any_of('lower(text)', ['email', 'phone', 'sku', 'id', 'code'])} THEN 'exact identifiers' END,
  CASE WHEN {any_of('lower(text)', ['depends', 'connected', 'owns', 'partner', 'vendor'])} THEN 'relationship language' END, CASE WHEN length(text) > 1600 THEN 'long section' END], lambda x: x IS NOT NULL) AS signals FROM cls)"""
CLASSIFIED = f"{SEG}, {_SCORES}, {_CLASSES}"
_DECIDED = f"""dec AS (SELECT doc_id AS input_id, source AS dataset_id, quality = 1 AS good, (doc_id % 3) / 2 AS conf, toxic = 0 AS reliable FROM labels JOIN documents USING (doc_id)),
dj AS (SELECT ann.*, good, conf, reliable, good IS NOT NULL AS has, CASE WHEN good THEN 'keyword' WHEN good IS NOT NULL THEN 'sql' ELSE method END AS valid FROM ann LEFT JOIN dec USING (dataset_id, input_id)),
dk AS (SELECT *, coalesce(valid = 'sql' AND NOT (segment_type = 'sql_candidate' AND confidence >= 0.72 AND coalesce(reliable, false)), false) AS refused FROM dj),
dl AS (SELECT *, CASE WHEN refused THEN method ELSE valid END AS mode FROM dk)"""


def _cells_sql(mark: str, row: str, least: int, keep: str) -> str:
    own = f"list_filter({P.lines('text')}, lambda x: length(x) - length(replace(x, '{mark}', '')) >= 2)"
    base = r"regexp_replace(regexp_replace(lower(" + P.strip("v") + r"), '[^A-Za-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g')"
    return f"""WITH {SEG}, r0 AS (SELECT input_id, list_filter(list_transform({own}, lambda x: {row}), lambda r: {keep}) AS rows FROM seg),
r1 AS (SELECT input_id, rows FROM r0 WHERE len(rows) >= {least}),
w AS (SELECT input_id, len(r) AS width, count(*) AS n FROM (SELECT input_id, unnest(rows) AS r FROM r1) GROUP BY 1, 2),
best AS (SELECT input_id, width FROM (SELECT *, row_number() OVER (PARTITION BY input_id ORDER BY n DESC, width) AS k FROM w) WHERE k = 1),
r2 AS (SELECT input_id, list_filter(rows, lambda r: len(r) = width) AS rows FROM r1 JOIN best USING (input_id)),
r3 AS (SELECT input_id, rows, list_transform(range(1, len(rows[1]) + 1), lambda i: i) AS ix FROM r2 WHERE len(rows) >= {least}),
h0 AS (SELECT input_id, unnest(ix) AS i, unnest(rows[1]) AS v FROM r3),
h1 AS (SELECT input_id, i, CASE WHEN {base} = '' THEN 'column_' || i ELSE {base} END AS b FROM h0),
h AS (SELECT input_id, i, CASE WHEN count(*) OVER w = 1 THEN b ELSE b || '_' || count(*) OVER w END AS col_name FROM h1 WINDOW w AS (PARTITION BY input_id, b ORDER BY i ROWS UNBOUNDED PRECEDING)),
body AS (SELECT input_id, unnest(range(0, len(rows) - 1)) AS row_no, unnest(rows[2:]) AS r FROM r3),
c AS (SELECT input_id, row_no, unnest(range(0, len(r))) AS col_no, unnest(r) AS value FROM body)
SELECT c.input_id, row_no, c.col_no, col_name, value FROM c JOIN h ON h.input_id = c.input_id AND h.i = c.col_no + 1"""


def _cell(x: str) -> str:
    return P.squeeze(rf"regexp_replace({P.strip(x)}, '^\|+|\|+$', '', 'g')")


_EDGE = r"'^[.,:;()\[\]]+|[.,:;()\[\]]+$'"


def _is_name(v: str) -> str:
    bare = P.squeeze(P.strip(v))
    words = f"list_transform(string_split({bare}, ' '), lambda w: regexp_replace(w, {_EDGE}, '', 'g'))"
    safe = P.word_safe(bare)
    return rf"({bare} <> '' AND length({bare}) <= 80 AND len(list_filter({words}, lambda w: lower(w) IN ({quoted(FA.NO_NAMES)}))) = 0 AND (regexp_matches({safe}, '{FA.HONORIFIC}') OR (len({words}) BETWEEN 2 AND 4 AND len(list_filter({words}, lambda w: NOT regexp_matches(w, '^[A-Z][A-Za-z.''-]+$'))) = 0)))"


def _sentence(text: str, pos: str) -> str:
    before, after = f"reverse(substr({text}, 1, {pos}))", f"substr({text}, {pos} + 2)"
    back = [f"CASE WHEN instr({before}, {m}) > 0 THEN {pos} - instr({before}, {m}) ELSE -1 END" for m in ("'.'", "chr(10)")]
    ahead = [f"CASE WHEN instr({after}, {m}) > 0 THEN {pos} + instr({after}, {m}) END" for m in ("'.'", "chr(10)")]
    start, end = f"greatest({', '.join(back)})", f"coalesce(least({', '.join(ahead)}), least(length({text}), {pos} + 500))"
    return P.strip(f"substr({text}, {start} + 2, greatest({end} - {start}, 0))")


def _found_sql(rule: int, pattern: str, kind: str, subject: str, confidence: float, safe: bool) -> str:
    text = P.word_safe("text") if safe else "text"
    return f"""m{rule} AS (SELECT *, regexp_extract_all({text}, '{pattern}') AS ms FROM seg), e{rule} AS (SELECT dataset_id, input_id, seg_ord, title, text, unnest(range(0, len(ms))) AS n, unnest(ms) AS v FROM m{rule}),
f{rule} AS (SELECT dataset_id, input_id, seg_ord, {rule} AS rule, n, '{kind}' AS fact_type, '{subject}' AS subject, 'value' AS predicate, {P.strip('v')} AS object, title AS qualifier, {confidence}::DOUBLE AS confidence, substr({_sentence('text', '(instr(text, v) - 1)')}, 1, 1200) AS fact_text FROM e{rule})"""


_FACT_COLUMNS = "input_id, n, fact_type, subject, predicate, object, qualifier, confidence, fact_text"
_KV_FACTS = """k AS (SELECT *, unnest(range(0, 6)) AS n FROM off), f1 AS (SELECT dataset_id, input_id, seg_ord, 1 AS rule, n, ['role', 'contact', 'event'][n % 3 + 1] AS fact_type, CASE n % 3 WHEN 0 THEN ['head of department', 'chairman'][n // 3 + 1] WHEN 1 THEN 'email' ELSE 'venue' END AS subject,
  CASE n % 3 WHEN 0 THEN 'held_by' ELSE 'value' END AS predicate, CASE n % 3 WHEN 0 THEN [one, two][n // 3 + 1] WHEN 1 THEN ['c', 'd'][n // 3 + 1] || id || '@example.org' ELSE hall END AS object, CASE n % 3 WHEN 0 THEN section ELSE [one, two][n // 3 + 1] END AS qualifier,
  [0.9, 0.86, 0.8][n % 3 + 1]::DOUBLE AS confidence, [r1, r2][n // 3 + 1] AS fact_text FROM k)"""
_ROLE_LINES = rf"""l2 AS (SELECT dataset_id, input_id, seg_ord, title, unnest(range(0, len(ls))) AS n, {P.strip('unnest(ls)')} AS line FROM (SELECT *, {P.lines('text')} AS ls FROM seg)),
m2 AS (SELECT *, regexp_extract(line, '(?i)^(?:current\s+)?({'|'.join(FA.ROLES)})\s*[:\-]\s*(.+)$', 1) AS role, regexp_extract(line, '(?i)^(?:current\s+)?({'|'.join(FA.ROLES)})\s*[:\-]\s*(.+)$', 2) AS v FROM l2 WHERE regexp_matches(line, '(?i)^(?:current\s+)?({'|'.join(FA.ROLES)})\s*[:\-]\s*(.+)$')),
f2 AS (SELECT dataset_id, input_id, seg_ord, 2 AS rule, n, 'role' AS fact_type, CASE lower(role) WHEN 'hod' THEN 'head of department' WHEN 'chairperson' THEN 'chairman' ELSE lower(role) END AS subject, 'held_by' AS predicate, {P.strip('v')} AS object, title AS qualifier, 0.92::DOUBLE AS confidence, substr(line, 1, 1200) AS fact_text FROM m2 WHERE {_is_name('v')})"""
_ROLE_SENTENCES = "f3 AS (SELECT dataset_id, input_id, seg_ord, 3 AS rule, 0 AS n, 'role' AS fact_type, 'secretary' AS subject, 'held_by' AS predicate, two AS object, title AS qualifier, 0.82::DOUBLE AS confidence, 'The secretary is ' || two || '.' AS fact_text FROM off)"
FACTS = f"""{OFFICES}, {_KV_FACTS}, {_ROLE_LINES}, {_ROLE_SENTENCES}, {_found_sql(4, FA.CONTACT, 'contact', 'contact', 0.72, False)}, {_found_sql(5, FA.DATE, 'event', 'date', 0.68, True)},
allf AS ({' UNION ALL '.join(f'SELECT * FROM f{i}' for i in range(1, 6))}),
facts AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, fact_type, lower(subject), lower(predicate), lower(object), lower(qualifier) ORDER BY input_id, seg_ord, rule, n) AS k FROM allf) WHERE k = 1)"""
_ORD = "{{'g': {g}::INTEGER, 'input_id': input_id, 'seg_ord': seg_ord, 'rule': {rule}, 'n': {n}, 'k': k}}"
VOCABULARY = f"""vall AS (SELECT dataset_id, {P.strip('t')} AS term, {_ORD.format(g=0, rule=0, n=0)} AS ord FROM (SELECT dataset_id, input_id, seg_ord, title AS t, 0 AS k FROM seg)
UNION ALL SELECT dataset_id, {P.strip('t')}, {_ORD.format(g=1, rule='rule', n='n')} FROM (SELECT *, unnest([subject, object, qualifier]) AS t, unnest([0, 1, 2]) AS k FROM facts)),
vocab AS (SELECT dataset_id, term, min(ord) AS ord FROM vall WHERE length(term) > 2 GROUP BY 1, 2)"""


_ENTS = f"gents AS (SELECT *, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all({P.word_safe('text')}, '{G.ENTITY}'), lambda e: {P.strip('e')}), lambda e: length(e) > 2))) AS es FROM chunks)"
_TYPE = "CASE " + " ".join(f"WHEN {any_of('lower(entity)', w)}" + (f" OR len(string_split({P.squeeze('entity')}, ' ')) IN (2, 3)" if t == "Person" else "") + f" THEN '{t}'" for t, w in G.TYPES) + " ELSE 'Entity' END"
_NODES = f"nodes AS (SELECT dataset_id, entity, weight, rank, {_TYPE} AS type FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY weight DESC, entity) AS rank FROM (SELECT dataset_id, entity, count(*) AS weight FROM (SELECT dataset_id, unnest(es) AS entity FROM gents) GROUP BY 1, 2)) WHERE rank <= 30)"
_EDGES = """p0 AS (SELECT dataset_id, es[:10] AS es FROM gents), p1 AS (SELECT dataset_id, es, unnest(range(1, len(es) + 1)) AS i FROM p0), p2 AS (SELECT dataset_id, es[i] AS source, unnest(es[i + 1:]) AS target FROM p1),
edges AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY weight DESC, source, target) AS rank FROM (SELECT dataset_id, source, target, count(*) AS weight FROM p2 GROUP BY ALL)
  WHERE (dataset_id, source) IN (SELECT (dataset_id, entity) FROM nodes) AND (dataset_id, target) IN (SELECT (dataset_id, entity) FROM nodes)) WHERE rank <= 60)"""
GRAPH = f"{P.DOC_CHUNKS}, {_ENTS}, {_NODES}, {_EDGES}"

_PIPE_SQL = _cells_sql("|", rf"list_transform(string_split(regexp_replace({P.strip('x')}, '^\|+|\|+$', '', 'g'), '|'), lambda y: {_cell('y')})", 2, "len(r) >= 2 AND len(list_filter(r, lambda y: NOT regexp_matches(y, '^[-: ]+$'))) > 0")
_CSV_SQL = _cells_sql(",", f"list_transform(string_split(x, ','), lambda y: {_cell('y')})", 3, "true")
_CELL_TABLES = ", ".join(f"{name} AS (SELECT input_id, row_no, col_no, col_name FROM ({sql.replace('WITH ' + SEG, 'WITH ' + OFFICES)}))" for name, sql in (("pipe_t", _PIPE_SQL), ("csv_t", _CSV_SQL)))

SQL = {
    "table_scores": f"WITH {SEG}, {_SCORES} SELECT input_id, round(pipe_score, 6) AS pipe_score, round(csv_score, 6) AS csv_score, round(kv_score, 6) AS kv_score FROM scores",
    "entity_score": f"WITH {CLASSIFIED} SELECT input_id, entity_count, round(entity_score, 6) AS entity_score FROM cls",
    "classify_segments": f"WITH {CLASSIFIED} SELECT input_id, segment_type, method, confidence, reason FROM cls",
    "annotate_segments": f"WITH {CLASSIFIED}, {_ANN} SELECT input_id, array_to_string(secondary, ',') AS secondary, array_to_string(signals, ',') AS signals, reason AS decision_reason, 'heuristic' AS classifier FROM ann",
    "apply_decisions": f"""WITH {CLASSIFIED}, {_ANN}, {_DECIDED} SELECT input_id, mode AS method, CASE WHEN has THEN round(least(0.98, conf), 2) ELSE confidence END AS confidence,
  CASE WHEN has THEN (CASE WHEN refused THEN 'SQL skipped because table structure was unreliable. ' ELSE '' END) || (CASE WHEN good THEN 'a plain text' ELSE 'An outside decision refined this segment''s method from structure and content signals.' END) ELSE reason END AS reason,
  CASE WHEN has THEN 'openai' ELSE 'heuristic' END AS classifier, CASE WHEN has THEN method END AS heuristic,
  CASE WHEN has THEN array_to_string(list_filter(['semantic', 'graph'], lambda x: x <> mode), ',') ELSE array_to_string(secondary, ',') END AS secondary, CASE WHEN has THEN 'label' ELSE array_to_string(signals, ',') END AS signals FROM dl""",
    "classification_counts": f"WITH {CLASSIFIED} SELECT dataset_id, {', '.join(f'count(*) FILTER (method = {chr(39)}{m}{chr(39)}) AS {m}' for m in S.MODES)} FROM cls GROUP BY 1",
    "section_search": f"""WITH {CLASSIFIED}, {P.QUESTIONS}, st AS (SELECT dataset_id, input_id, seg_ord, method, unnest(list_distinct({P.keyword_tokens("title || ' ' || text")})) AS term FROM cls WHERE method <> 'sql'),
qt AS (SELECT DISTINCT dataset_id, question_id, unnest({P.keyword_tokens('question')}) AS term FROM questions),
sc AS (SELECT dataset_id, question_id, input_id, seg_ord, count(*) + CASE WHEN any_value(method) = 'hierarchical' THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM st JOIN qt USING (dataset_id, term) GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, question_id ORDER BY score DESC, input_id, seg_ord) AS rank FROM sc) WHERE rank <= 8""",
    "chunks_from_segments": f"WITH RECURSIVE {CLASSIFIED}, {P.chunks_of('(SELECT * FROM cls WHERE method <> {0}sql{0})'.format(chr(39)), 'input_id, segment_type, method').replace('body AS', 'sbody AS').replace('FROM body', 'FROM sbody')} SELECT input_id, chunk_ord, segment_type, method, text FROM chunks",
    "pipe_tables": _PIPE_SQL,
    "csv_tables": _CSV_SQL,
    "dedupe_columns": rf"""WITH h0 AS (SELECT doc_id, string_split(string_split(text, chr(10))[1], ' ') AS ws FROM documents), h1 AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS v FROM h0),
h2 AS (SELECT doc_id, i, regexp_replace(regexp_replace(lower({P.strip('v')}), '[^A-Za-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g') AS b FROM h1), h3 AS (SELECT doc_id, i, CASE WHEN b = '' THEN 'column_' || i ELSE b END AS b FROM h2),
h4 AS (SELECT doc_id, i, b, count(*) OVER (PARTITION BY doc_id, b ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM h3) SELECT doc_id, string_agg(CASE WHEN k = 1 THEN b ELSE b || '_' || k END, ' ' ORDER BY i) AS columns FROM h4 GROUP BY 1""",
    "key_value_records": f"""WITH {OFFICES}, r AS (SELECT *, unnest([0, 1]) AS row_no FROM off), c AS (SELECT *, unnest(range(0, 5)) AS col_no FROM r)
SELECT dataset_id, input_id, seg_ord, row_no, col_no, ['name', 'role', 'department', 'email', 'venue'][col_no + 1] AS col_name, CASE col_no WHEN 0 THEN [one, two][row_no + 1] WHEN 1 THEN ['HOD', 'Chairperson'][row_no + 1] WHEN 2 THEN section WHEN 3 THEN ['c', 'd'][row_no + 1] || id || '@example.org' ELSE hall END AS value FROM c""",
    "extract_tables": f"""WITH {CLASSIFIED.replace(SEG, OFFICES)}, {_CELL_TABLES}, sure AS (SELECT dataset_id, input_id FROM cls WHERE segment_type = 'sql_candidate' AND confidence >= {S.TABLE_FROM}),
every AS (SELECT 0 AS kind, * FROM pipe_t UNION ALL SELECT 1, * FROM csv_t UNION ALL SELECT 2, input_id, unnest([0, 1]), unnest(range(0, 5)), unnest(['name', 'role', 'department', 'email', 'venue']) FROM off UNION ALL SELECT 2, input_id, 1, i, ['name', 'role', 'department', 'email', 'venue'][i + 1] FROM off, range(0, 5) t(i)),
sizes AS (SELECT kind, input_id, max(row_no) + 1 AS row_count, count(DISTINCT col_no) AS width, array_to_string(list_transform(list_sort(list(DISTINCT [lpad(col_no::VARCHAR, 6, '0'), col_name])), lambda x: x[2]), ',') AS columns FROM every GROUP BY 1, 2)
SELECT dataset_id, input_id, 0 AS seg_ord, concat_ws('_', 'text_table', dataset_id, input_id, 0) AS table_name, columns, row_count FROM (SELECT *, row_number() OVER (PARTITION BY input_id ORDER BY kind) AS k FROM sizes JOIN sure USING (input_id) WHERE width >= 2) WHERE k = 1""",
    "kv_facts": f"WITH {OFFICES}, {_KV_FACTS} SELECT {_FACT_COLUMNS} FROM f1",
    "role_sentence_facts": f"WITH {OFFICES}, {_ROLE_SENTENCES} SELECT {_FACT_COLUMNS} FROM f3",
    "role_line_facts": f"WITH {OFFICES}, {_ROLE_LINES} SELECT {_FACT_COLUMNS} FROM f2",
    "contact_facts": f"WITH {OFFICES}, {_found_sql(4, FA.CONTACT, 'contact', 'contact', 0.72, False)} SELECT {_FACT_COLUMNS} FROM f4",
    "date_facts": f"WITH {OFFICES}, {_found_sql(5, FA.DATE, 'event', 'date', 0.68, True)} SELECT {_FACT_COLUMNS} FROM f5",
    "extract_facts": f"WITH {FACTS} SELECT * FROM facts",
    "looks_like_name": f"WITH l AS (SELECT doc_id, unnest(range(0, len(ls))) AS n, unnest(ls) AS v FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) SELECT doc_id, n, {_is_name('v')} AS is_name FROM l",
    "sentence_around": f"SELECT doc_id, {_sentence('text', '(length(text) // 2)')} AS sentence FROM documents",
    "normalize_role": rf"SELECT word, CASE lower(word) WHEN 'hod' THEN 'head of department' WHEN 'chairperson' THEN 'chairman' ELSE lower(word) END AS role FROM (SELECT DISTINCT unnest(string_split_regex({P.strip('text')}, '\s+')) AS word FROM conversations)",
    "dataset_vocabulary": f"WITH {FACTS}, {VOCABULARY} SELECT dataset_id, term, ord.g AS g, ord.input_id AS first_input FROM vocab",
    "chunk_entities": f"WITH RECURSIVE {P.DOC_CHUNKS}, {_ENTS} SELECT input_id, chunk_ord, len(es) AS n, array_to_string(es, '|') AS entities FROM gents",
    "entity_nodes": f"WITH RECURSIVE {GRAPH} SELECT * FROM nodes",
    "cooccurrence_edges": f"WITH RECURSIVE {GRAPH} SELECT * FROM edges",
    "entity_type_counts": f"WITH RECURSIVE {GRAPH} SELECT dataset_id, type, count(*) AS n FROM nodes GROUP BY ALL",
    "graph_hint": f"""WITH RECURSIVE {GRAPH}, hints AS (SELECT dataset_id, 'The lightweight graph layer found these prominent entities for relationship-style reasoning: ' || string_agg(entity, ', ' ORDER BY rank) || '.' AS hint FROM nodes WHERE rank <= 8 GROUP BY 1)
SELECT dataset_id, coalesce(hint, 'No strong entity relationships were extracted yet.') AS hint FROM (SELECT DISTINCT 'src' || (conv_id % 23) AS dataset_id FROM conversations) LEFT JOIN hints USING (dataset_id)""",
    "graph_view": f"""WITH RECURSIVE {GRAPH}, shown AS (SELECT dataset_id, entity FROM nodes WHERE rank <= 18)
SELECT dataset_id, source, target, weight, view_rank FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY rank) AS view_rank FROM edges WHERE (dataset_id, source) IN (SELECT (dataset_id, entity) FROM shown) AND (dataset_id, target) IN (SELECT (dataset_id, entity) FROM shown)) WHERE view_rank <= 32""",
}
