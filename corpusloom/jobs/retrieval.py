"""Registered queries on chunks, terms and retrieval, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.lineage import shared_root, spread
from corpusloom.jobs import sql_parts as P
from corpusloom.jobs.stored import as_corpus, corpus
from corpusloom.operators import batch as B
from corpusloom.operators import chunks as C
from corpusloom.operators import retrieve as R
from corpusloom.operators import vectors as V
from corpusloom.streaming import incremental as IN


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark items as questions, dealt over the data sets."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return items.select(F.concat(F.lit("src"), F.col("item_id") % 20).alias("dataset_id"), F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def cut_chunks(spark, sf_dir):
    """Chunks of all documents, cut whenever they are read: a batch of questions reads them two or three times, which takes less than to store them."""
    return C.chunks_from_documents(corpus(spark, sf_dir))


def with_texts(spark, sf_dir, hits):
    """Hits with ``title, text`` of their chunks; only the documents that are hit are cut again."""
    docs = corpus(spark, sf_dir).join(F.broadcast(hits.select("dataset_id", "input_id").distinct()), ["dataset_id", "input_id"], "left_semi")
    return hits.join(C.chunks_from_documents(docs), R.CHUNK)


def chunk_text(spark, sf_dir):
    return C.chunks_from_documents(corpus(spark, sf_dir)).drop("title")


def _tokens(tokenizer):
    def run(spark, sf_dir):
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        return docs.select("doc_id", tokenizer(F.col("text")).alias("ts")).select("doc_id", F.size("ts").cast("long").alias("n_tokens"), F.array_join("ts", " ").alias("tokens"))

    return run


def sentences(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.posexplode(T.split_sentences(F.col("text"))).alias("ord", "sentence"))


def evidence(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", T.clean_evidence(F.col("text")).alias("evidence"))


def tokens_estimate(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", T.estimate_tokens(F.length("text")).cast("long").alias("tokens"))


def term_stats(spark, sf_dir):
    stats = B.term_stats(cut_chunks(spark, sf_dir))
    return stats.select("dataset_id", "term", "df", "n", F.round("idf", 6).alias("idf"))


def keyword_hits(spark, sf_dir):
    return B.keyword_search(questions(spark, sf_dir), cut_chunks(spark, sf_dir), 18)


def tfidf_hits(spark, sf_dir):
    return B.tfidf_search(questions(spark, sf_dir), cut_chunks(spark, sf_dir), 12)


def _vectors(spark, sf_dir):
    """All vectors, and every twentieth as a query."""
    vectors = spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), vectors


def vector_hits(spark, sf_dir):
    return V.vector_search(*_vectors(spark, sf_dir), 10)


def indexed_vector_hits(spark, sf_dir):
    asked, vectors = _vectors(spark, sf_dir)
    return V.index_search(asked, V.index_vectors(vectors, 10), 10)


def fused(spark, sf_dir):
    """Keyword and tf-idf hits, each set from 0 to 1, merged first-wins."""
    groups = []
    for name, hits in (("keyword", keyword_hits(spark, sf_dir)), ("semantic", tfidf_hits(spark, sf_dir))):
        hits = with_texts(spark, sf_dir, R.normalize_scores(hits.withColumn("retriever", F.lit(name)))).drop("title")
        groups.append(hits.withColumn("source_id", F.concat_ws(":", "input_id", "seg_ord", "chunk_ord")))
    return R.merge_hits(*groups).select("question_id", "source_id", "retriever", "rank", "score")


def normalized(spark, sf_dir):
    hits = keyword_hits(spark, sf_dir).withColumn("retriever", F.lit("keyword"))
    return R.normalize_scores(hits)


def streamed_stats(spark, sf_dir):
    """Term statistics of the documents as a stream leaves them: arrivals to chunks, chunks to counts."""
    root, path = f"{shared_root(spark)}/streams/{uuid.uuid4().hex[:12]}", f"{sf_dir}/documents.parquet"
    # a pattern, as a stream may not read a single file by its name
    docs = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 100).parquet(f"{path[:-1]}[t]")
    IN.index_stream(as_corpus(docs), f"{root}/index", f"{root}/c1").awaitTermination()
    IN.stats_stream(spark, f"{root}/index", f"{root}/stats", f"{root}/c2").awaitTermination()
    return IN.current_stats(spark, f"{root}/stats").select("dataset_id", "term", "df", "n", F.round("idf", 6).alias("idf"))


def unseen(spark, sf_dir):
    """Chunks of documents with odd ids, as if those of the others were indexed before."""
    chunks = C.chunks_from_documents(corpus(spark, sf_dir))
    return C.new_chunks(chunks, chunks.where("input_id % 2 = 0").select(*R.CHUNK)).select(*R.CHUNK)


QUERIES = {
    "chunk_text": chunk_text,
    "keyword_tokens": _tokens(T.keyword_tokens),
    "semantic_tokens": _tokens(T.semantic_tokens),
    "split_sentences": sentences,
    "clean_evidence": evidence,
    "estimate_tokens": tokens_estimate,
    "term_stats": term_stats,
    "keyword_search": keyword_hits,
    "tfidf_search": tfidf_hits,
    "vector_search": vector_hits,
    "vector_index_search": indexed_vector_hits,
    "normalize_scores": normalized,
    "merge_hits": fused,
    "new_chunks": unseen,
    "streamed_term_stats": streamed_stats,
}

_TF = "tf AS (SELECT dataset_id, input_id, seg_ord, chunk_ord, term, count(*) AS tf FROM (SELECT dataset_id, input_id, seg_ord, chunk_ord, unnest({tokens}) AS term FROM chunks) GROUP BY ALL)"
_STATS = "cn AS (SELECT dataset_id, count(*) AS n FROM chunks GROUP BY 1), stats AS (SELECT dataset_id, term, count(*) AS df, any_value(n) AS n, ln((any_value(n) + 1) / (count(*) + 0.5)) + 1 AS idf FROM tf JOIN cn USING (dataset_id) GROUP BY 1, 2)"
_QTF = "qt AS (SELECT dataset_id, question_id, term, count(*) AS qtf FROM (SELECT dataset_id, question_id, unnest({tokens}) AS term FROM questions) GROUP BY ALL)"
_KEYWORD = f"""{P.DOC_CHUNKS}, {P.QUESTIONS}, {_TF.format(tokens=P.keyword_tokens('text'))}, {_STATS}, {_QTF.format(tokens=P.keyword_tokens('question'))},
kscored AS (SELECT question_id, dataset_id, input_id, seg_ord, chunk_ord, sum(score) AS score FROM (
  SELECT question_id, q.dataset_id, input_id, seg_ord, chunk_ord, tf * (qtf * idf) AS score FROM qt q JOIN stats USING (dataset_id, term) JOIN tf USING (dataset_id, term)
  UNION ALL SELECT question_id, dataset_id, input_id, seg_ord, chunk_ord, 12.0 FROM questions JOIN chunks c USING (dataset_id) WHERE trim(question) <> '' AND contains(lower(c.text), trim(lower(question)))) GROUP BY ALL),
khits AS (SELECT * FROM (SELECT dataset_id, question_id, input_id, seg_ord, chunk_ord, round(score, 4) AS score, row_number() OVER (PARTITION BY dataset_id, question_id ORDER BY round(score, 4) DESC, input_id, seg_ord, chunk_ord) AS rank FROM kscored WHERE score > 0) WHERE rank <= 18)"""
_TFIDF = f"""{_TF.format(tokens=P.semantic_tokens('text')).replace('tf AS', 'stf AS', 1)}, {_STATS.replace('cn AS', 'scn AS').replace('stats AS', 'sstats AS').replace('FROM tf JOIN cn', 'FROM stf JOIN scn')}, {_QTF.format(tokens=P.semantic_tokens('question')).replace('qt AS', 'sqt AS', 1)},
dn AS (SELECT dataset_id, input_id, seg_ord, chunk_ord, sqrt(sum((tf * idf) * (tf * idf))) AS d_norm FROM stf JOIN sstats USING (dataset_id, term) GROUP BY ALL),
qn AS (SELECT dataset_id, question_id, sqrt(sum((qtf * coalesce(idf, 1)) * (qtf * coalesce(idf, 1)))) AS q_norm FROM sqt LEFT JOIN sstats USING (dataset_id, term) GROUP BY ALL),
dots AS (SELECT dataset_id, question_id, input_id, seg_ord, chunk_ord, sum(tf * idf * (qtf * idf)) AS dot FROM sqt JOIN sstats USING (dataset_id, term) JOIN stf USING (dataset_id, term) GROUP BY ALL),
thits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, question_id ORDER BY score DESC, input_id, seg_ord, chunk_ord) AS rank FROM (
  SELECT dataset_id, question_id, input_id, seg_ord, chunk_ord, round(dot / (q_norm * d_norm), 4) AS score FROM dots JOIN dn USING (dataset_id, input_id, seg_ord, chunk_ord) JOIN qn USING (dataset_id, question_id) WHERE dot > 0)) WHERE rank <= 12)"""


def _norm(hits: str) -> str:
    lo, hi = (f"{f}(score) OVER (PARTITION BY dataset_id, question_id)" for f in ("min", "max"))
    return f"SELECT * REPLACE (CASE WHEN {hi} <= {lo} THEN 1.0 ELSE round((score - {lo}) / ({hi} - {lo}), 4) END AS score) FROM {hits}"


SQL = {
    "chunk_text": f"WITH RECURSIVE {P.DOC_CHUNKS} SELECT dataset_id, input_id, seg_ord, chunk_ord, text FROM chunks",
    "keyword_tokens": f"SELECT doc_id, len(ts) AS n_tokens, array_to_string(ts, ' ') AS tokens FROM (SELECT doc_id, {P.keyword_tokens('text')} AS ts FROM documents)",
    "semantic_tokens": f"SELECT doc_id, len(ts) AS n_tokens, array_to_string(ts, ' ') AS tokens FROM (SELECT doc_id, {P.semantic_tokens('text')} AS ts FROM documents)",
    "split_sentences": f"SELECT doc_id, unnest(range(0, len(ss))) AS ord, unnest(ss) AS sentence FROM (SELECT doc_id, {P.sentences('text')} AS ss FROM documents)",
    "clean_evidence": f"SELECT doc_id, {P.clean_evidence('text')} AS evidence FROM documents",
    "estimate_tokens": "SELECT doc_id, (length(text) + 3) // 4 AS tokens FROM documents",
    "term_stats": f"WITH RECURSIVE {P.DOC_CHUNKS}, {_TF.format(tokens=P.keyword_tokens('text'))}, {_STATS} SELECT dataset_id, term, df, n, round(idf, 6) AS idf FROM stats",
    "streamed_term_stats": f"WITH RECURSIVE {P.DOC_CHUNKS}, {_TF.format(tokens=P.keyword_tokens('text'))}, {_STATS} SELECT dataset_id, term, df, n, round(idf, 6) AS idf FROM stats",
    "keyword_search": f"WITH RECURSIVE {_KEYWORD} SELECT dataset_id, question_id, input_id, seg_ord, chunk_ord, score, rank FROM khits",
    "tfidf_search": f"WITH RECURSIVE {P.DOC_CHUNKS}, {P.QUESTIONS}, {_TFIDF} SELECT dataset_id, question_id, input_id, seg_ord, chunk_ord, score, rank FROM thits",
    "vector_search": """WITH d AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))) AS distance FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d) SELECT query_id, vec_id, rank, round(1 / (1 + distance), 4) AS score FROM r WHERE rank <= 10""",
    "normalize_scores": f"WITH RECURSIVE {_KEYWORD} SELECT *, 'keyword' AS retriever FROM ({_norm('khits')})",
    "merge_hits": f"""WITH RECURSIVE {_KEYWORD}, {_TFIDF}, every AS (SELECT *, 0 AS g, 'keyword' AS retriever FROM ({_norm('khits')}) UNION ALL SELECT *, 1, 'semantic' FROM ({_norm('thits')})),
t AS (SELECT e.*, concat_ws(':', input_id, seg_ord, chunk_ord) AS source_id, c.text FROM every e JOIN chunks c USING (dataset_id, input_id, seg_ord, chunk_ord)),
f AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, question_id, source_id, substr(text, 1, 80) ORDER BY g, rank) AS first FROM t)
SELECT question_id, source_id, retriever, rank, score FROM f WHERE first = 1""",
    "new_chunks": f"WITH RECURSIVE {P.DOC_CHUNKS} SELECT dataset_id, input_id, seg_ord, chunk_ord FROM chunks WHERE input_id % 2 <> 0",
}
