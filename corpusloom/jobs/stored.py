"""The stored steps of the corpus: chunks, segments, and their indexes, made once for each content of a data set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.lineage import spread
from corpusloom.functions.store import DatasetBuild
from corpusloom.operators import chunks as C
from corpusloom.operators import facts as FA
from corpusloom.operators import graph as G
from corpusloom.operators import index as I
from corpusloom.operators import segments as S


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as one data set for each source."""
    return as_corpus(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def as_corpus(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("source").alias("dataset_id"), F.col("doc_id").alias("input_id"), F.concat(F.lit("document "), F.col("doc_id")).alias("title"), "text")


class Corpus:
    """All stored steps over the documents of a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.build = DatasetBuild(corpus(spark, sf_dir))

    def chunks(self) -> DataFrame:
        return self.build.step("chunks", C.chunks_from_documents, tuple(I.CHUNK))

    def index(self) -> I.TextIndex:
        chunks = self.chunks()
        lists = self.build.step("lists", lambda own: I.index_chunks(own).lists, I.LIST, of=chunks)
        terms = self.build.step("terms", I.terms_of, of=lists)
        return I.TextIndex(lists, terms, self.build.step("sizes", lambda own: I.index_chunks(own).sizes, of=chunks), chunks)

    def segments(self) -> DataFrame:
        def classified(own: DataFrame) -> DataFrame:
            each = own.select("dataset_id", "input_id", F.lit(0).alias("seg_ord"), "title", F.col("title").alias("source_name"), "text")
            return S.classify_segments(each)

        return self.build.step("segments", classified)

    def section_index(self) -> I.TextIndex:
        segments = self.segments()
        lists = self.build.step("section_lists", lambda own: I.index_sections(own).lists, I.LIST, of=segments)
        return I.TextIndex(lists, self.build.step("section_terms", I.terms_of, of=lists), self.build.step("section_sizes", lambda own: I.index_sections(own).sizes, of=segments))

    def nodes(self) -> DataFrame:
        return self.build.step("nodes", lambda own: G.entity_nodes(G.chunk_entities(own)), of=self.chunks())

    def edges(self) -> DataFrame:
        def pairs(own: DataFrame) -> DataFrame:
            found = G.chunk_entities(own)
            return G.cooccurrence_edges(found, G.entity_nodes(found))

        return self.build.step("edges", pairs, of=self.chunks())


class Facts:
    """Stored facts of segments (documents and offices), and the vocabulary that they and the titles make."""

    def __init__(self, segments: DataFrame):
        self.build = DatasetBuild(segments, "facts")

    def facts(self) -> DataFrame:
        return self.build.step("facts", FA.extract_facts)

    def vocabulary(self) -> DataFrame:
        def words(own: DataFrame) -> DataFrame:
            sets = own.select("dataset_id").distinct()
            return FA.dataset_vocabulary(own, self.facts().join(sets, "dataset_id", "left_semi"))

        return self.build.step("vocabulary", words)
