"""An inverted index of chunks and sections: term lists in blocks by falling weight, word positions, and searches that leave blocks out.

A list holds the places of one term of one data set.  It is dealt into parts by place, so that no list fills one task, and each part is cut
into blocks by falling weight; a block knows the largest weight in it.  A question takes the first blocks of its terms, which bounds from below what its k-th
hit scores; of the rest it takes only blocks whose places could still reach that with the largest weights of all its other terms.

Kinds of lists: ``keyword`` and ``semantic`` terms with counts, ``word`` with positions (for phrases), and ``section`` terms.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.functions.text import keyword_tokens, semantic_tokens

CHUNK = ["dataset_id", "input_id", "seg_ord", "chunk_ord"]
SECTION = ["dataset_id", "input_id", "seg_ord"]
QUESTION = ["dataset_id", "question_id"]
LIST = ("kind", "dataset_id", "term", "part")
#: Places of a block; chunks (or sections) of a data set for each part of its lists.
BLOCK, PART = 128, 1 << 20
#: A word or any other character but a space; a phrase's words stand in a text as they are, but for its first and last, which may be parts of words.
WORD = r"[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_ ]"
#: Scores are rounded before they are ranked, so a place that falls short by less may still be in.
MARGIN = 2e-4


def idf(n: Column, df: Column) -> Column:
    return F.log((n + 1) / (df + 0.5)) + 1


def words(low: Column) -> Column:
    """The words and other characters of a lower-case text."""
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def _counted(col: Column) -> Column:
    """Each distinct token of an array with its number and places."""

    @F.arrow_udf("array<struct<term: string, tf: int, positions: array<int>>>")
    def count(tokens: pa.Array) -> pa.Array:
        out = []
        for ts in tokens.to_pylist():
            at: dict[str, list[int]] = {}
            for i, t in enumerate(ts or []):
                at.setdefault(t, []).append(i)
            out.append([{"term": t, "tf": len(p), "positions": p} for t, p in at.items()])
        return pa.array(out, pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32()), ("positions", pa.list_(pa.int32()))])))

    return count(col)


@dataclass(frozen=True)
class TextIndex:
    """Tables of an index: ``lists`` (blocks), ``terms`` (``kind, dataset_id, term, df, top``), ``sizes`` (``kind, dataset_id, n, parts``), and the ``chunks`` themselves.

    A search works alike on tables that are made within its plan and on stored ones.
    """

    lists: DataFrame
    terms: DataFrame
    sizes: DataFrame
    chunks: DataFrame | None = None


def _sizes(places: DataFrame, kinds: list[str]) -> DataFrame:
    """Places of each data set, those without terms too, and the parts of its lists."""
    n = places.groupBy("dataset_id").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / PART).cast("int"))
    return n.select(F.explode(F.array(*map(F.lit, kinds))).alias("kind"), "dataset_id", "n", "parts")


def _blocks(postings: DataFrame, sizes: DataFrame, key: list[str]) -> DataFrame:
    """``kind, dataset_id, term, part, block, top, places`` from rows ``kind, term, weight`` and more of each place."""
    place = F.struct(*key[1:], "tf", "weight", "norm", "positions")
    # the rows of sizes are as many as data sets
    dealt = postings.join(sizes.select("kind", "dataset_id", "parts"), ["kind", "dataset_id"]).withColumn("part", F.pmod(F.xxhash64(*key), F.col("parts")).cast("int"))
    rank = F.row_number().over(W.partitionBy(*LIST).orderBy(F.desc("weight"), *key[1:]))
    cut = dealt.select(*LIST, place.alias("place"), F.col("weight"), F.floor((rank - 1) / BLOCK).cast("int").alias("block"))
    return cut.groupBy(*LIST, "block").agg(F.max("weight").alias("top"), F.collect_list("place").alias("places"))


def terms_of(lists: DataFrame) -> DataFrame:
    """``kind, dataset_id, term, df, top`` from the blocks alone."""
    return lists.groupBy("kind", "dataset_id", "term").agg(F.sum(F.size("places")).cast("long").alias("df"), F.max("top").alias("top"))


def index_chunks(chunks: DataFrame, kinds: tuple[str, ...] = ("keyword", "semantic", "word")) -> TextIndex:
    """The index of ``chunks`` (``dataset_id, input_id, seg_ord, chunk_ord, text`` and more).

    A chunk's key is unique; a null text has no terms, but counts; an empty table gives an index without rows.
    """
    tokens = {"keyword": keyword_tokens(F.col("text")), "semantic": semantic_tokens(F.col("text")), "word": words(F.lower("text"))}
    sizes = _sizes(chunks, list(kinds))
    each = chunks.select(*CHUNK, *(_counted(tokens[k]).alias(k) for k in kinds))
    each = each.select(*CHUNK, F.explode(F.create_map(*(x for k in kinds for x in (F.lit(k), F.col(k))))).alias("kind", "all"))
    each = each.select("kind", *CHUNK, F.explode("all").alias("t")).select("kind", *CHUNK, "t.term", "t.tf", F.when(F.col("kind") == "word", F.col("t.positions")).alias("positions"))
    plain = each.where("kind <> 'semantic'").select("*", F.when(F.col("kind") == "keyword", F.col("tf").cast("double")).otherwise(0.0).alias("weight"), F.lit(1.0).alias("norm"))
    postings = plain
    if "semantic" in kinds:
        own = each.where("kind = 'semantic'")
        df = own.groupBy("dataset_id", "term").agg(F.count("*").alias("df")).join(sizes.where("kind = 'semantic'").select("dataset_id", "n"), "dataset_id")
        weighed = own.join(df, ["dataset_id", "term"]).withColumn("w", F.col("tf") * idf(F.col("n"), F.col("df")))
        norms = weighed.groupBy(*CHUNK).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        weighed = weighed.join(norms, CHUNK).withColumn("weight", F.col("w") / F.col("norm"))
        postings = plain.unionByName(weighed.select(*plain.columns))
    lists = _blocks(postings, sizes, CHUNK)
    return TextIndex(lists, terms_of(lists), sizes, chunks)


def index_sections(segments: DataFrame) -> TextIndex:
    """The index of the terms of sections (title and text), tables left out: a place's weight is 1; half a point that long sections get is its ``norm``."""
    own = segments.where("method <> 'sql'")
    found = own.select(*SECTION, F.when(F.col("method") == "hierarchical", 0.5).otherwise(0.0).alias("norm"), F.explode(F.array_distinct(keyword_tokens(F.concat_ws(" ", "title", "text")))).alias("term"))
    rows = found.select(F.lit("section").alias("kind"), *SECTION, "term", F.lit(1).alias("tf"), F.lit(1.0).alias("weight"), "norm", F.lit(None).cast("array<int>").alias("positions"))
    sizes = _sizes(own, ["section"])
    lists = _blocks(rows, sizes, SECTION)
    return TextIndex(lists, terms_of(lists), sizes)


def candidates(asked: DataFrame, index: TextIndex, key: list[str], k: int, beyond: Column | None = None) -> DataFrame:
    """``QUESTION, term, qw, key, place``: the places of asked terms that can be among the first ``k`` of a question.

    ``asked`` has a row for each question and term: ``kind, term, qw`` (weight in the question), ``top`` (the term's largest weight), ``parts``, and whatever ``beyond``
    uses.  A place scores at most the sum of ``qw * top``, and ``beyond`` more.  A place that is left out in one list falls short of the k-th hit, so it may be left out of all.
    """
    total = F.sum(F.col("qw") * F.col("top")).over(W.partitionBy(*QUESTION))
    asked = asked.withColumn("total", total).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    first = asked.join(index.lists.where("block = 0"), list(LIST)).select(*QUESTION, "qw", F.explode("places").alias("place"))
    sums = first.groupBy(*QUESTION, *(F.col(f"place.{c}").alias(c) for c in key[1:])).agg(F.sum(F.col("qw") * F.col("place.weight")).alias("sum"))
    rank = F.row_number().over(W.partitionBy(*QUESTION).orderBy(F.desc("sum")))
    floor = sums.withColumn("r", rank).where(F.col("r") <= k).groupBy(*QUESTION).agg(F.min(F.when(F.col("r") == k, F.col("sum"))).alias("floor"))
    asked = asked.join(floor, QUESTION, "left")
    # without k places so far, every block is read
    rest = F.col("total") - F.col("qw") * F.col("top") + (beyond if beyond is not None else F.lit(0.0))
    asked = asked.withColumn("least", F.coalesce((F.col("floor") - MARGIN - rest) / F.col("qw"), F.lit(-1.0)))
    read = asked.join(index.lists.withColumnRenamed("top", "most"), list(LIST)).where(F.col("most") >= F.col("least"))
    return read.select(*QUESTION, "term", "qw", F.explode("places").alias("place")).select(*QUESTION, "term", "qw", *(F.col(f"place.{c}").alias(c) for c in key[1:]), "place")


def asked_terms(questions: DataFrame, index: TextIndex, kind: str, tokenizer) -> DataFrame:
    """``kind, QUESTION, term, qtf, df, n, top, parts`` of the terms of each question that its data set has (null elsewhere)."""
    q = questions.select(*QUESTION, F.explode(tokenizer(F.col("question"))).alias("term")).groupBy(*QUESTION, "term").agg(F.count("*").alias("qtf"))
    known = index.terms.where(F.col("kind") == kind).join(index.sizes, ["kind", "dataset_id"])
    return q.join(known, ["dataset_id", "term"], "left")


def phrase_hits(questions: DataFrame, index: TextIndex) -> DataFrame:
    """Chunks that hold the whole question, in any case, anywhere: ``QUESTION`` and the chunk.

    The rarest word that must stand as it is leads, its places are met with those of the second rarest by their offset, and the texts of what is left
    are looked at.  Phrases of one or two words, which may both be parts of words, lead by all words of the data set that hold the longer one.  Equal phrases
    are looked up once; an empty phrase has no hits.
    """
    asked = questions.select(*QUESTION, F.trim(F.lower("question")).alias("phrase")).where("phrase <> ''")
    phrases = asked.select("dataset_id", "phrase").distinct()
    each = phrases.select("*", words(F.col("phrase")).alias("ws")).select("*", F.size("ws").alias("n"), F.posexplode("ws").alias("at", "term"))
    whole = ~F.col("term").rlike(r"[\p{L}\p{N}\p{M}_]") | ((F.col("at") > 0) & (F.col("at") < F.col("n") - 1))
    each = each.drop("ws").withColumn("whole", whole)
    known = index.terms.where("kind = 'word'").select("dataset_id", "term", "df")

    # phrases with words that must stand as they are: all of them are known, or there is no hit
    met = each.where("whole").join(known, ["dataset_id", "term"], "left")
    rarest = F.sort_array(F.collect_list(F.struct("df", "at", "term")))
    led = met.groupBy("dataset_id", "phrase").agg(F.min(F.col("df").isNotNull()).alias("all"), rarest.alias("ws")).where("all")
    second = F.when(F.size("ws") > 1, F.element_at("ws", F.when(F.size("ws") > 1, 2).otherwise(1)))
    led = led.select("dataset_id", "phrase", F.col("ws")[0]["term"].alias("term"), F.col("ws")[0]["at"].alias("at"), second.alias("second"))

    # the others: words of the data set that hold the longest of theirs
    grams = _grams(known)
    short = each.join(led.select("dataset_id", "phrase"), ["dataset_id", "phrase"], "left_anti").join(each.where("whole").select("dataset_id", "phrase").distinct(), ["dataset_id", "phrase"], "left_anti")
    longest = short.groupBy("dataset_id", "phrase").agg(F.max(F.struct(F.length("term").alias("size"), (-F.col("at")).alias("at"), "term")).alias("w"))
    longest = longest.select("dataset_id", "phrase", F.col("w.term").alias("part_of"), F.substring("w.term", 1, 3).alias("gram"))
    held = longest.join(grams, ["dataset_id", "gram"]).where(F.contains("term", "part_of"))
    led = led.unionByName(held.select("dataset_id", "phrase", "term", F.lit(None).cast("int").alias("at"), F.lit(None).cast(led.schema["second"].dataType).alias("second")))

    parts = index.sizes.where("kind = 'word'").select("kind", "dataset_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    lists = index.lists.where("kind = 'word'")
    places = led.join(parts, "dataset_id").join(lists, list(LIST)).select("dataset_id", "phrase", "part", "at", "second", F.explode("places").alias("p"))
    places = places.select("dataset_id", "phrase", "part", *(F.col(f"p.{c}").alias(c) for c in CHUNK[1:]), "at", "second", "p.positions")
    alone = places.where("second IS NULL").select("dataset_id", "phrase", *CHUNK[1:])
    two = places.where("second IS NOT NULL").select(F.lit("word").alias("kind"), "dataset_id", F.col("second.term").alias("term"), "part", "phrase", *CHUNK[1:], "positions", (F.col("second.at") - F.col("at")).alias("apart"))
    # the second word's lists, opened once for each place
    opened = two.select(*LIST).distinct().join(lists, list(LIST)).select(*LIST, F.explode("places").alias("p")).select(*LIST, *(F.col(f"p.{c}").alias(c) for c in CHUNK[1:]), F.col("p.positions").alias("others"))
    both = two.join(opened, [*LIST, *CHUNK[1:]]).where(F.arrays_overlap(F.transform("positions", lambda x: x + F.col("apart")), "others"))
    left = alone.unionByName(both.select("dataset_id", "phrase", *CHUNK[1:])).distinct()
    sure = left.join(index.chunks.select(*CHUNK, "text"), CHUNK).where(F.contains(F.lower("text"), F.col("phrase"))).select("dataset_id", "phrase", *CHUNK[1:])
    return asked.join(sure, ["dataset_id", "phrase"]).select(*QUESTION, *CHUNK[1:])


def _grams(known: DataFrame) -> DataFrame:
    """``dataset_id, gram, term``: each word by all its runs of one, two and three characters."""
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("term") - n + 1, F.lit(1))), lambda i: F.substr("term", i, n))))
    return known.select("dataset_id", "term", F.explode(F.array_distinct(runs)).alias("gram"))
