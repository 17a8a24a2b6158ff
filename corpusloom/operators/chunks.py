"""Overlapping chunks of documents, and the terms of chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import keyword_tokens

MAX_CHARS, OVERLAP = 1400, 160
#: A break counts if it lies beyond this share of a window.
BREAK_AFTER = 0.55


def windows(text: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> Iterator[str]:
    """Windows over the trimmed lines of a text.  Each but the last ends at its last line end or sentence end, if that lies far enough in it; the next begins ``overlap`` before."""
    body = "\n".join(filter(None, map(str.strip, text.splitlines())))
    begin, size = 0, len(body)
    while begin < size:
        stop = min(size, begin + max_chars)
        if stop < size:
            last = max(body.rfind("\n", begin, stop), body.rfind(". ", begin, stop)) - begin
            if last > BREAK_AFTER * max_chars:
                stop = begin + last + 1
        yield body[begin:stop].strip()
        if stop == size:
            return
        begin = max(0, stop - overlap)


def chunk_text(df: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, text_col: str = "text") -> DataFrame:
    """A row per chunk: ``chunk_ord`` and the chunk in place of the text; texts without any line give none."""

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([list(windows(t.as_py() or "", max_chars, overlap)) for t in texts], pa.list_(pa.string()))

    rest = [c for c in df.columns if c != text_col]
    return df.select(*rest, F.posexplode(cut(F.col(text_col))).alias("chunk_ord", text_col))


def chunks_from_documents(docs: DataFrame) -> DataFrame:
    """Chunks of whole documents: ``dataset_id, input_id, seg_ord`` (0)``, chunk_ord, title, text``."""
    own = docs.select("dataset_id", "input_id", F.lit(0).alias("seg_ord"), "title", "text")
    return chunk_text(own)


def chunks_from_segments(segments: DataFrame) -> DataFrame:
    """Chunks of all segments but those that became tables, with the segment's type and method."""
    own = segments.where("method <> 'sql'").select("dataset_id", "input_id", "seg_ord", "segment_type", "method", "title", "text")
    return chunk_text(own)


def new_chunks(chunks: DataFrame, indexed: DataFrame) -> DataFrame:
    """Chunks whose key is not indexed yet."""
    return chunks.join(indexed, ["dataset_id", "input_id", "seg_ord", "chunk_ord"], "left_anti")


def with_terms(chunks: DataFrame, tokenizer=keyword_tokens) -> DataFrame:
    """A row per chunk and term with its count ``tf``."""
    key = ["dataset_id", "input_id", "seg_ord", "chunk_ord"]
    return chunks.select(*key, F.explode(tokenizer(F.col("text"))).alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf"))
