"""Overlapping character windows over documents, and the chunk table diff."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark import settings
from groundspark.functions.text import sha256_hex
from groundspark.runtime import in_slices

SPANS_DDL = "array<struct<text:string,char_start:int,char_end:int>>"
SPANS = pa.list_(pa.struct([("text", pa.string()), ("char_start", pa.int32()), ("char_end", pa.int32())]))
CHUNK_KEY = ["document_id", "chunk_index"]


def window_spans(text: str, size: int, overlap: int) -> list[dict]:
    """Windows of at most ``size`` characters that end before a blank if they can."""
    spans: list[dict] = []
    length, start = len(text), 0
    while True:
        rest = text[start : start + size]
        while rest and rest.isspace():
            start += len(rest)
            rest = text[start : start + size]
        start += len(rest) - len(rest.lstrip())
        if start >= length:
            return spans
        end = start + size
        if end < length:
            blank = text.rfind(" ", start + 1, end)
            end = blank if blank >= 0 else end
        else:
            end = length
        spans.append({"text": text[start:end], "char_start": start, "char_end": end})
        if end == length:
            return spans
        start = end - overlap if end - overlap > start else end


def check_window(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("chunk size must be positive")
    if not 0 <= overlap < size:
        raise ValueError("chunk overlap must be at least 0 and smaller than the chunk size")


def chunk_documents(
    documents: DataFrame,
    size: int = settings.CHUNK_SIZE,
    overlap: int = settings.CHUNK_OVERLAP,
    id_column: str = "document_id",
    text_column: str = "text",
) -> DataFrame:
    """(document_id, chunk_index, text, char_start, char_end, content_hash), no shuffle."""
    check_window(size, overlap)

    @F.arrow_udf(SPANS_DDL)
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in in_slices(batches):
            yield pa.array([window_spans(t or "", size, overlap) for t in part.to_pylist()], type=SPANS)

    return (
        documents.select(F.col(id_column).alias("document_id"), F.posexplode(spans(text_column)).alias("chunk_index", "s"))
        .select("document_id", "chunk_index", "s.text", "s.char_start", "s.char_end")
        .withColumn("content_hash", sha256_hex(F.col("text")))
    )


def diff_chunks(spans: DataFrame, stored: DataFrame) -> DataFrame:
    """Full-outer comparison of fresh spans with stored chunks, one action per key.

    Keys are unique on both sides, so one large document spreads over many tasks.
    """
    old = stored.select(*CHUNK_KEY, F.col("content_hash").alias("stored_hash"), F.lit(True).alias("_old"))
    new = spans.withColumn("_new", F.lit(True))
    action = (
        F.when(F.col("_old").isNull(), "created")
        .when(F.col("_new").isNull(), "deleted")
        .when(F.col("content_hash") == F.col("stored_hash"), "unchanged")
        .otherwise("updated")
    )
    return new.join(old, CHUNK_KEY, "full_outer").withColumn("action", action).drop("_old", "_new", "stored_hash")


def apply_index_diff(diff: DataFrame, stored: DataFrame, enrich) -> DataFrame:
    """New chunk table: only created and updated spans pass through ``enrich``.

    Unchanged rows are taken from ``stored`` as they are, old offsets included.
    """
    changed = enrich(diff.filter(F.col("action").isin("created", "updated")).drop("action"))
    kept = stored.join(diff.filter(F.col("action") == "unchanged").select(*CHUNK_KEY), CHUNK_KEY, "left_semi")
    return changed.unionByName(kept.select(*changed.columns))


def index_totals(diff: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: documents seen and the number of chunks per action."""
    names = ("documents", "created", "updated", "unchanged", "deleted")
    seen = documents.select(F.lit("documents").alias("action")).unionByName(diff.select("action"))
    return seen.agg(*[F.count_if(F.col("action") == name).alias(name) for name in names])
