"""Chunk hits regrouped into one row per source document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group_by_source(results: DataFrame, source_type: str) -> DataFrame:
    """(query_id, place, source fields, best_score, matched_by, excerpts) of one source type.

    A question has at most top_k hits, which bounds every list. Groups come by
    best score and excerpts by score; ties keep the order of the hits.
    """
    hits = F.sort_array(F.collect_list(F.struct("rank", "matched_by", "source_url", "title")))
    excerpts = F.array_sort(
        F.collect_list(F.struct((-F.col("score")).alias("below"), "rank", "document_id", "chunk_index", "excerpt", "score"))
    )
    groups = (
        results.filter(F.col("source_type") == source_type)
        .groupBy("query_id", "source_type", "source_identifier")
        .agg(
            F.max("score").alias("best_score"),
            F.min("rank").alias("first_rank"),
            hits.alias("hits"),
            F.transform(excerpts, lambda e: F.struct(e["document_id"].alias("document_id"), e["chunk_index"].alias("chunk_index"), e["excerpt"].alias("excerpt"), e["score"].alias("score"))).alias("excerpts"),
        )
    )
    order = Window.partitionBy("query_id").orderBy(F.col("best_score").desc(), "first_rank")
    return groups.select(
        "query_id",
        F.row_number().over(order).alias("place"),
        "source_type",
        "source_identifier",
        F.get("hits", 0)["source_url"].alias("source_url"),
        F.get("hits", 0)["title"].alias("title"),
        "best_score",
        F.array_distinct(F.flatten(F.transform("hits", lambda h: h["matched_by"]))).alias("matched_by"),
        "excerpts",
    )
