"""Reciprocal rank fusion of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundspark import settings


def reciprocal_rank_fusion(
    rankings: list[DataFrame],
    item: list[str],
    k: int = settings.RRF_K,
    top_k: int | None = None,
) -> DataFrame:
    """(query_id, item, score, source_ranks, rank) from lists of (query_id, item, rank).

    Ranks are raw list positions; an item repeated in a list counts at its first
    place. Equal scores keep first-seen order: earlier list, then place in it.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    lists = [r.select("query_id", *item, "rank", F.lit(i).alias("source")) for i, r in enumerate(rankings)]
    places = [f"_place_{i}" for i in range(len(lists))]
    firsts = (
        reduce(DataFrame.unionByName, lists)
        .groupBy("query_id", *item)
        .agg(*[F.min(F.when(F.col("source") == i, F.col("rank"))).alias(p) for i, p in enumerate(places)])
    )
    shares = [F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(p)), F.lit(0.0)) for p in places]
    entries = F.array(*[F.struct(F.lit(i).alias("key"), F.col(p).alias("value")) for i, p in enumerate(places)])
    fused = firsts.select(
        "query_id",
        *item,
        reduce(lambda total, share: total + share, shares).alias("score"),
        F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("source_ranks"),
    )
    keys = F.map_keys("source_ranks")
    order = Window.partitionBy("query_id").orderBy(
        F.col("score").desc(), F.array_min(keys), F.col("source_ranks")[F.array_min(keys)]
    )
    ranked = fused.withColumn("rank", F.row_number().over(order))
    return ranked if top_k is None else ranked.filter(F.col("rank") <= top_k)


def matched_by(source_ranks, labels: list[str]):
    """Names of the lists that found an item, in list order."""
    names = F.array(*[F.lit(label) for label in labels])
    return F.transform(F.array_sort(F.map_keys(source_ranks)), lambda i: F.get(names, i))
