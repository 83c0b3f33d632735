"""Bounded samples that do not depend on how rows are dealt to tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPACE = 1 << 40


def hash_sample(rows: DataFrame, by: list[str], bound: int) -> DataFrame:
    """About ``bound`` rows and never more: those of least hash of the columns ``by``.

    Rows are counted first and only hashes below twice the wanted share are sorted,
    so tasks pass on little more than what is taken. Equal rows have equal hashes and
    stand or fall together up to the bound.
    """
    count = rows.count()
    place = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in by], F.lit("sample")), F.lit(SPACE))
    limit = min(SPACE, SPACE * 2 * bound // max(1, count) + SPACE // max(1, count) * 20)
    return rows.withColumn("_place", place).filter(F.col("_place") < limit).orderBy("_place", *by).limit(bound).drop("_place")


def hash_sample_by(rows: DataFrame, stratum: str, by: list[str], bound: int, least: int) -> DataFrame:
    """At most ``bound`` rows, those of least hash of ``by`` within each value of ``stratum``.

    Every value gives up to ``least`` rows and a share of the remaining bound in
    proportion to its rows. At most ``bound // least`` values, those of most rows, take part.
    """
    sizes = rows.groupBy(stratum).count().orderBy(F.col("count").desc(), stratum).limit(bound // least).collect()
    rest, total = bound - least * len(sizes), max(1, sum(r["count"] for r in sizes))
    quota = {r[stratum]: least + rest * r["count"] // total for r in sizes}
    limit = {r[stratum]: min(SPACE, SPACE * 2 * quota[r[stratum]] // r["count"] + SPACE // r["count"] * 20) for r in sizes}
    numbers = [F.create_map(*[F.lit(x) for pair in m.items() for x in pair]) if m else F.lit(None) for m in (quota, limit)]
    numbers = [m[F.col(stratum)] if sizes else m for m in numbers]
    place = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in by], F.lit("sample")), F.lit(SPACE))
    drawn = rows.withColumn("_place", place).withColumn("_quota", numbers[0]).filter(F.col("_place") < numbers[1])
    order = Window.partitionBy(stratum).orderBy("_place", *by)
    drawn = drawn.withColumn("_rank", F.row_number().over(order)).filter("_rank <= _quota")
    return drawn.orderBy(stratum, "_rank").drop("_place", "_quota", "_rank")
