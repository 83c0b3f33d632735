"""Spark plumbing shared by the operators: shared storage, size checks, skew."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A side is broadcast only when its text was measured to be below this.
BROADCAST_BYTES = 64 * 1024 * 1024
# Likewise for tables of keys alone.
BROADCAST_KEYS = 500_000
# Python tasks turn so many bytes of a batch into objects at once.
SLICE_BYTES = 4 << 20
# Spark's setting (since 4.1) by which a query removes the files of its shuffles when it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Tables written since ``scratch_tables`` began.
_SCRATCH: contextvars.ContextVar[list[tuple[SparkSession, str]] | None] = contextvars.ContextVar("scratch", default=None)


def in_slices(batches: Iterable[pa.Array], limit_bytes: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """The rows of all batches in parts of about ``limit_bytes``, one row at least.

    Arrow's unused memory is given back after each batch; what a task holds then does
    not follow the length of Spark's batches.
    """
    for batch in batches:
        rows = max(1, len(batch) * limit_bytes // max(1, batch.nbytes))
        for start in range(0, len(batch), rows):
            yield batch.slice(start, rows)
        pa.default_memory_pool().release_unused()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries run here remove their shuffle files at once, instead of when the driver happens to collect its garbage.

    For results that are written: a frame kept in use would have to shuffle again.
    """
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


@contextlib.contextmanager
def scratch_tables() -> Iterator[None]:
    """Tables that ``write_table`` writes here are removed at the end, and compressed as texts of whole batches need it.

    For work that leaves its result elsewhere: nothing read afterwards may come from these tables.
    """
    tables: list[tuple[SparkSession, str]] = []
    outer = _SCRATCH.set(tables)
    try:
        yield
    finally:
        _SCRATCH.reset(outer)
        for spark, path in tables:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def write_table(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` under a fresh path of the shared folder and read it back.

    Readers get a plan that starts at the files, so column pruning works and a
    lost executor costs a re-read instead of the whole lineage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    held = _SCRATCH.get()
    if held is not None:
        held.append((spark, path))
        writer = writer.option("compression", "zstd")
    with freed_shuffles(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_input(df: DataFrame, key: str) -> DataFrame:
    """Spread a table of fewer files than cores, so that costly row work uses them all.

    Larger tables are returned as they are: their own splits are enough.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if len(df.inputFiles()) < cores else df


def text_fits_broadcast(df: DataFrame, column: str, limit_bytes: int = BROADCAST_BYTES) -> bool:
    """True when all values of ``column`` together stay below ``limit_bytes``."""
    total = df.agg(F.sum(F.octet_length(F.col(column)) + 64).alias("n")).first()["n"]
    return (total or 0) <= limit_bytes


def rows_fit(df: DataFrame, limit_rows: int) -> bool:
    """True when ``df`` has at most ``limit_rows`` rows; stops counting there."""
    return df.limit(limit_rows + 1).count() <= limit_rows


def frequent_values(df: DataFrame, key: str, support: float = 1e-3) -> DataFrame:
    """Every value held by more than ``support`` of the rows (at most 1/support values)."""
    found = f"{key}_freqItems"
    return (
        df.select(key).stat.freqItems([key], support)
        .select(F.explode(found).alias(key))
        .filter(F.col(key).isNotNull())
    )


def narrow(rows: DataFrame, keys: DataFrame, key: str, limit_rows: int = BROADCAST_KEYS) -> DataFrame:
    """``rows`` whose key is in ``keys`` when those are counted as few, else all rows.

    A small batch then meets a large table by a broadcast, and the table is
    scanned without being shuffled. Callers still join on the key.
    """
    wanted = keys.select(key).distinct()
    return rows.join(F.broadcast(wanted), key, "left_semi") if rows_fit(wanted, limit_rows) else rows


def without_keys(rows: DataFrame, keys: DataFrame, key: str | list[str], limit_rows: int = BROADCAST_KEYS) -> DataFrame:
    """``rows`` whose key is not in ``keys``; few keys are broadcast, more are shuffled."""
    wanted = keys.select(*([key] if isinstance(key, str) else key)).distinct()
    return rows.join(F.broadcast(wanted) if rows_fit(wanted, limit_rows) else wanted, key, "left_anti")


def running_starts(rows: DataFrame, order: list[str], amount: str, name: str = "starts") -> DataFrame:
    """``rows`` with ``start``: the sum of ``amount`` over all rows before each in the given order.

    Rows are dealt by ranges of the order and summed inside each part; only one total
    a part, as many as tasks, is summed in one place. ``rows`` should be slim.
    """
    dealt = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    dealt = write_table(dealt, name)
    parts = dealt.groupBy("_part").agg(F.sum(amount).alias("_total"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return summed.join(F.broadcast(parts), "_part").withColumn("start", F.col("_before") + F.col("_inside")).drop("_part", "_before", "_inside")


def skew_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str,
    spread_by: list[str],
    spread: int | None = None,
    support: float = 1e-3,
    slim_right: bool = False,
) -> DataFrame:
    """Equi-join whose hot left keys are spread over ``spread`` sub-keys.

    The hot keys are at most ``1/support`` values, so their list is broadcast;
    only their right rows are repeated. ``spread_by`` names left columns that
    differ between rows of one key; their hash is the sub-key, which stays the
    same when a task is run again. Keys that are null match nothing and are
    spread as well. By default a hot key is spread over as many sub-keys as the
    session has shuffle partitions. ``slim_right`` says that right rows are
    little more than keys: when counted as few they are broadcast instead.
    """
    if slim_right and rows_fit(right, BROADCAST_KEYS):
        return left.join(F.broadcast(right), key, how)
    if spread is None:
        spread = max(256, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hot = F.broadcast(frequent_values(left, key, support).withColumn("_hot", F.lit(True)))
    sub_key = F.pmod(F.xxhash64(*[F.col(c) for c in spread_by]), F.lit(spread)).cast("int")
    salted_left = left.join(hot, key, "left").withColumn(
        "_salt", F.when(F.col("_hot") | F.col(key).isNull(), sub_key).otherwise(F.lit(0))
    ).drop("_hot")
    salted_right = right.join(hot, key, "left").withColumn(
        "_salt",
        F.explode(
            F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(spread - 1))).otherwise(F.array(F.lit(0)))
        ),
    ).drop("_hot")
    return salted_left.join(salted_right, [key, "_salt"], how).drop("_salt")

