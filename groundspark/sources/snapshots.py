"""Versioned Parquet tables behind one log: nothing is overwritten while it is read.

A version is one small file that names all current tables. It is written whole under
another name and then renamed, so a reader sees either all of it or nothing, and a
writer that finds its number taken looks at what was written there: where that left
its own tables alone it takes the next number, else it raises SnapshotConflict.

Tables are whole (one folder, replaced as one) or keyed. A keyed table is dealt to
buckets by a hash of its key, and a batch adds one run: a folder with a file or more
for each bucket it has rows of. Readers keep the latest row of each key; rows of the
oldest run of a bucket, nearly all of a large table, only meet the keys of later runs.
When a bucket has ``TIER`` runs of one level they are merged to one of the next, so a
row is rewritten as often as the table grew ``TIER``-fold, and other buckets stay.
"""

from __future__ import annotations

import copy
import json
import re
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundspark.runtime import freed_shuffles, scratch_tables, without_keys, write_table

# Buckets of a keyed table, unless its first batch says otherwise.
BUCKETS = 64
# So many runs of one level in a bucket become one of the next level.
TIER = 4
# How runs are written: texts repeat much, and a file's filters take as much as its keys need, not a megabyte each.
RUN_OPTIONS = {"compression": "zstd", "parquet.bloom.filter.adaptive.enabled": "true"}
DELETED, BUCKET, AT = "_deleted", "_bucket", "_at"


class SnapshotConflict(RuntimeError):
    """Another writer changed the same rows since this one read them."""


@dataclass(frozen=True)
class Changes:
    """Rows of a batch, one a key; rows with ``_deleted`` true remove theirs.

    ``clustered`` sorts each run by the key, for readers that look up few keys. A table
    that is ``derived`` follows from others of the same batch: where those meet no other
    writer, it meets none.
    """

    rows: DataFrame
    key: tuple[str, ...]
    bucket_by: tuple[str, ...] = ()
    buckets: int = BUCKETS
    clustered: bool = False
    derived: bool = False


def _folder(spark: SparkSession, root: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/_log")
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, root: str) -> int:
    """The number of the newest version, 0 when there is none."""
    path, files = _folder(spark, root)
    names = [status.getPath().getName() for status in files.listStatus(path)] if files.exists(path) else []
    return max((int(found[1]) for name in names if (found := re.fullmatch(r"(\d+)\.json", name))), default=0)


def _entry(spark: SparkSession, root: str, version: int) -> dict:
    """What the file of one version says: ``tables``, and what the version ``changed``."""
    if version == 0:
        return {"tables": {}, "changed": {}}
    path, files = _folder(spark, root)
    stream = files.open(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, f"{version:012d}.json"))
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _publish(spark: SparkSession, root: str, version: int, entry: dict) -> bool:
    """Make ``entry`` the version's file; False when there is one already."""
    jvm = spark.sparkContext._jvm
    path, files = _folder(spark, root)
    final, whole = jvm.org.apache.hadoop.fs.Path(path, f"{version:012d}.json"), jvm.org.apache.hadoop.fs.Path(path, f".{uuid.uuid4().hex}")
    out = files.create(whole, False)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    try:
        if files.getScheme() == "file":
            # A rename would replace; a link is refused where there is a file.
            place = jvm.java.nio.file.Paths
            jvm.java.nio.file.Files.createLink(place.get(files.makeQualified(final).toUri()), place.get(files.makeQualified(whole).toUri()))
        else:
            kinds = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs.Options, "Rename"), 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), files.getConf()).rename(files.makeQualified(whole), files.makeQualified(final), kinds)
    except Exception as error:
        if files.exists(final):
            return False
        raise error
    finally:
        files.delete(whole, False)
    return True


def _overlap(mine: dict, theirs: dict) -> set[str]:
    """Tables that both change: whole ones, and keyed ones with a bucket in common."""
    return {n for n in mine.keys() & theirs.keys() if mine[n] is None or theirs[n] is None or set(mine[n]) & set(theirs[n])}


def commit(spark: SparkSession, root: str, base: int, changed: dict[str, list[int] | None], make: Callable[[dict], None]) -> int:
    """Write a version after ``base``: ``make`` edits the tables current at that time.

    ``changed`` names the tables, and of keyed ones the buckets, that the writer read
    and changed; a later version that touched them raises SnapshotConflict.
    """
    seen = base
    while True:
        now = current_version(spark, root)
        for version in range(seen + 1, now + 1):
            both = _overlap(changed, _entry(spark, root, version)["changed"])
            if both:
                raise SnapshotConflict(f"version {version} under {root} changed {', '.join(sorted(both))}")
        seen = now
        tables = copy.deepcopy(_entry(spark, root, now)["tables"])
        make(tables)
        if _publish(spark, root, now + 1, {"version": now + 1, "tables": tables, "changed": changed}):
            return now + 1


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """The current tables under ``root`` by name, or those of an earlier version; empty when none was written."""
    tables = _entry(spark, root, current_version(spark, root) if version is None else version)["tables"]
    return {name: _read(spark, table) for name, table in tables.items()}


def write_snapshot(
    spark: SparkSession, root: str, tables: dict[str, DataFrame], partition_by: dict[str, list[str]] | None = None, base: int | None = None
) -> dict[str, DataFrame]:
    """Write whole ``tables`` and make them current together; others keep their version.

    The log entry is the last write, so a batch that fails half-way changes nothing and
    can be run again. ``base`` is the version the tables were made from.
    """
    base = current_version(spark, root) if base is None else base
    written = {}
    for name, table in tables.items():
        path = f"{root}/v={base + 1}-{uuid.uuid4().hex}/{name}"
        writer = table.write
        if partition_by and name in partition_by:
            writer = writer.partitionBy(*partition_by[name])
        with freed_shuffles(spark):
            writer.parquet(path)
        written[name] = {"path": path}
    commit(spark, root, base, dict.fromkeys(written), lambda current: current.update(written))
    return read_snapshot(spark, root)


# Keyed tables


def bucket_of(columns: Iterable[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


@scratch_tables()
def _write_run(spark: SparkSession, rows: DataFrame, table: dict, path: str) -> list[int]:
    """Write one run; returns the buckets it has. Large buckets become several files."""
    placed = rows.withColumn(BUCKET, bucket_of(table["bucket_by"], table["buckets"]))
    order = [BUCKET, *table["key"]]
    if table["clustered"]:
        placed = write_table(placed, "run-rows")  # Ranges are drawn from the rows, which are then read again.
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order) if table["clustered"] else placed.hint("rebalance", BUCKET)
    writer = placed.write.partitionBy(BUCKET).options(**RUN_OPTIONS)
    for column in table["key"]:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.candidates.number#{column}", "10")
    with freed_shuffles(spark):
        writer.parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{BUCKET}="))


def _runs(spark: SparkSession, table: dict, places: dict[tuple[str, int], list[int]]) -> DataFrame | None:
    """Rows of some buckets of some runs; ``_at`` is the place of the run in its bucket."""
    schema = T.StructType.fromJson(table["schema"]).add(BUCKET, T.IntegerType())
    found = None
    for (run, at), buckets in sorted(places.items()):
        rows = spark.read.schema(schema).parquet(table["paths"][run]).filter(F.col(BUCKET).isin(buckets)).withColumn(AT, F.lit(at))
        found = rows if found is None else found.unionByName(rows)
    return found


def _merged(old: DataFrame | None, later: DataFrame | None, key: list[str]) -> DataFrame:
    """The latest row of each key: ``old`` rows have one a key and are older than all ``later`` ones."""
    if later is None:
        return old
    newest = later.groupBy(*key).agg(F.max(AT).alias(AT))
    fresh = later.join(newest, [*key, AT], "left_semi")
    return fresh if old is None else without_keys(old, newest, key).unionByName(fresh)


def _read(spark: SparkSession, table: dict, buckets: Iterable[int] | None = None) -> DataFrame:
    if "path" in table:
        return spark.read.parquet(table["path"])
    wanted = None if buckets is None else set(buckets)
    first, later = defaultdict(list), defaultdict(list)
    for bucket, runs in table["held"].items():
        if wanted is None or int(bucket) in wanted:
            for at, (run, _) in enumerate(runs):
                (later if at else first)[run, at].append(int(bucket))
    old = _runs(spark, table, first)
    if old is None:
        return spark.createDataFrame([], T.StructType.fromJson(table["schema"])).drop(DELETED)
    return _merged(old, _runs(spark, table, later), table["key"]).filter(~F.col(DELETED)).drop(DELETED, BUCKET, AT)


def touched_buckets(spark: SparkSession, root: str, version: int, name: str, keys: DataFrame) -> list[int]:
    """Buckets of a keyed table that ``keys`` fall into; as many numbers as it has buckets at most."""
    table = _entry(spark, root, version)["tables"].get(name)
    if table is None:
        return []
    place = bucket_of(table["bucket_by"], table["buckets"])
    return sorted(r["b"] for r in keys.select(place.alias("b")).distinct().collect())


def read_buckets(spark: SparkSession, root: str, version: int, name: str, buckets: list[int]) -> DataFrame | None:
    """The rows of some buckets of a keyed table; files of others are not read. None if there is no such table."""
    table = _entry(spark, root, version)["tables"].get(name)
    return None if table is None else _read(spark, table, buckets)


def apply_changes(spark: SparkSession, root: str, changes: dict[str, Changes], base: int) -> int:
    """Add one run to each of several keyed tables and make them current together.

    Only the buckets that have changed rows are written. ``base`` is the version the
    changes were made from.
    """
    current, added, changed, met = _entry(spark, root, base)["tables"], {}, {}, {}
    for name, change in changes.items():
        rows = change.rows if DELETED in change.rows.columns else change.rows.withColumn(DELETED, F.lit(False))
        table = current.get(name) or {
            "key": list(change.key), "bucket_by": list(change.bucket_by or change.key), "buckets": change.buckets, "clustered": change.clustered,
            "schema": T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema]).jsonValue(), "paths": {}, "held": {},
        }
        rows = rows.select(*[f["name"] for f in table["schema"]["fields"]])
        run = uuid.uuid4().hex
        path = f"{root}/{name}/run-{run}"
        changed[name] = _write_run(spark, rows, table, path)
        met[name] = [] if change.derived else changed[name]
        added[name] = (table, run, path)

    def make(tables: dict) -> None:
        for name, (table, run, path) in added.items():
            own = tables.setdefault(name, copy.deepcopy(table))
            own["paths"][run] = path
            for bucket in changed[name]:
                own["held"].setdefault(str(bucket), []).append([run, 0])

    version = commit(spark, root, base, met, make)
    for name in changes:
        try:
            compact(spark, root, name)
        except SnapshotConflict:
            pass  # The next batch finds the same runs due.
    return version


def due_runs(table: dict) -> dict[int, list[str]]:
    """Buckets with ``TIER`` or more newest runs of one level, and these runs, oldest first."""
    found = {}
    for bucket, runs in table["held"].items():
        level = runs[-1][1]
        same = [run for run, own in runs if own == level]
        if len(same) >= TIER:
            found[int(bucket)] = same
    return found


def compact(spark: SparkSession, root: str, name: str) -> int:
    """Merge runs where they are due, level by level; returns how many buckets were written."""
    written = 0
    while True:
        base = current_version(spark, root)
        table = _entry(spark, root, base)["tables"][name]
        due = due_runs(table)
        if not due:
            return written
        places, whole = defaultdict(list), []
        for bucket, runs in due.items():
            held = [run for run, _ in table["held"][str(bucket)]]
            if held[0] == runs[0]:
                whole.append(bucket)
            for run in runs:
                places[run, held.index(run)].append(bucket)
        rows = _merged(None, _runs(spark, table, places), table["key"])
        # A removal is done with when nothing older is left in its bucket.
        rows = rows.filter(~(F.col(DELETED) & F.col(BUCKET).isin(whole))) if whole else rows
        run = uuid.uuid4().hex
        path = f"{root}/{name}/run-{run}"
        left = set(_write_run(spark, rows.drop(AT, BUCKET), table, path))

        def make(tables: dict) -> None:
            own = tables[name]
            own["paths"][run] = path
            for bucket, merged in due.items():
                held = own["held"][str(bucket)]
                at = [r for r, _ in held].index(merged[0])
                level = held[at][1] + 1
                own["held"][str(bucket)] = held[:at] + ([[run, level]] if bucket in left else []) + held[at + len(merged) :]
                if not own["held"][str(bucket)]:
                    del own["held"][str(bucket)]
            used = {r for runs in own["held"].values() for r, _ in runs}
            own["paths"] = {r: p for r, p in own["paths"].items() if r in used}

        commit(spark, root, base, {name: sorted(due)}, make)
        written += len(due)


def write_report(lines: DataFrame, path: str) -> None:
    """Write (section, position, line) rows as text; the part files follow in order."""
    lines.orderBy("section", "position").select("line").write.mode("overwrite").text(path)
