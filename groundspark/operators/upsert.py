"""Keyed upserts by content hash, as if records were applied one after the other."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundspark.functions.text import sha256_hex
from groundspark.runtime import narrow, skew_join, without_keys, write_table

# Arrivals of one key are compared in steps of this many sequence numbers.
SEQUENCE_STEP = 1_000_000


@dataclass(frozen=True)
class Upsert:
    """``actions``: one row per arrival; ``changed``: arrivals written; ``written``: rows that
    replace or join those of the table, one a key; ``snapshot``: the new table."""

    actions: DataFrame
    changed: DataFrame
    snapshot: DataFrame
    written: DataFrame


def split_keyless(records: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(records with a key, rejected records without one)."""
    has_key = F.coalesce(F.col(key), F.lit("")) != ""
    return records.filter(has_key), records.filter(~has_key)


def dedup_action(existing_hash: Column, new_hash: Column) -> Column:
    return (
        F.when(existing_hash.isNull(), "new").when(existing_hash == new_hash, "unchanged").otherwise("updated")
    )


def classify(arrivals: DataFrame, existing: DataFrame | None, key: str, step: int = SEQUENCE_STEP) -> DataFrame:
    """(key, seq, action): each arrival against the record of its key before it.

    ``seq`` is a unique bigint in arrival order. Arrivals of one key are compared
    within steps of ``seq``; the last hash of each step is carried to the next
    over one row per step, so a key holding most of the batch still spreads.
    """
    slim = arrivals.select(key, "seq", "content_hash", F.expr(f"seq div {step}").alias("_step"))
    within = slim.withColumn("_previous", F.lag("content_hash").over(Window.partitionBy(key, "_step").orderBy("seq")))
    lasts = slim.groupBy(key, "_step").agg(F.max_by("content_hash", "seq").alias("_last"))
    carried = lasts.withColumn("_carried", F.lag("_last").over(Window.partitionBy(key).orderBy("_step"))).drop("_last")
    if existing is not None:
        stored = narrow(existing.select(key, F.col("content_hash").alias("_stored")), arrivals, key)
        carried = carried.join(stored, key, "left").withColumn("_carried", F.coalesce("_carried", "_stored"))
    joined = within.join(carried.select(key, "_step", "_carried"), [key, "_step"])
    before = F.coalesce("_previous", "_carried")
    return joined.select(key, "seq", dedup_action(before, F.col("content_hash")).alias("action"))


def upsert(
    arrivals: DataFrame, existing: DataFrame | None, key: str, now: Column | None = None, finish: Callable[[DataFrame], DataFrame] = lambda rows: rows
) -> Upsert:
    """Apply a batch: unchanged arrivals write nothing, the last change of a key wins.

    ``finish`` adds what only rows that are written need.

    All decisions are made on slim rows and written out; they then select the
    arrivals to write, which are read once. Rows of ``existing`` that are not
    replaced pass through by an anti join, which moves none of them when the
    batch is small.
    """
    actions = write_table(classify(arrivals, existing, key), "actions")
    changes = actions.filter(F.col("action") != "unchanged").select(key, "seq")
    changed = arrivals.join(changes, [key, "seq"], "left_semi")
    last = write_table(changes.groupBy(key).agg(F.max("seq").alias("seq")), "last-changes")
    now = now if now is not None else F.current_timestamp()
    if existing is None:
        written = finish(arrivals.join(last, [key, "seq"], "left_semi").drop("seq")).withColumn("created_at", now).withColumn("updated_at", now)
        return Upsert(actions, changed, written, written)
    # Creation times of replaced rows meet the slim decisions, not the rows.
    created = narrow(existing.select(key, F.col("created_at").alias("_created")), last, key)
    written = finish(arrivals.join(last.join(created, key, "left"), [key, "seq"]).drop("seq")).withColumn("created_at", F.coalesce("_created", now)).withColumn("updated_at", now).drop("_created")
    return Upsert(actions, changed, without_keys(existing, last, key).select(*written.columns).unionByName(written), written)


def action_counts(actions: DataFrame) -> DataFrame:
    names = ("new", "updated", "unchanged")
    return actions.agg(*[F.count_if(F.col("action") == name).alias(name) for name in names])


def last_hashes(arrivals: DataFrame, key: str) -> DataFrame:
    """(source_id, content_hash): the hash each key ends with in a batch."""
    return arrivals.groupBy(F.col(key).alias("source_id")).agg(F.max_by("content_hash", "seq").alias("content_hash"))


def hash_collisions(hashes: DataFrame) -> DataFrame:
    """(content_hash, n_ids, source_id) for contents held by two or more ids.

    One row per id instead of a list: a group of copies may be any size.
    """
    shared = hashes.groupBy("content_hash").agg(F.count("*").alias("n_ids")).filter("n_ids > 1")
    return skew_join(hashes, shared, "content_hash", "inner", ["source_id"]).select("content_hash", "n_ids", "source_id")


def resolve_linked_trials(publications: DataFrame, trials: DataFrame) -> DataFrame:
    """(pmid, linked_trial_id) for publications naming exactly one known trial."""
    named = publications.select("pmid", F.explode(F.array_distinct("linked_nct_ids")).alias("nct_id"))
    known = skew_join(named, trials.select("nct_id"), "nct_id", "inner", ["pmid"])
    return (
        known.groupBy("pmid")
        .agg(F.count("*").alias("n"), F.min("nct_id").alias("linked_trial_id"))
        .filter("n = 1")
        .drop("n")
    )


def link_publications(publications: DataFrame, trials: DataFrame) -> DataFrame:
    """Publications, one a pmid, with ``linked_trial_id`` resolved against the trials now stored."""
    links = resolve_linked_trials(publications.drop("linked_trial_id"), trials)
    return publications.drop("linked_trial_id").join(links, "pmid", "left")


def document_rows(source_type: str, key: Column, source_url: Column, title: Column, text: Column) -> list[Column]:
    """Columns of the document of one source record; its hash covers key and text only."""
    return [
        F.concat(F.lit(f"{source_type}:"), key).alias("document_id"),
        F.lit(source_type).alias("source_type"),
        key.alias("source_identifier"),
        source_url.alias("source_url"),
        title.alias("title"),
        text.alias("text"),
        sha256_hex(F.concat(key, F.lit(":"), text)).alias("content_hash"),
    ]
