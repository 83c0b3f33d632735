"""Incremental ingest: new landed pages flow through the batch steps unchanged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from groundspark.operators.chunking import CHUNK_KEY, chunk_documents, diff_chunks
from groundspark.operators.lexemes import postings
from groundspark.plans.ingest import Ingested, number_arrivals, upsert_publications, upsert_trials
from groundspark.plans.retrieval import enrich_chunks
from groundspark.runtime import narrow, scratch_tables, write_table
from groundspark.schemas import empty
from groundspark.sources.articles import ARRIVAL, ARTICLE_END, cut_articles, normalize_publications
from groundspark.sources.snapshots import DELETED, Changes, SnapshotConflict, apply_changes, current_version, read_buckets, touched_buckets
from groundspark.sources.studies import ARRIVAL as STUDY_ARRIVAL
from groundspark.sources.studies import normalize_trials, only_readable, read_study_pages, split_pages

# Columns of a stream of files, as Spark names them; only the path is read.
FILES = "path string, modificationTime timestamp, length long, content binary"


def refresh_index(documents: DataFrame, stored: DataFrame | None, enrich) -> DataFrame:
    """Changed chunks of re-chunked documents: created and updated ones, and removals of those gone.

    ``stored`` holds the chunks of these documents, at least.
    """
    fresh = chunk_documents(documents)
    if stored is None:
        return enrich(fresh).withColumn(DELETED, F.lit(False))
    current = narrow(stored, documents, "document_id").join(documents.select("document_id"), "document_id", "left_semi")
    diff = write_table(diff_chunks(fresh, current.select(*CHUNK_KEY, "content_hash")), "chunk-diff")
    changed = enrich(diff.filter(F.col("action").isin("created", "updated")).drop("action")).withColumn(DELETED, F.lit(False))
    gone = diff.filter(F.col("action") == "deleted").select(*CHUNK_KEY).withColumn(DELETED, F.lit(True))
    return changed.unionByName(gone, allowMissingColumns=True)


def changed_postings(renewed: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Changes of the inverted index that follow from changed chunks and the chunks they replace."""
    fresh = postings(renewed.filter(~F.col(DELETED))).withColumn(DELETED, F.lit(False))
    if stored is None:
        return fresh
    keys = renewed.select(*CHUNK_KEY)
    before = narrow(stored, keys, "document_id").join(keys, CHUNK_KEY, "left_semi")
    held = before.select(F.explode(F.array_distinct("lexemes")).alias("lexeme"), *CHUNK_KEY)
    gone = held.join(fresh.select("lexeme", *CHUNK_KEY), ["lexeme", *CHUNK_KEY], "left_anti").withColumn(DELETED, F.lit(True))
    return fresh.unionByName(gone, allowMissingColumns=True)


def store_batch(spark: SparkSession, root: str, base: int, name: str, key: str, done: Ingested, chunks: Callable[[DataFrame], DataFrame | None], config: str) -> None:
    """Re-index the documents a batch changed and make the changes of all its tables current together."""
    documents = write_table(done.documents.written, "documents")
    if documents.isEmpty() and done.records.written.isEmpty():
        return
    stored = chunks(documents)
    renewed = write_table(refresh_index(documents, stored, enrich_chunks(config=config)), "renewed-chunks")
    apply_changes(
        spark, root,
        {
            name: Changes(done.records.written, (key,)),
            "documents": Changes(documents, ("document_id",)),
            "chunks": Changes(renewed, tuple(CHUNK_KEY), ("document_id",)),
            # One run a batch: a segment of the index, sorted by lexeme, that later ones override.
            "postings": Changes(changed_postings(renewed, stored), ("lexeme", *CHUNK_KEY), buckets=1, clustered=True, derived=True),
        },
        base,
    )


def stored_rows(spark: SparkSession, root: str, base: int, name: str, keys: DataFrame) -> DataFrame | None:
    """Rows of the buckets that ``keys`` fall into, or None where the table is new."""
    return read_buckets(spark, root, base, name, touched_buckets(spark, root, base, name, keys))


@scratch_tables()
def apply_study_batch(pages: DataFrame, root: str, config: str = "english") -> None:
    """Upsert one batch of (page_file, value) study pages into the tables under ``root``.

    Only buckets that hold a key of the batch are read and written. A key is compared
    by hash, so running a batch again leaves the tables as they are. A page that cannot
    be read fails the batch; nothing of it is stored.
    """
    store_studies(only_readable(split_pages(pages)), root, config)


@scratch_tables()
def apply_study_files(files: DataFrame, root: str, config: str = "english") -> None:
    """``apply_study_batch`` of the files named by ``path``, large pages cut by byte ranges.

    The driver holds the names alone, at most as many as a batch may have files.
    """
    paths = [row["path"] for row in files.select("path").collect()]
    if paths:
        store_studies(read_study_pages(files.sparkSession, paths), root, config)


def store_studies(studies: DataFrame, root: str, config: str) -> None:
    """Upsert read studies (STUDY_ARRIVAL, study) into the tables under ``root``."""
    spark = studies.sparkSession
    base = current_version(spark, root)
    # Written before it is numbered: numbering reads its rows twice.
    normalized = number_arrivals(write_table(normalize_trials(studies, keep=tuple(STUDY_ARRIVAL)), "trial-batch"), STUDY_ARRIVAL).drop(*STUDY_ARRIVAL)
    ids = normalized.filter("nct_id <> ''").select("nct_id", F.concat(F.lit("trial:"), "nct_id").alias("document_id"))
    trials, documents = (stored_rows(spark, root, base, n, ids) for n in ("trials", "documents"))
    done = upsert_trials(normalized, trials, documents, F.current_timestamp())
    store_batch(spark, root, base, "trials", "nct_id", done, lambda d: stored_rows(spark, root, base, "chunks", d), config)


@scratch_tables()
def apply_article_batch(articles: DataFrame, root: str, config: str = "english") -> None:
    """Upsert one batch of (ARRIVAL, pmid, article_xml) rows; links use the trials stored so far."""
    spark = articles.sparkSession
    base = current_version(spark, root)
    normalized = number_arrivals(write_table(normalize_publications(articles, keep=tuple(ARRIVAL)), "publication-batch"), ARRIVAL).drop(*ARRIVAL)
    ids = normalized.select("pmid", F.concat(F.lit("publication:"), "pmid").alias("document_id"))
    publications, documents = (stored_rows(spark, root, base, n, ids) for n in ("publications", "documents"))
    named = normalized.select(F.explode("linked_nct_ids").alias("nct_id"))
    trials = stored_rows(spark, root, base, "trials", named)
    done = upsert_publications(normalized, publications, empty(spark, "trials") if trials is None else trials, documents, F.current_timestamp())
    store_batch(spark, root, base, "publications", "pmid", done, lambda d: stored_rows(spark, root, base, "chunks", d), config)


def until_stored(apply: Callable[[], None], tries: int = 20) -> None:
    """Run a batch, and again when another writer changed what it read; its upserts then start from the new tables."""
    for left in range(tries - 1, -1, -1):
        try:
            return apply()
        except SnapshotConflict:
            if not left:
                raise


def _run(rows: DataFrame, apply, root: str, checkpoint: str, config: str) -> StreamingQuery:
    return (
        rows.writeStream.foreachBatch(lambda batch, number: until_stored(lambda: apply(batch, root, config)))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_studies(spark: SparkSession, landing: str, root: str, checkpoint: str, config: str = "english", files_per_batch: int = 10_000) -> StreamingQuery:
    """Ingest every study page not seen before, then stop; start again at any time."""
    named = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_batch).load(landing)
    return _run(named.select("path"), apply_study_files, root, checkpoint, config)


def stream_articles(spark: SparkSession, landing: str, root: str, checkpoint: str, config: str = "english", files_per_batch: int = 10_000) -> StreamingQuery:
    """Ingest every article set not seen before, then stop; start again at any time."""
    pieces = spark.readStream.schema("value string").option("lineSep", ARTICLE_END).option("maxFilesPerTrigger", files_per_batch).text(landing)
    placed = pieces.select("value", F.col("_metadata.file_path").alias("page_file"), F.col("_metadata.file_block_start").alias("page_block"))
    return _run(placed, lambda batch, target, how: apply_article_batch(cut_articles(batch), target, how), root, checkpoint, config)
