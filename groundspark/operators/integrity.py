"""Constraint checks over the evidence tables, and cascading deletes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundspark.runtime import narrow, skew_join


def _key_text(keys: list[str]) -> Column:
    return F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key")


def duplicates(rows: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """(rule, key, n) for keys held by more than one row; nulls are not compared."""
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    counted = rows.filter(present).groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    return counted.select(F.lit(rule).alias("rule"), _key_text(keys), "n")


def failing(rows: DataFrame, condition: Column, keys: list[str], rule: str) -> DataFrame:
    """(rule, key, n) for rows where ``condition`` is not true."""
    broken = rows.filter(~F.coalesce(condition, F.lit(False)))
    return broken.select(F.lit(rule).alias("rule"), _key_text(keys), F.lit(1).cast("bigint").alias("n"))


def orphans(child: DataFrame, foreign_key: str, parent: DataFrame, primary_key: str, rule: str) -> DataFrame:
    """(rule, key, n) for foreign keys without a parent; counted before the join."""
    used = child.filter(F.col(foreign_key).isNotNull()).groupBy(F.col(foreign_key).alias("_key")).agg(F.count("*").alias("n"))
    missing = used.join(narrow(parent.select(F.col(primary_key).alias("_key")), used, "_key"), "_key", "left_anti")
    return missing.select(F.lit(rule).alias("rule"), F.col("_key").cast("string").alias("key"), "n")


def violations(
    trials: DataFrame, publications: DataFrame, documents: DataFrame, chunks: DataFrame, citations: DataFrame, touched: dict[str, DataFrame] | None = None
) -> DataFrame:
    """Every broken rule of the evidence tables as (rule, key, n).

    ``touched`` gives, by table name, the rows that a change put in, replaced or removed;
    then only what these rows can have broken is checked: rows that share a value under
    a rule with one of them. Where the tables kept all rules before the change, that is
    everything. Few such values are broadcast and the tables scanned for them, key
    columns only.
    """

    def near(rows: DataFrame, column: Column, *values: tuple[str, Column]) -> DataFrame:
        if touched is None:
            return rows
        found = [touched[name].select(value.cast("string").alias("_value")) for name, value in values if name in touched]
        if not found:
            return rows.limit(0)
        wanted = reduce(DataFrame.unionByName, found).filter(F.col("_value").isNotNull()).distinct()
        placed = rows.withColumn("_value", column.cast("string"))
        return narrow(placed, wanted, "_value").join(wanted, "_value", "left_semi").drop("_value")

    document, chunk_id = F.col("document_id"), F.concat_ws(":", "document_id", "chunk_index")
    trial, publication, doi, link = F.col("trial_id"), F.col("publication_id"), F.col("doi"), F.col("linked_trial_id")
    nct_id, pmid, cited = F.col("nct_id"), F.col("pmid"), F.col("chunk_id")
    trial_documents = documents.filter(F.col("source_type") == "trial")
    publication_documents = documents.filter(F.col("source_type") == "publication")
    own_documents, own_chunks = near(documents, document, ("documents", document)), near(chunks, document, ("chunks", document))
    excerpt = ["excerpt_char_start", "excerpt_char_end"]
    whole = F.col(excerpt[0]).isNull() | F.col(excerpt[1]).isNull() | (F.col(excerpt[1]) > F.col(excerpt[0]))
    one_source = F.when(F.col("source_type") == "trial", trial.isNotNull() & publication.isNull()).when(
        F.col("source_type") == "publication", publication.isNotNull() & trial.isNull()
    )
    return reduce(
        DataFrame.unionByName,
        [
            duplicates(near(trials, nct_id, ("trials", nct_id)), ["nct_id"], "trial_key_unique"),
            duplicates(near(publications, pmid, ("publications", pmid)), ["pmid"], "publication_key_unique"),
            duplicates(near(publications, doi, ("publications", doi)), ["doi"], "doi_unique"),
            failing(own_documents, F.col("source_type").isin("trial", "publication"), ["document_id"], "source_type_known"),
            failing(own_documents, one_source, ["document_id"], "document_one_source"),
            duplicates(near(trial_documents, trial, ("documents", trial)), ["trial_id"], "one_document_per_trial"),
            duplicates(near(publication_documents, publication, ("documents", publication)), ["publication_id"], "one_document_per_publication"),
            orphans(near(trial_documents, trial, ("documents", trial), ("trials", nct_id)), "trial_id", trials, "nct_id", "document_trial_exists"),
            orphans(near(publication_documents, publication, ("documents", publication), ("publications", pmid)), "publication_id", publications, "pmid", "document_publication_exists"),
            orphans(near(publications, link, ("publications", link), ("trials", nct_id)), "linked_trial_id", trials, "nct_id", "linked_trial_exists"),
            duplicates(own_chunks, ["document_id", "chunk_index"], "chunk_unique"),
            failing(own_chunks, F.col("char_end") > F.col("char_start"), ["document_id", "chunk_index"], "chunk_range"),
            orphans(near(chunks, document, ("chunks", document), ("documents", document)), "document_id", documents, "document_id", "chunk_document_exists"),
            orphans(near(citations, cited, ("citations", cited), ("chunks", chunk_id)), "chunk_id", chunks.select(chunk_id.alias("chunk_id")), "chunk_id", "citation_chunk_exists"),
            failing(near(citations, cited, ("citations", cited)), whole, ["chunk_id"], "citation_range"),
        ],
    )


def cascade_delete(
    deleted: DataFrame, documents: DataFrame, chunks: DataFrame, citations: DataFrame, publications: DataFrame
) -> dict[str, DataFrame]:
    """Tables left after deleting sources given as (source_type, source_identifier).

    Documents, chunks and citations of a deleted source go; publications linked
    to a deleted trial stay and lose the link.
    """
    source = ["source_type", "source_identifier"]
    gone = deleted.select(*source).distinct()
    dead = documents.join(gone, source, "left_semi").select("document_id")
    gone_trials = gone.filter(F.col("source_type") == "trial").select(F.col("source_identifier").alias("linked_trial_id"))
    gone_publications = gone.filter(F.col("source_type") == "publication").select(F.col("source_identifier").alias("pmid"))
    kept = publications.join(gone_publications, "pmid", "left_anti")
    unlinked = skew_join(kept, gone_trials.withColumn("_gone", F.lit(True)), "linked_trial_id", "left", ["pmid"], slim_right=True)
    link = F.when(F.col("_gone").isNull(), F.col("linked_trial_id"))
    return {
        "publications": unlinked.withColumn("linked_trial_id", link).select(*publications.columns),
        "documents": documents.join(gone, source, "left_anti").select(*documents.columns),
        "chunks": skew_join(chunks, dead, "document_id", "left_anti", ["chunk_index"], slim_right=True).select(*chunks.columns),
        "citations": skew_join(citations, dead, "document_id", "left_anti", ["query_id", "citation_index"], slim_right=True).select(*citations.columns),
    }
