"""Explicit schemas of the stored tables; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _table(required: str, optional: str) -> T.StructType:
    """Columns as DDL; the first group never holds nulls."""
    needed = [T.StructField(f.name, f.dataType, False) for f in T.StructType.fromDDL(required)]
    return T.StructType(needed + list(T.StructType.fromDDL(optional).fields))


def trials() -> T.StructType:
    outcomes = "array<struct<measure: string, description: string, timeFrame: string>>"
    return _table(
        "nct_id string, source_url string, brief_title string, overall_status string, raw_data string, content_hash string, "
        "created_at timestamp, updated_at timestamp",
        "official_title string, phase string, study_type string, conditions array<string>, intervention_names array<string>, "
        "sponsor_name string, enrollment_count int, start_date date, primary_completion_date date, completion_date date, "
        f"last_update_posted_date date, brief_summary string, detailed_description string, primary_outcomes {outcomes}, secondary_outcomes {outcomes}",
    )


def publications() -> T.StructType:
    return _table(
        "pmid string, source_url string, title string, raw_xml string, content_hash string, created_at timestamp, updated_at timestamp",
        "doi string, journal string, publication_date date, publication_year int, authors array<string>, abstract string, "
        "mesh_terms array<string>, linked_nct_ids array<string>, linked_trial_id string",
    )


def documents() -> T.StructType:
    return _table(
        "document_id string, source_type string, source_identifier string, source_url string, title string, text string, "
        "content_hash string, created_at timestamp, updated_at timestamp",
        "",
    )


def chunks() -> T.StructType:
    return _table(
        "document_id string, chunk_index int, text string, char_start int, char_end int, content_hash string",
        "vector array<int>, norm2 bigint, lexemes array<string>, positions array<int>",
    )


def citations() -> T.StructType:
    return _table(
        "query_id string, citation_index bigint, chunk_id string, document_id string, excerpt_text string, source_type string, "
        "source_identifier string, source_url string",
        "excerpt_char_start int, excerpt_char_end int",
    )


TABLES = {"trials": trials, "publications": publications, "documents": documents, "chunks": chunks, "citations": citations}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name]())


def conform(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with exactly the columns and types of a table; a null in a required column fails the job."""
    columns = []
    for field in TABLES[name]():
        value = F.col(field.name).cast(field.dataType)
        if not field.nullable:
            problem = F.raise_error(F.lit(f"{name}.{field.name} must not be null")).cast(field.dataType)
            value = F.coalesce(value, problem)
        columns.append(value.alias(field.name))
    return rows.select(*columns)
