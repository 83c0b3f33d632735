"""Labelled question sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTIONS = (
    "questions array<struct<id: string, question: string, expect_answerable: boolean, "
    "relevant_source_identifiers: array<string>, ground_truth_basis: string>>"
)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(id, question, expect_answerable, relevant_source_identifiers, ground_truth_basis); fails on a broken file."""
    return (
        spark.read.schema(QUESTIONS).option("multiLine", True).option("mode", "FAILFAST").json(path)
        .select(F.inline("questions"))
        .withColumn("ground_truth_basis", F.coalesce("ground_truth_basis", F.lit("")))
        .withColumn(
            "relevant_source_identifiers",
            F.coalesce("relevant_source_identifiers", F.array().cast("array<string>")),
        )
    )
