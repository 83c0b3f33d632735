"""Retrieval and citation metrics over ordered identifier lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundspark import settings
from groundspark.functions.text import strip
from groundspark.runtime import skew_join


def document_order(hits: DataFrame) -> DataFrame:
    """(query_id, place, source_identifier): each document once, at its best rank."""
    best = hits.groupBy("query_id", "source_identifier").agg(F.min("rank").alias("best"))
    order = Window.partitionBy("query_id").orderBy("best")
    return best.select("query_id", F.row_number().over(order).alias("place"), "source_identifier")


def ordered_list(rows: DataFrame, place: str, value: str, name: str) -> DataFrame:
    """(query_id, name): values of each question in the order of ``place``."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(place).alias("place"), F.col(value).alias("value"))))
    return rows.groupBy("query_id").agg(F.transform(pairs, lambda p: p["value"]).alias(name))


def _share(found: Column, wanted: Column, total: Column) -> Column:
    return F.size(F.array_intersect(found, wanted)) / F.size(F.array_distinct(total))


def recall_at_k(retrieved: Column, relevant: Column, k: int) -> Column:
    """Share of the truth among the first ``k``; nothing to find counts as 1."""
    if k < 0:
        raise ValueError("k must not be negative")
    head = F.slice(retrieved, 1, k)
    return F.when(F.size(relevant) == 0, F.lit(1.0)).otherwise(_share(head, relevant, relevant))


def reciprocal_rank(retrieved: Column, relevant: Column) -> Column:
    places = F.filter(F.transform(relevant, lambda r: F.array_position(retrieved, r)), lambda p: p > 0)
    return F.coalesce(F.lit(1.0) / F.array_min(places), F.lit(0.0))


def citation_correctness(cited: Column, relevant: Column) -> Column:
    """Precision of the cited; citing nothing is right only when nothing is relevant."""
    nothing = F.when(F.size(relevant) == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(F.size(cited) == 0, nothing).otherwise(_share(cited, relevant, cited))


def citation_completeness(cited: Column, relevant: Column) -> Column:
    return F.when(F.size(relevant) == 0, F.lit(1.0)).otherwise(_share(cited, relevant, relevant))


def mean_or_error(value: Column, name: str) -> Column:
    """Aggregate mean that fails on no rows instead of giving a score."""
    problem = F.raise_error(F.lit(f"{name} needs at least one row")).cast("double")
    return F.when(F.count(F.lit(1)) == 0, problem).otherwise(F.avg(value))


def mean_recall_at_k(rows: DataFrame, k: int) -> DataFrame:
    return rows.agg(mean_or_error(recall_at_k(F.col("retrieved"), F.col("relevant"), k), "mean recall").alias("mean_recall"))


def mean_reciprocal_rank(rows: DataFrame) -> DataFrame:
    return rows.agg(mean_or_error(reciprocal_rank(F.col("retrieved"), F.col("relevant")), "mean reciprocal rank").alias("mrr"))


def abstention_accuracy(predictions: DataFrame) -> DataFrame:
    """Share of (expected, answered) pairs that agree."""
    agree = (F.col("expected") == F.col("answered")).cast("double")
    return predictions.agg(mean_or_error(agree, "abstention accuracy").alias("accuracy"))


def confusion_columns(expected: Column, answered: Column) -> list[Column]:
    """Aggregates: the four counts, positive meaning "answered"."""
    return [
        F.count_if(expected & answered).alias("true_positive"),
        F.count_if(~expected & answered).alias("false_positive"),
        F.count_if(~expected & ~answered).alias("true_negative"),
        F.count_if(expected & ~answered).alias("false_negative"),
    ]


def confusion_counts(predictions: DataFrame) -> DataFrame:
    counted = predictions.agg(*confusion_columns(F.col("expected"), F.col("answered")))
    right = F.col("true_positive") + F.col("true_negative")
    total = right + F.col("false_positive") + F.col("false_negative")
    return counted.withColumn("total", total).withColumn("accuracy", F.try_divide(right, F.col("total")))


def truth_rows(questions: DataFrame) -> DataFrame:
    """(id, source_identifier) of questions that carry their truth as a list."""
    return questions.select("id", F.explode(F.array_distinct("relevant_source_identifiers")).alias("source_identifier"))


def question_problems(
    questions: DataFrame,
    truth: DataFrame,
    documents: DataFrame,
    expected: tuple[int, int, int] | None = settings.EXPECTED_QUESTIONS,
) -> DataFrame:
    """(question_id, problem, detail) for every fault of a labelled question set.

    Questions are (id, question, expect_answerable), truth is (id, source_identifier).
    Without ``expected`` their numbers are not checked; all other rules always are.
    """
    answerable = F.col("expect_answerable")
    counted = truth.groupBy("id").agg(F.count("*").alias("n_truth"))
    with_truth = questions.join(counted, "id", "left").withColumn("has_truth", F.col("n_truth").isNotNull())

    def where(rows: DataFrame, condition: Column, problem: str) -> DataFrame:
        return rows.filter(condition).select("id", F.lit(problem).alias("problem"), F.lit("").alias("detail"))

    repeated = questions.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(
        "id", F.lit("duplicate_id").alias("problem"), F.col("n").cast("string").alias("detail")
    )
    used = truth.select("source_identifier").distinct()
    unknown_ids = used.join(documents.select("source_identifier").distinct(), "source_identifier", "left_anti")
    unknown = skew_join(truth, unknown_ids, "source_identifier", "inner", ["id"]).select(
        "id", F.lit("unknown_identifier").alias("problem"), F.col("source_identifier").alias("detail")
    )
    totals = questions.agg(
        F.count("*").alias("total"), F.count_if(answerable).alias("answerable"), F.count_if(~answerable).alias("traps")
    )
    rows = [
        F.struct(F.lit(name).alias("name"), F.col(name).alias("found"), F.lit(wanted).cast("bigint").alias("wanted"))
        for name, wanted in zip(("total", "answerable", "traps"), expected or (0, 0, 0))
    ]
    counts = totals.select(F.inline(F.array(*rows))).filter("found <> wanted").select(
        F.lit(None).cast("string").alias("id"),
        F.concat(F.lit("count_"), F.col("name")).alias("problem"),
        F.concat_ws("/", "found", "wanted").alias("detail"),
    )
    parts = [
        repeated,
        where(questions, strip(F.col("question")) == "", "blank_question"),
        where(with_truth, answerable & ~F.col("has_truth"), "answerable_without_truth"),
        where(with_truth, ~answerable & F.col("has_truth"), "trap_with_truth"),
        unknown,
        *([counts] if expected else []),
    ]
    texts = [part.withColumn("id", F.col("id").cast("string")) for part in parts]
    return reduce(DataFrame.unionByName, texts).withColumnRenamed("id", "question_id")
