"""Scoring of retrieval and answers over a whole labelled question table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundspark import settings
from groundspark.functions.text import fixed_point
from groundspark.operators.grounding import citation_rows, generate_answers
from groundspark.operators.metrics import confusion_columns, document_order, ordered_list, question_problems
from groundspark.plans.retrieval import Provider, search_modes
from groundspark.runtime import write_table

SCRIPTED_NOTE = "The responder was scripted, so citation figures show its rules, not a model."


def question_results(questions: DataFrame, truth: DataFrame, retrieved: DataFrame, cited: DataFrame, answers: DataFrame) -> DataFrame:
    """One row per question with its status and four metrics.

    questions (id, question, expect_answerable), truth (id, source_identifier),
    retrieved (query_id, place, source_identifier), cited (query_id,
    source_identifier), answers (query_id, status). Everything is counted, so a
    question may have any number of true documents. A metric is null where it
    has no meaning: recall and rank without truth, citations without an answer.
    ``retrieved`` and ``cited`` keep their sources in order; they are as long as the
    evidence at most. True sources may be any number and stay rows of ``truth``.
    """
    true = truth.select(F.col("id").alias("query_id"), "source_identifier").distinct().withColumn("_true", F.lit(True))
    pair = ["query_id", "source_identifier"]
    n_true = true.groupBy("query_id").agg(F.count("*").alias("n_true"))
    found = retrieved.join(true, pair).groupBy("query_id").agg(
        F.count_if(F.col("place") <= 5).alias("found_in_5"), F.min("place").alias("first_place")
    )
    citations = cited.select(*pair).distinct().join(true, pair, "left").groupBy("query_id").agg(
        F.count("*").alias("n_cited"), F.count("_true").alias("n_cited_true")
    )
    joined = (
        questions.select(F.col("id").alias("query_id"), "question", "expect_answerable")
        .join(answers.select("query_id", "status"), "query_id")
        .join(n_true, "query_id", "left")
        .join(found, "query_id", "left")
        .join(citations, "query_id", "left")
        .join(ordered_list(retrieved, "place", "source_identifier", "retrieved"), "query_id", "left")
        .join(ordered_list(cited, "place", "source_identifier", "cited"), "query_id", "left")
        .fillna(0, ["n_true", "found_in_5", "n_cited", "n_cited_true"])
    )
    n_true_, n_cited, n_right = F.col("n_true"), F.col("n_cited"), F.col("n_cited_true")
    answered = F.col("status") == "answered"
    nothing_cited = F.when(n_true_ == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return joined.select(
        F.col("query_id").alias("question_id"),
        "question",
        "expect_answerable",
        "status",
        "n_true",
        "n_cited",
        F.try_divide("found_in_5", "n_true").alias("recall_at_5"),
        F.when(n_true_ > 0, F.coalesce(F.lit(1.0) / F.col("first_place"), F.lit(0.0))).alias("reciprocal_rank"),
        F.when(answered, F.coalesce(F.try_divide(n_right, n_cited), nothing_cited)).alias("citation_correctness"),
        F.when(answered, F.coalesce(F.try_divide(n_right, n_true_), F.lit(1.0))).alias("citation_completeness"),
        F.coalesce("retrieved", F.array().cast("array<string>")).alias("retrieved"),
        F.coalesce("cited", F.array().cast("array<string>")).alias("cited"),
    )


def cited_identifiers(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query_id, place, source_identifier): distinct cited sources in citation order."""
    cited = citation_rows(answers, evidence).withColumn("rank", F.col("position"))
    return document_order(cited)


def check_questions(questions: DataFrame, truth: DataFrame, documents: DataFrame, expected: tuple[int, int, int] | None) -> None:
    """Raise with the first problems of the question set, if it has any; without ``expected`` it may have any size."""
    problems = write_table(question_problems(questions, truth, documents, expected), "question-problems")
    found = problems.limit(20).collect()
    if found:
        first = "; ".join(f"{r.question_id}: {r.problem} {r.detail}" for r in found)
        raise ValueError(f"question set has {problems.count()} problems, all in {problems.inputFiles()[0].rpartition('/')[0]}; first: {first}")


def run_evaluation(
    questions: DataFrame, truth: DataFrame, index: DataFrame, documents: DataFrame, mode: str = "hybrid", **options
) -> DataFrame:
    """Per-question results of one mode, for all questions in one job; options as for ``evaluate_modes``."""
    return evaluate_modes(questions, truth, index, documents, (mode,), **options).drop("mode")


def evaluate_modes(
    questions: DataFrame,
    truth: DataFrame,
    index: DataFrame,
    documents: DataFrame,
    modes: tuple[str, ...] = settings.MODES,
    texts: DataFrame | None = None,
    provider: Provider | None = None,
    config: str = "english",
    expected: tuple[int, int, int] | None = settings.EXPECTED_QUESTIONS,
    postings: DataFrame | None = None,
) -> DataFrame:
    """Per-question results of several retrieval modes, with a ``mode`` column.

    The question set is checked once, each ranking made once, and the evidence of all
    modes loaded and written once. ``postings`` is the inverted index to search by.
    """
    check_questions(questions, truth, documents, expected)
    asked = questions.select(F.col("id").alias("query_id"), F.col("question").alias("text"))
    hits = search_modes(asked, index, documents, modes, settings.ANSWER_TOP_K, provider=provider, config=config, postings=postings)
    every = write_table(hits, "evidence")
    runs = []
    for mode in modes:
        evidence = every.filter(F.col("mode") == mode).drop("mode")
        answers = generate_answers(asked, evidence, texts)
        results = question_results(questions, truth, document_order(evidence), cited_identifiers(answers, evidence), answers)
        runs.append(results.withColumn("mode", F.lit(mode)))
    return reduce(DataFrame.unionByName, runs)


def summarize(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means and confusion counts; a mean over no questions is null."""
    expected, answered = F.col("expect_answerable"), F.col("status") == "answered"
    return results.groupBy(*(by or [])).agg(
        F.count("*").alias("questions"),
        F.count_if(expected).alias("answerable"),
        F.avg(F.when(expected, F.col("recall_at_5"))).alias("mean_recall_at_5"),
        F.avg(F.when(expected, F.col("reciprocal_rank"))).alias("mrr"),
        F.avg("citation_correctness").alias("mean_citation_correctness"),
        F.avg("citation_completeness").alias("mean_citation_completeness"),
        F.avg((expected == answered).cast("double")).alias("abstention_accuracy"),
        *confusion_columns(expected, answered),
    )


def evaluation_notes(mode: str, scripted: bool) -> list[str]:
    notes = [SCRIPTED_NOTE] if scripted else []
    if mode != "hybrid":
        notes.append(f"Only {mode} search was used.")
    return notes


def _shown(value: Column) -> Column:
    return F.when(value.isNull(), "n/a").otherwise(fixed_point(value, 3))


MEANS = {"recall within 5": "mean_recall_at_5", "first true rank, reciprocal": "mrr", "cited that is true": "mean_citation_correctness", "true that is cited": "mean_citation_completeness", "right to answer or decline": "abstention_accuracy"}
COUNTS = {"answered with truth": "true_positive", "declined with truth": "false_negative", "answered without truth": "false_positive", "declined without truth": "true_negative"}
CELLS = {"r5": "recall_at_5", "rr": "reciprocal_rank", "cited": "citation_correctness", "covered": "citation_completeness"}


def render_report(results: DataFrame, mode: str, generated_at: str, answer_source: str, provider: str, notes: list[str]) -> DataFrame:
    """Report as rows (section, position, line): 0 the run, 1 its figures, 2 a line per question.

    Questions are placed by id, ids of digits by their number.
    """
    run = [f"run of {generated_at}", f"search: {mode}, vectors: {provider}", f"responder: {answer_source}", *[f"note: {note}" for note in notes]]
    figures = [F.format_string("questions = %d", "questions"), F.format_string("questions with truth = %d", "answerable")]
    figures += [F.format_string(f"{name} = %d", column) for name, column in COUNTS.items()]
    figures += [F.concat(F.lit(f"{name} = "), _shown(F.col(column))) for name, column in MEANS.items()]
    totals = summarize(results)
    place = lambda lines: F.posexplode(F.array(*lines)).alias("number", "line")
    parts = [totals.select(F.lit(k).alias("section"), place(lines)) for k, lines in enumerate(([F.lit(line) for line in run], figures))]
    top = [part.select("section", F.format_string("%05d", "number").alias("position"), "line") for part in parts]
    key = F.col("question_id").cast("string")
    cells = [F.concat(F.lit(f"{name} "), _shown(F.col(column))) for name, column in CELLS.items()]
    body = results.select(
        F.lit(2).alias("section"), F.concat(F.when(key.rlike("^[0-9]{1,20}$"), F.lpad(key, 20, "0")).otherwise(F.lit("")), F.lit(":"), key).alias("position"),
        F.concat_ws("; ", F.concat(key, F.when(F.col("expect_answerable"), F.lit(" with truth")).otherwise(F.lit(" without truth"))), "status", *cells).alias("line"),
    )
    return top[0].unionByName(top[1]).unionByName(body)
