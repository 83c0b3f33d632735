"""Whole answering jobs: questions over an index, and trial against trial."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark import settings
from groundspark.operators.comparison import check_pairs, citation_side, generate_comparisons, pair_evidence, trial_chunks
from groundspark.operators.grounding import citation_rows, generate_answers
from groundspark.plans.retrieval import Provider, check_search, search
from groundspark.runtime import write_table


@dataclass(frozen=True)
class Answered:
    """``evidence`` is numbered per question; ``citations`` are those of answered questions."""

    evidence: DataFrame
    answers: DataFrame
    citations: DataFrame


def ask(
    questions: DataFrame,
    index: DataFrame,
    documents: DataFrame,
    texts: DataFrame | None = None,
    top_k: int = settings.ANSWER_TOP_K,
    mode: str = "hybrid",
    provider: Provider | None = None,
    config: str = "english",
    postings: DataFrame | None = None,
) -> Answered:
    """Retrieve, answer and validate every question of (query_id, text).

    The evidence is written out, since prompts, checks and citations all number
    their blocks by it. ``texts`` holds the model output for these very blocks;
    without it the scripted responder answers.
    """
    check_search(mode, top_k, settings.ANSWER_MAX_K)
    found = search(questions, index, documents, mode, top_k, provider=provider, config=config, postings=postings)
    evidence = write_table(found, "evidence")
    answers = generate_answers(questions, evidence, texts)
    return Answered(evidence, answers, citation_rows(answers, evidence))


def compare(
    pairs: DataFrame,
    documents: DataFrame,
    chunks: DataFrame,
    texts: DataFrame | None = None,
    limit: int = settings.MAX_CHUNKS_PER_TRIAL,
) -> tuple[DataFrame, Answered]:
    """(requests with their status, answers for the accepted ones) of (pair_id, nct_a, nct_b, question).

    A request naming an unknown trial is refused and gets no answer. Citations
    carry the side they belong to.
    """
    trials = documents.filter(F.col("source_type") == "trial").select(F.col("source_identifier").alias("nct_id"))
    requests = write_table(check_pairs(pairs, trials), "requests")
    accepted = requests.filter(F.col("status") == "ok")
    named = accepted.select(F.explode(F.array("nct_a", "nct_b")).alias("nct_id"))
    evidence = write_table(pair_evidence(accepted, trial_chunks(documents, chunks, limit, named)), "pair-evidence")
    answers = generate_comparisons(accepted, evidence, texts)
    numbered = evidence.withColumnRenamed("pair_id", "query_id")
    sides = accepted.select(F.col("pair_id").alias("query_id"), "nct_a", "nct_b")
    citations = citation_rows(answers, numbered).join(sides, "query_id").withColumn(
        "side", citation_side(F.col("source_identifier"), F.col("nct_a"), F.col("nct_b"))
    )
    return requests, Answered(evidence, answers, citations)
