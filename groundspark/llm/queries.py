"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundspark.llm import itq, langid, linededup, lm, merkle, minhash, mixing, packing, phrases, pivots, secrets, token_counts, token_files


# An upsampled source is read at most this often.
MAX_REPEATS = 2.0


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan_documents(table(spark, folder, "documents"))
    return found.select("doc_id", "word_no", "part", F.md5("candidate").alias("candidate_md5"), "probability", "is_secret")


def op2_token_files(spark: SparkSession, folder: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    written = token_files.write_token_files(table(spark, folder, "documents"), tokenizer)
    return token_files.read_token_files(spark, written)


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(table(spark, folder, "documents"), tokenizer, size=4096, with_ids=False)


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    uses = mixing.schedule(table(spark, folder, "documents"), max_repeats=MAX_REPEATS)
    return uses.select("doc_id", "source", "tokens", "epoch", "place")


def op5_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", "component_id", "kept")


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = linededup.dedup_lines(table(spark, folder, "documents"))
    return kept.select("doc_id", F.size(F.split("text", "\n", -1)).alias("n_lines"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op8_window_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm.pseudo_likelihood(table(spark, folder, "documents"))


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    found = langid.identify(table(spark, folder, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "lang_accepted")


def op6_itq_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return itq.near_vectors(table(spark, folder, "embeddings"), cosine=0.93)


def op10_pivot_search(spark: SparkSession, folder: str) -> DataFrame:
    return pivots.exact_search(table(spark, folder, "embeddings"), every=20, k=20)


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.verify(table(spark, folder, "documents"))


def op12_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op13_phrase_mining(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"), least=100, top=2_000)


OPERATORS = (
    op1_secret_scan, op2_token_files, op3_packing, op4_mixing, op5_minhash_dedup, op6_itq_dedup, op7_line_dedup, op8_window_scoring, op9_language_id, op10_pivot_search,
    op11_merkle_manifest, op12_token_counts, op13_phrase_mining,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in OPERATORS}
ORACLE_SQL: dict[str, str] = {
    "op4_mixing": mixing.oracle(MAX_REPEATS), "op7_line_dedup": linededup.oracle(), "op11_merkle_manifest": merkle.oracle(), "op13_phrase_mining": phrases.oracle(least=100, top=2_000),
}
