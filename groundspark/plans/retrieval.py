"""Index building and hybrid search over many questions at once."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark import settings
from groundspark.functions.text import strip
from groundspark.operators.chunking import CHUNK_KEY, chunk_documents
from groundspark.operators.dense import dense_search
from groundspark.operators.embedding import hashing
from groundspark.operators.fulltext import fulltext_from_postings, fulltext_search
from groundspark.operators.fusion import matched_by, reciprocal_rank_fusion
from groundspark.operators.lexemes import with_lexemes
from groundspark.runtime import rows_fit, text_fits_broadcast, write_table

Provider = Callable[[DataFrame], DataFrame]
BROADCAST_HITS = 200_000


def enrich_chunks(provider: Provider | None = None, config: str = "english") -> Provider:
    """Adds the vector and lexeme columns that search reads."""
    embed = provider or hashing()
    return lambda chunks: with_lexemes(embed(chunks), config)


def build_index(
    documents: DataFrame,
    provider: Provider | None = None,
    config: str = "english",
    size: int = settings.CHUNK_SIZE,
    overlap: int = settings.CHUNK_OVERLAP,
) -> DataFrame:
    """Chunk table with vectors and lexemes, in one pass and without a shuffle."""
    return enrich_chunks(provider, config)(chunk_documents(documents, size, overlap))


def check_search(mode: str, top_k: int, max_k: int = settings.SEARCH_MAX_K) -> None:
    if mode not in settings.MODES:
        raise ValueError(f"unknown mode {mode!r}, expected one of {settings.MODES}")
    if not 1 <= top_k <= max_k:
        raise ValueError(f"top_k must be between 1 and {max_k}")


def ranked_lists(
    queries: DataFrame, index: DataFrame, modes: tuple[str, ...], pool: int, provider: Provider | None, config: str, postings: DataFrame | None
) -> dict[str, DataFrame]:
    """The rankings that ``modes`` are fused from: ``fulltext``, ``dense`` or both."""
    asked = queries.filter(strip(F.col("text")) != "").select("query_id", "text")
    lists = {}
    if {"hybrid", "fulltext"} & set(modes):
        keywords = with_lexemes(asked, config)
        lists["fulltext"] = fulltext_search(keywords, index, pool) if postings is None else fulltext_from_postings(keywords, postings, pool)
    if {"hybrid", "dense"} & set(modes):
        lists["dense"] = dense_search((provider or hashing())(asked), index, pool)
    return lists


def fuse(lists: dict[str, DataFrame], mode: str, top_k: int, rrf_k: int) -> DataFrame:
    """Fused ranking of chunk keys in one mode, with the names of the lists that found them."""
    labels = [name for name in lists if mode in ("hybrid", name)]
    fused = reciprocal_rank_fusion([lists[name] for name in labels], CHUNK_KEY, rrf_k, top_k)
    return fused.withColumn("matched_by", matched_by(F.col("source_ranks"), labels))


def load_results(hits: DataFrame, index: DataFrame, documents: DataFrame, few_hits: bool) -> DataFrame:
    """Hits with their text and source fields; hits whose chunk is gone are left out.

    ``few_hits`` says the hits were found to be few enough to broadcast. Source fields
    join first, and text last: the chunk table is then only scanned, as long as the
    hits' own fields are measured to fit a broadcast.
    """
    extra = [c for c in hits.columns if c not in ("query_id", "rank", "score", "matched_by", "source_ranks", *CHUNK_KEY)]
    slim = hits.select("query_id", *extra, "rank", *CHUNK_KEY, "score", "matched_by")
    sources = documents.select("document_id", "source_type", "source_identifier", "source_url", "title")
    known = write_table(sources.join(F.broadcast(slim) if few_hits else slim, "document_id"), "hits")
    texts = index.select(*CHUNK_KEY, F.col("text").alias("excerpt"))
    fits = few_hits and text_fits_broadcast(known.select(F.concat_ws("", "source_url", "title", "source_identifier").alias("fields")), "fields")
    return texts.join(F.broadcast(known) if fits else known, CHUNK_KEY).select(
        "query_id", *extra, "rank", *CHUNK_KEY, "source_type", "source_identifier", "source_url", "title",
        "excerpt", "score", "matched_by",
    )


def search(
    queries: DataFrame,
    index: DataFrame,
    documents: DataFrame,
    mode: str = "hybrid",
    top_k: int = settings.SEARCH_TOP_K,
    pool: int = settings.CANDIDATE_POOL,
    rrf_k: int = settings.RRF_K,
    provider: Provider | None = None,
    config: str = "english",
    postings: DataFrame | None = None,
) -> DataFrame:
    """Ranked evidence rows for every question of (query_id, text).

    Blank questions give no rows. ``score`` is the fused score in every mode.
    With an inverted index in ``postings`` keyword search reads that instead of
    the lexeme column of the chunks.
    """
    check_search(mode, top_k)
    hits = fuse(ranked_lists(queries, index, (mode,), pool, provider, config, postings), mode, top_k, rrf_k)
    return load_results(hits, index, documents, rows_fit(queries, BROADCAST_HITS // top_k))


def search_modes(
    queries: DataFrame,
    index: DataFrame,
    documents: DataFrame,
    modes: tuple[str, ...] = settings.MODES,
    top_k: int = settings.SEARCH_TOP_K,
    pool: int = settings.CANDIDATE_POOL,
    rrf_k: int = settings.RRF_K,
    provider: Provider | None = None,
    config: str = "english",
    postings: DataFrame | None = None,
) -> DataFrame:
    """The rows of ``search`` in several modes, with a ``mode`` column.

    Each ranking is made once and written, and text is joined once for all modes.
    """
    for mode in modes:
        check_search(mode, top_k)
    lists = {n: write_table(r, f"{n}-ranking") for n, r in ranked_lists(queries, index, modes, pool, provider, config, postings).items()}
    hits = reduce(DataFrame.unionByName, [fuse(lists, mode, top_k, rrf_k).drop("source_ranks").withColumn("mode", F.lit(mode)) for mode in modes])
    return load_results(hits, index, documents, rows_fit(queries, BROADCAST_HITS // (top_k * len(modes))))


def search_response(queries: DataFrame, results: DataFrame, mode: str) -> DataFrame:
    """One row per question: (query_id, query, mode, results in rank order)."""
    fields = [c for c in results.columns if c not in ("query_id", "rank")]
    grouped = results.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", *fields))).alias("results")
    )
    none = F.array().cast(grouped.schema["results"].dataType)
    return queries.join(grouped, "query_id", "left").select(
        "query_id", F.col("text").alias("query"), F.lit(mode).alias("mode"), F.coalesce("results", none).alias("results")
    )
