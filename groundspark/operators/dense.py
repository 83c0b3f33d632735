"""Exact cosine search of many questions over all chunk vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundspark.operators.chunking import CHUNK_KEY
from groundspark.runtime import write_table

QUERIES_PER_PASS = 4096
SCORES_PER_SLICE = 500_000


def best_per_query(hits: DataFrame, limit: int) -> DataFrame:
    """Rank hits of each question; Spark cuts to ``limit`` before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), *CHUNK_KEY)
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def _local_best(table: pa.Table, limit: int) -> pa.Table:
    ordered = table.sort_by([("query", "ascending"), ("distance", "ascending")] + [(k, "ascending") for k in CHUNK_KEY])
    query = ordered.column("query").to_numpy()
    place = np.arange(len(query)) - np.searchsorted(query, query, side="left")
    return ordered.filter(pa.array(place < limit))


@dataclass(frozen=True)
class Block:
    """Questions of one pass: ids, vectors and squared norms, at most a few thousand."""

    ids: list
    vectors: np.ndarray
    norms: np.ndarray


def score_pass(chunks: DataFrame, block: Block, id_type: T.DataType, limit: int, probes: dict[int, np.ndarray] | None = None) -> DataFrame:
    """One scan of the chunks against one block of questions held by every task.

    With ``probes`` (list number to question places) a chunk is scored only for
    the questions that probe its ``list``.
    """
    shared = chunks.sparkSession.sparkContext.broadcast((block.ids, block.vectors, block.norms, probes))
    keys = [T.StructField(k, chunks.schema[k].dataType) for k in CHUNK_KEY]
    schema = T.StructType([T.StructField("query_id", id_type), *keys, T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, norms, probes = shared.value
        rows = max(1, SCORES_PER_SLICE // len(ids))
        cutoff = np.full(len(ids), -np.inf)
        best = None
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                flat = part.column("vector").flatten().to_numpy(zero_copy_only=False)
                matrix = flat.reshape(part.num_rows, -1).astype(np.float64)
                norms2 = part.column("norm2").to_numpy(zero_copy_only=False).astype(np.float64)
                if probes is None:
                    scores = cosines(matrix, norms2, vectors, norms)
                else:
                    scores = np.full((part.num_rows, len(ids)), -np.inf)
                    numbers = part.column("list").to_numpy()
                    for number in np.unique(numbers):
                        places, asking = np.nonzero(numbers == number)[0], probes.get(int(number), ())
                        if len(asking):
                            scores[np.ix_(places, asking)] = cosines(matrix[places], norms2[places], vectors[asking], norms[asking])
                if part.num_rows > limit:
                    place = part.num_rows - limit
                    cutoff = np.maximum(cutoff, np.partition(scores, place, axis=0)[place])
                hit = scores >= cutoff
                if probes is not None:
                    hit &= scores > -np.inf
                keys = part.select(CHUNK_KEY)
                if np.count_nonzero(hit) > 4 * limit * len(ids):
                    # Many copies tie at the cut: only the first ``limit`` by key can stay.
                    order = pc.sort_indices(keys, sort_keys=[(k, "ascending") for k in CHUNK_KEY]).to_numpy()
                    tied = scores[order] == cutoff
                    hit[order] &= ~(tied & (np.cumsum(tied, axis=0) > limit))
                row, query = np.nonzero(hit)
                picked = keys.take(pa.array(row))
                found = pa.table(
                    {
                        "query": pa.array(query.astype(np.int32)),
                        "distance": pa.array(-scores[row, query]),
                        **{k: picked.column(k) for k in CHUNK_KEY},
                    }
                )
                best = _local_best(found if best is None else pa.concat_tables([best, found]), limit)
                held = best.column("query").to_numpy()
                full = np.bincount(held, minlength=len(ids)) >= limit
                last = np.searchsorted(held, np.arange(len(ids)), side="right") - 1
                cutoff[full] = np.maximum(cutoff[full], -best.column("distance").to_numpy()[last[full]])
        if best is not None:
            distance = best.column("distance").to_numpy()
            yield from pa.table(
                {
                    "query_id": pa.array(ids).take(best.column("query").combine_chunks()),
                    **{k: best.column(k) for k in CHUNK_KEY},
                    "score": pa.array(-distance, mask=np.isinf(distance)),
                }
            ).cast(pa.schema([(f.name, _arrow_type(f.dataType)) for f in schema])).to_batches()

    return chunks.mapInArrow(score, schema)


def cosines(matrix: np.ndarray, norms2: np.ndarray, vectors: np.ndarray, query_norms2: np.ndarray) -> np.ndarray:
    """Cosine of every row with every question, -inf where either is zero."""
    scale = np.sqrt(np.outer(norms2, query_norms2))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(scale > 0, (matrix @ vectors.T) / scale, -np.inf)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def search_in_blocks(queries: DataFrame, limit: int, queries_per_pass: int, one_pass: Callable[[Block], DataFrame]) -> DataFrame | None:
    """Best hits of all questions, block by block; None when there is no question.

    A question set larger than one block is hashed into blocks, and each block's
    hits are written out before the next block is held, so neither the driver
    nor a task ever holds more than one block.
    """
    usable = queries.filter(F.col("vector").isNotNull()).select("query_id", "vector", "norm2")

    def held(rows: list) -> Block:
        vectors = np.array([row["vector"] for row in rows], dtype=np.float64)
        return Block([row["query_id"] for row in rows], vectors, np.array([row["norm2"] for row in rows], dtype=np.float64))

    first = usable.limit(queries_per_pass + 1).collect()
    if not first:
        return None
    if len(first) <= queries_per_pass:
        return best_per_query(one_pass(held(first)), limit)
    passes = -(-2 * usable.count() // queries_per_pass)
    block_of = F.pmod(F.xxhash64("query_id"), F.lit(passes))
    found = None
    for number in range(passes):
        rows = usable.filter(block_of == number).collect()
        if rows:
            hits = write_table(best_per_query(one_pass(held(rows)), limit), "dense-pass")
            found = hits if found is None else found.unionByName(hits)
    return found


def no_hits(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    fields = [queries.schema["query_id"], *[chunks.schema[k] for k in CHUNK_KEY]]
    fields += [T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())]
    return queries.sparkSession.createDataFrame([], T.StructType(fields))


def dense_search(queries: DataFrame, chunks: DataFrame, limit: int, queries_per_pass: int = QUERIES_PER_PASS) -> DataFrame:
    """(query_id, document_id, chunk_index, score, rank), best ``limit`` per question.

    ``queries`` has (query_id, vector, norm2). Chunks are scanned once per block
    of questions and never shuffled; each task returns at most ``limit`` hits per
    question. Chunks without a vector are left out; a zero vector scores null and
    sorts last.
    """
    vectors = chunks.filter(F.col("vector").isNotNull()).select(*CHUNK_KEY, "vector", "norm2")
    id_type = queries.schema["query_id"].dataType
    found = search_in_blocks(queries, limit, queries_per_pass, lambda block: score_pass(vectors, block, id_type, limit))
    return no_hits(queries, chunks) if found is None else found
