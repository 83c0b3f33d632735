"""Approximate nearest chunks: vectors stored in clustered lists, few lists probed."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundspark.operators.chunking import CHUNK_KEY
from groundspark.operators.dense import QUERIES_PER_PASS, Block, dense_search, no_hits, score_pass, search_in_blocks
from groundspark.operators.embedding import unit_vector
from groundspark.runtime import freed_shuffles, write_table

# Rows that centres are learnt from: so many a list, and in one cell of lists at most.
TRAINING_ROWS_PER_LIST = 256
CELL_ROWS = 65_536
HASHES = 1 << 40
ROUNDS = 10
# From so many lists on, a vector is compared with the lists of its nearest cells alone.
FLAT_LISTS = 64
NEAR_CELLS = 3
ROWS_PER_FILE = 65_536
# Questions searched exactly to choose probes, and the recall these must reach: some above 0.9, for other questions.
CALIBRATION_QUERIES = 256
CALIBRATION_RECALL = 0.93


def _usable(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("vector").isNotNull() & (F.col("norm2") > 0))


def cluster_units(points: np.ndarray, count: int, seed: int) -> np.ndarray:
    """Unit centres of at most ``count`` clusters of unit vectors."""
    places = np.random.default_rng(seed).permutation(len(points))[:count]
    centres = points[places].astype(np.float64)
    for _ in range(ROUNDS if len(points) > count else 0):
        nearest = (points @ centres.T).argmax(axis=1)
        order = np.argsort(nearest, kind="stable")
        found, begins = np.unique(nearest[order], return_index=True)
        sums = np.add.reduceat(points[order].astype(np.float64), begins, axis=0)
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        centres[found] = np.where(lengths > 0, sums / np.maximum(lengths, 1e-30), centres[found])
    return centres


def train_lists(chunks: DataFrame, n_lists: int | None = None, seed: int = 42) -> np.ndarray:
    """Unit centres of at most ``n_lists`` clusters of chunk vectors, by default the root of their number.

    Two levels: cells, as many as the root of the lists, and then the lists of each cell
    in a task of its own, so that no vector is compared with all lists. Both are learnt
    from the vectors of least hash, a share that grows with the lists; copies of a vector
    have one hash and count once. Every chunk is assigned afterwards.
    """
    usable = _usable(chunks).select("vector", "norm2")
    n_rows = usable.count()
    n_lists = n_lists or max(2, math.ceil(math.sqrt(n_rows)))
    limit = math.ceil(HASHES * min(1.0, n_lists * TRAINING_ROWS_PER_LIST / max(1, n_rows)))
    place = F.pmod(F.xxhash64("vector"), F.lit(HASHES))
    sample = usable.withColumn("place", place).filter(F.col("place") < limit).dropDuplicates(["vector"])
    sample = write_table(sample.select("place", unit_vector(F.col("vector"), F.col("norm2")).cast("array<float>").alias("unit")), "list-sample")
    n_cells = max(1, math.ceil(math.sqrt(n_lists)))
    some = sample.orderBy("place").limit(n_cells * TRAINING_ROWS_PER_LIST).select(array_to_vector("unit").alias("features"))
    model = KMeans(k=n_cells, seed=seed, distanceMeasure="cosine", initMode="random").fit(some) if n_cells > 1 else None
    cells = np.array(model.clusterCenters()) if model else np.ones((1, 1))
    celled = sample.withColumn("cell", nearest_of(cells)("unit") if model else F.lit(0))
    sized = write_table(celled, "list-cells")
    counts = sized.groupBy("cell").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("cells")).first()
    spare = max(0, n_lists - total["cells"])
    counts = counts.select("cell", (1 + F.floor(F.col("n") * spare / (total["total"] or 1))).cast("int").alias("lists"))
    first = Window.partitionBy("cell").orderBy("place")
    bounded = sized.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= CELL_ROWS).join(F.broadcast(counts), "cell")

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values("place")
        centres = cluster_units(np.stack(ordered["unit"].to_numpy()), int(ordered["lists"].iloc[0]), seed)
        return pd.DataFrame({"cell": int(ordered["cell"].iloc[0]), "number": np.arange(len(centres)), "centre": list(centres)})

    found = bounded.select("cell", "place", "unit", "lists").groupBy("cell").applyInPandas(split, "cell int, number int, centre array<double>")
    return np.array([r["centre"] for r in found.orderBy("cell", "number").collect()])


def nearest_of(centres: np.ndarray, near: int = NEAR_CELLS):
    """Column function: vector to the number of its nearest centre.

    Many centres are grouped into cells first, and only those of the ``near`` cells nearest to a vector compared.
    """
    cells = member = None
    if len(centres) > FLAT_LISTS:
        cells = cluster_units(centres, math.ceil(math.sqrt(len(centres))), 0)
        member = (centres @ cells.T).argmax(axis=1)

    def nearest(matrix: np.ndarray) -> np.ndarray:
        if cells is None:
            return (matrix @ centres.T).argmax(axis=1)
        best, score = np.zeros(len(matrix), np.int64), np.full(len(matrix), -np.inf)
        closest = np.argpartition(-(matrix @ cells.T), min(near, len(cells) - 1), axis=1)[:, :near]
        for cell in np.unique(closest):
            lists, rows = np.flatnonzero(member == cell), np.flatnonzero((closest == cell).any(axis=1))
            if len(lists):
                scores = matrix[rows] @ centres[lists].T
                top = scores.argmax(axis=1)
                value = scores[np.arange(len(rows)), top]
                better = value > score[rows]
                best[rows[better]], score[rows[better]] = lists[top[better]], value[better]
        return best

    @F.arrow_udf("int")
    def assign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            matrix = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1)
            yield pa.array(nearest(matrix).astype(np.int32))

    return assign


def write_lists(chunks: DataFrame, centres: np.ndarray, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Store the vectors with one folder per list; a list spans as many files as its counted rows need."""
    assigned = _usable(chunks).select(*CHUNK_KEY, "vector", "norm2", nearest_of(centres)("vector").alias("list"))
    files = assigned.groupBy("list").agg(F.ceil(F.count("*") / rows_per_file).alias("_files"))  # one row per list
    spread = F.pmod(F.xxhash64(*CHUNK_KEY), F.col("_files"))
    with freed_shuffles(assigned.sparkSession):
        assigned.join(F.broadcast(files), "list").repartition("list", spread).drop("_files").write.partitionBy("list").parquet(path)


def approximate_search(
    queries: DataFrame,
    lists: DataFrame,
    centres: np.ndarray,
    limit: int,
    probes: int = 8,
    queries_per_pass: int = QUERIES_PER_PASS,
) -> DataFrame:
    """Like exact dense search, over the ``probes`` lists nearest to each question.

    Scores are exact. Only folders of probed lists are read, and a chunk is
    compared with the questions that probe its list; chunks are not shuffled.
    """
    id_type = queries.schema["query_id"].dataType

    def one_pass(block: Block) -> DataFrame:
        nearest = np.argsort(-(block.vectors @ centres.T), axis=1, kind="stable")[:, :probes]
        asking = {int(number): np.nonzero((nearest == number).any(axis=1))[0] for number in np.unique(nearest)}
        return score_pass(lists.filter(F.col("list").isin(list(asking))), block, id_type, limit, asking)

    found = search_in_blocks(queries.filter(F.col("norm2") > 0), limit, queries_per_pass, one_pass)
    return no_hits(queries, lists) if found is None else found


def choose_probes(queries: DataFrame, chunks: DataFrame, lists: DataFrame, centres: np.ndarray, limit: int, recall: float = CALIBRATION_RECALL) -> int:
    """The fewest probes that find ``recall`` of the exact hits, as measured on questions of least hash."""
    asked = queries.filter(F.col("norm2") > 0).orderBy(F.xxhash64("query_id"), "query_id").limit(CALIBRATION_QUERIES)
    exact = dense_search(asked, chunks, limit).filter("score IS NOT NULL").select("query_id", *CHUNK_KEY)
    hits = lists.select(*CHUNK_KEY, "list").join(F.broadcast(exact), CHUNK_KEY).select("query_id", "list").collect()
    order = {r["query_id"]: np.argsort(np.argsort(-(centres @ np.array(r["vector"], np.float64)), kind="stable")) for r in asked.select("query_id", "vector").collect()}
    places: dict = {}
    for r in hits:
        places.setdefault(r["query_id"], []).append(order[r["query_id"]][r["list"]])
    found = np.zeros(len(centres))
    for each in places.values():
        found += np.bincount(each, minlength=len(centres)) / len(each)
    enough = np.flatnonzero(np.cumsum(found) >= recall * len(places) - 1e-9)
    return int(enough[0]) + 1 if places and len(enough) else len(centres)


def recall_against(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """(query_id, n_exact, n_found, recall): how much of the exact hits was found."""
    found = approximate.select("query_id", *CHUNK_KEY, F.lit(1).alias("hit"))
    return (
        exact.join(found, ["query_id", *CHUNK_KEY], "left")
        .groupBy("query_id")
        .agg(F.count("*").alias("n_exact"), F.count("hit").alias("n_found"))
        .withColumn("recall", F.col("n_found") / F.col("n_exact"))
    )
