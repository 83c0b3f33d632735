"""Exact top-k inner products by elimination with a table of pivot distances.

Components become integers. The distances of a vector to many pivots place it as the
apex of a simplex over them: its coordinates in the space of the pivots, and its height
over that space. The distance of two apexes on the same side is a lower bound of the
distance of query and candidate, never below what the triangle inequality gives from any
pivot, and so there is an upper bound of their inner product, (|q|^2 + |x|^2 - bound^2) / 2.
Candidates are evaluated in the order of these bounds until no bound left reaches the
k-th score, so the result is exact.

Queries and candidates meet in blocks: each pair of blocks is one group of bounded
size, and only the k best of a block leave it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundspark.llm.sampling import hash_sample
from groundspark.runtime import write_table

# Pivots for each hundred components: they leave little height, so that the bounds come near the products.
PIVOTS_PER_HUNDRED = 80
# Rows, of least hash, from which pivots are chosen, each time the farthest from those before.
PIVOT_SAMPLE = 2_000
QUERY_BLOCK = 1_024
CANDIDATE_BLOCK = 16_384
FIRST_TRIED = 256
# Below this, sums of products of doubles are exact integers; below the second, those of long integers.
EXACT, WIDE = float(1 << 52), float(1 << 62)
# A pivot closer to the space of those before it than this share of the farthest adds nothing.
FLAT = 1e-3


def matrix(vectors: pa.Array | list, width: int) -> np.ndarray:
    """floor(64 x) as doubles; shorter vectors are filled with zeros."""
    if not isinstance(vectors, list):
        vectors = [np.asarray(v.values) for v in vectors]
    out = np.zeros((len(vectors), width))
    for row, vector in enumerate(vectors):
        out[row, : len(vector)] = vector
    return np.floor(64 * out)


def choose_pivots(sample: np.ndarray, count: int | None = None) -> np.ndarray:
    """From the vector farthest from the mean on, each time the one farthest from the space of those before."""
    if not len(sample):
        return sample
    count = max(2, sample.shape[1] * PIVOTS_PER_HUNDRED // 100) if count is None else count
    chosen = [int(((sample - sample.mean(axis=0)) ** 2).sum(axis=1).argmax())]
    left = sample - sample[chosen[0]]
    farthest = (left**2).sum(axis=1).max()
    while len(chosen) < min(count, len(sample)):
        heights = (left**2).sum(axis=1)
        at = int(heights.argmax())
        if heights[at] <= FLAT**2 * farthest:
            break
        chosen.append(at)
        axis = left[at] / np.sqrt(heights[at])
        left = left - (left @ axis)[:, None] * axis
    return sample[chosen]


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (vectors**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None] - 2 * vectors @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def apexes(to_pivots: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Coordinates over the pivots and, last, the height, from distances to the pivots alone."""
    edges = pivots[1:] - pivots[0]
    squares = to_pivots**2
    base, corner = np.linalg.qr(edges.T) if len(edges) else (None, np.zeros((0, 0)))
    # x . edge = (d(x, first)^2 - d(x, pivot)^2 + |edge|^2) / 2 with the first pivot as origin.
    along = (squares[:, :1] - squares[:, 1:] + (edges**2).sum(axis=1)[None]) / 2
    flat = np.linalg.solve(corner.T, along.T).T if len(edges) else along
    height = np.sqrt(np.maximum(squares[:, :1] - (flat**2).sum(axis=1, keepdims=True), 0))
    return np.concatenate([flat, height], axis=1)


def upper_bounds(queries: np.ndarray, candidates: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Upper bounds of all inner products, with room for rounding."""
    sizes = (queries**2).sum(axis=1)[:, None] + (candidates**2).sum(axis=1)[None]
    q, c = (apexes(distances(rows, pivots), pivots) for rows in (queries, candidates))
    low = (q**2).sum(axis=1)[:, None] + (c**2).sum(axis=1)[None] - 2 * q @ c.T
    # Rounding is off by less than a part in a million of the squares (edges are at least FLAT apart).
    room = 1e-6 * (sizes + (q**2).sum(axis=1)[:, None] + (c**2).sum(axis=1)[None]) + 1e-3
    return (sizes - low + room) / 2


def best_of_block(query: np.ndarray, candidates: np.ndarray, names: np.ndarray, allowed: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and scores of the ``k`` best candidates by (score, then name), and how many were evaluated.

    Bounds are taken in falling order, in groups that double.
    """
    left = np.flatnonzero(allowed)
    places, scores, tried, size = np.zeros(0, np.int64), np.zeros(0), 0, FIRST_TRIED
    while len(left):
        bound = bounds[left]
        if len(left) > size:
            split = np.argpartition(-bound, size)
            now, rest = left[split[:size]], left[split[size:]]
        else:
            now, rest = left, left[:0]
        places, scores = np.concatenate([places, now]), np.concatenate([scores, candidates[now] @ query])
        tried += len(now)
        order = np.lexsort((names[places], -scores))[:k]
        places, scores = places[order], scores[order]
        # A bound equal to the last score may still win by its name.
        left = rest[bounds[rest] >= scores[-1]] if len(scores) == k else rest
        size *= 2
    return places, scores, tried


def saturated_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Products of every row of ``right`` with the vector ``left``, in whole numbers of any size, cut to a long's range."""
    whole = [int(x) for x in left]
    at = [i for i, x in enumerate(whole) if x]
    sums = (sum(whole[i] * int(row[i]) for i in at) for row in right)
    return np.array([min(max(s, -(1 << 63)), (1 << 63) - 1) for s in sums], np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, width: int) -> DataFrame:
    """The ``k`` best rows of ``vectors`` (row, vec_id, embedding) for each of ``queries`` (the same columns).

    Gives query_id, rank, vec_id, score. A row is no candidate of the query with its
    own row number. Ties go to the smaller vec_id, then row; a null vec_id is last.
    A score beyond 64 bits is the largest or smallest long, and ties as such.
    """
    blocks = (max(1, -(-queries.count() // QUERY_BLOCK)), max(1, -(-vectors.count() // CANDIDATE_BLOCK)))
    sample = hash_sample(vectors, ["vec_id", "row"], PIVOT_SAMPLE).select("embedding").collect()
    drawn = matrix([np.array(r["embedding"], float) for r in sample], width)
    with np.errstate(over="ignore"):
        drawn = drawn[(drawn**2).sum(axis=1) < WIDE]
    pivots = choose_pivots(drawn) if len(drawn) else np.zeros((1, width))

    def dealt(rows: DataFrame, own: str, other: str, count: int, others: int, is_query: bool) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        return rows.select(F.pmod(F.xxhash64("row"), F.lit(count)).cast("int").alias(own), every.alias(other), F.lit(is_query).alias("is_query"), "row", "vec_id", "embedding").select("qb", "cb", "is_query", "row", "vec_id", "embedding")

    both = dealt(queries, "qb", "cb", blocks[0], blocks[1], True).union(dealt(vectors, "cb", "qb", blocks[1], blocks[0], False))

    def search(group: pa.Table) -> pa.Table:
        is_query = group.column("is_query").to_numpy(zero_copy_only=False)
        rows = group.column("row").to_numpy()
        ids = group.column("vec_id").to_pylist()
        names = np.array([np.iinfo(np.int64).max if i is None else i for i in ids], np.int64)
        flat = group.column("embedding").combine_chunks()
        numbers = matrix([np.asarray(flat[i].values) for i in range(len(flat))], width)
        q, c = np.flatnonzero(is_query), np.flatnonzero(~is_query)
        c = c[np.argsort(rows[c], kind="stable")]
        out: dict[str, list] = {"query_row": [], "query_id": [], "row": [], "vec_id": [], "score": []}
        with np.errstate(over="ignore"):
            squares = (numbers**2).sum(axis=1)
        fits = squares < WIDE
        usual = np.where(fits[:, None], numbers, 0)
        exact = usual if squares[fits].max(initial=0) < EXACT else usual.astype(np.int64)
        of_candidates, huge = exact[c], np.flatnonzero(~fits[c])
        bounds = upper_bounds(usual[q], usual[c], pivots)
        for at, place in enumerate(q):
            allowed, extra = rows[c] != rows[place], huge if fits[place] else np.arange(len(c))
            found, scores, _ = best_of_block(exact[place], of_candidates, names[c], allowed & fits[c] & fits[place], bounds[at], k)
            # Vectors too long for the bounds are compared with all others in whole numbers.
            extra = extra[allowed[extra]]
            if len(extra):
                found = np.concatenate([found, extra])
                scores = np.concatenate([scores.astype(np.int64), saturated_products(numbers[place], numbers[c[extra]])])
                order = np.lexsort((found, names[c[found]], -1 - scores))[:k]
                found, scores = found[order], scores[order]
            out["query_row"] += [int(rows[place])] * len(found)
            out["query_id"] += [ids[place]] * len(found)
            out["row"] += rows[c[found]].tolist()
            out["vec_id"] += [ids[j] for j in c[found]]
            out["score"] += [int(s) for s in scores]
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    found = both.groupBy("qb", "cb").applyInArrow(search, "query_row long, query_id long, row long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def exact_search(embeddings: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """For each row whose vec_id is divisible by ``every``, the ``k`` rows of highest integer inner product.

    Vectors that are null or hold null or non-finite components take no part; a zero
    or empty vector scores 0; vectors of unequal length are compared on their common
    components. Repeated vec_ids are rows of their own. An empty table gives no rows.
    """
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).filter(usable)
    rows = write_table(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    width = rows.agg(F.max(F.size("embedding")).alias("n")).first()["n"] or 0
    return top_k(rows, rows.filter(F.col("vec_id") % every == 0), k, width)
