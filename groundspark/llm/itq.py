"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, exact rerank.

Rotations learned on a bounded sample turn centred unit vectors into balanced binary
codes. A table is a run of bits of the code, about as many as the table of vectors
needs to spread; two vectors are retrieved if in some table their runs differ in at
most one bit. Longer runs take more tables, so that retrieval does not fall with the
number of vectors. Retrieved pairs are reranked by cosine of the original vectors.

Equal vectors are one class with a size. Buckets are split into blocks; blocks of
equal or neighbouring buckets meet as groups of bounded size, which give counts of
links and a spanning forest, never all pairs. A pair retrieved by several tables
counts in the first of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark.llm.graph import components
from groundspark.llm.sampling import hash_sample
from groundspark.runtime import write_table

COSINE = 0.93
# Tables at least, and the share of pairs at the threshold that all tables together are to retrieve.
TABLES = 6
RETRIEVED = 0.97
MIN_BITS, MAX_BITS = 8, 24
# The documented bound of the sample that rotations are learned on, rows of least hash.
SAMPLE_ROWS = 10_000
ITERATIONS = 30
BLOCK = 256


def tables_for(bits: int, cosine: float) -> int:
    """Tables needed for ``RETRIEVED``: a bit differs with the angle as a share of a half turn, as for random planes."""
    differs = np.arccos(np.clip(cosine, -1, 1)) / np.pi
    hit = (1 - differs) ** bits + bits * differs * (1 - differs) ** (bits - 1)
    missed = max(1 - hit, 1e-12)
    return max(TABLES, int(np.ceil(np.log(1 - RETRIEVED) / np.log(missed)))) if hit > 0 else TABLES


def learn_rotation(centred: np.ndarray, bits: int, seed: int, iterations: int = ITERATIONS) -> np.ndarray:
    """Iterative quantisation: principal axes, then alternately signs and the best rotation to them."""
    _, _, axes = np.linalg.svd(centred, full_matrices=False) if len(centred) else (0, 0, np.eye(centred.shape[1]))
    axes = axes[:bits].T
    projected = centred @ axes
    rotation, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(axes.shape[1], axes.shape[1])))
    for _ in range(iterations if len(centred) else 0):
        signs = np.where(projected @ rotation >= 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(signs.T @ projected, full_matrices=False)
        rotation = (u @ v).T
    return axes @ rotation


def learn(sample: np.ndarray, bits: int, tables: int = TABLES) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection to ``tables * bits`` code bits; several rotations where one has too few."""
    mean = sample.mean(axis=0) if len(sample) else np.zeros(sample.shape[1])
    if not sample.shape[1]:  # no vector at all
        return mean, np.zeros((0, tables * bits))
    parts, seed = [], 0
    while sum(p.shape[1] for p in parts) < tables * bits:
        parts.append(learn_rotation(sample - mean, bits * tables, seed))
        seed += 1
    return mean, np.concatenate(parts, axis=1)[:, : tables * bits]


def code_runs(unit: np.ndarray, mean: np.ndarray, projection: np.ndarray, bits: int) -> np.ndarray:
    """The code of each vector as one number per table."""
    ones = ((unit - mean) @ projection >= 0).reshape(len(unit), -1, bits)
    return (ones * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)


def near_runs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether runs differ in at most one bit."""
    gap = left ^ right
    return (gap & (gap - 1)) == 0


def linked_pairs(left: tuple, right: tuple, table: int, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of two blocks that link by cosine and that no earlier table retrieves."""
    (a, a_norm, a_runs), (b, b_norm, b_runs) = left, right
    near = (a @ b.T) / (a_norm[:, None] * b_norm[None]) >= cosine
    if same:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    first = np.ones(len(i), bool)
    for earlier in range(table):
        first &= ~near_runs(a_runs[i, earlier], b_runs[j, earlier])
    return i[first], j[first]


def class_links(classes: DataFrame, width: int, cosine: float = COSINE) -> tuple[DataFrame, DataFrame]:
    """Of ``classes`` (class, label, size, embedding): (class, n) counts of linked vectors, and a forest of links (a, b)."""
    count = classes.count()
    bits = min(MAX_BITS, max(MIN_BITS, int(np.ceil(np.log2(max(count, 2))))))
    drawn = hash_sample(classes, ["class"], SAMPLE_ROWS).select("embedding").collect()
    sample = np.zeros((len(drawn), width))
    for at, row in enumerate(drawn):
        sample[at, : len(row["embedding"])] = row["embedding"]
    mean, projection = learn(sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-300), bits, tables_for(bits, cosine))

    def dense(column: pa.Array) -> np.ndarray:
        out = np.zeros((len(column), width))
        for row in range(len(column)):
            vector = np.asarray(column[row].values)
            out[row, : len(vector)] = vector
        return out

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = dense(batch.column("embedding"))
            runs = code_runs(vectors / np.linalg.norm(vectors, axis=1, keepdims=True), mean, projection, bits)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in ("class", "label", "size")), pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array(list(runs), pa.list_(pa.int64()))],
                names=["class", "label", "size", "vector", "runs"],
            )

    codes = write_table(classes.select("class", "label", "size", "embedding").mapInArrow(encode, "class long, label long, size long, vector binary, runs array<long>"), "codes")
    rows = codes.select("class", "label", F.posexplode("runs").alias("tab", "run"))
    buckets = rows.groupBy("label", "tab", "run").agg(F.count("*").alias("n"))
    buckets = write_table(buckets.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("long")), "buckets")
    # Neighbouring buckets: the one with the bit clear names the pair.
    low = buckets.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))))
    low = low.filter(F.expr("(shiftright(run, bit) & 1) = 0")).withColumn("other", F.expr("run | shiftleft(1L, bit)"))
    high = buckets.select("label", "tab", F.col("run").alias("other"), F.col("blocks").alias("other_blocks"))
    near = low.join(high, ["label", "tab", "other"]).select("label", "tab", "run", "blocks", "other", "other_blocks")
    own = buckets.filter("n > 1").select("label", "tab", "run", "blocks", F.col("run").alias("other"), F.col("blocks").alias("other_blocks"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    pairs = near.union(own).withColumn("i", every("blocks")).withColumn("j", every("other_blocks")).filter("run <> other OR i <= j")
    key = ["label", "tab", "run", "other", "i", "j"]
    pairs = write_table(pairs.select(*key), "block-pairs")
    placed = rows.join(buckets, ["label", "tab", "run"]).select("label", "tab", "run", F.pmod(F.xxhash64("class"), "blocks").alias("at"), "class")
    left = pairs.join(placed.withColumnRenamed("at", "i"), ["label", "tab", "run", "i"]).select(*key, F.lit(True).alias("left"), "class")
    right = pairs.filter("run <> other OR i <> j").join(placed.select("label", "tab", F.col("run").alias("other"), F.col("at").alias("j"), "class"), ["label", "tab", "other", "j"]).select(*key, F.lit(False).alias("left"), "class")
    members = left.union(right).join(codes.select("class", "size", "vector", "runs"), "class")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        name = None
        counts: dict[int, int] = {}
        forest: list[tuple[int, int]] = []

        def close() -> None:
            if not held:
                return
            sides = []
            for side in (True, False):
                some = [h for h in held if h[0] == side]
                vectors = np.frombuffer(b"".join(h[3] for h in some)).reshape(len(some), width)
                sides.append(([h[1] for h in some], [h[2] for h in some], (vectors, np.linalg.norm(vectors, axis=1), np.array([h[4] for h in some] or np.zeros((0, 1)), np.int64))))
            same = name[2] == name[3] and name[4] == name[5]
            if same:
                sides[1] = sides[0]
            (a, a_size, left_side), (b, b_size, right_side) = sides
            root: dict[int, int] = {}

            def find(c: int) -> int:
                while root.setdefault(c, c) != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c

            for i, j in zip(*linked_pairs(left_side, right_side, name[1], cosine, same), strict=True):
                counts[a[i]] = counts.get(a[i], 0) + b_size[j]
                counts[b[j]] = counts.get(b[j], 0) + a_size[i]
                if find(a[i]) != find(b[j]):
                    root[find(a[i])] = find(b[j])
                    forest.append((a[i], b[j]))

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({
                "a": pa.array([*counts, *(a for a, _ in forest)], pa.int64()),
                "b": pa.array([*[None] * len(counts), *(b for _, b in forest)], pa.int64()),
                "n": pa.array([*counts.values(), *[0] * len(forest)], pa.int64()),
            })
            counts.clear()
            forest.clear()
            return out

        for batch in batches:
            names = list(zip(*(batch.column(k).to_pylist() for k in key), strict=True))
            rest = zip(*(batch.column(k).to_pylist() for k in ("left", "class", "size", "vector", "runs")), strict=True)
            for own_name, row in zip(names, rest, strict=True):
                if own_name != name:
                    close()
                    name, held = own_name, []
                    if len(counts) + len(forest) > 20_000:
                        yield flush()
                held.append(row)
        close()
        yield flush()

    rows = members.select(*key, "left", "class", "size", "vector", "runs").repartition(*key).sortWithinPartitions(*key)
    found = write_table(rows.mapInArrow(link, "a long, b long, n long"), "vector-links")
    return found.filter("b IS NULL").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n")), found.filter("b IS NOT NULL").select("a", "b")


def near_vectors(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of ``embeddings`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors link when labels are equal and the cosine is at least ``cosine``. Null
    labels and vectors that are null, empty, zero or hold null or non-finite components
    link with nothing: no links, their own component, kept. ``n_links`` counts rows;
    repeated vec_ids are rows of their own, ``kept`` compares ids. An empty table gives no rows.
    """
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0) & F.col("label").isNotNull()
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>")).withColumn("row", F.monotonically_increasing_id())
    rows = write_table(rows.withColumn("usable", F.coalesce(usable, F.lit(False))), "vectors")
    width = rows.filter("usable").agg(F.max(F.size("embedding")).alias("n")).first()["n"] or 0
    classes = write_table(rows.filter("usable").groupBy("label", "embedding").agg(F.min("row").alias("class"), F.count("*").alias("size"), F.min("vec_id").alias("least")), "classes")
    counts, forest = class_links(classes, width, cosine)
    labels = components(forest)
    named = classes.join(labels.withColumnRenamed("node", "class"), "class", "left").join(counts, "class", "left")
    named = named.withColumn("component", F.coalesce("component", "class"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id", F.lit(True).alias("usable"))
    linked = rows.filter("usable").select("vec_id", "label", "embedding").join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
