"""Signed feature hashing of chunk and question texts, and the provider switch."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundspark import settings
from groundspark.runtime import in_slices

# A task keeps the slots of so many tokens, of at most that length; rare ones are cheap to hash again.
MAX_CACHED_TOKENS = 100_000
MAX_CACHED_LENGTH = 64


def hash_counts(dim: int = settings.EMBEDDING_DIM) -> Callable[[Column | str], Column]:
    """Column function: text to ``dim`` signed token counts (array<int>).

    A task keeps the slots of tokens it has seen, which makes one Arrow pass over
    the text about fifteen times faster than SHA-256 per token in expressions.
    """
    if dim <= 0:
        raise ValueError("embedding dimension must be positive")

    @F.arrow_udf("array<int>")
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        slots: dict[str, int] = {}

        def slot(token: str) -> int:
            known = slots.get(token)
            if known is None:
                if len(slots) >= MAX_CACHED_TOKENS:
                    slots.clear()
                digest = hashlib.sha256(token.encode("utf-8")).digest()
                known = int.from_bytes(digest, "big") % (2 * dim)
                if len(token) <= MAX_CACHED_LENGTH:
                    slots[token] = known
            return known

        for part in in_slices(batches):
            out = np.zeros((len(part), dim), dtype=np.int32)
            for row, text in enumerate(part.to_pylist()):
                tokens = [slot(token) for token in (text or "").lower().split()]
                both = np.bincount(tokens, minlength=2 * dim) if tokens else np.zeros(2 * dim, np.int64)
                out[row] = both[:dim] - both[dim:]
            offsets = np.arange(0, len(part) * dim + 1, dim, dtype=np.int32)
            yield pa.ListArray.from_arrays(offsets, out.ravel())

    return counts


def squared_norm(vector: Column) -> Column:
    """Sum of squares: exact for counts, double for real vectors."""
    return F.aggregate(vector, F.lit(0).cast("bigint"), lambda total, v: total + v.cast("bigint") * v)


def unit_vector(counts: Column, norm2: Column) -> Column:
    """The L2-normalised embedding; the zero vector stays zero."""
    return F.transform(counts, lambda v: F.when(norm2 > 0, v / F.sqrt(norm2)).otherwise(F.lit(0.0)))


def hashing(dim: int = settings.EMBEDDING_DIM) -> Callable[[DataFrame], DataFrame]:
    """Provider that adds ``vector`` and ``norm2`` computed from ``text``."""
    counts = hash_counts(dim)

    def embed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("vector", counts("text")).withColumn("norm2", squared_norm(F.col("vector")))

    return embed


def precomputed(vectors: DataFrame, keys: list[str], dim: int) -> Callable[[DataFrame], DataFrame]:
    """Provider that joins stored vectors on ``keys``; rows without one get null.

    Keys are unique in ``vectors``. A vector of another width fails the job.
    """
    wide = vectors.select(
        *keys,
        F.when(F.size("embedding") == dim, F.col("embedding").cast("array<double>"))
        .otherwise(F.raise_error(F.concat(F.lit(f"expected {dim} values, found "), F.size("embedding").cast("string"))))
        .alias("vector"),
    ).withColumn("norm2", F.aggregate("vector", F.lit(0.0), lambda total, v: total + v * v))
    return lambda rows: rows.join(wide, keys, "left")


def embedding_provider(name: str, **options) -> Callable[[DataFrame], DataFrame]:
    providers = {"hashing": hashing, "precomputed": precomputed}
    if name not in providers:
        raise ValueError(f"unknown embedding provider {name!r}, expected one of {sorted(providers)}")
    return providers[name](**options)
