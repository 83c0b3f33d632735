"""Token ids in binary shards: frequency-ranked, byte-aligned, with separate control bytes.

A shard holds documents in ascending doc_id order. Its layout, little-endian:

    magic "GTS1", documents u4, dictionary size u4, tokens u8
    dictionary u4[]      token id of each rank, the most frequent id of the shard first
    doc_id i8[], known u1[] (0: the id is null), length u4[]
    control u1[]         four 2-bit byte counts (less one) of four ranks each
    data u1[]            the ranks, 1 to 4 bytes each

Every shard ranks its own ids, so one pass over the texts is enough and a shard
can be read without any other. Shards are rows of a Parquet table, which gives
them Spark's commit protocol on any store.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundspark.llm.tokens import encoder, row_blocks
from groundspark.runtime import shared_folder

MAGIC = b"GTS1"
HEAD = "<4sIIQ"
SHARD_TOKENS = 8_000_000
# Byte counts of the four ranks behind each control byte.
BYTES_OF = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1

SHARD_SCHEMA = "part int, seq int, n_docs long, n_tokens long, shard binary"
DOC_SCHEMA = "part int, seq int, doc_id long, before long, n_tokens long, ids_crc32 long"


def pack_ranks(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    four = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    four[: len(ranks)] = extra
    four = four.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    return control.astype(np.uint8), data


def unpack_ranks(control: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    """Inverse of ``pack_ranks``: byte counts come from a table looked up by control byte."""
    sizes = BYTES_OF[control].ravel()[:count]
    begins = np.cumsum(sizes, dtype=np.int64) - sizes
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    ranks = padded[begins].astype(np.uint32)
    for more in (1, 2, 3):
        wide = np.flatnonzero(sizes > more)
        if not len(wide):
            break
        ranks[wide] |= padded[begins[wide] + more].astype(np.uint32) << np.uint32(8 * more)
    return ranks


def write_shard(doc_ids: list, documents: list[np.ndarray]) -> bytes:
    """One shard of documents, given as their ids."""
    ids = np.concatenate(documents) if documents else np.zeros(0, np.uint32)
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    seen = np.flatnonzero(counts)
    ranked = seen[np.lexsort((seen, -counts[seen]))].astype("<u4")
    rank_of = np.zeros(len(counts), np.uint32)
    rank_of[ranked] = np.arange(len(ranked), dtype=np.uint32)
    control, data = pack_ranks(rank_of[ids])
    known = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    lengths = np.array([len(d) for d in documents], "<u4")
    head = struct.pack(HEAD, MAGIC, len(documents), len(ranked), len(ids))
    return b"".join([head, *(a.tobytes() for a in (ranked, numbers, known, lengths, control, data))])


def read_shard(shard: bytes) -> tuple[list, list[np.ndarray]]:
    """Document ids and token ids of one shard."""
    magic, docs, size, count = struct.unpack_from(HEAD, shard)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    at, parts = struct.calcsize(HEAD), []
    for kind, number in (("<u4", size), ("<i8", docs), ("u1", docs), ("<u4", docs), ("u1", -(-count // 4))):
        parts.append(np.frombuffer(shard, kind, number, at))
        at += parts[-1].nbytes
    ranked, numbers, known, lengths, control = parts
    ids = ranked[unpack_ranks(control, np.frombuffer(shard, "u1", -1, at), count)]
    return [int(n) if k else None for n, k in zip(numbers, known, strict=True)], np.split(ids, np.cumsum(lengths)[:-1].astype(np.int64)) if docs else []


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int | None = 2, folder: str | None = None) -> str:
    """Write ``docs`` (doc_id, text) as shards in ascending doc_id order; returns the folder.

    Rows are dealt by ranges of doc_id, ties and nulls (first) by a hash of the
    text, so a repeated doc_id cannot fill one task. A null text counts as empty;
    repeated rows are each kept; an empty table gives a folder without shards.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, numbers, held, tokens = TaskContext.get().partitionId(), 0, [], [], 0
        end = np.array([] if end_id is None else [end_id], np.uint32)

        def shard() -> pa.RecordBatch:
            row = [[part], [seq], [len(held)], [tokens], [write_shard(numbers, held)]]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            names = ("part", "seq", "n_docs", "n_tokens", "shard")
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            texts = batch.column("text")
            for a, b in row_blocks(texts):
                documents = [np.concatenate([d, end]) for d in encoder(tokenizer).encode(texts.slice(a, b - a))]
                for number, document in zip(batch.column("doc_id").slice(a, b - a).to_pylist(), documents, strict=True):
                    numbers.append(number)
                    held.append(document)
                    tokens += len(document)
                    if tokens >= SHARD_TOKENS:
                        yield shard()
                        seq, numbers, held, tokens = seq + 1, [], [], 0
        if held:
            yield shard()

    dealt = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.mapInArrow(encode, SHARD_SCHEMA).write.option("compression", "none").parquet(folder)
    return folder


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document read back from shards: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before this one. Only the totals of
    shards, one small row each, are summed in order.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(folder)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                numbers, documents = read_shard(batch.column("shard")[row].as_py())
                sizes = np.array([len(d) for d in documents], np.int64)
                columns = {
                    "part": np.full(len(sizes), batch.column("part")[row].as_py(), np.int32),
                    "seq": np.full(len(sizes), batch.column("seq")[row].as_py(), np.int32),
                    "doc_id": pa.array(numbers, pa.int64()),
                    "before": np.cumsum(sizes) - sizes,
                    "n_tokens": sizes,
                    "ids_crc32": np.array([zlib.crc32(d.astype("<u4").tobytes()) for d in documents], np.int64),
                }
                yield pa.RecordBatch.from_pydict(columns)

    totals = shards.select("part", "seq", F.col("n_tokens").alias("shard_tokens"))
    earlier = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("shard_start", F.coalesce(F.sum("shard_tokens").over(earlier), F.lit(0)))
    return (
        shards.select("part", "seq", "shard").mapInArrow(decode, DOC_SCHEMA)
        .join(totals, ["part", "seq"])
        .select("doc_id", (F.col("shard_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
    )
