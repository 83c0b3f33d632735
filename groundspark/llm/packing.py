"""Packing documents into sequences of fixed length from the histogram of lengths.

Shortest-pack-first: lengths are placed longest first, each into the packs with
most room left, or into new ones. What is kept is not packs but patterns with a
count, so the work depends on the number of distinct lengths (at most the sequence
length), not on the number of documents. Documents find their pattern by their
rank among those of equal length.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundspark.llm.tokens import encoder, row_blocks
from groundspark.runtime import write_table

PIECE_SCHEMA = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, part int, place long, ids binary"


def pack_histogram(counts: dict[int, int], size: int) -> pd.DataFrame:
    """Shortest-pack-first over ``length -> count``.

    Rows say that the documents of ``length`` with ranks ``rank`` to ``rank + count - 1``
    lie at ``offset`` of the sequences numbered from ``sequence``, one in each.
    """
    # Open patterns by room left, most first; at equal room the oldest first.
    heap: list[tuple[int, int]] = []
    patterns: dict[int, tuple[int, list[tuple[int, int, int]]]] = {}  # number: (count, [(length, rank, offset)])
    rows, made, sequence = [], 0, 0

    def put(count: int, slots: list, room: int) -> None:
        nonlocal made
        patterns[made] = (count, slots)
        heapq.heappush(heap, (-room, made))
        made += 1

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            if heap and -heap[0][0] >= length:
                room, number = heapq.heappop(heap)
                count, slots = patterns.pop(number)
                used = min(count, left)
                put(used, [*slots, (length, rank, size + room)], -room - length)
                if used < count:
                    patterns[made] = (count - used, [(a, r + used, o) for a, r, o in slots])
                    heapq.heappush(heap, (room, made))
                    made += 1
            else:
                used = left
                put(used, [(length, rank, 0)], size - length)
            left -= used
            rank += used
    for number in sorted(patterns):
        count, slots = patterns[number]
        rows += [(length, rank, count, sequence, offset) for length, rank, offset in slots]
        sequence += count
    table = pd.DataFrame(rows, columns=["length", "rank", "count", "sequence", "offset"]).astype("int64")
    return table.sort_values(["length", "rank"], ignore_index=True)


def cut_pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int | None = 2) -> DataFrame:
    """Pieces of at most ``size`` ids, written once; ``place`` counts equal lengths within a part."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, places = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        end = np.array([] if end_id is None else [end_id], np.uint32)
        for batch in batches:
            texts = batch.column("text")
            for a, b in row_blocks(texts, 4 * 1024 * 1024):
                names = PIECE_SCHEMA.replace(",", "").split()[::2]
                out: dict[str, list] = {name: [] for name in names}
                documents = encoder(tokenizer).encode(texts.slice(a, b - a))
                for number, ids in zip(batch.column("doc_id").slice(a, b - a).to_pylist(), documents, strict=True):
                    ids = np.concatenate([ids, end]).astype("<u4")
                    for start in range(0, len(ids), size):
                        piece = ids[start : start + size]
                        row = (number, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), part, int(places[len(piece)]), piece.astype("<u2").tobytes() if piece.max() < 65536 else piece.tobytes())
                        places[len(piece)] += 1
                        for name, value in zip(names, row, strict=True):
                            out[name].append(value)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(out[n], k) for n, k in zip(names, kinds, strict=True)], names=names)

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return write_table(slim.mapInArrow(cut, PIECE_SCHEMA), "pieces")


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int | None = 2, with_ids: bool = True) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of at most ``size`` ids.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset and, if asked for, ``ids`` (binary, 2 bytes an id, or 4 where one needs them).
    A null text is empty and gives its end id; repeated and null doc_ids keep each
    row's pieces; an empty table, or an empty text without ``end_id``, gives none.
    Ranks of equal lengths are counted per part first and offset by a running sum
    over parts, so a length that a third of all pieces share never meets in a task.
    """
    pieces = cut_pieces(docs, tokenizer, size, end_id)
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    by_part = write_table(by_part, "piece-counts")
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    table = pack_histogram(histogram, size)
    keys = (table["length"].to_numpy() << 44) + table["rank"].to_numpy()
    ranks, sequences, offsets = (table[c].to_numpy() for c in ("rank", "sequence", "offset"))

    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ranked_before"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(keys, (length.to_numpy().astype(np.int64) << 44) + rank.to_numpy(), "right") - 1
        return pd.DataFrame({"sequence_id": sequences[at] + rank.to_numpy() - ranks[at], "offset": offsets[at]})

    columns = ["doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens"]
    placed = pieces.select(*pieces.columns if with_ids else [c for c in pieces.columns if c != "ids"]).join(before, ["length", "part"])
    placed = placed.withColumn("_place", place("length", F.col("place") + F.col("ranked_before")))
    return placed.select(*columns, "_place.sequence_id", "_place.offset", *["ids"] if with_ids else [])
