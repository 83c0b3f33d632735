"""Large JSON pages read by byte ranges: one page is the work of many tasks.

Spark cuts the files, as fragments that end in ``}``. A task joins fragments to
segments of about a megabyte and counts brackets for both cases, that the segment
begins inside a string or outside of one. Running sums over these few numbers tell
where each segment really begins; from there every segment is cut on its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundspark.runtime import rows_fit, write_table

SEGMENT_BYTES = 1 << 20
# Files that Spark cannot cut, by their names' endings; fixed values.
COMPRESSED = r"\.(gz|bz2|zst|lz4|snappy|deflate|xz)$"
SEGMENT = ["page_file", "block", "number"]
COUNTS = ["quotes", "rise_outside", "low_outside", "rise_inside", "low_inside"]
# Depth of what stands in a list of the page: the page is 1, its list 2.
LISTED = 2
# The part number of the element that is still open where its segment ends.
OPEN = -1

SKELETON, WHOLE, EDGE = 0, 1, 2
PIECES = "page_file string, segment long, kind int, of_segment long, of_part int, text binary, reason string"


def marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of brackets, +1 or -1 for each, and the number of quotes before it; last the number of all quotes.

    ``data`` begins where no backslash precedes.
    """
    quotes = np.flatnonzero(data == ord('"'))
    if len(quotes) and (data[np.maximum(quotes - 1, 0)] == ord("\\")).any():
        plain = np.flatnonzero(data != ord("\\"))
        before = np.searchsorted(plain, quotes)
        run = quotes - 1 - np.where(before > 0, plain[np.maximum(before - 1, 0)], -1)
        quotes = quotes[run % 2 == 0]
    folded = data | 32
    places = np.flatnonzero((folded == ord("{")) | (folded == ord("}")))
    steps = np.where(folded[places] == ord("{"), 1, -1)
    return places, steps, np.append(np.searchsorted(quotes, places), len(quotes))


def counts(data: np.ndarray) -> list[int]:
    """COUNTS of a segment: quotes, and how far the depth rises and falls in either case."""
    _, steps, quotes = marks(data)
    found = [int(quotes[-1])]
    for inside in (0, 1):
        depth = np.cumsum(steps[quotes[:-1] % 2 == inside])
        found += [int(depth[-1]), int(depth.min())] if len(depth) else [0, 0]
    return found


def segments(spark: SparkSession, path: str | list[str], larger_than: int, with_body: bool) -> DataFrame:
    """SEGMENT, file_size, n_bytes and either the body or COUNTS of every segment of the large files."""
    source = F.col("_metadata")
    lines = spark.read.text(path, lineSep="}").filter((source["file_size"] > larger_than) & ~source["file_path"].rlike(COMPRESSED))
    lines = lines.select(source["file_path"].alias("page_file"), source["file_block_start"].alias("block"), source["file_size"].alias("file_size"), "value")
    tail = "body binary" if with_body else ", ".join(f"{c} long" for c in COUNTS)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, number, held, size = None, 0, [], 0

        def flush() -> pa.RecordBatch:
            body = b"}".join(held) + b"}"
            found = [body] if with_body else counts(np.frombuffer(body, np.uint8))
            row = [key[0], key[1], number, key[2], len(body), *found]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=[*SEGMENT, "file_size", "n_bytes", *(["body"] if with_body else COUNTS)])

        for batch in batches:
            files, values = batch.column("page_file"), batch.column("value").cast(pa.binary())
            blocks, sizes = batch.column("block").to_pylist(), batch.column("file_size").to_pylist()
            for row, file in enumerate(files.to_pylist()):
                here = (file, blocks[row], sizes[row])
                if here != key or size >= SEGMENT_BYTES:
                    if held:
                        yield flush()
                    number, held, size, key = (number + 1 if here == key else 0), [], 0, here
                held.append(values[row].as_py())
                size += len(held[-1]) + 1
        if held:
            yield flush()

    return lines.mapInArrow(gather, f"page_file string, block long, number long, file_size long, n_bytes long, {tail}")


def begins(slim: DataFrame) -> DataFrame:
    """SEGMENT with segment (its number in the file) and how it begins: in_string, depth, of_segment, and spare.

    ``of_segment`` is the segment where the element began that is open here;
    ``spare`` says that the file has no ``}`` at its end, so that the last one is not its own.
    """
    order = Window.partitionBy("page_file").orderBy("block", "number")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    rows = slim.withColumn("segment", F.row_number().over(order).cast("long")).withColumn("in_string", so_far("quotes") % 2 == 1)
    for c in ("rise", "low"):
        rows = rows.withColumn(c, F.when(F.col("in_string"), F.col(f"{c}_inside")).otherwise(F.col(f"{c}_outside")))
    rows = rows.withColumn("depth", so_far("rise"))
    left_open = (F.col("depth") + F.col("rise") > LISTED) & ((F.col("depth") <= LISTED) | (F.col("depth") + F.col("low") <= LISTED))
    rows = rows.withColumn("_opens", F.when(left_open, F.col("segment")))
    file = Window.partitionBy("page_file")
    spare = (F.sum("n_bytes").over(file) > F.col("file_size")) & (F.col("segment") == F.max("segment").over(file))
    return rows.select(*SEGMENT, "segment", "in_string", "depth", F.last("_opens", ignorenulls=True).over(before).alias("of_segment"), spare.alias("spare"))


def cut_segment(body: bytes, segment: int, in_string: bool, depth: int, of_segment: int | None) -> Iterator[tuple[int, int, int, bytes]]:
    """(kind, of_segment, of_part, text): what a segment holds of its page.

    Elements of the page's lists leave the text; a stand-in ``{"":[segment,part]}`` takes
    their place in the skeleton. An element that passes the segment's ends leaves as edges.
    """
    places, steps, quotes = marks(np.frombuffer(body, np.uint8))
    outside = quotes[:-1] % 2 == int(in_string)
    places, steps = places[outside], steps[outside]
    after = depth + np.cumsum(steps)
    starts = places[(steps > 0) & (after == LISTED + 1)].tolist()
    ends = (places[(steps < 0) & (after == LISTED)] + 1).tolist()
    skeleton, at = [], 0
    if depth > LISTED:
        at = ends.pop(0) if ends else len(body)
        yield EDGE, of_segment, OPEN, body[:at]
    for part, start in enumerate(starts):
        skeleton.append(body[at:start])
        if part < len(ends):
            at = ends[part]
            yield WHOLE, segment, part, body[start:at]
        else:
            part, at = OPEN, len(body)
            yield EDGE, segment, part, body[start:]
        skeleton.append(b'{"":[%d,%d]}' % (segment, part))
    skeleton.append(body[at:])
    yield SKELETON, segment, 0, b"".join(skeleton)


def ranged_studies(
    spark: SparkSession,
    path: str | list[str],
    larger_than: int,
    cut_page: Callable[[str], Iterator[tuple[int, str | None, str | None]]],
    read_study: Callable[[str], tuple[str | None, str | None]],
) -> DataFrame:
    """(page_file, position, raw, reason) of files of more than ``larger_than`` bytes.

    What ``cut_page`` gives for a whole page, but elements are held one at a time. One
    task holds a page's skeleton: its keys and some bytes for each element. Nothing
    follows the first row of a page that ``read_study`` or ``cut_page`` cannot read.
    """
    state = write_table(begins(segments(spark, path, larger_than, False)), "page-segments")
    bodies = segments(spark, path, larger_than, True)
    joined = bodies.join(F.broadcast(state) if rows_fit(state, 100_000) else state, SEGMENT)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                of = {c: batch.column(c)[row].as_py() for c in ("page_file", "segment", "in_string", "depth", "of_segment", "spare", "body")}
                body, found = (of["body"][:-1] if of["spare"] else of["body"]), []
                for kind, segment, part, text in cut_segment(body, of["segment"], of["in_string"], of["depth"], of["of_segment"]):
                    reason = None
                    if kind == WHOLE:
                        text, reason = as_study(text)
                    found.append((of["page_file"], of["segment"], kind, segment, part, text, reason))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), PIECE_TYPES, strict=True)], names=PIECE_NAMES)

    def as_study(text: bytes) -> tuple[bytes | None, str | None]:
        try:
            raw, reason = read_study(text.decode())
        except UnicodeDecodeError as error:
            raw, reason = None, str(error)
        return (None if raw is None else raw.encode()), reason

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [as_study(b"".join(p["text"] for p in pieces)) for pieces in batch.column("pieces").to_pylist()]
            columns = [batch.column("page_file"), batch.column("of_segment"), batch.column("of_part"), pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_file", "of_segment", "of_part", "text", "reason"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, pieces in zip(batch.column("page_file").to_pylist(), batch.column("pieces"), strict=True):
                page = b"".join(p["text"] for p in pieces.as_py()).decode(errors="replace")
                found = []
                for position, raw, reason in cut_page(page):
                    stands_for = raw is not None and raw.startswith('{"":[')
                    segment, part = map(int, raw[5:-2].split(",")) if stands_for else (None, None)
                    found.append((file, position, segment, part, None if stands_for else raw, reason))
                if found:
                    types = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=["page_file", "position", "of_segment", "of_part", "plain", "page_reason"])

    pieces = write_table(joined.mapInArrow(cut, PIECES), "page-pieces")
    in_order = F.array_sort(F.collect_list(F.struct("segment", "text"))).alias("pieces")
    edges = pieces.filter(F.col("kind") == EDGE).groupBy("page_file", "of_segment", "of_part").agg(in_order)
    edges = edges.mapInArrow(close, "page_file string, of_segment long, of_part int, text binary, reason string")
    elements = pieces.filter(F.col("kind") == WHOLE).select("page_file", "of_segment", "of_part", "text", "reason").unionByName(edges)
    skeletons = pieces.filter(F.col("kind") == SKELETON).groupBy("page_file").agg(in_order)
    listed = write_table(skeletons.mapInArrow(index, "page_file string, position int, of_segment long, of_part int, plain string, page_reason string"), "page-index")
    listed = F.broadcast(listed) if rows_fit(listed, 100_000) else listed
    key = ["page_file", "of_segment", "of_part"]
    standing = listed.filter("of_segment IS NOT NULL").drop("plain", "page_reason")
    rows = elements.join(standing, key).select("page_file", "position", F.col("text").cast("string").alias("raw"), "reason")
    rows = rows.unionByName(listed.filter("of_segment IS NULL").select("page_file", "position", F.col("plain").alias("raw"), F.col("page_reason").alias("reason")))
    stops = rows.filter("reason IS NOT NULL").groupBy("page_file").agg(F.min("position").alias("_stop"))
    return rows.join(stops, "page_file", "left").filter("_stop IS NULL OR position <= _stop").drop("_stop")


PIECE_NAMES = ["page_file", "segment", "kind", "of_segment", "of_part", "text", "reason"]
PIECE_TYPES = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.string()]
