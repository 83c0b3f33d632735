"""Near-duplicates by consistent weighted sampling over TF-IDF word shingles.

A shingle is five words in a row, lower-cased and without punctuation. It weighs
``(1 + ln tf) * idf`` with a damped idf between 1 and 1.25, from document
frequencies counted over all documents in a table of hashed cells. Improved
consistent weighted sampling draws ``BANDS * ROWS`` samples of a document; two
documents agree in one with the probability of their weighted Jaccard similarity.
Documents that agree in all samples of a band are candidates; weighted Jaccard is
then computed exactly.

Equal documents are one class. In a bucket of classes every class meets the most
central one first; only classes that this leaves in another component are compared
with the rest, block by block, so a large group of copies is not squared.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark.llm.graph import components
from groundspark.llm.tokens import row_blocks
from groundspark.runtime import BROADCAST_KEYS, rows_fit, write_table

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 8, 3
CELL_BITS = 16
DAMPING = 0.25
# Classes of a bucket that meet in one comparison.
BLOCK = 128
DRAW_BITS = 16
NO_ID = (1 << 63) - 1

ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * ODD[3]
    values = (values ^ (values >> np.uint64(29))) * ODD[0]
    return values ^ (values >> np.uint64(32))


def shingles(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted shingle hashes and their counts for each text.

    A text of fewer words is one shingle of them all, one without words a single
    shingle of its characters; a null or blank text has none.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    words = np.array([re.sub(r"\W+", "", w) for w in coded.dictionary.to_pylist()], dtype=object)
    if not len(words):
        return [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * len(texts)
    hashes = pd.util.hash_array(words, categorize=False)
    full = np.array([bool(w) for w in words])
    indices = coded.indices.to_numpy(zero_copy_only=False)
    words_at, keep = hashes[indices], full[indices]
    ends = np.cumsum(counts)
    done = []
    for row, (begin, end) in enumerate(zip((ends - counts).tolist(), ends.tolist(), strict=True)):
        here = words_at[begin:end][keep[begin:end]]
        if len(here):
            size = min(WORDS, len(here))
            total = np.zeros(len(here) - size + 1, np.uint64)
            for k in range(size):
                total += mix(here[k : k + len(total)] + ODD[k])  * ODD[k]
            done.append(np.unique(mix(total), return_counts=True))
        else:
            bare = "".join(texts[row].as_py().split())
            found = pd.util.hash_array(np.array([bare], dtype=object), categorize=False) if bare else np.zeros(0, np.uint64)
            done.append((found, np.ones(len(found), np.int64)))
    return done


def cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """``ln``-damped idf of every cell, from counts over all documents.

    A cell counts the documents' distinct shingles that hash into it: an upper bound
    of each one's document frequency whose excess is the same share of the corpus at
    any size. Tasks count first; at most 2^16 sums reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs_seen = np.zeros(1 << CELL_BITS, np.int64), 0
        for batch in batches:
            for a, b in row_blocks(batch.column(0)):
                found = shingles(batch.column(0).slice(a, b - a))
                docs_seen += len(found)
                total += np.bincount(cells(np.concatenate([h for h, _ in found])), minlength=1 << CELL_BITS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": np.append(used, -1), "n": np.append(total[used], docs_seen)})

    sums = docs.select(F.col("text").cast("string")).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    frequency, documents = np.zeros(1 << CELL_BITS, np.float64), 1
    for row in sums:
        if row["cell"] < 0:
            documents = max(1, row["n"])
        else:
            frequency[row["cell"]] = row["n"]
    return (1 + DAMPING * np.log1p(documents / np.maximum(frequency, 1)) / np.log1p(documents)).astype(np.float32)


@cache
def draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sampling scheme's r, ln c and beta, 2^16 of each; a keyed hash of shingle and sample picks one."""
    draw = np.random.default_rng(20)
    r, c = (draw.gamma(2.0, 1.0, 1 << DRAW_BITS).astype(np.float32) for _ in range(2))
    return r, np.log(c), draw.random(1 << DRAW_BITS).astype(np.float32)


def signature(hashes: np.ndarray, weights: np.ndarray, samples: int = BANDS * ROWS) -> np.ndarray:
    """Improved consistent weighted sampling: one hash of (shingle, level) per sample."""
    r, log_c, beta = draws()
    keys = mix(np.arange(1, samples + 1, dtype=np.uint64) * ODD[1]) | np.uint64(1)
    best, chosen = np.full(samples, np.inf, np.float32), np.zeros(samples, np.uint64)
    log_w = np.log(weights)
    for begin in range(0, len(hashes), 4096):
        part, lw = hashes[begin : begin + 4096], log_w[begin : begin + 4096, None]
        pick = ((part[:, None] * keys) >> np.uint64(64 - DRAW_BITS)).astype(np.int64)
        step = r[pick]
        level = np.floor(lw / step + beta[pick])
        cost = log_c[pick] - step * (level - beta[pick] + 1)
        least = cost.argmin(axis=0)
        at = np.arange(samples)
        low = cost[least, at]
        better = low < best
        best = np.where(better, low, best)
        chosen = np.where(better, mix(part[least] + mix(level[least, at].astype(np.int64).view(np.uint64) + keys)), chosen)
    return chosen


def weigh(hashes: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return ((1 + np.log(counts)) * idf[cells(hashes)]).astype(np.float32)


def elements(hashes: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A document as a plain weighted set: the k-th occurrence of a shingle adds the weight that tf = k adds."""
    nth = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + 1
    share = np.where(nth == 1, 1.0, np.log(nth) - np.log(np.maximum(nth - 1, 1)))
    found = np.repeat(hashes, counts)
    return mix(found + nth.astype(np.uint64) * ODD[2]), (share * idf[cells(found)]).astype(np.float64)


def similarities(left: list, right: list) -> np.ndarray:
    """Weighted Jaccard similarity of each left with each right set of (elements, weights)."""
    sizes = np.array([len(e) for e, _ in left + right])
    names, weights = (np.concatenate([d[k] for d in left + right]) for k in (0, 1))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    unique, first, place = np.unique(names, return_index=True, return_inverse=True)
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    shared = np.zeros((len(left), len(right)))
    width = 2048
    cuts = np.searchsorted(place, np.arange(0, len(unique) + width, width))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        dense = np.zeros((len(sizes), width), np.float32)
        dense[owner[a:b], place[a:b] - k * width] = 1
        value = weights[first[k * width : (k + 1) * width]]
        shared += (dense[: len(left), : len(value)] * value) @ dense[len(left) :, : len(value)].T
    sums = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights, len(sizes))
    total = sums[: len(left), None] + sums[None, len(left) :] - shared
    return np.where(total > 0, shared / np.maximum(total, 1e-12), 0.0)


def sign(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """doc_key, text_key, class (null without shingles) and band hashes of every row, written once."""
    share = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b in row_blocks(whole.column("text"), 4 * 1024 * 1024):
                batch, classes, bands = whole.slice(a, b - a), [], []
                for hashes, counts in shingles(batch.column("text")):
                    if not len(hashes):
                        classes.append(None)
                        bands.append(None)
                        continue
                    marks = mix(hashes + counts.astype(np.uint64) * ODD[4])
                    classes.append(np.array([marks.sum(), mix(marks).sum()], np.uint64).tobytes())
                    drawn = signature(hashes, weigh(hashes, counts, share.value)).reshape(BANDS, ROWS)
                    key = np.zeros(BANDS, np.uint64)
                    for k in range(ROWS):
                        key = mix(key * ODD[1] + drawn[:, k])
                    bands.append(key.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_key"), batch.column("text_key"), pa.array(classes, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_key", "text_key", "class", "bands"],
                )

    return write_table(keyed(docs).select("doc_key", "text_key", "text").mapInArrow(run, "doc_key long, text_key long, class binary, bands array<long>"), "signatures")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_key (a null id comes last), text_key (a hash of the text), text, and the whole row as a struct."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_key"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"), F.struct("*").alias("row"))


def weighted_sets(docs: DataFrame, wanted: DataFrame, idf: np.ndarray) -> DataFrame:
    """Elements and weights of the classes in ``wanted`` (class, doc_key, text_key), written once."""
    share = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b in row_blocks(whole.column("text"), 4 * 1024 * 1024):
                batch = whole.slice(a, b - a)
                sets = [elements(h, c, share.value) for h, c in shingles(batch.column("text"))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("class"), pa.array([e.tobytes() for e, _ in sets], pa.binary()), pa.array([w.astype("<f4").tobytes() for _, w in sets], pa.binary())],
                    names=["class", "elements", "weights"],
                )

    # The keys of candidates alone: broadcast where they are counted as few.
    few = F.broadcast(wanted) if rows_fit(wanted, BROADCAST_KEYS) else wanted
    texts = keyed(docs).select("doc_key", "text_key", "text").join(few, ["doc_key", "text_key"]).select("class", "text")
    return write_table(texts.mapInArrow(run, "class binary, elements binary, weights binary").dropDuplicates(["class"]), "weighted-sets")


def compare(members: DataFrame, sets: DataFrame, key: list[str], similarity: float) -> DataFrame:
    """Links (a, b) of components from each group of ``members`` (key, left, class, component).

    The ``left`` classes of a group, at most a block, are compared with the others, at
    most one more. A link is given only where it joins two components that nothing in
    the group has joined so far.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = None, []

        def links() -> Iterator[pa.RecordBatch]:
            left = [(c, s) for is_left, c, s in held if is_left]
            right = [(c, s) for is_left, c, s in held if not is_left]
            root = {c: c for c, _ in left + right}
            if not left or not right or len(root) < 2:
                return
            near = similarities([s for _, s in left], [s for _, s in right]) >= similarity

            def find(c: bytes) -> bytes:
                while root[c] != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c

            found = []
            for i, j in zip(*np.nonzero(near), strict=True):
                a, b = left[i][0], right[j][0]
                if find(a) != find(b):
                    root[find(a)] = find(b)
                    found.append((a, b))
            if found:
                yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(len(key) + 1)]
            named, elems, weights = (batch.column(len(key) + 1 + k) for k in range(3))
            for row in range(batch.num_rows):
                name = tuple(c[row] for c in columns[:-1])
                if name != names:
                    yield from links()
                    names, held = name, []
                held.append((columns[-1][row], named[row].as_py(), (np.frombuffer(elems[row].as_py(), np.uint64), np.frombuffer(weights[row].as_py(), "<f4").astype(np.float64))))
        yield from links()

    rows = members.join(sets, "class").select(*key, "left", "component", "elements", "weights")
    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a binary, b binary")


def further(labels: DataFrame, joined: DataFrame) -> DataFrame:
    """Labels (node, component) after components were joined, given as (component, further)."""
    moved = labels.join(joined, "component", "left").select("node", F.coalesce("further", "component").alias("component"))
    # A component that had no link before is a node of its own.
    fresh = joined.join(labels, joined["component"] == labels["node"], "left_anti").select(F.col("component").alias("node"), F.col("further").alias("component"))
    return moved.unionByName(fresh)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, component_id, kept, and keys of the row.

    ``component_id`` is the smallest doc_id of the component (a null id is last),
    ``kept`` marks its first document; of fully equal rows of that document every
    one is marked, ``copies`` saying how many there are. A null or blank text is in
    no group and kept. An empty table gives an empty result.
    """
    idf = document_frequencies(docs)
    signed = sign(docs, idf)
    classes = signed.filter("class IS NOT NULL").groupBy("class").agg(F.min(F.struct("doc_key", "text_key")).alias("first"), F.first("bands").alias("bands"))
    rows = classes.select("class", "first", F.posexplode("bands").alias("band", "value"))
    sized = rows.groupBy("band", "value").agg(F.count("*").alias("size")).filter("size > 1")
    rows = write_table(rows.join(sized, ["band", "value"]), "buckets")  # only classes that share a bucket
    central = rows.groupBy("class").agg(F.sum("size").alias("weight"))
    hubs = rows.join(central, "class").groupBy("band", "value").agg(F.max_by("class", F.struct("weight", "class")).alias("hub"))
    member = write_table(rows.join(hubs, ["band", "value"]).select("band", "value", "size", "class", "hub"), "members")
    wanted = write_table(rows.select("class", "first.doc_key", "first.text_key").distinct(), "candidates")
    sets = weighted_sets(docs, wanted, idf)

    # Spokes of a hub in blocks, each block with the hub itself.
    spokes = member.filter("class <> hub").groupBy("hub").agg(F.count("*").alias("n"))
    star = member.filter("class <> hub").select("hub", "class").distinct().join(spokes, "hub")
    star = star.withColumn("block", F.pmod(F.xxhash64("class"), F.ceil(F.col("n") / BLOCK).cast("long")))
    star = star.select("hub", "block", F.lit(False).alias("left"), "class")
    star = star.union(star.select("hub", "block").distinct().select("hub", "block", F.lit(True), F.col("hub").alias("class")))
    labels = components(write_table(compare(star.withColumn("component", F.col("class")), sets, ["hub", "block"], similarity), "links"))

    # What is still apart from the hub of its bucket meets the whole bucket.
    named = member.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    of_hub = labels.select(F.col("node").alias("hub"), F.col("component").alias("hub_component"))
    named = named.join(of_hub, "hub", "left").withColumn("home", F.coalesce("hub_component", "hub"))
    open_buckets = named.filter("component <> home").select("band", "value").distinct()
    blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    rest = named.join(open_buckets, ["band", "value"]).filter("class <> hub").withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("class"), blocks))
    rest = write_table(rest.select("band", "value", "class", "component", "home", "blocks", "mine"), "rest")

    def within(rest: DataFrame, same_block: bool) -> DataFrame:
        """Links between the components of a bucket, from classes of one block or of two.

        Only what is apart from the hub's component by now is compared with the others.
        """
        apart = rest.filter("component <> home")
        met = F.col("mine") if same_block else F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: j != F.col("mine")))
        meets = F.col("i") == F.col("j") if same_block else F.col("i") != F.col("j")
        grid = apart.select("band", "value", F.col("mine").alias("i"), met.alias("j"), F.lit(True).alias("left"), "class", "component")
        taken = apart.select("band", "value", F.col("mine").alias("i")).distinct()
        others = rest.select("band", "value", F.col("mine").alias("j"), "class", "component").join(taken, ["band", "value"]).filter(meets)
        others = others.select("band", "value", "i", "j", F.lit(False).alias("left"), "class", "component")
        links = compare(grid.union(others), sets, ["band", "value", "i", "j"], similarity)
        return write_table(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")

    # First inside each block: then a group that belongs together has one component a block, and two blocks one link at most.
    for same_block in (True, False):
        joined = components(within(rest, same_block)).select(F.col("node").alias("component"), F.col("component").alias("further"))
        labels = write_table(further(labels, joined), "labels")
        if same_block:
            of_home = joined.select(F.col("component").alias("home"), F.col("further").alias("home_further"))
            moved = rest.join(joined, "component", "left").withColumn("component", F.coalesce("further", "component"))
            moved = moved.join(of_home, "home", "left").withColumn("home", F.coalesce("home_further", "home"))
            rest = write_table(moved.select(*rest.columns), "rest")

    named = signed.select("doc_key", "text_key", "class").join(labels.withColumnRenamed("node", "class"), "class", "left")
    # A row without class is its own group.
    named = write_table(named.withColumn("component", F.coalesce("component", "class")), "grouped")
    firsts = named.filter("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("doc_key", "text_key")).alias("first"))
    firsts = firsts.join(named.groupBy("component", "doc_key", "text_key").agg(F.count("*").alias("copies")).select(F.col("component"), F.struct("doc_key", "text_key").alias("first"), "copies"), ["component", "first"])
    out = named.join(firsts, "component", "left")
    identity = F.coalesce("first.doc_key", "doc_key")
    return out.select(
        F.nullif("doc_key", F.lit(NO_ID)).alias("doc_id"), F.nullif(identity, F.lit(NO_ID)).alias("component_id"),
        (F.col("first").isNull() | (F.col("first") == F.struct("doc_key", "text_key"))).alias("kept"),
        "doc_key", "text_key", F.coalesce("copies", F.lit(1)).alias("copies"), F.col("first").isNotNull().alias("grouped"),
    )


def keep_first(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, the one of smallest doc_id."""
    found = write_table(near_duplicates(docs, similarity), "near-duplicates")
    gone = found.filter("NOT kept").select("doc_key", "text_key").distinct()
    gone = F.broadcast(gone) if rows_fit(gone, BROADCAST_KEYS) else gone
    left = keyed(docs).select("doc_key", "text_key", "row").join(gone, ["doc_key", "text_key"], "left_anti")
    repeated = found.filter("kept AND grouped AND copies > 1").select("doc_key", "text_key").distinct()
    if not repeated.isEmpty():
        again = left.join(repeated, ["doc_key", "text_key"], "left_semi").dropDuplicates(["doc_key", "text_key"])
        left = left.join(repeated, ["doc_key", "text_key"], "left_anti").unionByName(again)
    return left.select("row.*")
