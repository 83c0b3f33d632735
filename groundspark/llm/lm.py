"""Scoring documents by masked pseudo-likelihood with a bidirectional window network.

Every token is predicted from the two tokens on either side: their embeddings, one
table per place, are summed and squashed, and a two-level softmax (class, then word
of the class) gives the token's log-probability. A document's score is the sum over
its tokens.

The vocabulary follows the corpus: a word counted sqrt(tokens) / 8 times or more over
all documents has an entry of its own (so do the 768 most frequent ones at least), and
classes grow with it. Other words share hashed entries, a quarter of all; what an entry
gets is split among its words by their counts plus one, one more share being left for
all words never counted. Training is numpy in tasks: in each round every task makes one
pass over its documents from the same parameters, which are then averaged by
tokens, in groups of tasks until one set is left.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundspark.llm.tokens import row_blocks
from groundspark.runtime import write_table

SIDE = 2
# The least number of classes, and of words in each, and the entries that makes.
LEAST_SIDE = 32
WORDS = LEAST_SIDE**2
OWN = WORDS * 3 // 4
# A word of sqrt(tokens) / RARER occurrences has its own entry.
RARER = 8
# Words without own entry whose counts go to every task, the most frequent first; others are joined.
LISTED = 1 << 18
# The last row of a table of contexts.
PAD = -1
SIZE = 24
BATCH = 4_096
# Logits within this are exponentiated as they are.
SAFE = 60
ROUNDS = 1
RATE = 0.1
# Sets of parameters averaged in one group.
FAN_IN = 16
# Floats of one piece of parameters between tasks.
PIECE = 1 << 18


def shapes(side: int) -> dict[str, tuple[int, ...]]:
    """Parameters of ``side`` classes of as many words."""
    return {"context": (2 * SIDE, side**2 + 1, SIZE), "hidden": (SIZE,), "class_out": (SIZE, side), "class_bias": (side,), "word_out": (side, SIZE, side), "word_bias": (side, side)}


def side_for(n_known: int) -> int:
    """Classes that hold ``n_known`` own entries and a third as many hashed ones."""
    return max(LEAST_SIDE, math.isqrt(max(0, -(-n_known * 4 // 3) - 1)) + 1)


def own_slots(side: int) -> int:
    return side**2 * 3 // 4


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (lower-cased, without punctuation) of all texts, and words per text."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    words = np.array(coded.dictionary.to_numpy(zero_copy_only=False), dtype=object)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    for k in np.flatnonzero(pc.match_substring_regex(coded.dictionary, "[^a-z0-9_]").to_numpy(zero_copy_only=False)):
        words[k] = re.sub(r"\W+", "", words[k])
    indices = coded.indices.to_numpy(zero_copy_only=False)
    full = np.array([bool(w) for w in words])[indices]
    owner = np.repeat(np.arange(len(texts)), counts)[full]
    return pd.util.hash_array(words, categorize=False)[indices][full].view(np.int64), np.bincount(owner, minlength=len(texts))


def word_counts(docs: DataFrame) -> DataFrame:
    """word (hash) and n of every word of all documents, written once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in row_blocks(batch.column(0)):
                found, n = np.unique(word_hashes(batch.column(0).slice(a, b - a))[0], return_counts=True)
                yield pa.RecordBatch.from_pydict({"word": found, "n": n.astype(np.int64)})

    counts = docs.select(F.col("text").cast("string")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return write_table(counts, "word-counts")


def vocabulary(docs: DataFrame, counts: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the words with own entries, and the count of every entry.

    Those are the words counted sqrt(tokens) / ``RARER`` times or more, or the ``OWN``
    most frequent ones where these are more (ties: the smaller hash).
    """
    counts = word_counts(docs) if counts is None else counts
    enough = math.sqrt(counts.agg(F.sum("n")).first()[0] or 0) / RARER
    often = counts.filter(F.col("n") >= enough)
    if often.count() < OWN:
        often = counts.orderBy(F.col("n").desc(), "word").limit(OWN)
    found = often.toArrow()
    order = np.argsort(found.column("word").to_numpy())
    known, n = found.column("word").to_numpy()[order], found.column("n").to_numpy()[order]
    side = side_for(len(known))
    frequency = np.zeros(side**2, np.int64)
    frequency[: len(known)] = n
    shared = counts.groupBy(shared_cell(side).alias("cell")).agg(F.sum("n").alias("n"))  # one row per hashed entry
    for r in shared.collect():
        frequency[own_slots(side) + r["cell"]] = r["n"]
    np.subtract.at(frequency, own_slots(side) + _cells(known, side), n)
    return known, frequency


def shared_cell(side: int) -> Column:
    return F.shiftrightunsigned("word", 20) % (side**2 - own_slots(side))


def _cells(hashes: np.ndarray, side: int) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(20)).astype(np.int64) % (side**2 - own_slots(side))


def word_ids(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    side = side_for(len(known))
    other = own_slots(side) + _cells(hashes, side)
    if not len(known):
        return other
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at, other)


def windows(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Targets and their contexts, documents apart by padding."""
    owner = np.repeat(np.arange(len(counts)), counts)
    padded = np.full(len(ids) + SIDE * (len(counts) + 1), PAD, np.int64)
    at = np.arange(len(ids)) + SIDE * (owner + 1)
    padded[at] = ids
    return ids, np.stack([padded[at + k] for k in (*range(-SIDE, 0), *range(1, SIDE + 1))])


def start(frequency: np.ndarray) -> np.ndarray:
    """First parameters: small random numbers, and biases that give each word its share of the corpus."""
    draw = np.random.default_rng(11)
    side = math.isqrt(len(frequency))
    flat = np.concatenate([draw.normal(0, 0.1, int(np.prod(s))) for s in shapes(side).values()]).astype(np.float32)
    p, shares = views(flat), (frequency + 1.0).reshape(side, side)
    p["hidden"][:] = 0
    p["class_bias"][:] = np.log(shares.sum(axis=1) / shares.sum())
    p["word_bias"][:] = np.log(shares / shares.sum(axis=1, keepdims=True))
    return flat


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    """The parameters by name; their number tells the number of classes."""
    side = math.isqrt(len(flat) // ((2 * SIDE + 1) * SIZE + 1))
    out, at = {}, 0
    for name, shape in shapes(side).items():
        size = int(np.prod(shape))
        out[name] = flat[at : at + size].reshape(shape)
        at += size
    assert at == len(flat)
    return out


def _grouped(numbers: np.ndarray, limit: int) -> np.ndarray:
    """A stable order by number; small types sort faster."""
    return np.argsort(numbers.astype(np.int16 if limit < 1 << 15 else np.int32), kind="stable")


def _forward(p: dict, target: np.ndarray, context: np.ndarray):
    """Logits of classes and of the words of each target's class; targets come in the order of their classes."""
    hidden = p["context"][0][context[0]]
    for k in range(1, 2 * SIDE):
        hidden += p["context"][k][context[k]]
    hidden += p["hidden"]
    np.tanh(hidden, out=hidden)
    side = len(p["class_bias"])
    of_class = hidden @ p["class_out"]
    of_class += p["class_bias"]
    cuts = np.searchsorted(target, np.arange(side + 1) * side).tolist()
    of_word = np.empty((len(target), side), hidden.dtype)
    for c in range(side):
        a, b = cuts[c], cuts[c + 1]
        if a < b:
            np.matmul(hidden[a:b], p["word_out"][c], out=of_word[a:b])
            of_word[a:b] += p["word_bias"][c]
    return hidden, of_class, of_word, cuts


def _in_range(logits: np.ndarray) -> None:
    """Moves rows in place so that their exponentials neither overflow nor vanish; most need no move."""
    if logits.max() > SAFE or logits.min() < -SAFE:
        logits -= logits.max(axis=1, keepdims=True)


def _exponentials(logits: np.ndarray) -> np.ndarray:
    """Turns logits into shares up to a factor, in place, and gives the sum of each row."""
    np.exp(logits, out=logits)
    return logits @ np.ones(logits.shape[1], logits.dtype)


def log_probabilities(flat: np.ndarray, target: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Log-probability of each target given its context."""
    p, out = views(flat), np.zeros(len(target), np.float32)
    side = len(p["class_bias"])
    for a in range(0, len(target), BATCH):
        by = _grouped(target[a : a + BATCH], side**2)
        t = target[a : a + BATCH][by]
        _, of_class, of_word, _ = _forward(p, t, context[:, a : a + BATCH][:, by])
        at, each = np.arange(len(t)), np.zeros(len(t), np.float32)
        for logits, mine in ((of_class, t // side), (of_word, t % side)):
            _in_range(logits)
            each += logits[at, mine]
            each -= np.log(_exponentials(logits))
        out[a + by] = each
    return out


def learn(flat: np.ndarray, memory: np.ndarray, target: np.ndarray, context: np.ndarray) -> None:
    """One step of gradient descent, scaled by the memory of squared slopes, on each batch; changes both arrays."""
    p, m = views(flat), views(memory)
    side = len(p["class_bias"])

    def step(name: str, rows, slope: np.ndarray) -> None:
        """Only ``rows`` have a slope: all others stay as they are."""
        held = m[name][rows] + slope**2
        m[name][rows] = held
        held += np.float32(1e-10)
        np.sqrt(held, out=held)
        np.divide(slope, held, out=held)
        held *= np.float32(RATE)
        p[name][rows] -= held

    of_words = np.zeros_like(p["word_out"])
    for a in range(0, len(target), BATCH):
        by = _grouped(target[a : a + BATCH], side**2)
        t, c = target[a : a + BATCH][by], context[:, a : a + BATCH][:, by]
        hidden, d_class, d_word, cuts = _forward(p, t, c)
        n = np.float32(len(t))
        at = np.arange(len(t))
        for slope, mine in ((d_class, t // side), (d_word, t % side)):
            _in_range(slope)
            slope *= (1 / (n * _exponentials(slope)))[:, None]
            slope[at, mine] -= 1 / n
        back = d_class @ p["class_out"].T
        step("class_out", ..., hidden.T @ d_class)
        step("class_bias", ..., d_class.sum(axis=0))
        used = [k for k in range(side) if cuts[k] < cuts[k + 1]]
        for k in used:
            rows = slice(cuts[k], cuts[k + 1])
            back[rows] += d_word[rows] @ p["word_out"][k].T
            np.matmul(hidden[rows].T, d_word[rows], out=of_words[k])
        rows = used if len(used) < side else ...
        step("word_out", rows, of_words[rows])
        step("word_bias", rows, np.add.reduceat(d_word, [cuts[k] for k in used], axis=0))
        back *= 1 - hidden**2
        step("hidden", ..., back.sum(axis=0))
        for k in range(2 * SIDE):
            order = _grouped(c[k], side**2)
            names = c[k][order]
            first = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
            step("context", (k, names[first]), np.add.reduceat(back[order], first, axis=0))


def train(docs: DataFrame, known: np.ndarray, frequency: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Parameters after ``rounds`` passes over all documents."""
    flat, spark = start(frequency), docs.sparkSession
    texts = docs.select(F.col("text").cast("string"))
    for _ in range(rounds):
        share = spark.sparkContext.broadcast((known, flat))

        def one_pass(batches: Iterator[pa.RecordBatch], share=share) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            words, mine = share.value
            mine, memory, tokens = mine.copy(), np.full(len(mine), 1e-4, np.float32), 0
            for batch in batches:
                for a, b in row_blocks(batch.column(0), 4 * 1024 * 1024):
                    hashes, counts = word_hashes(batch.column(0).slice(a, b - a))
                    learn(mine, memory, *windows(word_ids(hashes, words), counts))
                    tokens += len(hashes)
            if tokens:
                for k in range(0, len(mine), PIECE):
                    yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "piece": pa.array([k], pa.int64()), "tokens": pa.array([tokens], pa.int64()), "flat": pa.array([mine[k : k + PIECE].tobytes()], pa.binary())})

        schema = "part long, piece long, tokens long, flat binary"
        made = write_table(texts.mapInArrow(one_pass, schema), "parameters")
        groups = (made.agg(F.max("part").alias("n")).first()["n"] or 0) + 1

        def average(group: pa.Table) -> pa.Table:
            order = np.argsort(group.column("part").to_numpy())
            weights = group.column("tokens").to_numpy()[order]
            total = sum(np.frombuffer(group.column("flat")[int(i)].as_py(), np.float32).astype(np.float64) * w for i, w in zip(order, weights, strict=True))
            return pa.table({"part": pa.array([int(group.column("part")[0].as_py()) // FAN_IN], pa.int64()), "piece": group.column("piece").slice(0, 1), "tokens": pa.array([int(weights.sum())], pa.int64()), "flat": pa.array([(total / weights.sum()).astype(np.float32).tobytes()], pa.binary())})

        while groups > 1:
            made = write_table(made.groupBy("piece", F.expr(f"part div {FAN_IN}").alias("_group")).applyInArrow(average, schema), "parameters")
            groups = -(-groups // FAN_IN)
        last = made.orderBy("piece").collect()
        if not last:
            break
        flat = np.concatenate([np.frombuffer(r["flat"], np.float32) for r in last])
    return flat


def shares_of(known: np.ndarray, counts: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], DataFrame | None]:
    """How hashed entries are split: the logarithm of each one's shares in all, listed words and their counts; and the table of words that are not listed."""
    side = side_for(len(known))
    own = counts.sparkSession.createDataFrame(pd.DataFrame({"word": pd.Series(known, dtype="int64")}), "word long")
    rest = write_table(counts.join(F.broadcast(own), "word", "left_anti"), "shared-words")
    total = np.ones(side**2 - own_slots(side))
    for r in rest.groupBy(shared_cell(side).alias("cell")).agg(F.sum(F.col("n") + 1).alias("n")).collect():  # one row per hashed entry
        total[r["cell"]] += r["n"]
    # Counts of words and how many have them, in steps of a hundredth: a few thousand rows at any size.
    level = F.floor(F.log("n") * 100).cast("long")
    steps, held, least = rest.groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.col("level").desc()).collect(), 0, None
    for r in steps:
        held += r["words"]
        if held > LISTED:
            break
        least = r["level"]
    listed = rest.filter(level >= least).toArrow() if least is not None else pa.table({"word": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    order = np.argsort(listed.column("word").to_numpy())
    tail = rest.filter(level < least) if least is not None else rest
    return (np.log(total), listed.column("word").to_numpy()[order], listed.column("n").to_numpy()[order]), tail if held > LISTED else None


def score(docs: DataFrame, known: np.ndarray, flat: np.ndarray, counts: DataFrame | None = None) -> DataFrame:
    """doc_id, n_tokens, log_prob (sum) and mean_log_prob (null without tokens) of each row.

    With the ``counts`` of words every token is predicted as itself, otherwise as its
    entry. Words that are not counted have one share of their entry.
    """
    split, tail = shares_of(known, counts) if counts is not None else (None, None)
    share = docs.sparkSession.sparkContext.broadcast((known, flat, split))
    joined = tail is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, parameters, shares = share.value
        side, row = side_for(len(words)), TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b in row_blocks(batch.column("text"), 4 * 1024 * 1024):
                hashes, counts = word_hashes(batch.column("text").slice(a, b - a))
                ids = word_ids(hashes, words)
                each = log_probabilities(parameters, *windows(ids, counts)).astype(np.float64)
                open_words, open_counts = np.zeros(0, np.int64), np.zeros(len(counts), np.int64)
                if shares is not None:
                    log_total, listed, n = shares
                    other = np.flatnonzero(ids >= own_slots(side))
                    each[other] -= log_total[ids[other] - own_slots(side)]
                    found = np.zeros(len(other), bool)
                    if len(listed):
                        at = np.minimum(np.searchsorted(listed, hashes[other]), len(listed) - 1)
                        found = listed[at] == hashes[other]
                        each[other[found]] += np.log1p(n[at[found]])
                    if joined:
                        open_words = hashes[other[~found]]
                        open_counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[other[~found]], minlength=len(counts))
                ends = np.concatenate([[0.0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(counts)])]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(open_counts)]).astype(np.int32)), pa.array(open_words, pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(counts), pa.array(np.diff(ends)), pa.array(row + np.arange(b - a)), lists], names=["doc_id", "n_tokens", "log_prob", "row", "open"])
                row += b - a

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = rows.mapInArrow(run, "doc_id long, n_tokens long, log_prob double, row long, open array<long>")
    if joined:
        scored = write_table(scored, "scores")
        # Whole billionths: sums do not depend on their order.
        gain = F.sum(F.round(F.log(F.coalesce("n", F.lit(0)) + 1) * 1e9).cast("long"))
        gains = scored.select("row", F.explode("open").alias("word")).join(tail, "word", "left").groupBy("row").agg(gain.alias("gain"))
        scored = scored.drop("open").join(gains, "row", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("gain", F.lit(0)) / 1e9)
    mean = F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens"))
    return scored.select("doc_id", "n_tokens", "log_prob", mean.alias("mean_log_prob"))


def pseudo_likelihood(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Train on ``docs`` and score each of them.

    Null and empty texts, and texts without words, have no tokens: log_prob 0 and a
    null mean. Repeated rows and ids score alike; an empty table gives no rows.
    """
    counts = word_counts(docs)
    known, frequency = vocabulary(docs, counts)
    return score(docs, known, train(docs, known, frequency, rounds), counts)
