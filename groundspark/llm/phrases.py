r"""Phrase collocation mining: phrases of two to five words that stand together more often than chance.

Phrases are counted in HAT-tries: a shallow trie over word ids whose leaves are hash
containers that burst into a further level when they grow. A task holds one trie of
bounded size; when it is full, its largest subtrees leave whole as sorted runs, and
Spark merges the runs of all tasks by partitions of their first words.

A phrase cannot be more frequent than its parts. So words are counted first, then
pairs of frequent words, then longer phrases within chains of frequent pairs. Tasks
know what is frequent from a bit table of bounded size, in which a rare one can pass
for frequent; that costs work, and the counts, which are exact, then remove it.

Word ids are 64-bit hashes of language and word, checked for collisions over all
words counted and drawn anew if there is one. The most frequent words, as many as fit
a bounded table, are coded by their rank instead, which keeps the runs small.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from groundspark.llm.tokens import row_blocks
from groundspark.runtime import skew_join, write_table

LONGEST = 5
BREAKS = r"[.,;:!?\x0A-\x0D]"
UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
BLOCK_BYTES = 4 * 1024 * 1024
# A container of more entries bursts; a trie of more spills.
BURST = 4_096
TRIE_ENTRIES = 500_000
# Bit tables have eight bits a key, within these bounds: 64 MB at most.
FEWEST_BITS, MOST_BITS = 16, 29
# Words coded by rank: a table of 16 bytes each that every task is given.
RANKED_WORDS = 1_000_000
SPREAD = np.uint64(0x9E3779B97F4A7C15)


class HatTrie:
    """Counts of sequences of ``depth`` ids, each given as bytes, eight an id.

    Inner nodes map an id to a child; a leaf is a hash table from the rest of a
    sequence to its count, and becomes an inner node when it outgrows ``burst``.
    """

    class Node(dict):
        """An inner node."""

    def __init__(self, depth: int, burst: int = BURST):
        self.depth, self.burst = depth, burst
        self.root = HatTrie.Node()
        self.sizes: dict[bytes, int] = {}
        self.entries = 0

    def add(self, first: bytes, rests: list[bytes], counts: list[int]) -> None:
        """Add sequences that begin with the id ``first``."""
        before = self.sizes.get(first, 0)
        grown, more = self._add(self.root.get(first, None), rests, counts, self.depth - 1)
        self.root[first] = grown
        self.sizes[first] = before + more
        self.entries += more

    def _add(self, node: dict | None, rests: list[bytes], counts: list[int], depth: int) -> tuple[dict, int]:
        if isinstance(node, HatTrie.Node):
            by_next: dict[bytes, tuple[list, list]] = {}
            for rest, count in zip(rests, counts, strict=True):
                some = by_next.setdefault(rest[:8], ([], []))
                some[0].append(rest[8:])
                some[1].append(count)
            more = 0
            for own, (tails, numbers) in by_next.items():
                node[own], new = self._add(node.get(own), tails, numbers, depth - 1)
                more += new
            return node, more
        leaf = {} if node is None else node
        before = len(leaf)
        held = leaf.get
        for rest, count in zip(rests, counts, strict=True):
            leaf[rest] = held(rest, 0) + count
        more = len(leaf) - before
        if len(leaf) > self.burst and depth > 1:
            grown, _ = self._add(HatTrie.Node(), list(leaf), list(leaf.values()), depth)
            return grown, more
        return leaf, more

    def _run(self, node: dict, prefix: bytes) -> Iterator[tuple[bytes, int]]:
        for key in sorted(node):
            if isinstance(node, HatTrie.Node):
                yield from self._run(node[key], prefix + key)
            else:
                yield prefix + key, node[key]

    def spill(self, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Take out whole subtrees, the largest first, until ``keep`` entries are left: sorted runs of ids and counts."""
        for first in sorted(self.sizes, key=lambda f: (-self.sizes[f], f)):
            if self.entries <= keep:
                return
            self.entries -= self.sizes.pop(first)
            keys, counts = zip(*self._run(self.root.pop(first), first), strict=True)
            yield np.frombuffer(b"".join(keys), ">u8").reshape(-1, self.depth).astype(np.uint64), np.array(counts, np.int64)


def word_ids(langs: np.ndarray, words: np.ndarray, seed: int) -> np.ndarray:
    """Ids of words of a language: 64-bit numbers with the highest bit set, so never 0 or a rank."""
    key = f"phrases-{seed:08d}"
    own, lang = (pd.util.hash_array(a.astype(object), hash_key=key, categorize=False) for a in (words, langs))
    mixed = (own ^ (lang * SPREAD)) * SPREAD
    return (mixed ^ (mixed >> np.uint64(29))) | np.uint64(1 << 63)


class Ranks:
    """The ids that are coded by rank, from 1; all others keep their id."""

    def __init__(self, ids: np.ndarray, uses: np.ndarray):
        order = np.lexsort((ids, -uses))
        by_id = np.argsort(ids[order], kind="stable")
        self.ids, self.rank = ids[order][by_id], (by_id + 1).astype(np.uint64)

    def code(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of ids, and which of them are ranks."""
        if not len(self.ids):
            return ids, np.zeros(len(ids), bool)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        met = self.ids[at] == ids
        return np.where(met, self.rank[at], ids), met


def rank_words(frequent: DataFrame, most: int) -> Ranks:
    """Ranks of the words with most uses: all from a power of two of uses on, so that they are at most ``most``."""
    level = F.floor(F.log2("f")).cast("int").alias("level")
    least, taken = 63, 0
    for row in frequent.groupBy(level).count().orderBy(F.col("level").desc()).collect():
        taken += row["count"]
        if taken > most:
            break
        least = row["level"]
    found = frequent.filter(F.col("f") >= F.lit(1 << least if least < 63 else (1 << 63) - 1)).select("id", "f").toArrow()
    return Ranks(found.column("id").to_numpy().view(np.uint64), found.column("f").to_numpy())


def cells(ids: np.ndarray, bits: int) -> np.ndarray:
    """Places of rows of ids in a table of 2^bits bits."""
    place = np.zeros(len(ids), np.uint64)
    for column in ids.T:
        place = (place ^ column) * SPREAD
        place ^= place >> np.uint64(31)
    return place >> np.uint64(64 - bits)


class Words:
    """The words of a block of texts: ``code`` of each, 0 at the end of a piece, and the id of each code."""

    def __init__(self, texts: pa.Array, langs: pa.Array, seed: int):
        texts = pc.fill_null(texts.cast(pa.string() if texts.nbytes < 1 << 28 else pa.large_string()), "")
        langs = pc.fill_null(langs, "und").dictionary_encode()
        pieces = pc.replace_substring(pc.replace_substring_regex(pc.ascii_lower(texts), BREAKS, " \n "), "\t", " ")
        lists = pc.split_pattern(pieces, " ")
        rows = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
        coded = lists.flatten().dictionary_encode()
        words, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        stop, empty = pc.index(words, "\n").as_py(), pc.index(words, "").as_py()
        full = code != empty
        rows, code = rows[full], code[full]
        wide = max(1, len(words))
        pair = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[rows] * wide + code
        seen, inverse, self.uses = np.unique(pair, return_inverse=True, return_counts=True)
        self.langs, self.words = langs.dictionary.take(pa.array(seen // wide)), words.take(pa.array(seen % wide))
        self.is_word = seen % wide != stop
        self.ids = np.zeros(len(seen) + 1, np.uint64)
        self.ids[1:] = word_ids(np.array(langs.dictionary.to_pylist(), object)[seen // wide], np.array(self.words.to_pylist(), object), seed) if len(seen) else 0
        code = np.append(inverse + 1, 0)
        code[:-1][~self.is_word[inverse]] = 0
        # A text ends where the next begins.
        ends = np.flatnonzero(np.diff(rows)) + 1
        self.code = np.insert(code, ends, 0)


def blocks(batch: pa.RecordBatch, seed: int) -> Iterator[Words]:
    texts, langs = batch.column("text"), batch.column("lang")
    for a, b in row_blocks(texts, BLOCK_BYTES):
        yield Words(texts.slice(a, b - a), langs.slice(a, b - a), seed)


def windows(code: np.ndarray, linked: np.ndarray, least: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows of codes, and how often each starts.

    A window starts at every place and takes up to ``longest`` codes, as long as each is
    ``linked`` to the next; 0 fills it. Those shorter than ``least`` are left out.
    """
    reach = np.ones(len(code), np.int8) * (code > 0)
    good = reach > 0
    for k in range(1, longest):
        good = good[: len(code) - k] & linked[k - 1 : len(code) - 1]
        reach[: len(good)] += good
    starts = np.flatnonzero(reach >= least)
    reach = reach[starts]
    size = int(code.max(initial=0)) + 1
    keys, room, columns = code[starts], size, []
    for k in range(1, longest):
        column = np.where(reach > k, code[np.minimum(starts + k, len(code) - 1)], 0)
        if room * size >= 1 << 62:
            uniques, keys = np.unique(keys, return_inverse=True)
            room = len(uniques)
        keys, room = keys * size + column, room * size
    _, at, counts = np.unique(keys, return_index=True, return_counts=True)
    found = np.zeros((len(at), longest), code.dtype)
    for k in range(longest):
        found[:, k] = np.where(reach[at] > k, code[np.minimum(starts[at] + k, len(code) - 1)], 0)
    return found, counts


def key_table(keys: DataFrame, depth: int) -> tuple[int, np.ndarray]:
    """Bit table of the rows of ``keys`` (w1, ...); as large as their number asks for, within bounds."""
    count = keys.count()
    bits = min(MOST_BITS, max(FEWEST_BITS, math.ceil(math.log2(8 * count + 1))))
    names = [f"w{k + 1}" for k in range(depth)]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = cells(np.stack([c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns], axis=1), bits)
            bit = (np.uint64(1) << (place & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(6)).astype(np.int64)), pa.array(bit)], ["word", "bit"])

    # At most 2^MOST_BITS / 64 rows.
    found = keys.select(*names).mapInArrow(mark, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[found.column("word").to_numpy()] = found.column("bit").to_numpy().view(np.uint64)
    return bits, table


def known(ids: np.ndarray, bits: int, table: np.ndarray) -> np.ndarray:
    """Whether rows of ids may be in a bit table; never False for one that is."""
    place = cells(ids, bits)
    return (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0


def count_words(docs: DataFrame, seed: int) -> DataFrame:
    """lang, word, id and f of all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, seed):
                made = pa.RecordBatch.from_arrays([block.langs.cast(pa.string()), block.words.cast(pa.string()), pa.array(block.uses.astype(np.int64))], ["lang", "word", "f"])
                yield made.filter(pa.array(block.is_word))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = word_ids(*(np.array(batch.column(c).to_pylist(), object) for c in ("lang", "word")), seed) if batch.num_rows else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids.view(np.int64))], ["lang", "word", "f", "id"])

    found = docs.mapInArrow(count, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    return found.mapInArrow(name, "lang string, word string, f long, id long")


def coded(words: DataFrame, ranks: Ranks) -> DataFrame:
    """``words`` with ``code``, the number they have in runs."""
    shared = words.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, _ = shared.value.code(batch.column("id").to_numpy().view(np.uint64))
            yield batch.append_column("code", pa.array(codes.view(np.int64)))

    return words.mapInArrow(run, "lang string, word string, f long, id long, code long")


def count_runs(docs: DataFrame, seed: int, ranks: Ranks, tables: list, least: int, longest: int) -> DataFrame:
    """Sorted runs of phrases (w1, ..., n) of all tasks, windows of ``least`` to ``longest`` words.

    ``ranks`` and the first of ``tables``, which are bit tables, tell frequent words;
    the second, if given, tells frequent pairs.
    """
    shared = docs.sparkSession.sparkContext.broadcast((ranks, tables))
    names = [f"w{k + 1}" for k in range(longest)]
    entries, burst = TRIE_ENTRIES, BURST

    def runs(trie: HatTrie, keep: int) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for ids, counts in trie.spill(keep):
            held.append((ids, counts))
            rows += len(counts)
            if rows >= 50_000 or trie.entries <= keep:
                ids, counts = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                columns = [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in ids.T]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts)], [*names, "n"])
                held, rows = [], 0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, (ranks, tables) = HatTrie(longest, burst), shared.value
        for batch in batches:
            for block in blocks(batch, seed):
                named, good = ranks.code(block.ids)
                good |= known(block.ids[:, None], *tables[0])
                code = np.where(good[block.code], block.code, 0)
                linked = (code[:-1] > 0) & (code[1:] > 0)
                if len(tables) > 1:
                    at = np.flatnonzero(linked)
                    linked[at] = known(np.stack([named[code[at]], named[code[at + 1]]], axis=1), *tables[1])
                found, counts = windows(code, linked, least, longest)
                for a in range(0, len(found), entries):
                    ids = named[found[a : a + entries]].astype(">u8")
                    firsts = np.flatnonzero(np.diff(ids[:, 0], prepend=np.uint64(0)))
                    rests = np.ascontiguousarray(ids[:, 1:]).view(f"V{8 * (longest - 1)}").ravel().tolist()
                    numbers = counts[a : a + entries].tolist()
                    for i, j in zip(firsts.tolist(), [*firsts[1:].tolist(), len(ids)], strict=True):
                        trie.add(ids[i, :1].tobytes(), rests[i:j], numbers[i:j])
                    if trie.entries > entries:
                        yield from runs(trie, entries // 2)
        yield from runs(trie, 0)

    return docs.mapInArrow(count, ", ".join(f"{c} long" for c in [*names, "n"]))


def frequent_phrases(docs: DataFrame, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """Phrases of one to five words with ``least`` uses or more, and the words of each language.

    Gives (lang, phrase, size, a) and (lang, n). Phrases lie within pieces, cut at
    ``.,;:!?`` and line ends; every occurrence counts, overlapping ones included.
    """
    docs = docs.select(F.col("text").cast("string"), F.col("lang").cast("string"))
    seed = 0
    while True:
        words = write_table(count_words(docs, seed), "phrase-words")
        if words.groupBy("id").count().filter("count > 1").isEmpty():
            break
        seed += 1
    frequent = words.filter(F.col("f") >= least)
    ranks = rank_words(frequent, RANKED_WORDS)
    frequent = write_table(coded(frequent.select("lang", "word", "f", "id"), ranks), "phrase-frequent")
    tables = [key_table(frequent.filter("code < 0").select(F.col("id").alias("w1")), 1)]
    pairs = count_runs(docs, seed, ranks, tables, 2, 2).repartition("w1", "w2").groupBy("w1", "w2").agg(F.sum("n").alias("a")).filter(F.col("a") >= least)
    pairs = write_table(pairs, "phrase-pairs")
    tables.append(key_table(pairs, 2))
    # A window counts for each of its beginnings, all of which are in the window's own partition.
    none = F.lit(0).cast("long")
    ends = F.array(F.struct(none.alias("w4"), none.alias("w5")), F.struct("w4", none.alias("w5")), F.struct("w4", "w5"))
    ends = F.slice(ends, 1, F.when(F.col("w5") != 0, 3).when(F.col("w4") != 0, 2).otherwise(1))
    longer = count_runs(docs, seed, ranks, tables, 3, LONGEST).repartition("w1", "w2", "w3").select("w1", "w2", "w3", F.inline(ends), "n")
    longer = longer.groupBy("w1", "w2", "w3", "w4", "w5").agg(F.sum("n").alias("a")).filter(F.col("a") >= least)
    zero = [none.alias(f"w{k}") for k in (3, 4, 5)]
    found = write_table(pairs.select("w1", "w2", *zero, "a").unionByName(longer), "phrase-counts")

    parts = found.select("a", F.array("w1", "w2", "w3", "w4", "w5").alias("ids")).select("a", "ids", F.posexplode(F.filter("ids", lambda w: w != 0)).alias("pos", "code"))
    named = skew_join(parts, frequent.select("code", "lang", "word"), "code", "inner", ["ids"])
    spelt = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda w: w["word"]), " ")
    phrases = named.groupBy("ids", "a").agg(F.first("lang").alias("lang"), spelt.alias("phrase"), F.count("*").cast("int").alias("size"))
    single = frequent.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), F.col("f").alias("a"))
    phrases = write_table(phrases.select("lang", "phrase", "size", "a").unionByName(single), "phrases")
    return phrases, write_table(words.groupBy("lang").agg(F.sum("f").alias("n")), "phrase-langs")


def key(phrase: Column) -> Column:
    """Language and phrase as one string; neither words nor phrases hold a tab."""
    return F.concat("lang", F.lit("\t"), phrase)


def collocations(docs: DataFrame, least: int = 100, top: int = 2_000) -> DataFrame:
    """Each language's ``top`` phrases of documents(text, lang) by score: lang, rank, phrase, a, l, r, n, score.

    A phrase's score is its uses against what the parts of its weakest cut would give
    by chance, in thousandths. Phrases inside an equally frequent longer one are left
    out. A null lang is ``und``, a null text empty; repeated rows count as often as they
    occur; other columns are ignored. An empty table gives no rows. Ties end in the
    phrase, by bytes.
    """
    phrases, langs = frequent_phrases(docs, least)
    candidates = phrases.filter(F.col("size") >= 2)
    counts = phrases.select(key(F.col("phrase")).alias("part"), F.col("a").alias("uses"))

    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    first, rest = F.expr("substring_index(phrase, ' ', cut)"), F.expr("substring_index(phrase, ' ', cut - size)")
    cuts = cuts.withColumn("rest", key(rest)).withColumn("part", key(first))
    cuts = skew_join(cuts, counts, "part", "inner", ["phrase"]).withColumnRenamed("uses", "l").drop("part").withColumnRenamed("rest", "part")
    cuts = skew_join(cuts, counts, "part", "inner", ["phrase"]).withColumnRenamed("uses", "r").join(langs, "lang")
    wide = "decimal(19,0)"
    score = F.expr(f"(cast(1000 * cast(n as {wide}) as decimal(22,0)) * cast(a as decimal(15,0))) div (cast(l as {wide}) * cast(r as {wide}))")
    weakest = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))

    inside = candidates.filter(F.col("size") >= 3).select("lang", "a", "size", F.split("phrase", " ").alias("words"))
    inside = inside.select("lang", "a", "size", "words", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("length"))
    inside = inside.select("lang", "a", "words", "length", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("length") + 1)).alias("at"))
    inside = inside.select("lang", F.array_join(F.slice("words", F.col("at"), F.col("length")), " ").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("covered"))
    left = weakest.join(inside, ["lang", "phrase"], "left").filter(F.col("covered").isNull() | (F.col("covered") < F.col("a")))
    best = left.select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle(least: int = 100, top: int = 2_000) -> str:
    """The same in DuckDB SQL, with all phrases of up to five words as rows."""
    return f"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '{BREAKS}')) AS p FROM texts),
lists AS (SELECT lang, list_filter(string_split_regex(p, '[ \\t]+'), lambda w: w <> '') AS w FROM pieces),
numbered AS (SELECT lang, w, row_number() OVER () AS piece FROM lists WHERE len(w) > 0),
starts AS MATERIALIZED (SELECT lang, piece, unnest(w) AS w1, unnest(range(len(w))) AS i FROM numbered),
nexts AS (SELECT lang, w1, {", ".join(f"lead(w1, {k - 1}) OVER p AS w{k}" for k in range(2, LONGEST + 1))} FROM starts WINDOW p AS (PARTITION BY piece ORDER BY i)),
grams AS ({" UNION ALL ".join(f"SELECT lang, {k} AS size, concat_ws(' ', {', '.join(f'w{j}' for j in range(1, k + 1))}) AS phrase FROM nexts WHERE w{k} IS NOT NULL" for k in range(1, LONGEST + 1))}),
counted AS MATERIALIZED (SELECT lang, phrase, size, count(*) AS a FROM grams GROUP BY ALL),
langs AS (SELECT lang, sum(a)::BIGINT AS n FROM counted WHERE size = 1 GROUP BY lang),
parts AS MATERIALIZED (SELECT * FROM counted WHERE a >= {least}),
cand AS MATERIALIZED (SELECT lang, phrase, size, a, string_split(phrase, ' ') AS w FROM parts WHERE size >= 2),
cuts AS (SELECT lang, phrase, size, a, k, array_to_string(w[1:k], ' ') AS f, array_to_string(w[k + 1:], ' ') AS g FROM cand, range(1, {LONGEST}) AS r(k) WHERE k < size),
lefts AS MATERIALIZED (SELECT c.*, x.a AS l FROM cuts c JOIN parts x ON x.lang = c.lang AND x.phrase = c.f),
rights AS MATERIALIZED (SELECT c.*, y.a AS r FROM lefts c JOIN parts y ON y.lang = c.lang AND y.phrase = c.g),
scored AS (SELECT c.lang, phrase, a, k, l, r, n, ((1000::HUGEINT * a * n) // (l::HUGEINT * r))::BIGINT AS score FROM rights c JOIN langs ON langs.lang = c.lang),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS covered FROM cand, range(2, {LONGEST}) AS r(m), range(1, {LONGEST}) AS q(i) WHERE m < size AND i + m - 1 <= size GROUP BY ALL),
kept AS (SELECT s.* FROM weakest s LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase WHERE covered IS NULL OR 100 * covered < 100 * s.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept QUALIFY rank <= {top}"""
