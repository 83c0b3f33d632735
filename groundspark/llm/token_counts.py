"""Token counts of documents, from the counts of their pre-tokens.

A byte-level tokenizer cuts a text into pre-tokens and merges inside each alone.
So the pieces of every distinct pre-token are counted once for the whole corpus, and
a document has the sum over its own pre-token frequencies; no ids are made.

Pre-tokens are met in two ways that add up: the most frequent ones, as many as fit
``HEAD_BYTES``, go to every task; the others of a document stay rows and are joined
with the counted table. How many are in which part changes no result.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark.llm.tokens import row_blocks
from groundspark.runtime import write_table

# Bytes of pre-tokens that every task is given.
HEAD_BYTES = 8 * 1024 * 1024
BLOCK_BYTES = 8 * 1024 * 1024
MARK = "\x01"
# The byte-level pattern without its two forms for runs of white space, which plain texts have none of.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|[ \n]"
# Letters, digits and marks that every version of Unicode classes alike: Latin, Greek, Cyrillic, common punctuation.
COMMON = r"\x21-\x7e\x{a1}-\x{ac}\x{ae}-\x{24f}\x{391}-\x{3a1}\x{3a3}-\x{3ff}\x{400}-\x{481}\x{48a}-\x{52f}\x{2010}-\x{2027}\x{2030}-\x{205e}"
# Any other character, or a blank or line feed not right after one of these: cut by the library.
UNCOMMON = rf"[^{COMMON} \n]|(^|[^{COMMON}])[ \n]"


class PreTokenizer:
    """Cuts texts as one byte-level tokenizer file does, and counts the pieces of pre-tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        stage = made["pre_tokenizer"] or {}
        plain = all(not t[k] for t in made["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if made["normalizer"] or stage.get("type") != "ByteLevel" or stage["add_prefix_space"] or not stage["use_regex"] or not plain:
            raise ValueError("pre-tokens are counted for plain byte-level tokenizers only")
        self.added = [t["content"] for t in made["added_tokens"]]
        # Longer strings first, as the library finds the leftmost longest one.
        self.strings = sorted(self.added, key=len, reverse=True)

    def _cut(self, text: str) -> list[str]:
        """Pre-tokens of one text by the library; an added token is one of its own."""
        parts, out = [text], []
        if any(s in text for s in self.strings):
            import regex

            parts = regex.split("(" + "|".join(map(regex.escape, self.strings)) + ")", text)
        for part in parts:
            if part in self.added:
                out.append(part)
            elif part:
                out += [part[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Row and code of each pre-token, and the distinct ones that the codes number; a null text has none."""
        # Marks can double a text, which short offsets hold for all but huge ones.
        texts = pc.fill_null(texts.cast(pa.string() if texts.nbytes < 1 << 29 else pa.large_string()), "")
        odd = pc.match_substring_regex(texts, UNCOMMON)
        for one in self.strings:
            odd = pc.or_(odd, pc.match_substring(texts, one))
        odd = odd.to_numpy(zero_copy_only=False)
        plain, rest = np.arange(len(odd)), np.flatnonzero(odd)
        if len(rest):
            plain = np.flatnonzero(~odd)
            texts, left = texts.take(pa.array(plain)), texts.take(pa.array(rest)).to_pylist()
        lists = pc.split_pattern(pc.replace_substring_regex(texts, PIECE, MARK + r"\0"), MARK)
        rows = np.repeat(plain, np.diff(lists.offsets.to_numpy()))
        words = lists.flatten()
        if len(rest):
            cut = [self._cut(t) for t in left]
            rows = np.concatenate([rows, np.repeat(rest, [len(c) for c in cut])])
            words = pa.concat_arrays([words, pa.array([w for c in cut for w in c], words.type)])
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        # What stands before the first mark of a text is empty.
        empty = pc.index(coded.dictionary, "").as_py()
        if empty >= 0:
            full = codes != empty
            rows, codes = rows[full], codes[full]
        return rows, codes, coded.dictionary

    def pieces(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token; an added token is one."""
        self.tokenizer.encode_special_tokens = True
        counts = [len(e) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([1 if w in self.added else n for w, n in zip(words, counts, strict=True)], np.int64)


@functools.lru_cache(maxsize=1)
def pre_tokenizer(path: str) -> PreTokenizer:
    """The worker's own for ``path``, kept between tasks."""
    return PreTokenizer(path)


def count_pre_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Every distinct pre-token of the texts: pre_token, uses, pieces. Each is encoded once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in row_blocks(batch.column("text"), BLOCK_BYTES):
                _, codes, words = pre_tokenizer(tokenizer).cut(batch.column("text").slice(a, b - a))
                uses = np.bincount(codes, minlength=len(words))
                seen = np.flatnonzero(uses)
                yield pa.RecordBatch.from_arrays([words.take(pa.array(seen)).cast(pa.string()), pa.array(uses[seen])], ["pre_token", "uses"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = pre_tokenizer(tokenizer).pieces(batch.column("pre_token").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces)], ["pre_token", "uses", "pieces"])

    found = docs.select(F.col("text").cast("string")).mapInArrow(cut, "pre_token string, uses long")
    return found.groupBy("pre_token").agg(F.sum("uses").alias("uses")).mapInArrow(encode, "pre_token string, uses long, pieces long")


def head_uses(counted: DataFrame, limit_bytes: int) -> int:
    """The fewest uses, a power of two, from which on all pre-tokens together fit ``limit_bytes``."""
    level = F.floor(F.log2("uses")).cast("int").alias("level")
    # One row a level, 63 at most.
    levels = counted.groupBy(level).agg(F.sum(F.octet_length("pre_token") + 24).alias("size")).orderBy(F.col("level").desc()).collect()
    taken, least = 0, 1 << 62
    for row in levels:
        taken += row["size"]
        if taken > limit_bytes:
            break
        least = 1 << row["level"]
    return least


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, head_bytes: int = HEAD_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of documents(doc_id, text).

    A null text is an empty one, with 0 bytes and tokens; repeated rows are each
    counted; other columns are ignored. Strings of added tokens inside a text count
    as that token, the library's default. An empty table gives no rows.
    """
    spark = docs.sparkSession
    counted = write_table(count_pre_tokens(docs, tokenizer), "pre-tokens")
    least = head_uses(counted, head_bytes)
    head = counted.filter(F.col("uses") >= least).select("pre_token", "pieces").toArrow()
    shared = spark.sparkContext.broadcast((head.column("pre_token").combine_chunks().cast(pa.string()), head.column("pieces").to_numpy()))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pieces = shared.value
        for batch in batches:
            for a, b in row_blocks(batch.column("text"), BLOCK_BYTES):
                rows, codes, words = pre_tokenizer(tokenizer).cut(batch.column("text").slice(a, b - a))
                # Frequency of each pre-token in each document.
                wide = max(1, len(words))
                pairs, uses = np.unique(rows * wide + codes, return_counts=True)
                row, word = pairs // wide, pairs % wide
                place = pc.fill_null(pc.index_in(words, value_set=known.cast(words.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)[word]
                met = place >= 0
                tokens = np.bincount(row[met], uses[met] * pieces[place[met]], b - a).astype(np.int64)
                row, word, uses = row[~met], word[~met], uses[~met]
                ends = np.zeros(b - a + 1, np.int32)
                np.cumsum(np.bincount(row, minlength=b - a), out=ends[1:])
                rare = pa.ListArray.from_arrays(pa.array(ends), words.take(pa.array(word)).cast(pa.string()))
                times = pa.ListArray.from_arrays(pa.array(ends), pa.array(uses.astype(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("n_bytes").slice(a, b - a), pa.array(tokens), rare, times], ["doc_id", "n_bytes", "tokens", "rare", "times"]
                )

    text = F.col("text").cast("string")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    slim = slim.mapInArrow(weigh, "doc_id long, n_bytes long, tokens long, rare array<string>, times array<long>")
    slim = write_table(slim.withColumn("row", F.monotonically_increasing_id()), "pre-token-frequencies")
    shared.unpersist()
    rare = slim.select("row", F.inline(F.arrays_zip("rare", "times")).alias("pre_token", "times"))
    rest = counted.filter(F.col("uses") < least).select("pre_token", "pieces")
    more = rare.join(rest, "pre_token").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    total = F.col("tokens") + F.coalesce("more", F.lit(0))
    return slim.select("row", "doc_id", "n_bytes", "tokens").join(more, "row", "left").select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
