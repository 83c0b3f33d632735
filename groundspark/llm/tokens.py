"""Token ids of whole texts, encoding every distinct word of a worker once.

Words are cut only where both the tokenizer and this module must see a boundary:
before a blank or line feed that follows a visible character. Texts with other
white space (runs of blanks, tabs, leading blanks) go to the tokenizer whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MARK = "\x01"
# A blank or line feed not right after a visible ASCII or Latin character, or the mark itself.
IRREGULAR = r"(^|[^\x21-\x7e\x{a1}-\x{ac}\x{ae}-\x{24f}])[ \n]|\x01"
# Words a worker remembers before it starts anew; a cache, without effect on results.
MEMO_WORDS = 1_000_000
BLOCK_BYTES = 16 * 1024 * 1024
JOINED_WORDS = 2_000


def row_blocks(texts: pa.Array, limit_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit_bytes`` of text each; a longer text stands alone.

    What Arrow holds on to is given back after each block, as workers live on between stages.
    """
    sizes = np.maximum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), 1)
    begin, held = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if held and held + size > limit_bytes:
            yield begin, row
            pa.default_memory_pool().release_unused()
            begin, held = row, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)
        pa.default_memory_pool().release_unused()


class WordEncoder:
    """Encodes texts with one tokenizer file; equal words are encoded once."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.memo_words = memo_words
        self.begins = self._begins()
        self._forget()

    def _begins(self) -> np.ndarray | None:
        """Which ids stand for bytes that begin with a blank or line feed, if tokens are bytes of the text."""
        parts = json.loads(self.tokenizer.to_str())
        if parts["normalizer"] is not None or (parts["pre_tokenizer"] or {}).get("type") != "ByteLevel":
            return None
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        begins = np.zeros(max(vocabulary.values()) + 1, bool)
        begins[[number for token, number in vocabulary.items() if token[:1] in ("\u0120", "\u010a")]] = True
        return begins

    def _forget(self) -> None:
        self.memo = pa.array([], pa.string())
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, words: pa.StringArray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids and counts of ids of words that each begin with a blank or line feed and hold more."""
        ids, sizes = [], []
        for at in range(0, len(words), JOINED_WORDS):
            some = words.slice(at, JOINED_WORDS)
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), "")[0].as_py()
            if self.begins is not None:
                # Bytes of words make up tokens: each word has one that holds its first byte, and offsets are not needed.
                found = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
                starts = np.flatnonzero(self.begins[found])
                if len(starts) == len(some):
                    ids.append(found)
                    sizes.append(np.diff(starts, append=len(found)))
                    continue
            encoding = self.tokenizer.encode(text, add_special_tokens=False)
            ids.append(np.array(encoding.ids, np.uint32))
            lengths = pc.utf8_length(some).to_numpy(zero_copy_only=False)
            offsets = np.fromiter((o[0] for o in encoding.offsets), np.int64, len(ids[-1]))
            sizes.append(np.diff(np.searchsorted(offsets, np.cumsum(lengths) - lengths, "left"), append=len(offsets)))
        return ids, sizes

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Remember new words; returns their places."""
        begun = pc.or_(pc.starts_with(words, " "), pc.starts_with(words, "\n"))
        joined = pc.and_(begun, pc.greater(pc.binary_length(words), 1)).to_numpy(zero_copy_only=False)
        order = np.concatenate([np.flatnonzero(joined), np.flatnonzero(~joined)])
        arrays, counts = self._joined(words.take(pa.array(np.flatnonzero(joined))))
        whole = self._whole(words.take(pa.array(np.flatnonzero(~joined))).to_pylist())
        sizes = np.concatenate([*counts, [len(a) for a in whole]]).astype(np.int64)
        known, total = len(self.memo), self.used + int(sizes.sum())
        self.memo = pa.concat_arrays([self.memo, words.take(pa.array(order))])
        if total > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(total, np.uint32)])
        self.ids[self.used : total] = np.concatenate(arrays + whole)
        if known + len(sizes) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(known + len(sizes) + 1, np.int64)])
        self.starts[known + 1 : known + len(sizes) + 1] = self.used + np.cumsum(sizes)
        self.used = total
        places = np.empty(len(order), np.int64)
        places[order] = known + np.arange(len(order))
        return places

    def _by_words(self, texts: pa.Array) -> list[np.ndarray]:
        marked = pc.replace_substring(pc.replace_substring(texts, " ", MARK + " "), "\n", MARK + "\n")
        lists = pc.split_pattern(marked, MARK)
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        if len(self.memo) + len(words) > self.memo_words:
            self._forget()
        found = pc.index_in(words, value_set=self.memo)
        place = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh = np.flatnonzero(place < 0)
        if len(fresh):
            place[fresh] = self._learn(words.take(pa.array(fresh)))
        place = place[coded.indices.to_numpy(zero_copy_only=False)]
        starts = self.starts[place]
        sizes = self.starts[place + 1] - starts
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]))]
        word_ends = np.cumsum(counts)
        return np.split(ids, ends[word_ends - 1][:-1])

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; a null text has none."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(texts, IRREGULAR).to_numpy(zero_copy_only=False)
        done: list = [None] * len(texts)
        for rows, way in ((np.flatnonzero(~odd), self._by_words), (np.flatnonzero(odd), lambda t: self._whole(t.to_pylist()))):
            if len(rows):
                for row, ids in zip(rows.tolist(), way(texts.take(pa.array(rows))), strict=True):
                    done[row] = ids
        return done


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for ``path``, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
