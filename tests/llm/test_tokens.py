import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from groundspark.llm import packing, token_files
from groundspark.llm.tokens import WordEncoder

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
ENCODERS = {f: WordEncoder(public_tokenizers.path(f), memo_words=50) for f in FILES}
PLAIN = {f: Tokenizer.from_file(public_tokenizers.path(f)) for f in FILES}
for one in PLAIN.values():
    one.encode_special_tokens = True


def plain(name, text):
    return PLAIN[name].encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet="abZé ß\n.,'’|19\t́ṩİΣ漢<>=\x01\x1c -", max_size=40), min_size=1, max_size=6))
def test_words_encode_like_whole_texts(name, texts):
    assert [d.tolist() for d in ENCODERS[name].encode(pa.array(texts))] == [plain(name, t) for t in texts]


@pytest.mark.parametrize("name", FILES)
def test_nulls_contractions_and_special_strings(name):
    texts = [None, "", "it's we'll don't I'M", "a <|endoftext|> b", "x" * 5000, " lead", "trail \n"]
    assert [d.tolist() for d in ENCODERS[name].encode(pa.array(texts))] == [plain(name, t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=50))
def test_ranks_round_trip(numbers):
    ranks = np.array(numbers, np.uint32)
    assert token_files.unpack_ranks(*token_files.pack_ranks(ranks), len(ranks)).tolist() == numbers


def test_shards_round_trip_and_rank_by_frequency():
    documents = [np.array(d, np.uint32) for d in ([7, 7, 70000, 2], [], [7, 2])]
    shard = token_files.write_shard([1, None, -5], documents)
    ids, back = token_files.read_shard(shard)
    assert ids == [1, None, -5] and [b.tolist() for b in back] == [d.tolist() for d in documents]
    assert token_files.read_shard(token_files.write_shard([], [])) == ([], [])
    with pytest.raises(ValueError):
        token_files.read_shard(b"xxxx" + shard[4:])


def test_token_files_of_odd_documents(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_TOKENS", 100)
    path = public_tokenizers.path(FILES[0])
    got = token_files.read_token_files(spark, token_files.write_token_files(odd_docs, path)).orderBy("start").collect()
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda k: (k is not None, k)) and len(got) == odd_docs.count()
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:k]) for k in range(len(got))]
    want = sorted((r["doc_id"] or 0, zlib.crc32(np.array(plain(FILES[0], r["text"]) + [2], "<u4").tobytes())) for r in odd_docs.collect())
    assert sorted((r["doc_id"] or 0, r["ids_crc32"]) for r in got) == want
    assert token_files.read_token_files(spark, token_files.write_token_files(no_docs, path)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 16), st.integers(1, 40), max_size=16))
def test_histogram_packing_places_every_rank_once(counts):
    table = packing.pack_histogram(counts, 16)
    seen, rooms = {}, {}
    for r in table.itertuples():
        for k in range(r.count):
            assert seen.setdefault((r.length, r.rank + k), True)
            rooms.setdefault(r.sequence + k, []).append((r.offset, r.length))
    assert len(seen) == sum(counts.values())
    for slots in rooms.values():
        slots.sort()
        assert slots[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(slots, slots[1:])) and sum(slots[-1]) <= 16


def test_shortest_pack_first():
    # 10 opens a pack with 6 left, 9 one with 7 left; 5 goes to the one with most room.
    table = packing.pack_histogram({10: 1, 9: 1, 5: 1}, 16)
    assert [(r.length, r.offset) for r in table.itertuples()] == [(5, 9), (9, 0), (10, 0)]


def test_packing_of_odd_documents(spark, odd_docs, no_docs):
    path = public_tokenizers.path(FILES[1])
    rows = packing.pack(odd_docs, path, size=64).collect()
    by_sequence, texts = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        ids = np.frombuffer(r["ids"], "<u2").astype("<u4")
        assert zlib.crc32(ids.tobytes()) == r["ids_crc32"] and len(ids) == r["length"]
        texts.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], ids))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for slots in by_sequence.values():
        slots.sort()
        assert slots[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(slots, slots[1:])) and sum(slots[-1]) <= 64
    want = sorted(tuple(plain(FILES[1], r["text"]) + [2]) for r in odd_docs.collect() if r["doc_id"] not in (9, None))
    got = sorted(tuple(np.concatenate([i for _, i in sorted(p, key=lambda x: x[0])]).tolist()) for (d, _), p in texts.items() if d not in (9, None, 10))
    assert got == [w for w in want if w in set(got)] and len(got) == len(want) - 2
    assert packing.pack(no_docs, path).count() == 0


def test_words_of_a_byte_tokenizer_need_no_offsets():
    """op2: offsets of every token were made into Python objects to find where words begin."""
    encoder = WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    whole = encoder.tokenizer

    class WithoutOffsets:
        encode_batch_fast = staticmethod(whole.encode_batch_fast)

    encoder.tokenizer = WithoutOffsets()
    texts = ["The first line\nholds caf\u00e9 and \u65e5\u672c \u4f60 words", "a b\nc <|endoftext|> \u0120x \U0001f600y 12.5%", "", "x"]
    found = [ids.tolist() for ids in encoder.encode(pa.array(texts))]
    assert found == [whole.encode(text, add_special_tokens=False).ids for text in texts]
