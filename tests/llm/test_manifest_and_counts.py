"""Merkle manifest, token counts and phrases against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from groundspark.llm import merkle, phrases, token_counts
from tests.llm.conftest import DOCS

PATH = public_tokenizers.path("byte_bpe_50k.json")

# 11: Merkle manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, lower=False):
    out = []
    for name in ("doc_id", "source", "lang", "n_chars", "text"):
        value = row[name]
        if name == "text" and lower and value is not None:
            value = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in value)
        out.append("-" if value is None else f"{len(str(value).encode())}:{value}")
    return digest(*out)


def climb(nodes):
    """All levels of digests over ``nodes``."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, place):
    out = []
    for level in levels[:-1]:
        begin = place // 8 * 8
        out.append((level[begin:place], level[place + 1 : begin + 8]))
        place //= 8
    return out


def plain_manifest(rows):
    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r["lang"]].append(r)
    langs = sorted(by_lang, key=lambda v: (v is not None, (v or "").encode()))
    trees = []
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        trees.append(climb([leaf_of(r) for r in by_lang[lang]]))
    high = climb([t[-1][0] for t in trees])
    out = []
    for place, (lang, tree) in enumerate(zip(langs, trees, strict=True)):
        for k, r in enumerate(by_lang[lang]):
            steps = path(tree, k) + path(high, place)
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            folded = leaf_of(r, lower=hit)
            for before, after in steps:
                folded = digest(*before, folded, *after)
            proof = digest(*[d for before, after in steps for d in before + after])
            out.append((r["doc_id"], tree[0][k], tree[-1][0], high[-1][0], proof, folded, folded == high[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", [1, 7])
def test_manifest_equals_plain_tree(spark, odd_docs, parts):
    got = sorted([tuple(r) for r in merkle.verify(odd_docs.repartition(parts)).collect()], key=repr)
    assert got == plain_manifest([r.asDict() for r in odd_docs.collect()])


def test_manifest_of_deep_single_and_many_trees(spark, no_docs):
    assert merkle.verify(no_docs).count() == 0
    # 1, 8, 9, 64, 65 and 600 leaves, eleven languages, and a language of one leaf.
    sizes = {None: 600, "": 65, "a": 64, "ab": 9, "b": 8, "é": 1, **{f"x{k}": 2 for k in range(5)}}
    rows = [(1000 * n + k, f"Text {k} of {lang}", lang, "S", k) for n, (lang, size) in enumerate(sizes.items()) for k in range(size)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for some in (docs, docs.filter("lang = 'b'"), docs.filter("lang = 'é'")):
        got = sorted([tuple(r) for r in merkle.verify(some).collect()], key=repr)
        assert got == plain_manifest([r.asDict() for r in some.collect()])
    assert 0 < docs.count() - merkle.verify(docs).filter("verified").count() < docs.count()


def test_manifest_ignores_the_order_of_rows(spark, odd_docs):
    roots = {r["root"] for n in (1, 5) for r in merkle.manifest(odd_docs.repartition(n).orderBy(F.rand(n))).select("root").distinct().collect()}
    assert len(roots) == 1


# 12: token counts


def library_counts(texts):
    return [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.text(alphabet="abZé ß\n.,'’|19\t́ṩİΣ漢<>=\x01\x1c　- sdtrelvm\r", max_size=40) | st.sampled_from(["a <|endoftext|> b", "<|endoftext|><|endoftext|>  x"]), min_size=1, max_size=8))
def test_pre_tokens_sum_to_the_library_count(texts):
    cutter = token_counts.PreTokenizer(PATH)
    rows, codes, words = cutter.cut(pa.array(texts))
    counts = np.bincount(rows, cutter.pieces(words.to_pylist())[codes], len(texts)) if len(rows) else np.zeros(len(texts))
    assert counts.astype(int).tolist() == library_counts(texts)


@pytest.mark.parametrize("head_bytes", [0, 400, 1 << 20])
def test_token_counts_of_odd_documents(spark, odd_docs, head_bytes):
    rows = odd_docs.collect()
    want = [(r["doc_id"], len((r["text"] or "").encode()), n, n > 512) for r, n in zip(rows, library_counts([r["text"] for r in rows]), strict=True)]
    got = [tuple(r) for r in token_counts.count_tokens(odd_docs.repartition(3), PATH, head_bytes=head_bytes).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_token_counts_of_special_strings_and_no_documents(spark, no_docs):
    texts = ["a <|endoftext|> b", "<|endoftext|>", " x  <|endoftext|><|endof", "it's\n\n  we'll \n", "x" * 5000, "　漢字 \t\r\n", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["n_tokens"] for r in token_counts.count_tokens(docs, PATH).orderBy("doc_id").collect()]
    assert got == library_counts(texts)
    assert token_counts.count_tokens(no_docs, PATH).count() == 0


def test_head_takes_the_most_used_within_its_bytes(spark):
    counted = spark.createDataFrame([("a" * 10, 1000, 1), ("b" * 10, 600, 1), ("c" * 10, 5, 2), ("d" * 10, 1, 2)], "pre_token string, uses long, pieces long")
    assert token_counts.head_uses(counted, 33) == 1 << 62 and token_counts.head_uses(counted, 68) == 512
    assert token_counts.head_uses(counted, 1000) == 1 and token_counts.head_uses(counted.limit(0), 10) == 1 << 62


def test_other_kinds_of_tokenizers_are_refused():
    with pytest.raises(ValueError):
        token_counts.PreTokenizer(public_tokenizers.path("word_bpe_49k.json"))


# 13: phrases


def plain_phrases(rows, least, top):
    import re

    counts = defaultdict(Counter)
    for text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            for i in range(len(words)):
                for k in range(1, 6):
                    if i + k <= len(words):
                        counts["und" if lang is None else lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        found = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        inside = Counter()
        for p, c in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], c)
        scored = []
        for p, a in found.items():
            score, cut = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if 100 * inside[p] < 100 * a:
                scored.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return sorted(out)


def phrase_rows(seed, count):
    draw = random.Random(seed)
    words = ["the", "The", "of", "New", "york", "São", "x-1", "a b", "ß", *(f"w{k}" for k in range(12))]
    rows = []
    for _ in range(count):
        text = "".join(draw.choice(words) + draw.choice([" "] * 8 + ["  ", "\t", ". ", ",", "\n", "!?"]) for _ in range(draw.randint(0, 60)))
        rows.append((text, draw.choice(["en", "de", "und", None])))
    return [*rows, (None, "en"), ("", None), ("...\n\t  ", "fr"), (rows[0][0], rows[0][1])]


@pytest.mark.parametrize("least,top", [(3, 50), (8, 2000)])
def test_phrases_equal_brute_force(spark, monkeypatch, least, top):
    rows = phrase_rows(least, 250)
    docs = spark.createDataFrame([(k, t, g, "row", 1) for k, (t, g) in enumerate(rows)], "doc_id long, text string, lang string, a string, rank int").repartition(5)
    want = plain_phrases(rows, least, top)
    assert sorted(map(tuple, phrases.collocations(docs, least, top).collect())) == want and len(want) > 50
    # The same from tries that burst and spill all the time, and from bit tables that let much pass.
    monkeypatch.setattr(phrases, "TRIE_ENTRIES", 40)
    monkeypatch.setattr(phrases, "BURST", 3)
    monkeypatch.setattr(phrases, "FEWEST_BITS", 6)
    monkeypatch.setattr(phrases, "MOST_BITS", 6)
    monkeypatch.setattr(phrases, "RANKED_WORDS", 5)
    assert sorted(map(tuple, phrases.collocations(docs, least, top).collect())) == want


def test_phrases_of_odd_documents(spark, odd_docs, no_docs):
    got = sorted(map(tuple, phrases.collocations(odd_docs, 2, 100).collect()))
    assert got == plain_phrases([(r["text"], r["lang"]) for r in odd_docs.collect()], 2, 100)
    assert phrases.collocations(no_docs).count() == 0


def test_colliding_word_ids_are_drawn_anew(spark, monkeypatch):
    rows = phrase_rows(5, 60)
    docs = spark.createDataFrame(rows, "text string, lang string")
    real, seeds = phrases.count_words, []

    def colliding(docs, seed):
        seeds.append(seed)
        found = real(docs, seed)
        return found.withColumn("id", F.lit(1).cast("long")) if seed == 0 else found

    monkeypatch.setattr(phrases, "count_words", colliding)
    assert sorted(map(tuple, phrases.collocations(docs, 3, 100).collect())) == plain_phrases(rows, 3, 100) and seeds == [0, 1]


def test_trie_bursts_spills_subtrees_and_keeps_counts():
    draw = random.Random(1)
    trie, want, runs = phrases.HatTrie(4, burst=4), Counter(), []
    for _ in range(30):
        some = sorted({tuple(draw.randint(1, 5) for _ in range(4)) for _ in range(40)})
        for first in sorted({s[0] for s in some}):
            own = [s for s in some if s[0] == first]
            trie.add(np.array([first], ">u8").tobytes(), [np.array(s[1:], ">u8").tobytes() for s in own], [2] * len(own))
            want.update({s: 2 for s in own})
        if trie.entries > 100:
            before = set(trie.root)
            taken = list(trie.spill(60))
            assert trie.entries <= 60 and len(before) - len(trie.root) == len(taken)
            runs += taken
    assert any(isinstance(c, phrases.HatTrie.Node) for c in trie.root.values())
    runs += list(trie.spill(0))
    got = Counter()
    for ids, counts in runs:
        listed = list(map(tuple, ids.tolist()))
        assert listed == sorted(listed) and len({s[0] for s in listed}) == 1
        got.update(dict(zip(listed, counts.tolist(), strict=True)))
    assert got == want and trie.entries == 0
