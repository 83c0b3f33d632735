import math
import re
import time
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from groundspark import runtime
from groundspark.llm import graph, itq, langid, linededup, lm, minhash, mixing, pivots, sampling, secrets
from tests.llm.conftest import WORDS, sentence

EMB = "vec_id long, embedding array<float>, label int, row long, class string"


def roots(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


# Components and samples


def test_components_of_paths_stars_and_repeats(spark):
    pairs = [(k, k + 1) for k in range(1, 20)] + [(50, k) for k in range(51, 60)] + [(50, 51), (51, 50), (70, 70)]
    links = spark.createDataFrame([*pairs, (None, 1), (2, None)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(links).collect()}
    want = roots({n for p in pairs for n in p} - {70}, [p for p in pairs if p[0] != p[1]])
    assert got == want
    assert graph.components(links.limit(0)).count() == 0


def test_hash_sample_is_bounded_and_stable(spark):
    rows = spark.range(5000).select(F.col("id"), (F.col("id") % 3).alias("k"))
    a, b = (sorted(r["id"] for r in sampling.hash_sample(rows.repartition(n), ["id"], 100).collect()) for n in (1, 9))
    assert a == b and len(a) == 100
    assert sampling.hash_sample(rows.limit(7), ["id"], 100).count() == 7 and sampling.hash_sample(rows.limit(0), ["id"], 5).count() == 0


# 5: weighted MinHash


def weighted(texts):
    found = minhash.shingles(pa.array(texts))
    frequency = np.zeros(1 << minhash.CELL_BITS)
    for hashes, _ in found:
        np.add.at(frequency, minhash.cells(hashes), 1)
    n = max(1, len(texts))
    idf = 1 + minhash.DAMPING * np.log1p(n / np.maximum(frequency, 1)) / math.log1p(n)
    return [{int(h): (1 + math.log(c)) * idf[int(h) >> (64 - minhash.CELL_BITS)] for h, c in zip(*f, strict=True)} for f in found], idf


def jaccard(a, b):
    shared = sum(min(a[k], b[k]) for k in a if k in b)
    return shared / (sum(a.values()) + sum(b.values()) - shared) if a and b else 0.0


def variant(seed, text, changes):
    words = text.split()
    for k in range(changes):
        words[(seed * 37 + k * 53) % len(words)] = f"other{seed}{k}"
    return " ".join(words)


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    base = [sentence(100 + k, 150) for k in range(3)]
    texts = [variant(k, base[k % 3], k % 5) for k in range(40)] + [sentence(200 + k, 30) for k in range(20)] + [base[0]] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    sets, _ = weighted(texts)
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(sets[i], sets[j]) >= minhash.SIMILARITY]
    want = roots(range(len(texts)), pairs)
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()}
    assert got == {d: (c, c == d) for d, c in want.items()} and len(set(want.values())) < 40


def test_joined_classes_are_not_compared_between_blocks(spark, monkeypatch):
    """op5: classes that their block had joined to the hub still met every other block of the bucket."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    # One sample alone: buckets are wide, and hubs reach a part of them.
    monkeypatch.setattr(minhash, "BANDS", 1)
    monkeypatch.setattr(minhash, "ROWS", 1)
    monkeypatch.setattr(minhash, "signature", lambda hashes, weights, drawn=minhash.signature: drawn(hashes, weights, 1))
    words = sentence(31, 260).split()
    texts = [" ".join(words[k : k + 150]) for k in range(0, 100, 2)]
    apart, compare = [], minhash.compare

    def counted(members, stored, key, similarity):
        if "j" in key:
            apart.append(members.filter("left").select("band", "value", "class").distinct().count())
        return compare(members, stored, key, similarity)

    monkeypatch.setattr(minhash, "compare", counted)
    assert minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count() == len(texts)
    assert len(apart) == 2 and apart[1] < apart[0], apart


def test_exact_similarity_of_sets_and_sampling_rate():
    texts = [variant(k, sentence(7, 300) + " " + sentence(7, 30), 3 * k) for k in range(4)] + ["one two", "one two one two one two one two one two"]
    sets, idf = weighted(texts)
    found = minhash.shingles(pa.array(texts))
    plain = [minhash.elements(h, c, idf) for h, c in found]
    near = minhash.similarities(plain[:3], plain[3:])
    for i in range(3):
        for j in range(3):
            assert near[i, j] == pytest.approx(jaccard(sets[i], sets[3 + j]), abs=1e-5)
    drawn = [minhash.signature(h, minhash.weigh(h, c, idf), 2000) for h, c in found[:2]]
    assert (drawn[0] == drawn[1]).mean() == pytest.approx(jaccard(sets[0], sets[1]), abs=0.05)


def test_near_duplicates_of_odd_documents(spark, odd_docs, no_docs):
    rows = minhash.near_duplicates(odd_docs).collect()
    group = defaultdict(set)
    for r in rows:
        group[r["doc_id"]].add(r["component_id"])
    assert len(rows) == odd_docs.count() and group[2] == group[3] == {1} and group[5] == {5} and group[6] == {6} and group[12] == {11} and group[9] == {9}
    kept = minhash.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[9] == 1 and ids[2] == ids[3] == ids[12] == 0 and ids[5] == ids[6] == ids[7] == ids[1] == ids[11] == 1 and ids[10] == 2 and ids[None] == 2
    assert minhash.near_duplicates(no_docs).count() == 0 and minhash.keep_first(no_docs).count() == 0


# 7: lines


def line_sets(line):
    words = [w for w in line.lower().replace("\t", " ").split(" ") if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else None


def test_line_dedup_equals_brute_force(spark):
    base = [sentence(300 + k, 60) for k in range(4)]
    lines = [variant(k, base[k % 4], k % 3) for k in range(30)] + [base[0], "short line", "Short  line", "", "other short line"]
    docs = [(k, "\n".join(lines[(k * 7 + j * 5) % len(lines)] for j in range(4))) for k in range(25)]
    seen, want = [], {}
    for d, text in docs:
        stay = []
        for line in text.split("\n"):
            s = line_sets(line)
            if s is None:
                stay.append(line)
                continue
            if not any(len(s & o) >= 0.8 * len(s | o) for o in seen):
                stay.append(line)
            seen.append(s)
        want[d] = "\n".join(stay)
    got = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == want


@pytest.mark.parametrize("longer", ["one two three four five six seven eight nine", "zero one two three four five six seven eight"])
def test_a_line_of_four_shingles_meets_one_of_five(spark, longer):
    short = "one two three four five six seven eight"
    for first, later in ((short, longer), (longer, short)):
        docs = spark.createDataFrame([(1, first), (2, f"{later}\nstays")], "doc_id long, text string")
        assert {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs).collect()} == {1: first, 2: "stays"}
    three = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g h")], "doc_id long, text string")
    assert [r["text"] for r in linededup.dedup_lines(three).orderBy("doc_id").collect()] == ["a b c d e f g", "a b c d e f g h"]


def test_common_tokens_come_last_and_links_stay(spark, monkeypatch):
    monkeypatch.setattr(linededup, "COMMON", 10)
    monkeypatch.setattr(linededup, "COMMON_TIMES", 0)
    shared = sentence(900, 30)
    near = sentence(901, 60)
    docs = [(k, f"{sentence(k + 1000, 20)} {shared} {sentence(k + 2000, 20)}") for k in range(60)] + [(100, f"{near} {shared} {near}"), (101, f"{near} {shared} {near} end")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    tables = {}
    real = linededup.write_table
    monkeypatch.setattr(linededup, "write_table", lambda df, name, *more: tables.setdefault(name, real(df, name, *more)))
    assert {r["doc_id"]: r["text"] for r in linededup.dedup_lines(frame).collect()} == {**dict(docs), 101: ""}
    # All 60 lines share 26 tokens; none of them is left among the first ones.
    assert tables["common-lines"].count() >= 60 and tables["shared-tokens"].groupBy("token").count().filter("count > 10").count() == 0


def test_cells_follow_the_number_of_tokens(spark, monkeypatch):
    """with cells of one number for any input, tokens that many lines share were not told apart from the mean."""
    assert [linededup.cells_for(n) for n in (0, 1 << 20, (1 << 20) + 1, 1 << 40)] == [1 << 16, 1 << 16, 1 << 17, 1 << 20]
    monkeypatch.setattr(linededup, "CELLS", 64)
    monkeypatch.setattr(linededup, "COMMON", 10)
    shared = sentence(700, 30)
    docs = [(k, f"{sentence(k + 5000, 30)} {shared} {sentence(k + 6000, 30)}") for k in range(40)] + [(k, sentence(k, 300)) for k in range(100, 200)]
    tables, real = {}, linededup.write_table
    monkeypatch.setattr(linededup, "write_table", lambda df, name, *more: tables.setdefault(name, real(df, name, *more)))
    got = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == dict(docs)
    # In 64 cells of about 140 tokens each the shared ones would not be common.
    assert tables["shared-tokens"].groupBy("token").count().filter("count > 32").count() == 0


def test_written_tables_leave_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {f.name for top in disk.localDirsString() for f in Path(top).rglob("shuffle_*.data")}
    before, setting = held(), spark.conf.get(runtime.FREE_SHUFFLES, None)
    frame = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    tables = [runtime.write_table(frame, "sums") for _ in range(3)]
    deadline = time.time() + 20  # they are removed in the background
    while held() - before and time.time() < deadline:
        time.sleep(0.1)
    assert not held() - before and [t.count() for t in tables] == [7, 7, 7]
    assert spark.conf.get(runtime.FREE_SHUFFLES, None) == setting


def test_line_dedup_of_odd_documents(spark, odd_docs, no_docs):
    got = linededup.dedup_lines(odd_docs)
    assert got.columns == odd_docs.columns
    texts = defaultdict(list)
    for r in got.collect():
        assert (r["row"], r["doc_key"], r["class"], r["epoch"]) == ("r", "k", "c", 7)
        texts[r["doc_id"]].append(r["text"])
    whole = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    assert texts[5] == [None] and texts[6] == [""] and texts[7] == [whole[7]] and texts[2] == [""] and texts[12] == [""] and texts[9] == [whole[9]] * 2
    assert texts[4] == [sentence(2, 40)] and texts[13] == [""] and linededup.dedup_lines(no_docs).count() == 0


# 4: mixing


def test_mixture_meets_limits(spark):
    sizes = {"big": 64, "mid": 16, "small": 1}
    docs = spark.createDataFrame([(f"{s}{k}", s) for s, n in sizes.items() for k in range(n)], "text string, source string").withColumn("doc_id", F.monotonically_increasing_id())
    totals = docs.groupBy("source").agg(F.count("*").alias("tokens"))
    exponent = mixing.choose_exponent(totals, 4.0, None)
    assert exponent == pytest.approx(1 - math.log(4) / math.log(64), abs=1e-6)
    uses = Counter(r["source"] for r in mixing.schedule(docs, max_repeats=4.0).collect())
    assert uses == {"big": 64, "mid": round(16 * 4 ** (1 - exponent)), "small": 4}
    p = np.array([64, 16, 1]) / 81
    for share in (0.7, 0.9):
        target = share * math.log(3)
        w = p ** mixing.choose_exponent(totals, None, target)
        w /= w.sum()
        assert -(w * np.log(w)).sum() == pytest.approx(target, abs=1e-6)
    assert mixing.choose_exponent(totals, None, None) == 1.0 and mixing.choose_exponent(totals, 1000.0, None) == 0.0 and mixing.choose_exponent(totals.limit(0), 2.0, None) == 1.0
    assert Counter(r["source"] for r in mixing.schedule(docs, max_repeats=None, budget=41).collect()) == {"big": 32, "mid": 8, "small": 1}


def test_an_epoch_is_a_permutation(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 50)
    docs = spark.createDataFrame([(k, "w " * (k % 5 + 1), "a" if k < 90 else "b") for k in range(100)], "doc_id long, text string, source string")
    rows = mixing.schedule(docs, max_repeats=3.0).collect()
    for source in "ab":
        epochs = defaultdict(list)
        for r in sorted((r for r in rows if r["source"] == source), key=lambda r: r["place"]):
            epochs[r["epoch"]].append(r["doc_id"])
        whole = sorted(r["doc_id"] for r in rows if r["source"] == source and r["epoch"] == 0)
        assert sorted(epochs[0]) == whole and all(len(set(e)) == len(e) for e in epochs.values())
        assert all(sorted(e) == whole for n, e in epochs.items() if n < max(epochs))
    assert mixing.schedule(docs, seed=1).orderBy("source", "place").first()["doc_id"] is not None


def test_mix_repeats_rows_as_scheduled(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 2)
    text = "four words in here"
    rows = [(1, text, "small", k) for k in (1, 1)] + [(1, text, "big", 1)] + [(2, text, "small", k) for k in (1, 2, 3)] + [(None, None, None, 1)] * 5
    rows += [(3, "five words are in here", "small", 7)] * 9 + [(k, text * 4, "big", k) for k in range(10, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").repartition(4)
    for repeats in (1.0, 1.5, 2.0, 3.5, 7.3):
        want = Counter((r["doc_id"], r["source"], r["tokens"]) for r in mixing.schedule(docs, max_repeats=repeats).collect())
        mixed = mixing.mix(docs, max_repeats=repeats).collect()
        assert Counter((r["doc_id"], r["source"] or "", len((r["text"] or "").split())) for r in mixed) == want
        # Rows that share id, source and text are used alike, up to one use.
        of = Counter(r["n_chars"] for r in mixed if r["doc_id"] == 2)
        assert max(of.values()) - min(of.values()) <= 1 and len(of) == 3


def test_mixing_odd_documents(spark, odd_docs, no_docs):
    mixed = mixing.mix(odd_docs, max_repeats=1.0)
    assert mixed.columns == odd_docs.columns
    assert sorted(map(str, mixed.collect())) == sorted(map(str, odd_docs.collect()))
    assert mixing.mix(no_docs).count() == 0 and mixing.schedule(odd_docs).filter("epoch = 0").count() == odd_docs.count()


# 9: language


def corpus(n=120):
    kinds = {"aa": "babeba bibo boba bebabi", "cc": "kukoki kikeku kokuka kekiku"}
    return [(kinds[lang].split()[k % 4] + " " + " ".join(kinds[lang].split()[(k * j) % 4] for j in range(k % 30)), lang) for k in range(n) for lang in kinds]


def test_language_model_learns_and_rejects(spark, odd_docs, no_docs):
    model = langid.train(*map(list, zip(*corpus(), strict=True)))
    docs = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate(corpus(40))], "doc_id long, text string, lang string")
    rows = langid.identify(docs).collect()
    held = [r for r in rows if r["held_out"]]
    assert held and all(r["lang_pred"] == r["lang"] and 0 <= r["score"] <= 1 for r in held)
    odd = langid.predict(odd_docs, model)
    assert odd.columns[:9] == [c for c in odd_docs.columns if c != "score"]
    for r in odd.collect():
        lettered = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] != "und") == lettered and (lettered or (r["score"], r["lang_accepted"]) == (0.0, False))
    assert langid.identify(no_docs).count() == 0
    strange = spark.createDataFrame([(1, "день прошёл в городе"), (2, "xqzt wvkk pqrz jjyw"), (3, "babeba bibo boba"), (4, "kukoki kikeku")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_accepted"] for r in langid.predict(strange, model).collect()} == {1: False, 2: False, 3: True, 4: True}
    unlabelled = langid.identify(odd_docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}


def test_a_rare_language_is_learnt(spark):
    many = [(k, t, lang) for k, (t, lang) in enumerate(corpus(100))]
    docs = spark.createDataFrame([*many, *[(1000 + k, f"zozu zizo zuzu{k}", "zz") for k in range(8)], (5, None, "aa"), (6, "", None)], "doc_id long, text string, lang string")
    usable = docs.filter("text IS NOT NULL AND lang IS NOT NULL")
    drawn = sampling.hash_sample_by(usable, "lang", ["doc_id"], 60, 15).collect()
    assert len(drawn) <= 60 and Counter(r["lang"] for r in drawn)["zz"] == 8
    assert sorted(drawn) == sorted(sampling.hash_sample_by(usable.repartition(7), "lang", ["doc_id"], 60, 15).collect())
    assert {r["lang"] for r in sampling.hash_sample_by(usable, "lang", ["doc_id"], 60, 30).collect()} == {"aa", "cc"}
    assert sampling.hash_sample_by(usable.limit(0), "lang", ["doc_id"], 60, 15).count() == 0
    model = langid.fit(usable, 100)
    told = langid.predict(spark.createDataFrame([(1, "zuzu zozu zizo")], "doc_id long, text string"), model).first()
    assert told["lang_pred"] == "zz"


def test_long_texts_are_scored_whole(monkeypatch):
    model = langid.train(*map(list, zip(*corpus(), strict=True)))
    text = " ".join(t for t, _ in corpus(60))
    once = langid.logits_of(model, [text])[0]
    monkeypatch.setattr(langid, "PASS_CHARS", 97)
    assert langid.logits_of(model, [text])[0] == pytest.approx(once, abs=1e-9)


# 8: language model


def test_scores_equal_a_plain_forward_pass():
    texts = [sentence(k, 20) for k in range(3)] + ["", "one"]
    hashes, counts = lm.word_hashes(pa.array(texts))
    known = np.unique(hashes)[:10]
    ids = lm.word_ids(hashes, known)
    flat = lm.start(np.bincount(ids, minlength=lm.WORDS))
    got = lm.log_probabilities(flat, *lm.windows(ids, counts))
    p, at = lm.views(flat.astype(np.float64)), 0
    for n in counts:
        doc = ids[at : at + n].tolist()
        padded = [lm.PAD] * 2 + doc + [lm.PAD] * 2
        for k, word in enumerate(doc):
            around = [padded[k], padded[k + 1], padded[k + 3], padded[k + 4]]
            h = np.tanh(sum(p["context"][j][w] for j, w in enumerate(around)) + p["hidden"])
            of_class = h @ p["class_out"] + p["class_bias"]
            of_word = h @ p["word_out"][word // 32] + p["word_bias"][word // 32]
            want = of_class[word // 32] - np.log(np.exp(of_class).sum()) + of_word[word % 32] - np.log(np.exp(of_word).sum())
            assert got[at + k] == pytest.approx(want, abs=1e-4)
        at += n


def test_words_lose_punctuation_of_any_script():
    texts = ["Plain, it's\u00a0École-9 _x_ ... “Straße”\nçà ١٢", None, "", "!?", "word\u0301 word"]
    hashes, counts = lm.word_hashes(pa.array(texts))
    want = [[w for w in (re.sub(r"\W+", "", w) for w in (t or "").lower().split()) if w] for t in texts]
    assert counts.tolist() == [len(w) for w in want] == [7, 0, 0, 0, 2]
    assert hashes.tolist() == pd.util.hash_array(np.array(sum(want, []), dtype=object), categorize=False).view(np.int64).tolist()


def test_large_logits_and_unused_classes():
    """Logits beyond what floats can exponentiate; most classes have no target."""
    ids = np.random.default_rng(3).integers(0, 70, 50)
    target, context = lm.windows(ids, np.array([50]))
    flat = lm.start(np.ones(lm.WORDS, np.int64))
    lm.views(flat)["word_bias"][:] = np.linspace(-300, 300, lm.LEAST_SIDE)
    lm.views(flat)["class_bias"][:] = np.linspace(400, -400, lm.LEAST_SIDE)
    p = {k: v.astype(np.float64) for k, v in lm.views(flat).items()}
    h = np.tanh(sum(p["context"][k][context[k]] for k in range(4)) + p["hidden"])
    want = 0
    for z, mine in ((h @ p["class_out"] + p["class_bias"], target // 32), (np.einsum("nd,ndw->nw", h, p["word_out"][target // 32]) + p["word_bias"][target // 32], target % 32)):
        z -= z.max(axis=1, keepdims=True)
        want = want + z[np.arange(50), mine] - np.log(np.exp(z).sum(axis=1))
    assert lm.log_probabilities(flat, target, context) == pytest.approx(want, rel=1e-4, abs=1e-4)
    before, memory = flat.copy(), np.full(len(flat), 1e-4, np.float32)
    lm.learn(flat, memory, target, context)
    assert np.isfinite(flat).all() and (lm.views(flat)["word_out"][3:] == lm.views(before)["word_out"][3:]).all() and (flat != before).any()


def test_a_batch_of_many_classes_multiplies_no_whole_logits_twice(monkeypatch):
    """Safe logits are exponentiated once, without a search for each row's largest."""
    ids = np.random.default_rng(4).integers(0, lm.WORDS, 200)
    target, context = lm.windows(ids, np.array([200]))
    flat, calls, real = lm.start(np.ones(lm.WORDS, np.int64)), [], np.exp
    monkeypatch.setattr(lm.np, "exp", lambda x, *more, **named: calls.append(x.size) or real(x, *more, **named))
    lm.learn(flat, np.full(len(flat), 1e-4, np.float32), target, context)
    assert sum(calls) == 2 * 200 * lm.LEAST_SIDE


def test_slopes_match_differences():
    draw = np.random.default_rng(0)
    ids = draw.integers(0, lm.WORDS, 60)
    target, context = lm.windows(ids, np.array([25, 35]))
    flat = lm.start(np.ones(lm.WORDS, np.int64))
    # From a memory of nothing, the first step is the sign of the slope times the rate.
    moved, memory = flat.copy(), np.zeros_like(flat)
    lm.learn(moved, memory, target, context)
    slope = np.sign(flat - moved) * np.sqrt(memory)
    for at in np.argsort(-memory)[:8]:
        up, down = flat.astype(np.float64), flat.astype(np.float64)
        up[at] += 1e-3
        down[at] -= 1e-3
        numeric = -(lm.log_probabilities(up, target, context).mean(dtype=np.float64) - lm.log_probabilities(down, target, context).mean(dtype=np.float64)) / 2e-3
        assert slope[at] == pytest.approx(numeric, rel=0.05, abs=1e-5)


def test_training_beats_word_shares_on_new_texts(spark, odd_docs, no_docs):
    turns = [" ".join(WORDS[(k + j) % 10] for j in range(40)) for k in range(400)]
    docs = spark.createDataFrame(list(enumerate(turns)), "doc_id long, text string").repartition(3)
    known, frequency = lm.vocabulary(docs)
    flat = lm.train(docs, known, frequency, rounds=3)
    new = spark.createDataFrame([(1, " ".join(WORDS[(3 + j) % 10] for j in range(30))), (2, " ".join(WORDS[(j * j) % 10] for j in range(30)))], "doc_id long, text string")
    good, bad = (r["mean_log_prob"] for r in lm.score(new, known, flat).orderBy("doc_id").collect())
    assert good > -1.5 > math.log(0.1) > bad
    rows = lm.pseudo_likelihood(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all((r["n_tokens"], r["log_prob"], r["mean_log_prob"]) == (0, 0.0, None) for r in rows if r["doc_id"] in (5, 6, 7, 8))
    assert lm.pseudo_likelihood(no_docs).count() == 0


def test_vocabulary_follows_the_corpus(spark):
    texts = [" ".join(f"w{(k * 300 + j) % 1500}" for j in range(300)) for k in range(120)]
    known, frequency = lm.vocabulary(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert len(known) == 1500 and frequency.sum() == 36_000 and len(lm.start(frequency)) > len(lm.start(np.ones(lm.WORDS)))


@pytest.mark.parametrize("listed", [1 << 18, 3, 0])
def test_shared_entries_are_split_by_counts(spark, monkeypatch, listed):
    monkeypatch.setattr(lm, "LISTED", listed)
    hashes = {f"rare{k}": lm.word_hashes(pa.array([f"rare{k}"]))[0] for k in range(3000)}
    cell = {w: int(lm.word_ids(h, np.zeros(0, np.int64))[0]) for w, h in hashes.items()}
    common, once, never = [w for w in cell if cell[w] == cell["rare0"]][:3]
    known = np.sort(np.concatenate([lm.word_hashes(pa.array([f"own{k}"]))[0] for k in range(700)]))
    counted = [(int(h), 20) for h in known] + [(int(hashes[common][0]), 9), (int(hashes[once][0]), 1)] + [(int(hashes[f"rare{k}"][0]), 2) for k in range(2000, 2004)]
    counts = spark.createDataFrame(counted, "word long, n long")
    frequency = np.ones(lm.WORDS, np.int64)
    docs = spark.createDataFrame([(1, common), (2, once), (3, never), (4, f"own0 {common} {once}"), (5, "own1"), (6, None)], "doc_id long, text string")
    flat = lm.start(frequency)
    got = {r["doc_id"]: r["log_prob"] for r in lm.score(docs, known, flat, counts).collect()}
    whole = {r["doc_id"]: r["log_prob"] for r in lm.score(docs, known, flat).collect()}
    others = sum(3 for k in range(2000, 2004) if cell[f"rare{k}"] == cell["rare0"])
    total = 10 + 2 + others + 1
    # The three are one entry; single words have the same context.
    assert [math.exp(got[k] - whole[k]) * total for k in (1, 2, 3)] == pytest.approx([10, 2, 1], rel=1e-5)
    assert got[4] - whole[4] == pytest.approx(math.log(20 / total**2), abs=1e-5) and got[5] == whole[5] and got[6] == 0


# 6 and 10: vectors


def vectors(spark, seed=0, n=300, copies=60):
    draw = np.random.default_rng(seed)
    base = draw.normal(size=(n, 16))
    near = base[0] + 0.03 * draw.normal(size=(copies, 16))
    rows = [(k, v.astype(np.float32).tolist(), int(k % 3)) for k, v in enumerate([*base, *near, *[base[1]] * 10])]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] + [1.0] * 15, 1), (904, base[1].tolist(), None), (None, base[2].tolist(), 2), (905, [], 1), (906, [1.0, 2.0], 1), (7, base[7].tolist(), 1)]
    return rows + odd


def test_vector_links_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(itq, "BLOCK", 16)
    rows = vectors(spark)
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], EMB)
    usable = [i for i, (_, v, y) in enumerate(rows) if v and y is not None and None not in v and np.isfinite(v).all() and any(v)]
    unit = {i: np.pad(np.array(rows[i][1], np.float32).astype(float), (0, 16 - len(rows[i][1]))) for i in usable}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    pairs = [(i, j) for i in usable for j in usable if j < i and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= 0.93 - 1e-12]
    links = Counter(k for p in pairs for k in p)
    got = itq.near_vectors(table).collect()
    assert len(got) == len(rows)
    found = Counter()
    for r in got:
        found[r["vec_id"]] += r["n_links"]
    want = Counter()
    for i, n in links.items():
        want[rows[i][0]] += n
    assert all(found[k] <= want[k] for k in found) and sum(found.values()) >= 0.9 * sum(want.values())
    alone = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] in range(900, 906)}
    assert alone == {k: (0, k, True) for k in range(900, 906)}
    assert itq.near_vectors(table.limit(0)).count() == 0


def test_rotation_is_orthogonal_and_balanced():
    sample = np.random.default_rng(1).normal(size=(500, 16))
    mean, projection = itq.learn(sample, 8, 2)
    assert projection.T @ projection == pytest.approx(np.eye(16), abs=1e-9)
    share = ((sample - mean) @ projection >= 0).mean(axis=0)
    assert (abs(share - 0.5) < 0.15).all()
    assert itq.learn(sample, 8, 6)[1].shape == (16, 48)


@pytest.mark.parametrize("bits", [8, 14, 20, 24])
def test_tables_follow_the_length_of_runs(bits):
    draw = np.random.default_rng(bits)
    left = draw.normal(size=(3000, 64))
    left /= np.linalg.norm(left, axis=1, keepdims=True)
    off = draw.normal(size=left.shape)
    off -= (off * left).sum(axis=1, keepdims=True) * left
    right = itq.COSINE * left + np.sqrt(1 - itq.COSINE**2) * off / np.linalg.norm(off, axis=1, keepdims=True)
    tables = itq.tables_for(bits, itq.COSINE)
    mean, projection = itq.learn(left, bits, tables)
    a, b = (itq.code_runs(v, mean, projection, bits) for v in (left, right))
    assert a.shape == (3000, tables) and itq.near_runs(a, b).any(axis=1).mean() >= 0.95
    assert tables == itq.TABLES if bits <= 14 else tables > itq.TABLES


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pivots, "QUERY_BLOCK", 8)
    monkeypatch.setattr(pivots, "CANDIDATE_BLOCK", 100)
    monkeypatch.setattr(pivots, "FIRST_TRIED", 16)
    rows = vectors(spark, 3)
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], EMB)
    usable = [(i, r[0], np.floor(64 * np.pad(np.array(r[1], np.float32).astype(float), (0, 16 - len(r[1]))))) for i, r in enumerate(rows) if r[1] is not None and None not in r[1] and np.isfinite(r[1]).all()]
    want = []
    for i, q, v in usable:
        if q is not None and q % 20 == 0:
            best = sorted((-int(v @ w), math.inf if x is None else x) for j, x, w in usable if j != i)[:20]
            want += [(q, k + 1, x, -s) for k, (s, x) in enumerate(best)]
    got = pivots.exact_search(table).collect()
    assert sorted((r["query_id"], r["rank"], math.inf if r["vec_id"] is None else r["vec_id"], r["score"]) for r in got) == sorted(want)
    assert pivots.exact_search(table.limit(0)).count() == 0


def test_elimination_stops_early_and_exactly():
    draw = np.random.default_rng(2)
    near = np.floor(64 * (np.ones(16) + 0.01 * draw.normal(size=(300, 16))))
    far = np.floor(64 * draw.normal(size=(3000, 16)) * 0.2)
    candidates = np.concatenate([far, near])
    bounds = pivots.upper_bounds(near[:1], candidates, pivots.choose_pivots(candidates[::10]))[0]
    exact = candidates @ near[0]
    assert (bounds >= exact).all()
    places, scores, tried = pivots.best_of_block(near[0], candidates, np.arange(len(candidates)), np.ones(len(candidates), bool), bounds, 20)
    assert tried < len(candidates) and places.tolist() == np.lexsort((np.arange(len(candidates)), -exact))[:20].tolist() and scores.tolist() == exact[places].tolist()


@pytest.mark.parametrize("width", [1, 5, 64])
def test_bounds_hold_and_eliminate(width):
    draw = np.random.default_rng(width)
    centres = draw.normal(size=(40, width))
    rows = np.floor(64 * (centres[draw.integers(0, 40, 4000)] + 0.3 * draw.normal(size=(4000, width))))
    rows[:3] = 0
    chosen = pivots.choose_pivots(rows[::4])
    near = np.arange(0, 4000, 100)
    bounds, exact = pivots.upper_bounds(rows[near], rows, chosen), rows[near] @ rows.T
    assert (bounds >= exact).all()
    # Never above what the distance to any single pivot allows.
    left, right = pivots.distances(rows[near], chosen), pivots.distances(rows, chosen)
    low = np.abs(left[:, None] - right[None]).max(axis=2)
    sizes = (rows[near] ** 2).sum(axis=1)[:, None] + (rows**2).sum(axis=1)[None]
    room = 1e-6 * (sizes + left[:, :1] ** 2 + right[:, 0] ** 2) + 1e-2
    assert (bounds <= (sizes - low**2) / 2 + room).all()
    tried = 0
    for at in range(len(near)):
        found, scores, n = pivots.best_of_block(rows[near[at]], rows, np.arange(4000), np.ones(4000, bool), bounds[at], 20)
        assert found.tolist() == np.lexsort((np.arange(4000), -exact[at]))[:20].tolist()
        tried += n
    assert tried < 0.3 * len(near) * 4000
    # Equal rows have one pivot and no height.
    assert (pivots.upper_bounds(rows[:3], rows[:3], pivots.choose_pivots(np.ones((5, width)))) >= 0).all()


def test_huge_components_are_whole_numbers(spark):
    rows = [(0, [1e30, 1.0]), (20, [1.0, 2.0]), (3, [-1e30, 5.0]), (4, [3.0, 1.0]), (5, [1e300, -1e300]), (6, [2.0**40, 0.0]), (7, None), (40, [2.0**35, 1.0])]
    table = spark.createDataFrame([(i, v, 1, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, text long, extra string")
    whole = {i: [math.floor(64 * x) for x in v] for i, v in rows if v}
    cut = lambda n: min(max(n, -(1 << 63)), (1 << 63) - 1)
    want = []
    for q in (0, 20, 40):
        best = sorted((-cut(sum(x * y for x, y in zip(whole[q], w, strict=True))), i) for i, w in whole.items() if i != q)
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, pivots.exact_search(table).collect())) == sorted(want)


# 1: secrets


def test_forest_keeps_secrets_and_drops_the_rest(spark, odd_docs, no_docs):
    key = lambda k: "".join("0123456789abcdef"[(k * 7919 >> (j % 13)) * (j + 3) % 16] for j in range(40))
    texts = [f'{sentence(k, 8)} token = "{key(k)}" {sentence(k + 1, 5)}' for k in range(60)] + [f"{sentence(k, 6)} {''.join(WORDS[(k + j) % len(WORDS)] for j in range(6))} {sentence(k, 4)}" for k in range(60)]
    docs = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    rows = secrets.scan_documents(docs).collect()
    verdicts = {r["candidate"]: r["is_secret"] for r in rows}
    assert all(verdicts[key(k)] for k in range(60)) and not any(v for c, v in verdicts.items() if c.isalpha())
    assert len(rows) == 120 and {r["doc_id"] for r in rows} == set(range(120))
    assert secrets.scan_documents(odd_docs).filter("doc_id IN (5, 6, 7, 8)").count() == 0 and secrets.scan_documents(no_docs).count() == 0


def test_findings_carry_their_surroundings(spark):
    docs = spark.createDataFrame([(1, 'set api_key="ABCDEFGHIJ0123456789+/" now\nx=AAAAAAAAAAAAAAAAAAAAAA;BBBBBBBBBBBBBBBBBBBBBB', None)], "doc_id long, text string, source string")
    got = [(r["word_no"], r["part"], r["candidate"], r["before"], r["lead"], r["after"]) for r in secrets.findings(docs).orderBy("word_no", "part").collect()]
    assert got[0] == (1, 0, "ABCDEFGHIJ0123456789+/", "set", 'api_key="', "now") and [g[1:3] for g in got[1:]] == [(0, "x=AAAAAAAAAAAAAAAAAAAAAA"), (1, "BBBBBBBBBBBBBBBBBBBBBB")]
