"""Chunking, vectors, lexemes: scalar twins with random input, and invariants."""

import hashlib
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from groundspark import runtime
from groundspark.functions.stemming import stem
from groundspark.operators import chunking, embedding, lexemes
from groundspark.plans.retrieval import build_index, enrich_chunks


def slow_windows(text, size, overlap):
    """One character at a time, straight from the definition."""
    spans, start = [], 0
    while True:
        while start < len(text) and text[start].isspace():
            start += 1
        if start == len(text):
            return spans
        end = min(start + size, len(text))
        if end < len(text):
            for place in range(end - 1, start, -1):
                if text[place] == " ":
                    end = place
                    break
        spans.append((start, end))
        if end == len(text):
            return spans
        start = end - overlap if end - overlap > start else end


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é\n\t ", max_size=120), st.integers(1, 20), st.data())
def test_windows_match_definition(text, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    got = chunking.window_spans(text, size, overlap)
    assert [(s["char_start"], s["char_end"]) for s in got] == slow_windows(text, size, overlap)
    assert all(s["text"] == text[s["char_start"] : s["char_end"]] and len(s["text"]) <= size for s in got)


def spans_of(spark, text, size, overlap):
    rows = chunking.chunk_documents(spark.createDataFrame([(1, text)], "document_id long, text string"), size, overlap)
    return [(r.char_start, r.char_end) for r in rows.orderBy("chunk_index").collect()]


def test_windows_by_hand(spark):
    assert spans_of(spark, "aaaa bbbb cccc dddd", 10, 2) == [(0, 9), (7, 14), (12, 19)]
    assert spans_of(spark, "   \n\t ", 10, 2) == []
    assert spans_of(spark, "   lead", 10, 2) == [(3, 7)]
    assert spans_of(spark, "x" * 25, 10, 0) == [(0, 10), (10, 20), (20, 25)]


@pytest.mark.parametrize("size,overlap", [(0, 0), (-1, 0), (10, -1), (10, 10), (10, 11)])
def test_window_arguments(spark, size, overlap):
    with pytest.raises(ValueError):
        chunking.chunk_documents(spark.createDataFrame([(1, "x")], "document_id long, text string"), size, overlap)


def test_chunk_plan_has_no_shuffle(spark):
    documents = spark.range(10).select(F.col("id").alias("document_id"), F.lit("some text").alias("text"))
    plan = build_index(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def slow_vector(text, dim):
    vector = [0] * dim
    for token in text.lower().split():
        number = int(hashlib.sha256(token.encode()).hexdigest(), 16)
        vector[number % dim] += 1 if (number // dim) % 2 == 0 else -1
    return vector


@pytest.mark.parametrize("dim", [256, 64, 100, 7])
def test_vectors_match_definition(spark, dim):
    rng = random.Random(dim)
    words = ["Alpha", "beta", "GAMMA", "délta", "e", "ζ", "10", "x-y"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(40)] + ["", "  ", "a b\tc"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = embedding.hashing(dim)(rows).orderBy("id").collect()
    for row, text in zip(got, texts):
        want = slow_vector(text, dim)
        assert row["vector"] == want and row["norm2"] == sum(v * v for v in want)


def test_unit_vector(spark):
    rows = embedding.hashing(16)(spark.createDataFrame([("Same words",), ("same WORDS",), ("",)], "text string"))
    units = [r[0] for r in rows.select(embedding.unit_vector(F.col("vector"), F.col("norm2"))).collect()]
    assert units[0] == units[1] and abs(sum(v * v for v in units[0]) - 1) < 1e-12
    assert units[2] == [0.0] * 16


def test_providers(spark):
    vectors = spark.createDataFrame([(1, [3.0, 4.0])], "k long, embedding array<double>")
    rows = spark.createDataFrame([(1,), (2,)], "k long")
    got = {r.k: (r.vector, r.norm2) for r in embedding.embedding_provider("precomputed", vectors=vectors, keys=["k"], dim=2)(rows).collect()}
    assert got == {1: ([3.0, 4.0], 25.0), 2: (None, None)}
    with pytest.raises(Exception, match="expected 3"):
        embedding.precomputed(vectors, ["k"], 3)(rows).collect()
    with pytest.raises(ValueError):
        embedding.embedding_provider("telepathy")
    with pytest.raises(ValueError):
        embedding.hashing(0)


@pytest.mark.parametrize(
    "word,expected",
    [
        ("consisting", "consist"), ("relational", "relat"), ("hopping", "hop"), ("hoping", "hope"), ("flies", "fli"), ("dying", "die"),
        ("patients", "patient"), ("survival", "surviv"), ("randomized", "random"), ("agreed", "agre"), ("generously", "generous"),
        ("happiness", "happi"), ("controlled", "control"), ("knightly", "knight"), ("gas", "gas"), ("été", "été"), ("is", "is"), ("2021", "2021"),
    ],
)
def test_stems(word, expected):
    assert stem(word) == expected


def test_lexemes(spark):
    rows = spark.createDataFrame([("The Patients' responses, and the patient responded: 12-week",)], "text string")
    simple = lexemes.with_lexemes(rows, "simple").first()
    assert simple.lexemes == ["patients", "responses", "patient", "responded", "12", "week"]
    assert simple.positions == [2, 3, 6, 7, 8, 9]
    english = lexemes.with_lexemes(rows, "english").first()
    assert english.lexemes == ["patient", "respons", "patient", "respond", "12", "week"]
    with pytest.raises(ValueError):
        lexemes.with_lexemes(rows, "klingon")


def test_postings(spark, tmp_path):
    chunks = spark.createDataFrame([(1, 0, "red blue red"), (1, 1, "blue")], "document_id long, chunk_index int, text string")
    table = lexemes.postings(lexemes.with_lexemes(chunks, "simple"))
    lexemes.write_postings(table, str(tmp_path / "p"))
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "p")).collect())
    assert got == [("blue", 1, 0, 1, [2]), ("blue", 1, 1, 1, [1]), ("red", 1, 0, 2, [1, 3])]


def test_index_diff(spark):
    enrich = enrich_chunks(config="simple")

    def spans(texts):
        return chunking.chunk_documents(spark.createDataFrame(list(texts.items()), "document_id long, text string"), 10, 2)

    stored = enrich(spans({1: "aaaa bbbb cccc dddd", 2: "keep me", 3: "gone now"}))
    fresh = spans({1: "aaaa bbbb cccc", 2: "  keep me", 4: "new one"})
    diff = chunking.diff_chunks(fresh, stored)
    actions = {(r.document_id, r.chunk_index): r.action for r in diff.collect()}
    assert actions == {(1, 0): "unchanged", (1, 1): "unchanged", (1, 2): "deleted", (2, 0): "unchanged", (3, 0): "deleted", (4, 0): "created"}
    renewed = {(r.document_id, r.chunk_index): r for r in chunking.apply_index_diff(diff, stored, enrich).collect()}
    assert set(renewed) == {(1, 0), (1, 1), (2, 0), (4, 0)}
    assert renewed[(2, 0)].char_start == 0  # moved text keeps its stored offsets
    documents = spark.createDataFrame([(1,), (2,), (4,)], "document_id long")
    assert chunking.index_totals(diff, documents).first().asDict() == {"documents": 3, "created": 1, "updated": 0, "unchanged": 3, "deleted": 2}
    again = chunking.diff_chunks(fresh, chunking.apply_index_diff(diff, stored, enrich))
    assert {r.action for r in again.collect()} == {"unchanged"}


def test_python_work_is_cut_in_slices():
    """A batch of Spark's, however long, is turned into objects part by part, and all its rows come back in order."""
    texts = pa.array([f"word{i} " * 2_000 for i in range(1_000)] + [None, ""])
    parts = list(runtime.in_slices([texts, texts.slice(0, 0)], 1 << 20))
    assert len(parts) > 10 and max(p.nbytes for p in parts) < 2 << 20 and pa.concat_arrays(parts).equals(texts)
    assert [len(p) for p in runtime.in_slices([pa.array(["x" * 100] * 3)], 1)] == [1, 1, 1]
    hashed = list(embedding.hash_counts(4).func(iter([texts])))
    assert len(hashed) > 2 and sum(map(len, hashed)) == len(texts) and hashed[-1][-1].as_py() == [0] * 4


def test_stems_of_null_and_empty_rows(spark):
    rows = spark.createDataFrame([(["runs", "running", "run"],), (None,), ([],), (["cats"],)], "w array<string>").coalesce(1)
    assert [r[0] for r in rows.select(lexemes.stem_words(F.col("w"))).collect()] == [["run"] * 3, None, [], ["cat"]]
