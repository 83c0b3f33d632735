"""Dense, keyword and fused search against brute force; skewed and large inputs."""

import math
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from groundspark.functions.stemming import stem
from groundspark.operators import approximate, dense, embedding, fulltext, fusion, grouping, lexemes
from groundspark.plans import retrieval
from groundspark.runtime import frequent_values, skew_join, write_table

WORDS = [f"w{i}" for i in range(30)]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    rows = []
    for document in range(60):
        text = "copy of the same words w1 w2 w3" if document % 3 == 0 else " ".join(rng.choices(WORDS, k=rng.randint(1, 40)))
        rows.append((document, 0, text))
    rows += [(100, 0, ""), (101, 0, "w1"), (101, 1, "w1")]
    chunks = spark.createDataFrame(rows, "document_id long, chunk_index int, text string")
    table = write_table(lexemes.with_lexemes(embedding.hashing(32)(chunks), "simple"), "corpus")
    asked = [(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 6)))) for i in range(25)] + [(98, ""), (99, "unheard w1")]
    return rows, table, asked, spark.createDataFrame(asked, "query_id long, text string")


def brute_dense(rows, asked, dim, limit):
    def vector(text):
        from tests.test_index import slow_vector

        return slow_vector(text, dim)

    def key(hit):
        return (hit[0] is None, -(hit[0] or 0), hit[1], hit[2])

    out = set()
    for query, text in asked:
        q = vector(text)
        scored = []
        for document, index, body in rows:
            c = vector(body)
            scale = sum(v * v for v in q) * sum(v * v for v in c)
            scored.append((sum(a * b for a, b in zip(q, c)) / math.sqrt(scale) if scale else None, document, index))
        for rank, hit in enumerate(sorted(scored, key=key)[:limit], start=1):
            out.add((query, hit[1], hit[2], None if hit[0] is None else round(hit[0], 9), rank))
    return out


def as_set(hits):
    return {(r.query_id, r.document_id, r.chunk_index, None if r.score is None else round(r.score, 9), r["rank"]) for r in hits.collect()}


@pytest.mark.parametrize("limit", [1, 7, 500])
def test_dense_equals_brute_force(corpus, limit):
    rows, table, asked, queries = corpus
    hits = dense.dense_search(embedding.hashing(32)(queries), table, limit)
    assert as_set(hits) == brute_dense(rows, asked, 32, limit)


def test_dense_in_many_passes(corpus):
    rows, table, asked, queries = corpus
    hits = dense.dense_search(embedding.hashing(32)(queries), table, 7, queries_per_pass=4)
    assert as_set(hits) == brute_dense(rows, asked, 32, 7)


def test_dense_small_slices(corpus, monkeypatch):
    rows, table, asked, queries = corpus
    monkeypatch.setattr(dense, "SCORES_PER_SLICE", 90)
    hits = dense.dense_search(embedding.hashing(32)(queries), table.coalesce(1), 5)
    assert as_set(hits) == brute_dense(rows, asked, 32, 5)


def test_dense_with_many_copies(spark):
    """Most chunks tie at the cut, in any order of arrival."""
    rng = random.Random(11)
    rows = [(d, i, "same words here" if rng.random() < 0.9 else "other words there") for d in range(80) for i in range(5)]
    rng.shuffle(rows)
    asked = [(1, "same"), (2, "there words"), (3, "")]
    chunks = embedding.hashing(32)(spark.createDataFrame(rows, "document_id long, chunk_index int, text string").coalesce(2))
    queries = embedding.hashing(32)(spark.createDataFrame(asked, "query_id long, text string"))
    for limit in (3, 20):
        assert as_set(dense.dense_search(queries, chunks, limit)) == brute_dense(rows, asked, 32, limit)


def test_dense_skips_missing_vectors(spark, corpus):
    _, table, _, queries = corpus
    partly = table.withColumn("vector", F.when(F.col("document_id") != 101, F.col("vector")))
    found = dense.dense_search(embedding.hashing(32)(queries), partly, 1000)
    assert found.filter("document_id = 101").count() == 0
    assert dense.dense_search(embedding.hashing(32)(queries.limit(0)), table, 5).count() == 0


def test_dense_scans_chunks_once_without_shuffling_them(corpus):
    _, table, _, queries = corpus
    plan = dense.dense_search(embedding.hashing(32)(queries), table, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert plan.index("Exchange") < plan.index("MapInArrow")  # only hits are exchanged
    scan = plan[plan.index("ReadSchema") :].splitlines()[0]
    assert "text" not in scan and "lexemes" not in scan


def brute_fulltext(rows, asked, limit):
    stop = set(lexemes.STOPWORDS)
    out = set()
    for query, text in asked:
        wanted = {w for w in text.split() if w not in stop}
        hits = []
        for document, index, body in rows:
            counts = Counter(body.split())
            if wanted and all(counts[w] for w in wanted):
                units = sum(10**9 // (j * j) for w in wanted for j in range(1, counts[w] + 1))
                hits.append((-units, document, index))
        for rank, (units, document, index) in enumerate(sorted(hits)[:limit], start=1):
            out.add((query, document, index, round(-units / 1e9, 9), rank))
    return out


@pytest.mark.parametrize("small", [True, False])
def test_fulltext_equals_brute_force(corpus, monkeypatch, small):
    rows, table, asked, queries = corpus
    monkeypatch.setattr(fulltext, "text_fits_broadcast", lambda *_: small)
    hits = fulltext.fulltext_search(lexemes.with_lexemes(queries, "simple"), table, 10)
    assert as_set(hits) == brute_fulltext(rows, asked, 10)


@pytest.mark.parametrize("small,pushed", [(True, 1000), (True, 0), (False, 1000), (False, 0)])
def test_postings_search_equals_brute_force(corpus, monkeypatch, tmp_path, small, pushed):
    rows, table, asked, queries = corpus
    lexemes.write_postings(lexemes.postings(table), str(tmp_path / "postings"))
    monkeypatch.setattr(fulltext, "text_fits_broadcast", lambda *_: small)
    monkeypatch.setattr(fulltext, "MAX_PUSHED_LEXEMES", pushed)
    stored = table.sparkSession.read.parquet(str(tmp_path / "postings"))
    hits = fulltext.fulltext_from_postings(lexemes.with_lexemes(queries, "simple"), stored, 10)
    assert as_set(hits) == brute_fulltext(rows, asked, 10)
    if pushed:
        assert "In(lexeme" in hits._jdf.queryExecution().executedPlan().toString()


def test_small_searches_carry_no_lexeme_lists(corpus, monkeypatch):
    """a candidate of a small question table carried all lexemes of its chunk and counted them again."""
    rows, table, _, _ = corpus
    asked = [(i, word) for i, word in enumerate(WORDS)] + [(50, "w1 w2"), (51, "w1 unheard")]
    monkeypatch.setattr(fulltext, "frequency_score", None)
    queries = table.sparkSession.createDataFrame(asked, "query_id long, text string")
    hits = fulltext.fulltext_search(lexemes.with_lexemes(queries, "simple"), table, 10)
    assert as_set(hits) == brute_fulltext(rows, asked, 10)


def test_stemmed_search_equals_brute_force(spark):
    rng = random.Random(5)
    forms = ["trial", "trials", "dose", "dosing", "doses", "patients", "patient", "the", "of", "improved", "improving", "Survival"]
    rows = [(d, 0, " ".join(rng.choices(forms, k=rng.randint(1, 12)))) for d in range(50)]
    asked = [(q, " ".join(rng.choices(forms, k=rng.randint(1, 4)))) for q in range(20)]

    def stemmed(text):
        return " ".join(stem(w) for w in text.lower().split() if w not in lexemes.STOPWORDS)

    chunks = lexemes.with_lexemes(spark.createDataFrame(rows, "document_id long, chunk_index int, text string"))
    queries = lexemes.with_lexemes(spark.createDataFrame(asked, "query_id long, text string"))
    want = brute_fulltext([(d, i, stemmed(t)) for d, i, t in rows], [(q, stemmed(t)) for q, t in asked], 10)
    assert as_set(fulltext.fulltext_search(queries, chunks, 10)) == want
    counts = Counter(w for _, _, t in rows for w in stemmed(t).split())
    got = chunks.select(F.explode("lexemes").alias("lexeme")).groupBy("lexeme").count().collect()
    assert {r.lexeme: r["count"] for r in got} == counts


def test_search_through_postings(spark, library):
    documents, index = library
    queries = spark.createDataFrame([(1, "tirbonib lung cancer"), (2, "sleep")], "query_id long, text string")
    plain = retrieval.search(queries, index, documents)
    indexed = retrieval.search(queries, index, documents, postings=lexemes.postings(index))
    assert sorted(map(str, plain.collect())) == sorted(map(str, indexed.collect()))


def test_fulltext_equal_single_occurrences_tie(spark):
    chunks = spark.createDataFrame([(2, 0, "red sky"), (1, 0, "red sea and much other text"), (3, 0, "red red")], "document_id long, chunk_index int, text string")
    queries = spark.createDataFrame([(1, "red")], "query_id long, text string")
    hits = fulltext.fulltext_search(lexemes.with_lexemes(queries), lexemes.with_lexemes(chunks), 5).orderBy("rank").collect()
    assert [(h.document_id, h.score) for h in hits] == [(3, 1.25), (1, 1.0), (2, 1.0)]


def slow_fusion(rankings, k):
    scores, ranks = defaultdict(float), defaultdict(dict)
    for source, ranking in enumerate(rankings):
        for rank, item in enumerate(ranking, start=1):
            if source not in ranks[item]:
                ranks[item][source] = rank
                scores[item] += 1.0 / (k + rank)
    ordered = sorted(scores, key=lambda i: -scores[i])
    return [(i, scores[i], ranks[i]) for i in ordered]


def fuse(spark, rankings, k=60, top_k=None):
    lists = [
        spark.createDataFrame([(1, item, rank) for rank, item in enumerate(ranking, start=1)], "query_id long, item long, rank int")
        for ranking in rankings
    ]
    return [(r["item"], r.score, r.source_ranks) for r in fusion.reciprocal_rank_fusion(lists, ["item"], k, top_k).orderBy("rank").collect()]


@pytest.mark.parametrize(
    "rankings",
    [
        [[1, 2, 3]],
        [[5, 5, 5, 7]],
        [[1, 2], [2, 1]],
        [[1, 2, 3], [9, 3]],
        [[4, 1], [], [1, 4, 6]],
        [[], []],
    ],
)
def test_fusion_cases(spark, rankings):
    assert fuse(spark, rankings) == slow_fusion(rankings, 60)


def test_fusion_values(spark):
    assert fuse(spark, [[5, 5, 5, 7]]) == [(5, 1 / 61, {0: 1}), (7, 1 / 64, {0: 4})]
    assert [r[2] for r in fuse(spark, [[1, 2], [2, 1]])] == [{0: 1, 1: 2}, {0: 2, 1: 1}]
    assert len(fuse(spark, [[1, 2, 3]], top_k=2)) == 2
    with pytest.raises(ValueError):
        fuse(spark, [[1]], k=0)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=8), min_size=1, max_size=3), st.integers(1, 80))
def test_fusion_random(spark, rankings, k):
    assert fuse(spark, rankings, k) == slow_fusion(rankings, k)


@pytest.fixture(scope="module")
def library(spark):
    texts = {
        1: ("trial", "NCT00000001", "Tirbonib slowed tumour growth in adults with lung cancer. Dosing was weekly."),
        2: ("trial", "NCT00000002", "Placebo controlled study of vitamin supplements in healthy volunteers."),
        3: ("publication", "3001", "Results: tirbonib improved survival in lung cancer compared with placebo."),
        4: ("publication", "3002", "A review of sleep habits among students."),
    }
    rows = [(k, t, i, f"https://example.org/{i}", f"Title {i}", text) for k, (t, i, text) in texts.items()]
    documents = spark.createDataFrame(rows, "document_id long, source_type string, source_identifier string, source_url string, title string, text string")
    return documents, write_table(retrieval.build_index(documents), "library")


def ask(spark, library, text, **options):
    documents, index = library
    return retrieval.search(spark.createDataFrame([(1, text)], "query_id long, text string"), index, documents, **options).orderBy("rank").collect()


def test_hybrid_search(spark, library):
    found = ask(spark, library, "tirbonib lung cancer")
    assert {found[0].source_identifier, found[1].source_identifier} == {"NCT00000001", "3001"}
    assert found[0].matched_by == ["fulltext", "dense"] and len(found) == 4
    assert found[0].score <= 2 / 61 and [r["rank"] for r in found] == [1, 2, 3, 4]
    assert all(r.excerpt for r in found)


def test_single_modes(spark, library):
    keyword = ask(spark, library, "tirbonib cancers", mode="fulltext")
    assert {r.source_identifier for r in keyword} == {"NCT00000001", "3001"}
    assert all(r.matched_by == ["fulltext"] for r in keyword) and keyword[0].score == 1 / 61
    assert ask(spark, library, "tirbonib unheardof", mode="fulltext") == []
    nearest = ask(spark, library, "sleep habits", mode="dense", top_k=1)
    assert [r.source_identifier for r in nearest] == ["3002"] and nearest[0].matched_by == ["dense"]


def test_blank_questions_and_bounds(spark, library):
    assert ask(spark, library, "  \n") == []
    for options in ({"top_k": 0}, {"top_k": 51}, {"mode": "magic"}):
        with pytest.raises(ValueError):
            ask(spark, library, "x", **options)


def test_missing_chunks_drop_out(spark, library):
    documents, index = library
    hits = spark.createDataFrame([(1, 1, 1, 0, 0.5, ["dense"]), (1, 2, 77, 0, 0.4, ["dense"])], "query_id long, rank int, document_id long, chunk_index int, score double, matched_by array<string>")
    for few in (True, False):
        assert [r["rank"] for r in retrieval.load_results(hits, index, documents, few).collect()] == [1]


def test_response(spark, library):
    documents, index = library
    queries = spark.createDataFrame([(1, "tirbonib"), (2, " ")], "query_id long, text string")
    rows = {r.query_id: r for r in retrieval.search_response(queries, retrieval.search(queries, index, documents, top_k=3), "hybrid").collect()}
    assert [x["rank"] for x in rows[1].results] == [1, 2, 3] and rows[2].results == []


def test_grouping(spark):
    rows = [
        (1, 1, "trial", "A", 0, 0.3, ["dense"]), (1, 2, "publication", "P", 0, 0.3, ["dense"]), (1, 3, "trial", "B", 0, 0.2, ["fulltext"]),
        (1, 4, "trial", "B", 1, 0.3, ["dense", "fulltext"]), (1, 5, "trial", "A", 1, 0.1, ["fulltext"]),
    ]
    hits = spark.createDataFrame(rows, "query_id long, rank int, source_type string, source_identifier string, chunk_index int, score double, matched_by array<string>")
    hits = hits.withColumns({"document_id": F.lit(1), "source_url": F.lit("u"), "title": F.lit("t"), "excerpt": F.lit("e")})
    groups = grouping.group_by_source(hits, "trial").orderBy("place").collect()
    assert [(g.source_identifier, g.best_score, g.matched_by, [e.chunk_index for e in g.excerpts]) for g in groups] == [
        ("A", 0.3, ["dense", "fulltext"], [0, 1]),
        ("B", 0.3, ["fulltext", "dense"], [1, 0]),
    ]


def test_approximate_search(spark, corpus, tmp_path):
    _, table, _, queries = corpus
    asked = embedding.hashing(32)(queries)
    centres = approximate.train_lists(table, 6)
    assert centres.shape[1] == 32
    approximate.write_lists(table, centres, str(tmp_path / "lists"))
    lists = spark.read.parquet(str(tmp_path / "lists"))
    exact = dense.dense_search(asked, table, 5).filter("score is not null")
    # All lists probed: the same hits as exact search.
    assert as_set(approximate.approximate_search(asked, lists, centres, 5, probes=6)) == as_set(exact)
    few = approximate.approximate_search(asked, lists, centres, 5, probes=2)
    assert approximate.recall_against(exact, few).agg(F.avg("recall")).first()[0] > 0.5
    truth = {(r.query_id, r.document_id, r.chunk_index): r.score for r in dense.dense_search(asked, table, 1000).collect()}
    assert all(abs(truth[(r.query_id, r.document_id, r.chunk_index)] - r.score) < 1e-9 for r in few.collect())
    assert as_set(approximate.approximate_search(asked, lists, centres, 5, probes=2, queries_per_pass=4)) == as_set(few)
    one = approximate.approximate_search(asked.limit(1), lists, centres, 5, probes=1)
    assert "PartitionFilters: [isnotnull(list" in one._jdf.queryExecution().executedPlan().toString()
    assert approximate.approximate_search(asked.limit(0), lists, centres, 5).count() == 0


def test_probes_are_chosen_for_recall(spark, corpus, tmp_path):
    _, table, _, queries = corpus
    asked = embedding.hashing(32)(queries)
    many = table.withColumn("document_id", F.col("document_id") * 100).crossJoin(spark.range(100)).withColumn("document_id", F.col("document_id") + F.col("id")).drop("id")
    assert 60 < len(approximate.train_lists(many.withColumn("vector", F.transform("vector", lambda v: (v + F.rand(1) * 4).cast("float"))))) <= 80
    centres = approximate.train_lists(table)
    approximate.write_lists(table, centres, str(tmp_path / "lists"), rows_per_file=3)
    lists = spark.read.parquet(str(tmp_path / "lists"))
    assert lists.count() == table.filter("norm2 > 0").count()
    exact = dense.dense_search(asked, table, 5).filter("score is not null")
    recall = lambda probes: approximate.recall_against(exact, approximate.approximate_search(asked, lists, centres, 5, probes=probes)).agg(F.avg("recall")).first()[0]
    probes = approximate.choose_probes(asked, table, lists, centres, 5)
    assert recall(probes) >= 0.9 and (probes == 1 or recall(probes - 1) < approximate.CALIBRATION_RECALL)
    assert approximate.choose_probes(asked, table, lists, centres, 5, recall=1.0) <= len(centres) and recall(len(centres)) == 1.0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join(spark, how):
    left = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 40).cast("long").alias("k"), "id"
    )
    right = spark.range(0, 40, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    plain = sorted(map(tuple, left.join(right, "k", how).collect()), key=repr)
    assert sorted(map(tuple, skew_join(left, right, "k", how, ["id"], spread=16).collect()), key=repr) == plain


def test_frequent_values(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 400, F.lit(7)).otherwise(F.col("id")).alias("k"))
    found = [r.k for r in frequent_values(rows, "k", 0.1).collect()]
    assert 7 in found and len(found) <= 10


def test_few_candidates_do_not_shuffle_the_postings(spark, monkeypatch):
    """Without broadcasts of Spark's own choice: the postings are scanned, or shuffled if candidates are many, for the same hits."""
    rows = [(f"w{i % 7}", i // 7, 0, 1 + i % 3, [1]) for i in range(700)]
    stored = spark.createDataFrame(rows, "lexeme string, document_id long, chunk_index int, tf int, positions array<int>")
    asked = spark.createDataFrame([(1, ["w1", "w2"]), (2, ["w3", "none"])], "query_id int, lexemes array<string>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = fulltext.fulltext_from_postings(asked, stored, 5)
        plan = few._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        monkeypatch.setattr(fulltext, "BROADCAST_KEYS", 1)
        many = fulltext.fulltext_from_postings(asked, stored, 5).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many)) and len(many) == 5
