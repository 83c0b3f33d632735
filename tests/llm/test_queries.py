"""Registered queries on the smallest tables, and the pipeline against plain versions of its stages."""

from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from groundspark.llm import mixing
from groundspark.llm.queries import ORACLE_SQL, QUERIES
from groundspark.runtime import write_table
from tests.compare import compare
from tests.llm.test_operators import jaccard, roots, weighted

FOLDER = "/root/testdata/sf0.001"
# What the smallest tables hold nothing of: secrets, and phrases of a hundred uses.
LARGER = {n: "/root/testdata/sf0.01" for n in ("op1_secret_scan", "op13_phrase_mining")}


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    connection = duckdb.connect()
    folder = LARGER.get(name, FOLDER)
    for file in Path(folder).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    outcome, _ = compare(spark, connection, folder, name)
    assert outcome.startswith("equal" if name in ORACLE_SQL else "rows only") and "(0)" not in outcome, outcome


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name.replace(" ", "-"))
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = rows_of(docs)
        assert name == "packing" or docs.columns == columns
    whole = {r["doc_id"]: r for r in rows_of(spark.read.parquet(f"{FOLDER}/documents.parquet"))}
    told = kept["language ID"]
    assert all(r == whole[r["doc_id"]] for r in told) and len(told) >= 0.99 * len(whole)

    # Lines: the same decisions as all pairs of lines give.
    seen, want = [], {}
    for r in sorted(told, key=lambda r: r["doc_id"]):
        stay = []
        for line in r["text"].split("\n"):
            words = [w for w in line.lower().split(" ") if w]
            tokens = frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else None
            if tokens is None or not any(len(tokens & o) >= 0.8 * len(tokens | o) for o in seen if len(o) >= 0.8 * len(tokens) and len(tokens) >= 0.8 * len(o)):
                stay.append(line)
            if tokens:
                seen.append(tokens)
        # A document that had words and lost them all goes.
        if "".join(stay).strip() or not (r["text"] or "").strip():
            want[r["doc_id"]] = "\n".join(stay)
    lines = {r["doc_id"]: r["text"] for r in kept["line dedup"]}
    assert lines == want

    ids = sorted(lines)
    sets, _ = weighted([lines[d] for d in ids])
    owners = defaultdict(set)
    for i, s in enumerate(sets):
        for k in s:
            owners[k].add(i)
    pairs = {(i, j) for o in owners.values() for i in o for j in o if i < j}
    group = roots(range(len(ids)), [p for p in pairs if jaccard(sets[p[0]], sets[p[1]]) >= 0.8])
    near = sorted(r["doc_id"] for r in kept["MinHash near-dedup"])
    assert near == [ids[i] for i in range(len(ids)) if group[i] == i]

    uses = defaultdict(int)
    for r in kept["mixing"]:
        uses[r["doc_id"]] += 1
    assert set(uses) == set(near) and max(uses.values()) <= corpus_pipeline.MAX_REPEATS + 1
    tokens = mixing.schedule(spark.read.parquet(str(tmp_path / "MinHash-near-dedup")), max_repeats=corpus_pipeline.MAX_REPEATS).count()
    assert sum(uses.values()) == tokens

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    plain.encode_special_tokens = True
    found = defaultdict(list)
    for r in kept["packing"]:
        found[r["doc_id"], r["start"]].append(np.frombuffer(r["ids"], "<u2").tolist())
    for d, n in uses.items():
        ids_of = plain.encode(lines[d], add_special_tokens=False).ids + [2]
        for start in range(0, len(ids_of), 4096):
            assert found.pop((d, start)) == [ids_of[start : start + 4096]] * n
    assert not found

    # Of equal texts, one document is packed.
    copies = defaultdict(set)
    for r in told:
        copies[r["text"]].add(r["doc_id"])
    packed = {r["doc_id"] for r in kept["packing"]}
    several = [ids for text, ids in copies.items() if len(ids) > 1 and (text or "").strip()]
    assert several and all(len(ids & packed) <= 1 for ids in several)


def test_pipeline_of_odd_documents(spark, odd_docs, no_docs):
    """Odd rows among ordinary ones, with columns named like those of the stages."""
    plain = spark.read.parquet(f"{FOLDER}/documents.parquet")
    clash = [c for c in odd_docs.columns if c not in plain.columns]
    typed = odd_docs.select(*[F.col(c).cast(plain.schema[c].dataType) for c in plain.columns], *clash)
    ordinary = plain.select((F.col("doc_id") + 1000).alias("doc_id"), *plain.columns[1:], *[F.lit(None).cast(odd_docs.schema[c].dataType).alias(c) for c in clash])
    docs = typed.unionByName(ordinary)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = write_table(stage(spark, docs, FOLDER), name.replace(" ", "-"))
        assert name == "packing" or docs.columns == columns
        if name == "language ID":  # without a letter there is no language
            assert not [r for r in docs.collect() if not any(c.isalpha() for c in r["text"] or "")]
        if name == "MinHash near-dedup":
            ids = [r["doc_id"] for r in docs.collect()]
            assert len(set(ids) & {1, 2, 3}) <= 1 and ids.count(9) <= 1
    packed = {r["doc_id"] for r in docs.collect()}
    assert len(packed & {r["doc_id"] + 1000 for r in plain.collect()}) > 100
