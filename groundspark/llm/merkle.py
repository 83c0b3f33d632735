"""A Merkle manifest of a dataset: one digest for all rows, and a proof for each of them.

Every row is a leaf. The leaves of a language stand in order of doc_id; eight
consecutive nodes of a level become one of the next, until one is left, and the
roots of the languages are joined to one root in the same way.

A node carries the interval of leaf ranks that it covers. Nodes of a level meet
their parent by containment of intervals, bucketed by what a node of the parent's
level can cover at most, so the join is an equality and no window or task ever
sees a language whole. What a parent covers besides a child are the child's
siblings: those with a smaller interval stand left of it, the others right.

Order and repeats: null doc_ids come first, equal doc_ids stand by their digest, and
equal rows, which have equal digests, each have a place of their own.
"""

from __future__ import annotations

import string
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from groundspark.runtime import write_table

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
# A node that covers its tree is the root of it.
WHOLE = "hi - lo = size"


def record_digest(*values: Column) -> Column:
    """Digest of values: ``-`` for a null, else the count of UTF-8 bytes, ``:`` and the value."""
    parts = []
    for value in values:
        shown = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``rank`` and ``size`` within each ``tree``, without sorting a tree in one task.

    Rows are dealt by ranges of (tree, order); a place is the place inside the
    part plus the counts of earlier parts, of which there are as many as tasks.
    """
    dealt = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    placed = write_table(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), name)
    whole = Window.partitionBy("tree")
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("tree", "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    parts = parts.select("tree", "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("size"))
    # Written, so that its true size decides how it is joined.
    placed = placed.join(write_table(parts, f"{name}-parts"), ["tree", "_part"])
    return placed.withColumn("rank", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift")


def grow(leaves: DataFrame, name: str) -> list[DataFrame]:
    """Levels of all trees, from leaves(tree, size, rank, digest, ...) up; each is written once.

    A node is (tree, size, lo, hi, digest): ``size`` counts the leaves of its tree,
    ``lo`` and ``hi`` bound the ranks it covers. A tree stops at the level where one
    node covers it whole.
    """
    levels = [leaves.withColumn("lo", F.col("rank")).withColumn("hi", F.col("rank") + 1).drop("rank")]
    most = leaves.agg(F.max("size").alias("n")).first()["n"] or 0
    span = 1
    while span < most:
        span *= FANOUT
        below = levels[-1].filter(f"NOT ({WHOLE})").withColumn("bucket", F.expr(f"lo div {span}"))
        children = F.array_sort(F.collect_list(F.struct("lo", "digest")))
        nodes = below.groupBy("tree", "bucket").agg(
            F.first("size").alias("size"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sha2(F.array_join(F.transform(children, lambda c: c["digest"]), ""), 256).alias("digest")
        )
        levels.append(write_table(nodes.drop("bucket"), f"{name}-level"))
    return levels


def attach(nodes: DataFrame, above: DataFrame, span: int) -> DataFrame:
    """Nodes below the top of their tree with the ``top`` and the ``steps`` that lead there.

    Nodes meet the one of ``above`` whose interval contains theirs; both are bucketed
    by what it can cover at most. At most eight nodes share a parent.
    """
    bucket = F.expr(f"lo div {span}")
    extra = [c for c in nodes.columns if c not in ("tree", "size", "lo", "hi", "digest")]
    runs = nodes.filter(f"NOT ({WHOLE})").groupBy("tree", bucket.alias("bucket")).agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.array_sort(F.collect_list(F.struct("lo", "hi", "digest", *extra))).alias("run")
    )
    parents = above.select(F.col("tree").alias("p_tree"), bucket.alias("p_bucket"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"), "top", F.col("steps").alias("higher"))
    contained = (F.col("p_lo") <= F.col("lo")) & (F.col("hi") <= F.col("p_hi"))
    held = runs.join(parents, (F.col("tree") == F.col("p_tree")) & (F.col("bucket") == F.col("p_bucket")) & contained)
    each = held.select("tree", "top", "higher", "run", F.explode("run").alias("own"))

    def digests(part: Callable[[Column], Column]) -> Column:
        return F.array_join(F.transform(F.filter("run", part), lambda c: c["digest"]), "")

    # The parent's interval without the node's own: what ends before it and what begins after it.
    own = F.col("own")
    beside = F.struct(digests(lambda c: c["hi"] <= own["lo"]).alias("before"), digests(lambda c: c["lo"] >= own["hi"]).alias("after"))
    return each.select("tree", *[own[c].alias(c) for c in ("lo", "hi", "digest", *extra)], "top", F.concat(F.array(beside), "higher").alias("steps"))


def proofs(levels: list[DataFrame], name: str) -> DataFrame:
    """Leaves with ``steps``, their siblings at each level up to the tree's root, and ``top``, its digest.

    Attached from the top down, so a leaf is joined once. Levels above the leaves,
    an eighth of them at most, are written.
    """
    none = F.array().cast("array<struct<before:string,after:string>>")
    found = None
    for at in range(len(levels) - 1, -1, -1):
        done = levels[at].filter(WHOLE).drop("size").withColumn("top", F.col("digest")).withColumn("steps", none)
        if found is not None:
            done = done.unionByName(attach(levels[at], found, FANOUT ** (at + 1)))
        found = write_table(done, f"{name}-proofs") if at else done
    return found


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf gives with the siblings of its proof."""
    return F.aggregate(steps, leaf, lambda digest, step: F.sha2(F.concat(step["before"], digest, step["after"]), 256))


def proof_digest(steps: Column) -> Column:
    """Digest of all siblings of a proof, from the leaf to the root and from left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Leaves of documents(doc_id, source, lang, n_chars, text) with their proofs.

    Gives doc_id, lang, leaf, changed_leaf (the leaf with ``tampered`` as its text, if
    that differs), subroot, root and ``steps``. Nulls in any column have a defined
    digest, repeated rows are leaves of their own, a null language is a tree of its
    own and comes first; other columns are ignored. An empty table gives no rows.
    """
    own = [F.col(f) for f in FIELDS]
    leaf = record_digest(*own)
    changed = F.when(tampered != F.col("text"), record_digest(*own[:-1], tampered)) if tampered is not None else F.lit(None).cast("string")
    # Names of trees are never null and sort as the languages do, the null one first.
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), leaf.alias("digest"), changed.alias("changed"), F.monotonically_increasing_id().alias("_tie"))
    leaves = write_table(leaves, "merkle-leaves")
    levels = grow(ranked(leaves, [F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("_tie")], "merkle-order").drop("_tie"), "merkle")

    # The roots of the languages are the leaves of one more tree.
    tops = reduce(DataFrame.unionByName, [level.filter(WHOLE).select(F.lit("all").alias("tree"), F.col("tree").alias("name"), "digest") for level in levels])
    high = proofs(grow(ranked(tops, [F.col("name")], "merkle-tops"), "merkle-high"), "merkle-high")
    high = write_table(high.select(F.col("name").alias("tree"), F.col("top").alias("root"), F.col("steps").alias("high_steps")), "merkle-high")
    found = proofs(levels, "merkle").join(high, "tree")
    lang = F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30))
    return found.select("doc_id", lang.alias("lang"), F.col("digest").alias("leaf"), F.col("changed").alias("changed_leaf"), F.col("top").alias("subroot"), "root", F.concat("steps", "high_steps").alias("steps"))


def verify(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs``, checked against a copy in which every third text was lower-cased.

    Texts with ``crc32(doc_id) mod 3 = 0`` have A-Z lower-cased in the copy; a null
    text or doc_id leaves a row as it is. ``verified`` tells whether the copy's leaf and
    the manifest's siblings give the manifest's root.
    """
    text = F.col("text").cast("string")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    made = manifest(docs, F.when(hit, F.translate(text, UPPER, LOWER)))
    folded = fold(F.coalesce("changed_leaf", "leaf"), F.col("steps"))
    made = made.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), folded.alias("folded_root"))
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(levels: int = 8, lang_levels: int = 3) -> str:
    """The same in DuckDB SQL for up to 8^levels documents of a language and 8^lang_levels languages."""
    # The checksum by its rule: eight shifts for each of the 256 table entries, then one step a byte.
    bit = "(CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END)"
    steps = ", ".join(f"t{k + 1} AS (SELECT i, {bit.format('c')} AS c FROM t{k})" for k in range(8))
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k, 1))::BIGINT)), lambda a, b: xor(a >> 8, (SELECT list(c ORDER BY i) FROM t8)[(xor(a, b) & 255) + 1])), 4294967295)"
    crc = crc.replace("(SELECT list(c ORDER BY i) FROM t8)", "(codes)")

    def digest(text: str) -> str:
        fields = [text if f == "text" else f for f in FIELDS]
        return "sha256(" + " || ".join(f"coalesce(strlen({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')" for f in fields) + ")"

    lowered = f"translate(text, '{UPPER}', '{LOWER}')"
    sql = [
        "t0 AS (SELECT i, i::BIGINT AS c FROM range(256) AS r(i))", steps, "codes AS (SELECT list(c ORDER BY i) AS codes FROM t8)",
        f"base AS (SELECT doc_id, lang, {digest('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {digest(lowered)} ELSE {digest('text')} END AS changed FROM documents, codes)",
        "ranks AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM base)",
        "a0 AS (SELECT lang AS g, r, n, leaf AS d FROM ranks)",
    ]

    def climb(p: str, depth: int) -> None:
        for k in range(1, depth + 1):
            sql.append(f"{p}{k} AS (SELECT g, r // 8 AS r, (n + 7) // 8 AS n, sha256(string_agg(d, '' ORDER BY r)) AS d FROM {p}{k - 1} WHERE n > 1 GROUP BY g, r // 8, n)")
        sql.append(f"{p}top AS (" + " UNION ALL ".join(f"SELECT g, d FROM {p}{k} WHERE n = 1" for k in range(depth + 1)) + ")")
        for k in range(depth):
            sql.append(f"{p}s{k} AS (SELECT x.g, x.r, coalesce(string_agg(y.d, '' ORDER BY y.r) FILTER (y.r < x.r), '') AS b, coalesce(string_agg(y.d, '' ORDER BY y.r) FILTER (y.r > x.r), '') AS f FROM {p}{k} x JOIN {p}{k} y ON x.g IS NOT DISTINCT FROM y.g AND x.r // 8 = y.r // 8 WHERE x.n > 1 GROUP BY x.g, x.r)")

    climb("a", levels)
    sql.append("b0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS r, count(*) OVER () AS n, d FROM atop)")
    sql.append("places AS (SELECT g AS lang, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS r, d AS subroot FROM atop)")
    climb("b", lang_levels)
    sql.append("f0 AS (SELECT ranks.*, '' AS proof, changed AS c FROM ranks)")
    last = "f0"
    for k in range(levels):
        sql.append(f"f{k + 1} AS (SELECT f.* EXCLUDE (proof, c), proof || coalesce(s.b || s.f, '') AS proof, CASE WHEN s.b IS NULL THEN c ELSE sha256(s.b || c || s.f) END AS c FROM {last} f LEFT JOIN as{k} s ON s.g IS NOT DISTINCT FROM f.lang AND s.r = f.r // {8**k})")
        last = f"f{k + 1}"
    sql.append(f"h0 AS (SELECT f.doc_id, f.leaf, p.subroot, p.r AS lr, f.proof, f.c FROM {last} f JOIN places p ON p.lang IS NOT DISTINCT FROM f.lang)")
    last = "h0"
    for k in range(lang_levels):
        sql.append(f"h{k + 1} AS (SELECT f.* EXCLUDE (proof, c), proof || coalesce(s.b || s.f, '') AS proof, CASE WHEN s.b IS NULL THEN c ELSE sha256(s.b || c || s.f) END AS c FROM {last} f LEFT JOIN bs{k} s ON s.r = f.lr // {8**k})")
        last = f"h{k + 1}"
    # Each step stands on its own: inlined, the chain of steps would be planned over and over.
    parts = [p if p.startswith("t1 ") else p.replace(" AS (", " AS MATERIALIZED (", 1) for p in sql]
    return "WITH " + ", ".join(parts) + f" SELECT doc_id, leaf, subroot, btop.d AS root, sha256(proof) AS proof_sha256, c AS folded_root, c = btop.d AS verified FROM {last}, btop"
