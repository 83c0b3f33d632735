"""Mixing sources by temperature: shares raised to an exponent, realised as block permutations.

Source weights are token shares to the power of an exponent between 0 (all alike)
and 1 (as they are). The exponent is bisected to the smallest that keeps a limit on
repetition, a target entropy, or both. Weights become budgets of tokens: by default
the smallest that give every source one whole epoch, so that no document is lost.

An epoch of a source is a permutation of its blocks with a permutation of documents
inside each; the last epoch ends at the budget. Blocks are hashed, so a source that
holds a third of all rows is spread over its blocks, and running sums go over blocks
of a source and over documents of a block, never over a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from groundspark.runtime import write_table

LEVELS_PER_JOB = 6
LEVELS = 30
# A source has as many blocks as these tokens go into it, 2^16 at most.
BLOCK_TOKENS = 1_000_000
MAX_BLOCKS = 1 << 16


def words(text: str = "text") -> Column:
    """Tokens of a text: runs of anything but white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def draw(*parts: Column) -> Column:
    """A number below 2^32 that depends on the parts alone."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("long")


def choose_exponent(totals: DataFrame, max_repeats: float | None, target_entropy: float | None, budget: int | None = None) -> float:
    """Bisect on [0, 1] for the smallest exponent whose mixture meets the limits.

    One job evaluates every exponent that the next levels of bisection could ask for.
    Entropy is in nats and met from above. With no limit, or no tokens, the exponent is 1.
    """
    everything = totals.agg(F.sum("tokens").alias("n")).first()["n"]
    if not everything or (max_repeats is None and target_entropy is None):
        return 1.0
    share = totals.filter("tokens > 0").select((F.col("tokens") / F.lit(everything)).alias("p"))

    def evaluate(exponents: list[float]) -> dict[float, bool]:
        at = share.withColumn("a", F.explode(F.array(*map(F.lit, exponents)))).groupBy("a").agg(
            F.max(F.pow("p", F.col("a") - 1)).alias("most"), F.max(F.pow("p", 1 - F.col("a"))).alias("least"),
            F.sum(F.pow("p", "a")).alias("z"), F.sum(F.pow("p", "a") * F.log("p")).alias("zl"),
        )
        met = {}
        for r in at.collect():  # one row per exponent
            repeats = r["most"] * r["least"] if budget is None else r["most"] / r["z"] * budget / everything
            entropy = _entropy(r["z"], r["zl"], r["a"])
            met[r["a"]] = (max_repeats is None or repeats <= max_repeats) and (target_entropy is None or entropy <= target_entropy)
        return met

    if evaluate([0.0])[0.0]:
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(LEVELS // LEVELS_PER_JOB):
        parts = 1 << LEVELS_PER_JOB
        met = evaluate([low + (high - low) * k / parts for k in range(1, parts)])
        for _ in range(LEVELS_PER_JOB):
            middle = (low + high) / 2
            low, high = (low, middle) if met[middle] else (middle, high)
    return high


def _entropy(z: float, zl: float, exponent: float) -> float:
    from math import log

    return log(z) - exponent * zl / z


def schedule(docs: DataFrame, max_repeats: float | None = 2.0, target_entropy: float | None = None, budget: int | None = None, seed: int = 0) -> DataFrame:
    """Every use of every document: doc_key, text_md5, doc_id, source, tokens, epoch, place.

    ``place`` is the first token's place in the source's budget in parts of 10^9;
    sorting by it interleaves the sources at their weights. A null source is the
    source ''; documents without tokens are used once an epoch like others; a null
    id sorts last; repeated rows are used each; an empty table gives no rows. With a
    ``budget`` in tokens, sources may get less than an epoch.
    """
    rows = docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), words().alias("tokens"),
        F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_md5"),
    )
    rows = write_table(rows.withColumn("doc_key", F.coalesce("doc_id", F.lit((1 << 63) - 1))), "sized")
    totals = write_table(rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")), "source-totals")
    exponent = choose_exponent(totals, max_repeats, target_entropy, budget)
    numbers = totals.agg(F.sum("tokens").alias("all"), F.max("tokens").alias("most")).first()
    everything, most = numbers["all"] or 0, numbers["most"] or 0
    size = F.greatest("tokens", F.lit(1)).cast("double")
    if budget is None:
        repeats = F.pow(F.lit(float(max(most, 1))) / size, F.lit(1 - exponent))
    else:
        z = totals.filter("tokens > 0").agg(F.sum(F.pow(F.col("tokens") / F.lit(max(everything, 1)), F.lit(exponent))).alias("z")).first()["z"] or 1.0
        repeats = F.pow(size / F.lit(max(everything, 1)), F.lit(exponent)) / F.lit(z) * F.lit(budget) / size
    plan = totals.select(
        "source", F.col("tokens").alias("source_tokens"), F.when(F.col("tokens") > 0, F.floor(F.col("tokens") * repeats + 0.5)).otherwise(0).cast("long").alias("budget"),
        F.least(F.lit(MAX_BLOCKS), F.greatest(F.lit(1), F.ceil(F.col("tokens") / BLOCK_TOKENS))).cast("long").alias("blocks"),
    )
    epochs = F.when(F.col("source_tokens") > 0, F.ceil(F.col("budget") / F.col("source_tokens"))).otherwise(1).cast("int")
    plan = plan.withColumn("epochs", F.greatest(epochs, F.lit(1) if budget is None else F.lit(0)))
    block = F.pmod(draw(F.lit(f"block{seed}"), F.col("doc_key").cast("string")), F.col("blocks"))
    spread = rows.join(plan, "source").withColumn("block", block)
    every = F.explode(F.expr("sequence(0, epochs - 1)"))
    # Running sums over the blocks of a source, then over the documents of a block.
    by_block = spread.groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens"), F.first("epochs").alias("epochs")).filter("epochs > 0")
    by_block = by_block.withColumn("epoch", every).withColumn("_turn", draw(F.lit(f"turn{seed}"), F.col("source"), F.col("epoch").cast("string"), F.col("block").cast("string")))
    earlier = Window.partitionBy("source", "epoch").orderBy("_turn", "block").rowsBetween(Window.unboundedPreceding, -1)
    by_block = by_block.select("source", "block", "epoch", F.coalesce(F.sum("block_tokens").over(earlier), F.lit(0)).alias("block_start"))
    uses = spread.filter("epochs > 0").withColumn("epoch", every)
    uses = uses.withColumn("_turn", draw(F.lit(f"doc{seed}"), F.col("epoch").cast("string"), F.col("doc_key").cast("string")))
    inside = Window.partitionBy("source", "block", "epoch").orderBy("_turn", "doc_key", "text_md5").rowsBetween(Window.unboundedPreceding, -1)
    uses = uses.withColumn("_inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(by_block, ["source", "block", "epoch"])
    start = F.col("epoch") * F.col("source_tokens") + F.col("block_start") + F.col("_inside")
    whole = (F.col("epoch") == 0) if budget is None else F.lit(False)
    uses = uses.withColumn("_start", start).filter(whole | (F.col("_start") < F.col("budget")))
    place = F.when(F.col("budget") > 0, F.floor(F.col("_start").cast("decimal(20,0)") * 1_000_000_000 / F.col("budget"))).otherwise(0).cast("long")
    return uses.select("doc_key", "text_md5", "doc_id", "source", "tokens", "epoch", place.alias("place"))


# Extra copies of one row that one task writes.
COPIES = 1_000


def mix(docs: DataFrame, **limits) -> DataFrame:
    """``docs`` with every row as often as its schedule uses it; only slim rows are scheduled.

    Rows of one id, source and text share their uses: each has the whole part of its
    share, and what remains goes to the first by a hash of all their columns. Rows that
    are equal in every column are counted, not numbered, so any number of them may be
    equal. A null id, source or text is a value of its own; an empty table stays empty.
    """
    key = ["_key", "source", "text_md5"]
    uses = schedule(docs, **limits).withColumnRenamed("doc_key", "_key").groupBy(*key).agg(F.count("*").alias("_uses"))
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("_key"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_md5"), F.xxhash64(*docs.columns).alias("_row"), F.struct("*").alias("row"),
    )
    # Slim rows: one for each distinct content, with how many rows have it.
    contents = rows.groupBy(*key, "_row").agg(F.count("*").alias("_same"))
    every = Window.partitionBy(*key)
    before = F.coalesce(F.sum("_same").over(every.orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    contents = contents.withColumn("_all", F.sum("_same").over(every)).withColumn("_before", before).join(uses, key)
    left = F.pmod(F.col("_uses"), F.col("_all")) - F.col("_before")
    extra = F.greatest(F.lit(0), F.least(left, F.col("_same")))
    contents = contents.select(*key, "_row", F.floor(F.col("_uses") / F.col("_all")).alias("_copies"), extra.alias("_extra"), "_same")
    found = rows.join(contents, [*key, "_row"])
    # All rows of a content get one more, or none do; else the extra ones are copies of one of them.
    alike = F.col("_extra").isin(0) | (F.col("_extra") == F.col("_same"))
    copies = F.col("_copies") + F.when(F.col("_extra") == F.col("_same"), 1).otherwise(0)
    out = found.withColumn("_times", copies.cast("int")).filter("_times > 0").select("row", F.explode(F.expr("sequence(1, _times)"))).select("row.*")
    some = contents.filter(~alike)
    if not some.isEmpty():
        one = found.filter(~alike).dropDuplicates([*key, "_row"])
        blocks = F.explode(F.expr(f"sequence(0, (_extra - 1) div {COPIES})"))
        spread = one.withColumn("_block", blocks).repartition("_row", "_block")
        times = F.least(F.lit(COPIES), F.col("_extra") - F.col("_block") * COPIES).cast("int")
        out = out.unionByName(spread.withColumn("_times", times).select("row", F.explode(F.expr("sequence(1, _times)"))).select("row.*"))
    return out


def oracle(max_repeats: float) -> str:
    """The schedule at a repetition limit as DuckDB SQL."""
    number = lambda text: f"('0x' || substr(md5({text}), 1, 8))::BIGINT"
    return f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '\\S+')), 0)::BIGINT AS tokens,
    md5(coalesce(text, '')) AS text_md5, coalesce(doc_id, 9223372036854775807) AS doc_key
  FROM documents),
totals AS (SELECT source, sum(tokens)::BIGINT AS tokens FROM sized GROUP BY source),
shares AS (SELECT tokens / (SELECT sum(tokens) FROM totals)::DOUBLE AS p FROM totals WHERE tokens > 0),
search AS (
  SELECT 0 AS step, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
  UNION ALL
  SELECT step + 1, CASE WHEN met THEN low ELSE (low + high) / 2 END, CASE WHEN met THEN (low + high) / 2 ELSE high END
  FROM (
    SELECT *, (SELECT max(pow(p, (low + high) / 2 - 1)) * max(pow(p, 1 - (low + high) / 2)) FROM shares) <= {max_repeats} AS met
    FROM search WHERE step < {LEVELS})),
exponent AS (SELECT CASE WHEN (SELECT max(pow(p, -1)) * max(p) FROM shares) <= {max_repeats} THEN 0 ELSE (SELECT high FROM search WHERE step = {LEVELS}) END AS a),
plan AS (
  SELECT source, tokens AS source_tokens,
    CASE WHEN tokens > 0 THEN floor(tokens * pow((SELECT max(tokens) FROM totals)::DOUBLE / greatest(tokens, 1), 1 - (SELECT a FROM exponent)) + 0.5)::BIGINT ELSE 0 END AS budget,
    least({MAX_BLOCKS}, greatest(1, ceil(tokens / {BLOCK_TOKENS}.0)))::BIGINT AS blocks
  FROM totals),
spread AS (
  SELECT s.*, source_tokens, budget, {number("'block0|' || doc_key")} % blocks AS block,
    CASE WHEN source_tokens > 0 THEN greatest(1, ceil(budget / source_tokens::DOUBLE))::INT ELSE 1 END AS epochs
  FROM sized s JOIN plan USING (source)),
block_sums AS (SELECT source, block, sum(tokens) AS block_tokens, unnest(range(any_value(epochs))) AS epoch FROM spread GROUP BY source, block),
block_starts AS (
  SELECT source, block, epoch, coalesce(sum(block_tokens) OVER (PARTITION BY source, epoch ORDER BY {number("'turn0|' || source || '|' || epoch || '|' || block")}, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block_start
  FROM block_sums),
uses AS (SELECT *, unnest(range(epochs)) AS epoch FROM spread),
placed AS (
  SELECT u.*, coalesce(sum(tokens) OVER (PARTITION BY source, block, epoch ORDER BY {number("'doc0|' || epoch || '|' || doc_key")}, doc_key, text_md5 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside
  FROM uses u),
begun AS (SELECT p.*, epoch * source_tokens + block_start + inside AS start FROM placed p JOIN block_starts USING (source, block, epoch))
SELECT doc_id, source, tokens, epoch::INT AS epoch, CASE WHEN budget > 0 THEN (start::HUGEINT * 1000000000 // budget)::BIGINT ELSE 0 END AS place
FROM begun WHERE epoch = 0 OR start < budget
"""
