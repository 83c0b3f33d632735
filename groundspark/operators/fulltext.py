"""Keyword search: chunks holding every lexeme of a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundspark.operators.chunking import CHUNK_KEY
from groundspark.operators.dense import best_per_query
from groundspark.runtime import BROADCAST_KEYS, rows_fit, skew_join, text_fits_broadcast, write_table

# Fixed value: weights are whole billionths, so that sums do not depend on order.
WEIGHT_UNIT = 1_000_000_000
# So many lexeme names are at most sent to the files as a filter.
MAX_PUSHED_LEXEMES = 10_000


def saturated_weight(tf: Column) -> Column:
    """1 + 1/4 + ... + 1/tf^2 in whole billionths."""
    shares = F.transform(F.sequence(F.lit(1), tf), lambda j: F.floor(F.lit(WEIGHT_UNIT) / (j * j)).cast("bigint"))
    return F.aggregate(shares, F.lit(0).cast("bigint"), lambda total, share: total + share)


def frequency_score(wanted: Column, lexemes: Column) -> Column:
    """Sum of the weights of all wanted lexemes: grows with frequency, saturates."""

    def weight(lexeme: Column) -> Column:
        return saturated_weight(F.size(F.filter(lexemes, lambda found: found == lexeme)))

    units = F.aggregate(F.transform(wanted, weight), F.lit(0).cast("bigint"), lambda total, w: total + w)
    return units / F.lit(float(WEIGHT_UNIT))


def rarest_lexemes(terms: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(query_id, lexeme): the least frequent lexeme of each question that knows all of its own."""
    return (
        terms.join(frequencies, "lexeme", "left")
        .groupBy("query_id")
        .agg(F.min(F.struct("n", "lexeme")).alias("least"), F.bool_and(F.col("n").isNotNull()).alias("all_known"))
        .filter("all_known")
        .select("query_id", F.col("least.lexeme").alias("lexeme"))
    )


def document_frequencies(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """(lexeme, n): in how many chunks each searched lexeme occurs."""
    held = chunks.select(F.explode(F.array_distinct("lexemes")).alias("lexeme"))
    return held.groupBy("lexeme").agg(F.count("*").alias("n")).join(terms.select("lexeme").distinct(), "lexeme", "left_semi")


def _wanted(queries: DataFrame) -> tuple[DataFrame, bool]:
    """Distinct lexemes per question, and whether they were measured as small.

    A large table is written out, as the search reads it several times.
    """
    wanted = queries.select("query_id", F.array_distinct("lexemes").alias("wanted")).filter(F.size("wanted") > 0)
    small = text_fits_broadcast(wanted.select(F.array_join("wanted", " ").alias("words")), "words")
    return (wanted if small else write_table(wanted, "wanted")), small


def fulltext_search(queries: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """(query_id, document_id, chunk_index, score, rank), best ``limit`` per question.

    ``queries`` has (query_id, lexemes); one without lexemes matches nothing.
    Candidates are the chunks holding a question's rarest lexeme, and only those
    are checked for the others, so frequent lexemes never multiply rows. A question
    table measured as small goes to the chunks, which are checked as they are read
    and do not move; a larger one is joined on the lexeme with frequent lexemes
    spread out.
    """
    wanted, small = _wanted(queries)
    if small:
        return _best_of_rows(wanted, chunks, limit)
    terms = wanted.select("query_id", F.explode("wanted").alias("lexeme"))
    drivers = rarest_lexemes(terms, document_frequencies(chunks, terms)).join(wanted, "query_id")
    slim = chunks.select(*CHUNK_KEY, F.explode(F.array_distinct("lexemes")).alias("lexeme"))
    candidates = skew_join(slim, drivers, "lexeme", "inner", CHUNK_KEY).join(chunks.select(*CHUNK_KEY, "lexemes"), CHUNK_KEY)
    hits = candidates.filter((F.size("wanted") == 1) | (F.size(F.array_except("wanted", "lexemes")) == 0))
    scored = hits.select("query_id", *CHUNK_KEY, frequency_score(F.col("wanted"), F.col("lexemes")).alias("score"))
    return best_per_query(scored, limit)


def _of_lexemes(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """``rows`` whose lexeme is in the few ``terms``; up to MAX_PUSHED_LEXEMES are looked up by name, without a join."""
    wanted = terms.select("lexeme").distinct()
    names = [row["lexeme"] for row in wanted.limit(MAX_PUSHED_LEXEMES + 1).collect()]
    return rows.filter(F.col("lexeme").isin(names)) if len(names) <= MAX_PUSHED_LEXEMES else rows.join(F.broadcast(wanted), "lexeme", "left_semi")


def _best_of_rows(wanted: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """Best hits of few questions (query_id, wanted) from the chunks, of which only lexemes of hits are shuffled.

    The only lexeme of a question is counted as it stands. For the others a chunk is checked
    where a question's rarest lexeme first occurs in it, and counted when it holds all.
    """
    every = wanted.withColumn("n_wanted", F.size("wanted"))
    alone, several = every.filter("n_wanted = 1").select("query_id", F.get("wanted", F.lit(0)).alias("lexeme")), every.filter("n_wanted > 1")
    hits = None
    if not alone.isEmpty():
        held = _of_lexemes(chunks.select(*CHUNK_KEY, F.explode("lexemes").alias("lexeme")), alone)
        counted = held.groupBy("lexeme", *CHUNK_KEY).agg(F.count("*").cast("int").alias("tf"))
        hits = counted.join(F.broadcast(alone), "lexeme").select("query_id", *CHUNK_KEY, saturated_weight(F.col("tf")).alias("units"))
    if hits is None or not several.isEmpty():
        terms = several.select("query_id", F.explode("wanted").alias("lexeme"))
        # Any measure of rarity will do: occurrences are counted, not chunks.
        occurrences = _of_lexemes(chunks.select(F.explode("lexemes").alias("lexeme")), terms).groupBy("lexeme").agg(F.count("*").alias("n"))
        drivers = write_table(rarest_lexemes(terms, occurrences).join(several, "query_id"), "rarest-lexemes")
        placed = chunks.select(*CHUNK_KEY, "lexemes", F.posexplode("lexemes").alias("place", "lexeme"))
        candidates = _of_lexemes(placed, drivers).join(F.broadcast(drivers), "lexeme").filter(F.array_position("lexemes", F.col("lexeme")) == F.col("place") + 1)
        found = candidates.filter(F.size(F.array_except("wanted", "lexemes")) == 0)
        words = found.select("query_id", *CHUNK_KEY, F.explode(F.filter("lexemes", lambda word: F.array_contains("wanted", word))).alias("word"))
        counted = words.groupBy("query_id", *CHUNK_KEY, "word").agg(F.count("*").cast("int").alias("tf"))
        both = counted.groupBy("query_id", *CHUNK_KEY).agg(F.sum(saturated_weight(F.col("tf"))).alias("units"))
        hits = both if hits is None else hits.unionByName(both)
    return _best_by_units(hits, limit)


def _best_by_units(hits: DataFrame, limit: int) -> DataFrame:
    return best_per_query(hits.select("query_id", *CHUNK_KEY, (F.col("units") / F.lit(float(WEIGHT_UNIT))).alias("score")), limit)


def fulltext_from_postings(queries: DataFrame, postings: DataFrame, limit: int) -> DataFrame:
    """The same hits from an inverted index of (lexeme, document_id, chunk_index, tf).

    Only postings of searched lexemes are read: with up to MAX_PUSHED_LEXEMES of
    them their names are pushed down to the files, which are clustered by lexeme.
    Candidates come from each question's rarest lexeme and then meet the postings
    of its other lexemes on the whole key; counted as few they are broadcast, so that
    the postings are not shuffled.
    """
    wanted, small = _wanted(queries)
    listed = wanted.select(F.explode("wanted").alias("lexeme")).distinct()
    names = [row["lexeme"] for row in listed.limit(MAX_PUSHED_LEXEMES + 1).collect()]
    slim = postings.select("lexeme", *CHUNK_KEY, "tf")
    if len(names) <= MAX_PUSHED_LEXEMES:
        searched = slim.filter(F.col("lexeme").isin(names))
    else:
        searched = slim.join(F.broadcast(listed), "lexeme", "left_semi") if small else slim
    return _best_of_postings(wanted, small, searched, limit)


def _best_of_postings(wanted: DataFrame, small: bool, searched: DataFrame, limit: int) -> DataFrame:
    """Best hits of questions (query_id, wanted) from the postings of their lexemes.

    A posting of a question's only lexeme is a hit as it stands; candidates are for the others.
    """
    every = wanted.select("query_id", F.explode("wanted").alias("lexeme"), F.size("wanted").alias("n_wanted"))
    alone, terms = every.filter("n_wanted = 1").select("query_id", "lexeme"), every.filter("n_wanted > 1")
    hits = None
    if not alone.isEmpty():
        found = searched.join(F.broadcast(alone), "lexeme") if small else skew_join(searched, alone, "lexeme", "inner", CHUNK_KEY)
        hits = found.select("query_id", *CHUNK_KEY, saturated_weight(F.col("tf")).alias("units"))
    if hits is None or not terms.isEmpty():
        several = _hits_of_several(terms, small, searched)
        hits = several if hits is None else hits.unionByName(several)
    return _best_by_units(hits, limit)


def _hits_of_several(terms: DataFrame, small: bool, searched: DataFrame) -> DataFrame:
    """(query_id, document_id, chunk_index, units) of the chunks holding all lexemes of a question."""
    frequencies = searched.groupBy("lexeme").agg(F.count("*").alias("n"))
    rarest = rarest_lexemes(terms, frequencies)
    found = searched.select("lexeme", *CHUNK_KEY)
    if small:
        candidates = found.join(F.broadcast(rarest), "lexeme").drop("lexeme").join(F.broadcast(terms), "query_id")
    else:
        candidates = skew_join(found, rarest, "lexeme", "inner", CHUNK_KEY).drop("lexeme")
        candidates = skew_join(candidates, terms, "query_id", "inner", CHUNK_KEY)
    candidates = write_table(candidates.select("query_id", *CHUNK_KEY, "lexeme", "n_wanted"), "candidates")
    return (
        searched.join(F.broadcast(candidates) if rows_fit(candidates, BROADCAST_KEYS) else candidates, ["lexeme", *CHUNK_KEY])
        .groupBy("query_id", *CHUNK_KEY)
        .agg(F.count("*").alias("n_found"), F.first("n_wanted").alias("n_wanted"), F.sum(saturated_weight(F.col("tf"))).alias("units"))
        .filter(F.col("n_found") == F.col("n_wanted"))
        .select("query_id", *CHUNK_KEY, "units")
    )
