"""Secret scans: candidates by pattern, false positives removed by a random forest.

A candidate is a run of 20 or more characters that keys are made of. Its features are
its length, its character transitions (between kinds of characters, and how much
likelier its letter pairs are in secrets than in other findings), the share of it
that frequent words of the corpus cover, the path it was found at, and the words
around it. The forest is trained on labelled findings. All of it is DataFrame work
in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundspark.llm.langid import fold
from groundspark.llm.sampling import hash_sample
from groundspark.runtime import write_table

CANDIDATE = r"[A-Za-z0-9_+/=\-]{20,}"
# Words that name a secret, and words that name a stand-in; fixed values.
NAMES = "token|key|secret|passw|pwd|auth|bearer|credential|api"
STAND_INS = "example|sample|dummy|test|placeholder|your|xxx"
DICTIONARY_WORDS = 300
# The documented bound of labelled findings the forest is trained on, of either kind.
SAMPLE_FINDINGS = 4_000
TREES, DEPTH = 20, 6
FEATURES = ["length", "kinds", "kind_changes", "digits", "pairs", "coverage", "path_odds", "named", "assigned", "quoted", "stand_in", "before_odds"]


def findings(docs: DataFrame, text: str = "text", path: str = "source") -> DataFrame:
    """Candidates with what stands around them: doc_id, word_no, part, path, candidate, before, before2, after, lead.

    ``lead`` is what precedes the candidate inside its word. A null or empty text has none.
    """
    body = F.split(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n\t\r", "   "), " ")
    words = docs.filter(F.col(text).rlike(CANDIDATE)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(path).cast("string").alias("path"), body.alias("_words"))
    at = F.filter(F.transform("_words", lambda w, i: F.when((F.length(w) >= 20) & w.rlike(CANDIDATE), i)), lambda i: i.isNotNull())
    found = words.withColumn("word_no", F.explode(at))
    near = lambda k: F.lower(F.coalesce(F.get("_words", F.col("word_no") + k), F.lit("")))
    word = F.get("_words", F.col("word_no"))
    found = found.select("doc_id", "path", "word_no", word.alias("_word"), near(-1).alias("before"), near(-2).alias("before2"), near(1).alias("after"))
    parts = found.select("*", F.posexplode(F.regexp_extract_all("_word", F.lit(f"({CANDIDATE})"), 1)).alias("part", "candidate"))
    return parts.select("doc_id", "word_no", "part", "path", "candidate", "before", "before2", "after", F.expr("substring_index(_word, candidate, 1)").alias("lead"))


def assigned(column: str = "lead") -> Column:
    """Whether the candidate is given to a name: ``name = "..."`` or ``name:...``."""
    return F.concat_ws(" ", "before2", "before", F.lower(column)).rlike(rf"({NAMES})\w*[\"']?\s*[:=]\s*[\"']?$")


def frequent_words(docs: DataFrame, count: int = DICTIONARY_WORDS) -> DataFrame:
    """The most frequent words of three letters or more over all documents, lower-cased."""
    words = docs.select(F.explode(F.split(F.translate(F.lower("text"), "\n\t.,;:!?|", "  "), " ")).alias("word"))
    words = words.filter(F.length("word").between(3, 12) & F.col("word").rlike("^[a-z]+$"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "word").limit(count)


def odds(labelled: DataFrame, column: str) -> DataFrame:
    """Smoothed log-odds of secrets by the value of a column: at most as many rows as the bounded sample."""
    of = labelled.groupBy(F.col(column).alias("value")).agg(F.sum("label").alias("y"), F.count("*").alias("n"))
    return of.select("value", F.log((F.col("y") + 0.5) / (F.col("n") - F.col("y") + 0.5)).alias("odds"))


def letter_pairs(column: Column) -> Column:
    """Neighbouring letters and digits of a candidate, lower-cased, all digits as 0."""
    plain = F.regexp_replace(F.lower(column), "[0-9]", "0")
    return F.transform(F.sequence(F.lit(1), F.length(plain) - 1), lambda i: F.substr(plain, i, F.lit(2)))


@dataclass
class Scanner:
    forest: Model
    dictionary: str
    pairs: DataFrame
    paths: DataFrame
    before: DataFrame


def mapped(rows: DataFrame, odds_of: DataFrame) -> Column:
    """The odds as one map literal; its source is bounded by the training sample."""
    values = {r["value"]: r["odds"] for r in odds_of.collect() if r["value"] is not None}
    if not values:
        return F.create_map(F.lit(""), F.lit(0.0))
    return F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*map(F.lit, values.values())))


def featured(rows: DataFrame, dictionary: str, pairs: DataFrame, paths: DataFrame, before: DataFrame) -> DataFrame:
    """``rows`` (findings) with FEATURES. Odds are joined as small broadcast tables bounded by the training sample."""
    c = F.col("candidate")
    changes = F.regexp_count(c, F.lit(r"[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])|[_+/=\-](?=[A-Za-z0-9])"))
    kinds = sum(c.rlike(k).cast("int") for k in ("[a-z]", "[A-Z]", "[0-9]", r"[_+/=\-]"))
    around = F.concat_ws(" ", "before2", "before", F.lower("lead"))
    rows = rows.select(
        "*", F.length(c).cast("double").alias("length"), kinds.cast("double").alias("kinds"), (changes / F.length(c)).alias("kind_changes"),
        (F.regexp_count(c, F.lit("[0-9]")) / F.length(c)).alias("digits"),
        (1 - F.length(F.regexp_replace(F.lower(c), dictionary, "")) / F.length(c)).alias("coverage"),
        around.rlike(NAMES).cast("double").alias("named"), F.concat("before", "lead").rlike("[:=]").cast("double").alias("assigned"),
        F.col("lead").rlike("[\"'`]$").cast("double").alias("quoted"), F.concat_ws(" ", around, F.lower(c), "after").rlike(STAND_INS).cast("double").alias("stand_in"),
    )
    table = mapped(rows, pairs)
    mean = F.aggregate(letter_pairs(c), F.lit(0.0), lambda total, pair: total + F.coalesce(F.try_element_at(table, pair), F.lit(0.0))) / F.greatest(F.length(c) - 1, F.lit(1))
    rows = rows.withColumn("pairs", mean)
    for name, key, of in (("path_odds", "path", paths), ("before_odds", "before", before)):
        rows = rows.join(F.broadcast(of.select(F.col("value").alias(key), F.col("odds").alias(name))), key, "left").fillna(0.0, [name])
    return rows


def train(docs: DataFrame, labelled: DataFrame) -> Scanner | None:
    """A scanner trained on ``labelled`` findings (``findings`` columns and label 0/1); None unless both labels occur."""
    kinds = [hash_sample(labelled.filter(F.col("label") == k), ["doc_id", "word_no", "part", "candidate"], SAMPLE_FINDINGS) for k in (0, 1)]
    sample = write_table(kinds[0].union(kinds[1]), "labelled-findings")
    if sample.select("label").distinct().count() < 2:
        return None
    words = [r["word"] for r in frequent_words(docs).collect()]
    dictionary = "|".join(sorted(words, key=lambda w: (-len(w), w))) or "$^"
    pairs = sample.select("label", F.explode(letter_pairs(F.col("candidate"))).alias("pair"))
    both = [write_table(o, "odds") for o in (odds(pairs, "pair"), odds(sample, "path"), odds(sample, "before"))]
    rows = featured(sample, dictionary, *both)
    made = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=5).fit(made.select(F.col("label").cast("double"), "features"))
    return Scanner(forest, dictionary, *both)


def scan(candidates: DataFrame, scanner: Scanner | None) -> DataFrame:
    """``candidates`` with probability and is_secret; without a scanner every candidate stays, at 0.5."""
    if scanner is None:
        return candidates.withColumn("probability", F.lit(0.5)).withColumn("is_secret", F.lit(True))
    rows = featured(candidates, scanner.dictionary, scanner.pairs, scanner.paths, scanner.before)
    scored = scanner.forest.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))
    return scored.withColumn("probability", vector_to_array("probability")[1]).select(*candidates.columns, "probability", (F.col("probability") >= 0.5).alias("is_secret"))


def scan_documents(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """All findings of ``docs`` (doc_id, text, source) with the forest's verdict.

    Without ``labelled`` findings, those of the folds other than 2 are labelled by
    whether they are assigned to a name and no stand-in is near. Null and empty texts
    have no findings, a null path is a path of its own without odds, repeated rows
    repeat their findings, and an empty table gives none.
    """
    found = write_table(findings(docs), "findings")
    if labelled is None:
        near = F.concat_ws(" ", "before2", "before", F.lower("candidate"), "after")
        labelled = found.filter(fold() != 2).withColumn("label", (assigned() & ~near.rlike(STAND_INS)).cast("int"))
    return scan(found, train(docs, labelled))
