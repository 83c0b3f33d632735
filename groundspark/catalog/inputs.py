"""Evidence tables derived by Spark from the given Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundspark.functions.text import sha256_hex, split_sentences
from groundspark.plans.retrieval import build_index
from groundspark.runtime import skew_join, spread_input, write_table

STUDIES_PER_PAGE = 200
STUDIES_PER_LARGE_PAGE = 5_000
FIRST_BATCH, SECOND_BATCH = "2024-01-01 00:00:00", "2024-02-01 00:00:00"
_indexes: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def is_trial(doc_id: Column) -> Column:
    return doc_id % 2 == 0


def nct_of(number: Column) -> Column:
    return F.concat(F.lit("NCT"), F.lpad(number.cast("string"), 8, "0"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Even documents are registry trials, odd ones publications."""
    key = F.col("doc_id")
    identifier = F.when(is_trial(key), nct_of(key)).otherwise(key.cast("string"))
    return table(spark, folder, "documents").select(
        key.alias("document_id"),
        F.when(is_trial(key), "trial").otherwise("publication").alias("source_type"),
        identifier.alias("source_identifier"),
        F.concat(F.lit("https://example.org/"), identifier).alias("source_url"),
        F.concat_ws(" ", "lang", "source", "n_chars").alias("title"),
        "text",
        sha256_hex(F.concat(identifier, F.lit(":"), F.col("text"))).alias("content_hash"),
    )


def questions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def index(spark: SparkSession, folder: str, config: str = "simple") -> DataFrame:
    """The chunk table with vectors and lexemes, written once per session and folder."""
    key = (spark.sparkContext.applicationId, folder, config)
    if key not in _indexes:
        source = spread_input(documents(spark, folder).select("document_id", "text"), "document_id")
        _indexes[key] = write_table(build_index(source, config=config), "index")
    return _indexes[key]


def question_truth(spark: SparkSession, folder: str) -> DataFrame:
    """(id, source_identifier): documents sharing a sentence of 40 or more characters."""

    def long_sentences(rows: DataFrame, key: str) -> DataFrame:
        sentences = F.filter(split_sentences(F.col("text")), lambda s: F.char_length(s) >= 40)
        return rows.select(key, F.explode(F.array_distinct(sentences)).alias("sentence"))

    told = long_sentences(spread_input(documents(spark, folder), "document_id"), "source_identifier")
    asked = long_sentences(questions(spark, folder), "query_id")
    shared = skew_join(told, asked, "sentence", "inner", ["source_identifier"])
    return shared.select(F.col("query_id").alias("id"), "source_identifier").distinct()


def labelled_questions(spark: SparkSession, folder: str, truth: DataFrame) -> DataFrame:
    """(id, question, expect_answerable): benchmark items, answerable when they have truth."""
    has_truth = truth.select("id").distinct().withColumn("_true", F.lit(True))
    asked = questions(spark, folder).select(F.col("query_id").alias("id"), F.col("text").alias("question"))
    return asked.join(has_truth, "id", "left").select("id", "question", F.col("_true").isNotNull().alias("expect_answerable"))


def raw_date(number: Column) -> Column:
    """Full, partial, blank and impossible dates in turn."""
    year = (2000 + number % 25).cast("string")
    month, day = F.lpad((1 + number % 12).cast("string"), 2, "0"), (1 + number % 28).cast("string")
    return (
        F.when(number % 6 == 0, year)
        .when(number % 6 == 1, F.concat_ws("-", year, month))
        .when(number % 6 == 2, F.concat_ws("-", year, month, day))
        .when(number % 6 == 3, "")
        .when(number % 6 == 4, F.concat_ws("-", year, F.lit("02"), F.lit("30")))
        .otherwise(F.concat_ws("-", year, month, day, F.lit("9")))
    )


def raw_studies(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, raw): one registry study as JSON text per even document."""
    key = F.col("doc_id")

    def dated(shift: int) -> Column:
        return F.struct(raw_date(key + shift).alias("date"))

    phases = F.when(key % 4 == 0, F.array(F.lit("PHASE1"), F.lit("PHASE2"))).when(key % 3 == 0, F.array(F.lit("PHASE3")))
    interventions = F.array(
        F.struct(F.lit("DRUG").alias("type"), F.col("lang").alias("name")),
        F.struct(F.lit("DRUG").alias("type"), F.when(key % 3 == 0, F.lit("Placebo")).otherwise(F.lit("")).alias("name")),
    )
    protocol = F.struct(
        F.struct(
            F.when(key % 50 != 0, nct_of(key)).alias("nctId"),
            F.concat_ws(" ", "lang", "source").alias("briefTitle"),
            F.when(key % 3 != 0, F.col("source")).alias("officialTitle"),
        ).alias("identificationModule"),
        F.struct(
            F.when(key % 7 != 0, F.when(key % 3 == 0, "COMPLETED").otherwise("RECRUITING")).alias("overallStatus"),
            dated(0).alias("startDateStruct"),
            dated(1).alias("primaryCompletionDateStruct"),
            dated(2).alias("completionDateStruct"),
            F.when(key % 8 != 0, dated(3)).alias("lastUpdatePostDateStruct"),
        ).alias("statusModule"),
        F.struct(
            F.lit("INTERVENTIONAL").alias("studyType"),
            phases.alias("phases"),
            F.struct(F.col("n_chars").alias("count")).alias("enrollmentInfo"),
        ).alias("designModule"),
        F.struct(F.array("source", F.lit("general")).alias("conditions")).alias("conditionsModule"),
        F.when(key % 10 != 0, F.struct(interventions.alias("interventions"))).alias("armsInterventionsModule"),
        F.struct(F.struct(F.col("source").alias("name")).alias("leadSponsor")).alias("sponsorCollaboratorsModule"),
        F.struct(
            F.when(key % 6 != 0, F.concat(F.lit("Summary of "), nct_of(key))).alias("briefSummary"),
            F.col("text").alias("detailedDescription"),
        ).alias("descriptionModule"),
        F.struct(
            F.array(F.struct(F.col("lang").alias("measure"), F.lit("12 weeks").alias("timeFrame"))).alias("primaryOutcomes")
        ).alias("outcomesModule"),
    )
    study = F.to_json(F.struct(protocol.alias("protocolSection")))
    source = spread_input(table(spark, folder, "documents"), "doc_id")
    return source.filter(is_trial(key)).select("doc_id", study.alias("raw"))


def parsed_studies(spark: SparkSession, folder: str) -> DataFrame:
    """(seq, study) in document order."""
    return raw_studies(spark, folder).select(F.col("doc_id").alias("seq"), F.parse_json("raw").alias("study"))


def clean_xml(text: Column) -> Column:
    """Text without control characters, with the three special characters escaped."""
    plain = F.regexp_replace(text, r"[\x00-\x08\x0b-\x1f]", "")
    return F.replace(F.replace(F.replace(plain, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def raw_articles(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, pmid, article_xml): one article as XML text per odd document."""
    key = F.col("doc_id")

    def tag(name: str, value: Column, attributes: str = "") -> Column:
        return F.coalesce(F.concat(F.lit(f"<{name}{attributes}>"), value, F.lit(f"</{name}>")), F.lit(""))

    year, day = (1990 + key % 30).cast("string"), (1 + key % 31).cast("string")
    months = F.array(*[F.lit(m) for m in ("Jan", "february", "03", "Apr", "17", "Spring", "jul")])
    month = F.get(months, (key % 7).cast("int"))
    article_date = F.when(key % 3 == 0, tag("ArticleDate", F.concat(tag("Year", year), tag("Month", F.lit("2")), tag("Day", day))))
    issue = F.when(key % 5 == 0, tag("MedlineDate", F.concat(year, F.lit(" Jan-Feb")))).otherwise(
        F.concat(tag("Year", year), tag("Month", month), tag("Day", F.when(key % 4 == 1, day)))
    )
    authors = F.concat(
        tag("Author", F.concat(tag("LastName", F.col("source")), tag("Initials", F.when(key % 3 != 0, F.upper("lang"))))),
        F.when(key % 9 == 0, tag("Author", tag("CollectiveName", F.lit("Group A")))).otherwise(F.lit("")),
        tag("Author", tag("Initials", F.lit("X"))),
    )
    abstract = F.when(
        key % 11 != 0,
        F.concat(
            tag("AbstractText", F.concat(F.lit(" <i>Aim</i> of "), key.cast("string"), F.lit(" ")), ' Label="AIM"'),
            tag("AbstractText", F.lit("  ")),
            tag("AbstractText", clean_xml(F.col("text"))),
        ),
    )
    accessions = F.when(
        key % 4 == 1,
        tag("DataBank", tag("AccessionNumberList", F.concat(tag("AccessionNumber", F.lower(nct_of(key - 1))), tag("AccessionNumber", F.lit("GSE1"))))),
    )
    secondary = F.when(key % 6 == 1, tag("SecondarySourceId", F.concat(F.lit("reg/"), nct_of(key + 1))))
    body = F.concat(
        F.lit("<PubmedArticle><MedlineCitation>"),
        tag("PMID", key.cast("string"), ' Version="1"'),
        F.lit("<Article>"),
        tag("Journal", F.concat(tag("JournalIssue", tag("PubDate", issue)), tag("Title", F.concat(F.lit(" Journal "), F.col("lang"))))),
        F.coalesce(article_date, F.lit("")),
        tag("ArticleTitle", F.concat(F.lit("On "), F.col("source"), F.lit(" <b>bold</b> rest"))),
        tag("Abstract", abstract),
        tag("AuthorList", authors),
        tag("DataBankList", accessions),
        F.lit("</Article>"),
        tag("MeshHeadingList", F.concat(tag("MeshHeading", tag("DescriptorName", F.concat(F.lit(" "), F.col("lang")))), tag("MeshHeading", tag("DescriptorName", F.lit(""))))),
        F.coalesce(secondary, F.lit("")),
        F.lit("</MedlineCitation><PubmedData><ArticleIdList>"),
        tag("ArticleId", key.cast("string"), ' IdType="pubmed"'),
        F.coalesce(F.when(key % 3 != 1, tag("ArticleId", F.concat(F.lit(" 10.1/"), key.cast("string")), ' IdType="doi"')), F.lit("")),
        F.lit("</ArticleIdList></PubmedData></PubmedArticle>"),
    )
    source = spread_input(table(spark, folder, "documents"), "doc_id")
    return source.filter(~is_trial(key)).select(
        "doc_id", key.cast("string").alias("pmid"), body.alias("article_xml")
    )


def numbered_articles(spark: SparkSession, folder: str) -> DataFrame:
    return raw_articles(spark, folder).select(F.col("doc_id").alias("seq"), "pmid", "article_xml")


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """Assistant turns as raw answers with markers, some damaged: (query_id, query, n_evidence, text)."""
    number = (1 + F.col("turn") % 3).cast("string")
    marker = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" ["), number, F.lit(", 1]"))).otherwise(F.concat(F.lit(" ["), number, F.lit("]")))
    cited = F.regexp_replace(F.col("text"), F.lit(r"([.!?])(\s|\z)"), F.concat(marker, F.lit("$1$2")))
    damaged = (
        F.when(F.col("conv_id") % 7 == 0, F.lit(" NOT_ENOUGH_EVIDENCE\n"))
        .when(F.col("conv_id") % 3 == 0, F.concat(cited, F.lit(" Also see the second [0] and the late source [42].")))
        .when(F.col("conv_id") % 5 == 0, F.concat(cited, F.lit(" This closing statement carries no marker.")))
        .otherwise(cited)
    )
    return table(spark, folder, "conversations").filter(F.col("role") == "assistant").select(
        "conv_id",
        "turn",
        F.concat_ws(":", "conv_id", "turn").alias("query_id"),
        F.col("text").alias("query"),
        F.least("turn", F.lit(8)).cast("bigint").alias("n_evidence"),
        damaged.alias("text"),
    )


def turn_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """The up to eight turns before each assistant turn, nearest first, as its evidence."""
    turns = table(spark, folder, "conversations")
    asked = turns.filter(F.col("role") == "assistant").select(
        "conv_id", F.concat_ws(":", "conv_id", "turn").alias("query_id"), "turn", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("rank")
    ).withColumn("turn", F.col("turn") - F.col("rank"))
    number = F.col("conv_id") * 10 + F.col("turn")
    return asked.join(turns, ["conv_id", "turn"]).select(
        "query_id",
        "rank",
        F.col("conv_id").alias("document_id"),
        F.col("turn").cast("int").alias("chunk_index"),
        F.when(F.col("role") == "user", "trial").otherwise("publication").alias("source_type"),
        F.when(F.col("role") == "user", nct_of(number)).otherwise(number.cast("string")).alias("source_identifier"),
        F.concat(F.lit("https://example.org/"), number.cast("string")).alias("source_url"),
        F.col("role").alias("title"),
        F.col("text").alias("excerpt"),
    )


def trial_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's number with the next trial's; odd numbers name no trial."""
    key = F.col("doc_id")
    return table(spark, folder, "documents").select(
        key.alias("pair_id"),
        nct_of(key).alias("nct_a"),
        nct_of(key + F.when(key % 3 == 0, 1).otherwise(2)).alias("nct_b"),
        F.when(key % 4 == 0, F.concat(F.lit("Compare dosing in "), F.col("lang"))).alias("question"),
    )
