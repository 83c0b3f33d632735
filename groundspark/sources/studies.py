"""Registry studies: landed JSON pages to typed trial rows."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundspark.functions.dates import parse_registry_date
from groundspark.functions.text import canonical_json, sha256_hex
from groundspark.sources.page_ranges import COMPRESSED, ranged_studies

SPACE = re.compile(r"[ \t\r\n]*")
STUDY_URL = "https://clinicaltrials.gov/study/"
OUTCOMES = "array<struct<measure:string,description:string,timeFrame:string>>"


ARRIVAL = ["page_number", "page_file", "position"]
CUT = "page_file string, position int, raw string, reason string"
# Pages of more bytes are read by ranges, in several tasks.
WHOLE_PAGE_BYTES = 64 << 20
# Studies that a task hands to Spark at once.
STUDIES_PER_BATCH = 1_000
CHARS_PER_BATCH = 4 << 20


class _Decoder(json.JSONDecoder):
    """Of a key that an object repeats the last value counts; ``repeats`` tells that one does."""

    def __init__(self) -> None:
        self.repeats = False
        super().__init__(object_pairs_hook=self._as_object)

    def _as_object(self, pairs: list) -> dict:
        made = dict(pairs)
        self.repeats = self.repeats or len(made) < len(pairs)
        return made


def read_study(text: str) -> tuple[str | None, str | None]:
    """(study text, reason) of the text of one study."""
    decoder = _Decoder()
    try:
        study = decoder.decode(text)
    except ValueError as error:
        return None, str(error)
    return (json.dumps(study, ensure_ascii=False) if decoder.repeats else text), None


def cut_page(text: str) -> Iterator[tuple[int, str | None, str | None]]:
    """(position, study text, reason) for each element of a page's ``studies`` list.

    The page is walked element by element, so its size does not matter. Of a key
    that a study repeats the last value counts. What cannot be read gives one row
    with a reason at the position where reading ended.
    """
    decoder, position = _Decoder(), 0

    def skip(at: int) -> int:
        return SPACE.match(text, at).end()

    try:
        at = skip(0)
        if text[at : at + 1] != "{":
            raise ValueError("page is not an object")
        at, seen = skip(at + 1), False
        while text[at : at + 1] != "}":
            key, at = decoder.raw_decode(text, at)
            at = skip(at)
            if text[at : at + 1] != ":":
                raise ValueError(f"no value for key {key!r}")
            at = skip(at + 1)
            if key == "studies" and text[at : at + 1] == "[":
                seen, at = True, skip(at + 1)
                while text[at : at + 1] != "]":
                    decoder.repeats = False
                    study, end = decoder.raw_decode(text, at)
                    yield position, json.dumps(study, ensure_ascii=False) if decoder.repeats else text[at:end], None
                    position, at = position + 1, skip(end)
                    if text[at : at + 1] == ",":
                        at = skip(at + 1)
                    elif text[at : at + 1] != "]":
                        raise ValueError("studies list is cut off")
                at += 1
            else:
                _, at = decoder.raw_decode(text, at)
            at = skip(at)
            if text[at : at + 1] == ",":
                at = skip(at + 1)
            elif text[at : at + 1] != "}":
                raise ValueError("page is cut off")
        if not seen:
            raise ValueError("page has no list of studies")
    except ValueError as error:
        yield position, None, str(error)


def cut_whole_pages(pages: DataFrame) -> DataFrame:
    """(page_file, position, raw, reason) of (page_file, value) pages, each cut by one task.

    Studies are handed on by number and by length, whichever comes first, those of short pages together.
    """

    def studies_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for file, value in zip(batch.column("page_file"), batch.column("value"), strict=True):
                name = file.as_py()
                for study in cut_page(value.as_py() or ""):
                    yield name, *study

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in studies_of(batches):
            rows.append(row)
            size += len(row[2] or "")
            if len(rows) >= STUDIES_PER_BATCH or size >= CHARS_PER_BATCH:
                yield handed(rows)
                rows, size = [], 0
        if rows:
            yield handed(rows)

    def handed(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.int32(), pa.string(), pa.string()]
        columns = [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["page_file", "position", "raw", "reason"])

    return pages.select("page_file", "value").mapInArrow(cut, CUT)


def typed_studies(rows: DataFrame) -> DataFrame:
    """ARRIVAL, study and reason of (page_file, position, raw, reason) rows."""
    rows = rows.withColumn("study", F.try_parse_json("raw"))
    unread = F.when(F.col("study").isNull(), F.coalesce("reason", F.lit("study is not readable")))
    number = F.regexp_extract("page_file", r"(\d+)\D*$", 1).try_cast("decimal(38,0)")
    return rows.select(F.coalesce(number, F.lit(0)).alias("page_number"), "page_file", "position", "study", unread.alias("reason"))


def split_pages(pages: DataFrame) -> DataFrame:
    """ARRIVAL, study and reason of every study of (page_file, value) pages.

    ``study`` is a VARIANT, parsed one study at a time; ``reason`` is set where
    there is none. Pages sort by the last number in their name, then by name.
    """
    return typed_studies(cut_whole_pages(pages))


def landed_pages(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("page_file"), "value")


def pack_pages(pages: DataFrame, path: str) -> None:
    """Land (page_file, value) pages as rows of a Parquet table.

    For pages of a few studies: as files of their own, each would cost its own opening,
    listing and renaming, most of it in the driver.
    """
    pages.select("page_file", "value").write.mode("append").parquet(path)


def packed_pages(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.schema("page_file string, value string").parquet(*([path] if isinstance(path, str) else path))


def split_landed(spark: SparkSession, path: str | list[str], whole_bytes: int = WHOLE_PAGE_BYTES) -> DataFrame:
    """``split_pages`` of the files at ``path``; those of more than ``whole_bytes`` are cut by many tasks.

    Either way gives the same rows, but for the wording of reasons inside a study.
    """
    files = spark.read.format("binaryFile").load(path)
    large = (F.col("length") > whole_bytes) & ~F.col("path").rlike(COMPRESSED)
    if files.filter(large).select("length").isEmpty():
        return split_pages(landed_pages(spark, path))
    small = (F.col("_metadata.file_size") <= whole_bytes) | F.col("_metadata.file_path").rlike(COMPRESSED)
    whole = cut_whole_pages(spark.read.text(path, wholetext=True).filter(small).select(F.col("_metadata.file_path").alias("page_file"), "value"))
    return typed_studies(whole.unionByName(ranged_studies(spark, path, whole_bytes, cut_page, read_study)))


def only_readable(rows: DataFrame) -> DataFrame:
    """Studies alone; fails on the first row that could not be read."""
    failure = F.raise_error(F.concat(F.lit("unreadable study page "), "page_file", F.lit(" at "), F.col("position").cast("string"), F.lit(": "), "reason"))
    return rows.filter(F.when(F.col("reason").isNull(), True).otherwise(failure.cast("boolean"))).drop("reason")


def read_study_pages(spark: SparkSession, path: str | list[str], whole_bytes: int = WHOLE_PAGE_BYTES) -> DataFrame:
    """Studies of landed result pages, in arrival order (ARRIVAL); fails on unreadable input.

    A page is one file holding a JSON object with a ``studies`` list; a file of no bytes is no page.
    """
    return only_readable(split_landed(spark, path, whole_bytes))


def rejected_studies(spark: SparkSession, path: str | list[str], whole_bytes: int = WHOLE_PAGE_BYTES) -> DataFrame:
    """(page_file, position, reason) of what ``read_study_pages`` fails on."""
    return _rejected(split_landed(spark, path, whole_bytes))


def rejected_of_pages(pages: DataFrame) -> DataFrame:
    """The same of (page_file, value) pages, as ``packed_pages`` gives them."""
    return _rejected(split_pages(pages))


def _rejected(rows: DataFrame) -> DataFrame:
    return rows.filter("reason IS NOT NULL").select("page_file", "position", "reason")


def take_first(studies: DataFrame, max_results: int | None, order: list[str]) -> DataFrame:
    """The first ``max_results`` studies in arrival order; all when not given."""
    return studies if max_results is None else studies.orderBy(*order).limit(max_results)


def filter_studies(
    trials: DataFrame,
    intervention: str | None = None,
    condition: str | None = None,
    status: str | None = None,
) -> DataFrame:
    """Keep trials naming the intervention and condition and having the status."""

    def names(column: str, wanted: str) -> Column:
        return F.exists(column, lambda name: F.contains(F.lower(name), F.lit(wanted.lower())))

    if status:
        trials = trials.filter(F.col("overall_status") == status)
    if intervention:
        trials = trials.filter(names("intervention_names", intervention))
    if condition:
        trials = trials.filter(names("conditions", condition))
    return trials


def normalize_trials(studies: DataFrame, study: str = "study", keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed trial rows of a VARIANT study column; missing parts become null or empty."""
    raw = F.col(study)

    def text(path: str) -> Column:
        return F.try_variant_get(raw, f"$.protocolSection.{path}", "string")

    def texts(path: str) -> Column:
        found = F.try_variant_get(raw, f"$.protocolSection.{path}", "array<string>")
        return F.coalesce(found, F.array().cast("array<string>"))

    def date(name: str) -> Column:
        return parse_registry_date(F.try_variant_get(raw, f"$.protocolSection.statusModule.{name}", "variant"))

    def outcomes(name: str) -> Column:
        found = F.try_variant_get(raw, f"$.protocolSection.outcomesModule.{name}", OUTCOMES)
        return F.coalesce(found, F.array().cast(OUTCOMES))

    interventions = F.try_variant_get(
        raw, "$.protocolSection.armsInterventionsModule.interventions", "array<struct<name:string>>"
    )
    named = F.filter(F.transform(interventions, lambda i: i["name"]), lambda n: n.isNotNull() & (n != ""))
    phases = texts("designModule.phases")
    nct_id = F.coalesce(text("identificationModule.nctId"), F.lit(""))
    return studies.select(
        *keep,
        nct_id.alias("nct_id"),
        F.concat(F.lit(STUDY_URL), nct_id).alias("source_url"),
        F.coalesce(text("identificationModule.briefTitle"), F.lit("")).alias("brief_title"),
        text("identificationModule.officialTitle").alias("official_title"),
        F.coalesce(text("statusModule.overallStatus"), F.lit("UNKNOWN")).alias("overall_status"),
        F.when(F.size(phases) > 0, F.array_join(phases, "/")).alias("phase"),
        text("designModule.studyType").alias("study_type"),
        texts("conditionsModule.conditions").alias("conditions"),
        F.coalesce(named, F.array().cast("array<string>")).alias("intervention_names"),
        text("sponsorCollaboratorsModule.leadSponsor.name").alias("sponsor_name"),
        F.try_variant_get(raw, "$.protocolSection.designModule.enrollmentInfo.count", "int").alias("enrollment_count"),
        date("startDateStruct").alias("start_date"),
        date("primaryCompletionDateStruct").alias("primary_completion_date"),
        date("completionDateStruct").alias("completion_date"),
        date("lastUpdatePostDateStruct").alias("last_update_posted_date"),
        text("descriptionModule.briefSummary").alias("brief_summary"),
        text("descriptionModule.detailedDescription").alias("detailed_description"),
        outcomes("primaryOutcomes").alias("primary_outcomes"),
        outcomes("secondaryOutcomes").alias("secondary_outcomes"),
        canonical_json(raw).alias("raw_data"),
    ).withColumn("content_hash", sha256_hex(F.col("raw_data")))


def trial_document_text(brief_summary: Column, detailed_description: Column) -> Column:
    blank = F.lit("")
    return F.concat_ws("\n\n", F.nullif(brief_summary, blank), F.nullif(detailed_description, blank))
