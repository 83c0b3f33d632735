"""Literature articles: landed search results and article sets to typed rows."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundspark.functions.dates import article_date
from groundspark.functions.text import extract_nct_ids, sha256_hex, strip
from groundspark.runtime import in_slices

ARTICLE_URL = "https://pubmed.ncbi.nlm.nih.gov/"
ARTICLE_END = "</PubmedArticle>"
ARRIVAL = ["page_file", "page_block", "position"]
SEARCH_RESULT = "esearchresult struct<idlist: array<string>>"

DATE_NODE = pa.struct([(name, pa.string()) for name in ("year", "month", "day", "medline_date")])
PARSED = pa.struct(
    [
        ("title", pa.string()),
        ("journal", pa.string()),
        ("sections", pa.list_(pa.struct([("label", pa.string()), ("text", pa.string())]))),
        ("authors", pa.list_(pa.struct([(n, pa.string()) for n in ("last", "initials", "collective")]))),
        ("article_ids", pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())]))),
        ("descriptors", pa.list_(pa.string())),
        ("accessions", pa.list_(pa.string())),
        ("secondary_ids", pa.list_(pa.string())),
        ("article_date", DATE_NODE),
        ("issue_date", DATE_NODE),
    ]
)
PARSED_DDL = (
    "struct<title:string,journal:string,sections:array<struct<label:string,text:string>>,"
    "authors:array<struct<last:string,initials:string,collective:string>>,"
    "article_ids:array<struct<kind:string,text:string>>,descriptors:array<string>,"
    "accessions:array<string>,secondary_ids:array<string>,"
    "article_date:struct<year:string,month:string,day:string,medline_date:string>,"
    "issue_date:struct<year:string,month:string,day:string,medline_date:string>>"
)


def read_article_ids(spark: SparkSession, path: str, retmax: int | None = None) -> DataFrame:
    """Ids of landed search results, in result order; a missing list gives none, a broken file fails."""
    found = (
        spark.read.schema(SEARCH_RESULT).option("multiLine", True).option("mode", "FAILFAST").json(path)
        .select(F.col("_metadata.file_path").alias("page_file"), F.posexplode("esearchresult.idlist").alias("position", "pmid"))
    )
    return found if retmax is None else found.orderBy("page_file", "position").limit(retmax)


def read_articles(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """Raw articles of landed article sets, optionally only ``ids``.

    Files are split at the closing article tag, so one large set is read by many
    tasks and each article keeps its exact text for hashing. ARRIVAL names the
    columns that hold the order of the articles in their files.
    """
    pieces = spark.read.option("lineSep", ARTICLE_END).text(path).select(
        "value", F.col("_metadata.file_path").alias("page_file"), F.col("_metadata.file_block_start").alias("page_block")
    )
    articles = cut_articles(pieces)
    return articles if ids is None else articles.join(ids.select("pmid").distinct(), "pmid", "left_semi")


def cut_articles(pieces: DataFrame) -> DataFrame:
    """(ARRIVAL, pmid, article_xml) of (value, page_file, page_block) lines ending at closing tags."""
    start = F.regexp_instr("value", F.lit(r"<PubmedArticle[\s>]"))
    body = F.concat(F.substring(F.col("value"), start, F.char_length("value")), F.lit(ARTICLE_END))
    placed = pieces.withColumn("position", F.monotonically_increasing_id())
    articles = placed.filter(start > 0).select(*ARRIVAL, body.alias("article_xml"))
    return articles.select(*ARRIVAL, article_key(F.col("article_xml")).alias("pmid"), "article_xml")


def article_key(article_xml: Column) -> Column:
    return F.regexp_extract(article_xml, r"<PMID(?:\s[^>]*)?>([^<]*)</PMID>", 1)


def parse_article(article_xml: str | None) -> dict | None:
    """The leaves of one article; None when the text is not well-formed."""
    try:
        root = ElementTree.fromstring(article_xml or "")
    except ElementTree.ParseError:
        return None

    def leaves(path: str) -> list[str]:
        return [node.text for node in root.iterfind(path) if node.text]

    def date(path: str) -> dict | None:
        node = root.find(path)
        if node is None:
            return None
        tags = {"year": "Year", "month": "Month", "day": "Day", "medline_date": "MedlineDate"}
        return {name: node.findtext(tag) for name, tag in tags.items()}

    return {
        "title": root.findtext(".//ArticleTitle"),
        "journal": root.findtext(".//Journal/Title"),
        "sections": [
            {"label": node.get("Label"), "text": "".join(node.itertext())}
            for node in root.iterfind(".//Abstract/AbstractText")
        ],
        "authors": [
            {
                "last": node.findtext("LastName"),
                "initials": node.findtext("Initials"),
                "collective": node.findtext("CollectiveName"),
            }
            for node in root.iterfind(".//AuthorList/Author")
        ],
        "article_ids": [
            {"kind": node.get("IdType"), "text": node.text}
            for node in root.iterfind(".//ArticleIdList/ArticleId")
        ],
        "descriptors": leaves(".//MeshHeadingList/MeshHeading/DescriptorName"),
        "accessions": leaves(".//DataBankList/DataBank/AccessionNumberList/AccessionNumber"),
        "secondary_ids": leaves(".//SecondarySourceId"),
        "article_date": date(".//ArticleDate"),
        "issue_date": date(".//Journal/JournalIssue/PubDate"),
    }


def parse_articles(article_xml: Column) -> Column:
    """Leaves struct of each article, every article parsed once."""

    def parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in in_slices(batches):
            yield pa.array([parse_article(xml) for xml in part.to_pylist()], type=PARSED)

    return F.arrow_udf(parse, PARSED_DDL)(article_xml)


def assemble_abstract(sections: Column) -> Column:
    """``Label: text`` or ``text`` per non-blank section, one per line; null when none."""
    stripped = F.transform(
        sections, lambda s: F.struct(s["label"].alias("label"), strip(s["text"]).alias("text"))
    )
    lines = F.transform(
        F.filter(stripped, lambda s: s["text"] != ""),
        lambda s: F.concat(F.coalesce(F.concat(F.nullif(s["label"], F.lit("")), F.lit(": ")), F.lit("")), s["text"]),
    )
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n"))


def author_names(authors: Column) -> Column:
    """``Last Initials``, ``Last`` or the collective name; others are dropped."""
    blank = F.lit("")

    def name(author: Column) -> Column:
        last, initials = F.nullif(author["last"], blank), F.nullif(author["initials"], blank)
        return F.coalesce(
            strip(F.concat(last, F.lit(" "), initials)), last, F.nullif(author["collective"], blank)
        )

    return F.filter(F.transform(authors, name), lambda n: n.isNotNull())


def first_doi(article_ids: Column) -> Column:
    dois = F.filter(article_ids, lambda a: (a["kind"] == "doi") & (F.coalesce(a["text"], F.lit("")) != ""))
    return strip(F.get(dois, 0)["text"])


def linked_nct_ids(accessions: Column, secondary_ids: Column, title: Column, abstract: Column) -> Column:
    """Sorted registry numbers from accession lists, secondary ids and free text."""
    numbers = F.transform(accessions, lambda a: F.upper(strip(a)))
    prefixed = F.filter(numbers, lambda a: a.startswith("NCT"))
    secondary = F.flatten(F.transform(secondary_ids, extract_nct_ids))
    return F.array_sort(
        F.array_distinct(F.concat(prefixed, secondary, extract_nct_ids(title), extract_nct_ids(abstract)))
    )


def normalize_publications(articles: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed publication rows; an article that cannot be parsed has ``parsed`` false."""
    parsed = articles.select(*keep, "pmid", "article_xml", parse_articles(F.col("article_xml")).alias("a"))
    return project_publications(parsed, keep)


def project_publications(parsed: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Publication columns from the leaves struct ``a`` of each article."""
    leaves = F.col("a")
    dated = parsed.select(
        *keep,
        "pmid",
        "article_xml",
        "a",
        F.coalesce(strip(leaves["title"]), F.lit("")).alias("title"),
        assemble_abstract(leaves["sections"]).alias("abstract"),
        F.coalesce(article_date(leaves["article_date"]), article_date(leaves["issue_date"])).alias("published"),
    )
    return dated.select(
        *keep,
        "pmid",
        F.concat(F.lit(ARTICLE_URL), F.col("pmid"), F.lit("/")).alias("source_url"),
        "title",
        first_doi(leaves["article_ids"]).alias("doi"),
        F.nullif(strip(leaves["journal"]), F.lit("")).alias("journal"),
        F.col("published.date").alias("publication_date"),
        F.col("published.year").alias("publication_year"),
        author_names(leaves["authors"]).alias("authors"),
        "abstract",
        F.transform(leaves["descriptors"], strip).alias("mesh_terms"),
        linked_nct_ids(leaves["accessions"], leaves["secondary_ids"], F.col("title"), F.col("abstract")).alias("linked_nct_ids"),
        F.col("article_xml").alias("raw_xml"),
        sha256_hex(F.col("article_xml")).alias("content_hash"),
        leaves.isNotNull().alias("parsed"),
    )


def publication_document_text(abstract: Column) -> Column:
    return F.coalesce(abstract, F.lit(""))
