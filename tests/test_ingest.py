"""Sources, upserts, links, snapshots, integrity and incremental ingest."""

import datetime as dt
import gzip
import hashlib
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from groundspark import runtime, schemas
from groundspark.operators import integrity, upsert
from groundspark.plans import ingest
from groundspark.plans.retrieval import build_index
from groundspark.operators import fulltext, lexemes
from groundspark.sources import articles, page_ranges, questions, snapshots, studies
from groundspark.streaming import incremental

FULL = {
    "protocolSection": {
        "identificationModule": {"nctId": "NCT00000007", "briefTitle": "Brief", "officialTitle": "Official"},
        "statusModule": {
            "overallStatus": "TERMINATED", "startDateStruct": {"date": "2011-08", "type": "ESTIMATED"}, "primaryCompletionDateStruct": {"date": "2013-02-27"},
            "completionDateStruct": {"date": ""}, "lastUpdatePostDateStruct": {"date": "2022"},
        },
        "designModule": {"studyType": "INTERVENTIONAL", "phases": ["PHASE2", "PHASE3"], "enrollmentInfo": {"count": 41, "type": "ACTUAL"}},
        "conditionsModule": {"conditions": ["Cough", "Cold"]},
        "armsInterventionsModule": {"interventions": [{"type": "DRUG", "name": "Syrup"}, {"type": "DRUG"}, {"name": ""}, {"name": "Tea"}]},
        "sponsorCollaboratorsModule": {"leadSponsor": {"name": "Sponsor", "class": "OTHER"}},
        "descriptionModule": {"briefSummary": "Short.", "detailedDescription": "Long."},
        "outcomesModule": {"primaryOutcomes": [{"measure": "Days", "timeFrame": "1 week"}], "secondaryOutcomes": [{"measure": "Nights", "description": "d"}]},
    },
    "extra": {"kept": ["in", "the", "hash"]},
}


def study(nct_id, title="T", summary="S", **status):
    return {
        "protocolSection": {
            "identificationModule": {"nctId": nct_id, "briefTitle": title},
            "statusModule": status,
            "descriptionModule": {"briefSummary": summary},
        }
    }


def as_studies(spark, records):
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)]
    return spark.createDataFrame(rows, "seq long, raw string").select("seq", F.parse_json("raw").alias("study"))


def test_full_trial(spark):
    trial = studies.normalize_trials(as_studies(spark, [FULL])).first()
    assert (trial.nct_id, trial.source_url, trial.brief_title) == ("NCT00000007", "https://clinicaltrials.gov/study/NCT00000007", "Brief")
    assert (trial.phase, trial.conditions, trial.intervention_names) == ("PHASE2/PHASE3", ["Cough", "Cold"], ["Syrup", "Tea"])
    assert (trial.start_date, trial.primary_completion_date, trial.completion_date) == (dt.date(2011, 8, 1), dt.date(2013, 2, 27), None)
    assert (trial.last_update_posted_date, trial.enrollment_count, trial.sponsor_name) == (dt.date(2022, 1, 1), 41, "Sponsor")
    assert trial.primary_outcomes[0].asDict() == {"measure": "Days", "description": None, "timeFrame": "1 week"}
    canonical = json.dumps(FULL, sort_keys=True, separators=(",", ":"))
    assert trial.raw_data == canonical and trial.content_hash == hashlib.sha256(canonical.encode()).hexdigest()


def test_sparse_trials(spark):
    rows = studies.normalize_trials(as_studies(spark, [study("NCT00000001"), {}, {"protocolSection": {}}]), keep=("seq",)).orderBy("seq").collect()
    assert [r.overall_status for r in rows] == ["UNKNOWN"] * 3
    assert [r.nct_id for r in rows] == ["NCT00000001", "", ""]
    assert rows[1].conditions == [] and rows[1].intervention_names == [] and rows[1].phase is None and rows[1].brief_title == ""
    assert rows[1].primary_outcomes == [] and rows[1].start_date is None and rows[1].source_url.endswith("/study/")


def test_trial_text(spark):
    rows = spark.createDataFrame([("a", "b"), ("", "b"), (None, None), ("a", "")], "s string, d string")
    got = [r[0] for r in rows.select(studies.trial_document_text(F.col("s"), F.col("d"))).collect()]
    assert got == ["a\n\nb", "b", "", "a"]


def test_study_pages(spark, tmp_path):
    for number, ids in enumerate([["A", "B"], [], ["C"]]):
        page = {"studies": [study(i) for i in ids], "nextPageToken": None}
        (tmp_path / f"page-{number}.json").write_text(json.dumps(page, indent=2))
    scanned = studies.read_study_pages(spark, str(tmp_path))
    assert scanned.count() == 3 and studies.rejected_studies(spark, str(tmp_path)).count() == 0
    first = studies.take_first(scanned, 2, studies.ARRIVAL)
    assert sorted(r.nct_id for r in studies.normalize_trials(first).collect()) == ["A", "B"]
    assert studies.take_first(scanned, None, []).count() == 3


def test_unreadable_pages_are_told(spark, tmp_path):
    pages = {
        "page-2.json": "{not json", "page-3.json": '{"other": 1}', "page-10.json": json.dumps({"studies": [study("A"), study("B")]})[:-40],
        "page-4.json": '{"studies": [{"a": 1, "a": 2}, {"b": "} ] ,"}], "nextPageToken": null}', "page-6.json": '{"studies": [1, oops, 3]}',
    }
    for name, text in pages.items():
        (tmp_path / name).write_text(text)
    rows = studies.split_pages(studies.landed_pages(spark, str(tmp_path))).orderBy(*studies.ARRIVAL).collect()
    got = [(int(r.page_number), r.position, r.reason is None) for r in rows]
    assert got == [(2, 0, False), (3, 0, False), (4, 0, True), (4, 1, True), (6, 0, True), (6, 1, False), (10, 0, True), (10, 1, False)]
    assert json.loads(str(rows[2].study)) == {"a": 2} and json.loads(str(rows[3].study)) == {"b": "} ] ,"}
    assert studies.rejected_studies(spark, str(tmp_path)).count() == 4
    with pytest.raises(Exception, match="unreadable study page"):
        studies.read_study_pages(spark, str(tmp_path)).collect()


def test_a_page_may_be_larger_than_one_value(spark, tmp_path):
    body = ",".join(json.dumps(study(f"NCT{k:08d}", summary="x" * 100_000)) for k in range(1_450))
    (tmp_path / "page-0.json").write_text('{"studies": [' + body + "]}")
    assert studies.read_study_pages(spark, str(tmp_path)).count() == 1_450


ODD_PAGES = {
    "page-1.json": json.dumps({"studies": [study(f"N{k}", summary='a "b" \\\\' + "}]{[" * (k % 7)) for k in range(30)], "nextPageToken": "}"}, indent=1),
    "page-2.json": json.dumps({"meta": {"studies": [{"x": 1}], "deep": [[{}, []]]}, "studies": [1, "}{", [], {}, [{"a": [1]}], None, {"b": "\\\""}], "other": [{"c": 1}]}),
    "page-3.json": '{"studies": [{"a": 1}], "n": 1, "studies": [{"a": 1, "a": 2}]}\n \n',
    "page-4.json": json.dumps({"studies": [study("A"), study("B")]})[:-40],
    "page-5.json": '{"studies": [{"a": 1}, {"b": 2}',
    "page-6.json": '{"studies": [{"a": 1}, {"b": tru}, {"c": 1}]}',
    "page-7.json": '{"studies": [{"a": "open}, {"b": 1}]}',
    "page-8.json": '[{"studies": [{"a": 1}]}]',
    "page-9.json": '{"studies": [{"a": 1]}, {"b": 1}]}',
    "page-10.json": '{"studies": [{"a": "' + "é" * 300 + '"}, 5',
    "page-11.json": '{"studies": []} {"studies": [{"a": 1}]}',
    "page-12.json": '{"studies": [{"a": NaN}, {"b": 1}]}',
    "page-13.json": '{"studies": 5} }}}{{{',
    "page-14.json": "",
    "page-15.json": " \n",
}


@pytest.mark.parametrize("segment_bytes, block_bytes", [(1, 400), (1 << 20, 1 << 27)])
def test_pages_cut_by_ranges_give_the_rows_of_whole_pages(spark, tmp_path, monkeypatch, segment_bytes, block_bytes):
    monkeypatch.setattr(page_ranges, "SEGMENT_BYTES", segment_bytes)
    for name, text in ODD_PAGES.items():
        (tmp_path / name).write_text(text)

    def rows(whole_bytes):
        found = studies.split_landed(spark, str(tmp_path), whole_bytes).select("page_file", "position", F.col("study").cast("string").alias("study"), F.col("reason").isNull().alias("read"))
        return sorted((tuple(r) for r in found.collect()), key=lambda r: (r[0], r[1]))

    want, before = rows(1 << 30), spark.conf.get("spark.sql.files.maxPartitionBytes")
    assert len(want) > 45
    spark.conf.set("spark.sql.files.maxPartitionBytes", block_bytes)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        assert rows(0) == want
        assert rows(200) == want
        if block_bytes == 400:
            page = [r for r in page_ranges.segments(spark, str(tmp_path), 0, False).collect() if r.page_file.endswith("page-1.json")]
            assert len({r.block for r in page}) > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_rejects_of_ranges_keep_file_and_position(spark, tmp_path):
    body = ['{"a": %d}' % k for k in range(50)]
    (tmp_path / "page-0.json").write_text('{"studies": [' + ",".join(body[:30] + ['{"a": oops}'] + body[30:]) + "]}")
    (tmp_path / "page-1.json.gz").write_bytes(gzip.compress(('{"studies": [' + ",".join(body) + "]}").encode()))
    rejected = [(r.page_file.rsplit("/", 1)[1], r.position) for r in studies.rejected_studies(spark, str(tmp_path), 0).collect()]
    assert rejected == [("page-0.json", 30)]
    assert studies.split_landed(spark, str(tmp_path), 0).filter("reason IS NULL").count() == 30 + 50


def test_two_writers_cannot_take_one_version(spark, tmp_path):
    root, rows = str(tmp_path / "t"), spark.range(3)
    base = snapshots.current_version(spark, root)
    snapshots.write_snapshot(spark, root, {"a": rows}, base=base)
    with pytest.raises(snapshots.SnapshotConflict):
        snapshots.write_snapshot(spark, root, {"a": rows.limit(1), "b": rows}, base=base)
    assert snapshots.read_snapshot(spark, root)["a"].count() == 3 and snapshots.current_version(spark, root) == 1
    snapshots.write_snapshot(spark, root, {"b": rows})
    assert {n: t.count() for n, t in snapshots.read_snapshot(spark, root).items()} == {"a": 3, "b": 3}


def test_broken_json_files_fail(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"questions": [{"id": "q1", "question": "Q"}], "esearchresult": {"idlist": ["1"]}}')
    assert questions.read_questions(spark, str(tmp_path)).count() == 1 and articles.read_article_ids(spark, str(tmp_path)).count() == 1
    (tmp_path / "b.json").write_text('{"questions": [{"id": "q2", "que')
    for read in (questions.read_questions, articles.read_article_ids):
        with pytest.raises(Exception, match="FAILFAST|Malformed|MALFORMED"):
            read(spark, str(tmp_path)).collect()


def test_study_filters(spark):
    trials = studies.normalize_trials(as_studies(spark, [FULL, study("NCT00000001", overallStatus="COMPLETED")]))
    count = lambda **wanted: studies.filter_studies(trials, **wanted).count()
    assert (count(), count(status="TERMINATED"), count(intervention="syrup"), count(condition="COLD"), count(status="X")) == (2, 1, 1, 1, 0)
    assert count(status="TERMINATED", intervention="tea", condition="cough") == 1


ARTICLE = """<PubmedArticle>
  <MedlineCitation><PMID Version="1">0042</PMID>
  <Article><Journal><JournalIssue><PubDate><Year>2020</Year><Month>Nov</Month><Day>31</Day></PubDate></JournalIssue><Title> J. Coughs </Title></Journal>
  {article_date}
  <ArticleTitle>Syrup for <i>bad</i> coughs NCT00000009</ArticleTitle>
  <Abstract><AbstractText Label="AIM"> To <b>test</b> syrup &amp; tea. </AbstractText><AbstractText> </AbstractText><AbstractText>See NCT00000007.</AbstractText></Abstract>
  <AuthorList><Author><LastName>Roe</LastName><Initials>AB</Initials></Author><Author><LastName>Poe</LastName></Author>
  <Author><CollectiveName>Cough Group</CollectiveName></Author><Author><Initials>Q</Initials></Author></AuthorList>
  <DataBankList><DataBank><AccessionNumberList><AccessionNumber>nct1</AccessionNumber><AccessionNumber>GSE5</AccessionNumber></AccessionNumberList></DataBank></DataBankList>
  </Article><MeshHeadingList><MeshHeading><DescriptorName> Cough </DescriptorName></MeshHeading></MeshHeadingList>
  <OtherID><SecondarySourceId>x NCT00000008</SecondarySourceId></OtherID></MedlineCitation>
  <PubmedData><ArticleIdList><ArticleId IdType="pubmed">42</ArticleId><ArticleId IdType="doi"> 10.1/x </ArticleId><ArticleId IdType="doi">10.1/y</ArticleId></ArticleIdList></PubmedData>
</PubmedArticle>"""


def publication(spark, xml):
    return articles.normalize_publications(spark.createDataFrame([("0042", xml)], "pmid string, article_xml string")).first()


def test_full_article(spark):
    xml = ARTICLE.format(article_date="")
    row = publication(spark, xml)
    assert row.title == "Syrup for" and row.journal == "J. Coughs" and row.doi == "10.1/x"
    assert row.abstract == "AIM: To test syrup & tea.\nSee NCT00000007."
    assert row.authors == ["Roe AB", "Poe", "Cough Group"] and row.mesh_terms == ["Cough"]
    assert row.linked_nct_ids == ["NCT00000007", "NCT00000008", "NCT1"]  # the title ends at its first tag
    assert (row.publication_date, row.publication_year) == (None, 2020)  # 31 November
    assert row.content_hash == hashlib.sha256(xml.encode()).hexdigest() and row.source_url == "https://pubmed.ncbi.nlm.nih.gov/0042/"


@pytest.mark.parametrize(
    "node,expected",
    [
        ("<ArticleDate><Year>2019</Year><Month>2</Month><Day>3</Day></ArticleDate>", (dt.date(2019, 2, 3), 2019)),
        ("<ArticleDate><Year>2019</Year></ArticleDate>", (dt.date(2019, 1, 1), 2019)),
        ("<ArticleDate><MedlineDate>1998 Dec-1999 Jan</MedlineDate></ArticleDate>", (dt.date(1998, 1, 1), 1998)),
        ("<ArticleDate><Month>2</Month></ArticleDate>", (None, 2020)),
        ("<ArticleDate><MedlineDate>Winter 1998</MedlineDate></ArticleDate>", (None, 2020)),
    ],
)
def test_article_dates(spark, node, expected):
    row = publication(spark, ARTICLE.format(article_date=node))
    assert (row.publication_date, row.publication_year) == expected


def test_bare_and_broken_articles(spark):
    bare = publication(spark, "<PubmedArticle><PMID>1</PMID></PubmedArticle>")
    assert bare.title == "" and bare.abstract is None and bare.authors == [] and bare.linked_nct_ids == [] and bare.parsed
    assert bare.doi is None and bare.publication_date is None and bare.publication_year is None
    assert publication(spark, "<PubmedArticle><PMID>1").parsed is False


def test_article_sets(spark, tmp_path):
    body = ARTICLE.format(article_date="")
    other = "<PubmedArticle><MedlineCitation><PMID>7</PMID></MedlineCitation></PubmedArticle>"
    (tmp_path / "a.xml").write_text(f"<?xml version='1.0'?>\n<PubmedArticleSet>\n{body}\n{other}\n</PubmedArticleSet>\n")
    (tmp_path / "b.xml").write_text("<PubmedArticleSet></PubmedArticleSet>")
    found = {r.pmid: r.article_xml for r in articles.read_articles(spark, str(tmp_path)).collect()}
    assert found == {"0042": body, "7": other}
    ids = spark.createDataFrame([("7",), ("8",)], "pmid string")
    assert [r.pmid for r in articles.read_articles(spark, str(tmp_path), ids).collect()] == ["7"]
    assert articles.read_articles(spark, str(tmp_path), ids.limit(0)).count() == 0


def test_article_ids(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps({"esearchresult": {"idlist": ["03", "1", "2"]}}))
    (tmp_path / "2.json").write_text("{}")
    assert [r.pmid for r in articles.read_article_ids(spark, str(tmp_path)).orderBy("page_file", "position").collect()] == ["03", "1", "2"]
    assert articles.read_article_ids(spark, str(tmp_path), retmax=2).count() == 2


def test_questions(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"questions": [{"id": "a", "question": "Why?", "expect_answerable": True, "relevant_source_identifiers": ["x"]}]}))
    row = questions.read_questions(spark, str(tmp_path)).first()
    assert row.asDict() == {"id": "a", "question": "Why?", "expect_answerable": True, "relevant_source_identifiers": ["x"], "ground_truth_basis": ""}


def test_classify_matches_one_by_one(spark, monkeypatch):
    rng = random.Random(3)
    stored = {f"k{i}": rng.choice("ab") for i in range(6)}
    arrivals = [(rng.choice(["k0", "k0", "k0", *[f"k{i}" for i in range(12)]]), i * 3, rng.choice("ab")) for i in range(300)]
    state, want = dict(stored), {}
    for key, seq, content in arrivals:
        want[seq] = "new" if key not in state else "unchanged" if state[key] == content else "updated"
        state[key] = content
    batch = spark.createDataFrame(arrivals, "key string, seq long, content_hash string")
    existing = spark.createDataFrame(list(stored.items()), "key string, content_hash string")
    for step in (7, 100, 10**6):
        assert {r.seq: r.action for r in upsert.classify(batch, existing, "key", step).collect()} == want
    merged = upsert.upsert(batch, existing.withColumn("created_at", F.lit(None).cast("timestamp")).withColumn("updated_at", F.lit(None).cast("timestamp")), "key")
    assert {r.key: r.content_hash for r in merged.snapshot.collect()} == state
    monkeypatch.setattr(runtime, "rows_fit", lambda *_: False)  # the same without broadcasts
    wide = upsert.upsert(batch, existing.withColumn("created_at", F.lit(None).cast("timestamp")).withColumn("updated_at", F.lit(None).cast("timestamp")), "key")
    assert {r.key: r.content_hash for r in wide.snapshot.collect()} == state
    counts = upsert.action_counts(merged.actions).first().asDict()
    assert counts == {a: list(want.values()).count(a) for a in ("new", "updated", "unchanged")}


def test_collisions(spark):
    rows = spark.createDataFrame([("b", "h1"), ("a", "h1"), ("c", "h2")], "source_id string, content_hash string")
    assert sorted(map(tuple, upsert.hash_collisions(rows).collect())) == [("h1", 2, "a"), ("h1", 2, "b")]
    batch = spark.createDataFrame([("x", 1, "h1"), ("x", 2, "h2"), ("y", 3, "h1")], "key string, seq long, content_hash string")
    assert upsert.hash_collisions(upsert.last_hashes(batch, "key")).count() == 0


def test_trial_batches(spark):
    day = [F.lit(f"2024-01-0{i} 00:00:00").cast("timestamp") for i in range(1, 5)]
    first = ingest.ingest_trials(as_studies(spark, [study("NCT00000001", "One"), study("", "none"), study("NCT00000002", "Two")]), None, None, day[0])
    assert first.rejected.count() == 1
    assert upsert.action_counts(first.records.actions).first().asDict() == {"new": 2, "updated": 0, "unchanged": 0}
    trials, documents = first.records.snapshot, first.documents.snapshot
    again = ingest.ingest_trials(as_studies(spark, [study("NCT00000001", "One"), study("NCT00000002", "Two")]), trials, documents, day[1])
    assert upsert.action_counts(again.records.actions).first().unchanged == 2
    assert sorted(map(str, again.records.snapshot.select(*sorted(trials.columns)).collect())) == sorted(map(str, trials.select(*sorted(trials.columns)).collect()))
    # A new title alone changes the trial and leaves the document as it was.
    titled = ingest.ingest_trials(as_studies(spark, [study("NCT00000001", "Renamed")]), trials, documents, day[2])
    assert {r.nct_id: r.brief_title for r in titled.records.snapshot.collect()} == {"NCT00000001": "Renamed", "NCT00000002": "Two"}
    assert {r.source_identifier: r.title for r in titled.documents.snapshot.collect()} == {"NCT00000001": "One", "NCT00000002": "Two"}
    # New text renews the document, title included.
    retold = ingest.ingest_trials(as_studies(spark, [study("NCT00000001", "Renamed", "New text")]), trials, documents, day[3])
    document = retold.documents.snapshot.filter("source_identifier = 'NCT00000001'").first()
    assert (document.title, document.text) == ("Renamed", "New text")
    assert document.content_hash == hashlib.sha256(b"NCT00000001:New text").hexdigest()
    assert document.created_at < document.updated_at


def test_table_schemas(spark):
    done = ingest.ingest_trials(as_studies(spark, [FULL, study("NCT00000001")]), None, None)
    articles_done = ingest.ingest_publications(as_articles(spark, [("1", article("1"))]), None, schemas.empty(spark, "trials"), None)
    index = build_index(done.documents.snapshot)
    for name, table in {"trials": done.records.snapshot, "documents": done.documents.snapshot, "publications": articles_done.records.snapshot, "chunks": index}.items():
        wanted = schemas.TABLES[name]()
        assert {f.name: f.dataType.simpleString() for f in wanted} == {f.name: f.dataType.simpleString() for f in table.schema if f.name != "parsed"}
        assert schemas.conform(table, name).count() == table.count()
        assert schemas.empty(spark, name).schema == wanted
    with pytest.raises(Exception, match="documents.text must not be null"):
        schemas.conform(done.documents.snapshot.withColumn("text", F.lit(None).cast("string")), "documents").collect()


def test_same_key_twice_in_a_batch(spark):
    batch = [study("NCT00000001", "A", "x"), study("NCT00000001", "B", "x"), study("NCT00000001", "B", "x"), study("NCT00000001", "C", "y"), study("NCT00000001", "D", "y")]
    done = ingest.ingest_trials(as_studies(spark, batch), None, None)
    assert upsert.action_counts(done.records.actions).first().asDict() == {"new": 1, "updated": 3, "unchanged": 1}
    assert done.records.snapshot.first().brief_title == "D"
    assert done.documents.snapshot.first().title == "C"  # the title that came with the stored text


def article(pmid, *nct_ids, title="T"):
    links = "".join(f"<SecondarySourceId>{n}</SecondarySourceId>" for n in nct_ids)
    return f"<PubmedArticle><PMID>{pmid}</PMID><ArticleTitle>{title}</ArticleTitle><Abstract><AbstractText>About {pmid}</AbstractText></Abstract>{links}</PubmedArticle>"


def as_articles(spark, pairs):
    return spark.createDataFrame([(i, pmid, xml) for i, (pmid, xml) in enumerate(pairs)], "seq long, pmid string, article_xml string")


def test_links(spark):
    trials = spark.createDataFrame([("NCT00000001",), ("NCT00000002",)], "nct_id string")
    one, two, none = article("1", "NCT00000001", "NCT00000099"), article("2", "NCT00000001", "NCT00000002"), article("3", "NCT00000098")
    batch = as_articles(spark, [("1", one), ("2", two), ("3", none), ("", article("")), ("5", "<PubmedArticle>")])
    done = ingest.ingest_publications(batch, None, trials, None)
    links = {r.pmid: r.linked_trial_id for r in done.records.snapshot.collect()}
    assert links == {"1": "NCT00000001", "2": None, "3": None} and done.rejected.count() == 2
    # A trial stored later is linked when the publication changes, or on request.
    more = trials.unionByName(spark.createDataFrame([("NCT00000098",)], "nct_id string"))
    same = ingest.ingest_publications(as_articles(spark, [("3", none)]), done.records.snapshot, more, done.documents.snapshot)
    assert same.records.snapshot.filter("pmid = '3'").first().linked_trial_id is None
    asked = ingest.ingest_publications(as_articles(spark, [("3", none)]), done.records.snapshot, more, done.documents.snapshot, relink=True)
    assert asked.records.snapshot.filter("pmid = '3'").first().linked_trial_id == "NCT00000098"
    changed = ingest.ingest_publications(as_articles(spark, [("3", article("3", "NCT00000098", title="New"))]), done.records.snapshot, more, done.documents.snapshot)
    assert changed.records.snapshot.filter("pmid = '3'").first().linked_trial_id == "NCT00000098"
    assert {r.source_identifier: r.text for r in changed.documents.snapshot.collect()} == {p: f"About {p}" for p in "123"}


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "tables")
    assert snapshots.read_snapshot(spark, root) == {}
    snapshots.write_snapshot(spark, root, {"a": spark.range(3), "b": spark.range(5).withColumn("kind", F.col("id") % 2)}, {"b": ["kind"]})
    tables = snapshots.read_snapshot(spark, root)
    snapshots.write_snapshot(spark, root, {"a": tables["a"].filter("id > 0")})
    now = snapshots.read_snapshot(spark, root)
    assert (now["a"].count(), now["b"].count(), tables["a"].count()) == (2, 5, 3)
    assert list((tmp_path / "tables").glob("v=1-*/b/kind=0"))


def test_violations_and_cascade(spark):
    trials = spark.createDataFrame([("N1",), ("N2",)], "nct_id string")
    publications = spark.createDataFrame([("1", "10.1/a", "N1"), ("2", None, "N2"), ("3", None, None)], "pmid string, doi string, linked_trial_id string")
    documents = spark.createDataFrame(
        [("trial:N1", "trial", "N1", None), ("trial:N2", "trial", "N2", None), ("publication:1", "publication", None, "1")],
        "document_id string, source_type string, trial_id string, publication_id string",
    ).withColumn("source_identifier", F.coalesce("trial_id", "publication_id"))
    chunks = spark.createDataFrame([("trial:N1", 0, 0, 4), ("trial:N2", 0, 0, 4), ("publication:1", 0, 0, 4)], "document_id string, chunk_index int, char_start int, char_end int")
    citations = spark.createDataFrame([("trial:N1:0", "trial:N1", "q", 1, 0, 3), ("publication:1:0", "publication:1", "q", 2, None, None)],
                                      "chunk_id string, document_id string, query_id string, citation_index int, excerpt_char_start int, excerpt_char_end int")
    assert integrity.violations(trials, publications, documents, chunks, citations).count() == 0
    broken = integrity.violations(
        trials.unionByName(trials.limit(1)), publications.withColumn("doi", F.lit("same")), documents.withColumn("publication_id", F.lit("1")),
        chunks.withColumn("char_end", F.lit(0)), citations.withColumn("chunk_id", F.lit("lost")),
    )
    assert {r.rule for r in broken.select("rule").distinct().collect()} == {
        "trial_key_unique", "doi_unique", "document_one_source", "chunk_range", "citation_chunk_exists",
    }
    # Changes to clean tables: checking what they touch finds what checking all tables does.
    pieces = [trials, publications, documents, chunks, citations]
    names = ["trials", "publications", "documents", "chunks", "citations"]
    planted = {
        "trials": ("delete", trials.filter("nct_id = 'N2'")),
        "publications": ("insert", spark.createDataFrame([("4", "10.1/a", "N9"), ("3", "10.1/z", None)], publications.schema)),
        "documents": ("insert", spark.createDataFrame([("report:9", "report", "N1", None, "N1"), ("publication:8", "publication", None, "8", "8")], documents.schema)),
        "chunks": ("delete", chunks.filter("document_id = 'trial:N1'")),
        "citations": ("insert", spark.createDataFrame([("publication:1:0", "publication:1", "q", 3, 3, 1), ("lost", "x", "q", 4, 0, 1)], citations.schema)),
    }
    for several in ([n] for n in names), [names]:
        for changed in several:
            after = {n: t for n, t in zip(names, pieces, strict=True)}
            for n in changed:
                how, rows = planted[n]
                after[n] = after[n].exceptAll(rows) if how == "delete" else after[n].unionByName(rows)
            full = sorted(map(tuple, integrity.violations(**after).collect()))
            assert full and full == sorted(map(tuple, integrity.violations(**after, touched={n: planted[n][1] for n in changed}).collect()))
    assert integrity.violations(*pieces, touched={"trials": trials}).count() == 0
    deleted = spark.createDataFrame([("trial", "N1")], "source_type string, source_identifier string")
    left = integrity.cascade_delete(deleted, documents, chunks, citations, publications)
    assert {n: t.count() for n, t in left.items()} == {"publications": 3, "documents": 2, "chunks": 2, "citations": 1}
    assert {r.pmid: r.linked_trial_id for r in left["publications"].collect()} == {"1": None, "2": "N2", "3": None}


def test_incremental_equals_batch(spark, tmp_path):
    landing, root, checkpoint = tmp_path / "landing", str(tmp_path / "tables"), str(tmp_path / "checkpoint")
    landing.mkdir()

    def land(name, *records):
        (landing / name).write_text(json.dumps({"studies": list(records)}))

    def run():
        query = incremental.stream_studies(spark, str(landing), root, checkpoint)
        query.awaitTermination(120)
        return snapshots.read_snapshot(spark, root)

    land("p1.json", study("NCT00000001", "One", "alpha beta"), study("NCT00000002", "Two", "gamma"))
    assert {r.document_id for r in run()["chunks"].collect()} == {"trial:NCT00000001", "trial:NCT00000002"}
    land("p2.json", study("NCT00000002", "Two", "delta epsilon"), study("NCT00000003", "Three", ""))
    tables = run()
    assert {r.document_id: r.text for r in tables["chunks"].collect()} == {"trial:NCT00000001": "alpha beta", "trial:NCT00000002": "delta epsilon"}
    whole = ingest.ingest_trials(
        as_studies(spark, [study("NCT00000001", "One", "alpha beta"), study("NCT00000002", "Two", "delta epsilon"), study("NCT00000003", "Three", "")]), None, None
    )
    columns = ["document_id", "title", "text", "content_hash"]
    assert sorted(map(tuple, tables["documents"].select(*columns).collect())) == sorted(map(tuple, whole.documents.snapshot.select(*columns).collect()))
    before = {n: t.count() for n, t in tables.items()}
    pages = spark.createDataFrame([("p2", (landing / "p2.json").read_text())], "page_file string, value string")
    incremental.apply_study_batch(pages, root)  # the same batch again
    again = snapshots.read_snapshot(spark, root)
    assert {n: t.count() for n, t in again.items()} == before


def test_incremental_articles(spark, tmp_path):
    landing, root, checkpoint = tmp_path / "landing", str(tmp_path / "tables"), str(tmp_path / "checkpoint")
    landing.mkdir()
    pages = spark.createDataFrame([("p", json.dumps({"studies": [study("NCT00000001")]}))], "page_file string, value string")
    incremental.apply_study_batch(pages, root)
    first, second = article("1", "NCT00000001", title="Old"), article("1", "NCT00000001", title="New")
    (landing / "a.xml").write_text(f"<PubmedArticleSet>{first}{article('2')}{second}</PubmedArticleSet>")
    incremental.stream_articles(spark, str(landing), root, checkpoint).awaitTermination(120)
    tables = snapshots.read_snapshot(spark, root)
    assert {(r.pmid, r.title, r.linked_trial_id) for r in tables["publications"].collect()} == {("1", "New", "NCT00000001"), ("2", "T", None)}
    assert {r.document_id for r in tables["chunks"].collect()} == {"trial:NCT00000001", "publication:1", "publication:2"}
    # The title alone changed between the two copies, so the document kept the first one.
    assert tables["documents"].filter("source_identifier = '1'").first().title == "Old"


def test_a_reader_never_sees_half_a_version(spark, tmp_path, monkeypatch):
    root, rows = str(tmp_path / "tables"), spark.range(3)
    snapshots.write_snapshot(spark, root, {"a": rows})
    real, seen = snapshots._publish, []

    def watched(session, place, version, entry):
        seen.append((snapshots.current_version(session, place), sorted(snapshots.read_snapshot(session, place))))
        return real(session, place, version, entry)

    monkeypatch.setattr(snapshots, "_publish", watched)
    snapshots.write_snapshot(spark, root, {"b": rows})
    assert seen == [(1, ["a"])]
    # A crash before the rename leaves the version before it, and its number free.
    monkeypatch.setattr(snapshots, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("crash")))
    with pytest.raises(RuntimeError):
        snapshots.write_snapshot(spark, root, {"a": rows.limit(1)})
    monkeypatch.setattr(snapshots, "_publish", real)
    assert snapshots.current_version(spark, root) == 2 and snapshots.read_snapshot(spark, root)["a"].count() == 3
    assert not [p for p in (tmp_path / "tables" / "_log").iterdir() if p.name.startswith(".") and p.suffix != ".crc"]
    assert not real(spark, root, 2, {"version": 2, "tables": {}, "changed": {}})


def test_writers_of_different_tables_and_buckets_both_commit(spark, tmp_path):
    root = str(tmp_path / "tables")
    keyed = spark.createDataFrame([(f"k{k}", k) for k in range(50)], "key string, value long")
    snapshots.write_snapshot(spark, root, {"whole": keyed})
    base = snapshots.apply_changes(spark, root, {"t": snapshots.Changes(keyed, ("key",), buckets=16)}, 1)
    # Both start from the same version; the first changes another table, then the buckets of other keys.
    snapshots.write_snapshot(spark, root, {"other": keyed}, base=base)
    place = {r["key"]: r["b"] for r in keyed.select("key", snapshots.bucket_of(["key"], 16).alias("b")).collect()}
    one = next(k for k in place if place[k] != place["k0"])
    first, second = (keyed.filter(F.col("key") == k).withColumn("value", F.lit(v)) for k, v in (("k0", 1000), (one, 2000)))
    snapshots.apply_changes(spark, root, {"t": snapshots.Changes(first, ("key",))}, base)
    snapshots.apply_changes(spark, root, {"t": snapshots.Changes(second, ("key",))}, base)
    now = {r.key: r.value for r in snapshots.read_snapshot(spark, root)["t"].collect()}
    assert now == {f"k{k}": k for k in range(50)} | {"k0": 1000, one: 2000}
    with pytest.raises(snapshots.SnapshotConflict):
        snapshots.apply_changes(spark, root, {"t": snapshots.Changes(first, ("key",))}, base)
    with pytest.raises(snapshots.SnapshotConflict):
        snapshots.write_snapshot(spark, root, {"other": keyed}, base=base)
    assert snapshots.read_snapshot(spark, root, base)["t"].filter("value > 900").count() == 0


def test_keyed_tables_keep_the_latest_row_through_compaction(spark, tmp_path):
    root, rng, want = str(tmp_path / "tables"), random.Random(5), {}
    base, shape = 0, "key string, part int, value long, _deleted boolean"
    for batch in range(11):
        rows = {(f"k{rng.randrange(12)}", rng.randrange(2)): (rng.randrange(1000), rng.random() < 0.2) for _ in range(1 if batch % 3 else 12)}
        changes = spark.createDataFrame([(k, p, v, d) for (k, p), (v, d) in rows.items()], shape)
        before = snapshots._entry(spark, root, snapshots.current_version(spark, root))["tables"].get("t", {"held": {}})["held"]
        version = snapshots.apply_changes(spark, root, {"t": snapshots.Changes(changes, ("key", "part"), ("key",), 8)}, base)
        base = snapshots.current_version(spark, root)
        for key, (value, gone) in rows.items():
            want.pop(key, None)
            if not gone:
                want[key] = value
        table = snapshots._entry(spark, root, version)["tables"]["t"]
        changed = {b for b in table["held"] if table["held"][b] != before.get(b)}
        assert changed == {str(b) for b in snapshots.touched_buckets(spark, root, version, "t", changes)}  # other buckets stay as they are
        found = snapshots.read_snapshot(spark, root)["t"]
        assert found.columns == ["key", "part", "value"] and {(r.key, r.part): r.value for r in found.collect()} == want
        some = snapshots.touched_buckets(spark, root, base, "t", changes)
        part = {(r.key, r.part): r.value for r in snapshots.read_buckets(spark, root, base, "t", some).collect()}
        assert part.items() <= want.items() and {k: v for k, v in want.items() if k in rows} == {k: v for k, v in part.items() if k in rows}
    held = snapshots._entry(spark, root, base)["tables"]["t"]["held"]
    assert any(level for runs in held.values() for _, level in runs)  # something was merged
    assert all(sum(1 for _, own in runs if own == level) < snapshots.TIER for runs in held.values() for level in {own for _, own in runs})


def test_a_small_batch_writes_only_its_buckets(spark, tmp_path):
    root = str(tmp_path / "tables")
    pages = lambda *s: spark.createDataFrame([("p1.json", json.dumps({"studies": list(s)}))], "page_file string, value string")
    incremental.apply_study_batch(pages(*[study(f"NCT{k:08d}", f"T{k}", f"words of study {k}") for k in range(40)]), root, "simple")
    first = snapshots._entry(spark, root, snapshots.current_version(spark, root))["tables"]
    incremental.apply_study_batch(pages(study("NCT00000007", "T7", "amended words")), root, "simple")
    second = snapshots._entry(spark, root, snapshots.current_version(spark, root))["tables"]
    for name in ("trials", "documents", "chunks", "postings"):
        assert sum(second[name]["held"][b] != first[name]["held"].get(b) for b in second[name]["held"]) == 1
    tables = snapshots.read_snapshot(spark, root)
    # The index has one more segment, of the changed chunk alone, and reads like one built anew.
    (old, _), (new, _) = second["postings"]["held"]["0"]
    assert [old, 0] in first["postings"]["held"]["0"] and spark.read.parquet(second["postings"]["paths"][new]).count() < 10
    built = lexemes.postings(tables["chunks"])
    assert sorted(map(str, tables["postings"].select(*built.columns).collect())) == sorted(map(str, built.collect()))
    asked = lexemes.with_lexemes(spark.createDataFrame([(1, "amended"), (2, "study"), (3, "7")], "query_id long, text string"), "simple")
    found = fulltext.fulltext_from_postings(asked, tables["postings"], 100).groupBy("query_id").count()
    assert {r["query_id"]: r["count"] for r in found.collect()} == {1: 1, 2: 39}
    assert tables["chunks"].count() == 40 and tables["chunks"].filter("text = 'amended words'").count() == 1
    version = snapshots.current_version(spark, root)
    incremental.apply_study_batch(pages(study("NCT00000007", "T7", "amended words")), root, "simple")  # nothing new: nothing written
    assert snapshots.current_version(spark, root) == version


def test_a_stored_batch_leaves_its_runs_alone_and_small_ones(spark, tmp_path):
    """every batch left its working tables behind, and every file of a run a filter of a megabyte for each key."""
    shared, root = Path(runtime.shared_folder(spark)), tmp_path / "tables"
    before = {p.name for p in shared.iterdir()}
    for text in ("alpha", "beta"):
        pages = spark.createDataFrame([("p1.json", json.dumps({"studies": [study(f"NCT{k:08d}", "T", f"{text} {k}") for k in range(30)]}))], "page_file string, value string")
        incremental.apply_study_batch(pages, str(root), "simple")
    assert {p.name for p in shared.iterdir()} == before
    tables = snapshots.read_snapshot(spark, str(root))
    assert tables["documents"].count() == 30 and tables["chunks"].filter("text LIKE 'beta%'").count() == 30
    sizes = [p.stat().st_size for p in root.rglob("*.parquet")]
    assert len(sizes) > 50 and max(sizes) < 20_000


def test_scratch_tables_end_with_failed_work_too(spark):
    shared = Path(runtime.shared_folder(spark))
    before = {p.name for p in shared.iterdir()}
    with pytest.raises(ValueError, match="stop"):
        with runtime.scratch_tables():
            assert runtime.write_table(spark.range(3), "own").count() == 3
            with runtime.scratch_tables():
                runtime.write_table(spark.range(3), "inner")
            raise ValueError("stop")
    assert {p.name for p in shared.iterdir()} == before
    kept = runtime.write_table(spark.range(3), "kept")
    assert len({p.name for p in shared.iterdir()} - before) == 1 and kept.count() == 3


def test_a_stream_outlives_a_conflict(spark, tmp_path, monkeypatch):
    root, landing = str(tmp_path / "tables"), tmp_path / "landing"
    landing.mkdir()
    incremental.apply_study_batch(spark.createDataFrame([("p0.json", json.dumps({"studies": [study("NCT00000001", "One", "alpha")]}))], "page_file string, value string"), root, "simple")
    (landing / "p1.json").write_text(json.dumps({"studies": [study("NCT00000001", "Two", "beta")]}))
    real, calls = incremental.apply_changes, []

    def raced(session, place, changes, base):
        calls.append(base)
        if len(calls) == 1:  # another writer is faster
            real(session, place, {"documents": snapshots.Changes(snapshots.read_snapshot(session, place)["documents"].withColumn("title", F.lit("raced")), ("document_id",))}, base)
        return real(session, place, changes, base)

    monkeypatch.setattr(incremental, "apply_changes", raced)
    incremental.stream_studies(spark, str(landing), root, str(tmp_path / "checkpoint"), "simple").awaitTermination(120)
    assert len(calls) == 2 and snapshots.read_snapshot(spark, root)["chunks"].first().text == "beta"


def test_streamed_pages_are_cut_by_ranges(spark, tmp_path, monkeypatch):
    root, landing = str(tmp_path / "tables"), tmp_path / "landing"
    landing.mkdir()
    monkeypatch.setattr(page_ranges, "SEGMENT_BYTES", 300)
    monkeypatch.setattr(incremental, "read_study_pages", lambda s, paths: studies.read_study_pages(s, paths, whole_bytes=100))
    (landing / "p1.json").write_text(json.dumps({"studies": [study(f"NCT{k:08d}", "T", f"word {k}") for k in range(20)]}))
    (landing / "p2.json").write_text(json.dumps({"studies": []}))
    (landing / "p3.json").write_text(json.dumps({"studies": [study("NCT00000003", "T", "later")]}))
    incremental.stream_studies(spark, str(landing), root, str(tmp_path / "checkpoint"), "simple").awaitTermination(120)
    got = {r.document_id: r.text for r in snapshots.read_snapshot(spark, root)["chunks"].collect()}
    assert got == {f"trial:NCT{k:08d}": "later" if k == 3 else f"word {k}" for k in range(20)}


def test_arrival_numbers_follow_the_order_without_moving_rows(spark):
    rows = [(n, f"f{n}-{b}", p * 3, f"{n}-{b}-{p}") for n in (2, 0, 1) for b in range(3) for p in range(4)]
    frame = spark.createDataFrame(rows, "page_number long, page_file string, position long, raw string").repartition(5)
    numbered = ingest.number_arrivals(frame, ["page_number", "page_file", "position"])
    got = [r.raw for r in numbered.orderBy("seq").collect()]
    assert got == [r[3] for r in sorted(rows)] and numbered.select("seq").distinct().count() == len(rows)
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    assert ingest.number_arrivals(frame.limit(0), ["page_number", "page_file", "position"]).count() == 0


def test_packed_pages_give_few_files(spark, tmp_path):
    """Pages of one study each need no file each; what cannot be read is told per page, as of files."""
    rows = [(f"page-{i}.json", json.dumps({"studies": [study(f"NCT{i}")]})[: -30 if i % 3 == 0 else None]) for i in range(3_000)]
    path, files = str(tmp_path / "packs"), tmp_path / "files"
    studies.pack_pages(spark.createDataFrame(rows, "page_file string, value string"), path)
    assert len(list((tmp_path / "packs").glob("part-*"))) <= 8
    packed = studies.rejected_of_pages(studies.packed_pages(spark, path)).collect()
    assert {r.page_file for r in packed} == {name for name, _ in rows[::3]} and len(packed) == 1_000
    files.mkdir()
    for name, text in rows[:60]:
        (files / name).write_text(text)
    told = {(r.page_file.rsplit("/", 1)[1], r.position, r.reason) for r in studies.rejected_studies(spark, str(files)).collect()}
    assert told == {tuple(r) for r in packed if int(r.page_file[5:-5]) < 60}


def test_rejected_query_lands_packs(spark, tmp_path, monkeypatch):
    """The query's landing writes no file per document."""
    from groundspark.catalog import queries

    spark.range(200).selectExpr("id AS doc_id", "'some text' AS text", "'en' AS lang", "'s' AS source", "9L AS n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(queries, "_fresh_path", lambda spark, name: str(tmp_path / name))
    found = {(r.position, r.n_pages) for r in queries.s1_rejected_studies(spark, str(tmp_path)).collect()}
    assert found == {(1, 67), (0, 26)} and len(list((tmp_path / "broken-pages").glob("part-*"))) <= 16


def test_arrivals_are_numbered_on_written_rows(spark, tmp_path, monkeypatch):
    """numbering reads rows twice, so every page was cut and parsed twice."""
    seen = []
    number = incremental.number_arrivals

    def watched(rows, order):
        seen.append(rows._jdf.queryExecution().executedPlan().toString())
        return number(rows, order)

    monkeypatch.setattr(incremental, "number_arrivals", watched)
    value = '{"studies":[{"protocolSection":{"identificationModule":{"nctId":"NCT00000001","briefTitle":"T"}}}]}'
    pages = spark.createDataFrame([("page-1.json", value)], "page_file string, value string")
    incremental.apply_study_batch(pages, str(tmp_path / "tables"), "simple")
    assert len(seen) == 1 and "MapInArrow" not in seen[0] and "FileScan parquet" in seen[0]
    assert snapshots.read_snapshot(spark, str(tmp_path / "tables"))["documents"].count() == 1
