"""DuckDB twins of the queries, on the given tables."""

from __future__ import annotations

from groundspark import settings
from groundspark.catalog.inputs import FIRST_BATCH, SECOND_BATCH
from groundspark.operators import comparison as cmp
from groundspark.operators import grounding as gr
from groundspark.operators.lexemes import STOPWORDS
from groundspark.plans import evaluation

BLANK = r"E' \n\t\r'"
STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
ZW = "chr(8203)"
ELLIPSIS = "chr(8230)"


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def nct(number: str) -> str:
    return f"('NCT' || lpad(CAST({number} AS VARCHAR), 8, '0'))"


def identifier(key: str) -> str:
    return f"CASE WHEN {key} % 2 = 0 THEN {nct(key)} ELSE CAST({key} AS VARCHAR) END"


DOCS = f"""docs AS (
  SELECT doc_id AS document_id, CASE WHEN doc_id % 2 = 0 THEN 'trial' ELSE 'publication' END AS source_type,
         {identifier('doc_id')} AS source_identifier, lang || ' ' || source || ' ' || n_chars AS title, text, lang, source, n_chars
  FROM documents)"""


def chunk_ctes(rows: str, name: str = "chunks") -> str:
    """Chunk windows over ``rows`` (a SELECT of document_id, text)."""
    size, overlap = settings.CHUNK_SIZE, settings.CHUNK_OVERLAP

    def end(start: str) -> str:
        cut = f"strpos(reverse(substr(text, {start} + 2, {size - 1})), ' ')"
        return (
            f"CASE WHEN {start} + {size} >= length(text) THEN length(text) "
            f"WHEN {cut} > 0 THEN {start} + {size} - {cut} ELSE {start} + {size} END"
        )

    def skip(at: str) -> str:
        rest = f"substr(text, {at} + 1)"
        return f"({at} + length({rest}) - length(ltrim({rest}, {BLANK})))"

    return f"""{name}_spans AS (
  SELECT document_id, text, 0 AS chunk_index, s, {end('s')} AS e
  FROM (SELECT document_id, text, {skip('0')} AS s FROM ({rows})) WHERE s < length(text)
  UNION ALL
  SELECT document_id, text, chunk_index, s, {end('s')} AS e FROM (
    SELECT document_id, text, chunk_index + 1 AS chunk_index, {skip('n')} AS s FROM (
      SELECT document_id, text, chunk_index, CASE WHEN e - {overlap} > s THEN e - {overlap} ELSE e END AS n
      FROM {name}_spans WHERE e < length(text)))
  WHERE s < length(text)),
{name} AS (
  SELECT document_id, chunk_index, substr(text, CAST(s AS BIGINT) + 1, CAST(e - s AS BIGINT)) AS text,
         CAST(s AS INTEGER) AS char_start, CAST(e AS INTEGER) AS char_end FROM {name}_spans)"""


CHUNKS = chunk_ctes("SELECT doc_id AS document_id, text FROM documents")


def vector_ctes(rows: str, keys: str, name: str, dim: int = 256) -> str:
    """Sparse signed counts ``name`` (keys, bucket, v) and squared norms ``name_norm`` (keys, norm2)."""
    return f"""{name}_tokens AS (
  SELECT {keys}, token, CAST(('0x' || right(sha256(token), 4)) AS BIGINT) % {2 * dim} AS slot FROM (
    SELECT {keys}, unnest(string_split_regex(lower(text), '\\s+')) AS token FROM {rows}) WHERE token <> ''),
{name} AS (
  SELECT {keys}, slot % {dim} AS bucket, CAST(sum(CASE WHEN slot < {dim} THEN 1 ELSE -1 END) AS BIGINT) AS v
  FROM {name}_tokens GROUP BY ALL),
{name}_norm AS (
  SELECT {keys}, CAST(coalesce(sum(v * v), 0) AS BIGINT) AS norm2 FROM (SELECT {keys} FROM {rows}) LEFT JOIN {name} USING ({keys}) GROUP BY {keys})"""


QUESTIONS = "asked AS (SELECT item_id AS query_id, text FROM benchmark)"
CHUNK_VECTORS = vector_ctes("chunks", "document_id, chunk_index", "cv")
QUESTION_VECTORS = vector_ctes("asked", "query_id", "qv")


def lexeme_ctes(rows: str, keys: str, name: str) -> str:
    return f"""{name} AS (
  SELECT {keys}, lexeme, count(*) AS tf FROM (
    SELECT {keys}, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS lexeme FROM {rows})
  WHERE lexeme NOT IN ({STOP}) GROUP BY ALL)"""


CHUNK_LEXEMES = lexeme_ctes("chunks", "document_id, chunk_index", "cl")
QUESTION_LEXEMES = lexeme_ctes("asked", "query_id", "ql")


def fulltext_cte(pool: int) -> str:
    return f"""weights AS (
  SELECT tf, CAST(list_sum(list_transform(range(1, tf + 1), lambda j: 1000000000 // (j * j))) AS BIGINT) AS w
  FROM (SELECT DISTINCT tf FROM cl)),
needed AS (SELECT query_id, count(*) AS n FROM ql GROUP BY ALL),
ft AS (
  SELECT query_id, document_id, chunk_index, sum(w) / 1000000000.0 AS score,
         row_number() OVER (PARTITION BY query_id ORDER BY sum(w) DESC, document_id, chunk_index) AS rank
  FROM ql JOIN cl USING (lexeme) JOIN weights ON weights.tf = cl.tf JOIN needed USING (query_id)
  GROUP BY query_id, document_id, chunk_index, n HAVING count(*) = n QUALIFY rank <= {pool})"""


def dense_cte(pool: int) -> str:
    return f"""dots AS (
  SELECT query_id, document_id, chunk_index, sum(qv.v * cv.v) AS dot FROM qv JOIN cv USING (bucket) GROUP BY ALL),
de AS (
  SELECT q.query_id, c.document_id, c.chunk_index,
         CASE WHEN q.norm2 > 0 AND c.norm2 > 0 THEN coalesce(dot, 0) / sqrt(CAST(c.norm2 AS DOUBLE) * q.norm2) END AS score,
         row_number() OVER (PARTITION BY q.query_id ORDER BY CASE WHEN q.norm2 > 0 AND c.norm2 > 0 THEN coalesce(dot, 0) / sqrt(CAST(c.norm2 AS DOUBLE) * q.norm2) END DESC NULLS LAST, c.document_id, c.chunk_index) AS rank
  FROM qv_norm q CROSS JOIN cv_norm c LEFT JOIN dots ON dots.query_id = q.query_id AND dots.document_id = c.document_id AND dots.chunk_index = c.chunk_index
  QUALIFY rank <= {pool})"""


def search_ctes(mode: str, top_k: int, name: str = "found") -> str:
    """Everything up to ``name``: the ranked evidence rows of one mode."""
    pool = settings.CANDIDATE_POOL
    parts = [DOCS, CHUNKS, QUESTIONS]
    lists = []
    if mode in ("hybrid", "fulltext"):
        parts += [CHUNK_LEXEMES, QUESTION_LEXEMES, fulltext_cte(pool)]
        lists.append(("fulltext", "ft"))
    if mode in ("hybrid", "dense"):
        parts += [CHUNK_VECTORS, QUESTION_VECTORS, dense_cte(pool)]
        lists.append(("dense", "de"))
    return ",\n".join(parts) + ",\n" + fuse_ctes(lists, top_k, name)


def fuse_ctes(lists: list[tuple[str, str]], top_k: int, name: str) -> str:
    union = " UNION ALL ".join(
        f"SELECT query_id, document_id, chunk_index, rank, {i} AS source, '{label}' AS label FROM {cte}" for i, (label, cte) in enumerate(lists)
    )
    return f"""{name}_ranked AS (
  SELECT query_id, document_id, chunk_index, sum(1.0::DOUBLE / (60 + rank) ORDER BY source) AS score,
         array_to_string(list(label ORDER BY source), '|') AS matched_by,
         row_number() OVER (PARTITION BY query_id ORDER BY sum(1.0::DOUBLE / (60 + rank) ORDER BY source) DESC, min(source), arg_min(rank, source)) AS place
  FROM ({union}) GROUP BY query_id, document_id, chunk_index QUALIFY place <= {top_k}),
{name} AS (
  SELECT r.query_id, r.place AS rank, r.document_id, r.chunk_index, source_type, source_identifier, title, c.text AS excerpt, r.score, matched_by
  FROM {name}_ranked r JOIN chunks c USING (document_id, chunk_index) JOIN docs d USING (document_id))"""


def search_sql(mode: str) -> str:
    return f"""WITH RECURSIVE {search_ctes(mode, settings.SEARCH_TOP_K)}
SELECT query_id, rank, document_id, chunk_index, source_type, source_identifier, md5(excerpt) AS excerpt_md5, round(score, 9) AS score, matched_by FROM found"""


EVIDENCE = search_ctes("hybrid", settings.ANSWER_TOP_K)


def raw_date(number: str) -> str:
    year, month, day = f"CAST(2000 + ({number}) % 25 AS VARCHAR)", f"lpad(CAST(1 + ({number}) % 12 AS VARCHAR), 2, '0')", f"CAST(1 + ({number}) % 28 AS VARCHAR)"
    return f"""CASE ({number}) % 6 WHEN 0 THEN {year} WHEN 1 THEN {year} || '-' || {month} WHEN 2 THEN {year} || '-' || {month} || '-' || {day}
  WHEN 3 THEN '' WHEN 4 THEN {year} || '-02-30' ELSE {year} || '-' || {month} || '-' || {day} || '-9' END"""


def parsed_date(number: str) -> str:
    year, month, day = f"2000 + ({number}) % 25", f"1 + ({number}) % 12", f"1 + ({number}) % 28"
    return f"""CASE ({number}) % 6 WHEN 0 THEN CAST(make_date({year}, 1, 1) AS VARCHAR) WHEN 1 THEN CAST(make_date({year}, {month}, 1) AS VARCHAR)
  WHEN 2 THEN CAST(make_date({year}, {month}, {day}) AS VARCHAR) WHEN 5 THEN CAST(make_date({year}, {month}, {day}) AS VARCHAR) END"""


NCT_ID = f"CASE WHEN doc_id % 50 <> 0 THEN {nct('doc_id')} ELSE '' END"
STATUS = "CASE WHEN doc_id % 7 = 0 THEN 'UNKNOWN' WHEN doc_id % 3 = 0 THEN 'COMPLETED' ELSE 'RECRUITING' END"
SUMMARY = f"CASE WHEN doc_id % 6 <> 0 THEN 'Summary of ' || {nct('doc_id')} END"
STUDIES = f"""studies AS (
  SELECT doc_id, {NCT_ID} AS nct_id, lang || ' ' || source AS brief_title, {STATUS} AS overall_status, {SUMMARY} AS brief_summary, text, source, lang, n_chars
  FROM documents WHERE doc_id % 2 = 0)"""
CLEAN = r"regexp_replace(text, '[\x00-\x08\x0b-\x1f]', '', 'g')"
ARTICLES = f"""articles AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS pmid, lang, source, trim({CLEAN}, {BLANK}) AS body FROM documents WHERE doc_id % 2 = 1)"""
ABSTRACT = r"CASE WHEN doc_id % 11 <> 0 THEN 'AIM: Aim of ' || doc_id || CASE WHEN body <> '' THEN chr(10) || body ELSE '' END END"
DAY = "1 + doc_id % 31"
MONTH = "CASE doc_id % 7 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 12 WHEN 5 THEN 1 ELSE 7 END"
YEAR = "1990 + doc_id % 30"


def try_date(year: str, month: str, day: str) -> str:
    return f"CAST(try_cast(CAST({year} AS VARCHAR) || '-' || lpad(CAST({month} AS VARCHAR), 2, '0') || '-' || lpad(CAST({day} AS VARCHAR), 2, '0') AS DATE) AS VARCHAR)"


LINKED = f"""list_sort(list_distinct(list_concat(
  CASE WHEN doc_id % 4 = 1 THEN [{nct('doc_id - 1')}] ELSE []::VARCHAR[] END,
  CASE WHEN doc_id % 6 = 1 THEN [{nct('doc_id + 1')}] ELSE []::VARCHAR[] END)))"""

SECOND = f"""second AS (
  SELECT doc_id, CASE WHEN doc_id % 8 = 0 AND nct_id <> '' THEN 'NCT9' || substr(nct_id, 5) ELSE nct_id END AS nct_id,
         CASE WHEN doc_id % 5 = 0 THEN 'New ' || brief_title ELSE brief_title END AS brief_title,
         CASE WHEN doc_id % 3 = 0 AND overall_status <> 'UNKNOWN' THEN 'ACTIVE' ELSE overall_status END AS overall_status,
         concat_ws(chr(10) || chr(10), brief_summary, CASE WHEN doc_id % 15 = 0 THEN 'Amended. ' || text ELSE text END) AS body,
         doc_id % 5 = 0 OR (doc_id % 3 = 0 AND overall_status <> 'UNKNOWN') OR doc_id % 8 = 0 AS differs
  FROM studies WHERE nct_id <> ''),
first AS (
  SELECT doc_id, nct_id, brief_title, overall_status, concat_ws(chr(10) || chr(10), brief_summary, text) AS body FROM studies WHERE nct_id <> '')"""

ANSWERS = f"""answers AS (
  SELECT conv_id, turn, query, query_id, n_evidence, CASE WHEN conv_id % 7 = 0 THEN ' NOT_ENOUGH_EVIDENCE' || chr(10)
    WHEN conv_id % 3 = 0 THEN cited || ' Also see the second [0] and the late source [42].'
    WHEN conv_id % 5 = 0 THEN cited || ' This closing statement carries no marker.' ELSE cited END AS text
  FROM (SELECT conv_id, turn, text AS query, conv_id || ':' || turn AS query_id, least(turn, 8) AS n_evidence,
      regexp_replace(text, '([.!?])(\\s|\\z)', ' [' || (1 + turn % 3) || CASE WHEN turn % 2 = 0 THEN ', 1]' ELSE ']' END || '\\1\\2', 'g') AS cited
    FROM conversations WHERE role = 'assistant')),
evidence AS (
  SELECT a.query_id, r.rank, e.conv_id AS document_id, e.turn AS chunk_index, CASE WHEN e.role = 'user' THEN 'trial' ELSE 'publication' END AS source_type,
         CASE WHEN e.role = 'user' THEN {nct('e.conv_id * 10 + e.turn')} ELSE CAST(e.conv_id * 10 + e.turn AS VARCHAR) END AS source_identifier,
         e.role AS title, e.text AS excerpt
  FROM answers a CROSS JOIN (SELECT unnest(range(1, 9)) AS rank) r JOIN conversations e ON e.conv_id = a.conv_id AND e.turn = a.turn - r.rank)"""

GROUP = r"\[([0-9]+(?:\s*,\s*[0-9]+)*)\]"
INDICES = (
    f"list_transform(flatten(list_transform(regexp_extract_all(text, '{GROUP}', 1), lambda g: string_split(g, ','))), lambda n: CAST(trim(n) AS BIGINT))"
)
FIRST_SEEN = "list_filter(all_cited, lambda c, i: list_position(all_cited, c) = i)"
CITED = f"""cited AS (
  SELECT *, {FIRST_SEEN} AS cited FROM (SELECT *, {INDICES} AS all_cited FROM (SELECT * REPLACE (trim(text, {BLANK}) AS text) FROM answers)))"""


def sentences(text: str) -> str:
    split = f"string_split(regexp_replace(trim({text}, {BLANK}), '([.!?])\\s+', '\\1' || chr(31), 'g'), chr(31))"
    return f"list_filter(list_transform({split}, lambda s: trim(s, {BLANK})), lambda s: s <> '')"


CHECKED = CITED + f""",
checked AS (
  SELECT *, list_filter(cited, lambda i: i < 1 OR i > n_evidence) AS invalid,
         list_filter({sentences('text')}, lambda s: length(s) >= 25 AND NOT regexp_matches(s, '{GROUP}')) AS uncited FROM cited),
final AS (
  SELECT *, CASE WHEN n_evidence = 0 OR text = 'NOT_ENOUGH_EVIDENCE' THEN 'insufficient_evidence'
    WHEN len(invalid) = 0 AND len(uncited) = 0 THEN 'answered' ELSE 'validation_failed' END AS status FROM checked)"""
WARNINGS = f"""CASE WHEN n_evidence = 0 THEN [{quoted(gr.NO_EVIDENCE_WARNING)}] WHEN status = 'insufficient_evidence' THEN [{quoted(gr.ABSTAINED_WARNING)}]
  WHEN status = 'answered' THEN []::VARCHAR[] ELSE list_filter([
    CASE WHEN len(invalid) > 0 THEN 'cited numbers without evidence: ' || array_to_string(list_transform(invalid, lambda i: '[' || i || ']'), ', ') END,
    CASE WHEN len(uncited) > 0 THEN 'sentences without a citation: ' || len(uncited) END], lambda w: w IS NOT NULL) END"""


def block(number: str, excerpt: str, label: str | None) -> str:
    safe = f"replace(replace({excerpt}, '</retrieved_chunk>', '<' || {ZW} || 'retrieved_chunk' || {ZW} || '>'), '<retrieved_chunk', '<' || {ZW} || 'retrieved_chunk')"
    source = f" || ' source=\"' || {label} || '\"'" if label else ""
    return f"'<retrieved_chunk index=\"' || {number} || '\"'{source} || '>' || chr(10) || {safe} || chr(10) || '</retrieved_chunk>'"


BREAK = "chr(10) || chr(10)"
PAIRS = f"""pairs AS (
  SELECT doc_id AS pair_id, {nct('doc_id')} AS nct_a, {nct('doc_id + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END')} AS nct_b,
         CASE WHEN doc_id % 4 = 0 THEN 'Compare dosing in ' || lang ELSE {quoted(cmp.DEFAULT_QUESTION)} END AS question FROM documents),
known AS (SELECT source_identifier AS nct_id FROM docs WHERE source_type = 'trial'),
checked_pairs AS (
  SELECT *, CASE WHEN nct_a NOT IN (SELECT nct_id FROM known) THEN 'not_found_a' WHEN nct_b NOT IN (SELECT nct_id FROM known) THEN 'not_found_b' ELSE 'ok' END AS status FROM pairs),
heads AS (
  SELECT source_identifier AS nct_id, chunk_index AS place, chunks.text AS excerpt, source_identifier FROM chunks JOIN docs USING (document_id)
  WHERE source_type = 'trial' AND chunk_index < {settings.MAX_CHUNKS_PER_TRIAL}),
numbered AS (
  SELECT pair_id, side, nct_a, nct_b, source_identifier, excerpt, row_number() OVER (PARTITION BY pair_id ORDER BY side, place) AS rank FROM (
    SELECT p.*, 'A' AS side, h.* FROM checked_pairs p JOIN heads h ON h.nct_id = p.nct_a UNION ALL
    SELECT p.*, 'B' AS side, h.* FROM checked_pairs p JOIN heads h ON h.nct_id = p.nct_b))"""

TRUTH = f"""truth AS (
  SELECT DISTINCT query_id AS id, source_identifier FROM
    (SELECT source_identifier, unnest(list_filter({sentences('text')}, lambda s: length(s) >= 40)) AS sentence FROM docs) d
    JOIN (SELECT query_id, unnest(list_filter({sentences('text')}, lambda s: length(s) >= 40)) AS sentence FROM asked) q USING (sentence)),
labelled AS (SELECT query_id AS id, text AS question, query_id IN (SELECT id FROM truth) AS expect_answerable FROM asked)"""


def result_ctes(found: str, name: str) -> str:
    """Per-question results over the evidence rows ``found`` (scripted answers cite every block)."""
    return f"""{name} AS (
  SELECT id AS question_id, question, expect_answerable, CASE WHEN n_hits > 0 THEN 'answered' ELSE 'insufficient_evidence' END AS status,
    n_true, coalesce(n_docs, 0) AS n_cited,
    CASE WHEN n_true > 0 THEN coalesce(in_5, 0) / n_true END AS recall_at_5,
    CASE WHEN n_true > 0 THEN coalesce(1.0::DOUBLE / first_place, 0.0::DOUBLE) END AS reciprocal_rank,
    CASE WHEN n_hits > 0 THEN right_docs / n_docs END AS citation_correctness,
    CASE WHEN n_hits > 0 THEN CASE WHEN n_true > 0 THEN right_docs / n_true ELSE 1.0::DOUBLE END END AS citation_completeness
  FROM (SELECT l.*, (SELECT count(*) FROM truth t WHERE t.id = l.id) AS n_true FROM labelled l)
  LEFT JOIN (
    SELECT query_id, sum(hits) AS n_hits, count(*) AS n_docs, count_if(hit) AS right_docs, count_if(hit AND place <= 5) AS in_5, min(CASE WHEN hit THEN place END) AS first_place
    FROM (SELECT o.*, EXISTS (SELECT 1 FROM truth t WHERE t.id = o.query_id AND t.source_identifier = o.source_identifier) AS hit FROM (
      SELECT query_id, source_identifier, count(*) AS hits, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS place FROM {found} GROUP BY query_id, source_identifier) o)
    GROUP BY query_id) r ON r.query_id = id)"""


RESULT_COLUMNS = "question_id, expect_answerable, status, n_true, n_cited, round(recall_at_5, 9) AS recall_at_5, round(reciprocal_rank, 9) AS reciprocal_rank, round(citation_correctness, 9) AS citation_correctness, round(citation_completeness, 9) AS citation_completeness"
SUMMARY_COLUMNS = """count(*) AS questions, count_if(expect_answerable) AS answerable, round(avg(CASE WHEN expect_answerable THEN recall_at_5 END), 9) AS mean_recall_at_5,
  round(avg(CASE WHEN expect_answerable THEN reciprocal_rank END), 9) AS mrr, round(avg(citation_correctness), 9) AS mean_citation_correctness,
  round(avg(citation_completeness), 9) AS mean_citation_completeness, round(avg(CAST(expect_answerable = (status = 'answered') AS DOUBLE)), 9) AS abstention_accuracy,
  count_if(expect_answerable AND status = 'answered') AS true_positive, count_if(NOT expect_answerable AND status = 'answered') AS false_positive,
  count_if(NOT expect_answerable AND status <> 'answered') AS true_negative, count_if(expect_answerable AND status <> 'answered') AS false_negative"""


def results_sql(mode: str) -> str:
    return f"WITH RECURSIVE {search_ctes(mode, settings.ANSWER_TOP_K)},\n{TRUTH},\n{result_ctes('found', 'results')}\n"


def all_modes() -> str:
    pool, k = settings.CANDIDATE_POOL, settings.ANSWER_TOP_K
    parts = [DOCS, CHUNKS, QUESTIONS, CHUNK_LEXEMES, QUESTION_LEXEMES, fulltext_cte(pool), CHUNK_VECTORS, QUESTION_VECTORS, dense_cte(pool), TRUTH]
    lists = {"hybrid": [("fulltext", "ft"), ("dense", "de")], "fulltext": [("fulltext", "ft")], "dense": [("dense", "de")]}
    for mode, cts in lists.items():
        parts += [fuse_ctes(cts, k, f"found_{mode}"), result_ctes(f"found_{mode}", f"results_{mode}")]
    union = " UNION ALL ".join(f"SELECT '{m}' AS mode, * FROM results_{m}" for m in lists)
    return f"WITH RECURSIVE {', '.join(parts)}\nSELECT mode, {SUMMARY_COLUMNS} FROM ({union}) GROUP BY mode"


def shown(value: str) -> str:
    return f"coalesce(printf('%.3f', {value}), 'n/a')"


TABLE_ROW = "question_id || CASE WHEN expect_answerable THEN ' with truth' ELSE ' without truth' END || '; ' || status || " + " || ".join(
    f"'; {name} ' || {shown(column)}" for name, column in evaluation.CELLS.items()
)


def report_sql() -> str:
    run = [f"run of {FIRST_BATCH}", "search: dense, vectors: hashing", "responder: scripted", *[f"note: {n}" for n in evaluation.evaluation_notes("dense", True)]]
    figures = ["'questions = ' || questions", "'questions with truth = ' || answerable", *(f"'{n} = ' || {c}" for n, c in evaluation.COUNTS.items()), *(f"'{n} = ' || {shown(c)}" for n, c in evaluation.MEANS.items())]

    def listed(section: int, lines: list[str]) -> str:
        return f"SELECT {section} AS section, lpad(CAST(i - 1 AS VARCHAR), 5, '0') AS position, lines[i] AS line FROM (SELECT [{', '.join(lines)}] AS lines FROM totals), range(1, {len(lines) + 1}) r(i)"

    return results_sql("dense") + f""", totals AS (SELECT {SUMMARY_COLUMNS} FROM results)
{listed(0, [quoted(line) for line in run])} UNION ALL {listed(1, figures)}
UNION ALL SELECT 2, CASE WHEN regexp_full_match(CAST(question_id AS VARCHAR), '[0-9]{{1,20}}') THEN lpad(CAST(question_id AS VARCHAR), 20, '0') ELSE '' END || ':' || question_id, {TABLE_ROW} FROM results"""


LISTS = """lists AS (
  SELECT conv_id || ':' || turn AS query_id, list_transform(range(0, turn + 1), lambda t: t * 2) AS retrieved,
    list_filter(list_transform(range(0, turn + 1), lambda t: t * 3 + conv_id % 5), lambda v: v % 4 <> 0 AND conv_id % 5 <> 4) AS relevant,
    CASE WHEN turn % 3 = 0 THEN []::BIGINT[] ELSE list_transform(range(0, turn + 1), lambda t: t * t % 7) END AS cited FROM conversations)"""


def recall(k: int) -> str:
    return f"CASE WHEN len(relevant) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(retrieved[:{k}], relevant)) / len(list_distinct(relevant)) END" if k else "CASE WHEN len(relevant) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


RECIPROCAL = "coalesce(1.0::DOUBLE / list_min(list_filter(list_transform(relevant, lambda r: list_position(retrieved, r)), lambda p: p > 0)), 0.0::DOUBLE)"


def group_sql(ctes: str, source_type: str) -> str:
    return f"""WITH RECURSIVE {ctes},
hits AS (SELECT * FROM found WHERE source_type = '{source_type}'),
names AS (SELECT query_id, source_identifier, array_to_string(list(m ORDER BY seen), '|') AS matched_by FROM (
  SELECT query_id, source_identifier, m, min(rank * 10 + i) AS seen FROM (
    SELECT query_id, source_identifier, rank, unnest(string_split(matched_by, '|')) AS m, unnest(range(0, len(string_split(matched_by, '|')))) AS i FROM hits) GROUP BY ALL) GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, min(rank)) AS place, source_identifier, min(title) AS title, round(max(score), 9) AS best_score, min(names.matched_by) AS matched_by,
  count(*) AS n_excerpts, array_to_string(list(chunk_index ORDER BY score DESC, rank), '|') AS chunks
FROM hits JOIN names USING (query_id, source_identifier) GROUP BY query_id, source_identifier"""


def truncated(length: int) -> str:
    text, cut = f"trim(text, {BLANK})", f"substr(trim(text, {BLANK}), 1, {length})"
    tail = f"strpos(reverse({cut}), ' ')"
    return f"md5(CASE WHEN length({text}) <= {length} THEN {text} ELSE rtrim(CASE WHEN {tail} > 0 AND {length} - {tail} > 0 THEN substr({text}, 1, {length} - {tail}) ELSE {cut} END, {BLANK}) || {ELLIPSIS} END)"


FINDINGS = f"""trials AS (SELECT {nct('doc_id - doc_id % 22')} AS nct_id FROM documents WHERE doc_id % 2 = 0 AND lang <> 'de'),
publications AS (SELECT CAST(doc_id AS VARCHAR) AS pmid, CASE WHEN doc_id % 3 = 0 THEN '10.1/' || (doc_id - doc_id % 9) END AS doi, CASE WHEN doc_id % 5 = 0 THEN {nct('doc_id + 1')} END AS linked_trial_id
  FROM documents WHERE doc_id % 2 = 1 AND lang <> 'es'),
d AS (SELECT doc_id AS document_id, CASE WHEN doc_id % 31 = 0 THEN 'report' WHEN doc_id % 2 = 0 THEN 'trial' ELSE 'publication' END AS source_type,
  CASE WHEN doc_id % 2 = 0 OR doc_id % 17 = 0 THEN {nct('doc_id')} END AS trial_id, CASE WHEN doc_id % 2 = 1 THEN CAST(doc_id AS VARCHAR) END AS publication_id FROM documents),
pieces AS (SELECT conv_id AS document_id, greatest(turn, 1) AS chunk_index, CASE WHEN turn = 3 THEN 0 ELSE length(text) END AS char_end FROM conversations),
citations AS (SELECT conv_id || ':' || turn AS chunk_id, CASE WHEN turn % 2 = 0 THEN 5 END AS s, CASE WHEN turn % 4 = 0 THEN 5 ELSE 9 END AS e FROM conversations)
SELECT 'trial_key_unique' AS rule, nct_id AS key, count(*) AS n FROM trials GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'publication_key_unique', pmid, count(*) FROM publications GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'doi_unique', doi, count(*) FROM publications WHERE doi IS NOT NULL GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'source_type_known', CAST(document_id AS VARCHAR), 1 FROM d WHERE source_type = 'report'
UNION ALL SELECT 'document_one_source', CAST(document_id AS VARCHAR), 1 FROM d WHERE source_type = 'report' OR (trial_id IS NOT NULL AND publication_id IS NOT NULL)
UNION ALL SELECT 'one_document_per_trial', trial_id, count(*) FROM d WHERE source_type = 'trial' GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'one_document_per_publication', publication_id, count(*) FROM d WHERE source_type = 'publication' GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'document_trial_exists', trial_id, count(*) FROM d WHERE source_type = 'trial' AND trial_id NOT IN (SELECT nct_id FROM trials) GROUP BY ALL
UNION ALL SELECT 'document_publication_exists', publication_id, count(*) FROM d WHERE source_type = 'publication' AND publication_id NOT IN (SELECT pmid FROM publications) GROUP BY ALL
UNION ALL SELECT 'linked_trial_exists', linked_trial_id, count(*) FROM publications WHERE linked_trial_id IS NOT NULL AND linked_trial_id NOT IN (SELECT nct_id FROM trials) GROUP BY ALL
UNION ALL SELECT 'chunk_unique', document_id || '|' || chunk_index, count(*) FROM pieces GROUP BY document_id, chunk_index HAVING count(*) > 1
UNION ALL SELECT 'chunk_range', document_id || '|' || chunk_index, 1 FROM pieces WHERE char_end <= 0
UNION ALL SELECT 'chunk_document_exists', CAST(document_id AS VARCHAR), count(*) FROM pieces WHERE document_id NOT IN (SELECT document_id FROM d) GROUP BY document_id
UNION ALL SELECT 'citation_chunk_exists', chunk_id, count(*) FROM citations WHERE chunk_id NOT IN (SELECT document_id || ':' || chunk_index FROM pieces) GROUP BY chunk_id
UNION ALL SELECT 'citation_range', chunk_id, 1 FROM citations WHERE s IS NOT NULL AND e <= s"""

EDITED = chunk_ctes(
    """SELECT doc_id AS document_id, CASE WHEN doc_id % 5 = 0 THEN 'Erratum. ' || text WHEN doc_id % 5 = 1 THEN substr(text, 1, length(text) // 2)
    WHEN doc_id % 5 = 2 THEN text || ' ' || text WHEN doc_id % 50 = 3 THEN ' ' || chr(10) || ' ' ELSE text END AS text FROM documents""",
    "fresh",
)
DIFF = f"""{CHUNKS}, {EDITED},
diff AS (SELECT document_id, chunk_index, CASE WHEN c.text IS NULL THEN 'created' WHEN f.text IS NULL THEN 'deleted' WHEN f.text = c.text THEN 'unchanged' ELSE 'updated' END AS action,
  coalesce(f.text, c.text) AS text, CASE WHEN f.text = c.text THEN c.char_start ELSE f.char_start END AS char_start, CASE WHEN f.text = c.text THEN c.char_end ELSE f.char_end END AS char_end
  FROM fresh f FULL JOIN chunks c USING (document_id, chunk_index))"""

ORACLE_SQL: dict[str, str] = {
    "s1_page_ranges": "SELECT lang || ' ' || source AS brief_title, n_chars, (doc_id % 10000) // 2 AS position FROM documents WHERE doc_id % 2 = 0",
    "s1_rejected_studies": "SELECT CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS position, CASE WHEN doc_id % 3 = 0 THEN 'studies list is cut off' ELSE 'page has no list of studies' END AS reason, count(*) AS n_pages FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0 GROUP BY ALL",
    "s1_study_pages": "SELECT lang || ' ' || source AS brief_title, n_chars, (doc_id % 400) // 2 AS position FROM documents WHERE doc_id % 2 = 0",
    "s2_study_filter": f"WITH {STUDIES} SELECT doc_id AS seq, nct_id, overall_status FROM studies WHERE overall_status = 'COMPLETED' AND source LIKE '%src1%' AND doc_id % 3 = 0 AND doc_id % 10 <> 0",
    "s3_article_ids": "SELECT doc_id, CAST(doc_id AS VARCHAR) AS pmid FROM documents WHERE doc_id % 2 = 1 AND lang = 'fr'",
    "s4_article_sets": "SELECT CAST(doc_id AS VARCHAR) AS pmid, true AS same_text FROM documents WHERE doc_id % 2 = 1",
    "s5_question_set": "SELECT CAST(item_id AS VARCHAR) AS id, md5(text) AS question_md5, item_id % 2 = 0 AS expect_answerable, CAST(1 - item_id % 2 AS BIGINT) AS n_relevant, CASE WHEN item_id % 3 = 0 THEN 'shared text' ELSE '' END AS ground_truth_basis FROM benchmark",
    "s6_seed_corpus": f"""WITH {STUDIES}, {ARTICLES} SELECT 'trial:' || nct_id AS document_id, 'trial' AS source_type, nct_id AS source_identifier, md5(concat_ws(chr(10) || chr(10), brief_summary, text)) AS text_md5 FROM studies WHERE nct_id <> ''
UNION ALL SELECT 'publication:' || pmid, 'publication', pmid, md5(coalesce({ABSTRACT}, '')) FROM articles""",
    "s7_snapshot_table": f"WITH {DOCS} SELECT document_id, source_type, source_identifier, upper(title) AS title, sha256(source_identifier || ':' || text) AS content_hash FROM docs",
    "s8_report_file": results_sql("dense") + f"SELECT {TABLE_ROW} AS line FROM results",
    "n1_sha256": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "n2_canonical_json": r"""SELECT doc_id, '{"a":[true,null,{"x":"a\nb","y":1.5}],"n":' || n_chars || ',"z":{"lang":"' || lang || '","source":"' || source || '"}}' AS canonical FROM documents""",
    "n3_partial_dates": f"SELECT doc_id, {parsed_date('doc_id')} AS parsed FROM documents",
    "n4_registry_dates": f"SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN {parsed_date('doc_id')} END AS parsed FROM documents",
    "n5_nct_ids": f"SELECT doc_id, {nct('doc_id + 2')} || '|' || {nct('doc_id')} AS nct_ids FROM documents",
    "n6_trials": f"""WITH {STUDIES} SELECT doc_id AS seq, nct_id, 'https://clinicaltrials.gov/study/' || nct_id AS source_url, brief_title, CASE WHEN doc_id % 3 <> 0 THEN source END AS official_title, overall_status,
  CASE WHEN doc_id % 4 = 0 THEN 'PHASE1/PHASE2' WHEN doc_id % 3 = 0 THEN 'PHASE3' END AS phase, 'INTERVENTIONAL' AS study_type, source || '|general' AS conditions,
  CASE WHEN doc_id % 10 = 0 THEN '' WHEN doc_id % 3 = 0 THEN lang || '|Placebo' ELSE lang END AS intervention_names, source AS sponsor_name, n_chars AS enrollment_count,
  {parsed_date('doc_id')} AS start_date, {parsed_date('doc_id + 1')} AS primary_completion_date, {parsed_date('doc_id + 2')} AS completion_date,
  CASE WHEN doc_id % 8 <> 0 THEN {parsed_date('doc_id + 3')} END AS last_update_posted_date, brief_summary, md5(text) AS description_md5, lang AS measure, '12 weeks' AS time_frame, CAST(0 AS BIGINT) AS n_secondary FROM studies""",
    "n7_trial_text": f"WITH {STUDIES} SELECT doc_id AS seq, md5(body) AS text_md5, length(body) AS n FROM (SELECT doc_id, concat_ws(chr(10) || chr(10), brief_summary, text) AS body FROM studies)",
    "n8_leading_text": f"WITH {ARTICLES} SELECT doc_id AS seq, 'On ' || source AS title, 'Journal ' || lang AS journal FROM articles",
    "n9_article_dates": f"""WITH {ARTICLES} SELECT doc_id AS seq, CASE WHEN doc_id % 3 = 0 THEN {try_date(YEAR, '2', DAY)} WHEN doc_id % 5 = 0 THEN {try_date(YEAR, '1', '1')}
  WHEN doc_id % 4 = 1 THEN {try_date(YEAR, MONTH, DAY)} ELSE {try_date(YEAR, MONTH, '1')} END AS publication_date, {YEAR} AS publication_year FROM articles""",
    "n10_months": "SELECT doc_id, CAST([1, 2, 3, 4, 12, 1, 7, 1, 12, 1][doc_id % 10 + 1] AS BIGINT) AS month FROM documents",
    "n11_abstracts": f"WITH {ARTICLES} SELECT doc_id AS seq, md5({ABSTRACT}) AS abstract_md5, length({ABSTRACT}) AS n FROM articles",
    "n12_authors": f"WITH {ARTICLES} SELECT doc_id AS seq, source || CASE WHEN doc_id % 3 <> 0 THEN ' ' || upper(lang) ELSE '' END || CASE WHEN doc_id % 9 = 0 THEN '|Group A' ELSE '' END AS authors FROM articles",
    "n13_doi": f"WITH {ARTICLES} SELECT doc_id AS seq, CASE WHEN doc_id % 3 <> 1 THEN '10.1/' || doc_id END AS doi FROM articles",
    "n14_mesh_terms": f"WITH {ARTICLES} SELECT doc_id AS seq, lang AS mesh_terms FROM articles",
    "n15_linked_ids": f"WITH {ARTICLES} SELECT doc_id AS seq, array_to_string({LINKED}, '|') AS linked_nct_ids FROM articles",
    "n16_publications": f"WITH {ARTICLES} SELECT doc_id AS seq, pmid, 'https://pubmed.ncbi.nlm.nih.gov/' || pmid || '/' AS source_url, 'On ' || source AS title, CASE WHEN doc_id % 3 <> 1 THEN '10.1/' || doc_id END AS doi, true AS parsed, true AS hash_of_raw FROM articles",
    "n17_publication_text": f"WITH {ARTICLES} SELECT doc_id AS seq, md5(coalesce({ABSTRACT}, '')) AS text_md5 FROM articles",
    "d1_classify": "SELECT doc_id, CASE WHEN lang <> 'en' THEN 'new' WHEN doc_id % 3 = 0 THEN 'updated' ELSE 'unchanged' END AS action FROM documents",
    "d2_hash_collisions": "SELECT sha256(text) AS content_hash, count(*) OVER (PARTITION BY text) AS n_ids, doc_id AS source_id FROM documents QUALIFY n_ids > 1",
    "d3_upsert_trials": f"""WITH {STUDIES}, {SECOND} SELECT nct_id, coalesce(s.brief_title, f.brief_title) AS brief_title, coalesce(s.overall_status, f.overall_status) AS overall_status,
  CASE WHEN f.nct_id IS NULL THEN '{SECOND_BATCH}' ELSE '{FIRST_BATCH}' END AS created_at, CASE WHEN s.nct_id IS NOT NULL AND (f.nct_id IS NULL OR s.differs) THEN '{SECOND_BATCH}' ELSE '{FIRST_BATCH}' END AS updated_at
FROM second s FULL JOIN first f USING (nct_id)""",
    "d4_upsert_publications": f"""WITH {STUDIES}, {ARTICLES}, named AS (SELECT doc_id, unnest({LINKED}) AS nct_id FROM articles), linked AS (SELECT n.doc_id, min(n.nct_id) AS l FROM named n JOIN studies s ON s.nct_id = n.nct_id GROUP BY n.doc_id HAVING count(*) = 1)
SELECT pmid, CASE WHEN doc_id % 3 = 0 THEN 'Corrected: ' ELSE '' END || 'On ' || source AS title, CASE WHEN doc_id % 3 = 0 THEN l END AS linked_trial_id,
  '{FIRST_BATCH}' AS created_at, CASE WHEN doc_id % 3 = 0 THEN '{SECOND_BATCH}' ELSE '{FIRST_BATCH}' END AS updated_at FROM articles LEFT JOIN linked USING (doc_id)""",
    "d5_linked_trials": f"""WITH named AS (SELECT doc_id, unnest(CASE doc_id % 3 WHEN 0 THEN [doc_id + 1] WHEN 1 THEN [doc_id + 1, doc_id + 3] ELSE []::BIGINT[] END) AS t FROM documents WHERE doc_id % 2 = 1),
one AS (SELECT n.doc_id, min(t) AS t FROM named n JOIN documents d ON d.doc_id = n.t AND d.lang = 'en' GROUP BY ALL HAVING count(*) = 1)
SELECT CAST(d.doc_id AS VARCHAR) AS pmid, {nct('t')} AS linked_trial_id FROM documents d LEFT JOIN one USING (doc_id) WHERE d.doc_id % 2 = 1""",
    "d6_upsert_documents": f"""WITH {STUDIES}, {SECOND} SELECT nct_id AS source_identifier, CASE WHEN f.body IS NULL OR f.body <> s.body THEN s.brief_title ELSE f.brief_title END AS title, md5(coalesce(s.body, f.body)) AS text_md5,
  CASE WHEN f.nct_id IS NULL THEN '{SECOND_BATCH}' ELSE '{FIRST_BATCH}' END AS created_at, CASE WHEN s.nct_id IS NOT NULL AND (f.nct_id IS NULL OR s.body <> f.body) THEN '{SECOND_BATCH}' ELSE '{FIRST_BATCH}' END AS updated_at
FROM second s FULL JOIN first f USING (nct_id)""",
    "x1_stream_ingest": f"""WITH {STUDIES}, {SECOND} SELECT nct_id AS source_identifier, CASE WHEN f.body IS NULL OR f.body <> s.body THEN s.brief_title ELSE f.brief_title END AS title, md5(coalesce(s.body, f.body)) AS text_md5
FROM second s FULL JOIN first f USING (nct_id)""",
    "d7_keyless_records": f"WITH {STUDIES} SELECT doc_id AS seq, brief_title FROM studies WHERE nct_id = ''",
    "d8_action_counts": "SELECT count_if(lang <> 'en') AS new, count_if(lang = 'en' AND doc_id % 3 = 0) AS updated, count_if(lang = 'en' AND doc_id % 3 <> 0) AS unchanged FROM documents",
    "d9_batch_duplicates": """WITH b AS (SELECT user_id, event_id, event_type, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), CASE WHEN user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN 'click' END) AS before FROM events)
SELECT user_id, event_id, CASE WHEN before IS NULL THEN 'new' WHEN before = event_type THEN 'unchanged' ELSE 'updated' END AS action FROM b""",
    "d10_last_hashes": "SELECT sha256(t) AS content_hash, count(*) OVER (PARTITION BY t) AS n_ids, user_id AS source_id FROM (SELECT user_id, arg_max(event_type, event_id) AS t FROM events GROUP BY user_id) QUALIFY n_ids > 1",
    "d11_violations": "WITH " + FINDINGS,
    "d11_foreign_keys": """SELECT 'line_order_exists' AS rule, CAST(l_orderkey AS VARCHAR) AS key, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY l_orderkey
UNION ALL SELECT 'order_customer_exists', CAST(o_custkey AS VARCHAR), count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_custkey
UNION ALL SELECT 'order_unique', CAST(o_orderkey AS VARCHAR), count(*) FROM orders GROUP BY o_orderkey HAVING count(*) > 1""",
    "d12_cascade_delete": f"""WITH RECURSIVE {CHUNKS}, live AS (SELECT doc_id AS document_id FROM documents WHERE lang <> 'fr'), kept AS (SELECT count(*) AS n FROM chunks WHERE document_id IN (SELECT document_id FROM live))
SELECT 'documents' AS kept_table, count(*) AS n FROM live UNION ALL SELECT 'chunks', n FROM kept UNION ALL SELECT 'citations', n FROM kept
UNION ALL SELECT 'publications', count(*) FROM live WHERE document_id % 2 = 1
UNION ALL SELECT 'linked', count(*) FROM live WHERE document_id % 2 = 1 AND document_id + 1 NOT IN (SELECT doc_id FROM documents WHERE lang = 'fr')""",
    "r1_chunks": f"WITH RECURSIVE {CHUNKS} SELECT document_id, chunk_index, char_start, char_end, sha256(text) AS content_hash FROM chunks",
    "r2_index_diff": f"WITH RECURSIVE {DIFF} SELECT document_id, chunk_index, action FROM diff",
    "r2_index_apply": f"""WITH RECURSIVE {DIFF}, left_over AS (SELECT * FROM diff WHERE action <> 'deleted'), {vector_ctes('left_over', 'document_id, chunk_index', 'lv')}
SELECT document_id, chunk_index, char_start, char_end, sha256(text) AS content_hash, norm2 FROM left_over JOIN lv_norm USING (document_id, chunk_index)""",
    "r3_index_totals": f"WITH RECURSIVE {DIFF} SELECT (SELECT count(*) FROM documents) AS documents, count_if(action = 'created') AS created, count_if(action = 'updated') AS updated, count_if(action = 'unchanged') AS unchanged, count_if(action = 'deleted') AS deleted FROM diff",
    "r4_hash_vectors": f"""WITH RECURSIVE {CHUNKS}, {CHUNK_VECTORS}, packed AS (SELECT document_id, chunk_index, map_from_entries(list((bucket, v))) AS m FROM cv GROUP BY ALL)
SELECT document_id, chunk_index, array_to_string(list_transform(range(0, 256), lambda b: coalesce(m[b], 0)), ',') AS vector, norm2 FROM cv_norm LEFT JOIN packed USING (document_id, chunk_index)""",
    "r4_unit_vectors": f"""WITH {QUESTIONS}, {vector_ctes('asked', 'query_id', 'qv', 64)} SELECT query_id, round(sum((v / sqrt(norm2)) ** 2), 9) AS length2,
  round(CASE WHEN count(*) < 64 THEN greatest(max(v / sqrt(norm2)), 0) ELSE max(v / sqrt(norm2)) END, 9) AS largest, round(CASE WHEN count(*) < 64 THEN least(min(v / sqrt(norm2)), 0) ELSE min(v / sqrt(norm2)) END, 9) AS smallest
FROM qv JOIN qv_norm USING (query_id) GROUP BY query_id""",
    "r5_stored_vectors": f"""WITH flat AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(0, 64)) AS place FROM embeddings),
means AS (SELECT label, place, avg(v) AS m FROM flat GROUP BY ALL), mn AS (SELECT label, sum(m * m) AS n FROM means GROUP BY ALL), vn AS (SELECT vec_id, sum(v * v) AS n FROM flat JOIN documents ON doc_id = vec_id GROUP BY ALL),
scored AS (SELECT means.label, vec_id, sum(m * v) / sqrt(min(mn.n) * min(vn.n)) AS score FROM means JOIN (SELECT vec_id, place, v FROM flat) f USING (place) JOIN mn ON mn.label = means.label JOIN vn USING (vec_id) GROUP BY means.label, vec_id)
SELECT CAST(label AS BIGINT) AS query_id, vec_id AS document_id, round(score, 6) AS score, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM scored QUALIFY rank <= {settings.CANDIDATE_POOL}""",
    "r6_lexemes_simple": f"WITH RECURSIVE {CHUNKS}, {CHUNK_LEXEMES} SELECT document_id, chunk_index, lexeme, tf FROM cl",
    "r7_postings": f"""WITH RECURSIVE {CHUNKS}, words AS (SELECT document_id, chunk_index, unnest(w) AS lexeme, unnest(range(1, len(w) + 1)) AS position FROM (SELECT document_id, chunk_index, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM chunks))
SELECT lexeme, count(DISTINCT (document_id, chunk_index)) AS n_chunks, count(*) AS total_tf, min(position) AS first_position FROM words WHERE lexeme NOT IN ({STOP}) GROUP BY lexeme""",
    "r8_fulltext": f"WITH RECURSIVE {CHUNKS}, {QUESTIONS}, {CHUNK_LEXEMES}, {QUESTION_LEXEMES}, {fulltext_cte(settings.CANDIDATE_POOL)} SELECT query_id, document_id, chunk_index, round(score, 6) AS score, rank FROM ft",
    "r8_fulltext_words": f"""WITH RECURSIVE {CHUNKS}, asked AS (SELECT DISTINCT w AS query_id, w AS text FROM (SELECT unnest(regexp_extract_all(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[\\p{{L}}]{{4,}}')) AS w FROM pages)),
{CHUNK_LEXEMES}, {QUESTION_LEXEMES}, {fulltext_cte(settings.CANDIDATE_POOL)} SELECT query_id, document_id, chunk_index, round(score, 6) AS score, rank FROM ft""",
    "r9_dense": f"WITH RECURSIVE {CHUNKS}, {QUESTIONS}, {CHUNK_VECTORS}, {QUESTION_VECTORS}, {dense_cte(settings.CANDIDATE_POOL)} SELECT query_id, document_id, chunk_index, round(score, 9) AS score, rank FROM de",
    "r10_all_lists": f"WITH RECURSIVE {CHUNKS}, {QUESTIONS}, {CHUNK_VECTORS}, {QUESTION_VECTORS}, {dense_cte(settings.CANDIDATE_POOL)} SELECT query_id, document_id, chunk_index, round(score, 9) AS score, rank FROM de WHERE score IS NOT NULL",
    "r11_fusion": """WITH ranks AS (SELECT doc_id // 40 AS query_id, doc_id AS item, 0 AS source, n_chars % 97 + 1 AS rank FROM documents UNION ALL SELECT doc_id // 40, doc_id % 50, 1, doc_id % 211 + 1 FROM documents),
firsts AS (SELECT query_id, item, min(rank) FILTER (source = 0) AS rank_0, min(rank) FILTER (source = 1) AS rank_1 FROM ranks GROUP BY ALL)
SELECT query_id, item, round(coalesce(1.0::DOUBLE / (60 + rank_0), 0) + coalesce(1.0::DOUBLE / (60 + rank_1), 0), 9) AS score, rank_0, rank_1 FROM firsts""",
    "r12_search_hybrid": search_sql("hybrid"),
    "r12_search_fulltext": search_sql("fulltext"),
    "r12_search_dense": search_sql("dense"),
    "r13_load_results": f"WITH RECURSIVE {DOCS}, {CHUNKS} SELECT document_id % 10 AS query_id, document_id AS rank, source_identifier, title, md5(c.text) AS excerpt_md5 FROM docs d JOIN chunks c USING (document_id) WHERE chunk_index = document_id % 2",
    "r14_matched_by": f"WITH RECURSIVE {EVIDENCE} SELECT query_id, matcher, count(*) AS n FROM (SELECT query_id, unnest(string_split(matched_by, '|')) AS matcher FROM found) GROUP BY ALL",
    "r15_search_response": f"""WITH RECURSIVE {EVIDENCE} SELECT a.query_id, md5(any_value(a.text)) AS query_md5, 'hybrid' AS mode, count(f.rank) AS n, coalesce(array_to_string(list(source_identifier ORDER BY rank) FILTER (f.rank IS NOT NULL), '|'), '') AS sources
FROM asked a LEFT JOIN found f USING (query_id) GROUP BY a.query_id""",
    "g1_sanitize": f"""SELECT page_id, md5(replace(replace(replace(replace(html, '<p', '<retrieved_chunk'), '</p>', '</retrieved_chunk>'), '</retrieved_chunk>', '<' || {ZW} || 'retrieved_chunk' || {ZW} || '>'), '<retrieved_chunk', '<' || {ZW} || 'retrieved_chunk')) AS clean_md5,
  true AS no_end, true AS no_start FROM pages""",
    "g2_prompts": f"""WITH {ANSWERS}, b AS (SELECT query_id, count(*) AS n, array_to_string(list({block('rank', 'excerpt', "source_type || ':' || source_identifier")} ORDER BY rank), {BREAK}) AS blocks FROM evidence GROUP BY ALL)
SELECT query_id, coalesce(n, 0) AS n_evidence, md5(coalesce(blocks, '') || {BREAK} || 'Question: ' || query || {BREAK} || {quoted(gr.ANSWER_REQUEST)}) AS prompt_md5 FROM answers LEFT JOIN b USING (query_id)""",
    "g3_comparison_prompts": f"""WITH RECURSIVE {DOCS}, {CHUNKS}, {PAIRS}, b AS (SELECT pair_id, count(*) AS n, array_to_string(list({block('rank', 'excerpt', None)} ORDER BY rank) FILTER (side = 'A'), {BREAK}) AS a, array_to_string(list({block('rank', 'excerpt', None)} ORDER BY rank) FILTER (side = 'B'), {BREAK}) AS b FROM numbered GROUP BY ALL)
SELECT pair_id, coalesce(n, 0) AS n_evidence, md5({quoted(cmp.SIDE_HEADING.format("A"))} || nct_a || {BREAK} || coalesce(a, {quoted(cmp.NO_SIDE_EVIDENCE)}) || {BREAK} || {quoted(cmp.SIDE_HEADING.format("B"))} || nct_b || {BREAK} || coalesce(b.b, {quoted(cmp.NO_SIDE_EVIDENCE)}) || {BREAK} || {quoted(cmp.REQUEST_LINE)} || question || {BREAK} || {quoted(gr.ANSWER_REQUEST)}) AS prompt_md5
FROM checked_pairs LEFT JOIN b USING (pair_id)""",
    "g4_system_texts": "SELECT item_id, true AS answer_marker, true AS comparison_marker FROM benchmark",
    "g5_citation_indices": f"WITH {ANSWERS}, {CITED} SELECT query_id, array_to_string(cited, ',') AS cited FROM cited",
    "g6_resolve_citations": f"""WITH {ANSWERS}, {CITED}, flat AS (SELECT query_id, unnest(range(0, len(cited))) AS position, unnest(cited) AS citation_index FROM cited)
SELECT f.query_id, position, citation_index, e.rank IS NOT NULL AS is_valid, source_identifier FROM flat f LEFT JOIN evidence e ON e.query_id = f.query_id AND e.rank = citation_index""",
    "g7_sentences": f"SELECT conv_id, turn, unnest(range(0, len(s))) AS place, unnest(s) AS sentence FROM (SELECT conv_id, turn, {sentences('text')} AS s FROM conversations)",
    "g8_uncited_sentences": f"WITH {ANSWERS}, {CHECKED} SELECT query_id, unnest(uncited) AS sentence FROM checked",
    "g9_validate": f"WITH {ANSWERS}, {CHECKED} SELECT query_id, array_to_string(invalid, ',') AS invalid, len(uncited) AS n_uncited, len(invalid) = 0 AND len(uncited) = 0 AS is_valid FROM checked",
    "g10_finalize": f"""WITH {ANSWERS}, {CHECKED} SELECT query_id, status, md5(CASE status WHEN 'answered' THEN text WHEN 'insufficient_evidence' THEN {quoted(gr.INSUFFICIENT_TEXT)} ELSE {quoted(gr.FAILED_TEXT)} END) AS answer_md5,
  CASE WHEN status = 'answered' THEN array_to_string(cited, ',') ELSE '' END AS cited FROM final""",
    "g11_warnings": f"WITH {ANSWERS}, {CHECKED} SELECT query_id, unnest({WARNINGS}) AS warning FROM final",
    "g12_generate_answers": f"""WITH RECURSIVE {EVIDENCE}, n AS (SELECT query_id, count(*) AS n FROM found GROUP BY ALL)
SELECT query_id, CASE WHEN n IS NULL THEN 'insufficient_evidence' ELSE 'answered' END AS status, CASE WHEN n IS NULL THEN {quoted(gr.INSUFFICIENT_TEXT)} ELSE 'All evidence blocks of this self-test support the statement [' || array_to_string(range(1, n + 1), ', ') || '].' END AS answer, coalesce(n, 0) AS n_cited FROM asked LEFT JOIN n USING (query_id)""",
    "g13_trial_chunks": f"WITH RECURSIVE {DOCS}, {CHUNKS} SELECT source_identifier AS nct_id, chunk_index + 1 AS place, chunk_index, md5(c.text) AS excerpt_md5 FROM docs JOIN chunks c USING (document_id) WHERE source_type = 'trial' AND chunk_index < {settings.MAX_CHUNKS_PER_TRIAL}",
    "g13_trial_states": f"""WITH RECURSIVE {DOCS}, {CHUNKS}, n AS (SELECT document_id, count(*) AS n FROM chunks WHERE chunk_index < {settings.MAX_CHUNKS_PER_TRIAL} GROUP BY ALL)
SELECT source_identifier AS nct_id, CASE WHEN lang = 'en' THEN n ELSE 0 END AS n_chunks, CASE WHEN lang = 'en' THEN 'found' ELSE 'empty' END AS state FROM docs JOIN n USING (document_id) WHERE source_type = 'trial'""",
    "g14_scripted_answers": f"WITH {ANSWERS} SELECT query_id, CASE WHEN n_evidence = 0 THEN 'NOT_ENOUGH_EVIDENCE' ELSE 'All evidence blocks of this self-test support the statement [' || array_to_string(range(1, n_evidence + 1), ', ') || '].' END AS answer FROM answers",
    "g15_comparisons": f"""WITH RECURSIVE {DOCS}, {CHUNKS}, {PAIRS}, n AS (SELECT pair_id, count(*) AS n FROM numbered GROUP BY ALL)
SELECT pair_id, question, 'answered' AS status, array_to_string(range(1, n + 1), ',') AS cited FROM checked_pairs JOIN n USING (pair_id) WHERE status = 'ok'""",
    "g16_pair_status": f"WITH {DOCS}, pairs AS (SELECT doc_id AS a, doc_id + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS b, CASE WHEN doc_id % 4 = 0 THEN 'Compare dosing in ' || lang ELSE {quoted(cmp.DEFAULT_QUESTION)} END AS question FROM documents)\n"
    "SELECT a AS pair_id, CASE WHEN a % 2 = 1 THEN 'not_found_a' WHEN b % 2 = 1 OR b NOT IN (SELECT doc_id FROM documents) THEN 'not_found_b' ELSE 'ok' END AS status, question FROM pairs",
    "g17_answer_response": f"""WITH {ANSWERS}, {CHECKED}, flat AS (SELECT query_id, unnest(range(0, len(cited))) AS position, unnest(cited) AS i FROM final WHERE status = 'answered'),
nested AS (SELECT f.query_id, count(*) AS n, array_to_string(list(source_identifier ORDER BY position), '|') AS sources FROM flat f JOIN evidence e ON e.query_id = f.query_id AND e.rank = i GROUP BY ALL)
SELECT query_id, status, coalesce(n, 0) AS n_citations, coalesce(sources, '') AS sources, array_to_string({WARNINGS}, '|') AS warnings FROM final LEFT JOIN nested USING (query_id)""",
    "p1_group_by_source": group_sql(EVIDENCE, "trial"),
    "p2_publication_search": group_sql(search_ctes("hybrid", settings.GROUPED_SEARCH_K), "publication"),
    "p3_source_labels": f"WITH {DOCS} SELECT document_id, CASE WHEN source_type = 'publication' THEN 'PMID ' || source_identifier ELSE source_identifier END AS label, CASE WHEN source_type = 'publication' THEN 'Publication' ELSE 'Registered trial' END AS type_name FROM docs",
    "p4_score_text": "SELECT event_id, printf('%.4f', 1.0::DOUBLE / (60 + event_id)) AS shown FROM events",
    "p5_truncate": f"SELECT doc_id, {truncated(settings.CARD_EXCERPT_LENGTH)} AS card_md5, {truncated(settings.CITATION_EXCERPT_LENGTH)} AS citation_md5 FROM documents",
    "p6_answer_segments": f"""WITH {ANSWERS}, cut AS (SELECT query_id, list_filter(string_split(regexp_replace(text, '({GROUP.replace('([', '(?:[', 1)})', chr(31) || '\\1' || chr(31), 'g'), chr(31)), lambda p: p <> '') AS pieces FROM answers)
SELECT query_id, place, segment, CASE WHEN regexp_matches(segment, '^{GROUP}$') THEN regexp_replace(segment, '[^0-9,]', '', 'g') END AS indices FROM (SELECT query_id, unnest(range(0, len(pieces))) AS place, unnest(pieces) AS segment FROM cut)""",
    "p7_comparison_input": "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'missing_id' WHEN doc_id % 5 = 1 THEN 'malformed_id' WHEN doc_id % 3 = 0 THEN 'same_trial' END AS problem FROM documents",
    "p8_citation_sides": f"WITH RECURSIVE {DOCS}, {CHUNKS}, {PAIRS} SELECT pair_id, rank, side FROM numbered",
    "e1_question_problems": f"""WITH {DOCS}, {QUESTIONS}, {TRUTH}, q AS (SELECT CASE WHEN id % 10 = 9 THEN id - 1 ELSE id END AS id, CASE WHEN id % 8 = 3 THEN ' ' ELSE question END AS question, CASE WHEN id % 6 = 5 THEN NOT expect_answerable ELSE expect_answerable END AS expect FROM labelled),
planted AS (SELECT * FROM truth UNION ALL SELECT DISTINCT id, 'missing-' || id FROM q WHERE length(question) > 250), has AS (SELECT *, id IN (SELECT id FROM planted) AS h FROM q)
SELECT CAST(id AS VARCHAR) AS question_id, 'duplicate_id' AS problem, CAST(count(*) AS VARCHAR) AS detail FROM q GROUP BY id HAVING count(*) > 1
UNION ALL SELECT CAST(id AS VARCHAR), 'blank_question', '' FROM q WHERE trim(question) = ''
UNION ALL SELECT CAST(id AS VARCHAR), 'answerable_without_truth', '' FROM has WHERE expect AND NOT h
UNION ALL SELECT CAST(id AS VARCHAR), 'trap_with_truth', '' FROM has WHERE NOT expect AND h
UNION ALL SELECT CAST(id AS VARCHAR), 'unknown_identifier', source_identifier FROM planted WHERE source_identifier LIKE 'missing-%'
UNION ALL SELECT NULL, 'count_total', count(*) || '/20' FROM q HAVING count(*) <> 20
UNION ALL SELECT NULL, 'count_answerable', count_if(expect) || '/15' FROM q HAVING count_if(expect) <> 15
UNION ALL SELECT NULL, 'count_traps', count_if(NOT expect) || '/5' FROM q HAVING count_if(NOT expect) <> 5""",
    "e2_document_order": f"WITH RECURSIVE {EVIDENCE} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS place, source_identifier FROM found GROUP BY query_id, source_identifier",
    "e3_recall_at_k": f"WITH {LISTS} SELECT query_id, round({recall(0)}, 9) AS recall_0, round({recall(3)}, 9) AS recall_3, round({recall(5)}, 9) AS recall_5 FROM lists",
    "e4_reciprocal_rank": f"WITH {LISTS} SELECT query_id, round({RECIPROCAL}, 9) AS rr FROM lists",
    "e5_means": f"WITH {LISTS} SELECT round(avg({recall(5)}), 9) AS mean_recall, round(avg({RECIPROCAL}), 9) AS mrr FROM lists",
    "e6_citation_correctness": f"WITH {LISTS} SELECT query_id, round(CASE WHEN len(cited) = 0 THEN CASE WHEN len(relevant) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE len(list_intersect(cited, relevant)) / len(list_distinct(cited)) END, 9) AS correctness FROM lists",
    "e7_citation_completeness": f"WITH {LISTS} SELECT query_id, round(CASE WHEN len(relevant) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(cited, relevant)) / len(list_distinct(relevant)) END, 9) AS completeness FROM lists",
    "e8_abstention_accuracy": "SELECT round(avg(CAST((quality = 1) = (toxic = 0) AS DOUBLE)), 9) AS accuracy FROM labels",
    "e9_confusion_counts": """SELECT *, true_positive + true_negative + false_positive + false_negative AS total, round((true_positive + true_negative) / (true_positive + true_negative + false_positive + false_negative), 9) AS accuracy FROM (
SELECT count_if(quality = 1 AND toxic = 0) AS true_positive, count_if(quality <> 1 AND toxic = 0) AS false_positive, count_if(quality <> 1 AND toxic <> 0) AS true_negative, count_if(quality = 1 AND toxic <> 0) AS false_negative FROM labels)""",
    "e10_question_results": results_sql("hybrid") + f"SELECT {RESULT_COLUMNS} FROM results",
    "e11_report_aggregates": results_sql("hybrid") + f"SELECT {SUMMARY_COLUMNS} FROM results",
    "e12_run_evaluation": results_sql("fulltext") + f"SELECT * EXCLUDE (expect_answerable, n_true, n_cited) FROM (SELECT {RESULT_COLUMNS} FROM results)",
    "e13_cited_identifiers": f"""WITH {ANSWERS}, {CHECKED}, flat AS (SELECT query_id, unnest(range(0, len(cited))) AS position, unnest(cited) AS i FROM final WHERE status = 'answered'),
firsts AS (SELECT f.query_id, source_identifier, min(position) AS position FROM flat f JOIN evidence e ON e.query_id = f.query_id AND e.rank = i GROUP BY ALL)
SELECT query_id, array_to_string(list(source_identifier ORDER BY position), '|') AS sources FROM firsts GROUP BY query_id""",
    "e14_mode_sweep": all_modes(),
    "e15_report_lines": report_sql(),
    "g10_citation_table": f"""WITH {ANSWERS}, {CHECKED}, flat AS (SELECT query_id, unnest(cited) AS citation_index FROM final WHERE status = 'answered')
SELECT f.query_id, citation_index, document_id || ':' || chunk_index AS chunk_id, source_identifier, md5(excerpt) AS excerpt_md5, CAST(NULL AS INTEGER) AS excerpt_char_start
FROM flat f JOIN evidence e ON e.query_id = f.query_id AND e.rank = citation_index""",
}
ORACLE_SQL["r8_fulltext_postings"] = ORACLE_SQL["r8_fulltext"]
ORACLE_SQL["g12_ask"] = f"""WITH RECURSIVE {EVIDENCE}
SELECT a.query_id, CASE WHEN count(f.rank) > 0 THEN 'answered' ELSE 'insufficient_evidence' END AS status, array_to_string(list(source_identifier ORDER BY rank) FILTER (f.rank IS NOT NULL), '|') AS sources
FROM asked a LEFT JOIN found f USING (query_id) GROUP BY a.query_id"""
ORACLE_SQL["g16_compare"] = f"""WITH RECURSIVE {DOCS}, {CHUNKS}, {PAIRS}
SELECT p.pair_id, status, CASE WHEN status = 'ok' THEN count_if(side = 'A') END AS n_a, CASE WHEN status = 'ok' THEN count_if(side = 'B') END AS n_b
FROM checked_pairs p LEFT JOIN numbered n ON n.pair_id = p.pair_id GROUP BY p.pair_id, status"""
