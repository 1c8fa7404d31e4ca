"""Text, metadata and maintenance queries over documents, pages and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as X
from ..operators import chunking as C
from ..operators import maintenance as M
from ..operators import metadata as D
from ..operators import parents as P
from ..operators.structure import chunk_context, lines, section_context
from ..sources import loaders
from .registry import query


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words_rx(words) -> str:
    """An alternation of whole words for RE2."""
    import re

    return "|".join(r"\b" + re.escape(w).replace("\\ ", " ").replace("\\&", "&").replace("\\-", "-") + r"\b" for w in words)


STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
BARE = "regexp_replace(" + STRIP + r", '^[.,;:|()\[\]{{}}]+|[.,;:|()\[\]{{}}]+$', '', 'g')"
# Documents under a header that varies with the id, so that labels, ids and dates of all forms occur in every table.
HEADERS = (
    "Department: Human Resources\nPolicy ID: POL-HR-001\nEffective Date: 2024-03-05\n",
    "Owner: IT\nSee IT-SEC-2024-v2 for vpn and password rules.\nRevised: March 7, 2023\n",
    "Issued By: Legal & Compliance Board\nPolicy #5.2 applies.\nDate: 7th June 2021\n",
    "Division: Blue Team\nPolicy No. 77\nLast Updated 3/14/2022\n",
    "Payroll and tax notes. Payroll again; accounting, $1,200 per trip, 30 days notice period.\nHR-101 Effective May 2020\n",
    "Remote work and parental leave for every Manager and full-time employees: 12 weeks.\nDoc Ref 2021\n",
    "",
)
HEADED_SQL = "headed AS (SELECT doc_id, CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN {quoted(h)}" for i, h in enumerate(HEADERS)) + " END || text AS text FROM documents)"


def headed(t):
    head = F.element_at(F.array(*[F.lit(h) for h in HEADERS]), (F.col("doc_id") % 7 + 1).cast("int"))
    return t("documents").select("doc_id", F.concat(head, F.col("text")).alias("text"))


@query("SELECT doc_id, greatest(1, length(text) // 4) AS tokens FROM documents")
def token_estimate(t):
    return t("documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS clean FROM documents")
def clean_text(t):
    return t("documents").select("doc_id", X.clean_text(F.col("text")).alias("clean"))


@query("SELECT doc_id, left(sha256(text), 16) AS content_hash FROM documents")
def content_hash(t):
    return t("documents").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'legal' ELSE 'policy' END AS document_type, upper(source[1]) || source[2:] || ' ' || upper(lang[1]) || lang[2:] AS category FROM documents")
def doc_type_from_path(t):
    path = F.concat(F.when(F.col("doc_id") % 3 == 0, "legal/").otherwise("policies/"), F.col("source"), F.lit("_"), F.col("lang"), F.lit(".pdf"))
    return t("documents").select("doc_id", X.document_type(path).alias("document_type"), X.category_label(path).alias("category"))


@query(r"SELECT page_id, TRY_CAST(regexp_replace(regexp_extract(url, '[^/]*$'), '\D', '', 'g') AS INTEGER) AS page_number FROM pages")
def page_number_parse(t):
    return t("pages").select("page_id", X.page_number(F.regexp_extract("url", "[^/]*$", 0)).alias("page_number"))


NOISE_SQL = (
    f"(trim_l = '' OR trim_l IN ({', '.join(map(quoted, X.NOISE_PHRASES))}) OR "
    + " OR ".join(f"starts_with(trim_l, {quoted(p)})" for p in X.NOISE_PREFIXES)
    + r" OR regexp_matches(trim_l, '(?:\.{3,}|_{3,}|-{3,}|\s{4,})\s*\d+$') OR regexp_matches(trim_l, '^(?:page\s+)?[-–—\[(]?\s*\d+\s*[-–—\])]?$') OR length(regexp_replace(line, '[^\pL]', '', 'g')) < greatest(3, length(line) * 0.3))"
)
LINES_SQL = "ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM {src}), tl AS (SELECT *, lower(" + STRIP.format("line") + ") AS trim_l FROM ln)"


@query(f"WITH {LINES_SQL.replace('{src}', 'documents')} SELECT doc_id, line_no, {NOISE_SQL} AS noise FROM tl")
def noise_lines(t):
    return lines(t("documents")).select("doc_id", "line_no", X.is_noise_line(F.col("line")).alias("noise"))


# Sections of different depth in every document: a heading line before each of its first lines, by line number.
HEADING_LINES = ("# Handbook of Rules", "I. General Terms", "A. Scope and Purpose", "1.2 Leave of Absence", "Section 4.1: Notice of Leave", "SAFETY AND HEALTH RULES", "## Second Part", "II. Closing Terms", "3. Travel and Meals")
def headed_lines(t):
    """Every line of the whole texts as it is, with a heading of each form before each of the first ones."""
    head = F.array(*[F.lit(h) for h in HEADING_LINES])
    both = F.flatten(F.transform(F.split("text", "\n"), lambda x, i: F.when(i < len(HEADING_LINES), F.array(F.get(head, i), x)).otherwise(F.array(x))))
    return t("documents").select("doc_id", F.posexplode(both).alias("line_no", "line"))


# SQL can't express the tests of a heading: a brute-force stack stands against these.
@query()
def parse_headings(t):
    h = headed_lines(t).select("doc_id", "line_no", X.parse_heading(F.col("line")).alias("h")).filter("h is not null")
    return h.select("doc_id", "line_no", "h.level", F.when(F.col("h.number") != "", F.col("h.number")).alias("number"), "h.title", "h.pattern")


@query()
def section_contexts(t):
    return section_context(headed_lines(t)).select("doc_id", "line_no", "section_title", "section_level", "section_path")


@query()
def page_sections(t):
    """Five documents are the pages of a file: a section goes on over its pages, a page has the context in force at its end."""
    pages = headed_lines(t).select(F.floor(F.col("doc_id") / 5).alias("file"), F.col("doc_id").alias("page_number"), "line_no", "line")
    return section_context(pages, "file", F.struct("page_number", "line_no"), F.col("page_number")).groupBy("file", "page_number").agg(F.max_by("section_title", "line_no").alias("section_title"), F.max_by("section_path", "line_no").alias("section_path"))


@query()
def chunk_sections(t):
    """Chunks of a file in their order take on the section that the lines before them opened."""
    pages = headed_lines(t).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    chunks = C.chunk_recursive(pages).select(F.floor(F.col("doc_id") / 5).alias("source_file"), F.col("doc_id").alias("page_number"), "chunk_index", "text")
    return chunk_context(chunks).select("source_file", "page_number", "chunk_index", "section_title", "section_path")


@query("SELECT doc_id, CASE WHEN contains(text, '|---') OR (contains(text, '|') AND contains(text, chr(10) || '|')) THEN 'table' WHEN contains(text, '```') THEN 'markdown' WHEN doc_id % 5 = 0 THEN 'heading_aware' WHEN len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) > 200 THEN 'semantic' ELSE 'recursive' END AS strategy FROM documents")
def chunk_strategy(t):
    return t("documents").select("doc_id", C.chunk_strategy(F.col("text"), has_section=F.col("doc_id") % 5 == 0).alias("strategy"))


@query()
def chunk_semantic(t):
    return C.chunk_semantic(t("documents"))


@query()
def chunk_recursive(t):
    return C.chunk_recursive(t("documents"))


@query()
def chunk_heading(t):
    whole = headed_lines(t).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return C.chunk_heading(whole)


@query()
def chunk_adaptive(t):
    return C.chunk_adaptive(t("documents"), document_type=F.expr(TYPED), has_section=F.col("doc_id") % 17 == 0)


@query("SELECT doc_id, n, CASE WHEN n % 2 = 1 THEN 'code' ELSE 'text' END AS kind, block FROM (SELECT doc_id, unnest(string_split(CASE WHEN doc_id % 2 = 0 THEN 'see ```x = 1``` and ' ELSE '' END || text, '```')) AS block, unnest(range(0, len(string_split(CASE WHEN doc_id % 2 = 0 THEN 'see ```x = 1``` and ' ELSE '' END || text, '```')))) AS n FROM documents) WHERE regexp_replace(block, '^\\s+|\\s+$', '', 'g') <> ''")
def block_types(t):
    fenced = t("documents").select("doc_id", F.concat(F.when(F.col("doc_id") % 2 == 0, "see ```x = 1``` and ").otherwise(""), F.col("text")).alias("text"))
    return C.block_types(fenced).select("doc_id", "n", "kind", "block")


# Letters that aren't ASCII stand for word characters, as in Java and not in RE2.
PLAIN = "regexp_replace(lower({}), '[^\\x00-\\x7F\\PL]', '_', 'g')"
ALIAS_SCORES = ", ".join(
    "[" + " + ".join(f"3 * len(regexp_extract_all({PLAIN.format('left(text, 1000)')}, {quoted(words_rx([a]))})) + len(regexp_extract_all({PLAIN.format('text')}, {quoted(words_rx([a]))}))" for a in aliases) + f", -{i}]" for i, (_, aliases) in enumerate(R.DEPARTMENTS)
)


@query(
    f"WITH {HEADED_SQL}, s AS (SELECT doc_id, list_max([{ALIAS_SCORES}]) AS b FROM headed) SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'Human Resources' WHEN 1 THEN 'IT' WHEN 2 THEN 'Legal' WHEN 3 THEN 'Blue Team' ELSE CASE WHEN b[1] >= 1 THEN [{', '.join(quoted(n) for n, _ in R.DEPARTMENTS)}][1 - b[2]] ELSE 'General' END END AS department, "
    "round(CASE doc_id % 7 WHEN 0 THEN 0.95 WHEN 1 THEN 0.95 WHEN 2 THEN 0.9 WHEN 3 THEN 0.85 ELSE CASE WHEN b[1] >= 3 THEN least(0.85::DOUBLE, 0.6::DOUBLE + b[1] * 0.05::DOUBLE) WHEN b[1] >= 1 THEN 0.65 ELSE 0.5 END END::DOUBLE, 6) AS confidence FROM s"
)
def extract_department(t):
    return headed(t).select("doc_id", D.extract_department(F.col("text")).alias("d")).select("doc_id", "d.department", F.round("d.confidence", 6).alias("confidence"))


def id_sql(pattern: str, scan: str) -> str:
    p = quoted(pattern)
    return f"""list_filter(list_transform(list_zip(regexp_extract_all({scan}, {p}, 1), regexp_extract_all({scan}, {p}, 0)), lambda z:
CASE WHEN regexp_matches({BARE.format('z[1]')}, '^\\d+$') THEN CASE WHEN NOT regexp_matches({BARE.format('z[1]')}, '^(19|20)\\d\\d$') AND contains(lower(z[2]), 'policy') THEN 'Policy ' || {BARE.format('z[1]')} END
WHEN length({BARE.format('z[1]')}) >= 3 THEN {BARE.format('z[1]')} END), lambda x: x IS NOT NULL)[1]"""


def id_sql_first(pattern: str) -> str:
    b = BARE.format(f"regexp_extract(text, {quoted(pattern)}, 1)")
    return f"CASE WHEN regexp_matches(text, {quoted(pattern)}) AND NOT regexp_matches({b}, '^\\d+$') AND length({b}) >= 3 THEN {b} END"


@query(f"WITH {HEADED_SQL} SELECT doc_id, coalesce({', '.join(id_sql(p, 'left(text, 2000)') for p in R.POLICY_ID_PATTERNS)}, {', '.join(id_sql_first(p) for p in R.POLICY_ID_PATTERNS)}) AS policy_id FROM headed")
def extract_policy_id(t):
    return headed(t).select("doc_id", D.extract_policy_id(F.col("text")).alias("policy_id"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN strftime(o_orderdate, '%Y-%m-01') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders")
def normalize_date(t):
    form = [F.date_format("o_orderdate", f) for f in ("yyyy-MM-dd", "MM/dd/yyyy", "'on' MMMM d, yyyy", "d MMM yyyy", "MMMM yyyy")]
    raw = F.element_at(F.array(*form), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return t("orders").select("o_orderkey", D.normalize_date(raw).alias("iso"))


@query(f"WITH {HEADED_SQL} SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN '2024-03-05' WHEN 1 THEN '2023-03-07' WHEN 2 THEN '2021-06-07' WHEN 3 THEN '2022-03-14' WHEN 4 THEN '2020-05-01' END AS effective_date FROM headed")
def extract_effective_date(t):
    return headed(t).select("doc_id", D.extract_effective_date(F.col("text")).alias("effective_date"))


TOPIC_LIST = "[" + ", ".join([f"CASE WHEN regexp_matches(lower(text), {quoted(words_rx([w]))}) THEN {quoted(w)} END" for w in R.TOPIC_WORDS] + [f"CASE WHEN regexp_matches(lower(text), {quoted(words_rx(ws))}) THEN {quoted(n)} END" for n, ws in R.TOPICS]) + "]"


@query(f"WITH {HEADED_SQL}, raw AS (SELECT doc_id, list_filter({TOPIC_LIST}, lambda x: x IS NOT NULL) AS l FROM headed) SELECT doc_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS topics FROM raw")
def extract_topics(t):
    return headed(t).select("doc_id", D.extract_topics(F.col("text")).alias("topics"))


@query()
def extract_entities(t):
    return headed(t).select("doc_id", D.extract_entities(F.col("text")).alias("entities"))


@query()
def extract_metadata(t):
    return D.extract_metadata(headed(t)).drop("text")


@query("SELECT l.doc_id, d.lang AS department, CASE WHEN l.quality = 1 THEN [d.source] ELSE ['own'] END AS tags FROM labels l LEFT JOIN documents d USING (doc_id)")
def attach_metadata(t):
    chunks = t("labels").select("doc_id", F.when(F.col("quality") == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("own"))).alias("tags"))
    docs = t("documents").select("doc_id", F.col("lang").alias("department"), F.array("source").alias("tags"))
    return D.attach_metadata(chunks, docs, "doc_id", ["department"], ["tags"]).select("doc_id", "department", "tags")


# An index of the table's earlier state: some documents missing, some with another hash.
INDEXED_SQL = "indexed AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE left(sha256(text), 16) END AS content_hash FROM documents WHERE doc_id % 7 <> 0)"


def hashed(t):
    return t("documents").select("doc_id", "text", X.content_hash(F.col("text")).alias("content_hash"))


def indexed(t):
    return hashed(t).filter("doc_id % 7 <> 0").withColumn("content_hash", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("content_hash"))).drop("text")


@query(f"WITH {INDEXED_SQL} SELECT d.doc_id, CASE WHEN i.doc_id IS NULL THEN 'new' WHEN i.content_hash <> left(sha256(text), 16) THEN 'changed' ELSE 'unchanged' END AS change FROM documents d LEFT JOIN indexed i USING (doc_id)")
def incremental_changes(t):
    return M.incremental_changes(hashed(t), indexed(t), "doc_id").select("doc_id", "change")


@query(f"WITH {INDEXED_SQL} SELECT doc_id, left(sha256(text), 16) AS content_hash FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT * FROM indexed WHERE doc_id % 2 <> 0")
def upsert_chunks(t):
    return M.upsert(indexed(t), hashed(t).filter("doc_id % 2 = 0").drop("text"), "doc_id")


@query("SELECT lang, count(*) AS removed FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY lang")
def delete_document(t):
    return M.deleted_counts(t("documents"), t("labels").filter("toxic = 1"), "doc_id", "lang")


@query("SELECT doc_id AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN 'dense_only' ELSE 'lexical_only' END AS side FROM documents WHERE (doc_id % 3 = 0) <> (doc_id % 4 = 0)")
def index_consistency(t):
    ids = t("documents").select(F.col("doc_id").alias("chunk_id"))
    return M.index_consistency(ids.filter("chunk_id % 4 = 0"), ids.filter("chunk_id % 3 = 0"))


@query("SELECT lang, source, count(*) AS chunks FROM documents GROUP BY ALL")
def collection_stats(t):
    return M.collection_stats(t("documents"), ["lang", "source"])


@query(r"SELECT page_id, regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g') AS title, len(string_split(html, '<h1')) - 1 AS headings FROM pages")
def pages_to_text(t):
    found = loaders.pages_to_text(t("pages"))
    heads = F.size(F.filter(F.split("content", "\n"), lambda x: x.startswith("# "))).cast("long")
    return found.select("page_id", "title", heads.alias("headings"))


@query(
    """WITH p AS (SELECT source AS source_file, doc_id AS page_number, text, CASE WHEN doc_id % 4 = 0 THEN lang || doc_id END AS section_path FROM documents), i AS (SELECT source_file, page_number, text FROM p),
c AS (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM i),
n AS (SELECT i.source_file, i.page_number, arg_min(p.section_path, abs(p.page_number - i.page_number) * 10000000 + p.page_number) AS section_path FROM i LEFT JOIN p ON p.source_file = i.source_file AND p.section_path IS NOT NULL GROUP BY ALL)
SELECT c.source_file, c.page_number, '[DIAGRAM CAPTION — ' || c.source_file || ' (page ' || c.page_number || ')] ' || coalesce(list_filter(l, lambda x: regexp_matches(x, '(?i)\\b(figure|fig\\.|diagram|chart|illustration)\\b'))[1], left(l[1], 200), 'Visual content from ' || c.source_file) AS caption, section_path FROM c JOIN n USING (source_file, page_number)"""
)
def caption_rows(t):
    from ..operators.structure import caption_rows as captions

    pages = t("documents").select(F.col("source").alias("source_file"), F.col("doc_id").alias("page_number"), "text", F.when(F.col("doc_id") % 4 == 0, F.concat("lang", F.col("doc_id").cast("string"))).alias("section_path"))
    return captions(pages, pages.select("source_file", "page_number"))


def fenced(t):
    """Every second document with a fence between its halves."""
    half = F.floor(F.length("text") / 2).cast("int")
    text = F.concat(F.substr("text", F.lit(1), half), F.lit("\n```\nx = f(1)\ny = g(x)\n```\n"), F.substr("text", half + 1, F.length("text")))
    return t("documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, text).otherwise(F.col("text")).alias("text"))


@query()
def chunk_markdown(t):
    return C.chunk_markdown(fenced(t))


@query()
def chunk_table(t):
    return C.chunk_table(t("documents"))


def paged(t):
    """Documents as pages of their sources, in sections of 50 numbers; every third has code in its middle."""
    fenced = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("See below.\n```py\nx = 1\n\ny = 2\n```\n"), "text")).otherwise(F.col("text"))
    return t("documents").select(F.col("source").alias("source_file"), F.col("doc_id").alias("page_number"), F.floor(F.col("doc_id") / 50).cast("string").alias("section_path"), fenced.alias("text"))


PAGED_SQL = """p AS (SELECT source AS f, doc_id AS p, doc_id // 50 AS s, CASE WHEN doc_id % 3 = 0 THEN 'See below.' || chr(10) || '```py' || chr(10) || 'x = 1' || chr(10) || chr(10) || 'y = 2' || chr(10) || '```' || chr(10) || text ELSE text END AS text FROM documents),
q AS (SELECT *, greatest(1, length(coalesce(text, '')) // 4) AS n, row_number() OVER (PARTITION BY f ORDER BY p) AS i FROM p), r AS (SELECT *, coalesce(s <> lag(s) OVER (PARTITION BY f ORDER BY i), true) AS fresh FROM q),
w AS (SELECT f, i, n AS held, i AS g FROM r WHERE fresh UNION ALL SELECT r.f, r.i, CASE WHEN held + r.n > 2000 THEN r.n ELSE held + r.n END, CASE WHEN held + r.n > 2000 THEN r.i ELSE g END FROM w JOIN r ON r.f IS NOT DISTINCT FROM w.f AND r.i = w.i + 1 AND NOT fresh)"""
STRIPPED = "regexp_replace(text, '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g')"


@query(
    f"WITH RECURSIVE {PAGED_SQL}, m AS (SELECT r.f, r.p, w.g, {STRIPPED} AS text, r.i FROM r JOIN w ON w.f IS NOT DISTINCT FROM r.f AND w.i = r.i) "
    "SELECT * FROM (SELECT f AS source_file, min(p) AS page_number, CAST(count(*) AS INTEGER) AS n_pages, sha256(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY i) FILTER (WHERE text <> ''), '')) AS text_sha256 FROM m GROUP BY f, g) WHERE text_sha256 <> sha256('')"
)
def page_parents(t):
    parents, _ = P.page_parent_child(paged(t))
    return parents.select("source_file", "page_number", "n_pages", F.sha2("text", 256).alias("text_sha256"))


@query()
def chunk_parent_child(t):
    parents, children = P.page_parent_child(paged(t))
    return children.join(parents.select("parent_id", F.col("page_number").alias("parent_page"), "n_pages").distinct(), "parent_id")


TYPED = "CASE doc_id % 6 WHEN 0 THEN 'markdown' WHEN 1 THEN 'pdf' WHEN 2 THEN 'text' END"


@query(
    f"SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'table' WHEN doc_id % 11 = 1 THEN 'heading_aware' WHEN contains(text, '|---') OR (contains(text, '|') AND contains(text, chr(10) || '|')) THEN 'table' WHEN coalesce({TYPED}, 'text') = 'markdown' OR doc_id % 13 = 0 OR contains(text, '```') THEN 'markdown' "
    f"WHEN coalesce({TYPED}, 'text') = 'pdf' OR doc_id % 17 = 0 THEN 'heading_aware' WHEN len(list_filter(regexp_split_to_array(text, '[\\s\\x0B]+'), lambda w: w <> '')) > 200 THEN 'semantic' ELSE 'recursive' END AS strategy FROM documents"
)
def chunk_strategy(t):
    asked = F.when(F.col("doc_id") % 11 == 0, "Table_Aware").when(F.col("doc_id") % 11 == 1, "heading").when(F.col("doc_id") % 11 == 2, "unknown")
    return t("documents").select("doc_id", C.chunk_strategy(F.col("text"), F.expr(TYPED), F.col("doc_id") % 17 == 0, None, F.col("doc_id") % 13 == 0, asked).alias("strategy"))


@query()
def chunk_parent_pieces(t):
    parents, children = C.chunk_parent_child(t("documents"))
    return children.join(parents.select("parent_id", "doc_id", F.col("chunk_index").alias("parent_index")), "parent_id")


@query("SELECT source, count(*) AS chunks, max(length(text)) AS longest, min(left(text, 100)) AS first_snippet FROM documents GROUP BY source")
def document_detail(t):
    from ..operators.telemetry import document_detail as detail

    return detail(t("documents"), "source")
