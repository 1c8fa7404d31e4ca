"""Every registered query with SQL equals DuckDB over the smallest tables; the others give rows."""

import math

import duckdb
import pytest

from corpusmill.plans import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return str(v) if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    out = QUERIES[name](spark, SMALL)
    rows = sorted((tuple(plain(v) for v in r) for r in out.collect()), key=str)
    if name not in SQL:
        assert rows
        return
    rel = con.sql(SQL[name])
    at = [rel.columns.index(c) for c in out.columns]
    assert len(at) == len(rel.columns)
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)


def test_latency_of_all_events(spark, con):
    """No event is left out, whatever its id."""
    got = {r["stage"]: (r["n"], r["mean"]) for r in QUERIES["latency_summary"](spark, SMALL).collect()}
    want = {stage: (n, round(mean, 6)) for stage, n, mean in con.sql("select event_type, count(*), avg(value) from events group by 1").fetchall()}
    assert {k: (n, round(m, 6)) for k, (n, m) in got.items()} == want


def test_section_contexts_of_whole_texts(spark, con):
    found = {(r["doc_id"], r["line_no"]): r for r in QUERIES["parse_headings"](spark, SMALL).collect()}
    got = {(r["doc_id"], r["line_no"]): (r["section_title"], r["section_level"], r["section_path"]) for r in QUERIES["section_contexts"](spark, SMALL).collect()}
    want = {}
    for doc, text in con.sql("select doc_id, text from documents where text is not null").fetchall():
        n, stack = len(text.split("\n")), []
        for i in range(n + min(n, 9)):
            if h := found.get((doc, i)):
                stack = [x for x in stack if x["level"] < h["level"]] + [h]
            path = " > ".join(" ".join(filter(None, (x["number"], x["title"]))) for x in stack)
            want[doc, i] = (stack[-1]["title"], stack[-1]["level"], path) if stack else (None, None, None)
    assert got == want and max(i for _, i in got) > 40


def test_sections_go_on_over_pages_and_chunks(spark):
    lines = {(r["doc_id"], r["line_no"]): r for r in QUERIES["parse_headings"](spark, SMALL).collect()}
    want, stack, file = {}, [], None
    for doc, n in sorted(lines):
        if doc // 5 != file:
            stack, file = [], doc // 5
        stack = [x for x in stack if x["level"] < lines[doc, n]["level"]] + [lines[doc, n]]
        want[doc] = " > ".join(" ".join(filter(None, (x["number"], x["title"]))) for x in stack)
    got = {r["page_number"]: r["section_path"] for r in QUERIES["page_sections"](spark, SMALL).collect()}
    for doc, path in got.items():
        known = [d for d in want if d // 5 == doc // 5 and d <= doc]
        assert path == (want[max(known)] if known else None), doc


def test_chunk_context_inherits(spark):
    from corpusmill.operators.structure import chunk_context

    rows = [("a", 1, 0, "I. First Part\nwords"), ("a", 1, 1, "more words"), ("a", 900, 0, "A. Scope Here\nB. Other Part"), ("a", 901, 0, "words"), ("b", 1, 0, "none")]
    chunks = spark.createDataFrame(rows, "source_file string, page_number int, chunk_index int, text string").selectExpr("*", "if(source_file = 'b', 'Own', null) section_title")
    got = {(r["source_file"], r["page_number"], r["chunk_index"]): (r["section_title"], r["section_path"]) for r in chunk_context(chunks).collect()}
    assert got == {("a", 1, 0): ("First Part", "I First Part"), ("a", 1, 1): ("First Part", "I First Part"), ("a", 900, 0): ("Other Part", "I First Part > B Other Part"), ("a", 901, 0): ("Other Part", "I First Part > B Other Part"), ("b", 1, 0): ("Own", None)}
