"""The pipeline's stages against brute force, and the queries over the smallest tables."""

import re
from collections import Counter
from itertools import combinations

import corpus_pipeline
import pytest
from test_llm_operators import bootstrap, components, contaminated, fingerprint

from corpusmill.llm import language, packing
from corpusmill.llm import queries as Q
from corpusmill.llm.common import read_table

SMALL = "/root/testdata/sf0.001"


def redacted(text, line):
    """The text with each span of a line kind:start:end,... replaced by its kind; of spans that overlap the first stands for all."""
    out, at = [], 0
    for kind, a, b in (x.split(":") for x in line.split(",") if x):
        if int(a) >= at:
            out += [text[at : int(a)], f"<{kind.upper()}>"]
        at = max(at, int(b))
    return "".join(out) + text[at:]


def test_stages(spark):
    docs = read_table(spark, SMALL, "documents")
    before = {r["doc_id"]: r for r in docs.collect()}
    benchmark = [tuple(r) for r in read_table(spark, SMALL, "benchmark").select("item_id", "text").collect()]
    learned = language.learn(docs)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "decontamination", "pii", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns
        rows = out.collect()
        texts = {r["doc_id"]: r["text"] for r in rows}
        old = {i: r["text"] for i, r in before.items()}
        assert len(texts) == len(rows)
        if name == "language":
            judged = {i: language.classify(t, language._compressors(learned)) for i, t in old.items()}
            assert texts == {i: t for i, t in old.items() if judged[i][0] != "und" and judged[i][1] >= language.MIN_MARGIN} and len(texts) >= 0.97 * len(old)
        if name == "near_duplicates":
            prints = {i: fingerprint(t) for i, t in old.items()}
            of = components(list(prints), [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 3])
            assert texts == {i: t for i, t in old.items() if of[i] == i} and len(texts) < len(old)
        if name == "decontamination":
            assert texts == {i: t for i, t in old.items() if not contaminated(t, benchmark)[4]} and len(texts) < len(old)
        if name == "pii":
            want = bootstrap(old.items())
            assert texts == {i: redacted(t, want[i]) for i, t in old.items()} and texts != old
            assert all(r["n_chars"] == len(r["text"]) for r in rows if want[r["doc_id"]])
        docs, before = spark.createDataFrame(rows, docs.schema), {r["doc_id"]: r for r in rows}
    packed = corpus_pipeline.run(spark, SMALL).collect()
    assert {r["doc_id"] for r in packed} == set(before)
    lengths = {i: len(re.split(r"[ \t\n\x0b\f\r]+", r["text"].strip(" \t\n\x0b\f\r"))) + 1 for i, r in before.items()}
    bounds = packing.optimal_boundaries(sorted(Counter(lengths.values()).items()))
    assert {r["doc_id"]: (r["n_tokens"], r["bucket_length"]) for r in packed} == {i: (n, min(b for b in bounds if b >= n)) for i, n in lengths.items()}


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_queries_cover_their_tables(spark, name):
    out = Q.queries()[name](spark, SMALL)
    if name == "op12_phrases":  # a row a phrase: as many as its SQL gives
        import duckdb

        con = duckdb.connect()
        con.sql(f"create view documents as select * from '{SMALL}/documents.parquet'")
        rel = con.sql(Q.oracle_sql()[name])
        assert sorted(map(tuple, out.select(rel.columns).collect())) == sorted(rel.fetchall())
        return
    if name == "op13_prefix_trie":  # a row a node: the root has every conversation
        root = out.filter("depth = 0").collect()
        assert [r["n_convs"] for r in root] == [read_table(spark, SMALL, "conversations").select("conv_id").distinct().count()]
        return
    table = {"op5_chat": "conversations", "op6_html_text": "pages", "op8_embedding": "embeddings"}.get(name, "documents")
    n = read_table(spark, SMALL, table).count()
    assert out.count() == n if name != "op5_chat" else out.count() > 0


def test_chat_equals_its_sql(spark):
    import duckdb

    from corpusmill.llm import chat

    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{SMALL}/conversations.parquet'")
    rel = con.sql(chat.SQL)
    out = Q.op5_chat(spark, SMALL).select(rel.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, out.collect()), key=key) == sorted(rel.fetchall(), key=key)
