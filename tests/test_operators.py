"""Exact semantics on small hand-made rows, sources and streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators import answers as A
from corpusmill.operators import chunking as C
from corpusmill.operators import evaluation as E
from corpusmill.operators import fusion as U
from corpusmill.operators import questions as Q
from corpusmill.operators import vectors as V
from corpusmill.operators.structure import section_context
from corpusmill.operators.verification import best_attempt, verify_answers
from corpusmill.sources import loaders, sinks
from corpusmill.streaming import jobs


def one(spark, column, *values):
    return spark.createDataFrame([values], [f"c{i}" for i in range(len(values))]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("# Rules.", (1, "Rules", "markdown_heading")),
        ("Section 4.2: Sick Leave", (4, "Sick Leave", "article_section_clause")),
        ("IV. Benefits", (1, "Benefits", "roman_numeral")),
        ("B. Paid Time Off", (2, "Paid Time Off", "letter_subsection")),
        ("3.1 Travel Rules", (3, "Travel Rules", "numbered_section")),
        ("SAFETY AT WORK", (5, "SAFETY AT WORK", "all_caps_heading")),
        ("plain prose goes here", None),
        ("Page 12", None),
        ("Chapter 1 ......... 45", None),
    ],
)
def test_headings(spark, line, want):
    h = one(spark, X.parse_heading(F.col("c0")), line)
    assert (h and (h["level"], h["title"], h["pattern"])) == want


def test_section_context(spark):
    lines = ["I. One", "A. Scope Here", "text", "B. Other Part", "II. Two", "text"]
    out = section_context(spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id long, line_no int, line string")).orderBy("line_no").collect()
    assert [r["section_path"] for r in out] == ["I One", "I One > A Scope Here", "I One > A Scope Here", "I One > B Other Part", "II Two", "II Two"]


def fold_semantic(text, size, overlap):
    """The packing rule, sentence by sentence."""
    import re

    said = [s.strip() for s in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9\"'“])|\n\n+", text) if s.strip()]
    cost = [max(1, len(s) // 4) for s in said]
    out, a, total = [], 0, 0
    for i in range(len(said)):
        if i > a and total + cost[i] > size:
            out.append((a, i))
            k, t = i, 0
            while k > a and t + cost[k - 1] <= overlap:
                k, t = k - 1, t + cost[k - 1]
            a, total = k, t
        total += cost[i]
    if len(said) > a:
        out.append((a, len(said)))
    return [t for t in (" ".join(said[x:y]) for x, y in out) if len(t) >= 40]


def test_chunk_semantic(spark):
    text = " ".join(f"Sentence number {i} says {'much ' * (i % 7)}here." for i in range(80)) + "\n\nLast one!"
    out = C.chunk_semantic(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string"), size=60, overlap=20).orderBy("chunk_index").collect()
    assert [r["text"] for r in out] == fold_semantic(text, 60, 20) and len({r["chunk_id"] for r in out}) == len(out)


def joins(lengths, gap, size, overlap):
    """Bounds of joined pieces of less than size, by running totals: what the open join holds is a difference of totals less the gaps it lacks."""
    total = [0]
    for n in lengths:
        total.append(total[-1] + n + gap)
    out, a, lacks = [], 0, gap
    for i, n in enumerate(lengths):
        if i > a and total[i] - total[a] - lacks + n + gap > size:
            out.append((a, i))
            a = next((k for k in range(a, i) if total[i] - total[k] - lacks <= overlap), i)
        if a == i > 0 and out:
            lacks += gap  # a join that begins anew counts one gap too few
    return [*out, (a, len(lengths))] if len(lengths) > a else out


def cut_by(text, size, overlap, marks=("\n\n", "\n", ". ", " ")):
    marks = list(marks)
    while marks and marks[0] not in text:
        marks.pop(0)
    if not marks:
        return [text[i : i + size] for i in range(0, max(1, len(text) - overlap), size - overlap)]
    out, run = [], []
    for piece in [*text.split(marks[0]), None]:
        if piece is None or len(piece) >= size:
            out += [marks[0].join(run[a:b]) for a, b in joins([len(x) for x in run], len(marks[0]), size, overlap)]
            run = []
            out += cut_by(piece, size, overlap, marks[1:]) if piece is not None else []
        else:
            run.append(piece)
    return out


def test_chunk_recursive(spark):
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.choice([1, 3, 9, 40, 150])))
    texts = ["".join(word() + rng.choice(["\n\n", "\n", ". ", " ", " ", " "]) for _ in range(rng.randrange(1, 90))) for _ in range(150)] + ["", " ", "a" * 50, "abc", "x" * 79, "y" * 80, "z" * 81, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in docs.select("doc_id", C.split_text(F.col("text"), 80, 20).alias("c")).collect():
        got[r["doc_id"]] = r["c"]
    assert got == {i: None if t is None else cut_by(t, 80, 20) for i, t in enumerate(texts)}
    out = C.chunk_recursive(docs, size=20, overlap=5).orderBy("doc_id", "chunk_index").collect()
    assert [(r["doc_id"], r["text"]) for r in out] == [(i, x) for i, t in enumerate(texts) for x in (cut_by(t, 80, 20) if t else ()) if x.strip()]


def test_chunk_heading_and_table(spark):
    text = "I. First Part\n" + "words here. " * 20 + "\nII. Second Part\n" + "more words. " * 20
    out = C.chunk_heading(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("chunk_index").collect()
    assert [r["section_title"] for r in out] == ["First Part", "Second Part"]
    table = "intro\n| a | b |\n|---|---|\n" + "\n".join(f"| {i} | {'x' * 50} |" for i in range(80)) + "\nend of it"
    cut = C.chunk_table(spark.createDataFrame([(1, table)], "doc_id long, text string"), size=200).filter("content_type = 'table'").collect()
    assert len(cut) > 3 and all(r["text"].startswith("| a | b |\n|---|---|\n") for r in cut)
    assert sum(r["text"].count("xxxxx" * 10) for r in cut) == 80


def test_fusion_ties(spark):
    lists = [("q", "a", 0, 1), ("q", "b", 0, 2), ("q", "b", 1, 1), ("q", "a", 1, 2), ("q", "c", 1, 3)]
    df = spark.createDataFrame([(*x, 1.0, None) for x in lists], "query_id string, chunk_id string, list int, rank int, dense_score double, sparse_score double")
    assert [r["chunk_id"] for r in U.rrf_fuse(df).orderBy("rank").collect()] == ["a", "b", "c"]


@pytest.mark.parametrize(("scores", "ratio", "keep", "n"), [((10, 5, 4, 1), 0.45, 1, 2), ((-1.5, -4, -8), 0.45, 1, 1), ((10, 5, 2), 0.80, 2, 2)])
def test_relative_threshold(spark, scores, ratio, keep, n):
    df = spark.createDataFrame([("q", str(i), float(s)) for i, s in enumerate(scores)], "query_id string, chunk_id string, score double")
    assert U.relative_threshold(df, ratio, keep).count() == n


def test_parents(spark):
    hits = spark.createDataFrame([("q", "c1", "p1", 1, 0.9), ("q", "c2", "p1", 2, 0.8), ("q", "c3", "px", 3, 0.7), ("q", "c4", None, 4, 0.6), ("q", "c5", "px", 5, 0.5)], "query_id string, chunk_id string, parent_id string, rank int, score double")
    parents = spark.createDataFrame([("p1", "whole")], "parent_id string, text string")
    assert [r["result_id"] for r in U.parent_expand(hits, parents).orderBy("rank").collect()] == ["p1", "c3", "c4"]
    assert [r["result_id"] for r in U.parent_expand(hits, parents, drop_siblings=False).orderBy("rank").collect()] == ["p1", "c3", "c4", "c5"]


def test_questions(spark):
    ask = lambda f, q: one(spark, f(F.col("c0")), q)
    assert [ask(Q.classify_intent, q) for q in ("", "compare a and b", "list all leave", "how do I apply", "hello there", "what is it")] == ["empty", "comparison", "enumeration", "procedural", "conversational", "factual"]
    assert ask(Q.detect_departments, "does it cover HR?") == ["HR"] and ask(Q.detect_departments, "ask IT") == ["IT"]
    assert ask(Q.is_followup, "what about that") and not ask(Q.is_followup, "explain the dress code for staff")
    rows = Q.multi_query(spark.createDataFrame([("q", "Explain leave including sick pay (a, b), travel, Travel")], "query_id string, text string")).orderBy("n").collect()
    assert [r["sub_query"] for r in rows][1:] == ["sick pay (a, b)", "travel"]


def test_citation_tags(spark):
    tags = lambda a: one(spark, A.source_tags(F.col("c0")), a)
    assert tags("x [Source 2, Source 3] y [source 01]") == [1, 2, 3] and tags("[1] Source 2") == []


def test_verification(spark):
    rows = [(1, "What is leave policy?", "Leave policy gives staff twenty days yearly [Source 1].", "leave policy gives staff twenty days yearly", 1, 0), (2, "q", "", "c", 1, 0), (3, "What is it?", "I am unable to answer this.", None, 0, 0), (4, "What is the fee?", "The fee is 45% of it [Source 9].", "nothing alike", 1, 0)]
    out = {r["id"]: r for r in verify_answers(spark.createDataFrame(rows, "id int, question string, answer string, context string, chunks int, citations int")).collect()}
    assert out[1]["passed"] and out[1]["faithfulness"] >= 0.85 and not out[2]["passed"] and out[2]["critique"] == "Empty answer generated." and out[3]["passed"]
    assert out[4]["faithfulness"] <= 0.4 and out[4]["citation_coverage"] == 0.15 and not out[4]["passed"]
    tries = spark.createDataFrame([("a", 0, 0.5, False), ("a", 1, 0.8, True), ("a", 2, 0.9, True), ("b", 0, 0.4, False), ("b", 1, 0.4, False)], "query_id string, attempt int, composite double, passed boolean")
    assert {r["query_id"]: r["attempt"] for r in best_attempt(tries).collect()} == {"a": 1, "b": 0}


def test_agreement_and_latency(spark):
    pairs = spark.createDataFrame([(1.0, 1.0), (0.5, 0.4), (0.2, 0.1), (0.9, 1.0), (0.6, 0.6)], "a double, b double")
    r = E.agreement(pairs, "a", "b").first()
    assert r["n"] == 5 and r["mae"] == 0.06 and r["within"] == 1.0 and 0.5 < r["kappa"] < 1
    s = E.latency_summary(spark.createDataFrame([("s", float(x)) for x in (1, 2, 3, 4)], "stage string, ms double")).first()
    assert (s["p50"], s["p95"]) == (2.5, 3.85)


def test_latency_without_warm_up(spark):
    samples = spark.createDataFrame([("s", 0, 90.0), ("s", 1, 1.0), ("s", 2, 3.0)], "stage string, iteration int, ms double")
    assert tuple(E.latency_summary(samples, warm_up=1).first()) == ("s", 2, 2.0, 2.0, 2.9)
    assert E.latency_summary(samples).first()["n"] == 3


def test_lsh_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    asked = vectors.filter("vec_id % 20 = 0")
    true = {(r["query_id"], r["vec_id"]) for r in V.dense_topk(vectors, asked, 10).collect()}
    near = {(r["query_id"], r["vec_id"]) for r in V.dense_topk_lsh(vectors, asked, 10).collect()}
    assert len(true & near) >= 0.9 * len(true)


def test_loaders_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("# Title\n```\nx\n```\n| a |\n| --- |")
    (tmp_path / "in/b.csv").write_text("x,y\n1,2\n3\n")
    (tmp_path / "in/c.jsonl").write_text(json.dumps({"full_name": "Bo", "n": 3}) + "\nbad\n")
    (tmp_path / "in/d.pdf").write_bytes(b"nope")
    found = {r["source_file"]: r["loader"] for r in loaders.discover_files(spark, str(tmp_path / "in")).collect()}
    assert found == {"a.md": "markdown", "b.csv": "csv", "c.jsonl": "json", "d.pdf": "pdf"}
    doc = loaders.load_markdown(spark, str(tmp_path / "in/a.md")).first()
    assert doc["has_code"] and doc["has_tables"] and doc["section_title"] == "Title"
    csv = loaders.load_csv_rendered(spark, str(tmp_path / "in/b.csv")).first()
    assert csv["content"] == "| x | y |\n| --- | --- |\n| 1 | 2 |\n| 3 |  |" and csv["row_count"] == 2
    assert loaders.load_json_lines_rendered(spark, str(tmp_path / "in/c.jsonl")).first()["content"] == "- **Full Name**: Bo\n- **N**: 3"
    files = spark.read.format("binaryFile").load(str(tmp_path / "in"))
    assert {r["reason"] for r in loaders.validate_upload(files).collect()} == {None, "not a PDF"}
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c")], "doc_id long, text string")
    sinks.save_index(docs, str(tmp_path / "index"), buckets=2)
    assert sinks.load_index(spark, str(tmp_path / "index")).postings.agg(F.sum(F.size("keys"))).first()[0] == 4
    sinks.append_feedback(spark.createDataFrame([("q" * 3000, "a")], "question string, answer string"), str(tmp_path / "fb"))
    assert len(spark.read.parquet(str(tmp_path / "fb")).first()["question"]) == 2000


def test_streams(spark, tmp_path):
    (tmp_path / "fb").mkdir()
    rows = [{"id": str(i), "rating": r} for i, r in enumerate((1, 1, -1, 0))]
    (tmp_path / "fb/1.json").write_text("\n".join(map(json.dumps, rows)) + "\nbad line\n")
    q = jobs.stream_feedback(spark.readStream.schema(jobs.FEEDBACK).json(str(tmp_path / "fb"))).writeStream.outputMode("complete").format("memory").queryName("fb").trigger(availableNow=True).start()
    q.awaitTermination()
    assert tuple(spark.table("fb").first()) == (2, 1, 4)
    (tmp_path / "inbox").mkdir()
    ingest = lambda: jobs.stream_ingest(spark, str(tmp_path / "inbox"), str(tmp_path / "chunks"), C.chunk_recursive, str(tmp_path / "cp")).awaitTermination()
    (tmp_path / "inbox/a.txt").write_text("first text")
    ingest()
    (tmp_path / "inbox/b.txt").write_text("second text")
    ingest()
    assert {r["text"] for r in jobs.current_chunks(spark, str(tmp_path / "chunks")).collect()} == {"first text", "second text"}
    (tmp_path / "inbox/a.txt").write_text("first text, changed")
    ingest()
    assert {r["text"] for r in jobs.current_chunks(spark, str(tmp_path / "chunks")).collect()} >= {"second text"}


def test_sessions_end_after_their_start(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, t0 + dt.timedelta(hours=h)) for h in (0, 20, 23, 25, 48, 50)]
    out = jobs.sessions(spark.createDataFrame(rows, "user_id long, ts timestamp")).orderBy("ts").collect()
    assert [r["session"] for r in out] == [1, 1, 1, 2, 2, 3]


def test_chunks_of_chunks(spark):
    text = "\n\n".join(f"Sentence {i} of the whole says {'much ' * (i % 9)}here." for i in range(900))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    parents, children = C.chunk_parent_child(docs)
    whole = {r["parent_id"]: r["text"] for r in parents.collect()}
    assert sorted(whole.values()) == sorted(cut_by(text, 8000, 0))
    got = {}
    for r in children.orderBy("chunk_index").collect():
        got.setdefault(r["parent_id"], []).append(r["text"])
    assert got == {i: fold_semantic(p, C.CHUNK_TOKENS, C.OVERLAP_TOKENS) for i, p in whole.items()}


def test_chunk_markdown(spark):
    prose = ["I. First Part\n" + "words here. " * 20, "II. Second Part\n" + "more words. " * 20]
    docs = spark.createDataFrame([(1, f"{prose[0]}\n```\nx = f(1)\n```\n{prose[1]}\n``````")], "doc_id long, text string")
    out = C.chunk_markdown(docs).orderBy("chunk_index").collect()
    assert [(r["content_type"], r["section_title"], r["text"]) for r in out] == [("text", "First Part", prose[0].strip()), ("code", None, "x = f(1)"), ("text", "Second Part", prose[1].strip())]


def test_chunk_adaptive(spark):
    words = "plain words go on. " * 100
    texts = {1: "a | b\n|---|---|\n| 1 | 2 |", 2: "see ```x = 1``` and " + words, 3: words, 4: "short text of one line, long enough to be kept"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r["doc_id"], r["chunk_index"]): (r["text"], r["strategy"]) for r in C.chunk_adaptive(docs).collect()}
    want = {}
    for i, maker in ((1, C.chunk_table), (2, C.chunk_markdown), (3, C.chunk_semantic), (4, C.chunk_recursive)):
        want |= {(r["doc_id"], r["chunk_index"]): (r["text"], r["strategy"]) for r in maker(docs.filter(F.col("doc_id") == i)).collect()}
    assert got == want and {i for i, _ in got} == set(texts)


def test_entities_and_metadata(spark):
    from corpusmill.operators import metadata as M

    text = "Department: Human Resources\nPolicy ID: POL-HR-001\nEffective Date: 2024-03-05\nEvery manager gets $1,200 per trip and 30 days, or 30 Days. Passwords and pto."
    row = M.extract_metadata(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert (row[0]["department"], row[0]["policy_id"], row[0]["effective_date"]) == ("Human Resources", "POL-HR-001", "2024-03-05")
    low = [x.lower() for x in row[0]["entities"]]
    assert "$1200" in low and low.count("30 days") == 1 and len(low) == len(set(low)) and "leave_pto" in row[0]["topics"]
    assert row[0]["confidence"] == round(0.95 * 0.35 + 0.95 * 0.2 + 0.9 * 0.15 + 0.85 * 0.3, 2)
    assert [(r["department"], r["policy_id"], r["entities"], r["confidence"]) for r in row[1:]] == [("General", None, [], round(0.5 * 0.35 + 0.5 * 0.2 + 0.5 * 0.15 + 0.5 * 0.3, 2))] * 2


def test_phrases_count_as_each_does_alone(spark):
    import re

    from corpusmill.functions import rules as R
    from corpusmill.operators.metadata import _phrases

    pattern, within = _phrases([a for _, aliases in R.DEPARTMENTS for a in aliases])
    text = "people operations and people ops; hr, human resources human resources! r&d it security it people"
    hits = [h for m in re.finditer(pattern, text) for h in within[m[1]]]
    for alias in within:
        assert hits.count(alias) == len(re.findall(rf"\b{re.escape(alias)}\b", text)), alias


def test_retry_rounds_keep_the_best(spark):
    from corpusmill.operators.verification import retry_rounds

    rows = [(1, "What is leave?", "Leave policy gives staff twenty days yearly [Source 1].", "leave policy gives staff twenty days yearly", 1, 1), (2, "What is the fee?", "nothing known 45%", "the fee is ten coins", 1, 0), (3, "What is the fee?", "bad 77% thing", "the fee is ten coins", 1, 0)]
    schema = "query_id int, question string, answer string, context string, chunks int, citations int"
    answers = spark.createDataFrame(rows, schema)

    def again(failed, attempt):
        better = F.when(F.col("query_id") == 2, F.lit("The fee is ten coins [Source 1].") if attempt == 2 else F.col("answer")).otherwise(F.col("answer"))
        return failed.withColumn("answer", better).select(*[c.split()[0] for c in schema.split(", ")])

    out = {r["query_id"]: (r["attempt"], r["passed"]) for r in retry_rounds(answers, again).collect()}
    assert out == {1: (0, True), 2: (2, True), 3: (0, False)}


def test_scorer_hook(spark):
    rows = [(1, "q", "An answer to it all.", "c", 1, 0), (2, "q", " ", "c", 1, 0)]
    df = spark.createDataFrame(rows, "id int, question string, answer string, context string, chunks int, citations int")
    scorer = lambda d: d.withColumn("faithfulness", F.lit(0.9)).withColumn("completeness", F.lit(0.9)).withColumn("citation_coverage", F.lit(0.9)).withColumn("coherence", F.lit(None).cast("double"))
    out = {r["id"]: r for r in verify_answers(df, scorer=scorer).collect()}
    assert out[1]["faithfulness"] == 0.9 and out[1]["coherence"] == 0.95 and out[1]["passed"] and out[2]["faithfulness"] == 0.0 and not out[2]["passed"]


def test_searches_in_passes_agree(spark, monkeypatch):
    """Queries in many scans and small steps give the same rows; ties go to the smaller key."""
    rows = lambda df: sorted(map(tuple, df.collect()))
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    vectors = vectors.unionByName(vectors.limit(40).withColumn("vec_id", F.col("vec_id") + 100_000))
    once = rows(V.dense_topk(vectors, vectors.filter("vec_id % 2 = 0"), 5))
    monkeypatch.setattr(V, "QUERY_BYTES", 40_000)
    monkeypatch.setattr(V, "AT_ONCE", 7)
    assert rows(V.dense_topk(vectors, vectors.filter("vec_id % 2 = 0"), 5)) == once
    assert len(once) == 5 * vectors.filter("vec_id % 2 = 0").count()


def test_cache_serves_later_questions_only(spark):
    from corpusmill.operators.cache import cache_lookup_asof

    schema = "vec_id long, embedding array<double>, ts timestamp, kb_version string, model string"
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    entries = [(1, [1.0, 0.0], at(5), "v", "m"), (2, [1.0, 0.1], at(3), "v", "m"), (3, [1.0, 0.0], at(1), "v", "other"), (4, [1.0, 0.1], at(2), "v", "m"), (5, [1.0, 0.0], None, "v", "m"), (6, [1.0, 0.0], at(1), None, "m"), (7, None, at(1), "v", "m")]
    asked = [(10, [1.0, 0.0], at(4), "v", "m"), (11, [1.0, 0.0], at(5), "v", "m"), (12, [1.0, 0.0], at(6), "v", "m"), (13, [1.0, 0.0], at(9), "w", "m"), (14, [0.0, 1.0], at(9), "v", "other"), (15, [1.0, 0.0], at(1), "v", "m"), (16, [1.0, 0.0], None, "v", "m")]
    found = cache_lookup_asof(spark.createDataFrame(entries, schema).withColumnRenamed("vec_id", "entry_id"), spark.createDataFrame(asked, schema).withColumnRenamed("vec_id", "query_id"))
    got = {r["query_id"]: (r["entry_id"], r["hit"]) for r in found.collect()}
    assert got == {10: (2, True), 11: (2, True), 12: (1, True), 13: (None, False), 14: (3, False), 15: (None, False), 16: (None, False)}


def test_json_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"title": "Leave", "days_off": 3}, {"n": {"x": 1}}, "plain"]')
    (tmp_path / "b.json").write_text('{"full_name": "Bo", "n": 3}')
    (tmp_path / "c.json").write_text("oops")
    got = {r["source_file"]: (r["content"], r["record_count"]) for r in loaders.load_json_rendered(spark, str(tmp_path)).collect()}
    assert got == {"a.json": ("### Leave\n\n- **Title**: Leave\n- **Days Off**: 3\n\n---\n\n### Record 2\n\n- **N**: {\"x\":1}\n\n---\n\nplain", 3), "b.json": ("- **Full Name**: Bo\n- **N**: 3", None), "c.json": ("oops", None)}


def test_stream_sessions(spark, tmp_path):
    """Over several micro-batches: sessions go on, end by a timer, count late rows apart and are forgotten."""
    t0, path, out = dt.datetime(2024, 1, 1), str(tmp_path / "events"), []
    spark.conf.set(*jobs.STATE_STORE)
    rows = lambda *hours: [(u, t0 + dt.timedelta(hours=h)) for u, h in hours]
    batches = [rows((1, 0), (1, 20), (2, 3), (1, 25)), rows((1, 26), (2, 21), (2, 4), (3, 26)), rows((1, 24.9), (1, 50), (9, 60)), rows((9, 90)), rows((9, 2000)), rows((1, 2001), (9, 2001))]
    try:
        for batch in batches:
            spark.createDataFrame(batch, "user_id long, ts timestamp").coalesce(1).write.mode("append").parquet(path)
            stream = jobs.stream_sessions(spark.readStream.schema("user_id long, ts timestamp").parquet(path), late="5 hours")
            job = stream.writeStream.outputMode("update").foreachBatch(lambda b, n: out.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            job.awaitTermination()
    finally:
        spark.conf.unset(jobs.STATE_STORE[0])
    hours = lambda x: (x - t0).total_seconds() / 3600
    got = [(u, s, hours(start), n, late, closed) for u, s, start, n, late, closed in out]
    assert (1, 1, 0.0, 2, 0, True) in got and (1, 2, 25.0, 1, 0, False) in got  # 0 and 20 h, then 25 h opens the second
    assert (1, 2, 25.0, 2, 0, False) in got and (1, 3, 50.0, 1, 0, False) in got and (1, 2, 25.0, 2, 1, True) in got  # 24.9 h came late
    assert (2, 1, 3.0, 2, 0, True) in got and (3, 1, 26.0, 1, 0, True) in got  # ended by their timers; 4 h was older than the watermark
    assert (1, 1, 2001.0, 1, 0, False) in got  # forgotten after 30 days


def test_csv_of_any_width(spark, tmp_path):
    wide = ",".join(f"h{i}" for i in range(200)) + "\r\n" + ",".join(f'"v{i}, ""x""\nnext"' for i in range(201)) + "\r\n\r\n1,2\r\n"
    (tmp_path / "wide.csv").write_text("\ufeff" + wide, newline="")
    (tmp_path / "none.csv").write_text("\n\n")
    found = {r["source_file"]: r for r in loaders.load_csv_rendered(spark, str(tmp_path)).collect()}
    lines = found["wide.csv"]["content"].split("\n")
    assert (found["wide.csv"]["columns"], found["wide.csv"]["row_count"], len(lines)) == (200, 2, 4)
    assert lines[0].startswith("| h0 | h1 |") and lines[0].count("|") == 201 and lines[2].startswith('| v0, "x" next | v1,') and lines[3].startswith("| 1 | 2 |  |")
    assert found["none.csv"]["content"] == "" and found["none.csv"]["columns"] == 0


def test_sub_question_rules(spark):
    asked = ["How many building blocks are there?", "Which roles do sub-agents play in it?", "roles only", "popular full code, covering rates (a, b), GUARDRAILS.", " "]
    rows = Q.multi_query(spark.createDataFrame(list(enumerate(asked)), "query_id int, text string")).orderBy("query_id", "n").collect()
    got = {i: [r["sub_query"] for r in rows if r["query_id"] == i] for i in range(5)}
    assert len(got[0]) == 8 and got[0][1].startswith("5 Levels") and got[0][7] == "Planning building block AI agents"
    assert got[1][1:] == ["research agent orchestration", "manager agent sub-agent specialization", "sub-agent roles delegation"] and got[2] == ["roles only"] and got[4] == []
    assert got[3][1:4] == ["Guardrails building block AI agents safety constraints", "Examples of useful guardrails agents", "ReAct agent design pattern"] and len(got[3]) == 8


def test_explicit_filters_win(spark):
    rows = [(1, 1, "user", "What is the HR leave policy?", None, None), (1, 2, "user", "And for the manual?", "Legal", None), (1, 3, "user", " ", None, "POL-1"), (2, 1, "user", "under POL-HR-001 the handbook", None, None)]
    said = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, d string, p string")
    out = {(r["conv_id"], r["turn"]): r for r in Q.infer_filters(said, {"departments": F.when(F.col("d").isNotNull(), F.array("d")), "policy_id": F.col("p")}).collect()}
    assert out[1, 2]["departments"] == ["Legal"] and out[1, 2]["category"] == "guidebook"
    assert out[1, 3]["departments"] is None and out[1, 3]["policy_id"] == "POL-1"
    assert out[2, 1]["policy_id"] == "POL-HR-001" and out[2, 1]["category"] == "guidebook"


def test_retry_rounds_verify_an_answer_once(spark):
    """What is tried again comes from the reports as written, not from verifying anew."""
    from corpusmill.operators.verification import retry_rounds

    schema = "query_id int, question string, answer string, context string, chunks int, citations int"
    answers, read = spark.createDataFrame([(1, "What is the fee?", "bad 77% thing", "the fee is ten coins", 1, 0)], schema), []

    def again(failed, attempt):
        read.append(failed.inputFiles())
        return failed.select(*answers.columns)

    assert retry_rounds(answers, again).count() == 1
    assert len(read) == 2 and all("retry-reports" in f for files in read for f in files) and all(read)
