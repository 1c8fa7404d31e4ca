"""Parents of whole pages and their children against a plain walk over sorted pages."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import chunking as C
from corpusmill.operators import parents as P

PAGES = "source_file string, page_number int, section_path string, text string"


def walked(rows, budget):
    """Groups of (file, page, section, text), a plain walk."""
    groups, held = [], 0
    for r in rows:
        n = max(1, len(r[3] or "") // 4)
        if groups and groups[-1][-1][0] == r[0] and groups[-1][-1][2] == r[2] and held + n <= budget:
            groups[-1].append(r)
            held += n
        else:
            groups.append([r])
            held = n
    return groups


@pytest.mark.parametrize(("bits", "budget", "seed"), [(0, 7, 1), (2, 20, 2), (3, 40, 3), (18, 40, 4)])
def test_page_groups_over_blocks(spark, monkeypatch, bits, budget, seed):
    monkeypatch.setattr(P, "BLOCK_BITS", bits)
    rng = random.Random(seed)
    rows = [("hot", i, ["a", "a", None][i // 50 % 3], f"{i:03d}" + "x" * rng.choice([0, 5, 20, 60, 300])) for i in range(150)]
    rows += [(f, i, "a", "w" * rng.randrange(40)) for f in ("b", "c", None) for i in range(5)] + [("d", None, None, None), ("d", 1, None, "")]
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] or 0))
    shuffled = rows[:]
    rng.shuffle(shuffled)
    got = P.page_groups(spark.createDataFrame(shuffled, PAGES).repartition(3), budget=budget).withColumn("p", F.coalesce("page_number", F.lit(0)))
    found = {}
    for r in got.collect():
        found.setdefault(r["_group"], []).append((r["source_file"], r["p"]))
    assert sorted(map(sorted, found.values()), key=str) == sorted((sorted((r[0], r[1] or 0) for r in g) for g in walked(rows, budget)), key=str)


def test_children_of_pages(spark):
    code = "```py\na = 1\n\nb = 2\n```"
    rows = [("f.pdf", 2, "s", "After it."), ("f.pdf", 1, "s", f"Short.\n{code}\nMore said."), ("f.pdf", 3, "t", code), ("f.pdf", 4, None, "int main() { return 0; }\n" * 20), ("g", None, None, "``` open\nno end"), ("g", 0, "x", " \n"), (None, 5, None, code), ("h", 1, None, None)]
    pages = spark.createDataFrame(rows, PAGES).withColumn("types", F.when(F.col("page_number") == 4, "text,code"))
    parents, children = P.page_parent_child(pages, types="types")
    held = {r["text"]: r for r in parents.collect()}
    assert set(held) == {f"Short.\n{code}\nMore said.\n\nAfter it.", code, ("int main() { return 0; }\n" * 20).strip(), "``` open\nno end"} and parents.count() == 5
    ids = {r["parent_id"]: r["text"] for r in parents.collect()}
    got = {}
    for r in sorted(children.collect(), key=lambda r: r["chunk_index"]):
        got.setdefault((r["source_file"], ids[r["parent_id"]]), []).append((r["page_number"], r["text"], r["content_type"], r["is_atomic"]))
    first = got["f.pdf", f"Short.\n{code}\nMore said.\n\nAfter it."]
    assert first == [(1, "Short.", "prose", False), (1, f"[CODE BLOCK — f.pdf p.1]\n{code}", "code", True), (1, "More said.", "prose", False), (2, "After it.", "prose", False)]
    assert got[None, code] == [(5, f"[CODE BLOCK — document p.5]\n{code}", "code", True)]
    (_, text, kind, atomic), = got["f.pdf", ("int main() { return 0; }\n" * 20).strip()]
    assert text.startswith("[CODE BLOCK — f.pdf p.4]\nint main") and (kind, atomic) == ("code", True)
    assert [x[2] for x in got["g", "``` open\nno end"]] == ["prose"]
    assert all(not re.search(r"^\s*$", x[1]) for g in got.values() for x in g)
    empty = P.page_parent_child(pages.limit(0), types="types")
    assert empty[0].count() == empty[1].count() == 0


def test_strategy_inputs(spark):
    rows = [(0, "x", None, None, None), (1, "x", "PDF", None, None), (2, "x", None, True, None), (3, "x", "html", True, None), (4, "a | b", None, None, "Semantic"), (5, "x |---", None, None, "recursive"), (6, "x", None, None, "other"), (7, "```c", "pdf", None, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, type string, headed boolean, asked string")
    got = {r["doc_id"]: r["s"] for r in docs.select("doc_id", C.chunk_strategy(F.col("text"), F.col("type"), F.col("headed"), None, None, F.col("asked")).alias("s")).collect()}
    assert got == {0: "recursive", 1: "heading_aware", 2: "heading_aware", 3: "markdown", 4: "semantic", 5: "recursive", 6: "recursive", 7: "markdown"}
    long = docs.withColumn("text", F.concat("text", F.lit(" words of a text that is long enough to be a chunk of its own")))
    made = C.chunk_adaptive(long, document_type=F.col("type"), override=F.col("asked")).select("doc_id", "strategy").distinct().collect()
    assert {r["doc_id"]: r["strategy"] for r in made}[1] == "heading_aware"
