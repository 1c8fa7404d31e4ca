"""The saved BM25 index: results against brute force, reloads, and how little a search of few results scores."""

import math
import random
import re
from collections import Counter

import pytest

from corpusmill.operators import lexical as L
from corpusmill.sources import sinks


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    words = [f"w{min(int(rng.expovariate(0.05)), 199)}" for _ in range(40_000)]
    docs = [(i, " ".join(words[i * 40 : i * 40 + rng.randrange(1, 40)])) for i in range(1000)]
    return [*docs, (1000, None), (1001, ""), (1002, "W1, w2! w1")]


QUESTIONS = [(1, "w1 w150"), (2, "w7 w7 w90 w3"), (3, "nothing here"), (4, None), (5, "w199")]


def brute(docs, questions, k, fill=False):
    terms = {i: re.findall("[a-z0-9]+", (t or "").lower()) for i, t in docs}
    n, average = len(docs), sum(map(len, terms.values())) / len(docs)
    df = Counter(w for x in terms.values() for w in set(x))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: 0.25 * mean if r < 0 else r for w, r in raw.items()}
    out = []
    for q, text in questions:
        found = []
        for i, x in terms.items():
            tf, asked = Counter(x), [w for w in re.findall("[a-z0-9]+", (text or "").lower()) if w in idf]
            if fill or set(asked) & set(x):
                found.append((-round(sum(idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(x) / average)) for w in asked), 6), i))
        out += [(q, i, abs(s), r) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return out


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize(("k", "fill"), [(1, False), (25, False), (5, True), (2000, False)])
def test_saved_index_against_brute_force(spark, corpus, tmp_path, k, fill):
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    asked = spark.createDataFrame(QUESTIONS, "query_id long, text string")
    path = str(tmp_path / "index")
    index = L.build_index(docs, path, block=16, buckets=8)
    want = sorted(brute(corpus, QUESTIONS, k, fill))
    assert rows(L.bm25_search(None, asked, k, index=index, fill=fill)) == want
    assert rows(L.bm25_search(None, asked, k, index=sinks.load_index(spark, path), seeds=1, fill=fill)) == want


def test_rows_scored_fall_with_k(spark, corpus, monkeypatch):
    index = L.build_index(spark.createDataFrame(corpus, "doc_id long, text string"), block=16)
    asked = spark.createDataFrame([(q, f"w{q} w{q + 60} w{q + 100}") for q in range(20)], "query_id long, text string")
    scored, honest = [], L._scored

    def counting(pairs, *rest):
        scored[-1] += pairs.count()
        return honest(pairs, *rest)

    monkeypatch.setattr(L, "_scored", counting)
    for k in (1, 10, 1000):
        scored.append(0)
        L.bm25_search(None, asked, k, index=index).count()
    assert scored[0] < scored[1] < scored[2]
    assert scored[0] < scored[2] / 3


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert rows(L.bm25_search(docs, spark.createDataFrame(QUESTIONS, "query_id long, text string"))) == []


def test_building_and_scoring_move_little(spark, corpus, monkeypatch):
    """Terms of chunks are written once, as postings; questions in several passes, pairs with a floor and terms without weight give the same rows."""
    written, honest = [], L.saved
    monkeypatch.setattr(L, "saved", lambda df, name: written.append(name) or honest(df, name))
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    index = L.build_index(docs, block=16)
    assert written == []
    monkeypatch.setattr(L, "ASKED_BYTES", 48)
    asked = spark.createDataFrame(QUESTIONS, "query_id long, text string")
    assert rows(L.bm25_search(None, asked, 25, index=index)) == sorted(brute(corpus, QUESTIONS, 25))
    even = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert rows(L.bm25_search(even, spark.createDataFrame([(1, "a")], "query_id long, text string"))) == [(1, 1, 0.0, 1)]
