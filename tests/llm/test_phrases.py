"""Phrases against brute force over all runs of words."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpusmill.llm import phrases

LOWER = {x: x + 32 for x in range(65, 91)}


def brute(rows, least=phrases.LEAST, top=phrases.TOP):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    some = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    covered = Counter()
    for p, a in some.items():
        for k in range(2, len(p) - 1):
            for i in range(1, len(p) - k + 1):
                covered[p[0], *p[i : i + k]] = max(a, covered[p[0], *p[i : i + k]])
    out = []
    for p, a in some.items():
        if 100 * covered[p] >= 80 * a:
            continue
        score, _, l, r = min((2000000 * a // (f[p[: k + 1]] + f[p[0], *p[k + 1 :]]), k, f[p[: k + 1]], f[p[0], *p[k + 1 :]]) for k in range(1, len(p) - 1))
        out.append((p[0], -score, -a, " ".join(p[1:]).encode(), l, r))
    ranked, seen = [], Counter()
    for lang, score, a, phrase, l, r in sorted(out):
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return ranked


def texts(rng, n, words):
    for _ in range(n):
        yield rng.choice(["en", "fr", None, "x y\n"]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n"]) for _ in range(rng.randrange(60)))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = list(texts(rng, 500, ["a", "a", "a", "B", "b", "c", "dé", "\x1c", "\xa0", "of the", "to be or not"]))
    return out + [(None, None), ("en", ""), ("en", " .. "), ("en", "one " * 3000), ("en", "One"), ("de", "Ä ä " * 40), ("fr", "lone")] + out[:40]


@pytest.mark.parametrize(("least", "route"), [(30, phrases.ROUTE), (30, 40), (5, 1), (70, 400)])
def test_against_brute_force(spark, rows, least, route):
    """Routes of one word, of some very frequent words, of all words; clashing columns, nulls, repeated rows."""
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "lang string, text string, phrase string, n int")
    got = sorted(map(tuple, phrases.collocations(docs, least, route=route).collect()))
    assert got == sorted(brute(rows, least))
    assert got


def test_top_and_empty(spark, rows):
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, phrases.collocations(docs, top=3).collect())) == sorted(brute(rows, top=3))
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_large_counts_stay_exact():
    """Partition sums are whole numbers far beyond any block."""
    keys = np.array([[1, 1, 2], [5, 5, -1], [6, -1, -1], [-1, -1, -1]])
    found = {(d, int(keys[0, at[0]])): int(f[0]) for at, d, f in phrases.frequent_parts(keys, np.array([2**51, 3, 9]), 10)}
    assert found == {(1, 1): 2**51 + 3, (2, 1): 2**51 + 3, (3, 1): 2**51}


class Held:
    """Stands for a broadcast filter."""

    def __init__(self, bits):
        self.value = np.full(phrases.FILTER_SLOTS, bits, np.int64).tobytes()


@pytest.mark.parametrize(("hot", "most"), [(0, 20_000), (-1, 20_000), (0, 7), (-1, 1)])
def test_rows_hold_many_suffixes(monkeypatch, hot, most):
    """A block gives a row a task, not a suffix; rows are cut at their bound, equal leading words meet in one task, no suffix is lost."""
    monkeypatch.setattr(phrases, "ROW_SUFFIXES", most)
    rng = random.Random(5)
    lines = ["".join(rng.choice(["a", "b", "c", "dé", "of"]) + rng.choice(" ") for _ in range(40)) for _ in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(lines)), pa.array(lines)], names=["lang", "text"])
    rows = pa.Table.from_batches(phrases._suffixes(Held(-1), Held(hot), 3)(iter([batch]))).to_pylist()
    got, tasks = Counter(), {}
    for r in rows:
        found = r["words"].decode().removesuffix(" .").replace(" .", "\n").removesuffix("\n").split("\n")
        assert r["lang"] == "en" and 1 <= len(r["n"]) <= most and len(r["n"]) == len(r["run"]) == len(found)
        for phrase, n, run in zip(found, r["n"], r["run"], strict=True):
            got[phrase.strip()] += n
            assert tasks.setdefault(tuple(phrase.split()[: run + 1]), r["task"]) == r["task"] < 3
    words = [x.split() for x in lines]
    assert got == Counter(" ".join(w[i : i + 4]) for w in words for i in range(len(w) - 1))
    assert sum(len(r["n"]) for r in rows) == len(got)
    assert len(rows) <= (3 if most > len(got) else 3 + len(got) / most)


@pytest.mark.parametrize("base", [6, 60_000])
def test_distinct_of_few_and_many_words(base):
    """One number a row up to 55,000 words, two beyond."""
    rng = np.random.default_rng(1)
    columns = [rng.choice([0, 1, base - 2], 500), rng.choice([0, base - 2], 500), rng.choice([-1, 0, base - 2], 500), rng.choice([-1, base - 2], 500)]
    found, n = phrases._distinct(columns, base)
    want = Counter(zip(*(c.tolist() for c in columns), strict=True))
    assert dict(zip(zip(*(c.tolist() for c in found), strict=True), n.tolist(), strict=True)) == want
