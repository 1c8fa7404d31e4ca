"""The trie of prefixes against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from corpusmill.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string"


def sha(ids):
    return hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, own_members in members.items():
        words = len(re.findall("[^\x20\x09-\x0d]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(own_members) - 1) * words
            leaves[node[:d]] += not children[node]
    return sorted(
        (min(m), len(node), -1 if not node else min(members[node[:-1]]), len(m), children[node], leaves[node], saved[node], sha(c for c in m if len(built[c]) == len(node)))
        for node, m in members.items()
    )


def found(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    out = []
    for c in [*range(0, 130), 200, 201, 215, 333, 4001]:
        for t in range(rng.randrange(1, 8)):
            out.append((c, t, rng.choice(["user", "assistant"]) if rng.random() < 0.3 else "user", "hello  there\n" * rng.randrange(3) if t < 3 else rng.choice(["x", "y z", f"own {c} {t}", None])))
    out += [(7, 3, "user", "same"), (7, 3, "user", "same"), (8, None, None, None), (8, None, "user", "before"), (None, 1, "user", "lost")]
    out += [(c, t, "user", f"long {t}") for c in (500, 501, 502, 503) for t in range(400 + c % 2)]
    return out


@pytest.mark.parametrize("cells", [trie.MOST_CELLS, 1])
def test_against_brute_force(spark, rows, cells):
    """With a sketch that tells nearly all apart, and with one so small that it tells least; clashing columns."""
    docs = spark.createDataFrame([(*r, "u") for r in rows], SCHEMA + ", u string").repartition(5)
    assert found(trie.prefix_trie(docs, cells)) == brute(rows)


def test_full_sketch_shuffles_all(spark, rows, monkeypatch):
    monkeypatch.setattr(trie, "sketch", lambda prefixes, size: b"\xff" * (trie.ROWS * size // 8))
    assert found(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_false_alarms_below_a_proof(spark, rows, monkeypatch):
    """Cells set at random: prefixes below one that is proven alone may look shared again."""
    cells = random.Random(1)
    honest = trie.sketch
    monkeypatch.setattr(trie, "sketch", lambda prefixes, size: bytes(a | cells.randrange(256) | cells.randrange(256) for a in honest(prefixes, size)))
    assert found(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_one_conversation_over_many_tasks(spark):
    """A conversation and its copy of a third of all turns each, and many equal turns."""
    rows = [(c, t, "user", f"t {t}") for c in (20, 40) for t in range(1500)] + [(c, None, "user", "again") for c in (60, 61) for _ in range(300)] + [(c, 1, "user", "x") for c in range(100, 140)]
    assert found(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute(rows)


def test_empty_turnless_and_table(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    one = [(c, 0, "user", "a") for c in range(1001, 1019)]
    assert found(trie.prefix_trie(spark.createDataFrame(one, SCHEMA))) == brute(one)
    turnless = [r for r in one if zlib.crc32(str(r[0]).encode()) % 4]
    assert found(trie.prefix_trie(spark.createDataFrame(turnless, SCHEMA))) == brute(turnless)
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert found(trie.prefix_trie(table)) == brute([tuple(r) for r in table.collect()])
