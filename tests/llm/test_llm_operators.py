"""Each operator against brute force, on texts with nulls, empties, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusmill.llm import chat, common, decontamination, embedding, html_text, language, packing, pii, sharding, simhash, suffix_dedup

WORDS = "the ertion of and inre blest ou heonly was anthe with shed ing are é ça".split()
DOCS = "doc_id long, text string, lang string, source string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(9)) * (rng.random() < 0.2) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = [prose(rng, rng.randrange(1, 120)) for _ in range(60)]
    shared = prose(rng, 70)
    texts += [shared + " tail " + prose(rng, 20), "head " + shared, shared, shared, texts[0], texts[1] + " more", "", None, " \n ", "one", "x" * 5000, shared.upper()]
    return [(i * 3, t, rng.choice(["en", "fr", None]), "hot" if i % 3 else f"s{i}") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_sharding(spark, rows, docs, empty):
    out = sharding.kd_shards(docs, 5).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    for i, text, *_ in rows:
        data = (text or "").encode()
        assert (by[i]["size"], by[i]["text_crc32"], by[i]["law"]) == (len(data) + 8, zlib.crc32(data), "bytes")
    for shard in range(5):
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in out)))
    assert sharding.kd_shards(empty).count() == 0
    many = spark.range(20000).selectExpr("id doc_id", "repeat('a', cast(id % 90 as int)) text", "'en' lang", "if(id % 3 = 0, 'hot', cast(id % 50 as string)) source")
    sizes = {r["shard"]: r["sum(size)"] for r in sharding.kd_shards(many).groupBy("shard").sum("size").collect()}
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) < 400
    twice = many.limit(0).unionByName(many.filter("doc_id = 1")).unionByName(many.filter("doc_id = 1"))
    assert sharding.kd_shards(twice, 2).count() == 2
    mixed = docs.unionByName(docs.filter("doc_id % 3 = 0")).unionByName(docs.filter("doc_id % 3 = 0")).unionByName(docs.withColumn("doc_id", docs.doc_id * 0 + 4))
    shape = lambda d: sorted(map(str, d.select("doc_id", "text_crc32", "shard", "slot").collect()))
    assert shape(sharding.kd_shards(mixed, 5)) == shape(sharding.kd_shards(mixed.repartition(7), 5)) == shape(sharding.kd_shards(mixed.orderBy("text"), 5))
    equal = spark.range(2000).selectExpr("5L doc_id", "repeat('a', 50) text")
    assert [r["count"] for r in sharding.kd_shards(equal, 4).groupBy("shard").count().collect()] == [500] * 4
    assert sharding.kd_shards(equal, target_bytes=2000 * 58 // 10).agg({"shard": "max"}).first()[0] == 9


def kd_brute(points, shards):
    """(size, coordinates) -> shard: halves by the exact weighted median of the widest dimension."""
    spread = [max(1, max(p[1][d] for p in points) - min(p[1][d] for p in points)) for d in range(4)]
    out = {}

    def cut(rows, first, many):
        if many == 1 or not rows:
            out.update(dict.fromkeys(rows, first))
            return
        width = [(max(points[i][1][d] for i in rows) - min(points[i][1][d] for i in rows)) / spread[d] for d in range(4)]
        d = max(range(4), key=lambda d: (width[d], -d))
        rows = sorted(rows, key=lambda i: points[i][1][d])
        low = many // 2
        want, upto, k = sum(points[i][0] for i in rows) * low / many, 0, 0
        while k < len(rows) and upto + points[rows[k]][0] < want:
            upto, k = upto + points[rows[k]][0], k + 1
        if k < len(rows) and upto + points[rows[k]][0] - want < want - upto:
            k += 1
        cut(rows[:k], first, low)
        cut(rows[k:], first + low, many - low)

    cut(list(range(len(points))), 0, shards)
    return out


def test_sharding_equals_brute_force(spark):
    rng = random.Random(12)
    rows = [(i // 2 if i % 7 else None, "w" * rng.randrange(80), rng.choice("ab"), rng.choice(["hot", "hot", "x", None])) for i in range(150)] + [(3, "same", "a", "hot")] * 20
    docs = spark.createDataFrame(rows, DOCS).coalesce(1)
    points = [(r["size"], r["at"], r["doc_id"], r["text_crc32"]) for r in sharding._told_apart(sharding._points(docs), common.Scratch(spark, "kd"), len(rows)).collect()]
    for shards in (2, 5, 24):
        want = kd_brute(points, shards)
        got = sharding.kd_shards(docs, shards, tolerance=0.0).collect()
        assert sorted((str(r["doc_id"]), r["text_crc32"], r["shard"]) for r in got) == sorted((str(p[2]), p[3], want[i]) for i, p in enumerate(points))


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        luhn = sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, digits[::-1])))
        return 12 <= len(digits) <= 19 and luhn % 10 == 0
    return True


def test_pii_base_spans(spark):
    rng = random.Random(3)
    bits = ["a.b@c-d.org", "x@y.z@w.de", "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1", "0010.0255.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "12 34 56", "+1 (555) 222-3333", "+1-2", "+49 30 1234567", "é", "word", "@", "%", "4242424242424242 ", "7" * 400, "\n", "a" * 300, "+1+1 222 333 444"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", ", "]) for _ in range(rng.randrange(1, 12))) for _ in range(300)] + [None, "", "1 " * 700, "1.2.3.4 " * 600]
    out = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(out) == len(texts)
    for r in out:
        text = texts[r["doc_id"]] or ""
        spans = sorted((m.start(), list(KINDS).index(k), m.end(), k) for k, p in KINDS.items() for m in re.finditer(p, text) if valid(k, m[0]))
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[3] == k for s in spans) for k in KINDS]
        line = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert set(line.split(",")) <= set(r["spans"].split(",")) or not spans


def bootstrap(rows):
    """doc -> spans line by the bootstrapped rules, pattern by pattern."""
    token, other = re.compile(pii.TOKEN), re.compile(pii.OTHER)
    pairs, followers, facts = {}, {}, []

    def left(text, at):
        before = text[:at]
        w = before.lower().split()
        return " ".join(w[-2:]) if len(w) > 1 and before[-1:].isspace() else None

    for i, text in rows:
        text = text or ""
        spans = sorted((m.start(), list(KINDS).index(k), m.end(), k, m[0]) for k, p in KINDS.items() for m in re.finditer(p, text) if valid(k, m[0]))
        masked = list(text)
        for a, _, b, *_ in spans:
            masked[a:b] = pii.MASK * (b - a)
        masked = "".join(masked)
        maybe = [(m.start(), 4, m.end(), "id", m[0]) for m in token.finditer(masked) if len(m[0]) >= 6 and sum(c.isdigit() for c in m[0]) >= 3]
        maybe = [x for x in maybe if left(text, x[0])]
        for x in spans + maybe:
            if left(text, x[0]):
                key = (left(text, x[0]), x[4])
                pairs[key] = pairs.get(key, False) or x[3] != "id"
        w = text.lower().split()
        for k in range(len(w) - 2):
            if not re.search("[0-9@]", w[k + 2]):
                followers.setdefault(f"{w[k]} {w[k + 1]}", set()).add(w[k + 2])
        for m in other.finditer(masked):
            if left(text, m.start()):
                followers.setdefault(left(text, m.start()), set()).add(m[0].lower())
        facts.append((i, spans, [(x, left(text, x[0])) for x in maybe]))
    graph = {}
    for (p, v), seed in pairs.items():
        graph.setdefault(p, {})[v] = seed
    graph = {p: vs for p, vs in graph.items() if len(vs) >= 5 and not all(vs.values())}
    seeds = {v for vs in graph.values() for v, seed in vs.items() if seed}
    values, patterns, before = {v: float(v in seeds) for vs in graph.values() for v in vs}, {}, None
    while before != (patterns, values):
        before = (patterns, values)
        shares = {p: round(sum(values[v] for v in vs) / (len(vs) + len(followers.get(p, ()))), 9) for p, vs in graph.items()}
        patterns = {p: shares[p] if shares[p] >= 0.5 and sum(values[v] >= 0.5 for v in vs) >= 5 else 0.0 for p, vs in graph.items()}
        miss = dict.fromkeys(values, 1.0)
        for p, vs in graph.items():
            for v in vs:
                miss[v] *= max(1e-9, 1 - patterns[p])
        values = {v: 1.0 if v in seeds else round(1 - m, 9) for v, m in miss.items()}
    good = {p for p in graph if patterns[p] >= 0.8}
    return {i: ",".join(f"{k}:{a}:{b}" for a, _, b, k, _ in sorted(spans + [x for x, p in maybe if p in good])) for i, spans, maybe in facts}


def test_pii_equals_brute_force(spark):
    rng = random.Random(9)
    fill = "the of and to in was 12 2024 (12) x@ 7up".split()
    heads = ["write to", "mail me", "staff number", "the of", "key is", "see also"]

    def value(h):
        kind = rng.random()
        return f"U{rng.randrange(60)}x@mail.org" if h < 2 and kind < 0.6 else f"+1 555 {rng.randrange(100, 140)} 4444" if kind < 0.1 else f"ACC-{rng.randrange(100, 130)}{h % 3}9" if kind < (0.95 if h != 3 else 0.3) else rng.choice(fill)

    rows = []
    for i in range(400):
        words = []
        for _ in range(rng.randrange(1, 9)):
            h = rng.randrange(len(heads))
            words += [rng.choice(fill) for _ in range(rng.randrange(3))] + [heads[h], value(h)]
        rows.append((i, rng.choice([" ", "  ", " \n"]).join(words)))
    rows += [(900, None), (901, ""), (902, "\n write to"), (3, rows[3][1])]
    want = bootstrap(dict(rows).items())
    assert 50 < sum("id:" in x for x in want.values()) < 390
    assert {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_pii_long_texts_and_clashing_columns(spark):
    many = " ".join(f"mail u{i}@x.org or +1 555 {i:07d} at 10.0.{i % 256}.{i % 200} ref AB{i:06d}" for i in range(4000))
    docs = spark.createDataFrame([(1, many, "a", "b", 5)], "doc_id long, text string, found string, _row string, _key int")
    out = pii.redact_pii(docs)
    row = out.first()
    assert out.columns == docs.columns and (row["found"], row["_row"], row["_key"]) == ("a", "b", 5)
    assert row["text"].split()[:7] == ["mail", "<EMAIL>", "or", "<PHONE>", "at", "<IP>", "ref"] and row["text"].count("<PHONE>") == 4000
    assert pii.find_pii(docs.limit(0)).count() == 0 and pii.redact_pii(docs.limit(0)).count() == 0


def test_pii_discovers_by_context(spark):
    rows = [(i, f"item please write to me at u{i}x@mail.org now") for i in range(8)] + [(100 + i, f"kindly write to me at ACC-99{i}4412 now") for i in range(2)] + [(200, "the code ZX-881234 is here"), (300, "see you at noon")]
    found = {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[100].startswith("id:") and found[101].startswith("id:") and found[200] == "" and found[300] == ""


def test_pii_discovers_by_discovered(spark):
    rows = [(i, f"item please write to me at u{i}x@mail.org now") for i in range(40)] + [(100 + i, f"kindly write to me at ACC-99{i}4412 now") for i in range(6)]
    rows += [(200 + i, f"her employee number ACC-99{i}4412 is") for i in range(6)] + [(300, "his employee number ZQ-771203 is"), (310, "a badge of ZQ-771203 is"), (400, "the code ZX-881234 is here")]
    rows += [(500 + i, f"with staff key ACC-99{i}4412 too") for i in range(4)] + [(510, "with staff key KK-551190 too")]
    found = {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[300] == "id:20:29" and found[200].startswith("id:")
    assert found[310] == found[400] == found[510] == ""  # no pattern, no pattern, too little support


def test_pii_long_identifiers(spark):
    long = "eyJ0" + "a1B2-c3_" * 30 + ".sig9"
    far = "w" * 90
    rows = [(i, f"item please write to me at u{i}x@mail.org now") for i in range(8)] + [(100, f"write to me at {long}. now")]
    rows += [(200 + i, f"{'q ' * 40}{far} at v{i}x@mail.org now") for i in range(8)] + [(300, f"see {far} at KK-551190 now")]
    found = {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[100] == f"id:15:{15 + len(long)}"
    assert found[300] == "id:98:107"


def test_pii_token_matches_as_without_bound():
    plain = re.compile(r"(?<![^\s\"'(\[<])[A-Za-z0-9][A-Za-z0-9@._%+/#-]{4,}[A-Za-z0-9](?![A-Za-z0-9@%+/#_-])")
    rng = random.Random(4)
    for _ in range(20000):
        text = "".join(rng.choice("aB12379..-_/# (\"é") for _ in range(rng.randrange(30)))
        want = [m for m in plain.findall(text) if sum(c in "0123456789" for c in m) >= 3]
        assert [m for m in re.findall(pii.TOKEN, text) if len(m) >= pii.LEAST and sum(c in "0123456789" for c in m) >= 3] == want


def test_pii_redacts(spark):
    rows = [(1, "hi bob@x.com and 1.2.3.4 end é", 30), (2, None, None), (3, "plain", 5), (3, "plain", 5)]
    out = sorted(map(tuple, pii.redact_pii(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()))
    assert out == [(1, "hi <EMAIL> and <IP> end é", 25), (2, None, None), (3, "plain", 5), (3, "plain", 5)]


def test_packing(docs, rows, empty):
    out = packing.pack(docs, token_budget=300).collect()
    assert len(out) == len(rows)
    tokens = {i: len((t or "").split()) + 1 for i, t, *_ in rows}
    batches = {}
    for r in out:
        assert r["n_tokens"] == tokens[r["doc_id"]] <= r["bucket_length"] and r["padding"] == r["bucket_length"] - r["n_tokens"]
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
    for rows_ in batches.values():
        assert sorted(r["place"] for r in rows_) == list(range(len(rows_)))
        assert len(rows_) == 1 or len(rows_) * rows_[0]["bucket_length"] <= 300
    assert packing.pack(empty).count() == 0


def test_packing_boundaries_are_optimal():
    rng = random.Random(2)
    for _ in range(60):
        histogram = [(x, rng.randrange(1, 9)) for x in rng.sample(range(1, 60), rng.randrange(1, 9))]
        k = rng.randrange(1, 5)

        def padding(bounds, histogram=histogram):
            return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in histogram)

        lengths = [x for x, _ in histogram]
        best = min(padding(c) for n in range(1, min(k, len(lengths)) + 1) for c in combinations(lengths, n) if max(c) == max(lengths))
        got = packing.optimal_boundaries(histogram, k)
        assert len(got) <= k and padding(got) == best


def repeats(rows, length):
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            if data[k : k + length] in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(data[k : k + length])
        runs = sum(1 for k in range(len(data)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(data), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(data, gone, strict=True) if not g)).hexdigest())
    return out


def test_suffix_dedup(spark, docs, rows, empty, monkeypatch):
    extra = [(1000, "ab" * 400, None, None), (1001, "q" * 350, None, None), (1002, "é" * 260, None, None)]
    every = spark.createDataFrame(rows + extra, DOCS)
    want = repeats([(r[0], r[1]) for r in rows + extra], 100)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.remove_repeats(every).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 1000
    assert suffix_dedup.remove_repeats(empty).count() == 0
    kept = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.remove_repeats(every, with_text=True).collect()}
    assert all(hashlib.sha256(kept[i]).hexdigest() == want[i][3] for i in want)


def test_suffix_dedup_of_repeated_ids(spark, rows):
    texts = [rows[60][1], rows[61][1], rows[60][1] + " x", rows[62][1], None, ""]
    data = [(5, t) for t in texts] + [(None, t) for t in texts] + [(5, texts[0]), (7, texts[1])]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert len(out) == len(data)
    hashed = {r["t"]: r["h"] for r in spark.createDataFrame([(t or "",) for t in texts], "t string").selectExpr("t", "xxhash64(t) h").collect()}
    order = sorted({(i is not None, i or 0, hashed[t or ""], t or "") for i, t in data})
    want = repeats([(k, x[3]) for k, x in enumerate(order)], 100)
    made = {(x[1] if x[0] else None, x[3]): want[k] for k, x in enumerate(order)}
    assert sorted(map(str, (tuple(r) for r in out))) == sorted(str((i, *made[i, t or ""])) for i, t in data)


def test_large_keys_are_taken_apart(monkeypatch):
    # One task's code: every key beyond the limit comes out as windows to be grouped.
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "LARGE_KEY", 300)

    class Frame:
        def mapInArrow(self, f, schema):
            return f

    f = suffix_dedup._kept(Frame(), 100)
    contexts = [bytes([65 + i]) * 120 for i in range(6)]
    batch = pa.RecordBatch.from_pydict({"key": [7] * 6, "context": contexts, "doc": list(range(6)), "start": [0] * 6})
    out = [r for b in f(iter([batch])) for r in b.to_pylist()]
    assert len(out) == 6 and sum(r["bits"] is None for r in out) >= 3


def test_suffix_array_order():
    rng = random.Random(1)
    for _ in range(120):
        data = bytes(rng.choice(b"abcdefgh"[: rng.choice([1, 2, 8])]) for _ in range(rng.choice([1, 2, 7, 60, 400])))
        order = suffix_dedup.suffix_array(np.frombuffer(data, np.uint8), 100).tolist()
        heads = [data[i : i + 100] for i in order]
        assert sorted(order) == list(range(len(data))) and heads == sorted(heads)


def test_chat(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello é"), (1, 3, "bob", "x"), (1, 3, "bob", "x"), (2, None, None, None), (None, 1, "user", "a"), (3, 70, "user", "late"), (3, 1, "user", "early")]
    out = chat.rotate_perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    mine = {r["perspective"]: r for r in out if r["conv_id"] == 1}
    assert set(mine) == {"user", "assistant", "bob"} and all(r["n_turns"] == 4 for r in mine.values())
    r = mine["assistant"]
    assert r["rendered"] == "<|system|>\nbe kind<|end|>\n<|user:user|>\nhi<|end|>\n<|assistant|>\nhello é<|end|>\n<|user:bob|>\nx<|end|>\n"
    a, b = map(int, r["mask"].split(":"))
    assert r["rendered"][a:b] == "hello é<|end|>\n" and r["n_masked"] == b - a
    assert [(x["conv_id"], x["perspective"]) for x in out if x["conv_id"] in (2, None)] and sorted(x["part"] for x in out if x["conv_id"] == 3) == [0, 1]
    hot = [(9, None, rng_role, f"t{i}") for i in range(200) for rng_role in ("a", "b")] + [(9, i, "a", "again") for i in range(100)] + [(None, 5000 * i, "c", str(i)) for i in range(70)]
    cut = chat.rotate_perspectives(spark.createDataFrame(hot, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(1)).withColumn("part", F.lit("x"))).collect()
    assert sorted((r["part"], r["section"], r["n_turns"]) for r in cut if r["conv_id"] == 9 and r["perspective"] == "a") == [(-1, k, 64) for k in range(6)] + [(-1, 6, 16), (0, 0, 64), (1, 0, 36)]
    assert "".join(r["rendered"] for r in sorted((r for r in cut if r["conv_id"] is None), key=lambda r: (r["part"], r["section"]))) == "".join(f"<|assistant|>\n{i}<|end|>\n" for i in range(70))
    assert chat.rotate_perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_html_text(spark):
    page = (
        '<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use cookies</div>'
        "<div class=ad>Buy</div><article><h1>Head &amp; line</h1><p><b>One<br>two &lt;3<p>Be.</p><p>Third\n  para &copy; x</p><div class='comments'><p>nice</p></div></article><aside>side</aside><form>f<input></form><footer>foot</footer></body></html>"
    )
    bare = "<div class=menu><a href=1>one</a><a href=2>two</a></div><div><p>" + "A long enough paragraph of text. " * 5 + "</p><p>Another one that goes on for a while, too.</p></div><div id=footer>c</div>"
    wrapped = '<div class="layout has-sidebar"><div class="sidebar">side</div><article class="post"><p>Kept text.</p><section id="comments"><article class="comment"><p>not kept</p></article></section></article></div>'
    rows = [(7, "u", wrapped), (1, "u", page), (2, None, None), (3, "u", ""), (4, "u", bare), (5, "u", "<p>unclosed <b>bold"), (6, "u", "<div>" * 3000 + "deep"), (1, "u", page)]
    out = [(r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    first = "Head & line\n\nOne two <3\n\nBe.\n\nThird para © x"
    assert out.count((1, first, len(first))) == 2
    text = {i: t for i, t, _ in out}
    assert text[7] == "Kept text."
    assert text[2] == text[3] == "" and text[5] == "unclosed bold" and text[6] == "deep"
    assert text[4].startswith("A long enough") and text[4].endswith("too.") and "one" not in text[4].split("\n\n")[0].split()[:1]


def test_html_text_keeps_short_regions_and_wrappers():
    long, ad = "A long enough paragraph of text. " * 20, "<div class=ad>Buy</div>"
    assert html_text.main_text(f"<div><p>{long}</p>{ad}<p>Short middle.</p>{ad}<p>The end.</p></div>").split("\n\n")[1:] == ["Short middle.", "The end."]
    cited = f"<div><p>{long}</p>{ad}<p><a href=x>A source</a></p>{ad}<p>{long}</p></div>"
    assert "A source" in html_text.main_text(cited)
    assert "A source" not in html_text.main_text(f"<div><p>{long}</p></div>{ad}<div><a href=x>A source</a></div>{ad}<div><p>{long}</p></div>")
    assert html_text.main_text(f"<article class=card><p>A teaser.</p></article><div><p>{long}</p></div>") == "A teaser.\n\n" + long.strip()
    assert html_text.main_text(f"<article><p>{long}</p></article><div><p>Outside.</p></div>") == long.strip()
    side = "<div class=sidebar>Side text.</div>"
    for name in ("content has-sidebar", "layout sidebar-right"):
        assert html_text.main_text(f'<div class="{name}"><p>{long}</p>{side}<p>The end.</p></div>') == long.strip() + "\n\nThe end."


def test_html_text_of_malformed_pages():
    import time

    began = time.time()
    for bad in ("<a ", '<a href="x ', "<a href='", "<", "</", "<!--", "<div class=\"a", "<p>a'b\"", "<script>", '"', "<a<b"):
        html_text.main_text("<p>Begin.</p>" + bad * (1_000_000 // len(bad)))
    assert time.time() - began < 30
    assert html_text.main_text('<p title="a > b < c">One</p><p data-x=\'">\'>Two</p>') == "One\n\nTwo"
    assert html_text.main_text("<p don't>One</p><p>Two 1 < 2 </p>") == "One\n\nTwo 1 < 2"
    assert html_text.main_text('<p>One</p><a href="x>y</a><p>Two</p>') == "One\n\ny\n\nTwo"
    assert html_text.main_text("<p>One</p><!-- <p>no</p> --><![CDATA[ no ]]><?no?></ no><p>Two</p><script>a<b</script>") == "One\n\nTwo"


def test_html_text_keeps_subjects_of_noise_words():
    long = "A long enough paragraph of text. " * 20
    for name in ("market-share", "notice-period", "social-policy", "no-sidebar", "promotion-rules"):
        assert html_text.main_text(f"<article><p>{long}</p><section class='{name}'><p>Kept.</p></section></article>").endswith("Kept."), name
    for name in ("share", "share-buttons", "cookie-notice", "social links", "related-posts", "ad", "ad-slot-3", "article-comments", "promo_box", "alert", "widget"):
        assert html_text.main_text(f"<article><p>{long}</p><section class='{name}'><p>Gone.</p></section></article>") == long.strip(), name


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def contaminated(text, items):
    w, hit, own = words(text), set(), set()
    for item, t in items:
        x = words(t)
        for k in range(max(1, len(x) - 12)) if x else []:
            win = x[k : k + 13]
            for a in range(len(w) - len(win) + 1):
                if w[a : a + len(win)] == win:
                    hit |= set(range(a, a + len(win)))
                    own.add(str(item))
    return len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


def test_decontamination(spark, docs, rows):
    items = [(1, rows[60][1][:300]), (2, rows[3][1]), (11, "Blest, INRE2 ça"), (4, None), (5, "..."), (2, rows[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block_chars in (10**7, 200):
        out = decontamination.find_contamination(docs.withColumn("n_hit", docs.doc_id).withColumn("_spans", F.lit(7)).withColumn("_old_items", F.lit("x")), bench, block_chars=block_chars).collect()
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in out}
        assert got == {i: contaminated(t, items) for i, t, *_ in rows}
        for r in out:
            assert (r["_spans"], r["_old_items"]) == (7, "x")
            for a, b in r["hit_spans"]:
                assert words(r["text"][a:b]) == words(r["text"])[len(words(r["text"][:a])) :][: len(words(r["text"][a:b]))]
    none = decontamination.find_contamination(docs, bench.limit(0))
    assert none.filter("contaminated").count() == 0 and none.count() == len(rows)


def test_embedding(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((30, 16))
    v = np.concatenate([centres[rng.integers(0, 30, 700)] + 0.18 * rng.standard_normal((700, 16)), centres[0] + 0.001 * rng.standard_normal((300, 16))]).astype(np.float32)
    data = [(int(i), x.tolist()) for i, x in enumerate(v)] + [(2000, v[5].tolist()), (2001, (v[5] * 3).tolist()), (2002, None), (2003, [0.0] * 16), (2004, [float("nan")] * 16), (2005, [1.0, 0.0]), (2006, [1.0, 0.001]), (2007, []), (2008, [float("inf")] + [1.0] * 15)]
    data.append((2009, [None] + [1.0] * 15))
    out = {r["vec_id"]: r for r in embedding.embedding_components(spark.createDataFrame(data, "vec_id long, embedding array<float>"), block=64).collect()}
    assert len(out) == len(data)
    unit = {i: np.array(x, float) / np.linalg.norm(x) for i, x in data if x and None not in x and np.isfinite(x).all() and np.any(x)}
    linked = [(a, b) for a, b in combinations(unit, 2) if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9]
    of = components([i for i, _ in data], linked)
    for i, _ in data:
        assert out[i]["n_links"] == sum(i in e for e in linked), i
        assert out[i]["component_id"] == of[i] and out[i]["kept"] == (of[i] == i)
    assert embedding.embedding_components(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_language(spark):
    rng = random.Random(8)
    vocab = {"en": "the of and thing that with shed this from which", "fr": "le la une dans avec pour être où ces leurs", "de": "der die das nicht über für sich von mit auch"}
    rows = [(i, " ".join(rng.choice(vocab[lang].split()) for _ in range(40)), lang) for i, lang in enumerate(rng.choices(list(vocab), k=300))]
    rows += [(1000, None, "en"), (1001, "123 !!", None), (1002, "", "fr"), (1003, "½ Ⅷ ² 12", "en"), (None, rows[0][1], None)]
    out = language.identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumnRenamed("lang", "lang")).collect()
    assert len(out) == len(rows)
    held = [r for r in out if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 1000]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held) and len(held) > 30
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out) and {r["lang_pred"] for r in out if r["doc_id"] in (1000, 1001, 1002, 1003)} == {"und"}
    nothing = language.identify_language(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).first()
    assert nothing["lang_pred"] == "und" and nothing["rejected"]


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("run", [8192, 2])
def test_simhash(spark, docs, rows, empty, run):
    prints = {i: fingerprint(t) for i, t, *_ in rows}
    of = components(list(prints), [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 3])
    out = {r["doc_id"]: r for r in simhash.simhash_components(docs, run=run).collect()}
    assert {i: (int(r["fingerprint"], 16), r["component_id"]) for i, r in out.items()} == {i: (prints[i], of[i]) for i in prints}
    assert simhash.simhash_components(empty).count() == 0


@pytest.mark.parametrize("run", [8192, 3])
def test_simhash_links_at_every_distance(spark, run):
    rng = random.Random(6)
    fps = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        fps |= {base} | {base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))) for _ in range(12)}
    fps = sorted(fps)
    of = components(range(len(fps)), [(a, b) for a, b in combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 3])
    signed = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)]
    from corpusmill.llm.common import Scratch, connected_components

    scratch = Scratch(spark, "test")
    links = simhash.near_duplicate_links(spark.createDataFrame(signed, "fp long, rep long"), scratch, run=run)
    got = {r["node"]: r["component"] for r in connected_components(links, scratch).collect()}
    assert {i: got.get(i, i) for i in range(len(fps))} == of


def test_near_duplicates_keep_one(spark, docs, rows):
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()}
    of = {r["doc_id"]: r["component_id"] for r in simhash.simhash_components(docs).collect()}
    assert kept == {i for i in of if of[i] == i}


def test_connected_components_of_a_chain(spark):
    from corpusmill.llm.common import Scratch, connected_components

    chain = spark.range(300).selectExpr("id src", "id + 1 dst").unionByName(spark.range(1).selectExpr("1000L src", "1001L dst"))
    got = {r["node"]: r["component"] for r in connected_components(chain, Scratch(spark, "chain")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


@pytest.fixture(scope="module")
def odd_rows(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns named as results and as names that operators might use inside."""
    rows = [(None, None, None, None), (1, None, "en", None), (1, "", None, "s"), (2, "a b c d e f", "en", "s"), (2, "a b c d e f", "en", "s"), (3, "mail me at x@y.org now", "en", None), (None, "a b c d e f", "fr", "s"), (4, "long text " * 3000, "en", "s")]
    docs = spark.createDataFrame(rows, DOCS)
    for c in ("_row", "_key", "_doc", "key", "doc", "row", "slot", "shard", "size", "node", "at", "tie", "fp", "h", "z", "spans", "found", "pieces", "base", "n_words", "items", "kept", "score", "rejected", "component_id", "bucket", "batch", "place", "n_tokens", "many", "_b", "_r"):
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    return docs


OPERATORS = {
    "sharding": lambda d: sharding.kd_shards(d, 3),
    "pii": pii.find_pii,
    "redact": pii.redact_pii,
    "packing": packing.pack,
    "suffix": suffix_dedup.remove_repeats,
    "decontamination": lambda d: decontamination.find_contamination(d, d.sparkSession.createDataFrame([(1, "a b c d e f"), (None, None)], "item_id long, text string")),
    "language": language.identify_language,
    "simhash": simhash.simhash_components,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(odd_rows, name):
    out = OPERATORS[name](odd_rows)
    rows = out.collect()
    assert len(rows) == odd_rows.count() and sum(r["doc_id"] is None for r in rows) == 2
    twice = [r.asDict() for r in rows if r["doc_id"] == 2]
    same = [c for c in out.columns if c not in ("shard", "slot", "bucket", "batch", "place")]
    assert len(twice) == 2 and all(twice[0][c] == twice[1][c] for c in same)
    assert OPERATORS[name](odd_rows.limit(0)).count() == 0


def test_odd_pages_and_turns(spark):
    pages = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", ""), (2, None, "<p>x</p>")], "page_id long, url string, html string").withColumn("text", F.lit("own")).withColumn("n_chars", F.lit(7)).withColumn("compute", F.lit(1))
    out = html_text.extract_main_text(pages)
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"], r["compute"]) for r in out.collect()) == [("1", "", 0, 1), ("1", "", 0, 1), ("2", "x", 1, 1), ("None", "", 0, 1)]
    assert html_text.extract_main_text(pages.limit(0)).count() == 0
