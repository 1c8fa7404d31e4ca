"""Phrase collocations: multikey three-way partitions of suffix pointers, of which infrequent ones are abandoned.

Words are counted first. Every place where a frequent word begins is a suffix of up to DEPTH frequent words; equal ones of a block of text
are one with their number. Suffixes are routed by their leading word, and by as many more as leading ones are very frequent, so that no
route gathers more than the very frequent ones stand for; a row holds a block's suffixes for one task. A task deals its suffixes to parts less
than, equal to and greater than a pivot word; equal parts are phrases and go on with the next word, parts of too few are abandoned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, ship

DEPTH, LEAST, TOP = 4, 30, 2000
#: A longer candidate with this many hundredths of a shorter one's occurrences makes it superfluous.
COVERED = 80
#: Words with so many occurrences don't bound a route by themselves; a task is meant for SHARE suffixes.
ROUTE, SHARE = 1_000_000, 250_000
#: Filters of words: places of 64 bits each.
FILTER_SLOTS = 1 << 18
BLOCK_BYTES = 2 << 20
#: Suffixes in a row at most, and about as many in a batch of rows.
ROW_SUFFIXES, BATCH_SUFFIXES = 20_000, 100_000
#: A-Z lowered, what ends a piece as a full stop, the tab as a space.
_TABLE = bytes(x + 32 if 65 <= x <= 90 else 46 if x in b".,;:!?\n\v\f\r" else 32 if x == 9 else x for x in range(256))
_END = b"."


def _words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in order, and the number of each in a list of the distinct ones; the end of a piece is a word as well."""
    joined = b" . ".join(texts).translate(_TABLE).replace(_END, b" . ")
    coded = pc.split_pattern(pa.array([joined], pa.large_binary()), " ").flatten().dictionary_encode()
    return coded.dictionary.cast(pa.binary()), coded.indices.to_numpy()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(lang, texts in bytes) in blocks of about BLOCK_BYTES a language; a longer text is a block by itself."""
    held: dict[str, list] = {}
    size: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            lang = lang.as_py()
            data = text.as_py().encode("utf-8", "surrogatepass")
            held.setdefault(lang, []).append(data)
            size[lang] = size.get(lang, 0) + len(data)
            if size[lang] >= BLOCK_BYTES:
                size[lang] = 0
                yield lang, held.pop(lang)
    yield from held.items()


def _is_word(words: pa.Array) -> np.ndarray:
    """True for what is neither the end of a piece nor the nothing between two blanks."""
    return pc.invert(pc.is_in(words, pa.array([b"", _END], pa.binary()))).to_numpy(zero_copy_only=False)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, texts in _blocks(batches):
        words, codes = _words(texts)
        real = _is_word(words)
        n = np.bincount(codes, minlength=len(words))[real]
        names = pa.concat_arrays([words.filter(pa.array(real)), pa.array([None], pa.binary())]).cast(pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names), pa.string()), names, pa.array(np.append(n, n.sum()))], names=["lang", "word", "f"])


def _filter(words: DataFrame) -> np.ndarray:
    """Bits at both halves of the hash of every (lang, word): a set of fixed size that may take in others as well."""
    hashed = words.select(F.xxhash64("lang", "word").alias("h")).select(F.explode(F.array("h", F.shiftrightunsigned("h", 32))).alias("h"))
    bits = hashed.groupBy(F.pmod(F.shiftrightunsigned("h", 6), F.lit(FILTER_SLOTS)).alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits"))
    out = np.zeros(FILTER_SLOTS, np.int64)
    found = bits.toArrow()
    out[found["slot"].to_numpy()] = found["bits"].to_numpy()
    return out


def _hashes(lang: str, words: np.ndarray) -> np.ndarray:
    """The hashes of a language's words that Spark's xxhash64 gives."""
    seed = xxhash.xxh64_intdigest(lang.encode(), 42)
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64)


def _passes(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which words the filter has, by their hashes."""
    both = np.array([hashes, hashes >> np.uint64(32)])
    slot = ((both >> np.uint64(6)) % np.uint64(FILTER_SLOTS)).astype(np.int64)
    return ((table[slot].view(np.uint64) >> (both & np.uint64(63))) & np.uint64(1)).all(axis=0)


def _distinct(columns: list[np.ndarray], base: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of four columns of numbers from -1 to base - 2, of which the first two are not -1, and how often each occurs."""
    a, b, c, d = columns
    high, low = a * base + b, (c + 1) * base + d + 1
    if base**4 < 1 << 63:  # one number a row, sorted by itself
        key = high * (base * base) + low
        key.sort()
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        high, low = np.divmod(key[new], base * base)
        total = len(key)
    else:
        order = np.lexsort((low, high))
        high, low, total = high[order], low[order], len(order)
        new = np.flatnonzero(np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])))
        high, low = high[new], low[new]
    return [*np.divmod(high, base), *(x - 1 for x in np.divmod(low, base))], np.diff(np.append(new, total))


def _suffixes(frequent, hot, parts: int):
    """The function that turns (lang, text) into rows of a block's distinct suffixes for a task: task, lang, words (of all, each suffix after a blank and before an end), run (leading very frequent words) and n of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, very = (np.frombuffer(x.value, np.int64) for x in (frequent, hot))
        for lang, texts in _blocks(batches):
            words, codes = _words(texts)
            real = np.flatnonzero(_is_word(words))
            hashes = _hashes(lang, words.take(pa.array(real)).to_numpy(zero_copy_only=False))
            kept = _passes(some, hashes)
            real, hashes = real[kept], hashes[kept]
            # -1 ends a suffix: the end of a piece or a word of which there are too few.
            number = np.full(len(words), -1, np.int64)
            number[real] = np.arange(len(real))
            filled = pc.not_equal(words, pa.scalar(b"", pa.binary())).to_numpy(zero_copy_only=False)
            at = np.concatenate([number[codes[filled[codes]]], np.full(DEPTH, -1)])
            words = words.take(pa.array(real))
            start = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0))
            if not len(start):
                continue
            columns = [at[start], at[start + 1]]
            for d in range(2, DEPTH):
                columns.append(np.where(columns[-1] >= 0, at[start + d], -1))
            columns, n = _distinct(columns, len(words) + 1)
            is_hot = np.append(_passes(very, hashes), False)
            run_of = np.cumprod([is_hot[c] for c in columns[:-1]], axis=0).sum(axis=0)  # with all before the last very frequent, the route is the whole
            # The route is the suffix's first run + 1 words, or all of it; its hash names the task.
            route = hashes[columns[0]]
            for d in range(1, DEPTH):
                more = np.flatnonzero((run_of >= d) & (columns[d] >= 0))
                route[more] = (route[more] ^ (route[more] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[columns[d][more]]
            task = (route % np.uint64(parts)).astype(np.int32)
            order = np.argsort(task, kind="stable")
            task, run_of, n, columns = task[order], run_of[order], n[order], [c[order] for c in columns]
            begins = pc.binary_join_element_wise(pa.scalar(b""), words, b" ")  # a blank before each
            taken = [(words if d else begins).take(pa.array(c, mask=c < 0)) for d, c in enumerate(columns)]
            joined = pc.binary_join_element_wise(*taken, pa.scalar(_END), b" ", null_handling="skip")
            # Rows are consecutive suffixes of a task, ROW_SUFFIXES at most.
            new = np.append(True, task[1:] != task[:-1])
            place = np.arange(len(task))
            first = np.flatnonzero(new | ((place - np.maximum.accumulate(np.where(new, place, 0))) % ROW_SUFFIXES == 0))
            edges = np.append(first, len(task)).astype(np.int32)
            _, offsets, data = joined.buffers()
            edge_bytes = np.frombuffer(offsets, np.int32)[joined.offset : joined.offset + len(joined) + 1][edges]
            lines = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(edge_bytes), data])
            lists = [pa.ListArray.from_arrays(pa.array(edges), pa.array(x.astype(np.int32))) for x in (run_of, n)]
            rows = pa.Table.from_arrays([pa.array(task[first]), pa.array([lang] * len(first), pa.string()), lines, *lists], names=["task", "lang", "words", "run", "n"])
            yield from rows.to_batches(max_chunksize=max(1, BATCH_SUFFIXES * len(first) // len(task)))

    return run


def frequent_parts(keys: np.ndarray, weight: np.ndarray, least: int, seed: int = 7) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """keys[d, i], word d of suffix i or -1 behind its end -> (one suffix of each part, its depth, sum of weights) of all parts of suffixes that agree in the first depth words, from 1 on, and weigh least or more.

    All open parts are dealt at once: each has a pivot from its own suffixes and goes to what is less, equal and greater in the word at its depth. Lesser
    and greater parts are dealt again, equal ones with the next word. A part of less weight holds no frequent phrase and is abandoned.
    """
    depths, total = keys.shape
    rng = np.random.default_rng(seed)
    ptr = rng.permutation(total)  # a part's pivot is its last suffix: in this order a random one
    part = np.zeros(total, np.int64)
    depth = np.zeros(1, np.int64)
    while len(ptr):
        pivot = np.empty(len(depth), np.int64)
        mine = keys[depth[part], ptr].astype(np.int64)
        pivot[part] = mine
        side = part * 3 + np.sign(mine - pivot[part]) + 1
        sums = np.bincount(side, weight[ptr], minlength=3 * len(depth))
        heavy = sums >= least
        equal = np.zeros(len(sums), bool)
        equal[1::3] = True
        one = np.zeros(len(sums), np.int64)
        one[side] = ptr
        for d in range(depths):
            found = np.flatnonzero(heavy & equal & (np.repeat(depth, 3) == d))
            if len(found):
                yield one[found], d + 1, sums[found].astype(np.int64)
        deeper = np.repeat(depth, 3) + equal
        keep = heavy[side] & (deeper[side] < depths)
        ptr, side = ptr[keep], side[keep]
        keep = keys[deeper[side], ptr] >= 0  # a suffix that ends has no next word
        ptr, side = ptr[keep], side[keep]
        alive = np.bincount(side, minlength=len(sums)) > 0
        number = np.cumsum(alive) - 1
        part, depth = number[side], deeper[alive]


def _mine(least: int):
    """The function that turns the suffixes of a task's routes into (lang, phrase, k, f, whole); counts that are not whole come from several tasks."""

    def give(lang, phrase, k, f, whole) -> pa.RecordBatch:
        size = len(phrase)
        return pa.RecordBatch.from_arrays([lang, phrase, pa.array(np.full(size, k, np.int32)), pa.array(f), pa.array(np.full(size, whole))], names=["lang", "phrase", "k", "f", "whole"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        coded = pc.split_pattern(table["words"].chunk(0), " ").flatten().dictionary_encode()
        code, names = coded.indices.to_numpy(), coded.dictionary
        code = code[code != pc.index(names, b"").as_py()]
        ends = np.flatnonzero(code == pc.index(names, _END).as_py())
        begin = np.append(0, ends[:-1] + 1)
        lengths = ends - begin
        keys = np.full((DEPTH, len(lengths)), -1, np.int32)
        for d in range(DEPTH):
            has = np.flatnonzero(lengths > d)
            keys[d, has] = code[begin[has] + d]
        first = keys[0].copy()
        langs = table["lang"].chunk(0).dictionary_encode()
        lang = np.repeat(langs.indices.to_numpy(), pc.list_value_length(table["n"].chunk(0)).to_numpy())
        keys[0] += lang * np.int32(len(names))
        n, hot = (table[c].chunk(0).flatten().to_numpy().astype(np.int64) for c in ("n", "run"))
        del table, coded, begin, ends, code, lengths

        def told(at: np.ndarray, k: int) -> tuple[pa.Array, pa.Array]:
            parts = [names.take(pa.array((first if d == 0 else keys[d])[at])) for d in range(k)]
            return langs.dictionary.take(pa.array(lang[at])), pc.binary_join_element_wise(*parts, b" ").cast(pa.string())

        for at, k, f in frequent_parts(keys, n, least):
            own = hot[at] < k  # beginnings of very frequent words only are in other tasks as well
            if k > 1 and own.any():
                yield give(*told(at[own], k), k, f[own], True)
        for k in range(2, DEPTH):
            at = np.flatnonzero((hot >= k) & (keys[k - 1] >= 0))
            if len(at):
                order = at[np.lexsort(keys[:k, at][::-1])]
                new = np.append(True, (keys[:k, order[1:]] != keys[:k, order[:-1]]).any(axis=0))
                yield give(*told(order[new], k), k, np.add.reduceat(n[order], np.flatnonzero(new)), False)

    return run


def count_phrases(docs: DataFrame, scratch: Scratch, least: int = LEAST, route: int = ROUTE) -> DataFrame:
    """docs(lang, text) -> lang, phrase, k, f of all phrases of 1 to DEPTH words with f >= least, and a row with phrase null, f all words, for each language."""
    spark = docs.sparkSession
    ship(spark)
    clean = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words = clean.mapInArrow(_count_words, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    words = scratch.save(words.filter((F.col("f") >= least) | F.col("word").isNull()))
    single = words.filter("word is not null")
    tables = [spark.sparkContext.broadcast(_filter(x).tobytes()) for x in (single, single.filter(F.col("f") >= route))]
    total = words.filter("word is null").agg(F.sum("f")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARE))
    suffixes = clean.mapInArrow(_suffixes(*tables, parts), "task int, lang string, words binary, run array<int>, n array<int>")
    routed = suffixes.repartitionById(parts, "task").drop("task")
    mined = scratch.save(routed.mapInArrow(_mine(least), "lang string, phrase string, k int, f long, whole boolean"))
    spread = mined.filter("not whole").groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    longer = mined.filter("whole").select("lang", "phrase", "k", "f").union(spread)
    return words.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("k"), "f").union(longer)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, route: int = ROUTE) -> DataFrame:
    """docs(lang, text) -> lang, rank, phrase, a, l, r, n, score: each language's top phrases of 2 to DEPTH words with a >= least occurrences.

    A candidate's score is the lowest floor(2000000 * a / (l + r)) over its cuts into two parts with l and r occurrences, ties to the earliest cut. Candidates inside a
    longer one that has COVERED hundredths of their occurrences are left out. Null languages are "und", null texts are empty, repeated rows count each; an
    empty table gives an empty result; further columns are ignored. Counts are exact whatever the filters of words take in; products are decimals.
    """
    scratch = Scratch(docs.sparkSession, "phrases")
    counts = scratch.save(count_phrases(docs, scratch, least, route))
    known = counts.filter("phrase is not null")
    total = counts.filter("phrase is null").select(F.col("lang").alias("_lang"), F.col("f").alias("n"))
    some = known.filter("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cut = some.select("lang", "phrase", "k", "a", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at"))
    cut = cut.withColumn("left", F.array_join(F.slice("w", F.lit(1), F.col("at")), " ")).withColumn("right", F.array_join(F.slice("w", F.col("at") + 1, F.col("k") - F.col("at")), " ")).drop("w")
    part = lambda name, count: known.select(F.col("lang").alias("_lang"), F.col("phrase").alias(name), F.col("f").alias(count))
    for name, count in (("left", "l"), ("right", "r")):
        p = part(f"_{name}", count)
        cut = cut.join(p, (F.col("lang") == F.col("_lang")) & (F.col(name) == F.col(f"_{name}"))).drop("_lang", f"_{name}")
    score = F.expr("(cast(2000000 as decimal(7, 0)) * cast(a as decimal(19, 0))) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    best = cut.withColumn("score", score).groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "at", "l", "r")).alias("best"))
    inner = some.filter("k > 2").select("lang", F.col("a").alias("longer"), "w", "k", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"))
    inner = inner.select("lang", "longer", "w", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("at"))
    inner = inner.groupBy(F.col("lang").alias("_lang"), F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("_phrase")).agg(F.max("longer").alias("longer"))
    met = best.join(inner, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")), "left").drop("_lang")
    hundred = lambda c, by: F.lit(by).cast("decimal(3, 0)") * F.col(c).cast("decimal(19, 0)")
    left = met.filter(F.col("longer").isNull() | (hundred("longer", 100) < hundred("a", COVERED)))
    flat = left.select("lang", "phrase", "a", "best.l", "best.r", "best.score").join(total, F.col("lang") == F.col("_lang"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return flat.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_GRAMS = " UNION ALL ".join(f"SELECT lang, {k} AS k, {' || chr(32) || '.join(f'w{i}' for i in range(1, k + 1))} AS p FROM near WHERE w{k} IS NOT NULL" for k in range(1, DEPTH + 1))

SQL = f"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
parts AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS part FROM texts),
pieces AS (SELECT row_number() OVER () AS piece, lang, regexp_extract_all(part, '[^\\x20\\x09]+') AS w FROM parts),
words AS (SELECT piece, lang, unnest(range(len(w))) AS i, unnest(w) AS w1 FROM pieces),
near AS (SELECT lang, w1, {", ".join(f"lead(w1, {d}) OVER (PARTITION BY piece ORDER BY i) AS w{d + 1}" for d in range(1, DEPTH))} FROM words),
counts AS (SELECT lang, k, p, count(*) AS f FROM ({_GRAMS}) GROUP BY lang, k, p HAVING k = 1 OR count(*) >= {LEAST}),
totals AS (SELECT lang, sum(f) AS n FROM counts WHERE k = 1 GROUP BY lang),
often AS (SELECT lang, k, p, f AS a, string_split(p, ' ') AS w FROM counts WHERE k > 1),
cuts AS (SELECT lang, k, p, w, a, unnest(range(1, k)) AS c FROM often),
scored AS (SELECT x.lang, x.k, x.p, x.a, l.f AS l, r.f AS r, x.c, (2000000::HUGEINT * x.a) // (l.f + r.f) AS score
  FROM cuts x JOIN counts l ON l.lang = x.lang AND l.p = array_to_string(x.w[1:x.c], ' ') JOIN counts r ON r.lang = x.lang AND r.p = array_to_string(x.w[x.c + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, c) = 1),
sizes AS (SELECT lang, k, w, a, unnest(range(2, k)) AS s FROM often WHERE k > 2),
inside AS (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS p, max(a) AS longer FROM (SELECT lang, w, a, s, unnest(range(1, k - s + 2)) AS i FROM sizes) GROUP BY ALL),
kept AS (SELECT b.lang, b.p AS phrase, b.a, b.l, b.r, b.score FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.p = b.p
  WHERE i.longer IS NULL OR 100::HUGEINT * i.longer < {COVERED}::HUGEINT * b.a)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (SELECT kept.*, t.n, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept JOIN totals t ON t.lang = kept.lang) WHERE rank <= {TOP}
"""
