"""Exact removal of repeated passages with suffix arrays built by induced sorting.

A byte goes if a LENGTH-byte string that covers it also starts earlier (smaller doc_id, or the same document, earlier start).

Shards: every window of LENGTH bytes has an anchor, its leftmost smallest hash of GRAM bytes, so equal windows have equal anchors at
equal places. Windows with one anchor are one context (up to 2 * LENGTH - GRAM bytes). Anchors whose key occurs once cannot lie in a repeat and are
dropped before any text moves. Equal contexts are collapsed to the earliest by a grouped minimum, and the distinct contexts are dealt by key to shards. In a
shard the suffixes are classified, the leftmost-smaller (LMS) substrings sorted by recursion on their names, all suffixes induced from
them bucket by bucket, and common prefixes taken in text order: windows with LENGTH common bytes are one string, whose earliest start stays.

Keys that a sample shows to be very frequent are known to repeat and are dealt evenly instead of by key; a key with more distinct contexts than
one task should sort is taken apart by window. Neither changes a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ship

LENGTH, GRAM = 100, 16
#: Bytes of text that are hashed at once, of contexts that one suffix array holds, and of one key's contexts before it is taken apart.
CHUNK, SHARD, LARGE_KEY = 1 << 20, 4 << 20, 24 << 20
#: The sample that looks for frequent keys: a share of documents, the hits that make a key frequent, and the most keys kept. Only a hint.
SAMPLE, SAMPLE_HITS, HOT_KEYS = 0.02, 16, 20_000
NONE = -(1 << 63)
_U = np.uint64
_C = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def anchors(buffer: bytes, ends: np.ndarray, lengths: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """key, first window, last window, anchor as places in buffer, which holds segments that end at ends; windows don't cross segments."""
    n, width = len(buffer), length - GRAM + 1
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    words = np.ndarray((n - 7,), "<u8", buffer, 0, (1,)).astype(_U)
    h = words[:-8] * _C[0]
    h ^= h >> _U(29)
    h += words[8:] * _C[1]
    h *= _C[2]
    h ^= h >> _U(32)
    # The place in the low bits lets the leftmost of equal hashes win; a chunk is at most 2**24 bytes.
    best = (h & _U(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=_U)
    step = 1
    while step * 2 <= width:
        best = np.minimum(best[:-step], best[step:])
        step *= 2
    best = np.minimum(best[: len(best) - (width - step)], best[width - step :])
    starts = np.arange(len(best))
    valid = starts + length <= np.repeat(ends, lengths)[: len(best)]
    at, starts = (best & _U(0xFFFFFF)).astype(np.int64)[valid], starts[valid]
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    cut = np.flatnonzero((np.diff(at) != 0) | (np.diff(starts) != 1)) + 1
    first, last = starts[np.r_[0, cut]], starts[np.r_[cut - 1, len(starts) - 1]]
    a = at[np.r_[0, cut]]
    return h[a].view(np.int64), first, last, a


def _segments(data: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    """A text in pieces that overlap so that no window is lost or taken twice."""
    step = CHUNK - length + 1
    for at in range(0, max(1, len(data) - length + 1), step):
        yield at, data[at : at + CHUNK]


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """doc, key, spot for every anchor; spot packs the place of the first window (42 bits), the anchor's distance and the windows less one (8 bits each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            sizes = np.array([len(p) for _, _, p in held], np.int64)
            ends = np.cumsum(sizes)
            key, first, last, at = anchors(b"".join([*(p for _, _, p in held)]), ends, sizes, length)
            which = np.searchsorted(ends, first, side="right")
            docs_, offset = np.array([d for d, _, _ in held], np.int64), np.array([o for _, o, _ in held], np.int64)
            place = first - (ends - sizes)[which] + offset[which]
            spot = (place << 16) | ((at - first) << 8) | (last - first)
            return pa.RecordBatch.from_arrays([pa.array(docs_[which]), pa.array(key), pa.array(spot)], names=["doc", "key", "spot"])

        held, size = [], 0
        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text"), strict=True):
                data = _raw(text.as_py())
                if len(data) < length:
                    continue
                for at, piece in _segments(data, length):
                    if size + len(piece) > CHUNK and held:
                        yield flush()
                        held, size = [], 0
                    held.append((doc, at, piece))
                    size += len(piece)
        if held:
            yield flush()

    return docs.select("doc", "text").mapInArrow(run, "doc long, key long, spot long")


def _numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc, doc_id, text: doc orders the documents, the null id first. It is the id where no id repeats, else a number of the id and its text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return docs.withColumn("doc", F.coalesce("doc_id", F.lit(NONE)))
    keyed = docs.withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    # Partitions of a range come in order, so the id that grows through them does too.
    order = keyed.select("doc_id", "h").distinct().repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").withColumn("doc", F.monotonically_increasing_id())
    order = scratch.save(order).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "doc")
    return scratch.save(keyed.join(order, (F.col("h") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc", "doc_id", "text"))


def _repeated(rows: DataFrame, hot: list[int]) -> DataFrame:
    """The (doc, spot) of anchors whose key occurs more than once."""
    known = rows.sparkSession.sparkContext.broadcast(np.array(sorted(hot), np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sure = known.value
        last, waiting, dup = None, None, False  # the key before, its row if it was alone so far, whether it repeats
        for b in batches:
            if not b.num_rows:
                continue
            key, doc, spot = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "doc", "spot"))
            same = key[1:] == key[:-1]
            keep = np.r_[False, same] | np.r_[same, False]
            if len(sure):
                keep |= sure[np.minimum(np.searchsorted(sure, key), len(sure) - 1)] == key
            if last == key[0]:
                keep[: np.searchsorted(key, key[0], side="right")] = True
                if waiting is not None:
                    doc, spot, keep = np.r_[waiting[0], doc], np.r_[waiting[1], spot], np.r_[True, keep]
            yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(spot[keep])], names=["doc", "spot"])
            waiting = None if keep[-1] else (doc[-1], spot[-1])
            last = key[-1]

    often = rows.sparkSession.createDataFrame([(x, True) for x in hot], "key long, often boolean")  # at most HOT_KEYS rows
    marked = rows.join(F.broadcast(often), "key", "left")
    dealt = F.when(F.col("often"), F.xxhash64("doc", "spot")).otherwise(F.col("key"))
    return marked.repartition(dealt).drop("often").sortWithinPartitions("key").mapInArrow(run, "doc long, spot long")


def _squeezed(docs: DataFrame) -> DataFrame:
    """doc, doc_id and the text as zstandard bytes: what joins move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        small = zstandard.ZstdCompressor(level=3)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("doc_id"), pa.array([small.compress(_raw(t)) for t in b.column("text").to_pylist()], pa.binary())], names=["doc", "doc_id", "z"])

    return docs.select("doc", "doc_id", "text").mapInArrow(run, "doc long, doc_id long, z binary")


def _unpack(spots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """first window, anchor, windows."""
    first = spots >> 16
    return first, first + ((spots >> 8) & 255), (spots & 255) + 1


def _contexts(texts: DataFrame, marks: DataFrame, length: int) -> DataFrame:
    """key, context, doc, start of every repeated anchor, once a document for equal contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        large = zstandard.ZstdDecompressor()
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                keys, contexts, docs_, starts = [], [], [], []
                for doc, z, spots in zip(b.column("doc").to_pylist(), b.column("z").to_pylist(), _lists(b.column("spots")), strict=True):
                    data, seen = large.decompress(z), set()
                    first, anchor, many = _unpack(np.sort(spots))
                    for s, a, n in zip(first.tolist(), anchor.tolist(), many.tolist(), strict=True):
                        context = data[s : s + n - 1 + length]
                        if (a - s, context) not in seen:
                            seen.add((a - s, context))
                            keys.append(int.from_bytes(hashlib.blake2b(data[a : a + GRAM], digest_size=8).digest(), "little", signed=True))
                            contexts.append(context)
                            docs_.append(doc)
                            starts.append(s)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(contexts, pa.binary()), pa.array(docs_, pa.int64()), pa.array(starts, pa.int64())], names=["key", "context", "doc", "start"])

    return texts.join(marks, "doc").select("doc", "z", "spots").mapInArrow(run, "key long, context binary, doc long, start long")


def suffix_array(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """All suffixes of a byte array in the order of at least their first depth bytes, by induced sorting; 0xFF must not occur.

    The alphabet is small, so buckets are induced whole: a bucket's suffixes hand their predecessors, in order, to the
    predecessors' buckets, and a bucket that feeds itself is taken again until nothing comes.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    # Classify: a suffix is S (smaller than the next) or L; equal bytes have the type of what follows, the end is smallest.
    move = np.diff(text.astype(np.int16))
    turn = np.where(move != 0, np.arange(n - 1), n - 1)
    turn = np.minimum.accumulate(turn[::-1])[::-1]
    is_s = np.zeros(n, bool)
    is_s[:-1] = np.append(move, -1)[turn] > 0
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    by_byte = lambda places: np.split(places[order := np.argsort(text[places], kind="stable")], np.searchsorted(text[places][order], np.arange(1, 256)))
    smaller = by_byte(lms[np.argsort(_lms_names(text, lms, depth), kind="stable")])
    large: list[list[np.ndarray]] = [[] for _ in range(256)]
    small: list[list[np.ndarray]] = [[] for _ in range(256)]

    def hand(to: list, places: np.ndarray, types: bool) -> None:
        before = places[places > 0] - 1
        before = before[is_s[before] == types]
        if len(before):
            c = text[before]
            if len(before) < 64:
                for byte in dict.fromkeys(c.tolist()):
                    to[byte].append(before[c == byte])
                return
            order = np.argsort(c, kind="stable")
            before, c = before[order], c[order]
            cut = np.flatnonzero(np.diff(c)) + 1
            for part, byte in zip(np.split(before, cut), c[np.r_[0, cut]].tolist(), strict=True):
                to[byte].append(part)

    large[text[n - 1]].append(np.array([n - 1]))
    for c in range(256):
        done = 0
        while done < len(large[c]):
            parts, done = large[c][done:], len(large[c])
            hand(large, np.concatenate(parts), False)
        hand(large, smaller[c], False)
    for c in range(255, -1, -1):
        done = 0
        while done < len(small[c]):
            parts, done = small[c][done:], len(small[c])
            hand(small, np.concatenate(parts), True)
        if large[c]:
            hand(small, np.concatenate(large[c])[::-1], True)
    return np.concatenate([x for c in range(256) for x in (*large[c], *((np.concatenate(small[c])[::-1],) if small[c] else ()))])


def _lms_names(text: np.ndarray, lms: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of LMS suffixes by at least depth bytes: substrings are named, then pairs of names, pairs of pairs, and so on."""
    m, n = len(lms), len(text)
    if m == 0:
        return np.zeros(0, np.int64)
    size = np.minimum(np.append(lms[1:] + 1, n) - lms, depth + 8)
    padded = np.append(text, np.full(depth + 24, 255, np.uint8)).tobytes()
    words = np.ndarray((len(padded) - 7,), ">u8", padded, 0, (1,))
    full = _U(0xFFFFFFFFFFFFFFFF)

    def word(w: int) -> np.ndarray:
        """The w-th eight bytes of each substring; what lies behind its end is 0xFF, as a prefix is the larger of two, and 0 for the last."""
        left = np.clip(size - 8 * w, 0, 8)
        got = words[np.minimum(lms + 8 * w, len(words) - 1)].astype(_U)
        behind = np.where(left == 8, _U(0), full >> (np.minimum(left, 7).astype(_U) * _U(8)))
        got |= behind
        got[-1] &= ~behind[-1]
        return got

    # A name is the rank of the first of its group, so that splitting a group leaves all other names alone.
    name = np.zeros(m, np.int64)
    open_ = _refine(name, np.arange(m), word(0))
    for w in range(1, -(-int(size.max()) // 8)):
        # Only groups of which a substring goes on can split.
        goes_on = np.zeros(m, bool)
        goes_on[name[open_[size[open_] > 8 * w]]] = True
        active = goes_on[name[open_]]
        open_ = np.r_[open_[~active], _refine(name, open_[active], word(w)[open_[active]])]
    step = 1
    while len(open_) and step < m and int(np.min(lms[step:] - lms[:-step])) < depth + 8:
        after = open_ + step
        open_ = _refine(name, open_, np.where(after < m, name[np.minimum(after, m - 1)] + 1, 0).astype(_U))
        step *= 2
    return name


def _refine(name: np.ndarray, members: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Splits the groups of members (all of each group) by key, in place; returns the members whose groups still have others."""
    if not len(members):
        return members
    old = name[members]
    if int(key.max()) < 1 << 32:
        order = np.argsort((old.astype(_U) << _U(32)) | key)
    elif old.min() == old.max():
        order = np.argsort(key)
    else:
        order = np.lexsort((key, old))
    old, keys, places = old[order], key[order], np.arange(len(order))
    new_group = np.r_[True, old[1:] != old[:-1]]
    new = new_group | np.r_[True, keys[1:] != keys[:-1]]
    begin = np.maximum.accumulate(np.where(new_group, places, 0))
    own = np.maximum.accumulate(np.where(new, places, 0))
    name[members[order]] = old + own - begin
    alone = new & np.r_[new[1:], True]
    return members[order[~alone]]


def earliest_windows(contexts: list[bytes], docs: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each context, which of its windows are the earliest start of their string among all windows of all contexts."""
    data = b"".join(contexts)
    text = np.frombuffer(data, np.uint8)
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    begin = np.cumsum(sizes) - sizes
    windows = sizes - length + 1
    which = np.repeat(np.arange(len(contexts)), windows)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
    is_window = np.zeros(len(text), bool)
    is_window[begin[which] + offset] = True
    sa = suffix_array(text, length)
    sa = sa[is_window[sa]]
    # Permuted common prefixes: each window against the one before it in the array, eight bytes a step while all are equal.
    phi = np.full(len(text), -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    words = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    open_ = np.flatnonzero(phi >= 0)
    for k in [*range(0, length - 7, 8), length - 8]:
        open_ = open_[words[open_ + k] == words[phi[open_] + k]]
    joined = np.zeros(len(text), bool)
    joined[open_] = True
    next_ = joined[sa]
    shared = next_ | np.r_[next_[1:], False]
    group = np.cumsum(~next_)[shared]
    at = sa[shared]
    number = np.empty(len(text), np.int64)
    number[begin[which] + offset] = np.arange(len(which))
    window = number[at]
    order = np.lexsort((starts[which[window]] + offset[window], docs[which[window]], group))
    first = np.ones(len(which), bool)
    first[window[order]] = np.r_[True, np.diff(group[order]) != 0][: len(order)]
    return np.split(first, np.cumsum(windows)[:-1])


def _kept(distinct: DataFrame, length: int) -> DataFrame:
    """doc, start, bits (which windows stay; empty: all) of distinct contexts sorted by key; bits null with context: its key was too large for a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(docs_: list, starts: list, bits: list, contexts: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(docs_, pa.int64()), pa.array(starts, pa.int64()), pa.array(bits, pa.binary()), pa.array(contexts, pa.binary())], names=["doc", "start", "bits", "context"])

        def shard(rows: list) -> pa.RecordBatch:
            docs_, starts = (np.array([r[i] for r in rows], np.int64) for i in (2, 3))
            kept = earliest_windows([r[1] for r in rows], docs_, starts, length)
            return emit(docs_.tolist(), starts.tolist(), [b"" if k.all() else np.packbits(k).tobytes() for k in kept], [None] * len(rows))

        ready, ready_size, own, own_size, large = [], 0, [], 0, None
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("key", "context", "doc", "start")), strict=True):
                if own and own[0][0] != row[0]:
                    ready += own
                    ready_size += own_size
                    own, own_size = [], 0
                    if ready_size >= SHARD:
                        yield shard(ready)
                        ready, ready_size = [], 0
                own.append(row)
                own_size += len(row[1])
                if own_size > LARGE_KEY or row[0] == large:
                    large = row[0]
                    yield emit([r[2] for r in own], [r[3] for r in own], [None] * len(own), [r[1] for r in own])
                    own, own_size = [], 0
        if ready or own:
            yield shard(ready + own)

    return distinct.mapInArrow(run, "doc long, start long, bits binary, context binary")


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """The rows of an array column as numpy arrays; null is empty."""
    values, cuts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def _removal(spots: np.ndarray, whole: np.ndarray, parts: list | None, n: int, length: int) -> tuple[int, int, np.ndarray | None]:
    """(bytes removed, removed runs, mask of bytes that stay). Windows of repeated anchors go, but for contexts that stay whole and marked windows of others."""
    first, _, many = _unpack(spots)
    if len(whole):
        gone = ~np.isin(first, whole)
        first, many = first[gone], many[gone]
    if not len(first):
        return 0, 0, None
    at = np.repeat(first, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    if parts:
        stays = np.zeros(n + 1, bool)
        for k in parts:
            bits = np.unpackbits(np.frombuffer(k["bits"], np.uint8)).astype(bool)[: n + 1 - k["start"]]
            stays[k["start"] : k["start"] + len(bits)] |= bits
        at = at[~stays[at]]
        if not len(at):
            return 0, 0, None
    delta = np.bincount(at, minlength=n + 1) - np.bincount(at + length, minlength=n + 1)
    lost = np.cumsum(delta[:-1]) > 0
    return int(lost.sum()), int(np.count_nonzero(lost[1:] & ~lost[:-1])) + int(lost[0]), ~lost


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes) for every row.

    Null and empty texts have no bytes. Documents of fewer than length bytes lose nothing. A null doc_id comes before all others. Equal rows are one
    document and get equal results; different texts under one id (or null) are documents of their own, in the order of a hash of the text. An empty table gives an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "suffix")
    docs = _numbered(docs, scratch)
    rows = _anchor_rows(docs, length)
    sample = _anchor_rows(docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(10_000)) < int(SAMPLE * 10_000)), length)
    hot = [r[0] for r in sample.groupBy("key").count().filter(F.col("count") >= SAMPLE_HITS).orderBy(F.desc("count"), "key").limit(HOT_KEYS).collect()]
    marks = scratch.save(_repeated(rows, hot).groupBy("doc").agg(F.collect_list("spot").alias("spots")))
    found = _contexts(_squeezed(docs), marks, length)
    # The earliest of equal contexts: document and start in one decimal, which a hash aggregate can hold.
    one = F.col("doc").cast("decimal(20,0)") * F.lit(1 << 42).cast("decimal(14,0)") + F.col("start").cast("decimal(14,0)")
    distinct = found.select("key", "context", one.cast("decimal(38,0)").alias("at")).groupBy("key", "context").agg(F.min("at").alias("at"))
    doc = F.floor(F.col("at") / F.lit(1 << 42).cast("decimal(14,0)")).cast("long")
    split = distinct.select("key", "context", doc.alias("doc"), "at").select("key", "context", "doc", (F.col("at") - F.col("doc").cast("decimal(20,0)") * F.lit(1 << 42).cast("decimal(14,0)")).cast("long").alias("start"))
    stays = scratch.save(_kept(split.repartition("key").sortWithinPartitions("key"), length))
    # Keys too large for one task: each window by itself, equal ones grouped.
    each = stays.filter("bits is null").select("doc", "start", "context", F.explode(F.expr(f"sequence(0, octet_length(context) - {length})")).alias("i"))
    alone = each.groupBy(F.expr(f"substring(context, i + 1, {length})").alias("window")).agg(F.min(F.struct("doc", (F.col("start") + F.col("i")).alias("start"))).alias("x")).select("x.doc", "x.start", F.lit(b"\x80").alias("bits"))
    kept = stays.filter("bits is not null").select("doc", "start", "bits").union(alone).groupBy("doc").agg(F.collect_list(F.when(F.octet_length("bits") == 0, F.col("start"))).alias("whole"), F.collect_list(F.when(F.octet_length("bits") > 0, F.struct("start", "bits"))).alias("parts"))
    plan = scratch.save(marks.join(kept, "doc", "left"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        large = zstandard.ZstdDecompressor()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                out, spots, stay, parts = [], _lists(b.column("spots")), _lists(b.column("whole")), b.column("parts").to_pylist()
                for i, z in enumerate(b.column("z").to_pylist()):
                    data = large.decompress(z)
                    removed, spans, mask = _removal(spots[i], stay[i], parts[i], len(data), length)
                    rest = np.frombuffer(data, np.uint8)[mask].tobytes() if removed else data
                    out.append((len(data), removed, spans, hashlib.sha256(rest).hexdigest(), rest if with_text else None))
                columns = list(zip(*out, strict=True)) if out else [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    result = _squeezed(docs).join(plan, "doc", "left").select("doc_id", "z", "spots", "whole", "parts").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return result if with_text else result.drop("kept")
