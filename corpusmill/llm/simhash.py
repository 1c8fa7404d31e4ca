"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits, fewer than the four that would need an equal one: of up to
three differing bits at most one falls into one of the segments. Each segment is indexed under its 32 variants
with one bit deleted, so two linked fingerprints share a key; members of a key are verified by their bits.
Only distinct fingerprints take part, and a key yields a spanning forest of its links, not its pairs.
Keys with very many members are cut again by variants of the other segment's halves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components

SEED, SHINGLE, MAX_BITS = 42, 3, 3
#: Members of a key that one task links at once; larger keys are cut again.
RUN = 8192
#: For each byte, its bits as eight bytes of a word: sums of up to 255 of them can't overflow.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def shingle_hashes(text: str | None) -> list[int]:
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        return [xxhash.xxh64_intdigest(line, SEED)]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: 1 - SHINGLE].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)]


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """One unsigned 64-bit fingerprint a text; a bit is set if more than half of the hashes set it."""
    out = np.zeros(len(texts), np.uint64)
    for k, text in enumerate(texts):
        hashes = np.array(shingle_hashes(text), np.uint64)
        n = len(hashes)
        if n:
            rows = _SPREAD[hashes.view(np.uint8).reshape(n, 8)]
            sums = np.add.reduceat(rows, np.arange(0, n, 255), axis=0).view(np.uint8).reshape(-1, 64)
            out[k] = np.packbits(sums.sum(axis=0, dtype=np.int64) * 2 > n, bitorder="little").view(np.uint64)[0]
    return out


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, h (a hash of the text), fp (the fingerprint's bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(fingerprints(batch.column("text").to_pylist()).view(np.int64))], names=["doc_id", "h", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text").mapInArrow(run, "doc_id long, h long, fp long")


def _forest(fp: np.ndarray, rep: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that span the components of one key's members: breadth first, each member left is compared once a step."""
    left = np.arange(len(fp))
    while len(left) > 1:
        first, left = left[0], left[1:]
        todo = [first]
        while todo and len(left):
            near = np.bitwise_count(fp[left] ^ fp[todo.pop()]) <= bits
            if near.any():
                found = left[near]
                left = left[~near]
                todo.extend(found.tolist())
                yield rep[found], np.full(len(found), rep[first])


def link_runs(bits: int, run: int | None):
    """A function for mapInArrow over (key, fp, rep) sorted by key: links (key null), or members of keys beyond run."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(src: list, dst: list, key: np.ndarray | None = None, fp: np.ndarray | None = None) -> pa.RecordBatch:
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (src, dst))
            none = pa.nulls(len(a), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b) if key is None else pa.nulls(len(a), pa.int64()), none if key is None else pa.array(key), none if fp is None else pa.array(fp)], names=["src", "dst", "key", "fp"])

        key, fp, rep = (np.zeros(0, np.int64) for _ in range(3))
        over = None
        for batch in batches:
            k, f, r = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "rep"))
            key, fp, rep = np.concatenate([key, k]), np.concatenate([fp, f]), np.concatenate([rep, r])
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            yield from settle(key[:cut], fp[:cut], rep[:cut], over, out)
            over = over if cut == 0 else None
            key, fp, rep = key[cut:], fp[cut:], rep[cut:]
            if run and len(key) > run:
                over = key[0]
                yield out([rep], [rep], key, fp)
                key, fp, rep = key[:0], fp[:0], rep[:0]
        yield from settle(key, fp, rep, over, out)

    def settle(key, fp, rep, over, out):
        if not len(key):
            return
        edges = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.r_[0, edges], np.r_[edges, len(key)]
        size = ends - starts
        two = starts[size == 2]
        bits_of = fp.view(np.uint64)
        if over is not None and key[0] == over:
            n = ends[0]
            yield out([rep[:n]], [rep[:n]], key[:n], fp[:n])
            two = two[two > 0]
        near = two[np.bitwise_count(bits_of[two] ^ bits_of[two + 1]) <= bits]
        src, dst = [rep[near]], [rep[near + 1]]
        for a, b in zip(starts[size > 2].tolist(), ends[size > 2].tolist(), strict=True):
            if over is not None and key[a] == over:
                continue
            for x, y in _forest(bits_of[a:b], rep[a:b], bits):
                src.append(x)
                dst.append(y)
        yield out(src, dst)

    return work


LINKS = "src long, dst long, key long, fp long"


def near_duplicate_links(reps: DataFrame, scratch: Scratch, bits: int = MAX_BITS, run: int = RUN) -> DataFrame:
    """(fp, rep) with distinct fp -> (src, dst): links whose components are those of all pairs within bits bits."""
    variant = "transform(sequence(0, 63), i -> shiftleft(cast(i as bigint), 32) | (shiftrightunsigned(fp, cast(32 * (i div 32) as int)) & 4294967295 & ~shiftleft(1L, i % 32)))"
    keyed = reps.select(F.explode(F.expr(variant)).alias("key"), "fp", "rep")
    found = scratch.save(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(link_runs(bits, run), LINKS))
    # The other segment's halves differ by at most one bit in one of them; what then is left is at most 18 bits.
    other = "shiftrightunsigned(fp, cast(32 * (1 - cast(shiftright(key, 32) as int) div 32) as int)) & 4294967295"
    again = "transform(sequence(0, 31), i -> xxhash64(key, i, shiftrightunsigned(other, cast(16 * (i div 16) as int)) & 65535 & ~shiftleft(1L, i % 16)))"
    hot = found.filter("key is not null").withColumn("other", F.expr(other)).select(F.explode(F.expr(again)).alias("key"), "fp", F.col("src").alias("rep"))
    finer = scratch.save(hot.repartition("key").sortWithinPartitions("key").mapInArrow(link_runs(bits, None), LINKS))
    return found.filter("key is null").select("src", "dst").union(finer.select("src", "dst"))


def _labelled(docs: DataFrame, bits: int, run: int) -> DataFrame:
    """doc_id, h, fp, part (a number of the row's component), component_id, for every row. Links run from fingerprint to fingerprint, so rows that share a doc_id only are not linked by it."""
    scratch = Scratch(docs.sparkSession, "simhash")
    table = scratch.save(fingerprint_table(docs))
    reps = scratch.save(table.groupBy("fp").agg(F.min("doc_id").alias("least")))
    of = connected_components(near_duplicate_links(reps.select("fp", F.col("fp").alias("rep")), scratch, bits, run), scratch)
    parts = scratch.save(reps.join(of, reps.fp == of.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("part")))
    smallest = parts.groupBy("part").agg(F.min("least").alias("component_id"))
    labels = scratch.save(parts.select("fp", "part").join(smallest, "part"))
    return table.join(labels, "fp").select("doc_id", "h", "fp", "part", "component_id")


def simhash_components(docs: DataFrame, bits: int = MAX_BITS, run: int = RUN) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fingerprint, component_id for every row.

    Null, empty and blank texts have fingerprint zero and are linked like any other. Texts of fewer than three
    words have one shingle. Rows with equal fingerprints, repeated rows too, are one component; its id is the smallest
    doc_id that isn't null (null if there is none). Different texts under one doc_id are linked only by their fingerprints. An empty table gives an
    empty result; further columns are ignored.
    """
    return _labelled(docs, bits, run).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """Keeps one row of each component, all columns: of its smallest doc_id, null last, the text with the least hash; of rows equal in both any one."""
    rows = _labelled(docs, MAX_BITS, RUN)
    first = rows.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("_kept"), F.col("h").alias("_h"))).alias("x")).select("x._kept", "x._h")
    kept = docs.withColumn("_text", F.xxhash64("text")).join(first, F.col("doc_id").cast("long").eqNullSafe(F.col("_kept")) & (F.col("_text") == F.col("_h")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_text"]).drop("_text")
