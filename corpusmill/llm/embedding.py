"""Embedding near-duplicates by an epsilon grid order join.

Equal vectors are joined first by grouping. The rest are unit vectors turned onto their principal axes (a d x d covariance, summed
over all rows); cosine >= t means a distance of at most eps = sqrt(2 - 2t). They are sorted by the grid cells of width eps on the leading
axes, cut into blocks of BLOCK_BYTES of successive vectors, and the sequence is joined with itself recursively: pairs of intervals start at the
whole sequence, and a pair whose bounding boxes on the leading axes lie more than eps apart is dropped, else it is cut FAN x FAN. The
recursion runs in Spark down to blocks, one task joins a pair of blocks, going on with the recursion down to LEAF vectors: boxes that
are provably distant are skipped, what is provably close is counted whole. Where no axis leads, as with random directions in many dimensions, no block is provably distant from another, and
the join compares all blocks: its work then grows with the square of the distinct vectors, its shuffle with the square over the vectors of a block. Links are counted exactly in double precision; only a spanning forest of them leaves a task.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, stars

THRESHOLD = 0.9
AXES, BLOCK_BYTES, LEAF, FAN = 8, 8 << 20, 256, 8
#: Boxes and balls are compared with this much room for rounding.
ROOM = 1e-7
MOST_PARTS = 4096


def _clean(df: DataFrame) -> DataFrame:
    """vec_id, embedding as doubles and its 128-bit hash a, b; a vector that is null, zero or not finite in any component becomes null."""
    v = F.col("embedding").cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)
    clean = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(good, F.transform(v, lambda x: x + F.lit(0.0))).alias("v"))
    hashed = lambda seed: F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(seed), "v"))
    return clean.select("vec_id", "v", hashed(1).alias("a"), hashed(2).alias("b"))


def _unit(batch: pa.RecordBatch, column: str, dim: int) -> np.ndarray:
    x = np.asarray(batch.column(column).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """An orthonormal d x d matrix, leading axis first; tasks send sums, the driver gets one row for each pair of components."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim + 1))
        for b in batches:
            if b.num_rows:
                x = np.c_[_unit(b, "v", dim), np.ones(b.num_rows)]
                total += x.T @ x
        i = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(total.ravel())], names=["i", "x"])

    rows = vectors.select("v").mapInArrow(sums, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    total = np.zeros((dim + 1) ** 2)
    for i, x in rows:
        total[i] = x
    total = total.reshape(dim + 1, dim + 1)
    n = max(total[-1, -1], 1)
    mean = total[-1, :-1] / n
    return np.linalg.eigh(total[:-1, :-1] / n - np.outer(mean, mean))[1][:, ::-1].copy()


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges that span the components of a square adjacency matrix."""
    left, out = np.arange(len(near)), []
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            one = todo.pop()
            hit = near[one, left]
            found = left[hit]
            left = left[~hit]
            todo.extend(found.tolist())
            out.extend((one, int(x)) for x in found)
    return out


class _Side:
    """A block's vectors and ids with bounding balls of its leaves."""

    def __init__(self, packed: bytes, ids: bytes, many: bytes, dim: int):
        self.v = np.frombuffer(packed, np.float64).reshape(-1, dim)
        self.id = np.frombuffer(ids, np.int64)
        self.many = np.frombuffer(many, np.int64)
        self.links = np.zeros(len(self.id), np.int64)
        self.cuts = list(range(0, len(self.id), LEAF))
        self.centre = [self.v[a : a + LEAF].mean(axis=0) for a in self.cuts]
        self.radius = [float(np.sqrt(((self.v[a : a + LEAF] - c) ** 2).sum(axis=1)).max()) for a, c in zip(self.cuts, self.centre, strict=True)]


def join_blocks(a: _Side, b: _Side, same: bool, threshold: float) -> set[tuple[int, int]]:
    """Counts the links between two blocks, or in one, into .links (members of groups of equal vectors by number) and returns spanning edges."""
    eps = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    edges: set[tuple[int, int]] = set()
    for i, p in enumerate(a.cuts):
        for j, q in enumerate(b.cuts):
            if same and j < i:
                continue
            apart = float(np.linalg.norm(a.centre[i] - b.centre[j]))
            if apart - a.radius[i] - b.radius[j] > eps + ROOM:
                continue
            one = same and i == j
            ra, rb = slice(p, p + LEAF), slice(q, q + LEAF)
            ia, ib = a.id[ra], b.id[rb]
            if apart + a.radius[i] + b.radius[j] < eps - ROOM:
                a.links[ra] += b.many[rb].sum()
                if one:
                    a.links[ra] -= a.many[ra]
                    edges.update((int(ia[0]), int(x)) for x in ia[1:])
                else:
                    b.links[rb] += a.many[ra].sum()
                    edges.update((int(ia[0]), int(x)) for x in ib)
                    edges.update((int(ib[0]), int(x)) for x in ia)
                continue
            near = a.v[ra] @ b.v[rb].T >= threshold
            if one:
                np.fill_diagonal(near, False)
            if not near.any():
                continue
            a.links[ra] += near @ b.many[rb]
            if one:
                edges.update((int(ia[x]), int(ia[y])) for x, y in _forest(near))
                continue
            b.links[rb] += near.T @ a.many[ra]
            n, m = near.shape
            square = np.zeros((n + m, n + m), bool)
            square[:n, n:], square[n:, :n] = near, near.T
            both = np.r_[ia, ib]
            edges.update((int(both[x]), int(both[y])) for x, y in _forest(square))
    return edges


def _ordered_blocks(vectors: DataFrame, axes: np.ndarray, dim: int, eps: float, block: int, scratch: Scratch) -> DataFrame:
    """(block, packed, ids, many, low, high): the vectors on their axes in grid order; a block has at most block vectors."""
    lead = min(AXES, dim)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _unit(b, "v", dim) @ axes
                cells = np.floor(x[:, :lead] / eps).astype(np.int64)
                # Cells of unit vectors are small numbers: the order of the cells is the order of one binary key.
                width = np.int64(np.ceil(1 / eps) + 2)
                key = np.zeros(len(x), np.int64)
                for k in range(lead):
                    key = key * (2 * width) + cells[:, k] + width
                # Order and boxes are by axes; what is compared are the vectors themselves, unrotated.
                packed = [pa.array([r.tobytes() for r in y]) for y in (_unit(b, "v", dim), np.ascontiguousarray(x[:, :lead]))]
                yield pa.RecordBatch.from_arrays([pa.array(key), b.column("vec_id"), b.column("many"), *packed], names=["cell", "vec_id", "many", "x", "lead"])

    turned = vectors.mapInArrow(turn, "cell long, vec_id long, many long, x binary, lead binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of a sorted partition."""
        from pyspark import TaskContext

        rest: list[pa.RecordBatch] = []
        held, part, count = 0, TaskContext.get().partitionId(), itertools.count()

        def pack(rows: pa.Table) -> pa.RecordBatch:
            x, axis = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.float64).reshape(rows.num_rows, -1) for c in ("x", "lead"))
            f = lambda y: [y.tolist()]
            number = lambda c: [np.asarray(rows.column(c).to_numpy(), np.int64).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([next(count)], pa.int64()), pa.array([x.tobytes()]), pa.array(number("vec_id")), pa.array(number("many")), pa.array(f(axis.min(axis=0))), pa.array(f(axis.max(axis=0)))], names=["part", "place", "packed", "ids", "many", "low", "high"])

        for b in batches:
            rest.append(b)
            held += b.num_rows
            while held >= block:
                table = pa.Table.from_batches(rest)
                yield pack(table.slice(0, block))
                rest = table.slice(block).to_batches()
                held -= block
        if held:
            yield pack(pa.Table.from_batches(rest))

    n = vectors.count()
    parts = max(1, min(MOST_PARTS, n // (4 * block) + 1))
    blocks = turned.repartitionByRange(parts, "cell", "vec_id").sortWithinPartitions("cell", "vec_id").mapInArrow(cut, "part int, place long, packed binary, ids binary, many binary, low array<double>, high array<double>")
    blocks = scratch.save(blocks)
    # A block's number is its place in the sequence: that in its partition after the blocks of those before, of which there are at most MOST_PARTS.
    sizes = dict(blocks.groupBy("part").agg(F.count(F.lit(1))).collect())
    before, total = {}, 0
    for k in sorted(sizes):
        before[k] = total
        total += sizes[k]
    first = F.create_map(*[F.lit(x) for k, v in before.items() for x in (k, v)])[F.col("part")] if before else F.lit(0)
    return blocks.select((first + F.col("place")).alias("block"), "packed", "ids", "many", "low", "high")


def _pairs(blocks: DataFrame, eps: float, scratch: Scratch) -> DataFrame:
    """(i, j) with i <= j: pairs of blocks whose boxes aren't provably distant, by recursion over intervals of the sequence."""
    levels, n = [blocks.select("block", "low", "high")], blocks.count()
    size = n
    while size > 1:
        up = levels[-1].select(F.expr(f"block div {FAN}").alias("block"), F.posexplode(F.arrays_zip("low", "high")).alias("k", "x")).groupBy("block", "k").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high")).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("k", "low", "high"))).alias("x")).select("block", F.col("x.low").alias("low"), F.col("x.high").alias("high"))
        levels.append(scratch.save(up))
        size = -(-size // FAN)
    pairs = levels[-1].select(F.col("block").alias("i"), F.col("block").alias("j"))
    for level in reversed(levels[:-1]):
        steps = F.sequence(F.lit(0), F.lit(FAN - 1))
        finer = pairs.select("i", "j", F.explode(steps).alias("a")).select((F.col("i") * FAN + F.col("a")).alias("i"), "j", F.explode(steps).alias("b")).select("i", (F.col("j") * FAN + F.col("b")).alias("j")).filter("i <= j")
        boxes = lambda x: level.select(F.col("block").alias(x), F.col("low").alias(f"low_{x}"), F.col("high").alias(f"high_{x}"))  # noqa: E731, B023
        met = finer.join(boxes("i"), "i").join(boxes("j"), "j")
        gap = F.transform(F.arrays_zip("low_i", "high_i", "low_j", "high_j"), lambda x: F.greatest(F.lit(0.0), x["low_i"] - x["high_j"], x["low_j"] - x["high_i"]))
        apart = F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x)
        pairs = scratch.save(met.filter(apart <= (eps + ROOM) ** 2).select("i", "j"))
    return pairs


def _pair_joiner(dim: int, threshold: float):
    """The work on one pair of blocks, or on one with itself: rows of links by vector and of edges that span them."""

    def work(rows):
        sides = {x["side"]: _Side(x["packed"], x["ids"], x["many"], dim) for x in rows.to_pylist()}
        left, right = sides[0], sides.get(1, sides[0])
        edges = np.array(sorted(stars(join_blocks(left, right, len(sides) == 1, threshold)).items()), np.int64).reshape(-1, 2)
        src = np.concatenate([edges[:, 0], *(x.id[x.links > 0] for x in sides.values())])
        none, n = pa.nulls(len(src) - len(edges), pa.int64()), np.concatenate([x.links[x.links > 0] for x in sides.values()])
        return pa.table({"src": src, "dst": pa.concat_arrays([pa.array(edges[:, 1]), none]), "n": pa.concat_arrays([pa.nulls(len(edges), pa.int64()), pa.array(n)])})

    return work


def embedding_components(vectors: DataFrame, threshold: float = THRESHOLD, block: int | None = None) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, n_links, component_id, kept for every row.

    Vectors that are null, zero or have null or non-finite components link with nothing: 0 links, a component of their own. Vectors of another
    length than most are joined in a pass of their own length. Equal vectors (by a hash of 128 bits) link with each other and have equal
    links; repeated rows count as vectors. Links run from vector to vector: different vectors under one id are not linked by it, and those without an id link like any other, but
    name no component (null if it has no id at all). An empty table gives an empty result; further columns are ignored.
    block: the most vectors in a block, by default as many as BLOCK_BYTES hold.
    """
    scratch = Scratch(vectors.sparkSession, "embedding")
    eps = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    clean = scratch.save(_clean(vectors))
    groups = clean.filter("v is not null").groupBy("a", "b").agg(F.min("vec_id").alias("least"), F.first("v").alias("v"), F.count(F.lit(1)).alias("many"))
    groups = scratch.save(groups.withColumn("vec_id", F.monotonically_increasing_id()))  # a number for each distinct vector
    told = None
    for (dim,) in groups.select(F.size("v")).distinct().collect():
        of_dim = groups.filter(F.size("v") == dim).select("vec_id", "v", "many")
        axes = principal_axes(of_dim, dim)
        blocks = _ordered_blocks(of_dim, axes, dim, eps, block or max(LEAF, BLOCK_BYTES // (8 * dim)), scratch)
        pairs = _pairs(blocks, eps, scratch)

        side = lambda p, k, c: p.join(blocks, p[c] == blocks.block).select("i", "j", F.lit(k).alias("side"), "packed", "ids", "many")  # noqa: E731, B023
        both = side(pairs, 0, "i").unionByName(side(pairs.filter("i < j"), 1, "j"))
        found = scratch.save(both.groupBy("i", "j").applyInArrow(_pair_joiner(dim, threshold), "src long, dst long, n long"))
        told = found if told is None else told.unionByName(found)
    alone = clean.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if told is None:
        return alone
    counts, links = told.filter("dst is null").groupBy("src").agg(F.sum("n").alias("n")), told.filter("dst is not null").select("src", "dst")
    of = connected_components(links, scratch)
    labels = groups.select("a", "b", "vec_id", "least", "many").join(counts, F.col("vec_id") == F.col("src"), "left").join(of, F.col("vec_id") == F.col("node"), "left")
    labels = scratch.save(labels.select("a", "b", "least", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("part")))
    smallest = labels.groupBy("part").agg(F.min("least").alias("component_id"))
    labels = labels.select("a", "b", "n_links", "part").join(smallest, "part").select("a", "b", "n_links", "component_id", F.lit(True).alias("met"))
    component = F.when(F.col("met"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id")
    joined = clean.select("vec_id", "a", "b").join(labels, ["a", "b"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component)
    return joined.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
