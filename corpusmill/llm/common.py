"""What several operators share: scratch tables, gapless numbering, components of a graph."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window


#: The scratch folder of sessions on one machine that name none.
_TEMPORARY: list[str] = []


def stars(edges) -> dict[int, int]:
    """node -> smallest node of its component, for a task's own bounded edges; nodes that are their component's smallest are absent."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Lets Python workers that run beside the driver import this package; on a cluster it is installed or given by --py-files."""
    home = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if home not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{home}:{known}".rstrip(":")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a temporary one where it is unset and all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _TEMPORARY:
        _TEMPORARY.append("file://" + tempfile.mkdtemp(prefix="spark-scratch-"))
    return _TEMPORARY[0]


class Scratch:
    """Tables written to the shared folder: they cut lineage, survive lost executors and are read by column."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        ship(spark)
        self.base = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, number: int) -> None:
        """Deletes a table that no later plan reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{number}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def number_rows(df: DataFrame, group: str, keys: list[Column], total: int, name: str = "slot", share: int = 200_000) -> DataFrame:
    """Adds a number for each row of a group, from 0 without gaps, with no group in one task.

    Rows of a group are dealt to buckets by a hash of keys, numbered in each bucket, and shifted
    by the rows of the buckets before. The table of shifts has total / share rows for each group.
    """
    buckets = max(16, -(-total // share))
    dealt = df.withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(group, "_b").orderBy(*keys)
    numbered = dealt.withColumn("_r", F.row_number().over(inside) - 1)
    return numbered.join(shift, [group, "_b"]).withColumn(name, (F.col("_before") + F.col("_r")).cast("long")).drop("_b", "_r", "_before")


def connected_components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(src, dst) long pairs -> (node, component), the smallest node reachable; nodes without an edge are absent.

    Alternates large-star and small-star steps until the edges rest. A step takes each node's
    smallest neighbour by a grouped minimum, which is combined before the shuffle, and joins it back,
    which Spark can split where a node has very many neighbours. Lineage is cut after each round.
    """
    e = scratch.save(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    mark = lambda x: x.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = scratch.save(large)
        if mark(large) == mark(e):  # only stars are left as they are
            return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        number = scratch.count
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # Each neighbour and the node itself go to the smallest: as many edges as before, whatever repeats.
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        e = scratch.save(small)
        scratch.drop(number)
        scratch.drop(number - 1)
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def add_columns(df: DataFrame, fields: list[T.StructField], compute: Callable[[pa.RecordBatch], list], rows: int = 1024) -> DataFrame:
    """Adds columns computed batch by batch in Arrow tasks, without a shuffle; input columns of these names are replaced.

    compute gets a batch of at most rows rows and returns a list of values for each field.
    """
    ship(df.sparkSession)
    mine = {f.name.lower() for f in fields}
    kept = df.select([c for c in df.columns if c.lower() not in mine])
    types = [to_arrow_type(f.dataType) for f in fields]
    names = kept.columns + [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                added = [pa.array(v, t) for v, t in zip(compute(batch), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=names)

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *fields]))
