"""Structured Streaming jobs over the append-only logs and the inbox of files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.session import saved, ship
from ..functions.text import content_hash
from ..operators.maintenance import incremental_changes

FEEDBACK = "id string, timestamp timestamp, rating int, question string, answer string, model string"


def stream_feedback(stream: DataFrame) -> DataFrame:
    """Running totals for output mode complete; the same columns as the batch summary. Malformed lines have no rating and count in total only if they have an id."""
    return stream.filter("id is not null").agg(F.count_if(F.col("rating") > 0).alias("up"), F.count_if(F.col("rating") < 0).alias("down"), F.count(F.lit(1)).alias("total"))


def trace_windows(traces: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count, mean and approximate p95 of latency in tumbling or sliding event-time windows; later rows than the watermark are dropped. Works on a batch too."""
    marked = traces.withWatermark("ts", late) if traces.isStreaming else traces
    span = F.window("ts", size, slide) if slide else F.window("ts", size)
    return marked.groupBy(span.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("latency"), 6).alias("mean"), F.percentile_approx("latency", 0.95, 10_000).alias("p95")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "mean", "p95")


#: The k of a quantile sketch, and the share of rows by which a quantile's rank may be off with it (99 in 100 windows are within a third of it).
SKETCH_K, RANK_ERROR = 400, 0.025


def trace_quantiles(traces: DataFrame, size: str = "1 hour", slide: str = "15 minutes", late: str = "10 minutes", k: int = SKETCH_K) -> DataFrame:
    """traces(ts, latency) -> window_start, window_end, n, mean, p50, p95 of sliding windows; of a stream in append mode, a row once the watermark has passed its window's end.

    A row goes into one pane, as long as the slide, whose state is a count, a sum and a mergeable quantile sketch of k; the windows merge the sketches of their
    panes, so neither state nor work grows with the rows of a window or with size / slide. Ranks of p50 and p95 are off by RANK_ERROR at most; n and mean are exact. size is a
    whole number of slides. Rows without time are left out; those without latency count in n only, and a window without any has null quantiles.
    """
    known = traces.filter("ts is not null")
    marked = known.withWatermark("ts", late) if traces.isStreaming else known
    panes = marked.groupBy(F.window("ts", slide).alias("pane")).agg(F.count(F.lit(1)).alias("n"), F.count("latency").alias("m"), F.sum("latency").alias("s"), F.kll_sketch_agg_double(F.col("latency").cast("double"), F.lit(k)).alias("sketch"))
    held = panes.select(F.window_time("pane").alias("at"), "n", "m", "s", "sketch")
    merged = held.groupBy(F.window("at", size, slide).alias("w")).agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum("s").alias("s"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))
    at = lambda q: F.when(F.col("m") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(q)))
    return merged.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", (F.col("s") / F.col("m")).alias("mean"), at(0.5).alias("p50"), at(0.95).alias("p95"))


def sessions(events: DataFrame, hours: int = 24) -> DataFrame:
    """Batch twin of stream_sessions: events(user_id long, ts, ...) with session (number in the user, from 1) and session_start; rows without user or time are left out.

    A session ends hours after its first event, however many follow. Events are sorted by user and time, and a task walks through them keeping the open
    session's start and number only, so a user with very many events needs no memory; a batch is cut into sessions by binary search.
    """
    ship(events.sparkSession)
    span = hours * 3_600_000_000
    fields = [*events.schema.fields, T.StructField("session", T.IntegerType()), T.StructField("session_start", events.schema["ts"].dataType)]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user = start = None
        number = 0
        for b in batches:
            who, at = b.column("user_id").to_numpy(zero_copy_only=False), b.column("ts").cast(pa.int64()).to_numpy(zero_copy_only=False)
            session, begin = np.zeros(len(who), np.int32), np.zeros(len(who), np.int64)
            i = 0
            while i < len(who):
                if who[i] != user:
                    user, start, number = who[i], None, 0
                if start is None or at[i] >= start + span:
                    start, number = at[i], number + 1
                end = i + int(np.searchsorted(who[i:], user, side="right"))
                j = i + int(np.searchsorted(at[i:end], start + span))
                session[i:j], begin[i:j] = number, start
                i = j
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(session), pa.array(begin).cast(b.column("ts").type)], names=[f.name for f in fields])

    return events.filter("user_id is not null and ts is not null").repartition("user_id").sortWithinPartitions("user_id", "ts").mapInArrow(walk, T.StructType(fields))


#: The setting and the value that stream_sessions needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
SESSION_ROWS = "user_id long, session int, session_start timestamp, n long, late long, closed boolean"


def _session_state(hours: int, keep_ms: int):
    """The state of stream_sessions: the open session of a user (number, start, rows, late rows), a timer at its end and one that forgets the user."""
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    span = hours * 3_600_000_000

    class Sessions(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.open = handle.getValueState("open", "number int, start long, n long, late long, ended boolean")

        def _rows(self, user, rows) -> pd.DataFrame:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            return pd.DataFrame({"user_id": pd.Series([user] * len(rows), dtype="int64"), "session": pd.Series(columns[0], dtype="int32"), "session_start": pd.to_datetime(pd.Series(columns[1], dtype="int64"), unit="us"), "n": pd.Series(columns[2], dtype="int64"), "late": pd.Series(columns[3], dtype="int64"), "closed": pd.Series(columns[4], dtype="bool")})

        def handleInputRows(self, key, rows, timerValues):
            times = np.sort(np.concatenate([f["ts"].to_numpy().astype("datetime64[us]").astype(np.int64) for f in rows]))
            number, start, n, late, ended = self.open.get() if self.open.exists() else (0, None, 0, 0, False)
            told, i = [], 0
            if start is not None:
                i = int(np.searchsorted(times, start))  # before the open session: theirs is closed
                late += i
                if i and i == len(times):
                    told.append((number, start, n, late, ended))
            while i < len(times):
                if start is None or times[i] >= start + span:
                    if start is not None and not ended:
                        told.append((number, start, n, late, True))
                    number, start, n, late, ended = number + 1, int(times[i]), 0, 0, False
                j = int(np.searchsorted(times, start + span))
                n, i = n + j - i, j
                if i == len(times):
                    told.append((number, start, n, late, ended))
            self.open.update((number, start, n, late, ended))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((start + span) // 1000 + ended * keep_ms)
            yield self._rows(key[0], told)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            number, start, n, late, ended = self.open.get()
            if ended:
                self.open.clear()
                yield self._rows(key[0], [])
            else:
                self.open.update((number, start, n, late, True))
                self.handle.registerTimer((start + span) // 1000 + keep_ms)
                yield self._rows(key[0], [(number, start, n, late, True)])

        def close(self) -> None:
            pass

    return Sessions()


def stream_sessions(stream: DataFrame, hours: int = 24, late: str = "1 hour", keep_days: int = 30) -> DataFrame:
    """events(user_id, ts) -> user_id, session, session_start, n, late, closed, a row whenever a session changes: its last row holds.

    A session ends hours after its first event; a timer says so once the watermark has passed its end. State is one row a user, which a second timer forgets keep_days of event time after the
    session's end: a user who comes back later starts from session 1. A micro-batch's times of a user are sorted and cut by binary search. Rows older than the watermark are dropped by Spark; those before the open
    session's start belong to a closed one and are counted in late of the open one, in no n. Rows without user or time are left out. Needs the RocksDB state store: see
    STATE_STORE.
    """
    ship(stream.sparkSession)
    marked = stream.filter("user_id is not null and ts is not null").select(F.col("user_id").cast("long").alias("user_id"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return marked.groupBy("user_id").transformWithStateInPandas(_session_state(hours, keep_days * 86_400_000), SESSION_ROWS, "Update", "EventTime")


def current_chunks(spark: SparkSession, table: str) -> DataFrame:
    """The chunks of each document's newest batch."""
    every = spark.read.parquet(table)
    newest = every.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return every.join(newest, ["doc_id", "batch"]).filter("chunk_id is not null")


def ingest(stream: DataFrame, table: str, chunker: Callable[[DataFrame], DataFrame], checkpoint: str):
    """A stream of doc_id, text through hash check and chunker into the Parquet table.

    Each micro-batch adds a partition with the chunks of its new and changed documents only, and one row without a chunk for each of them, which keeps the hash of a
    document that has no chunks; a batch that is tried again replaces its partition. current_chunks reads what holds now.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        current = saved(batch.dropDuplicates(["doc_id"]).withColumn("content_hash", content_hash(F.coalesce("text", F.lit("")))), "ingest")
        folder = spark._jvm.org.apache.hadoop.fs.Path(table)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            known = spark.read.parquet(table).filter(F.col("batch") < number)
            newest = known.groupBy("doc_id").agg(F.max_by("content_hash", "batch").alias("content_hash"))
            current = incremental_changes(current, newest, "doc_id").filter("change <> 'unchanged'").drop("change")
        fresh = chunker(current.select("doc_id", "text")).select("doc_id", "chunk_index", "text", "chunk_id").join(current.select("doc_id", "content_hash"), "doc_id")
        marks = current.select("doc_id", "content_hash")
        fresh.unionByName(marks, allowMissingColumns=True).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.select("doc_id", "text").writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_ingest(spark: SparkSession, inbox: str, table: str, chunker: Callable[[DataFrame], DataFrame], checkpoint: str):
    """New files of inbox through ingest, one document a file."""
    files = spark.readStream.option("wholetext", True).text(inbox).select(F.col("_metadata.file_name").alias("doc_id"), F.col("value").alias("text"))
    return ingest(files, table, chunker, checkpoint)
