"""Structured Streaming forms of the clock-based rules."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.history import billable, notifications
from ..sources.files import exists

DELAY = "1 hour"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def usage_windows(usage: DataFrame, size: str = "24 hours", slide: str = "1 hour", delay: str = DELAY) -> DataFrame:
    """Billable actions per user in sliding windows."""
    return usage.where(billable()).withWatermark("ts", delay).groupBy(F.window("ts", size, slide).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def rate_limits(rows: DataFrame, key: str, limit: int, every: str = "1 hour", delay: str = DELAY) -> DataFrame:
    """Tumbling windows with more than `limit` rows of a key."""
    return rows.withWatermark("ts", delay).groupBy(F.window("ts", every).alias("w"), key).agg(F.count("*").alias("n")).where(F.col("n") > limit).select(key, F.col("w.start").alias("start"), "n")


def sessions(rows: DataFrame, gap: str = "30 minutes", delay: str = DELAY) -> DataFrame:
    """User sessions: rows with no gap longer than `gap`."""
    return rows.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def live_notifications(rows: DataFrame, delay: str = DELAY) -> DataFrame:
    """Notices, each id once within the watermark."""
    return notifications(rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id"]))


class QuotaClock(StatefulProcessor):
    """Exact counts of a user's billable actions as each happens: rows wait until the watermark has passed them, so that order of arrival doesn't matter.

    State of a user: the times of the last 30 days, and the rows that wait. A timer stands at the first of those.
    """

    DAY, MONTH = 24 * 3_600_000_000, 30 * 24 * 3_600_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.past = handle.getListState("past", "ts long")
        self.waiting = handle.getListState("waiting", "ts long, id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(t), int(i)) for b in rows for t, i in zip(b["us"], b["id"], strict=True)]
        self.waiting.appendList(new)
        self.handle.registerTimer(min(t for t, _ in new) // 1000)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get())
        ready, later = [r for r in rows if r[0] <= mark], [r for r in rows if r[0] > mark]
        if not ready:
            return
        times = sorted([t for (t,) in self.past.get()] + [t for t, _ in ready])
        out = []
        for t, i in ready:
            upto, day = bisect_right(times, t), bisect_left(times, t - self.DAY)
            out.append((key[0], i, upto - day, upto - bisect_left(times, t - self.MONTH), (times[day] + self.DAY - t) // 3_600_000_000))
        self.past.put([(t,) for t in times if t >= mark - self.MONTH])
        self.waiting.put(later) if later else self.waiting.clear()
        if later:
            self.handle.registerTimer(later[0][0] // 1000)
        yield pd.DataFrame(out, columns=["user_id", "id", "used_24h", "used_30d", "hours"])


def live_quota(usage: DataFrame, delay: str = DELAY) -> DataFrame:
    """(user_id, id, used_24h, used_30d, hours) for each billable action of usage(id, user_id, action, ts): the user's billable actions in the 24 hours and 30 days up to
    it, and whole hours until the first of the 24 hours' leaves the window. Exact, once the watermark has passed the action."""
    usage.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # what this kind of state needs
    rows = usage.where(billable() & F.col("user_id").isNotNull()).withWatermark("ts", delay).select("user_id", "id", "ts", F.unix_micros("ts").alias("us"))
    return rows.groupBy("user_id").transformWithStateInPandas(QuotaClock(), "user_id long, id long, used_24h long, used_30d long, hours long", "Append", "EventTime")


def run_available(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now into Parquet at path; the table written."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", f"{path}-log").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def batch_writer(path: str, work: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch has a folder of its own, by its number, which a batch that runs again overwrites. So every row is there once."""

    def step(batch: DataFrame, n: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return step


def read_batches(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What batch_writer has written so far, as one table; empty before its first batch."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def per_batch(stream: DataFrame, path: str, work: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> DataFrame:
    """Runs a batch transformation on each micro-batch (whole works arriving); what it has written, each batch once."""
    q = stream.writeStream.foreachBatch(batch_writer(path, work)).option("checkpointLocation", f"{path}-log").trigger(availableNow=True).start()
    q.awaitTermination()
    spark = stream.sparkSession
    return read_batches(spark, path, work(spark.createDataFrame([], stream.schema)).schema)


def stream_table(spark: SparkSession, folder: str, name: str, files_per_batch: int = 10) -> DataFrame:
    """A stream of a folder's table file or files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
