"""Streams of items and runs. Each job is a function of a streaming DataFrame."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener


def read_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def daily_window_counts(items: DataFrame, ts: str = "ts", key: str = "source_id", late: str = "2 days") -> DataFrame:
    """Items of each key in windows of a day that start at 10:00; report_day is the day on which a window ends."""
    windowed = items.withColumn("_ts", F.to_utc_timestamp(F.col(ts), F.current_timezone())) if dict(items.dtypes)[ts] == "timestamp_ntz" else items.withColumn("_ts", F.col(ts))
    marked = windowed.withWatermark("_ts", late) if items.isStreaming else windowed
    counts = marked.groupBy(F.window("_ts", "1 day", "1 day", "10 hours").alias("w"), key).agg(F.count(F.lit(1)).alias("items"))
    return counts.select(F.to_date("w.end").alias("report_day"), key, "items")


def ingest_stream(items: DataFrame, store: Callable[[DataFrame, int], None], checkpoint: str, late: str = "2 days") -> StreamingQuery:
    """One row per canonical URL within the watermark goes to `store` (which removes URLs that it holds already). Rows
    behind the watermark are counted by the query's own metric of dropped rows."""
    unique = items.withWatermark("crawl_time", late).dropDuplicatesWithinWatermark(["canonical_url"])
    return unique.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_counts(items: DataFrame, start: Any, end: Any, name: str = "ingest") -> DataFrame:
    """items unchanged, with counts of rows outside [start, end) observed under `name`."""
    outside = ~F.coalesce((F.col("publish_time") >= start) & (F.col("publish_time") < end), F.lit(False))
    return items.observe(name, F.count(F.lit(1)).alias("candidates"), F.count_if(outside).alias("outside_window"))


class BatchStore:
    """Stored output of a stream, a folder for each batch, so that a batch that runs again replaces its own rows.

    A batch sees what earlier ones hold, never what itself or a later one has written before a failure, so it writes the
    same rows again. Rows count from the moment their batch's folder has its _SUCCESS marker."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str):
        self.spark, self.path, self.keys, self.schema = spark, path.rstrip("/"), keys, schema

    def _committed(self) -> list[int]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch_id=*/_SUCCESS")
        found = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(where)
        return sorted(int(x.getPath().getParent().getName().split("=")[1]) for x in found or ())

    def read(self, before: int | None = None) -> DataFrame:
        """The rows of all committed batches, or of those before one."""
        paths = [f"{self.path}/batch_id={n}" for n in self._committed() if before is None or n < before]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def __call__(self, batch: DataFrame, n: int) -> None:
        """For foreachBatch: the rows whose keys no earlier batch holds."""
        new = batch.join(self.read(n).select(*self.keys), self.keys, "left_anti")
        new.select(*self.read(n).columns).write.mode("overwrite").parquet(f"{self.path}/batch_id={n}")


class BatchCounts(StreamingQueryListener):
    """What the engine says of each batch: rows read, the counts observed under `name`, and rows that came behind the
    watermark and were dropped by stateful operators. Add it to spark.streams before a query starts."""

    def __init__(self, name: str = "ingest"):
        self.name, self.counts, self.ended = name, {}, threading.Event()

    def onQueryStarted(self, event: Any) -> None:
        self.ended.clear()

    def onQueryProgress(self, event: Any) -> None:
        p = event.progress
        seen = (p.observedMetrics or {}).get(self.name)
        dropped = sum(x.numRowsDroppedByWatermark for x in p.stateOperators)
        # a batch that runs again counts once
        self.counts[p.batchId] = (p.batchId, p.numInputRows, seen["candidates"] if seen else 0, seen["outside_window"] if seen else 0, dropped)

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        self.ended.set()

    def rows(self, spark: SparkSession, wait: float = 60) -> DataFrame:
        """(batch_id, input_rows, candidates, outside_window, dropped_late) of the batches that had input, after the query."""
        if not self.ended.wait(wait):
            raise TimeoutError("the query has not ended")
        kept = [c for c in self.counts.values() if c[1]]
        return spark.createDataFrame(sorted(kept), "batch_id long, input_rows long, candidates long, outside_window long, dropped_late long")


class StreakProcessor(StatefulProcessor):
    """Per source: passes items until `streak` older ones have come since the last one inside the window."""

    def __init__(self, streak: int = 10):
        self.streak = streak

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("older", "older int, stopped boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        older, stopped = tuple(self.state.get()) if self.state.exists() else (0, False)
        kept = []
        for row in pd.concat(list(rows)).sort_values("position").itertuples():
            if stopped:
                continue
            older = 0 if row.in_window else older + int(row.before_window)
            stopped = older >= self.streak
            kept.append((key[0], row.position))
        self.state.update((older, stopped))
        yield pd.DataFrame(kept, columns=["source_id", "position"])

    def close(self) -> None:
        pass


def streak_state(links: DataFrame, streak: int = 10) -> DataFrame:
    """The cut after a streak of older items, kept per source across batches."""
    return links.groupBy("source_id").transformWithStateInPandas(StreakProcessor(streak), "source_id long, position long", "Append", "none")
