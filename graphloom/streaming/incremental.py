"""Structured Streaming: growing knowledge bases, event-time windows, sessions, session state, progress and cancellation."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed(events: DataFrame, every: str = "1 day", late: str = "10 minutes", ts: str = "ts", key: str = "event_type") -> DataFrame:
    """(window_start, key, n, total): tumbling windows of event time; rows later than late are dropped from a stream."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    return e.groupBy(F.window(ts, every).alias("w"), key).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")).select(F.col("w.start").alias("window_start"), key, "n", "cents")


def sliding(events: DataFrame, size: str = "2 days", slide: str = "1 day", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    e = events.withWatermark(ts, late) if events.isStreaming else events
    return e.groupBy(F.window(ts, size, slide).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "10 minutes", ts: str = "ts", key: str = "user_id") -> DataFrame:
    """(key, session_start, session_end, n): runs of a key's events with gaps below gap."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    return e.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def grow(stream: DataFrame, target: str, keys: list[str], checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None, select: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Merge each batch of a stream into target: rows whose keys are there already stay as they are. A batch is written under its own
    number, so a batch that is run again after a failure replaces its own rows and nothing else: exactly once. select: what of a batch goes on."""

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = (select(batch) if select else batch).dropDuplicates(keys)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            names = F.regexp_extract(F.input_file_name(), r"batch=(\d+)/", 1).cast("long")
            old = spark.read.schema(new.schema).parquet(f"{target}/batch=*").where(names != n).select(*keys).distinct()
            new = new.join(old, keys, "left_anti")
        new.write.mode("overwrite").parquet(f"{target}/batch={n}")
        if on_batch:
            on_batch(new, n)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_grown(spark: SparkSession, target: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{target}/batch=*")


def enrich(pages: DataFrame, queries: DataFrame, target: str, checkpoint: str, least: float = 0.3) -> StreamingQuery:
    """Pages of a stream (page_id, url, content, fidelity) that answer a planned query, added to target batch by batch, each page once."""
    from ..operators.build import enrichment_pages

    def chosen(batch: DataFrame) -> DataFrame:
        return enrichment_pages(queries, batch, least).select("page_id", "query", "url", "content", "fidelity")

    return grow(pages, target, ["page_id"], checkpoint, select=chosen)


def conversation_state(turns: DataFrame) -> DataFrame:
    """A session's turns so far, appended batch by batch: for each update (conv_id, n, last). Rows: conv_id, turn, role, text."""
    import pandas as pd

    def step(key, frames, state):
        n, last, at = state.get if state.exists else (0, None, -1)
        for f in frames:
            f = f.sort_values("turn")
            n += len(f)
            if len(f) and int(f["turn"].iloc[-1]) > at:
                at, last = int(f["turn"].iloc[-1]), str(f["text"].iloc[-1])
        state.update((n, last, at))
        yield pd.DataFrame({"conv_id": [key[0]], "n": [n], "last": [last]})

    return turns.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, n long, last string", "n long, last string, at long", "update", "NoTimeout")


def conversation_history(turns: DataFrame) -> DataFrame:
    """(conv_id, history) in batch: the turns of each conversation in order."""
    return turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.concat(t.role, F.lit(": "), t.text)).alias("history"))


def progress(query: StreamingQuery) -> list[dict]:
    """Batches so far: number, rows, milliseconds."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "ms": p["batchDuration"] if "batchDuration" in p else None} for p in query.recentProgress]


class Timer:
    """Seconds of a block: with Timer() as t: ...; t.seconds."""

    def __enter__(self):
        self.began, self.seconds = time.monotonic(), 0.0
        return self

    def __exit__(self, *_):
        self.seconds = time.monotonic() - self.began


class Job:
    """A group of Spark jobs that can be cancelled together."""

    def __init__(self, spark: SparkSession, job_id: str):
        self.spark, self.job_id = spark, job_id

    def __enter__(self):
        self.spark.sparkContext.setJobGroup(self.job_id, self.job_id, True)
        return self

    def __exit__(self, *_):
        self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    def cancel(self) -> None:
        self.spark.sparkContext.cancelJobGroup(self.job_id)
