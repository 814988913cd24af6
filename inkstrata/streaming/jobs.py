"""Incremental and streaming operators: resumable appends, per-key state, stale jobs, event windows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def append_new(stream: DataFrame, path: str, keys: list[str], checkpoint: str):
    """A query that appends each micro-batch's rows whose keys aren't in path yet."""
    from ..sources.files import _exists, pending

    def sink(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(keys)
        if _exists(spark, path):
            fresh = pending(fresh, spark.read.parquet(path), keys)
        fresh.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rolling(stream: DataFrame, key: str, order: str, value: str, step) -> DataFrame:
    """(key, n, state): per-key state = step(state, value) over a stream's rows, in order within each batch; `in_order` orders across batches."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def update(k, pdfs, state):
        text, n = state.get if state.exists else ("", 0)
        # A key's rows come in several pieces, each in any order.
        for v in pd.concat(list(pdfs)).sort_values(order, kind="stable")[value].tolist():
            text, n = step(text, v), n + 1
        state.update((text, n))
        yield pd.DataFrame({key: [k[0]], "n": [n], "state": [text]})

    kind = dict(stream.dtypes)[key]
    return stream.select(key, order, value).groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n long, state string", "text string, n long", "update", GroupStateTimeout.NoTimeout)


def stale(lines: DataFrame, now, job: str = "job", at: str = "ts", minutes: int = 10) -> DataFrame:
    """Jobs that are ready and had work at their last throughput line, but have been silent for `minutes`.

    lines(job, ts, kind in 'start' | 'ready' | 'load' | other, running, waiting); lines before the latest start don't count. `now` is a time or a
    Column, such as a scalar subquery.
    """
    start = F.max(F.when(F.col("kind") == "start", F.col(at))).over(Window.partitionBy(job))
    live = lines.withColumn("_start", start).where(F.col("_start").isNull() | (F.col(at) >= F.col("_start")))
    load = F.when(F.col("kind") == "load", F.struct(at, (F.col("running") + F.col("waiting")).alias("work")))
    got = live.groupBy(job).agg(F.max((F.col("kind") == "ready").cast("int")).alias("ready"), F.max(load).alias("load"), F.max(at).alias("last"))
    idle = F.col("last") < (now if isinstance(now, Column) else F.lit(now)) - F.expr(f"INTERVAL {int(minutes)} MINUTES")
    return got.where((F.col("ready") == 1) & (F.col("load.work") > 0) & idle).select(job, "last", F.col("load.work").alias("work"))


def windowed(events: DataFrame, at: str, key: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of a value by key and tumbling window; on a stream, late rows beyond the watermark are left out."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    got = rows.groupBy(F.window(at, width), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return got.select(F.col("window.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, at: str, key: str, gap: str = "30 minutes") -> DataFrame:
    """Sessions of a key: runs of rows no further apart than the gap."""
    rows = events.withWatermark(at, gap) if events.isStreaming else events
    return rows.groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")
