"""Log files of generation jobs as the lines that jobs.stale and stateful.silent watch.

A job is a folder; `server` is the log that its server appends to across restarts, `worker` the log that says when it is ready.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What the servers and workers write.
THROUGHPUT = r"INFO (\d\d-\d\d \d\d:\d\d:\d\d) .*Avg generation throughput: ([\d.]+) tokens/s, Running: (\d+) reqs, Waiting: (\d+) reqs"
STARTED = "Application startup complete"
READY = "READY"
# End of fixed values.


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(job, log, n, line): the numbered lines of <path>/<job>/<log>.log. A log is one row until it is split."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.log").text(path).select("value", F.input_file_name().alias("_file"))
    name = lambda k: F.regexp_extract("_file", r"([^/]+)/([^/]+)\.log$", k)
    return files.select(name(1).alias("job"), name(2).alias("log"), F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))


def events(rows: DataFrame, year: int, server: str = "server", worker: str = "worker") -> DataFrame:
    """(job, ts, kind, running, waiting, rate) of numbered lines: 'load' for throughput lines, 'start' for a server's start, 'ready' for a ready worker.

    Stamps have no year, so it is given. A start has no stamp: it counts as the next throughput line of its log, or as a second after the last
    one. A ready line counts as the job's last stamp, as a worker says it once. Other and torn lines give nothing, nor does a job without a stamp.
    """
    own = rows.where(F.col("log") == server)
    part = lambda k: F.regexp_extract("line", THROUGHPUT, k)
    stamp = F.when(part(1) != "", F.try_to_timestamp(F.concat(F.lit(f"{year}-"), part(1)), F.lit("yyyy-MM-dd HH:mm:ss")))
    kind = F.when(stamp.isNotNull(), "load").when(F.contains("line", F.lit(STARTED)), "start")
    own = own.select("job", "n", stamp.alias("stamp"), kind.alias("kind"), F.nullif(part(3), F.lit("")).try_cast("int").alias("running"), F.nullif(part(4), F.lit("")).try_cast("int").alias("waiting"), F.nullif(part(2), F.lit("")).try_cast("double").alias("rate")).where("kind is not null")
    order = Window.partitionBy("job").orderBy("n")
    after = F.first("stamp", True).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    before = F.last("stamp", True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    served = own.withColumn("ts", F.coalesce(after, before + F.expr("INTERVAL 1 SECOND"))).where("ts is not null").select("job", "ts", "kind", "running", "waiting", "rate")
    last = served.groupBy("job").agg(F.max("ts").alias("ts"))
    ready = rows.where((F.col("log") == worker) & F.contains("line", F.lit(READY))).select("job").distinct().join(last, "job")
    none = F.lit(None)
    return served.unionByName(ready.select("job", "ts", F.lit("ready").alias("kind"), none.cast("int").alias("running"), none.cast("int").alias("waiting"), none.cast("double").alias("rate")))
