"""Helpers that the corpus operators share: the shared folder, and Arrow buffers seen as numpy arrays."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql import functions as F

#: A numpy step works on about so many bytes of text at once, so that its arrays stay near the CPU's caches.
CHUNK_BYTES = 1 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession) -> None:
    """Set the checkpoint folder: the one that spark.checkpoint.dir names. Where that is unset, a session in one process (tests) gets a
    folder of its own, and a cluster is refused: its machines have no folder in common that could be guessed."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="inkstrata-checkpoint-")
    spark.sparkContext.setCheckpointDir(named)


#: Spark's own switch: a query's shuffle files go when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there: no lineage, no recomputation, nothing lost with an executor. What was
    shuffled for it is removed once it is written.

    A checkpoint keeps the size that its plan was estimated at. These are products over joins, and after some dozens of cuts numbers
    of megabytes that the driver multiplies for each plan, so the result is a table of unknown size instead.
    """
    spark = df.sparkSession
    shared(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        done = df.select("*").checkpoint(True)._jdf  # a plan of its own, made under the setting
        return DataFrame(spark._jsparkSession.internalCreateDataFrame(done.queryExecution().toRdd(), done.schema(), False), spark)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def written(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: what follows starts from files that every executor reaches."""
    spark = df.sparkSession
    shared(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Integer vectors of a squared length under this have products and squared distances that fit a long, with factors up to 100.
LENGTH_BOUND = float(1 << 56)


def cells(column: str, scale: int = 256) -> tuple[Column, Column]:
    """(integer components, whether they can be had) of a vector column: floor(scale * x), for vectors that are not null, hold
    neither null nor non-finite components, and stay under LENGTH_BOUND."""
    x = F.transform(F.col(column).cast("array<double>"), lambda v: v * scale)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LENGTH_BOUND))
    short = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.floor(v).cast("double") * F.floor(v)) < LENGTH_BOUND
    return F.transform(x, lambda v: F.floor(v).cast("int")), F.col(column).isNotNull() & fine & short


#: Rows in a batch that goes to a Python worker, where the session has Spark's default of 10,000: texts are long.
BATCH_ROWS = "1000"


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers and of the buffers beside them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name in taken:
        name += "_"
    return name


def buffers(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, valid) of a string or binary column; offsets has one entry more than there are rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n, large = len(column), pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    valid = np.asarray(column.is_valid()) if column.null_count else np.ones(n, bool)
    _, ends, data = column.buffers()
    if n == 0 or ends is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), valid
    kind = np.int64 if large else np.int32
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0], valid


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most `most` bytes each, or of one row that is longer."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words under which nearby words part (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, 1 << 64))
        take = min(done, n - done)
        out[done : done + take] = out[:take] * step
        done += take
    return out[:n]


BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def power_table(base: int, n: int) -> np.ndarray:
    """powers(base, at least n), kept for the next call."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = _POWERS[base] = powers(base, max(n, 2 * CHUNK_BYTES))
    return have


def byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN)


BYTE_VALUES = byte_values()


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of values[t] * BASE ** t over i <= t < j; one entry more than values."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power_table(BASE, len(values) + 1)[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, the same wherever the span stands."""
    raw = (prefix[end] - prefix[start]) * power_table(INVERSE, len(prefix))[start]
    return mix(raw ^ ((end - start).astype(np.uint64) * GOLDEN))


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c of counts, in a row."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64) - np.repeat(ends - counts, counts)


def words_of(body: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes b with keep[b] inside each row: (start, end, row)."""
    inside = keep[body]
    edge = np.zeros(len(body) + 1, bool)
    edge[offsets[(offsets >= 0) & (offsets <= len(body))]] = True
    before = np.concatenate(([False], inside[:-1])) if len(body) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1])) if len(body) else np.zeros(0, np.int64)
    after = np.concatenate((inside[1:], [False])) if len(body) else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1 if len(body) else np.zeros(0, np.int64)
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def text_of(df: DataFrame, column: str = "text"):
    """The column as text, whatever its type."""
    return F.col(column).cast("string")
