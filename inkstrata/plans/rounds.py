"""A queue of model requests worked off in rounds, each a DataFrame that is written before the next begins.

A round calls the client once for every pending request. A valid reply ends its request. A fault sends it into the next round with the
reply and the fault shown; the last attempt is repaired first if the work has a repair. A request that is out of attempts is split into
requests of one item each, or fails if it has one item. Attempts and levels are bounded, so the queue runs empty after 2 * attempts
rounds at most. Round k is `path`/rounds/k and a line in `path`/progress; a run that stops goes on after the last round with such a line, and
no request of a finished round is sent again.

The state of a request is its row: nothing lives in a task between rounds, and what the driver keeps is a count.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import small_batches
from . import model

DONE, RETRY, SPLIT, FAILED = "done", "retry", "split", "failed"
STATE = "request_id string, parent string, attempt int, shown string, fault string"


@dataclass(frozen=True)
class Work:
    """prompt(row) is a request's text, check(payload, row) gives the result or raises, repair(payload, row) what the last attempt's payload
    becomes; result is the DDL of what check gives. A row has the request's columns, its items (a list of dicts) and the context's columns."""

    prompt: Callable[[dict], str]
    check: Callable[[object, dict], dict]
    result: str
    repair: Callable[[object, dict], object] | None = None
    attempts: int = 3
    max_tokens: int = 12_000


def queue(requests: DataFrame) -> DataFrame:
    """Requests (request_id, items, other columns) as the first round's queue."""
    none = F.lit(None).cast("string")
    return requests.withColumns({"parent": none, "attempt": F.lit(1), "shown": none, "fault": none})


def _plain(column: pa.Array) -> list:
    """column.to_pylist(), with the values of nested rows taken by column and not one by one."""
    kind, whole = column.type, column.null_count == 0
    if pa.types.is_struct(kind) and kind.num_fields:
        names = [f.name for f in kind]
        out = [dict(zip(names, v, strict=True)) for v in zip(*map(_plain, column.flatten()), strict=True)]
    elif pa.types.is_list(kind):
        flat, ends = _plain(column.flatten()), np.cumsum(column.value_lengths().fill_null(0)).tolist()
        out = [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    elif pa.types.is_string(kind) or whole and (pa.types.is_integer(kind) or pa.types.is_boolean(kind)):
        return column.to_numpy(zero_copy_only=False).tolist()
    else:
        return column.to_pylist()
    return out if whole else [v if there else None for v, there in zip(out, column.is_valid().to_pylist(), strict=True)]


def _answers(pending: DataFrame, work: Work, make: Callable[[], model.Client], context: DataFrame | None, on: list[str]) -> DataFrame:
    """pending with status, result, repaired, shown and fault after one call each. Requests are dealt out before, as few and short rows may be much work."""
    pending = pending.repartition(int(pending.sparkSession.conf.get("spark.sql.shuffle.partitions")), *(on or ["request_id"]))
    rows = pending if context is None else pending.join(context, on, "left")
    extra = [T.StructField("status", T.StringType()), T.StructField("repaired", T.BooleanType()), T.StructField("result", T.StructType.fromDDL(work.result))]
    schema = T.StructType([*pending.schema.fields, *extra])
    kinds = to_arrow_schema(schema)

    def one(client: model.Client, row: dict) -> dict:
        messages = [{"role": "user", "content": work.prompt(row)}]
        if row["attempt"] > 1:
            messages += [{"role": "assistant", "content": (row["shown"] or "")[: model.SHOWN]}, {"role": "user", "content": f"That reply is not valid ({(row['fault'] or '')[: model.SHOWN_FAULT]}). Give the whole reply again in the required format."}]
        try:
            got = client(messages, 0.1 if row["attempt"] == 1 else model.RETRY_HEAT, work.max_tokens)
        except Exception as e:  # noqa: BLE001 - a call that fails is a fault like any other
            got = {"text": "", "finish_reason": f"{type(e).__name__}: {e}"}
        value, fault = model.read_reply(got, lambda p: work.check(p, row), True)
        last = row["attempt"] >= work.attempts
        repaired = False
        if fault is not None and last and work.repair is not None:
            mended, still = model.read_reply(got, lambda p: work.check(work.repair(p, row), row), True)
            if still is None:
                value, fault, repaired = mended, None, True
        status = DONE if fault is None else RETRY if not last else SPLIT if len(row["items"]) > 1 else FAILED
        return {"status": status, "repaired": repaired, "result": value, "shown": None if fault is None else got["text"], "fault": fault}

    def each(batches):
        client = make()
        for batch in batches:
            names = batch.schema.names
            out = [one(client, dict(zip(names, row, strict=True))) for row in zip(*map(_plain, batch.columns), strict=True)]
            made = {c: pa.array([o[c] for o in out], kinds.field(c).type) for c in ("status", "repaired", "result", "shown", "fault")}
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in kinds.names], kinds.names)

    return rows.mapInArrow(each, schema)


def _next(done: DataFrame, columns: list[str]) -> DataFrame:
    """The queue that a round leaves: retries, and single requests for what was split."""
    again = done.where(F.col("status") == RETRY).withColumn("attempt", F.col("attempt") + 1).select(columns)
    none = F.lit(None).cast("string")
    single = done.where(F.col("status") == SPLIT).select(*[c for c in columns if c != "items"], F.posexplode("items").alias("_k", "_item"))
    single = single.withColumns({"parent": F.col("request_id"), "request_id": F.concat("request_id", F.lit("_s"), F.col("_k").cast("string")), "attempt": F.lit(1), "shown": none, "fault": none, "items": F.array("_item")})
    return again.unionByName(single.select(columns))


def progress(spark: SparkSession, path: str) -> int:
    """The number of rounds that are finished."""
    try:
        return spark.read.schema("round int").parquet(f"{path}/progress").agg(F.coalesce(F.max("round") + 1, F.lit(0))).first()[0]
    except AnalysisException:
        return 0


def run(requests: DataFrame, work: Work, path: str, make: Callable[[], model.Client] = lambda: model.stub, context: DataFrame | None = None, on: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Every answer of every round: the requests' columns with parent, attempt, round, status, repaired, result, shown and fault.

    `context` is joined to pending requests on the columns `on` for a call and isn't stored with them. `most` stops after so many rounds of this
    call; a later run with the same path goes on. An empty queue gives an empty result.
    """
    spark, first = requests.sparkSession, queue(requests)
    small_batches(spark)
    columns = first.columns
    k = progress(spark, path)
    written = lambda i: spark.read.parquet(f"{path}/rounds/{i}")
    made = 0
    while most is None or made < most:
        pending = first if k == 0 else _next(written(k - 1), columns)
        if k > 0 and pending.isEmpty():
            break
        _answers(pending, work, make, context, on or []).write.mode("overwrite").parquet(f"{path}/rounds/{k}")
        spark.createDataFrame([(k,)], "round int").coalesce(1).write.mode("append").parquet(f"{path}/progress")
        k, made = k + 1, made + 1
    rounds = [written(i).withColumn("round", F.lit(i)) for i in range(k)]
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out
