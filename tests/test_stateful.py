"""Streams with timers against the same rows as a batch: out of order, late, and silent."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from inkstrata.streaming import jobs, stateful

START = datetime(2024, 1, 1)


@pytest.fixture
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, stateful.STORE)
    yield
    spark.conf.set(key, before)


def fed(spark, tmp_path, batches, schema, make):
    """The rows that a query gives out, batch by batch: each batch is a file, and each file a micro-batch."""
    source, out = tmp_path / "in", []
    source.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
        (part,) = (tmp_path / f"part{i}").glob("*.parquet")
        part.rename(source / f"{i:03d}.parquet")
        import os

        os.utime(source / f"{i:03d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    def sink(df, n):  # noqa: E306
        out.extend((n, r) for r in df.collect())

    query = make(stream).writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return out


SCHEMA = "k string, at timestamp, place long, v string"


def at(minutes):
    return START + timedelta(minutes=minutes)


def test_rows_out_of_order_fold_as_the_batch_does(spark, store, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), at(i // 2), i % 2, f"{i};") for i in range(60)]
    mixed = sorted(rows, key=lambda r: (r[1] - START).total_seconds() / 60 + rng.uniform(0, 8))  # at most 8 minutes late
    batches = [mixed[i : i + 12] for i in range(0, 60, 12)] + [[("end", at(500), 0, "x")], [("end", at(900), 0, "y"), (None, at(901), 0, "z"), ("a", None, 0, "z")]]
    step = lambda s, v: s + v
    got = fed(spark, tmp_path, batches, SCHEMA, lambda s: stateful.in_order(s, "k", "at", "place", "v", step, "10 minutes"))
    last = {}
    for _, r in got:
        assert r.k not in last or (r.state.startswith(last[r.k][1]) and r.n > last[r.k][0])  # what was given out stays
        last[r.k] = (r.n, r.state)
    want = {k: (sum(r[0] == k for r in rows), "".join(r[3] for r in rows if r[0] == k)) for k in "abc"}
    assert {k: last[k] for k in "abc"} == want and len({n for n, _ in got}) > 2


def test_rows_beyond_the_delay_are_dropped(spark, store, tmp_path):
    batches = [[("a", at(0), 0, "1"), ("a", at(30), 0, "3")], [("a", at(31), 0, "4")], [("a", at(5), 0, "late"), ("a", at(28), 0, "2")], [("b", at(600), 0, "x")], [("b", at(601), 0, "x")]]
    got = fed(spark, tmp_path, batches, SCHEMA, lambda s: stateful.in_order(s, "k", "at", "place", "v", lambda a, b: a + b, "10 minutes"))
    assert [r.state for _, r in got if r.k == "a"][-1] == "1234"


LINES = "job string, ts timestamp, kind string, running int, waiting int"


def test_a_silent_job_is_reported_by_a_timer(spark, store, tmp_path):
    lines = [("hung", 0, "start", 0, 0), ("hung", 1, "ready", 0, 0), ("hung", 2, "load", 3, 1), ("idle", 0, "ready", 0, 0), ("idle", 3, "load", 0, 0), ("cold", 2, "load", 5, 0), ("cold", 3, "start", 0, 0), ("cold", 4, "load", 5, 0)]
    lines += [("busy", 0, "ready", 0, 0)] + [("busy", m, "load", 1, 1) for m in range(1, 60, 5)]
    lines += [("back", 0, "ready", 0, 0), ("back", 1, "load", 2, 0), ("back", 40, "load", 2, 0)] + [("back", m, "load", 2, 0) for m in range(44, 60, 4)]
    rows = sorted((j, at(m), k, r, w) for j, m, k, r, w in lines)
    by_time = sorted(rows, key=lambda r: r[1])
    batches = [by_time[i : i + 6] for i in range(0, len(by_time), 6)]
    batches = [*batches[:3], [("clock", at(32), "x", 0, 0)], *batches[3:], [("clock", at(61), "x", 0, 0)], [("clock", at(62), "x", 0, 0)]]
    got = [r for _, r in fed(spark, tmp_path, batches, LINES, lambda s: stateful.silent(s))]
    assert sorted((r.job, r.last, r.work) for r in got) == [("back", at(1), 2), ("hung", at(2), 4)]
    batch = jobs.stale(spark.createDataFrame(rows, LINES), at(61)).collect()
    final = {r[0]: max(x[1] for x in rows if x[0] == r[0]) for r in rows}
    assert {(r.job, r.last, r.work) for r in got if final[r.job] == r.last} == {(r.job, r["last"], r.work) for r in batch}


def test_lines_out_of_order_give_the_same_report(spark, store, tmp_path):
    lines = [("hung", at(2), "load", 3, 1), ("hung", at(1), "ready", 0, 0), ("hung", at(0), "start", 0, 0), ("cold", at(3), "start", 0, 0), ("cold", at(4), "load", 5, 0), ("cold", at(2), "ready", 5, 0), ("clock", at(0), "x", None, None)]
    got = fed(spark, tmp_path, [lines[:3], lines[3:], [("clock", at(30), "x", 0, 0)], [("clock", at(31), "x", 0, 0)]], LINES, lambda s: stateful.silent(s, late="20 minutes"))
    assert got == []
    (tmp_path / "more").mkdir()
    got = fed(spark, tmp_path / "more", [lines[:3], lines[3:], [("clock", at(40), "x", 0, 0)], [("clock", at(41), "x", 0, 0)]], LINES, lambda s: stateful.silent(s, late="20 minutes"))
    assert [(r.job, r.last, r.work) for _, r in got] == [("hung", at(2), 4)]


def test_a_keys_pieces_fold_in_order(spark, tmp_path):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        rows = [("a", at(i), i, str(i)) for i in random.Random(1).sample(range(10), 10)]
        got = fed(spark, tmp_path, [rows], SCHEMA, lambda s: jobs.rolling(s, "k", "place", "v", lambda a, b: a + b))
    finally:
        spark.conf.set(key, before)
    assert [(r.k, r.n, r.state) for _, r in got] == [("a", 10, "0123456789")]


def test_a_scalar_subquery_is_now(spark):
    rows = spark.createDataFrame([("a", at(0), "ready", 0, 0), ("a", at(1), "load", 1, 0), ("b", at(60), "x", 0, 0)], LINES)
    assert [(r.job, r.work) for r in jobs.stale(rows, rows.agg(F.max("ts")).scalar()).collect()] == [("a", 1)]
