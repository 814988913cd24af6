"""Traces, trimming and packing against plain versions."""

import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from inkstrata.operators import scoring, traces
from inkstrata.plans import generate, packing


def grams(text, n=4):
    w = re.findall("[a-z']+", (text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_shares_and_splits_equal_sets_of_grams(spark):
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(["a", "B", "c'd", "e", "f1"]) for _ in range(n))
    rows = [(rng.choice("xy"), rng.randint(0, 9), say(rng.choice((0, 3, 4, 40))), rng.randint(0, 1)) for _ in range(200)] + [("x", 3, None, 1), ("y", 77, "a b c d e", 0)]
    notes = [(c, i, rng.choice([say(25), None, ""])) for c in "xy" for i in range(8) for _ in range(2)]
    items = [(i, say(15)) for i in range(10)]
    got = traces.shares(spark.createDataFrame(rows, "cond string, item int, trace string, correct int"), spark.createDataFrame(notes, "cond string, item int, text string"), spark.createDataFrame(items, "item int, masked string"), ["cond"])
    want = []
    for c, i, t, ok in rows:
        if g := grams(t):
            known = set().union(*(grams(x) for d, j, x in notes if (d, j) == (c, i)))
            want.append((c, i, t, ok, len(g & known) / len(g), len(g & grams(dict(items).get(i))) / len(g)))
    assert sorted(tuple(r) for r in got.select("cond", "item", "trace", "correct", "notes_share", "passage_share").collect()) == sorted(want)
    by = {r.cond: r for r in traces.split(got).collect()}
    for c in "xy":
        own = [w for w in want if w[0] == c]
        mid = statistics.median(w[4] for w in own)
        high, low = [w[3] for w in own if w[4] >= mid], [w[3] for w in own if w[4] < mid]
        assert by[c].traces == len(own) and by[c].median_notes == pytest.approx(mid) and by[c].accuracy_above == pytest.approx(statistics.mean(high))
        assert by[c].accuracy_below == (pytest.approx(statistics.mean(low)) if low else None) and by[c].median_words == statistics.median(len(w[2].split()) for w in own)


def test_effort_takes_the_last_row_of_many_units(spark):
    rows = [("a", u, k, 10 * u + k) for u in range(60) for k in range(3)] + [("b", u, 0, 1) for u in range(49)]
    got = traces.effort(spark.createDataFrame(rows, "c string, u int, k int, v int"), ["c"], ["u"], ["k"], "v").collect()
    assert [tuple(r) for r in got] == [("a", statistics.median(10 * u + 2 for u in range(60)), 60)]


def test_the_oldest_go_first(spark):
    rows = [("a", 0, "xx"), ("a", 1, "x" * 5), ("a", 2, "xxx"), ("b", 0, "x" * 99)]
    got = traces.oldest_out(spark.createDataFrame(rows, "k string, i int, t string"), ["k"], ["i"], "t", 10).collect()
    assert sorted(r.i for r in got) == [1, 2] and {r.k for r in got} == {"a"}


def test_hand_written_texts_give_no_ids(spark):
    texts = {"fine": True, " \n": False, None: False, "[CHAR 1] ran": False, "CHAR2": False, "the ID 3": False, "id4": False, "idea 4": True, "IDEA": True}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", traces.hand_written(F.col("t")).alias("ok")).collect()
    assert {r.t: r.ok for r in rows} == texts


def test_units_count_once_in_means_of_means(spark):
    hits = spark.createDataFrame([(1, 1), (1, 1), (1, 1), (2, 0), (3, 1), (4, 1)], "u int, hit int")
    groups = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "u int, g string")
    assert sorted(map(tuple, scoring.mean_of_means(hits, groups, ["u"], ["g"]).collect())) == [("x", 0.5, 2), ("y", 1.0, 1)]


def test_tasks_cost_nearly_the_same(spark):
    rng = random.Random(8)
    costs = [rng.paretovariate(1.1) * 10 for _ in range(3000)] + [50.0] * 1500 + [None, -3.0, 0.0]
    rng.shuffle(costs)
    work = spark.createDataFrame([(i, c, {"k": "v"}) for i, c in enumerate(costs)], "i int, cost double, m map<string, string>")
    rows = packing.packed(work, F.col("cost"), 16).collect()
    assert sorted(r.i for r in rows) == list(range(len(costs))) and {r.task for r in rows} == set(range(16))
    load = [sum(max(r.cost or 0, 0) for r in rows if r.task == k) for k in range(16)]
    mean, most = sum(load) / 16, max(c for c in costs if c)
    assert max(load) <= packing.STEP * mean + most and max(sum(r.task == k for r in rows) for k in range(16)) <= len(costs) / 16 + 1
    # As stored, one task would hold a run of dear rows; dealt, each partition is a task.
    parts = packing.dealt(work, F.col("cost"), 16).select(F.spark_partition_id().alias("p"), "cost").groupBy("p").agg(F.sum(F.greatest(F.coalesce("cost", F.lit(0.0)), F.lit(0.0))).alias("c")).collect()
    assert len(parts) == 16 and max(p.c for p in parts) <= packing.STEP * mean + most
    assert packing.packed(work.where("false"), F.col("cost"), 4).count() == 0


def test_a_stage_runs_over_dealt_work(spark):
    work = spark.createDataFrame([("b", i, "Ana", f"Ana ran {i}. " * (i + 1)) for i in range(30)], "book string, i int, name string, text string")
    good, errors = generate.run(generate.STAGES["names"], work, generate.extractor, cost=F.length("text"), tasks=4)
    plain, _ = generate.run(generate.STAGES["names"], work, generate.extractor)
    assert errors.count() == 0 and sorted(map(str, good.collect())) == sorted(map(str, plain.collect())) and good.rdd.getNumPartitions() == 4
