"""Scoring and statistics against plain Python on hand fixtures."""

import math
import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from inkstrata.operators import scoring, stats

ROWS = "cond int, book string, item int, target int, lp array<double>, answer int, invalid boolean"


def test_joint_and_argmax_differ(spark):
    rows = spark.createDataFrame([(0, "b", 1, 0, [0.0, -9.0, -1.0], 2, False), (0, "b", 1, 1, [0.0, -1.0, -9.0], 1, False), (0, "b", 1, 2, [0.0, -9.0, -9.0], 0, False)], ROWS)
    assert scoring.argmax_hits(rows).agg(F.sum("hit")).first()[0] == 1
    assert scoring.joint_hits(rows, ["cond", "item"]).agg(F.sum("hit")).first()[0] == 3


def test_tied_invalid_groups_are_wrong(spark):
    rows = spark.createDataFrame([(0, "b", 1, t, [-1e9] * 3, t, True) for t in range(3)], ROWS)
    assert scoring.joint_hits(rows, ["item"], invalid=F.col("invalid")).agg(F.sum("hit")).first()[0] == 0
    assert scoring.joint_hits(rows, ["item"]).agg(F.sum("hit")).first()[0] == 3
    assert scoring.argmax_hits(rows, F.col("invalid")).agg(F.sum("hit")).first()[0] == 0


def test_incomplete_groups_and_missing_values(spark):
    rows = spark.createDataFrame([(0, "b", 1, 0, [float("-inf"), None, float("nan")], 0, None), (0, "b", 1, 1, [0.0, -1.0, -2.0], 0, None)], ROWS)
    assert scoring.joint_hits(rows, ["item"]).count() == 0
    assert [r.hit for r in scoring.argmax_hits(rows).orderBy("target").collect()] == [1, 1]
    assert scoring.macro(scoring.argmax_hits(rows.where("false"))).count() == 0


@pytest.mark.parametrize("n", [2, 3, 4])
def test_assignment_equals_brute_force(spark, n):
    rng = random.Random(n)
    groups = [[[float(rng.randint(-3, 0)) for _ in range(n)] for _ in range(n)] for _ in range(40)]
    rows = spark.createDataFrame([(0, "b", i, t, g[t], 0, False) for i, g in enumerate(groups) for t in range(n)], ROWS)
    got = {}
    for r in scoring.joint_hits(rows.withColumn("answer", F.col("target")), ["item"], n).collect():
        got.setdefault(r["item"], {})[r["target"]] = r["hit"]
    for i, g in enumerate(groups):
        best = max(permutations(range(n)), key=lambda p, g=g: sum(g[t][p[t]] for t in range(n)))
        assert got[i] == {t: int(best[t] == t) for t in range(n)}


def test_quantile_kinds(spark):
    x = [5, 1, 4, 2, 3, 9]
    df = spark.createDataFrame([("a", v) for v in x], "k string, v int")
    got = stats.quantiles(df, ["k"], "v").first()
    s = sorted(x)
    assert [got.q10, got.q25, got.q50, got.q75, got.q90] == [s[int(q * 5)] for q in (0.1, 0.25, 0.5, 0.75, 0.9)]
    one = df.groupBy("k").agg(stats.floor_quantile(F.collect_list("v"), 0.5).alias("f"), stats.upper_median(F.collect_list("v")).alias("u")).first()
    assert (one.f, one.u) == (s[2], s[3])


def test_bootstrap_is_seeded(spark):
    df = spark.createDataFrame([(0, float(i % 4)) for i in range(12)], "c int, x double")
    a, b = (stats.bootstrap(d, ["c"], "x").first() for d in (df, df.orderBy(F.desc("x")).repartition(3)))
    assert a == b and a.low <= a["mean"] <= a.high
    rng, x = random.Random(0), sorted(float(i % 4) for i in range(12))
    means = sorted(sum(rng.choices(x, k=12)) / 12 for _ in range(2000))
    assert (a.low, a.high) == (means[50], means[1950])


def test_fronts(spark):
    rng = random.Random(1)
    pts = [("g", rng.randint(0, 30), rng.randint(0, 30), i) for i in range(200)]
    df = spark.createDataFrame(pts, "g string, x int, y int, name int")
    top, want = -1, []
    for p in sorted(pts, key=lambda p: (p[1], -p[2], p[3])):
        if p[2] > top:
            want.append(p[3])
            top = p[2]
    assert sorted(r.name for r in stats.pareto(df, "g", "x", "y", "name").collect()) == sorted(want)
    free = [p[3] for p in pts if not any(q[1] <= p[1] and q[2] >= p[2] and (q[1] < p[1] or q[2] > p[2]) for q in pts)]
    assert sorted(r.name for r in stats.skyline(df, "g", "x", "y").collect()) == sorted(free)


def test_overlap_and_runs(spark):
    rng = random.Random(2)
    pairs = [(i, [rng.choice("abc") for _ in range(rng.randint(0, 14))], [rng.choice("abc") for _ in range(rng.randint(0, 14))]) for i in range(30)]
    df = spark.createDataFrame(pairs, "i int, a array<string>, b array<string>")
    runs = {r.i: r.longest for r in stats.longest_common_run(df, ["i"], "a", "b").collect()}
    share = {r.i: r.o for r in df.select("i", stats.gram_overlap(F.col("a"), F.col("b"), 3).alias("o")).collect()}
    for i, a, b in pairs:
        best = max((k for s in range(len(a)) for k in range(1, len(a) - s + 1) if any(a[s : s + k] == b[t : t + k] for t in range(len(b)))), default=0)
        assert runs.get(i, 0) == best
        ga, gb = ({tuple(x[j : j + 3]) for j in range(len(x) - 2)} for x in (a, b))
        assert math.isclose(share[i], len(ga & gb) / max(1, len(gb)))


def test_gain_and_drift(spark):
    df = spark.createDataFrame([("r", "b", 1, 0.0), ("x", "b", 1, 0.1), ("r", "c", 2, 0.0), ("x", "c", 2, -0.2)], "cond string, book string, example int, score double")
    got = stats.gain(df, "r").first()
    assert math.isclose(got.b, 50 * (2 - math.exp(-0.1) - math.exp(0.2))) and (got.better, got.books) == (1, 2)
    assert stats.drift(df, ["book"], "score").first().worst == 0.2
