"""Passage likelihoods and rulers with the offline echo client."""

import math

from pyspark.sql import functions as F

from inkstrata.operators import stats
from inkstrata.plans import likelihood as lk
from inkstrata.plans import model


def test_passages(spark):
    df = spark.createDataFrame([(1, "a b", "a c"), (2, None, "a c"), (3, "x", "")], "i int, rep string, passage string")
    work = df.withColumn("context", F.coalesce(lk.contexts("none", F.col("rep"), None), F.lit("")))
    good, bad = model.split(lk.passages(work))
    got = {r.i: r for r in good.collect()}
    assert got[1].tokens == 2 and got[1].nll < got[2].nll and math.isclose(got[2].nll, -sum(lk.stub("", "a c")))
    assert [r.i for r in bad.collect()] == [3]
    story = spark.createDataFrame([("r", "w1 w2 w3")], "r string, s string").select(lk.contexts("story", F.col("r"), F.col("s"), 2)).first()[0]
    assert story == "# Character information\n\nr\n\n# The story so far\n\nw2 w3\n\n"


def test_rulers(spark):
    data = [(1, "b", "one two", {"p": "one", "c": "two"}), (2, "b", "one two", {"p": "one"}), (3, "b", "one two", {"p": "w " * 50, "c": "x"})]
    df = spark.createDataFrame(data, "example int, book string, passage string, texts map<string, string>").withColumn("contexts", lk.slot_contexts(F.col("texts"), [None, "p"], [None, "c"]))
    good, bad = model.split(lk.ruler(df, window=20))
    rows = {r.example: r for r in good.collect()}
    assert bad.count() == 0 and rows[2].skipped == "missing context" and rows[3].skipped == "over the window"
    assert set(rows[1].scores) == {"none|none", "none|c", "p|none", "p|c"} and rows[1].scores["p|c"] > rows[1].scores["p|none"] > rows[1].scores["none|none"]
    gains = {r.cond: r.delta for r in stats.gain(lk.long_scores(good), "none|none").collect()}
    assert gains["p|c"] > gains["none|c"] > 0
