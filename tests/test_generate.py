"""Generation stages, lexical selections, report and command line."""

import pytest
from pyspark.sql import functions as F

from inkstrata import catalog
from inkstrata.__main__ import main
from inkstrata.operators import lexical
from inkstrata.plans import generate as gn
from inkstrata.plans import report
from inkstrata.sources import adapters

SF = "/root/testdata/sf0.001"


def test_checks_accept_and_refuse():
    good = {"present": True, "claims": [{"q": "looks", "text": " tall ", "rating": 5}]}
    assert gn.claims_check(good, {})["claims"] == [{"q": "looks", "category": "Physical", "text": "tall", "rating": 5}]
    for bad in ({"present": 1}, {"present": True, "claims": [{"q": "x", "text": "t", "rating": 5}]}, {"present": True, "claims": [{"q": "looks", "text": "t", "rating": 6}]}, {"present": True, "claims": [{"q": "looks", "text": "t", "rating": True}]}):
        with pytest.raises(ValueError):
            gn.claims_check(bad, {})
    assert gn.ratings_check({"ratings": [{"id": 1, "rating": 2}, {"id": 0, "rating": 5}]}, 2) == [5, 2]
    with pytest.raises(ValueError):
        gn.ratings_check({"ratings": [{"id": 0, "rating": 5}, {"id": 0, "rating": 5}]}, 2)
    row = {"labels": ["Ana Kol", "The Leszy"], "n": 1}
    assert gn.pronouns_check({"pronouns": [{"id": 0, "ref": "ana", "possessive": False}]}, row)["edits"][0]["ref"] == "Ana Kol"
    with pytest.raises(ValueError):
        gn.pronouns_check({"pronouns": [{"id": 0, "ref": "the", "possessive": False}]}, row)
    assert gn.verbatim_check({"quotes": ["“He  ran”", "no", ""]}, {"text": 'x "he ran" y'}) == {"quotes": ["“He  ran”"]}
    assert gn.narrator_check({"first_person": False, "narrator": "Ana"}, {})["narrator"] is None
    ledger = {"claims": [{"text": "a", "sources": ["ch1:2"]}]}
    assert gn.ledger_check(ledger, {"sources": ["ch001:2"]})["claims"][0]["sources"] == ["ch001:2"]
    for bad in ({"claims": [{"text": "a ch1:2", "sources": ["ch1:2"]}]}, {"claims": [{"text": "a", "sources": []}]}, {"claims": []}):
        with pytest.raises(ValueError):
            gn.ledger_check(bad, {"sources": ["ch001:2"]})
    assert gn.sheet_target({"text": "w " * 100}, 500) == 40 and gn.sheet_target({"text": "w " * 9000}, 500) == 500


def test_resizing_and_verifying():
    replies = iter(["one two", "a b c d e f", "x"])
    got = gn.resized(gn.STAGES["plot"], lambda m, t, k: {"text": next(replies)}, {"text": "t", "target": 6}, 0.5, 1.5)
    assert got == "a b c d e f"
    kept, counts = gn.verified([f"c{i}" for i in range(10)], "s", lambda cs, s: ["3" not in c for c in cs], lambda c, s: "fixed")
    assert "c3" not in kept and len(kept) == 10 and counts == {"batch": 2, "single": 7, "repaired": 1, "removed": 0}


def test_stage_errors_are_rows(spark):
    work = spark.createDataFrame([(1, "Ana", "He ran. She sat."), (2, "Bo", "")], "k int, name string, text string")
    good, bad = gn.run(gn.STAGES["notes"], work, gn.extractor)
    assert {r.k for r in good.collect()} == {1, 2} and bad.count() == 0
    good, bad = gn.run(gn.STAGES["notes"], work)  # the stub's replies are no JSON
    assert good.count() == 0 and {r.k for r in bad.collect()} == {1, 2} and "JSON" in bad.first().error
    d = spark.createDataFrame([("a", "x", "1"), ("a", "y", "2"), ("b", "x", "3")], "k string, variant string, text string")
    assert [(r.k, r.drafts) for r in gn.drafts_of(d, ["k"], ["x", "y"]).collect()] == [("a", ["1", "2"])]


def test_lexical(spark):
    items = spark.createDataFrame([(1, "red apple [CHAR 0] fruit " + "z " * 20 + " blue sky [CHAR 1] cloud " + "z " * 20 + "grey stone [CHAR 2] rock", ["s", "a", "c"], [2, 0, 1])], "item int, masked string, labels array<string>, answer array<int>")
    texts = spark.createDataFrame([(1, "s", "a grey stone, a rock"), (1, "a", "a red apple [x] fruit"), (1, "c", "cloud in a blue sky")], "item int, label string, text string")
    assert [r.hit for r in lexical.match_masks(items, texts, near=4).collect()] == [1, 1, 1]
    s = spark.createDataFrame([("k", 0, "x", ["A", "B"]), ("k", 1, "y", ["A"]), ("k", 2, "z", ["A"])], "k string, pos int, text string, named array<string>")
    assert [r.text for r in lexical.quotes(s, ["k"]).orderBy("rank").collect()] == ["y", "z"]
    w = spark.createDataFrame([("a " * 15 + "[CHAR 0] b [CHAR 1]",)], "m string").select(lexical.example_window(F.col("m"), F.array(F.lit(0), F.lit(1)), 12, 10)).first()[0]
    assert w.startswith("a a a a a [CHAR 0]")
    e = spark.createDataFrame([({"0": 1.0}, " 0"), ({"0": 1.0}, "x")], "logprobs map<string, double>, top_token string").withColumn("c", F.lit(1))
    assert lexical.non_digit_rate(e, ["c"]).first().rate == 0.5


def test_report(spark, tmp_path):
    rows = adapters.eval_rows(spark, SF)
    got = report.tables(rows, 0, categories=[1, 2])
    assert got["scoring"].count() == 5 and got["category products"].count() == 3 and got["best by length"].count() >= 1
    report.write(rows, 0, str(tmp_path / "r.html"))
    assert "<h2>main</h2>" in (tmp_path / "r.html").read_text()


def test_command_line(spark, capsys, tmp_path):
    assert main(["parse", "swap:v2@9"]) == 0 and "swap=True" in capsys.readouterr().out
    assert main(["queries"]) == 0 and "joint_accuracy" in capsys.readouterr().out
    assert main(["run", "weighted_nll", "--data", SF, "--out", str(tmp_path / "o")]) == 0 and spark.read.parquet(str(tmp_path / "o")).count() == 3
    assert main(["prep", "--documents", f"{SF}/documents.parquet", "--out", str(tmp_path / "p")]) == 0
    assert set(catalog.SQL) <= set(catalog.QUERIES)
