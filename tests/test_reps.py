"""Representations, items, names, conditions, model calls, files and streams on hand fixtures."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from inkstrata.functions import unicode as u
from inkstrata.operators import items, names, reps
from inkstrata.plans import conditions as cd
from inkstrata.plans import model
from inkstrata.sources import files
from inkstrata.streaming import jobs


def rows(spark, data, ddl):
    return spark.createDataFrame(data, ddl)


def test_budgets(spark):
    df = rows(spark, [("a", i, w) for i, w in enumerate([50, 60, 10])], "book string, chapter_index int, words int")
    assert [r.words for r in reps.recency_budget(df, ["book"], ["chapter_index"], 65).collect()] == [10]
    df = rows(spark, [("a", 0, 10), ("a", 1, 900)], "book string, chapter_index int, words int")
    assert [r.words for r in reps.chapter_budget(df, ["book"], 500).collect()] == [900]
    rng = random.Random(0)
    for _ in range(5):
        w = [rng.randint(0, 30) for _ in range(20)]
        df = rows(spark, [("a", i, x) for i, x in enumerate(w)], "book string, chapter_index int, words int")
        want = [i for i in range(20) if sum(w[i:]) <= 120]
        assert {r.chapter_index for r in reps.recency_budget(df, ["book"], ["chapter_index"], 120).collect()} == set(want)


def test_greedy_duplicates_are_not_transitive(spark):
    data = [("k", 0, {"x": 1.0}), ("k", 1, {"x": 0.8, "y": 0.6}), ("k", 2, {"y": 0.8, "x": 0.6})]
    df = rows(spark, data, "k string, i int, v map<string, double>")
    assert sorted(r.i for r in reps.greedy_distinct(df, ["k"], "i", "v", 0.75).collect()) == [0, 2]


def test_views(spark):
    df = rows(spark, [("a", c, f"t{c}") for c in (0, 1, 2, 4)], "book string, chapter_index int, text string")
    b = rows(spark, [("a", 3), ("a", 5)], "book string, boundary int")
    assert reps.as_of(df, b, ["book"]).count() == 7
    assert sorted((r.boundary, r.chapter_index) for r in reps.as_of(df, b, ["book"], low=2).collect()) == [(3, 1), (3, 2), (5, 4)]
    assert sorted(r.boundary for r in reps.complete(df, ["book"]).collect()) == [1, 2, 3]
    assert {(r.boundary, r.chapter_index): r.text for r in reps.latest_fill(df, b, ["book"], 2).collect()}[5, 3] == "Not in this chapter."
    sections = rows(spark, [("a", s, i) for s in "xy" for i in range(3)], "book string, s string, o int")
    assert [(r.s, r.o) for r in reps.round_robin(sections, ["book"], "s", "o", 3).orderBy("turn").collect()] == [("x", 0), ("y", 0), ("x", 1)]


def test_archives_render_back(spark):
    x = "## Looks\n\nQuestion: q?\n\n<snippet 0>\nTall.\n<snippet 2>\nOld.\n\n## Goals"
    df = rows(spark, [("a", x)], "k string, x string").select("k", F.explode(u.blocks(F.col("x"))).alias("b")).select("k", "b.*")
    got = reps.render_archive(df, ["k"]).first().text
    assert got == "## Looks\n\nQuestion: q?\n\n<snippet 0>\nTall.\n<snippet 2>\nOld.\n\n## Goals"
    layout = reps.archive_layout(rows(spark, [("a", 1, "q1", "note")], "k string, chapter_index int, q string, text string"), rows(spark, [("a", 2)], "k string, boundary int"), ["k"], [("S", [("q1", "One?"), ("q2", "Two?")])])
    assert layout.first().text == "## S\n\nQuestion: One?\n\n<snippet 0>\n\n<snippet 1>\nnote\n\nQuestion: Two?\n\n<snippet 0>\n\n<snippet 1>"
    sec = reps.render_sections(rows(spark, [("a", 0, "x", "one")], "k string, pos int, section string, text string"), ["k"], ["x", "y"])
    assert sec.first().text == "### x\n- one\n\n### y\n- No information."


def test_mentions_are_whole_words(spark):
    units = rows(spark, [(1, "b", 0, "Ana Dolabra and ANA"), (2, "b", 1, "Anatole O’Ana"), (3, "b", 2, "Kol, Ana")], "unit int, book string, chapter_index int, text string")
    al = rows(spark, [("b", "A", "Ana"), ("b", "A", "Ana Dolabra"), ("b", "K", "Kol")], "book string, label string, alias string")
    got = {(r.unit, r.label): r.n for r in items.named_counts(units, al).collect()}
    assert got == {(1, "A"): 2, (3, "A"): 1, (3, "K"): 1}
    assert [r.unit for r in items.fully_named(items.named_counts(units, al), al, units).collect()] == [3]
    assert items.named_counts(units.where("false"), al).count() == 0


def test_short_spans_shrink():
    sents = ["A here again.", "A walks on.", "B comes.", "C too."]
    named = [{"A"}, {"A"}, {"B"}, {"C"}]
    assert items.tightest_spans(sents, named, {"A", "B", "C"}, 1, 50) == ["A walks on. B comes. C too."]
    assert items.tightest_spans(sents, named, {"A", "B", "C"}, 8, 50) == ["A here again. A walks on. B comes. C too."]
    assert items.tightest_spans(sents, named, {"A", "D"}, 1, 50) == []


def test_windows_equal_the_loop(spark):
    rng = random.Random(4)
    secs = [" ".join(["w"] * rng.randint(1, 60)) for _ in range(30)]
    got = items.windows(rows(spark, [("a", i, s) for i, s in enumerate(secs)], "k string, o int, text string"), ["k"], "o", 50, 3)
    size = [len(x.split()) for x in secs]
    cuts = [0]
    for i in range(1, len(secs)):
        if i - cuts[-1] == 3 or sum(size[cuts[-1] : i]) >= 50:
            cuts.append(i)
    want = ["\n\n".join(secs[a:b]) for a, b in zip(cuts, [*cuts[1:], len(secs)], strict=True)]
    assert [r.text for r in got.orderBy("k", "pos" if "pos" in got.columns else got.columns[1]).collect()] == want


def test_names(spark):
    ch = rows(spark, [("b", 0, "Leszy came"), ("b", 5, "Eliasz Kowal")], "book string, chapter_index int, text string")
    labels = rows(spark, [("b", "Leszy (Eliasz Kowal)")], "book string, label string")
    pos = rows(spark, [("b", 5), ("b", 6)], "book string, pos int")
    got = {r.pos: r.name for r in names.display_names(labels, names.first_seen(ch), pos, through=False).collect()}
    assert got == {5: "Leszy", 6: "Leszy (Eliasz Kowal)"}
    n = rows(spark, [("b", i, True, "Ana" if i < 8 else None) for i in range(10)] + [("b", 10, False, None)], "book string, chapter_index int, first_person boolean, narrator string")
    assert [r.narrator for r in names.narrators(n).orderBy("chapter_index").collect()] == ["Ana"] * 10 + [None]
    g = rows(spark, [("b", "x", "he him she"), ("b", "y", "nothing"), ("b", "z", "Her hers")], "book string, label string, text string")
    assert {r.label: r.gender for r in names.genders(g).collect()} == {"x": "M", "y": "?", "z": "F"}


@pytest.mark.parametrize(("name", "want"), [
    ("noinfo", cd.Condition("noinfo", "noinfo")),
    ("swapname:v2@250&book_last1000+pre", cd.Condition("swapname:v2@250&book_last1000+pre", "v2", True, True, 250, "book_last1000", None, True)),
    ("swap:x^book_ch2p", cd.Condition("swap:x^book_ch2p", "x", True, after="book_ch2p")),
    ("plot_global_500@last100", cd.Condition("plot_global_500@last100", "plot_global_500@last100")),
])
def test_conditions(name, want):
    assert cd.parse(name) == want


@pytest.mark.parametrize("name", ["", "v2@x", "other:v2"])
def test_malformed_conditions(name):
    with pytest.raises(ValueError):
        cd.parse(name)


def test_book_specs():
    assert cd.parse_book("book_ch3p") == cd.BookText(low=3, prefix=True)
    assert cd.parse_book("book_noprev200") == cd.BookText(skip=1, last=200)
    assert cd.parse_book("book_prefix") == cd.BookText(prefix=True, chapters=False)
    with pytest.raises(ValueError):
        cd.parse_book("booklet")


def planned(spark, name, n=3):
    labels = ["Ana", "Bo", "Cy"][:n]
    it = rows(spark, [("i1", "b", 2, labels, {x: i for i, x in enumerate(labels)}, "masked", "so far")], "item_id string, book string, chapter_index int, labels array<string>, answer map<string, int>, masked string, prefix string")
    rp = rows(spark, [("v2", "b", 2, x, f"about {x}") for x in labels] + [("gap", "b", 2, "Ana", "x")], "condition string, book string, boundary int, label string, text string")
    nm = rows(spark, [("b", 2, x, x.upper()) for x in labels], "book string, boundary int, label string, name string")
    ch = rows(spark, [("b", i, f"chapter {i}") for i in range(4)], "book string, chapter_index int, text string")
    al = rows(spark, [("b", x, x) for x in labels], "book string, label string, alias string")
    return cd.plan(it, name, rp, nm, ch, n=n, aliases=al)


def test_plans(spark):
    assert planned(spark, "v2").count() == 18 and planned(spark, "noinfo").count() == 3 and planned(spark, "gap").count() == 0
    text = planned(spark, "swap:v2&book+pre").where("target = 'Bo'").orderBy("prompt").first().prompt
    assert "# The novel so far\n\nchapter 0\n\nchapter 1\n\n# Character information" in text and "## ANA\n\nabout Bo" in text and "# This chapter up to the passage\n\nso far" in text
    assert text.endswith("Which ID in the passage is BO? Answer with only the digit 0, 1 or 2.")
    named = planned(spark, "swapname:v2").where("target = 'Bo'").first().prompt
    assert "## ANA\n\nabout ANA" in named and "## CY\n\nabout CY" in named
    assert "- ANA\n- BO\n- CY" in planned(spark, "noinfo").first().prompt


def test_scores_and_errors(spark):
    good, bad = model.split(model.score(planned(spark, "v2")))
    assert good.count() == 18 and bad.count() == 0 and set(good.first().logprobs) == {"0", "1", "2"}
    assert good.orderBy("prompt").first() == model.split(model.score(planned(spark, "v2").repartition(3)))[0].orderBy("prompt").first()

    def failing():
        def call(messages, temperature, most):
            raise OSError("down")

        return call

    assert model.split(model.score(planned(spark, "v2"), failing))[1].first().error == "OSError: down"
    assert model.digit_logprobs({"0": -1.0, " 0": -0.5, "x": 0.0}, 2) == {"0": -0.5, "1": float("-inf")}


def test_ask_retries_with_the_error():
    said = []

    def client(messages, heat, most):
        said.append((len(messages), heat))
        return {"text": "no" if len(said) == 1 else '```json\n{"a": 1}\n```', "prompt_tokens": 2, "completion_tokens": 1, "finish_reason": "stop"}

    got, usage = model.ask(client, [{"role": "user", "content": "x"}], lambda p: p["a"])
    assert got == 1 and usage == {"attempts": 2, "prompt_tokens": 4, "completion_tokens": 2} and said == [(1, 0.1), (3, 0.6)]
    with pytest.raises(ValueError):
        model.ask(lambda *a: {"text": "", "prompt_tokens": 0, "completion_tokens": 0, "finish_reason": "stop"}, [], lambda p: p)


def test_chains(spark):
    df = rows(spark, [("a", 0, "x y."), ("a", 1, "z z z z."), ("a", 3, "lost"), ("b", 1, "late")], "book string, chapter_index int, text string")
    got = [(r.book, r.boundary, r.summary, r.compressed_from) for r in model.chain(df, ["book"], lambda s, x: (s + " " + x).strip(), cap=5).orderBy("boundary").collect()]
    assert got == [("a", 1, "x y.", None), ("a", 2, "x y.", 6)]
    rated = model.rate_once(rows(spark, [("a",), ("a",), ("b",), (None,)], "s string"), "s", lambda xs: [5 if x == "a" else 3 for x in xs])
    assert sorted((r.s or "", r.rating or 0) for r in rated.collect()) == [("", 0), ("a", 5), ("a", 5), ("b", 3)]
    assert model.two_level(df, ["book"], lambda xs: "+".join(xs), 2).where("book = 'a'").first().summary == "x y.+z z z z.+lost"


def test_files(spark, tmp_path):
    p = tmp_path / "v2.s0of2.r7.jsonl"
    p.write_text('{"item_id": "a", "logprobs": {"0": -Infinity, "1": -0.5}, "order": ["x"]}\n{"item_id": "b", "more": 1}\n{"item_id": "c", "lo')
    (tmp_path / "v2.errors.jsonl").write_text('{"item_id": "e"}\n')
    got = files.name_parts(files.read_jsonl(spark, str(tmp_path), "eval_rows")).collect()
    assert {r.item_id for r in got} == {"a", "b"} and (got[0].cond, got[0].shard, got[0].shards, got[0].run) == ("v2", 0, 2, "7")
    assert files.read_jsonl(spark, str(tmp_path / "none.jsonl"), "items").count() == 0
    a, b = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    line = '{"condition": "c", "book": "b", "boundary": 1, "label": "l", "text": "%s"}\n'
    a.write_text(line % "old" + line % "newer")
    b.write_text(line % "newest")
    assert [r.text for r in files.read_reps(spark, [str(a), str(b)]).collect()] == ["newest"]
    assert [r.text for r in files.read_reps(spark, [str(b), str(a)]).collect()] == ["newer"]
    (tmp_path / "al").mkdir()
    (tmp_path / "al" / "dark.json").write_text('{\n "principals": {"A": ["Ana", "A."]},\n "ambiguous": ["Dol"]}')
    assert files.read_aliases(spark, str(tmp_path / "al")).count() == 2 and files.read_rules(spark, str(tmp_path / "al")).first().kind == "ambiguous"
    out = str(tmp_path / "out")
    work = rows(spark, [(i,) for i in range(5)], "k int")
    assert files.resume(work.where("k < 3"), out, ["k"], lambda d: d) == 3 and files.resume(work, out, ["k"], lambda d: d) == 2
    files.report({"t": work}, str(tmp_path / "r.html"))
    assert "<h2>t</h2>" in (tmp_path / "r.html").read_text()


def test_streams(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    spark.createDataFrame(pd.DataFrame({"k": ["a", "a", "b"], "o": [0, 1, 0], "v": ["x", "y", "z"]})).coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("k string, o long, v string").parquet(str(src))
    jobs.append_new(stream, out, ["k", "o"], str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(out).count() == 3
    q = jobs.rolling(stream, "k", "o", "v", lambda s, v: s + v).writeStream.format("memory").queryName("rolled").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.k, r.n, r.state) for r in spark.table("rolled").collect()} == {("a", 2, "xy"), ("b", 1, "z")}


def test_stale_jobs(spark):
    t = lambda m: pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=m)
    data = [("a", t(0), "start", 0, 0), ("a", t(1), "ready", 0, 0), ("a", t(2), "load", 2, 0), ("b", t(0), "ready", 0, 0), ("b", t(1), "load", 2, 0), ("b", t(5), "start", 0, 0), ("c", t(0), "ready", 0, 0), ("c", t(1), "load", 0, 0)]
    df = spark.createDataFrame(pd.DataFrame(data, columns=["job", "ts", "kind", "running", "waiting"]))
    assert [r.job for r in jobs.stale(df, t(20)).collect()] == ["a"]
    assert jobs.stale(df, t(11)).count() == 0


def test_greedy_duplicates_equal_the_loop(spark):
    rng = random.Random(8)
    docs = [(k, i, " ".join(rng.choice("ab cd ef gh ij kl mn".split()) for _ in range(rng.randint(3, 9)))) for k in "xy" for i in range(40)]
    v = reps.tfidf(rows(spark, docs, "k string, i int, text string"), ["k"], ["i"], "text")
    vec = {(r.k, r.i): r.v for r in v.collect()}
    for threshold in (0.6, 0.9):
        got = {(r.k, r.i) for r in reps.greedy_distinct(v, ["k"], "i", "v", threshold).collect()}
        want = set()
        for k, i, _ in docs:
            if all(sum(w * vec[k, j].get(t, 0) for t, w in vec[k, i].items()) < threshold for kk, j in want if kk == k):
                want.add((k, i))
        assert got == want


@pytest.mark.parametrize(("name", "want"), [
    ("book_last2", "chapter 1"), ("plot_a_5@last2", "c d"), ("ncp_plot", "syn"), ("ncp_next", "nxt"), ("ncp_story", "## Synopses of the chapters so far\n\nsyn\n\n## The last two chapters\n\nraw"),
    ("si-plot_a_5@last1-ch2", "## Plot summary so far\n\nd\n\n## The last two chapters\n\nraw"), ("si-none-last1", "## The last 1 words before this chapter\n\n1"), ("si-ncp-none", "## Synopses of the chapters so far\n\nsyn"),
])
def test_story_texts(spark, name, want):
    it = rows(spark, [("i", "b", 2, "pre")], "item_id string, book string, chapter_index int, prefix string")
    ch = rows(spark, [("b", i, f"chapter {i}") for i in range(3)], "book string, chapter_index int, text string")
    plots = rows(spark, [("plot_a_5", "b", 2, "a b c d")], "condition string, book string, boundary int, text string")
    parts = rows(spark, [("b", 2, "syn", "raw", "nxt")], "book string, chapter_index int, plot string, raw string, next string")
    got = cd.story_text(it, name, ch, plots, parts).collect()
    assert len(got) == 1 and got[0].text == want
    assert cd.story_text(it, "plot_missing", ch, plots, parts).count() == 0
