"""Verification and synthesis in rounds against a plain loop, stopped and resumed."""

import json
import random

import pytest
from pyspark.sql import functions as F

from inkstrata.plans import ledger as lg
from inkstrata.plans import rounds

CHAPTERS = [(b, c, f"Text of {b} {c}.") for b in ("x", "y") for c in range(3)]


@pytest.fixture(scope="module")
def claims():
    rng = random.Random(2)
    out = []
    for b, c, _ in CHAPTERS:
        for pos in range(rng.choice((0, 1, 5, 8, 19))):
            out.append((b, c, pos, rng.choice(("Ana", "Kol")), rng.choice(lg.SECTIONS), "word " * rng.randint(0, 8) + "z" * rng.randint(1, 9)))
    return [*out, ("x", 2, 99, "Ana", lg.SECTIONS[0], "z" * 35), ("y", 2, 99, "Ana", lg.SECTIONS[0], "z" * 70)]


def frames(spark, claims):
    return (spark.createDataFrame(claims, "book string, chapter_index int, pos int, label string, section string, claim string"), spark.createDataFrame(CHAPTERS, "book string, chapter_index int, text string"))


def plain_verify(claims, batch=8):
    """Chapter by chapter: batches, then single claims, then removal."""
    decided, counts = {}, {}
    for b, c in sorted({x[:2] for x in claims}):
        own = sorted((x for x in claims if x[:2] == (b, c)), key=lambda x: (x[3], x[2], x[4], x[5]))
        named, number = [], {}
        for x in own:
            number[x[3], x[4]] = number.get((x[3], x[4]), 0) + 1
            named.append((f"ch{c:03d}:{x[4]}:{number[x[3], x[4]]:03d}@{x[3]}", x))
        count = counts[b, c] = {"candidates": len(own), "kept": 0, "removed": 0, "removed_unverified": 0, "batches_split": 0, "repaired": 0}
        for i in range(0, len(named), batch):
            part, name = named[i : i + batch], f"{b}__chapter_{c:04d}__verify_{i:04d}"
            sizes = [len(x[5]) for _, x in part]
            lying = lambda some: any(n % 3 == 0 and n % 5 == 0 for n in some)
            if len(part) > 1 and not any(n % 7 == 0 for n in sizes):
                requests = [(name, part, 2 if lying(sizes) else 0)]
            elif len(part) > 1:
                count["batches_split"] += 1
                requests = [(f"{name}_s{k}", [x], 3 + (2 if lying([len(x[1][5])]) else 0)) for k, x in enumerate(part)]
            else:
                requests = [(name, part, 2 if lying(sizes) else 0)]
            for name_, some, at in requests:
                if len(some) == 1 and len(some[0][1][5]) % 35 == 0:
                    decided[b, c, some[0][0]] = ("remove", lg.UNVERIFIED, name_, at - at % 3 + 2)
                    count["removed"] += 1
                    count["removed_unverified"] += 1
                    continue
                count["repaired"] += at % 3 == 2
                for i_, x in some:
                    keep = len(x[5]) % 3 != 0
                    decided[b, c, i_] = ("keep" if keep else "remove", str(len(x[5])), name_, at)
                    count["kept" if keep else "removed"] += 1
    return decided, counts


def result(claims, counts):
    return {(r.book, r.chapter_index, r.id): (r.verdict, r.reason, r.request_id, r.round) for r in claims.collect()}, {(r.book, r.chapter_index): {k: v for k, v in r.asDict().items() if k not in ("book", "chapter_index")} for r in counts.collect()}


def test_rounds_equal_the_plain_loop(spark, claims, tmp_path):
    got = result(*lg.verify(*frames(spark, claims), str(tmp_path / "v"), lg.critic))
    assert got == plain_verify(claims)
    assert {v[3] for v in got[0].values()} == {0, 2, 3, 5} and rounds.progress(spark, str(tmp_path / "v")) == 6


def test_a_stopped_run_goes_on_and_asks_nothing_twice(spark, claims, tmp_path):
    path, asked = str(tmp_path / "v"), str(tmp_path / "asked")

    def counting():
        client = lg.critic()

        def call(messages, *rest):
            import os
            import uuid

            os.makedirs(asked, exist_ok=True)
            with open(os.path.join(asked, uuid.uuid4().hex), "w") as out:
                json.dump([m["content"] for m in messages], out)
            return client(messages, *rest)

        return call

    data = frames(spark, claims)
    part, _ = lg.verify(*data, path, counting, most=2)
    assert rounds.progress(spark, path) == 2 and 0 < part.where("verdict is null").count() < len(claims)
    # What a round left half-written doesn't count.
    spark.range(3).write.parquet(f"{path}/rounds/2")
    for _ in range(4):
        rows, counts = lg.verify(*data, path, counting, most=1)
    assert result(rows, counts) == plain_verify(claims)
    import os

    calls = [open(os.path.join(asked, f)).read() for f in os.listdir(asked)]
    answers = sum(spark.read.parquet(f"{path}/rounds/{k}").count() for k in range(6))
    assert len(calls) == answers
    again, counts = lg.verify(*data, path, counting)
    assert len(os.listdir(asked)) == len(calls) and result(again, counts) == plain_verify(claims)


def test_an_empty_ledger(spark, claims, tmp_path):
    rows, chapters = frames(spark, claims)
    empty, counts = lg.verify(rows.where("false"), chapters, str(tmp_path / "e"), lg.critic)
    assert empty.count() == 0 and counts.count() == 0


def test_decisions_are_checked():
    row = {"items": [{"id": "a"}, {"id": "b"}]}
    good = {"id": "a", **dict.fromkeys(lg.FLAGS, True), "verdict": "keep"}
    bad = {"id": "b", **dict.fromkeys(lg.FLAGS, False), "verdict": "remove"}
    assert [d["verdict"] for d in lg.decisions_check({"decisions": [bad, good]}, row)["decisions"]] == ["keep", "remove"]
    for some in ([good], [good, good, bad], [good, {**bad, "id": "c"}], [good, {**bad, "useful": 1}], [good, {**bad, "verdict": "keep"}], "x"):
        with pytest.raises(ValueError):
            lg.decisions_check({"decisions": some}, row)
    assert lg.decisions_repair({"decisions": [{**bad, "verdict": "keep"}, good, good, {"id": "c"}, 7]}, row)["decisions"] == [{**bad, "verdict": "remove"}, good]


def test_sheets_rest_on_kept_claims(spark, tmp_path):
    def writer():
        """Sheets with one statement an entry: right at the first try, at the second, after repair, or never."""

        def call(messages, temperature, max_tokens):
            who = messages[0]["content"].split("about ")[1].split(",")[0]
            entries = [json.loads(x) for x in messages[0]["content"].split("a line:\n")[1].split("\n\n")[0].split("\n")]
            sections = {s: [{"statement": e["claim"], "source_ids": [e["id"]]} for e in entries if e["section"] == s] for s in lg.SECTIONS}
            if who == "Kol" and len(messages) == 1:
                sections.pop(lg.SECTIONS[0])
            if who == "Bo":
                sections[lg.SECTIONS[1]] += [{"statement": "Said (see ch001:x:001) often , so ch2:y.", "source_ids": [entries[0]["id"], entries[0]["id"], "ch9:none"]}, {"statement": "nothing", "source_ids": ["ch9:none"]}, {"statement": "w " * 1100, "source_ids": [entries[0]["id"]]}]
            text = "broken" if who == "Zed" else json.dumps({"sections": sections})
            return {"text": text, "logprobs": {}, "prompt_tokens": 1, "completion_tokens": 1, "finish_reason": "stop"}

        return call

    rows = [("x", c, x, s, f"{x} {c} {s[:4]}", f"ch{c:03d}:{s}:001@{x}", c, "keep" if c < 3 else "remove") for x in ("Ana", "Kol", "Bo", "Zed") for c in range(4) for s in lg.SECTIONS[:2]]
    claims = spark.createDataFrame(rows, "book string, chapter_index int, label string, section string, claim string, id string, nth int, verdict string")
    bounds = spark.createDataFrame([("x", 0), ("x", 1), ("x", 4), ("x", 4)], "book string, boundary int")
    good, errors = lg.sheets(claims, bounds, str(tmp_path / "s"), writer)
    got = {(r.label, r.boundary): r for r in good.collect()}
    assert set(got) == {(x, n) for x in ("Ana", "Kol", "Bo") for n in (1, 4)} and {(r.label, r.boundary) for r in errors.collect()} == {("Zed", 1), ("Zed", 4)}
    assert {k[0]: (r.round, r.repaired) for k, r in got.items()} == {"Ana": (0, False), "Kol": (1, False), "Bo": (2, True)}
    lines = got["Ana", 4].text.split("\n")
    assert lines[:6] == ["## Physicality And Personality", "", "- Ana 0 phys [Ch. 1]", "- Ana 1 phys [Ch. 2]", "- Ana 2 phys [Ch. 3]", ""] and lines[-1] == "_No established information._"
    assert got["Ana", 4].words == len(got["Ana", 4].text.split())
    assert "- Said often, so. [Ch. 1]" in got["Bo", 1].text and "nothing" not in got["Bo", 1].text and "w w" not in got["Bo", 1].text


def test_a_failing_client_is_a_fault(spark, claims, tmp_path):
    def make():
        def call(*_):
            raise OSError("down")

        return call

    few = [c for c in claims if c[:2] == claims[0][:2]]
    rows, counts = lg.verify(*frames(spark, few), str(tmp_path / "v"), make)
    assert rows.select("verdict", "reason").distinct().collect() == [("remove", lg.UNVERIFIED)]
    assert rows.where(F.col("round") < 2).count() == 0 and counts.first().removed_unverified == len(few)


def test_claims_are_numbered_and_joined_once(spark, claims, tmp_path):
    """Claims and counts are read from what was written: nothing is numbered or joined with its decisions again for each use."""
    rows, counts = lg.verify(*frames(spark, claims), str(tmp_path / "v"), lg.critic)
    for df, joins in ((rows, 0), (counts, 1)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and plan.count("Join ") == joins


def test_requests_are_dealt_to_all_tasks(spark, claims, tmp_path):
    some, chapters = frames(spark, [c for c in claims for _ in range(2)])
    lg.verify(some.coalesce(1), chapters.coalesce(1), str(tmp_path / "v"), lg.critic, most=1)
    assert len({r[0] for r in spark.read.parquet(f"{tmp_path}/v/rounds/0").selectExpr("input_file_name()").collect()}) > 1


def test_a_claim_with_quotes_and_braces_stays_on_its_line():
    odd = ['ends }, {"id": "x"', "line\nbreak", '"}, {"', "é "]
    row = {"text": None, "items": [{"nth": i, "id": f"i{i}", "label": "L", "section": "s", "claim": c} for i, c in enumerate(odd)]}
    body = lg._verify_prompt(row).split("one JSON object a line:\n")[1].split("\n\n")[0]
    assert body.split("\n") == [json.dumps({k: x[k] for k in ("id", "label", "section", "claim")}, ensure_ascii=False) for x in row["items"]]


def test_rows_are_taken_by_column():
    import pyarrow as pa

    item = pa.struct([("n", pa.int32()), ("s", pa.string()), ("b", pa.bool_()), ("l", pa.list_(pa.string()))])
    items = [[{"n": 1, "s": "a", "b": True, "l": ["x", None]}, None], [], None, [{"n": None, "s": None, "b": None, "l": None}], [{"n": 3, "s": "", "b": False, "l": []}]]
    for column in (pa.array(items, pa.list_(item)), pa.array([1, None, 3]), pa.array([1.5, None]), pa.array([], pa.list_(item)), pa.array([True, False]), pa.array(["a", None]), pa.array([None, {"n": 2, "s": "z", "b": True, "l": ["q"]}, None], item)):
        for part in (column, column.slice(1), column.slice(0, 2), column.slice(3)):
            assert rounds._plain(part) == part.to_pylist()
