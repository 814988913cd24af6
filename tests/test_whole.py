"""Queries over whole inputs: nothing is left out by place, id or size."""

import hashlib
import random

import pytest

from inkstrata import catalog
from inkstrata.operators import reps


@pytest.fixture
def tables(spark, tmp_path):
    """Writes hand tables and gives their folder."""

    def write(**named):
        for name, (data, ddl) in named.items():
            spark.createDataFrame(data, ddl).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def documents(texts):
    return [(i, text, "en", source) for i, (source, text) in enumerate(texts)], "doc_id long, text string, lang string, source string"


def test_every_triple_of_a_source_is_matched(spark, tables):
    texts = [("a", " ".join(f"word{i}x{k}" for k in range(3 + i))) for i in range(32)] + [("b", ""), ("b", "one two"), ("b", "red blue")]
    got = catalog.QUERIES["lexical_matcher"](spark, tables(documents=documents(texts))).collect()
    assert sorted((r.item, r.target) for r in got) == sorted([(f"a-{i}", t) for i in [*range(10), "last"] for t in range(3)] + [("b-0", t) for t in range(3)])
    assert all(r.hit == 1 for r in got)


def test_windows_are_returned_whole(spark, tables):
    texts = {b: [" ".join([f"w{b}"] * ((7 * i * i + 5 * b) % 70 + 1)) for i in range(n)] for b, n in ((1, 1), (2, 9), (3, 40))}
    sf = tables(conversations=([(b, i, "user", x) for b, xs in texts.items() for i, x in reversed(list(enumerate(xs)))], "conv_id long, turn int, role string, text string"))
    want = set()
    for b, xs in texts.items():
        left, k = list(xs), 0
        while left:
            now = [left.pop(0)]
            while left and len(now) < 3 and sum(len(x.split()) for x in now) < 60:
                now.append(left.pop(0))
            want.add((b, k, len(now), sum(len(x.split()) for x in now), hashlib.md5("\n\n".join(now).encode()).hexdigest()))
            k += 1
    got = catalog.QUERIES["section_windows"](spark, sf).collect()
    assert len(got) == len(want) and {(r.book, r.k, r.sections, r.words, r.digest) for r in got} == want


def test_a_lost_section_shows_in_the_count(spark, tables, monkeypatch):
    sf = tables(conversations=([(1, i, "user", "a b") for i in range(8)], "conv_id long, turn int, role string, text string"))
    assert [r.sections for r in catalog.QUERIES["window_sections"](spark, sf).collect()] == [8]
    whole = catalog.it.windows
    monkeypatch.setattr(catalog.it, "windows", lambda *args: whole(*args).where("k > 0"))
    assert [r.sections for r in catalog.QUERIES["window_sections"](spark, sf).collect()] == [5]


def test_all_exchanges_are_combined(spark, tables):
    roles = {1: ["system", *["user", "assistant"] * 20], 2: ["user", "assistant", "user"], 3: ["assistant", "user"], 4: ["user"]}
    sf = tables(conversations=([(b, i, r, f"{r} {b} {i}") for b, x in roles.items() for i, r in enumerate(x)], "conv_id long, turn int, role string, text string"))
    want = set()
    for b, x in roles.items():
        by = {r: [f"{r} {b} {i}" for i, y in enumerate(x) if y == r] for r in ("user", "assistant")}
        want |= {(b, k, f"{u}\n\n{a}") for k, (u, a) in enumerate(zip(by["user"], by["assistant"], strict=False))}
    got = catalog.QUERIES["combo_exchanges"](spark, sf).collect()
    assert len(got) == len(want) == 22 and {(r.book, r.exchange, r.text) for r in got} == want


def test_similar_documents_need_not_be_neighbours(spark, tables):
    same = "the quick brown fox jumps over the lazy dog again"
    texts = [("a", same), ("a", "something else entirely here"), ("b", same), ("a", "other words stand there"), ("a", same + " today"), ("a", ""), ("b", "nothing alike")]
    got = catalog.QUERIES["similar_documents"](spark, tables(documents=documents(texts))).collect()
    assert [(r.book, r.x, r.y) for r in got] == [("a", 0, 4)] and 0.8 <= got[0].cosine < 1


def test_similar_pairs_equal_the_loop(spark):
    rng = random.Random(12)
    pool = [f"t{min(rng.randrange(60), rng.randrange(60))}" for _ in range(300)]
    docs = [(k, i, " ".join(rng.choice(pool) for _ in range(rng.randint(3, 25)))) for k in "xy" for i in range(0, 180, 3)]
    docs += [(k, i + 1, t + " t0 t1" * (i % 3)) for k, i, t in docs[::4]]
    v = reps.tfidf(spark.createDataFrame(docs, "k string, i int, text string"), ["k"], ["i"], "text").cache()
    vec = {(r.k, r.i): r.v for r in v.collect()}
    for threshold in (0.3, 0.6, 0.9):
        got = {(r.k, r.x, r.y): r.cosine for r in reps.similar_pairs(v, ["k"], "i", "v", threshold).collect()}
        want = {(k, i, j): s for k, i in vec for kk, j in vec if k == kk and i < j and (s := sum(w * vec[k, j].get(t, 0) for t, w in vec[k, i].items())) >= threshold}
        assert len(want) > 10 and got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_chapters_are_numbered_across_blocks(spark, tables, monkeypatch):
    from inkstrata.sources import adapters

    monkeypatch.setattr(adapters, "BLOCK", 7)
    rng = random.Random(5)
    rows = [(i, f"t {i}", "en", rng.choice("aaab")) for i in rng.sample(range(-20, 400), 150)]
    sf = tables(documents=(rows, "doc_id long, text string, lang string, source string"))
    got = {(r.book, r.doc_id): r.chapter_index for r in adapters.chapters(spark, sf).collect()}
    assert got == {(s, d): k for s in "ab" for k, d in enumerate(sorted(r[0] for r in rows if r[3] == s))}
