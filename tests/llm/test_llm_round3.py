"""Ball k-means, hard negatives and byte-level BPE against plain versions, and on odd tables."""

import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from inkstrata.llm import ballkmeans, bytebpe, vafile

VECTORS = "vec_id bigint, embedding array<float>, label int"


def floats(values):
    return [float(np.float32(v)) for v in values]


def integers(values):
    return [math.floor(256 * v) for v in values]


def crowd(rng, n, d, spread=0.15, centres=6):
    middle = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(centres)]
    return [floats(m + rng.gauss(0, spread) for m in rng.choice(middle)) for _ in range(n)]


# Centroid clustering


def plain_means(rows, k, rounds, salt="2:"):
    kept = [(i, integers(v)) for i, v in rows]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"{salt}{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [list(x) for _, x in start]
    apart = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    nearest = lambda x: min(range(len(c)), key=lambda j: (apart(x, c[j]), j))
    for _ in range(rounds):
        to = [nearest(x) for _, x in kept]
        for j in set(to):
            own = [x for (_, x), t in zip(kept, to, strict=True) if t == j]
            c[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    return sorted(((i, nearest(x), apart(x, c[nearest(x)])) for i, x in kept), key=repr), c


def test_clusters_equal_plain_rounds(spark):
    rng = random.Random(5)
    rows = [*enumerate(crowd(rng, 260, 8))]
    rows += [(1000 + i, rows[0][1]) for i in range(130)]  # a third are one vector
    rows += [(2000 + i, rows[i][1]) for i in range(5)] + [rows[3], rows[3], (None, rows[5][1])]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    got, centroids = ballkmeans.cluster(frame, k=12, rounds=4, dims=8)
    want, c = plain_means(rows, 12, 4)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got.collect()), key=repr) == want
    assert centroids.tolist() == c


def test_balls_assign_as_all_comparisons_do_and_compare_less():
    rng = np.random.default_rng(3)
    middle = rng.integers(-400, 400, (30, 6))
    x = middle[rng.integers(0, 30, 4000)] + rng.integers(-60, 60, (4000, 6))
    balls = ballkmeans.Balls(np.concatenate((middle, middle[:2])))  # two centroids twice: ties
    every = ((x[:, None, :] - balls.c[None, :, :]) ** 2).sum(axis=2)
    to, d = balls.assign(x, np.full(len(x), -1))
    assert (to == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all()
    balls.compared = 0
    for was in (to, rng.integers(0, 32, len(x))):
        again, e = balls.assign(x, was)
        assert (again == to).all() and (e == d).all()
        if was is to:
            assert balls.compared < 0.3 * every.size


def test_distances_of_long_vectors_are_exact():
    balls = ballkmeans.Balls(np.array([[2**26, -(2**26)], [2**26 - 1, -(2**26)]]))
    to, d = balls.assign(np.array([[2**26, -(2**26) + 1], [-(2**26), 2**26]]), np.array([1, 0]))
    assert to.tolist() == [0, 1] and d.tolist() == [1, (2**27 - 1) ** 2 + 2**54]


def test_clusters_of_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None, 0), (2, [], 0), (3, [1.0, None], 0), (4, [1.0, nan], 0), (5, [inf, 0.0], 0), (6, [1.0], 0), (7, [1e30, 0.0], 0), (None, [0.25, -0.25], 0), (8, [0.5, -0.001], 1)]
    frame = spark.createDataFrame(odd, VECTORS).withColumn("cluster", F.lit("clash")).withColumn("x", F.lit(1))
    got = ballkmeans.clusters(frame, k=40, dims=2).collect()
    assert sorted(((r.vec_id, r.distance) for r in got), key=repr) == [(8, 0), (None, 0)] and {r.inertia for r in got} == {0}
    assert {r.centroid_sha256 for r in got} == {hashlib.sha256(s.encode()).hexdigest() for s in ("64,-64", "128,-1")}
    assert ballkmeans.clusters(frame.where("false")).count() == 0


# Hard negatives


def plain_mining(rows, every, n_pos, n_neg, low, high):
    rows = [(i, label, integers(v)) for i, label, v in dict.fromkeys((i, label, tuple(v)) for i, label, v in rows)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for i, label, x in rows:
        if i % every:
            continue
        scored = sorted(((-dot(x, y), j, other) for j, other, y in rows if len(y) == len(x)), key=lambda r: r[:2])
        for p, j, _ in [r for r in scored if r[2] == label and r[1] != i][:n_pos]:
            inside = [r for r in scored if r[2] != label and low * -p <= 100 * -r[0] <= high * -p][:n_neg]
            out += [(i, j, k + 1, r[1], -p, -r[0]) for k, r in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [1 << 12, 1 << 22])
def test_hard_negatives_equal_the_definition(spark, block_bytes):
    rng = random.Random(9)
    vectors = crowd(rng, 330, 8, 0.4)
    rows = [(i, 0 if i % 3 == 0 else rng.randint(1, 4), v) for i, v in enumerate(vectors)]
    rows += [(500 + i, rng.randint(0, 2), vectors[7]) for i in range(160)]  # ties: one vector a third of the time
    rows += [rows[4], rows[4], (20, 3, vectors[21]), (900, 1, vectors[2][:5]), (901, 2, vectors[3][:5]), (902, 1, vectors[5][:5])]
    frame = spark.createDataFrame([(i, v, label) for i, label, v in rows], VECTORS)
    got = vafile.mine(frame, every=20, positives=3, negatives=4, low=30, high=90, block_bytes=block_bytes)
    want = plain_mining(rows, 20, 3, 4, 30, 90)
    assert sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == want and len(want) > 100


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(0, 32, (5000, 32))).astype(np.int64)
    x[:3] *= 1000  # outliers leave the other cells as they are
    block = vafile.Block(np.arange(5000).tobytes(), (np.arange(5000) % 7).tobytes(), x.astype(np.int32).tobytes(), *(a.tobytes() for a in vafile.quantised(x)))
    least, most = block.bounds(x[10:14])
    exact = x[10:14] @ x.T
    assert (least <= exact).all() and (exact <= most).all()
    rows, score = block.positives(x[10], 10, 3, least[0], most[0], 5)
    assert block.scored < 5000 / 7 / 2 and len(rows) == 5
    block.negatives(x[10], 3, least[0], most[0], *vafile.window(int(score[-1]), 30, 90), 10)
    assert block.scored < 2500


def test_the_window_is_exact():
    for p in (*range(-40, 41), 2**55 + 7):
        low, high = vafile.window(p, 30, 90)
        for s in {low - 1, low, high, high + 1}:
            assert (low <= s <= high) == (30 * p <= 100 * s <= 90 * p)


def test_hard_negatives_of_odd_tables(spark):
    odd = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 9.0], 2), (3, None, 1), (4, [1.0, None], 1), (5, [float("nan"), 1.0], 1), (6, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (7, [], 1), (8, [1e30, 1.0], 2)]
    frame = spark.createDataFrame(odd, VECTORS).withColumn("key", F.lit("clash")).withColumn("d", F.lit(1))
    assert [tuple(r) for r in vafile.mine(frame).collect()] == [(0, 1, 1, 2, 65536, 32768)]
    assert vafile.mine(frame.where("false")).count() == 0 and vafile.mine(frame.where("vec_id = 1")).count() == 0


# Byte-level BPE


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.ranks().whole, special_tokens={})


TEXTS = [None, "", " ", "a", "é😀 ▁x́", "x" * 70_000, "ab" * 3_000, "don't we'LL 'tis 're", " \n\t  \n x  \n", "漢字かな交じり文" * 300, "a\u0000b\r\n", "1234567890" * 40, "=-" * 200, "same text", "same text"]


def test_ids_equal_the_librarys_and_decode_to_the_text(spark, reference):
    rng = random.Random(2)
    ranges_ = [(32, 127), (0xA0, 0x2FF), (0x400, 0x4FF), (0x4E00, 0x9FFF), (0x1F300, 0x1F5FF)]
    texts = TEXTS + ["".join(chr(rng.randint(*rng.choice(ranges_))) for _ in range(rng.randint(1, 400))) for _ in range(120)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").withColumn("token_ids_", F.lit("kept")).withColumn("Token_Ids", F.lit("clash"))
    coded = bytebpe.encode(frame)
    assert coded.columns[-1] == "token_ids__"
    got = bytebpe.decode(coded, "token_ids__").collect()
    assert len(got) == len(texts)
    for r in got:
        want = None if r.text is None else reference.encode_ordinary(r.text)
        assert r["token_ids__"] == want, r.text[:40]
        assert (r.token_bytes.packed, r.token_bytes.body) == ((None, None) if want is None else (np.array(want, "<u4").tobytes(), r.text.encode()))
    assert bytebpe.decode(bytebpe.encode(frame.select("text").where("false"))).count() == 0


def plain_merges(ranks, word):
    parts = [bytes([b]) for b in word]
    while True:
        least = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
        if least is None:
            return [ranks[p] for p in parts]
        parts[least[1] : least[1] + 2] = [parts[least[1]] + parts[least[1] + 1]]


def test_merges_of_any_vocabulary_are_one_pair_at_a_time(tmp_path):
    """Vocabularies whose ranks are in no order of merges, so that a merge often makes a pair of lower rank."""
    import base64

    for seed in range(40):
        rng = random.Random(seed)
        entries = {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))) for _ in range(rng.randint(3, 40))}
        every = [bytes([b]) for b in range(256)] + sorted(entries)
        order = list(range(len(every)))
        rng.shuffle(order)
        path = tmp_path / f"{seed}.ranks"
        path.write_text("".join(f"{base64.b64encode(t).decode()} {k}\n" for t, k in zip(every, order, strict=True)))
        v = bytebpe.Ranks(str(path))
        words = [bytes(rng.choice(b"abc") for _ in range(rng.choice((1, 2, 3, 7, 20, 90)))) for _ in range(60)]
        ids, counts = bytebpe.merged(v, np.concatenate([v.byte_id[np.frombuffer(w, np.uint8)] for w in words]), np.array([len(w) for w in words]))
        ends = np.cumsum(counts)
        assert [ids[e - c : e].tolist() for e, c in zip(ends, counts, strict=True)] == [plain_merges(v.whole, w) for w in words]
        ids, counts = bytebpe.encode_words(v, words)
        ends = np.cumsum(counts)
        assert [ids[e - c : e].tolist() for e, c in zip(ends, counts, strict=True)] == [[v.whole[w]] if w in v.whole else plain_merges(v.whole, w) for w in words]


@pytest.mark.parametrize("most", [3, 10, 64])
def test_slices_cut_between_matches(most):
    pattern = regex.compile(public_tokenizers.PATTERN)
    for text in [t[:900] for t in TEXTS if t] + ["we'll  go   'n'see 'll l'l " * 5, "a" + " " * 50 + "b", "'" * 9 + "re"]:
        assert [w for part in bytebpe.matches(pattern, text, most) for w in part] == pattern.findall(text)


def test_a_full_memo_starts_anew(monkeypatch, reference):
    monkeypatch.setattr(bytebpe, "MEMO", 20)
    monkeypatch.setattr(bytebpe, "GROUP", 8)
    texts = [f"word{i % 7} other{i} thing{i * i}" for i in range(40)]
    ids, counts = bytebpe.encode_texts(bytebpe.Ranks(public_tokenizers.path(bytebpe.RANKS)), regex.compile(public_tokenizers.PATTERN), texts)
    assert ids.tolist() == [t for x in texts for t in reference.encode_ordinary(x)] and counts.tolist() == [len(reference.encode_ordinary(x)) for x in texts]
