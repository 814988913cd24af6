"""Near-duplicate groups from SetSketch registers.

A document is its set of distinct word shingles. Register i of its sketch is a truncated, exponentially spaced
minimum: floor(1 - log_b(min over shingles of an exponential hash / A)), kept within 16 bits. Registers merge by
maximum and two sets share a register about as often as their Jaccard similarity says. Equal sets are one node. Bands of
ROWS registers propose pairs; a pair's similarity is first estimated jointly from the counts of larger, smaller and equal
registers by maximum likelihood, and pairs that can't be near (by more than five standard errors) go; the rest
are verified on their full sets.

Pairs within a band's bucket are not all emitted. Each node is paired with its bucket's centre c, the member that shares
most buckets, and linked ones are joined. Buckets that then still hold several components get more pairs, across components:
of a link x, y at least one end, say x, is not linked to c. Let G be what a set has outside c. Either x and y share a
shingle of G, which an equi-join finds; or they share at most min(|x & c|, |y & c|) shingles, which bounds the sizes of
y that x can be near to, and an equi-join on sizes finds those. In a group of near copies of c both are few, so every link is
decided or inside one component already, while the group costs about a star.

A bucket or a centre may have a third of all nodes. Joins by them are dealt to several tasks by hot_keys: of n rows, keys with more than
DEAL, or n / 2^16, are a bounded table that both sides get; the side of many rows is dealt to PARTS tasks, and the
other side's row is copied to each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import GOLDEN, buffers, chunks, cut, mix, prefix_hash, small_batches, span_hash, words_of
from .graph import components

BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
#: SetSketch parameters: base, rate, and the largest register value.
B, A, TOP = 1.001, 20.0, 65535
PERCENT = 80
#: Rows of one key that a task may get in a join, and the tasks that a key with more is dealt to.
DEAL, PARTS = 1024, 64
#: Margin of the estimate, over five standard errors of REGISTERS registers at 0.8.
MARGIN = 0.22

WORD = np.ones(256, bool)
WORD[[9, 10, 11, 12, 13, 32]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_FACTORS = mix(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64) * GOLDEN) | np.uint64(1)


def shingles(body: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted by row and hash, and the offsets of each row's."""
    rows = len(offsets) - 1
    if not len(body):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    low = LOWER[body]
    start, end, row = words_of(low, offsets, WORD)
    word = span_hash(prefix_hash(common.BYTE_VALUES[low]), start, end)
    n = np.bincount(row, minlength=rows)
    first = np.concatenate(([0], np.cumsum(n)))[:-1]
    full = len(word) - words + 1
    if full > 0:
        h = np.zeros(full, np.uint64)
        for k in range(words):
            h = h * np.uint64(0x9FB21C651E98DF25) + word[k : k + full]
        same = row[:full] == row[words - 1 :]
        hashes, owner = mix(h[same]), row[:full][same]
    else:
        hashes, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < words))
    if len(short):
        h = np.zeros(len(short), np.uint64)
        for k in range(words - 1):
            on = n[short] > k
            h[on] = h[on] * np.uint64(0x9FB21C651E98DF25) + word[first[short[on]] + k]
        hashes = np.concatenate((hashes, mix(h ^ (n[short].astype(np.uint64) * GOLDEN))))
        owner = np.concatenate((owner, short))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=rows))))


def registers(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x REGISTERS truncated logarithms of exponential minima; 0 for an empty set."""
    n = np.diff(offsets)
    out = np.zeros((len(n), REGISTERS), np.uint16)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    least = np.empty((len(full), REGISTERS), np.uint64)
    for i in range(REGISTERS):
        least[:, i] = np.minimum.reduceat(hashes * _FACTORS[2 * i] + _FACTORS[2 * i + 1], offsets[:-1][full])
    u = ((least >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53
    out[full] = np.clip(np.floor(1 - np.log(-np.log1p(-u) / A) / np.log(B)), 0, TOP).astype(np.uint16)
    return out


def estimate(k1: np.ndarray, k2: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarities of pairs from their registers (rows) and set sizes."""
    above, below = (k1 > k2).sum(axis=1), (k1 < k2).sum(axis=1)
    equal = k1.shape[1] - above - below
    u = n1 / np.maximum(n1 + n2, 1)
    v = 1 - u
    grid = np.linspace(0, 1, 201)[None, :] * np.minimum(u / np.maximum(v, 1e-12), v / np.maximum(u, 1e-12))[:, None]

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)

    up, down = p(u[:, None] - v[:, None] * grid), p(v[:, None] - u[:, None] * grid)
    with np.errstate(divide="ignore", invalid="ignore"):
        log = sum(np.where(c[:, None] > 0, c[:, None] * np.log(np.clip(q, 1e-300, 1)), 0) for c, q in ((above, up), (below, down), (equal, 1 - up - down)))
    return grid[np.arange(len(grid)), np.argmax(log, axis=1)]


def sketcher(words: int):
    """An Arrow UDF text -> struct<n, f1, f2, regs>; f1 and f2 are fingerprints of the set."""

    @F.arrow_udf("struct<n: bigint, f1: bigint, f2: bigint, regs: binary>")
    def sketch(text: pa.Array) -> pa.Array:
        body, offsets, _ = buffers(text)
        n, f = np.zeros(len(text), np.int64), np.zeros((2, len(text)), np.uint64)
        regs = np.zeros((len(text), REGISTERS), np.uint16)
        for i, j in chunks(offsets):
            h, at = shingles(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
            n[i:j] = np.diff(at)
            regs[i:j] = registers(h, at)
            for k in range(2):
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h ^ _FACTORS[k]))))
                f[k, i:j] = total[at[1:]] - total[at[:-1]]
        ends = pa.array(np.arange(len(text) + 1, dtype=np.int32) * (2 * REGISTERS))
        raw = pa.Array.from_buffers(pa.binary(), len(text), [None, ends.buffers()[1], pa.py_buffer(regs.tobytes())])
        return pa.StructArray.from_arrays([pa.array(n), pa.array(f[0].view(np.int64)), pa.array(f[1].view(np.int64)), raw], ["n", "f1", "f2", "regs"])

    return sketch


def _matrix(column: pa.Array) -> np.ndarray:
    body, _, _ = buffers(column)
    return np.ascontiguousarray(body).view(np.uint16).reshape(len(column), REGISTERS)


def band_keys(regs):
    """The keys of the BANDS bands of a registers column."""

    @F.arrow_udf("array<bigint>")
    def keys(regs: pa.Array) -> pa.Array:
        k = _matrix(regs).astype(np.uint64)
        h = np.repeat((np.arange(BANDS, dtype=np.uint64) * GOLDEN)[None, :], len(k), axis=0)
        for r in range(ROWS):
            h = mix(h ^ k[:, r::ROWS] + np.uint64(0x632BE59BD9B4E019))
        flat = pa.array(h.reshape(-1).view(np.int64))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(k) + 1, dtype=np.int32) * BANDS), flat)

    return keys(regs)


def similarity(r1, r2, n1, n2):
    """The estimated similarity of two sketches' columns."""

    @F.arrow_udf("double")
    def joint(r1: pa.Array, r2: pa.Array, n1: pa.Array, n2: pa.Array) -> pa.Array:
        a, b, na, nb = _matrix(r1), _matrix(r2), np.asarray(n1).astype(float), np.asarray(n2).astype(float)
        parts = [estimate(a[i : i + 2000], b[i : i + 2000], na[i : i + 2000], nb[i : i + 2000]) for i in range(0, len(a), 2000)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return joint(r1, r2, n1, n2)


def setter(words: int):
    @F.arrow_udf("binary")
    def as_set(text: pa.Array) -> pa.Array:
        body, offsets, _ = buffers(text)
        out = []
        for i, j in chunks(offsets):
            h, at = shingles(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
            out += [h[at[k] : at[k + 1]].tobytes() for k in range(j - i)]
        return pa.array(out, pa.binary())

    return as_set


def difference(s1, s2):
    """Of a centre's set and another: the shingles in common, and those of the other outside the centre."""

    @F.arrow_udf("struct<common: bigint, outside: array<bigint>>")
    def differ(s1: pa.Array, s2: pa.Array) -> pa.Array:
        common_, parts = np.zeros(len(s1), np.int64), []
        for i, (x, y) in enumerate(zip(s1, s2, strict=True)):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            at = np.searchsorted(a, b)
            at[at == len(a)] = 0
            same = a[at] == b
            common_[i] = same.sum()
            parts.append(b[~same].view(np.int64))
        ends = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))
        return pa.StructArray.from_arrays([pa.array(common_), lists], ["common", "outside"])

    return differ(s1, s2)


def linker(percent: int):
    @F.arrow_udf("boolean")
    def linked(s1: pa.Array, s2: pa.Array) -> pa.Array:
        out = np.zeros(len(s1), bool)
        for i, (x, y) in enumerate(zip(s1, s2, strict=True)):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            both = int((b[at] == a).sum()) if len(b) else 0
            out[i] = 100 * both >= percent * (len(a) + len(b) - both)
        return pa.array(out)

    return linked


def hot_keys(counts: DataFrame, key: str) -> DataFrame | None:
    """The keys of counts(key, c) with more than DEAL rows, 2^16 keys at most; None if there are none."""
    total = counts.agg(F.sum("c")).first()[0] or 0
    hot = cut(counts.where(F.col("c") > max(DEAL, total >> 16)).select(key))
    return hot if hot.take(1) else None


def dealt(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None, by: str = "node") -> DataFrame:
    """left join right on key; rows of hot keys are dealt to PARTS tasks by the column `by` of left, and right's are copied there."""
    if hot is None:
        return left.join(right, key)
    own = F.broadcast(hot.withColumnRenamed(hot.columns[0], key))
    part = F.pmod(F.xxhash64(by), F.lit(PARTS)).cast("int")
    many = left.join(own, key, "left_semi").withColumn("part", part)
    copies = right.join(own, key, "left_semi").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return many.join(copies, [key, "part"]).drop("part").unionByName(left.join(own, key, "left_anti").join(right, key))


def _decided(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, hot: DataFrame | None) -> DataFrame:
    """The pairs(a, b) of nodes whose full sets are near; `hot` are those that stand in many pairs as a."""
    a = nodes.select(F.col("node").alias("a"), F.col("regs").alias("r1"), F.col("n").alias("n1"))
    b = nodes.select(F.col("node").alias("b"), F.col("regs").alias("r2"), F.col("n").alias("n2"))
    # Sizes alone rule a pair out when the smaller set is under the share of the larger one.
    sized = dealt(pairs, a, "a", hot, "b").join(b, "b").where(100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2"))
    # Written in between: else one task could hold the workers of both functions.
    near = cut(sized.where(similarity("r1", "r2", "n1", "n2") >= percent / 100 - MARGIN).select("a", "b"))
    full = dealt(near, sets.select(F.col("node").alias("a"), F.col("s").alias("s1")), "a", hot, "b").join(sets.select(F.col("node").alias("b"), F.col("s").alias("s2")), "b")
    return cut(full.where(linker(percent)("s1", "s2")).select("a", "b").distinct())


def _crowd(nodes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(key, node, centre) of buckets with two nodes or more, and the hot keys; the centre shares most buckets, ties to the least."""
    members = cut(nodes.select("node", F.explode(band_keys("regs")).alias("key")).distinct())
    sizes = cut(members.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"))
    hot = hot_keys(sizes, "key")
    members = cut(dealt(members, sizes, "key", hot))
    scores = cut(members.groupBy("node").agg(F.sum("c").alias("score")))
    best = F.max(F.struct("score", (-F.col("node")).alias("minus")))
    centres = cut(members.join(scores, "node").groupBy("key").agg(best.alias("x")).select("key", (-F.col("x.minus")).alias("centre"), F.col("x.score").alias("score")))
    return cut(dealt(members, centres, "key", hot).select("key", "node", "centre", "score")), hot


def _across(crowd: DataFrame, found: DataFrame, sets: DataFrame, percent: int, keys: DataFrame | None, hot: DataFrame | None) -> DataFrame:
    """Pairs(a, b) of different components that can still be near, from buckets that hold several components."""
    held = cut(crowd.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")))
    mixed = cut(held.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("c")).where("x <> y and c > 2").select("key"))
    # A node's home is the best of its centres. Members of a bucket with one home are compared there, once for all buckets;
    # only buckets with several homes are compared around their own centre too.
    homes = crowd.groupBy("node").agg(F.max(F.struct("score", (-F.col("centre")).alias("minus"))).alias("x")).select("node", (-F.col("x.minus")).alias("home"))
    held = cut(dealt(held, mixed, "key", keys).join(homes, "node").select("key", "node", "centre", "home", "component"))
    several = held.groupBy("key").agg(F.min("home").alias("x"), F.max("home").alias("y")).where("x <> y").select("key")
    own = found.select(F.col("node").alias("centre"), F.col("component").alias("of_centre"))
    around = held.select(F.col("home").alias("centre"), "node", "component").union(dealt(held, several, "key", keys).select("centre", "node", "component")).distinct()
    around = cut(around)
    centres = cut(around.select("centre").distinct().join(own, "centre", "left").withColumn("of_centre", F.coalesce("of_centre", "centre")))
    both = dealt(around, centres.join(sets.select(F.col("node").alias("centre"), F.col("s").alias("s1")), "centre"), "centre", hot).join(sets.select("node", F.col("s").alias("s2")), "node")
    both = both.withColumn("d", difference("s1", "s2")).withColumn("n", F.floor(F.length("s2") / 8))
    # most: the largest set that this one can be near to when they share nothing outside the centre.
    most = F.floor(F.col("d.common") * (100 + percent) / percent) - F.col("n")
    spokes = cut(both.select("centre", "node", "component", (F.col("component") != F.col("of_centre")).alias("open"), "n", F.col("d.common").alias("common"), F.col("d.outside").alias("outside"), most.alias("most")))
    x = spokes.where("open").select("centre", F.col("node").alias("p"), F.col("component").alias("cp"), F.col("n").alias("np"), F.col("most").alias("mp"), F.col("outside").alias("op"))
    y = spokes.select("centre", F.col("node").alias("q"), F.col("component").alias("cq"), F.col("n").alias("nq"), F.col("most").alias("mq"), F.col("outside").alias("oq"))
    near = (F.col("cp") != F.col("cq")) & (100 * F.least("np", "nq") >= percent * F.greatest("np", "nq"))
    # A near pair shares at least `need` shingles outside the centre, so prefixes of these sets in order of rarity must meet.
    least = spokes.groupBy("centre").agg(F.min("n").alias("least"))
    low_n = F.greatest(F.ceil(F.col("n") * percent / 100), F.col("least"))
    need = F.ceil((F.col("n") + low_n) * percent / (100 + percent)) - F.col("common")
    grams = dealt(spokes, least, "centre", hot).select("centre", "node", (F.size("outside") + 1 - F.greatest(need, F.lit(1))).alias("prefix"), F.explode("outside").alias("g"))
    times = grams.groupBy("centre", "g").agg(F.count("*").alias("times"))
    nth = F.row_number().over(Window.partitionBy("centre", "node").orderBy("times", "g"))
    grams = cut(grams.join(times, ["centre", "g"]).withColumn("nth", nth).where("nth <= prefix and times > 1").select("centre", "node", "g"))
    x, y = x.drop("op"), y.drop("oq")
    left = grams.withColumnRenamed("node", "p").join(x, ["centre", "p"])
    right = grams.withColumnRenamed("node", "q").join(y, ["centre", "q"])
    shared = left.join(right, ["centre", "g"]).where(near)
    low, high = F.ceil(F.col("np") * percent / 100), F.least("mp", F.floor(F.col("np") * 100 / percent))
    sized = x.where(low <= high).withColumn("size", F.explode(F.sequence(low, high))).join(y.withColumn("size", F.col("nq")), ["centre", "size"]).where(near & (F.col("np") <= F.col("mq")))
    ends = F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")
    return shared.select(*ends).union(sized.select(*ends)).distinct()


def groups(docs: DataFrame, words: int = 5, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of docs(doc_id, text).

    n_shingles is the size of the set of distinct shingles of `words` words (fewer words: the sequence is one shingle).
    Documents with percent / 100 of their union in common are linked; component_id is the least doc_id that
    can be reached. Null, empty and wordless texts have no shingles and are linked with nothing. Rows with one doc_id
    are one document, which has the links of each of its texts. A row without doc_id takes no part: component_id null, kept
    false. An empty table gives an empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), sketcher(words)(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("s"))
    rows = cut(rows.select("doc_id", "s.n", "s.f1", "s.f2", "s.regs"))
    nodes = rows.where("n > 0 and doc_id is not null").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.first("regs").alias("regs"))
    nodes = cut(nodes)
    crowd, keys = _crowd(nodes)
    # The centres that many nodes share.
    hot = hot_keys(crowd.groupBy("centre").agg(F.count("*").alias("c")), "centre")
    ids = crowd.select("node").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text")).join(ids, "node", "left_semi")
    sets = cut(texts.select("node", setter(words)("text").alias("s")).where(F.length("s") > 0))
    star = cut(crowd.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct())
    links = _decided(star, nodes, sets, percent, hot)
    linked = cut(components(links))
    more = _decided(_across(crowd, linked, sets, percent, keys, hot), nodes, sets, percent, None)
    final = components(links.union(more))
    moved = cut(nodes.join(final, "node", "left").withColumn("component", F.coalesce("component", "node")).where("copies > 1 or component <> node").select("n", "f1", "f2", "component"))
    out = rows.select("doc_id", "n", "f1", "f2").join(moved, ["n", "f1", "f2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return _one_each(out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")))


def _one_each(out: DataFrame) -> DataFrame:
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
