"""Sharding by a minimax contiguous partition.

Rows with equal texts form an atomic group; groups are ordered by a 60-bit prefix of their text's SHA-256, and the
shards are contiguous ranges of that order. The smallest feasible capacity is found by binary search; each trial
packs groups greedily and counts shards, and the cuts are those of the greedy packing at that capacity.

No list of groups is ever gathered. The driver holds a trie over the key's bits with the bytes and rows below each
leaf (at most LEAVES leaves). A trial runs on the trie with two bounds: a cut that falls inside a leaf reaches at least
the leaf's start and at most the target itself. Leaves that a cut can fall into, for a capacity between the two answers,
are split by further bits with one aggregation over the compact row table, until both answers agree. Each round
narrows these leaves by orders of magnitude, so a handful of rounds serve any corpus.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

BITS = 60
#: Bits of one round, and so the bound on the rows that a round brings to the driver.
ROUND_BITS = 14


class Trie:
    """Leaves (key prefix range) in order, with bytes and rows; solves for the capacity with lower and upper bounds."""

    def __init__(self) -> None:
        self.leaves: list[tuple[int, int, int, int, int]] = []  # first key, log2 of width, bytes, rows, groups if 0 or 1 else 2

    def set(self, leaves) -> None:
        self.leaves = sorted(leaves)
        self.ends, total = [0], 0
        for _, _, size, _, _ in self.leaves:
            total += size
            self.ends.append(total)
        self.total = total

    def step(self, start: int, capacity: int) -> tuple[int, int, int | None]:
        """The furthest boundary within start + capacity: at least, at most, and the leaf it is in if that is open."""
        target = start + capacity
        if target >= self.total:
            return self.total, self.total, None
        k = bisect.bisect_right(self.ends, target) - 1
        if self.ends[k] == target or self.leaves[k][4] < 2:
            return self.ends[k], self.ends[k], None
        return self.ends[k], target, k

    def reach(self, capacity: int, shards: int, upper: bool) -> list[int]:
        cuts, at = [], 0
        for _ in range(shards):
            at = self.step(at, capacity)[1 if upper else 0]
            cuts.append(at)
        return cuts

    def smallest(self, shards: int, upper: bool) -> int:
        """The smallest capacity that covers everything, when cuts are rounded up (a lower bound) or down (an upper one)."""
        low, high = 0, self.total
        while low < high:
            mid = (low + high) // 2
            if self.reach(mid, shards, upper)[-1] >= self.total:
                high = mid
            else:
                low = mid + 1
        return low

    def open(self, low: int, high: int, shards: int) -> list[int]:
        """Leaves that some cut can fall into for a capacity in [low, high]."""
        found, least, most = set(), 0, 0
        for _ in range(shards):
            a, b = least + low, most + high
            i = max(0, bisect.bisect_right(self.ends, a) - 1)
            j = min(len(self.leaves) - 1, bisect.bisect_left(self.ends, min(b, self.total)))
            found.update(k for k in range(i, j + 1) if self.leaves[k][4] > 1 and self.ends[k] < b and self.ends[k + 1] > a)
            least, most = self.step(least, low)[0], self.step(most, high)[1]
        return sorted(found)


def _sums(rows: DataFrame, bits: int, where: Column | None) -> list[tuple[int, int, int, int, int]]:
    wide = BITS - bits
    part = rows if where is None else rows.where(where)
    got = part.groupBy(F.shiftright("key", wide).alias("p")).agg(F.sum("size").alias("b"), F.count("*").alias("n"), (F.min("key") != F.max("key")).alias("many"))
    return [(r.p << wide, wide, r.b, r.n, 2 if r.many else 1) for r in got.collect()]


def solve(rows: DataFrame, shards: int) -> tuple[int, list[int]]:
    """(smallest capacity, first keys of shards 1, 2, ...) for rows(key, size); cuts are exact."""
    trie = Trie()
    bits = min(ROUND_BITS, BITS)
    trie.set(_sums(rows, bits, None))
    while True:
        low, high = trie.smallest(shards, True), trie.smallest(shards, False)
        split = trie.open(low, high, shards)
        if not split:
            break
        # The widest leaves first; all that are split in a round get the same number of new bits.
        width = max(trie.leaves[k][1] for k in split)
        group = [k for k in split if trie.leaves[k][1] == width][:512]
        more = max(1, min(width, ROUND_BITS - (len(group) - 1).bit_length()))
        # All leaves of a round are equally wide, so their rows are told by one prefix: a flat set, however many leaves there are.
        where = F.shiftright("key", width).isin([trie.leaves[k][0] >> width for k in group])
        fine = _sums(rows, BITS - width + more, where)
        gone = set(group)
        trie.set([x for k, x in enumerate(trie.leaves) if k not in gone] + fine)
    firsts, at = [], 0
    for _ in range(shards - 1):
        at = trie.step(at, high)[0]
        k = bisect.bisect_left(trie.ends, at)
        # The shard after this cut starts with leaf k.
        firsts.append(trie.leaves[k][0] if k < len(trie.leaves) else 1 << BITS)
    return high, firsts


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Put each row of docs(doc_id, text, ...) into a shard: doc_id, size, text_crc32, shard, slot.

    size is the text's UTF-8 bytes plus 1 (null text: 1). Equal texts share a shard (null is one such text), so a shard
    is over the capacity of an even split only where one group is. slot counts each shard's rows from 0 without gaps,
    ordered by text hash, then doc_id (nulls first), then CRC. text_crc32 of a null text is null. Repeated rows each
    get a slot of their own; an empty table gives an empty result; other columns of docs are ignored.
    """
    text = F.col("text").cast("string")
    rows = cut(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, BITS // 4), 16, 10).cast("long"), F.lit(0)).alias("key"),
    ))
    _, firsts = solve(rows, shards)
    which = F.lit(0)
    for first in firsts:
        which = which + (F.col("key") >= first).cast("int")
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # doc_id is in the ordering, so even one group of a third of all rows is dealt to many tasks.
    ordered = (rows.withColumn("shard", which.cast("int")).repartitionByRange(n, "key", "doc_id").sortWithinPartitions("key", "doc_id", "text_crc32")
               .withColumn("at", F.monotonically_increasing_id()))
    ordered = cut(ordered.select("*", F.shiftright("at", 33).cast("int").alias("part"), (F.col("at").bitwiseAND((1 << 33) - 1)).alias("nth")))
    counts = ordered.groupBy("part", "shard").agg(F.count("*").alias("n")).collect()  # partitions + shards rows at most
    parts: dict[int, int] = {}
    by_shard: dict[int, int] = {}
    for r in counts:
        parts[r["part"]] = parts.get(r["part"], 0) + r["n"]
        by_shard[r["shard"]] = by_shard.get(r["shard"], 0) + r["n"]
    before, total = {}, 0
    for p in sorted(parts):
        before[p] = total
        total += parts[p]
    starts, total = [], 0
    for s in range(shards):
        starts.append(total)
        total += by_shard.get(s, 0)
    offsets = spark.createDataFrame([(p, b) for p, b in before.items()] or [(0, 0)], "part int, before long")
    start = F.element_at(F.array(*[F.lit(s).cast("long") for s in starts]), F.col("shard") + 1)
    return ordered.join(F.broadcast(offsets), "part").select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("nth") - start).alias("slot"))
