"""Benchmark decontamination by q-gram filtering.

An occurrence of an item of n characters with at most e edits keeps at least n - q + 1 - q * e of its q-grams, and they lie on
diagonals (text position less item position) at most e apart. Shared q-grams are therefore counted per row, item
and diagonal band; bands are 2 (e + 1) wide and overlap by half, so one of them holds every such set of diagonals. Bands
that meet the bound are verified by a banded alignment with free ends, all bands of a chunk side by side.

Texts are compared as lower-case letters (A-Z only), digits and bytes over 127, everything else being one space.
The benchmark is the query side: it goes to the workers in blocks of about BLOCK_BYTES, one pass of the rows a block; with several blocks,
a pass is written before the next block is read, so one block is held at a time. An item's edit budget is RATE of its n
characters, rounded down, and (n - Q) / Q at most, so that at least one q-gram has to be shared.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, buffers, chunks, cut, fresh, ranges, small_batches

Q = 8
#: Edits allowed per character of an item.
RATE = 0.08
BLOCK_BYTES = 8 << 20
BITS = 22
RESULT = "array<struct<item_id: bigint, start: int, end: int, edits: int>>"

FOLD = np.full(256, 32, np.uint8)
FOLD[128:] = np.arange(128, 256)
for _a, _b, _to in ((48, 58, 48), (65, 91, 97), (97, 123, 97)):
    FOLD[_a:_b] = np.arange(_to, _to + _b - _a)


def normal(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes, their places in body, offsets of rows in the folded bytes); rows begin and end without a space."""
    plain = FOLD[body]
    space = plain == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    begins = offsets[:-1][offsets[:-1] < len(body)]
    keep[begins] = ~space[begins]
    place = np.flatnonzero(keep)
    return plain[place], place, np.searchsorted(place, offsets)


def grams(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as one word; rows' last 7 places are not cut off here."""
    a = text.astype(np.uint64)
    for k in (1, 2, 4):
        a = a[:-k] | (a[k:] << np.uint64(8 * k))
    return a


class Items:
    """One block of the benchmark: folded texts, edit budgets, and where each q-gram stands."""

    def __init__(self, ids: list[int], texts: list[str]) -> None:
        self.ids, self.texts, self.tiny = [], [], []
        for i, t in zip(ids, texts, strict=True):
            raw = np.frombuffer(t.encode(), np.uint8)
            flat = normal(raw, np.array([0, len(raw)]))[0].tobytes().strip()
            if len(flat) >= Q:
                self.ids.append(i)
                self.texts.append(np.frombuffer(flat, np.uint8))
            elif flat:
                self.tiny.append((i, flat))
        self.size = np.array([len(t) for t in self.texts], np.int64)
        # A budget that leaves at least one q-gram to be shared.
        self.edits = np.minimum((self.size * RATE).astype(np.int64), np.maximum((self.size - Q) // Q, 0))
        self.least = np.maximum(self.size - Q + 1 - Q * self.edits, 1)
        parts = [grams(t) for t in self.texts]
        gram = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        count = np.array([len(p) for p in parts], np.int64)
        item, pos = np.repeat(np.arange(len(parts)), count), ranges(count)
        order = np.argsort(gram, kind="stable")
        self.item, self.pos = item[order], pos[order]
        self.gram, self.first, self.times = np.unique(gram[order], return_index=True, return_counts=True)
        # A bit for each class of sizes (by doubling), so that short items' low bounds are asked of their own q-grams only.
        self.group = np.minimum(np.log2(np.maximum(self.size, 1)).astype(np.int64), 12) - 3 if len(self.size) else np.zeros(0, np.int64)
        self.bitmap = np.zeros(1 << BITS, np.uint16)
        np.bitwise_or.at(self.bitmap, self.slot(gram), np.uint16(1) << self.group[item].astype(np.uint16))

    @staticmethod
    def slot(gram: np.ndarray) -> np.ndarray:
        return (gram * GOLDEN >> np.uint64(64 - BITS)).astype(np.int64)

    def bands(self, text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, item, least diagonal of the band) of bands that meet their bound; diagonals are places in `text`."""
        none = (np.zeros(0, np.int64),) * 3
        if len(text) < Q or not len(self.gram):
            return none
        all_grams = grams(text)
        bits = self.bitmap[self.slot(all_grams)]
        n = len(bits)
        wanted = np.zeros(n, bool)
        for g in np.unique(self.group):
            # A region needs as many hits as the class's least bound within its greatest reach.
            own = self.group == g
            reach, least = int((self.size + 2 * self.edits)[own].max()), int(self.least[own].min())
            at = np.flatnonzero(bits & np.uint16(1 << int(g)))
            if len(at) < least:
                continue
            # Hit i opens a full region if the hit least - 1 further on is within reach.
            opens = np.flatnonzero(at[least - 1 :] - at[: len(at) - least + 1] < reach)
            if len(opens):
                lasts = np.searchsorted(at, at[opens] + reach)
                cover = np.bincount(opens, minlength=len(at) + 1) - np.bincount(lasts, minlength=len(at) + 1)
                wanted[at[np.cumsum(cover)[:-1] > 0]] = True
        place = np.flatnonzero(wanted)
        if not len(place):
            return none
        found = np.searchsorted(self.gram, all_grams[place])
        found[found == len(self.gram)] = 0
        same = self.gram[found] == all_grams[place]
        place, found = place[same], found[same]
        row = np.searchsorted(offsets, place, side="right") - 1
        inside = place + Q <= offsets[row + 1]
        place, found, row = place[inside], found[inside], row[inside]
        times = self.times[found]
        at = np.repeat(self.first[found], times) + ranges(times)
        item, diagonal, row = self.item[at], np.repeat(place, times) - self.pos[at], np.repeat(row, times)
        wide = 2 * (self.edits[item] + 1)
        out = []
        for shift in (0, 1):
            low = (diagonal + shift * wide // 2) // wide
            key = np.stack((row, item, low), 1)
            order = np.lexsort((low, item, row))
            key = key[order]
            edge = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1)))) if len(key) else np.zeros(0, np.int64)
            n = np.diff(np.append(edge, len(key)))
            key = key[edge][n >= self.least[key[edge, 1]]]
            w = 2 * (self.edits[key[:, 1]] + 1)
            out.append(np.stack((key[:, 0], key[:, 1], key[:, 2] * w - shift * w // 2), 1))
        got = np.unique(np.concatenate(out), axis=0)
        return got[:, 0], got[:, 1], got[:, 2]

    def align(self, text: np.ndarray, offsets: np.ndarray, row, item, low) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(edits, start, end) of each band's best alignment within its row; edits over the budget mean none."""
        edits, size = self.edits[item], self.size[item]
        wide = 4 * edits + 2
        k = np.arange(int(wide.max()))
        base = low - edits
        cost = np.int64(1 << 20)
        bad = np.int64(1 << 40)
        # The value holds the cost above the place on the first diagonal, so the least value also tells the start.
        value = np.where(k < wide[:, None], k[None, :], bad)
        lo, hi = offsets[row][:, None], offsets[row + 1][:, None]
        best = np.full(len(row), bad)
        last = np.zeros(len(row), np.int64)
        letters = np.zeros((len(row), int(size.max())), np.uint8)
        for i, x in enumerate(item):
            letters[i, : size[i]] = self.texts[x]
        for p in range(int(size.max())):
            at = base[:, None] + p + k
            known = (at >= lo) & (at < hi)
            same = known & (text[np.clip(at, 0, len(text) - 1)] == letters[:, p : p + 1])
            step = np.where(known, value + np.where(same, 0, cost), bad)
            drop = np.concatenate((value[:, 1:], np.full((len(row), 1), bad)), 1) + cost
            value = np.minimum(step, drop)
            value = np.minimum.accumulate(value - k * cost, axis=1) + k * cost
            value[k >= wide[:, None]] = bad
            done = np.flatnonzero(size == p + 1)
            if len(done):
                last[done] = np.argmin(value[done] & ~np.int64((1 << 20) - 1), axis=1)
                best[done] = value[done, last[done]]
        spent = np.minimum(best >> 20, 1 << 20)
        start = np.maximum(base + (best & ((1 << 20) - 1)), offsets[row])
        end = np.minimum(base + size + last, offsets[row + 1])
        return spent, start, end

    def matches(self, body: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item id, start, end, edits) in code points of the row."""
        text, place, at = normal(body, offsets)
        out = []
        row, item, low = self.bands(text, at)
        for i in range(0, len(row), 256):
            r, t, d = row[i : i + 256], item[i : i + 256], low[i : i + 256]
            edits, start, end = self.align(text, at, r, t, d)
            for j in np.flatnonzero((edits <= self.edits[t]) & (end > start)):
                out.append((int(r[j]), self.ids[t[j]], int(start[j]), int(end[j]), int(edits[j])))
        for i, flat in self.tiny:
            # A byte string finds its occurrences from left to right; the spaces around a word belong to its neighbours too.
            word = re.compile(rb"(?<= )" + re.escape(flat) + rb"(?= )")
            for r in range(len(at) - 1):
                for m in word.finditer(b" " + text[at[r] : at[r + 1]].tobytes() + b" "):
                    s = m.start() - 1 + int(at[r])
                    out.append((r, i, s, s + len(flat), 0))
        # Bands overlap: of matches of an item that share text, the best one stays.
        kept: dict[tuple[int, int], list] = {}
        for r, i, s, e, c in sorted(out, key=lambda x: (x[4], x[2], x[3])):
            have = kept.setdefault((r, i), [])
            if all(e <= a or s >= b for a, b, _ in have):
                have.append((s, e, c))
        found = []
        for (r, i), have in kept.items():
            lead = np.flatnonzero((body[offsets[r] : offsets[r + 1]] & 0xC0) != 0x80) + offsets[r]
            for s, e, c in sorted(have):
                a, b = int(np.searchsorted(lead, place[s])), int(np.searchsorted(lead, place[e - 1], side="right"))
                found.append((r, i, a, b, c))
        return found


def matcher(items: Items):
    """An Arrow UDF text -> array of matches, by start and item."""

    @F.arrow_udf(RESULT)
    def match(text: pa.Array) -> pa.Array:
        body, offsets, _ = buffers(text)
        lists: list[list[dict]] = [[] for _ in range(len(text))]
        for i, j in chunks(offsets):
            for r, item, a, b, c in items.matches(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                lists[i + r].append({"item_id": item, "start": a, "end": b, "edits": c})
        for x in lists:
            x.sort(key=lambda m: (m["start"], m["item_id"]))
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))
        return pa.array(lists, kind)

    return match


def blocks(benchmark: DataFrame, most: int = BLOCK_BYTES):
    """(number of blocks, the blocks of about `most` bytes, each read when it is asked for)."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    n = int((rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // most) + 1

    def read():
        for k in range(n):
            part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
            got = part.orderBy("item_id", "text").toPandas()
            yield Items(got.item_id.tolist(), got.text.tolist())

    return n, read()


def leaks(docs: DataFrame, benchmark: DataFrame, column: str = "leaks") -> DataFrame:
    """docs(text, ...) with an array<struct<item_id, start, end, edits>> of benchmark passages (as the last column).

    Positions count code points of the whole text. A null, empty or letterless text, an empty benchmark, and items that
    fold to nothing give no match. Items shorter than Q characters match as whole words, without edits. Every occurrence is told, of
    an item's overlapping ones that with the fewest edits. Each row is judged on its own, so repeated rows get equal matches; equal items are all reported. Extra columns are carried; a
    clashing name gets more underscores.
    """
    small_batches(docs.sparkSession)
    own = fresh(docs, column)
    out = docs.withColumn(own, F.array().cast(RESULT))
    n, parts = blocks(benchmark, BLOCK_BYTES)
    for items in parts:
        if items.ids or items.tiny:
            found = matcher(items)(F.coalesce(F.col("text").cast("string"), F.lit("")))
            out = out.withColumn(own, found if n == 1 else F.concat(own, found))
            out = out if n == 1 else cut(out)
    return out
