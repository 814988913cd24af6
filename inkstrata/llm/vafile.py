"""Hard-negative mining with a vector-approximation file.

Rows are dealt into blocks of at most about BLOCK_BYTES. A block keeps, besides its vectors, the cell that each component falls into:
CELLS cells a dimension, holding equally many rows, with the least and greatest component in each. For an anchor, a table tells what
each cell of a dimension adds to a score at least and at most; looking up a row's cells gives bounds of its score. Only rows whose bounds
let them into the answer are scored exactly:

- positives: rows of the anchor's label whose upper bound reaches the n-th greatest lower bound of that label in the block;
- negatives: rows of other labels whose bounds meet the window of a positive, and whose upper bound reaches the n-th greatest lower bound
  of the rows that are surely inside of it.

Anchors are sent to all blocks in small packs and stream past a block that stays in memory; a block answers with its best few for
each anchor, which are merged by windows of at most that many rows a block. Labels play no part in the dealing, so a hot label is nothing special.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cells, small_batches, written

CELLS = 64
BLOCK_BYTES = 4 << 20
#: Anchors of a pack, and anchors whose bounds are held at once.
PACK, AT_ONCE = 64, 16
INDEX = "block int, ids binary, labels binary, vectors binary, cells binary, low binary, high binary"


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells of each dimension and row, least and greatest component of each dimension and cell) of rows of integers."""
    n, d = x.shape
    cell, low, high = np.zeros((d, n), np.uint8), np.zeros((d, CELLS), np.int64), np.zeros((d, CELLS), np.int64)
    for k in range(d):
        column = x[:, k]
        order = np.sort(column)
        edges = np.unique(order[np.arange(CELLS) * n // CELLS])
        cell[k] = np.searchsorted(edges, column, side="right") - 1
        low[k, : len(edges)] = edges
        high[k, : len(edges)] = order[np.append(np.searchsorted(order, edges[1:]), n) - 1]
    return cell, low, high


def _packed(table: pa.Table) -> pa.Table:
    """A block's index, one row, from rows (block, vec_id, label, x)."""
    x = np.asarray(table["x"].combine_chunks().flatten(), np.int64).reshape(len(table), -1)
    cell, low, high = quantised(x)
    row = [table["block"][0].as_py(), np.asarray(table["vec_id"], np.int64), np.asarray(table["label"], np.int64), x.astype(np.int32), cell, low, high]
    return pa.Table.from_arrays([pa.array([row[0]], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in row[1:])], [c.split()[0] for c in INDEX.split(", ")])


class Block:
    """A block's rows with their cells."""

    def __init__(self, ids: bytes, labels: bytes, vectors: bytes, cell: bytes, low: bytes, high: bytes) -> None:
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        n = len(self.ids)
        self.x = np.frombuffer(vectors, np.int32).reshape(n, -1)
        self.cell = np.frombuffer(cell, np.uint8).reshape(-1, n).astype(np.intp)
        self.low, self.high = np.frombuffer(low, np.int64).reshape(-1, CELLS), np.frombuffer(high, np.int64).reshape(-1, CELLS)
        #: Rows that were scored exactly, for tests.
        self.scored = 0

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of each anchor with all rows."""
        widest = (np.abs(q).max(axis=0, initial=0) * np.maximum(np.abs(self.low), np.abs(self.high)).max(axis=1, initial=0)).sum()
        kind = np.int32 if widest < 2**31 - 1 else np.int64
        least, most = np.zeros((len(self.ids), len(q)), kind), np.zeros((len(self.ids), len(q)), kind)
        for k in range(self.x.shape[1]):
            a, b = self.low[k][:, None] * q[None, :, k], self.high[k][:, None] * q[None, :, k]
            least += np.minimum(a, b).astype(kind)[self.cell[k]]
            most += np.maximum(a, b).astype(kind)[self.cell[k]]
        return np.ascontiguousarray(least.T), np.ascontiguousarray(most.T)

    def _best(self, q: np.ndarray, rows: np.ndarray, n: int, low: int | None = None, high: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the first n of some rows, of those inside the window if there is one."""
        self.scored += len(rows)
        score = (self.x[rows].astype(np.int64) * q).sum(axis=1)
        if low is not None:
            inside = (score >= low) & (score <= high)
            rows, score = rows[inside], score[inside]
        order = np.lexsort((self.ids[rows], -score))[:n]
        return rows[order], score[order]

    def positives(self, q: np.ndarray, own: int, label: int, least: np.ndarray, most: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.flatnonzero((self.labels == label) & (self.ids != own))
        if len(rows) > n:
            rows = rows[most[rows] >= np.partition(least[rows], -n)[-n]]
        return self._best(q, rows, n)

    def negatives(self, q: np.ndarray, label: int, least: np.ndarray, most: np.ndarray, low: int, high: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        may = (self.labels != label) & (most >= low) & (least <= high)
        sure = least[may & (least >= low) & (most <= high)]
        if len(sure) >= n:
            may &= most >= np.partition(sure, -n)[-n]
        return self._best(q, np.flatnonzero(may), n, low, high)


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """The least and greatest s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def searcher(positives: int, negatives: int, low: int, high: int, mining: bool):
    """Rows in which a block's index is followed by packs of anchors, to the block's best rows for each anchor: its positives, or its
    negatives for each positive that the anchor brings."""
    names = ["anchor_id", "key", *(["nth"] * mining), "positive_id", "positive_score", *(["negative_id", "negative_score"] * mining)]

    def asked(block: Block, pack: list[dict]) -> Iterator[tuple]:
        for i in range(0, len(pack), AT_ONCE):
            some = pack[i : i + AT_ONCE]
            q = np.array([a["x"] for a in some], np.int64)
            least, most = block.bounds(q)
            for k, a in enumerate(some):
                if not mining:
                    rows, score = block.positives(q[k], a["vec_id"], a["label"], least[k], most[k], positives)
                    yield from ((a["vec_id"], a["key"], *r) for r in zip(block.ids[rows].tolist(), score.tolist(), strict=True))
                    continue
                for p in a["positives"]:
                    rows, score = block.negatives(q[k], a["label"], least[k], most[k], *window(p["score"], low, high), negatives)
                    yield from ((a["vec_id"], a["key"], p["nth"], p["id"], p["score"], *r) for r in zip(block.ids[rows].tolist(), score.tolist(), strict=True))

    def search(batches):
        block = None
        for batch in batches:
            for t in range(batch.num_rows):
                if batch.column("vectors")[t].is_valid:
                    block = Block(*(batch.column(c)[t].as_py() for c in ("ids", "labels", "vectors", "cells", "low", "high")))
                    continue
                out = list(asked(block, batch.column("anchors")[t].as_py()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)

    return search, ", ".join(f"{c} bigint" for c in names)


def mine(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of the rows whose vec_id is divisible by `every`.

    Scores are inner products of the integers floor(256 * x). An anchor's positives are its first rows of the same label; a positive's
    negatives are the first rows of other labels with low * positive <= 100 * negative <= high * positive. First is the higher score,
    then the smaller vec_id; rows with the anchor's vec_id are no positives of it. Null ids, labels and vectors, null and non-finite components take no
    part, nor do vectors whose integers have a squared length of 2 ** 56 or more (their scores needn't fit). Repeated rows count
    once; one vec_id with several vectors or labels is several rows, and several anchors. Vectors of different lengths have no score. An
    empty table gives an empty result; other columns are ignored.
    """
    spark = rows.sparkSession
    small_batches(spark)
    x, fine = cells("embedding")
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))
    kept = written(kept.where(F.size("x") > 0).distinct().withColumns({"d": F.size("x"), "key": F.xxhash64("vec_id", "label", "x")}))
    anchor = F.col("vec_id") % every == 0
    # A row for each length that vectors have.
    kinds, base = [], 0
    for r in kept.groupBy("d").agg(F.count("*").alias("n"), F.count_if(anchor).alias("a")).orderBy("d").collect():
        blocks = -(-r["n"] * r["d"] * 8 // block_bytes)
        kinds.append((r["d"], base, blocks, r["a"] // PACK + 1))
        base += blocks
    if not kinds:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    kinds = F.broadcast(spark.createDataFrame(kinds, "d int, base int, blocks int, packs int"))
    kept = kept.join(kinds, "d")
    index = written(kept.select((F.col("base") + F.pmod("key", "blocks")).cast("int").alias("block"), "vec_id", "label", "x").groupBy("block").applyInArrow(_packed, INDEX))

    def met(anchors: DataFrame, mining: bool) -> DataFrame:
        """What all blocks answer to the anchors."""
        carried = F.struct("vec_id", "key", "label", "x", *(["positives"] * mining))
        packs = anchors.groupBy("d", "base", "blocks", F.pmod(F.xxhash64("key"), "packs").alias("pack")).agg(F.collect_list(carried).alias("anchors"))
        sent = packs.select(F.explode(F.sequence("base", F.col("base") + F.col("blocks") - 1)).alias("block"), "anchors")
        search, kind = searcher(positives, negatives, low, high, mining)
        beside = index.unionByName(sent, allowMissingColumns=True).repartition(base, "block").sortWithinPartitions("block", F.col("vectors").isNull())
        return beside.mapInArrow(search, kind)

    anchors = kept.where(anchor)
    nth = F.row_number().over(Window.partitionBy("anchor_id", "key").orderBy(F.desc("positive_score"), "positive_id"))
    best = met(anchors, False).withColumn("nth", nth).where(F.col("nth") <= positives)
    best = best.groupBy(F.col("anchor_id").alias("vec_id"), "key").agg(F.collect_list(F.struct("nth", F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))).alias("positives"))
    found = met(anchors.join(written(best), ["vec_id", "key"]), True)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "key", "nth").orderBy(F.desc("negative_score"), "negative_id"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
