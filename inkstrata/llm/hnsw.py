"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, shard results merged.

Nearness is the largest inner product. Vectors get one more component, sqrt(longest^2 - norm^2), after which all are equally
long and inner products with (query, 0) order them as before; graphs are built on these. Equal vectors are one graph node
with its smallest ids. A shard's vectors take about SHARD bytes, whatever their length; its graph is stored as flat neighbour arrays, one per layer. Layers are
drawn by a hash of the vector. Nodes are inserted in batches: a batch searches the graph so far from the top layer down, and in each of
its nodes' layers it links them, by the usual diversity rule, to what was found and to each other. Links are two-way; a full list
keeps the nearest. A search starts from the top layer and keeps a beam of EF nodes a layer.

A shard's graph goes to its tasks once, followed by the queries in blocks; queries are split among several tasks only while
there are fewer shards than tasks, and never into more parts than there are blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions, ranges

#: Bytes of a shard's vectors, as doubles.
SHARD = 8 << 20
M = 32
#: Candidates for a node's links, from the beam of an insertion.
WIDE = 64
EF = 96
#: Nodes of a beam that one step opens.
EXPAND = 4
#: Nodes that are inserted together, and queries of one block.
BATCH, BLOCK = 512, 256


def _diverse(x: np.ndarray, near: np.ndarray, sims: np.ndarray) -> np.ndarray:
    """Which candidates (rows of `near`, nearest first, -1 at the end) become links: those nearer to the node than to every kept
    one, and, where these are under M, the nearest of the others."""
    keep = np.zeros(near.shape, bool)
    for i in range(0, len(near), 256):
        some = near[i : i + 256]
        v = x[np.maximum(some, 0)]
        inner = v @ v.transpose(0, 2, 1)
        own, kept = sims[i : i + 256], keep[i : i + 256]
        for j in range(near.shape[1]):
            closest = np.where(kept[:, :j], inner[:, j, :j], -np.inf).max(axis=1) if j else np.full(len(own), -np.inf)
            kept[:, j] = (some[:, j] >= 0) & (own[:, j] > closest) & (kept[:, :j].sum(axis=1) < M)
    spare = M - keep.sum(axis=1)
    rest = ~keep & (near >= 0)
    return keep | (rest & (np.cumsum(rest, axis=1) <= spare[:, None]))


class Layer:
    """One layer while it grows: its nodes, their links as places in the layer, and the links' products."""

    def __init__(self, nodes: np.ndarray, most: int) -> None:
        self.nodes = nodes
        self.links = np.full((len(nodes), most), -1, np.int32)
        self.sims = np.full((len(nodes), most), -np.inf, np.float32)

    def insert(self, x: np.ndarray, old: int, new: int, at: np.ndarray, sims: np.ndarray) -> None:
        """Link the places old..new to the candidates of their beams, and to each other."""
        own = x[self.nodes[old:new]]
        inner = own @ own.T
        np.fill_diagonal(inner, -np.inf)
        at = np.concatenate((at, np.repeat(np.arange(old, new)[None, :], new - old, axis=0)), axis=1)
        sims = np.where(at >= 0, np.concatenate((sims, inner), axis=1), -np.inf)
        if at.shape[1] > WIDE:
            top = np.argpartition(-sims, WIDE - 1, axis=1)[:, :WIDE]
            at, sims = np.take_along_axis(at, top, 1), np.take_along_axis(sims, top, 1)
        order = np.lexsort((at, -sims), axis=1)
        at, sims = np.take_along_axis(at, order, 1), np.take_along_axis(sims, order, 1)
        at[sims == -np.inf] = -1
        row, col = np.nonzero(_diverse(x[self.nodes[:new]], at, sims))
        to, val, row = at[row, col], sims[row, col], row + old
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        self.links[row, nth], self.sims[row, nth] = to, val
        back = ~(self.links[to] == row[:, None]).any(axis=1)
        to, row, val = to[back], row[back], val[back]
        order = np.lexsort((-val, to))
        to, row, val = to[order], row[order], val[order]
        head, nth = np.unique(to), np.arange(len(to)) - np.searchsorted(to, to)
        which = np.searchsorted(head, to)
        more = np.full((len(head), int(nth.max(initial=0)) + 1), -1, np.int32)
        worth = np.full(more.shape, -np.inf, np.float32)
        more[which, nth], worth[which, nth] = row, val
        more, worth = np.concatenate((self.links[head], more), axis=1), np.concatenate((self.sims[head], worth), axis=1)
        top = np.argsort(-worth, axis=1, kind="stable")[:, : self.links.shape[1]]
        self.links[head], self.sims[head] = np.take_along_axis(more, top, 1), np.take_along_axis(worth, top, 1)


class Graph:
    """nodes: each layer's node numbers (layer 0 first); links: each layer's neighbours, as places in the layer."""

    def __init__(self, x: np.ndarray, nodes: list[np.ndarray], links: list[np.ndarray]) -> None:
        self.x, self.nodes, self.links = x, nodes, links

    @classmethod
    def build(cls, x: np.ndarray, draws: np.ndarray) -> Graph:
        level = np.minimum((-np.log(draws) / np.log(M)).astype(int), 8)
        layers = [Layer(np.flatnonzero(level >= k), 2 * M if k == 0 else M) for k in range(int(level.max(initial=0)) + 1)]
        done = 0
        while done < len(x):
            end = min(len(x), done + min(BATCH, max(done, 64)))
            q, beam = x[done:end], None
            for layer in layers[::-1]:
                old, new = np.searchsorted(layer.nodes, (done, end))
                own = layer.nodes[old:new] - done
                at, sims = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0), np.float32)
                if old:
                    start = np.repeat(np.arange(min(WIDE, old))[None, :], len(q), axis=0) if beam is None else np.where(beam >= 0, np.searchsorted(layer.nodes, beam), -1)
                    at, sims = cls._beam(q, x[layer.nodes[:old]], layer.links[:old], start, WIDE)
                    beam = np.where(at >= 0, layer.nodes[at], -1)
                if new > old:
                    layer.insert(x, int(old), int(new), at[own], sims[own])
            done = end
        return cls(x, [layer.nodes for layer in layers], [layer.links for layer in layers])

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, products) of each query's beam at layer 0, -1 where it is not full."""
        beam = np.repeat(self.nodes[-1][None, : min(ef, len(self.nodes[-1]))], len(q), axis=0)
        for nodes, links in zip(self.nodes[::-1], self.links[::-1], strict=True):
            place = np.full(len(self.x), -1)
            place[nodes] = np.arange(len(nodes))
            at = np.where(beam >= 0, place[beam], -1)
            at, sims = self._beam(q, self.x[nodes], links, at, ef)
            beam = np.where(at >= 0, nodes[at], -1)
        return beam, sims

    @staticmethod
    def _beam(q: np.ndarray, x: np.ndarray, links: np.ndarray, start: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        n, low = len(q), np.float32(-np.inf)
        at, sims = np.full((n, ef), -1, np.int64), np.full((n, ef), low, np.float32)
        # The step and place at which a node was first met; of several in one step, one stays.
        seen = np.full((n, len(x)), -1, np.int32)
        at[:, : start.shape[1]] = start
        rows, cols = np.nonzero(start >= 0)
        seen[rows, start[rows, cols]] = 0
        sims[rows, cols] = np.einsum("ij,ij->i", q[rows], x[start[rows, cols]])
        done = at < 0
        live = np.arange(n)
        wide = min(EXPAND, ef)
        while True:
            ahead = np.where(done[live], low, sims[live])
            best = np.argpartition(-ahead, wide - 1, axis=1)[:, :wide] if ef > wide else np.repeat(np.arange(ef)[None, :], len(live), axis=0)
            open_ = ~np.take_along_axis(done[live], best, 1)
            some = open_.any(axis=1)
            live, best, open_ = live[some], best[some], open_[some]
            if not len(live):
                break
            done[live[:, None], best] = True
            near = np.where(open_[:, :, None], links[np.maximum(at[live[:, None], best], 0)], -1).reshape(len(live), -1)
            r, c = np.nonzero((near >= 0) & (seen[live[:, None], near] < 0))
            node = near[r, c]
            seen[live[r], node] = c
            one = seen[live[r], node] == c
            r, c, node = r[one], c[one], node[one]
            value = np.full(near.shape, low, np.float32)
            value[r, c] = np.einsum("ij,ij->i", q[live[r]], x[node])
            every = np.concatenate((sims[live], value), axis=1)
            names = np.concatenate((at[live], near), axis=1)
            closed = np.concatenate((done[live], value == low), axis=1)
            top = np.argpartition(-every, ef - 1, axis=1)[:, :ef]
            at[live], sims[live], done[live] = (np.take_along_axis(z, top, 1) for z in (names, every, closed))
            at[live] = np.where(sims[live] == low, -1, at[live])
        return at, sims


def _pack(arrays: list[np.ndarray]) -> bytes:
    return b"".join(np.array([len(a.tobytes())], np.int64).tobytes() + a.tobytes() for a in arrays)


def _unpack(raw: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(raw):
        n = int(np.frombuffer(raw, np.int64, 1, at)[0])
        out.append(raw[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def _augmented(v: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(longest**2 - (v * v).sum(axis=1), 0))
    return np.ascontiguousarray(np.concatenate((v, rest[:, None]), axis=1), np.float32)


INDEX = "shard int, longest double, ids array<array<bigint>>, vectors binary, nodes binary, links binary"


def _built(table: pa.Table) -> pa.Table:
    """A shard's index, a row of flat arrays, from rows(shard, longest, key, v, ids)."""
    table = table.sort_by("key")
    v = np.array(table["v"].combine_chunks().flatten()).reshape(len(table), -1)
    draws = (np.asarray(table["key"]).view(np.uint64) >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54
    longest = table["longest"][0].as_py()
    g = Graph.build(_augmented(v, longest), draws)
    row = [table["shard"][0].as_py(), longest, table["ids"].to_pylist(), v.astype(np.float64).tobytes(), _pack([a.astype(np.int32) for a in g.nodes]), _pack(g.links)]
    kinds = (pa.int32(), pa.float64(), pa.list_(pa.list_(pa.int64())), pa.binary(), pa.binary(), pa.binary())
    return pa.Table.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], ["shard", "longest", "ids", "vectors", "nodes", "links"])


def searcher(k: int, ef: int):
    """Rows in which a shard's index is followed by blocks of queries, to each query's k nearest of the shard."""

    def search(batches):
        v = graph = first = flat = None
        for batch in batches:
            for t in range(batch.num_rows):
                get = lambda name, t=t, batch=batch: batch.column(name)[t]
                if get("vectors").is_valid:
                    ids = get("ids").values
                    first, flat = np.asarray(ids.offsets).astype(np.int64), np.asarray(ids.values)
                    v = np.frombuffer(get("vectors").as_py()).reshape(len(ids), -1)
                    nodes = [np.frombuffer(x, np.int32) for x in _unpack(get("nodes").as_py())]
                    links = [np.frombuffer(x, np.int32).reshape(len(own), -1) for x, own in zip(_unpack(get("links").as_py()), nodes, strict=True)]
                    graph = Graph(_augmented(v, get("longest").as_py()), nodes, links)
                    continue
                q_ids = np.asarray(get("q_ids").values)
                q = np.array(get("qs").values.flatten()).reshape(len(q_ids), -1)
                beam, _ = graph.search(np.concatenate((q, np.zeros((len(q), 1))), 1).astype(np.float32), ef)
                out = []
                for i in range(len(q)):
                    near = beam[i][beam[i] >= 0]
                    score = (v[near] * q[i]).sum(axis=1)
                    count = first[near + 1] - first[near]
                    names = flat[np.repeat(first[near], count) + ranges(count)]
                    values = np.repeat(score, count)
                    other = names != q_ids[i]
                    names, values = names[other], values[other]
                    order = np.lexsort((names, -values))[:k]
                    out.append((np.full(len(order), q_ids[i]), names[order], values[order]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[j] for x in out])) for j in range(3)], ["query_id", "vec_id", "score"])

    return search, "query_id bigint, vec_id bigint, score double"


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, v) of vectors that take part: finite and not zero."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    got = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine & F.exists("v", lambda x: x != 0))
    return got.distinct()


def nearest(rows: DataFrame, every: int = 20, k: int = 20, ef: int = EF, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose vec_id is divisible by `every`.

    Ties go to the smaller vec_id; fewer candidates than k are all returned. Null, zero and non-finite vectors and null ids take no
    part. Vectors of different lengths have no inner product: each length is searched for itself. Repeated rows count once; one
    vec_id with several vectors is several candidates. An empty table gives an empty result; other columns are ignored.
    """
    spark = rows.sparkSession
    got = usable(rows).withColumn("d", F.size("v"))
    # The k + 1 smallest ids of a vector are all that can be among a query's k nearest.
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    unique = got.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("v", "d").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    unique = cut(unique.select(F.xxhash64("v").alias("key"), "v", "d", "ids"))
    # A row for each length that vectors have.
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    lengths = unique.groupBy("d").agg(F.count("*").alias("n"), (F.sqrt(F.max(norm)) * (1 + 1e-7)).alias("longest")).orderBy("d").collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kinds, base = [], 0
    for r in lengths:
        shards = -(-r["n"] * r["d"] * 8 // shard)
        kinds.append((r["d"], r["longest"], base, shards))
        base += shards
    kinds = F.broadcast(spark.createDataFrame(kinds, "d int, longest double, base int, shards int"))
    placed = unique.join(kinds, "d").withColumn("shard", (F.col("base") + F.pmod("key", "shards")).cast("int"))
    index = cut(placed.select("shard", "longest", "key", "v", "ids").groupBy("shard").applyInArrow(_built, INDEX))
    queries = sum(r["n"] for r in lengths) // every
    blocks = queries // BLOCK + 1
    splits = max(1, min(partitions(spark) // base, blocks))  # an index is copied for blocks of queries, not for partitions
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    asked = got.where(F.col("vec_id") % every == 0).groupBy("d", block.alias("block")).agg(F.collect_list(F.struct("vec_id", "v")).alias("x")).join(kinds, "d")
    asked = asked.select(F.explode(F.sequence("base", F.col("base") + F.col("shards") - 1)).alias("shard"), F.pmod("block", F.lit(splits)).cast("int").alias("split"), F.col("x.vec_id").alias("q_ids"), F.col("x.v").alias("qs"))
    copies = index.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    search, kind = searcher(k, ef)
    met = copies.unionByName(asked, allowMissingColumns=True).repartition(base * splits, "shard", "split").sortWithinPartitions("shard", "split", F.col("vectors").isNull())
    found = cut(met.mapInArrow(search, kind))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
