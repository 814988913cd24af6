"""Centroid clustering by balls: exact k-means over integer vectors that compares a vector only with the centroids that can win it.

The members of a cluster in a batch are a ball around its centroid, whose radius is the farthest member's distance. A centroid is a
neighbour of the ball when half its distance from the ball's centre is within the radius; no other can be as near to any member.
Members nearer to their centre than half the way to the nearest neighbour are the stable core and stay. The others lie in annuli: a
member in the annulus between the m-th and the next neighbour's half-way is compared exactly with the first m neighbours. All
comparisons are of integers, so ties are exact; they go to the smaller number.

Rows and their clusters are written to the shared folder once a round. Centroids (k vectors) go out with the tasks; k rows of sums come back,
added up by Spark in each partition first. No row is shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cells, small_batches, written

STATE = "vec_id bigint, x array<int>, cluster int, distance bigint"


class Balls:
    """Centroids, each one's others by distance, and the assignment of vectors to them."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.c = centroids.astype(np.int64)
        apart = self.c[:, None, :] - self.c[None, :, :]
        apart = (apart * apart).sum(axis=2)
        np.fill_diagonal(apart, -1)  # oneself comes first
        self.order = np.argsort(apart, axis=1, kind="stable")[:, 1:]
        self.apart = np.take_along_axis(apart, self.order, 1)
        #: Vectors that were compared with a centroid, for tests.
        self.compared = 0

    def distances(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Squared distances of vectors from some centroids."""
        c = self.c[which]
        self.compared += len(x) * len(c)
        # Products of floats are exact while they stay under 2 ** 53.
        kind = np.float64 if float(np.abs(x).max(initial=1)) * float(np.abs(c).max(initial=1)) * x.shape[1] < 2.0**52 else np.int64
        inner = (x.astype(kind) @ c.T.astype(kind)).astype(np.int64)
        return (x * x).sum(axis=1)[:, None] - 2 * inner + (c * c).sum(axis=1)[None, :]

    def nearest(self, x: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance) among some centroids."""
        which = np.sort(which)
        d = self.distances(x, which)
        best = d.argmin(axis=1)
        return which[best], d[np.arange(len(x)), best]

    def assign(self, x: np.ndarray, was: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance) of vectors that were in the clusters `was` (-1: none yet)."""
        to, d = was.astype(np.int64), np.zeros(len(x), np.int64)
        for j in np.unique(was):
            rows = np.flatnonzero(was == j)
            if j < 0:
                to[rows], d[rows] = self.nearest(x[rows], np.arange(len(self.c)))
                continue
            own = self.distances(x[rows], np.array([j]))[:, 0]
            d[rows] = own
            neighbours = self.apart[j][: np.searchsorted(self.apart[j], 4 * own.max(), side="right")]
            annulus = np.searchsorted(neighbours, 4 * own, side="right")
            for m in np.unique(annulus[annulus > 0]):
                some = rows[annulus == m]
                to[some], d[some] = self.nearest(x[some], np.append(self.order[j][:m], j))
        return to, d


def assigner(centroids: np.ndarray):
    """Batches of (vec_id, x, cluster) to those with the new cluster and the squared distance."""

    def assign(batches):
        balls = Balls(centroids)
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, centroids.shape[1]).astype(np.int64)
            to, d = balls.assign(x, np.asarray(batch.column("cluster").fill_null(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array(to, pa.int32()), pa.array(d, pa.int64())], ["vec_id", "x", "cluster", "distance"])

    return assign


def cluster(rows: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, salt: str = "2:") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, x, cluster, distance) of the rows that are kept, and the centroids they are assigned to.

    Kept are vectors of `dims` components, none null or non-finite, whose integer components floor(256 * x) have a squared length under
    2 ** 56 (longer ones have no distance that is sure to fit a long). Centroids start as the k kept vectors with the least sha256 of salt and
    vec_id; of one hash, the least vector first. Every row counts, repeated ones too; a null vec_id hashes as an empty one. Fewer rows
    than k are all centroids; an empty table gives an empty result. Other columns are ignored.
    """
    small_batches(rows.sparkSession)
    x, fine = cells("embedding")
    size = F.size(F.col("embedding")) == dims
    kept = written(rows.where(size & fine).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"), F.lit(None).cast("int").alias("cluster")))
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    centroids = np.array([r["x"] for r in kept.orderBy(digest, "x").limit(k).select("x").collect()], np.int64).reshape(-1, dims)
    sums = [F.sum(F.col("x")[i].cast("long")).alias(f"s{i}") for i in range(dims)]
    state = kept
    for _ in range(rounds):
        state = written(state.mapInArrow(assigner(centroids), STATE))
        for r in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
            centroids[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
    return written(state.mapInArrow(assigner(centroids), STATE)), centroids


def clusters(rows: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, salt: str = "2:") -> DataFrame:
    """The rows of `cluster` with cluster_inertia and inertia (sums of squared distances) and centroid_sha256."""
    spark = rows.sparkSession
    got, centroids = cluster(rows, k, rounds, dims, salt)
    sums = {r["cluster"]: r["s"] for r in got.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    of = [(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    about = spark.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return got.drop("x").join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
