"""Quality classification by importance resampling.

Two generative models over hashed n-grams, one of target text and one of the raw corpus, give each document the
importance weight p_target / p_raw; documents are drawn without replacement by Gumbel top-k over the log weights.

Features are single tokens and pairs of neighbouring tokens (maximal runs of word bytes, or of punctuation bytes,
case kept), hashed into BUCKETS. The raw model counts every feature of every document. The target model counts those of
a bounded sample of rows labelled good (SAMPLE rows, the smallest by hash). Each model is mixed with SMOOTH of the uniform one,
so rare buckets are neutral. The log weight of a document is the sum of its features' log ratios, normalised for length: less its
expectation under the target model, over sqrt(features), so that target text has weights about 0 with one spread at any length.
k is the number of documents whose weight is at least a cut that parts the sample's good rows from the others best, each
half of the sample being scored by a model of the other half. The k documents with the largest log weight + Gumbel noise of scale 1
are drawn: a sample without replacement by exp(log weight), in which documents near the cut come in and go out by chance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import buffers, chunks, cut, fresh, mix, power_table, prefix_hash, small_batches, span_hash

BUCKETS = 1 << 16
SAMPLE = 20_000
SMOOTH = 0.05

#: 0: white space and control bytes, 1: word bytes, 2: punctuation.
CLASS = np.full(256, 2, np.uint8)
CLASS[:33] = 0
CLASS[127] = 0
CLASS[128:] = 1
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    CLASS[_a:_b] = 1


def features(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every feature of the rows."""
    if not len(body):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = CLASS[body]
    change = np.empty(len(body), bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change[offsets[:-1][offsets[:-1] < len(body)]] = True
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], len(body))
    full = kind[starts] > 0
    starts, ends = starts[full], ends[full]
    row = np.searchsorted(offsets, starts, side="right") - 1
    one = span_hash(prefix_hash(common.BYTE_VALUES[body]), starts, ends)
    same = row[1:] == row[:-1]
    two = mix(one[:-1] * np.uint64(3) + one[1:])[same]
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    return np.concatenate((one >> shift, two >> shift)).astype(np.int64), np.concatenate((row, row[1:][same]))


def _counted(batches):
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        body, offsets, _ = buffers(batch.column(0))
        for i, j in chunks(offsets):
            bucket, _ = features(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            total += np.bincount(bucket, minlength=BUCKETS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])


def counts(docs: DataFrame) -> np.ndarray:
    """Feature counts of all rows; what comes to the driver is BUCKETS rows at most."""
    got = docs.select(F.col("text").cast("string").alias("text")).where("text is not null").mapInArrow(_counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS)
    out[got.bucket.to_numpy(int)] = got.n.to_numpy(float)
    return out


def smoothed(n: np.ndarray) -> np.ndarray:
    return (1 - SMOOTH) * n / max(n.sum(), 1) + SMOOTH / BUCKETS


def weights(target: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, float]:
    """Each bucket's log ratio, and its mean under the target model."""
    p, q = smoothed(target), smoothed(raw)
    ratio = np.log(p / q)
    return ratio, float((p * ratio).sum())


def scorer(ratio: np.ndarray, mean: float):
    """An Arrow UDF (key, text) -> struct<n, weight, draw>; draw is the weight and the Gumbel noise of the key."""

    @F.arrow_udf("struct<n: int, weight: double, draw: double>")
    def score(key: pa.Array, text: pa.Array) -> pa.Array:
        body, offsets, _ = buffers(text)
        n, total = np.zeros(len(text), np.int64), np.zeros(len(text))
        for i, j in chunks(offsets):
            bucket, row = features(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            n[i:j] = np.bincount(row, minlength=j - i)
            total[i:j] = np.bincount(row, weights=ratio[bucket], minlength=j - i)
        weight = (total - n * mean) / np.sqrt(np.maximum(n, 1))
        u = ((mix(np.asarray(key.fill_null(0)).astype(np.int64).view(np.uint64) ^ common.GOLDEN) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53
        draw = weight - np.log(-np.log(u))
        return pa.StructArray.from_arrays([pa.array(n.astype(np.int32)), pa.array(weight), pa.array(draw)], ["n", "weight", "draw"])

    return score


def kth_largest(values: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest of a double column, by radix selection: 16 bits a round, so 65,536 counts at most come to the driver."""
    if k <= 0:
        return None
    # The order of doubles as integers is kept by three 16-bit digits of a fixed-point form.
    digits = values.select((F.round((F.greatest(F.least(F.col(column), F.lit(1e6)), F.lit(-1e6)) + 1e6) * 100_000_000)).cast("long").alias("v"))
    low = 0
    for shift in (32, 16, 0):
        got = digits.where(F.shiftright("v", shift + 16) == (low >> (shift + 16))).groupBy(F.shiftright("v", shift).alias("d")).count().collect()
        for d, c in sorted(((r["d"], r["count"]) for r in got), reverse=True):
            if c >= k:
                low = d << shift
                break
            k -= c
        else:
            return None
    return low / 100_000_000 - 1e6 - 1e-8


class Resampler:
    """Fitted models and the cut; fit() reads all documents once for the raw counts."""

    def __init__(self, ratio: np.ndarray, mean: float, least: float) -> None:
        self.ratio, self.mean, self.least = ratio, mean, least

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Resampler | None:
        """None if no labelled row is good: then nothing can be rejected."""
        rows = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), ((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).alias("good"))
                .where("doc_id is not null and good is not null").groupBy("doc_id").agg(F.min("good").alias("good")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
        # At most `sample` rows of two small columns: safe to broadcast.
        known = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(rows), "doc_id"))
        # Each half of the sample is scored by a model of the other half, so that the cut fits texts the model hasn't seen.
        half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0
        parts = [counts(known.where(F.col("good") & half)), counts(known.where(F.col("good") & ~half))]
        target = parts[0] + parts[1]
        if not target.sum():
            return None
        raw = counts(docs)
        good, bad = [], []
        for own, other in ((half, parts[1]), (~half, parts[0])):
            if other.sum():
                held = known.where(own).select("good", scorer(*weights(other, raw))("doc_id", "text").alias("s")).select("good", "s.weight").toPandas()
                good.append(held.weight[held.good].to_numpy())
                bad.append(held.weight[~held.good].to_numpy())
        ratio, mean = weights(target, raw)
        good, bad = (np.concatenate(x) if x else np.zeros(0) for x in (good, bad))
        return cls(ratio, mean, best_cut(good, bad) if len(good) else -np.inf)

    def scored(self, docs: DataFrame, column: str = "_s") -> DataFrame:
        key = F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
        return docs.withColumn(column, scorer(self.ratio, self.mean)(key, F.col("text").cast("string")))


def best_cut(good: np.ndarray, bad: np.ndarray, slack: float = 0.5) -> float:
    """The cut that parts the labelled rows best, counting a good row lost as ten bad ones kept, and then lowered by slack."""
    if not len(bad):
        return float(good.min()) - slack
    at = np.unique(np.concatenate((good, bad)))
    lost = np.searchsorted(np.sort(good), at) / len(good)
    kept = 1 - np.searchsorted(np.sort(bad), at) / len(bad)
    return float(at[np.argmin(10 * lost + kept)]) - slack


def resample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that the draw keeps, with _features, _log_weight and _draw (names that docs has get more underscores).

    Null, empty and token-free texts have no features and weight 0, that of typical target text, and are drawn by the same rule as
    others. Equal doc_ids share their noise, so repeated rows stand or fall together; ties at the threshold are all kept. Without a good labelled row
    everything is kept with weight 0. An empty table gives an empty result. Extra columns are carried along.
    """
    small_batches(docs.sparkSession)
    names = [fresh(docs, c) for c in ("_features", "_log_weight", "_draw")]
    model = Resampler.fit(docs, labels, sample)
    if model is None:
        return docs.withColumns({names[0]: F.lit(0), names[1]: F.lit(0.0), names[2]: F.lit(0.0)})
    s = fresh(docs, "_s")
    least = threshold(model, docs)
    out = model.scored(docs, s)
    if least is not None:
        out = out.where(F.col(s)["draw"] >= least)
    else:
        out = out.where(F.lit(False))
    return out.withColumns({n: F.col(s)[f] for n, f in zip(names, ("n", "weight", "draw"), strict=True)}).drop(s)


def threshold(model: Resampler, docs: DataFrame) -> float | None:
    """The k-th largest draw, where k is the number of documents that weigh at least the cut."""
    # Texts are scored here and once more for the result: that costs less than a join of the scores with whole texts.
    draws = cut(model.scored(docs.select("doc_id", "text"), "s").select("s.weight", "s.draw"))
    k = draws.where(F.col("weight") >= model.least).count()
    return kth_largest(draws, "draw", k)
