"""Statistics over score and text tables: quantiles, variance shares, likelihood gains, overlaps, fronts, bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound


def floor_quantile(values: Column, q: float) -> Column:
    """sorted[int(q * (n - 1))] of an array column."""
    return F.try_element_at(F.array_sort(values), (F.floor(F.lit(q) * (F.size(values) - 1)) + 1).cast("int"))


def upper_median(values: Column) -> Column:
    """sorted[n // 2] of an array column."""
    return F.try_element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def quantiles(rows: DataFrame, keys: list[str], value: str, qs=(0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """Floor-index quantiles by keys, without gathering a group: ranks are spread by the window's sort, one row per quantile stays."""
    w = Window.partitionBy(*keys)
    ranked = rows.where(F.col(value).isNotNull()).select(*keys, value, (F.row_number().over(w.orderBy(value)) - 1).alias("_r"), F.count("*").over(w).alias("_n"))
    picks = [F.max(F.when(F.col("_r") == F.floor(F.lit(q) * (F.col("_n") - 1)), F.col(value))).alias(f"q{round(100 * q):02d}") for q in qs]
    return ranked.groupBy(*keys).agg(*picks, F.max("_n").alias("n"))


def variance_shares(scores: DataFrame) -> DataFrame:
    """Shares of the variance of `x` that lie between items and between conditions."""
    means = scores.withColumns({"m_item": F.avg("x").over(Window.partitionBy("item")), "m_cond": F.avg("x").over(Window.partitionBy("cond"))})
    total = scores.agg(F.avg("x").alias("m"))
    joined = means.crossJoin(F.broadcast(total))  # one row
    sq = lambda a, b: F.sum((F.col(a) - F.col(b)) ** 2)
    return joined.agg(sq("x", "m").alias("t"), sq("m_item", "m").alias("i"), sq("m_cond", "m").alias("c")).select((F.col("i") / F.col("t")).alias("item_share"), (F.col("c") / F.col("t")).alias("cond_share"))


def oracle_pick(hits: DataFrame) -> DataFrame:
    """Shares of units that all conditions, none, the best single one, and the best pick for each get right."""
    n = hits.agg(F.countDistinct("cond").alias("k"))
    units = hits.groupBy("item", "target").agg(F.min("hit").alias("lo"), F.max("hit").alias("hi"), F.countDistinct("cond").alias("c")).join(F.broadcast(n), F.col("c") == F.col("k"))
    shares = units.agg(F.avg("lo").alias("all_right"), (1 - F.avg("hi")).alias("all_wrong"), F.avg("hi").alias("oracle"), F.count("*").alias("n"))
    single = hits.groupBy("cond").agg(F.avg("hit").alias("a")).agg(F.max("a").alias("best_single"))
    return shares.crossJoin(F.broadcast(single))  # one row each


def pairwise_agreement(hits: DataFrame) -> DataFrame:
    """Share of units on which two conditions agree, for each pair of conditions."""
    a = hits.select(F.col("cond").alias("a"), "item", "target", F.col("hit").alias("x"))
    b = hits.select(F.col("cond").alias("b"), "item", "target", F.col("hit").alias("y"))
    return a.join(b, ["item", "target"]).where("a < b").groupBy("a", "b").agg(F.avg((F.col("x") == F.col("y")).cast("int")).alias("agreement"), F.count("*").alias("n"))


def token_weighted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of nll over sum of tokens, and the perplexity."""
    got = rows.groupBy(*keys).agg(F.sum("nll").alias("nll"), F.sum("tokens").alias("tokens"))
    return got.withColumn("per_token", F.col("nll") / F.col("tokens")).withColumn("ppl", F.exp("per_token"))


def nll_deltas(rows: DataFrame, reference) -> DataFrame:
    """Token-weighted NLL less the reference's by book: mean, how many books are lower, and the perplexity ratio."""
    by = token_weighted(rows, ["cond", "book"])
    ref = by.where(F.col("cond") == reference).select("book", F.col("per_token").alias("ref"))
    d = F.col("per_token") - F.col("ref")
    return by.where(F.col("cond") != reference).join(ref, "book").groupBy("cond").agg(F.avg(d).alias("delta"), F.exp(F.avg(d)).alias("ppl_ratio"), F.sum((d < 0).cast("long")).alias("better"), F.count("*").alias("books"))


def gain(rows: DataFrame, reference) -> DataFrame:
    """B = mean of 100 (1 - exp(-d)) over examples, d the score gain over the reference of the same example, and book means."""
    ref = rows.where(F.col("cond") == reference).select("book", "example", F.col("score").alias("ref"))
    d = F.col("score") - F.col("ref")
    each = rows.where(F.col("cond") != reference).join(ref, ["book", "example"]).select("cond", "book", d.alias("d"), (100 * (1 - F.exp(-d))).alias("b"))
    books = each.groupBy("cond", "book").agg(F.avg("d").alias("bd"), F.sum("d").alias("sd"), F.sum("b").alias("sb"), F.count("*").alias("n"))
    return books.groupBy("cond").agg((F.sum("sb") / F.sum("n")).alias("b"), (F.sum("sd") / F.sum("n")).alias("delta"), F.avg("bd").alias("book_mean"), F.sum((F.col("bd") > 0).cast("long")).alias("better"), F.count("*").alias("books"))


def drift(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The largest spread of a value that should be the same in each run."""
    return rows.groupBy(*keys).agg((F.max(value) - F.min(value)).alias("d"), F.count("*").alias("n")).where("n > 1").agg(F.max("d").alias("worst"), F.count("*").alias("keys"))


def pareto(rows: DataFrame, group: str, x: str, y: str, name: str) -> DataFrame:
    """Rows whose y is over that of all rows before them, by (x, y descending, name)."""
    w = Window.partitionBy(group).orderBy(F.col(x), F.col(y).desc(), F.col(name)).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_top", F.max(y).over(w)).where(F.col("_top").isNull() | (F.col(y) > F.col("_top"))).drop("_top")


def skyline(rows: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Rows that no row of their group dominates (x no larger and y no smaller, one of them strictly).

    Per x the largest y, then a running maximum over smaller x: no self join.
    """
    best = rows.groupBy(group, x).agg(F.max(y).alias("_own"))
    w = Window.partitionBy(group).orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    best = best.withColumn("_before", F.max("_own").over(w))
    return rows.join(best, [group, x]).where((F.col(y) == F.col("_own")) & (F.col("_before").isNull() | (F.col(y) > F.col("_before")))).drop("_own", "_before")


def bootstrap(rows: DataFrame, keys: list[str], value: str, draws: int = 2000, seed: int = 0) -> DataFrame:
    """Mean and 95 % interval of resampled means by keys; values are sorted first, so the result depends on no row order.

    Groups are few values (books), so one group is one task's list.
    """
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        import random

        rng, x = random.Random(seed), sorted(pdf[value].tolist())
        means = sorted(sum(rng.choices(x, k=len(x))) / len(x) for _ in range(draws))
        head = pdf[keys].iloc[[0]].reset_index(drop=True)
        return head.assign(mean=sum(x) / len(x), low=means[int(0.025 * draws)], high=means[int(0.975 * draws) - 1 if draws < 40 else int(0.975 * draws)], n=len(x))

    kinds = dict(rows.dtypes)
    return rows.select(*keys, value).where(F.col(value).isNotNull()).groupBy(*keys).applyInPandas(one, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", mean double, low double, high double, n long")


def hash_bootstrap(rows: DataFrame, key: str, value: str, draws: int = 200) -> DataFrame:
    """A bootstrap that SQL can check: draw d takes, for place i of n, the value at (i * 7919 + d * 104729 + i * d) mod n."""
    w = Window.partitionBy(key)
    ranked = rows.select(key, value, (F.row_number().over(w.orderBy(value)) - 1).alias("i"), F.count("*").over(w).alias("n"))
    d = ranked.select(key, "n", "i", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("d"))
    picks = d.select(key, "d", ((F.col("i") * 7919 + F.col("d") * 104729 + F.col("i") * F.col("d")) % F.col("n")).alias("i"))
    means = picks.join(ranked.select(key, "i", value), [key, "i"]).groupBy(key, "d").agg(F.avg(value).alias("m"))
    return quantiles(means, [key], "m", (0.025, 0.5, 0.975))


def gram_overlap(words_a: Column, words_b: Column, n: int) -> Column:
    """Distinct n-grams of a that b has too, over the larger of 1 and b's distinct n-grams."""
    return F.size(F.array_intersect(grams(words_a, n), grams(words_b, n))) / F.greatest(F.lit(1), F.size(grams(words_b, n)))


def grams(words: Column, n: int) -> Column:
    """Distinct word n-grams of an array of words."""
    def runs(w: Column) -> Column:
        last = F.size(w) - (n - 1)
        at = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(w, i, n), " ")))

    return bound(words, runs)


def gram_hashes(words: Column, n: int) -> Column:
    """64-bit hashes of the distinct word n-grams of an array of words."""
    def runs(h: Column) -> Column:
        last = F.size(h) - (n - 1)
        at = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.slice(h, i, n))))

    return bound(F.transform(words, lambda w: F.xxhash64(w)), runs)


def longest_common_run(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Length of the longest run of words that two word arrays share: equal words meet in an equi-join, and runs are
    islands on the diagonals (a place less b place)."""
    left = pairs.select(*keys, F.posexplode(a).alias("_i", "_w"))
    right = pairs.select(*keys, F.posexplode(b).alias("_j", "_w"))
    hits = left.join(right, [*keys, "_w"]).select(*keys, (F.col("_i") - F.col("_j")).alias("_d"), "_i")
    w = Window.partitionBy(*keys, "_d").orderBy("_i")
    runs = hits.withColumn("_island", F.col("_i") - F.row_number().over(w)).groupBy(*keys, "_d", "_island").agg(F.count("*").alias("_run"))
    return runs.groupBy(*keys).agg(F.max("_run").alias("longest"))
