"""Accuracy of score rows: argmax, one-to-one assignment, macro means, paired differences, category products.

Score rows have `cond`, `book`, `item`, `target` (0..n-1 within an item's order), `lp` (log-probabilities by id) and
`answer`. Rates are kept as integer hits and counts until one last division, so that strict comparisons don't hang on float noise.
"""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW = -1e9  # stands for a log-probability that was not among the returned ones


def finite(lp: Column) -> Column:
    """Log-probabilities with -inf, NaN and null replaced by LOW, so that sums and maxima stay ordered."""
    return F.transform(lp, lambda x: F.when(x.isNull() | F.isnan(x) | (x < LOW), F.lit(LOW)).otherwise(x))


def argmax_id(lp: Column) -> Column:
    """The first id with the largest log-probability."""
    return (F.array_position(finite(lp), F.array_max(finite(lp))) - 1).cast("int")


def argmax_hits(rows: DataFrame, invalid: Column | None = None) -> DataFrame:
    """rows with `hit` 1 or 0; invalid rows score 0."""
    hit = (argmax_id(F.col("lp")) == F.col("answer")).cast("int")
    return rows.withColumn("hit", hit if invalid is None else F.when(F.coalesce(invalid, F.lit(False)), 0).otherwise(hit))


def best_assignment(lps: Column, n: int) -> Column:
    """The permutation of ids with the largest summed log-probability; ties go to the lexicographically first.

    lps: array<array<double>> in target order. All n! permutations are a literal, so nothing leaves the JVM.
    """
    perms = F.array(*[F.array(*[F.lit(i) for i in p]) for p in permutations(range(n))])

    def total(p: Column) -> Column:
        out = F.element_at(F.element_at(lps, 1), F.element_at(p, 1) + 1)
        for t in range(2, n + 1):
            out = out + F.element_at(F.element_at(lps, t), F.element_at(p, t) + 1)
        return out

    scored = F.transform(perms, lambda p: F.struct((-total(p)).alias("minus"), p.alias("perm")))
    return F.array_min(scored)["perm"]


def joint_hits(rows: DataFrame, keys: list[str], n: int = 3, invalid: Column | None = None) -> DataFrame:
    """A row per (keys, target) of complete groups with `hit` under the best one-to-one assignment.

    Groups without all n targets are left out; a group with an invalid row scores 0 throughout.
    """
    bad = F.lit(False) if invalid is None else F.coalesce(invalid, F.lit(False))
    parts = F.array_sort(F.collect_list(F.struct("target", finite(F.col("lp")).alias("lp"), "answer")))
    groups = rows.withColumn("_bad", bad).groupBy(*keys).agg(parts.alias("g"), F.bool_or("_bad").alias("bad")).where(F.size("g") == n)
    best = groups.withColumn("best", best_assignment(F.col("g.lp"), n))
    hits = F.transform(F.col("g"), lambda x, i: F.struct(x["target"].alias("target"), x["answer"].alias("answer"), F.when(F.col("bad"), 0).otherwise((F.get("best", i) == x["answer"]).cast("int")).alias("hit")))
    return best.select(*keys, F.explode(hits).alias("x")).select(*keys, "x.target", "x.answer", "x.hit")


def accuracy(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Hits, counts and their ratio by keys."""
    return hits.groupBy(*keys).agg(F.sum("hit").cast("long").alias("ok"), F.count("*").alias("n")).withColumn("acc", F.col("ok") / F.col("n"))


def all_and_by_book(hits: DataFrame) -> DataFrame:
    """Accuracy of each condition over all books and by book, in one pass; the total's book is 'all'."""
    both = hits.select("cond", F.explode(F.array(F.lit("all"), F.col("book").cast("string"))).alias("book"), "hit")
    return accuracy(both, ["cond", "book"])


def macro(hits: DataFrame, least: int = 10, unit: str = "item") -> DataFrame:
    """Mean of per-book accuracies over books with at least `least` distinct units."""
    books = hits.groupBy("cond", "book").agg(F.sum("hit").alias("ok"), F.count("*").alias("n"), F.countDistinct(unit).alias("items")).where(F.col("items") >= least)
    return books.groupBy("cond").agg(F.avg(F.col("ok") / F.col("n")).alias("macro"), F.count("*").alias("books"), F.sum("ok").cast("long").alias("ok"), F.sum("n").cast("long").alias("n"))


def paired(hits: DataFrame, reference, key: str = "book", least: int = 3) -> DataFrame:
    """Mean over common keys of a condition's accuracy less the reference's, how many are better, and how many there are."""
    by = hits.groupBy("cond", key).agg(F.sum("hit").cast("long").alias("ok"), F.count("*").alias("n"))
    ref = by.where(F.col("cond") == reference).select(F.col(key), F.col("ok").alias("ref_ok"), F.col("n").alias("ref_n"))
    both = by.where(F.col("cond") != reference).join(ref, key)
    better = (F.col("ok") * F.col("ref_n") > F.col("ref_ok") * F.col("n")).cast("long")
    out = both.groupBy("cond").agg(F.avg(F.col("ok") / F.col("n") - F.col("ref_ok") / F.col("ref_n")).alias("diff"), F.sum(better).alias("better"), F.count("*").alias("n"))
    return out.where(F.col("n") >= least)


def agreed(rows: DataFrame, conds: list) -> DataFrame:
    """Accuracy of every subset of conditions when their normalised log-probabilities are summed.

    Each condition's row is renormalised over its ids; a subset counts rows that all its conditions have.
    """
    lp = finite(F.col("lp"))
    z = F.log(F.aggregate(lp, F.lit(0.0), lambda a, x: a + F.exp(x)))
    normal = rows.where(F.col("cond").isin(conds)).withColumn("p", F.transform(lp, lambda x: x - z))
    wide = normal.groupBy("book", "item", "target", "answer").agg(*[F.max(F.when(F.col("cond") == c, F.col("p"))).alias(f"p{i}") for i, c in enumerate(conds)])
    subsets = [s for k in range(1, len(conds) + 1) for s in combinations(range(len(conds)), k)]

    def summed(s) -> Column:
        out = F.col(f"p{s[0]}")
        for i in s[1:]:
            out = F.zip_with(out, F.col(f"p{i}"), lambda a, b: a + b)
        return out

    parts = F.array(*[F.struct(F.lit("+".join(str(conds[i]) for i in s)).alias("subset"), summed(s).alias("lp")) for s in subsets])
    every = wide.select("answer", F.explode(parts).alias("x")).select("answer", "x.*").where("lp is not null")
    hits = every.withColumn("hit", (F.array_position("lp", F.array_max("lp")) - 1 == F.col("answer")).cast("int"))
    return accuracy(hits, ["subset"])


def mean_of_means(rows: DataFrame, groups: DataFrame, unit: list[str], group: list[str], value: str = "hit") -> DataFrame:
    """(group, accuracy, n): each unit's mean first, then the mean of the units of a group; groups(unit, group) leaves out units that it doesn't hold."""
    units = rows.groupBy(*unit).agg(F.avg(value).alias("_m"))
    return units.join(groups, unit).groupBy(*group).agg(F.avg("_m").alias("accuracy"), F.count("*").alias("n"))
