"""Reasoning traces: how much of one comes from notes or from the passage, and what that has to do with being right.

A gram is N consecutive words of a-z and apostrophes, as a 64-bit hash; sets of grams are arrays in a row, so that a trace meets its notes by key,
and no gram is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound
from .reps import last_wins

N = 4


def gram_set(text: Column, n: int = N) -> Column:
    """array<bigint>: hashes of the distinct n-grams of a text; a null text has none."""

    def grams(words: Column) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(words, i, n), " "))))

    # Bound, or the words would be found anew for each gram.
    return bound(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z']+"), F.lit(0)), grams)


def shares(traces: DataFrame, notes: DataFrame, items: DataFrame, key: list[str]) -> DataFrame:
    """traces(key, item, trace, ...) with notes_share and passage_share: the parts of a trace's grams that are in its notes and in its item's passage.

    notes(key, item, text) may have several rows for a trace's key and item, one for each label; items(item, masked) are the passages. A trace without
    grams is left out; one without notes has a share of 0.
    """
    grams = traces.withColumn("_g", gram_set(F.col("trace"))).where(F.size("_g") > 0)
    known = notes.select(*key, "item", gram_set(F.col("text")).alias("_n")).groupBy(*key, "item").agg(F.array_distinct(F.flatten(F.collect_list("_n"))).alias("_n"))
    passages = items.select("item", gram_set(F.col("masked")).alias("_p"))
    rows = grams.join(known, [*key, "item"], "left").join(passages, "item", "left")
    part = lambda c: F.coalesce(F.size(F.array_intersect("_g", c)), F.lit(0)) / F.size("_g")
    return rows.withColumns({"notes_share": part("_n"), "passage_share": part("_p")}).drop("_g", "_n", "_p")


def split(rows: DataFrame, cond: str = "cond") -> DataFrame:
    """For each condition of shares' rows(correct, trace, notes_share, passage_share): traces, accuracy, medians of words and shares, and the
    accuracy at or above the median share of notes and below it (null where there are no such traces)."""
    words = F.regexp_count("trace", F.lit(r"(?U)\S+")).cast("double")
    middle = rows.groupBy(cond).agg(F.percentile("notes_share", 0.5).alias("median_notes"))
    high = F.col("notes_share") >= F.col("median_notes")
    return rows.join(middle, cond).groupBy(cond).agg(
        F.count("*").alias("traces"), F.avg("correct").alias("accuracy"), F.percentile(words, 0.5).alias("median_words"), F.first("median_notes").alias("median_notes"),
        F.percentile("passage_share", 0.5).alias("median_passage"), F.avg(F.when(high, F.col("correct"))).alias("accuracy_above"), F.avg(F.when(~high, F.col("correct"))).alias("accuracy_below"))


def effort(rows: DataFrame, keys: list[str], unit: list[str], order: list[str], value: str, least: int = 50) -> DataFrame:
    """(keys, median, generations): the median of a value by keys, where each unit counts with its last row, of keys with at least `least` units."""
    last = last_wins(rows, [*keys, *unit], order)
    got = last.groupBy(*keys).agg(F.percentile(F.col(value).cast("double"), 0.5).alias("median"), F.count("*").alias("generations"))
    return got.where(F.col("generations") >= least)


def oldest_out(rows: DataFrame, keys: list[str], order: list[str], text: str, most: int) -> DataFrame:
    """The newest rows of each key whose texts, each with a line break, are no longer than `most` characters together."""
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_sum", F.sum(F.length(text) + 1).over(newest)).where(F.col("_sum") <= most).drop("_sum")


# Fixed value: ids that a hand-written text must not hold.
GIVEN_AWAY = r"\[?CHAR\s*\d|\bID\s*\d|\bid\s*\d"


def hand_written(text: Column) -> Column:
    """whether a hand-written text can be used: not blank, and without mask ids."""
    return F.coalesce(~F.regexp_like(text, F.lit(GIVEN_AWAY)) & F.regexp_like(text, F.lit(r"(?U)\S")), F.lit(False))
