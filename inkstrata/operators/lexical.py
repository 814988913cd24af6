"""Lexical baselines and selections: matching masks to texts, quoted sentences, example windows, coverage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound, drop_tags, mask_windows, words
from ..session import small_batches
from .scoring import joint_hits
from .similar import WORD


def match_masks(items: DataFrame, reps: DataFrame, n: int = 3, near: int = 30) -> DataFrame:
    """Hits of the best assignment of masks to labels by cosine of the words around a mask and a label's text.

    items(item, masked, labels in target order, answer array<int>), reps(item, label, text). Weights come from each item's own texts.
    """
    found = reps.groupBy("item").agg(F.collect_list(F.struct("label", "text")).alias("_reps"))
    of = lambda label: F.transform(F.filter("_reps", lambda r: r["label"] == label), lambda r: r["text"])
    empty = F.array().cast("array<array<string>>")
    return match_rows(items.join(found, "item", "left").select("item", "masked", "labels", "answer", F.coalesce(F.transform("labels", of), empty).alias("texts")), n, near)


def match_rows(items: DataFrame, n: int = 3, near: int = 30) -> DataFrame:
    """match_masks of items(item, masked, labels, answer, texts array<array<string>>: the texts of each label): all that an item needs is in its row."""
    small_batches(items.sparkSession)
    hashed = lambda text: F.coalesce(F.transform(F.regexp_extract_all(F.lower(text), F.lit(WORD), 0), lambda w: F.xxhash64(w)), F.array().cast("array<bigint>"))
    doc = lambda mask, key, words: F.struct(mask.alias("mask"), key.cast("int").alias("key"), words.alias("words"))

    def masks(marks: Column) -> Column:
        around = lambda i: F.array_join(F.array_sort(F.transform(F.filter(marks, lambda m: m["id"] == i), lambda m: m["context"])), " ")
        return F.transform(F.array_distinct(F.transform(marks, lambda m: m["id"])), lambda i: doc(F.lit(True), i, hashed(around(i))))

    texts = F.filter(F.transform("texts", lambda t, i: doc(F.lit(False), F.when(F.size(t) > 0, i), F.flatten(F.transform(t, lambda x: hashed(drop_tags(x)))))), lambda d: d["key"].isNotNull())
    own = F.coalesce(bound(mask_windows(F.col("masked"), near), masks), F.array().cast("array<struct<mask: boolean, key: int, words: array<bigint>>>"))
    rows = items.select("item", "answer", F.size("labels").alias("_k"), F.concat(own, texts).alias("_docs"))
    met = rows.mapInArrow(_similarities(n), f"item {dict(items.dtypes)['item']}, answer {dict(items.dtypes)['answer']}, lps array<array<double>>")
    return joint_hits(met.select("item", "answer", F.posexplode("lps").alias("target", "lp")).select("item", "target", "lp", F.get("answer", F.col("target")).alias("answer")), ["item"], n)


def _similarities(n: int):
    """(item, answer, lps): for each of an item's _k labels its text's cosine with the masks 0 to n - 1, by weights from the item's own
    _docs(mask, key, words) alone. A text or mask without terms has no vector: its similarities are 0, and its item stays."""

    def one(k: int, mask: np.ndarray, key: np.ndarray, size: np.ndarray, words: np.ndarray) -> list[list[float]]:
        terms, t = np.unique(words, return_inverse=True)
        tf = np.bincount(np.repeat(np.arange(len(size)), size) * len(terms) + t, minlength=len(size) * len(terms)).reshape(len(size), len(terms))
        w = tf * (np.log((1 + len(size)) / (1 + (tf > 0).sum(0))) + 1)
        w = w / np.maximum(np.sqrt((w * w).sum(1)), 1e-300)[:, None]
        out = [[0.0] * n for _ in range(k)]
        for x in np.flatnonzero(~mask):
            for y in np.flatnonzero(mask & (key < n)):
                out[key[x]][key[y]] = float((w[x] * w[y]).sum())
        return out

    def each(batches):
        for b in batches:
            docs = b.column("_docs")
            ends = np.concatenate(([0], np.cumsum(np.asarray(docs.value_lengths()).astype(np.int64))))
            flat = docs.flatten()
            mask, key = (np.asarray(pa.array(flat.field(c).to_pylist(), kind), dtype) for c, kind, dtype in (("mask", pa.bool_(), bool), ("key", pa.int32(), np.int64)))
            words = flat.field("words")
            size = np.asarray(words.value_lengths()).astype(np.int64)
            stops, words = np.concatenate(([0], np.cumsum(size))), np.asarray(words.flatten())
            lps = [one(k or 0, mask[i:j], key[i:j], size[i:j], words[stops[i] : stops[j]]) for k, i, j in zip(b.column("_k").to_pylist(), ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("item"), b.column("answer"), pa.array(lps, pa.list_(pa.list_(pa.float64())))], ["item", "answer", "lps"])

    return each


def quotes(sentences: DataFrame, keys: list[str], n: int = 2) -> DataFrame:
    """n sentences per key: those that name only the key's label before others, in order. sentences(keys, pos, text, named array)."""
    alone = (F.size("named") == 1).cast("int")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(alone.desc(), "pos"))
    return sentences.withColumn("rank", rank).where(F.col("rank") <= n)


def example_window(masked: Column, ids: Column, width: int = 70, step: int = 10) -> Column:
    """The first window of `width` words, `step` apart, that holds a mask of every id; else null."""

    def first(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(step))
        texts = F.transform(starts, lambda s: F.array_join(F.slice(w, s + 1, width), " "))
        return F.try_element_at(F.filter(texts, lambda t: F.forall(ids, lambda i: F.contains(t, F.concat(F.lit("[CHAR "), i.cast("string"), F.lit("]"))))), F.lit(1))

    return bound(words(masked), first)


def covering(rows: DataFrame, key: str, book: str = "book", share: float = 0.5) -> DataFrame:
    """Rows of keys that have at least a share of all books."""
    total = rows.agg(F.countDistinct(book).alias("_all"))
    enough = rows.groupBy(key).agg(F.countDistinct(book).alias("_n")).crossJoin(F.broadcast(total)).where(F.col("_n") >= share * F.col("_all")).select(key)  # one row
    return rows.join(enough, key, "left_semi")


def last_needed(boundaries: DataFrame) -> DataFrame:
    """The last chapter that any boundary of a book shows."""
    return boundaries.groupBy("book").agg((F.max("boundary") - 1).alias("last"))


def repaired(rows: DataFrame, column: str, fixes: dict[str, str]) -> DataFrame:
    """Labels by their present names."""
    pairs = [x for kv in fixes.items() for x in map(F.lit, kv)]
    return rows if not fixes else rows.withColumn(column, F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(column)), F.col(column)))


def non_digit_rate(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Share of rows whose top token is no id."""
    odd = ~F.array_contains(F.map_keys("logprobs"), F.trim("top_token"))
    return rows.groupBy(*keys).agg(F.avg(odd.cast("int")).alias("rate"), F.count("*").alias("n"))


def perplexity(rows: DataFrame, keys: list[str]) -> DataFrame:
    """exp of minus the mean log-probability."""
    return rows.groupBy(*keys).agg(F.exp(-F.avg("score")).alias("ppl"), F.count("*").alias("n"))
