"""Names over time: display names, narrators, gender, presence, distinctive names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import unicode as u

# Genders of labels whose sheets have too few pronouns.
GENDER_OVERRIDES = {("first_lie", "Mr. Smith"): "M", ("ugly", "Kitty Goldman"): "F"}


def first_seen(chapters: DataFrame) -> DataFrame:
    """(book, word, first): the first chapter of each word without its accents. Seen through c is first <= c, before b is first < b."""
    words = chapters.select("book", "chapter_index", F.explode(t.text_tokens(u.fold(F.col("text")))).alias("word"))
    return words.groupBy("book", "word").agg(F.min("chapter_index").alias("first"))


def display_names(labels: DataFrame, seen: DataFrame, positions: DataFrame, through: bool = True) -> DataFrame:
    """(book, label, pos, name): the label as far as its name words are known at each position.

    labels(book, label), seen from first_seen, positions(book, pos). Only words of labels are looked up.
    """
    parts = labels.select("book", "label", F.explode(t.text_tokens(u.fold(F.col("label")))).alias("word")).join(seen, ["book", "word"])
    known = F.col("first") <= F.col("pos") if through else F.col("first") < F.col("pos")
    grid = labels.join(positions, "book")
    words = grid.join(parts, ["book", "label"], "left").groupBy("book", "label", "pos").agg(F.collect_set(F.when(known, F.col("word"))).alias("seen"))
    return words.select("book", "label", "pos", u.display_name(F.col("label"), F.col("seen")).alias("name"))


def majority(rows: DataFrame, key: str, value: str, order: str, share: float = 0.8) -> DataFrame:
    """(key, value) of the most frequent value where it has at least `share` of the non-null ones; ties go to the first seen."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = counts.groupBy(key).agg(F.sum("n").alias("all"), F.max(F.struct("n", (-F.col("first")).alias("f"), F.col(value).alias("v"))).alias("x"))
    return best.where(F.col("x.n") >= share * F.col("all")).select(key, F.col("x.v").alias(value), F.col("x.n").alias("n"), "all")


def narrators(rows: DataFrame) -> DataFrame:
    """rows(book, chapter_index, first_person, narrator) with unnamed first-person chapters given the book's narrator."""
    usual = majority(rows, "book", "narrator", "chapter_index").select("book", F.col("narrator").alias("_usual"))
    name = F.coalesce("narrator", F.when(F.col("first_person"), F.col("_usual")))
    return rows.join(usual, "book", "left").withColumn("narrator", name).drop("_usual")


def genders(texts: DataFrame, share: float = 0.65, overrides: dict | None = None) -> DataFrame:
    """(book, label, gender): M or F where over `share` of the pronouns are such, else '?'."""
    got = texts.groupBy("book", "label").agg(F.sum(F.regexp_count("text", F.lit(t.MALE))).alias("m"), F.sum(F.regexp_count("text", F.lit(t.FEMALE))).alias("f"))
    both = F.col("m") + F.col("f")
    gender = F.when(F.col("m") > share * both, "M").when(F.col("f") > share * both, "F").otherwise("?")
    for (book, label), g in (GENDER_OVERRIDES if overrides is None else overrides).items():
        gender = F.when((F.col("book") == book) & (F.col("label") == label), g).otherwise(gender)
    return got.withColumn("gender", gender)


def gender_groups(items: DataFrame, known: DataFrame) -> DataFrame:
    """(item, label, group): whether a label's gender is unique among its item's labels, shared, or all the same; items with '?' are left out."""
    g = items.join(known.select("book", "label", "gender"), ["book", "label"])
    same, every = Window.partitionBy("item", "gender"), Window.partitionBy("item")
    g = g.withColumns({"k": F.count("*").over(same), "n": F.count("*").over(every), "odd": F.max((F.col("gender") == "?").cast("int")).over(every)})
    return g.where("odd = 0").select("item", "label", "gender", F.when(F.col("k") == F.col("n"), "all same").when(F.col("k") == 1, "unique").otherwise("shared").alias("group"))


def absent_share(notes: DataFrame, presence: DataFrame, keys: list[str]) -> DataFrame:
    """Share of notes and of their words that are about chapters where the label isn't present."""
    there = presence.select(*keys, "chapter_index").distinct().withColumn("_there", F.lit(1))
    w = t.word_count(F.col("text"))
    away = F.col("_there").isNull()
    got = notes.join(there, [*keys, "chapter_index"], "left").groupBy(*keys).agg(F.count("*").alias("notes"), F.sum(w).alias("words"), F.sum(away.cast("long")).alias("absent"), F.sum(F.when(away, w).otherwise(0)).alias("absent_words"))
    return got.withColumns({"note_share": F.col("absent") / F.col("notes"), "word_share": F.try_divide("absent_words", "words")})


def distinctive(counts: DataFrame, group: str, label: str, term: str, n: int = 40, least: int = 2) -> DataFrame:
    """The n terms of each label with the best m^2 / (m + mean of the other labels' counts), for counts `m` of at least `least`."""
    labels = counts.groupBy(group).agg(F.countDistinct(label).alias("k"))
    total = F.sum("m").over(Window.partitionBy(group, term))
    rows = counts.withColumn("total", total).join(labels, group).where(F.col("m") >= least)
    others = (F.col("total") - F.col("m")) / F.greatest(F.col("k") - 1, F.lit(1))
    rows = rows.withColumn("score", F.col("m") * F.col("m") / (F.col("m") + others))
    rank = F.row_number().over(Window.partitionBy(group, label).orderBy(F.desc("score"), term))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n).select(group, label, term, "m", "score", "rank")


def entity_counts(found: DataFrame) -> DataFrame:
    """Counts, first chapter and distinct chapters of recognised names(book, name, kind, chapter_index)."""
    return found.groupBy("book", "name", "kind").agg(F.count("*").alias("n"), F.min("chapter_index").alias("first"), F.countDistinct("chapter_index").alias("chapters"))
