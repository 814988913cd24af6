"""Representation algebra: point-in-time views of per-chapter texts.

Texts have `book`, `label`, `chapter_index`, `text`; a view at boundary b sees chapters under b only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cut_words, strip, word_count


def as_of(rows: DataFrame, boundaries: DataFrame, keys: list[str], low: int | None = None, skip: int = 0) -> DataFrame:
    """rows joined to boundaries(keys..., boundary) with boundary - low <= chapter_index < boundary - skip (no low: from the start)."""
    if low is None:
        return rows.join(boundaries, keys).where(F.col("chapter_index") < F.col("boundary") - skip)
    # A bounded band is an equi-join on each of its few chapters.
    band = boundaries.withColumn("chapter_index", F.explode(F.sequence(F.col("boundary") - low, F.col("boundary") - skip - 1)))
    return rows.join(band, [*keys, "chapter_index"])


def running_words(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Words of all chapters before each chapter: an as-of sum as a running window, without a range join."""
    w = Window.partitionBy(*keys).orderBy("chapter_index").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("words", word_count(F.col("text"))).withColumn("words_before", F.coalesce(F.sum("words").over(w), F.lit(0)))


def complete(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, boundary) for which every chapter 0 .. boundary - 1 is there: boundaries up to the first gap."""
    w = Window.partitionBy(*keys).orderBy("chapter_index")
    chapters = rows.select(*keys, "chapter_index").distinct().withColumn("nth", F.row_number().over(w))
    return chapters.where(F.col("nth") == F.col("chapter_index") + 1).select(*keys, F.col("nth").alias("boundary"))


def recency_budget(rows: DataFrame, keys: list[str], order: list[str], k: int, words: str = "words") -> DataFrame:
    """The newest rows until k words, stopping at the first that overflows."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_sum", F.sum(words).over(w)).where(F.col("_sum") <= k).drop("_sum")


def chapter_budget(rows: DataFrame, keys: list[str], k: int, words: str = "words") -> DataFrame:
    """Rows of the newest chapters until k words; the newest chapter always stays."""
    per = rows.groupBy(*keys, "chapter_index").agg(F.sum(words).alias("_w"))
    w = Window.partitionBy(*keys).orderBy(F.col("chapter_index").desc())
    kept = per.withColumns({"_sum": F.sum("_w").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_rn": F.row_number().over(w)}).where((F.col("_sum") <= k) | (F.col("_rn") == 1))
    return rows.join(kept.select(*keys, "chapter_index"), [*keys, "chapter_index"], "left_semi")


def round_robin(rows: DataFrame, keys: list[str], section: str, order: str, k: int | None) -> DataFrame:
    """k rows of each key, taken in turn from its sections (all rows without k), with their place `turn`."""
    first = F.row_number().over(Window.partitionBy(*keys, section).orderBy(order))
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy("_first", section))
    out = rows.withColumn("_first", first).withColumn("turn", turn).drop("_first")
    return out if k is None else out.where(F.col("turn") <= k)


def latest_fill(rows: DataFrame, boundaries: DataFrame, keys: list[str], n: int, text: str = "text", default: str = "Not in this chapter.") -> DataFrame:
    """The last n chapters before each boundary, with a default where a chapter has no text."""
    wanted = boundaries.where("boundary > 0").withColumn("chapter_index", F.explode(F.sequence(F.greatest(F.col("boundary") - n, F.lit(0)), F.col("boundary") - 1)))
    have = rows.groupBy(*keys, "chapter_index").agg(F.min(text).alias(text))
    return wanted.join(have, [*keys, "chapter_index"], "left").withColumn(text, F.coalesce(text, F.lit(default)))


def latest(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The value at the largest order of each key."""
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def first_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the first in order."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last in order."""
    return first_wins(rows, keys, [F.col(c).desc() for c in order])


def matched_cut(rows: DataFrame, partner: DataFrame, keys: list[str]) -> DataFrame:
    """Each text cut to the words of its partner text."""
    other = partner.select(*keys, word_count(F.col("text")).alias("_k"))
    w = F.filter(F.split("text", r"(?U)\s+"), lambda x: x != "")
    cut = F.when(F.size(w) > F.col("_k"), F.array_join(F.slice(w, F.lit(1), F.col("_k")), " ")).otherwise(F.col("text"))
    return rows.join(other, keys).withColumn("text", cut).drop("_k")


def ordered_text(rows: DataFrame, keys: list[str], order: list[str], text: str, sep: str) -> DataFrame:
    """Texts of each key joined in order."""
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["_t"]), sep).alias(text))


def render_sections(rows: DataFrame, keys: list[str], sections: list[str], default: str = "- No information.") -> DataFrame:
    """Rows(section, text, pos) as '### section' lists in a fixed order of sections, each with its rows in order of pos."""
    by = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "section", "text"))).alias("r"))

    def part(s: str) -> Column:
        lines = F.transform(F.filter("r", lambda x: x["section"] == s), lambda x: F.concat(F.lit("- "), x["text"]))
        return F.concat(F.lit(f"### {s}\n"), F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(default))

    return by.select(*keys, F.array_join(F.array(*[part(s) for s in sections]), "\n\n").alias("text"))


def render_archive(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Rows(head_no, head, chapter, text) as an archive sheet; heads stay if they are sections or have blocks."""
    block = F.concat(F.lit("<snippet "), F.col("chapter").cast("string"), F.lit(">\n"), strip(F.col("text")))
    body = F.array_sort(F.collect_list(F.when(strip(F.col("text")) != "", F.struct("chapter", block.alias("t")))))
    heads = blocks.groupBy(*keys, "head_no", "head").agg(body.alias("b")).where((F.size("b") > 0) | F.col("head").startswith("## "))
    heads = heads.withColumn("p", F.concat(F.col("head"), F.when(F.size("b") > 0, F.concat(F.lit("\n\n"), F.array_join(F.col("b.t"), "\n"))).otherwise("")))
    return ordered_text(heads.select(*keys, "head_no", F.col("p").alias("text")), keys, ["head_no"], "text", "\n\n")


def archive_layout(notes: DataFrame, boundaries: DataFrame, keys: list[str], layout: list[tuple[str, list[tuple[str, str]]]]) -> DataFrame:
    """Every chapter under every question, whether it has a note or not; sections are parted by a rule.

    notes(keys, chapter_index, q, text); layout lists (section, [(q, question)]).
    """
    spark = notes.sparkSession
    rows = [(i, s, j, q, text) for i, (s, qs) in enumerate(layout) for j, (q, text) in enumerate(qs)]
    questions = F.broadcast(spark.createDataFrame(rows, "s_no int, section string, q_no int, q string, question string"))  # a fixed list
    grid = boundaries.where("boundary > 0").withColumn("chapter_index", F.explode(F.sequence(F.lit(0), F.col("boundary") - 1))).crossJoin(questions)
    line = F.concat(F.lit("<snippet "), F.col("chapter_index").cast("string"), F.lit(">\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    full = grid.join(notes, [*keys, "chapter_index", "q"], "left").withColumn("text", line)
    group = [*keys, "boundary"]
    by_q = ordered_text(full, [*group, "s_no", "section", "q_no", "question"], ["chapter_index"], "text", "")
    by_q = by_q.withColumn("text", F.concat(F.lit("Question: "), "question", F.lit("\n\n"), "text"))
    by_s = ordered_text(by_q, [*group, "s_no", "section"], ["q_no"], "text", "\n").withColumn("text", F.concat(F.lit("## "), "section", F.lit("\n\n"), "text"))
    return ordered_text(by_s, group, ["s_no"], "text", "-" * 100 + "\n").withColumn("text", strip(F.col("text")))


def combine(reps: DataFrame, conds: list[str], name: str, keys: list[str]) -> DataFrame:
    """Texts of several conditions joined in order, where all of them exist."""
    wide = reps.where(F.col("condition").isin(conds)).groupBy(*keys).agg(*[F.max(F.when(F.col("condition") == c, F.col("text"))).alias(f"_{i}") for i, c in enumerate(conds)])
    every = [F.col(f"_{i}") for i in range(len(conds))]
    return wide.where(" and ".join(f"_{i} is not null" for i in range(len(conds)))).select(F.lit(name).alias("condition"), *keys, F.concat_ws("\n\n", *every).alias("text"))


def greedy_distinct(rows: DataFrame, keys: list[str], order: str, vector: str, threshold: float = 0.9) -> DataFrame:
    """Rows of each key that no kept earlier row resembles, in order; vector is a map<term, weight> of length 1.

    Similar pairs come from `similar.pairs`; the fold over a key's pairs then asks for kept earlier ones only, so a dropped row
    drops no other. A key is one label's statements in one category.
    """
    from . import similar

    near = similar.pairs(similar.map_vectors(rows, keys, order, vector, threshold), keys, order, threshold)
    return rows.where(F.size(vector) > 0).join(similar.later_ones(near, keys, order), [*keys, order], "left_anti")


def similar_pairs(rows: DataFrame, keys: list[str], order: str, vector: str, threshold: float = 0.9) -> DataFrame:
    """(keys, x, y, cosine): all pairs x < y of a key with a cosine of at least the threshold; vector is a map<term, weight> of length 1."""
    from . import similar

    return similar.pairs(similar.map_vectors(rows, keys, order, vector, threshold), keys, order, threshold)


def tfidf(rows: DataFrame, corpus: list[str], doc: list[str], text: str, pattern: str = r"(?U)\b\w\w+\b") -> DataFrame:
    """(corpus, doc, v): map<term, weight> of length 1 with smooth idf ln((1 + n) / (1 + df)) + 1, one idf per corpus."""
    tokens = rows.select(*corpus, *doc, F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(pattern), 0)).alias("term"))
    tf = tokens.groupBy(*corpus, *doc, "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy(*corpus, "term").agg(F.count("*").alias("df"))
    n = rows.select(*corpus, *doc).distinct().groupBy(*corpus).agg(F.count("*").alias("n"))
    w = tf.join(df, [*corpus, "term"])
    w = w.join(n, corpus) if corpus else w.crossJoin(F.broadcast(n))  # one row
    w = w.withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = w.groupBy(*corpus, *doc).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, [*corpus, *doc]).groupBy(*corpus, *doc).agg(F.map_from_entries(F.collect_list(F.struct("term", (F.col("w") / F.col("norm")).alias("w")))).alias("v"))


def cosine(a: Column, b: Column) -> Column:
    """Inner product of two map<term, weight> columns."""
    return F.aggregate(F.map_keys(a), F.lit(0.0), lambda acc, k: acc + F.element_at(a, k) * F.coalesce(F.try_element_at(b, k), F.lit(0.0)))


def window_of(reps: DataFrame, k: int, last: bool = False) -> DataFrame:
    """Texts cut to k words, their condition renamed `<condition>@<k>`."""
    return reps.withColumn("text", cut_words(F.col("text"), k, last)).withColumn("condition", F.concat("condition", F.lit(f"@{'last' if last else ''}{k}")))


def present_only(rows: DataFrame, presence: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of chapters in which the label is present."""
    return rows.join(presence.select(*keys, "chapter_index").distinct(), [*keys, "chapter_index"], "left_semi")


def mentioning(rows: DataFrame, aliases: DataFrame, key: str, other: bool = True) -> DataFrame:
    """Rows(key, book, label, text) that name another label of the book (or, without `other`, name none)."""
    from .items import mentions

    named = mentions(rows, aliases, key).where("label <> alias_label").select(key).distinct()
    return rows.join(named, key, "left_semi" if other else "left_anti")
