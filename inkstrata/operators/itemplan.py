"""Identification items as one plan: units, mentions, the cascade of rules, masks, and the counters.

Examples have `book`, `chapter_index`, `chunk_index`, `text`, `header`. Alias rows have `book`, `kind` (principal, ambiguous or
protected), `label` and `label_no` (null for the other kinds) and `alias`. Chapters have `book`, `chapter_index`, `text`; a chapter may have several rows.

All names of a book are one automaton (functions.matcher). It reads each unit once; counts, rules and masks are expressions over what it
found, and only units that are still in the running are read again, masked. A book's names are one row, written before its units meet
it: Spark broadcasts these rows where their size allows it and joins by book where it doesn't.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import matcher
from ..functions.text import SENTENCE_END, item_id, strip, strip_heading
from ..functions.unicode import clean_text, nfc, shuffled_ids
from ..session import small_batches
from ..sources.files import kept
from .items import MIN_PRIOR, tightest_spans, windows

# Capitalised words of aliases that identify nobody; how units of the other two modes are cut.
NO_NAMES = ["The", "Miss", "Mrs", "Ms.", "Mr.", "Mrs.", "Pan", "Pani", "Panie"]
WINDOW_WORDS, WINDOW_SECTIONS = 900, 3
SHORT_WORDS = (20, 150)
# End of fixed values.
NAME_WORD = r"(?U)[^\W\d_][\w’'-]*"
AMBIGUOUS, PROTECTED = -1, -2
#: In the order in which they are asked.
REASONS = ("no_text", "protected", "not_all_named", "too_early", "ambiguous", "leftover")


def books(aliases: DataFrame) -> DataFrame:
    """(book, labels, forms, names, key): a book's labels in order, its forms by group, and the name words that must not be left.

    A form is an alias or its capitals. A principal's group is its label's place; labels without label_no are in order of name.
    """
    alias = nfc(F.col("alias"))
    rows = aliases.where("alias <> ''").select("book", "kind", F.col("label_no").cast("int").alias("no"), "label", alias.alias("alias"))
    order = F.struct(F.coalesce("no", F.lit(2**31 - 1)).alias("no"), "label")
    principal = F.col("kind") == "principal"
    word = F.filter(F.regexp_extract_all("alias", F.lit(NAME_WORD), F.lit(0)), lambda w: (F.length(w) >= 3) & F.regexp_like(w, F.lit(r"^\p{Lu}")) & ~F.array_contains(F.array(*map(F.lit, NO_NAMES)), w))
    by = rows.groupBy("book").agg(
        F.array_sort(F.collect_set(F.when(principal, order))).alias("ordered"),
        F.array_sort(F.collect_set(F.struct("kind", F.when(principal, order).alias("o"), "alias"))).alias("all"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(principal, word))))).alias("words"))
    place = lambda a: F.when(a["kind"] == "principal", F.array_position("ordered", a["o"]).cast("int") - 1).when(a["kind"] == "protected", PROTECTED).otherwise(AMBIGUOUS)
    forms = F.flatten(F.transform("all", lambda a: F.transform(F.array_distinct(F.array(a["alias"], F.upper(a["alias"]))), lambda f: F.struct(place(a).alias("group"), f.alias("form")))))
    out = by.select("book", F.transform("ordered", lambda o: o["label"]).alias("labels"), forms.alias("forms"), F.transform("words", lambda w: F.struct(F.lit(0).alias("group"), w.alias("form"))).alias("names"))
    return out.withColumn("key", F.md5(F.to_json(F.struct("forms", "names"))))


def sections(examples: DataFrame) -> DataFrame:
    """F1's texts: examples without headings and markup, composed; null where nothing but a header was there."""
    text = strip(clean_text(strip_heading(F.col("text"), F.col("header"))))
    return examples.select("book", "chapter_index", "chunk_index", text.alias("text"))


def short_spans(text: Column, key: Column, forms: Column, labels: Column) -> Column:
    """array<string>: the tightest runs of whole sentences that name every label."""
    splitter = re.compile(SENTENCE_END)
    least, most = SHORT_WORDS

    @F.arrow_udf("array<string>")
    def spans(text: pa.Array, key: pa.Array, forms: pa.Array, n: pa.Array) -> pa.Array:
        out = []
        for i, (t, k, count) in enumerate(zip(text.to_pylist(), key.to_pylist(), n.to_pylist(), strict=True)):
            if t is None or k is None or not count:
                out.append([])
                continue
            found, sentences = matcher.matcher(k, forms[i]), [s for s in splitter.split(t) if s.strip()]
            named = [{g for g, _, _ in found.find(s) if g >= 0} for s in sentences]
            out.append(tightest_spans(sentences, named, set(range(count)), least, most))
        return pa.array(out, pa.list_(pa.string()))

    return spans(text, key, forms, F.size(labels))


def units(examples: DataFrame, known: DataFrame, mode: str = "section") -> DataFrame:
    """(book, chapter_index, unit, chunk_index, text, labels, forms, names, key) of one passage type.

    section: an example each. window: consecutive examples of a chapter until WINDOW_WORDS, at most WINDOW_SECTIONS. short: the tightest
    runs of sentences of a chapter that name every label.
    """
    rows = sections(examples)
    number = lambda letter, c: F.format_string(f"{letter}%02d", F.col(c))
    none = F.lit(None).cast("int").alias("chunk_index")
    if mode == "section":
        return rows.select("book", "chapter_index", number("k", "chunk_index").alias("unit"), F.col("chunk_index").cast("int").alias("chunk_index"), "text").join(known, "book")
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    if mode == "window":
        got = windows(rows, ["book", "chapter_index"], "chunk_index", WINDOW_WORDS, WINDOW_SECTIONS)
        return got.select("book", "chapter_index", number("w", "k").alias("unit"), none, "text").join(known, "book")
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "text")))
    whole = rows.groupBy("book", "chapter_index").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("whole")).join(known, "book")
    spans = whole.select("book", "chapter_index", "labels", "forms", "names", "key", F.posexplode(short_spans(F.col("whole"), F.col("key"), F.col("forms"), F.col("labels"))).alias("k", "text"))
    return spans.select("book", "chapter_index", number("t", "k").alias("unit"), none, "text", "labels", "forms", "names", "key")


def eligible_since(chapters: DataFrame, known: DataFrame, least: int = MIN_PRIOR) -> DataFrame:
    """(book, since map<group, chapter>): the least-th chapter that names each label; later boundaries have it in `least` earlier chapters."""
    text = clean_text(F.col("text"))
    hits = chapters.join(known.select("book", "forms", "key"), "book").select("book", "chapter_index", matcher.find(text, F.col("key"), F.col("forms")).alias("hits"))
    groups = F.array_distinct(F.transform(F.filter("hits", lambda h: h["group"] >= 0), lambda h: h["group"]))
    named = hits.select("book", "chapter_index", F.explode(groups).alias("group")).distinct()
    nth = F.row_number().over(Window.partitionBy("book", "group").orderBy("chapter_index"))
    since = named.withColumn("nth", nth).where(F.col("nth") == least)
    return since.groupBy("book").agg(F.map_from_entries(F.collect_list(F.struct("group", "chapter_index"))).alias("since"))


def hashed_ids(item: Column, labels: Column) -> Column:
    """map<label, id>: ids in order of a hash of item and label; SQL can say this one."""
    ranked = F.array_sort(F.transform(labels, lambda x: F.struct(F.md5(F.concat(item, F.lit(":"), x)).alias("h"), x.alias("x"))))
    return F.map_from_entries(F.transform(ranked, lambda r, i: F.struct(r["x"].alias("x"), i.alias("i"))))


def masked(text: Column, hits: Column, ids: Column) -> Column:
    """struct<at, out, used>: text with '[CHAR id]' for hits(group, start, end), and the groups of the masks. At one place the longest
    hit is taken; hits whose group isn't in ids (map<group, id>) stay."""
    spans = F.array_sort(F.transform(F.filter(hits, lambda h: F.map_contains_key(ids, h["group"])), lambda h: F.struct(h["start"].alias("start"), (-h["end"]).alias("back"), h["group"].alias("group"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.array().cast("array<int>").alias("used"))

    def add(acc: Column, s: Column) -> Column:
        mark = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("[CHAR "), F.element_at(ids, s["group"]).cast("string"), F.lit("]"))
        free = s["start"] >= acc["at"]
        return F.struct(F.when(free, -s["back"]).otherwise(acc["at"]).alias("at"), F.when(free, mark).otherwise(acc["out"]).alias("out"), F.when(free, F.concat(acc["used"], F.array(s["group"]))).otherwise(acc["used"]).alias("used"))

    return F.aggregate(spans, start, add, lambda acc: F.struct(acc["at"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))).alias("out"), acc["used"].alias("used")))


def plan(examples: DataFrame, aliases: DataFrame, chapters: DataFrame, mode: str = "section", two: bool = False, min_mentions: int = 1, seed: int = 0, ids=None) -> DataFrame:
    """Every unit with the rule that it fails, and what an item has.

    (item_id, book, chapter_index, chunk_index, labels, answer, mentions, masked, original, reason, left): reason is null for items, else the first of
    REASONS that holds: no_text; protected: a protected name is in the text; not_all_named: a label is named less than min_mentions times (two: not
    exactly two labels are named, both so often); too_early: a label is named in fewer than MIN_PRIOR chapters before the unit's;
    ambiguous: an ambiguous name is in the masked text; leftover: a name word is in the masked text, in any capitals but all lower case (`left`).
    `ids` gives map<label, id> from item_id and labels; by default ids are shuffled by a generator seeded with '<seed>:<item_id>'. Books without alias rows have no units.
    """
    small_batches(examples.sparkSession)
    known = kept(books(aliases))
    rows = units(examples, known, mode).join(kept(eligible_since(chapters, known)), "book", "left")
    name = item_id(F.col("book"), F.col("chapter_index"), F.col("unit"))
    rows = rows.withColumns({"item_id": F.concat(name, F.lit("__two")) if two else name, "hits": matcher.find(F.col("text"), F.col("key"), F.col("forms"))})
    every = F.transform("labels", lambda _, i: i)
    count = lambda g: F.size(F.filter("hits", lambda h: h["group"] == g))
    rows = rows.withColumns({"groups": F.filter(every, lambda g: count(g) >= min_mentions), "named": F.size(F.filter(every, lambda g: count(g) > 0))})
    whole = (F.size("groups") == 2) & (F.col("named") == 2) if two else F.size("groups") == F.size("labels")
    early = F.exists("groups", lambda g: F.coalesce(F.try_element_at("since", g) >= F.col("chapter_index"), F.lit(True)))
    first = F.when(F.coalesce("text", F.lit("")) == "", "no_text").when(F.exists("hits", lambda h: h["group"] == PROTECTED), "protected").when(~whole, "not_all_named").when(early, "too_early")
    rows = rows.withColumn("reason", first).withColumn("own", F.transform("groups", lambda g: F.get("labels", g)))
    given = shuffled_ids(F.col("item_id"), F.col("own"), seed) if ids is None else ids(F.col("item_id"), F.col("own"))
    rows = rows.withColumn("answer", F.when(F.col("reason").isNull(), given))
    numbers = F.map_from_entries(F.transform("groups", lambda g: F.struct(g.alias("g"), F.element_at("answer", F.get("labels", g)).alias("i"))))
    rows = rows.withColumn("mask", F.when(F.col("reason").isNull(), masked(F.col("text"), F.col("hits"), numbers)))
    rows = rows.withColumn("leak", matcher.leaks(F.col("mask.out"), F.col("key"), F.col("forms"), AMBIGUOUS, F.col("names")))
    reason = F.coalesce("reason", F.when(F.col("leak.named"), "ambiguous").when(F.size("leak.left") > 0, "leftover"))
    mentions = F.map_from_entries(F.transform("groups", lambda g: F.struct(F.get("labels", g).alias("l"), F.size(F.filter("mask.used", lambda u: u == g)).alias("n"))))
    rows = rows.withColumns({"mentions": F.when(F.col("answer").isNotNull(), mentions), "reason": reason})
    return rows.select("item_id", "book", "chapter_index", "chunk_index", F.col("own").alias("labels"), "answer", "mentions", F.col("mask.out").alias("masked"), F.col("text").alias("original"), "reason", F.col("leak.left").alias("left"))


def items(rows: DataFrame) -> DataFrame:
    """The items of a plan, as they are stored."""
    return rows.where("reason is null").drop("reason", "left")


def counters(rows: DataFrame) -> DataFrame:
    """(book, units, one count for each reason, items) of a plan."""
    count = [F.count_if(F.col("reason") == r).alias(r) for r in REASONS]
    return rows.groupBy("book").agg(F.count("*").alias("units"), *count, F.count_if(F.col("reason").isNull()).alias("items"))
