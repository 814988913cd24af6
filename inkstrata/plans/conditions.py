"""The condition language: parse a condition's name, and plan prompts for items, orders and targets.

    condition := rep [ '^' book ] [ '&' book ] [ '+pre' ]
    rep       := 'noinfo' | book | [ 'swap:' | 'swapname:' ] name [ '@' k ]

Splitting goes in the order '+pre', '&', '^', '@', ':'.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cut_words, strip
from ..functions.unicode import exchange

# Prompt texts.
INTRO = {
    3: "Below is information about three characters from a novel, followed by a passage from a later part of the same novel. In the passage, each of these characters' names has been replaced with an ID: [CHAR 0], [CHAR 1] or [CHAR 2]. Each ID stands for exactly one of the three characters.",
    2: "Below is information about two characters from a novel, followed by a passage from a later part of the same novel. In the passage, each of these characters' names has been replaced with an ID: [CHAR 0] or [CHAR 1]. Each ID stands for exactly one of the two characters.",
}
DIGITS = {3: "0, 1 or 2", 2: "0 or 1"}
STORY_NAMES = ("book", "plot_", "ncp_", "si-")
HEADS = {"book": "The novel so far", "plot": "Summary of the novel so far", "parts": "The story so far, chapter by chapter", "next": "Synopsis of this chapter", "story": "Story information"}
SYNOPSES, LAST_TWO, SUMMARY, NEXT = "## Synopses of the chapters so far", "## The last two chapters", "## Plot summary so far", "## Synopsis of the next chapter"
# End of fixed values.

BOOK_TEXT = re.compile(r"book(?:_(?P<kind>last|noprev)(?P<k>\d+)|_(?P<prev>prevonly)|_ch(?P<ch>\d+)(?P<p>p?)|_(?P<prefix>prefix))?$")


@dataclass(frozen=True)
class BookText:
    """Chapters boundary - low .. boundary - skip - 1 (low None: from the start), their last `last` words, then the prefix."""

    low: int | None = None
    skip: int = 0
    last: int | None = None
    prefix: bool = False
    chapters: bool = True


@dataclass(frozen=True)
class Condition:
    name: str
    base: str
    swap: bool = False
    rename: bool = False
    words: int | None = None
    before: str | None = None
    after: str | None = None
    pre: bool = False

    @property
    def blocks(self) -> bool:
        """Whether there is a block of text per character."""
        return self.base != "noinfo" and not is_story(self.base)


def is_story(name: str) -> bool:
    return name.startswith(STORY_NAMES)


def parse(name: str) -> Condition:
    """The parts of a condition's name; ValueError where a part is malformed."""
    rest, pre = (name[:-4], True) if name.endswith("+pre") else (name, False)
    rest, _, before = rest.partition("&")
    rest, _, after = rest.partition("^")
    if not rest:
        raise ValueError(f"no representation in {name!r}")
    if is_story(rest):
        return Condition(name, rest, before=before or None, after=after or None, pre=pre)
    base, _, k = rest.partition("@")
    if k and not k.isdigit():
        raise ValueError(f"not a number of words: {k!r}")
    kind, _, plain = base.rpartition(":")
    if kind not in ("", "swap", "swapname"):
        raise ValueError(f"unknown modifier {kind!r}")
    return Condition(name, plain, bool(kind), kind == "swapname", int(k) if k else None, before or None, after or None, pre)


def parse_book(name: str) -> BookText:
    """What a book condition shows of the book."""
    m = BOOK_TEXT.match(name)
    if not m:
        raise ValueError(f"not a book condition: {name!r}")
    if m["prefix"]:
        return BookText(prefix=True, chapters=False)
    if m["prev"]:
        return BookText(low=1)
    if m["ch"]:
        return BookText(low=int(m["ch"]), prefix=bool(m["p"]))
    return BookText(skip=int(m["kind"] == "noprev"), last=int(m["k"]) if m["k"] else None)


def book_text(items: DataFrame, chapters: DataFrame, spec: BookText) -> DataFrame:
    """(item_id, text) for items(item_id, book, chapter_index, prefix) from chapters(book, chapter_index, text).

    Items of one book and chapter share the text, so chapters are joined to distinct boundaries only.
    """
    from ..operators.reps import as_of, ordered_text

    keys = items.select("book", F.col("chapter_index").alias("boundary")).distinct()
    if spec.chapters:
        seen = as_of(chapters.select("book", "chapter_index", "text"), keys, ["book"], spec.low, spec.skip)
        text = ordered_text(seen, ["book", "boundary"], ["chapter_index"], "text", "\n\n")
        if spec.last:
            text = text.withColumn("text", cut_words(F.col("text"), spec.last, last=True))
        got = items.join(text, (items.book == text.book) & (items.chapter_index == text.boundary), "left").select(items["*"], F.coalesce("text", F.lit("")).alias("text"))
    else:
        got = items.withColumn("text", F.lit(""))
    if spec.prefix:
        both = F.filter(F.array("text", F.coalesce("prefix", F.lit(""))), lambda x: x != "")
        got = got.withColumn("text", F.array_join(both, "\n\n"))
    return got.select("item_id", "text")


def story_text(items: DataFrame, name: str, chapters: DataFrame | None = None, plots: DataFrame | None = None, parts: DataFrame | None = None) -> DataFrame:
    """(item_id, head, text) of a story condition; items whose text is missing are left out.

    plots(condition, book, boundary, text) are plot summaries, parts(book, chapter_index, plot, raw, next) a story's given parts.
    """
    base, _, tail = ("", "", "") if name.startswith("si-") else name.partition("@")
    last = int(tail.removeprefix("last")) if tail else None
    cut = lambda c: cut_words(c, last, last=True) if last else c

    def plot(of: str) -> DataFrame:
        got = plots.where(F.col("condition") == of).select("book", F.col("boundary").alias("chapter_index"), "text")
        return items.select("item_id", "book", "chapter_index").join(got, ["book", "chapter_index"]).select("item_id", "text")

    def given(expr: Column) -> DataFrame:
        return items.select("item_id", "book", "chapter_index").join(parts, ["book", "chapter_index"]).select("item_id", expr.alias("text"))

    def titled(head: str, c: Column) -> Column:
        return F.concat(F.lit(head + "\n\n"), c)

    if name.startswith("book"):
        got, head = book_text(items, chapters, parse_book(name)), HEADS["book"]
    elif name.startswith("plot_"):
        got, head = plot(base).withColumn("text", cut(F.col("text"))), HEADS["plot"]
    elif name.startswith("ncp_"):
        both = F.concat_ws("\n\n", titled(SYNOPSES, F.col("plot")), titled(LAST_TWO, F.col("raw")))
        kinds = {"ncp_plot": (cut(F.col("plot")), "parts"), "ncp_next": (F.col("next"), "next"), "ncp_story": (both, "story"), "ncp_storynext": (F.concat_ws("\n\n", both, titled(NEXT, F.col("next"))), "story")}
        if base not in kinds:
            raise ValueError(f"not a story condition: {name!r}")
        got, head = given(kinds[base][0]), HEADS[kinds[base][1]]
    else:
        first, _, recent = name.removeprefix("si-").rpartition("-")
        first, _, tail = first.partition("@")
        last = int(tail.removeprefix("last")) if tail else None
        texts = []
        if first != "none":
            own = given(F.col("plot")) if first == "ncp" else plot(first)
            texts.append(own.withColumn("text", titled(SYNOPSES if first == "ncp" else SUMMARY, cut(F.col("text")))))
        if recent == "ch2":
            texts.append(given(titled(LAST_TWO, F.col("raw"))))
        elif recent.startswith("last"):
            n = int(recent[4:])
            texts.append(book_text(items, chapters, BookText(last=n)).withColumn("text", titled(f"## The last {n:,} words before this chapter", F.col("text"))))
        elif recent != "none":
            raise ValueError(f"not a story condition: {name!r}")
        got, head = items.select("item_id", F.lit("").alias("text")), HEADS["story"]
        for t in texts:
            both = F.filter(F.array("text", "_more"), lambda x: x != "")
            got = got.join(t.withColumnRenamed("text", "_more"), "item_id").select("item_id", F.array_join(both, "\n\n").alias("text"))
    return got.where("text is not null").select("item_id", F.lit(head).alias("head"), "text")


def sources(labels: Column, swap: bool) -> Column:
    """Whose block each label gets: its own, or the next label's in cyclic order."""
    return F.transform(labels, lambda x, i: F.get(labels, (i + 1) % F.size(labels)) if swap else x)


def blocks(items: DataFrame, cond: Condition, reps: DataFrame, item_reps: DataFrame | None = None, names: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """(item_id, blocks map<label, text>) of items whose labels all have a text; item-level texts win over boundary-level ones.

    items(item_id, book, chapter_index, labels); an item without some text is left out, never shown as having no information.
    """
    pairs = items.select("item_id", "book", F.col("chapter_index").alias("boundary"), F.size("labels").alias("n"), F.explode(F.arrays_zip(F.col("labels").alias("label"), sources(F.col("labels"), cond.swap).alias("source"))).alias("x"))
    pairs = pairs.select("item_id", "book", "boundary", "n", "x.label", "x.source")
    at = reps.where(F.col("condition") == cond.base).select("book", "boundary", F.col("label").alias("source"), "text")
    pairs = pairs.join(at, ["book", "boundary", "source"], "left")
    if item_reps is not None:
        own = item_reps.where(F.col("condition") == cond.base).select("item_id", F.col("label").alias("source"), F.col("text").alias("own"))
        pairs = pairs.join(own, ["item_id", "source"], "left").withColumn("text", F.coalesce("own", "text")).drop("own")
    if cond.rename:
        # After a swap by name, the two characters' names change places in the text.
        also = aliases.groupBy("book", "label").agg(F.array_sort(F.collect_set("alias")).alias("forms")).join(names, ["book", "label"])
        also = also.select("book", "boundary", "label", F.struct("forms", "name").alias("who"))
        pairs = pairs.join(also.withColumnRenamed("who", "to"), ["book", "boundary", "label"]).join(also.withColumnsRenamed({"label": "source", "who": "from"}), ["book", "boundary", "source"])
        pairs = pairs.withColumn("text", exchange(F.col("text"), F.col("from"), F.col("to")))
    if cond.words:
        pairs = pairs.withColumn("text", cut_words(F.col("text"), cond.words))
    return pairs.where("text is not null").groupBy("item_id", "n").agg(F.map_from_entries(F.collect_list(F.struct("label", "text"))).alias("blocks")).where(F.size("blocks") == F.col("n")).select("item_id", "blocks")


def orders(labels: Column, n: int, most: int | None = None, rotations: bool = False) -> Column:
    """array<array<label>>: permutations of n labels in lexicographic order of places (the first `most`), or the n rotations."""
    places = [tuple((i + k) % n for i in range(n)) for k in range(n)] if rotations else list(permutations(range(n)))[:most]
    return F.array(*[F.array(*[F.get(labels, F.lit(i)) for i in p]) for p in places])


def jobs(items: DataFrame, n: int, shown: bool, most: int | None = 6, rotations: bool = False) -> DataFrame:
    """items x orders x targets; items shown without blocks get one order."""
    all_ = orders(F.col("labels"), n, most, rotations) if shown else F.array(F.col("labels"))
    return items.where(F.size("labels") == n).withColumn("order", F.explode(all_)).withColumn("target", F.explode("labels"))


def prompt(n: int, head: Column | None = None, book: Column | None = None, shown: bool = True, recent: Column | None = None, pre: Column | None = None) -> Column:
    """The prompt of a job row with names map<label, name>, order, target, masked, and blocks map<label, text> if shown."""
    named = F.transform("order", lambda x: F.concat(F.lit("- "), F.element_at("names", x)))
    texts = F.transform("order", lambda x: F.concat(F.lit("## "), F.element_at("names", x), F.lit("\n\n"), strip(F.element_at("blocks", x)))) if shown else None
    parts = [F.lit(INTRO[n])]
    if book is not None:
        parts.append(F.concat(F.lit("# "), F.lit("The novel so far") if head is None else head, F.lit("\n\n"), book))
    parts.append(F.concat(F.lit("# Character information\n\n"), F.array_join(texts, "\n\n")) if shown else F.concat(F.lit("# Characters\n\n"), F.array_join(named, "\n")))
    if recent is not None:
        parts.append(F.concat(F.lit("# The story just before this chapter\n\n"), recent))
    if pre is not None:
        parts.append(F.concat(F.lit("# This chapter up to the passage\n\n"), F.when(F.coalesce(pre, F.lit("")) == "", "(The passage starts the chapter.)").otherwise(pre)))
    parts.append(F.concat(F.lit("# Passage\n\n"), F.col("masked")))
    parts.append(F.concat(F.lit("# Question\n\nWhich ID in the passage is "), F.element_at("names", F.col("target")), F.lit(f"? Answer with only the digit {DIGITS[n]}.")))
    return F.concat_ws("\n\n", *parts)


def grid(plots: DataFrame, characters: DataFrame) -> DataFrame:
    """Every plot slot with every character slot, named '<plot>|<characters>'; both are short lists of conditions."""
    return plots.select(F.col("condition").alias("plot")).distinct().crossJoin(F.broadcast(characters.select(F.col("condition").alias("chars")).distinct())).withColumn("condition", F.concat_ws("|", "plot", "chars"))


def plan(items: DataFrame, name: str, reps: DataFrame, names: DataFrame, chapters: DataFrame | None = None, item_reps: DataFrame | None = None, n: int = 3, most: int = 6, rotations: bool = False, plots: DataFrame | None = None, parts: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """Prompts of a condition: (item_id, book, chapter_index, order, target, answer, condition, prompt), prefixes adjacent.

    items(item_id, book, chapter_index, labels, answer, masked, prefix), names(book, boundary, label, name).
    """
    cond = parse(name)
    by = names.groupBy("book", F.col("boundary").alias("chapter_index")).agg(F.map_from_entries(F.collect_list(F.struct("label", "name"))).alias("names"))
    rows = items.join(by, ["book", "chapter_index"])
    if cond.blocks:
        rows = rows.join(blocks(items, cond, reps, item_reps, names, aliases), "item_id")
    texts = {}
    for place, story in (("book_text", cond.before or (cond.base if is_story(cond.base) else None)), ("recent", cond.after)):
        if story is not None:
            got = story_text(items, story, chapters, plots, parts).withColumnsRenamed({"text": place, "head": f"{place}_head"})
            rows = rows.join(got, "item_id")
            texts[place] = F.col(place)
    rows = jobs(rows, n, cond.blocks, most, rotations)
    text = prompt(n, F.col("book_text_head") if "book_text" in texts else None, texts.get("book_text"), shown=cond.blocks, recent=texts.get("recent"), pre=F.col("prefix") if cond.pre else None)
    out = rows.select("item_id", "book", "chapter_index", "order", "target", F.element_at("answer", F.col("target")).alias("answer"), F.lit(name).alias("condition"), text.alias("prompt"))
    return prefix_sorted(out)


def prefix_sorted(rows: DataFrame) -> DataFrame:
    """Rows of one book, chapter, item and order next to each other, for servers that keep prompt prefixes."""
    return rows.repartitionByRange("book", "chapter_index", "item_id").sortWithinPartitions("book", "chapter_index", "item_id", F.array_join("order", "\x1f"))
