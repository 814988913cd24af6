"""Text functions as Column expressions; everything here stays in the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that results depend on.
SENTENCE_END = r"(?<=[.!?…])[\"”’)\]]*\s+(?=[\"“‘(\[]?[A-Z0-9])"
NAME_TITLES = ["The", "A", "An", "Mr", "Mr.", "Mrs", "Mrs.", "Ms", "Ms.", "Dr", "Dr.", "Miss", "Sir", "Lady", "Lord", "Aunt", "Uncle", "Father", "Mother", "Sister", "Brother"]
NEGATION = r"(?i)\b(?:no|not|never|none|nothing|neither|nor)\b|n't\b"
META_WORDS = r"(?i)\b(?:text|snippet|excerpt|section|passage|story|mention\w*|describ\w*|information|indication|quot\w*|details?|depict\w*|reveal\w*|provid\w*|specif\w*|stated|appears?|shown|given|attributed|listed|spoken|assigned|explained|refer\w*|record\w*|clues?|attached|indicated)\b"
ABOUT_TEXT = r"(?i)^(?:(?:the|this) (?:text|snippet|excerpt|section|story section|passage)\b|therefore\b|no\b|none\b|nothing\b|there (?:is|are) no\b|we (?:have|do) not\b|we have no\b)"
FILLER = r"(?i)[^.!?]*(?:not mentioned|no (?:physical )?description|not (?:explicitly )?described|no information)[^.!?]*[.!?]?"
MALE = r"(?i)\b(he|him|his|himself)\b"
FEMALE = r"(?i)\b(she|her|hers|herself)\b"
# End of fixed values.

SPACE = r"(?U)\s+"


def bound(value: Column, f) -> Column:
    """f(value) with value computed once, also where f uses it inside a lambda over other elements."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def flat(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, SPACE, " "), "^ | $", "")


def words(text: Column) -> Column:
    """Words between white space; none for an empty text."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def cut_words(text: Column, k: int, last: bool = False) -> Column:
    """The first or last k words with single spaces; a text of at most k words is left as it is."""
    w = words(text)
    part = F.slice(w, -k, k) if last else F.slice(w, 1, k)
    return F.when(F.size(w) > k, F.array_join(part, " ")).otherwise(text)


def sentences(text: Column) -> Column:
    """Sentences of the flattened text; closing quotes at a boundary go with the boundary."""
    return F.filter(F.split(flat(text), SENTENCE_END), lambda s: strip(s) != "")


def first_sentences(text: Column, n: int = 1) -> Column:
    return F.array_join(F.slice(F.split(flat(text), SENTENCE_END), 1, n), " ")


def snippets(text: Column, target: int = 300) -> Column:
    """Sentences packed greedily into chunks of at least `target` words; a tail under a third of that joins the last chunk."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"))

    def add(acc: Column, x: Column) -> Column:
        s = x["s"]
        now = F.when(acc["n"] == 0, s).otherwise(F.concat(acc["now"], F.lit(" "), s))
        n = acc["n"] + x["words"]
        full = n >= target
        return F.struct(F.when(full, F.concat(acc["done"], F.array(now))).otherwise(acc["done"]).alias("done"), F.when(full, "").otherwise(now).alias("now"), F.when(full, 0).otherwise(n).alias("n"))

    def finish(acc: Column) -> Column:
        done, size = acc["done"], F.size(acc["done"])
        short = (size > 0) & (acc["n"] < target // 3)
        tail = F.concat(F.slice(done, 1, F.greatest(size - 1, F.lit(0))), F.array(F.concat(F.element_at(done, -1), F.lit(" "), acc["now"])))
        return F.when(acc["n"] == 0, done).when(short, tail).otherwise(F.concat(done, F.array(acc["now"])))

    # Words are counted once for each sentence, not wherever the fold needs their number.
    counted = F.transform(sentences(text), lambda s: F.struct(s.alias("s"), word_count(s).alias("words")))
    return F.aggregate(counted, start, add, finish)


def strip_markup(text: Column) -> Column:
    """Comments, images and tags out, rules as line breaks; entities are left to functions.unicode.clean_text."""
    steps = ((r"(?s)<!--.*?-->|<!--<hr/>", ""), (r"<img[^<>]*>", ""), (r"<hr\s*/?>", "\n"), (r"</?[A-Za-z][^<>\n]{0,200}/?>", ""))
    return reduce(lambda t, step: F.regexp_replace(t, *step), steps, text)


def name_tokens(name: Column) -> Column:
    """Capitalised words of a name that are no titles, without outer punctuation."""
    bare = F.transform(F.regexp_extract_all(name, F.lit(r"[^\s\"“”]+"), 0), lambda t: F.regexp_replace(t, r"^[.,'’]+|[.,'’]+$", ""))
    titles = F.array(*[F.lit(t) for t in NAME_TITLES])
    return F.filter(bare, lambda t: (t != "") & F.regexp_like(t, F.lit(r"^(?U)\p{Lu}")) & ~F.array_contains(titles, t))


def text_tokens(text: Column) -> Column:
    """Distinct words of a text (runs of word characters, inner apostrophes and hyphens parted)."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)\w+"), 0))


def name_seen(name: Column, text: Column) -> Column:
    """Whether every name token occurs as a whole word of the text; a name without tokens counts as seen."""
    return F.forall(name_tokens(name), lambda t: F.regexp_like(text, F.concat(F.lit(r"(?U)(?<!\w)\Q"), t, F.lit(r"\E(?!\w)"))))


def alias_pattern(aliases: list[str]) -> str:
    """A Java regex of whole aliases, each also in upper case, the longest first."""
    from .unicode import alias_forms

    return r"(?U)(?<![\w’'])(" + "|".join(map(java_quote, alias_forms(aliases))) + r")(?!\w)"


def clean_notes(text: Column) -> Column:
    """Sentences about what a text doesn't say are left out."""
    keep = lambda s: ~(F.regexp_like(s, F.lit(NEGATION)) & F.regexp_like(s, F.lit(META_WORDS))) & ~F.regexp_like(s, F.lit(ABOUT_TEXT))
    return F.array_join(F.filter(F.split(flat(text), SENTENCE_END), keep), " ")


def drop_filler(text: Column) -> Column:
    return strip(F.regexp_replace(text, FILLER, ""))


def nest_headings(text: Column) -> Column:
    """Markdown headings one level down, with plain hyphens and spaces."""
    return F.translate(F.regexp_replace(text, r"(?m)^(#+) ", r"#$1 "), "‑ ", "- ")


def section_map(text: Column) -> Column:
    """Markdown '## head' sections as a map from head to body; of equal heads the last one stays."""

    def as_map(parts: Column) -> Column:
        heads = F.transform(parts, lambda s: strip(F.regexp_extract(s, r"^## ([^\n]*)", 1)))
        bodies = F.transform(parts, lambda s: strip(F.regexp_replace(s, r"^## [^\n]*\n?", "")))
        return bound(F.arrays_zip(heads.alias("h"), bodies.alias("b")), last_of)

    def last_of(pairs: Column) -> Column:
        later = lambda i: F.transform(F.slice(pairs, i + 2, F.size(pairs)), lambda p: p["h"])
        kept = F.filter(F.transform(pairs, lambda p, i: F.when(~F.array_contains(later(i), p["h"]), p)), lambda p: p.isNotNull())
        return F.map_from_entries(kept)

    return bound(F.filter(F.split(text, r"(?m)^(?=## )"), lambda s: s.startswith("## ")), as_map)


def drop_section(text: Column, head: str) -> Column:
    """The text without the sections whose heading starts with `head`, in any case."""
    pattern = r"(?i)^#+\s*" + head
    return F.array_join(F.filter(F.split(text, r"(?m)^(?=#+ )"), lambda s: ~F.regexp_like(strip(s), F.lit(pattern))), "")


def name_subject(text: Column, name: Column) -> Column:
    """A leading She or He becomes the name, Her or His its possessive."""
    bare = strip(F.regexp_replace(F.element_at(F.split(name, " / "), 1), r"\s*\(.*?\)|\s*“.*?”", ""))
    safe = F.regexp_replace(bare, r"([\\$])", r"\\$1")
    return F.regexp_replace(F.regexp_replace(text, F.lit(r"^(?:She|He)\b"), safe), F.lit(r"^(?:Her|His)\b"), F.concat(safe, F.lit("’s")))


def tokens(text: Column) -> Column:
    """Lower-case words and single marks."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+|[^\w\s]"), 0)


def mask_windows(text: Column, near: int = 30) -> Column:
    """For each mask, its id and the words within `near` tokens on either side, as array<struct<id, context>>."""

    def windows(w: Column) -> Column:
        marks = F.filter(F.transform(w, lambda t, i: F.when(t.startswith("[CHAR "), F.struct(F.substring(t, 7, 1).cast("int").alias("id"), i.alias("at")))), lambda x: x.isNotNull())
        around = lambda m: F.filter(F.slice(w, F.greatest(m["at"] - near, F.lit(0)) + 1, F.least(m["at"], F.lit(near)) + near + 1), lambda t: ~t.startswith("[CHAR "))
        return F.transform(marks, lambda m: F.struct(m["id"].alias("id"), F.array_join(around(m), " ").alias("context")))

    return bound(F.regexp_extract_all(text, F.lit(r"(?U)\[CHAR \d\]|\w+"), 0), windows)


def verbatim_form(text: Column) -> Column:
    """Straight quotes, single spaces and lower case, for containment tests."""
    return F.lower(flat(F.translate(text, "“”‘’", "\"\"''")))


def json_text(reply: Column) -> Column:
    """The JSON object of a reply: without code fences, or else from the first brace to the last."""
    bare = F.regexp_replace(strip(reply), r"^```(?:json)?\s*|\s*```$", "")
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(bare).isNotNull(), bare).when(F.try_parse_json(inner).isNotNull(), inner)


def last_object(reply: Column) -> Column:
    """The last flat JSON object in a reply."""
    return F.try_element_at(F.regexp_extract_all(reply, F.lit(r"\{[^{}]*\}"), 0), F.lit(-1))


def valid_assignment(reply: Column, n: int) -> Column:
    """map<string, int> from the last object of a reply if its values are the ids 0..n-1, each once; else null."""
    got = F.from_json(last_object(reply), "map<string, int>")
    return F.when((F.size(got) == n) & (F.array_sort(F.map_values(got)) == F.array(*[F.lit(i) for i in range(n)])), got)


def last_rating(reply: Column) -> Column:
    """The last lone digit 1 to 5 of a reply, or 1."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(reply, F.lit(r"(?<!\d)([1-5])(?!\d)"), 1), F.lit(-1)).cast("int"), F.lit(1))


def citation(chapters: Column) -> Column:
    """Distinct chapters in order as '[Ch. a]' or '[Chs. a, b]'."""
    c = F.array_sort(F.array_distinct(chapters))
    head = F.when(F.size(c) == 1, "[Ch. ").otherwise("[Chs. ")
    return F.when(F.size(c) > 0, F.concat(head, F.array_join(F.transform(c, lambda x: x.cast("string")), ", "), F.lit("]"))).otherwise("")


def full_sentences(text: Column) -> Column:
    """The text up to its last full stop before white space; a text without one is left as it is."""
    got = F.regexp_extract(text, r"(?s)^(.*\.)[ \n]", 1)
    return F.when(got != "", got).otherwise(text)


def trim_sentences(text: Column, most: int) -> Column:
    """Leading sentences while they keep within `most` words, at least the first."""

    def add(acc: Column, s: Column) -> Column:
        n = acc["n"] + word_count(s)
        on = acc["on"] & ((n <= most) | (acc["n"] == 0))
        return F.struct(F.when(on, F.concat(acc["out"], F.array(s))).otherwise(acc["out"]).alias("out"), F.when(on, n).otherwise(acc["n"]).alias("n"), on.alias("on"))

    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("n"), F.lit(True).alias("on"))
    return F.aggregate(sentences(text), zero, add, lambda acc: F.array_join(acc["out"], " "))


def drop_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"\[[^\]]*\]|<[^>]*>", " ")


def item_id(book: Column, chapter: Column, unit: Column) -> Column:
    return F.format_string("%s__c%03d__%s", book, chapter, unit)


def snippet_id(book: Column, chapter: Column, idx: Column) -> Column:
    return F.format_string("%s__c%03d__s%03d", book, chapter, idx)


def repair_sources(text: Column) -> Column:
    """Chapter marks such as 'ch10:' padded to three digits."""
    return F.regexp_replace(F.regexp_replace(text, r"\bch(\d):", "ch00$1:"), r"\bch(\d\d):", "ch0$1:")


def tagged(claim: Column, tags: list[Column]) -> Column:
    """A claim with its non-empty tags in square brackets."""
    kept = F.filter(F.array(*tags), lambda t: t.isNotNull() & (t != ""))
    return F.when(F.size(kept) > 0, F.concat(claim, F.lit(" ["), F.array_join(kept, "; "), F.lit("]"))).otherwise(claim)


def chapter_context(header: Column, narrator: Column) -> Column:
    """Heading and narrator lines that go before a chapter's text; empty if there are none."""
    head = flat(F.coalesce(header, F.lit("")))
    first = F.when(head != "", F.concat(F.lit("Chapter heading: "), head))
    who = F.when(narrator.isNotNull() & (narrator != ""), F.concat(F.lit("This chapter is narrated in the first person by "), narrator, F.lit(': "I" and "me" refer to '), narrator, F.lit(".")))
    return F.concat_ws("\n", first, who)


# Fixed value: what counts as a heading line, with the blank lines around it; and its longest extent.
HEADING = r"\s*((CHAPTER|Chapter|PART|Part|PROLOGUE|Prologue|EPILOGUE|Epilogue|INTERLUDE|BOOK)\b[^\n]*|\d+|[IVXLC]+)\s*\n"
HEADING_CHARS = 120


def strip_heading(text: Column, header: Column) -> Column:
    """The text without its header and leading heading lines; null where the header is all there is.

    Headings go one after the other from the start, up to the first that takes more than HEADING_CHARS characters with its blanks.
    """
    head = F.coalesce(header, F.lit(""))
    named = strip(head) != ""
    rest = F.when(named & F.startswith(text, head), F.substr(text, F.length(head) + 1)).otherwise(text)
    # Each match begins where the one before ended; `on` falls at the first long one.
    ends = F.aggregate(F.regexp_extract_all(rest, F.lit(r"\G" + HEADING), F.lit(0)), F.struct(F.lit(0).alias("at"), F.lit(True).alias("on")),
                       lambda acc, m: F.struct(F.when(acc["on"] & (F.length(m) <= HEADING_CHARS), acc["at"] + F.length(m)).otherwise(acc["at"]).alias("at"), (acc["on"] & (F.length(m) <= HEADING_CHARS)).alias("on")))
    bare = F.substr(rest, ends["at"] + 1)
    return F.when(named & (strip(text) == strip(head)), None).otherwise(strip(strip_markup(bare)))


def java_quote(text: str) -> str:
    return r"\Q" + re.sub(r"\\E", r"\\E\\\\E\\Q", text) + r"\E"
