"""The catalogue of representations: every named text that stands for a character at a boundary, as one plan.

A condition is a name. A family says, for the names that it knows, which inputs they need and how the text is made of them: a Column over one
row for each (book, boundary, label). Inputs are sources, or other conditions and what is derived from them. `build` resolves the
wanted names into the inputs that they need, reads and joins each input once, computes shared parents once, and explodes the row into its
conditions at the end; what isn't wanted isn't read.

Sources:

- texts(source, book, boundary, label, text, pos): finished texts; of several rows of a key the first by pos counts;
- records(source, book, label, name, chapter_index, q, q_no, pos, text, rating): what is known of a label chapter by chapter: notes (a row for each
  question), rated sentences (rows in order of pos), claims (q is a category), ledgers (q is a section, q_no its place), presence (rating 1 or 0);
- rated(source, book, boundary, label, pos, text, rating): sentences of finished texts with their ratings;
- aliases: alias rows as in operators.itemplan.

A label's records become one row of chapters before they meet the boundaries, so nothing is multiplied by the boundaries but the result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import matcher
from ..functions import text as t
from ..functions.unicode import blocks
from ..operators import itemplan, names
from ..operators import reps as rp
from .generate import QUESTIONS

KEYS = ["book", "boundary", "label"]
ENTRY = "array<struct<chapter: int, text: string>>"


@dataclass(frozen=True)
class Layout:
    """What notes are about: sections of questions, the questions' texts, and the categories of claims."""

    sections: tuple[tuple[str, tuple[str, ...]], ...]
    questions: dict[str, str]
    categories: tuple[str, ...]
    #: The question on speech, whose answers the writer's brief replaces.
    spoken: str = "speech"


def _own_layout() -> Layout:
    heads = list(dict.fromkeys(head for head, _ in QUESTIONS.values()))
    return Layout(tuple((h, tuple(q for q, (head, _) in QUESTIONS.items() if head == h)) for h in heads), {q: text for q, (_, text) in QUESTIONS.items()}, tuple(heads))


@dataclass(frozen=True)
class Sources:
    texts: DataFrame
    records: DataFrame
    aliases: DataFrame
    rated: DataFrame | None = None
    layout: Layout = field(default_factory=_own_layout)


@dataclass(frozen=True)
class Family:
    """Conditions whose whole name matches `pattern`: needs(match, layout) are names of inputs, text(match, get, layout) is the Column; get
    gives the Column of an input."""

    pattern: str
    needs: Callable
    text: Callable


# Texts from parts ---------------------------------------------------------------------------------------------------------


def _joined(parts: Column, sep: str) -> Column:
    return F.array_join(parts, sep)


def _early(entries: Column) -> Column:
    return F.filter(F.coalesce(entries, F.array().cast(ENTRY)), lambda x: x["chapter"] < F.col("boundary"))


def _answers(view: Column, q: str) -> Column:
    return _early(F.try_element_at(view, F.lit(q)))


def _chapters(view: Column) -> Column:
    return F.array_distinct(F.transform(_early(F.flatten(F.map_values(view))), lambda x: x["chapter"]))


def _complete(view: Column) -> Column:
    """Whether every chapter before the boundary is in the view."""
    return (F.col("boundary") > 0) & (F.size(_chapters(view)) == F.col("boundary"))


def _snippet(x: Column, text: Column) -> Column:
    return F.concat(F.lit("<snippet "), x["chapter"].cast("string"), F.lit(">\n"), text)


def _notes(view: Column, layout: Layout, edit=lambda text: text, empty: bool = False) -> Column:
    """Notes under their questions; chapters, and questions, without a text are left out, or stay if `empty`."""
    parts = []
    for head, qs in layout.sections:
        parts.append(F.lit(f"## {head}"))
        for q in qs:
            body = F.transform(_answers(view, q), lambda x: F.struct(x["chapter"].alias("chapter"), edit(x["text"]).alias("text")))
            body = body if empty else F.filter(body, lambda x: x["text"] != "")
            question = F.concat(F.lit(f"Question: {layout.questions[q]}\n\n"), _joined(F.transform(body, lambda x: _snippet(x, x["text"])), "\n"))
            parts.append(question if empty else F.when(F.size(body) > 0, question))
    return F.concat_ws("\n\n", *parts)


def _line(have: Column) -> Callable:
    """A chapter's line, given map<chapter, text>."""
    return lambda c: F.concat(F.lit("<snippet "), c.cast("string"), F.lit(">\n"), F.coalesce(F.try_element_at(have, c), F.lit("")), F.lit("\n"))


def _archive(view: Column, layout: Layout, only: int | None = None) -> Column:
    """Every chapter under every question; sections are parted by a rule."""
    secs = []
    for i, (head, qs) in enumerate(layout.sections):
        if only in (None, i):
            each = []
            for q in qs:
                every = F.when(F.col("boundary") > 0, F.sequence(F.lit(0), F.col("boundary") - 1)).otherwise(F.array().cast("array<int>"))
                each.append(F.concat(F.lit(f"Question: {layout.questions[q]}\n\n"), _joined(F.transform(every, _line(F.map_from_entries(_answers(view, q)))), "")))
            secs.append(F.concat(F.lit(f"## {head}\n\n"), F.concat_ws("\n", *each)))
    return t.strip(F.concat_ws("-" * 100 + "\n", *secs))


def _rendered(parts: Column, keep=lambda c: F.lit(True), edit=lambda text: text) -> Column:
    """An archive's blocks as a text again: those of kept chapters whose edited text isn't empty; questions without blocks go."""
    own = lambda b: b["chapter"].isNotNull() & keep(b["chapter"])
    body = F.filter(F.transform(F.filter(parts, own), lambda b: F.struct(b["head_no"].alias("head_no"), b["chapter"].alias("chapter"), t.strip(edit(b["text"])).alias("text"))), lambda b: b["text"] != "")
    heads = F.transform(F.filter(parts, lambda b: b["chapter"].isNull()), lambda h: F.struct(h["head"].alias("head"), F.filter(body, lambda b: b["head_no"] == h["head_no"]).alias("body")))
    shown = F.filter(heads, lambda h: (F.size(h["body"]) > 0) | h["head"].startswith("## "))
    part = lambda h: F.concat(h["head"], F.when(F.size(h["body"]) > 0, F.concat(F.lit("\n\n"), _joined(F.transform(h["body"], lambda b: _snippet(b, b["text"])), "\n"))).otherwise(""))
    return _joined(F.transform(shown, part), "\n\n")


def _recent(parts: Column, budget: int) -> Column:
    """The newest chapters of an archive until `budget` words; the newest always stays."""
    sized = F.transform(F.filter(parts, lambda b: b["chapter"].isNotNull()), lambda b: F.struct(b["chapter"].alias("c"), t.word_count(b["text"]).alias("n")))
    newest = F.reverse(F.array_sort(F.array_distinct(F.transform(sized, lambda b: b["c"]))))
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("keep"), F.lit(True).alias("on"))

    def add(acc: Column, c: Column) -> Column:
        n = acc["n"] + F.aggregate(F.filter(sized, lambda b: b["c"] == c), F.lit(0), lambda a, b: a + b["n"])
        on = acc["on"] & ((n <= budget) | (F.size(acc["keep"]) == 0))
        return F.struct(F.when(on, n).otherwise(acc["n"]).alias("n"), F.when(on, F.concat(acc["keep"], F.array(c))).otherwise(acc["keep"]).alias("keep"), on.alias("on"))

    return t.bound(F.aggregate(newest, start, add)["keep"], lambda keep: _rendered(parts, lambda c: F.array_contains(keep, c)))


def _claims(rows: Column, layout: Layout, only: int | None = None) -> Column:
    """Claims as lists under their categories."""
    parts = []
    for i, category in enumerate(layout.categories):
        if only in (None, i):
            own = F.transform(rows, lambda r: F.struct((r["q"] == F.lit(category)).alias("own"), r["text"].alias("text")))  # the Column is made at once
            lines = F.transform(F.filter(own, lambda r: r["own"]), lambda r: F.concat(F.lit("- "), r["text"]))
            parts.append(F.concat(F.lit(f"### {category}\n"), F.when(F.size(lines) > 0, _joined(lines, "\n")).otherwise("- No information.")))
    return F.concat_ws("\n\n", *parts)


def _newest(rows: Column, budget: int) -> Column:
    """The last rows until `budget` words, in their order."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("k"), F.lit(True).alias("on"))

    def add(acc: Column, r: Column) -> Column:
        n = acc["n"] + t.word_count(r["text"])
        on = acc["on"] & (n <= budget)
        return F.struct(F.when(on, n).otherwise(acc["n"]).alias("n"), (acc["k"] + on.cast("int")).alias("k"), on.alias("on"))

    return t.bound(F.aggregate(F.reverse(rows), start, add)["k"], lambda k: F.slice(rows, F.size(rows) - k + 1, k))



def naming_others(texts: Column, label: Column, known: Column) -> Column:
    """map<text, boolean>: which distinct texts name another label of the book; known is struct<labels, forms, key>."""

    @F.arrow_udf("array<boolean>")
    def others(texts: pa.Array, own: pa.Array, key: pa.Array, forms: pa.Array) -> pa.Array:
        out = []
        for i, (some, mine, k) in enumerate(zip(texts.to_pylist(), own.to_pylist(), key.to_pylist(), strict=True)):
            found = None if some is None or k is None else matcher.matcher(k, forms[i])
            out.append([False] * len(some or ()) if found is None else [any(g >= 0 and g != mine for g, _, _ in found.find(x)) for x in some])
        return pa.array(out, pa.list_(pa.bool_()))

    distinct = F.array_distinct(texts)
    return F.map_from_arrays(distinct, others(distinct, F.array_position(known["labels"], label).cast("int") - 1, known["key"], known["forms"]))


# Families -----------------------------------------------------------------------------------------------------------------

# Short names of sheet sections, sections that a generated sheet can be without, parts of combined texts and their titles.
SHEET_SECTIONS = {"physical": "Physicality And Personality", "dialogue": "Dialogue And Voice", "history": "History And Circumstances", "knowledge": "Knowledge And Beliefs", "goals": "Goals And Motivations", "relationships": "Relationships"}
SHEET_ABLATE = {"refer": "how others refer", "voice": "voice", "story": "story so far", "rel": "relationships"}
COMBOS = {"combo_short": ("v2", "second", "summary"), "combo_legacy_v2": ("legacy_nofill", "v2"), "combo_all": ("v2", "second", "summary", "legacy_nofill")}
TITLES = {"v2": "Sheet", "second": "Second sheet", "summary": "Summary", "legacy_nofill": "Chapter-by-chapter notes"}
# End of fixed values.

_RULES: list[Family] = []


def family(pattern: str, *needs: str):
    """Register a builder. In `needs` {1}, {2}, ... are groups of the pattern."""

    def add(f):
        _RULES.append(Family(pattern, lambda m, layout: [n.format(m[0], *[g or "" for g in m.groups()]) for n in needs], f))
        return f

    return add


@family("sheet_(csum(?:_[a-z0-9]+)?)_fd_flat", "@rated:{1}_f")
def _(m, get, layout):
    best = F.filter(get(f"@rated:{m[1]}_f"), lambda x: x["rating"] == 5)
    return F.when(get(f"@rated:{m[1]}_f").isNotNull(), _joined(F.array_distinct(F.transform(best, lambda x: x["text"])), " "))


@family("sheet_(.+)_flat", "@text:sheet_{1}")
def _(m, get, layout):
    return get(f"@text:sheet_{m[1]}")


@family("sheet_(.+)_no(refer|voice|story|rel)", "sheet_{1}")
def _(m, get, layout):
    return t.drop_section(get(f"sheet_{m[1]}"), SHEET_ABLATE[m[2]])


@family(r"(.+)\+index", "{1}", "@index")
def _(m, get, layout):
    listed = F.concat(F.lit("\n\n### Names in the story\n"), _joined(get("@index"), ", "), F.lit("."))
    return F.when(F.size(get("@index")) > 0, F.concat(F.regexp_replace(get(m[1]), r"(?U)\s+$", ""), listed))


@family(r"(.+)\+last([0-9]+)", "{1}", "@view:chapnotes/plain")
def _(m, get, layout):
    view = get("@view:chapnotes/plain")
    own = lambda c: F.filter(F.array(*[F.try_element_at(F.map_from_entries(_answers(view, q)), c) for q in layout.questions]), lambda x: F.coalesce(x, F.lit("")) != "")
    last = F.filter(F.array_sort(_chapters(view)), lambda c: c >= F.col("boundary") - int(m[2]))
    lines = F.transform(last, lambda c: F.concat(F.lit("Chapter "), (c + 1).cast("string"), F.lit(": "), F.when(F.size(own(c)) > 0, _joined(own(c), " ")).otherwise("Not in this chapter.")))
    return F.when(F.size(last) > 0, F.concat(F.regexp_replace(get(m[1]), r"(?U)\s+$", ""), F.lit("\n\n### Latest chapters\n"), _joined(lines, "\n")))


@family("sheet_(.+)", "@text:sheet_{1}")
def _(m, get, layout):
    return t.nest_headings(get(f"@text:sheet_{m[1]}"))


@family("second_nest", "@text:second")
def _(m, get, layout):
    return t.nest_headings(get("@text:second"))


@family("(v2|second)_sec_(" + "|".join(SHEET_SECTIONS) + ")", "@text:{1}")
def _(m, get, layout):
    head = SHEET_SECTIONS[m[2]]
    return t.bound(t.section_map(get(f"@text:{m[1]}")), lambda parts: F.concat(F.lit(f"## {head}\n"), F.try_element_at(parts, F.lit(head))))


@family("(v2|second)_norel", "@text:{1}")
def _(m, get, layout):
    kept = lambda parts: F.filter(F.map_entries(parts), lambda e: e["key"] != "Relationships")
    return t.bound(t.section_map(get(f"@text:{m[1]}")), lambda parts: _joined(F.transform(kept(parts), lambda e: F.concat(F.lit("## "), e["key"], F.lit("\n"), e["value"])), "\n\n"))


@family("gender", "@gender")
def _(m, get, layout):
    word = F.create_map(F.lit("F"), F.lit("female"), F.lit("M"), F.lit("male"))
    return F.concat(F.lit("Gender: "), F.try_element_at(word, get("@gender")), F.lit("."))


@family("combo_(short|legacy_v2|all)")
def _(m, get, layout):
    parts = [(c, get(c)) for c in COMBOS[m[0]]]
    whole = F.concat_ws("\n\n", *[F.concat(F.lit(f"#### {TITLES[c]}\n"), x) for c, x in parts])
    every = F.lit(True)
    for _, x in parts:
        every = every & (F.coalesce(x, F.lit("")) != "")
    return F.when(every, whole)


@family("index", "@index")
def _(m, get, layout):
    return F.when(F.size(get("@index")) > 0, F.concat(F.lit("Names in this character's story so far, most distinctive first: "), _joined(get("@index"), ", "), F.lit(".")))


# Archives and what is left of them.


@family("legacy_(noprev|onlyprev)", "blocks:@text:legacy_full")
def _(m, get, layout):
    last = F.col("boundary") - 1
    return _rendered(get("blocks:@text:legacy_full"), lambda c: (c != last) if m[1] == "noprev" else (c == last))


@family("legacy_r([0-9]+)", "blocks:@text:legacy_full")
def _(m, get, layout):
    return _recent(get("blocks:@text:legacy_full"), int(m[1]))


@family("legacy_nofill", "blocks:@text:legacy_full")
def _(m, get, layout):
    return _rendered(get("blocks:@text:legacy_full"), edit=t.drop_filler)


@family("legacy_(inter|nointer)", "blocks:@text:legacy_full", "others:@text:legacy_full")
def _(m, get, layout):
    named = get("others:@text:legacy_full")
    chosen = lambda text: F.filter(F.split(t.flat(text), t.SENTENCE_END), lambda s: F.try_element_at(named, s) == F.lit(m[1] == "inter"))
    return _rendered(get("blocks:@text:legacy_full"), edit=lambda text: t.drop_filler(_joined(chosen(text), " ")))


@family("legacy_full_rr", "blocks:@text:legacy_full", "@presence")
def _(m, get, layout):
    return F.when(_known(get("@presence")), _rendered(get("blocks:@text:legacy_full")))


@family("(legacy_full|renote_ent|renote_x)_pres", "blocks:{1}", "@presence")
def _(m, get, layout):
    there = F.transform(F.filter(get("@presence"), lambda p: p["rating"] == 1), lambda p: p["chapter"])
    return F.when(_known(get("@presence")), _rendered(get(f"blocks:{m[1]}"), lambda c: F.array_contains(there, c)))


def _known(presence: Column) -> Column:
    """Whether presence is known of every chapter before the boundary."""
    return F.size(F.array_distinct(F.transform(F.filter(presence, lambda p: p["chapter"] < F.col("boundary")), lambda p: p["chapter"]))) == F.col("boundary")


@family("legacy_match", "blocks:@text:legacy_full", "@view:chapnotes/plain")
def _(m, get, layout):
    parts, view = get("blocks:@text:legacy_full"), get("@view:chapnotes/plain")
    q_of = F.create_map(*[F.lit(x) for q, text in layout.questions.items() for x in (text, q)])
    q = lambda b: F.try_element_at(q_of, t.strip(F.substring(b["head"], len("Question: ") + 1, 1 << 30)))
    asked = lambda b: b["head"].startswith("Question:") & q(b).isNotNull()
    size = lambda b: t.word_count(F.coalesce(F.get(F.transform(F.filter(F.try_element_at(view, q(b)), lambda x: x["chapter"] == b["chapter"]), lambda x: x["text"]), F.lit(0)), F.lit("")))
    cut = lambda b: F.struct(b["head_no"].alias("head_no"), b["chapter"].alias("chapter"), _joined(F.slice(t.words(F.regexp_replace(b["text"], t.FILLER, "")), F.lit(1), size(b)), " ").alias("text"))
    body = F.filter(F.transform(F.filter(parts, lambda b: b["chapter"].isNotNull() & asked(b)), cut), lambda b: b["text"] != "")
    heads = F.transform(F.filter(parts, lambda b: b["chapter"].isNull()), lambda h: F.struct(h["head"].alias("head"), asked(h).alias("asked"), F.filter(body, lambda b: b["head_no"] == h["head_no"]).alias("body")))
    shown = F.filter(heads, lambda h: ~h["asked"] | (F.size(h["body"]) > 0))
    out = _joined(F.transform(shown, lambda h: F.concat(h["head"], F.when(h["asked"], F.concat(F.lit("\n\n"), _joined(F.transform(h["body"], lambda b: _snippet(b, b["text"])), "\n"))).otherwise(""))), "\n\n")
    return F.when(F.coalesce(F.size(F.array_distinct(F.transform(F.flatten(F.map_values(view)), lambda x: x["chapter"]))), F.lit(0)) >= F.col("boundary"), out)


# Chapter notes.


@family("(chapnotes(?:_h|_h_long)?)", "@view:{1}/plain")
def _(m, get, layout):
    view = get(f"@view:{m[1]}/plain")
    return F.when(_complete(view), _notes(view, layout))


@family("(chapnotes_h_long)_r([0-9]+)", "blocks:{1}")
def _(m, get, layout):
    return _recent(get(f"blocks:{m[1]}"), int(m[2]))


@family("(chapnotes(?:_h_long)?)_s1", "@view:{1}/plain")
def _(m, get, layout):
    view = get(f"@view:{m[1]}/plain")
    return F.when(_complete(view), _notes(view, layout, t.first_sentences))


@family("renote", "@view:renote/plain")
def _(m, get, layout):
    view = get("@view:renote/plain")
    return F.when(_complete(view) & (F.size(_early(F.flatten(F.map_values(view)))) == F.col("boundary") * len(layout.questions)), _notes(view, layout, t.strip, empty=True))


@family("renote_nofill", "renote", "@view:renote/plain")
def _(m, get, layout):
    return F.when(get("renote").isNotNull(), _notes(get("@view:renote/plain"), layout, t.clean_notes))


@family("renote_nofill_s1", "@view:renote/plain")
def _(m, get, layout):
    view = get("@view:renote/plain")
    return F.when(_complete(view), _notes(view, layout, lambda text: t.first_sentences(t.clean_notes(text))))


# Rated sentences.


@family("renote_ent(4?)", "@view:renote_ent/rated{1}")
def _(m, get, layout):
    view = get(f"@view:renote_ent/rated{m[1]}")
    return F.when(_complete(view), _notes(view, layout))


@family("renote_x(?:_sec([0-9]+))?", "@view:renote_x/rated")
def _(m, get, layout):
    view = get("@view:renote_x/rated")
    return F.when(_complete(view), _archive(view, layout, None if m[1] is None else int(m[1])))


@family("renote_x_named", "@view:renote_x/named")
def _(m, get, layout):
    return F.when(_complete(get("@view:renote_x/named")), _archive(get("@view:renote_x/named"), layout))


@family("renote_xs", "@view:renote_x/rated", "@view:renote_brief_x/rated")
def _(m, get, layout):
    view, brief = get("@view:renote_x/rated"), get("@view:renote_brief_x/rated")
    spoken = layout.spoken
    own, other = F.coalesce(F.try_element_at(view, F.lit(spoken)), F.array().cast(ENTRY)), F.coalesce(F.try_element_at(brief, F.lit(spoken)), F.array().cast(ENTRY))
    here = _chapters(view)
    fresh = F.filter(other, lambda x: F.array_contains(here, x["chapter"]))
    kept = F.filter(own, lambda x: ~F.exists(fresh, lambda y: y["chapter"] == x["chapter"]))
    mixed = F.map_concat(F.map_filter(view, lambda k, _: k != spoken), F.create_map(F.lit(spoken), F.concat(kept, fresh)))
    return F.when(_complete(view), _archive(mixed, layout))


@family("renote_(low|brief|brieflow)_x_sec([0-9]+)", "@view:renote_{1}_x/rated")
def _(m, get, layout):
    view = get(f"@view:renote_{m[1]}_x/rated")
    return F.when(_complete(view), _archive(view, layout, int(m[2])))


@family("renote_([a-z0-9]+)_x", "@view:renote_{1}_x/rated")
def _(m, get, layout):
    view = get(f"@view:renote_{m[1]}_x/rated")
    return F.when(_complete(view), _archive(view, layout))


@family("legacy_full_xf(?:_sec([0-9]+))?", "@view:legacy_xf/rated", "@has:legacy_xf")
def _(m, get, layout):
    view = F.coalesce(get("@view:legacy_xf/rated"), F.create_map().cast(f"map<string, {ENTRY}>"))
    return F.when(get("@has:legacy_xf"), _archive(view, layout, None if m[1] is None else int(m[1])))


# Claims and ledgers.


@family("(claims(?:_h)?)", "@claims:{1}")
def _(m, get, layout):
    return _claims(get(f"@claims:{m[1]}"), layout)


@family("(claims(?:_h)?)_r([0-9]+)", "@claims:{1}")
def _(m, get, layout):
    return _claims(_newest(get(f"@claims:{m[1]}"), int(m[2])), layout)


@family("claims_(noprev|onlyprev)", "@claims:claims")
def _(m, get, layout):
    last = F.col("boundary") - 1
    return _claims(F.filter(get("@claims:claims"), lambda r: (r["chapter"] != last) if m[1] == "noprev" else (r["chapter"] == last)), layout)


@family("claims_(inter|nointer)", "@claims:claims", "others:@claims:claims")
def _(m, get, layout):
    named = get("others:@claims:claims")
    return _claims(F.filter(get("@claims:claims"), lambda r: F.try_element_at(named, r["text"]) == F.lit(m[1] == "inter")), layout)


@family("claims_([a-z]+)", "@claims:claims")
def _(m, get, layout):
    short = [c.split("/")[0].lower() for c in layout.categories]
    if m[1] not in short:
        raise ValueError(f"no category {m[1]}")
    return _claims(get("@claims:claims"), layout, short.index(m[1]))


@family("ledger_(full|c[0-9]+)", "@ledger")
def _(m, get, layout):
    chapters = F.filter(get("@ledger"), lambda x: x["chapter"] < F.col("boundary"))
    some = (lambda x: x["claims"]) if m[1] == "full" else (lambda x: F.slice(x["claims"], 1, int(m[1][1:])))
    text = lambda x: F.concat(F.lit("Chapter "), (x["chapter"] + 1).cast("string"), F.lit(":\n"), _joined(F.transform(some(x), lambda c: F.concat(F.lit("- "), c)), "\n"))
    return F.when(get("@ledger").isNotNull(), _joined(F.transform(chapters, text), "\n\n"))


@family("(v2|second|legacy|legacy_full|summary|summary_[a-z0-9]+)", "@text:{1}")
def _(m, get, layout):
    return get(f"@text:{m[1]}")


# Resolution ---------------------------------------------------------------------------------------------------------------


def _needs(name: str, layout: Layout) -> list[str]:
    if name.startswith("@"):
        return []
    if name.startswith("blocks:"):
        return [name[7:]]
    if name.startswith("others:"):
        return [name[7:], "@forms"] if name[7:].startswith("@claims:") else [f"blocks:{name[7:]}", "@forms"]
    rule, m = _rule(name)
    return list(COMBOS[name]) if name in COMBOS else rule.needs(m, layout)


def _rule(name: str) -> tuple[Family, re.Match]:
    for rule in _RULES:
        if m := re.fullmatch(rule.pattern, name):
            return rule, m
    raise ValueError(f"no family makes {name}")


def resolve(conditions: Iterable[str], layout: Layout | None = None) -> list[str]:
    """Everything that the conditions need, and they themselves, parents first. Names that begin with @ are read from the sources."""
    layout, out = layout or _own_layout(), {}

    def visit(name: str, above: tuple[str, ...]) -> None:
        if name in above:
            raise ValueError(f"{name} needs itself")
        if name not in out:
            for need in _needs(name, layout):
                visit(need, (*above, name))
            out[name] = None

    for c in conditions:
        visit(c, ())
    return list(out)


# Inputs -------------------------------------------------------------------------------------------------------------------


def _texts(src: Sources, named: list[str]) -> DataFrame:
    own = lambda s, c: F.when(F.col("source") == s, F.col(c))
    cols = [F.min_by(own(s, "text"), own(s, "pos")).alias(f"@text:{s}") for s in named]
    return src.texts.where(F.col("source").isin(named)).groupBy(*KEYS).agg(*cols)


def _rated(src: Sources, named: list[str]) -> DataFrame:
    own = lambda s: F.array_sort(F.collect_list(F.when(F.col("source") == s, F.struct("pos", "text", "rating"))))
    return src.rated.where(F.col("source").isin(named)).groupBy(*KEYS).agg(*[F.when(F.size(own(s)) > 0, own(s)).alias(f"@rated:{s}") for s in named])


HOW = {
    "plain": lambda: F.col("text"),
    "rated": lambda: F.when(F.col("rating") == 5, F.col("text")),
    "rated4": lambda: F.when(F.col("rating") >= 4, F.col("text")),
    "named": lambda: F.when(F.col("rating") == 5, t.name_subject(F.col("text"), F.col("name"))),
}


def _views(src: Sources, named: list[str]) -> DataFrame:
    """(book, label, @view:source/how map<q, entries>): records as texts by chapter and question."""
    pairs = [(v, *v.split("/")) for v in named]
    wanted = F.filter(F.array(*[F.when(F.col("source") == s, F.struct(F.lit(v).alias("view"), HOW[how]().alias("text"))) for v, s, how in pairs]), lambda x: x.isNotNull())
    rows = src.records.where(F.col("source").isin([s for _, s, _ in pairs])).select("book", "label", F.col("chapter_index").cast("int").alias("chapter"), "q", "pos", F.explode(wanted).alias("x"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("x.text").alias("text")))), lambda x: x["text"]), " ")
    rows = rows.groupBy("book", "label", "chapter", "q", F.col("x.view").alias("view")).agg(text.alias("text"))

    def as_map(entries: Column) -> Column:
        of = lambda q: F.array_sort(F.transform(F.filter(entries, lambda e: e["q"] == q), lambda e: F.struct(e["chapter"].alias("chapter"), e["text"].alias("text"))))
        return F.when(F.size(entries) > 0, F.map_from_entries(F.transform(F.array_distinct(F.transform(entries, lambda e: e["q"])), lambda q: F.struct(q.alias("q"), of(q).alias("e")))))

    lists = [F.collect_list(F.when(F.col("view") == v, F.struct("q", "chapter", "text"))).alias(v) for v in named]
    return rows.groupBy("book", "label").agg(*lists).select("book", "label", *[as_map(F.col(f"`{v}`")).alias(f"@view:{v}") for v in named])


def _distinct_claims(src: Sources, keys: DataFrame, source: str) -> DataFrame:
    """(KEYS, @claims:source): the claims rated 5 before each boundary in book order, without those that resemble an earlier one of their category."""
    rows = src.records.where((F.col("source") == source) & (F.col("rating") == 5)).select("book", "label", F.col("chapter_index").cast("int").alias("chapter_index"), "q", "pos", "text")
    seen = rp.as_of(rows, keys, ["book", "label"])
    order = Window.partitionBy(*KEYS).orderBy("chapter_index", "pos", "q", "text")
    seen = seen.withColumn("place", F.row_number().over(order))
    group = [*KEYS, "q"]
    vectors = rp.tfidf(seen, group, ["place"], "text")
    plain = seen.join(vectors, [*group, "place"], "left_anti").groupBy(*group, "text").agg(F.min("place").alias("place")).select(*group, "place")
    kept = rp.greedy_distinct(vectors, group, "place", "v", 0.9).select(*group, "place").unionByName(plain)
    claim = F.struct("place", F.col("chapter_index").alias("chapter"), "q", "text")
    return seen.join(kept, [*group, "place"]).groupBy(*KEYS).agg(F.array_sort(F.collect_list(claim)).alias(f"@claims:{source}"))


def _ledger(src: Sources) -> DataFrame:
    """Claims of each chapter, in turn from its sections."""
    rows = src.records.where("source = 'ledger'").groupBy("book", "label", F.col("chapter_index").cast("int").alias("chapter"))
    rows = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "q_no", "text"))), lambda x: x["text"]).alias("claims"))
    return rows.groupBy("book", "label").agg(F.array_sort(F.collect_list(F.struct("chapter", "claims"))).alias("@ledger"))


def _presence(src: Sources) -> DataFrame:
    return src.records.where("source = 'presence'").groupBy("book", "label").agg(F.collect_list(F.struct(F.col("chapter_index").cast("int").alias("chapter"), "rating")).alias("@presence"))


# Fixed value: a run of capitalised words within a sentence, with titles and particles.
NAME_RUN = r"(?U)(?<=[a-z,;:’'\"] )((?:(?:Dr|Mr|Mrs|Ms|St)\. )?[A-Z][\w’'-]+(?: (?:of |de |van |von |the )?[A-Z][\w’'-]+)*)"


def _index(src: Sources, keys: DataFrame, most: int = 40) -> DataFrame:
    """(KEYS, @index): names in a label's notes before a boundary that are no principals', the most distinctive first."""
    notes = src.records.where("source = 'renote'").select("book", "label", F.col("chapter_index").cast("int").alias("chapter_index"), "q_no", t.clean_notes(F.col("text")).alias("text")).where("text <> ''")
    notes = rp.ordered_text(notes.withColumn("text", F.concat(F.lit("- "), "text")), ["book", "label", "chapter_index"], ["q_no"], "text", "\n")
    found = notes.select("book", "label", "chapter_index", F.posexplode(F.regexp_extract_all("text", F.lit(NAME_RUN), F.lit(1))).alias("at", "found"))
    found = found.select("book", "label", "chapter_index", "at", F.regexp_replace("found", "[’']s$", "").alias("entity"))
    counts = rp.as_of(found, keys.select("book", "boundary").distinct(), ["book"]).groupBy(*KEYS, "entity").agg(F.count("*").alias("m"), F.min(F.struct("chapter_index", "at")).alias("first"))
    principal = src.aliases.where("kind = 'principal'").groupBy("book").agg(F.countDistinct("label").alias("k"), F.array_distinct(F.flatten(F.collect_list(F.split("alias", " ")))).alias("words"))
    total = F.sum("m").over(Window.partitionBy("book", "boundary", "entity"))
    scored = counts.withColumn("_total", total).join(principal, "book").withColumn("score", F.col("m") * F.col("m") / (F.col("m") + (F.col("_total") - F.col("m")) / F.greatest(F.col("k") - 1, F.lit(1))))
    fine = (F.col("m") >= 2) & (F.length("entity") > 2) & ~F.arrays_overlap(F.split(F.replace("entity", F.lit("."), F.lit("")), " "), "words")
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("score"), "first"))
    top = scored.where(fine).withColumn("rank", rank).where(F.col("rank") <= most)
    return top.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "entity"))), lambda x: x["entity"]).alias("@index"))


def _gender(src: Sources, keys: DataFrame) -> DataFrame:
    sheets = src.texts.where("source in ('v2', 'second')").join(keys, KEYS, "left_semi").select("book", "label", "text")
    return names.genders(sheets).select("book", "label", F.col("gender").alias("@gender"))


def build(keys: DataFrame, src: Sources, conditions: Iterable[str]) -> DataFrame:
    """(condition, book, boundary, label, text, words) of the wanted conditions at the keys (book, boundary, label).

    A condition gives no row where its family has no text: an absent source, chapters that are missing from notes, a section that isn't there. Unknown names
    raise ValueError before anything is read.
    """
    conditions = list(dict.fromkeys(conditions))
    order = resolve(conditions, src.layout)
    of = lambda kind: [n.split(":", 1)[1] for n in order if n.startswith(f"@{kind}:")]
    keys = keys.select("book", F.col("boundary").cast("int").alias("boundary"), "label").distinct()
    joins: list[tuple[DataFrame, list[str]]] = []
    if named := of("text"):
        joins.append((_texts(src, named), KEYS))
    if named := of("rated"):
        joins.append((_rated(src, named), KEYS))
    if named := of("view"):
        joins.append((_views(src, named), ["book", "label"]))
    joins += [(_distinct_claims(src, keys, s), KEYS) for s in of("claims")]
    joins += [(src.records.where(F.col("source") == s).select("book").distinct().withColumn(f"@has:{s}", F.lit(True)), ["book"]) for s in of("has")]
    for leaf, make, on in (("@ledger", lambda: _ledger(src), ["book", "label"]), ("@presence", lambda: _presence(src), ["book", "label"]), ("@index", lambda: _index(src, keys), KEYS), ("@gender", lambda: _gender(src, keys), ["book", "label"])):
        if leaf in order:
            joins.append((make(), on))
    if "@forms" in order:
        joins.append((itemplan.books(src.aliases).select("book", F.struct("labels", "forms", "key").alias("@forms")), ["book"]))
    rows = keys
    for other, on in joins:
        rows = rows.join(other, on, "left")
    get = lambda name: F.col(f"`{name}`")
    for s in of("claims"):
        empty = F.array().cast("array<struct<place: int, chapter: int, q: string, text: string>>")
        rows = rows.withColumn(f"@claims:{s}", F.coalesce(get(f"@claims:{s}"), empty))
    # One level at a time: what several conditions share is a column of its own.
    depth: dict[str, int] = {}
    for name in order:
        depth[name] = 0 if name.startswith("@") else 1 + max((depth[n] for n in _needs(name, src.layout)), default=0)
    for level in range(1, max(depth.values(), default=0) + 1):
        rows = rows.withColumns({n: _made(n, get, src.layout) for n in order if depth[n] == level})
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), get(c).alias("text")) for c in conditions]))
    out = rows.select(*KEYS, each.alias("x")).select("x.condition", *KEYS, "x.text").where("text is not null")
    return out.withColumn("words", t.word_count(F.col("text")))


def _made(name: str, get: Callable, layout: Layout) -> Column:
    if name.startswith("blocks:"):
        return blocks(get(name[7:]))
    if name.startswith("others:"):
        parent = name[7:]
        if parent.startswith("@claims:"):
            texts = F.transform(get(parent), lambda r: r["text"])
        else:
            texts = F.flatten(F.transform(F.filter(get(f"blocks:{parent}"), lambda b: b["chapter"].isNotNull()), lambda b: F.split(t.flat(b["text"]), t.SENTENCE_END)))
        return naming_others(texts, F.col("label"), get("@forms"))
    rule, m = _rule(name)
    return rule.text(m, get, layout)


def write(reps: DataFrame, path: str) -> None:
    """Write representations by condition; conditions that are there already and not in reps stay."""
    reps.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("condition").parquet(path)


def standard(layout: Layout | None = None, sheets: Iterable[str] = (), generators: Iterable[str] = ()) -> list[str]:
    """The names of the catalogue, with those of generated sheets and of other generators."""
    layout, generators = layout or _own_layout(), list(generators)
    secs = range(len(layout.sections))
    out = ["v2", "legacy", "legacy_full", "legacy_noprev", "legacy_onlyprev", *[f"legacy_r{n}" for n in (1000, 2000, 3000, 6000)], "legacy_nofill", "legacy_inter", "legacy_nointer", "legacy_match", "legacy_full_rr",
           "summary", "summary_h", "claims", "claims_h", "claims_h_r2000", "claims_inter", "claims_nointer", "claims_noprev", "claims_onlyprev", *[f"claims_{c.split('/')[0].lower()}" for c in layout.categories],
           *[f"claims_r{n}" for n in (250, 500, 1000, 2000, 4000)], "renote", "renote_nofill", "renote_nofill_s1", "chapnotes", "chapnotes_s1", "chapnotes_h", "chapnotes_h_long", "chapnotes_h_long_s1", "chapnotes_h_long_r1000", "chapnotes_h_long_r2000",
           "second", "second_nest", "gender", *[f"{s}_sec_{x}" for s in ("v2", "second") for x in SHEET_SECTIONS], "v2_norel", "second_norel", *COMBOS, "index", *[f"{s}+{x}" for s in ("v2", "second") for x in ("index", "last1", "last2")],
           "ledger_full", "ledger_c2", "ledger_c4", "renote_ent", "renote_ent4", "renote_x", *[f"renote_x_sec{i}" for i in secs], "renote_xs", "renote_x_named", *[f"renote_{v}_x_sec{i}" for v in ("low", "brief", "brieflow") for i in secs],
           "legacy_full_xf", *[f"legacy_full_xf_sec{i}" for i in secs], *[f"{s}_pres" for s in ("legacy_full", "renote_ent", "renote_x")], *[f"renote_{g}_x" for g in generators], *[f"summary_{g}" for g in generators], *[f"sheet_csum{g}_fd_flat" for g in ("", *(f"_{g}" for g in generators))]]
    for s in sheets:
        out += [f"sheet_{s}", f"sheet_{s}_flat", *[f"sheet_{s}_no{x}" for x in SHEET_ABLATE], f"sheet_{s}+index"]
    return out
