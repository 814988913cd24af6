"""Text functions that need Python: Unicode forms, entities, and replacements whose matches depend on one another.

All are Arrow-batched scalar UDFs; the plain functions beside them can be used and tested without Spark.
"""

import html
import random
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PRONOUN = re.compile(r"\b(he|she|him|her|his|hers|himself|herself)\b", re.I)


def _each(kind: str, f, structs: bool = False):
    """A pandas UDF that applies f to the values of its columns (structs: its second and third are structs, given as dicts);
    a null in any of them gives null."""

    def make(*cols: Column) -> Column:
        def run(*series: pd.Series):
            # A struct column comes as a data frame.
            plain = [x.to_dict("records") if isinstance(x, pd.DataFrame) else x for x in series]
            out = [None if any(v is None for v in row) else f(*row) for row in zip(*plain, strict=True)]
            if not kind.startswith("struct"):
                return pd.Series(out, dtype=object)
            names = [part.split(":")[0].strip() for part in kind[7:-1].split(", ") if ":" in part]
            return pd.DataFrame({n: pd.Series([None if o is None else o[n] for o in out], dtype=object) for n in names})

        # The annotation tells Spark whether a UDF returns a column or a struct's columns.
        result = pd.DataFrame if kind.startswith("struct") else pd.Series
        if len(cols) == 1:

            @F.pandas_udf(kind)
            def one(a: pd.Series) -> result:
                return run(a)

            return one(*cols)
        if len(cols) == 2:

            @F.pandas_udf(kind)
            def two(a: pd.Series, b: pd.Series) -> result:
                return run(a, b)

            return two(*cols)

        @F.pandas_udf(kind)
        def three(a: pd.Series, b: pd.Series, c: pd.Series) -> result:
            return run(a, b, c)

        @F.pandas_udf(kind)
        def with_structs(a: pd.Series, b: pd.DataFrame, c: pd.DataFrame) -> result:
            return run(a, b, c)

        return (with_structs if structs else three)(*cols)

    return make


def fold_text(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def nfc(text: Column) -> Column:
    return _each("string", lambda t: unicodedata.normalize("NFC", t))(text)


def fold(text: Column) -> Column:
    """Without combining marks."""
    return _each("string", fold_text)(text)


def clean_text(text: Column) -> Column:
    """Markup out (in the JVM), then entities as characters and NFC."""
    from .text import strip_markup

    return _each("string", lambda t: unicodedata.normalize("NFC", html.unescape(t)))(strip_markup(text))


def name_words(name: str) -> set[str]:
    """The folded words of a name that begin with a capital and are no titles."""
    from .text import NAME_TITLES

    bare = {w.strip(".,'’") for w in re.split(r"[\s\"“”]+", fold_text(name))}
    return {w for w in bare if w[:1].isupper()} - set(NAME_TITLES)


def display(label: str, seen: set[str]) -> str:
    """What a label shows while only the words of `seen` are known.

    A label lists variants by slashes, each a base with notes in parentheses. A variant shows its base with the notes that
    are known, or, while the base is not known, its first known note; variants without either are hidden. If all are, the
    first base stands for the label.
    """

    def shown(base: str, notes: list[str]) -> str:
        notes = [n for n in notes if name_words(n) <= seen]
        return base + "".join(f" ({n})" for n in notes) if name_words(base) <= seen else next(iter(notes), "")

    variants = [(re.sub(r"\s*\([^)]*\)", "", v).strip(), [n.strip() for n in re.findall(r"\(([^)]*)\)", v)]) for v in label.split("/")]
    texts = [shown(*v) for v in variants if any(v)]
    return " / ".join(filter(None, texts)) or variants[0][0]


def display_name(label: Column, seen: Column) -> Column:
    """Display name of a label given the array of folded words seen so far."""
    return _each("string", lambda name, words: display(name, set(words)))(label, seen)


def replace_spans(text: str, spans: list[tuple[int, int, str, str]]) -> tuple[str, list[str]]:
    """Replace (start, end, key, replacement) spans from left to right; at one start the longest wins, overlaps are skipped.
    Returns the text and the keys used."""
    out, at, used = [], 0, []
    for start, end, key, new in sorted(spans, key=lambda s: (s[0], s[0] - s[1])):
        if start >= at:
            out += (text[at:start], new)
            used.append(key)
            at = end
    return "".join([*out, text[at:]]), used


def alias_forms(aliases) -> list[str]:
    """Composed aliases and their capitals, longest first."""
    composed = [unicodedata.normalize("NFC", a) for a in aliases]
    return sorted({*composed, *map(str.upper, composed)}, key=lambda form: (-len(form), form))


def alias_regex(aliases) -> re.Pattern:
    """Any alias as whole words; a quote before it doesn't count as a boundary."""
    return re.compile("(?<![\\w’'])(?:%s)(?!\\w)" % "|".join(map(re.escape, alias_forms(aliases))))


_REGEXES: dict[tuple[str, ...], re.Pattern] = {}


def _regex(aliases) -> re.Pattern:
    key = tuple(aliases)
    if key not in _REGEXES:
        _REGEXES[key] = alias_regex(key)
    return _REGEXES[key]


def masked(text: str, aliases: dict[str, list[str]], order: dict[str, int]) -> dict:
    """Every alias as '[CHAR id]': text and mentions by label."""
    spans = [(m.start(), m.end(), label, f"[CHAR {order[label]}]") for label, names in aliases.items() if label in order for m in _regex(names).finditer(text)]
    got, used = replace_spans(text, spans)
    return {"text": got, "mentions": {label: used.count(label) for label in order}}


def mask(text: Column, aliases: Column, order: Column) -> Column:
    """struct<text, mentions> from text, map<label, array<alias>> and map<label, id>."""
    return _each("struct<text: string, mentions: map<string, int>>", lambda t, a, o: masked(t, {k: list(v) for k, v in dict(a).items()}, dict(o)))(text, aliases, order)


def remasked(text: str, edits: list[dict], names: dict[str, str]) -> str:
    """Replace pronouns as well: edits are (number of the pronoun, ref, possessive), names map a ref to its mask."""
    places = list(PRONOUN.finditer(text))
    spans = [(places[e["id"]].start(), places[e["id"]].end(), e["ref"], names[e["ref"]] + ("'s" if e["possessive"] else "")) for e in edits if e["ref"] in names and e["id"] < len(places)]
    return replace_spans(text, spans)[0]


def remask(text: Column, edits: Column, names: Column) -> Column:
    return _each("string", lambda t, e, n: remasked(t, [x if isinstance(x, dict) else x.asDict() for x in e], dict(n)))(text, edits, names)


def exchanged(text: str, a: list[str], b: list[str], names: list[str]) -> str:
    """Every alias of a as b's name and the other way round; names are (a's, b's)."""
    spans = [(m.start(), m.end(), "a", names[1]) for m in _regex(a).finditer(text)] + [(m.start(), m.end(), "b", names[0]) for m in _regex(b).finditer(text)]
    return replace_spans(text, spans)[0]


def exchange(text: Column, a: Column, b: Column) -> Column:
    """exchanged() of texts with struct<forms, name> columns for the two characters."""
    return _each("string", lambda t, x, y: exchanged(t, list(x["forms"]), list(y["forms"]), [x["name"], y["name"]]), structs=True)(text, a, b)


def numbered(text: Column) -> Column:
    """Each third-person pronoun followed by its number in angle brackets."""

    def run(t: str) -> str:
        n = iter(range(len(t)))
        return PRONOUN.sub(lambda m: f"{m[0]}⟨{next(n)}⟩", t)

    return _each("string", run)(text)


def shuffled_ids(item_id: Column, labels: Column, seed: int = 0) -> Column:
    """map<label, id>: ids shuffled by a generator seeded with '<seed>:<item_id>', so items don't influence one another."""

    def run(item: str, names) -> dict[str, int]:
        ids = list(range(len(names)))
        random.Random(f"{seed}:{item}").shuffle(ids)
        return dict(zip(names, ids, strict=True))

    return _each("map<string, int>", run)(item_id, labels)


def archive_blocks(text: str) -> list[dict]:
    """The blocks of an archive sheet: heads are '## ' and 'Question:' lines, blocks start with '<snippet n>'. Every line of a block ends
    with a line break; what precedes the first head or a head's first block belongs to none."""
    out: list[dict] = []
    for n, part in enumerate(re.split(r"(?m)^(?=## |Question:)", text + "\n")[1:]):
        head, _, body = part.partition("\n")
        pieces = re.split(r"(?m)^<snippet (\d+)>.*\n", body)
        out.append({"head_no": n, "head": head, "chapter": None, "text": None})
        out += [{"head_no": n, "head": head, "chapter": int(k), "text": t} for k, t in zip(pieces[1::2], pieces[2::2], strict=True)]
    return out


def blocks(text: Column) -> Column:
    """array<struct<head_no, head, chapter, text>>; a head's own row has neither chapter nor text."""
    return _each("array<struct<head_no: int, head: string, chapter: int, text: string>>", archive_blocks)(text)
