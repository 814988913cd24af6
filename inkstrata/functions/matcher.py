"""Many names at once: one automaton over all forms of a book, run over a text in a single pass.

Forms belong to groups (a label, the ambiguous names, the protected names). A group's matches are those of one alternation of
its forms, the longest first: from left to right, at each place the longest form that stands there as whole words, without overlap.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks that may not precede a name: it would be the end of another word.
QUOTES = "’'"


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def lowered(text: str) -> str:
    """Lower case with every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Matcher:
    """An automaton over (group, form) pairs. With `any_case` forms match in any capitalisation, and may follow a quote."""

    def __init__(self, forms: Iterable[tuple[int, str]], any_case: bool = False) -> None:
        self.any_case = any_case
        groups: dict[str, set[int]] = {}
        for group, form in forms:
            if form:
                groups.setdefault(lowered(form) if any_case else form, set()).add(group)
        self.size = len(groups)
        if groups:
            self.automaton = ahocorasick.Automaton()
            for form, own in groups.items():
                self.automaton.add_word(form, (len(form), tuple(sorted(own))))
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(group, start, end) of every group's matches, in order of place; at one start the longest first."""
        if not self.size or not text:
            return []
        barred = "" if self.any_case else QUOTES
        met = []
        for last, (size, own) in self.automaton.iter(lowered(text) if self.any_case else text):
            start, end = last + 1 - size, last + 1
            if (start and (_word(text[start - 1]) or text[start - 1] in barred)) or (end < len(text) and _word(text[end])):
                continue
            met += [(start, -end, group) for group in own]
        out, free = [], {}
        for start, end, group in sorted(met):
            if start >= free.get(group, 0):
                out.append((group, start, -end))
                free[group] = -end
        return out


_KEPT: dict[tuple[str, bool], Matcher] = {}
#: Automata that a worker keeps; books come in runs, so a few are enough.
KEEP = 64


def matcher(key: str, forms: pa.Scalar, any_case: bool = False) -> Matcher:
    """The automaton of a list of struct<group, form>, built when a worker first meets its key."""
    if (key, any_case) not in _KEPT:
        if len(_KEPT) >= KEEP:
            _KEPT.clear()
        _KEPT[key, any_case] = Matcher(((f["group"], f["form"]) for f in forms.as_py() or ()), any_case)
    return _KEPT[key, any_case]


HITS = "array<struct<group: int, start: int, end: int>>"


def find(text: Column, key: Column, forms: Column) -> Column:
    """array<struct<group, start, end>>: matches of forms, array<struct<group, form>>; key names the forms. Places count
    characters from 0. Null texts and keys give null."""

    @F.arrow_udf(HITS)
    def found(text: pa.Array, key: pa.Array, forms: pa.Array) -> pa.Array:
        at, parts = [], [array("i"), array("i"), array("i")]
        for i in range(len(text)):  # one text at a time, and numbers in packed arrays
            t, k = text[i].as_py(), key[i].as_py()
            at.append(None if t is None or k is None else len(parts[0]))
            for hit in matcher(k, forms[i]).find(t) if at[-1] is not None else ():
                for part, x in zip(parts, hit, strict=True):
                    part.append(x)
        hits = pa.StructArray.from_arrays([pa.array(np.frombuffer(p, np.int32) if p else np.zeros(0, np.int32)) for p in parts], ["group", "start", "end"])
        return pa.ListArray.from_arrays(pa.array([*at, len(parts[0])], pa.int32()), hits)

    return found.asNondeterministic()(text, key, forms)  # or a filter on what follows would run it again below


def leaks(text: Column, key: Column, forms: Column, group: int, names: Column) -> Column:
    """struct<named boolean, left array<string>>: whether a form of the group is in the text, and matches of names in any
    capitalisation but all lower case. Null texts and keys give null."""

    @F.arrow_udf("struct<named: boolean, left: array<string>>")
    def leak(text: pa.Array, key: pa.Array, forms: pa.Array, names: pa.Array) -> pa.Array:
        named, left = [], []
        for i in range(len(text)):
            t, k = text[i].as_py(), key[i].as_py()
            none = t is None or k is None
            named.append(None if none else any(g == group for g, _, _ in matcher(k, forms[i]).find(t)))
            left.append(None if none else [w for w in (t[a:b] for _, a, b in matcher(k, names[i], True).find(t)) if not w.islower()])
        return pa.StructArray.from_arrays([pa.array(named, pa.bool_()), pa.array(left, pa.list_(pa.string()))], ["named", "left"])

    return leak.asNondeterministic()(text, key, forms, names)
