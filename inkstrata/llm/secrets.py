"""Secret scanning with a trigram inverted index, in DataFrame operations only.

Each rule's regex is turned into a Boolean query over trigrams that any match must hold. The index keeps, for each
block of row ids and each trigram that some rule asks for, the posting list of rows that hold the trigram; postings are
intersected and united block by block, and the candidates that remain are verified with the full regex. A rule
without mandatory trigrams (a character class alone) is run over every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh

# The kinds of secrets, in order, with Java regexes. `value` is the group whose length counts.
@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    value: int = 0
    least: int = 1
    letters: bool = False  # letters of the pattern stand in either case


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("web", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
BASE = ("assign", "access", "hex")
#: Row ids per block of postings, which bounds every posting list.
BLOCK = 4096
#: More exact strings than this are cut into a clause of the query.
MOST = 64


class _Beyond(ValueError):
    """Syntax outside of the subset that is read here."""


#: Escaped letters that stand for a class or a place, not for themselves.
CLASSES = "dDwWsSbB"


def _parts(regex: str, fold: bool) -> list[set[str] | None]:
    """The pattern as a row of sets of exact strings (a literal part) and None (a part that can be anything).

    Read are literals, escapes, classes, groups, (?i:...), alternatives and quantifiers; other syntax raises _Beyond.
    """
    parts, at = _alternatives(regex, 0, fold)
    if at < len(regex):
        raise _Beyond(regex)
    return parts


def _alternatives(regex: str, at: int, fold: bool) -> tuple[list[set[str] | None], int]:
    rows, row = [], []
    while at < len(regex) and regex[at] != ")":
        if regex[at] == "|":
            rows.append(row)
            row, at = [], at + 1
            continue
        atom, at = _atom(regex, at, fold)
        often = re.compile(r"([*+?]|\{(\d+)(,(\d*))?\})[?+]?").match(regex, at)
        if often:
            at = often.end()
            once = often[1] == "?" or (often[2] and int(often[4] or -1 if often[3] else often[2]) in (0, 1))
            whole = _whole(atom) if once else None
            optional = often[1] == "?" or (often[2] and int(often[2]) == 0)
            atom = [whole | {""} if whole is not None and optional else whole]
        row += atom
    if not rows:
        return row, at
    every = [_whole(r) for r in [*rows, row]]
    return [None if None in every else set().union(*every)], at


def _atom(regex: str, at: int, fold: bool) -> tuple[list[set[str] | None], int]:
    c = regex[at]
    if c == "(":
        either = regex.startswith("(?i:", at)
        skip = 4 if either else 3 if regex.startswith("(?:", at) else 1
        if regex[at + skip : at + skip + 1] == "?":
            raise _Beyond(regex)
        parts, end = _alternatives(regex, at + skip, fold)
        if end >= len(regex):
            raise _Beyond(regex)
        return ([None] if either and not fold else parts), end + 1
    if c == "[":
        return _class(regex, at + 1, fold)
    if c in "*+?{":
        raise _Beyond(regex)
    if c in ".^$":
        return [None], at + 1
    got, at = _character(regex, at)
    return [None if got is None else {got.lower() if fold else got}], at


def _character(regex: str, at: int) -> tuple[str | None, int]:
    """One character or escape: itself, or None for a class or a place."""
    if regex[at] != "\\":
        return regex[at], at + 1
    code = re.compile(r"\\x([0-9A-Fa-f]{2})").match(regex, at)
    if code:
        return chr(int(code[1], 16)), code.end()
    c = regex[at + 1 : at + 2]
    if c and c in CLASSES:
        return None, at + 2
    if not c or c.isalnum():
        raise _Beyond(regex)
    return c, at + 2


def _class(regex: str, at: int, fold: bool) -> tuple[list[set[str] | None], int]:
    """A class, from after its bracket: its characters if they are 8 at most, without ranges."""
    start, plain, members = at, not regex.startswith("^", at), set()
    while at < len(regex) and (regex[at] != "]" or at == start):
        if regex[at] == "[" or regex.startswith("&&", at):
            raise _Beyond(regex)
        if regex[at] == "-" and at > start and regex[at + 1 : at + 2] != "]":
            plain = False
        got, at = _character(regex, at)
        if got is None:
            plain = False
        else:
            members.add(got.lower() if fold else got)
    if at >= len(regex):
        raise _Beyond(regex)
    return [members if plain and len(members) <= 8 else None], at + 1


def _whole(parts: list[set[str] | None]) -> set[str] | None:
    out = {""}
    for part in parts:
        if part is None or len(out) * len(part) > MOST:
            return None
        out = {a + b for a in out for b in part}
    return out


def trigrams(s: str) -> list[str]:
    return sorted({s[i : i + 3] for i in range(len(s) - 2)})


def trigram_query(regex: str, fold: bool) -> list[list[list[str]]]:
    """A conjunction of clauses, each a disjunction of conjunctions of trigrams; empty if nothing is mandatory, or if the regex has
    syntax that isn't read: then the rule scans every text."""
    clauses, run = [], {""}
    try:
        parts = _parts(regex, fold)
    except _Beyond:
        return []
    for part in [*parts, None]:
        if part is not None and len(run) * len(part) <= MOST:
            run = {a + b for a in run for b in part}
            continue
        if run and min(map(len, run)) >= 3:
            clauses.append(sorted({tuple(trigrams(s)) for s in run}))
        run = part if part is not None else {""}
    # An option that asks for a superset of another one is no option of its own.
    return [[list(o) for o in clause if not any(set(p) < set(o) for p in clause)] for clause in clauses]


def _pieces(text: Column, rule: Rule) -> Column:
    """Spans of a rule in text: array<struct<start, kind, end>>, leftmost and non-overlapping, failing ones dropped."""
    found = F.regexp_extract_all(text, F.lit(rule.regex), 0)
    value = found if rule.value == 0 else F.regexp_extract_all(text, F.lit(rule.regex), rule.value)
    gaps = F.split(text, rule.regex, -1)
    order = [r.kind for r in RULES].index(rule.kind)

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["found"])
        spans = F.when(F.length(x["value"]) >= rule.least, F.concat(acc["spans"], F.array(F.struct(start.alias("start"), F.lit(order).alias("kind"), end.alias("end"))))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    none = F.array().cast("array<struct<start: int, kind: int, end: int>>")
    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("found"), value.alias("value"))
    return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("spans")), add, lambda acc: acc["spans"])


def _scan(text: Column, rule: Rule) -> Column:
    """_pieces, but only for a text in which a long enough match can be."""
    none = F.array().cast("array<struct<start: int, kind: int, end: int>>")
    # A literal head and one class: a match is long enough if so many characters of the class follow the head.
    plain = re.fullmatch(r"(\w*)(\[[^\]]+\])\+", rule.regex)
    quick = f"{plain[1]}{plain[2]}{{{rule.least - len(plain[1])}}}" if plain and rule.least > len(plain[1]) else rule.regex
    return F.when(F.regexp_like(text, F.lit(quick)), _pieces(text, rule)).otherwise(none)


def candidates(rows: DataFrame, rules=RULES) -> DataFrame:
    """(rid, rules) from rows(rid, low, text): ids of rows whose postings satisfy a rule's query, with those rules."""
    queries = {r.kind: (trigram_query(r.regex, r.letters), r.letters) for r in rules}
    wanted = sorted({(t, fold) for q, fold in queries.values() for clause in q for option in clause for t in option})
    mark = {w: i for i, w in enumerate(wanted)}
    held = F.filter(F.array(*[F.when(F.contains(F.col("low" if fold else "text"), F.lit(t)), F.lit(i)) for (t, fold), i in mark.items()]), lambda x: x.isNotNull())
    block = F.floor(F.col("rid") / BLOCK).cast("long")
    postings = (rows.select("rid", block.alias("block"), F.explode(held).alias("trigram"))
                .groupBy("block", "trigram").agg(F.array_sort(F.collect_set("rid")).alias("rids")))
    # A block's postings side by side: one map of bounded lists.
    index = postings.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "rids"))).alias("index"))
    empty = F.array().cast("array<bigint>")
    post = lambda t, fold: F.coalesce(F.col("index")[F.lit(mark[t, fold])], empty)
    hits = []
    for kind, (query, fold) in queries.items():
        if not query:
            continue
        whole = None
        for clause in query:
            union = None
            for option in clause:
                both = None
                for t in option:
                    both = post(t, fold) if both is None else F.array_intersect(both, post(t, fold))
                union = both if union is None else F.array_union(union, both)
            whole = union if whole is None else F.array_intersect(whole, union)
        hits.append(_named(whole, kind))
    return index.select(F.explode(F.concat(*hits)).alias("x")).groupBy("x.rid").agg(F.collect_set("x.kind").alias("rules"))


def _named(rids: Column, kind: str) -> Column:
    return F.transform(rids, lambda r: F.struct(r.alias("rid"), F.lit(kind).alias("kind")))


def spans(docs: DataFrame, rules=RULES) -> DataFrame:
    """(rid, body_hash, spans) of docs(doc_id, text): rows that some indexed rule matches."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(row_id(docs).alias("rid"), text.alias("text"), F.lower(text).alias("low"))
    indexed = [r for r in rules if trigram_query(r.regex, r.letters)]
    found = candidates(rows, rules)
    none = F.array().cast("array<struct<start: int, kind: int, end: int>>")
    near = docs.select(row_id(docs).alias("rid"), text.alias("text")).join(found, "rid")
    every = F.concat(*[F.when(F.array_contains("rules", r.kind), _scan(F.col("text"), r)).otherwise(none) for r in indexed])
    return near.select("rid", F.xxhash64("text").alias("body"), every.alias("spans")).where(F.size("spans") > 0).dropDuplicates(["rid", "body"])


def row_id(docs: DataFrame) -> Column:
    """doc_id, or for a null one a hash of the text, so that such rows are indexed too."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")))


def scan(docs: DataFrame, column: str = "spans", rules=RULES) -> DataFrame:
    """docs with an array<struct<start, kind, end>> of all spans by start, then kind (an index into the rules).

    Positions count code points. Null text counts as empty. Rows with null or repeated doc_ids are matched by id and text,
    so each row gets its own text's spans. An empty table gives an empty result; extra columns are carried, and a
    clashing name gets more underscores (the result's last column is the spans).
    """
    rid, body, own = fresh(docs, "_rid"), fresh(docs, "_body"), fresh(docs, column)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = cut(spans(docs, rules)).select(F.col("rid").alias(rid), F.col("body").alias(body), F.col("spans").alias(own))
    free = [r for r in rules if not trigram_query(r.regex, r.letters)]
    none = F.array().cast("array<struct<start: int, kind: int, end: int>>")
    # Scanned below the join, so that the text itself is shuffled only if the caller asks for it.
    plain = fresh(docs, "_plain")
    base = docs.withColumns({rid: row_id(docs), body: F.xxhash64(text), plain: F.concat(none, *[_scan(text, r) for r in free])})
    joined = base.join(found, [rid, body], "left")
    every = F.array_sort(F.concat(F.coalesce(F.col(own), none), F.col(plain)))
    return joined.withColumn(own, every).select(*[F.col(f"`{c}`") for c in docs.columns], own)


def digest(spans: Column, kinds: list[int] | None = None) -> Column:
    chosen = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(kinds))
    names = F.array(*[F.lit(r.kind) for r in RULES])
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """text with each maximal run of overlapping spans replaced by mask; spans are sorted by start."""

    def add(acc: Column, s: Column) -> Column:
        fresh_run = s["start"] >= acc["at"]
        out = F.when(fresh_run, F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    done = F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), add)
    return F.when(F.size(spans) > 0, F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))).otherwise(text)
