"""Every family of the catalogue against a plain version over one small book."""

import random
import re

import pytest

from inkstrata.functions import text as t
from inkstrata.plans import catalogue as cat

LAYOUT = cat.Layout((("Looks", ("body", "mind")), ("Talk", ("dialogue",))), {"body": "How do they look?", "mind": "What do they think?", "dialogue": "How do they talk?"}, ("Physical/Personality", "Dialogue"), "dialogue")
QS = list(LAYOUT.questions)
LABELS = ("Ana", "Kol")
KEYS = [("b", n, x) for n in (1, 2, 4) for x in LABELS] + [("b", 0, "Ana"), ("c", 2, "Bo")]
SENTENCE = re.compile(t.SENTENCE_END)
NEG = re.compile(t.NEGATION)
META, ABOUT, FILLER = re.compile(t.META_WORDS), re.compile(t.ABOUT_TEXT), re.compile(t.FILLER)
SAY = ["Ana runs home.", "She sees Kol by the river Nile.", "The text does not mention her.", "No description is given.", "He walks with Old Tom today.", "It was met by Old Tom again.", "They talk of Old Tom and Bea.", "Kol sleeps.", "", "  Two.  Three! "]


def sentences(text):
    return SENTENCE.split(" ".join(text.split()))


def cleaned(text):
    return " ".join(s for s in sentences(text) if not (NEG.search(s) and META.search(s)) and not ABOUT.search(s))


class Book:
    """Seeded records and texts, as rows and as dictionaries."""

    def __init__(self):
        rng = random.Random(7)
        say = lambda n: " ".join(rng.choice(SAY) for _ in range(rng.randint(0, n)))
        self.records, self.texts, self.rated, self.notes, self.claims, self.ledger = [], [], [], {}, {}, {}
        for source in ("chapnotes", "chapnotes_h", "chapnotes_h_long", "renote"):
            for x in LABELS:
                for c in range(4):
                    if (source, x, c) == ("chapnotes_h", "Kol", 1):
                        continue  # a chapter is missing
                    for i, q in enumerate(QS):
                        text = say(4)
                        self.notes.setdefault((source, x), {}).setdefault(c, {})[q] = text
                        self.records.append((source, "b", x, x, c, q, i, 0, text, None))
        for source in ("renote_ent", "renote_x", "renote_brief_x", "renote_low_x", "renote_brieflow_x", "renote_small_x", "legacy_xf"):
            for x in LABELS:
                for c in range(3 if (source, x) == ("legacy_xf", "Kol") else 4):
                    for i, q in enumerate(QS):
                        some = [(rng.choice(["She ran.", "His hat fell.", "Kol ran.", "They sat."]), rng.randint(3, 5)) for _ in range(rng.randint(1, 4))]
                        self.notes.setdefault((source, x), {}).setdefault(c, {})[q] = some
                        self.records += [(source, "b", x, f"{x} (the old)", c, q, i, k, s, r) for k, (s, r) in enumerate(some)]
        for source in ("claims", "claims_h"):
            for x in LABELS:
                for c in range(4):
                    for k in range(6):
                        text, q, rating = rng.choice(["likes red apples", "likes red apples", "fears Kol at night", "knows Ana well", "sings old songs loudly", "walks far in rain"]) + rng.choice(["", "", " now"]), rng.choice(LAYOUT.categories), rng.choice((4, 5, 5))
                        self.claims.setdefault((source, x), []).append((c, k, q, text, rating))
                        self.records.append((source, "b", x, x, c, q, None, k, text, rating))
        for c in range(4):
            for i, sec in enumerate(("s1", "s2", "s3")):
                for k in range(rng.randint(0, 3)):
                    self.ledger.setdefault(c, []).append((k, i, f"claim {c}{sec}{k}"))
                    self.records.append(("ledger", "b", "Ana", "Ana", c, sec, i, k, f"claim {c}{sec}{k}", None))
        self.there = {(c, x): rng.randint(0, 1) for c in range(4) for x in LABELS}
        self.records += [("presence", "b", x, x, c, None, None, None, None, r) for (c, x), r in self.there.items()]
        sheet = "## Physicality And Personality\nTall. He is he.\n## Relationships\nKol’s kin\n\n## Goals And Motivations\n\nTo run.\n## Dialogue And Voice\nlow\n## History And Circumstances\nold\n## Knowledge And Beliefs\n \nknows\n"
        self.have = {}
        for b, n, x in KEYS:
            archive = "## Looks\n\n" + "\n".join(f"Question: {LAYOUT.questions[q]}\n\n" + "".join(f"<snippet {c}>\n{say(5)}\n" for c in range(n)) for q in QS[:2]) + "-" * 100 + f"\n## Talk\n\nQuestion: {LAYOUT.questions['dialogue']}\n\n" + "".join(f"<snippet {c}>\n{say(3)}\n" for c in range(n))
            for source, text in (("v2", sheet + f"{n}  "), ("second", sheet.replace("He is he", "Her") + "# Voice‑x\nlow\n"), ("summary", f"sum {x} {n}"), ("legacy", "short"), ("legacy_full", archive), ("summary_h", "h"), ("summary_small", "s"), ("sheet_bible", "# Voice\nlow\n## Story so far\nran\n### How others refer to them\nsir\n")):
                if (source, n, x) != ("summary", 2, "Kol"):
                    self.have[source, b, n, x] = text
                    self.texts += [(source, b, n, x, text, 0), (source, b, n, x, "a later row", 1)]
            own = [(rng.choice(["He ran.", "He sat.", "He fell."]), rng.choice((4, 5))) for _ in range(6)]
            self.have["rated", b, n, x] = own
            self.rated += [(source, b, n, x, k, s, r) for source in ("csum_f", "csum_small_f") for k, (s, r) in enumerate(own)]


def parse(archive):
    """[(head, [(chapter, text)])]."""
    out = []
    for line in archive.split("\n"):
        if line.startswith("## ") or line.startswith("Question:"):
            out.append((line, []))
        elif m := re.match(r"<snippet (\d+)>", line):
            if out:
                out[-1][1].append([int(m[1]), ""])
        elif out and out[-1][1]:
            out[-1][1][-1][1] += line + "\n"
    return out


def shown(archive, keep=lambda c: True, edit=lambda x: x):
    parts = []
    for head, body in parse(archive):
        body = [(c, edit(x).strip()) for c, x in body if keep(c)]
        body = "\n".join(f"<snippet {c}>\n{x}" for c, x in body if x)
        if body or head.startswith("## "):
            parts.append(head + (f"\n\n{body}" if body else ""))
    return "\n\n".join(parts)


def recent(archive, budget):
    size = {}
    for _, body in parse(archive):
        for c, x in body:
            size[c] = size.get(c, 0) + len(x.split())
    kept, total = set(), 0
    for c in sorted(size, reverse=True):
        if kept and total + size[c] > budget:
            break
        kept.add(c)
        total += size[c]
    return shown(archive, lambda c: c in kept)


def under_questions(notes, n, edit, empty=False):
    parts = []
    for head, qs in LAYOUT.sections:
        parts.append(f"## {head}")
        for q in qs:
            body = [(c, edit(notes[c][q])) for c in range(n)]
            body = "\n".join(f"<snippet {c}>\n{x}" for c, x in body if x or empty)
            if body or empty:
                parts.append(f"Question: {LAYOUT.questions[q]}\n\n{body}")
    return "\n\n".join(parts)


def archived(notes, n, edit, only=None):
    secs = ["## " + head + "\n\n" + "\n".join(f"Question: {LAYOUT.questions[q]}\n\n" + "".join(f"<snippet {c}>\n{edit(notes.get(c, {}).get(q, []))}\n" for c in range(n)) for q in qs) for i, (head, qs) in enumerate(LAYOUT.sections) if only in (None, i)]
    return ("-" * 100 + "\n").join(secs).strip()


def best(least=5):
    return lambda some: " ".join(s for s, r in some if r >= least)


def listed(rows, only=None):
    return "\n\n".join(f"### {q}\n" + ("\n".join(f"- {x}" for _, c, x in rows if c == q) or "- No information.") for q in LAYOUT.categories if only in (None, q))


def distinct_claims(rows, n):
    """Statements of one word set are alike, others aren't, in this fixture."""
    out, seen = [], {}
    for c, _, q, x, r in sorted(rows):
        if c < n and r == 5:
            out.append((c, q, x))
    return out, seen


def newest(rows, k):
    out, n = [], 0
    for row in reversed(rows):
        if n + len(row[2].split()) > k:
            break
        out.insert(0, row)
        n += len(row[2].split())
    return out


def others(x, text):
    return any(o != x and re.search(rf"(?<![\w’'])(?:{o}|{o.upper()})(?!\w)", text) for o in LABELS)


@pytest.fixture(scope="module")
def book():
    return Book()


@pytest.fixture(scope="module")
def sources(spark, book):
    texts = spark.createDataFrame(book.texts, "source string, book string, boundary int, label string, text string, pos int")
    records = spark.createDataFrame(book.records, "source string, book string, label string, name string, chapter_index int, q string, q_no int, pos int, text string, rating int")
    rated = spark.createDataFrame(book.rated, "source string, book string, boundary int, label string, pos int, text string, rating int")
    aliases = spark.createDataFrame([("b", "principal", x, i, x) for i, x in enumerate(LABELS)] + [("c", "principal", "Bo", 0, "Bo")], "book string, kind string, label string, label_no int, alias string")
    return cat.Sources(texts, records, aliases, rated, LAYOUT)


@pytest.fixture(scope="module")
def built(spark, sources):
    keys = spark.createDataFrame(KEYS, "book string, boundary int, label string")
    wanted = cat.standard(LAYOUT, ["bible"], ["small"])
    out = {}
    for i in range(0, len(wanted), 24):
        for r in cat.build(keys, sources, wanted[i : i + 24]).collect():
            assert r.words == len(r.text.split())
            assert out.setdefault((r.condition, r.book, r.boundary, r.label), r.text) is r.text
    return out


def want(book, kept):
    """The same by plain rules; `kept` are the claims that the similarity step leaves, tested by itself."""
    out = {}
    for b, n, x in KEYS:
        def put(name, text, key=(b, n, x)):
            if text is not None:
                out[name, *key] = text

        have = lambda s, k=(b, n, x): book.have.get((s, *k))
        for s in ("v2", "second", "summary", "summary_h", "summary_small", "legacy", "legacy_full"):
            put(s, have(s))
        nested = lambda s: re.sub(r"(?m)^(#+) ", r"#\1 ", s).replace("‑", "-").replace(" ", " ")
        put("second_nest", nested(have("second")))
        put("sheet_bible_flat", have("sheet_bible"))
        put("sheet_bible", nested(have("sheet_bible")))
        for short, head in cat.SHEET_ABLATE.items():
            put(f"sheet_bible_no{short}", "".join(p for p in re.split(r"(?m)^(?=#+ )", nested(have("sheet_bible"))) if not re.match(r"(?i)#+\s*" + head, p.strip())))
        for s in ("v2", "second"):
            parts = dict((h.strip(), y.strip()) for h, y in re.findall(r"(?ms)^## (.+?)\n(.*?)(?=^## |\Z)", have(s)))
            for short, head in cat.SHEET_SECTIONS.items():
                if head in parts:
                    put(f"{s}_sec_{short}", f"## {head}\n{parts[head]}")
            put(f"{s}_norel", "\n\n".join(f"## {h}\n{y}" for h, y in parts.items() if h != "Relationships"))
        full = have("legacy_full")
        put("legacy_noprev", shown(full, lambda c: c != n - 1))
        put("legacy_onlyprev", shown(full, lambda c: c == n - 1))
        for k in (1000, 2000, 3000, 6000):
            put(f"legacy_r{k}", recent(full, k))
        unfilled = lambda y: FILLER.sub("", y)
        put("legacy_nofill", shown(full, edit=unfilled))
        if b == "b":
            for name, to in (("inter", True), ("nointer", False)):
                put(f"legacy_{name}", shown(full, edit=lambda y, to=to: unfilled(" ".join(s for s in sentences(y) if others(x, s) == to))))
        else:
            put("legacy_inter", shown(full, edit=lambda y: ""))
            put("legacy_nointer", shown(full, edit=unfilled_flat))
        if len(book.notes.get(("chapnotes", x), {})) >= n:
            text = []
            for head, body in parse(full):
                q = next((q for q, y in LAYOUT.questions.items() if head == f"Question: {y}"), None)
                if q is None:
                    text.append(head)
                    continue
                size = lambda c, q=q: len(book.notes.get(("chapnotes", x), {}).get(c, {}).get(q, "").split())
                body = [(c, " ".join(unfilled(y).split()[: size(c)])) for c, y in body]
                body = "\n".join(f"<snippet {c}>\n{y}" for c, y in body if y)
                if body:
                    text.append(head + "\n\n" + body)
            put("legacy_match", "\n\n".join(text))
        fd = " ".join(dict.fromkeys(s for s, r in book.have["rated", b, n, x] if r == 5))
        put("sheet_csum_fd_flat", fd)
        put("sheet_csum_small_fd_flat", fd)
        m, f = (sum(len(re.findall(p, book.have[s, b, k, x])) for s in ("v2", "second") for bb, k, y in KEYS if (bb, y) == (b, x)) for p in (t.MALE, t.FEMALE))
        put("gender", "Gender: male." if m > 0.65 * (m + f) else "Gender: female." if f > 0.65 * (m + f) else None)
        for name, parts in cat.COMBOS.items():
            texts = [out.get((c, b, n, x)) for c in parts]
            if all(texts):
                put(name, "\n\n".join(f"#### {cat.TITLES[c]}\n{y}" for c, y in zip(parts, texts, strict=True)))
        for s in ("claims", "claims_h"):
            rows = kept.get((s, b, n, x), [])
            put(s, listed(rows))
            if s == "claims_h":
                put("claims_h_r2000", listed(newest(rows, 2000)))
                continue
            for k in (250, 500, 1000, 2000, 4000):
                put(f"claims_r{k}", listed(newest(rows, k)))
            put("claims_noprev", listed([r for r in rows if r[0] != n - 1]))
            put("claims_onlyprev", listed([r for r in rows if r[0] == n - 1]))
            put("claims_inter", listed([r for r in rows if others(x, r[2])]))
            put("claims_nointer", listed([r for r in rows if not others(x, r[2])]))
            for q in LAYOUT.categories:
                put("claims_" + q.split("/")[0].lower(), listed(rows, q))
        if (b, x) == ("b", "Ana"):
            for name, k in (("full", None), ("c2", 2), ("c4", 4)):
                put(f"ledger_{name}", "\n\n".join(f"Chapter {c + 1}:\n" + "\n".join(f"- {y}" for *_, y in sorted(book.ledger[c])[:k]) for c in sorted(book.ledger) if c < n))
        if b == "b":
            for i, head in enumerate([None, *range(len(LAYOUT.sections))]):
                put("legacy_full_xf" + (f"_sec{head}" if i else ""), archived(book.notes.get(("legacy_xf", x), {}), n, best(), head))
        known = b == "b" or n == 0
        whole = lambda s: n > 0 and all(c in book.notes.get((s, x), {}) for c in range(n))
        if known and b == "b":
            put("legacy_full_rr", shown(full))
            put("legacy_full_pres", shown(full, lambda c: book.there[c, x] == 1))
        first = lambda y: " ".join(sentences(y)[:1])
        for s in ("chapnotes", "chapnotes_h", "chapnotes_h_long"):
            if whole(s):
                put(s, under_questions(book.notes[s, x], n, lambda y: y))
                if s != "chapnotes_h":
                    put(f"{s}_s1", under_questions(book.notes[s, x], n, first))
                if s == "chapnotes_h_long":
                    for k in (1000, 2000):
                        put(f"{s}_r{k}", recent(out[s, b, n, x], k))
        if whole("renote"):
            put("renote", under_questions(book.notes["renote", x], n, str.strip, True))
            put("renote_nofill", under_questions(book.notes["renote", x], n, cleaned))
            put("renote_nofill_s1", under_questions(book.notes["renote", x], n, lambda y: first(cleaned(y))))
        if whole("renote_ent"):
            for name, least in (("", 5), ("4", 4)):
                put(f"renote_ent{name}", under_questions(book.notes["renote_ent", x], n, best(least)))
        if whole("renote_x"):
            own = book.notes["renote_x", x]
            put("renote_x", archived(own, n, best()))
            named = lambda some: " ".join(re.sub(r"^(?:Her|His)\b", f"{x}’s", re.sub(r"^(?:She|He)\b", x, s)) for s, r in some if r == 5)
            put("renote_x_named", archived(own, n, named))
            put("renote_xs", archived({c: own[c] | {"dialogue": book.notes["renote_brief_x", x][c]["dialogue"]} for c in own}, n, best()))
            for i in range(2):
                put(f"renote_x_sec{i}", archived(own, n, best(), i))
                for v in ("low", "brief", "brieflow"):
                    put(f"renote_{v}_x_sec{i}", archived(book.notes[f"renote_{v}_x", x], n, best(), i))
            put("renote_small_x", archived(book.notes["renote_small_x", x], n, best()))
            for s in ("renote_ent", "renote_x"):
                put(f"{s}_pres", shown(out[s, b, n, x], lambda c: book.there[c, x] == 1))
        for s in ("v2", "second"):
            for k in (1, 2):
                last = [c for c in range(max(0, n - k), n) if c in book.notes.get(("chapnotes", x), {})]
                if last:
                    text = [" ".join(y for y in (book.notes["chapnotes", x][c][q] for q in QS) if y) for c in last]
                    put(f"{s}+last{k}", have(s).rstrip() + "\n\n### Latest chapters\n" + "\n".join(f"Chapter {c + 1}: {y or 'Not in this chapter.'}" for c, y in zip(last, text, strict=True)))
    return out


def unfilled_flat(text):
    return FILLER.sub("", " ".join(sentences(text)))


def test_every_family_equals_the_plain_version(spark, book, sources, built):
    keys = spark.createDataFrame(KEYS, "book string, boundary int, label string")
    kept = {}
    for s in ("claims", "claims_h"):
        for r in cat._distinct_claims(sources, keys, s).collect():
            kept[s, r.book, r.boundary, r.label] = [(x.chapter, x.q, x.text) for x in r[f"@claims:{s}"]]
    plain = want(book, kept)
    indexed = {k: v for k, v in built.items() if "index" in k[0]}
    got = {k: v for k, v in built.items() if k not in indexed}
    for k in sorted(plain.keys() | got.keys(), key=str):
        assert got.get(k) == plain.get(k), k
    assert {c for c, *_ in built} == set(cat.standard(LAYOUT, ["bible"], ["small"]))
    run = re.compile(cat.NAME_RUN.removeprefix("(?U)"))
    for b, n, x in KEYS:
        met = {}
        for y in LABELS:
            for c, notes in sorted(book.notes.get(("renote", y), {}).items()):
                if b == "b" and c < n:
                    for name in run.findall("\n".join(f"- {cleaned(notes[q])}" for q in QS if cleaned(notes[q]))):
                        met.setdefault(re.sub("[’']s$", "", name), []).append(y)
        own = {name: (ys.count(x), len(ys) - ys.count(x)) for name, ys in met.items() if ys.count(x) >= 2 and len(name) > 2 and not set(name.split()) & set(LABELS)}
        names = sorted(own, key=lambda e: -(own[e][0] ** 2) / (own[e][0] + own[e][1]))
        for c in ("index", "v2+index", "second+index", "sheet_bible+index"):
            text = indexed.get((c, b, n, x))
            if not names:
                assert text is None
            elif c == "index":
                assert sorted(text.split(": ")[1].rstrip(".").split(", ")) == sorted(names) and text.split(": ")[1].startswith(names[0])
            else:
                assert text == built[c.removesuffix("+index"), b, n, x].rstrip() + "\n\n### Names in the story\n" + indexed["index", b, n, x].split(": ")[1]
    assert len(indexed) >= 4


def test_claims_that_resemble_earlier_ones_go(spark, book, sources):
    keys = spark.createDataFrame([("b", 4, "Ana")], "book string, boundary int, label string")
    (row,) = cat._distinct_claims(sources, keys, "claims").collect()
    rows = [(r.chapter, r.q, r.text) for r in row["@claims:claims"]]
    every = [(c, q, x) for c, _, q, x, r in sorted(book.claims["claims", "Ana"]) if r == 5]
    assert rows == sorted(rows, key=lambda r: every.index(r)) and set(rows) <= set(every)
    for q in LAYOUT.categories:
        own = [x for _, c, x in rows if c == q]
        assert len(own) == len(set(own)) and {x.removesuffix(" now") for x in own} == {x.removesuffix(" now") for _, c, x in every if c == q}


def test_only_what_is_asked_for_is_read(spark, sources):
    keys = spark.createDataFrame(KEYS, "book string, boundary int, label string")
    assert cat.resolve(["legacy_r1000", "legacy_nofill"], LAYOUT) == ["@text:legacy_full", "blocks:@text:legacy_full", "legacy_r1000", "legacy_nofill"]
    plan = cat.build(keys, sources, ["v2"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") <= 2 and "aggregate" not in plan.lower().replace("aggregate [", "")
    with pytest.raises(ValueError, match="no family"):
        cat.build(keys, sources, ["v2", "nonsense"])


def test_conditions_are_replaced_one_by_one(spark, sources, tmp_path):
    keys = spark.createDataFrame(KEYS, "book string, boundary int, label string")
    path = str(tmp_path / "reps")
    cat.write(cat.build(keys, sources, ["v2", "legacy"]), path)
    cat.write(cat.build(keys.where("boundary = 2"), sources, ["legacy"]), path)
    got = spark.read.parquet(path).groupBy("condition").count().collect()
    assert {r["condition"]: r["count"] for r in got} == {"v2": len(KEYS), "legacy": 3}


def test_the_command_line_builds_what_the_catalogue_names(spark, sources, tmp_path):
    from inkstrata.__main__ import main

    for name in ("texts", "records", "aliases"):
        getattr(sources, name).write.parquet(str(tmp_path / name))
    items = [("b", 2, ["Ana", "Kol"], None), ("b", 4, ["Ana"], "leftover")]
    spark.createDataFrame(items, "book string, chapter_index int, labels array<string>, reason string").write.parquet(str(tmp_path / "items"))
    assert main(["reps", "--data", str(tmp_path), "--out", str(tmp_path / "out"), "--conditions", "v2", "ledger_c2"]) == 0
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.condition, r.boundary, r.label) for r in got.collect()) == [("ledger_c2", 2, "Ana"), ("v2", 2, "Ana"), ("v2", 2, "Kol")]
