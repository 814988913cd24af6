"""The item plan against a plain version of its rules, and the matcher against regular expressions."""

import random
import re
import unicodedata

import pytest

from inkstrata.functions.matcher import Matcher, lowered
from inkstrata.operators import itemplan as ip

BOOKS = {
    "b1": {"principal": {"Ana": ["Ana", "Ana Dolabra"], "Kol": ["Kol", "Dolabra Kol"], "Lisk": ["Liska", "Liska Radost"]}, "ambiguous": ["Radost"], "protected": ["Ana-Maria", "Old Kol"]},
    "b2": {"principal": {"Bo": ["Bo"], "Żeń": ["Żeń", "Zofia the Żeń"]}, "ambiguous": [], "protected": []},
}
WORDS = ["Ana", "ANA", "ana", "Kol", "KOL", "Dolabra", "Liska", "LISKA", "liska", "Radost", "Ana Dolabra", "Dolabra Kol", "Liska Radost", "Ana-Maria", "Old Kol", "Bo", "Żeń", "Zofia the Żeń", "Zofia", "zofia", "ŻEŃ",
         "walks", "home", "and", "the", "’Kol", "'Ana", "Anatol", "Bo’s", "Kol.", "night", "Mrs", "&amp;", "<i>so</i>"]


def forms(aliases):
    return sorted({f for a in aliases for f in (unicodedata.normalize("NFC", a), unicodedata.normalize("NFC", a).upper())}, key=lambda f: (-len(f), f))


def pattern(aliases):
    return re.compile(r"(?<![\w’'])(?:" + "|".join(map(re.escape, forms(aliases))) + r")(?!\w)")


def cleaned(text, header):
    head = header or ""
    if head.strip() and text.strip() == head.strip():
        return ""
    if head.strip() and text.startswith(head):
        text = text[len(head):]
    text = re.sub(r"^(?:\s*(?:Chapter\b[^\n]*|\d+)\s*\n)+", "", text)
    return unicodedata.normalize("NFC", re.sub(r"</?i>", "", text).replace("&amp;", "&")).strip()


def plain_units(examples, mode):
    if mode == "section":
        return [(b, c, f"k{k:02d}", cleaned(t, h)) for b, c, k, t, h in examples]
    out, by = [], {}
    for b, c, k, t, h in sorted(examples, key=lambda e: e[:3]):
        by.setdefault((b, c), []).append(cleaned(t, h))
    for (b, c), texts in by.items():
        if mode == "short":
            sentences = [s for s in re.split(r"(?<=[.!?…])[\"”’)\]]*\s+(?=[\"“‘(\[]?[A-Z0-9])", "\n\n".join(texts)) if s.strip()]
            rx = {x: pattern(a) for x, a in BOOKS[b]["principal"].items()}
            names = lambda part: {x for x, r in rx.items() if any(r.search(s) for s in part)}
            i, n = 0, 0
            while i < len(sentences):
                j = next((j for j in range(i + 1, len(sentences) + 1) if names(sentences[i:j]) == set(rx)), None)
                if j is None:
                    break
                low = max(k for k in range(i, j) if names(sentences[k:j]) == set(rx))
                while low > i and len(" ".join(sentences[low:j]).split()) < 20:
                    low -= 1
                span = " ".join(sentences[low:j])
                if 20 <= len(span.split()) <= 150:
                    out.append((b, c, f"t{n:02d}", span))
                    n += 1
                i = j
            continue
        n = 0
        while texts:
            take = 1
            while take < min(3, len(texts)) and sum(len(t.split()) for t in texts[:take]) < 900:
                take += 1
            out.append((b, c, f"w{n:02d}", "\n\n".join(texts[:take])))
            texts, n = texts[take:], n + 1
    return out


def plain_plan(examples, chapters, mode, two, least):
    out = {}
    for book, chapter, unit, text in plain_units(examples, mode):
        file = BOOKS[book]
        rx = {label: pattern(a) for label, a in file["principal"].items()}
        item = f"{book}__c{chapter:03d}__{unit}" + "__two" * two
        named = {label: sorted({c for b, c, t in chapters if b == book and r.search(cleaned(t, None))}) for label, r in rx.items()}
        labels = [label for label, r in rx.items() if len(r.findall(text)) >= least]
        if not text:
            out[item] = ("no_text",)
        elif file["protected"] and pattern(file["protected"]).search(text):
            out[item] = ("protected",)
        elif len(labels) != (2 if two else len(rx)) or (two and sum(bool(r.search(text)) for r in rx.values()) != 2):
            out[item] = ("not_all_named",)
        elif any(sum(c < chapter for c in named[label]) < 2 for label in labels):
            out[item] = ("too_early",)
        else:
            ids = list(range(len(labels)))
            random.Random(f"0:{item}").shuffle(ids)
            order = dict(zip(labels, ids, strict=True))
            spans = sorted((m.start(), -m.end(), label) for label in labels for m in rx[label].finditer(text))
            masked, at, used = "", 0, []
            for start, back, label in spans:
                if start >= at:
                    masked += text[at:start] + f"[CHAR {order[label]}]"
                    at = -back
                    used.append(label)
            masked += text[at:]
            words = {w for a in file["principal"].values() for x in a for w in re.findall(r"[^\W\d_][\w’'-]*", x) if len(w) >= 3 and w[0].isupper() and w not in ip.NO_NAMES}
            leak = re.compile(r"(?<!\w)(?:" + "|".join(sorted(map(re.escape, words), key=len, reverse=True)) + r")(?!\w)", re.I)
            left = [w for w in leak.findall(masked) if not w.islower()] if words else []
            if file["ambiguous"] and pattern(file["ambiguous"]).search(masked):
                out[item] = ("ambiguous",)
            elif left:
                out[item] = ("leftover",)
            else:
                out[item] = (None, labels, order, {x: used.count(x) for x in labels}, masked)
    return out


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(11)

    def text(book):
        lines = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(4, 14))) + "." for _ in range(rng.randint(1, 9))]
        return rng.choice(["", "", "Chapter One\n\n 12 \n", "5\n"]) + " ".join(s[0].upper() + s[1:] for s in lines) + rng.choice(["", "\n", " Ana and Kol and Liska met Bo, Żeń."])

    def plain(book):
        return " ".join(rng.choice(["Ana", "Kol", "Liska", "Bo", "Żeń", "Ana Dolabra", "walks", "home", "so", "and"]) for _ in range(30)) + ". " + " ".join(rng.choice(WORDS[21:26]) for _ in range(5))

    examples = [(b, c, k, rng.choice([text, plain])(b), None) for b in BOOKS for c in range(12) for k in range(3)]
    examples += [("b1", 12, 0, "The Head", "The Head "), ("b1", 12, 1, "The HeadAna, Kol and Liska.", "The Head"), ("b1", 12, 2, "", None), ("b1", 13, 0, " \n", None), ("b9", 1, 0, "Ana", None)]
    chapters = [(b, c, t) for b, c, _, t, _ in examples if t is not None]
    rows = [(b, kind, label, n, a) for b, f in BOOKS.items() for n, (label, names) in enumerate(f["principal"].items()) for kind, a in (("principal", x) for x in names)]
    rows += [(b, kind, None, None, a) for b, f in BOOKS.items() for kind in ("ambiguous", "protected") for a in f[kind]]
    frames = (spark.createDataFrame(examples, "book string, chapter_index int, chunk_index int, text string, header string"),
              spark.createDataFrame(rows, "book string, kind string, label string, label_no int, alias string"),
              spark.createDataFrame(chapters, "book string, chapter_index int, text string"))
    return [e for e in examples if e[0] in BOOKS], chapters, frames


@pytest.mark.parametrize(("mode", "two", "least"), [("section", False, 1), ("section", True, 1), ("section", False, 2), ("section", True, 2), ("window", False, 1), ("short", False, 1)])
def test_the_plan_equals_the_rules(data, mode, two, least):
    examples, chapters, frames = data
    want = plain_plan(examples, chapters, mode, two, least)
    rows = ip.plan(*frames, mode=mode, two=two, min_mentions=least)
    got = {r.item_id: (r.reason,) if r.reason else (None, r.labels, r.answer, r.mentions, r.masked) for r in rows.collect()}
    assert got == want
    if (mode, two, least) == ("section", False, 1):
        assert set(r[0] for r in want.values()) == {None, *ip.REASONS}
    counts = {r.book: r.asDict() for r in ip.counters(rows).collect()}
    for book, row in counts.items():
        own = [v[0] for k, v in want.items() if k.startswith(book)]
        assert row == {"book": book, "units": len(own), "items": own.count(None), **{x: own.count(x) for x in ip.REASONS}}
    assert ip.items(rows).count() == sum(v[0] is None for v in want.values())


def test_leftovers_are_told(data):
    _, _, frames = data
    left = [r.left for r in ip.plan(*frames).where("reason = 'leftover'").collect()]
    assert left and all(w != w.lower() for words in left for w in words) and all(left)


def test_empty_tables(data):
    _, _, (examples, aliases, chapters) = data
    for e, a in ((examples.where("false"), aliases), (examples, aliases.where("false"))):
        for mode in ("section", "window", "short"):
            assert ip.plan(e, a, chapters, mode=mode).count() == 0
    assert {r.reason for r in ip.plan(examples, aliases, chapters.where("false")).collect()} <= {"no_text", "protected", "not_all_named", "too_early"}


def test_matches_are_those_of_each_groups_alternation():
    rng = random.Random(4)
    letters = "ab’' -ÄßI"
    for seed in range(300):
        rng.seed(seed)
        groups = {g: {"".join(rng.choice("abÄ-") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 4))} for g in range(3)}
        text = "".join(rng.choice(letters) for _ in range(40))
        want = {(g, m.start(), m.end()) for g, own in groups.items() for m in re.finditer(r"(?<![\w’'])(?:" + "|".join(map(re.escape, sorted(own, key=lambda f: (-len(f), f)))) + r")(?!\w)", text)}
        assert set(Matcher([(g, f) for g, own in groups.items() for f in own]).find(text)) == want
        loose = {m.span() for m in re.finditer(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(groups[0], key=lambda f: (-len(f), f)))) + r")(?!\w)", text, re.I)}
        assert {(a, b) for _, a, b in Matcher([(0, f) for f in groups[0]], True).find(text)} == loose
    assert Matcher([]).find("text") == [] and Matcher([(0, "")]).find("text") == [] and Matcher([(0, "a")]).find("") == []
    assert len(lowered("İstanbul")) == 8
