"""Text functions against plain Python."""

import html
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from inkstrata.functions import text as t
from inkstrata.functions import unicode as u

def value(spark, x, f, kind="string"):
    return spark.createDataFrame([(x,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def packed(text, target):
    """Chunk ends are the sentences at which the words since the last end reach the target."""
    sentences = [x for x in re.split(t.SENTENCE_END, " ".join(text.split())) if x.strip()]
    ends, since = [0], 0
    for k, size in enumerate((len(x.split()) for x in sentences), 1):
        since += size
        if since >= target:
            ends.append(k)
            since = 0
    if since:
        if len(ends) > 1 and since < target // 3:
            ends.pop()
        ends.append(len(sentences))
    return [" ".join(sentences[i:j]) for i, j in zip(ends, ends[1:], strict=False)]


def test_snippets_equal_the_loop(spark):
    rng = random.Random(0)
    texts = ["", "One.", "  A b.\n\nC d!  “E f.” G"] + [" ".join(rng.choice(["Aa", "bb", "cc.", "Dd!", "ee?\"", "\n"]) for _ in range(rng.randint(1, 150))) for _ in range(60)]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").select("i", t.snippets(F.col("x"), 12).alias("s")).collect()
    assert {r.i: r.s for r in got} == {i: packed(x, 12) for i, x in enumerate(texts)}


def test_words(spark):
    assert value(spark, " a  b\nc ", lambda x: t.cut_words(x, 2)) == "a b"
    assert value(spark, " a  b\nc ", lambda x: t.cut_words(x, 2, last=True)) == "b c"
    assert value(spark, " a  b", lambda x: t.cut_words(x, 2)) == " a  b"
    assert value(spark, "", t.word_count) == 0 and value(spark, None, t.word_count) is None


def test_unicode_forms(spark):
    x = "Marysieńka LISKA é"
    assert value(spark, x, u.nfc) == unicodedata.normalize("NFC", x)
    assert value(spark, x, u.fold) == "Marysienka LISKA e"
    assert value(spark, None, u.fold) is None


def test_clean_text(spark):
    x = 'a<!-- c\nd --> <img src="x"> <hr/>b <b>bold</b> 1 &lt; 2 &amp; é <3'
    want = unicodedata.normalize("NFC", html.unescape(re.sub(r"</?[A-Za-z][^<>\n]{0,200}/?>", "", re.sub(r"<hr\s*/?>", "\n", re.sub(r"<img[^<>]*>", "", re.sub(r"(?s)<!--.*?-->|<!--<hr/>", "", x))))))
    assert value(spark, x, u.clean_text) == want


def test_display_names_over_time():
    label = "The Leszy (Eliasz Kowal) / Old Man"
    assert u.display(label, {"Leszy"}) == "The Leszy"
    assert u.display(label, {"Leszy", "Eliasz", "Kowal"}) == "The Leszy (Eliasz Kowal)"
    assert u.display(label, {"Old", "Man"}) == "Old Man"
    assert u.display(label, set()) == "The Leszy"
    assert u.display("the stranger", set()) == "the stranger"


def test_masks_take_the_longest_alias_first():
    got = u.masked("Ana Dolabra met Dolabra Kol. ANA left; Anatole’s Ana", {"A": ["Ana", "Ana Dolabra"], "D": ["Dolabra Kol"]}, {"A": 1, "D": 0})
    assert got["text"] == "[CHAR 1] met [CHAR 0]. [CHAR 1] left; Anatole’s [CHAR 1]" and got["mentions"] == {"A": 3, "D": 1}
    assert u.exchanged("Ana saw Bo", ["Ana"], ["Bo"], ["Ana", "Bo"]) == "Bo saw Ana"
    assert u.remasked("He saw her hand", [{"id": 1, "ref": "A", "possessive": True}, {"id": 0, "ref": "other", "possessive": False}], {"A": "[CHAR 1]"}) == "He saw [CHAR 1]'s hand"


def test_numbered_and_ids(spark):
    assert value(spark, "She gave him hers", u.numbered) == "She⟨0⟩ gave him⟨1⟩ hers⟨2⟩"
    df = spark.createDataFrame([("b__c003__k01", ["x", "y", "z"])], "i string, l array<string>")
    ids = [0, 1, 2]
    random.Random("0:b__c003__k01").shuffle(ids)
    assert df.select(u.shuffled_ids(F.col("i"), F.col("l"))).first()[0] == dict(zip("xyz", ids, strict=True))


def test_name_seen(spark):
    df = spark.createDataFrame([("Mr. Kol", "old Kol went"), ("Kol", "Kola went"), ("the cat", ""), ("D’Arc", "D’Arc!")], "n string, x string")
    assert [r[0] for r in df.select(t.name_seen(F.col("n"), F.col("x"))).collect()] == [True, False, True, True]


@pytest.mark.parametrize(("reply", "want"), [("```json\n{\"a\": 1}\n```", '{"a": 1}'), ("so {\"a\": 1} ok", '{"a": 1}'), ("none", None)])
def test_json_text(spark, reply, want):
    assert value(spark, reply, t.json_text) == want


def test_replies(spark):
    assert value(spark, 'x {"a": 0} y {"a": 1, "b": 0}', lambda x: t.valid_assignment(x, 2)) == {"a": 1, "b": 0}
    assert value(spark, '{"a": 1, "b": 1}', lambda x: t.valid_assignment(x, 2)) is None
    assert [value(spark, x, t.last_rating) for x in ("a 3 then 5.", "15", "", "2/7")] == [5, 1, 1, 2]


def test_sections(spark):
    x = "intro\n## A\nx\ny\n## B\nz\n## A\nlast"
    assert value(spark, x, t.section_map) == {"A": "last", "B": "z"}
    assert value(spark, "# T\n## Voice and tone\nq\n## Other\nr", lambda c: t.drop_section(c, "voice")) == "# T\n## Other\nr"
    assert value(spark, "# A\n## B‑c", t.nest_headings) == "## A\n### B-c"
    assert value(spark, "He ran. His dog", lambda c: t.name_subject(c, F.lit("Kol (K) / X"))) == "Kol ran. His dog"
    assert value(spark, "A b. The text does not mention it. C d.", t.clean_notes) == "A b. C d."
    assert value(spark, "She is tall. Her age is not mentioned. Ok.", t.drop_filler) == "She is tall. Ok."


def test_small_functions(spark):
    assert value(spark, [3, 1, 3], t.citation, "array<int>") == "[Chs. 1, 3]" and value(spark, [2], t.citation, "array<int>") == "[Ch. 2]"
    assert value(spark, "A b. C d. E", t.full_sentences) == "A b. C d."
    assert value(spark, "A b. C d e. F.", lambda c: t.trim_sentences(c, 4)) == "A b."
    assert value(spark, "ch1: x ch12: y ch123: z", t.repair_sources) == "ch001: x ch012: y ch123: z"
    assert value(spark, "“A”  b’s", t.verbatim_form) == '"a" b\'s'
    got = value(spark, "a b [CHAR 1] c d e", lambda c: t.mask_windows(c, 2))
    assert [(m.id, m.context) for m in got] == [(1, "a b c d")]
    assert value(spark, "CHAPTER ONE\n12\nText here", lambda c: t.strip_heading(c, F.lit(None))) == "Text here"
    assert value(spark, "Head", lambda c: t.strip_heading(c, F.lit("Head"))) is None
    # A heading line counts with the blank lines around it, up to 120 characters.
    for text in ("Part " + "x" * 112 + "\nText", "Part " + "x" * 116 + "\nText", "\n" * 112 + "XIV\nText", "\n" * 118 + "XIV\nText", "12" + "\n" * 118 + "Text", "12" + "\n" * 119 + "Text", "BOOK 1\n7\nPart " + "y" * 120 + "\nV\nText", "Text\n7\n"):
        rest = text
        while (m := re.match(t.HEADING, rest)) and len(m[0]) <= 120:
            rest = rest[m.end() :]
        assert value(spark, text, lambda c: t.strip_heading(c, F.lit(None))) == rest.strip()
    assert value(spark, " Head  x", lambda c: t.chapter_context(c, F.lit("Kol"))).startswith("Chapter heading: Head x\nThis chapter is narrated")
    assert value(spark, "claim", lambda c: t.tagged(c, [F.lit("a"), F.lit(None), F.lit("")])) == "claim [a]"
