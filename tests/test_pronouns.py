"""Items with masked pronouns against a plain version."""

import json
import re

from inkstrata.functions.unicode import PRONOUN
from inkstrata.plans import pronouns

ALIASES = {"Ana": ["Ana", "Her Grace"], "Kol": ["Kol"], "Bo": ["Bo"]}
TEXTS = {
    "two": "Ana saw Kol. Her hat fell; he took HIS own. Anahe herself left.",
    "long": "Her Grace told him. é Ünshe, she said: hers! Kol’s hat. Bo came.",
    "none": "Ana met Kol.",
    "bad": "Then he ran.",
    "retry": "She met Kol.",
    "empty": "",
}


def test_names_and_pronouns_are_masked_together(spark):
    def make():
        import re as rx

        def client(messages, temperature, max_tokens):
            words = rx.findall(r"(\w+)⟨(\d+)⟩", messages[0]["content"])
            first = rx.match(r"[^\n]*\n([^\n]*)", messages[0]["content"])[1]
            if first.startswith("Then") or (first.startswith("She") and len(messages) == 1):
                text = "[]"
            else:
                ref = {"her": "ana", "his": "Kol", "he": "KOL", "him": "other", "she": "Ana", "herself": "other", "hers": "Ana"}
                text = json.dumps({"pronouns": [{"id": int(k), "ref": ref[w.lower()], "possessive": w.lower() in ("his", "hers", "her")} for w, k in words]})
            return {"text": text, "logprobs": {}, "prompt_tokens": 1, "completion_tokens": 1, "finish_reason": "stop"}

        return client

    answer = {"Ana": 1, "Kol": 0}
    items = spark.createDataFrame([(k, "b", ["Ana", "Kol"], answer, t, "old", "x") for k, t in TEXTS.items()], "item_id string, book string, labels array<string>, answer map<string, int>, original string, masked string, n string")
    aliases = spark.createDataFrame([("b", "principal", x, i, a) for i, (x, names) in enumerate(ALIASES.items()) for a in names], "book string, kind string, label string, label_no int, alias string")
    good, dropped = pronouns.masked(items.drop("n"), aliases, make)
    got = {r.item_id: (r.masked, r.pronouns_masked, r.pronouns_total) for r in good.collect()}

    def plain(text):
        ref = {"her": ("Ana", 1), "his": ("Kol", 1), "he": ("Kol", 0), "she": ("Ana", 0), "hers": ("Ana", 1)}
        spans = [(m.start(), -m.end(), f"[CHAR {answer[x]}]") for x in answer for m in re.finditer(r"(?<![\w’'])(?:" + "|".join(sorted((f for a in ALIASES[x] for f in (a, a.upper())), key=len, reverse=True)) + r")(?!\w)", text)]
        said = [(m, ref[m[0].lower()]) for m in PRONOUN.finditer(text) if m[0].lower() in ref]
        spans += [(m.start(), -m.end(), f"[CHAR {answer[x]}]" + "'s" * own) for m, (x, own) in said]
        out, at = "", 0
        for start, back, mark in sorted(spans):
            if start >= at:
                out, at = out + text[at:start] + mark, -back
        return out + text[at:], len(said), len(PRONOUN.findall(text))

    assert got == {k: plain(t) for k, t in TEXTS.items() if k != "bad"} and got["none"][1:] == (0, 0) and got["two"][0].startswith("[CHAR 1] saw [CHAR 0]. [CHAR 1]'s hat")
    assert [r.item_id for r in dropped.collect()] == ["bad"]
    assert pronouns.masked(items.drop("n").where("false"), aliases, make)[0].count() == 0
