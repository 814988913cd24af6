"""Verified ledgers and the sheets that rest on them.

Candidates are claims about a book's labels: `book`, `chapter_index`, `pos`, `label`, `section`, `claim`. Their ids, ch<chapter>:<section>:<number>, name
a claim's place and stay with it: a decision, and later every statement of a sheet, cites them.

Verification asks for decisions on batches of BATCH candidates of a chapter; batches that never get valid decisions are asked for one candidate
at a time, and a candidate without a decision is removed. Synthesis asks for a sheet of the kept claims before a boundary. Both are queues
worked off in rounds (plans.rounds), so they can be stopped and resumed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import kept as written
from . import model, rounds

# What a decision says of a candidate, the sections of a sheet and its longest text, the size of a batch.
FLAGS = ("supported", "assigned_to_correct_character", "appropriately_scoped", "useful")
SECTIONS = ("physicality_and_personality", "dialogue_and_voice", "history_and_circumstances", "knowledge_and_beliefs", "goals_and_motivations", "relationships")
MOST_WORDS = 1000
BATCH = 8
# End of fixed values.
UNVERIFIED = "verification_failed"
CITED = re.compile(r"\bch\d{1,3}:(?:[a-z_]+(?::\d{1,3})?|\d{1,3})\b", re.I)
ENCODE = json.JSONEncoder(ensure_ascii=False).encode
DECISION = f"id: string, {', '.join(f'{f}: boolean' for f in FLAGS)}, verdict: string, reason: string"


def claim_id(chapter: Column, section: Column, number: Column) -> Column:
    return F.format_string("ch%03d:%s:%03d", chapter, section, number)


def identified(candidates: DataFrame) -> DataFrame:
    """candidates with `id` and `nth`: the number of a claim in its chapter, label and section, and its place in the chapter from 0."""
    book = ["book", "chapter_index"]
    number = F.row_number().over(Window.partitionBy(*book, "label", "section").orderBy("pos", "claim"))
    nth = F.row_number().over(Window.partitionBy(*book).orderBy("label", "pos", "section", "claim")) - 1
    name = F.concat(claim_id(F.col("chapter_index"), F.col("section"), number), F.lit("@"), F.col("label"))
    return candidates.withColumns({"id": name, "nth": nth})


# Verification -------------------------------------------------------------------------------------------------------------


def decisions_check(payload, row: dict) -> dict:
    """{"decisions": [{"id", flags, "verdict", "reason"}]}: one decision for each candidate, whose verdict is keep exactly if all flags hold."""
    given = payload.get("decisions") if isinstance(payload, dict) else None
    if not isinstance(given, list):
        raise ValueError("'decisions' is a list")
    asked, out = [x["id"] for x in row["items"]], {}
    for d in given:
        if not isinstance(d, dict) or d.get("id") not in asked:
            raise ValueError(f"unknown id {d.get('id') if isinstance(d, dict) else d!r}")
        if d["id"] in out:
            raise ValueError(f"two decisions on {d['id']}")
        flags = [d.get(f) for f in FLAGS]
        if set(map(type, flags)) != {bool}:
            raise ValueError(f"{d['id']}: flags are true or false")
        if d.get("verdict") != ("keep" if all(flags) else "remove"):
            raise ValueError(f"{d['id']}: the verdict doesn't follow from the flags")
        out[d["id"]] = {"id": d["id"], **dict(zip(FLAGS, flags, strict=True)), "verdict": d["verdict"], "reason": str(d.get("reason") or "")}
    if missing := [i for i in asked if i not in out]:
        raise ValueError(f"no decision on {missing[:4]}")
    return {"decisions": [out[i] for i in asked]}


def decisions_repair(payload, row: dict):
    """Verdicts from the flags; unknown, repeated and incomplete decisions go."""
    asked, seen, kept = {x["id"] for x in row["items"]}, set(), []
    for d in payload.get("decisions") or []:
        if isinstance(d, dict) and d.get("id") in asked - seen and all(type(d.get(f)) is bool for f in FLAGS):
            seen.add(d["id"])
            kept.append({**d, "verdict": "keep" if all(d[f] for f in FLAGS) else "remove"})
    return {"decisions": kept}


def _verify_prompt(row: dict) -> str:
    listed = ENCODE([{"id": x["id"], "label": x["label"], "section": x["section"], "claim": x["claim"]} for x in row["items"]])
    listed = listed[1:-1].replace('}, {"id": ', '}\n{"id": ')  # in a claim such quotes are escaped
    return f"Chapter:\n{row.get('text') or ''}\n\nCandidate claims, one JSON object a line:\n{listed}\n\nFor each say whether the chapter supports it, whether it is assigned to the right character, whether its scope is right and whether it is useful. Reply with JSON: decisions, each with id, {', '.join(FLAGS)}, verdict (keep or remove) and reason."


VERIFY = rounds.Work(_verify_prompt, decisions_check, f"decisions array<struct<{DECISION}>>", decisions_repair)


def verify(candidates: DataFrame, chapters: DataFrame, path: str, make: Callable[[], model.Client] = lambda: model.stub, batch: int = BATCH, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(claims, counts). claims are the candidates with id, verdict, the flags, reason, request_id and round of their decision; counts are, for each chapter,
    candidates, kept, removed, batches_split, removed_unverified and repaired.

    chapters(book, chapter_index, text) are what is judged against. While the queue isn't empty (`most`), open candidates have no verdict.
    """
    known = written(identified(candidates))  # for the requests and, after the rounds, for the claims
    item = F.struct("nth", "id", "label", "section", "claim")
    name = F.format_string("%s__chapter_%04d__verify_%04d", F.col("book"), F.col("chapter_index"), F.col("k") * batch)
    requests = known.withColumn("k", F.floor(F.col("nth") / batch).cast("int")).groupBy("book", "chapter_index", "k").agg(F.array_sort(F.collect_list(item)).alias("items"))
    requests = requests.select(name.alias("request_id"), "book", "chapter_index", "items")
    answers = rounds.run(requests, VERIFY, path, make, chapters.select("book", "chapter_index", "text"), ["book", "chapter_index"], most)
    decided = answers.where(F.col("status") == rounds.DONE).select("book", "chapter_index", "request_id", "round", F.explode("result.decisions").alias("d"))
    decided = decided.select("book", "chapter_index", "d.*", "request_id", "round")
    lost = answers.where(F.col("status") == rounds.FAILED).select("book", "chapter_index", F.col("items")[0]["id"].alias("id"), *[F.lit(False).alias(f) for f in FLAGS], F.lit("remove").alias("verdict"), F.lit(UNVERIFIED).alias("reason"), "request_id", "round")
    claims = written(known.join(decided.unionByName(lost), ["book", "chapter_index", "id"], "left"))
    kept = claims.groupBy("book", "chapter_index").agg(F.count("*").alias("candidates"), F.count_if(F.col("verdict") == "keep").alias("kept"), F.count_if(F.col("verdict") == "remove").alias("removed"), F.count_if(F.col("reason") == UNVERIFIED).alias("removed_unverified"))
    calls = answers.groupBy("book", "chapter_index").agg(F.count_if(F.col("status") == rounds.SPLIT).alias("batches_split"), F.count_if("repaired").alias("repaired"))
    return claims, kept.join(calls, ["book", "chapter_index"])


# Synthesis ----------------------------------------------------------------------------------------------------------------


def padded(source: str) -> str:
    """ch10:... as ch010:..."""
    return re.sub(r"^ch(\d{1,2}):", lambda m: f"ch{int(m[1]):03d}:", source.strip())


def sheet_check(payload, row: dict) -> dict:
    """{"sections": {section: [{"statement", "source_ids"}]}}: all sections, each statement with distinct known ids and none in its text, MOST_WORDS at most."""
    given = payload.get("sections") if isinstance(payload, dict) else None
    if not isinstance(given, dict) or set(given) != set(SECTIONS):
        raise ValueError(f"'sections' has exactly {', '.join(SECTIONS)}")
    known, out = {x["id"] for x in row["items"][0]["entries"]}, []
    for section in SECTIONS:
        for s in given[section]:
            text, ids = s["statement"], [padded(i) for i in s["source_ids"]]
            if not isinstance(text, str) or not text.strip():
                raise ValueError(f"{section}: empty statement")
            if found := CITED.search(text):
                raise ValueError(f"{section}: {found[0]} stands in a statement")
            if not ids or set(ids) - known:
                raise ValueError(f"{section}: unknown source ids {sorted(set(ids) - known)[:4]}")
            if len(set(ids)) < len(ids):
                raise ValueError(f"{section}: a source id twice")
            out.append({"section": section, "statement": text.strip(), "source_ids": ids})
    if (n := sum(len(s["statement"].split()) for s in out)) > MOST_WORDS:
        raise ValueError(f"{n} words, at most {MOST_WORDS}")
    return {"statements": out}


def sheet_repair(payload, row: dict):
    """Ids out of the texts, unknown and repeated ids away, statements without ids away, and the longest sections cut until the words fit."""
    known = {x["id"] for x in row["items"][0]["entries"]}
    out: dict[str, list] = {s: [] for s in SECTIONS}
    for section in SECTIONS:
        for s in (payload.get("sections") or {}).get(section) or []:
            if isinstance(s, dict) and isinstance(s.get("statement"), str):
                ids = [i for i in dict.fromkeys(padded(i) for i in s.get("source_ids") or [] if isinstance(i, str)) if i in known]
                bare = re.sub(r"\s*\([^()]*\bch\d{1,3}:[^()]*\)", "", s["statement"])
                bare = re.sub(r"\s+([,.])", r"\1", re.sub(r"\s{2,}", " ", CITED.sub("", bare))).strip()
                if ids and bare:
                    out[section].append({"statement": bare, "source_ids": ids})
    while sum(len(s["statement"].split()) for own in out.values() for s in own) > MOST_WORDS:
        max(out.values(), key=len).pop()
    return {"sections": out}


def _sheet_prompt(row: dict) -> str:
    listed = "\n".join(json.dumps(dict(e), ensure_ascii=False) for e in row["items"][0]["entries"])
    return f"Verified claims about {row['label']}, one JSON object a line:\n{listed}\n\nWrite the character's sheet as of the end of chapter {row['boundary']}. Each statement cites the ids that it rests on in source_ids, never in its text; {MOST_WORDS - 100} words at most. Reply with JSON: sections, an object with {', '.join(SECTIONS)}, each a list of statement and source_ids."


SHEET = rounds.Work(_sheet_prompt, sheet_check, "statements array<struct<section: string, statement: string, source_ids: array<string>>>", sheet_repair, max_tokens=24_000)


def sheets(claims: DataFrame, boundaries: DataFrame, path: str, make: Callable[[], model.Client] = lambda: model.stub, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(sheets, errors): (book, boundary, label, text, words, statements, repaired, request_id, round) of the kept claims before each boundary
    (book, boundary); labels without such claims have no sheet. A statement ends with the chapters of its sources."""
    kept = claims.where("verdict = 'keep'").join(boundaries.select("book", "boundary").distinct(), "book").where("chapter_index < boundary")
    entry = F.struct("chapter_index", "nth", F.struct("id", "section", "claim").alias("e"))
    requests = kept.groupBy("book", "boundary", "label").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]).alias("entries"))
    name = F.format_string("%s__%04d__%s__sheet", F.col("book"), F.col("boundary"), F.col("label"))
    requests = requests.select(name.alias("request_id"), "book", "boundary", "label", F.array(F.struct("entries")).alias("items"))
    answers = rounds.run(requests, SHEET, path, make, most=most)
    cited = lambda ids: F.array_join(F.array_sort(F.array_distinct(F.transform(ids, lambda i: F.regexp_extract(i, r"^ch(\d+):", 1).cast("int") + 1))), ", ")

    def part(section: str) -> Column:
        own = F.filter("result.statements", lambda s: s["section"] == section)
        line = lambda s: F.concat(F.lit("- "), s["statement"], F.when(F.contains(cited(s["source_ids"]), F.lit(",")), F.lit(" [Chs. ")).otherwise(F.lit(" [Ch. ")), cited(s["source_ids"]), F.lit("]"))
        return F.concat(F.lit(f"## {section.replace('_', ' ').title()}\n\n"), F.when(F.size(own) > 0, F.array_join(F.transform(own, line), "\n")).otherwise("_No established information._"))

    text = F.concat_ws("\n\n", *[part(s) for s in SECTIONS])
    good = answers.where(F.col("status") == rounds.DONE).select("book", "boundary", "label", text.alias("text"), F.col("result.statements").alias("statements"), "repaired", "request_id", "round")
    words = F.regexp_count("text", F.lit(r"(?U)\S+")).alias("words")
    return good.select("book", "boundary", "label", "text", words, "statements", "repaired", "request_id", "round"), answers.where(F.col("status") == rounds.FAILED).select("book", "boundary", "label", "fault", "request_id", "round")


def critic() -> model.Client:
    """An offline judge that decides by the claims' lengths, so that queues can be run without a network: its reply to several claims
    lacks one if a length is divisible by 7, and its reply to a single claim is no JSON if the length is divisible by 35. It drops claims whose length
    is divisible by 3, and says keep of every fifth one against its flags."""

    def call(messages: list[dict], temperature: float, max_tokens: int) -> dict:
        body = messages[0]["content"].split("one JSON object a line:\n")[1].split("\n\n")[0]
        asked = json.loads(f"[{body.replace(chr(10), ',')}]")
        sizes = [len(x["claim"]) for x in asked]
        made = [{"id": x["id"], **dict.fromkeys(FLAGS, True), "useful": n % 3 != 0, "verdict": "keep" if n % 3 or n % 5 == 0 else "remove", "reason": str(n)} for x, n in zip(asked, sizes, strict=True)]
        if len(asked) > 1 and any(n % 7 == 0 for n in sizes):
            made.pop()
        text = "no" if len(asked) == 1 and sizes[0] % 35 == 0 else ENCODE({"decisions": made})
        return {"text": text, "logprobs": {}, "prompt_tokens": len(body.split()), "completion_tokens": len(text.split()), "finish_reason": "stop"}

    return call
