"""Passage likelihoods under contexts: per-passage NLL, and rulers that compare many contexts on one example.

An echo client is a function of (context, passage) to the log-probabilities of the passage's tokens after the context.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cut_words
from . import model

Echo = Callable[[str, str], list[float]]
#: Tokens that a context and its passage may have together.
WINDOW = 57_344


def stub(context: str, passage: str) -> list[float]:
    """A log-probability per word that depends on the word, its place and the context; words the context has cost less."""
    seen = set(context.split())
    return [-(1 + hashlib.sha256(f"{i}\x1e{w}".encode()).digest()[0] / 64) / (2 if w in seen else 1) for i, w in enumerate(passage.split())]


def http(base: str, model_name: str, timeout: float = 3600) -> Echo:
    """An echo client of a completions endpoint: the prompt's own log-probabilities, from where the passage starts."""

    def call(context: str, passage: str) -> list[float]:
        from urllib import request

        body = json.dumps({"model": model_name, "prompt": context + passage, "max_tokens": 1, "echo": True, "logprobs": 1, "temperature": 0}).encode()
        with request.urlopen(request.Request(f"{base}/completions", body, {"Content-Type": "application/json"}), timeout=timeout) as got:
            lp = json.loads(got.read())["choices"][0]["logprobs"]
        return [p for at, p in zip(lp["text_offset"], lp["token_logprobs"], strict=True) if len(context) <= at < len(context) + len(passage) and p is not None]

    return call


def contexts(kind: str, rep: Column | None, story: Column | None, words: int = 4000) -> Column:
    """The text before a passage: 'none' (the representation alone), 'story' (and the story's last words), or 'full' (the whole story)."""
    parts = [] if rep is None else [F.concat(F.lit("# Character information\n\n"), rep)]
    if kind == "story":
        parts.append(F.concat(F.lit("# The story so far\n\n"), cut_words(story, words, last=True)))
    elif kind == "full":
        parts.append(F.concat(F.lit("# The story so far\n\n"), story))
    elif kind != "none":
        raise ValueError(f"unknown context {kind!r}")
    return F.concat(F.concat_ws("\n\n", *parts), F.lit("\n\n")) if parts else F.lit("")


def passages(work: DataFrame, make: Callable[[], Echo] = lambda: stub) -> DataFrame:
    """work(context, passage, ...) with ok struct<nll, tokens> and error."""

    def call(echo: Echo, row: dict) -> dict:
        got = echo(row["context"] or "", row["passage"] or "")
        if not got:
            raise ValueError("the passage has no tokens")
        return {"nll": -sum(got), "tokens": len(got)}

    return model.run(work, make, call, "nll double, tokens int")


def ruler(examples: DataFrame, make: Callable[[], Echo] = lambda: stub, window: int = WINDOW, size: Callable[[str], int] = lambda t: len(t.split())) -> DataFrame:
    """examples(passage, contexts map<cond, text>, ...) with ok struct<scores map<cond, mean log-probability>, target_tokens, skipped> and error.

    An example one of whose contexts is missing or too long for the window is skipped in all conditions.
    """

    def call(echo: Echo, row: dict) -> dict:
        texts = dict(row["contexts"] or {})
        if not texts or any(t is None for t in texts.values()):
            return {"scores": None, "target_tokens": None, "skipped": "missing context"}
        if max(size(t) for t in texts.values()) + size(row["passage"]) > window:
            return {"scores": None, "target_tokens": None, "skipped": "over the window"}
        got = {c: echo(t, row["passage"]) for c, t in texts.items()}
        return {"scores": {c: sum(v) / len(v) for c, v in got.items()}, "target_tokens": len(next(iter(got.values()))), "skipped": None}

    return model.run(examples, make, call, "scores map<string, double>, target_tokens int, skipped string")


def long_scores(rulers: DataFrame) -> DataFrame:
    """One row per example and condition of a ruler's good rows, for the gains of operators.stats."""
    return rulers.where("skipped is null").select("*", F.explode("scores").alias("cond", "score")).drop("scores")


def slots(plots: list[str | None], characters: list[str | None]) -> list[tuple[str, str | None, str | None]]:
    """Named combinations of plot and character texts, each possibly none."""
    return [(f"{p or 'none'}|{c or 'none'}", p, c) for p in plots for c in characters]


def slot_contexts(texts: Column, plots: list[str | None], characters: list[str | None]) -> Column:
    """map<'plot|characters', context> from map<condition, text>; a combination with a missing text is null."""
    pairs: list[Column] = []
    for name, p, c in slots(plots, characters):
        parts = [F.try_element_at(texts, F.lit(x)) for x in (p, c) if x]
        joined = F.when(F.exists(F.array(*parts), lambda x: x.isNull()), None).otherwise(F.concat_ws("\n\n", *parts)) if parts else F.lit("")
        pairs += [F.lit(name), joined]
    return F.create_map(*pairs)
