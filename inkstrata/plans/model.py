"""Model calls as a batch operator: a pluggable client, validation in the loop, errors as rows, and sequential chains.

A client is a function of (messages, temperature, max_tokens) to a dict with `text`, `logprobs` (token to log-probability),
`prompt_tokens`, `completion_tokens` and `finish_reason`. `stub` is deterministic and needs no network. A conversation that ends with an
assistant's message asks for its continuation; one message of the role RAW is a bare text to go on with.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Client = Callable[[list[dict], float, int], dict]
ATTEMPTS = 3
RETRY_HEAT = 0.6
#: Characters of a reply, and of its fault, that the model is shown again.
SHOWN, SHOWN_FAULT = 16_000, 600
RAW = "raw"
DECODER = json.JSONDecoder()
# What a reply is begun with, how a bare prompt ends; the tokens for reasoning at most and at least, those that are spared, and the
# characters of a prompt under which all of them fit.
ANSWER, BARE = "[CHAR ", "\n\nAnswer: [CHAR "
REASONING, LEAST_REASONING, SPARED, SURE_CHARS = 32_768, 256, 64, 60_000
# End of fixed values.


def stub(messages: list[dict], temperature: float = 0.0, max_tokens: int = 0) -> dict:
    """A reply that depends on the messages alone: a digest as text, and log-probabilities of three digits."""
    text = "\x1e".join(m["content"] for m in messages)
    digest = hashlib.sha256(text.encode()).digest()
    weights = [1 + b for b in digest[:3]]
    total = sum(weights)
    lp = {str(i): math.log(w / total) for i, w in enumerate(weights)}
    return {"text": digest.hex()[:16], "logprobs": lp, "prompt_tokens": len(text.split()), "completion_tokens": 1, "finish_reason": "stop"}


def http(base: str, model: str, tries: int = 6, timeout: float = 3600, wait: Callable[[float], None] = time.sleep) -> Client:
    """A client of a chat-completions endpoint; failed requests are tried again after 5, 10, ... up to 60 seconds."""

    def call(messages: list[dict], temperature: float, max_tokens: int) -> dict:
        from urllib import request

        raw = messages[0]["role"] == RAW
        asked: dict = {"model": model, "temperature": temperature, "max_tokens": max_tokens}
        if raw:
            asked |= {"prompt": messages[0]["content"], "logprobs": 20}
        else:
            asked |= {"messages": messages, "logprobs": True, "top_logprobs": 20}
            if messages[-1]["role"] == "assistant":
                asked |= {"continue_final_message": True, "add_generation_prompt": False}
        body = json.dumps(asked).encode()
        error: Exception | None = None
        for k in range(tries):
            try:
                with request.urlopen(request.Request(f"{base}/{'completions' if raw else 'chat/completions'}", body, {"Content-Type": "application/json"}), timeout=timeout) as got:
                    reply = json.loads(got.read())
                break
            except OSError as e:
                error = e
                wait(min(60, 5 * (k + 1)))
        else:
            raise RuntimeError(f"no reply after {tries} tries: {error}")
        choice, usage = reply["choices"][0], reply.get("usage") or {}
        if raw:
            top = ((choice.get("logprobs") or {}).get("top_logprobs") or [{}])[0]
            return {"text": (choice.get("text") or "").strip(), "logprobs": top, "prompt_tokens": usage.get("prompt_tokens") or 0, "completion_tokens": usage.get("completion_tokens") or 0, "finish_reason": choice.get("finish_reason")}
        first = ((choice.get("logprobs") or {}).get("content") or [{}])[0].get("top_logprobs") or []
        return {"text": (choice["message"].get("content") or "").strip(), "logprobs": {t["token"]: t["logprob"] for t in first}, "prompt_tokens": usage.get("prompt_tokens") or 0, "completion_tokens": usage.get("completion_tokens") or 0, "finish_reason": choice.get("finish_reason")}

    return call


def parse_json(text: str):
    """The first JSON object or list of a reply, whatever stands around it."""
    for opening in re.finditer(r"[\[{]", text):
        try:
            return DECODER.raw_decode(text, opening.start())[0]
        except json.JSONDecodeError:
            continue
    raise ValueError("the reply holds no JSON")


def read_reply(got: dict, validate: Callable, as_json: bool) -> tuple[object, str | None]:
    """(value, fault) of one reply; one of the two is None."""
    if got["finish_reason"] != "stop":
        return None, f"it ended by {got['finish_reason']}"
    if not got["text"]:
        return None, "it is empty"
    try:
        return validate(parse_json(got["text"]) if as_json else got["text"]), None
    except (ValueError, LookupError, TypeError, AttributeError) as fault:
        return None, f"{type(fault).__name__}: {fault}"


def ask(client: Client, messages: list[dict], validate: Callable, max_tokens: int = 8000, temperature: float = 0.1, as_json: bool = True) -> tuple[object, dict]:
    """A validated reply and the tokens of all attempts. After a fault the model is shown its reply and the fault, and heat goes up;
    ValueError with all faults when the attempts are used up."""
    replies: list[dict] = []
    faults: list[str] = []
    while len(replies) < ATTEMPTS:
        shown = [] if not faults else [{"role": "assistant", "content": replies[-1]["text"][:SHOWN]}, {"role": "user", "content": f"That reply is not valid ({faults[-1][:SHOWN_FAULT]}). Give the whole reply again in the required format."}]
        replies.append(client([*messages, *shown], max(temperature, RETRY_HEAT) if faults else temperature, max_tokens))
        value, fault = read_reply(replies[-1], validate, as_json)
        if fault is None:
            return value, {"attempts": len(replies), **{k: sum(r[k] for r in replies) for k in ("prompt_tokens", "completion_tokens")}}
        faults.append(fault)
    raise ValueError("; ".join(f[:SHOWN_FAULT] for f in faults))


def digit_logprobs(top: dict[str, float], n: int) -> dict[str, float]:
    """The best log-probability of each digit among the returned tokens, -inf where there is none."""
    out = {str(i): -math.inf for i in range(n)}
    for token, lp in top.items():
        digit = token.strip()
        if digit in out:
            out[digit] = max(out[digit], lp)
    return out


def run(work: DataFrame, make: Callable[[], Client], call: Callable[[Client, dict], dict], kind: str) -> DataFrame:
    """work with `ok struct<kind>` and `error string`: call(client, row) for each row; a failure becomes the row's error.

    A client is made once per task. Rows stream through in Arrow batches, so a task holds one batch.
    """
    from pyspark.sql import types as T

    ok = T.StructType.fromDDL(kind)
    schema = T.StructType([*work.schema.fields, T.StructField("ok", ok), T.StructField("error", T.StringType())])

    def each(batches):
        client = make()
        for pdf in batches:
            oks, errors = [], []
            for row in pdf.to_dict("records"):
                try:
                    oks.append(call(client, row))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - whatever fails is the row's result
                    oks.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:2000])
            yield pdf.assign(ok=pd.Series(oks, index=pdf.index, dtype=object), error=pd.Series(errors, index=pdf.index, dtype=object))

    return work.mapInPandas(each, schema)


def scored_as(prompt: str, mode: str = "chat") -> list[dict]:
    """The messages that ask for an id's digit: chat asks for a reply, prefix for what follows ANSWER in the reply, base for what follows a bare text."""
    if mode == "base":
        return [{"role": RAW, "content": prompt + BARE}]
    if mode not in ("chat", "prefix"):
        raise ValueError(f"no mode {mode}")
    return [{"role": "user", "content": prompt}, *([{"role": "assistant", "content": ANSWER}] if mode == "prefix" else [])]


def score(prompts: DataFrame, make: Callable[[], Client] = lambda: stub, n: int = 3, mode: str = "chat") -> DataFrame:
    """Digit scoring of prompts: prompts with ok struct<logprobs, top_token, prompt_tokens> and error; modes are those of `scored_as`."""
    scored_as("", mode)  # an unknown mode fails here, not in a task

    def call(client: Client, row: dict) -> dict:
        got = client(scored_as(row["prompt"], mode), 0.0, 1)
        top = max(got["logprobs"], key=got["logprobs"].get) if got["logprobs"] else ""
        return {"logprobs": digit_logprobs(got["logprobs"], n), "top_token": top, "prompt_tokens": got["prompt_tokens"]}

    return run(prompts, make, call, "logprobs map<string, double>, top_token string, prompt_tokens int")


def reasoning_budget(messages: list[dict], count: Callable[[list[dict]], tuple[int, int]] | None = None) -> int:
    """Tokens for reasoning and reply: REASONING, or what the served context leaves after a long prompt. count gives a conversation's tokens and
    the context's length; it is asked only for prompts of SURE_CHARS and more."""
    if count is None or sum(len(m["content"]) for m in messages) < SURE_CHARS:
        return REASONING
    used, context = count(messages)
    return max(LEAST_REASONING, min(REASONING, context - used - SPARED))


def reasoned(prompts: DataFrame, make: Callable[[], Client] = lambda: stub, n: int = 3, count: Callable[[list[dict]], tuple[int, int]] | None = None) -> DataFrame:
    """Reasoning scoring: the last JSON object of a reply maps labels to distinct ids; one retry, then the row is invalid.

    A valid reply gives the target's id log-probability 0 and the others -1e9.
    """

    def call(client: Client, row: dict) -> dict:
        for attempt in (1, 2):
            messages = [{"role": "user", "content": row["prompt"]}]
            got = client(messages, RETRY_HEAT if attempt > 1 else 0.0, reasoning_budget(messages, count))
            objects = re.findall(r"\{[^{}]*\}", got["text"])
            try:
                answer = json.loads(objects[-1]) if objects else {}
            except json.JSONDecodeError:
                answer = {}
            if sorted(map(str, answer.values())) == [str(i) for i in range(n)] and row["target"] in answer:
                pick = str(answer[row["target"]])
                return {"logprobs": {str(i): 0.0 if str(i) == pick else -1e9 for i in range(n)}, "invalid": False, "attempts": attempt, "prompt_tokens": got["prompt_tokens"]}
        return {"logprobs": {str(i): -1e9 for i in range(n)}, "invalid": True, "attempts": 2, "prompt_tokens": got["prompt_tokens"]}

    return run(prompts, make, call, "logprobs map<string, double>, invalid boolean, attempts int, prompt_tokens int")


def split(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows with ok's fields beside the others, and error rows."""
    plain = [c for c in results.columns if c not in ("ok", "error")]
    return results.where("error is null").select(*plain, "ok.*"), results.where("error is not null").select(*plain, "error")


def chain(chapters: DataFrame, keys: list[str], step: Callable[[str, str], str], cap: int = 900, rounds: int = 3, compress: Callable[[str], str] | None = None) -> DataFrame:
    """(keys, boundary, summary, words, compressed_from): rolling state S(c + 1) = step(S(c), text of chapter c), one chain per key.

    A summary over `cap` words is compressed up to `rounds` times and then cut at a sentence. A missing chapter or a
    failing step ends the chain. Chains of different keys run side by side; a chain is one key's chapters.
    """
    kinds = dict(chapters.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", boundary int, summary string, words int, compressed_from int"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out, state = [], ""
        for want, row in enumerate(pdf.sort_values("chapter_index").to_dict("records")):
            if row["chapter_index"] != want:
                break
            try:
                state = step(state, row["text"] or "")
                before = None
                for _ in range(rounds):
                    if len(state.split()) <= cap or compress is None:
                        break
                    before = before or len(state.split())
                    state = compress(state)
            except Exception:  # noqa: BLE001 - the chain ends here, what it has stays
                break
            if len(state.split()) > cap:
                before = before or len(state.split())
                state = trimmed(state, cap)
            out.append({**{k: row[k] for k in keys}, "boundary": want + 1, "summary": state, "words": len(state.split()), "compressed_from": before})
        got = pd.DataFrame(out, columns=[*keys, "boundary", "summary", "words", "compressed_from"])
        return got.astype({"compressed_from": "Int32"})

    return chapters.select(*keys, "chapter_index", "text").groupBy(*keys).applyInPandas(one, schema)


def trimmed(text: str, most: int) -> str:
    """The first `most` words, back to the last sentence end among them if there is one."""
    cut = " ".join(text.split()[:most])
    stop = max(cut.rfind(c) for c in ".!?")
    return cut[: stop + 1] if stop > 0 else cut


def two_level(chapters: DataFrame, keys: list[str], step: Callable[[list[str]], str], fan: int = 8) -> DataFrame:
    """(keys, summary): chapters summarised in runs of `fan`, then the runs' summaries together."""
    kinds = dict(chapters.dtypes)
    head = ", ".join(f"{k} {kinds[k]}" for k in keys)
    runs = chapters.withColumn("run", F.floor(F.col("chapter_index") / fan).cast("int"))
    low = runs.groupBy(*keys, "run").applyInPandas(lambda p: pd.DataFrame([{**{k: p[k].iloc[0] for k in keys}, "run": p["run"].iloc[0], "text": step(p.sort_values("chapter_index")["text"].tolist())}]), f"{head}, run int, text string")
    return low.groupBy(*keys).applyInPandas(lambda p: pd.DataFrame([{**{k: p[k].iloc[0] for k in keys}, "summary": step(p.sort_values("run")["text"].tolist())}]), f"{head}, summary string")


def rate_once(statements: DataFrame, text: str, rate: Callable[[list[str]], list[int]], batch: int = 35) -> DataFrame:
    """statements with `rating`: each distinct text is rated once, in batches; a failing batch leaves its texts unrated."""
    distinct = statements.select(text).where(F.col(text).isNotNull()).distinct()

    def run_batches(pdfs):
        for pdf in pdfs:
            texts, ratings = pdf[text].tolist(), []
            for i in range(0, len(texts), batch):
                part = texts[i : i + batch]
                try:
                    got = rate(part)
                    ratings += got if len(got) == len(part) else [None] * len(part)
                except Exception:  # noqa: BLE001
                    ratings += [None] * len(part)
            yield pd.DataFrame({text: texts, "rating": pd.Series(ratings, dtype="Int32")})

    return statements.join(distinct.mapInPandas(run_batches, f"{text} string, rating int"), text, "left")
