"""Scoring modes and the reasoning budget against a deterministic client, and the bodies that go to a server."""

import json

import pytest

from inkstrata.plans import model


def test_modes_ask_for_the_same_digit_in_three_ways(spark):
    prompts = spark.createDataFrame([("i1", "Who is it?"), ("i2", "And it?")], "item string, prompt string")

    def make():
        def client(messages, temperature, max_tokens):
            roles = "+".join(m["role"] for m in messages)
            lp = {"user": {" 1": -0.5, "1": -0.7, "x": -0.1}, "user+assistant": {"2": -0.2}, "raw": {"0": -0.3, "9": -0.1}}[roles]
            assert temperature == 0.0 and max_tokens == 1
            return {"text": "", "logprobs": lp, "prompt_tokens": len(messages[-1]["content"]), "completion_tokens": 1, "finish_reason": "stop"}

        return client

    inf = float("inf")
    want = {"chat": ({"0": -inf, "1": -0.5, "2": -inf}, "x", {10, 7}), "prefix": ({"0": -inf, "1": -inf, "2": -0.2}, "2", {len(model.ANSWER)}), "base": ({"0": -0.3, "1": -inf, "2": -inf}, "9", {10 + len(model.BARE), 7 + len(model.BARE)})}
    for mode, (lp, top, sizes) in want.items():
        good, errors = model.split(model.score(prompts, make, 3, mode))
        rows = good.collect()
        assert errors.count() == 0 and all(r.logprobs == lp and r.top_token == top for r in rows) and {r.prompt_tokens for r in rows} == sizes, mode
    with pytest.raises(ValueError, match="no mode"):
        model.score(prompts, make, 3, "other")


def test_the_budget_leaves_room_for_long_prompts(spark):
    short, long_ = [{"role": "user", "content": "x" * 59_999}], [{"role": "user", "content": "x" * 60_000}]
    never = lambda m: pytest.fail("asked")
    assert model.reasoning_budget(short, never) == model.reasoning_budget(long_) == 32_768
    assert model.reasoning_budget(long_, lambda m: (15_000, 131_072)) == 32_768
    assert model.reasoning_budget(long_, lambda m: (100_000, 131_072)) == 31_008 and model.reasoning_budget(long_, lambda m: (131_000, 131_072)) == 256
    prompts = spark.createDataFrame([("a", "x" * 10), ("a", "x" * 60_000)], "target string, prompt string")

    def make():
        return lambda messages, temperature, max_tokens: {"text": '{"a": 0, "b": 1}', "logprobs": {}, "prompt_tokens": max_tokens, "completion_tokens": 1, "finish_reason": "stop"}

    good, _ = model.split(model.reasoned(prompts, make, 2, lambda m: (100_000, 131_072)))
    assert sorted(r.prompt_tokens for r in good.collect()) == [31_008, 32_768]


def test_bodies_for_a_server(monkeypatch):
    from urllib import request

    sent = []

    class Reply:
        def __init__(self, body):
            self.body = body

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return False

        def read(self):
            return json.dumps(self.body).encode()

    def urlopen(asked, timeout):
        sent.append((asked.full_url, json.loads(asked.data)))
        if asked.full_url.endswith("/chat/completions"):
            return Reply({"choices": [{"message": {"content": " 1 "}, "finish_reason": "stop", "logprobs": {"content": [{"top_logprobs": [{"token": "1", "logprob": -0.1}]}]}}], "usage": {"prompt_tokens": 7, "completion_tokens": 1}})
        return Reply({"choices": [{"text": " 2", "finish_reason": "length", "logprobs": {"top_logprobs": [{"2": -0.2, "0": -3.0}]}}]})

    monkeypatch.setattr(request, "urlopen", urlopen)
    client = model.http("http://host/v1", "m")
    assert client(model.scored_as("p"), 0.0, 1) == {"text": "1", "logprobs": {"1": -0.1}, "prompt_tokens": 7, "completion_tokens": 1, "finish_reason": "stop"}
    client(model.scored_as("p", "prefix"), 0.0, 1)
    assert client(model.scored_as("p", "base"), 0.0, 1) == {"text": "2", "logprobs": {"2": -0.2, "0": -3.0}, "prompt_tokens": 0, "completion_tokens": 0, "finish_reason": "length"}
    assert [u.removeprefix("http://host/v1") for u, _ in sent] == ["/chat/completions", "/chat/completions", "/completions"]
    assert "continue_final_message" not in sent[0][1] and sent[1][1]["continue_final_message"] is True and sent[1][1]["add_generation_prompt"] is False
    assert sent[2][1]["prompt"] == "p" + model.BARE and sent[2][1]["logprobs"] == 20 and "messages" not in sent[2][1]
