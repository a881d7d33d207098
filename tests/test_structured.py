"""Structured answers: schemas, repair, failing models, the cache."""

import os

from quillgraph.operators import structured
from quillgraph.operators.structured import Request, problems

SCHEMA = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 1, "maximum": 9}, "b": {"type": ["string", "null"], "enum": ["x", None]}, "c": {"type": "array", "items": {"type": "number"}}}, "additionalProperties": False}


def test_problems():
    assert problems({"a": 1, "b": None, "c": [1, 2.5]}, SCHEMA) == []
    assert problems({"b": "y", "d": 1}, SCHEMA) == ["answer.a: missing", "answer.d: not known", "answer.b: not one of ['x', None]"]
    assert problems({"a": True}, SCHEMA) == ["answer.a: not of type integer"]
    assert problems({"a": 0}, SCHEMA) == ["answer.a: below 1"] and problems({"a": 10}, SCHEMA) == ["answer.a: above 9"]
    assert problems({"a": 1, "c": [1, "2"]}, SCHEMA) == ["answer.c[1]: not of type number"]
    assert problems([], SCHEMA) == ["answer: not of type object"]


def test_answers_are_sent_back_until_they_are_valid():
    said = iter(["no json", '```json\n{"a": 0}\n```', '{"a": 3}'])
    prompts = []

    def model(prompt):
        prompts.append(prompt)
        return next(said)

    r = Request("task", SCHEMA, [("one", {"a": 1})])
    assert r.ask(model, 'te"xt') == ('{"a": 3}', [], 3)
    assert 'Text: "one"\nAnswer: {"a": 1}' in prompts[0] and 'Text: "te\\"xt"' in prompts[0]
    assert "Problems: answer: no JSON" in prompts[1] and "Problems: answer.a: below 1" in prompts[2]
    assert Request("task", SCHEMA, rounds=1).ask(lambda p: "{}", "t") == (None, ["answer.a: missing"], 1)


def test_cache_and_failing_models(spark, tmp_path):
    df = spark.createDataFrame([(1, "two", "c"), (2, "two", "c"), (3, None, "c"), (4, "", "c"), (5, "bad", "c"), (6, "down", "c")], "id int, text string, `a.key` string")
    log = tmp_path / "log"
    log.mkdir()

    def model(prompt, up=False):
        text = prompt.rsplit('\nText: "', 1)[1].split('"', 1)[0]
        (log / f"{text}_{os.urandom(4).hex()}").touch()
        if text == "down" and not up:
            raise OSError
        return "{}" if text == "bad" else '{"a": 2}'

    r, cache = Request("task", SCHEMA, rounds=2), f"file://{tmp_path}/cache"
    get = lambda m, q=r: {x["id"]: (x["answer"], x["problems"], x["asked"]) for x in structured.answers(df, "text", q, m, cache).collect()}
    want = {1: ('{"a": 2}', [], 1), 2: ('{"a": 2}', [], 1), 3: (None, None, None), 4: ('{"a": 2}', [], 1), 5: (None, ["answer.a: missing"], 2), 6: (None, ["model: OSError"], 0)}
    assert get(model) == want
    calls = lambda: sorted(n.rsplit("_", 1)[0] for n in os.listdir(log))
    assert calls() == ["", "bad", "bad", "down", "two"]
    assert get(lambda p: model(p, True)) == want | {6: ('{"a": 2}', [], 1)}  # only what failed is asked again
    assert calls() == ["", "bad", "bad", "down", "down", "two"]
    get(lambda p: model(p, True), Request("another task", SCHEMA, rounds=1))
    assert calls().count("two") == 2
    assert structured.answers(df, "text", r, model, cache).columns == ["id", "text", "a.key", "answer", "problems", "asked"]
