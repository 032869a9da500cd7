import json
import random

import pytest

from lodestar.llm import chat, licenses


def descend(text):
    """A recursive-descent reading of an expression: the rank of its class."""
    tokens = licenses._TOKEN.findall(text)

    def rank(name):
        return licenses.CLASSES.index(licenses.LICENSES.get(licenses.canonical(name), "unknown"))

    def disjunction():
        out = conjunction()
        while tokens and tokens[0].lower() == "or":
            tokens.pop(0)
            out = min(out, conjunction())
        return out

    def conjunction():
        out = atom()
        while tokens and tokens[0].lower() == "and":
            tokens.pop(0)
            out = max(out, atom())
        return out

    def atom():
        t = tokens.pop(0)
        if t == "(":
            out = disjunction()
            assert tokens.pop(0) == ")"
            return out
        out = rank(t)
        if tokens and tokens[0].lower() == "with":
            tokens.pop(0)
            if tokens.pop(0).lower() in licenses.LINKING and "copyleft" in licenses.CLASSES[out]:
                out -= 1
        return out

    return disjunction()


def test_yard_equals_descent():
    rng = random.Random(4)

    def make(depth):
        if not depth or rng.random() < 0.3:
            name = rng.choice([*licenses.LICENSES, "Foo-1.0", "GPL-2.0-or-later", "mit"])
            return name + (" WITH " + rng.choice(["Classpath-exception-2.0", "Odd-exception"]) if rng.random() < 0.2 else "")
        parts = f" {rng.choice(['AND', 'OR', 'and'])} ".join(make(depth - 1) for _ in range(rng.randint(2, 3)))
        return f"({parts})" if rng.random() < 0.5 else parts

    for _ in range(400):
        text = make(3)
        expression, rank, _ = licenses.evaluate(text)
        assert rank == descend(text) and licenses.evaluate(expression)[1] == rank, text


@pytest.mark.parametrize("bad", ["", "MIT AND", "OR MIT", "(MIT", "MIT)", "MIT Apache-2.0", "MIT (GPL-2.0)", "()"])
def test_ill_formed(bad):
    assert licenses.evaluate(bad)[0] == "NOASSERTION"


def test_scan_texts():
    assert licenses.scan_text("x\n// SPDX-License-Identifier: MIT OR GPL-2.0-only\nint main;") == ("MIT OR GPL-2.0", "GPL-2.0,MIT", "permissive", 1)
    assert licenses.scan_text("Released under the  MIT\nLicense. Licensed under CC BY-NC 4.0.")[:3] == ("CC-BY-NC-4.0 AND MIT", "CC-BY-NC-4.0,MIT", "non-commercial")
    assert licenses.scan_text("no notice") == (None, None, None, 0) == licenses.scan_text(None)


def test_scan_odd_rows(odd_docs, no_docs):
    assert licenses.scan(odd_docs).count() == 10 and licenses.scan(no_docs).collect() == []


LAYOUTS = {
    "messages": {"messages": [{"role": "User", "content": "q"}, {"role": "model", "content": "a"}], "extra": {"deep": [1, {"x": None}]}},
    "conversations": {"id": 7, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
    "dialog": {"dialog": {"turns": [{"speaker": "customer", "utterance": {"text": "q"}}, {"speaker": "agent", "utterance": {"text": "a"}}]}},
    "prompt_completion": {"prompt": "q", "completion": "a"},
    "prompt_response": {"prompt": "q", "response": "a", "score": 0.5},
    "instruction": {"instruction": "q", "output": "a"},
    "instruction_input": {"instruction": "q", "input": "", "output": "a"},
}


def test_layouts_become_the_same_turns(spark):
    rows = [(i, json.dumps(v)) for i, v in enumerate(LAYOUTS.values())]
    got = chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, record string")).orderBy("conv_id", "turn").collect()
    for i, name in enumerate(LAYOUTS):
        assert [(r.layout, r.turn, r.role, r.text) for r in got if r.conv_id == i] == [(name, 0, "user", "q"), (name, 1, "assistant", "a")]


def test_records_that_are_odd(spark):
    rows = [(1, None), (2, "not json"), (3, "{}"), (4, '{"other": 1}'), (5, '{"messages": [{"role": null, "content": null}]}'), (6, '{"messages": []}'), (7, "[1, 2]"), (None, '{"prompt": "p", "completion": "c"}')]
    got = chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, record string")).collect()
    layouts = {r.conv_id: r.layout for r in got}
    assert {k for k, v in layouts.items() if v == "unknown"} == {1, 2, 3, 4, 6, 7} and layouts[None] == "prompt_completion"
    assert [(r.role, r.text) for r in got if r.conv_id == 5] == [(None, None)]
    assert chat.canonical_turns(spark.createDataFrame([], "conv_id long, record string")).collect() == []


def test_records_of_several_layouts_and_parts(spark):
    turns = [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]
    rows = [
        {"prompt": "p", "messages": turns}, {"system": "s", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"messages": [{"role": "user", "content": [{"type": "text", "text": "one"}, {"type": "image", "url": "u"}, {"type": "text", "text": "two"}]}, {"role": "assistant", "content": "a" * 300_000}]},
    ]
    df = spark.createDataFrame([(i, json.dumps(r), 1, "x") for i, r in enumerate(rows)], "conv_id long, record string, turn int, layout string")
    got = {(r.conv_id, r.turn): (r.layout, r.role, r.text) for r in chat.canonical_turns(df).collect()}
    assert got[0, 0] == ("messages", "user", "q") and got[1, 1] == ("conversations", "assistant", "a")
    assert got[2, 0] == ("messages", "user", "one\ntwo") and len(got[2, 1][2]) == 300_000 and len(got) == 6


def test_fingerprints_differ():
    assert len(chat.FINGERPRINTS) == len(chat.MAPPINGS)
    assert chat.schema_paths("OBJECT<a: ARRAY<OBJECT<b: STRING, c: OBJECT<d: BIGINT>>>, e: DECIMAL(3,1)>") == ("a", "a[]", "a[].b", "a[].c", "a[].c.d", "e")
