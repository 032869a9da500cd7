"""Chat formatting by schema fingerprints.

A record's nested field paths, without types and places in arrays, are hashed into a fingerprint.
A registry of declarative mappings says, for each layout's fingerprint, where turns, roles and texts
stand. Paths that no mapping mentions don't enter the fingerprint, so extra fields change nothing; where
a record also has fields of other mappings, its fingerprint is that of the mapping that it holds whole
and that has the most paths, of equals the first.
Records are read into Spark's variant type, which is also what their paths come from; only the
text of a record's schema, a short string that few records do not share, goes through Python.
"""

from __future__ import annotations

import functools
import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F

ROLES = {"user": "user", "human": "user", "prompter": "user", "customer": "user", "assistant": "assistant", "gpt": "assistant", "bot": "assistant", "model": "assistant", "agent": "assistant", "system": "system", "tool": "tool", "function": "tool"}

#: name -> (list of turns, role in a turn, text in a turn) or [(role, text path), ...] for flat layouts.
MAPPINGS = {
    "messages": ("messages", "role", "content"),
    "conversations": ("conversations", "from", "value"),
    "dialog": ("dialog.turns", "speaker", "utterance.text"),
    "prompt_completion": [("user", "prompt"), ("assistant", "completion")],
    "prompt_response": [("user", "prompt"), ("assistant", "response")],
    "instruction": [("user", "instruction"), ("assistant", "output")],
    "instruction_input": [("user", "instruction+input"), ("assistant", "output")],
    "system_prompt": [("system", "system"), ("user", "prompt"), ("assistant", "response")],
}


def paths_of(mapping) -> list[str]:
    if isinstance(mapping, tuple):
        head = mapping[0].split(".")
        out = [".".join(head[: i + 1]) for i in range(len(head))]
        base = mapping[0] + "[]"
        for leaf in mapping[1:]:
            at = leaf.split(".")
            out += [base + "." + ".".join(at[: i + 1]) for i in range(len(at))]
        return sorted({*out, base})
    return sorted(p for _, text in mapping for p in text.split("+"))


VOCABULARY = {p for m in MAPPINGS.values() for p in paths_of(m)}


def hash_paths(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths) & VOCABULARY)).encode()).hexdigest()[:16]


FINGERPRINTS = {hash_paths(paths_of(m)): name for name, m in MAPPINGS.items()}

_PART = re.compile(r"OBJECT<|ARRAY<|>|, |`(?:[^`]|``)*`: |[^<>,:`]+: |[^<>,:`]+(?:\(\d+,\d+\))?")


@functools.lru_cache(1 << 16)
def schema_paths(schema: str) -> tuple[str, ...]:
    """Field paths of a variant's schema, as ``a``, ``a[]``, ``a[].b``."""
    out: list[str] = []
    stack: list[str] = [""]
    name = ""
    for token in _PART.findall(schema):
        if token.endswith(": "):
            key = token[:-2]
            key = key[1:-1].replace("``", "`") if key.startswith("`") else key
            name = f"{stack[-1]}.{key}".lstrip(".")
            out.append(name)
        elif token == "OBJECT<":
            stack.append(name)
        elif token == "ARRAY<":
            name += "[]"
            out.append(name)
            stack.append(name)
        elif token == ">":
            stack.pop()
            name = stack[-1]
    return tuple(out)


@functools.lru_cache(1 << 16)
def schema_fingerprint(schema: str) -> str:
    """The fingerprint of a schema's own paths or, if no mapping has it, of the largest mapping that lies in them."""
    paths = set(schema_paths(schema))
    own = hash_paths(paths)
    if own in FINGERPRINTS:
        return own
    whole = [m for m in map(paths_of, MAPPINGS.values()) if paths.issuperset(m)]
    return hash_paths(max(whole, key=len)) if whole else own


def _fingerprint(schema):
    def each(schemas: pd.Series) -> pd.Series:
        return schemas.map(lambda s: schema_fingerprint(s) if s is not None else None)

    return F.pandas_udf(each, "string")(schema)


def _text(v, path: str):
    return F.try_variant_get(v, "$." + path, "string")


def _content(v, path: str):
    """A turn's text; of a list of parts, the texts of those that have one, a line each."""
    part = lambda p: F.when(F.schema_of_variant(p).startswith("OBJECT"), _text(p, "text")).otherwise(F.try_variant_get(p, "$", "string"))
    parts = F.try_variant_get(v, "$." + path, "array<variant>")
    return F.when(parts.isNotNull(), F.array_join(F.transform(parts, part), "\n")).otherwise(_text(v, path))


def _role(c):
    known = F.create_map(*[x for k, v in ROLES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(c))), F.lower(F.trim(c)))


def _turns(v, mapping):
    """The canonical turns of a record, as an array of (role, text), for one mapping."""
    if isinstance(mapping, tuple):
        items = F.try_variant_get(v, "$." + mapping[0], "array<variant>")
        return F.transform(items, lambda x: F.struct(_role(_text(x, mapping[1])).alias("role"), _content(x, mapping[2]).alias("text")))
    turns = []
    for role, text in mapping:
        parts = [_text(v, p) for p in text.split("+")]
        parts = [F.when(p != "", p) for p in parts] if len(parts) > 1 else parts
        value = F.concat_ws("\n\n", *parts) if len(parts) > 1 else parts[0]
        turns.append(F.struct(F.lit(role).alias("role"), value.alias("text")))
    return F.array(*turns)


def canonical_turns(records: DataFrame, key: str = "conv_id", record: str = "record") -> DataFrame:
    """``(<key>, layout, turn, role, text)``: the turns of every JSON record, numbered from 0.

    A record that is null, no JSON, or of a layout without a mapping gives one row with layout
    ``unknown`` and nulls; so does one whose list of turns is empty, since such a list has no fields.
    Turns whose text is null stay, with a null text. Roles are those of ROLES, others in lower case.
    Records that repeat are each read, texts of any length whole; an empty table gives no rows. Fields
    and columns of other names, also ones that clash with columns here, are not read.
    """
    v = F.try_parse_json(F.col(record))
    t = records.select(F.col(key), v.alias("_v"))
    t = t.withColumn("_f", _fingerprint(F.schema_of_variant("_v")))
    layout = F.coalesce(F.try_element_at(F.create_map(*[x for k, n in FINGERPRINTS.items() for x in (F.lit(k), F.lit(n))]), F.col("_f")), F.lit("unknown"))
    t = t.withColumn("layout", layout)
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for name, mapping in MAPPINGS.items():
        turns = F.when(F.col("layout") == name, _turns(F.col("_v"), mapping)).otherwise(turns)
    t = t.select(key, "layout", turns.alias("_turns"))
    return t.select(key, "layout", F.posexplode_outer("_turns").alias("turn", "_t")).select(key, "layout", F.col("turn").cast("bigint").alias("turn"), F.col("_t.role").alias("role"), F.col("_t.text").alias("text"))


def as_collected(conversations: DataFrame) -> DataFrame:
    """``(conv_id, record)``: each conversation as JSON in a layout that its id picks among those that can hold it.

    The test tables hold one layout only; this gives the mixed layouts that canonical_turns reads.
    Conversations of one user and one assistant turn may take a flat layout, all may take a list.
    """
    turn = F.struct("turn", "role", "text")
    conv = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    listed = lambda role, text: F.transform("t", lambda x: F.struct(x["role"].alias(role), text(x)))
    first, second = F.col("t")[0]["text"], F.try_element_at("t", F.lit(2))["text"]
    js = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    pair = (F.size("t") == 2) & (F.col("t")[0]["role"] == "user") & (F.try_element_at("t", F.lit(2))["role"] == "assistant")
    k = F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(7))
    layouts = [
        js(listed("role", lambda x: x["text"].alias("content")).alias("messages"), F.lit("collected").alias("origin")),
        js(F.col("conv_id").alias("id"), listed("from", lambda x: x["text"].alias("value")).alias("conversations")),
        js(F.struct(listed("speaker", lambda x: F.struct(x["text"].alias("text")).alias("utterance")).alias("turns")).alias("dialog")),
        js(first.alias("prompt"), second.alias("completion")),
        js(first.alias("prompt"), second.alias("response")),
        js(first.alias("instruction"), second.alias("output")),
        js(first.alias("instruction"), F.lit("").alias("input"), second.alias("output")),
    ]
    record = F.when(k == 0, layouts[0]).when(k == 1, layouts[1]).when(k == 2, layouts[2])
    for i in (3, 4, 5, 6):
        record = record.when((k == i) & pair, layouts[i])
    return conv.select("conv_id", record.otherwise(layouts[0]).alias("record"))


def chat(conversations: DataFrame) -> DataFrame:
    return canonical_turns(as_collected(conversations)).select("conv_id", "turn", "role", "text")


ORACLE = """
select conv_id, row_number() over (partition by conv_id order by turn) - 1 as turn, role, text from conversations
"""
