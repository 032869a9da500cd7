"""License scans: identifier tags and notice phrases by Aho-Corasick, expressions by a shunting yard.

One automaton holds the tag ``spdx-license-identifier:`` and every notice phrase, so a text is read
once whatever their number. What follows a tag, to the end of its line, is an expression of
licence identifiers with AND, OR, WITH and brackets. Dijkstra's shunting yard orders it; OR takes
the most permissive branch, AND the most restrictive, WITH relaxes a copyleft licence one class
where the exception is a linking exception.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TAG = "spdx-license-identifier:"
#: From most permissive to most restrictive; an unknown licence counts as the last but one.
CLASSES = ["public-domain", "permissive", "weak-copyleft", "copyleft", "network-copyleft", "unknown", "non-commercial"]
LICENSES = {
    "CC0-1.0": "public-domain", "Unlicense": "public-domain", "0BSD": "public-domain",
    "MIT": "permissive", "Apache-2.0": "permissive", "BSD-2-Clause": "permissive", "BSD-3-Clause": "permissive", "ISC": "permissive", "Zlib": "permissive", "BSL-1.0": "permissive", "CC-BY-4.0": "permissive", "PSF-2.0": "permissive",
    "LGPL-2.1": "weak-copyleft", "LGPL-3.0": "weak-copyleft", "MPL-2.0": "weak-copyleft", "EPL-2.0": "weak-copyleft", "CC-BY-SA-4.0": "weak-copyleft",
    "GPL-2.0": "copyleft", "GPL-3.0": "copyleft", "AGPL-3.0": "network-copyleft", "SSPL-1.0": "network-copyleft",
    "CC-BY-NC-4.0": "non-commercial", "CC-BY-NC-SA-4.0": "non-commercial", "CC-BY-NC-ND-4.0": "non-commercial", "CC-BY-ND-4.0": "non-commercial",
}
LINKING = {"classpath-exception-2.0", "gcc-exception-3.1", "llvm-exception", "openssl-exception", "linux-syscall-note"}
#: In lower case, blanks single. A phrase inside a longer one that also matches doesn't count.
PHRASES = {
    "released under the mit license": "MIT", "licensed under the mit license": "MIT", "permission is hereby granted, free of charge": "MIT",
    "licensed under the apache license, version 2.0": "Apache-2.0", "apache license 2.0": "Apache-2.0",
    "gnu general public license, version 3": "GPL-3.0", "gnu general public license version 3": "GPL-3.0", "gnu general public license, version 2": "GPL-2.0", "gnu general public license version 2": "GPL-2.0",
    "gnu lesser general public license, version 3": "LGPL-3.0", "gnu lesser general public license, version 2.1": "LGPL-2.1", "gnu affero general public license": "AGPL-3.0",
    "mozilla public license, version 2.0": "MPL-2.0", "mozilla public license version 2.0": "MPL-2.0", "eclipse public license 2.0": "EPL-2.0", "boost software license, version 1.0": "BSL-1.0",
    "redistribution and use in source and binary forms": "BSD-3-Clause", "bsd 2-clause license": "BSD-2-Clause", "bsd 3-clause license": "BSD-3-Clause",
    "permission to use, copy, modify, and/or distribute this software": "ISC", "this is free and unencumbered software released into the public domain": "Unlicense",
    "cc0 1.0 universal": "CC0-1.0", "licensed under cc by 4.0": "CC-BY-4.0", "licensed under cc by-sa 4.0": "CC-BY-SA-4.0", "licensed under cc by-nc 4.0": "CC-BY-NC-4.0",
    "licensed under cc by-nc-sa 4.0": "CC-BY-NC-SA-4.0", "licensed under cc by-nc-nd 4.0": "CC-BY-NC-ND-4.0", "licensed under cc by-nd 4.0": "CC-BY-ND-4.0",
    "server side public license": "SSPL-1.0",
}
_CANON = {k.lower(): k for k in LICENSES}
_TOKEN = re.compile(r"\(|\)|[a-z0-9.+:-]+", re.I)
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_BLANKS = re.compile(r"[ \t\r\n]+")


def canonical(name: str) -> str:
    """A known identifier in its usual spelling, without ``+``, ``-only`` and ``-or-later``; others as given."""
    bare = re.sub(r"(\+|-only|-or-later)$", "", name.lower())
    return _CANON.get(bare, name)


def postfix(expression: str) -> list[str]:
    """The shunting yard: an expression's operands and operators in evaluation order.

    Raises ValueError for unbalanced brackets, missing operands or operators, or an empty text.
    """
    out: list[str] = []
    stack: list[str] = []
    operand_next = True
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if low == "(":
            if not operand_next:
                raise ValueError("no operator before a bracket")
            stack.append("(")
        elif low == ")":
            if operand_next:
                raise ValueError("no operand before a bracket")
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise ValueError("unbalanced bracket")
            stack.pop()
        elif low in _PRECEDENCE:
            if operand_next:
                raise ValueError("no operand before " + low)
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[low]:
                out.append(stack.pop())
            stack.append(low)
            operand_next = True
        else:
            if not operand_next:
                raise ValueError("no operator before " + token)
            out.append(token)
            operand_next = False
    if operand_next:
        raise ValueError("no last operand")
    while stack:
        if stack[-1] == "(":
            raise ValueError("unbalanced bracket")
        out.append(stack.pop())
    return out


def evaluate(expression: str) -> tuple[str, int, list[str]]:
    """Canonical expression, rank of its class and its licences; an ill-formed one is unknown."""
    unknown = CLASSES.index("unknown")
    try:
        order = postfix(expression)
    except ValueError:
        return "NOASSERTION", unknown, []
    stack: list[tuple[str, int, str]] = []
    found: set[str] = set()
    for k, token in enumerate(order):
        if token not in _PRECEDENCE:
            is_exception = k + 1 < len(order) and order[k + 1] == "with"
            name = token.lower() if is_exception else canonical(token)
            if not is_exception:
                found.add(name)
            stack.append((name, CLASSES.index(LICENSES.get(name, "unknown")), "id"))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            relaxed = left[1] - 1 if right[0] in LINKING and CLASSES[left[1]] in ("copyleft", "weak-copyleft", "network-copyleft") else left[1]
            stack.append((f"{left[0]} WITH {right[0]}", relaxed, "id"))
        else:
            sides = [f"({text})" if kind not in ("id", token) else text for text, _, kind in (left, right)]
            pick = min if token == "or" else max
            stack.append((f" {token.upper()} ".join(sides), pick(left[1], right[1]), token))
    return stack[0][0], stack[0][1], sorted(found)


@functools.cache
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for p in (TAG, *PHRASES):
        a.add_word(p, p)
    a.make_automaton()
    return a


def scan_text(text: str | None) -> tuple[str | None, str | None, str | None, int]:
    """``(expression, licenses, class, n_hits)`` of one text; nulls and 0 where nothing is found.

    All that is found holds together, as if joined by AND: tags first in order of place, then the
    licences of notice phrases by name.
    """
    if not text:
        return None, None, None, 0
    low = _BLANKS.sub(lambda m: "\n" if "\n" in m[0] else " ", text.lower())
    hits = [(end - len(p) + 1, end + 1, p) for end, p in automaton().iter(low.replace("\n", " "))]
    if not hits:
        return None, None, None, 0
    hits.sort(key=lambda h: (h[0], -h[1]))
    kept, upto = [], -1
    for h in hits:
        if h[1] > upto:
            kept.append(h)
            upto = h[1]
    parts = []
    for _, end, p in kept:
        if p == TAG:
            line = low[end : low.find("\n", end) if "\n" in low[end:] else None]
            parts.append(evaluate(line.strip(" */#;-<>!\"'")))
    names = {PHRASES[p] for _, _, p in kept if p != TAG}
    parts += [(n, CLASSES.index(LICENSES[n]), [n]) for n in sorted(names)]
    expression = " AND ".join(f"({e})" if " OR " in e and len(parts) > 1 else e for e in dict.fromkeys(p[0] for p in parts))
    return expression, ",".join(sorted({n for p in parts for n in p[2]})), CLASSES[max(p[1] for p in parts)], len(kept)


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, expression, licenses, license_class, n_hits)`` of every row of ``docs``.

    A row without a tag or phrase, a null text among them, has nulls and 0. Repeated rows each count.
    """

    def run(batches):
        for b in batches:
            rows = [scan_text(t) for t in b.column("text").to_pylist()]
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.string()) for c in cols[:3]), pa.array(cols[3], pa.int32())], ["doc_id", "expression", "licenses", "license_class", "n_hits"])

    picked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, expression string, licenses string, license_class string, n_hits int")


def oracle() -> str:
    """SQL for texts without tags, as all of the test tables are: phrases only."""
    values = ", ".join(f"('{p}', '{n}', {CLASSES.index(LICENSES[n])})" for p, n in PHRASES.items())
    classes = "[" + ", ".join(f"'{c}'" for c in CLASSES) + "]"
    return f"""
with p(phrase, name, rank) as (values {values}),
t as (select row_number() over () as r, doc_id, regexp_replace(lower(text), '[ \\t\\r\\n]+', ' ', 'g') as low from documents),
h as (select r, name, rank, (len(low) - len(replace(low, phrase, ''))) // len(phrase) as n from t join p on contains(low, phrase)),
g as (select r, string_agg(distinct name, ',' order by name) as licenses, string_agg(distinct name, ' AND ' order by name) as expression, max(rank) as rank, sum(n) as n from h group by r)
select doc_id, expression, licenses, {classes}[rank + 1] as license_class, coalesce(n, 0)::integer as n_hits from t left join g using (r)
"""
