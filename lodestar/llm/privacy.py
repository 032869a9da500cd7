"""Information-theoretic sanitisation of personal data.

Protected entities are e-mail addresses, telephone numbers, network addresses, account and identity
numbers and secrets, found by pattern. An entity e reveals itself wholly, so each occurrence is
generalised to its kind. A term t near it may reveal it too: of the entity's information
IC(e) = log2(1 / p(e)), p(e) = n(e) / N, the term gives away PMI(t, e) = log2(p(e | t) / p(e)), where n
counts documents of the whole corpus, n(t, e) those where t stands within REACH words of e, and
p(e | t) = (n(t, e) + PRIOR p(e)) / (n(t) + PRIOR): few joint occurrences of a term are little evidence,
and draw the estimate to that of no relation. Where the share PMI / IC is at least GENERALISE, the term
is put in more general words near that entity, and where it is at least REMOVE, it is taken out. So a
rare word beside an address that one document has is treated, and a common one is left.

Terms are counted in all documents. Texts are never shuffled but for those that hold an entity.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestar.llm.textutil import distinct, lower, mix64, pieces, text_bytes, words
from lodestar.runtime import cut

REACH = 10
GENERALISE = 0.6
REMOVE = 0.9
#: Documents without a relation that each term is taken to be in besides its own.
PRIOR = 1.0

KINDS = {
    "SECRET": rb"(?i:\b(?:api[_-]?key|access[_-]?key|secret|token|password|passwd|pwd)\b\W{0,6}[=:]\W{0,6}[A-Za-z0-9_/+.-]{8,})|\bAKIA[0-9A-Z]{16}\b|\b(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{32,}\b|\b(?=[0-9A-F]*[0-9])(?=[0-9A-F]*[A-F])[0-9A-F]{32,}\b",
    "EMAIL": rb"[A-Za-z0-9_.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "PHONE": rb"\+\d{1,3}[^\w\n]{0,5}\(?\d{2,4}\)?[^\w\n]{0,5}\d{3,4}(?:[^\w\n]{0,5}\d{3,4})?\b|\(\d{3}\)[^\w\n]{0,5}\d{3}[ .-]\d{4}\b|\b\d{3}[.-]\d{3}[.-]\d{4}\b",
    "IP": rb"\b(?:\d{1,3}\.){3}\d{1,3}\b|\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b",
    "ACCOUNT": rb"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b|\b\d(?:[ -]?\d){12,18}\b",
    "ID": rb"\b\d{3}-\d{2}-\d{4}\b",
}
PATTERN = re.compile(b"|".join(b"(?P<%s>%s)" % (k.encode(), p) for k, p in KINDS.items()))
#: Every entity has three digits, or an at sign, or the name of a secret, or begins like an access key or
#: an account of few digits; the other texts needn't be searched.
MAYBE = r"@|AKIA|[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}|[0-9].{0,40}[0-9].{0,40}[0-9]|(?i:key|secret|token|password|passwd|pwd)|[A-Fa-f0-9]{32}|:[0-9a-fA-F]{1,4}:"


def entities(data: bytes) -> list[tuple[int, int, str, int]]:
    """Start, end, kind and hash of each entity of a text, in order; they don't overlap."""
    return [(m.start(), m.end(), m.lastgroup, _hash(m.lastgroup, m[0])) for m in PATTERN.finditer(data)]


def _hash(kind: str, value: bytes) -> int:
    import hashlib

    plain = re.sub(rb"[^0-9a-z@.]", b"", value.lower())
    return int.from_bytes(hashlib.blake2b(kind.encode() + b":" + plain, digest_size=8).digest(), "little", signed=True)


def near(found, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """For each entity the words within REACH of it that belong to no entity."""
    taken = np.zeros(len(start), bool)
    spans = []
    for a, b, _, _ in found:
        i, j = np.searchsorted(end, a, "right"), np.searchsorted(start, b, "left")
        spans.append((i, j))
        taken[i:j] = True
    return [np.array([k for k in (*range(max(0, i - REACH), i), *range(j, min(len(start), j + REACH))) if not taken[k]], np.int64) for i, j in spans]


def _walk(col: pa.Array):
    """For each text of a column its bytes, and its words' starts, ends and hashes."""
    data, off = text_bytes(col)
    start, end, h, at = words(lower(data), off)
    for i in range(len(col)):
        a, b = at[i], at[i + 1]
        yield data[off[i] : off[i + 1]].tobytes(), start[a:b] - off[i], end[a:b] - off[i], h[a:b]


def _picked(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def contexts(docs: DataFrame) -> DataFrame:
    """``(doc, entity, term)``: the terms near each entity of a document, each once; term 0 stands for the entity alone."""

    def run(batches):
        n = 0
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 40
        for batch in batches:
            for b in pieces(batch, "text", 1 << 20):
                rows: set[tuple[int, int, int]] = set()
                for data, start, end, h in _walk(b.column("text")):
                    n += 1
                    found = entities(data)
                    for (_, _, _, e), around in zip(found, near(found, start, end)):
                        rows.add((part + n, e, 0))
                        rows.update((part + n, e, int(t)) for t in h[around].view(np.int64))
                cols = list(zip(*sorted(rows))) if rows else [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc", "entity", "term"])

    return _picked(docs).filter(F.col("text").rlike(MAYBE)).mapInArrow(run, "doc long, entity long, term long")


def term_counts(docs: DataFrame) -> DataFrame:
    """``(term, n)``: in how many documents of a partition each term stands; term 0 counts the documents."""

    def merged(terms, counts):
        u, back = np.unique(np.concatenate(terms), return_inverse=True)
        return u, np.bincount(back, np.concatenate(counts)).astype(np.int64)

    def run(batches):
        terms, counts, held, docs_seen = [], [], 0, 0
        for batch in batches:
            for b in pieces(batch, "text", 2 << 20):
                data, off = text_bytes(b.column("text"))
                _, _, h, at = words(lower(data), off)
                docs_seen += b.num_rows
                u, c = np.unique(distinct(h, at)[0], return_counts=True)
                terms.append(u)
                counts.append(c)
                held += len(u)
                if held > 1_500_000:
                    u, c = merged(terms, counts)
                    terms, counts, held = [u], [c], len(u)
                    if held > 1_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], ["term", "n"])
                        terms, counts, held = [], [], 0
        if terms:
            u, c = merged(terms, counts)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], ["term", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([docs_seen], pa.int64())], ["term", "n"])

    return _picked(docs).mapInArrow(run, "term long, n long")


def revealing(docs: DataFrame) -> DataFrame:
    """``(entity, term, share)`` where a term gives away GENERALISE of an entity's information or more."""
    c = cut(contexts(docs))
    joint = c.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("nte"))
    of = joint.filter("term = 0").select("entity", F.col("nte").alias("ne"))
    wanted = joint.filter(F.col("term") != 0)
    counted = cut(term_counts(docs).join(wanted.select("term").distinct().union(docs.sparkSession.range(1).select(F.col("id").alias("term"))), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("nt")))
    total = counted.filter("term = 0").select(F.col("nt").alias("N"))
    x = wanted.join(of, "entity").join(counted, "term").crossJoin(F.broadcast(total))  # one row
    p = F.col("ne") / F.col("N")
    share = F.log2((F.col("nte") + PRIOR * p) / ((F.col("nt") + PRIOR) * p)) / F.log2(1 / p)
    return x.filter("N > ne").withColumn("share", share).filter(F.col("share") >= GENERALISE).select("entity", "term", "share")


_CAPITAL = re.compile(rb"^(?:[A-Z]|\xc3[\x80-\x9e])")


def general(word: bytes) -> bytes:
    """More general words for a term."""
    if any(48 <= c <= 57 for c in word):
        return b"<NUMBER>"
    return b"<NAME>" if _CAPITAL.match(word) else b"<TERM>"


def clean(data: bytes, start: np.ndarray, end: np.ndarray, h: np.ndarray, shares: dict[tuple[int, int], float]) -> tuple[bytes, int, int]:
    """The sanitised text, how many entities and how many terms it lost."""
    found = entities(data)
    edits: dict[int, tuple[int, bytes]] = {a: (b, b"<%s>" % kind.encode()) for a, b, kind, _ in found}
    terms: dict[int, float] = {}
    if shares:
        for (_, _, _, e), around in zip(found, near(found, start, end)):
            for k in around:
                s = shares.get((e, int(h[k].view(np.int64))))
                if s is not None:
                    terms[int(k)] = max(s, terms.get(int(k), 0))
    for k, s in terms.items():
        edits[int(start[k])] = (int(end[k]), b"" if s >= REMOVE else general(data[start[k] : end[k]]))
    out, at = [], 0
    for a in sorted(edits):
        b, text = edits[a]
        out += [data[at:a], text]
        at = b
    return b"".join([*out, data[at:]]), len(found), len(terms)


def sanitise(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, n_entities, n_terms)`` of every row, its text without what it must not disclose.

    A text without an entity is returned as it is, null and empty texts among them. Null ids stay; rows
    that repeat each count in the statistics and are each returned. Texts are searched whole, whatever
    their length; of two entities' shares for one word the larger counts. An empty table gives no rows.
    Other columns, whatever their names, are not read.
    """
    pairs = revealing(docs)
    has = F.col("text").rlike(MAYBE)
    rows = _picked(docs)
    untouched = rows.filter(F.col("text").isNull() | ~has).select("doc_id", "text", F.lit(0).alias("n_entities"), F.lit(0).alias("n_terms"))

    def listed(batches):
        for batch in batches:
            for b in pieces(batch, "text", 1 << 20):
                found = [sorted({e for _, _, _, e in entities(t[0])}) for t in _walk(b.column("text"))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "text", "found"])

    def run(batches):
        for batch in batches:
            for b in pieces(batch, "text", 1 << 20):
                cols: list[list] = [[], [], []]
                for t, known in zip(_walk(b.column("text")), b.column("shares").to_pylist()):
                    got = clean(*t, {(k["entity"], k["term"]): k["share"] for k in known or []})
                    for c, v in zip(cols, got):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x.decode("utf-8", "replace") for x in cols[0]], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], ["doc_id", "text", "n_entities", "n_terms"])

    held = rows.filter(has).mapInArrow(listed, "doc_id long, text string, found array<long>").withColumn("row", F.monotonically_increasing_id())
    held = cut(held)  # a few per cent of the texts; row numbers must not change between uses
    by_row = held.select("row", F.explode("found").alias("entity")).join(pairs, "entity").groupBy("row").agg(F.collect_list(F.struct("entity", "term", "share")).alias("shares"))
    touched = held.join(by_row, "row", "left").select("doc_id", "text", "shares").mapInArrow(run, "doc_id long, text string, n_entities int, n_terms int")
    return untouched.union(touched)
