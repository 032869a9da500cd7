import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestar.llm import decontaminate as dc, neardup as nd, textutil as tu
from lodestar.runtime import table


def plain_words(t):
    return [w.lower() for w in re.findall(r"[^\W]+", t or "")]


def test_words_and_shingles_equal_plain():
    texts = ["One two, THREE\tÉté çà!", None, "", "x", "a b", "ab" * 3000 + " c", "a b a b a b a b"]
    data, off = tu.text_bytes(pa.array(texts))
    start, end, h, at = tu.words(tu.lower(data), off)
    low = tu.lower(data).tobytes()
    for i, t in enumerate(texts):
        got = [low[a:b].decode() for a, b in zip(start[at[i] : at[i + 1]], end[at[i] : at[i + 1]])]
        assert got == plain_words(t)
    by = defaultdict(set)
    for a, b, x in zip(start, end, h):
        by[low[a:b]].add(int(x))
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)
    s, sat = tu.shingles(h, at, 4)
    assert [int(n) for n in np.diff(sat)] == [2, 0, 0, 1, 1, 1, 5]
    v, vat = tu.distinct(s, sat)
    assert [int(n) for n in np.diff(vat)] == [2, 0, 0, 1, 1, 1, 2]
    # a text's hashes don't depend on its neighbours
    alone = tu.shingles(*tu.words(tu.lower(tu.text_bytes(pa.array([texts[6]]))[0]), tu.text_bytes(pa.array([texts[6]]))[1])[2:], 4)[0]
    assert (alone == s[sat[6] : sat[7]]).all()


def near_pairs(texts):
    """All pairs whose smaller shingle set lies in the larger to T, whatever their sizes, and which are mutual."""
    sets = {}
    for i, t in texts.items():
        w = plain_words(t)
        if w:
            sets[i] = frozenset(tuple(w[j : j + nd.K]) for j in range(max(1, len(w) - nd.K + 1)))
    inverse = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            inverse[g].append(i)
    common = Counter()
    for ids in inverse.values():
        for x in range(len(ids)):
            for y in range(x):
                common[min(ids[x], ids[y]), max(ids[x], ids[y])] += 1
    near = {p for p, n in common.items() if n >= nd.T * min(len(sets[p[0]]), len(sets[p[1]]))}
    return near, {p for p in near if common[p] >= nd.T * max(len(sets[p[0]]), len(sets[p[1]]))}


def test_recall_against_all_pairs(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    near, mutual = near_pairs(texts)
    group = {r.doc_id: r.group_id for r in nd.groups(docs).collect()}
    same = lambda p: p[0] in group and group[p[0]] == group.get(p[1])
    assert len(mutual) > 50 and np.mean([same(p) for p in mutual]) >= 0.98
    assert np.mean([same(p) for p in near]) >= 0.9
    linked = {i for p in near for i in p}
    assert set(group) <= linked  # no document is in a group without a near pair
    kept = Counter(group.values())
    assert all(n >= 2 for n in kept.values())


def edited(rng, words, share):
    return [rng.choice(["alpha", "beta", "gamma", "delta"]) if rng.random() < share else w for w in words]


def test_hot_groups_containment_and_clean_documents(spark, docs_of):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(4000)]
    hot = [rng.choice(vocab) for _ in range(220)]
    passage = [rng.choice(vocab) for _ in range(55)]
    texts = [" ".join(edited(rng, hot, 0.03)) for _ in range(300)] + [" ".join(hot)] * 40
    clean = [" ".join([rng.choice(vocab) for _ in range(200)] + passage + [rng.choice(vocab) for _ in range(200)]) for _ in range(120)]
    whole = [rng.choice(vocab) for _ in range(400)]
    texts += clean + [" ".join(whole), " ".join(whole[60:330])]
    g = {r.doc_id: (r.group_id, r.kept) for r in nd.groups(docs_of(texts)).collect()}
    assert len({g[i][0] for i in range(340)}) == 1 and sum(g[i][1] for i in range(340)) == 1
    assert not any(i in g for i in range(340, 460))  # a shared passage makes no copies
    assert g[460] == (460, True) and g[461] == (460, False)


def test_short_text_joins_nothing_together(spark, docs_of):
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(3000)]
    quote = [rng.choice(vocab) for _ in range(80)]
    a, b = ([rng.choice(vocab) for _ in range(n)] for n in (90, 100))
    g = {r.doc_id: r.group_id for r in nd.groups(docs_of([" ".join(a + quote), " ".join(quote), " ".join(b + quote)])).collect()}
    assert not (0 in g and 2 in g and g[0] == g[2])


def test_components_equal_union_find(spark):
    rng = random.Random(11)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(230)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = {r.id: r.comp for r in nd.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert nd.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_neardup_odd_rows(spark, odd_docs, no_docs):
    assert {(r.doc_id, r.group_id, r.kept) for r in nd.groups(odd_docs).collect()} == {(4, 4, True), (5, 4, False)}
    assert nd.groups(no_docs).collect() == []
    # document 5 is a copy, and one of two equal rows of document 3 is enough
    assert nd.stage(spark, odd_docs, None).count() == 8


def plain_leaks(docs, items):
    """Every window of the item's size, held against it exactly."""
    out = {}
    for i, item in items.items():
        w = plain_words(item)
        weight = {p: len(p[0].encode()) + len(p[1].encode()) for p in zip(w, w[1:])}
        total = sum(weight.values())
        for d, t in docs.items():
            v = plain_words(t)
            pairs = list(zip(v, v[1:]))
            hits = [p in weight for p in pairs]
            if not any(hits):
                continue
            best = 0
            for a in range(max(1, len(pairs) - (len(w) - 1) + 1)):
                if hits[a] or a == 0:
                    best = max(best, sum(weight[p] for p in set(pairs[a : a + len(w) - 1]) if p in weight) / total)
            if best >= dc.LEAST:
                out[d, i] = best
    return out


def test_leaks_equal_every_window(spark):
    docs, items = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "benchmark"))
    want = plain_leaks({r.doc_id: r.text for r in docs.collect()}, {r.item_id: r.text for r in items.collect()})
    got = {(r.doc_id, r.item_id): r.similarity for r in dc.leaks(docs, items).collect()}
    assert len(want) > 10 and set(got) <= set(want)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_edited_passages_are_found(spark, docs_of):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    items = [[rng.choice(vocab) for _ in range(rng.randint(15, 60))] for _ in range(80)]
    texts, want = [], set()
    for k in range(240):
        body = [rng.choice(vocab) for _ in range(300)]
        if k % 2:
            i = rng.randrange(80)
            w = list(items[i])
            w[rng.randrange(len(w))] = "changed"
            at = rng.randrange(300)
            body[at:at] = w
            want.add((k, i))
        texts.append(" ".join(body).upper() if k % 3 == 0 else ", ".join(body))
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.leaks(docs_of(texts), b).collect()}
    assert got == want


def test_multi_index_finds_all_within_radius():
    rng = np.random.default_rng(2)
    index = dc.Index([(i, " ".join(f"t{i}x{j}" for j in range(20))) for i in range(30)])
    (size, c), = index.sizes.items()
    assert size == 20 and dc.RADIUS >= dc.radius_for(dc.LEAST)
    for x in index.items:
        for r in range(dc.RADIUS + 1):
            bits = rng.choice(64, r, replace=False)
            v = int(x["print"]) ^ sum(1 << int(b) for b in bits)
            found = {int(i) for k, (at, who) in enumerate(c["tables"]) for i in who[at[v >> 8 * k & 0xFF] : at[(v >> 8 * k & 0xFF) + 1]]}
            assert index.items.index(x) in found


def test_decontaminate_odd_rows(spark, odd_docs, no_docs, docs_of):
    b = spark.createDataFrame([(1, None), (None, "a b c"), (2, ""), (3, "word"), (4, "same words here as there"), (4, "same words here as there")], "item_id long, text string")
    got = dc.leaks(odd_docs, b).collect()
    assert {r.doc_id for r in got} == {4, 5} and len(got) == 4
    assert dc.leaks(no_docs, b).collect() == [] and dc.leaks(odd_docs, b.limit(0)).collect() == []
    passes = list(dc.passes(spark.createDataFrame([(i, "a b") for i in range(50)], "item_id long, text string"), 20))
    assert len(passes) == 3 and sorted(i for p in passes for i, _ in p) == list(range(50))


def contained_pairs(texts):
    """All pairs whose smaller set lies in the larger to T: (smaller, larger) -> (sizes, whether each holds the other)."""
    sets = {i: frozenset(tuple(w[j : j + nd.K]) for j in range(max(1, len(w) - nd.K + 1))) for i, w in ((i, plain_words(t)) for i, t in texts.items()) if w}
    out = {}
    for i in sets:
        for j in sets:
            if (len(sets[i]), -i) < (len(sets[j]), -j) and len(sets[i] & sets[j]) >= nd.T * len(sets[i]):
                out[i, j] = len(sets[i]), len(sets[j]), len(sets[i] & sets[j]) >= nd.T * len(sets[j])
    return out


def test_members_below_the_head_are_compared(spark, docs_of):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(4000)]
    for share in (0.05, 0.06):
        base = [rng.choice(vocab) for _ in range(200)]
        texts = [" ".join(rng.choice(vocab) if rng.random() < share else w for w in base) for _ in range(150)]
        pairs = contained_pairs(dict(enumerate(texts)))
        parent = list(range(150))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for (i, j), (_, _, mutual) in pairs.items():
            if mutual:
                parent[find(i)] = find(j)
        g = {r.doc_id: r.group_id for r in nd.groups(docs_of(texts)).collect()}
        assert len({find(i) for i in range(150)}) < 75
        assert all(i in g and g[i] == g.get(j) for i in range(150) for j in range(i) if find(i) == find(j))


def test_leaks_near_the_threshold_equal_every_window(spark, docs_of):
    rng = random.Random(12)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    items = {i: [rng.choice(vocab) for _ in range(rng.randint(15, 80))] for i in range(60)}
    docs = {}
    for k in range(300):
        body = [rng.choice(vocab) for _ in range(150)]
        at = rng.randrange(150)
        body[at:at] = [rng.choice(vocab) if rng.random() < 0.02 * (k % 9) else w for w in items[k % 60]]
        docs[k] = " ".join(body + ["end"])
    want = plain_leaks(docs, {i: " ".join(w) for i, w in items.items()})
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in dc.leaks(docs_of([docs[k] for k in range(300)]), b).collect()}
    assert sum(s < 0.85 for s in want.values()) > 40
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-9 for p in got)


def test_texts_contained_in_far_larger_ones_are_found(spark, docs_of):
    rng = random.Random(21)
    vocab = [f"w{i}" for i in range(4000)]
    large = [[rng.choice(vocab) for _ in range(600)] for _ in range(20)]
    texts = [" ".join(w) for w in large] + [" ".join(w[100 : 100 + n]) for w, n in zip(large, range(8, 48, 2))]
    g = {r.doc_id: r.group_id for r in nd.groups(docs_of(texts)).collect()}
    assert g == {i: i % 20 for i in range(40)}


def test_recall_at_the_bound_of_each_distance(spark, docs_of):
    rng = random.Random(22)
    vocab = [f"w{i}" for i in range(4000)]
    texts = []
    for ratio in (1.9, 3.9, 7.5):
        for _ in range(40):
            small = [rng.choice(vocab) for _ in range(70)]
            larger = small[:54] + [rng.choice(vocab) for _ in range(int(67 * ratio) - 51)]
            texts += [" ".join(small), " ".join(larger)]
    pairs = contained_pairs(dict(enumerate(texts)))
    by = Counter(int(np.frexp(float(n))[1] - np.frexp(float(m))[1]) for m, n, _ in pairs.values())
    assert by == {0: 40, 1: 40, 2: 40} or sum(by.values()) == 120
    g = {r.doc_id: r.group_id for r in nd.groups(docs_of(texts)).collect()}
    assert all(p[0] in g and g[p[0]] == g.get(p[1]) for p in pairs)


def test_containment_in_crowded_buckets(spark, docs_of):
    rng = random.Random(23)
    vocab = [f"w{i}" for i in range(4000)]
    passage = [rng.choice(vocab) for _ in range(40)]
    large = [passage + [rng.choice(vocab) for _ in range(200)] for _ in range(200)]
    texts = [" ".join(w) for w in large] + [" ".join(large[i][15:70]) for i in range(30)]
    g = {r.doc_id: r.group_id for r in nd.groups(docs_of(texts)).collect()}
    assert g == {i: i % 200 for i in [*range(30), *range(200, 230)]}


def test_a_common_line_does_not_pair_all_that_have_it(spark, docs_of, monkeypatch):
    rng = random.Random(24)
    vocab = [f"w{i}" for i in range(4000)]
    line = [rng.choice(vocab) for _ in range(14)]
    texts = [[rng.choice(vocab) for _ in range(60 + i % 40)] + line for i in range(300)]
    texts += [[rng.choice(vocab) for _ in range(12)] + line for _ in range(300)]
    texts += [[rng.choice(vocab) for _ in range(3)] + line for _ in range(30)]
    texts += [texts[7][50:] for _ in range(1)] + [texts[400][2:] + ["end"], line[:13]]
    texts = [" ".join(w) for w in texts]
    pairs = []
    plain = nd.common

    def counted(p, sets):
        pairs.append(p.count())
        return plain(p, sets)

    monkeypatch.setattr(nd, "common", counted)
    g = {r.doc_id: r.group_id for r in nd.groups(docs_of(texts)).collect()}
    # short texts are copies of one another and lie in all others, so in the largest; all of it is compared once
    best = 39
    assert g == {**{i: best for i in [*range(600, 630), best, 632]}, 7: 7, 630: 7, 400: 400, 631: 400}
    assert sum(pairs) < 3000
