import random
import re

import numpy as np
import pytest

from quillgraph.llm import neardup
from quillgraph.llm.components import components


def sets(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def brute(rows, n=3, over=85):
    groups = {}
    for i, t in rows:
        groups.setdefault(sets(t, n), []).append(i)
    nodes = [s for s in groups if s]
    parent = {s: s for s in nodes}

    def root(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if 100 * len(a & b) >= over * len(a | b):
                parent[root(a)] = root(b)
    low = {}
    for s in nodes:
        ids = [x for x in groups[s] if x is not None]
        r = root(s)
        low[r] = min([*ids, *([low[r]] if low.get(r) is not None else [])], default=None)
    out = []
    for i, t in rows:
        s = sets(t, n)
        c = low[root(s)] if s else i
        out.append((i, len(s), c, c == i))
    return sorted(out, key=str)


def edited(text, r, n):
    words = text.split(" ")
    for _ in range(n):
        words[r.randrange(len(words))] = "".join(r.choice("xyz") for _ in range(4))
    return " ".join(words)


def run(spark, docs, **spec):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    return sorted(map(tuple, neardup.near_duplicates(df, spec=neardup.Spec(**spec)).collect()), key=str)


def test_against_brute_force(spark, prose):
    r = random.Random(3)
    rows = []
    for g in range(40):
        base = prose(r.randint(20, 120), g)
        for _ in range(r.randint(1, 7)):
            rows.append(edited(base, r, r.randint(0, 5)))
    hot = prose(60, 999)
    rows += [edited(hot, r, r.randint(0, 3)) for _ in range(120)] + [hot.upper()] * 30 + ["", None, "one", "ONE", "two words", "two  Words"]
    r.shuffle(rows)
    rows = list(enumerate(rows))
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, words=5, over=80, bands=30, rows=4) == brute(rows, 5, 80)


def test_large_buckets_are_compared_in_blocks(spark, prose, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL_BUCKET", 2)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 900)
    monkeypatch.setattr(neardup, "PARTNERS", 4)
    r = random.Random(6)
    text, rows = prose(80, 5), []
    for i in range(60):  # a chain: neighbours link, ends do not
        text = edited(text, r, 1)
        rows.append((i, text))
    rows += [(100 + i, edited(prose(80, 5), r, 6)) for i in range(40)]
    assert run(spark, rows) == brute(rows)


def test_odd_sketch_estimates_and_loses_nothing():
    spec, r = neardup.Spec(), np.random.default_rng(1)
    make = neardup.Sketcher(spec)
    for j, most in ((0.86, True), (0.2, False)):
        within = 0
        for _ in range(60):
            pool = r.integers(0, 2**63, 1000, dtype=np.uint64)
            n = int(1000 * (1 - j) / 2)
            a, b = np.unique(pool[: 1000 - n]), np.unique(pool[n:])
            x = make.odd(make.samples(a)).view(np.uint64) ^ make.odd(make.samples(b)).view(np.uint64)
            within += int(np.bitwise_count(x).sum()) <= spec.most_bits()
        assert within == 60 if most else within <= 2


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, 6000 + i) for i in range(50)] + [(7, 7)]
    labels = {x.node: x.label for x in components(spark.createDataFrame(edges, "a long, b long")).df().collect()}
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    both = {}
    for x, label in labels.items():
        both.setdefault(label, set()).add(root(x))
    assert all(len(v) == 1 for v in both.values()) and len(both) == len({root(x) for x in labels})
    assert components(spark.createDataFrame([], "a long, b long")).rows() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 9])
def test_shingle_sets(n):
    words = [b"a", b"b", b"a", b"b", b"a", b"c", b"d", b"e", b"f"][:n]
    assert len(neardup.shingle_hashes(words, 3)) == len(sets(b" ".join(words).decode(), 3))


def test_odd_and_empty(spark, save, odd_docs, empty_docs):
    got = sorted(map(tuple, neardup.op8_near_duplicates(spark, save(odd_docs)).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert neardup.near_duplicates(empty_docs).count() == 0
    kept = neardup.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() > 0


def test_keep_one_tells_rows_that_share_an_id(spark, prose):
    a, b, c, d = (prose(40, i) for i in range(4))
    rows = [(3, a), (5, a), (5, b), (7, c), (7, c), (None, d), (None, d), (None, b + " end"), (9, ""), (9, ""), (None, None), (None, None), (2, c + " more"), (2, "word")]
    df = spark.createDataFrame([(*r, {"k": 1}) for r in rows], "doc_id long, text string, keep map<string,int>").repartition(3)
    got = sorted(((x.doc_id, x.text) for x in neardup.keep_one(df).collect()), key=str)
    want = [(3, a), (5, b), (None, d), (9, ""), (9, ""), (None, None), (None, None), (2, c + " more"), (2, "word")]
    assert got == sorted(want, key=str)


def test_keep_one_keeps_one_of_each_component(spark, prose):
    r = random.Random(8)
    rows = [(i, edited(prose(80, i % 30), r, r.randint(0, 3))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x.doc_id for x in neardup.keep_one(df).collect()}
    assert got == {x[0] for x in brute(rows, 5, 80) if x[3]}


def test_a_chain_in_order_takes_few_rounds(spark, monkeypatch):
    from quillgraph.llm import components as module

    rounds = []
    monkeypatch.setattr(module, "_ranked", lambda node, k, f=module._ranked: rounds.append(k) or f(node, k))
    edges = spark.range(10_000).selectExpr("id as a", "id + 1 as b")
    labels = components(edges)
    assert max(rounds) < 20
    assert labels.df().select("label").distinct().count() == 1 and labels.rows() == 10_001


def test_wide_blocks_of_sketches(spark, prose, monkeypatch):
    for name, value in (("SMALL_BUCKET", 2), ("BLOCK", 4), ("SKETCH_BLOCK", 16)):
        monkeypatch.setattr(neardup, name, value)
    r = random.Random(9)
    rows = [(i, edited(prose(60, 77), r, r.randint(0, 8))) for i in range(150)]
    assert run(spark, rows) == brute(rows)
