import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import exact


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**58 - 1) | st.integers(0, 30), max_size=60), st.integers(1, 4), st.integers(1, 700))
def test_filters_count_and_merge_without_loss(values, parts, times):
    values = values + values[:2] * times
    filters = [exact.CountingQuotientFilter.from_bytes(exact.CountingQuotientFilter.build(np.array(values[i::parts], np.uint64), 58).to_bytes()) for i in range(parts)]
    merged = exact.CountingQuotientFilter.from_bytes(filters[0].merge(*filters[1:]).to_bytes())
    found, counts = merged.entries()
    assert dict(zip(found.tolist(), counts.tolist(), strict=True)) == Counter(values)
    assert (np.diff(found.astype(object)) > 0).all()


@pytest.mark.parametrize("width", [2, 3, 8])
def test_counters_in_runs(width):
    make = exact.CountingQuotientFilter
    r = random.Random(width)
    for _ in range(3000):
        want = [(x, r.choice([1, 1, 2, 3, 4, 5, 9, 100, 70_000])) for x in range(1 << width) if r.random() < 0.4][:6]
        run = [s for x, c in want for s in [x, *(make._counter(x, c, width) if c > 1 else [])]]
        assert make._parsed(run, width) == want


def test_filters_are_smaller_than_their_fingerprints():
    values = np.random.default_rng(1).integers(0, 2**58, 100_000, dtype=np.uint64)
    size = len(exact.CountingQuotientFilter.build(values, 58).to_bytes())
    assert size < 5.5 * len(values)


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        g = groups[norm(t)]
        keep = min(g)[3]
        out.append((i, keep, len(g), keep == i, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark, save, prose, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = sorted(map(tuple, exact.op6_exact_dedup(spark, save(odd_docs)).collect()), key=str)
    assert got == brute(rows)
    r = random.Random(2)
    base = [prose(20, i) for i in range(40)]
    rows = [(i, r.choice(base).replace(" ", r.choice([" ", "  ", "\n", "\t "]))) for i in range(300)] + [(1000 + i, base[0]) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, exact.deduplicate(df).collect()), key=str) == brute(rows)


def test_empty(spark, empty_docs):
    assert exact.deduplicate(empty_docs).count() == 0
