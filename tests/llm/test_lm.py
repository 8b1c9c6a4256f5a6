import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quillgraph.llm import lm


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), " "]


def held(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 10 == 0


def brute(rows):
    count = Counter(t for i, x in rows if not held(i) for t in tokens(x))
    n, v = sum(count.values()), len(count)
    return {i: (held(i), len(t := tokens(x)), sum(count[w] > 0 for w in t), n, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for i, x in rows}


def chain(r, n):
    """Words that each call for the next, with some noise."""
    words, w = [], 0
    for _ in range(n):
        w = (w * 3 + 1) % 37 if r.random() < 0.8 else r.randrange(37)
        words.append(f"W{w}")
    return " ".join(words)


@pytest.mark.parametrize("size", [400, lm.BLOCK_BYTES])
def test_base_scores_against_brute_force(spark, save, prose, size, monkeypatch):
    monkeypatch.setattr(lm, "COUNT_ROWS", 200)
    r = random.Random(1)
    rows = [(i, prose(r.randint(0, 40)) + r.choice(["", " É é \U0001f600", " A", " \x1c\x85 b\x0b"])) for i in range(120)] + [(500, None), (501, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.id: x for x in lm.score(df, spec=lm.Spec(width=4, batch=64), block_bytes=size, block_tokens=size).collect()}
    for i, want in brute(rows).items():
        x = got[i]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == want[:4]
        assert x.base_score == pytest.approx(want[4])
        assert x.score < 0


def test_scores_against_brute_force(spark, prose, monkeypatch):
    """Scores word by word, from the trained model's parameters, with every normaliser summed in plain code."""
    kept = {}
    monkeypatch.setattr(lm, "_scored", lambda model, end, f=lm._scored: kept.update(model=model.value, end=end) or f(model, end))
    monkeypatch.setattr(lm, "count_classes", lambda *a, f=lm.count_classes: kept.setdefault("counts", f(*a)))
    r = random.Random(3)
    rows = [(i, prose(r.randint(0, 30)) + r.choice(["", f" new{i}"])) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.id: x.score for x in lm.score(df, spec=lm.Spec(width=4, batch=64, noise=4)).collect()}
    m, c = lm.Model.of(kept["model"]), kept["counts"]
    count = Counter(t for i, x in rows if not held(i) for t in tokens(x))
    singles = {w.decode(): int(k) for w, k in zip(c.words, c.singles, strict=True)}
    cls = lambda w: singles.get(w, int(c.suffixes[zlib.crc32(w.encode()[-3:]) % len(c.suffixes)]))
    members = {}
    for w in count:
        members.setdefault(cls(w), set()).add(w)
    there = [k for k in range(len(c.counts)) if c.counts[k] >= 0]

    def within(w, k):
        if k in c.singles:
            return 1.0
        mass = sum(count[x] for x in members.get(k, ()))
        return (count[w] + 0.1) / (mass + 0.1 * (len(members.get(k, ())) + 1))

    def classes(before):
        """Probabilities of all classes after the three classes before."""
        v = sum(m.c[i] * m.q[k] for i, k in enumerate(before))
        groups = [math.exp(m.rg[g] @ v + m.bg[g]) for g in range(len(m.bg))]
        out = {}
        for g in range(len(m.bg)):
            own = {k: math.exp(m.r[k] @ v + m.b[k]) for k in there if k // c.members == g}
            out |= {k: x / sum(own.values()) * groups[g] / sum(groups) for k, x in own.items()}
        return out

    for i, text in rows[:25]:
        before, total = [c.end] * 3, 0.0
        for w in tokens(text):
            k = cls(w)
            p = classes(before)
            assert sum(p.values()) == pytest.approx(1, abs=1e-5)
            total += math.log10(p[k] * within(w, k))
            before = [k, *before[:2]]
        assert got[i] == pytest.approx(total, rel=1e-4)
    # all words and, per class of several, an unseen one
    p = classes([c.end] * 3)
    unseen = {k: f"never-{k}" for k in there if k not in c.singles}
    every = sum(p[cls(w)] * within(w, cls(w)) for w in count) + sum(p[k] * within(w, k) for k, w in unseen.items())
    assert every == pytest.approx(1, abs=1e-4)


def test_model_learns(spark):
    r = random.Random(2)
    ids = np.array([int(w[1:]) for w in chain(r, 30_000).split()])
    for context in (1, 3):
        model = lm.Model(lm.Spec(batch=256, context=context), np.r_[np.bincount(ids, minlength=40), [-1.0] * 2], 7)
        history = lm._history(ids, np.array([0]), 39, context)
        unigram = np.log(np.bincount(ids, minlength=40) / len(ids))[ids].mean()
        assert model.log_probabilities(history, ids).mean() == pytest.approx(unigram, abs=0.05)
        weights = model.c.copy()
        for k in range(3):
            model.train(history, ids, k)
        assert model.log_probabilities(history, ids).mean() > unigram + 0.5
        assert not np.allclose(weights, model.c)
        total = sum(np.exp(model.log_probabilities(history[:5], np.full(5, w))) for w in range(40))
        assert total == pytest.approx(np.ones(5), abs=1e-4)


def test_history():
    ids = np.random.default_rng(3).integers(0, 9, 500)
    history = lm._history(ids, np.array([0, 200]), 8, 3)
    assert history[0].tolist() == [8, 8, 8] and history[201].tolist() == [ids[200], 8, 8] and history[4].tolist() == ids[[3, 2, 1]].tolist()


def test_rows_are_means_over_the_blocks_that_used_them():
    spec = lm.Spec(width=2, context=1)
    a, b, c = (lm.Model(spec, np.ones(4), 2) for _ in range(3))
    a.q[:], b.q[:] = 1, 3
    ua, ub = (m.uses(np.array([[x]] * n), np.zeros(n, np.int64)) for m, x, n in ((a, 0, 2), (b, 1, 5)))
    ua["q"][2], ub["q"][2] = 1, 3
    old = c.q.copy()
    c.load(a.weighed(ua) + b.weighed(ub))
    assert c.q[0].tolist() == [1, 1] and c.q[1].tolist() == [3, 3] and c.q[2].tolist() == [2.5, 2.5] and (c.q[3] == old[3]).all()


def test_scores_beat_the_unigram_on_held_out_text_however_dealt(spark):
    r = random.Random(4)
    rows = [(i, chain(r, 150)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spec = lm.Spec(scale=8, batch=64, rounds=4, passes=4)
    got = [{x.id: x for x in lm.score(df.repartition(k), spec=spec, block_bytes=size, block_tokens=20_000).collect()} for k, size in ((2, 1 << 20), (5, 9000))]
    held_rows = [x for x in got[0].values() if x.held_out]
    assert len(held_rows) > 10
    assert sum(x.score for x in held_rows) > sum(x.base_score for x in held_rows) * 0.8
    assert all(got[1][i].score == pytest.approx(x.score, rel=1e-3) for i, x in got[0].items())


def test_classes_grow_with_the_vocabulary(spark):
    sizes = []
    for n in (100, 10_000):
        rows = spark.range(n).selectExpr("cast(concat('w', id) as binary) as word", "id + 1 as count", "true as first")
        c = lm.count_classes(rows, lm.Spec())
        assert c.distinct == n and c.counts[c.counts >= 0].sum() == c.total
        sizes.append(len(c.words) - 1)
    assert sizes == [10, 100]


def test_packing():
    for n in (1, 5, 1000):
        x = np.random.default_rng(n).integers(0, 1 << 20, n)
        assert (lm.unpack(lm.pack(x), n) == x).all()


def test_odd_and_empty(spark, save, odd_docs, empty_docs):
    got = lm.op3_lm_scores(spark, save(odd_docs)).collect()
    assert len(got) == odd_docs.count() and all(x.score <= 0 and x.n_tokens > 0 for x in got)
    assert lm.score(empty_docs).count() == 0
