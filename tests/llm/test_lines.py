import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import lines
from quillgraph.llm.common import Table


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edit(text, r, n, alpha="abx"):
    t = list(text)
    for _ in range(n):
        k = r.randrange(len(t) + 1)
        what = r.random()
        if what < 0.4 and k < len(t):
            t[k] = r.choice(alpha)
        elif what < 0.7:
            t.insert(k, r.choice(alpha))
        elif k < len(t):
            del t[k]
    return "".join(t)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance(spark, edits):
    r = random.Random(edits)
    rows = []
    for _ in range(600):
        a = "".join(r.choice("abé") for _ in range(r.randint(edits + 1, 90)))
        b = edit(a, r, r.randint(0, edits + 2))
        a, b = (a, b) if len(a) >= len(b) else (b, a)
        if len(a) - len(b) <= edits and b:
            rows.append((len(rows), a, b))
    got = {x.i for x in spark.createDataFrame(rows, "i int, x string, y string").where(lines.within(F.col("x"), F.col("y"), edits)).collect()}
    assert got == {i for i, a, b in rows if distance(a, b) <= edits}


def near(a, b, edits, per_edit):
    """Within an edit for every ``per_edit`` code points of the shorter one, ``edits`` at most."""
    most = min(edits, min(len(a), len(b)) // per_edit)
    return abs(len(a) - len(b)) <= most and most > 0 and distance(a, b) <= most


def links(texts, edits, per_edit):
    return {(i, j) for i, a in enumerate(texts) for j in range(i + 1, len(texts)) if near(a, texts[j], edits, per_edit)}


@pytest.mark.parametrize("edits,hot", [(1, 64), (2, 64), (2, 3), (3, 2)])
def test_links_against_brute_force(spark, monkeypatch, edits, hot):
    monkeypatch.setattr(lines, "HOT", hot)
    monkeypatch.setattr(lines, "BUSY", min(4, hot - 1))
    r = random.Random(10 * edits + hot)
    pool = []
    for _ in range(25):
        base = "".join(r.choice("abcdefgh ") for _ in range(r.randint(24, 60)))
        pool += [edit(base, r, r.randint(0, 4)) for _ in range(6)]
    pool += [f"item number {r.randrange(10**4):05d} of the same template, sold at once" for _ in range(60)]
    pool = sorted(set(pool))
    table = Table(spark.createDataFrame(list(enumerate(pool)), "lid long, line string"), "t")
    got = {(x.a, x.b) for x in lines.near_links(table, edits, 24 // edits).collect()}
    assert got == links(pool, edits, 24 // edits)


def brute(rows, edits=lines.EDITS, per_edit=lines.PER_EDIT):
    seen = defaultdict(list)
    for i, t in rows:
        for p, x in enumerate((t or "").split("\n") if t is not None else []):
            if re.search(r"[^\x20\x09-\x0D]", x):
                seen[x].append(((i is None, i or 0), p))
    first = {x: min(v) for x, v in seen.items()}
    close = {x for x in first for y in first if x != y and first[y] < first[x] and near(x, y, edits, per_edit)}
    out = []
    for i, t in rows:
        own = [(p, x) for p, x in enumerate(t.split("\n")) if x in first] if t is not None else []
        n = [p for p, x in own if x in close]
        e = [p for p, x in own if x not in close and first[x] != ((i is None, i or 0), p)]
        out.append((i, len(own), len(e), len(n), ",".join(map(str, sorted(e + n)))))
    return sorted(out, key=str)


def test_query_and_removal(spark, save, prose):
    r = random.Random(12)
    pool = [prose(r.randint(4, 25), i) for i in range(30)]
    rows = []
    for i in range(80):
        parts = [r.choice(pool) if r.random() < 0.5 else edit(r.choice(pool), r, r.randint(1, 3), "aeiou") for _ in range(r.randint(0, 6))]
        if r.random() < 0.5:
            parts += [edit(prose(3, 500 + r.randrange(9))[:18], r, r.randint(0, 2)) for _ in range(3)] + [r.choice("ab|")]
        rows.append((i, "\n".join(parts + ["short", ""])))
    rows += [(200, None), (201, ""), (None, pool[0] + "\n" + prose(9, 77)), (202, pool[1]), (203, "é" * 30), (204, "é" * 29 + "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows)
    assert sorted(map(tuple, lines.op5_line_dedup(spark, save(df)).collect()), key=str) == want
    kept = {x.doc_id: x.text for x in lines.remove_lines(df).collect()}
    for i, t in rows:
        gone = next(w[4] for w in want if w[0] == i)
        left = "\n".join(x for p, x in enumerate((t or "").split("\n")) if str(p) not in gone.split(",")) if t is not None else None
        if gone and not left.split():
            assert i not in kept
        else:
            assert kept[i] == left


def test_odd_and_empty(spark, save, odd_docs, empty_docs):
    assert lines.op5_line_dedup(spark, save(odd_docs)).count() == odd_docs.count()
    assert lines.remove_lines(odd_docs).columns == odd_docs.columns
    assert lines.op5_line_dedup(spark, save(empty_docs)).count() == 0
    assert lines.remove_lines(empty_docs).count() == 0
