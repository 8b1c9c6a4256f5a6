import os
import random
from collections import defaultdict

import duckdb
import pytest

from quillgraph.llm import mixing


def oracle(folder, sql):
    con = duckdb.connect()
    path = f"{folder}/documents.parquet"
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con.execute(sql)


def test_query_equals_sql(spark, save, prose, sf001):
    r = random.Random(8)
    rows = [(i, prose(r.randint(0, 30)) if i % 9 else None, r.choice(["hot"] * 30 + ["a", "b", "c", "é", "\U0001f600", None, "tiny"])) for i in range(700)]
    folder = save(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5))
    for where in (folder, sf001):
        got = {row.doc_id: tuple(row) for row in mixing.op4_source_mix(spark, where).collect()}
        cursor = oracle(where, mixing.OP4_SQL)
        names = [d[0] for d in cursor.description]
        order = [names.index(c) for c in ("doc_id", "size", "source_size", "target", "taken")]
        want = {x[order[0]]: tuple(x[i] for i in order) for x in cursor.fetchall()}
        assert got.keys() == want.keys()
        for k, v in got.items():
            assert v[:3] == want[k][:3] and v[4] == want[k][4] and v[3] == pytest.approx(want[k][3])
        taken, goal, most = defaultdict(int), {}, defaultdict(int)
        skey = {row[0]: row[2] for row in rows} if where == folder else None
        for k, v in got.items():
            assert v[4] <= 3 * v[1]
            key = skey[k] if skey else v[2:4]
            taken[key] += v[4]
            goal[key] = v[3]
            most[key] = max(most[key], v[1])
        for key in taken:
            assert abs(taken[key] - goal[key]) <= most[key] / 2 + 1
        assert sum(goal.values()) == pytest.approx(sum(v[1] for v in got.values()))


def test_targets_reshare_until_none_is_above(spark):
    sizes = {"0a": 1000, "0b": 10, "0c": 10, "0d": 5, "0e": 0, "1": 200}
    df = spark.createDataFrame(list(sizes.items()), "skey string, size long")
    got = {r.skey: r.target for r in mixing.targets(df).collect()}
    weights = dict(zip(sorted(sizes), [1, 2, 3, 1, 2, 3], strict=True))
    want, capped = {}, set()
    total = sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[k] for k in capped)
        open_ = [k for k in sizes if k not in capped]
        want = {k: 3 * sizes[k] for k in capped} | {k: rest * weights[k] / sum(weights[x] for x in open_) for k in open_}
        over = {k for k in open_ if want[k] > 3 * sizes[k]}
        if not over:
            break
        capped |= over
    assert got == pytest.approx(want)


def test_nested_budgets_and_ties(spark):
    r = random.Random(9)
    rows = [(i, "0s", r.randint(0, 9), r.getrandbits(60)) for i in range(500)]
    rows += [(1000, "0s", 3, 12345)] * 50 + [(i, "0t", 1, (1 << 59) + i % 3) for i in range(30)]
    sizes = spark.createDataFrame(rows, "id long, skey string, size long, h long")
    budgets = spark.createDataFrame([("0s", i, float(b)) for i, b in enumerate((0, 50, 90, 500, 10**9))] + [("0t", 0, 15.0)], "skey string, budget_no int, budget double")
    cut = mixing.thresholds(sizes, budgets).collect()
    taken = {}
    for c in cut:
        taken[c.skey, c.budget_no] = [x for x in rows if x[1] == c.skey and (c.full or x[3] < c.low or (x[3] < c.high and c.boundary))]
    words = {k: sum(x[2] for x in v) for k, v in taken.items()}
    assert words["0s", 0] == 0 and words["0s", 4] == sum(x[2] for x in rows if x[1] == "0s")
    assert abs(words["0s", 3] - 500) <= 5 and words["0t", 0] in (10, 20)
    assert words["0s", 1] in (0, 150) or abs(words["0s", 1] - 50) <= 75
    sets = [{(x[0], x[3]) for x in taken["0s", i]} for i in range(5)]
    assert all(a <= b for a, b in zip(sets, sets[1:], strict=False))


def test_take_repeats_rows(spark, odd_docs, empty_docs):
    out = mixing.take(odd_docs)
    assert out.columns == odd_docs.columns
    copies = {(r.id, r.h): r.copies for r in mixing.mix(odd_docs).collect()}
    assert out.count() == sum(r.copies for r in mixing.mix(odd_docs).collect()) and copies
    assert mixing.take(empty_docs).count() == 0 and mixing.mix(empty_docs).count() == 0
