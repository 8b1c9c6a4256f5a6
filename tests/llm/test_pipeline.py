import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import test_lines
import test_mixing
import test_neardup
import test_quality
from tokenizers import Tokenizer

import corpus_pipeline
from quillgraph.llm import mixing, quality
from quillgraph.llm.catalogue import ORACLES, QUERIES

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def judged(text):
    """The full policy on plain measurements."""
    words = (text or "").split(" ")
    m = dict(zip(quality.MEASURES, quality.measure((text or "").encode()), strict=True))
    assert test_quality.brute(text) == tuple(m.values())[:5] and words
    return m["n_words"] >= 10 and not any(eval(r.fails, {}, m) for r in quality.RULES)  # noqa: S307


def brute(rows, save):
    rows = [r for r in rows if judged(r[1])]
    gone = {w[0]: set(w[4].split(",")) for w in test_lines.brute([r[:2] for r in rows])}
    rows = [(i, "\n".join(x for p, x in enumerate(t.split("\n")) if str(p) not in gone[i]), s) for i, t, s in rows]
    rows = [r for r in rows if r[1].split() or not gone[r[0]] - {""}]
    kept = {k[0] for k in test_neardup.brute([r[:2] for r in rows], 5, 80) if k[3]}
    rows = [r for r in rows if r[0] in kept]
    taken = test_mixing.oracle(save(rows), mixing.OP4_SQL).fetchall()
    copies = {t[0]: (t[4] // t[1] if t[1] else 0) for t in taken}
    out = Counter()
    for i, t, s in rows:
        ids = LIBRARY.encode(t, add_special_tokens=False).ids
        digest = lambda b: hashlib.sha256(b).hexdigest()
        if copies[i]:
            out[i, s, len(ids), digest(np.array(ids, "<u4").tobytes()), digest(t.encode())] += copies[i]
    return out


def test_against_brute_force(spark, prose, tmp_path):
    r = random.Random(21)
    pool = [prose(r.randint(5, 20), 1000 + i) for i in range(12)]
    rows = []
    for i in range(120):
        lines = [prose(r.randint(8, 30)) for _ in range(r.randint(1, 4))] + [r.choice(pool) for _ in range(r.randint(0, 2))]
        rows.append((i, "\n".join(lines), r.choice(["hot", "hot", "hot", "a", "b"])))
    rows += [(200 + i, test_neardup.edited(rows[i][1].replace("\n", " "), r, 1), "c") for i in range(20)]
    rows += [(300, "spam " * 50, "a"), (301, "few words", "a"), (302, rows[3][1], "a"), (303, "# | $ " * 10 + prose(10), "b")]
    schema = "doc_id long, text string, source string, lang string, n_chars long"
    count = [0]

    def save(these):
        count[0] += 1
        spark.createDataFrame([(*x, "en", len(x[1])) for x in these], schema).repartition(3).write.parquet(f"{tmp_path}/{count[0]}/documents.parquet")
        return f"{tmp_path}/{count[0]}"

    got = Counter((x.doc_id, x.source, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in corpus_pipeline.run(spark, save(rows)).collect())
    assert got == brute(rows, save)
    assert sum(got.values()) > 50


def test_stages_keep_columns_and_stand_odd_rows(spark, odd_docs, empty_docs):
    for docs in (odd_docs, empty_docs):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, "")
            assert k == 4 or tuple(out.columns) == corpus_pipeline.COLUMNS
            out.count()


def test_catalogue():
    assert {f"op{i}" for i in range(1, 11)} <= {q.partition("_")[0] for q in QUERIES} and "pipeline" in QUERIES
    assert set(ORACLES) <= set(QUERIES)
