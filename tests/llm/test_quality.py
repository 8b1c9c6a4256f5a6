import random
import re

from pyspark.sql import functions as F

from quillgraph.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_measures(prose):
    r = random.Random(4)
    texts = [prose(r.randint(0, 60)) + r.choice(["", "\n", " | # é "]) + prose(3, 1) + "\n" + prose(3, 1) + "\n \n" for _ in range(60)]
    texts += ["a b c a b c a b c a b c", "x " * 40, "", "\n\n", "a\nb\na\n a"]
    for t in texts:
        assert quality.measure(t.encode())[:5] == brute(t)


def test_windows_in_arrays(monkeypatch):
    r = random.Random(3)
    for n in (0, 4, 5, 6, 40, 300):
        words = [r.choice([b"a", b"b", b"c"]) for _ in range(n)]
        want = quality.repeated_words(words)
        with monkeypatch.context() as m:
            m.setattr(quality, "ARRAY_WORDS", 1)
            assert quality.repeated_words(words) == want


def test_query(spark, save, odd_docs):
    got = quality.op10_quality_rules(spark, save(odd_docs)).collect()
    assert len(got) == odd_docs.count()
    texts = {}
    for d in odd_docs.collect():
        texts.setdefault(d.doc_id, []).append(brute(d.text) if len(d.text or "") < 1000 else None)
    for g in got:
        hit = [m for m in texts[g.doc_id] if m is None or m == tuple(g)[1:6]]
        assert hit
        assert g.base_failed == (g.n_words < 10 or 100 * g.n_repeat_words > 20 * g.n_words)
        assert not (g.kept and g.base_failed)


def test_ablations_equal_counting_each_rule(spark, odd_docs, empty_docs):
    book = quality.ledger(odd_docs, keep=("doc_id", "failures")).cache()
    assert "in_failures" in book.columns
    for row in quality.ablations(book).collect():
        policy = next(p for p in quality.POLICIES if (p.name, p.version) == (row.policy, row.version))
        bit = next(r.bit for r in quality.RULES if r.name == row.rule)
        mask = policy.mask(quality.RULES)
        masks = [r.failures for r in book.collect()]
        assert row.failing == sum(bool(m >> bit & 1) for m in masks)
        assert row.only_this == sum(m & mask == 1 << bit for m in masks)
        assert row.kept == sum(m & mask == 0 for m in masks)
        assert row.kept_without == sum(m & mask & ~(1 << bit) == 0 for m in masks)
    assert quality.ledger(empty_docs).count() == 0
    assert quality.keep_documents(odd_docs).columns == odd_docs.columns
    assert quality.keep_documents(odd_docs).where(F.length("text") < 10).count() == 0
