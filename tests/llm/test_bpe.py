import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quillgraph.llm import bpe

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_and_texts_equal_the_library():
    own, r = bpe.Encoder(bpe.tokenizer_spec()), random.Random(1)
    alpha = ["a", "b", "e", "th", "ing", " ", "  ", "\n", "\t", "é", "ß", "中", "\U0001f600", "\x1c", "\x85", "\xa0", "1", "22", ".", "!!", "'s", "'ll", "<|endoftext|>", "<|end", "́", "٣", "\x00", "​"]
    texts = ["".join(r.choice(alpha) for _ in range(r.randint(0, 50))) for _ in range(1500)]
    texts += ["".join(r.choice("aehinorstx") for _ in range(r.randint(0, 80))) for _ in range(1500)] + ["a" * 3000, " " * 999, "ab" * 2000, "-=" * 500]
    for text in texts:
        ids = LIBRARY.encode(text, add_special_tokens=False).ids
        packed = own.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == ids
        assert own.decode(packed).decode() == LIBRARY.decode(ids, skip_special_tokens=False)


def test_memory_bound_changes_nothing(monkeypatch):
    own = bpe.Encoder(bpe.tokenizer_spec())
    text = "some words that are encoded, and others; again some words"
    want = own.encode(text)
    monkeypatch.setattr(bpe, "MEMORY", 2)
    own.clear()
    assert own.encode(text) == want and len(own) <= 2


def test_query(spark, save, odd_docs):
    rows = bpe.op7_bpe_round_trip(spark, save(odd_docs)).collect()
    texts = odd_docs.collect()
    want = []
    for d in texts:
        ids = LIBRARY.encode(d.text or "", add_special_tokens=False).ids
        want.append((d.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)


def test_kept_columns_and_empty(spark, empty_docs, odd_docs):
    assert bpe.encode_table(empty_docs, keep=("source",)).count() == 0
    got = bpe.encode_table(odd_docs, keep=("id", "raw")).where("decoded = 'a b'").collect()
    assert got[0].id == "clash" and np.frombuffer(got[0].token_ids, "<u4").tolist() == LIBRARY.encode("a b").ids


def test_kept_columns_of_the_operators_names(spark):
    df = spark.createDataFrame([(1, "a b", 7, "x")], "doc_id long, text string, n_tokens long, decoded string")
    out = bpe.encode_table(df, "text", ("doc_id", "n_tokens", "decoded"))
    assert out.columns.count("n_tokens") == 1 and out.first().n_tokens == 2 and out.first().decoded == "a b"
