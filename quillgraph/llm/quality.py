"""Quality rules as a bitmask ledger.

Every rule is evaluated once.  The ledger keeps, per document, the measurements and one long whose bit i
says that rule i failed.  A policy is a named, versioned mask over these bits; applying or changing one
never reads a text again.  Ablations come from the histogram of failure masks, which has at most two to
the number of rules rows, by bitwise tests alone.

Null and empty texts have no words, so they fail ``few_words``.  Repeated rows are judged alike, very long texts
whole; a null id stays null, an empty table gives an empty result, and extra columns are carried whatever
their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quillgraph.llm.common import SPACE, by_value, slices, small_batches, table, utf8

by_value(__name__)

SYMBOLS = b"#*$%&|<>"

#: A letter of ASCII, or any byte of a character beyond it.
LETTER = re.compile(rb"[A-Za-z\x80-\xff]").search

#: Texts with more words than this count windows in arrays instead of a dict: same numbers, less memory.
ARRAY_WORDS = 100_000

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_alpha_words")


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` (SQL over the measurements) is true; its bit never changes once dealt."""

    bit: int
    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    """A named, versioned choice of rules: a document is kept if none of them failed."""

    name: str
    version: int
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...]) -> int:
        bits = {r.name: r.bit for r in rules}
        return sum(1 << bits[n] for n in set(self.rules))


RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 40 * n_words"),
    Rule(3, "short_words", "word_chars < 2 * n_words"),
    Rule(4, "long_words", "word_chars > 20 * n_words"),
    Rule(5, "duplicate_lines", "n_lines >= 4 and 100 * n_dup_lines > 40 * n_lines"),
    Rule(6, "few_letters", "100 * n_alpha_words < 50 * n_words"),
)
POLICIES = (
    Policy("base", 1, ("few_words", "repeated_windows")),
    Policy("full", 1, tuple(r.name for r in RULES)),
)


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words found at least twice, the first one included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    if len(words) > ARRAY_WORDS:
        return _repeated_words_array(words, width)
    if len(set(zip(*(words[i:] for i in range(width)), strict=False))) == n:
        return 0
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    seen = Counter(windows)
    covered = end = 0
    for i, window in enumerate(windows):
        if seen[window] > 1:
            covered += i + width - max(i, end)
            end = i + width
    return covered


def _repeated_words_array(words: list[bytes], width: int) -> int:
    import numpy as np

    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    rank = ids
    for i in range(1, width):  # ranks of windows of i + 1 words; exact, as ranks and ids are below 2**31
        pairs = rank[: len(ids) - i] * len(number) + ids[i:]
        rank = np.unique(pairs, return_inverse=True)[1]
    twice = np.bincount(rank)[rank] > 1
    edges = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edges, np.flatnonzero(twice), 1)
    np.add.at(edges, np.flatnonzero(twice) + width, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure(raw: bytes) -> tuple[int, ...]:
    """The MEASURES of one text in UTF-8."""
    words = raw.split()
    chars = len(raw.decode("utf-8", "replace")) - sum(map(raw.count, SPACE.encode()))
    symbols = sum(map(raw.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = sum(1 for w in words if w.isalpha() or LETTER(w))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines), letters


def _measured(columns: list[pa.Field]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [measure(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            values = zip(*rows, strict=True) if rows else [()] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(columns))), *(pa.array(v, pa.int64()) for v in values)], names=[*(c.name for c in columns), *MEASURES])

    return run


def ledger(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = (), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: the columns in ``keep`` (prefixed ``in_`` where they clash), measurements, failures."""
    small_batches(df.sparkSession)
    safe = {c: f"in_{c}" if c in (*MEASURES, "failures") else c for c in keep}
    fields = [T.StructField(safe[c], df.schema[c].dataType) for c in keep]
    rows = df.select(*(F.col(c).alias(safe[c]) for c in keep), utf8(text_col).alias("__utf8"))
    columns = [pa.field(f.name, to_arrow_type(f.dataType)) for f in fields]
    out = rows.mapInArrow(_measured(columns), T.StructType([*fields, *(T.StructField(m, T.LongType()) for m in MEASURES)]))
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return out.withColumn("failures", bits)


def verdict(policy: Policy, rules: tuple[Rule, ...] = RULES, failures: str = "failures") -> Column:
    """Whether the policy keeps a ledger row."""
    return F.col(failures).bitwiseAND(F.lit(policy.mask(rules)).cast("long")) == 0


def ablations(book: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per policy and rule: documents that fail it, that only it rejects, and that the policy keeps without it.

    The ledger is first summed to one row per failure mask, at most 2 ** len(rules), so nothing larger moves.
    """
    spark = book.sparkSession
    masks = book.groupBy("failures").agg(F.count("*").alias("n"))
    chosen = [(p.name, p.version, r.name, p.mask(rules), 1 << r.bit) for p in policies for r in rules if r.name in p.rules]
    chosen_df = spark.createDataFrame(chosen, "policy string, version int, rule string, mask long, bit long")
    hit = F.col("failures").bitwiseAND(F.col("mask"))
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(F.lit(0))).cast("long")
    return (
        masks.join(F.broadcast(chosen_df))
        .groupBy("policy", "version", "rule")
        .agg(
            count(F.col("failures").bitwiseAND(F.col("bit")) != 0).alias("failing"),
            count(hit == F.col("bit")).alias("only_this"),
            count(hit == 0).alias("kept"),
            count(hit.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("kept_without"),
        )
    )


def keep_documents(df: DataFrame, policy: Policy = POLICIES[-1], text_col: str = "text") -> DataFrame:
    """The rows that the policy keeps, with the input's columns."""
    names = tuple(df.columns)
    book = ledger(df, text_col, names)
    return book.where(verdict(policy)).select(*(F.col(f"in_{c}" if c in (*MEASURES, "failures") else c).alias(c) for c in names))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: one row per document with the measurements, the base verdict and the full policy's."""
    book = ledger(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", ("doc_id",))
    base, full = POLICIES
    return book.select(
        "doc_id",
        *MEASURES[:5],
        (~verdict(base)).alias("base_failed"),
        (verdict(base) & verdict(full)).alias("kept"),
        "failures",
    )


OP10_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, w[i : i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) > 4)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY 1),
lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT x) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY 1),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             coalesce(lines.dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lines.n, 0) AS n_lines,
             len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_alpha_words
      FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)),
f AS (SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (100 * n_symbols > 40 * n_words)::BIGINT + 8 * (word_chars < 2 * n_words)::BIGINT
             + 16 * (word_chars > 20 * n_words)::BIGINT + 32 * (n_lines >= 4 AND 100 * n_dup_lines > 40 * n_lines)::BIGINT + 64 * (100 * n_alpha_words < 50 * n_words)::BIGINT AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed, failures = 0 AS kept, failures FROM f
"""
