"""Exact duplicates through counting quotient filters.

Each partition puts the 64-bit fingerprints of its normalised texts into counting quotient filters: the
high bits (the quotient, as many as the load needs) are only a position, the low bits (the remainder) are
kept sorted in the position's run, each with its counter in the run.  Filters of one shard of the fingerprint space merge without loss,
because they hold whole fingerprints: their runs are merged by sorted remainders and equal ones add
their counters.  A fingerprint with a count of one is a unique text, done.  The others go to byte
verification: grouping by the normalised bytes themselves, combined before the shuffle, so that a group
of copies of any size is one row per partition.

Texts are equal if identical after deleting every character of ``[\\x20\\x09-\\x0D]``; null is empty, and all
empty texts are one group.  Of equal texts the row with the most code points in the original stays, then
the smallest id (a null id comes last).  Rows that tie in both, repeated rows, share their verdict.  Very long
texts are worked on whole, an empty table gives an empty result, and only id and text are read, whatever
other columns are called.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import SPACE, Table, by_value, id_key, real_id, scratch, slices, small_batches, table, utf8

by_value(__name__)

#: Share of a filter's quotients that its fingerprints would fill, and the fewest bits of a remainder.
LOAD, LEAST_REMAINDER = 0.75, 8

#: Fingerprints that a shard holds on average, at most; a merge holds one shard.
SHARD_ROWS = 500_000


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each value, one after the other."""
    out = [np.packbits(np.unpackbits(values[i : i + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - width :]).tobytes() for i in range(0, len(values), 65_536)]
    return b"".join(out)


def unpack_bits(raw: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    for i in range(0, n, 65_536):
        k = min(65_536, n - i)
        start = i * width // 8  # blocks end at whole bytes
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, (k * width + 7) // 8, start))[: k * width].reshape(k, width)
        wide = np.zeros((k, 64), np.uint8)
        wide[:, 64 - width :] = bits
        out[i : i + k] = np.packbits(wide).view(">u8")
    return out


class CountingQuotientFilter:
    """Fingerprints below 2**bits with counts, without loss.

    A fingerprint's high bits, the quotient, are only a position; ``quotient_bits`` fit the number of entries.
    ``occupied`` has a bit per quotient, ``run_ends`` a bit per slot that is the last of its run, and
    ``slots`` hold the runs in order: remainders ascending, each with its counter behind it.  A remainder x
    that occurs once is x, twice x x.  More often it is x, digits of the count less three, x: digits are
    neither 0 nor x, and a 0 goes before a first digit above x, so a counter shows by a slot that doesn't
    ascend.  The remainder 0 closes its counter with 0 0.
    """

    def __init__(self, bits: int, quotient_bits: int, occupied: np.ndarray, run_ends: np.ndarray, slots: np.ndarray):
        self.bits, self.quotient_bits, self.occupied, self.run_ends, self.slots = bits, quotient_bits, occupied, run_ends, slots

    @staticmethod
    def _counter(x: int, count: int, width: int) -> list[int]:
        """The slots behind a remainder that occurs more than once."""
        if count == 2:
            return [x]
        base = (1 << width) - (2 if x else 1)
        left, digits = count - 3, []
        while left or not digits:
            left, d = divmod(left, base)
            digits.append(d + 1 + (x > 0 and d + 1 >= x))
        digits.reverse()
        if not x:
            return [*digits, 0, 0]
        return [*([0] if digits[0] > x else []), *digits, x]

    @classmethod
    def _parsed(cls, run: list[int], width: int) -> list[tuple[int, int]]:
        """Remainders and counts of a run."""
        out, i = [], 0
        while i < len(run):
            x, i = run[i], i + 1
            if x:
                base = (1 << width) - 2
                if i < len(run) and run[i] == x:
                    count, i = 2, i + 1
                elif i < len(run) and run[i] < x:
                    i += run[i] == 0
                    value = 0
                    while run[i] != x:
                        value, i = value * base + run[i] - 1 - (run[i] > x), i + 1
                    count, i = value + 3, i + 1
                else:
                    count = 1
            else:
                base = (1 << width) - 1
                close = next((k for k in range(i + 1, len(run) - 1) if run[k] == run[k + 1] == 0), None)
                if i < len(run) and run[i] == 0:
                    count, i = 2, i + 1
                elif close is not None:
                    value = 0
                    for d in run[i:close]:
                        value = value * base + d - 1
                    count, i = value + 3, close + 2
                else:
                    count = 1
            out.append((x, count))
        return out

    @classmethod
    def of_sorted(cls, values: np.ndarray, counts: np.ndarray, bits: int) -> CountingQuotientFilter:
        """From distinct fingerprints in ascending order."""
        q = min(max(1, math.ceil(math.log2(max(1, len(values)) / LOAD))), bits - LEAST_REMAINDER)
        width = bits - q
        quotients = (values >> np.uint64(width)).astype(np.int64)
        remainders = values & np.uint64((1 << width) - 1)
        occupied = np.zeros(1 << q, bool)
        occupied[quotients] = True
        ends = np.r_[quotients[1:] != quotients[:-1], True] if len(values) else np.zeros(0, bool)
        behind = {int(i): cls._counter(int(remainders[i]), int(counts[i]), width) for i in np.flatnonzero(counts > 1)}
        taken = np.ones(len(values), np.int64)
        for i, more in behind.items():
            taken[i] += len(more)
        at = np.r_[0, np.cumsum(taken)].astype(np.int64)
        slots, run_ends = np.zeros(at[-1], np.uint64), np.zeros(at[-1], bool)
        slots[at[:-1]] = remainders
        run_ends[at[1:][ends] - 1] = True
        for i, more in behind.items():
            slots[at[i] + 1 : at[i + 1]] = more
        return cls(bits, q, occupied, run_ends, slots)

    @classmethod
    def build(cls, values: np.ndarray, bits: int) -> CountingQuotientFilter:
        """From fingerprints in any order, one count each."""
        return cls.of_sorted(*np.unique(values.astype(np.uint64, copy=False), return_counts=True), bits)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprints in ascending order, and their counts: runs take the occupied quotients in turn."""
        n, width = len(self.slots), self.bits - self.quotient_bits
        if not n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        run = np.cumsum(np.r_[0, self.run_ends[:-1]]).astype(np.int64)
        high = np.flatnonzero(self.occupied).astype(np.uint64) << np.uint64(width)
        inside = run[1:] == run[:-1]
        counted = np.unique(run[1:][inside & (self.slots[1:] <= self.slots[:-1])])  # runs that hold a counter
        plain = ~np.isin(run, counted)
        values, counts = [high[run[plain]] | self.slots[plain]], [np.ones(int(plain.sum()), np.int64)]
        start, end = np.searchsorted(run, counted, "left"), np.searchsorted(run, counted, "right")
        parsed = [(int(high[k]) | x, c) for k, a, b in zip(counted.tolist(), start.tolist(), end.tolist(), strict=True) for x, c in self._parsed(self.slots[a:b].tolist(), width)]
        values.append(np.array([v for v, _ in parsed], np.uint64))
        counts.append(np.array([c for _, c in parsed], np.int64))
        return merge_sorted((values[0], counts[0]), (values[1], counts[1]))

    def merge(self, *others: CountingQuotientFilter) -> CountingQuotientFilter:
        """All entries with their counts added: the filters' runs, which are sorted, are merged two by two."""
        left = [x.entries() for x in (self, *others)]
        while len(left) > 1:
            left = [merge_sorted(left[i], left[i + 1]) if i + 1 < len(left) else left[i] for i in range(0, len(left), 2)]
        return type(self).of_sorted(*left[0], self.bits)

    def to_bytes(self) -> bytes:
        head = np.array([self.bits, self.quotient_bits, len(self.slots)], np.int64).tobytes()
        return b"".join((head, np.packbits(self.occupied).tobytes(), np.packbits(self.run_ends).tobytes(), pack_bits(self.slots, self.bits - self.quotient_bits)))

    @classmethod
    def from_bytes(cls, raw: bytes) -> CountingQuotientFilter:
        bits, q, n = (int(x) for x in np.frombuffer(raw, np.int64, 3))
        at = 24
        size = ((1 << q) + 7) // 8
        occupied = np.unpackbits(np.frombuffer(raw, np.uint8, size, at))[: 1 << q].astype(bool)
        at += size
        run_ends = np.unpackbits(np.frombuffer(raw, np.uint8, (n + 7) // 8, at))[:n].astype(bool)
        return cls(bits, q, occupied, run_ends, unpack_bits(raw[at + (n + 7) // 8 :], n, bits - q))


def merge_sorted(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two ascending lists of distinct values with counts as one; equal values add their counts."""
    (x, m), (y, n) = (a, b) if len(a[0]) >= len(b[0]) else (b, a)
    if not len(y):
        return x, m
    at = np.searchsorted(x, y)
    same = x[np.minimum(at, len(x) - 1)] == y
    m = m.copy()
    m[at[same]] += n[same]
    return np.insert(x, at[~same], y[~same]), np.insert(m, at[~same], n[~same])


def normalise(raw: bytes) -> bytes:
    return raw.translate(None, SPACE.encode())


def _fingerprinted(with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raws = batch.column(1).to_pylist()
            plain = [normalise(x) for x in raws]
            digests = [hashlib.sha256(x) for x in plain]
            prints = np.frombuffer(b"".join(d.digest()[:8] for d in digests), "<i8")
            arrays = [batch.column(0), pa.array([len(x.decode("utf-8", "replace")) for x in raws], pa.int64()), pa.array(prints, pa.int64()), pa.array([d.hexdigest() for d in digests], pa.string())]
            names = ["id", "points", "print", "sha"]
            if with_bytes:
                arrays, names = [arrays[2], arrays[3], pa.array(plain, pa.binary())], ["print", "sha", "plain"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _filters(shard_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = [b.column(0).to_numpy(zero_copy_only=False) for b in batches]
        prints = np.concatenate(prints).view(np.uint64) if prints else np.zeros(0, np.uint64)
        bits = 64 - shard_bits
        shards = (prints >> np.uint64(bits)).astype(np.int64)
        order = np.argsort(shards, kind="stable")
        prints, shards = prints[order] & ((np.uint64(1) << np.uint64(bits)) - np.uint64(1)), shards[order]
        if not len(shards):
            return
        edges = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]])
        for start, end in zip(edges, [*edges[1:], len(shards)], strict=True):
            filled = CountingQuotientFilter.build(prints[start:end], bits)
            yield pa.RecordBatch.from_arrays([pa.array([int(shards[start])], pa.int64()), pa.array([filled.to_bytes()], pa.binary())], names=["shard", "filter"])

    return run


def _repeated(shard_bits: int):
    def run(rows: pa.Table) -> pa.Table:
        filters = [CountingQuotientFilter.from_bytes(x) for x in rows.column("filter").to_pylist()]
        values, counts = filters[0].merge(*filters[1:]).entries()
        twice = counts > 1
        shard = np.uint64(rows.column("shard")[0].as_py()) << np.uint64(64 - shard_bits)
        return pa.table({"print": pa.array((values[twice] | shard).view(np.int64), pa.int64()), "copies": pa.array(counts[twice], pa.int64())})

    return run


def repeated_fingerprints(prints: DataFrame, rows: int) -> DataFrame:
    """Fingerprints (column ``print``) that occur more than once, with their counts."""
    shard_bits = max(6, (rows // SHARD_ROWS).bit_length())
    filters = prints.select("print").mapInArrow(_filters(shard_bits), "shard long, filter binary")
    return filters.groupBy("shard").applyInArrow(_repeated(shard_bits), "print long, copies long")


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Shuffles: the filters (six bytes or so a row), the narrow rows of repeated texts, and the bytes of repeated
    texts after combining; unique texts never move.
    """
    small_batches(df.sparkSession)
    source = df.select(id_key(id_col).alias("id"), utf8(text_col).alias("raw"))
    with scratch() as keep:
        narrow = keep(Table(source.mapInArrow(_fingerprinted(False), "id long, points long, print long, sha string"), "exact-rows"))
        repeated = Table(repeated_fingerprints(narrow.df(), narrow.rows()), "exact-prints")
        # byte verification: the key is the text itself; partial aggregation leaves a row per text and partition
        verified = Table(
            source.mapInArrow(_fingerprinted(True), "print long, sha string, plain binary")
            .join(repeated.small(), "print", "left_semi")
            .groupBy("print", "sha", "plain")
            .agg(F.count("*").alias("group_size"))
            .groupBy("print", "sha")
            .agg(F.sum("group_size").alias("group_size"), F.count("*").alias("texts"))
            .where((F.col("texts") == 1) | F.raise_error(F.lit("two texts share a SHA-256")).isNull())
            .where("group_size > 1")
            .select("print", "sha", "group_size"),
            "exact-classes",
        )
        # who stays: hash aggregations of two longs, first the most code points, then the smallest id
        members = narrow.df().join(repeated.small(), "print", "left_semi")
        longest = members.groupBy("sha").agg(F.max("points").alias("points"))
        keepers = members.groupBy("sha", "points").agg(F.min("id").alias("keep")).join(longest, ["sha", "points"], "left_semi")
        classes = keep(Table(verified.df().join(keepers.select("sha", "keep"), "sha"), "exact-keepers"))
    return (
        narrow.df()
        .join(classes.small().select("sha", "group_size", "keep"), "sha", "left")
        .select(
            real_id("id").alias("id"),
            real_id(F.coalesce("keep", "id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            (F.coalesce("keep", "id") == F.col("id")).alias("kept"),
            F.col("sha").alias("text_sha256"),
        )
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: one row per document, dropped ones too."""
    return deduplicate(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain FROM documents),
k AS (SELECT *, sha256(plain) AS text_sha256, count(*) OVER (PARTITION BY plain) AS group_size,
      first_value(doc_id) OVER (PARTITION BY plain ORDER BY points DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""
