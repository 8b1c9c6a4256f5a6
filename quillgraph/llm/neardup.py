"""Near duplicates: banded MinHash candidates, odd sketches, and links confirmed on full sets.

A document is the set of its distinct word shingles.  Its MinHash samples give bands, for candidates, and
an odd sketch: every sample flips one bit of a bitmap, so the XOR of two bitmaps has a population count
that estimates how many samples differ, most precisely where similarity is high.  Candidates whose count
is beyond what linked documents reach (by ``SIGMAS`` standard deviations) are dropped, and the rest are
confirmed on the sets themselves.

Copies cost nothing: documents with equal sets are one class, and only classes are compared.  A bucket of
m classes gives m - 1 candidates, each class with the bucket's first document.  After these are confirmed
and joined into components, buckets that still hold several components are searched again for links between
them: small ones pair by pair, and large ones as families.  A family's odd sketches are compared in blocks,
and only members that have a possible partner in another component are compared further, block by block, by
an inverted index of their full sets.  So no link between different texts is lost, and no bucket is capped.
With 24 bands of 5 samples a pair at similarity 0.85 shares no bucket with probability 8e-7.

Equal sets are told by 128 bits of their shingles' 64-bit hashes, and families compare sets of these hashes;
pairs are confirmed on the words themselves.  A text with fewer words than a shingle is one shingle; a null
text or one without words has an empty set and links with nothing.  Rows with equal texts share their
component.  Of a component the smallest id stands for it, a null id last, and of equal ids the smaller
digest of the text.  Very long texts are worked on whole, an empty table gives an empty result, and extra
columns are carried whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import Table, by_value, id_key, real_id, scratch, slices, small_batches, table, utf8, worker_cache
from quillgraph.llm.components import components

by_value(__name__)

SIGMAS = 6
#: Members of a bucket compared within a join; larger buckets are compared in blocks.
SMALL_BUCKET = 32
#: Documents of a block, and their shingles, on average at most; documents of a block of sketches.
BLOCK, BLOCK_SHINGLES, SKETCH_BLOCK = 512, 1_000_000, 8192
#: Partners confirmed in one task with the document they share.
PARTNERS = 64
#: Words whose hashes a worker remembers.
MEMORY = 50_000


@dataclass(frozen=True)
class Spec:
    """Words a shingle; similarity as a fraction; bands, samples a band, bits of the odd sketch."""

    words: int = 3
    over: int = 85
    under: int = 100
    bands: int = 24
    rows: int = 5
    bits: int = 256

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    def most_bits(self) -> int:
        """Set bits of the XOR that a pair at the threshold exceeds only beyond SIGMAS standard deviations.

        k samples differ in k(1-J) places, each of which flips two of n bits.
        """
        k, n, j = self.samples, self.bits, self.over / self.under
        differing = min(k, k * (1 - j) + SIGMAS * math.sqrt(k * j * (1 - j)))
        mean = n / 2 * (1 - (1 - 2 / n) ** (2 * differing))
        return math.ceil(mean + 3 * math.sqrt(n) / 4)


def _mix(x: np.ndarray) -> np.ndarray:
    """A mixing of 64 bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MEMORY:
            self.clear()
        got = xxhash.xxh64_intdigest(word, 7)
        if len(word) < 64:
            self[word] = got
        return got


def _word_hashes() -> _Words:
    return worker_cache().setdefault("neardup-words", _Words())


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_word_hashes().__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    out = np.full(len(words) - width + 1, 0x9E3779B97F4A7C15 * width & (2**64 - 1), np.uint64)
    for i in range(width):
        out = _mix(out * np.uint64(0xD1342543DE82EF95) + h[i : len(h) - width + 1 + i])
    return np.unique(out)


class Sketcher:
    """MinHash samples, bands and odd sketches of sets of hashes."""

    def __init__(self, spec: Spec):
        rng = np.random.default_rng(20240229)
        k = spec.samples
        self.spec = spec
        self.a = rng.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2)
        self.place = _mix(np.arange(1, k + 1, dtype=np.uint64))
        self.band = _mix(np.arange(1, spec.bands + 1, dtype=np.uint64) << np.uint64(32))

    def samples(self, x: np.ndarray) -> np.ndarray:
        low = None
        for i in range(0, len(x), 512):
            part = (self.a[:, None] * x[None, i : i + 512] + self.b[:, None]).min(axis=1)
            low = part if low is None else np.minimum(low, part)
        return low

    def bands(self, samples: np.ndarray) -> np.ndarray:
        grid = samples.reshape(self.spec.bands, self.spec.rows)
        out = self.band
        for i in range(self.spec.rows):
            out = _mix(out * np.uint64(0xD1342543DE82EF95) + grid[:, i])
        return out.view(np.int64)

    def odd(self, samples: np.ndarray) -> np.ndarray:
        bits = _mix(samples + self.place) % np.uint64(self.spec.bits)
        parity = np.bincount(bits.astype(np.int64), minlength=self.spec.bits) & 1
        return np.packbits(parity.astype(np.uint8)).view(np.int64)


def set_digest(x: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of hashes as two longs."""
    raw = hashlib.blake2b(x.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


SKETCH_SCHEMA = "id long, t0 long, t1 long, n long, d0 long, d1 long, bands array<long>, odd array<long>"


def _sketched(spec: Spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Sketcher(spec)
        for batch in slices(batches):
            rows = []
            for raw in batch.column(3).to_pylist():
                x = shingle_hashes(raw.lower().split(), spec.words)
                if not len(x):
                    rows.append((0, None, None, None, None))
                    continue
                s = make.samples(x)
                rows.append((len(x), *set_digest(x), make.bands(s), make.odd(s)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2
            arrays = [batch.column(i) for i in range(3)] + [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "t0", "t1", "n", "d0", "d1", "bands", "odd"])

    return run


def document_key(id_col: str, text_col: str) -> list[Column]:
    """id, t0, t1: the id's key and 128 bits of the text, which tell rows that share an id."""
    raw = utf8(text_col)
    return [id_key(id_col).alias("id"), F.xxhash64(raw).alias("t0"), F.xxhash64(F.lit(77), raw, F.length(raw)).alias("t1")]


def _differing(a: str, b: str) -> Column:
    """Population count of the XOR of two odd sketches."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _verified(spec: Spec):
    """Cogrouped map: the shared document's text against those of its partners, on full sets of shingles."""

    def run(partners: pa.Table, shared: pa.Table) -> pa.Table:
        def full(raw: pa.BinaryScalar) -> set:
            words = raw.as_buffer().to_pybytes().lower().split()
            width = min(spec.words, len(words))
            return set(zip(*(words[i:] for i in range(width)), strict=False))

        out: list[tuple[int, int]] = []
        hub = full(shared.column("raw")[0])
        for a, b, raw in zip(partners.column("a").to_pylist(), partners.column("b").to_pylist(), partners.column("raw"), strict=True):
            other = full(raw)
            both = len(hub & other)
            if spec.under * both >= spec.over * (len(hub) + len(other) - both):
                out.append((a, b))
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return run


def _texts(docs: DataFrame, need: Table) -> DataFrame:
    """cid, raw: the text of each class in ``need`` (cid, rep); one row each."""
    want = need.small().select("cid", F.col("rep.id").alias("id"), F.col("rep.t0").alias("t0"), F.col("rep.t1").alias("t1"))
    return docs.join(want, ["id", "t0", "t1"]).select("cid", "raw").dropDuplicates(["cid"])


def confirm(pairs: Table, classes: Table, docs: DataFrame, spec: Spec) -> Table:
    """a, b of the pairs that are links by their full sets.

    Texts of the classes in question are fetched once.  A document with many partners is copied to as
    many tasks as hold PARTNERS of them each, so no task gathers an unbounded group.
    """
    wanted = pairs.df().select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    need = Table(classes.df().select("cid", "rep").join(wanted, "cid", "left_semi"), "near-wanted")
    texts = Table(_texts(docs, need), "near-texts")
    many = Table(pairs.df().groupBy("a").agg(F.count("*").alias("deg")).where(F.col("deg") > PARTNERS), "near-hubs")
    salt = F.pmod(F.xxhash64("b"), F.ceil(F.coalesce("deg", F.lit(1)) / PARTNERS))
    dealt = Table(pairs.df().join(many.small(), "a", "left").select("a", "b", salt.cast("long").alias("salt")), "near-dealt")
    partners = dealt.df().join(texts.df(), F.col("b") == F.col("cid")).select("a", "salt", "b", "raw")
    shared = dealt.df().select("a", "salt").distinct().join(texts.df(), F.col("a") == F.col("cid")).select("a", "salt", "raw")
    links = partners.groupBy("a", "salt").cogroup(shared.groupBy("a", "salt")).applyInArrow(_verified(spec), "a long, b long")
    return Table(links, "near-links")


def _merges(spec: Spec):
    """Grouped map over two blocks of a family: links that join components, by full sets of hashes.

    An inverted index of the second block's shingles gives a document's intersections with all of that
    block at once.  Only links that join two components are emitted, so the output is below the members.
    """

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        block, cid, label = (rows.column(c).to_numpy() for c in ("block", "cid", "label"))
        sets = [shingle_hashes(raw.as_buffer().to_pybytes().lower().split(), spec.words) for raw in rows.column("raw")]
        size = np.array([len(x) for x in sets], np.int64)
        at, to = np.flatnonzero(block == i), np.flatnonzero(block == j)
        owners = np.repeat(np.arange(len(to)), size[to])
        flat = np.concatenate([sets[k] for k in to]) if len(to) else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        owners = owners[order]
        known, start, times = np.unique(flat[order], return_index=True, return_counts=True)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        left, right = [], []
        for x in at if len(known) else []:
            place = np.minimum(np.searchsorted(known, sets[x]), len(known) - 1)
            place = place[known[place] == sets[x]]
            lists, lengths = start[place], times[place]
            index = np.repeat(lists - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum()) if len(place) else np.zeros(0, np.int64)
            both = np.bincount(owners[index], minlength=len(to))
            linked = spec.under * both >= spec.over * (size[x] + size[to] - both)
            for other, y in zip(*np.unique(label[to[linked]], return_index=True), strict=True):
                a, b = root(int(label[x])), root(int(other))
                if a != b:
                    parent[a] = b
                    left.append(int(cid[x]))
                    right.append(int(cid[to[np.flatnonzero(linked)[y]]]))
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return run


def _possible(most: int):
    """Grouped map over two blocks of a family's sketches: members of which smaller blocks have to be compared.

    A member counts for a pair of blocks if the other block has one of another component whose sketch is near.
    """

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        wide, block, cid, label = (rows.column(c).to_numpy() for c in ("wide", "block", "cid", "label"))
        odd = np.array(rows.column("odd").to_pylist(), np.int64).reshape(len(cid), -1).view(np.uint64)
        parts = [{b: np.flatnonzero((wide == w) & (block == b)) for b in np.unique(block[wide == w])} for w in (i, j)]
        found: dict[tuple[int, int], set] = {}
        for x, left in parts[0].items():
            for y, right in parts[1].items():
                if i == j and x > y:
                    continue
                other = label[left][:, None] != label[right][None, :]
                if not other.any():
                    continue
                apart = np.zeros(other.shape, np.int64)
                for k in range(odd.shape[1]):
                    apart += np.bitwise_count(odd[left, k][:, None] ^ odd[right, k][None, :])
                near = other & (apart <= most)
                if near.any():
                    found.setdefault((min(x, y), max(x, y)), set()).update(left[near.any(axis=1)].tolist(), right[near.any(axis=0)].tolist())
        out = [(key[0].as_py(), int(x), int(y), int(block[k]), int(cid[k]), int(label[k])) for (x, y), members in found.items() for k in sorted(members)]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        names = ("family", "i", "j", "block", "cid", "label")
        return pa.table({name: pa.array([r[k] for r in out], kind) for k, (name, kind) in enumerate(zip(names, kinds, strict=True))})

    return run


def _families(large: DataFrame, classes: Table, docs: DataFrame, spec: Spec) -> DataFrame:
    """a, b: links between components of the members (bucket, cid, label, hub) of large buckets.

    Buckets that share members are one family, whose members are compared once, whatever number of buckets
    they meet in.  Its sketches meet first, in wide blocks of small rows; texts go only to the pairs of
    blocks in which they have a possible partner.
    """
    family = components(large.select(F.col("cid").alias("a"), F.col("hub").alias("b")))
    named = family.df().select(F.col("node").alias("cid"), F.col("label").alias("family"))
    inside = Table(large.select("cid", "label").distinct().join(named, "cid").join(classes.df().select("cid", "rep", "n", "odd"), "cid"), "near-inside")
    sizes = inside.df().groupBy("family").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    blocks = sizes.select("family", F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int").alias("blocks"), F.ceil(F.col("m") / SKETCH_BLOCK).cast("int").alias("wides"))
    dealt = inside.df().join(Table(blocks, "near-families").small(), "family").withColumn("block", F.pmod(F.hash("cid"), F.col("blocks")))
    dealt = dealt.withColumn("wide", F.floor(F.col("block") * F.col("wides") / F.col("blocks")).cast("int"))
    both = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("wides") - 1)))
    sent = both.select("family", F.least("wide", "other").alias("i"), F.greatest("wide", "other").alias("j"), "wide", "block", "cid", "label", "odd")
    possible = Table(sent.groupBy("family", "i", "j").applyInArrow(_possible(spec.most_bits()), "family long, i int, j int, block int, cid long, label long"), "near-possible")
    if not possible.rows():
        return possible.df().select(F.col("cid").alias("a"), F.col("label").alias("b"))
    need = Table(inside.df().select("cid", "rep").join(possible.df().select("cid").distinct(), "cid", "left_semi"), "near-family-wanted")
    texts = Table(_texts(docs, need), "near-family-texts")
    return possible.df().join(texts.df(), "cid").groupBy("family", "i", "j").applyInArrow(_merges(spec), "a long, b long")


def _rest(members: Table, classes: Table, labels: Table, docs: DataFrame, spec: Spec) -> tuple[Table, Table | None]:
    """Candidates in small buckets, and links in large ones if there are such, across the components that share a bucket."""
    labelled = members.df().join(labels.small(), F.col("cid") == F.col("node"), "left").select("bucket", "cid", F.coalesce("label", "cid").alias("label"))
    labelled = Table(labelled, "near-labelled")
    mixed = labelled.df().groupBy("bucket").agg(F.count("*").alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("cid").alias("hub")).where("lo <> hi and m > 2").select("bucket", "m", "hub")
    mixed = Table(mixed, "near-mixed")
    open_ = Table(labelled.df().join(mixed.small(), "bucket"), "near-open")
    small = open_.df().where(F.col("m") <= SMALL_BUCKET).join(classes.df().select("cid", "odd"), "cid")
    other = small.select("bucket", F.col("cid").alias("b"), F.col("label").alias("lb"), F.col("odd").alias("ob"))
    pairs = small.join(other, "bucket").where("cid < b and label <> lb").where(_differing("odd", "ob") <= spec.most_bits()).select(F.col("cid").alias("a"), "b").distinct()
    large = open_.df().where(F.col("m") > SMALL_BUCKET)
    far = None if large.isEmpty() else Table(_families(large, classes, docs, spec), "near-far")
    return Table(pairs, "near-rest"), far


def _classes(df: DataFrame, id_col: str, text_col: str, spec: Spec) -> tuple[Table, Table]:
    """The rows (id, t0, t1, n, d0, d1), and the classes of equal sets (d0, d1, rep, m, label).

    ``rep`` is the first document of a class, ``m`` its rows, ``label`` one class of its component.
    """
    small_batches(df.sparkSession)
    docs = df.select(*document_key(id_col, text_col), utf8(text_col).alias("raw"))
    rows = Table(docs.mapInArrow(_sketched(spec), SKETCH_SCHEMA), "near-rows")
    grouped = rows.df().where("n > 0").groupBy("d0", "d1")
    distinct = grouped.agg(F.min(F.struct("id", "t0", "t1")).alias("rep"), F.count("*").alias("m"), F.min("n").alias("n"), F.first("bands").alias("bands"), F.first("odd").alias("odd"))
    classes = Table(distinct.withColumn("cid", F.monotonically_increasing_id()), "near-classes")  # writing settles the numbers
    keys = classes.df().select("cid", "rep", F.explode("bands").alias("bucket"))
    shared = Table(keys.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1").select("bucket"), "near-buckets")
    members = Table(keys.join(shared.small(), "bucket", "left_semi"), "near-members")
    first = members.df().groupBy("bucket").agg(F.min(F.struct("rep", "cid")).alias("hub")).select("bucket", F.col("hub.cid").alias("a"))
    first = Table(first, "near-first")
    sketch = lambda cid, odd: classes.df().select(F.col("cid").alias(cid), F.col("odd").alias(odd))
    star = Table(members.df().join(first.small(), "bucket").select("a", F.col("cid").alias("b")).where("a <> b").distinct(), "near-star")
    near = star.df().join(sketch("a", "oa"), "a").join(sketch("b", "ob"), "b").where(_differing("oa", "ob") <= spec.most_bits()).select("a", "b")
    links = confirm(Table(near, "near-candidates"), classes, docs, spec)
    labels = components(links.df())
    pairs, far = _rest(members, classes, labels, docs, spec)
    if pairs.rows():
        seen = star.df().select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = Table(pairs.df().join(seen, ["a", "b"], "left_anti"), "near-unseen")
    more = [t for t in (confirm(pairs, classes, docs, spec) if pairs.rows() else None, far) if t is not None and t.rows()]
    if more:
        every = links.df()
        for t in more:
            every = every.unionByName(t.df())
        labels = components(every)
    named = classes.df().join(labels.small(), F.col("cid") == F.col("node"), "left").select("d0", "d1", "rep", "m", F.coalesce("label", "cid").alias("label"))
    return rows, Table(named, "near-named")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", spec: Spec = Spec()) -> DataFrame:  # noqa: B008
    """One row per input row: id, n_shingles, component_id, kept."""
    with scratch() as keep:
        rows, named = _classes(df, id_col, text_col, spec)
        lowest = Table(named.df().groupBy("label").agg(F.min("rep.id").alias("component")), "near-lowest")
        where = keep(Table(named.df().join(lowest.small(), "label").select("d0", "d1", "component"), "near-where"))
        keep(rows)
    out = rows.df().select("id", "n", "d0", "d1").join(where.small(), ["d0", "d1"], "left")
    component = F.coalesce("component", "id")
    return out.select(real_id("id").alias("id"), F.col("n").alias("n_shingles"), real_id(component).alias("component_id"), (component == F.col("id")).alias("kept"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", spec: Spec = Spec(words=5, over=80, bands=30, rows=4)) -> DataFrame:  # noqa: B008
    """The input with one row of each component: the first by id, then by the text's digest.

    Rows without words stay, however often.  Rows that share an id are told by their texts; of rows equal in
    both, of which at most one stays, any may.  Only components of two rows or more are looked at.
    """
    with scratch() as keep:
        rows, named = _classes(df, id_col, text_col, spec)
        keepers = named.df().groupBy("label").agg(F.min("rep").alias("keep"), F.sum("m").alias("members")).where("members > 1").select("label", "keep")
        where = Table(named.df().join(Table(keepers, "near-keepers").small(), "label").select("d0", "d1", "keep"), "near-where")
        key = ["id", "t0", "t1"]
        inside = Table(rows.df().select(*key, "d0", "d1").join(where.small(), ["d0", "d1"]).groupBy(*key).agg(F.first("keep").alias("keep"), F.count("*").alias("times")), "near-inside")
        gone = keep(Table(inside.df().where(F.struct(*key) != F.col("keep")).select(*key), "near-gone"))
        twice = keep(Table(inside.df().where((F.struct(*key) == F.col("keep")) & (F.col("times") > 1)).select(*key), "near-twice"))
    every = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *document_key(id_col, text_col))
    left = every.join(gone.small(), key, "left_anti")
    if twice.rows():
        again = left.join(twice.small(), key, "left_semi").groupBy(*key).agg(F.first("row").alias("row"))
        left = left.join(twice.small(), key, "left_anti").select("row").unionByName(again.select("row"))
    return left.select(*(F.col("row")[c].alias(c) for c in df.columns))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: shingles of three words, similarity 0.85, one row per document."""
    return near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
        SELECT doc_id, w[i : i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT a AS node, a AS other FROM links UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.other = links.a),
low AS (SELECT node, min(other) AS component FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least(low.component, d.doc_id), d.doc_id) AS component_id, coalesce(least(low.component, d.doc_id), d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.node = d.doc_id
"""
