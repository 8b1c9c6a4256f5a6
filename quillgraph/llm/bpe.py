"""Byte-level BPE by per-prefix dynamic programming, without replaying merges.

For a pre-token of n bytes, ``last[i]`` is the one token that ends the canonical encoding of the prefix
of i bytes.  Candidates are the vocabulary's tokens that are suffixes of that prefix; the vocabulary's
suffix automaton (goto and suffix links, as in Aho and Corasick) lists them while it reads the bytes
once.  A candidate t is right exactly if (last[i - len(t)], t) is a compatible pair: encoding the two
tokens' bytes together yields these two tokens again.  Following the back-pointers from n gives the ids.
Time is linear in n times the matches at a place, so a pre-token of any length is safe.

Nulls encode as the empty text.  Repeated rows encode alike; very long texts are encoded whole; an empty table
gives an empty result.  Columns that are kept stand beside the operator's own; of two with one name the
operator's own stands.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import by_value, slices, small_batches, table, utf8, worker_cache

by_value(__name__)

#: Fixed: the pre-tokenizer's pattern (published with the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pre-tokens of a worker's younger memory; when it is full it becomes the older one.  It bounds memory, not results.
MEMORY = 200_000
#: Token pairs whose compatibility a worker remembers.
PAIRS = 300_000


def byte_letters() -> dict[str, int]:
    """Letter of the vocabulary file -> byte: printable bytes stand for themselves, others move up from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder(dict):
    """Maps a pre-token to its ids, packed as little-endian unsigned 32-bit integers."""

    def __init__(self, spec: str):
        import ahocorasick
        import regex

        super().__init__()
        self.old: dict[str, bytes] = {}
        spec_json = json.loads(spec)
        model, letters = spec_json["model"], byte_letters()
        to_bytes = lambda token: bytes(letters[c] for c in token)
        self.token = {i: to_bytes(t) for t, i in model["vocab"].items()}
        ids = {b: i for i, b in self.token.items()}
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token -> (rank, left, right) of the merge that makes it
        for rank, merge in enumerate(model["merges"]):
            left, right = (to_bytes(x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            pair, made = (ids[left], ids[right]), ids[left + right]
            self.merged[pair] = (rank, made)
            self.parts.setdefault(made, (rank, *pair))
        self.special = {t["content"]: t["id"] for t in spec_json.get("added_tokens", [])}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.split = regex.compile(PATTERN).findall
        self.cut = regex.compile("|".join(f"({regex.escape(t)})" for t in sorted(self.special, key=len, reverse=True))).split if self.special else None
        self.packed = {i: i.to_bytes(4, "little") for i in [*self.token, *self.special.values()]}
        self.text = self.token | {i: t.encode() for t, i in self.special.items()}
        self.suffixes = ahocorasick.Automaton()
        for b, i in ids.items():
            if len(b) == 1 or (i in self.parts and self.whole(i)):
                self.suffixes.add_word(b.decode("latin-1"), (i, len(b)))
        self.suffixes.make_automaton()
        self.match = self.suffixes.iter

    def whole(self, token: int) -> bool:
        """Whether encoding the token's own bytes yields that token: its making pair must be compatible below its rank."""
        rank, left, right = self.parts[token]
        return self.compatible(left, right, rank)

    def compatible(self, left: int, right: int, below: int | None = None) -> bool:
        """Whether no merge across the seam comes before the merges that build the two sides.

        The seam's two inner neighbours are undone in the reverse order of their making, highest rank
        first.  While they stand, a merge of the pair at the seam must have a rank above the rank at
        which one of them was consumed; ``below`` is the rank at which the seam itself closes.
        """
        limit = len(self.merged) if below is None else below
        base = (-1, -1, -1)
        while True:
            found = self.merged.get((left, right))
            if found and found[0] < limit:
                return False
            made_left, made_right = self.parts.get(left, base), self.parts.get(right, base)
            if made_left[0] < 0 and made_right[0] < 0:
                return True
            if made_left[0] > made_right[0]:
                # the left side closed last: before that, its right part stood at the seam
                limit, left = made_left[0], made_left[2]
            else:
                # of equal ranks the leftmost merge goes first, so the right one closes after the seam
                limit, right = made_right[0] + 1, made_right[1]

    def tokens(self, piece: bytes) -> list[int]:
        n = len(piece)
        last: list = [None] * (n + 1)
        pairs = self.pairs
        for end, (token, size) in self.match(piece.decode("latin-1")):
            end += 1
            if last[end] is not None:
                continue
            start = end - size
            if start:
                before = last[start]
                if before is None:
                    continue
                key = (before[0], token)
                fits = pairs.get(key)
                if fits is None:
                    fits = pairs[key] = self.compatible(*key)
                if not fits:
                    continue
            last[end] = (token, start)
        out = []
        while n:
            token, n = last[n]
            out.append(token)
        return out[::-1]

    def __missing__(self, piece: str) -> bytes:
        got = self.old.get(piece)
        if got is None:
            packed = self.packed
            got = b"".join([packed[i] for i in self.tokens(piece.encode())])
        if len(piece) < 64:
            if len(self) >= MEMORY:
                self.old = dict(self)
                self.clear()
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self[piece] = got
        return got

    def encode(self, text: str) -> bytes:
        """Packed ids of a whole text; special tokens' strings are single ids."""
        if self.cut is None or not any(t in text for t in self.special):
            return b"".join(map(self.__getitem__, self.split(text)))
        out = []
        for part in self.cut(text):
            if part in self.special:
                out.append(self.packed[self.special[part]])
            elif part:
                out.append(b"".join(map(self.__getitem__, self.split(part))))
        return b"".join(out)

    def decode(self, packed: bytes) -> bytes:
        """UTF-8 of the text that the ids stand for; broken sequences become U+FFFD."""
        raw = b"".join(map(self.text.__getitem__, memoryview(packed).cast("I").tolist()))
        try:
            raw.decode()
        except UnicodeDecodeError:
            raw = raw.decode("utf-8", "replace").encode()
        return raw


def encoder(spec: str) -> Encoder:
    key = ("bpe", hashlib.sha256(spec.encode()).hexdigest())
    cache = worker_cache()
    if key not in cache:
        cache[key] = Encoder(spec)
    return cache[key]


def tokenizer_spec(path: str | None = None) -> str:
    """The tokenizer file's text, read on the driver; executors get it inside the tasks' broadcast."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def _round_trip(spec, columns: list[pa.Field], keep_ids: bool, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(spec.value)
        hexed = lambda b: hashlib.sha256(b).hexdigest()
        for batch in slices(batches):
            ids, texts = [], []
            for raw in batch.column(batch.num_columns - 1).to_pylist():
                packed = bpe.encode(raw.decode("utf-8", "replace"))
                ids.append(packed)
                texts.append(bpe.decode(packed))
            arrays = [batch.column(i) for i in range(len(columns))]
            arrays += [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(hexed, ids), pa.string()), pa.array(map(hexed, texts), pa.string())]
            names = [c.name for c in columns] + ["n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                arrays.append(pa.array(ids, pa.binary()))
                names.append("token_ids")
            if keep_text:
                arrays.append(pa.array([x.decode() for x in texts], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def encode_table(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = (), spec_path: str | None = None, keep_ids: bool = True, keep_text: bool = True) -> DataFrame:
    """Encode and decode every text.

    Returns the columns in ``keep`` and n_tokens, ids_sha256, decoded_sha256; with ``keep_ids`` also
    token_ids (packed little-endian unsigned 32-bit), with ``keep_text`` decoded.  One map over the rows, no shuffle.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    small_batches(df.sparkSession)
    spec = df.sparkSession.sparkContext.broadcast(tokenizer_spec(spec_path))  # one file of fixed size
    keep = tuple(c for c in keep if c not in ("n_tokens", "ids_sha256", "decoded_sha256", *["token_ids"] * keep_ids, *["decoded"] * keep_text))
    fields = [df.schema[c] for c in keep]
    out = [*fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if keep_ids:
        out.append(T.StructField("token_ids", T.BinaryType()))
    if keep_text:
        out.append(T.StructField("decoded", T.StringType()))
    rows = df.select(*keep, utf8(text_col).alias("__utf8"))
    columns = [pa.field(f.name, to_arrow_type(f.dataType)) for f in fields]
    return rows.mapInArrow(_round_trip(spec, columns, keep_ids, keep_text), T.StructType(out))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: one row per document with digests of its ids and of the decoded text."""
    docs = table(spark, sf_dir, "documents")
    return encode_table(docs, "text", ("doc_id",), keep_ids=False, keep_text=False).select(F.col("doc_id").cast("long").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")
