"""Language-model scores: a hierarchical log-bilinear model trained in numpy with noise-contrastive estimation.

Words are numbered within blocks of some megabytes of text, so texts become small integers once and every
later step is array work.  Counts over all training documents come back to each block as one number per word
of the block; no task holds the whole vocabulary, and a word has one row per block, however frequent it is.

Every word has a class.  The most frequent words, as many as the square root of the vocabulary's size, are
classes of their own, so is the end of text, and as many classes again take the other words by their last
three bytes; within these the smoothed unigram decides, one unseen word included.  So the classes grow with
the corpus, words that were never seen have one too, and the probabilities of all words sum to one.

Classes are dealt into groups, half as many as their number's root: every token meets all groups, in training
too, but only its own group's classes.  A context of n words has the
vector sum of c_i * q(w_i); a group and a class within its group each have a vector and a bias, and the score
is the scalar product plus bias.  P(class) is P(group) times P(class within the group), both normalised over
all their outcomes by batched matrix products, so scores are exact logarithms of normalised probabilities.

Training contrasts what was seen with noise: at the groups with the unigram's expectation over all of them,
within a group with draws from its unigram.  Biases start as logarithms of the unigram.  Training documents
are dealt into blocks by a hash of id and text, whatever partitions they came in, and every training token is
used once a pass: a round takes its share of each block's tokens from the common parameters, and a row's mean
over the blocks, weighted by how often each of them used the row, starts the next.  Sums over blocks may
differ in their last bits with the order of the work, and scores with them.

Null and empty texts are the end token alone.  A null id is hashed as the empty text.  Repeated rows are
documents of their own, very long texts are worked on whole, an empty table gives an empty result, and only
id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import Table, by_value, id_key, real_id, slices, small_batches, table, utf8

by_value(__name__)

#: The end token among words; no word holds a space.
END = b" "
#: Bytes of text of a block that numbers its words; words of a counting task and tokens of a training block, on average at most.
BLOCK_BYTES, COUNT_ROWS, BLOCK_TOKENS = 16 << 20, 500_000, 1 << 21
#: Floats of a row in which parameters are summed.
PART = 1 << 14
#: Rows of scores that are worked on at once.
PIECE = 2048


@dataclass(frozen=True)
class Spec:
    """Sizes of the model and of its training; ``scale`` times the vocabulary's root is each kind's number of classes."""

    scale: float = 1.0
    width: int = 16
    context: int = 3
    rounds: int = 2
    passes: int = 1
    batch: int = 8192
    noise: int = 16
    per_token: float = 8.0
    rate: float = 0.1
    slow: float = 0.01
    seed: int = 5


def pack(ids: np.ndarray) -> bytes:
    """Small integers, byte planes apart, compressed."""
    planes = ids.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return pa.Codec("zstd", 1).compress(np.ascontiguousarray(planes).tobytes(), asbytes=True)


def unpack(raw: bytes, n: int) -> np.ndarray:
    flat = pa.Codec("zstd").decompress(raw, decompressed_size=4 * n, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def _sorted(values: np.ndarray) -> np.ndarray:
    """Stable order of small numbers; two bytes each sort by radix."""
    return np.argsort(values.astype(np.uint16) if not len(values) or values.max() < 1 << 16 else values, kind="stable")


BLOCK_SCHEMA = "block long, id long, held boolean, n int, ids binary, word binary, lid int, seen long"


def _blocks(size: int):
    """Map over partitions: documents as local ids, and each block's words with their training counts."""

    def flush(block: int, parts: list) -> Iterator[pa.RecordBatch]:
        ids, held = (np.concatenate([p.column(i).to_numpy(zero_copy_only=False) for p in parts]) for i in (0, 1))
        raw = pa.concat_arrays([p.column(2) for p in parts]).view(pa.string())
        # Arrow's ASCII functions work on bytes: A-Z, and the six separators
        split = pc.ascii_split_whitespace(pc.ascii_lower(raw))
        words = split.flatten()
        real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)  # a space at a text's end leaves an empty part
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        starts = np.r_[0, np.cumsum(real)][offsets]
        encoded = words.filter(pa.array(real)).dictionary_encode()
        names = pa.concat_arrays([encoded.dictionary.view(pa.binary()), pa.array([END], pa.binary())])
        n = np.diff(starts) + 1
        ends = np.cumsum(n)
        tokens = np.full(ends[-1], len(names) - 1, np.int64)
        place = np.ones(len(tokens), bool)
        place[ends - 1] = False
        tokens[place] = encoded.indices.to_numpy()
        seen = np.bincount(tokens[~np.repeat(held, n)], minlength=len(names))
        order = np.argsort(-seen, kind="stable")
        number = np.empty(len(names), np.int64)
        number[order] = np.arange(len(names))
        tokens = number[tokens]
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int64()]
        columns = [c.partition(" ")[0] for c in BLOCK_SCHEMA.split(", ")]
        packed = [pack(tokens[e - k : e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
        for i in range(0, len(n), 5000):
            k = len(n[i : i + 5000])
            docs = [pa.array(np.full(k, block)), pa.array(ids[i : i + k]), pa.array(held[i : i + k]), pa.array(n[i : i + k], pa.int32()), pa.array(packed[i : i + k], pa.binary())]
            yield pa.RecordBatch.from_arrays([*docs, *(pa.nulls(k, t) for t in kinds[5:])], names=columns)
        for i in range(0, len(names), 100_000):
            at = order[i : i + 100_000]
            k = len(at)
            own = [names.take(pa.array(at)), pa.array(np.arange(i, i + k), pa.int32()), pa.array(seen[at], pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, block)), *(pa.nulls(k, t) for t in kinds[1:5]), *own], names=columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, have, parts = TaskContext.get().partitionId() << 32, 0, []
        for batch in slices(batches):
            if batch.num_rows:
                parts.append(batch)
                have += batch.nbytes
            if have >= size:
                yield from flush(block, parts)
                block, have, parts = block + 1, 0, []
                pa.default_memory_pool().release_unused()
        if parts:
            yield from flush(block, parts)

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map over partitions that hold all rows of their words: each row with its word's sum; ``first`` marks one row a word."""
    rows = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if rows is None or not rows.num_rows:
        return
    words = rows.column("word").combine_chunks()
    encoded = words.dictionary_encode()
    which = encoded.indices.to_numpy()
    total = np.bincount(which, weights=rows.column("seen").to_numpy()).astype(np.int64)
    order = np.argsort(which, kind="stable")
    which = which[order]
    first = np.r_[True, which[1:] != which[:-1]]
    for i in range(0, len(order), 100_000):
        at = pa.array(order[i : i + 100_000])
        arrays = [words.take(at), *(rows.column(c).combine_chunks().take(at) for c in ("block", "lid")), pa.array(total[which[i : i + 100_000]]), pa.array(first[i : i + 100_000])]
        yield pa.RecordBatch.from_arrays(arrays, names=["word", "block", "lid", "count", "first"])


class Model:
    """Parameters of the model: q (classes as context), c (weights by place), and vectors and biases of the
    groups (rg, bg) and of the classes within them (r, b).  Class numbers are group * members + place.

    ``counts`` has a count per class, -1 where a number stands for no class.
    """

    NAMES = ("q", "r", "b", "c", "rg", "bg")

    def __init__(self, spec: Spec, counts: np.ndarray, members: int):
        rng = np.random.default_rng(spec.seed)
        self.spec, self.members = spec, members
        there = (counts >= 0).reshape(-1, members)
        mass = np.where(there, counts.reshape(-1, members) + 0.5, 0.0)
        self.group_noise = mass.sum(axis=1) / mass.sum()
        self.noise = mass / mass.sum(axis=1, keepdims=True)
        n, groups = len(counts), len(mass)
        single = np.float32
        self.q = rng.normal(0, 0.1, (n, spec.width)).astype(single)
        self.r = np.zeros((n, spec.width), single)
        self.b = np.where(there, np.log(np.maximum(self.noise, 1e-30)), -1e4).astype(single).ravel()
        self.c = (np.ones((spec.context, spec.width)) / np.arange(1, spec.context + 1)[:, None]).astype(single)
        self.rg = np.zeros((groups, spec.width), single)
        self.bg = np.log(self.group_noise).astype(single)
        #: Squared gradients so far, by row.
        self.past = {k: np.full(len(getattr(self, k)), 1e-8, single) for k in self.NAMES}

    def state(self) -> dict:
        """All of it as plain values, which a broadcast carries to executors without this module."""
        return {"spec": asdict(self.spec)} | {k: v for k, v in self.__dict__.items() if k != "spec"}

    @classmethod
    def of(cls, state: dict) -> Model:
        """A model of its own: what training changes is copied."""
        m = object.__new__(cls)
        m.__dict__ |= state
        m.spec = Spec(**state["spec"])
        for k in cls.NAMES:
            setattr(m, k, state[k].copy())
        m.past = {k: v.copy() for k, v in state["past"].items()}
        return m

    def contexts(self, history: np.ndarray) -> np.ndarray:
        """Vectors of contexts, given as rows of class numbers, the nearest word first."""
        return sum(self.c[i] * self.q[history[:, i]] for i in range(self.spec.context))

    @staticmethod
    def _log_softmax(scores: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Logarithm of each row's probability of its own column; works in place."""
        out = scores[np.arange(len(own)), own]
        top = float(scores.max())
        if not -60 < top < 60:  # rows that single precision can't hold as they are
            top = scores.max(axis=1)
            scores -= top[:, None]
            np.exp(scores, out=scores)
            return out - top - np.log(scores.sum(axis=1))
        np.exp(scores, out=scores)
        return out - np.log(scores.sum(axis=1))

    def log_probabilities(self, history: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logarithms of normalised class probabilities, by batched matrix products."""
        out, m = np.empty(len(target), np.float64), self.members
        for i in range(0, len(target), 1 << 16):
            h, t = history[i : i + (1 << 16)], target[i : i + (1 << 16)]
            order = _sorted(t // m)
            h, t = h[order], t[order]
            g, v = t // m, self.contexts(h)
            log_p = np.concatenate([self._log_softmax(v[k : k + PIECE] @ self.rg.T + self.bg, g[k : k + PIECE]) for k in range(0, len(t), PIECE)])
            edges = [*np.flatnonzero(np.r_[True, g[1:] != g[:-1]]).tolist(), len(g)]
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                at = int(g[start]) * m
                log_p[start:end] += self._log_softmax(v[start:end] @ self.r[at : at + m].T + self.b[at : at + m], t[start:end] - at)
            out[i + order] = log_p
        return out

    def _step(self, name: str, rows: np.ndarray | slice, total: np.ndarray, slow: float = 1.0) -> None:
        """A step against the summed gradient of each row, scaled by the row's history."""
        past, values = self.past[name], getattr(self, name)
        past[rows] += total * total if total.ndim == 1 else np.mean(total * total, axis=1)
        step = (self.spec.rate * slow / np.sqrt(past[rows])).astype(np.float32)
        values[rows] -= total * (step if total.ndim == 1 else step[:, None])

    def _scatter(self, name: str, at: np.ndarray, grad: np.ndarray, slow: float = 1.0) -> None:
        order = _sorted(at)
        at = at[order]
        start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        self._step(name, at[start], np.add.reduceat(grad[order], start, axis=0), slow)

    def train(self, history: np.ndarray, target: np.ndarray, seed: int) -> None:
        """Noise-contrastive estimation over all the given tokens, once, in a random order."""
        spec, m, rng = self.spec, self.members, np.random.default_rng(seed)
        single = np.float32
        mass, log_mass = (spec.per_token * self.group_noise).astype(single), np.log(spec.per_token * self.group_noise).astype(single)
        log_noise = np.log(spec.per_token * np.maximum(self.noise, 1e-30)).astype(single).ravel()
        cdf = np.cumsum(self.noise, axis=1)
        last = m - 1 - np.argmax((self.noise > 0)[:, ::-1], axis=1)
        ones = np.ones(spec.batch, single)
        # steps are scaled by the gradients' history, so the batch's size needn't divide them

        def sigmoid(x: np.ndarray) -> np.ndarray:
            np.negative(x, out=x)
            np.exp(x, out=x)
            x += 1
            return np.reciprocal(x, out=x)

        mixed = rng.permutation(len(target)).astype(np.int32)
        history, target = history[mixed], target[mixed]  # once, so that a batch lies together
        with np.errstate(over="ignore"):
            for i in range(0, len(target), spec.batch):
                h, t = history[i : i + spec.batch], target[i : i + spec.batch]
                order = _sorted(t // m)
                h, t = h[order], t[order]
                g, every = t // m, np.arange(len(t))
                places = [self.q[h[:, j]] for j in range(spec.context)]
                v = sum(self.c[j] * places[j] for j in range(spec.context))
                # groups: the noise's expectation over all of them, in pieces that stay in the cache
                dv, drg, dbg = np.empty_like(v), np.zeros_like(self.rg), np.zeros_like(self.bg)
                shift = self.bg - log_mass
                for k in range(0, len(t), PIECE):
                    vs, gs, rows = v[k : k + PIECE], g[k : k + PIECE], every[: len(t) - k][:PIECE]
                    s = vs @ self.rg.T
                    s += shift
                    sigmoid(s)
                    seen = s[rows, gs]
                    s *= mass
                    s[rows, gs] += seen - 1
                    np.matmul(s, self.rg, out=dv[k : k + PIECE])
                    drg += s.T @ vs
                    dbg += ones[: len(s)] @ s
                # classes: each group's tokens share draws from its unigram
                rows, grads, biases = [], [], []
                edges = [*np.flatnonzero(np.r_[True, g[1:] != g[:-1]]).tolist(), len(g)]
                for start, end in zip(edges[:-1], edges[1:], strict=True):
                    k, vs, ts = int(g[start]), v[start:end], t[start:end]
                    fake = k * m + np.minimum(np.searchsorted(cdf[k], rng.random(spec.noise) * cdf[k, -1], side="right"), last[k])
                    own, other = self.r[ts], self.r[fake]
                    real = sigmoid(np.einsum("ij,ij->i", vs, own) + self.b[ts] - log_noise[ts])
                    real -= 1
                    drawn = sigmoid(vs @ other.T + (self.b[fake] - log_noise[fake]))
                    drawn *= single(spec.per_token / spec.noise)
                    dv[start:end] += real[:, None] * own + drawn @ other
                    rows += [ts, fake]
                    grads += [real[:, None] * vs, drawn.T @ vs]
                    biases += [real, ones[: len(drawn)] @ drawn]
                both = np.concatenate(rows)
                dc = np.stack([np.einsum("ij,ij->j", dv, places[j]) for j in range(spec.context)])
                self._scatter("r", both, np.concatenate(grads))
                self._scatter("b", both, np.concatenate(biases), spec.slow)
                self._scatter("q", h.T.ravel(), np.concatenate([dv * self.c[j] for j in range(spec.context)]))
                self._step("rg", slice(None), drg)
                self._step("bg", slice(None), dbg, spec.slow)
                self._step("c", slice(None), dc, 0.1)

    def uses(self, history: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """How often tokens use the rows of each parameter."""
        n = len(self.q)
        seen = np.bincount(target, minlength=n).astype(np.float32)
        told = np.bincount(history.ravel(), minlength=n).astype(np.float32)
        every = np.float32(len(target))
        return {"q": told, "r": seen, "b": seen} | {k: np.full(len(getattr(self, k)), every) for k in ("c", "rg", "bg")}

    def weighed(self, uses: dict[str, np.ndarray]) -> np.ndarray:
        """Parameters and squared gradients times the uses of their rows, and the uses, in one array."""
        out = []
        for k in self.NAMES:
            x, u = getattr(self, k), uses[k]
            out += [(x * (u if x.ndim == 1 else u[:, None])).ravel(), self.past[k] * u, u]
        return np.concatenate(out)

    def load(self, flat: np.ndarray) -> None:
        """From a sum of ``weighed``: means of the rows that were used; others stay."""
        at = 0

        def take(size: int) -> np.ndarray:
            nonlocal at
            at += size
            return flat[at - size : at]

        for k in self.NAMES:
            old = getattr(self, k)
            x, past, u = take(old.size).reshape(old.shape), take(len(old)), take(len(old))
            used = u > 0
            old[used] = x[used] / (u[used] if old.ndim == 1 else u[used, None])
            self.past[k][used] = past[used] / u[used]


def _history(tokens: np.ndarray, starts: np.ndarray, end: int, n: int) -> np.ndarray:
    """Rows of the n classes before each token, nearest first; before the first word stands the end."""
    out = np.full((len(tokens), n), end, np.int32)
    place = np.arange(len(tokens)) - np.repeat(starts, np.diff(np.append(starts, len(tokens))))
    for i in range(n):
        ok = np.flatnonzero(place > i)
        out[ok, i] = tokens[ok - i - 1]
    return out


def suffix_code(word, size: int):
    """Class of a word among ``size`` by its last three bytes."""
    return F.crc32(F.substring(word, -3, 3)) % size


READY_SCHEMA = "id long, held boolean, n int, known long, base double, within double, classes binary"


def _ready(named, total: int, distinct: int):
    """Cogrouped map over a block: documents as classes, with what doesn't depend on the model.

    ``named`` holds the class of each single word and suffix, and per class whether it is a single word, its
    count and its known words.  A row's ``kind`` is the place among the single words, or below zero the suffix.
    """

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        singles, suffixes, single, counts, known = named.value
        lid, kind, seen = (words.column(c).to_numpy() for c in ("lid", "kind", "count"))
        size = int(lid.max()) + 1 if len(lid) else 0
        count, classes = np.zeros(size, np.float64), np.zeros(size, np.int64)
        count[lid] = seen
        classes[lid] = np.where(kind >= 0, singles[np.maximum(kind, 0)], suffixes[np.maximum(-kind - 1, 0)])
        base = np.log10((count + 0.1) / (total + 0.1 * (distinct + 1)))
        within = np.where(single[classes], 0.0, np.log10((count + 0.1) / (counts[classes] + 0.1 * (known[classes] + 1))))
        rows = []
        for raw, n in zip(docs.column("ids").to_pylist(), docs.column("n").to_pylist(), strict=True):
            ids = unpack(raw, n)
            rows.append((int((count[ids] > 0).sum()), float(base[ids].sum()), float(within[ids].sum()), pack(classes[ids])))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        kinds = (pa.int64(), pa.float64(), pa.float64(), pa.binary())
        return pa.table([docs.column(c) for c in ("id", "held", "n")] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "held", "n", "known", "base", "within", "classes"])

    return run


def _gathered(key: tuple, rows: pa.Table) -> pa.Table:
    """A training block as one row, in an order that doesn't depend on how the rows arrived."""
    pa.default_memory_pool().release_unused()
    docs = sorted(zip(rows.column("id").to_pylist(), rows.column("classes").to_pylist(), rows.column("n").to_pylist(), strict=True))
    lengths = np.array([d[2] for d in docs], np.int64)
    tokens = np.concatenate([unpack(d[1], d[2]) for d in docs])
    return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([len(tokens)], pa.int64()), "docs": pa.array([len(docs)], pa.int64()), "lengths": pa.array([pack(lengths)], pa.binary()), "tokens": pa.array([pack(tokens)], pa.binary())})


def _trained(model, end: int, round_: int, fan: int):
    """Map over training blocks: the sum of their weighed parameters after a round, in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        spec, total = Spec(**model.value["spec"]), None
        for batch in batches:
            for row in batch.to_pylist():
                own = Model.of(model.value)
                lengths, tokens = unpack(row["lengths"], row["docs"]), unpack(row["tokens"], row["n"])
                history = _history(tokens, np.r_[0, np.cumsum(lengths)[:-1]], end, spec.context)
                share = np.random.default_rng((spec.seed, row["block"])).permutation(len(tokens))
                share = np.sort(np.concatenate([share[(round_ + i) % spec.rounds :: spec.rounds] for i in range(spec.passes)]))
                history, tokens = history[share], tokens[share].astype(np.int32)
                own.train(history, tokens, (spec.seed, row["block"], round_))
                flat = own.weighed(own.uses(history, tokens)).astype(np.float64)
                total = flat if total is None else total + flat
        if total is not None:
            parts = [total[i : i + PART].tobytes() for i in range(0, len(total), PART)]
            spread = np.full(len(parts), TaskContext.get().partitionId() % fan)
            yield pa.RecordBatch.from_pydict({"part": pa.array(np.arange(len(parts)), pa.int32()), "spread": pa.array(spread, pa.int32()), "sums": pa.array(parts, pa.binary())})

    return run


def _summed(rows: pa.Table) -> pa.Table:
    total = None
    for raw in rows.column("sums"):
        x = np.frombuffer(raw.as_buffer(), np.float64)
        total = x.copy() if total is None else total + x
    return pa.table({"part": rows.column("part")[:1], "sums": pa.array([total.tobytes()], pa.binary())})


def _scored(model, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.of(model.value)
        for batch in slices(batches):
            if not batch.num_rows:
                continue
            n = batch.column("n").to_numpy().astype(np.int64)
            tokens = np.concatenate([unpack(raw, k) for raw, k in zip(batch.column("classes").to_pylist(), n.tolist(), strict=True)])
            starts = np.r_[0, np.cumsum(n)[:-1]]
            log_p = own.log_probabilities(_history(tokens, starts, end, own.spec.context), tokens)
            score = np.add.reduceat(log_p, starts) / np.log(10) + batch.column("within").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held"), pa.array(n), batch.column("known"), batch.column("base"), pa.array(score)],
                names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"],
            )

    return run


def held_out(id_col: str):
    """crc32 of the id as text, modulo 10, is 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0


@dataclass
class Counts:
    """Counts over all training documents, and the classes: the single words, the numbers of single words and
    of suffixes, of each class its number, whether it is a single word, its count and known words."""

    total: int
    distinct: int
    words: list[bytes]
    singles: np.ndarray
    suffixes: np.ndarray
    single: np.ndarray
    counts: np.ndarray
    known: np.ndarray
    members: int

    @property
    def end(self) -> int:
        return int(self.singles[-1])


def count_classes(rows: DataFrame, spec: Spec) -> Counts:
    """``rows`` has word, count and first.  What reaches the driver grows with the vocabulary's root."""
    known = rows.where("first and count > 0")
    total, distinct = known.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    size = max(1, math.ceil(spec.scale * math.sqrt(distinct)))
    top = [(bytes(r.word), r["count"]) for r in known.where(F.col("word") != F.lit(END)).orderBy(F.desc("count"), "word").limit(size).collect()]
    ended = known.where(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    words = [*(w for w, _ in top), END]
    named = rows.sparkSession.createDataFrame([(bytearray(w),) for w in words], "word binary")
    rest = known.join(F.broadcast(named), "word", "left_anti").groupBy(suffix_code(F.col("word"), size).alias("code")).agg(F.sum("count").alias("c"), F.count("*").alias("k")).collect()
    n, m = len(words), len(words) + size
    counts, distinct_words = np.zeros(m), np.zeros(m)
    counts[:n] = [*(c for _, c in top), ended]
    distinct_words[:n] = 1
    for r in rest:
        counts[n + r.code], distinct_words[n + r.code] = r.c, r.k
    # by frequency in turn over the groups, so that these weigh alike
    groups = math.ceil(math.sqrt(m) / 2)
    members = -(-m // groups)
    rank = np.empty(m, np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(m)
    number = rank % groups * members + rank // groups
    full = groups * members
    single, by_class, known_by_class = np.zeros(full, bool), np.full(full, -1.0), np.zeros(full)
    single[number[:n]] = True
    by_class[number], known_by_class[number] = counts, distinct_words
    return Counts(int(total), int(distinct), words, number[:n], number[n:], single, by_class, known_by_class, members)


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", spec: Spec = Spec(), block_bytes: int = BLOCK_BYTES, block_tokens: int = BLOCK_TOKENS) -> DataFrame:  # noqa: B008
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = df.sparkSession
    small_batches(spark)
    source = df.select(id_key(id_col).alias("id"), held_out(id_col).alias("held"), utf8(text_col).alias("raw"))
    blocks = Table(source.mapInArrow(_blocks(block_bytes), BLOCK_SCHEMA), "lm-blocks")
    docs = blocks.df().where("ids is not null").select("block", "id", "held", "n", "ids")
    words = blocks.df().where("word is not null").select("block", "lid", "word", "seen")
    dealt = words.repartition(max(1, -(-words.count() // COUNT_ROWS)), "word")
    counted = Table(dealt.mapInArrow(_counted, "word binary, block long, lid int, count long, first boolean"), "lm-counts")
    c = count_classes(counted.df(), spec)
    model = Model(spec, c.counts, c.members)
    # the single words, of which there are as many as the vocabulary's root
    named = spark.createDataFrame([(bytearray(w), i) for i, w in enumerate(c.words)], "word binary, place long")
    kind = F.coalesce("place", -1 - suffix_code(F.col("word"), len(c.suffixes)))
    final = counted.df().join(F.broadcast(named), "word", "left").select("block", "lid", "count", kind.alias("kind"))
    shared = spark.sparkContext.broadcast((c.singles, c.suffixes, c.single, c.counts, c.known))
    ready = Table(docs.groupBy("block").cogroup(final.groupBy("block")).applyInArrow(_ready(shared, c.total, c.distinct), READY_SCHEMA), "lm-ready")
    blocks.drop()
    counted.drop()
    if c.total:
        many = max(1, -(-c.total // block_tokens))
        block = F.pmod(F.xxhash64("id", "classes"), F.lit(many)).alias("block")
        gathered = ready.df().where("not held").select(block, "id", "n", "classes").groupBy("block").applyInArrow(_gathered, "block long, n long, docs long, lengths binary, tokens binary")
        training = Table(gathered, "lm-training")
        fan = math.ceil(math.sqrt(many))
        for i in range(spec.rounds):
            shared = spark.sparkContext.broadcast(model.state())
            parts = training.df().mapInArrow(_trained(shared, c.end, i, fan), "part int, spread int, sums binary")
            some = parts.groupBy("part", "spread").applyInArrow(_summed, "part int, sums binary")
            rows = some.groupBy("part").applyInArrow(_summed, "part int, sums binary").collect()  # the model's size
            rows.sort(key=lambda r: r.part)
            model.load(np.concatenate([np.frombuffer(bytes(r.sums), np.float64) for r in rows]))
        training.drop()
    shared = spark.sparkContext.broadcast(model.state())
    out = ready.df().mapInArrow(_scored(shared, c.end), "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(real_id("id").alias("id"), "held_out", "n_tokens", "n_known", F.lit(c.total).cast("long").alias("train_tokens"), "base_score", "score")


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: base and model scores of every document."""
    return score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
