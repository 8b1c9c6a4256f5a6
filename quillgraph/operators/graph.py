"""Graph operators over triple tables: expansion, cleaning, components, degrees, samples and splits."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.terms import RDF_TYPE
from quillgraph.functions.text import blocked_predicate
from quillgraph.operators.stage import cut, dealt, part_count, small

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEY = ["h", "r", "t"]


def drop_reason(keep_types: bool = True) -> Column:
    """Why a triple can't be used for embeddings; null if it can.  The first reason in this order counts."""
    reason = (
        F.when(F.col("s_kind") != "iri", "non_uri_subject")
        .when(F.col("p").isNull() | ~F.col("p").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), "non_uri_predicate")
        .when(F.col("o_kind") == "literal", "literal_object")
        .when(F.col("o_kind") != "iri", "non_uri_object")
        .when(blocked_predicate("p"), "blocked_predicate")
    )
    return reason if keep_types else reason.when(F.col("p") == RDF_TYPE, "rdf_type")


def clean(triples: DataFrame, keep_types: bool = True) -> DataFrame:
    """h, r, t of the usable triples, each once."""
    kept = triples.where(drop_reason(keep_types).isNull())
    return kept.select(F.col("s").alias("h"), F.col("p").alias("r"), F.col("o").alias("t")).transform(dealt, *KEY).distinct()


def drop_histogram(triples: DataFrame, keep_types: bool = True) -> DataFrame:
    """reason, n: only reasons that occur."""
    return triples.select(drop_reason(keep_types).alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


#: Nodes that a query service is asked about at once.
BATCH = 50


def by_provider(provider: Callable[[list[str], int], list[tuple[str, str, str]]], per_node: int = 250, batch: int = BATCH, delay: float = 0.0) -> Callable[[DataFrame], DataFrame]:
    """A backing for ``expand`` by a query service: ``provider`` takes nodes and a limit for each and gives triples.

    Nodes are asked about in batches of ``batch``; a task waits ``delay`` seconds after each answer.
    """

    def hop(frontier: DataFrame) -> DataFrame:
        def run(batches: Iterator) -> Iterator:
            import time

            import pandas as pd

            for rows in batches:
                nodes = rows["node"].tolist()
                for i in range(0, len(nodes), batch):
                    yield pd.DataFrame(provider(nodes[i : i + batch], per_node), columns=KEY)
                    time.sleep(delay)

        return frontier.mapInPandas(run, "h string, r string, t string").join(frontier.select(F.col("node").alias("h")), "h", "left_semi").select(*KEY)

    return hop


def expand(graph: DataFrame, backing: DataFrame | Callable[[DataFrame], DataFrame], seeds: DataFrame, depth: int = 2, target: int | None = 50_000, per_node: int | None = 250, predicates: str = "", objects: str = "") -> tuple[DataFrame, DataFrame]:
    """Breadth-first expansion from seeds (column node) along a backing table (h, r, t), or what ``by_provider`` makes.

    Each level joins the frontier with the backing table, or asks for its triples, keeps at most ``per_node`` triples a node (in the
    order of r and t), drops those already there, and stops at ``target`` triples in all.  Only backing triples
    whose predicate and object start with the given prefixes are asked for.  Returns the grown
    graph and one row a level: level, frontier, added, total.  The frontier is broadcast only if it is
    small; levels are cut by written tables.
    """
    spark = graph.sparkSession
    wanted = F.startswith("r", F.lit(predicates)) & F.startswith("t", F.lit(objects))
    total = cut(graph.select(*KEY).distinct(), "expand")
    frontier = cut(seeds.select("node").distinct(), "frontier")
    seen, stats, n = frontier, [], total.count()
    for level in range(1, depth + 1):
        asked = frontier.count()
        if not asked or target is not None and n >= target:
            break
        hop = cut(backing(frontier).where(wanted), "asked") if callable(backing) else backing.select(*KEY).where(wanted).join(small(frontier), F.col("h") == F.col("node")).select(*KEY)
        if per_node is not None:
            # a hub's triples are ranked in shares first, so that no task sorts them all
            hop = dealt(hop.withColumn("__s", F.pmod(F.xxhash64("r", "t"), F.lit(64))), "h", "__s")
            for keys in (["h", "__s"], ["h"]):
                hop = hop.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("r", "t"))).where(F.col("__n") <= per_node).drop("__n")
            hop = hop.drop("__s")
        new = dealt(hop, *KEY).distinct().join(total, KEY, "left_anti")
        if target is not None:
            new = new.orderBy(*KEY).limit(target - n)
        new = cut(new, "hop")
        added = new.count()
        stats.append((level, asked, added, n + added))
        n += added
        frontier = cut(new.select(F.col("t").alias("node")).distinct().join(seen, "node", "left_anti"), "frontier")
        seen = cut(seen.unionByName(frontier), "seen")
        total = cut(total.unionByName(new), "expand")
    return total, spark.createDataFrame(stats, "level int, frontier long, added long, total long")


#: Rows of edges from which on a quarter of them is contracted first.
SAMPLED_ROWS = 2_000_000
#: Bits of the map of nodes outside the sample's largest component, as a power of two, at most.
MAP_BITS = 29


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node of each undirected component; edges has a, b of any orderable type.

    Nodes go by 64-bit hashes, taken anew should two of them ever agree.  Of many edges a quarter, by their hash, is
    contracted first.  Most of the others then lie within its largest component: a map of bits tells the nodes that
    may be outside, and only edges with such an end are relabelled and contracted with what is left.
    """
    return _components(cut(edges.select("a", "b"), "links"))


def _components(links: DataFrame) -> DataFrame:
    """``components`` of a written table."""
    ends = dealt(links.select(F.explode(F.array("a", "b")).alias("node")).where("node is not null"), "node").distinct()
    salt = 0
    while True:
        nodes = cut(ends.select("node", F.xxhash64(F.lit(salt), "node").alias("id")), "nodes")
        if nodes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            break
        salt += 1
    pairs = links.where("a <> b").select(F.xxhash64(F.lit(salt), "a").alias("x"), F.xxhash64(F.lit(salt), "b").alias("y"))
    if links.count() < SAMPLED_ROWS:
        labels = nodes.join(_contracted(pairs), "id", "left").select("node", F.coalesce("to", "id").alias("label"))
    else:
        some = _contracted(pairs.where(F.pmod(F.xxhash64("x", "y"), F.lit(4)) == 0))
        top = some.groupBy("to").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "to").limit(1).collect()
        top = F.lit(top[0].to if top else 0)
        outside = cut(nodes.select("id").join(some, "id", "left").where(F.col("to").isNull() | (F.col("to") != top)).select("id", F.coalesce("to", "id").alias("to")), "outside")
        left = _touching(pairs, outside)
        for c in ("x", "y"):
            left = left.join(outside.withColumnRenamed("id", c), c, "left").withColumn(c, F.coalesce("to", top)).drop("to")
        rest = _contracted(dealt(left.where("x <> y"), "x", "y").distinct()).withColumnsRenamed({"id": "at", "to": "root"})
        labels = nodes.join(outside, "id", "left").select("node", F.coalesce("to", top).alias("at")).join(small(rest), "at", "left").select("node", F.coalesce("root", "at").alias("label"))
    labels = cut(labels, "labels")
    lowest = cut(dealt(labels, "node").groupBy("label").agg(F.min("node").alias("component")), "lowest")
    return labels.join(small(lowest), "label").select("node", "component")


def _contracted(pairs: DataFrame) -> DataFrame:
    """id, to: a node of the component of each node; pairs has x, y, hashes of nodes.

    Rounds of contraction: every node takes the first of its neighbours and itself, in an order of the turned bits that
    changes with the round, then twice what the node taken took.  Edges are relabelled and loops dropped, until none
    is left; a node's label is followed through the rounds.  In expectation the nodes left shrink by a constant factor
    a round, whatever the shape and the numbering.
    """
    left = cut(pairs.where("x <> y").select("x", "y"), "edges")
    labels, round_ = left.select(F.col("x").alias("id"), F.col("y").alias("to")).limit(0), 0
    while not left.isEmpty():
        round_ += 1
        turned = lambda c, n: F.shiftleft(c, n % 64).bitwiseOR(F.shiftrightunsigned(c, -n % 64))
        both = left.select(F.col("x").alias("id"), F.col("y").alias("other")).unionByName(left.select(F.col("y").alias("id"), F.col("x").alias("other")))
        first = dealt(both, "id").groupBy("id").agg(F.min(turned("other", 13 * round_)).alias("low"))
        step = cut(first.select("id", turned(F.least("low", turned("id", 13 * round_)), -13 * round_).alias("to")), "step")
        for _ in range(2):
            step = cut(step.join(step.select(F.col("id").alias("to"), F.col("to").alias("next")), "to").select("id", F.col("next").alias("to")), "jump")
        labels = step if round_ == 1 else cut(labels.join(step.select(F.col("id").alias("to"), F.col("to").alias("next")), "to", "left").select("id", F.coalesce("next", "to").alias("to")), "labels")
        for c in ("x", "y"):
            left = left.join(step.withColumnRenamed("id", c), c).drop(c).withColumnRenamed("to", c)
        left = cut(dealt(left.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")), "x", "y").distinct(), "edges")
    return labels


def _touching(pairs: DataFrame, outside: DataFrame) -> DataFrame:
    """Pairs with an end that may be outside: all that have one, and few others, told by a map of the hashes' first bits."""
    bits = min(MAP_BITS, max(3, (8 * outside.count()).bit_length()))
    part = min(20, bits)

    def marked(key: tuple, rows: pa.Table) -> pa.Table:
        bit = np.zeros(1 << part, np.uint8)
        bit[rows.column("slot").to_numpy() & ((1 << part) - 1)] = 1
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bit).tobytes()], pa.binary())})

    slots = outside.select(F.shiftrightunsigned("id", 64 - bits).alias("slot")).withColumn("part", F.shiftright("slot", part))
    found = slots.groupBy("part").applyInArrow(marked, "part long, bits binary").collect()  # 64 MiB at most
    size = 1 << part >> 3
    table = np.zeros(size << bits - part, np.uint8)
    for x in found:
        table[x.part * size : (x.part + 1) * size] = np.frombuffer(bytes(x.bits), np.uint8)
    shared = pairs.sparkSession.sparkContext.broadcast(table)

    def kept(batches: Iterator) -> Iterator:
        table = shared.value

        def may(column: pa.Array) -> np.ndarray:
            slot = column.to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            return table[slot >> np.uint64(3)] >> (7 - (slot & np.uint64(7))).astype(np.uint8) & 1

        for rows in batches:
            yield rows.filter(pa.array((may(rows.column(0)) | may(rows.column(1))).astype(bool)))

    return pairs.mapInArrow(kept, "x long, y long")


def largest_component(labels: DataFrame) -> DataFrame:
    """node: those of the largest component, of equals the one with the smallest node."""
    sizes = labels.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return labels.join(F.broadcast(sizes), "component").select("node")


def keep_component(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """Triples with both ends among the nodes."""
    ends = lambda c: nodes.select(F.col("node").alias(c))
    return triples.join(ends("h"), "h", "left_semi").join(ends("t"), "t", "left_semi").select(*KEY)


def within_largest(triples: DataFrame) -> DataFrame:
    """Triples of the largest component, told by its nodes or, where these are fewer, by all others.

    Both ends of a triple are in one component, so that of the head decides.
    """
    rows = cut(triples.select(*KEY), "triples")
    labels = cut(_components(rows.select(F.col("h").alias("a"), F.col("t").alias("b"))), "components")
    sizes = labels.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1).collect()
    if not sizes:
        return rows.limit(0)
    inside, most = F.col("component") == F.lit(sizes[0].component), 2 * sizes[0].n > labels.count()
    heads = cut(labels.where(~inside if most else inside).select(F.col("node").alias("h")), "heads")
    return rows.where("h is not null and t is not null").join(small(heads), "h", "left_anti" if most else "left_semi").select(*KEY)


def degrees(triples: DataFrame) -> DataFrame:
    """node, degree: occurrences as head or tail."""
    return dealt(triples.select(F.explode(F.array("h", "t")).alias("node")), "node").groupBy("node").agg(F.count("*").alias("degree"))


def counts(triples: DataFrame) -> DataFrame:
    """One row: triples, entities, relations."""
    ends = triples.select(F.explode(F.array("h", "t")).alias("e")).agg(F.countDistinct("e").alias("entities"))
    return triples.agg(F.count("*").alias("triples"), F.countDistinct("r").alias("relations")).join(ends).select("triples", "entities", "relations")


def merge_splits(*parts: DataFrame) -> DataFrame:
    """h, r, t, split: given splits (the first train, then valid and test) as one, a triple where it comes first."""
    names = ["train", "valid", "test"]
    every = None
    for i, part in enumerate(parts):
        rows = part.select(*KEY, F.lit(i).alias("i"))
        every = rows if every is None else every.unionByName(rows)
    first = every.groupBy(*KEY).agg(F.min("i").alias("i"))
    return first.select(*KEY, F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1).alias("split"))


def seeded_order(seed: int, *columns: str) -> Column:
    """A fixed shuffle: MD5 of seed and columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *columns))


def sample(triples: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n triples without replacement, the same ones for a seed; all if n is 0 or too large."""
    return triples if n <= 0 else triples.orderBy(seeded_order(seed, *KEY), *KEY).limit(n)


#: Share of the hashed order, in multiples of what valid and test take, that is looked at first for their places.
FIRST_LOOK = 1.75


def split(triples: DataFrame, train: float = 0.8, valid: float = 0.1, test: float = 0.1, seed: int = 42, each_once: bool = False) -> DataFrame:
    """h, r, t, split with every entity and relation of valid and test also in train.

    The first triple, in seeded order, of every entity and of every relation stays in train (its anchor).
    Of the others a triple's place in the seeded order decides: two places bound valid and test, and what comes after
    them is train, anchor or not.  So anchors are only sought among the first triples of the order, which hold the
    first of all entities that matter, and nothing else is shuffled.  ``each_once`` says that no triple occurs twice.
    """
    if abs(train + valid + test - 1) > 1e-6:
        raise ValueError("the ratios must sum to 1")
    rows = triples.select(*KEY)
    rows = cut(rows if each_once else dealt(rows, *KEY).distinct(), "split")
    n = rows.count()
    valids, wanted = math.floor(n * valid), math.floor(n * valid) + math.floor(n * test)
    named = lambda df, name: df.select(*KEY, F.lit(name).alias("split"))
    if not wanted:
        return named(rows, "train")
    order = seeded_order(seed, *KEY)
    keyed = rows.withColumn("md5", order).withColumn("k", F.unhex("md5"))
    bucket = F.substring(F.hex("k"), 1, 4)
    share = FIRST_LOOK * (valid + test)
    while True:
        low = keyed if share >= 1 else keyed.where(F.col("md5") < f"{int(share * (1 << 32)):08x}")
        anchors = cut(_anchors(low), "anchors")
        sizes = low.select(bucket.alias("bucket"), F.lit(1).alias("n")).unionByName(anchors.select(bucket.alias("bucket"), F.lit(-1).alias("n")))
        sizes = sorted((x.bucket, x.n) for x in sizes.groupBy("bucket").agg(F.sum("n").alias("n")).collect())  # at most 65,536 rows
        if share >= 1 or sum(x for _, x in sizes) >= wanted:
            break
        share *= 2
    # the bucket that holds a place, and the place within it
    at, before = {}, 0
    for name, c in sizes:
        at |= {place: (name, place - before) for place in {valids, wanted} if before < place <= before + c}
        before += c
    near = cut(low.where(bucket.isin(sorted({b for b, _ in at.values()}))).select("k").join(anchors, "k", "left_anti"), "places") if at else None
    # the last key up to a place; past all triples that are no anchors it is the greatest key
    last = lambda place: b"" if not place else bytes(near.where(bucket == at[place][0]).orderBy("k").limit(at[place][1]).agg(F.max("k")).first()[0]) if place in at else b"\xff" * 16
    to_valid, to_test = F.lit(bytearray(last(valids))), F.lit(bytearray(last(wanted)))
    first, marks = keyed.where(F.col("k") <= to_test).select(*KEY, "k"), anchors.where(F.col("k") <= to_test).withColumn("anchor", F.lit(True))
    if parts := part_count(rows):
        first, marks = first.repartition(parts, "k"), marks.repartition(parts, "k")
    name = F.when(F.col("anchor"), F.lit("train")).when(F.col("k") <= to_valid, F.lit("valid")).otherwise(F.lit("test"))
    placed = cut(first.join(marks, "k", "left").select(*KEY, name.alias("split")), "split")
    return placed.unionByName(named(keyed.where(F.col("k") > to_test), "train"))


def _anchors(keyed: DataFrame) -> DataFrame:
    """k: the first key of every entity and of every relation, each once."""
    ends = keyed.select(F.explode(F.array("h", "t")).alias("what"), "k")
    first = dealt(ends, "what").groupBy("what").agg(F.min("k").alias("k")).select("k")
    # relations may be few, so their rows aren't dealt: first the least halves of their keys
    half = keyed.select("r", "k", F.conv(F.substring("md5", 1, 15), 16, 10).cast("long").alias("half"))
    least = half.groupBy("r").agg(F.min("half").alias("half"))
    same = F.col("a.r").eqNullSafe(F.col("b.r")) & (F.col("a.half") == F.col("b.half"))
    relations = half.alias("a").join(least.alias("b"), same).groupBy("a.r").agg(F.min("k").alias("k")).select("k")
    return first.unionByName(relations).distinct()


def split_stats(parts: DataFrame) -> DataFrame:
    """split, triples, entities, relations."""
    by = parts.groupBy("split").agg(F.count("*").alias("triples"), F.countDistinct("r").alias("relations"))
    ents = dealt(parts.select("split", F.explode(F.array("h", "t")).alias("e")).where("e is not null"), "split", "e").distinct().groupBy("split").agg(F.count("*").alias("entities"))
    return by.join(ents, "split").select("split", "triples", "entities", "relations")


def numbered(values: DataFrame, column: str) -> DataFrame:
    """column, id: dense numbers in order.

    Ranks within ranges that Spark deals by order, plus the sizes of the ranges before; no single task
    sorts everything.
    """
    n = part_count(values)
    each = dealt(values.select(column), column).distinct()
    ordered = (each.repartitionByRange(n, column) if n else each.repartitionByRange(column)).sortWithinPartitions(column)
    parts = cut(ordered.select(column, F.spark_partition_id().alias("part"), (F.monotonically_increasing_id() % (1 << 33)).alias("at")), "ids")
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return parts.join(F.broadcast(before), "part").select(column, (F.col("before") + F.col("at")).alias("id"))


def entity_ids(train: DataFrame) -> DataFrame:
    return numbered(train.select(F.explode(F.array("h", "t")).alias("label")), "label")


def relation_ids(train: DataFrame) -> DataFrame:
    return numbered(train.select(F.col("r").alias("label")).distinct(), "label")  # few: not dealt row by row


def encode(triples: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """h, r, t as numbers; triples with a label that has none are dropped."""
    e = lambda c: entities.select(F.col("label").alias(c), F.col("id").alias(c + "_id"))
    r = relations.select(F.col("label").alias("r"), F.col("id").alias("r_id"))
    return triples.join(e("h"), "h").join(r, "r").join(e("t"), "t").select(F.col("h_id").alias("h"), F.col("r_id").alias("r"), F.col("t_id").alias("t"))
