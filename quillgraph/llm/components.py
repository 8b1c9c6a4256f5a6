"""Connected components of an edge table by repeated contraction, entirely in tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import Table


def _ranked(node: str, round_: int) -> Column:
    """The node behind a hash that changes with the round: an order that no numbering of the nodes can spoil."""
    return F.struct(F.xxhash64(F.lit(round_), node).alias("rank"), F.col(node).alias("node"))


def components(edges: DataFrame) -> Table:
    """node, label for every node that has an edge; label is one node of its component.

    ``edges`` has a, b (longs).  Each round maps every node to the first node, in the round's own order, of
    those within two edges of it, relabels the edges and drops those that became loops.  A node stays its
    own label only if it comes first within two edges, so in expectation the nodes left shrink by a constant
    factor a round, whatever the shape: stars take one round, a chain of 10,000 in order eight.  Both minima
    are combined before the shuffle, each round's tables are written, so lineage stays short, and joins are
    between written tables, which lets Spark split a hub's rows.
    """
    ordered = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = Table(ordered, "cc-edges")
    labels: Table | None = None
    round_ = 0
    while left.rows() or labels is None:
        round_ += 1
        e = left.df()
        both = e.select(F.col("a").alias("at"), F.col("b").alias("other")).unionByName(e.select(F.col("b").alias("at"), F.col("a").alias("other")))
        first = both.groupBy("at").agg(F.min(_ranked("other", round_)).alias("low")).select(F.col("at").alias("other"), F.least("low", _ranked("at", round_)).alias("low"))
        # every neighbour has seen the node itself, so the minimum over the neighbours is that over two edges
        step = Table(both.join(first, "other").groupBy("at").agg(F.min("low").alias("low")).select("at", F.col("low.node").alias("to")), "cc-step")
        if labels is None:
            new = step.df().select(F.col("at").alias("node"), F.col("to").alias("label"))
        else:
            new = labels.df().join(step.small(), F.col("label") == F.col("at"), "left").select("node", F.coalesce("to", "label").alias("label"))
        labels, old = Table(new, "cc-labels"), labels
        a = e.join(step.small(), F.col("a") == F.col("at")).select(F.col("to").alias("a"), "b")
        ends = a.join(step.small(), F.col("b") == F.col("at")).select("a", F.col("to").alias("b"))
        left, done = Table(ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges"), left
        for t in (done, step, *([old] if old else [])):
            t.drop()
    left.drop()
    return labels
