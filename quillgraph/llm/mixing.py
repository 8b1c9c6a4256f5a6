"""Mixing sources to target weights by hash-threshold histograms, without a sort of the documents.

Every document has a fixed 60-bit hash.  For a budget of words, a source's documents whose hash is below
a threshold are taken.  The threshold comes from histograms: words are summed by source and by the top 12
bits; running sums over at most 4,096 buckets find the bucket in which the budget ends; only documents of
that boundary bucket are summed again by their next 12 bits, and so on, until the boundary holds one
document (or one hash).  It is taken if that comes nearer to the budget.  Several budgets of a source
give nested thresholds, and so nested samples.  All documents are then filtered in one pass.

Sizes are words; null and empty texts have none, very long ones count whole.  A null source is a source of
its own, last in order.  Documents that agree in id and text, repeated rows or ties, share a hash, so they are
taken together.  An empty table gives an empty result, and extra columns are carried whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import Table, table, word_count

HASH_BITS, LEVEL_BITS = 60, 12
#: Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)
#: Times that a document may be taken.
MOST = 3


def source_key(source: Column) -> Column:
    """Never null; orders by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def document_hash(id_col: Column, text: Column) -> Column:
    digest = F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source key, size and hash: all that mixing needs of a document."""
    text = F.col(text_col).cast("string")
    return df.select(F.col(id_col).cast("long").alias("id"), source_key(F.col(source_col)).alias("skey"), word_count(text).alias("size"), document_hash(F.col(id_col), text).alias("h"))


def _placed(by_source: DataFrame) -> Table:
    """skey, source_size, place (from 0 in order of skey): places within ranges, after the ranges before; no task sorts all."""
    ranged = by_source.repartitionByRange("skey").sortWithinPartitions("skey")
    parts = Table(ranged.select("skey", "source_size", F.spark_partition_id().alias("part"), (F.monotonically_increasing_id() % (1 << 33)).alias("at")), "mix-ranges")
    sizes = parts.df().groupBy("part").agg(F.count("*").alias("n"))  # a row per range
    before = Table(sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")), "mix-before")
    return Table(parts.df().join(before.small(), "part").select("skey", "source_size", (F.col("before") + F.col("at")).alias("place")), "mix-placed")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """skey, source_size, target: shares by weight of all words, none above ``most`` times its source.

    What is above is reshared by weight until nothing is: each round sums the caps and weights of the sources
    that the share of a weight reaches, which only grow, and ends when they are the same as before.  Sources
    may be many (hosts): every step is a sum combined before the shuffle.
    """
    placed = _placed(sizes.groupBy("skey").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    weighed = Table(placed.df().select("skey", "source_size", weight.alias("w"), (F.col("source_size") * most).alias("cap")), "mix-weighed")
    words, parts = (int(x or 0) for x in weighed.df().agg(F.sum("source_size"), F.sum("w")).first())
    all_words, all_parts = words, parts
    wide = lambda c: c.cast("decimal(38,0)")
    while True:
        capped = wide(F.lit(words)) * F.col("w") >= wide(F.col("cap")) * F.lit(parts)
        row = weighed.df().where(capped).agg(F.sum("cap"), F.sum("w")).first()
        left = all_words - int(row[0] or 0), all_parts - int(row[1] or 0)
        if left == (words, parts):
            break
        words, parts = left
    share = (F.lit(words) * F.col("w")).cast("double") / F.lit(float(parts or 1))
    return weighed.df().select("skey", "source_size", F.when(capped, F.col("cap").cast("double")).otherwise(share).alias("target"))


def thresholds(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """skey, budget_no, full, low, high, boundary.

    ``budgets`` has skey, budget_no, budget (double).  Documents with a hash below ``low`` are taken, those
    from ``low`` to below ``high`` if ``boundary``; ``full`` says that the budget takes the whole source.
    """
    state = Table(
        budgets.select("skey", "budget_no", F.col("budget").alias("left"), F.lit(0).cast("long").alias("prefix"), F.lit(0).alias("bits"), F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("words"), F.lit(True).alias("open"), F.lit(False).alias("full")),
        "mix-state",
    )
    by_budget = Window.partitionBy("skey", "budget_no").orderBy("bucket")
    for level in range(HASH_BITS // LEVEL_BITS):
        above, below = HASH_BITS - LEVEL_BITS * level, HASH_BITS - LEVEL_BITS * (level + 1)
        refined = state.df().where("open")
        inside = sizes.join(state.small().where("open").select("skey", "budget_no", "prefix"), "skey").where(F.shiftright("h", above) == F.col("prefix"))
        histogram = inside.groupBy("skey", "budget_no", F.shiftright("h", below).alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
        running = histogram.withColumn("upto", F.sum("words").over(by_budget))
        ends = (
            running.join(refined.select("skey", "budget_no", "left"), ["skey", "budget_no"])
            .where(F.col("upto") > F.col("left"))
            .groupBy("skey", "budget_no")
            .agg(F.min(F.struct("bucket", "upto", "words", "rows")).alias("end"))
        )
        moved = refined.select("skey", "budget_no", "left").join(ends, ["skey", "budget_no"], "left").select(
            "skey", "budget_no",
            F.when(F.col("end").isNotNull(), F.col("left") - (F.col("end.upto") - F.col("end.words"))).otherwise(F.col("left")).alias("left"),
            F.coalesce("end.bucket", F.lit(0)).cast("long").alias("prefix"),
            F.lit(HASH_BITS - below).alias("bits"),
            F.coalesce("end.rows", F.lit(0)).cast("long").alias("rows"),
            F.coalesce("end.words", F.lit(0)).cast("long").alias("words"),
            (F.col("end.rows") > 1).alias("open"),
            F.col("end").isNull().alias("full"),
        ).withColumn("open", F.coalesce("open", F.lit(False)))
        done = state.df().where("not open")
        state = Table(done.unionByName(moved), f"mix-state{level}")
        if state.df().where("open").isEmpty():
            break
    low = F.expr(f"shiftleft(prefix, {HASH_BITS} - bits)")
    return state.df().select("skey", "budget_no", "full", low.alias("low"), (low + F.expr(f"shiftleft(1L, {HASH_BITS} - bits)")).alias("high"), (2 * F.col("left") >= F.col("words")).alias("boundary"))


def _plan(sizes: DataFrame, weights: tuple[int, ...]) -> Table:
    """Per source: target, whole copies, and the thresholds of the remainder; one row per source."""
    goal = Table(targets(sizes, weights), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST))).otherwise(F.lit(0)).cast("long")
    plan = goal.df().withColumn("whole", whole)
    cut = thresholds(sizes, plan.select("skey", F.lit(0).alias("budget_no"), (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget")))
    return Table(plan.join(cut, "skey"), "mix-plan")


def _copies(h: str, plan: str = "") -> Column:
    at = lambda c: F.col(plan + c)
    once = F.when(at("full") | (F.col(h) < at("low")) | ((F.col(h) < at("high")) & at("boundary")), 1).otherwise(0)
    return F.least(at("whole") + once, F.lit(MOST)).cast("int")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """id, skey, size, source_size, target, h, copies: how often the mix takes each document."""
    sizes = Table(measured(df, id_col, text_col, source_col), "mix-sizes")
    plan = _plan(sizes.df(), weights)
    return sizes.df().join(plan.small(), "skey").select("id", "skey", "size", "source_size", "target", "h", _copies("h").alias("copies"))


def take(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix itself: the input's rows, each as often as it is taken, none where it isn't.

    Thresholds are found on the narrow table; the rows themselves are filtered in place and never move.
    """
    sizes = Table(measured(df, id_col, text_col, source_col), "mix-sizes")
    plan = _plan(sizes.df(), weights).small().select(F.struct("*").alias("__plan"), F.col("skey").alias("__skey"))
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__row"), source_key(F.col(source_col)).alias("__skey"), document_hash(F.col(id_col), F.col(text_col).cast("string")).alias("__h"))
    taken = rows.join(plan, "__skey").withColumn("__n", _copies("__h", "__plan.")).where("__n > 0")
    return taken.select("__row", F.explode(F.sequence(F.lit(1), F.col("__n")))).select("__row.*")


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: one row per document with the words that the mix takes of it."""
    return mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP4_SQL = r"""
WITH docs AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
sources AS (
  SELECT skey, sum(size)::HUGEINT AS s, [1, 2, 3][((row_number() OVER (ORDER BY skey) - 1) % 3 + 1)::INT]::HUGEINT AS w
  FROM docs GROUP BY skey),
filled AS (
  SELECT *, 3 * s AS cap,
         sum(s) OVER () - coalesce(sum(3 * s) OVER (ORDER BY 3 * s::DOUBLE / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_words,
         sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY 3 * s::DOUBLE / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_w
  FROM sources),
capped AS (SELECT *, rest_words * w >= cap * rest_w AS capped FROM filled),
goals AS (
  SELECT skey, s, CASE WHEN capped THEN cap::DOUBLE ELSE
    ((sum(s) OVER () - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0)) * w)::DOUBLE / (sum(CASE WHEN NOT capped THEN w END) OVER ())::DOUBLE END AS target
  FROM capped),
plan AS (
  SELECT *, CASE WHEN s > 0 THEN least(floor(target / s), 3) ELSE 0 END AS whole FROM goals),
run AS (
  SELECT d.*, p.s, p.target, p.whole, p.target - p.whole * p.s AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.skey ORDER BY d.h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM docs d JOIN plan p USING (skey))
SELECT doc_id, size, s::BIGINT AS source_size, target,
       (size * least(whole + CASE WHEN budget >= before AND 2 * (budget - before) >= size THEN 1 ELSE 0 END, 3))::BIGINT AS taken
FROM run
"""
