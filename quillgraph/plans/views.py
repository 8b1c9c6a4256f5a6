"""Graph tables made from relational ones, and their SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.terms import COLUMNS, LABEL, RDF_TYPE, triple
from quillgraph.functions.text import TYPE_TO_CLASS
from quillgraph.operators.stage import dealt, part_count

BASE = "http://example.org/kg/"
E, P, C = BASE + "entity/", BASE + "property/", BASE + "ontology/"

#: table -> (entity folder, key, class, label column)
NODES = {
    "region": ("region", "r_regionkey", "Region", "r_name"),
    "nation": ("nation", "n_nationkey", "Nation", "n_name"),
    "customer": ("customer", "c_custkey", "Customer", "c_name"),
    "supplier": ("supplier", "s_suppkey", "Supplier", "s_name"),
    "part": ("part", "p_partkey", "Part", "p_name"),
    "orders": ("order", "o_orderkey", "Order", None),
}
#: table, subject (folder, key), property, object (folder, key), whether pairs repeat
EDGES = (
    ("nation", ("nation", "n_nationkey"), "partOf", ("region", "n_regionkey"), False),
    ("customer", ("customer", "c_custkey"), "locatedIn", ("nation", "c_nationkey"), False),
    ("supplier", ("supplier", "s_suppkey"), "locatedIn", ("nation", "s_nationkey"), False),
    ("orders", ("order", "o_orderkey"), "placedBy", ("customer", "o_custkey"), False),
    ("lineitem", ("order", "l_orderkey"), "contains", ("part", "l_partkey"), True),
    ("lineitem", ("supplier", "l_suppkey"), "supplies", ("part", "l_partkey"), True),
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node(folder: str, key: str):
    return F.concat(F.lit(f"{E}{folder}/"), F.col(key).cast("string"))


def triple_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relational tables as triples: edges, types and labels."""
    out = None
    for table, s, p, o, repeats in EDGES:
        df = read(spark, sf_dir, table).select(s[1], o[1])
        df = (dealt(df, s[1], o[1]).distinct() if repeats else df).select(*triple(node(*s), P + p, node(*o)))
        out = df if out is None else out.unionByName(df)
    for table, (folder, key, cls, label) in NODES.items():
        df = read(spark, sf_dir, table)
        out = out.unionByName(df.select(*triple(node(folder, key), RDF_TYPE, F.lit(C + cls))))
        if label:
            out = out.unionByName(df.select(*triple(node(folder, key), LABEL, F.col(label), "literal")))
    return out.select(*COLUMNS)


def edge_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """h, r, t: the triples between entities."""
    return triple_view(spark, sf_dir).where((F.col("o_kind") == "iri") & (F.col("p") != RDF_TYPE)).select(F.col("s").alias("h"), F.col("p").alias("r"), F.col("o").alias("t"))


def _triples_sql() -> str:
    parts = []
    for table, s, p, o, repeats in EDGES:
        parts.append(f"SELECT {'DISTINCT ' * repeats}'{E}{s[0]}/' || {s[1]} AS s, '{P}{p}' AS p, '{E}{o[0]}/' || {o[1]} AS o, 'iri' AS k FROM {table}")
    for table, (folder, key, cls, label) in NODES.items():
        parts.append(f"SELECT '{E}{folder}/' || {key}, '{RDF_TYPE}', '{C}{cls}', 'iri' FROM {table}")
        if label:
            parts.append(f"SELECT '{E}{folder}/' || {key}, '{LABEL}', {label}, 'literal' FROM {table}")
    return " UNION ALL ".join(parts)


#: CTEs: t(s, p, o, k) and e(h, r, t).
T = f"t AS ({_triples_sql()})"
TE = f"{T}, e AS (SELECT s AS h, p AS r, o AS t FROM t WHERE k = 'iri' AND p <> '{RDF_TYPE}')"


#: Odd rows of the entity table: pos, text, normalised form, type, mentions.
ODD_ENTITIES = (
    (30_000_001, "Only Text", "", "ORG", 2),
    (30_000_002, "", "Only Form", "", None),
    (30_000_003, " ", "", "PERSON", 5),
    (30_000_004, "Two Types", "two types", "PERSON", 0),
    (30_000_005, "TWO TYPES", "two types", "ORG", 3),
    (30_000_006, "TWO TYPES", "two types", "", 1),
    (30_000_007, "Odd", "odd kind", "KIND", 1),
)
#: Odd rows of the relation table: pos, subject, its type, predicate, object, its type, confidence.
ODD_RELATIONS = (
    (1, "Only Text", "ORG", "live in", "Oddtown", "GPE", 0.9),
    (2, "Only Text", "PERSON", "live in", "Oddtown", "ORG", 0.9),
    (3, "Only Text", "PERSON", "live in", "Oddtown", "ORG", 0.9),
    (4, "Only Form", "", "know", "two types", "", 0.5),
    (5, "Only Form", "PERSON", "know", "", "", 0.9),
    (6, "Nobody", "PERSON", "know", "two types", "ORG", None),
    (7, "Only Form", "PERSON", " ", "Nobody", "", 0.9),
)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entity table: customers, suppliers and nations with their numbers of mentions, and odd rows."""
    customer, nation, supplier = (read(spark, sf_dir, t) for t in ("customer", "nation", "supplier"))

    def rows(df: DataFrame, key: str, at: int, plain, name: str, kind: str, n) -> DataFrame:
        return df.select((F.col(key) + at).cast("long").alias("pos"), plain.alias("entity_text"), F.col(name).alias("entity_normalized"), F.lit(kind).alias("entity_type"), n.cast("long").alias("mention_count"))

    a = rows(customer, "c_custkey", 0, F.concat(F.lit("The "), "c_name"), "c_name", "PERSON", F.nullif(F.col("c_custkey") % 7, F.lit(3)))
    b = rows(supplier, "s_suppkey", 10_000_000, F.col("s_name"), "s_name", "ORG", F.col("s_suppkey") % 5)
    c = rows(nation, "n_nationkey", 20_000_000, F.lower("n_name"), "n_name", "GPE", F.col("n_nationkey") % 3)
    odd = spark.createDataFrame(list(ODD_ENTITIES), "pos long, entity_text string, entity_normalized string, entity_type string, mention_count long")
    return a.unionByName(b).unionByName(c).unionByName(odd)


def _sql(value: object) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def _values(rows: tuple) -> str:
    return ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows)


#: CTE ents(pos, plain, form, type, n): the entity table.
ENTITIES = f"""ents AS (
  SELECT c_custkey::BIGINT AS pos, 'The ' || c_name AS plain, c_name AS form, 'PERSON' AS type, nullif(c_custkey % 7, 3)::BIGINT AS n FROM customer
  UNION ALL SELECT s_suppkey + 10000000, s_name, s_name, 'ORG', (s_suppkey % 5)::BIGINT FROM supplier
  UNION ALL SELECT n_nationkey + 20000000, lower(n_name), n_name, 'GPE', (n_nationkey % 3)::BIGINT FROM nation
  UNION ALL SELECT * FROM (VALUES {_values(ODD_ENTITIES)}))"""


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relation table: where customers and suppliers are, and what suppliers deliver, with confidences, and odd rows."""
    customer, nation, supplier = (read(spark, sf_dir, t) for t in ("customer", "nation", "supplier"))
    part, line = read(spark, sf_dir, "part"), read(spark, sf_dir, "lineitem")
    lit = F.lit
    a = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select((F.col("c_custkey") + 1_000).alias("pos"), F.col("c_name").alias("subject"), lit("PERSON").alias("subject_type"), lit("live_in").alias("predicate"), F.col("n_name").alias("object"), lit("GPE").alias("object_type"), ((F.col("c_custkey") % 10) / 10.0).alias("confidence"))
    b = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select((F.col("s_suppkey") + 10_000_000).alias("pos"), F.col("s_name").alias("subject"), lit("ORG").alias("subject_type"), lit("be").alias("predicate"), F.col("n_name").alias("object"), lit("GPE").alias("object_type"), lit(0.85).alias("confidence"))
    sold = line.select("l_suppkey", "l_partkey", "l_discount")
    if part_count(sold):
        # the parts that the pairs are dealt to serve the join with part too, whose rows meet them there
        sold, part = dealt(sold, "l_partkey"), part.hint("shuffle_hash")
    pairs = sold.groupBy("l_suppkey", "l_partkey").agg(F.max("l_discount").alias("d"))
    c = pairs.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select((F.col("l_suppkey") * 1_000_000 + F.col("l_partkey") + 100_000_000).alias("pos"), F.col("s_name").alias("subject"), lit("ORG").alias("subject_type"), lit("supply_to").alias("predicate"), F.col("p_name").alias("object"), lit("PRODUCT").alias("object_type"), (F.col("d") * 10).alias("confidence"))
    odd = spark.createDataFrame(list(ODD_RELATIONS), "pos long, subject string, subject_type string, predicate string, object string, object_type string, confidence double")
    return a.unionByName(b).unionByName(c).unionByName(odd)


def class_sql(x: str) -> str:
    """The class of an entity type."""
    return f"CASE trim({x}) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPE_TO_CLASS.items()) + " ELSE 'Thing' END"


#: CTEs rels(pos, s, st, p, o, ot, conf, property), the trimmed relation table, kept, and first, a row per triple of texts.
RELATIONS = f"""rels0 AS (
  SELECT (c_custkey + 1000)::BIGINT AS pos, c_name AS s, 'PERSON' AS st, 'live_in' AS p, n_name AS o, 'GPE' AS ot, (c_custkey % 10) / 10.0::DOUBLE AS conf FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT s_suppkey + 10000000, s_name, 'ORG', 'be', n_name, 'GPE', 0.85 FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT l_suppkey * 1000000 + l_partkey + 100000000, s_name, 'ORG', 'supply_to', p_name, 'PRODUCT', d * 10
    FROM (SELECT l_suppkey, l_partkey, max(l_discount) AS d FROM lineitem GROUP BY 1, 2) JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
  UNION ALL SELECT * FROM (VALUES {_values(ODD_RELATIONS)})),
rels AS (SELECT pos, trim(s) AS s, trim(st) AS st, trim(p) AS p, trim(o) AS o, trim(ot) AS ot, coalesce(conf, 0) AS conf,
  CASE trim(p) WHEN 'be' THEN 'beRelation' WHEN 'supply_to' THEN 'supplyTo' WHEN 'know' THEN 'know' ELSE 'liveIn' END AS property FROM rels0),
kept AS (SELECT * FROM rels WHERE conf >= 0.5 AND s <> '' AND p <> '' AND o <> ''),
first AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY s, p, o ORDER BY pos) = 1)"""


def slug_sql(x: str) -> str:
    return f"coalesce(nullif(trim(regexp_replace(lower(trim({x})), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'unnamed')"
