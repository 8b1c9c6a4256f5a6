"""The knowledge graph from entity and relation tables, and the ontology that it implies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.terms import LABEL, OWL, RDF_TYPE, RDFS, TRIPLES, XSD, Namespaces, triple, union
from quillgraph.functions.text import CLASS_PARENTS, class_of, strip
from quillgraph.operators.stage import cut, dealt

#: Shares in which the rows of one text are counted first, so that no task reads all of a hub's.
SHARES = 16


def most_common(rows: DataFrame, keys: list[str], value: str, pos: str) -> DataFrame:
    """keys, value: the most frequent value of each key, the one seen first among equals."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("__n"), F.min(pos).alias("__pos"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("__n", -F.col("__pos"))).alias(value))


def confident(c: str, threshold: float) -> Column:
    """Null and NaN confidences count as 0."""
    return F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)) >= threshold


def numbered(rows: DataFrame) -> DataFrame:
    """With ``pos``, the order of rows."""
    return rows if "pos" in rows.columns else rows.withColumn("pos", F.monotonically_increasing_id())


def combine(relations: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """pos, times and the five texts of relations, and ``sure``: rows of equal texts that are sure or not alike are one.

    ``pos`` is the first one's.  The table is written, so its readers share one pass over the relations; a combined
    table stays as it is.
    """
    if "times" in relations.columns:
        return relations
    texts = ["subject", "subject_type", "predicate", "object", "object_type"]
    rows = numbered(relations).select("pos", *texts, confident("confidence", min_confidence).alias("sure"))
    groups = dealt(rows, "subject", "predicate", "object").groupBy(*texts, "sure")
    return cut(groups.agg(F.min("pos").alias("pos"), F.count("*").alias("times")), "relations")


def clean_relations(relations: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """pos, times, s, s_type, p, o, o_type and ``kept``: enough confidence and no empty part.

    A row of a combined table is as sure as it was when combined.
    """
    part = lambda c: F.coalesce(strip(c), F.lit(""))
    rows = numbered(relations)
    if "times" not in rows.columns:
        rows = rows.withColumns({"times": F.lit(1).cast("long"), "sure": confident("confidence", min_confidence)})
    parts = rows.select("pos", "times", part("subject").alias("s"), part("subject_type").alias("s_type"), part("predicate").alias("p"), part("object").alias("o"), part("object_type").alias("o_type"), "sure")
    return parts.withColumn("kept", F.col("sure") & (F.col("s") != "") & (F.col("p") != "") & (F.col("o") != "")).drop("sure")


def entity_meta(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """text, label, mentions, classes: every entity of either table.

    An entity row is named by its normalised form, or else by its text; a row with neither goes.  A null or
    zero count is one mention; entities known from relations alone, confident or not, have none.  The label
    is the most common text, of equals the first seen, entity rows before relations.  An entity has the
    classes of all its types, ``Thing`` only where no row names a type or a type has no class of its own.
    """
    clean = lambda c: F.coalesce(strip(c), F.lit(""))
    rows = numbered(entities)
    plain = clean("entity_text") if "entity_text" in entities.columns else F.lit("")
    one = F.lit(1).cast("long").alias("times")
    named = rows.select(F.coalesce(F.nullif(clean("entity_normalized"), F.lit("")), plain).alias("text"), plain.alias("plain"), clean("entity_type").alias("type"), F.col("mention_count").cast("long").alias("n"), "pos")
    named = named.select("text", F.coalesce(F.nullif("plain", F.lit("")), "text").alias("label"), "type", F.coalesce(F.nullif("n", F.lit(0)), F.lit(1)).alias("n"), one, F.lit(0).alias("table"), "pos", F.lit(0).alias("side"))
    ends = F.array(*(F.struct(F.col(c).alias("text"), F.col(f"{c}_type").alias("type"), F.lit(i).alias("side")) for i, c in enumerate(("s", "o"))))
    ends = relations.select("pos", "times", F.explode(ends).alias("end"))
    ends = ends.select(F.col("end.text").alias("text"), F.col("end.text").alias("label"), F.col("end.type").alias("type"), F.lit(0).cast("long").alias("n"), "times", F.lit(1).alias("table"), "pos", F.col("end.side").alias("side"))
    every = named.unionByName(ends).where("text <> ''").withColumn("__s", F.pmod(F.xxhash64("pos"), F.lit(SHARES)))
    # plain sums and minima first, which take a fixed room per group
    facts = dealt(every, "text", "__s").groupBy("text", "label", "type", "table", "side", "__s").agg(F.sum("times").alias("times"), F.min("pos").alias("pos"), F.sum("n").alias("n"))
    by_label = dealt(facts, "text").groupBy("text", "label").agg(F.sum("times").alias("times"), F.min(F.struct("table", "pos", "side")).alias("at"), F.sum("n").alias("n"), F.collect_set(F.when(F.col("type") != "", class_of("type"))).alias("classes"))
    order = F.struct("times", (-F.col("at.table")).alias("t"), (-F.col("at.pos")).alias("p"), (-F.col("at.side")).alias("s"))
    meta = by_label.groupBy("text").agg(F.max_by("label", order).alias("label"), F.sum("n").alias("mentions"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("classes")))).alias("classes"))
    return meta.withColumn("classes", F.when(F.size("classes") == 0, F.array(F.lit("Thing"))).otherwise(F.col("classes")))


def kb_triples(entities: DataFrame, relations: DataFrame, ns: Namespaces = Namespaces(), min_confidence: float = 0.5) -> DataFrame:  # noqa: B008
    """The graph: label, mention count, individual and classes of every entity, and confident relations."""
    rel = clean_relations(combine(relations, min_confidence), min_confidence)
    meta = entity_meta(entities, rel)
    kept = rel.where("kept")
    named = meta.select(ns.entity("text").alias("s"), "label", "mentions", "classes")
    fact = lambda *x: F.struct(*triple(F.col("s"), *x))
    own = F.array(fact(LABEL, F.col("label"), "literal"), fact(ns.base + "ontology/mentionCount", F.col("mentions"), "literal", XSD + "integer"), fact(RDF_TYPE, F.lit(OWL + "NamedIndividual")))
    return union(
        named.select(F.explode(F.concat(own, F.transform("classes", lambda c: fact(RDF_TYPE, ns.cls(c))))).alias("t")).select("t.*"),
        kept.select(*triple(ns.entity("s"), ns.prop("p"), ns.entity("o"))),
    )


def first_seen(relations: DataFrame) -> DataFrame:
    """pos, p, domain, range: of kept relations that agree in the texts of their parts the first, with its classes."""
    first = relations.where("kept").groupBy("s", "p", "o").agg(F.min(F.struct("pos", "s_type", "o_type")).alias("row"))
    return first.select(F.col("row.pos").alias("pos"), "p", class_of("row.s_type").alias("domain"), class_of("row.o_type").alias("range"))


def domain_range(relations: DataFrame, ns: Namespaces = Namespaces()) -> DataFrame:  # noqa: B008
    """predicate, property, domain, range: most common classes of the two sides, each triple of texts once."""
    rows = first_seen(relations)
    both = most_common(rows, ["p"], "domain", "pos").join(most_common(rows, ["p"], "range", "pos"), "p")
    return both.select(F.col("p").alias("predicate"), ns.prop("p").alias("property"), "domain", "range")


def ontology_shell(spark: SparkSession, ns: Namespaces = Namespaces()) -> DataFrame:  # noqa: B008
    rows = []
    for name, parent in CLASS_PARENTS.items():
        me = f"{ns.base}ontology/{name}"
        rows += [(me, "iri", RDF_TYPE, OWL + "Class", "iri", None, None), (me, "iri", LABEL, name, "literal", None, None)]
        if parent:
            rows.append((me, "iri", RDFS + "subClassOf", f"{ns.base}ontology/{parent}", "iri", None, None))
    return spark.createDataFrame(rows, TRIPLES)


def ontology(relations: DataFrame, ns: Namespaces = Namespaces()) -> DataFrame:  # noqa: B008
    """The shell and, per predicate, its property's type, label (the predicate's text), domain and range unless ``Thing``."""
    props = domain_range(relations, ns)
    p = F.col("property")
    return union(
        ontology_shell(relations.sparkSession, ns),
        props.select(*triple(p, RDF_TYPE, F.lit(OWL + "ObjectProperty"))),
        props.select(*triple(p, LABEL, F.col("predicate"), "literal")),
        props.where("domain <> 'Thing'").select(*triple(p, RDFS + "domain", ns.cls("domain"))),
        props.where("range <> 'Thing'").select(*triple(p, RDFS + "range", ns.cls("range"))),
    )


def kb_stats(graph: DataFrame, meta: DataFrame, relations: DataFrame) -> DataFrame:
    """One row: triples, entities, distinct properties of kept relations, kept relations, filtered ones."""
    text_key = relations.where("kept").select("s", "p", "o").distinct().agg(F.count("*").alias("relations_kept"), F.countDistinct(Namespaces().prop("p")).alias("relations"))
    dropped = relations.agg(F.coalesce(F.sum(F.when(~F.col("kept"), F.col("times"))), F.lit(0).cast("long")).alias("relations_filtered"))
    return graph.agg(F.count("*").alias("triples")).join(meta.agg(F.count("*").alias("entities"))).join(text_key).join(dropped)
