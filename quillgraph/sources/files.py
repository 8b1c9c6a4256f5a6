"""Text, CSV, JSON and TSV sources and sinks with declared schemas and checked columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.text import qid, strip

DOCUMENTS = "url string, final_url string, status_code long, allowed_by_robots boolean, fetched_at string, title string, author string, date string, hostname string, language string, word_count long, text string, extraction_method string"
ENTITIES = "entity_text string, entity_normalized string, entity_type string, source_url string, mention_count long, example_sentence string"
RELATIONS = "subject string, subject_type string, predicate string, object string, object_type string, source_url string, sentence string, confidence double, method string"
ENTITY_LINKS = "private_entity string, private_uri string, entity_type string, wikidata_id string, wikidata_uri string, wikidata_label string, wikidata_description string, confidence double, matched boolean, match_reason string"
PREDICATE_LINKS = "private_predicate string, private_uri string, wikidata_property string, property_label string, property_description string, confidence double, matched boolean, match_reason string"


def names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def require_columns(df: DataFrame, wanted: list[str], what: str) -> DataFrame:
    missing = sorted(set(wanted) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks columns: {', '.join(missing)}")
    return df


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def read_lines(spark: SparkSession, path: str, required: bool = False) -> DataFrame:
    """value: stripped lines, without blank ones and comments."""
    out = spark.read.text(path).select(strip("value").alias("value")).where((F.col("value") != "") & ~F.col("value").startswith("#"))
    return require_rows(out, path) if required else out


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of crawled documents; blank lines are skipped, an empty file is an error."""
    return require_rows(spark.read.schema(DOCUMENTS).json(path), path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header that must hold the schema's columns, in any order; numbers that don't parse are null."""
    raw = spark.read.csv(path, header=True, escape='"', multiLine=True)
    require_columns(raw, names(schema), path)
    return raw.select(*(F.expr(f"try_cast(`{c}` AS {t})").alias(c) for c, t in (part.split() for part in schema.split(", "))))


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, ENTITIES)


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, RELATIONS)


def seed_ids(links: DataFrame, min_confidence: float = 0.72) -> DataFrame:
    """qid, pos: identifiers of confident matches, each at its first place."""
    found = links.withColumn("pos", F.monotonically_increasing_id()).withColumn("qid", F.coalesce(F.nullif("wikidata_id", F.lit("")), qid("wikidata_uri")))
    kept = found.where(F.col("matched") & (F.col("confidence") >= min_confidence) & F.col("qid").isNotNull())
    return kept.groupBy("qid").agg(F.min("pos").alias("pos"))


def read_triples_tsv(spark: SparkSession, path: str) -> DataFrame:
    """h, r, t; a line with another number of fields is an error, and so is an empty file."""
    parts = spark.read.text(path).where(strip("value") != "").select(F.split("value", "\t").alias("f"))
    bad = F.raise_error(F.concat(F.lit("not three fields: "), F.array_join("f", "|")))
    checked = parts.withColumn("f", F.when(F.size("f") == 3, F.col("f")).otherwise(bad.cast("array<string>")))
    return require_rows(checked.select(F.col("f")[0].alias("h"), F.col("f")[1].alias("r"), F.col("f")[2].alias("t")), path)


def write_triples_tsv(df: DataFrame, path: str) -> None:
    df.select(F.concat_ws("\t", "h", "r", "t").alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def iso(ts: Column) -> Column:
    """A timestamp as the documents' sink writes it."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")
