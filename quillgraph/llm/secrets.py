"""Secret scan with multipart credential linking, with built-in expressions alone.

Base spans (assignments, access keys, long hexadecimal strings) stand by themselves.  Weak candidates are
parts of a credential that mean nothing alone: account identifiers, endpoints, and opaque values.  Each is
reported only if the parts that complete it lie within its scope of ``SCOPE`` code points to both sides.
Distances are from the earlier part to the later one's start; of the earlier one's own length no more than
``LEAD`` code points count, so that a long value doesn't use up the scope:

* an identifier needs a secret (an assignment, a hexadecimal string or an opaque value),
* an opaque value needs an identifier or an access key,
* an endpoint needs both a secret and an identifier or access key.

The interval join is a running maximum: in a document, per role and in order of start, the furthest reach of
the parts that start up to a candidate's scope.  No pairs are made however many parts a document holds.
Null and empty texts hold nothing; repeated rows are scanned each; a null id stays null.  Very long texts are
scanned whole, ties in place are ordered by kind, an empty table gives an empty result, and only id and text
are read, whatever other columns are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import Table, table
from quillgraph.llm.spans import NO_TAGGED, joined, tagged, with_spans

KINDS = ("assign", "access", "hex")
WEAK = ("ident", "opaque", "endpoint")
#: The role that each kind of span plays for others.
ROLES = {"assign": "secret", "hex": "secret", "opaque": "secret", "access": "name", "ident": "name"}
#: The roles that a weak kind needs in its scope.
NEEDS = {"ident": ("secret",), "opaque": ("name",), "endpoint": ("secret", "name")}

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
IDENT = r"""(?i)(?<![A-Za-z0-9_])(?:client_?id|app_?id|account(?:_?id)?|user(?:_?name|_?id)?|login|access_?key_?id)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9_.@-]{3,}+"""
OPAQUE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{20,}+={0,2}+"
ENDPOINT = r"(?i)(?:https?|ftp|jdbc:[a-z]++|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[A-Za-z0-9.@:_-]++"

SCOPE, LEAD = 200, 32


def find(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, text, base spans by kind, and weak candidates where any other part is there to complete them."""
    df = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sign = F.contains("text", F.lit("=")) | F.contains("text", F.lit(":"))
    df = with_spans(df, "assign", "text", ASSIGN, sign & F.col("text").rlike("[=:]"), lambda _, g: F.length(g) >= 6, group=2)
    df = with_spans(df, "access", "text", ACCESS, F.contains("text", F.lit("AKIA")))
    df = with_spans(df, "hex", "text", HEX, F.col("text").rlike(HEX))
    strong_secret = (F.size("assign") > 0) | (F.size("hex") > 0)
    df = with_spans(df, "ident", "text", IDENT, sign)
    named = (F.size("access") > 0) | (F.size("ident") > 0)
    df = with_spans(df, "opaque", "text", OPAQUE, named)
    secret = strong_secret | (F.size("opaque") > 0)
    return with_spans(df, "endpoint", "text", ENDPOINT, named & secret & F.contains("text", F.lit("://")))


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """rid, added: tagged spans of the weak candidates whose complementary parts co-occur in scope."""
    part = lambda kind: lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    every = F.concat(*(F.transform(k, part(k)) for k in (*KINDS, *WEAK)))
    weak = sum((F.size(k) for k in WEAK), F.lit(0))
    parts = found.where((weak > 0) & (F.size(every) > 1)).select("rid", F.explode(every).alias("p")).select("rid", "p.*")
    parts = parts.withColumn("reach", F.greatest("start", F.col("end") - LEAD))
    role = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))
    needs = F.create_map(*(x for k, v in NEEDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    # a candidate never completes itself: its own role is not among those it needs
    asked = parts.where(F.col("kind").isin(*WEAK)).withColumn("needs", needs[F.col("kind")]).select("*", F.explode("needs").alias("role"))
    given = parts.withColumn("role", role[F.col("kind")]).where("role is not null").select("rid", "role", F.col("start").alias("at"), F.col("reach").alias("far"))
    both = given.unionByName(asked.withColumn("at", F.col("reach") + scope), allowMissingColumns=True)
    # the default frame takes in the parts that start at the very end of the scope
    both = both.withColumn("furthest", F.max("far").over(Window.partitionBy("rid", "role").orderBy("at")))
    met = both.where(F.col("kind").isNotNull() & (F.col("furthest") >= F.col("start") - scope)).groupBy("rid", "kind", "start", "end", F.size("needs").alias("n")).agg(F.countDistinct("role").alias("met"))
    order = F.create_map(*(x for i, k in enumerate(WEAK) for x in (F.lit(k), F.lit(len(KINDS) + i))))
    return met.where("met = n").groupBy("rid").agg(F.collect_list(F.struct("start", order[F.col("kind")].alias("order"), "kind", "end")).alias("added"))


def scan(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", scope: int = SCOPE, keep_text: bool = False) -> DataFrame:
    """id, base spans by kind and ``added``, the linked weak candidates; with the text if asked for."""
    found = find(df, text_col, id_col).withColumn("rid", F.monotonically_increasing_id())
    found = Table(found if keep_text else found.drop("text"), "secrets-found")  # writing settles the row numbers
    added = Table(linked(found.df(), scope), "secrets-linked")
    return found.df().join(added.small(), "rid", "left").withColumn("added", F.coalesce("added", F.array().cast(NO_TAGGED)))


def base_spans() -> Column:
    return F.concat(*(tagged(F.col(k), i, k) for i, k in enumerate(KINDS)))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: counts and digest of the base spans, and all spans."""
    out = scan(table(spark, sf_dir, "documents"))
    base = base_spans()
    return out.select(F.col("id").alias("doc_id"), *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.concat(base, F.col("added"))).alias("spans"))
