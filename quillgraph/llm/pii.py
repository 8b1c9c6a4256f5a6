"""Information-theoretic sanitisation of personal data, with built-in expressions alone.

Protected entities are the values that the base patterns find (mail addresses, IP addresses, card and
phone numbers).  A term of the same document can reveal it as well: over the corpus, with n documents,
n(e) that hold the entity, n(t) that hold the term and n(e,t) that hold both, however far apart,
PMI(e,t) = log2(n(e,t) n / (n(e) n(t))) is the information that the term gives about the entity, and
IC(e) = log2(n / n(e)) all there is.  From two witnesses up, a term that discloses at least ``GENERALISE``
of IC(e) is generalised, at least ``REMOVE`` removed, wherever it stands in a document that holds the entity.
A copy proves nothing about what a term reveals: joint documents that agree in two MinHash samples of their
terms, as copies and most near copies do, are one witness.  Documents without an entity are left alone.
Terms are runs of three letters or more, lower-cased.

n, n(e), n(t), n(e,t) are counted over all documents, repeated rows as documents of their own.  Null and empty
texts hold nothing, very long ones are worked on whole, an empty table gives an empty result, and only id and
text are read, whatever other columns are called.  A null id stays null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import BROADCAST_ROWS, Table, scratch, table
from quillgraph.llm.spans import NO_TAGGED, joined, tagged, with_spans

KINDS = ("email", "ip", "card", "phone")

#: The base patterns, possessive.  A mail address's local part starts where its run starts or the last match ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"\p{L}{3,}+"

GENERALISE, REMOVE = 0.8, 0.95
#: Documents that must hold an entity, for a term to meet it before two witnesses.
SUPPORT = 2


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has Luhn's checksum."""
    n = F.length(number)

    def part(i: Column) -> Column:
        d = F.substring(number, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + part(i)) % 10 == 0


def _ip_ok(value: Column, _: Column) -> Column:
    return F.forall(F.split(value, "\\."), lambda x: (F.length(F.ltrim(x, F.lit("0"))) <= 3) & (F.coalesce(F.right(x, F.lit(3)).cast("int"), F.lit(0)) <= 255))


def _card_ok(value: Column, _: Column) -> Column:
    d = digits(value)
    return F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False))


def _phone_ok(value: Column, _: Column) -> Column:
    return F.length(digits(value)).between(9, 15)


def find(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, text, and per kind the base spans."""
    df = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    number = F.col("text").rlike("[0-9]")
    df = with_spans(df, "email", "text", EMAIL, F.contains("text", F.lit("@")))
    df = with_spans(df, "ip", "text", IP, number, _ip_ok)
    df = with_spans(df, "card", "text", CARD, number, _card_ok)
    return with_spans(df, "phone", "text", PHONE, F.contains("text", F.lit("+")), _phone_ok)


def _entity(kind: str, value: Column) -> Column:
    plain = F.lower(value) if kind == "email" else value if kind == "ip" else digits(value)
    return F.concat(F.lit(kind + ":"), plain)


def terms_of(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def witness(terms: Column) -> Column:
    """Two MinHash samples of a text's terms as one number, which copies and most near copies share."""
    low = lambda seed: F.array_min(F.transform(terms, lambda t: F.xxhash64(F.lit(seed), t)))
    return F.xxhash64(low(1), low(2))


def term_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """term, n_t: documents that hold each term, over all documents; combined before the shuffle."""
    return df.select(F.explode(terms_of(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))


def met(held: Table) -> DataFrame:
    """rid, witness, entity, term: every term of a document with every entity that it holds."""
    return held.df().select("rid", "witness", "terms", F.explode("entities").alias("entity")).select("rid", "witness", "entity", F.explode("terms").alias("term"))


def disclosures(held: Table, n: int, n_e: Table, df: DataFrame, text_col: str, generalise: float) -> DataFrame:
    """entity, term, share: the pairs of two witnesses or more whose term discloses at least ``generalise`` of the entity."""
    joint = met(held).groupBy("entity", "term").agg(F.count("*").alias("n_et"), F.min("witness").alias("one"), F.max("witness").alias("other"))
    witnessed = Table(joint.where("one <> other").select("entity", "term", "n_et"), "pii-witnessed")
    # a share is only reached up to some n_t, and the documents that hold entities alone may exceed it: such pairs
    # go before their terms are counted over the corpus (the slack is for rounding)
    among = held.df().select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_held"))
    most = F.col("n_et") * F.pow(F.lit(float(n)) / F.col("n_e"), F.lit(1 - generalise)) * (1 + 1e-9)
    pairs = Table(witnessed.df().join(n_e.small(), "entity").join(among, "term").where(F.col("n_held") <= most).select("entity", "term", "n_et", "n_e"), "pii-pairs")
    near = Table(pairs.df().select("term").distinct(), "pii-terms")
    # an inner join: a semi join would go before the sum and meet every document's terms one by one
    n_t = Table(term_counts(df, text_col).join(near.small(), "term"), "pii-counts")
    pmi = F.log2(F.col("n_et") * F.lit(float(n)) / (F.col("n_e") * F.col("n_t")))
    ic = F.log2(F.lit(float(n)) / F.col("n_e"))
    return pairs.df().join(n_t.small(), "term").select("entity", "term", (pmi / ic).alias("share")).where(F.col("share") >= generalise)


def analyse(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", generalise: float = GENERALISE, remove: float = REMOVE, keep_text: bool = False) -> DataFrame:
    """id, the base spans by kind, ``added`` (tagged spans of disclosing terms) and, if asked for, the text.

    Entities of fewer than ``SUPPORT`` documents, or of all, can't be disclosed and go before terms are paired.
    A hot entity or term is a sum combined before the shuffle, and joins are against written tables, which
    Spark may split.
    """
    entity = lambda kind: lambda s: _entity(kind, s["value"])
    with scratch() as keep:
        found = find(df, text_col, id_col).withColumn("rid", F.monotonically_increasing_id())
        found = found.withColumn("entities", F.array_distinct(F.concat(*(F.transform(k, entity(k)) for k in KINDS))))
        text = F.col("text") if keep_text else F.when(F.size("entities") > 0, F.col("text"))
        found = keep(Table(found.withColumn("text", text), "pii-found"))  # writing settles the row numbers
        n = found.rows()
        every = found.df().select("rid", F.explode("entities").alias("entity"))
        n_e = Table(every.groupBy("entity").agg(F.count("*").alias("n_e")).where((F.col("n_e") >= SUPPORT) & (F.col("n_e") < n)), "pii-entities")
        known = Table(every.join(n_e.small(), "entity").groupBy("rid").agg(F.collect_list("entity").alias("entities")), "pii-known")
        held = Table(found.df().select("rid", "text").join(known.small(BROADCAST_ROWS // 10), "rid").select("rid", "entities", terms_of(F.col("text")).alias("terms")).withColumn("witness", witness(F.col("terms"))), "pii-held")
        risky = Table(disclosures(held, n, n_e, df, text_col, generalise), "pii-risky")
        hits = Table(met(held).join(risky.small(), ["entity", "term"]).groupBy("rid", "term").agg(F.max("share").alias("share")), "pii-hits")
        hit = Table(hits.df().select("rid").distinct(), "pii-hit")
        words = with_spans(found.df().select("rid", "text").join(hit.small(), "rid", "left_semi"), "word", "text", TERM, F.lit(True)).select("rid", F.explode("word").alias("w"))
        places = Table(words.select("rid", F.lower("w.value").alias("term"), "w.start", "w.end").join(hits.small(), ["rid", "term"]).select("rid", "start", "end", "share"), "pii-places")
        kind = F.when(F.col("share") >= remove, F.lit("removed")).otherwise(F.lit("generalised"))
        added = keep(Table(
            places.df().groupBy("rid").agg(F.collect_list(F.struct(F.col("start"), F.lit(len(KINDS)).alias("order"), kind.alias("kind"), F.col("end"))).alias("added")),
            "pii-added",
        ))
    out = found.df().drop("entities", *([] if keep_text else ["text"])).join(added.small(), "rid", "left").withColumn("added", F.coalesce("added", F.array().cast(NO_TAGGED)))
    base = base_spans()
    clear = F.filter("added", lambda a: ~F.exists(base, lambda b: (b["start"] < a["end"]) & (a["start"] < b["end"])))
    return out.withColumn("added", clear)


def base_spans() -> Column:
    return F.concat(*(tagged(F.col(k), i, k) for i, k in enumerate(KINDS)))


def sanitise(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, spans, sanitised: entities and removed terms become their kind in brackets, generalised terms a
    shape of their first letter's case.  Of overlapping spans the first stands."""
    out = analyse(df, text_col, id_col, keep_text=True)
    spans = F.array_sort(F.concat(base_spans(), F.col("added")))
    start = F.named_struct(F.lit("at"), F.lit(0).cast("long"), F.lit("out"), F.lit(""))

    def step(acc: Column, s: Column) -> Column:
        term = F.substring("text", (s["start"] + 1).cast("int"), F.lit(1))
        new = F.when(s["kind"] != "generalised", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(term == F.upper(term), F.lit("[Name]")).otherwise(F.lit("[word]"))
        text = F.concat(acc["out"], F.substring("text", (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), new)
        return F.when(s["start"] < acc["at"], acc).otherwise(F.named_struct(F.lit("at"), s["end"], F.lit("out"), text))

    done = F.aggregate(spans, start, step)
    clean = F.when(F.size(spans) == 0, F.col("text")).otherwise(F.concat(done["out"], F.substring("text", (done["at"] + 1).cast("int"), F.length("text"))))
    return out.select("id", joined(spans).alias("spans"), clean.alias("sanitised"))


def op2_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: counts and digest of the base spans, and all spans."""
    out = analyse(table(spark, sf_dir, "documents"))
    base = base_spans()
    return out.select(F.col("id").alias("doc_id"), *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.concat(base, F.col("added"))).alias("spans"))
