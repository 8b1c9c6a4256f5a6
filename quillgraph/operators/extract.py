"""Entity and relation extraction over token and entity tables.

A parser fills two tables: ``tokens`` (doc, sent, i, text, lemma, pos, dep, head; i and head count within the
sentence, a root is its own head) and ``entities`` (doc, sent, start, end, text, label; token places, end
exclusive).  ``sentences`` makes of them a row per sentence, in which the relation rules do their work; tables that
already have such rows give them to ``sentence_entities``, ``sentence_dependencies`` and ``sentence_roots``.  ``regex_entities`` is a deterministic stand-in for a
parser's entities; it is no substitute for a statistical one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import ALLOWED_TYPES, normalize_entity, predicate_label, valid_entity
from quillgraph.operators.stage import cut

# Dependency labels and parts of speech.
SUBJECTS = ("nsubj", "nsubjpass", "csubj")
OBJECTS = ("dobj", "obj", "attr", "dative", "oprd")
VERBS = ("VERB", "AUX")
ROOT_POS = ("VERB", "AUX", "NOUN", "PROPN", "ADJ")
MAX_GAP = 15

Extractor = Callable[[DataFrame], DataFrame]


def regex_entities(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, pos, entity_text, entity_type, sentence: capitalised runs and years, by sentence."""
    sentences = docs.select(F.col(key).alias("doc"), F.posexplode(F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "([.!?])\\s+", "$1\n"), "\n")).alias("sent", "sentence"))
    found = sentences.select("doc", "sent", "sentence", F.posexplode(F.regexp_extract_all("sentence", F.lit("[A-Z][a-z]+(?: [A-Z][a-z]+)*|\\b(?:1[89]|20)[0-9]{2}\\b"), F.lit(0))).alias("i", "entity_text"))
    kind = F.when(F.col("entity_text").rlike("^[0-9]"), F.lit("DATE")).when(F.contains("entity_text", F.lit(" ")), F.lit("PERSON")).otherwise(F.lit("ORG"))
    return found.select("doc", (F.col("sent").cast("long") * 100_000 + F.col("i")).alias("pos"), "entity_text", kind.alias("entity_type"), "sentence")


def mention_aggregates(mentions: DataFrame) -> DataFrame:
    """entity rows: count and first sentence by document, text and type, for allowed and valid entities."""
    kept = mentions.where(F.col("entity_type").isin(*ALLOWED_TYPES) & valid_entity("entity_text"))
    named = kept.withColumn("entity_normalized", normalize_entity("entity_text"))
    return named.groupBy("doc", "entity_normalized", "entity_type").agg(F.count("*").alias("mention_count"), F.min_by(normalize_entity("sentence"), "pos").alias("example_sentence"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often it occurs there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: The fields of a sentence's entities.
SPAN = ("start", "end", "text", "label")


def sentences(tokens: DataFrame, entities: DataFrame) -> DataFrame:
    """doc, sent, tokens, entities: a row per sentence, its tokens by place, its entities by start.

    A token is a struct of the token table's columns and ``e``, the entity over it (e_start, e_text, e_label; the
    first of several), which comes by a range join within the sentence.
    """
    spans = entities.select("doc", "sent", F.col("start").alias("e_start"), F.col("end").alias("e_end"), F.col("text").alias("e_text"), F.col("label").alias("e_label"))
    inside = (tokens["doc"] == spans["doc"]) & (tokens["sent"] == spans["sent"]) & (tokens["i"] >= spans["e_start"]) & (tokens["i"] < spans["e_end"])
    columns = [c for c in tokens.columns if c not in ("doc", "sent", "i")]
    e = F.when(F.col("e_start").isNotNull(), F.struct("e_start", "e_text", "e_label")).alias("e")
    own = tokens.join(spans, inside, "left").select(tokens["doc"], tokens["sent"], F.struct(tokens["i"], e, *(tokens[c] for c in columns)).alias("x"))
    order = lambda a, b: F.when(a["i"] < b["i"], -1).when(a["i"] > b["i"], 1).when(a["e"] < b["e"], -1).when(a["e"] > b["e"], 1).otherwise(0)
    rows = own.groupBy("doc", "sent").agg(F.array_sort(F.collect_list("x"), order).alias("x"))
    first = F.filter("x", lambda x, k: (k == 0) | (x["i"] != F.get(F.col("x"), k - 1)["i"]))
    named = entities.groupBy("doc", "sent").agg(F.array_sort(F.collect_list(F.struct(*SPAN))).alias("entities"))
    return rows.select("doc", "sent", first.alias("tokens")).join(named, ["doc", "sent"], "left").withColumn("entities", F.coalesce("entities", F.array().cast(named.schema["entities"].dataType)))


def _heads(tokens: Column) -> Column:
    """The place of each token's head in the array; a head that isn't there is the token itself."""
    n = F.size(tokens)
    dense = (F.get(tokens, F.lit(0))["i"] == 0) & (F.get(tokens, n - 1)["i"] == n - 1)
    plain = F.transform(tokens, lambda x, k: F.when((x["head"] >= 0) & (x["head"] < n), x["head"].cast("int")).otherwise(k))
    places = lambda i: F.transform(tokens, lambda x, k: F.coalesce(F.nullif(F.array_position(i, x["head"].cast("long")), F.lit(0)) - 1, k).cast("int"))
    return F.when(dense, plain).otherwise(_let(F.transform(tokens, lambda x: x["i"].cast("long")), places))


def _answers(tokens: Column, heads: Column) -> Column:
    """answers, circle: the entity of each token, its own or its nearest ancestor's, and whether heads go in a circle.

    Doubling within the row: each round a token's pointer takes its target's, so depth d takes log2(d) rounds;
    tokens with an entity and roots point to themselves.
    """
    none = F.array().cast("array<int>")

    def followed(base: Column) -> Column:
        rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(base) + 1)).cast("int") + 1)
        step = lambda acc, _: F.when(acc["to"] == acc["before"], acc).otherwise(F.struct(F.transform(acc["to"], lambda h: F.get(acc["to"], h)).alias("to"), acc["to"].alias("before")))
        return F.aggregate(rounds, F.struct(base.alias("to"), none.alias("before")), step, lambda acc: acc["to"])

    base = F.transform(tokens, lambda x, k: F.when(x["e"].isNotNull(), k).otherwise(F.get(heads, k)))
    return _let(base, lambda b: _let(followed(b), lambda to: F.struct(F.transform(to, lambda h: F.get(tokens, h)["e"]).alias("answers"), F.exists(to, lambda h: F.get(b, h) != h).alias("circle"))))


def _resolved(tokens: Column, fields: list[str]) -> Column:
    """circle and tokens: in each token ``at``, its head's place, and ``found``, its entity or its nearest ancestor's."""
    told = lambda heads, a: F.transform(tokens, lambda x, k: F.struct(*(x[f].alias(f) for f in fields), F.get(heads, k).alias("at"), F.get(a["answers"], k).alias("found")))
    return _let(_heads(tokens), lambda heads: _let(_answers(tokens, heads), lambda a: F.struct(a["circle"].alias("circle"), told(heads, a).alias("tokens"))))


def _within(rows: DataFrame, body: Callable[[Column], Column]) -> DataFrame:
    """doc, sent and the structs that ``body`` makes of a sentence's resolved tokens; a circle of heads is an error.

    All of it is one expression: a column in between might be computed again for each place that reads it.
    """
    fields = [f.name for f in rows.schema["tokens"].dataType.elementType.fields]
    wrong = F.raise_error(F.lit("the heads of a sentence go in a circle"))
    straight = lambda r: F.when(r["circle"], wrong).otherwise(r["tokens"])
    return rows.select("doc", "sent", F.inline(_let(F.col("tokens"), lambda t: _let(_let(_resolved(t, fields), straight), body))))


def sentence_entities(rows: DataFrame) -> DataFrame:
    """doc, sent and the tokens that have an entity, with its e_start, e_text, e_label: ``token_entities`` of sentence rows."""
    fields = [f.name for f in rows.schema["tokens"].dataType.elementType.fields if f.name != "e"]
    part = lambda x: F.struct(*(x[f].alias(f) for f in fields), *(x["found"][c].alias(c) for c in ("e_start", "e_text", "e_label")))
    return _within(rows, lambda tokens: F.transform(F.filter(tokens, lambda x: x["found"].isNotNull()), part))


def token_entities(tokens: DataFrame, entities: DataFrame) -> DataFrame:
    """doc, sent, i, e_start, e_text, e_label: the entity of each token, its own or its nearest ancestor's.

    Tokens meet once, in their sentence's row, and are answered there.  Heads that go in a circle are an error.
    """
    rows = cut(sentences(tokens.select("doc", "sent", "i", "head"), entities), "tokens")
    fields = [f.name for f in rows.schema["tokens"].dataType.elementType.fields]
    if not rows.where(_let(F.col("tokens"), lambda t: _resolved(t, fields))["circle"]).isEmpty():
        raise ValueError("the heads of a sentence go in a circle")
    return sentence_entities(rows).select("doc", "sent", "i", "e_start", "e_text", "e_label")


def sentence_dependencies(rows: DataFrame, allowed_only: bool = False) -> DataFrame:
    """``dependency_relations`` of sentence rows: all joins are within the row."""

    def pairs(tokens: Column) -> Column:
        named = lambda x: x["found"].isNotNull() & (x["found"]["e_label"].isin(*ALLOWED_TYPES) if allowed_only else F.lit(True))
        up = lambda x: F.get(tokens, x["at"])
        # the head's place is the token's own where the head isn't in the sentence, so heads are compared too
        below = lambda x: (x["head"] != x["i"]) & (up(x)["i"] == x["head"]) & up(x)["pos"].isin(*VERBS)
        lemma = lambda v: F.coalesce(F.nullif(F.trim(v["lemma"]), F.lit("")), v["text"])
        behind = lambda x: (x["dep"] == "pobj") & (up(x)["i"] == x["head"]) & (up(x)["dep"] == "prep") & below(up(x))
        subjects = F.filter(tokens, lambda x: x["dep"].isin(*SUBJECTS) & named(x) & below(x))
        objects = F.filter(tokens, lambda x: named(x) & (x["dep"].isin(*OBJECTS) & below(x) | behind(x)))
        prep = lambda o: F.when(o["dep"] == "pobj", up(o)["lemma"])
        verb = lambda o: F.when(o["dep"] == "pobj", up(o)["at"]).otherwise(o["at"])
        shaped = F.transform(objects, lambda o: F.struct(verb(o).alias("verb"), lemma(F.get(tokens, verb(o))).alias("verb_lemma"), prep(o).alias("prep"), o["found"].alias("o")))
        pair = lambda s, o: F.struct(s["found"]["e_text"].alias("s_text"), s["found"]["e_label"].alias("s_label"), o["verb_lemma"].alias("verb_lemma"), o["prep"].alias("prep"), o["o"]["e_text"].alias("o_text"), o["o"]["e_label"].alias("o_label"))
        return _let(shaped, lambda os: F.flatten(F.transform(subjects, lambda s: F.transform(F.filter(os, lambda o: o["verb"] == s["at"]), lambda o: pair(s, o)))))

    return _relations(_within(rows, pairs), predicate_label("verb_lemma", "prep"), 0.85, "dependency")


def dependency_relations(tokens: DataFrame, entities: DataFrame, allowed_only: bool = False) -> DataFrame:
    """Subject and object entities of one verb, the preposition joined to the predicate where there is one."""
    return sentence_dependencies(sentences(tokens, entities), allowed_only)


def sentence_roots(rows: DataFrame) -> DataFrame:
    """``root_relations`` of sentence rows."""
    kept = F.filter("entities", lambda x: x["label"].isin(*ALLOWED_TYPES) & valid_entity(x["text"]))
    pair = lambda es, x, k: F.named_struct(F.lit("s"), x, F.lit("o"), F.get(es, k + 1))
    near = _let(kept, lambda es: F.filter(F.transform(es, lambda x, k: pair(es, x, k)), lambda p: p["o"]["text"].isNotNull() & (F.abs(p["o"]["start"] - p["s"]["end"]) <= MAX_GAP)))
    roots = F.filter("tokens", lambda x: (x["i"] == x["head"]) & x["pos"].isin(*ROOT_POS))
    names = F.transform(roots, lambda x: F.coalesce(F.nullif(x["lemma"], F.lit("")), x["text"]))
    pairs = rows.select("doc", "sent", near.alias("near"), F.explode(names).alias("root")).withColumn("root", normalize_entity(F.lower("root"))).where("root <> ''")
    flat = pairs.select("doc", "sent", "root", F.explode("near").alias("p"))
    return _relations(flat.select("doc", "sent", "root", *(F.col(f"p.{a}.{b}").alias(f"{a}_{b}") for a in "so" for b in ("text", "label"))), F.col("root"), 0.45, "same_sentence_root")


def root_relations(tokens: DataFrame, entities: DataFrame) -> DataFrame:
    """Neighbouring entities of a sentence, at most MAX_GAP tokens apart, related by the root's lemma."""
    return sentence_roots(sentences(tokens, entities))


def _relations(pairs: DataFrame, predicate, confidence: float, method: str) -> DataFrame:
    rows = pairs.select("doc", "sent", normalize_entity("s_text").alias("subject"), F.col("s_label").alias("subject_type"), predicate.alias("predicate"), normalize_entity("o_text").alias("object"), F.col("o_label").alias("object_type"), F.lit(confidence).alias("confidence"), F.lit(method).alias("method"))
    return rows.where((F.col("subject") != F.col("object")) & valid_entity("subject") & valid_entity("object"))


def dedupe_relations(relations: DataFrame, source: str = "source_url", order: str = "pos") -> DataFrame:
    """Per source, subject, predicate and object the row of highest confidence, the first of equals."""
    w = Window.partitionBy(source, "subject", "predicate", "object").orderBy(F.desc("confidence"), order)
    return relations.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def sorted_mentions(entities: DataFrame) -> DataFrame:
    """By document, type and text."""
    return entities.orderBy("doc", "entity_type", "entity_normalized")


def sorted_relations(relations: DataFrame, source: str = "source_url") -> DataFrame:
    """By source, subject, predicate and object."""
    return relations.orderBy(source, "subject", "predicate", "object")


def extract_relations(tokens: DataFrame, entities: DataFrame) -> DataFrame:
    """Both methods over every sentence, deduplicated per document."""
    both = dependency_relations(tokens, entities).unionByName(root_relations(tokens, entities))
    return dedupe_relations(both, "doc", "sent")
