"""Linking entities and predicates to an outside vocabulary by scored candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.terms import OWL, Namespaces, triple, union
from quillgraph.functions.text import normalize, search_term, token_set, tokens

# Words of a description that speak for a type; the reason codes below are required output.
TYPE_HINTS = {
    "PERSON": ("actor", "director", "writer", "producer", "television", "film", "person", "screenwriter"),
    "ORG": ("organization", "company", "studio", "network", "award", "academy"),
    "GPE": ("city", "country", "state", "location", "place"),
    "WORK_OF_ART": ("film", "television", "series", "movie", "show", "work"),
    "EVENT": ("award", "ceremony", "event", "festival"),
    "DATE": ("year", "date", "time"),
}
ENTITY_THRESHOLD, PROPERTY_THRESHOLD = 0.72, 0.75


def _clamp(score: Column) -> Column:
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(0.99))


def _reasons(*parts: Column) -> Column:
    return F.coalesce(F.nullif(F.concat_ws(",", *parts), F.lit("")), F.lit("weak_match"))


def entity_score(entity: str = "entity", kind: str = "entity_type", label: str = "label", description: str = "description", match: str = "match_text", second: str = "second_label") -> tuple[Column, Column]:
    """Score and reasons of a candidate; an empty candidate label matches nothing."""
    text = lambda c: F.coalesce(normalize(c), F.lit(""))
    e, name, about, told = text(entity), text(label), text(description), text(match)
    own = token_set(e)
    overlap = F.size(F.array_intersect(own, token_set(name)))
    exact = name == e
    partial = (name != "") & (e != "") & (F.contains(name, e) | F.contains(e, name))
    by_label = F.when(exact, F.lit(0.60)).when(partial, F.lit(0.40)).when(overlap > 0, F.lit(0.25) * (overlap / F.greatest(F.size(own), F.lit(1)))).otherwise(F.lit(0.0))
    why = F.when(exact, F.lit("exact_label")).when(partial, F.lit("partial_label")).when(overlap > 0, F.lit("token_overlap"))
    api = (told != "") & (told == e)
    hints = F.create_map(*(x for k, v in TYPE_HINTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    hint = F.get(F.filter(F.coalesce(F.try_element_at(hints, F.coalesce(kind, F.lit(""))), F.array().cast("array<string>")), lambda h: F.contains(about, h)), F.lit(0))
    rival = (F.coalesce(F.col(second), F.lit("")) != "") & (text(second) == name)
    score = F.lit(0.05) + by_label + F.when(api, 0.10).otherwise(0.0) + F.when(hint.isNotNull(), 0.15).otherwise(0.0) - F.when(rival, 0.05).otherwise(0.0)
    return _clamp(score), _reasons(why, F.when(api, F.lit("api_match_text")), F.concat(F.lit("type_hint:"), hint))


def best_candidate(scored: DataFrame, key: list[str], order: str = "pos") -> DataFrame:
    """Per key the candidate of the highest score, the first of equals."""
    w = Window.partitionBy(*key).orderBy(F.desc("score"), order)
    return scored.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


#: Candidates of an entity, and properties of a predicate, that a search gives at most.
ENTITY_LIMIT, PROPERTY_LIMIT = 5, 20

CANDIDATES = "entity string, entity_type string, pos int, id string, uri string, label string, description string, match_text string"


def looked_up(entities: DataFrame, provider, limit: int = ENTITY_LIMIT, delay: float = 0.0) -> DataFrame:
    """Candidates by a search service: ``provider`` takes entity, type and limit and gives dicts of the columns behind pos.

    Each distinct entity is asked for once; dates and empty ones aren't.  A task waits ``delay`` seconds after each answer.
    """

    def run(batches):
        import time

        import pandas as pd

        names = [c.split(" ")[0] for c in CANDIDATES.split(", ")]
        for batch in batches:
            rows = []
            for entity, kind in zip(batch["entity"], batch["entity_type"], strict=True):
                rows += [{"entity": entity, "entity_type": kind, "pos": i} | found for i, found in enumerate(list(provider(entity, kind, limit))[:limit])]
                time.sleep(delay)
            yield pd.DataFrame(rows, columns=names).astype({"pos": "Int32"})

    asked = entities.select("entity", "entity_type").distinct().where((F.coalesce("entity_type", F.lit("")) != "DATE") & (F.coalesce(F.trim("entity"), F.lit("")) != ""))
    return asked.mapInPandas(run, CANDIDATES)


def unique_entities(entities: DataFrame) -> DataFrame:
    """entity, entity_type: each once, by type and text."""
    return entities.select("entity", "entity_type").distinct().orderBy("entity_type", "entity")


def unique_predicates(relations: DataFrame) -> DataFrame:
    """predicate: trimmed, not empty, each once, in order."""
    return relations.select(F.trim("predicate").alias("predicate")).where("predicate <> ''").distinct().orderBy("predicate")


def link_summary(links: DataFrame) -> DataFrame:
    """One row: rows, matched, share (0 without rows)."""
    share = F.when(F.count("*") > 0, F.count_if("matched") / F.count("*")).otherwise(F.lit(0.0))
    return links.agg(F.count("*").alias("rows"), F.count_if("matched").alias("matched"), share.alias("share"))


def link_entities(entities: DataFrame, candidates: DataFrame, threshold: float = ENTITY_THRESHOLD, ns: Namespaces = Namespaces(), limit: int = ENTITY_LIMIT) -> DataFrame:  # noqa: B008
    """The entity link table.

    ``entities`` has entity, entity_type; ``candidates`` has entity, pos (from 0), id, uri, label,
    description, match_text, of which the first ``limit`` of each entity count.  Dates and empty entities aren't looked up, but keep a row.
    """
    wanted = entities.select("entity", "entity_type").distinct()
    seen = candidates.where(F.col("pos") < limit).drop("entity_type").withColumn("second_label", F.max(F.when(F.col("pos") == 1, F.col("label"))).over(Window.partitionBy("entity")))
    score, reason = entity_score()
    asked = wanted.where((F.col("entity_type") != "DATE") & (F.coalesce(F.trim("entity"), F.lit("")) != ""))
    best = best_candidate(asked.join(seen, "entity").withColumns({"score": score, "reason": reason}), ["entity", "entity_type"])
    out = wanted.join(best.select("entity", "entity_type", "id", "uri", "label", "description", "score", "reason"), ["entity", "entity_type"], "left")
    skipped = F.when(F.col("entity_type") == "DATE", F.lit("skipped_type")).otherwise(F.lit("no_candidates"))
    confidence = F.round(F.coalesce("score", F.lit(0.0)), 4)
    return out.select(
        F.col("entity").alias("private_entity"),
        ns.entity("entity").alias("private_uri"),
        "entity_type",
        F.coalesce("id", F.lit("")).alias("wikidata_id"),
        F.coalesce("uri", F.lit("")).alias("wikidata_uri"),
        F.coalesce("label", F.lit("")).alias("wikidata_label"),
        F.coalesce("description", F.lit("")).alias("wikidata_description"),
        confidence.alias("confidence"),
        F.coalesce(F.col("score") >= threshold, F.lit(False)).alias("matched"),
        F.coalesce("reason", skipped).alias("match_reason"),
    )


def property_score(predicate: str = "predicate", label: str = "label", description: str = "description", term: str = "term") -> tuple[Column, Column]:
    text = lambda c: F.coalesce(normalize(c), F.lit(""))
    words = F.filter(tokens(F.lower(predicate)), lambda t: t != "")
    plain = F.array_join(words, " ")
    own, name, about = token_set(plain), text(label), text(description)
    exact = (name == plain) & (plain != "")
    overlap = F.size(F.array_intersect(own, token_set(name)))
    inside = F.contains(name, F.col(term))
    told = F.exists(own, lambda t: F.contains(about, t))
    score = F.lit(0.05) + F.when(exact, F.lit(0.70)).otherwise(F.lit(0.35) * (overlap / F.greatest(F.size(own), F.lit(1)))) + F.when(inside, 0.15).otherwise(0.0) + F.when(told, 0.10).otherwise(0.0)
    return _clamp(score), _reasons(F.when(exact, F.lit("exact_label")).when(overlap > 0, F.lit("token_overlap")), F.when(inside, F.lit("search_term_in_label")), F.when(told, F.lit("description_overlap")))


def link_predicates(predicates: DataFrame, properties: DataFrame, threshold: float = PROPERTY_THRESHOLD, ns: Namespaces = Namespaces(), limit: int = PROPERTY_LIMIT) -> DataFrame:  # noqa: B008
    """The predicate link table.

    ``predicates`` has predicate; ``properties`` has pos, property, label, description.  A predicate's
    search term must be in a property's label, and the first ``limit`` such properties count; predicates are few, so the theta join broadcasts the
    side that Spark finds small enough.
    """
    wanted = predicates.select(F.trim("predicate").alias("predicate")).where("predicate <> ''").distinct().withColumn("term", search_term("predicate"))
    props = properties.select("pos", "property", "label", "description")
    score, reason = property_score()
    met = wanted.where("term is not null").join(props, F.contains(F.lower("label"), F.col("term")))
    met = met.withColumn("__n", F.row_number().over(Window.partitionBy("predicate").orderBy("pos"))).where(F.col("__n") <= limit).drop("__n")
    best = best_candidate(met.withColumns({"score": score, "reason": reason}), ["predicate"])
    out = wanted.join(best.select("predicate", "property", "label", "description", "score", "reason"), "predicate", "left")
    matched = F.coalesce(F.col("score") >= threshold, F.lit(False))
    return out.select(
        F.col("predicate").alias("private_predicate"),
        ns.prop("predicate").alias("private_uri"),
        F.coalesce("property", F.lit("")).alias("wikidata_property"),
        F.coalesce("label", F.lit("")).alias("property_label"),
        F.coalesce("description", F.lit("")).alias("property_description"),
        F.round(F.coalesce("score", F.lit(0.0)), 4).alias("confidence"),
        matched.alias("matched"),
        F.when(F.col("term").isNull(), F.lit("no_meaningful_tokens")).otherwise(F.coalesce("reason", F.lit("weak_match"))).alias("match_reason"),
    )


def alignment_graph(entity_links: DataFrame, predicate_links: DataFrame) -> DataFrame:
    """sameAs and equivalentProperty of matched rows with a target."""
    e = entity_links.where("matched and wikidata_uri <> ''")
    p = predicate_links.where("matched and wikidata_property <> ''")
    return union(e.select(*triple(F.col("private_uri"), OWL + "sameAs", F.col("wikidata_uri"))), p.select(*triple(F.col("private_uri"), OWL + "equivalentProperty", F.col("wikidata_property"))))
