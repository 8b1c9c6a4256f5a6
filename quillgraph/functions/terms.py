"""RDF terms: the triple schema and builders of IRIs and triples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import camel_case, col, slug
from quillgraph.operators.stage import dealt

# Vocabulary IRIs.
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
LABEL = RDFS + "label"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"

TRIPLES = "s string, s_kind string, p string, o string, o_kind string, o_datatype string, o_lang string"
COLUMNS = ("s", "s_kind", "p", "o", "o_kind", "o_datatype", "o_lang")


@dataclass(frozen=True)
class Namespaces:
    """IRIs below one base."""

    base: str = "http://example.org/kg/"

    def entity(self, text: str | Column) -> Column:
        return F.concat(F.lit(self.base + "entity/"), slug(text))

    def prop(self, text: str | Column, suffix: bool = True) -> Column:
        return F.concat(F.lit(self.base + "property/"), camel_case(text, suffix))

    def cls(self, name: str | Column) -> Column:
        return F.concat(F.lit(self.base + "ontology/"), col(name))


def triple(s: Column, p: str | Column, o: Column, kind: str = "iri", datatype: str | None = None, lang: str | None = None) -> list[Column]:
    """Columns of the triple schema."""
    none = F.lit(None).cast("string")
    return [
        s.cast("string").alias("s"),
        F.when(s.startswith("_:"), F.lit("bnode")).otherwise(F.lit("iri")).alias("s_kind"),
        (F.lit(p) if isinstance(p, str) else p).alias("p"),
        o.cast("string").alias("o"),
        F.lit(kind).alias("o_kind"),
        (F.lit(datatype) if datatype else none).alias("o_datatype"),
        (F.lit(lang) if lang else none).alias("o_lang"),
    ]


def union(*graphs: DataFrame) -> DataFrame:
    """Set union of triple tables."""
    out = graphs[0].select(*COLUMNS)
    for g in graphs[1:]:
        out = out.unionByName(g.select(*COLUMNS))
    return dealt(out, *COLUMNS).distinct()
