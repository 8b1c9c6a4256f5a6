"""Answers to questions over a graph: a model's query, then a label query, then a query on IRIs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.terms import LABEL, RDF_TYPE
from quillgraph.functions.text import extract_query, looks_like_query, question_phrase, token_regex
from quillgraph.operators.stage import BROADCAST_ROWS, cut
from quillgraph.plans.sparql import compile_query, literal

#: Takes a prompt and gives a text, or None where there is no model.
Model = Callable[[str], str | None]


def no_model(prompt: str) -> str | None:
    return None


@dataclass
class Answer:
    question: str
    query: str | None = None
    vars: list[str] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)
    repaired: bool = False
    error: str | None = None


def _one(spark: SparkSession, text: str, f) -> object:
    """A column function on one value."""
    return spark.createDataFrame([(text,)], "x string").select(f("x").alias("y")).first().y


def schema_summary(triples: DataFrame, predicates: int = 120, classes: int = 80, samples: int = 25) -> dict[str, DataFrame]:
    """Predicates, classes and sample triples, each in order and up to a limit."""
    return {
        "predicates": triples.select(F.col("p").alias("value")).distinct().orderBy("value").limit(predicates),
        "classes": triples.where((F.col("p") == RDF_TYPE) & (F.col("o_kind") == "iri")).select(F.col("o").alias("value")).distinct().orderBy("value").limit(classes),
        "samples": triples.select(F.concat_ws(" ", "s", "p", "o").alias("value")).orderBy("value").limit(samples),
    }


def summary_text(summary: dict[str, DataFrame]) -> str:
    parts = []
    for name, df in summary.items():
        rows = [r.value for r in df.orderBy("value").collect()]  # at most the limits above
        parts.append(f"{name.capitalize()} ({len(rows)}):\n" + "\n".join(f"- {x}" for x in rows))
    return "\n\n".join(parts) + "\n"


def prompt(question: str, summary: str) -> str:
    return f"Write one SPARQL SELECT query that answers the question over the graph described below. Return only the query.\n\n{summary}\nQuestion: {question}\n"


def label_query(phrase: str, limit: int = 30) -> str:
    return f'SELECT ?s ?p ?o WHERE {{ ?s <{LABEL}> ?label . FILTER(CONTAINS(LCASE(STR(?label)), {literal(phrase.lower())})) ?s ?p ?o . }} LIMIT {limit}'


def iri_query(regex: str, limit: int = 30) -> str:
    return f'SELECT ?s ?p ?o WHERE {{ ?s ?p ?o . FILTER(REGEX(STR(?s), {literal(regex)}, "i")) }} LIMIT {limit}'


def labelled(triples: DataFrame, phrase: str) -> DataFrame | None:
    """The triples that ``label_query`` needs, those of the subjects it finds; all where these are many, None if there is none."""
    found = cut(triples.where((F.col("p") == LABEL) & F.contains(F.lower("o"), F.lit(phrase.lower()))).select("s").distinct(), "labelled")
    n = found.count()
    if n > BROADCAST_ROWS:
        return triples
    return triples.join(F.broadcast(found), "s", "left_semi").select(triples.columns) if n else None


def answer(triples: DataFrame, question: str, model: Model = no_model, summary: str = "", whole_tokens: bool = False, limit: int = 30) -> Answer:
    """The first query that has rows wins; a query tried before is skipped, and errors are kept.

    ``repaired`` says that the rows come from another query than the model's.
    """
    spark, out = triples.sparkSession, Answer(question)
    attempts: list[tuple[str, bool]] = []
    try:
        said = model(prompt(question, summary))
    except Exception as e:  # a model's failure is part of the answer
        said, out.error = None, str(e)
    if said:
        query = _one(spark, said, extract_query)
        if _one(spark, query, looks_like_query):
            attempts.append((query, False))
    phrase = _one(spark, question, question_phrase)
    regex = _one(spark, phrase, token_regex)
    attempts.append((label_query(phrase, limit), True))
    if regex:
        attempts.append((iri_query(rf"(?<![A-Za-z0-9])(?:{regex})(?![A-Za-z0-9])" if whole_tokens else regex, limit), True))
    seen = set()
    for query, repaired in attempts:
        if query in seen:
            continue
        seen.add(query)
        try:
            part = labelled(triples, phrase) if query == label_query(phrase, limit) else triples
            if part is None:
                continue
            df = compile_query(query, part)
            rows = [tuple(map(str, r)) for r in df.collect()] if repaired else [tuple(map(str, r)) for r in df.limit(limit).collect()]
        except Exception as e:
            out.error = str(e)
            continue
        if rows:
            out.query, out.vars, out.rows, out.repaired = query, df.columns, rows, repaired
            return out
    out.query, out.repaired = attempts[-1][0], True
    return out


def baseline(question: str, model: Model = no_model) -> str:
    """The model's answer without retrieval; its failure as text."""
    try:
        return model(question) or ""
    except Exception as e:
        return f"error: {e}"


def show(a: Answer, cap: int = 20) -> str:
    """A console table of at most ``cap`` rows."""
    lines = [" | ".join(a.vars)] + [" | ".join(r) for r in a.rows[:cap]]
    return "\n".join(lines + ([f"showing {cap} of {len(a.rows)}"] if len(a.rows) > cap else []))


EVALUATION = "question string, baseline string, rag_query string, rag_repaired boolean, rag_error string, rag_result_count long, rag_first_row string"


def evaluate(triples: DataFrame, questions: list[str], model: Model = no_model) -> DataFrame:
    """One row per question, as the evaluation sinks hold them."""
    rows = []
    for q in questions:
        a = answer(triples, q, model)
        rows.append((q, baseline(q, model), a.query, a.repaired, a.error, len(a.rows), " | ".join(a.rows[0]) if a.rows else None))
    return triples.sparkSession.createDataFrame(rows, EVALUATION)


def chat(triples: DataFrame, model: Model = no_model, read: Callable[[str], str] = input, write: Callable[[str], None] = print) -> None:
    """A question loop until ``quit``."""
    while (q := read("question> ").strip()).lower() not in ("quit", "exit"):
        if q:
            write(show(answer(triples, q, model)))

