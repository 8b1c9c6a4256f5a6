"""RDFS and OWL closures and simple rules, as fixpoints of joins over written tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.terms import COLUMNS, OWL, RDF_TYPE, RDFS, triple, union
from quillgraph.functions.text import local_name
from quillgraph.operators.stage import cut, small

SUBCLASS, SUBPROPERTY, DOMAIN, RANGE = (RDFS + x for x in ("subClassOf", "subPropertyOf", "domain", "range"))


def closure(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """a, b: the transitive closure of edges (a, b), by squaring; cycles are fine."""
    reach = cut(edges.select("a", "b").where("a is not null and b is not null").distinct(), "closure")
    size = reach.count()
    for _ in range(rounds):
        on = reach.select(F.col("a").alias("b"), F.col("b").alias("c"))
        reach = cut(reach.unionByName(reach.join(on, "b").select("a", F.col("c").alias("b"))).distinct(), "closure")
        now = reach.count()
        if now == size:
            break
        size = now
    return reach


def edges_of(triples: DataFrame, p: str) -> DataFrame:
    return triples.where((F.col("p") == p) & (F.col("o_kind") != "literal")).select(F.col("s").alias("a"), F.col("o").alias("b"))


def with_self(reach: DataFrame) -> DataFrame:
    both = reach.select(F.explode(F.array("a", "b")).alias("a")).distinct()
    return reach.unionByName(both.select("a", F.col("a").alias("b"))).distinct()


def types(triples: DataFrame) -> DataFrame:
    """s, class: direct and inherited classes."""
    direct = edges_of(triples, RDF_TYPE).select(F.col("a").alias("s"), F.col("b").alias("class"))
    up = closure(edges_of(triples, SUBCLASS)).select(F.col("a").alias("class"), F.col("b").alias("above"))
    return direct.unionByName(direct.join(up, "class").select("s", F.col("above").alias("class"))).distinct()


def _list_members(triples: DataFrame) -> DataFrame:
    """list, member of RDF collections."""
    rdf = RDF_TYPE.rpartition("#")[0] + "#"
    rest = with_self(closure(edges_of(triples, rdf + "rest")))
    first = triples.where(F.col("p") == rdf + "first").select(F.col("s").alias("b"), F.col("o").alias("member"))
    return rest.join(first, "b").select(F.col("a").alias("list"), "member")


def entail(triples: DataFrame) -> DataFrame:
    """The triples with what follows from them.

    Rules: subclasses and subproperties, domains and ranges, inverse, symmetric and transitive
    properties, and equivalences of a named class with ``someValuesFrom`` or ``minCardinality`` 1
    restrictions.  Each round applies every rule to the whole table and ends when a round adds nothing; schema
    joins are small, and a transitive property's paths double in length with each round.
    """
    schema = cut(triples.select(*COLUMNS).distinct(), "schema")
    sub_c, sub_p = closure(edges_of(schema, SUBCLASS)), closure(edges_of(schema, SUBPROPERTY))
    dom, ran = edges_of(schema, DOMAIN), edges_of(schema, RANGE)
    inverse = edges_of(schema, OWL + "inverseOf")
    inverse = inverse.unionByName(inverse.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    of_type = lambda name: edges_of(schema, RDF_TYPE).where(F.col("b") == OWL + name).select("a")
    symmetric, transitive = of_type("SymmetricProperty"), of_type("TransitiveProperty")
    on = edges_of(schema, OWL + "onProperty").select(F.col("a").alias("x"), F.col("b").alias("prop"))
    some = edges_of(schema, OWL + "someValuesFrom").select(F.col("a").alias("x"), F.col("b").alias("filler"))
    least = schema.where(F.col("p").isin(OWL + "minCardinality", OWL + "someValuesFrom") & ((F.col("o_kind") != "literal") | (F.expr("try_cast(o AS int)") == 1))).select(F.col("s").alias("x"), F.when(F.col("o_kind") == "literal", F.lit(OWL + "Thing")).otherwise(F.col("o")).alias("filler"))
    equal = edges_of(schema, OWL + "equivalentClass").select(F.col("a").alias("cls"), F.col("b").alias("x"))
    defined = cut(equal.join(on, "x").join(least.unionByName(some).distinct(), "x").select("cls", "prop", "filler"), "defined")
    iri = lambda s, p, o: [F.col(s).alias("s"), F.when(F.col(s).startswith("_:"), "bnode").otherwise("iri").alias("s_kind"), (F.col(p) if p in ("p", "b") else F.lit(p)).alias("p"), F.col(o).alias("o"), F.when(F.col(o).startswith("_:"), "bnode").otherwise("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"), F.lit(None).cast("string").alias("o_lang")]
    facts, size = schema, schema.count()
    while True:
        plain = facts.where("o_kind <> 'literal'")
        kinds = edges_of(facts, RDF_TYPE).select(F.col("a").alias("s"), F.col("b").alias("class"))
        new = [
            facts.join(sub_p, F.col("p") == F.col("a")).select("s", "s_kind", F.col("b").alias("p"), "o", "o_kind", "o_datatype", "o_lang"),
            kinds.join(sub_c, F.col("class") == F.col("a")).select("s", "b").select(*iri("s", RDF_TYPE, "b")),
            facts.join(dom, F.col("p") == F.col("a")).select("s", "b").select(*iri("s", RDF_TYPE, "b")),
            plain.join(ran, F.col("p") == F.col("a")).select(F.col("o").alias("s"), F.col("b").alias("o")).select(*iri("s", RDF_TYPE, "o")),
            plain.join(inverse, F.col("p") == F.col("a")).select(F.col("o").alias("s"), F.col("b").alias("p"), F.col("s").alias("o")).select(*iri("s", "p", "o")),
            plain.join(symmetric, F.col("p") == F.col("a")).select(F.col("o").alias("s"), "p", F.col("s").alias("o")).select(*iri("s", "p", "o")),
        ]
        held = kinds.select(F.col("s").alias("o"), "class")
        met = facts.join(small(defined), F.col("p") == F.col("prop"))
        new.append(met.where(F.col("filler") == OWL + "Thing").select("s", F.col("cls").alias("b")).select(*iri("s", RDF_TYPE, "b")))
        new.append(met.where(F.col("filler") != OWL + "Thing").join(held, "o").where(F.col("class") == F.col("filler")).select("s", F.col("cls").alias("b")).select(*iri("s", RDF_TYPE, "b")))
        steps = plain.join(transitive, F.col("p") == F.col("a"), "left_semi")
        on_ = steps.select(F.col("s").alias("via"), F.col("p").alias("same"), F.col("o").alias("end"))
        new.append(steps.join(on_, (F.col("o") == F.col("via")) & (F.col("p") == F.col("same"))).select("s", "p", F.col("end").alias("o")).select(*iri("s", "p", "o")))
        grown = facts
        for part in new:
            grown = grown.unionByName(part)
        facts = cut(grown.distinct(), "facts")
        now = facts.count()
        if now == size:
            return facts
        size = now


def contradictions(facts: DataFrame) -> DataFrame:
    """s, a, b: individuals in two disjoint classes."""
    kinds = types(facts)
    disjoint = edges_of(facts, OWL + "disjointWith")
    one = kinds.select("s", F.col("class").alias("a"))
    return one.join(disjoint, "a").join(kinds.select("s", F.col("class").alias("b")), ["s", "b"]).select("s", "a", "b").distinct()


def resolve(triples: DataFrame, name: str, kind: str = OWL + "Class") -> str:
    """The IRI of a class or property by its local name; an error if there is none."""
    found = triples.where((F.col("p") == RDF_TYPE) & (local_name("s") == name))
    best = found.orderBy(F.when(F.col("o") == kind, 0).otherwise(1), "s").select("s").first()
    if best is None:
        raise ValueError(f"the ontology has no {name}")
    return best.s


def ensure_subclass(triples: DataFrame, name: str, parent: str) -> DataFrame:
    """The triples with a class of that IRI below the parent, added only if absent."""
    row = triples.sparkSession.range(1)
    made = union(row.select(*triple(F.lit(name), RDF_TYPE, F.lit(OWL + "Class"))), row.select(*triple(F.lit(name), SUBCLASS, F.lit(parent))))
    return union(triples, made)


@dataclass(frozen=True)
class ClassAtom:
    cls: str
    var: str


@dataclass(frozen=True)
class PropertyAtom:
    prop: str
    subject: str
    value: str


@dataclass(frozen=True)
class Compare:
    op: str
    left: str
    right: str | float


@dataclass(frozen=True)
class Rule:
    body: tuple
    head: ClassAtom | PropertyAtom


#: Fixed: names of the comparison builtins.
BUILTINS = {"greaterThan": ">", "greaterThanOrEqual": ">=", "lessThan": "<", "lessThanOrEqual": "<=", "equal": "=", "notEqual": "<>"}


def parse_rule(text: str, names: dict[str, str]) -> Rule:
    """A rule such as ``Person(?p), age(?p, ?a), greaterThan(?a, 60) -> OldPerson(?p)``; ``names`` gives IRIs."""
    import re

    def atom(name: str, args: list[str]):
        if name in BUILTINS:
            right = args[1]
            return Compare(BUILTINS[name], args[0], right if right.startswith("?") else float(right))
        return ClassAtom(names[name], args[0]) if len(args) == 1 else PropertyAtom(names[name], args[0], args[1])

    def side(part: str) -> list:
        return [atom(m[1], [a.strip() for a in m[2].split(",")]) for m in re.finditer(r"([\w-]+)\s*\(([^)]*)\)", part)]

    body, arrow, head = text.partition("->")
    if not arrow or len(side(head)) != 1:
        raise ValueError(f"no rule: {text}")
    return Rule(tuple(side(body)), side(head)[0])


def apply_rule(triples: DataFrame, rule: Rule) -> DataFrame:
    """The rule's new triples: atoms are joined on shared variables, comparisons filter numerically.

    Class atoms hold for inherited classes.
    """
    kinds = types(triples)
    out: DataFrame | None = None

    def join(df: DataFrame) -> None:
        nonlocal out
        out = df if out is None else out.join(df, [c for c in df.columns if c in out.columns])

    for a in rule.body:
        if isinstance(a, ClassAtom):
            join(kinds.where(F.col("class") == a.cls).select(F.col("s").alias(a.var)))
        elif isinstance(a, PropertyAtom):
            rows = triples.where(F.col("p") == a.prop)
            if a.value.startswith("?"):
                join(rows.select(F.col("s").alias(a.subject), F.col("o").alias(a.value)))
            else:
                join(rows.where(F.col("o") == a.value).select(F.col("s").alias(a.subject)))
    for a in rule.body:
        if isinstance(a, Compare):
            number = lambda v: F.lit(v) if isinstance(v, float) else F.expr(f"try_cast(`{v}` AS double)")
            left, right = number(a.left), number(a.right)
            out = out.where({">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right, "=": left == right, "<>": left != right}[a.op])
    h = rule.head
    if isinstance(h, ClassAtom):
        return out.select(*triple(F.col(f"`{h.var}`"), RDF_TYPE, F.lit(h.cls))).distinct()
    return out.select(*triple(F.col(f"`{h.subject}`"), h.prop, F.col(f"`{h.value}`"))).distinct()


def apply_rules(triples: DataFrame, rules: list[Rule]) -> DataFrame:
    """The triples with what the rules add, until nothing is new."""
    facts = cut(triples.select(*COLUMNS).distinct(), "rules")
    size = facts.count()
    while True:
        facts = cut(union(facts, *(apply_rule(facts, r) for r in rules)), "rules")
        now = facts.count()
        if now == size:
            return facts
        size = now


def max_number(triples: DataFrame, prop: str) -> DataFrame:
    """s, value: the largest numeric value of a property; other values are ignored."""
    number: Column = F.expr("try_cast(o AS double)")
    return triples.where(F.col("p") == prop).groupBy("s").agg(F.max(number).alias("value")).where("value is not null")


def old_individuals(triples: DataFrame, person: str, age: str, over: float = 60) -> DataFrame:
    """s, value: the manual form of the age rule, over the class and all below it."""
    people = types(triples).where(F.col("class") == person).select("s").distinct()
    return people.join(max_number(triples, age), "s").where(F.col("value") > over)


def report(triples: DataFrame, old: DataFrame) -> dict:
    """Counts and names for the reasoning report; the individuals of an ontology are few."""
    names = sorted((r.name, r.value) for r in old.select(local_name("s").alias("name"), "value").collect())
    return {"triples": triples.count(), "old_count": len(names), "old": [{"name": n, "age": v} for n, v in names]}


def report_text(data: dict) -> str:
    lines = [f"Triples: {data['triples']}", f"Individuals above the threshold: {data['old_count']}"]
    return "\n".join(lines + [f"- {x['name']}: {x['age']:g}" for x in data["old"]]) + "\n"
