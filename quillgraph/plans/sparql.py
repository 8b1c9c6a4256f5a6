"""A subset of SPARQL compiled to DataFrames over a triple table.

Supported: PREFIX and BASE; SELECT [DISTINCT], ASK, CONSTRUCT, DESCRIBE; basic graph patterns with ``;`` and
``,`` lists and ``a``; property paths of ``/ | ^ * + ?`` and brackets; subqueries; FILTER, OPTIONAL, UNION,
MINUS, VALUES, BIND; GROUP BY with COUNT, SUM, AVG, MIN, MAX, SAMPLE, expressions over them, and HAVING;
ORDER BY, LIMIT, OFFSET.  GRAPH, SERVICE and negated paths raise ``Unsupported``.

Constants and filters reach the scans of their pattern, patterns join on shared variables in an order that
keeps every step connected, and Catalyst does the rest.  A variable is a struct of value, kind, datatype
and language; joins compare value and kind.  LIMIT without ORDER BY takes the first rows of a total order.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.terms import RDF_TYPE, XSD
from quillgraph.operators.rules import closure
from quillgraph.operators.stage import cut


class Unsupported(ValueError):
    pass


TOKEN = re.compile(
    r"""\s+|\#[^\n]*
    |(?P<iri><[^<>"{}|^`\\\s]*>)
    |(?P<var>[?$]\w+)
    |(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<number>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)
    |(?P<name>[A-Za-z_][\w-]*(?:\.[\w-]+)*:(?:[\w%-]|\\.|\.(?=[\w-]))*|:(?:[\w%-]|\.(?=[\w-]))*)
    |(?P<word>[A-Za-z_]\w*)
    |(?P<mark>\^\^|&&|\|\||!=|<=|>=|[{}().;,=<>!+*/\[\]|^?-])""",
    re.VERBOSE,
)


@dataclass(frozen=True)
class Term:
    """A constant."""

    value: str
    kind: str = "iri"
    datatype: str | None = None
    lang: str | None = None


@dataclass(frozen=True)
class Var:
    name: str


@dataclass
class Group:
    triples: list = field(default_factory=list)
    filters: list = field(default_factory=list)
    parts: list = field(default_factory=list)  # (kind, ...) in order


@dataclass
class Query:
    form: str = "SELECT"
    distinct: bool = False
    items: list = field(default_factory=list)  # (name, expression or None)
    where: Group = field(default_factory=Group)
    group: list = field(default_factory=list)
    having: list = field(default_factory=list)
    order: list = field(default_factory=list)  # (expression, descending)
    limit: int | None = None
    offset: int = 0
    template: list = field(default_factory=list)  # of CONSTRUCT
    described: list = field(default_factory=list)  # terms of DESCRIBE


AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE")


class Parser:
    def __init__(self, text: str):
        self.items, at = [], 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise ValueError(f"SPARQL: unexpected {text[at : at + 30]!r}")
            if m.lastgroup:
                self.items.append((m.lastgroup, m[0]))
            at = m.end()
        self.at, self.prefixes, self.base = 0, {}, ""
        self.fresh = 0

    def peek(self) -> tuple[str, str]:
        return self.items[self.at] if self.at < len(self.items) else ("end", "")

    def is_word(self, *words: str) -> bool:
        kind, text = self.peek()
        return kind == "word" and text.upper() in words

    def accept(self, text: str) -> bool:
        if self.peek()[1].upper() == text and self.peek()[0] in ("word", "mark"):
            self.at += 1
            return True
        return False

    def expect(self, text: str) -> None:
        if not self.accept(text):
            raise ValueError(f"SPARQL: expected {text}, found {self.peek()[1] or 'the end'}")

    def next(self) -> tuple[str, str]:
        got = self.peek()
        if got[0] == "end":
            raise ValueError("SPARQL: unexpected end")
        self.at += 1
        return got

    def query(self) -> Query:
        q = Query()
        while self.is_word("PREFIX", "BASE"):
            if self.next()[1].upper() == "BASE":
                self.base = self.next()[1][1:-1]
            else:
                name = self.next()[1]
                self.prefixes[name[:-1]] = self.next()[1][1:-1]
        return self.body(q)

    def body(self, q: Query) -> Query:
        """From the query's form on; a subquery ends at its group's closing bracket."""
        q.form = self.next()[1].upper()
        if q.form not in ("SELECT", "ASK", "CONSTRUCT", "DESCRIBE"):
            raise Unsupported(f"{q.form} queries")
        if q.form == "CONSTRUCT":
            if self.peek()[1] == "{":
                q.template = self.group().triples
        elif q.form == "DESCRIBE":
            while self.peek()[0] in ("var", "iri", "name"):
                q.described.append(self.term())
            if self.peek()[0] == "end":
                return q
        elif q.form == "SELECT":
            q.distinct = self.accept("DISTINCT") or self.accept("REDUCED")
            if self.accept("*"):
                q.items = []
            else:
                while self.peek()[0] == "var" or self.peek()[1] == "(":
                    q.items.append(self.item())
        self.accept("WHERE")
        q.where = self.group()
        if q.form == "CONSTRUCT" and not q.template:
            q.template = q.where.triples
        while self.peek()[0] != "end" and self.peek()[1] != "}":
            if self.accept("GROUP"):
                self.expect("BY")
                while self.peek()[0] == "var" or self.peek()[1] == "(":
                    q.group.append(self.item())
            elif self.accept("HAVING"):
                while self.peek()[1] == "(":
                    q.having.append(self.bracketed())
            elif self.accept("ORDER"):
                self.expect("BY")
                while True:
                    if self.is_word("ASC", "DESC"):
                        down = self.next()[1].upper() == "DESC"
                        q.order.append((self.bracketed(), down))
                    elif self.peek()[0] == "var" or self.peek()[1] == "(" or self.is_word(*AGGREGATES, "STR", "LCASE", "UCASE", "STRLEN"):
                        q.order.append((self.primary(), False))
                    else:
                        break
            elif self.accept("LIMIT"):
                q.limit = int(self.next()[1])
            elif self.accept("OFFSET"):
                q.offset = int(self.next()[1])
            else:
                raise ValueError(f"SPARQL: unexpected {self.peek()[1]}")
        return q

    def item(self) -> tuple:
        if self.accept("("):
            e = self.expression()
            if self.accept("AS"):
                name = self.next()[1][1:]
            else:
                self.fresh += 1
                name = f"_g{self.fresh}"
            self.expect(")")
            return name, e
        return self.next()[1][1:], None

    def bracketed(self):
        self.expect("(")
        e = self.expression()
        self.expect(")")
        return e

    def group(self) -> Group:
        self.expect("{")
        g = Group()
        while not self.accept("}"):
            if self.accept("FILTER"):
                if self.is_word("EXISTS", "NOT"):
                    no = self.accept("NOT")
                    self.expect("EXISTS")
                    g.parts.append(("exists", self.group(), not no))
                else:
                    g.filters.append(self.primary())
            elif self.accept("OPTIONAL"):
                g.parts.append(("optional", self.group()))
            elif self.accept("MINUS"):
                g.parts.append(("minus", self.group()))
            elif self.accept("BIND"):
                self.expect("(")
                e = self.expression()
                self.expect("AS")
                g.parts.append(("bind", e, self.next()[1][1:]))
                self.expect(")")
            elif self.accept("VALUES"):
                g.parts.append(("values", *self.values()))
            elif self.is_word("GRAPH", "SERVICE"):
                raise Unsupported(self.peek()[1])
            elif self.is_word("SELECT"):  # a group that is a subquery
                g.parts.append(("query", self.body(Query())))
            elif self.peek()[1] == "{":
                branches = [self.group()]
                while self.accept("UNION"):
                    branches.append(self.group())
                g.parts.append(("union", branches))
            else:
                self.triples(g)
            self.accept(".")
        return g

    def values(self) -> tuple[list[str], list[list]]:
        if self.peek()[0] == "var":
            names, single = [self.next()[1][1:]], True
        else:
            self.expect("(")
            names, single = [], False
            while not self.accept(")"):
                names.append(self.next()[1][1:])
        self.expect("{")
        rows = []
        while not self.accept("}"):
            if single:
                rows.append([self.value()])
            else:
                self.expect("(")
                row = []
                while not self.accept(")"):
                    row.append(self.value())
                rows.append(row)
        return names, rows

    def value(self):
        return None if self.accept("UNDEF") else self.term()

    def term(self):
        kind, text = self.next()
        if kind == "var":
            return Var(text[1:])
        if kind == "iri":
            iri = text[1:-1]
            return Term(iri if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", iri) else self.base + iri)
        if kind == "name":
            prefix, _, local = text.partition(":")
            if prefix == "_":
                return Var("_:" + local)
            if prefix not in self.prefixes:
                raise ValueError(f"SPARQL: unknown prefix {prefix}:")
            return Term(self.prefixes[prefix] + local.replace("\\", ""))
        if kind == "string":
            value = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), text[1:-1])
            if self.peek()[0] == "lang":
                return Term(value, "literal", None, self.next()[1][1:])
            if self.accept("^^"):
                return Term(value, "literal", self.term().value)
            return Term(value, "literal")
        if kind == "number":
            return Term(text, "literal", XSD + ("integer" if text.isdigit() else "decimal"))
        if kind == "word" and text.lower() in ("true", "false"):
            return Term(text.lower(), "literal", XSD + "boolean")
        if text == "-" and self.peek()[0] == "number":
            t = self.term()
            return Term("-" + t.value, "literal", t.datatype)
        raise ValueError(f"SPARQL: unexpected {text}")

    def triples(self, g: Group) -> None:
        s = self.term()
        while True:
            p = self.term() if self.peek()[0] == "var" else self.path()
            while True:
                g.triples.append((s, p, self.term()))
                if not self.accept(","):
                    break
            if not self.accept(";"):
                return
            while self.accept(";"):
                pass
            if self.peek()[1] in (".", "}"):
                return

    def path(self):
        """A property, or a tuple of an operator and paths."""
        out = [self.path_sequence()]
        while self.accept("|"):
            out.append(self.path_sequence())
        return out[0] if len(out) == 1 else ("|", *out)

    def path_sequence(self):
        out = [self.path_element()]
        while self.accept("/"):
            out.append(self.path_element())
        return out[0] if len(out) == 1 else ("/", *out)

    def path_element(self):
        if self.accept("^"):
            return ("^", self.path_element())
        if self.accept("("):
            out = self.path()
            self.expect(")")
        elif self.peek() == ("word", "a"):
            self.next()
            out = Term(RDF_TYPE)
        elif self.peek()[1] == "!":
            raise Unsupported("negated property paths")
        else:
            out = self.term()
        for mark in ("*", "+", "?"):
            if self.accept(mark):
                return (mark, out)
        return out

    def expression(self):
        e = self.conjunction()
        while self.accept("||"):
            e = ("||", e, self.conjunction())
        return e

    def conjunction(self):
        e = self.comparison()
        while self.accept("&&"):
            e = ("&&", e, self.comparison())
        return e

    def comparison(self):
        e = self.sum()
        for op in ("!=", "<=", ">=", "=", "<", ">"):
            if self.accept(op):
                return (op, e, self.sum())
        no = self.is_word("NOT") and self.accept("NOT")
        if self.accept("IN"):
            self.expect("(")
            options = [self.expression()]
            while self.accept(","):
                options.append(self.expression())
            self.expect(")")
            found = reduce(lambda a, b: ("||", a, b), [("=", e, o) for o in options])
            return ("!", found) if no else found
        return e

    def sum(self):
        e = self.product()
        while self.peek()[1] in ("+", "-") and self.peek()[0] == "mark":
            e = (self.next()[1], e, self.product())
        return e

    def product(self):
        e = self.primary()
        while self.peek()[1] in ("*", "/") and self.peek()[0] == "mark":
            e = (self.next()[1], e, self.primary())
        return e

    def primary(self):
        if self.accept("!"):
            return ("!", self.primary())
        if self.peek()[1] == "(":
            return self.bracketed()
        kind, text = self.peek()
        if kind == "word" and text.lower() not in ("true", "false"):
            name = self.next()[1].upper()
            self.expect("(")
            distinct = self.accept("DISTINCT")
            args = []
            if self.accept("*"):
                args = ["*"]
            elif self.peek()[1] != ")":
                args = [self.expression()]
                while self.accept(","):
                    args.append(self.expression())
            self.expect(")")
            return ("call", name, distinct, *args)
        if kind == "name":
            iri = self.term()
            if self.peek()[1] == "(" and isinstance(iri, Term):
                return ("call", "CAST", False, iri, self.bracketed())
            return iri
        return self.term()


def _struct(value: Column, kind: Column | str, datatype: Column | None = None, lang: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(value.cast("string").alias("v"), (F.lit(kind) if isinstance(kind, str) else kind).alias("k"), (none if datatype is None else datatype).alias("d"), (none if lang is None else lang).alias("l"))


def _constant(t: Term) -> Column:
    return _struct(F.lit(t.value), t.kind, F.lit(t.datatype) if t.datatype else None, F.lit(t.lang) if t.lang else None)


def variables(g: Group) -> set[str]:
    out = {x.name for t in g.triples for x in t if isinstance(x, Var)}
    for part in g.parts:
        if part[0] in ("optional",):
            out |= variables(part[1])
        elif part[0] == "union":
            for b in part[1]:
                out |= variables(b)
        elif part[0] == "bind":
            out.add(part[2])
        elif part[0] == "values":
            out |= set(part[1])
        elif part[0] == "query":
            out |= {n for n, _ in part[1].items} or variables(part[1].where)
    return out


def used(e) -> set[str]:
    if isinstance(e, Var):
        return {e.name}
    return set().union(*(used(x) for x in e)) if isinstance(e, tuple) else set()


class Compiler:
    def __init__(self, triples: DataFrame):
        self.table = triples

    # expressions: ``value`` gives a struct, ``truth`` a boolean column

    def value(self, e) -> Column:
        if isinstance(e, Var):
            return F.col(f"`{e.name}`")
        if isinstance(e, Term):
            return _constant(e)
        if e[0] == "call" and e[1] in ("STR", "LCASE", "UCASE", "LANG", "DATATYPE", "IF", "COALESCE", "CONCAT", "REPLACE", "SUBSTR", "IRI", "URI", "CAST", "ABS", "STRLEN", "STRAFTER", "STRBEFORE"):
            return self.function(e[1], e[3:])
        if e[0] in ("+", "-", "*", "/"):
            a, b = self.number(e[1]), self.number(e[2])
            return _struct({"+": a + b, "-": a - b, "*": a * b, "/": F.when(b != 0, a / b)}[e[0]], "literal", F.lit(XSD + "double"))
        return _struct(self.truth(e), "literal", F.lit(XSD + "boolean"))

    def text(self, e) -> Column:
        return self.value(e)["v"]

    def number(self, e) -> Column:
        if isinstance(e, Term):
            return F.lit(float(e.value))
        if isinstance(e, tuple) and e[0] in ("+", "-", "*", "/"):
            a, b = self.number(e[1]), self.number(e[2])
            return {"+": a + b, "-": a - b, "*": a * b, "/": F.when(b != 0, a / b)}[e[0]]
        return self.text(e).try_cast("double")

    def function(self, name: str, args) -> Column:
        text = lambda i: self.text(args[i])
        plain = lambda c, t=None: _struct(c, "literal", F.lit(XSD + t) if t else None)
        if name == "STR":
            return plain(text(0))
        if name in ("IRI", "URI"):
            return _struct(text(0), "iri")
        if name == "CAST":
            return _struct(text(1), "literal", F.lit(args[0].value))
        if name == "LANG":
            return plain(F.coalesce(self.value(args[0])["l"], F.lit("")))
        if name == "DATATYPE":
            v = self.value(args[0])
            return _struct(F.when(v["k"] == "literal", F.coalesce(v["d"], F.lit(XSD + "string"))), "iri")
        if name == "IF":
            return F.when(self.truth(args[0]), self.value(args[1])).otherwise(self.value(args[2]))
        if name == "COALESCE":
            return F.coalesce(*(self.value(a) for a in args))
        if name == "CONCAT":
            return plain(F.concat(*(self.text(a) for a in args)))
        if name == "REPLACE":
            return plain(F.regexp_replace(text(0), text(1), text(2)))
        if name == "SUBSTR":
            size = self.number(args[2]).cast("int") if len(args) > 2 else F.length(text(0))
            return plain(F.substring(text(0), self.number(args[1]).cast("int"), size))
        if name == "ABS":
            return plain(F.abs(self.number(args[0])), "double")
        if name == "STRLEN":
            return plain(F.length(text(0)), "integer")
        if name == "STRAFTER":
            return plain(F.when(F.contains(text(0), text(1)), F.substring(text(0), F.locate(args[1].value, text(0)) + len(args[1].value), F.length(text(0)))).otherwise(F.lit("")))
        if name == "STRBEFORE":
            return plain(F.when(F.contains(text(0), text(1)), F.substring(text(0), F.lit(1), F.locate(args[1].value, text(0)) - 1)).otherwise(F.lit("")))
        return plain((F.lower if name == "LCASE" else F.upper)(text(0)))

    def truth(self, e) -> Column:
        if isinstance(e, (Var, Term)):
            v = self.value(e)
            return F.coalesce(~v["v"].isin("", "false", "0"), F.lit(False))
        op = e[0]
        if op == "||":
            return self.truth(e[1]) | self.truth(e[2])
        if op == "&&":
            return self.truth(e[1]) & self.truth(e[2])
        if op == "!":
            return ~self.truth(e[1])
        if op in ("=", "!=", "<", ">", "<=", ">="):
            a, b = self.value(e[1]), self.value(e[2])
            x, y = a["v"].try_cast("double"), b["v"].try_cast("double")
            numeric = lambda t: isinstance(t, Term) and t.kind == "literal" and t.datatype is not None and t.lang is None or isinstance(t, tuple) and t[0] in ("+", "-", "*", "/")
            if numeric(e[1]) or numeric(e[2]):
                both = {"=": x == y, "!=": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}
            elif op in ("=", "!="):
                same = (a["v"] == b["v"]) & (a["k"] == b["k"]) & (F.coalesce(a["l"], F.lit("")) == F.coalesce(b["l"], F.lit("")))
                both = {"=": same, "!=": ~same}
            else:
                number = x.isNotNull() & y.isNotNull()
                pick = lambda n, t: F.when(number, n).otherwise(t)
                both = {"<": pick(x < y, a["v"] < b["v"]), ">": pick(x > y, a["v"] > b["v"]), "<=": pick(x <= y, a["v"] <= b["v"]), ">=": pick(x >= y, a["v"] >= b["v"])}
            return both[op]
        if op == "call":
            name, args = e[1], e[3:]
            text = lambda i: self.text(args[i])
            if name == "CONTAINS":
                return F.contains(text(0), text(1))
            if name == "STRSTARTS":
                return F.startswith(text(0), text(1))
            if name == "STRENDS":
                return F.endswith(text(0), text(1))
            if name == "REGEX":
                flags = args[2].value if len(args) > 2 else ""
                if not isinstance(args[1], Term):
                    raise Unsupported("REGEX with a pattern that isn't a constant")
                return text(0).rlike((f"(?{flags})" if flags else "") + args[1].value)
            if name in ("ISIRI", "ISURI", "ISLITERAL", "ISBLANK"):
                return self.value(args[0])["k"] == {"ISIRI": "iri", "ISURI": "iri", "ISLITERAL": "literal", "ISBLANK": "bnode"}[name]
            if name == "BOUND":
                return self.value(args[0]).isNotNull()
            if name == "LANGMATCHES":
                lang = F.lower(text(0))
                return F.when(text(1) == "*", lang != "").otherwise((lang == F.lower(text(1))) | F.startswith(lang, F.concat(F.lower(text(1)), F.lit("-"))))
            if name in ("STR", "IF", "COALESCE", "LCASE", "UCASE", "LANG", "CONCAT", "REPLACE", "SUBSTR", "CAST", "STRLEN", "ABS"):
                v = self.value(e)
                return F.coalesce(~v["v"].isin("", "false", "0"), F.lit(False))
            raise Unsupported(f"function {name}")
        raise Unsupported(str(op))

    # patterns

    def scan(self, t: tuple) -> DataFrame:
        """One pattern: constants are filters on the table, so that they reach its files."""
        if isinstance(t[1], tuple):
            return self.path_scan(t)
        df, names = self.table, {}
        for place, x in zip(("s", "p", "o"), t, strict=True):
            if isinstance(x, Term):
                df = df.where(F.col(place) == x.value)
                if place == "o":
                    df = df.where(F.col("o_kind") == x.kind)
                    if x.lang:
                        df = df.where(F.col("o_lang") == x.lang)
            elif x.name in names:
                df = df.where(F.col(place) == F.col(names[x.name]))
            else:
                names[x.name] = place
        made = {"s": _struct(F.col("s"), F.col("s_kind")), "p": _struct(F.col("p"), "iri"), "o": _struct(F.col("o"), F.col("o_kind"), F.col("o_datatype"), F.col("o_lang"))}
        return df.select(*(made[place].alias(name) for name, place in names.items())) if names else df.select(F.lit(1).alias("__one")).limit(1)

    def path(self, p, ends: list[Term]) -> DataFrame:
        """a, b: the pairs of terms that a path joins, as JSON texts of their structs; bags but for ``* + ?``."""
        if isinstance(p, Term):
            rows = self.table.where(F.col("p") == p.value)
            return rows.select(F.to_json(_struct(F.col("s"), F.col("s_kind"))).alias("a"), F.to_json(_struct(F.col("o"), F.col("o_kind"), F.col("o_datatype"), F.col("o_lang"))).alias("b"))
        if isinstance(p, Var):
            raise Unsupported("a variable within a property path")
        parts = [self.path(x, ends) for x in p[1:]]
        if p[0] == "^":
            return parts[0].select(F.col("b").alias("a"), F.col("a").alias("b"))
        if p[0] == "|":
            return reduce(DataFrame.unionByName, parts)
        if p[0] == "/":
            step = lambda x, y: x.withColumnRenamed("b", "__m").join(y.withColumnRenamed("a", "__m"), "__m").select("a", "b")
            return reduce(step, parts)
        pairs = closure(parts[0].distinct()) if p[0] in ("*", "+") else parts[0]
        if p[0] == "+":
            return pairs.distinct()
        s, o = F.to_json(_struct(F.col("s"), F.col("s_kind"))), F.to_json(_struct(F.col("o"), F.col("o_kind"), F.col("o_datatype"), F.col("o_lang")))
        nodes = self.table.select(F.explode(F.array(s, o)).alias("a"))
        for end in ends:  # a constant reaches itself, in the graph or not
            nodes = nodes.unionByName(self.table.sparkSession.range(1).select(F.to_json(_constant(end)).alias("a")))
        return pairs.unionByName(nodes.select("a", F.col("a").alias("b"))).distinct()

    def path_scan(self, t: tuple) -> DataFrame:
        s, p, o = t
        df = self.path(p, [x for x in (s, o) if isinstance(x, Term)])
        for place, x in (("a", s), ("b", o)):
            if isinstance(x, Term):
                df = df.where(F.col(place) == F.to_json(_constant(x)))
        if isinstance(s, Var) and s == o:
            df = df.where("a = b")
        term = lambda c: F.from_json(c, "v string, k string, d string, l string")
        names = {x.name: place for place, x in (("a", s), ("b", o)) if isinstance(x, Var)}
        return df.select(*(term(place).alias(name) for name, place in names.items())) if names else df.select(F.lit(1).alias("__one")).limit(1)

    @staticmethod
    def join(a: DataFrame, b: DataFrame, how: str = "inner", sure: set[str] | None = None) -> DataFrame:
        """On shared variables; where one side may leave one unbound, an unbound one fits anything."""
        shared = [c for c in a.columns if c in b.columns and c != "__one"]
        b = b.select(*(F.col(f"`{c}`").alias(f"__b_{c}") for c in b.columns))
        on = F.lit(True)
        for c in shared:
            x, y = F.col(f"`{c}`"), F.col(f"`__b_{c}`")
            equal = (x["v"] == y["v"]) & (x["k"] == y["k"])
            on = on & (equal if sure is None or c in sure else equal | x.isNull() | y.isNull())
        out = a.join(b, on, how)
        if how in ("left_anti", "left_semi"):
            return out
        mine = [F.coalesce(F.col(f"`{c}`"), F.col(f"`__b_{c}`")).alias(c) if c in shared else F.col(f"`{c}`") for c in a.columns]
        theirs = [F.col(f"`__b_{c}`").alias(c) for c in (x[4:] for x in b.columns) if c not in a.columns]
        return out.select(*mine, *theirs)

    def group(self, g: Group) -> tuple[DataFrame, set[str]]:
        """The solutions of a group and the variables that all of them bind."""
        left, filters, out, sure = list(g.triples), list(g.filters), None, set()
        scans: list[tuple[set[str], DataFrame]] = []
        for t in left:
            names = {x.name for x in t if isinstance(x, Var)}
            df = self.scan(t)
            for f in [f for f in filters if used(f) and used(f) <= names]:
                df = df.where(self.truth(f))
            scans.append((names, df))
        values = [p for p in g.parts if p[0] == "values"]
        for _, names, rows in values:
            scans.insert(0, (set(names), self.inline(names, rows)))
        # the most bound pattern first, then always one that shares a variable
        weight = lambda i: (-sum(isinstance(x, Term) for x in left[i - len(values)]) if i >= len(values) else -9, i)
        todo = sorted(range(len(scans)), key=weight)
        while todo:
            k = next((i for i in todo if scans[i][0] & sure), todo[0])
            todo.remove(k)
            names, df = scans[k]
            out = df if out is None else self.join(out, df)
            sure |= names
        if out is None:
            out = self.table.sparkSession.range(1).select(F.lit(1).alias("__one"))
        for part in g.parts:
            if part[0] == "optional":
                inner, bound = self.group(Group(part[1].triples, [], part[1].parts))
                outer_filters = part[1].filters
                if outer_filters:
                    near = [f for f in outer_filters if used(f) <= set(inner.columns)]
                    for f in near:
                        inner = inner.where(self.truth(f))
                    if len(near) < len(outer_filters):
                        raise Unsupported("OPTIONAL filters on outer variables")
                out = self.join(out, inner, "left", sure & bound)
            elif part[0] == "union":
                made = [self.group(b) for b in part[1]]
                both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (m[0] for m in made))
                bound = set.intersection(*(m[1] for m in made))
                out = both if out.columns == ["__one"] else self.join(out, both, "inner", sure & bound)
                sure |= bound
            elif part[0] == "query":
                inner = self.solutions(part[1])
                # what a subquery leaves unbound isn't known, so its variables join as ones that may be
                out = inner if out.columns == ["__one"] else self.join(out, inner, "inner", set())
            elif part[0] == "minus":
                inner, bound = self.group(part[1])
                if set(inner.columns) & set(out.columns) - {"__one"}:
                    out = self.join(out, inner, "left_anti", sure & bound)
            elif part[0] == "exists":
                inner, bound = self.group(part[1])
                out = self.join(out, inner, "left_semi" if part[2] else "left_anti", sure & bound)
            elif part[0] == "bind":
                out = out.withColumn(part[2], self.value(part[1]))
        for f in filters:
            names = used(f)
            if not any(names and names <= s[0] for s in scans[len(values) :]):
                for n in names - set(out.columns):
                    out = out.withColumn(n, F.lit(None).cast("struct<v:string,k:string,d:string,l:string>"))
                out = out.where(self.truth(f))
        return out, sure

    def inline(self, names: list[str], rows: list[list]) -> DataFrame:
        data = [tuple(None if t is None else (t.value, t.kind, t.datatype, t.lang) for t in row) for row in rows]
        schema = ", ".join(f"`{n}` struct<v:string,k:string,d:string,l:string>" for n in names)
        return self.table.sparkSession.createDataFrame(data, schema)

    def aggregate(self, e) -> Column:
        """An aggregate expression; plain variables are group keys."""
        if isinstance(e, tuple) and e[0] == "call" and e[1] in AGGREGATES:
            name, distinct, arg = e[1], e[2], e[3]
            if name == "COUNT":
                if arg == "*":
                    return F.count("*")
                return F.countDistinct(self.text(arg)) if distinct else F.count(self.text(arg))
            number, text = self.number(arg), self.text(arg)
            if name in ("MIN", "MAX"):
                f, by = (F.min, F.min_by) if name == "MIN" else (F.max, F.max_by)
                return F.coalesce(by(text, number), f(text))
            if name == "SAMPLE":
                return F.min(text)
            f = F.sum_distinct if name == "SUM" and distinct else F.sum if name == "SUM" else F.avg
            return f(number)
        raise Unsupported("an expression over aggregates")

    def lifted(self, e, hidden: dict):
        """The expression with a variable in each aggregate's place; ``hidden`` collects these."""
        if isinstance(e, tuple):
            if e[0] == "call" and e[1] in AGGREGATES:
                return Var(hidden.setdefault(e, f"_h{len(hidden)}"))
            return tuple(self.lifted(x, hidden) for x in e)
        return e

    def solutions(self, q: Query) -> DataFrame:
        """The rows of a SELECT as structs, a column per variable."""
        df, _ = self.group(q.where)
        visible = [c for c in df.columns if not c.startswith(("_:", "__"))]
        hidden: dict = {}
        items = [(n, self.lifted(e, hidden) if e is not None else None) for n, e in q.items]
        having = [self.lifted(h, hidden) for h in q.having]
        by = [(self.lifted(e, hidden), down) for e, down in q.order]
        if q.group or hidden:
            keys = []
            for name, e in q.group:
                df = df.withColumn(name, self.value(e)) if e is not None else df
                keys.append(name)
            key = [F.col(f"`{k}`") for k in keys]
            kind = lambda e: XSD + ("integer" if e[1] == "COUNT" else "double")
            out = df.groupBy(*key).agg(*(self.aggregate(e).alias(n) for e, n in hidden.items())) if hidden else df.select(*key).distinct()
            df = out.select(*key, *(_struct(F.col(n), "literal", F.lit(kind(e))).alias(n) for e, n in hidden.items()))
            visible = keys
        for n, e in items:
            if e is not None:
                df = df.withColumn(n, self.value(e))
        for h in having:
            df = df.where(self.truth(h))
        names = [n for n, _ in items] or visible
        for n in names:
            if n not in df.columns:
                df = df.withColumn(n, F.lit(None).cast("struct<v:string,k:string,d:string,l:string>"))
        order = []
        for e, down in by:
            number, text = self.number(e), self.text(e)
            order += [number.desc_nulls_last(), text.desc_nulls_last()] if down else [number.asc_nulls_first(), text.asc_nulls_first()]
        if q.distinct:
            if order and not {v for e, _ in by for v in used(e)} <= set(names):
                raise Unsupported("ORDER BY of a variable that SELECT DISTINCT drops")
            df = df.dropDuplicates(names)
        if q.limit is not None or q.offset or order:
            df = df.orderBy(*order, *(F.col(f"`{n}`")["v"] for n in names))
            if q.offset:
                df = df.offset(q.offset)
            if q.limit is not None:
                df = df.limit(q.limit)
        return df.select(*(F.col(f"`{n}`") for n in names))

    def constructed(self, q: Query) -> DataFrame:
        """s, p, o: the template's triples for all solutions, each once; incomplete ones and literal subjects go."""
        rows = cut(self.solutions(Query(where=q.where, order=q.order, limit=q.limit, offset=q.offset)), "construct")
        made = []
        for t in q.template:
            if any(isinstance(x, tuple) for x in t):
                raise Unsupported("property paths in a template")
            some = [x for x in t if not (isinstance(x, Var) and x.name not in rows.columns)]
            if len(some) < 3:
                raise Unsupported("blank nodes and unbound variables in a template")
            s, p, o = (self.value(x) for x in t)
            made.append(rows.where((s["k"] != "literal") & (p["k"] == "iri") & o["v"].isNotNull()).select(s["v"].alias("s"), p["v"].alias("p"), o["v"].alias("o")))
        return reduce(DataFrame.unionByName, made).distinct()

    def described(self, q: Query) -> DataFrame:
        """s, p, o: all triples of the subjects named or found."""
        out = self.table.where(F.col("s").isin(*(x.value for x in q.described if isinstance(x, Term))))
        names = [x.name for x in q.described if isinstance(x, Var)]
        if names:
            found = self.solutions(Query(where=q.where, items=[(n, None) for n in names], limit=q.limit, offset=q.offset))
            some = found.select(F.explode(F.array(*(F.col(f"`{n}`")["v"] for n in names))).alias("s")).where("s is not null").distinct()
            out = out.unionByName(self.table.join(some, "s", "left_semi").select(self.table.columns))
        return out.select("s", "p", "o").distinct()

    def run(self, q: Query) -> DataFrame:
        if q.form == "ASK":
            return self.group(q.where)[0].limit(1).agg((F.count("*") > 0).alias("answer"))
        if q.form == "CONSTRUCT":
            return self.constructed(q)
        if q.form == "DESCRIBE":
            return self.described(q)
        df = self.solutions(q)
        return df.select(*(F.col(f"`{n}`")["v"].alias(n) for n in df.columns))


def parse(text: str) -> Query:
    return Parser(text).query()


def compile_query(text: str, triples: DataFrame) -> DataFrame:
    """The query's rows as strings, a column per variable; ASK gives one boolean row, CONSTRUCT and DESCRIBE triples."""
    return Compiler(triples).run(parse(text))


def literal(text: str) -> str:
    """A quoted string literal."""
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
