"""RDF sources and sinks: N-Triples by expressions, Turtle and RDF/XML by parsers of one file a row."""

from __future__ import annotations

import re
import sys
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.terms import COLUMNS, RDF_TYPE, TRIPLES, XSD

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
NT = r'^\s*(?:<([^>]*)>|(_:\S+))\s+<([^>]*)>\s+(?:<([^>]*)>|(_:\S+)|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?)\s*\.\s*(?:#.*)?$'

#: Fixed: escapes of strings.
ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def _unescape(text: str) -> str:
    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else ESCAPES.get(m[3], m[3]), text)


def _plain(c: Column) -> Column:
    """Undoes the escapes of a literal, natively; numeric escapes are left to the file parsers."""
    out = F.replace(c, F.lit("\\\\"), F.lit("\u0000"))
    for mark, char in (("t", "\t"), ("n", "\n"), ("r", "\r"), ('"', '"')):
        out = F.replace(out, F.lit("\\" + mark), F.lit(char))
    return F.replace(out, F.lit("\u0000"), F.lit("\\"))


def parse_ntriples(lines: DataFrame, value: str = "value") -> DataFrame:
    """Triples of N-Triples lines; blank lines and comments are skipped, other lines that don't parse are an error."""
    g = lambda i: F.nullif(F.regexp_extract(value, NT, i), F.lit(""))
    rows = lines.where(~F.col(value).rlike(r"^\s*(#.*)?$"))
    literal = _plain(F.regexp_extract(value, NT, 6))
    ok = rows.withColumn("__p", F.when(F.col(value).rlike(NT), g(3)).otherwise(F.raise_error(F.concat(F.lit("no triple: "), F.col(value))).cast("string")))
    iri, bnode = g(4), g(5)
    kind = F.when(iri.isNotNull(), F.lit("iri")).when(bnode.isNotNull(), F.lit("bnode")).otherwise(F.lit("literal"))
    return ok.select(
        F.coalesce(g(1), g(2)).alias("s"),
        F.when(g(1).isNotNull(), F.lit("iri")).otherwise(F.lit("bnode")).alias("s_kind"),
        F.col("__p").alias("p"),
        F.coalesce(iri, bnode, literal).alias("o"),
        kind.alias("o_kind"),
        g(7).alias("o_datatype"),
        g(8).alias("o_lang"),
    )


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    return parse_ntriples(spark.read.text(path)).distinct()


def _literal() -> Column:
    quoted = F.col("o")
    for char, mark in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        quoted = F.replace(quoted, F.lit(char), F.lit(mark))
    tail = F.when(F.col("o_datatype").isNotNull(), F.concat(F.lit("^^<"), F.col("o_datatype"), F.lit(">"))).when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), F.col("o_lang"))).otherwise(F.lit(""))
    return F.concat(F.lit('"'), quoted, F.lit('"'), tail)


def term(value: str, kind: str) -> Column:
    return F.when(F.col(kind) == "iri", F.concat(F.lit("<"), F.col(value), F.lit(">"))).when(F.col(kind) == "bnode", F.col(value)).otherwise(_literal())


def to_ntriples(triples: DataFrame) -> DataFrame:
    """value: one line a triple."""
    return triples.select(F.concat_ws(" ", term("s", "s_kind"), F.concat(F.lit("<"), F.col("p"), F.lit(">")), term("o", "o_kind"), F.lit(".")).alias("value"))


def write_ntriples(triples: DataFrame, path: str) -> None:
    to_ntriples(triples).write.mode("overwrite").text(path)


def to_turtle(triples: DataFrame) -> DataFrame:
    """value: one statement a subject, its predicates in order.

    A subject with very many triples makes a long row; ``to_ntriples`` has no such rows.
    """
    parts = triples.select(term("s", "s_kind").alias("subject"), F.when(F.col("p") == RDF_TYPE, F.lit("a")).otherwise(F.concat(F.lit("<"), F.col("p"), F.lit(">"))).alias("predicate"), term("o", "o_kind").alias("object"))
    objects = parts.groupBy("subject", "predicate").agg(F.array_join(F.array_sort(F.collect_set("object")), ", ").alias("objects"))
    lines = objects.groupBy("subject").agg(F.array_sort(F.collect_list(F.concat_ws(" ", "predicate", "objects"))).alias("lines"))
    return lines.select(F.concat(F.col("subject"), F.lit(" "), F.array_join("lines", " ;\n    "), F.lit(" .")).alias("value"))


def write_turtle(triples: DataFrame, path: str) -> None:
    to_turtle(triples).write.mode("overwrite").text(path)


TOKEN = re.compile(
    r"""\s+|\#[^\n]*
    |(?P<iri><[^<>"{}|^`\\\s]*>)
    |(?P<long>\"\"\"(?:(?:\"|\"\")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*''')
    |(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<prefix>@prefix|@base|PREFIX\b|BASE\b)
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<bnode>_:[\w.-]*\w)
    |(?P<number>[+-]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?(?![\w:]))
    |(?P<name>[\w-]*(?:\.[\w-]+)*:(?:[\w:%-]|\\.|\.(?=[\w:%-]))*)
    |(?P<word>true\b|false\b|a\b)
    |(?P<mark>\^\^|[.;,\[\]()])""",
    re.VERBOSE,
)


class Turtle:
    """A reader of Turtle: prefixes, lists of predicates and objects, literals, blank nodes and collections."""

    def __init__(self, text: str, base: str = "", tag: str = ""):
        self.items: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise ValueError(f"Turtle: unexpected {text[at : at + 40]!r}")
            if m.lastgroup:
                self.items.append((m.lastgroup, m[0]))
            at = m.end()
        self.at, self.base, self.tag, self.fresh = 0, base, tag, 0
        self.prefixes: dict[str, str] = {}
        self.out: list[tuple] = []

    def peek(self) -> tuple[str, str]:
        return self.items[self.at] if self.at < len(self.items) else ("end", "")

    def take(self, text: str | None = None) -> tuple[str, str]:
        kind, got = self.peek()
        if text is not None and got != text or kind == "end":
            raise ValueError(f"Turtle: expected {text or 'a term'}, found {got or 'the end'}")
        self.at += 1
        return kind, got

    def resolve(self, iri: str) -> str:
        return iri if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", iri) else self.base + iri

    def blank(self) -> str:
        self.fresh += 1
        return f"_:{self.tag}g{self.fresh}"

    def parse(self) -> list[tuple]:
        while self.peek()[0] != "end":
            kind, text = self.peek()
            if kind == "prefix":
                self.take()
                if text.lower().endswith("prefix"):
                    name = self.take()[1][:-1]
                    self.prefixes[name] = self.resolve(_unescape(self.take()[1][1:-1]))
                else:
                    self.base = _unescape(self.take()[1][1:-1])
                if text.startswith("@"):
                    self.take(".")
                continue
            alone = text == "["
            subject = self.node()
            if not (alone and self.peek()[1] == "."):
                self.predicates(subject)
            self.take(".")
        return self.out

    def predicates(self, subject: tuple) -> None:
        while True:
            if self.peek()[1] in (".", "]"):
                return
            p = RDF_TYPE if self.peek() == ("word", "a") and self.take() else self.node()[0]
            self.object(subject, p)
            while self.peek()[1] == ",":
                self.take()
                self.object(subject, p)
            if self.peek()[1] != ";":
                return
            while self.peek()[1] == ";":
                self.take()

    def object(self, subject: tuple, p: str) -> None:
        self.out.append((subject[0], subject[1], p, *self.node()))

    def node(self) -> tuple[str, str, str | None, str | None]:
        kind, text = self.take()
        if kind == "iri":
            return self.resolve(_unescape(text[1:-1])), "iri", None, None
        if kind == "name":
            prefix, _, local = text.partition(":")
            if prefix not in self.prefixes:
                raise ValueError(f"Turtle: unknown prefix {prefix}:")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local), "iri", None, None
        if kind == "bnode":
            return "_:" + self.tag + text[2:], "bnode", None, None
        if kind in ("string", "long"):
            value = _unescape(text[3:-3] if kind == "long" else text[1:-1])
            if self.peek()[0] == "lang":
                return value, "literal", None, self.take()[1][1:]
            if self.peek()[1] == "^^":
                self.take()
                return value, "literal", self.node()[0], None
            return value, "literal", None, None
        if kind == "number":
            return text, "literal", XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer"), None
        if kind == "word" and text != "a":
            return text, "literal", XSD + "boolean", None
        if text == "[":
            made = (self.blank(), "bnode", None, None)
            self.predicates(made)
            self.take("]")
            return made
        if text == "(":
            items = []
            while self.peek()[1] != ")":
                items.append(self.node())
            self.take(")")
            head = (RDF + "nil", "iri", None, None)
            for item in reversed(items):
                link = (self.blank(), "bnode", None, None)
                self.out += [(link[0], link[1], RDF + "first", *item), (link[0], link[1], RDF + "rest", *head)]
                head = link
            return head
        raise ValueError(f"Turtle: unexpected {text}")


def parse_rdf_xml(text: str, base: str = "", tag: str = "") -> list[tuple]:
    """Triples of RDF/XML: typed nodes, property elements and attributes, resources, nested nodes, collections."""
    root, out, fresh = ET.fromstring(text), [], [0]
    lang_key, base_key = "{http://www.w3.org/XML/1998/namespace}lang", "{http://www.w3.org/XML/1998/namespace}base"
    name = lambda tag: tag[1:].replace("}", "", 1) if tag.startswith("{") else tag

    def full(iri: str, at: str) -> str:
        if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", iri):
            return iri
        return at.partition("#")[0] + iri if iri.startswith("#") or not iri else at.rsplit("/", 1)[0] + "/" + iri

    def blank() -> str:
        fresh[0] += 1
        return f"_:{tag}x{fresh[0]}"

    def node(e: ET.Element, at: str, lang: str | None) -> tuple[str, str]:
        at, lang = e.get(base_key, at), e.get(lang_key, lang)
        if (about := e.get(f"{{{RDF}}}about")) is not None:
            me = (full(about, at), "iri")
        elif (ident := e.get(f"{{{RDF}}}ID")) is not None:
            me = (full("#" + ident, at), "iri")
        else:
            me = (f"_:{tag}{e.get(f'{{{RDF}}}nodeID')}" if e.get(f"{{{RDF}}}nodeID") else blank(), "bnode")
        if name(e.tag) != RDF + "Description":
            out.append((*me, RDF_TYPE, name(e.tag), "iri", None, None))
        for k, v in e.attrib.items():
            if not k.startswith((f"{{{RDF}}}", "{http://www.w3.org/XML/1998/namespace}")):
                out.append((*me, name(k), v, "literal", None, lang))
        for child in e:
            prop(me, child, at, lang)
        return me

    def prop(me: tuple[str, str], e: ET.Element, at: str, lang: str | None) -> None:
        at, lang, p = e.get(base_key, at), e.get(lang_key, lang), name(e.tag)
        how = e.get(f"{{{RDF}}}parseType")
        if (resource := e.get(f"{{{RDF}}}resource")) is not None:
            out.append((*me, p, full(resource, at), "iri", None, None))
        elif ref := e.get(f"{{{RDF}}}nodeID"):
            out.append((*me, p, f"_:{tag}{ref}", "bnode", None, None))
        elif how == "Collection":
            head = (RDF + "nil", "iri")
            for item in reversed([node(x, at, lang) for x in e]):
                link = (blank(), "bnode")
                out.extend([(*link, RDF + "first", *item, None, None), (*link, RDF + "rest", *head, None, None)])
                head = link
            out.append((*me, p, *head, None, None))
        elif how == "Resource":
            inner = (blank(), "bnode")
            out.append((*me, p, *inner, None, None))
            for x in e:
                prop(inner, x, at, lang)
        elif len(e):
            for x in e:
                out.append((*me, p, *node(x, at, lang), None, None))
        else:
            datatype = e.get(f"{{{RDF}}}datatype")
            out.append((*me, p, e.text or "", "literal", datatype, None if datatype else lang))

    start = root.get(base_key, base)
    for e in root if name(root.tag) == RDF + "RDF" else [root]:
        node(e, start, root.get(lang_key))
    return out


def _parsed(kind: str):
    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pandas as pd

        for batch in batches:
            for path, text in zip(batch["path"], batch["text"], strict=True):
                tag = hashlib.sha256(path.encode()).hexdigest()[:8]  # blank nodes of files stay apart
                rows = Turtle(text, tag=tag).parse() if kind == "turtle" else parse_rdf_xml(text, tag=tag)
                yield pd.DataFrame(rows, columns=list(COLUMNS))

    return run


def _read_files(spark: SparkSession, paths: str | list[str], kind: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", F.col("content").cast("string").alias("text")).mapInPandas(_parsed(kind), TRIPLES).distinct()


def read_turtle(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The set union of Turtle files; a file is parsed whole by one task, files in parallel."""
    return _read_files(spark, paths, "turtle")


def read_rdf_xml(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return _read_files(spark, paths, "xml")


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """A graph by its suffix: .nt, .owl or .rdf or .xml, else Turtle."""
    if path.endswith(".nt"):
        return read_ntriples(spark, path)
    return read_rdf_xml(spark, path) if path.endswith((".owl", ".rdf", ".xml")) else read_turtle(spark, path)


def to_rdf_xml(triples: DataFrame) -> str:
    """RDF/XML of a graph of the size of an ontology: its rows are collected."""
    from xml.sax.saxutils import escape, quoteattr

    rows = sorted({tuple(r[c] for c in COLUMNS) for r in triples.select(*COLUMNS).collect()}, key=str)
    spaces: dict[str, str] = {RDF: "rdf"}
    out, subject = [], None

    def split(iri: str) -> str:
        m = re.match(r"(.*?)([A-Za-z_][\w.-]*)$", iri)
        if not m:
            raise ValueError(f"no XML name at the end of {iri}")
        cut = max(iri.rfind("#"), iri.rfind("/")) + 1
        space, local = (iri[:cut], iri[cut:]) if cut and re.match(r"[A-Za-z_]", iri[cut:]) else (m[1], m[2])
        return f"{spaces.setdefault(space, f'ns{len(spaces)}')}:{local}"

    for s, s_kind, p, o, o_kind, datatype, lang in rows:
        if s != subject:
            out += ["</rdf:Description>"] * (subject is not None) + [f"<rdf:Description rdf:{'about' if s_kind == 'iri' else 'nodeID'}={quoteattr(s.removeprefix('_:'))}>"]
            subject = s
        tag = split(p)
        if o_kind == "literal":
            extra = f" rdf:datatype={quoteattr(datatype)}" if datatype else f" xml:lang={quoteattr(lang)}" if lang else ""
            out.append(f"<{tag}{extra}>{escape(o)}</{tag}>")
        else:
            out.append(f"<{tag} rdf:{'resource' if o_kind == 'iri' else 'nodeID'}={quoteattr(o.removeprefix('_:'))}/>")
    out += ["</rdf:Description>"] * (subject is not None)
    head = " ".join(f'xmlns:{v}="{k}"' for k, v in spaces.items())
    return "\n".join(['<?xml version="1.0"?>', f"<rdf:RDF {head}>", *out, "</rdf:RDF>", ""])


def iri_triples(triples: DataFrame, required: bool = False) -> DataFrame:
    """h, r, t: the triples between IRIs, each once, in order; none at all is an error if ``required``."""
    out = triples.where((F.col("s_kind") == "iri") & (F.col("o_kind") == "iri")).select(F.col("s").alias("h"), F.col("p").alias("r"), F.col("o").alias("t")).distinct().orderBy("h", "r", "t")
    if required and out.isEmpty():
        raise ValueError("no triple between IRIs")
    return out
