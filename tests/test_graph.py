import random

import pytest
from pyspark.sql import functions as F

from quillgraph.functions.terms import OWL, RDF_TYPE, RDFS, TRIPLES
from quillgraph.operators import build, embed, extract, graph, rules, stage
from quillgraph.plans import rag
from quillgraph.plans.sparql import Unsupported, compile_query, parse
from quillgraph.sources import crawl, files, rdf

TTL = """@prefix ex: <http://ex/> .
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
ex:a a ex:C, ex:D ; ex:p "x \\"y\\"\\n"@en , 5 , 1.5 , true ; ex:q [ ex:r ex:b ] .  # a comment
ex:b ex:list ( ex:a "z"^^xsd:string ) .
_:n ex:p '''long
text''' .
"""


def keys(df):
    return {(r.s, r.p, r.o, r.o_kind, r.o_datatype, r.o_lang) for r in df.collect()}


def test_turtle_and_round_trips(spark, tmp_path):
    path = tmp_path / "g.ttl"
    path.write_text(TTL)
    g = rdf.read_graph(spark, str(path))
    got = keys(g)
    assert ("http://ex/a", "http://ex/p", 'x "y"\n', "literal", None, "en") in got
    assert ("http://ex/a", "http://ex/p", "5", "literal", "http://www.w3.org/2001/XMLSchema#integer", None) in got
    assert g.where(F.col("p").endswith("first")).count() == 2 and len(got) == 14
    for write, suffix in ((rdf.write_ntriples, "nt"), (rdf.write_turtle, "out")):
        write(g, str(tmp_path / f"x.{suffix}"))
    assert keys(rdf.read_ntriples(spark, str(tmp_path / "x.nt"))) == got
    lines = "\n".join(r.value for r in rdf.to_turtle(g.where("s_kind = 'iri' and o_kind <> 'bnode'")).collect())
    (tmp_path / "again.ttl").write_text(lines)
    assert keys(rdf.read_turtle(spark, str(tmp_path / "again.ttl"))) == keys(g.where("s_kind = 'iri' and o_kind <> 'bnode'"))
    xml = tmp_path / "x.rdf"
    xml.write_text(rdf.to_rdf_xml(g.where("s_kind = 'iri' and o_kind <> 'bnode'")))
    assert keys(rdf.read_graph(spark, str(xml))) == keys(g.where("s_kind = 'iri' and o_kind <> 'bnode'"))
    with pytest.raises(ValueError):
        rdf.Turtle("a b c .").parse()


def test_files(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\tb\tc\n\nd\te\tf\n")
    assert files.read_triples_tsv(spark, str(tmp_path / "t.tsv")).count() == 2
    (tmp_path / "bad.tsv").write_text("a\tb\n")
    with pytest.raises(Exception, match="not three fields"):
        files.read_triples_tsv(spark, str(tmp_path / "bad.tsv")).collect()
    (tmp_path / "e.csv").write_text("entity_text,entity_type\nx,y\n")
    with pytest.raises(ValueError, match="entity_normalized, example_sentence, mention_count, source_url"):
        files.read_entities(spark, str(tmp_path / "e.csv"))
    (tmp_path / "s.txt").write_text("# c\n\n http://a/ \n")
    assert [r.url for r in crawl.read_seeds(spark, str(tmp_path / "s.txt")).collect()] == ["http://a/"]
    (tmp_path / "n.txt").write_text("# c\n")
    with pytest.raises(ValueError):
        crawl.read_seeds(spark, str(tmp_path / "n.txt"))


def test_crawl(spark):
    site = {"http://a/robots.txt": "User-agent: *\nDisallow: /no", "http://a/yes": "<title>T</title><p>" + "word " * 20 + "</p>", "http://a/no": "<p>x</p>"}

    def fetch(url):
        return (url, 200, site[url]) if url in site else None

    pages = crawl.fetch_pages(spark.createDataFrame([("http://a/yes",), ("http://a/no",), ("http://b/gone",)], "url string"), fetch, delay=0).cache()
    assert {(r.url, r.allowed_by_robots, r.html is not None) for r in pages.collect()} == {("http://a/yes", True, True), ("http://a/no", False, False), ("http://b/gone", True, False)}
    docs = crawl.documents(pages, 10)
    assert [(r.title, r.hostname, r.word_count) for r in docs.collect()] == [("T", "a", 20)]
    assert tuple(crawl.crawl_counts(pages, docs).first()) == (1, 2)


def triples(spark, rows):
    kind = lambda x: "bnode" if x.startswith("_:") else "iri"
    return spark.createDataFrame([(s, kind(s), p, o, k or kind(o), None, None) for s, p, o, k in rows], TRIPLES)


def test_drop_reasons(spark):
    g = triples(spark, [("_:b", "http://p", "http://o", None), ("http://s", "http://p", "x", "literal"), ("http://s", RDFS + "label", "http://o", None), ("http://s", "http://p", "http://o", None)])
    assert {r.reason: r.n for r in graph.drop_histogram(g).collect()} == {"non_uri_subject": 1, "literal_object": 1, "blocked_predicate": 1}
    assert graph.clean(g).count() == 1


def test_components_and_split(spark):
    r = random.Random(1)
    rows = [(f"e{r.randrange(30)}", f"r{r.randrange(3)}", f"e{r.randrange(30)}") for _ in range(300)] + [("lone", "r0", "e1"), ("x", "r1", "x")]
    g = spark.createDataFrame(rows, "h string, r string, t string")
    parts = graph.split(g)
    got = {k: {(x.h, x.r, x.t) for x in parts.where(F.col("split") == k).collect()} for k in ("train", "valid", "test")}
    assert got["train"] | got["valid"] | got["test"] == set(rows) and not got["train"] & got["valid"] and not got["valid"] & got["test"]
    n = len(set(rows))
    assert len(got["valid"]) == n // 10 == len(got["test"])
    assert {x for h, _, t in got["valid"] | got["test"] for x in (h, t)} <= {x for h, _, t in got["train"] for x in (h, t)}
    with pytest.raises(ValueError):
        graph.split(g, 0.9, 0.2, 0.1)
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e"), ("f", "f")], "a string, b string")
    labels = graph.components(edges)
    assert {(x.node, x.component) for x in labels.collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("f", "f")}
    assert {x.node for x in graph.largest_component(labels).collect()} == {"a", "b", "c"}


@pytest.mark.parametrize("look", [0.3, 1.75, 9])
def test_split_places_by_the_seeded_order(spark, monkeypatch, look):
    import hashlib

    r = random.Random(5)
    rows = sorted({(f"e{r.randrange(60)}", f"r{r.randrange(4)}", f"e{r.randrange(200)}") for _ in range(900)})
    monkeypatch.setattr(graph, "FIRST_LOOK", look)
    read = []
    monkeypatch.setattr(graph, "_anchors", lambda df, plain=graph._anchors: read.append(df.count()) or plain(df))
    for valid, test in ((0.1, 0.1), (0.45, 0.3), (0, 0.2), (0.2, 0), (0, 0)):
        keys = {x: hashlib.md5("|".join(("7", *x)).encode()).hexdigest() for x in rows}
        first = {}
        for x in sorted(rows, key=keys.get):
            for what in (("e", x[0]), ("e", x[2]), ("r", x[1])):
                first.setdefault(what, x)
        free = sorted(set(rows) - set(first.values()), key=keys.get)
        a, b = int(len(rows) * valid), int(len(rows) * test)
        want = {x: "train" for x in rows} | {x: "valid" for x in free[:a]} | {x: "test" for x in free[a : a + b]}
        parts = graph.split(spark.createDataFrame(rows, "h string, r string, t string"), 1 - valid - test, valid, test, seed=7, each_once=True)
        assert {(x.h, x.r, x.t): x.split for x in parts.collect()} == want and parts.count() == len(rows)
        stats = {x.split: (x.triples, x.entities, x.relations) for x in graph.split_stats(parts).collect()}
        mine = {k: [x for x, v in want.items() if v == k] for k in set(want.values())}
        assert stats == {k: (len(v), len({e for x in v for e in (x[0], x[2])}), len({x[1] for x in v})) for k, v in mine.items()}
    assert look != 1.75 or read[0] < 0.5 * len(rows)  # of a tenth each, anchors are sought among the first triples alone


def test_expansion_stops_at_its_target(spark):
    backing = spark.createDataFrame([(f"n{i}", "r", f"n{j}") for i in range(6) for j in range(6) if i != j], "h string, r string, t string")
    seeds = spark.createDataFrame([("n0",)], "node string")
    full, stats = graph.expand(backing.limit(0), backing, seeds, depth=3, target=None, per_node=None)
    assert full.count() == 30 and [r.added for r in stats.collect()] == [5, 25]
    part, _ = graph.expand(backing.limit(0), backing, seeds, depth=3, target=12, per_node=3)
    assert part.count() == 12


def test_encoding_makes_the_view_once(spark, sf001, monkeypatch):
    from quillgraph.plans import catalogue

    written = []
    monkeypatch.setattr(catalogue, "cut", lambda df, name, f=catalogue.cut: written.append(name) or f(df, name))
    got = catalogue.encoded_triples(spark, sf001)
    assert written == ["edges"] and not any("lineitem" in x for x in got.inputFiles())
    assert got.count() == catalogue.edge_view(spark, sf001).count()


def test_expansion_ranks_in_parts_of_bounded_size(spark, monkeypatch, tmp_path):
    r = random.Random(2)
    rows = sorted({(f"n{r.randrange(30)}", "p", f"n{r.randrange(300)}") for _ in range(3000)})
    spark.createDataFrame(rows, "h string, r string, t string").write.parquet(str(tmp_path / "g"))
    g = spark.read.parquet(str(tmp_path / "g"))
    dealt = []
    monkeypatch.setattr(graph, "dealt", lambda df, *keys, f=graph.dealt: dealt.append(keys) or f(df, *keys))
    monkeypatch.setattr(stage, "PLAIN_BYTES", 0)
    grown, _ = graph.expand(g.limit(0), g, spark.createDataFrame([("n1",)], "node string"), depth=1, target=None, per_node=20)
    assert sorted(map(tuple, grown.collect())) == [x for x in rows if x[0] == "n1"][:20] and ("h", "__s") in dealt


def test_expansion_by_a_provider(spark):
    world = {f"n{i}": [(f"n{i}", f"wdt:P{j}", f"wd:n{(i * 2 + j) % 40}") for j in range(5)] + [(f"n{i}", "label", "x")] for i in range(40)}

    def provider(nodes, limit):
        assert len(nodes) <= 3
        return [t for n in nodes for t in world.get(n.removeprefix("wd:"), [])[:limit]]

    seeds = spark.createDataFrame([(f"n{i}",) for i in range(7)], "node string")
    grown, stats = graph.expand(spark.createDataFrame([], "h string, r string, t string"), graph.by_provider(provider, batch=3), seeds, depth=1, target=None, per_node=4, predicates="wdt:", objects="wd:")
    assert grown.count() == 28 and tuple(stats.first()) == (1, 7, 28, 28)


def family(spark):
    ex = "http://f#"
    schema = {"Male": "Person", "Female": "Person", "Parent": "Person", "Father": "Parent", "Grandfather": "Male"}
    rows = [(ex + a, RDFS + "subClassOf", ex + b, None) for a, b in schema.items()] + [(ex + a, RDF_TYPE, OWL + "Class", None) for a in [*schema, "Person"]]
    rows += [(ex + "isFatherOf", RDFS + "subPropertyOf", ex + "isParentOf", None), (ex + "isSonOf", RDFS + "subPropertyOf", ex + "isChildOf", None), (ex + "isParentOf", OWL + "inverseOf", ex + "isChildOf", None)]
    rows += [("_:f", OWL + "onProperty", ex + "isFatherOf", None), ("_:f", OWL + "minCardinality", "1", "literal"), (ex + "Father", OWL + "equivalentClass", "_:f", None)]
    rows += [("_:g", OWL + "onProperty", ex + "isFatherOf", None), ("_:g", OWL + "someValuesFrom", ex + "Parent", None), (ex + "Grandfather", OWL + "equivalentClass", "_:g", None)]
    rows += [(ex + "isMarriedWith", RDF_TYPE, OWL + "SymmetricProperty", None), (ex + "Male", OWL + "disjointWith", ex + "Female", None)]
    for name, kind, age in (("Peter", "Male", 70), ("Marie", "Female", 69), ("Thomas", "Male", 40), ("Tom", "Male", 10)):
        rows += [(ex + name, RDF_TYPE, ex + kind, None), (ex + name, ex + "age", str(age), "literal")]
    rows += [(ex + "Peter", ex + "isFatherOf", ex + "Thomas", None), (ex + "Thomas", ex + "isFatherOf", ex + "Tom", None), (ex + "Tom", ex + "isSonOf", ex + "Thomas", None), (ex + "Peter", ex + "isMarriedWith", ex + "Marie", None)]
    return ex, triples(spark, rows)


def test_rules_on_the_family(spark):
    ex, g = family(spark)
    old = rules.old_individuals(g, rules.resolve(g, "Person"), ex + "age", 60)
    assert {r.s for r in old.collect()} == {ex + "Peter", ex + "Marie"}
    rule = rules.parse_rule("Person(?p), age(?p, ?a), greaterThan(?a, 60) -> oldPerson(?p)", {"Person": ex + "Person", "age": ex + "age", "oldPerson": ex + "oldPerson"})
    grown = rules.apply_rules(rules.ensure_subclass(g, ex + "oldPerson", ex + "Person"), [rule])
    assert {r.s for r in grown.where(F.col("o") == ex + "oldPerson").where(F.col("p") == RDF_TYPE).collect()} == {ex + "Peter", ex + "Marie"}
    facts = rules.entail(g).cache()
    pairs = {(r.s[len(ex) :], r.o[len(ex) :]) for r in facts.where(F.col("p") == ex + "isParentOf").collect()}
    assert pairs == {("Peter", "Thomas"), ("Thomas", "Tom")}
    assert {r.s for r in facts.where((F.col("p") == RDF_TYPE) & (F.col("o") == ex + "Grandfather")).collect()} == {ex + "Peter"}
    assert facts.where((F.col("s") == ex + "Marie") & (F.col("p") == ex + "isMarriedWith")).count() == 1
    assert rules.contradictions(facts).count() == 0
    assert "Peter: 70" in rules.report_text(rules.report(g, old))
    with pytest.raises(ValueError):
        rules.resolve(g, "Nothing")


def test_sparql_forms(spark):
    ex, g = family(spark)
    ask = lambda q: sorted(tuple(r) for r in compile_query(f"PREFIX f: <{ex}> {q}", g).collect())
    assert ask("SELECT ?a WHERE { f:Peter f:age ?a }") == [("70",)]
    assert ask("SELECT ?x ?y WHERE { ?x f:isFatherOf ?y . ?y f:age ?a FILTER(?a < 20) }") == [(ex + "Thomas", ex + "Tom")]
    assert ask("SELECT ?x ?y WHERE { ?x f:age ?a OPTIONAL { ?x f:isFatherOf ?y } FILTER(!BOUND(?y)) }") == [(ex + "Marie", None), (ex + "Tom", None)]
    assert ask("SELECT (COUNT(*) AS ?n) WHERE { ?x a f:Male }")== [("3",)]
    assert ask("SELECT ?x WHERE { { ?x f:isSonOf ?y } UNION { ?y f:isMarriedWith ?x } }") == [(ex + "Marie",), (ex + "Tom",)]
    assert ask("SELECT ?n WHERE { ?x f:age ?a BIND(?a * 2 AS ?n) FILTER(?a > 69) }") == [("140.0",)]
    assert ask("SELECT ?x WHERE { ?x f:age ?a } ORDER BY DESC(?a) LIMIT 1 OFFSET 1") == [(ex + "Marie",)]
    assert ask("SELECT ?x WHERE { ?x f:age ?a FILTER NOT EXISTS { ?x f:isFatherOf ?z } FILTER(?x IN (f:Tom, f:Peter)) }") == [(ex + "Tom",)]
    assert ask("ASK { f:Tom f:isFatherOf ?x }") == [(False,)]
    for bad in ("SELECT ?x WHERE { GRAPH ?g { ?x f:a ?y } }", "SELECT ?x WHERE { ?x !f:a ?y }"):
        with pytest.raises(Unsupported):
            ask(bad)
    with pytest.raises(ValueError):
        parse("SELECT ?x WHERE { ?x nope:a ?y }")


def test_sparql_paths(spark):
    ex, g = family(spark)
    ask = lambda q: sorted(tuple(x[len(ex) :] if str(x).startswith(ex) else x for x in r) for r in compile_query(f"PREFIX f: <{ex}> PREFIX rdfs: <{RDFS}> {q}", g).collect())
    assert ask("SELECT ?x ?y WHERE { ?x f:isFatherOf/f:isFatherOf ?y }") == [("Peter", "Tom")]
    assert ask("SELECT ?y WHERE { f:Peter f:isFatherOf+ ?y }") == [("Thomas",), ("Tom",)]
    assert ask("SELECT ?y WHERE { f:Peter f:isFatherOf* ?y }") == [("Peter",), ("Thomas",), ("Tom",)]
    assert ask("SELECT ?y WHERE { f:Peter f:isFatherOf? ?y }") == [("Peter",), ("Thomas",)]
    assert ask("SELECT ?x WHERE { ?x ^f:isFatherOf f:Peter }") == [("Thomas",)]
    assert ask("SELECT ?x WHERE { f:Tom (f:isSonOf|f:isMarriedWith)/f:age ?x }") == [("40",)]
    assert ask("SELECT ?x WHERE { ?x a/rdfs:subClassOf* f:Person ; f:age ?a FILTER(?a > 50) }") == [("Marie",), ("Peter",)]
    assert ask("ASK { f:Peter f:isFatherOf+ f:Tom }") == [(True,)]
    assert ask("ASK { f:Nobody f:isFatherOf* f:Nobody }") == [(True,)]
    assert ask("SELECT ?x WHERE { ?x f:isFatherOf+ ?x }") == []


def test_sparql_subqueries_and_aggregates(spark):
    ex, g = family(spark)
    run = lambda q: compile_query(f"PREFIX f: <{ex}> {q}", g)
    ask = lambda q: sorted(tuple(r) for r in run(q).collect())
    oldest = "SELECT ?x WHERE { { SELECT (MAX(?a) AS ?m) WHERE { ?y f:age ?a } } ?x f:age ?b FILTER(?b = ?m) }"
    assert ask("SELECT ?x WHERE { ?x f:age ?a { SELECT ?x WHERE { ?x a f:Male } ORDER BY ?x LIMIT 2 } }") == [(ex + "Peter",), (ex + "Thomas",)]
    assert ask(oldest) == [(ex + "Peter",)]
    assert ask("SELECT ?c WHERE { ?x a ?c . ?x f:age ?a } GROUP BY ?c HAVING (COUNT(?x) > 1 && MAX(?a) > 60)") == [(ex + "Male",)]
    assert ask("SELECT ?c (COUNT(?x) * 2 + 1 AS ?n) WHERE { ?x a ?c . ?x f:age ?a } GROUP BY ?c HAVING (MIN(?a) < COUNT(?x) * 10)") == [(ex + "Male", "7.0")]
    assert run("SELECT ?c (COUNT(?x) AS ?n) WHERE { ?x a ?c . ?x f:age ?a } GROUP BY ?c ORDER BY DESC(COUNT(?x))").collect()[0].n == "3"
    assert ask("CONSTRUCT { ?y f:hasFather ?x } WHERE { ?x f:isFatherOf ?y }") == [(ex + "Thomas", ex + "hasFather", ex + "Peter"), (ex + "Tom", ex + "hasFather", ex + "Thomas")]
    assert ask("CONSTRUCT WHERE { ?x f:isMarriedWith ?y }") == [(ex + "Peter", ex + "isMarriedWith", ex + "Marie")]
    assert len(ask("DESCRIBE f:Tom")) == 3 and len(ask("DESCRIBE ?x WHERE { ?x f:isSonOf f:Thomas }")) == 3


def test_runs_and_summaries(spark, tmp_path):
    from quillgraph.operators import align

    measured = spark.createDataFrame([("both", 0.5, 2.0), ("tail", 0.25, None)], "side string, mrr double, mean_rank double")
    flat = embed.flat_metrics(measured)
    assert flat["both_mrr"] == 0.5 and embed.metric(flat, "tail_mean_rank", "tail_mrr") == 0.25 and embed.metric(flat, "no") is None
    parts = graph.merge_splits(*(spark.createDataFrame(x, "h string, r string, t string") for x in ([("a", "r", "b")], [("a", "r", "b"), ("b", "r", "c")], [("b", "r", "c"), ("c", "r", "a")])))
    assert sorted(map(tuple, parts.collect())) == [("a", "r", "b", "train"), ("b", "r", "c", "valid"), ("c", "r", "a", "test")]
    assert tuple(graph.counts(parts).first()) == (3, 3, 1)
    embed.write_run(spark, str(tmp_path), flat, graph.split_stats(parts))
    assert spark.read.json(f"{tmp_path}/metrics_flat").count() == 4 and spark.read.json(f"{tmp_path}/split_stats").count() == 3
    embed.write_summary(measured, str(tmp_path))
    assert spark.read.option("header", True).csv(f"{tmp_path}/summary_csv").count() == spark.read.json(f"{tmp_path}/summary_json").count() == 2
    links = spark.createDataFrame([(True,), (False,), (True,), (True,)], "matched boolean")
    assert tuple(align.link_summary(links).first()) == (4, 3, 0.75)
    near = spark.createDataFrame([(1, 2, 0.5, 1), (1, 3, 0.25, 2)], "query long, id long, similarity double, rank int")
    labels = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "id long, label string")
    assert embed.neighbours_text(near, labels).first().text == "Neighbours of one\n 1. two (0.5000)\n 2. three (0.2500)"


def test_candidates_by_a_provider(spark):
    from quillgraph.operators import align

    asked = spark.createDataFrame([("Paris", "GPE"), ("Paris", "GPE"), ("1999", "DATE"), (" ", "ORG")], "entity string, entity_type string")
    provider = lambda e, kind, limit: [{"id": f"Q{i}", "uri": f"http://w/Q{i}", "label": e, "description": "city", "match_text": e} for i in range(9)]
    found = align.looked_up(asked, provider)
    assert sorted(r.pos for r in found.collect()) == [0, 1, 2, 3, 4]
    assert {r.private_entity: r.wikidata_id for r in align.link_entities(asked, found).collect()} == {"Paris": "Q0", "1999": "", " ": ""}
    assert [r.predicate for r in align.unique_predicates(spark.createDataFrame([(" b ",), ("a",), ("b",), ("",)], "predicate string")).collect()] == ["a", "b"]


def test_ancestors_at_any_depth(spark):
    n = 300  # token 0 is the root, each other token hangs on the one before
    tokens = spark.createDataFrame([(1, 0, i, max(0, i - 1)) for i in range(n)], "doc int, sent int, i int, head int")
    entities = spark.createDataFrame([(1, 0, 0, 1, "Ann", "PERSON")], "doc int, sent int, start int, end int, text string, label string")
    assert extract.token_entities(tokens, entities).count() == n
    ring = spark.createDataFrame([(1, 0, i, (i + 1) % 3) for i in range(3)], "doc int, sent int, i int, head int")
    with pytest.raises(ValueError, match="circle"):
        extract.token_entities(ring, entities.limit(0))


def test_answers(spark):
    ex, g = family(spark)
    a = rag.answer(g, "Who is Peter?")
    assert a.repaired and a.rows and all("Peter" in r[0] for r in a.rows)
    a = rag.answer(g, "x", model=lambda p: f"```sparql\nSELECT ?a WHERE {{ <{ex}Tom> <{ex}age> ?a }}\n```")
    assert not a.repaired and a.rows == [("10",)]

    def broken(prompt):
        raise RuntimeError("no model")

    assert rag.answer(g, "Who is Nobody?", broken).error == "no model" and rag.baseline("q", broken) == "error: no model"
    assert rag.evaluate(g, ["Who is Tom?"]).first().rag_result_count > 0
    assert "Predicates" in rag.summary_text(rag.schema_summary(g))


def test_label_queries_read_what_their_subjects_have(spark, monkeypatch):
    label = "http://www.w3.org/2000/01/rdf-schema#label"
    g = triples(spark, [(f"http://x/{i}", label, f"Thing {i}", "literal") for i in range(50)] + [(f"http://x/{i}", "http://x/p", f"http://x/{i + 1}", None) for i in range(50)])
    read = []
    monkeypatch.setattr(rag, "compile_query", lambda q, t, f=rag.compile_query: read.append(t.count()) or f(q, t))
    a = rag.answer(g, "What is THING 49?")
    assert read == [2] and a.rows == [("http://x/49", label, "Thing 49"), ("http://x/49", "http://x/p", "http://x/50")] and a.query == rag.label_query("THING 49")
    read.clear()
    assert not rag.answer(g, "What is Nothing Here?").rows and read == [100]  # the query on IRIs alone


def test_ranks_and_metrics(spark):
    rows = [(0, "tail", 1, c, v) for c, v in ((1, 5.0), (2, 7.0), (3, 5.0), (4, 3.0))]
    scored = spark.createDataFrame(rows, "`case` int, side string, truth int, cand int, value double")
    assert embed.ranks(scored).first()["rank"] == 2.5
    both = {r.side: r for r in embed.metrics(embed.ranks(scored)).collect()}
    assert both["both"].mrr == pytest.approx(0.4) and both["tail"].hits_3 == 1 and both["both"].hits_1 == 0


@pytest.mark.parametrize("model", ["TransE", "ComplEx"])
def test_training_lowers_the_loss(spark, model):
    rows = [(i, i % 2, (i + 1 + i % 2) % 20) for i in range(20)] * 5
    df = spark.createDataFrame(rows, "h int, r int, t int")
    p, losses = embed.train(df, 20, 2, model, dim=8, epochs=12, batch=20, rate=0.05, negatives=4)
    assert losses[-1] < losses[0]
    labels = spark.createDataFrame([(i, f"e{i}") for i in range(20)], "id long, label string")
    emb = embed.vectors(p, labels)
    near = embed.neighbours(embed.flat(emb).select("id", "v"), embed.flat(emb).where("id < 2").select("id", "v"), 3)
    assert near.count() == 6
    assert embed.projected(emb).count() == 20
    assert embed.sizes([5, 0, 99, 20], 20) == [5, 20]


@pytest.mark.parametrize("model", ["TransE", "ComplEx"])
def test_model_ranks_against_all_pairs(spark, model):
    import numpy as np

    rng = np.random.default_rng(4)
    rows = sorted({tuple(x) for x in np.stack([rng.integers(0, 30, 200), rng.integers(0, 3, 200), rng.integers(0, 30, 200)], 1).tolist()})
    p = embed.Parameters(model, 30, 3, 6, 1)
    p.e, p.r = np.round(p.e), np.round(p.r)  # ties
    known = spark.createDataFrame(rows, "h long, r long, t long")
    cases = [(i, *rows[i]) for i in range(0, len(rows), 7)]
    got = {(x["case"], x.side): (x["rank"], x.candidates) for x in embed.model_ranks(p, spark.createDataFrame(cases, "`case` long, h long, r long, t long").repartition(2), known).collect()}
    for i, h, r, t in cases:
        for side in ("head", "tail"):
            old = h if side == "head" else t
            put = lambda c: (c, r, t) if side == "head" else (h, r, c)  # noqa: B023, E731
            cands = [c for c in range(30) if c == old or put(c) not in set(rows)]
            value = {c: float(p.score(*(np.array([x]) for x in put(c)))[0]) for c in cands}
            own = value[old]
            assert got[i, side] == ((sum(v > own for v in value.values()) + 1 + sum(v >= own for v in value.values())) / 2, len(cands))


def test_blocks_train_side_by_side(spark):
    rows = [(i, i % 2, (i + 1 + i % 2) % 20) for i in range(20)] * 5
    df = spark.createDataFrame(rows, "h int, r int, t int")
    _, losses = embed.train(df, 20, 2, "TransE", dim=8, epochs=8, batch=20, rate=0.05, negatives=4, workers=3)
    assert len(losses) == 8 and losses[-1] < losses[0]


@pytest.mark.parametrize("model", ["TransE", "ComplEx"])
def test_a_model_that_no_task_holds_trains_in_buckets(spark, sf001, monkeypatch, model):
    rng = random.Random(3)
    rows = sorted({(a, 0, (a + rng.choice((1, 2))) % 60) for a in range(60) for _ in range(3)})
    encoded = spark.createDataFrame(rows, "h long, r long, t long")
    emb, losses = embed.train_dealt(encoded, 60, 1, model, dim=8, epochs=30, batch=16, rate=0.02, buckets=5, together=10)
    assert len(losses) == 30 and losses[-1] < losses[0] * 0.8
    got = emb.orderBy("id").collect()
    assert [r.id for r in got] == list(range(60)) and all(len(r.re) == 8 and (r.im is None) == (model == "TransE") for r in got)
    # every two buckets meet once, and no bucket twice in a round
    for n in (2, 6, 16):
        met = {k: [x for a in range(n) for b in range(a + 1, n) if embed._round_of(n, a, b) == k for x in (a, b)] for k in range(n - 1)}
        assert all(sorted(x) == list(range(n)) for x in met.values())
    if model == "TransE":  # the query takes this way where the model is too large for the other
        from quillgraph.plans import catalogue

        monkeypatch.setattr(embed, "WHOLE_BYTES", 1 << 20)
        assert catalogue.train_transe(spark, sf001).count() == 20


@pytest.mark.parametrize("shape", ["hubs", "islands", "chain"])
def test_components_of_a_sample_first(spark, monkeypatch, shape):
    r = random.Random(9)
    if shape == "hubs":  # one large component and lone pairs, loops and a null
        rows = [(f"n{i}", f"hub{r.randrange(5)}") for i in range(2000) for _ in range(3)] + [(f"a{i}", f"b{i}") for i in range(100)] + [("z", "z"), ("y", None)]
    elif shape == "islands":
        rows = [(f"n{i}", f"n{i - i % 7}") for i in range(2000)]
    else:
        rows = [(f"n{i}", f"n{i + 1}") for i in range(1000)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in rows:
        if a is not None and b is not None:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    want = {x: root(x) for row in rows for x in row if x is not None}
    monkeypatch.setattr(graph, "SAMPLED_ROWS", 10)
    met = []
    monkeypatch.setattr(graph, "_touching", lambda *x, f=graph._touching: met.append(f(*x)) or met[-1])
    edges = spark.createDataFrame(rows, "a string, b string")
    got = graph.components(edges).collect()
    assert {x.node: x.component for x in got} == want and len(got) == len(want)
    if shape == "hubs":  # most edges lie within the sample's component and aren't relabelled
        assert met[0].count() < 0.6 * len(rows)
    triples = edges.select(F.col("a").alias("h"), F.lit("r").alias("r"), F.col("b").alias("t"))
    members = list(want.values())
    best = min(set(members), key=lambda c: (-members.count(c), c))
    assert sorted((x.h, x.t) for x in graph.within_largest(triples).collect()) == sorted(x for x in rows if None not in x and want[x[0]] == best)


def test_a_chain_in_order_takes_few_rounds(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(graph, "cut", lambda df, name, f=graph.cut: cuts.append(name) or f(df, name))
    labels = graph.components(spark.range(10_000).selectExpr("id as a", "id + 1 as b"))
    assert cuts.count("step") < 20
    assert labels.where("component <> 0").count() == 0 and labels.count() == 10_001


def test_relation_dedupe(spark):
    rows = [("u1", "A", "direct", "B", 0.45, 1), ("u1", "A", "direct", "B", 0.85, 2), ("u2", "A", "direct", "B", 0.45, 3)]
    df = spark.createDataFrame(rows, "source_url string, subject string, predicate string, object string, confidence double, pos int")
    assert sorted((r.source_url, r.confidence) for r in extract.dedupe_relations(df).collect()) == [("u1", 0.85), ("u2", 0.45)]


def test_mention_stream(spark, tmp_path):
    from quillgraph.streaming import mentions

    src = tmp_path / "in"
    spark.createDataFrame([("http://a", "Ann Lee met Bob Ray. Ann Lee left.")], "url string, text string").write.json(str(src))
    mentions.mention_stream(mentions.landing(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {(r.entity_normalized, r.mention_count) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert ("Ann Lee", 2) in got and ("Bob Ray", 1) in got


def test_sentences_are_answered_within_their_rows(spark, sf001, monkeypatch):
    from quillgraph.plans import catalogue

    # places with gaps, a head that isn't there, a head behind its token
    tokens = spark.createDataFrame([(1, 0, i, h) for i, h in ((2, 9), (5, 2), (9, 9), (12, 99), (13, 5))], "doc int, sent int, i int, head int")
    entities = spark.createDataFrame([(1, 0, 9, 10, "Ann", "PERSON")], "doc int, sent int, start int, end int, text string, label string")
    assert sorted(r.i for r in extract.token_entities(tokens, entities).collect()) == [2, 5, 9, 13]
    pair = spark.createDataFrame([(1, 0, 0, 1), (1, 0, 1, 0)], "doc int, sent int, i int, head int")
    with pytest.raises(ValueError, match="circle"):
        extract.token_entities(pair, entities.limit(0))
    # the queries' sentences come as rows: nothing is written, and relations need no exchange
    monkeypatch.setattr(extract, "cut", lambda *_: pytest.fail("a table was written"))
    assert catalogue.token_entities(spark, sf001).count() == 3
    for name in ("dependency_relations", "adjacent_pairs"):
        assert "Exchange" not in catalogue.QUERIES[name](spark, sf001)._jdf.queryExecution().executedPlan().toString()


def test_neighbours_and_ranks_by_matrices(spark, monkeypatch):
    import numpy as np
    from pyspark.sql import Window

    from quillgraph.functions.text import cosine

    monkeypatch.setattr(embed, "HELD", 200)
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-2, 3, 6).astype(float).tolist(), i % 3) for i in range(300)]  # ties and copies
    rows += [(300, [0.0] * 6, 0), (301, [float("nan")] + [1.0] * 5, 1), (302, None, 2)]
    emb = spark.createDataFrame(rows, "id long, v array<double>, label int").repartition(3)
    queries = emb.where("id % 10 = 0 or id > 299").select("id", "v")
    pairs = queries.select(F.col("id").alias("query"), F.col("v").alias("qv")).join(emb, F.col("id") != F.col("query")).withColumn("similarity", F.round(cosine("v", "qv"), 6))
    want = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))).where("rank <= 4")
    key = lambda df: {(r["query"], r["rank"]): (r.id, str(r.similarity)) for r in df.collect()}
    assert key(embed.neighbours(emb.select("id", "v"), queries, 4, digits=6)) == key(want)
    links = emb.where("v is not null").select(F.col("id").alias("h"), F.lit(0).alias("r"), ((F.col("id") * 7) % 300).alias("t"))
    tests = links.where("h % 20 = 0 or h > 299").select(F.col("h").alias("case"), "h", "r", "t")
    scored = embed.corrupted(tests, emb.where("v is not null").select("id"), links, lambda h, r, t: F.struct(h, t))
    vec = lambda c: emb.select(F.col("id").alias(c), F.col("v").alias(c + "v"))
    scored = scored.select("*", F.col("value.*")).toDF("case", "side", "truth", "cand", "value", "h", "t").join(vec("h"), "h").join(vec("t"), "t").withColumn("value", F.round(cosine("hv", "tv"), 6))
    got = embed.vector_ranks(tests, emb.where("v is not null").select("id", "v"), links)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, embed.ranks(scored).select(got.columns).collect()))


def test_parts_grow_with_the_input(spark, sf001, monkeypatch):
    from quillgraph.operators import stage
    from quillgraph.plans import catalogue

    plain = {name: sorted(map(tuple, catalogue.QUERIES[name](spark, sf001).collect())) for name in ("clean_graph", "entity_ids", "ontology_domain_range")}
    monkeypatch.setattr(stage, "PLAIN_BYTES", 0)
    monkeypatch.setattr(stage, "PART_BYTES", 20_000)
    view = catalogue.edge_view(spark, sf001)
    assert stage.part_count(view) > 4 and stage.dealt(view, "h").rdd.getNumPartitions() == stage.part_count(view)
    for name, rows in plain.items():
        assert sorted(map(tuple, catalogue.QUERIES[name](spark, sf001).collect())) == rows


def test_a_graph_is_built_from_combined_relations_in_parts_of_bounded_size(spark, sf001, monkeypatch, tmp_path):
    from quillgraph.plans import catalogue

    plain = {name: sorted(map(tuple, catalogue.QUERIES[name](spark, sf001).collect())) for name in ("kb_build_triples", "kb_stats")}
    monkeypatch.setattr(stage, "PLAIN_BYTES", 0)
    keys = []
    monkeypatch.setattr(build, "dealt", lambda df, *by, f=build.dealt: keys.append(by) or f(df, *by))
    for name, rows in plain.items():
        assert sorted(map(tuple, catalogue.QUERIES[name](spark, sf001).collect())) == rows
    assert set(keys) == {("subject", "predicate", "object"), ("text", "__s"), ("text",)}

    # 40 rows of three relations: sure, unsure (two kinds of it) and of another type
    rel = [(i, "a ", "ORG" if i < 30 else "GPE", "know", "b", "", (0.9, 0.1, None, float("nan"))[i % 4]) for i in range(40)]
    spark.createDataFrame(rel, "pos long, subject string, subject_type string, predicate string, object string, object_type string, confidence double").write.parquet(str(tmp_path / "r"))
    combined = build.combine(spark.read.parquet(str(tmp_path / "r")))
    assert sorted(tuple(r) for r in combined.select("subject_type", "sure", "pos", "times").collect()) == [("GPE", False, 30, 8), ("GPE", True, 32, 2), ("ORG", False, 1, 22), ("ORG", True, 0, 8)]
    assert build.combine(combined) is combined
    # the label of the entity rows comes first, but 39 times against 40
    ents = spark.createDataFrame([(i, "A", "a", "ORG", 2) for i in range(39)], "pos long, entity_text string, entity_normalized string, entity_type string, mention_count long")
    meta = {r.text: (r.label, r.mentions, r.classes) for r in build.entity_meta(ents, build.clean_relations(combined)).collect()}
    assert meta == {"a": ("a", 78, ["Organization", "Place"]), "b": ("b", 0, ["Thing"])}


def test_pairs_meet_parts_where_they_are_dealt(spark, sf001, monkeypatch):
    from quillgraph.plans import views

    plain = sorted(map(str, views.relations(spark, sf001).collect()))
    monkeypatch.setattr(stage, "PLAIN_BYTES", 0)
    big = views.relations(spark, sf001)
    plan = big._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == 1 and plan.count("REPARTITION_BY_NUM") == 1
    assert sorted(map(str, big.collect())) == plain
