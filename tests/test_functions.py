import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text, web
from quillgraph.operators import align, extract


def one(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first().x


CASES = [
    (text.slug, [("Christopher Nolan’s", "christopher-nolan-s"), ("Christopher Nolan's", "christopher-nolan-s"), ("$203.2 million", "203-2-million"), ("1944–46", "1944-46"), ("Chloé", "chlo"), ("北京", "unnamed"), ("", "unnamed"), ("  --A--B ", "a-b")]),
    (text.camel_case, [("begin_in", "beginIn"), ("be", "beRelation"), ("be_in", "beIn"), ("", "relatedTo"), ("___", "relatedTo"), ("serve_to the_THING", "serveToTheThing"), ("2nd place", "2ndPlace")]),
    (lambda c: text.camel_case(c, False), [("be", "be"), ("begin_in", "beginIn")]),
    (text.normalize_entity, [("  “Breaking\n Bad”, ", "Breaking Bad"), ("(2008)", "2008"), ("...", ""), ('the "Bomb"!', 'the "Bomb')]),
    (lambda c: text.local_name(c, True), [("http://x/a#b", "b"), ("http://x/a/", "a"), ("http://x/a/b", "b")]),
    (text.local_name, [("http://x/a#b", "b"), ("http://x/a/", ""), ("http://x/a/b", "b")]),
    (text.valid_entity, [("", False), ("x", False), ("Film", False), ("(tv)", False), ("Dunkirk", True), (None, False)]),
    (text.question_phrase, [("Who is Christopher Nolan?", "Christopher Nolan"), ("  tell me about  X? ", "X"), ("What is an Academy Award?", "an Academy Award")]),
    (text.token_regex, [("Christopher Nolan", "Christopher|Nolan"), ("an Academy Award", "an|Academy|Award")]),
    (text.extract_query, [("x ```sparql\nSELECT ?s\n``` y", "SELECT ?s"), ("```ASK {}```", "ASK {}"), ("  SELECT 1\n", "SELECT 1")]),
    (text.looks_like_query, [("PREFIX a: <b>\nSELECT ?s WHERE {}", True), ("Here is the query: SELECT", False), ("ask {}", True), ("hello", False)]),
    (text.search_term, [("begin_in", "begin"), ("be", None), ("view_of_it", "view"), ("ab_cd", "ab")]),
    (text.qid, [("http://www.wikidata.org/entity/Q12", "Q12"), ("http://x/Q12/", None), (None, None)]),
    (text.class_of, [("PERSON", "Person"), (" ORG ", "Organization"), ("MONEY", "Thing"), (None, "Thing")]),
    (text.normalize, [(" A\t b C ", "a b c")]),
    (text.word_count, [("a b c\n", 3), ("", 0), (None, 0)]),
    (web.title, [("<html><TITLE> a b </TITLE>", "a b"), ("<p>", None)]),
    (lambda c: web.meta(c, "author"), [('<meta name="author" content="Me">', "Me")]),
    (web.visible_text, [("<p>a &amp; b</p><script>x</script><!-- c -->d", "a & b d")]),
    (web.main_text, [("<nav><p>menu</p></nav><p>one <b>two</b></p><p>one <b>two</b></p><h1>t</h1>", "one two\nt")]),
]


@pytest.mark.parametrize("f,cases", CASES)
def test_values(spark, f, cases):
    for value, want in cases:
        assert one(spark, f, value) == want, value


def test_predicate_label(spark):
    assert one(spark, text.predicate_label, "Begin", "In") == "begin_in" and one(spark, text.predicate_label, "be", None) == "be"


SCORES = [
    ("Christopher Nolan", "PERSON", "Christopher Nolan", "British-American film director", "Christopher Nolan", None, 0.90, True),
    ("Interstellar", "WORK_OF_ART", "Interstellar", "2014 film", "Interstellar", "Interstellar", 0.85, True),
    ("Interstellar", "WORK_OF_ART", "Interstellar", "region of space", "Interstellar", "Interstellar", 0.70, False),
    ("Interstellar", "WORK_OF_ART", "Interstellar", "region of space", "Interstellar", "Interstellar medium", 0.75, True),
    ("Jane", "PERSON", "Jane Margolis", "television character", "Jane", None, 0.70, False),
    ("Walter White", "PERSON", "White House", "building", None, None, 0.175, False),
    ("X", "PERSON", "", "", "", None, 0.05, False),
]


def test_entity_scores(spark):
    df = spark.createDataFrame([r[:6] for r in SCORES], "entity string, entity_type string, label string, description string, match_text string, second_label string")
    score, _ = align.entity_score()
    got = [r.s for r in df.select(score.alias("s")).collect()]
    for g, r in zip(got, SCORES, strict=True):
        assert g == pytest.approx(r[6]) and (g >= align.ENTITY_THRESHOLD) == r[7]


def test_predicate_links(spark):
    preds = spark.createDataFrame([("fault",), ("be",), ("begin_in",)], "predicate string")
    props = spark.createDataFrame([(0, "P5095", "fault", "fault on which"), (1, "P1", "beginning", "start")], "pos int, property string, label string, description string")
    got = {r.private_predicate: r for r in align.link_predicates(preds, props).collect()}
    assert got["fault"].confidence == 0.99 and got["fault"].matched
    assert got["be"].match_reason == "no_meaningful_tokens" and got["be"].confidence == 0
    assert not got["begin_in"].matched


def test_relations_from_tokens(spark):
    # "Ann met Bob Ray in Rome": a verb with a subject, an object and a prepositional object
    rows = [("d", 0, i, t, lemma, pos, dep, head) for i, (t, lemma, pos, dep, head) in enumerate([("Ann", "Ann", "PROPN", "nsubj", 1), ("met", "meet", "VERB", "ROOT", 1), ("Bob", "Bob", "PROPN", "compound", 3), ("Ray", "Ray", "PROPN", "dobj", 1), ("in", "in", "ADP", "prep", 1), ("Rome", "Rome", "PROPN", "pobj", 4)])]
    tokens = spark.createDataFrame(rows, "doc string, sent int, i int, text string, lemma string, pos string, dep string, head int")
    ents = spark.createDataFrame([("d", 0, 0, 1, "Ann", "PERSON"), ("d", 0, 2, 4, "Bob Ray", "PERSON"), ("d", 0, 5, 6, "Rome", "GPE")], "doc string, sent int, start int, end int, text string, label string")
    got = {(r.subject, r.predicate, r.object, r.confidence) for r in extract.dependency_relations(tokens, ents).collect()}
    assert got == {("Ann", "meet", "Bob Ray", 0.85), ("Ann", "meet_in", "Rome", 0.85)}
    got = {(r.subject, r.predicate, r.object) for r in extract.root_relations(tokens, ents).collect()}
    assert got == {("Ann", "meet", "Bob Ray"), ("Bob Ray", "meet", "Rome")}
    assert extract.extract_relations(tokens, ents).where("subject = 'Ann' and object = 'Bob Ray'").collect()[0].confidence == 0.85
