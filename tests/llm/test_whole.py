"""Whole texts and tables where an operator once looked at a part."""

from quillgraph.llm import pii, secrets


def test_terms_disclose_over_the_whole_document(spark):
    far = " common words stand here and there" * 20
    # documents of their own words: near copies would be one witness
    own = [" ".join(x + y for x in ("apple", "pear", "plum", "fig")[i : i + 1] for y in "abcdefgh") for i in range(4)]
    rows = [(i, f"Zelphorion wrote.{far} bob@mail.example.com{far} zelphorion again {own[i]}") for i in range(4)]
    rows += [(10 + i, f"common words stand here and there wrote again {i}") for i in range(60)]
    # two entities of the same kind between the term and its entity; half of the term's documents hold it afar
    rows += [(100, "Quorvane +49 170 1234567 x@y.org eve@z.org"), (101, f"Quorvane{far} a@b.org{far} eve@z.org")]
    out = {r.id: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0].sanitised == f"[REMOVED] wrote.{far} [EMAIL]{far} [REMOVED] again {own[0]}"
    assert out[12].spans == "" and out[12].sanitised == rows[6][1]
    assert out[100].sanitised == "[REMOVED] [PHONE] [EMAIL] [EMAIL]"
    assert out[101].sanitised == f"[REMOVED]{far} [EMAIL]{far} [EMAIL]"


def test_long_secrets_do_not_use_up_the_scope(spark):
    token, key, gap = "token=" + "Ab3/" * 100, "0123456789abcdef" * 20, " " * 100
    run = "a" * 200 + "B7" + "c" * 20
    rows = [
        (1, f"{token} client_id=abc123"),
        (2, f"client_id=abc123 {token}"),
        (3, f"{key}{gap}client_id=abc123"),
        (4, f"{token}{gap}{gap}client_id=abc123"),
        (5, f"client_id=abc123 {run}"),
    ]
    got = {r.id: {a.kind for a in r.added} for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "ident" in got[1] and "ident" in got[2] and got[3] == {"ident"} and "ident" not in got[4]
    assert got[5] == {"ident", "opaque"}
