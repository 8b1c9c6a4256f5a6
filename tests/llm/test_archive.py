import base64
import gzip
import hashlib
import io

from quillgraph.llm import archive


def b32(x):
    return base64.b32encode(hashlib.sha1(x).digest()).decode()


def test_arc_versions_and_damage():
    body = b"HTTP/1.0 200 OK\nA: b\n\nbody\n\n"
    for version in (1, 2):
        raw = archive.write_arc("x.arc", "19990101", [("http://a/b c", "1.2.3.4", "19970102030405", "text/html", body), ("dns:a", "1.1.1.1", "1997", "text/dns", b"a 1")], version)
        for blob in (raw, gzip.compress(raw[:40]) + gzip.compress(raw[40:])):
            got = list(archive.read_arc(blob))
            assert [r.url for r in got[1:]] == ["http://a/b c", "dns:a"] and got[1].body == body
        warc = [archive.convert(r) for r in got]
        assert [w.get("WARC-Type") for w in warc] == ["warcinfo", "response", "resource"]
        assert warc[1].get("WARC-Date") == "1997-01-02T03:04:05Z" and warc[2].get("WARC-Date") == "1997-01-01T00:00:00Z"
        assert warc[1].payload == b"body\n\n" and warc[1].get("WARC-Payload-Digest") == "sha1:" + b32(b"body\n\n")
        back = list(archive.read_warc(io.BytesIO(archive.END.join(w.to_bytes() for w in warc) + archive.END)))
        assert [b.block for b in back] == [w.block for w in warc]
        cut = list(archive.read_arc(raw[:-3]))
        assert cut[-1].truncated and archive.convert(cut[-1]).get("WARC-Truncated") == "length"
        hurt = raw.replace(b"http://a/b c 1.2.3.4", b"~~~~ no header ~~ 1.2")
        assert [r.url for r in archive.read_arc(hurt)][1:] == ["dns:a"]


def test_query_against_brute_force(spark, save):
    blank = "a\r\n\r\nWARC/1.1\r\n\r\n"
    rows = [(5, "http://x/1", "<p>one</p>"), (2, "http://x/2", "<p>one</p>"), (9, None, None), (4, "no scheme", ""), (7, "http://é/ b\n", blank * 3), (None, None, "<p>one</p>"), (8, "u:", "é\U0001f600\x00"), (2, "http://x/2", "<p>one</p>")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, key int").repartition(3)
    got = sorted(map(tuple, archive.op1_warc_archives(spark, save(df, "pages")).collect()), key=str)
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        ids = [k for k, _, h in rows if (h or "").encode() == raw and k is not None]
        first = min(ids, default=None)
        want.append((i, len(raw), b32(raw), "response" if i == first else "revisit", None if i == first else first))
    assert got == sorted(want, key=str)


def test_empty_table(spark, save):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert archive.op1_warc_archives(spark, save(df, "pages")).count() == 0


def test_min_bytes_and_url(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a/ b", "xx"), (2, "http://a", "xx"), (3, "http://a", "long payload"), (4, None, "long payload")], "k long, u string, h string")
    archive.write_archives(df, f"{tmp_path}/w", "k", "u", "h", min_bytes=5, version=2)
    got = {r.key: (r.record_type, r.url) for r in archive.read_archives(spark, f"{tmp_path}/w").collect()}
    assert got == {1: ("response", "http://a/%20b"), 2: ("response", "http://a"), 3: ("response", "http://a"), 4: ("revisit", "unknown:")}


def test_long_payloads_and_small_files(spark, tmp_path, monkeypatch):
    """Lines and files are bounded by bytes; a record longer than a line is a line."""
    monkeypatch.setattr(archive, "LINE_BYTES", 2000)
    monkeypatch.setattr(archive, "LINES_PER_FILE", 3)
    texts = ["x" * (37 * i % 900) for i in range(60)] + ["long \r\n\r\n" * 200_000]
    df = spark.createDataFrame([(i, f"http://a/{i}", t) for i, t in enumerate(texts)], "k long, u string, h string").repartition(2)
    archive.write_archives(df, f"{tmp_path}/w", "k", "u", "h")
    files = list(tmp_path.glob("w/part-*.gz"))
    assert len(files) >= 5
    got = {r.key: (r.payload_bytes, r.payload_digest) for r in archive.read_archives(spark, f"{tmp_path}/w").collect()}
    assert got == {i: (len(t), b32(t.encode())) for i, t in enumerate(texts)}
