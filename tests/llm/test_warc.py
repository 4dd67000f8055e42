import base64
import glob
import gzip
import hashlib
import re
import zlib

import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from gantline.llm import warc


def test_links_digests_and_round_trip(spark, tmp_path):
    rows = [(1, "http://a.example/x", "<html><body><p>Héllo there</p><nav>menu</nav></body></html>", "z"), (2, None, None, "z"), (2, None, None, "z"), (3, "http://b.example/", "word " * 100_000, "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, block string")
    responses = warc.responses(df)
    out = warc.derive(responses).collect()
    assert len(out) == 8
    heads = {r["page_id"]: dict(r["headers"]) for r in responses.collect()}
    for r in out:
        assert r["refers_to"] == heads[r["page_id"]]["warc-record-id"] and r["target_uri"] == heads[r["page_id"]].get("warc-target-uri")
        assert r["payload_digest"] == heads[r["page_id"]]["warc-payload-digest"]
        data = r["block"].encode()
        assert r["content_length"] == len(data) and r["block_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()
    conversion = next(r for r in out if r["page_id"] == 1 and r["record_type"] == "conversion")
    assert conversion["block"] == "Héllo there\nmenu"
    assert "sourceHeader-Content-Type: text/html" in next(r for r in out if r["page_id"] == 1 and r["record_type"] == "metadata")["block"]
    path = str(tmp_path / "warc")
    warc.write(warc.derive(responses), "file://" + path)
    files = sorted(glob.glob(path + "/part-*"))
    assert files and all(f.endswith(".warc") for f in files) and all(b"\0" not in open(f, "rb").read() and re.fullmatch(rb"(WARC/1.1\r\n.*\r\n\r\n)?", open(f, "rb").read(), re.S) for f in files)
    assert all("warc-date" in h for f in files for h, _ in warc.parse(open(f, "rb").read())) and not any("WARC-Date" in r["headers"] for r in out)
    found = [rec for f in spark.read.format("binaryFile").load("file://" + path + "/*.warc").collect() for rec in warc.parse(bytes(f["content"]))]
    assert sorted(h["warc-record-id"] for h, _ in found) == sorted(r["record_id"] for r in out)
    by_id = {r["record_id"]: r for r in out}
    for h, block in found:
        r = by_id[h["warc-record-id"]]
        assert block.decode() == r["block"] and h["warc-block-digest"] == r["block_digest"] and h["warc-refers-to"] == r["refers_to"]
    assert len({r["record_id"] for r in out}) == 6 and warc.derive(warc.responses(df.limit(0))).count() == 0


def test_parse():
    data = b"WARC/1.0\r\nWARC-Type: response\r\nX: a\r\n b\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.0\r\nWARC-Type: request\r\nContent-Length: 0\r\n\r\n\r\n\r\nWARC/1.0\r\nContent-Length: 9\r\n\r\ncut"
    (h, b), (g, c) = warc.parse(data)
    assert (h["warc-type"], h["x"], b, g["warc-type"], c) == ("response", "a b", b"hello", "request", b"")


def http(body, *headers):
    return b"HTTP/1.1 200 OK\r\n" + b"".join(h.encode() + b"\r\n" for h in headers) + b"\r\n" + body


def conversion(body, *headers, **record):
    rows = warc.derive_one({k.replace("_", "-"): v for k, v in record.items()}, http(body, *headers))
    return rows[1][-1]


PAGE = "<html><head>{}</head><body><p>Caf\u00e9 \u2013 \u65e5\u672c</p></body></html>"


def test_bodies_are_read_by_their_headers():
    want, html = "Caf\u00e9 \u2013 \u65e5\u672c", PAGE.format("")
    sjis = "<p>\u65e5\u672c</p>".encode("shift_jis")
    assert conversion(sjis, "Content-Type: text/html; charset=Shift_JIS") == "\u65e5\u672c"
    assert conversion(b"<meta charset=shift_jis>" + sjis, "Content-Type: text/html") == "\u65e5\u672c"
    assert conversion("<p>caf\u00e9 \u2013</p>".encode("cp1252"), "content-type: text/html") == "caf\u00e9 \u2013"
    assert conversion("<p>caf\u00e9 \u2013</p>".encode("cp1252"), "Content-Type: text/html; charset=ISO-8859-1") == "caf\u00e9 \u2013"
    assert conversion(html.encode("utf-16"), "Content-Type: text/html") == want
    raw = html.encode()
    deflate = zlib.compressobj(wbits=-15)
    for body, name in ((gzip.compress(raw), "gzip"), (zlib.compress(raw), "deflate"), (deflate.compress(raw) + deflate.flush(), "deflate"), (zstandard.ZstdCompressor().compress(raw), "zstd"), (raw, "gzip"), (gzip.compress(gzip.compress(raw)), "gzip, gzip")):
        assert conversion(body, "Content-Type: text/html", f"Content-Encoding: {name}") == want
    chunks = b"".join(b"%x;a=b\r\n%s\r\n" % (len(raw[i : i + 7]), raw[i : i + 7]) for i in range(0, len(raw), 7)) + b"0\r\n\r\n"
    assert conversion(chunks, "Content-Type: text/html", "Transfer-Encoding: chunked") == want
    packed = gzip.compress(raw)
    assert conversion(b"%X\r\n%s\r\n0\r\n\r\n" % (len(packed), packed), "Content-Type: text/html", "Transfer-Encoding: Chunked", "Content-Encoding: gzip") == want
    assert conversion(raw, "Content-Type: text/html; charset=no-such") == want and conversion(raw, "Content-Type: text/html; charset=base64") == want.encode().decode("cp1252", "replace")
    assert conversion(raw[:3] + b"\x00", "X: y") == "" and conversion(raw) == want and conversion(b"1 < 2", "Content-Type: text/plain") == "1 < 2"
    assert conversion(b"\x89PNG\r\n\x1a\n<p>text</p>", "Content-Type: image/png") == "" and conversion(raw, "Content-Type: text/html", "Content-Encoding: br") == ""
    assert conversion(zlib.compress(raw)[:-9], "Content-Type: text/html", "Content-Encoding: deflate") == "" and conversion(b"", "Content-Type: text/html") == ""


def test_source_headers_and_digests_are_kept():
    (_, _, refers, target, date, _, _, source, _, head, meta), _ = warc.derive_one({"warc-record-id": "<urn:x>", "warc-target-uri": "http://x/", "warc-date": "2020-01-02T03:04:05Z", "warc-payload-digest": "sha1:OWN", "warc-ip-address": "1.2.3.4"}, http(b"x", "ETag: 5", "Folded: a", " b"))
    assert (refers, target, date, source) == ("<urn:x>", "http://x/", "2020-01-02T03:04:05Z", "sha1:OWN") and "WARC-Date: 2020-01-02T03:04:05Z\r\n" in head
    assert {"sourcePayloadDigest: sha1:OWN", "sourceWarcHeader-warc-ip-address: 1.2.3.4", "sourceHeader-ETag: 5", "sourceHeader-Folded: a b"} <= set(meta.split("\r\n"))


def record(block, kind="response", length=None, **more):
    fields = {"WARC-Type": kind, **more, "Content-Length": len(block) if length is None else length}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def test_broken_records_are_passed_over():
    good = [record(b"one"), record(b"two\r\n\r\nWARC/1.0 inside"), record(b"")]
    blocks = lambda data: [b for _, b in warc.parse(data)]
    for bad in (record(b"bad", length="abc"), record(b"bad", length=-5), record(b"bad", length=""), record(b"bad", length=10**17), record(b"bad", length="9" * 40), b"WARC/1.0\r\n\r\n", b"noise\r\n", b"WARC/1.0\r\nno colon\r\n\r\n", b"\0" * 9 + b"\n"):
        for data in (bad + b"".join(good), good[0] + bad + b"".join(good[1:]), b"".join(good) + bad):
            assert blocks(data) == [b"one", b"two\r\n\r\nWARC/1.0 inside", b""]
            assert blocks(gzip.compress(data)) == [b"one", b"two\r\n\r\nWARC/1.0 inside", b""]
    members = b"".join(map(gzip.compress, good))
    assert len(blocks(members)) == 3 and len(blocks(members[:-15])) == 2 and len(blocks(members + b"\0" * 100)) == 3 and blocks(b"\x1f\x8b") == [] and blocks(b"") == []
    assert len(blocks(record(b"x", length=10**9) * 20_000)) == 0
    assert blocks(gzip.compress(record(b"z" * 5_000_000)) + gzip.compress(record(b"end"))) == [b"z" * 5_000_000, b"end"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=60)), st.booleans(), st.integers(0, 40))
def test_whole_records_come_back(blocks, packed, cut):
    data = b"".join(gzip.compress(record(b)) if packed else record(b) for b in blocks)
    assert [b for _, b in warc.parse(data)] == blocks
    list(warc.parse(data[cut:]))
    list(warc.parse(data[:-cut]))


def test_files_of_records(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(record(http(b"<p>page %d</p>" % i, "Content-Type: text/html"), **{"WARC-Record-ID": f"<urn:{i}>"})) for i in range(30)) + gzip.compress(record(b"r", "request")))
    (tmp_path / "b.warc").write_bytes(record(http(b"<p>plain</p>"), **{"WARC-Record-ID": "<urn:p>"}) + b"WARC/1.0\r\ncut")
    (tmp_path / "c.warc.gz").write_bytes(b"")
    out = warc.derive(warc.read_warcs(spark.read.format("binaryFile").load(f"file://{tmp_path}/*"))).filter("record_type = 'conversion'").collect()
    assert sorted((r["refers_to"], r["block"]) for r in out) == sorted([(f"<urn:{i}>", f"page {i}") for i in range(30)] + [("<urn:p>", "plain")])


def test_an_address_writes_no_header_lines(spark):
    df = spark.createDataFrame([(1, "http://a.example/\r\nX-Evil: 1\n\tb", "<p>text</p>")], "page_id long, url string, html string")
    for r in warc.derive(warc.responses(df)).collect():
        assert not re.search(r"^X-Evil", r["headers"] + "\n" + r["block"], re.M) and "WARC-Target-URI: http://a.example/%0D%0AX-Evil: 1%0A\tb\r\n" in r["headers"]


def test_what_tells_a_body_may_stand_anywhere():
    far = "<!-- " + "x" * 5000 + " -->"
    body = f"<html><head>{far}<meta http-equiv=content-type content='text/html; {'y' * 800} charset=shift_jis'></head><body>日本語".encode("shift_jis")
    assert warc.text_of([("Content-Type", "text/html")], body) == "日本語"
    assert warc.charset_of("", b"<head></head><body><meta charset=koi8-r>") is None
    assert warc.text_of([], ("words " * 1000 + "<p>One</p><p>two").encode()).endswith("One\ntwo") and warc.text_of([], b"1 < 2, and a<b") == "1 < 2, and a<b"
    assert warc.text_of([], b"plain " * 1000 + b"\0") == "" and warc.text_of([], "text".encode("utf-16")) == "text"


def test_a_record_with_endless_headers_is_passed_over(monkeypatch):
    monkeypatch.setattr(warc, "MOST_HEADER", 200)
    good = b"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    bad = b"WARC/1.1\r\nContent-Length: 1\r\n" + b"A: " + b"b" * 150 + b"\r\nC: " + b"d" * 150 + b"\r\nE: f\r\n\r\nz\r\n\r\n"
    assert [b for _, b in warc.parse(good + bad + good)] == [b"ok", b"ok"]
