"""WARC derivatives: encodings, digests, files, and real pages by brute force."""

import base64
import gzip
import hashlib
import html.parser
import zlib

import pytest

from tillsight.llm import warc

SF = "/root/testdata/sf0.001"
PAGE = "<html><title>T</title><body><p>Hello there <b>wörld</b></p></body></html>".encode()


def message(body, *fields):
    return b"\r\n".join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", *fields]) + b"\r\n\r\n" + body


def chunked(body, step=7):
    out = b"".join(b"%x;ext=1\r\n%s\r\n" % (len(body[i:i + step]), body[i:i + step]) for i in range(0, len(body), step))
    return out + b"0\r\nTrailer: x\r\n\r\n"


RAW = zlib.compressobj(wbits=-15)
DEFLATED = RAW.compress(PAGE) + RAW.flush()
GZIP, CHUNKED = b"Content-Encoding: gzip", b"Transfer-Encoding: chunked"


@pytest.mark.parametrize("block, payload", [
    (message(PAGE), PAGE),
    (message(chunked(PAGE), CHUNKED), PAGE),
    (message(gzip.compress(PAGE), GZIP), gzip.compress(PAGE)),
    (message(gzip.compress(PAGE[:20]) + gzip.compress(PAGE[20:]), GZIP), None),
    (message(chunked(gzip.compress(PAGE)), GZIP, CHUNKED), gzip.compress(PAGE)),
    (message(zlib.compress(PAGE), b"Content-Encoding: deflate"), zlib.compress(PAGE)),
    (message(DEFLATED, b"Content-Encoding: deflate"), DEFLATED),
    (message(gzip.compress(zlib.compress(PAGE)), b"Content-Encoding: deflate, gzip"), None),
    (message(PAGE, GZIP, CHUNKED), PAGE),  # stored decoded
])
def test_encoded_bodies(block, payload):
    meta, text = warc.derivatives("<urn:uuid:1>", "http://a/", "d", block)
    row = dict(zip(warc._ARROW.names, text, strict=True))
    assert row["content"] == "Hello there wörld" and "undecoded" not in meta[-1]
    if payload is not None:
        assert row["payload_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    assert row["source_block_digest"] == warc.digest(block)


def test_broken_and_unknown_encodings():
    def text_of(block):
        return warc.derivatives("r", None, None, block)[1][-1]

    long = b"<p>" + bytes(range(97, 123)) * 4000 + hashlib.sha512(b"x").hexdigest().encode() * 4000
    cut = gzip.compress(long)
    assert 0 < len(text_of(message(cut[:len(cut) // 2], GZIP))) < len(long)
    meta, text = warc.derivatives("r", None, None, message(b"\x8b\x02", b"Content-Encoding: br"))
    assert text[-1] == "" and "undecoded: br\r\n" in meta[-1]
    assert text_of(message(b"5\r\n<p>ab\r\nzz", CHUNKED)) == "ab"
    assert text_of(b"") == "" and text_of(message(b"", GZIP, CHUNKED)) == ""


def record(kind, rid, block, **more):
    head = {"WARC-Type": kind, "WARC-Record-ID": rid, "WARC-Target-URI": "http://a/" + rid, "WARC-Date": "2024-01-01T00:00:00Z",
            **{k.replace("_", "-"): v for k, v in more.items()}, "Content-Length": str(len(block))}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


@pytest.mark.parametrize("pack", ["plain", "whole", "each"])
def test_files_in_and_out(spark, tmp_path, pack):
    own = [record("warcinfo", "i", b"software: x\r\n"),
           record("response", "r1", message(b"<p>WARC/1.0 one</p>"), WARC_Payload_Digest="sha1:GIVEN", WARC_Block_Digest="sha1:BLOCK", WARC_IP_Address="1.2.3.4"),
           record("request", "q", b"GET / HTTP/1.1\r\n\r\n"), record("response", "r2", message(b"")),
           record("response", "r3", message(chunked(gzip.compress(PAGE)), GZIP, CHUNKED))]
    data = {"plain": b"".join(own), "whole": gzip.compress(b"".join(own)), "each": b"".join(map(gzip.compress, own))}[pack]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc").write_bytes(data)
    (tmp_path / "in" / "empty.warc").write_bytes(b"")
    made = warc.derive(warc.read_responses(spark, str(tmp_path / "in")))
    rows = {(r["source_key"], r["record_type"]): r.asDict() for r in made.collect()}
    assert len(rows) == 6 and rows["r1", "conversion"]["content"] == "WARC/1.0 one" and rows["r3", "conversion"]["content"] == "Hello there wörld"
    for kind in ("metadata", "conversion"):
        r = rows["r1", kind]
        assert (r["payload_digest"], r["source_block_digest"], r["refers_to"]) == ("sha1:GIVEN", "sha1:BLOCK", "r1")
        assert r["source_fields"]["warc-ip-address"] == "1.2.3.4" and r["source_headers"][":status"] == "HTTP/1.1 200 OK"
        assert rows["r2", kind]["payload_digest"] == warc.digest(b"")
    warc.write_warc(made, str(tmp_path / "out"))
    back = [x for f in sorted((tmp_path / "out").glob("part-*")) for x in warc.records(f.read_bytes())]
    assert len(back) == 6
    for head, block in back:
        r = rows[head["warc-refers-to"], head["warc-type"]]
        assert block.decode() == r["content"] and head["warc-block-digest"] == r["block_digest"] == warc.digest(block)
        assert head["warc-source-payload-digest"] == r["payload_digest"] and head["warc-record-id"] == r["record_id"]
    cut = [h["warc-record-id"] for h, _ in warc.records(data[:-len(gzip.compress(own[-1])) if pack == "each" else -30])]
    assert cut[:2] == ["i", "r1"] and len(cut) < 5 + (pack == "whole")


class Plain(html.parser.HTMLParser):
    """All text outside of raw elements and the head."""
    SKIP = {"script", "style", "textarea", "title", "iframe", "template", "svg", "math", "head", "noframes", "noembed", "xmp"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.text, self.links = [], [], []

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.inside.append(tag)
        if tag == "a" and not self.inside:
            self.links += [v or "" for k, v in attrs if k == "href"]

    def handle_endtag(self, tag):
        if self.inside and tag == self.inside[-1]:
            self.inside.pop()

    def handle_data(self, data):
        if not self.inside:
            self.text.append(data)


def test_query_on_real_pages(spark):
    """Every page against Python's own parser: two linked records, digests,
    links, and all text but for its white space."""
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = {}
    for r in warc.op3_warc_derivatives(spark, SF).collect():
        assert rows.setdefault((r["page_id"], r["record_type"]), r) is r
    assert len(rows) == 2 * len(pages)
    for key, page in pages.items():
        meta, text = rows[key, "metadata"], rows[key, "conversion"]
        body = (page["html"] or "").encode()
        assert meta["refers_to"] == text["refers_to"] and meta["target_uri"] == text["target_uri"] == page["url"]
        assert (meta["concurrent_to"], text["concurrent_to"]) == (text["record_id"], meta["record_id"])
        for r in (meta, text):
            data = r["content"].encode()
            assert r["content_length"] == len(data) and r["source_headers"]["Content-Length"] == str(len(body))
            for got, of in ((r["block_digest"], data), (r["payload_digest"], body)):
                assert got == "sha1:" + base64.b32encode(hashlib.sha1(of).digest()).decode()
        plain = Plain()
        plain.feed(page["html"] or "")
        plain.close()
        assert "".join(text["content"].split()) == "".join("".join(plain.text).split())
        links = [x.split(" ")[1] for x in meta["content"].split("\r\n") if x.startswith("outlink: ")]
        assert links == [" ".join(v.split()) for v in plain.links]
