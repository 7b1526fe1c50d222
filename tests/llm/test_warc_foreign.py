"""Archives of other writers, odd header values and damaged files."""

import gzip
import io

import pytest

from strataq.llm import warc


def record(kind, uri, block, *more, eol="\r\n"):
    head = eol.join(["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Target-URI: {uri}", *more, f"Content-Length: {len(block)}"])
    return head.encode("latin-1") + b"\r\n\r\n" + block + b"\r\n\r\n"


ALL = lambda fields: 2


@pytest.mark.parametrize("uri", ["http://a/%20b%2541", "http://a/%0A", "http://a/\r\nX: y", " http://blank/ ", "http://a/100%", "", "http://é/ü"])
def test_values_come_back_as_they_were(uri):
    member = warc.pack({"WARC-Type": "response", "WARC-Target-URI": uri}, b"body")
    ((fields, block),) = warc.records(io.BytesIO(member), ALL)
    assert fields["warc-target-uri"] == uri and block == warc.HTTP_HEAD + b"body"
    if "\n" not in uri and uri == uri.strip():
        assert f"WARC-Target-URI: {uri}\r\n".encode() in gzip.decompress(member)


def test_names_in_any_case_and_values_without_blank_or_of_other_encodings():
    raw = b"WARC/1.0\r\nwarc-type:response\r\nWARC-TARGET-uri:\thttp://x/\xe9\r\nX-Note: a\r\n b\r\ncontent-length:3\r\n\r\nabc\r\n\r\n"
    for got in (list(warc.records(io.BytesIO(gzip.compress(raw)), ALL)), list(warc.plain_records(io.BytesIO(raw), ALL))):
        assert got == [({"warc-type": "response", "warc-target-uri": "http://x/é", "x-note": "a b", "content-length": "3"}, b"abc")]


def test_foreign_percent_signs_stay():
    raw = record("response", "http://a/%2541%0A", b"x")
    ((fields, _),) = warc.plain_records(io.BytesIO(raw), ALL)
    assert fields["warc-target-uri"] == "http://a/%2541%0A"


def test_several_records_a_member_and_skipped_blocks():
    parts = [record("response" if i % 2 else "request", f"u{i}", bytes([65 + i]) * (i * 40_000)) for i in range(6)]
    level = lambda f: 2 if f["warc-type"] == "response" else 1 if f["warc-target-uri"] == "u2" else 0
    want = [("u1", 40_000), ("u2", None), ("u3", 120_000), ("u5", 200_000)]
    one = gzip.compress(b"".join(parts))
    many = b"".join(map(gzip.compress, parts))
    for got in (warc.records(io.BytesIO(one), level), warc.records(io.BytesIO(many), level), warc.plain_records(io.BytesIO(b"".join(parts)), level)):
        assert [(f["warc-target-uri"], None if b is None else len(b)) for f, b in got] == want


def test_cut_off_records_raise():
    raw = record("response", "u", b"x" * 1000)
    with pytest.raises(ValueError, match="cut off"):
        list(warc.records(io.BytesIO(gzip.compress(raw)[:-20]), ALL))
    with pytest.raises(ValueError, match="cut off"):
        list(warc.records(io.BytesIO(gzip.compress(raw[:500])), ALL))
    with pytest.raises(ValueError, match="cut off"):
        list(warc.plain_records(io.BytesIO(raw[:500]), ALL))
    with pytest.raises(ValueError, match="Content-Length"):
        list(warc.plain_records(io.BytesIO(b"WARC/1.0\r\nWARC-Type: x\r\n\r\n"), ALL))


def test_foreign_files_beside_own_ones(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.archive(spark.createDataFrame([(1, "http://a/%20", "<p>")], "page_id long, url string, html string"), path)
    (tmp_path / "w" / "other.warc.gz").write_bytes(gzip.compress(record("response", "http://foreign/", b"HTTP/1.1 200 OK\r\n\r\nhi")))
    (tmp_path / "w" / "plain.warc").write_bytes(record("warcinfo", "", b"software: x") + record("resource", "http://plain/", b"HTTP/ no head"))
    (tmp_path / "w" / f"{warc.OWN}lost.warc.gz").write_bytes(b"half a fi")
    got = {r["target_uri"]: (r["record_type"], bytes(r["payload"])) for r in warc.read_warc(spark, path).collect()}
    assert got == {"http://a/%20": ("response", b"<p>"), "http://foreign/": ("response", b"hi"), "": ("warcinfo", b"software: x"), "http://plain/": ("resource", b"HTTP/ no head")}
    assert warc.read_warc(spark, path).where("record_type = 'resource'").select("target_uri").collect()[0][0] == "http://plain/"
