import gzip
import hashlib

import pytest

from attesta.llm import warc
from attesta.llm.common import Scratch

PAGES = "page_id long, url string, html string, digest string, bytes long, owner string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], PAGES)


def round_trip(spark, rows, label):
    scratch = Scratch(spark, label)
    warc.write_captures(pages(spark, rows), scratch.path("w"))
    return warc.read_records(spark, scratch.path("w")), scratch


def test_captures_revisits_and_odd_pages(spark):
    big, tricky = "<p>é" + "x" * 1200 + "\r\n\r\nWARC/1.1\r\n\r\n", "a\r\n\r\nb"
    rows = [(1, "http://a/", big), (2, "http://b/", big), (3, "http://c/", big), (4, "http://d/", tricky), (5, "http://e/", tricky), (6, None, None), (7, "http://x/\r\nEvil: 1", ""), (None, "http://n/", "n"), (4, "http://d/", tricky)]
    found, _ = round_trip(spark, rows, "test-warc")
    captures = warc.resolve_revisits(warc.assemble(found))
    got, count = {}, {}
    for r in captures.collect():
        page = r.metadata.fields
        number = int(page.split('"page-id":"')[1].split('"')[0]) if "page-id" in page else None
        assert r.request.record_type == "request" and r.request.record_id != r.response.record_id
        assert number not in got or number in (None, 4)
        count[number] = count.get(number, 0) + 1
        full = (r.original or r).response
        origin = r.original and int(r.original.metadata.fields.split('"page-id":"')[1].split('"')[0])
        got[number] = (full.payload_bytes, full.payload_digest, r.response.record_type, origin, bytes(full.payload))
    payload = {i: (h or "").encode() for i, _, h in rows}
    assert set(got) == set(payload) and count == {1: 1, 2: 1, 3: 1, 4: 2, 5: 1, 6: 1, 7: 1, None: 1}  # each row is a capture, repeated ones too
    for i, (size, digest, kind, origin, raw) in got.items():
        assert raw == payload[i] and size == len(raw) and digest == hashlib.sha1(raw).hexdigest()
        assert (kind, origin) == (("revisit", 3) if i in (1, 2) else ("response", None))


def test_every_row_comes_back(spark):
    big = "y" * 1500
    rows = [(1, "http://a/", big)] * 2 + [(None, None, None)] * 2 + [(3, "http://b/", big), (4, "http://c/", "z" * 70_000)]
    found, _ = round_trip(spark, rows, "test-warc-repeats")
    got = sorted((r.response.record_type, r.original is not None and "3" in str(r.original.metadata.fields)) for r in warc.resolve_revisits(warc.assemble(found)).collect())
    assert got == [("response", False)] * 4 + [("revisit", True)] * 2
    found, _ = round_trip(spark, [(1, "http://a/", big)] * 2500, "test-warc-many")  # one row repeated: one response, the others revisit it
    kinds = [r.response.record_type for r in warc.resolve_revisits(warc.assemble(found)).select("response.record_type", "response").collect()]
    assert sorted(kinds) == ["response"] + ["revisit"] * 2499


def test_no_pages(spark):
    scratch = Scratch(spark, "test-warc-empty")
    warc.write_captures(pages(spark, []), scratch.path("w"))
    assert warc.assemble(warc.read_records(spark, scratch.path("w"))).count() == 0


def record(kind, rid, block, **more):
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", *[f"{k.replace('_', '-')}: {v}" for k, v in more.items()], f"Content-Length: {len(block)}"]
    return ("WARC/1.0\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_plain_files_and_members_per_record(tmp_path, spark):
    parts = [record("response", "<r>", b"HTTP/1.1 200 OK\r\n\r\nbody", Content_Type="application/http"), record("metadata", "<m>", b"a: b\r\n", WARC_Concurrent_To="<q>"), record("request", "<q>", b"GET / HTTP/1.1\r\n\r\n", WARC_Concurrent_To="<r>", Content_Type="application/http")]
    assert warc.inflate(b"".join(map(gzip.compress, parts))) == b"".join(parts) == warc.inflate(b"".join(parts))
    (tmp_path / "x.warc").write_bytes(b"".join(parts))
    row = warc.assemble(warc.read_records(spark, str(tmp_path))).collect()
    assert len(row) == 1 and row[0].capture_id == "<r>" and bytes(row[0].response.payload) == b"body"
    assert row[0].request.record_id == "<q>" and row[0].metadata.record_id == "<m>"  # the metadata names the request, which names the response


def test_a_response_may_name_its_request(tmp_path, spark):
    parts = [record("response", "<r>", b"x", WARC_Concurrent_To="<q>"), record("request", "<q>", b"y"), record("metadata", "<alone>", b"")]
    (tmp_path / "x.warc").write_bytes(b"".join(parts))
    found = {r.capture_id: r for r in warc.assemble(warc.read_records(spark, str(tmp_path))).collect()}
    assert set(found) == {"<r>", "<alone>"} and found["<r>"].request.record_id == "<q>" and found["<alone>"].response is None


def test_broken_archives_are_errors():
    with pytest.raises(ValueError):
        list(warc.records(b"junk"))
    with pytest.raises(ValueError):
        list(warc.records(record("metadata", "<m>", b"abc")[:-2]))
    with pytest.raises(ValueError):
        warc.inflate(gzip.compress(b"abc" * 100)[:-12])
