"""Archives: round trip through the index, revisits, odd rows."""

import random

import pytest

from duewatch.llm.warc import Archive, digest, parsed, record, url_key

PAGES = "page_id long, url string, html string, surt string, digest int"


@pytest.mark.parametrize(("url", "key"), [
    ("http://www.Example.com/A/b?z=1&A=2#f", "com,example)/a/b?a=2&z=1"), ("https://m.example.org:8080", "org,example,m:8080)/"),
    ("https://example.org:443/", "org,example)/"), (None, ""), ("", ""), ("http://[bad/x", ")http://[bad/x"),
])
def test_url_keys(url, key):
    assert url_key(url) == key


def test_record_round_trip():
    for page, url, payload, refers in [(1, "http://a/ \r\nX: y%41é", b"\r\n\r\nbody\r\n", None), (None, None, b"", None), (3, "", b"x" * 100_000, -7)]:
        found = parsed(record(page, url, payload, digest(payload), refers))
        assert (found["page_id"], found["target"], found["refers_to"]) == (page, url, refers)
        assert found["payload"] == (payload if refers is None else None) and found["payload_bytes"] == len(payload)


def test_round_trip_through_the_index(spark):
    rng = random.Random(3)
    rows = [(k, f"http://{'hot' if k % 3 else f'h{k % 50}'}.example.com/p{k % 97 if k % 2 else ''}", f"<p>{rng.randrange(400)}é") for k in range(2500)]
    rows += [(9000, None, None), (9001, "", ""), (9002, "tab\there\nand %09", "x"), (9003, "http://x/", "y" * 200_000), (None, "http://x/", "null id"),
             (7, rows[7][1], rows[7][2]), (8, "http://other/", "two payloads of one id"), (9004, "http://z/", "two payloads of one id")]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], PAGES).repartition(6)
    archive = Archive.write(df)
    found = archive.read(df).collect()
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(first.get(html or "", page), page)
    wanted = []
    for page, url, html in rows:
        html = html or ""
        refers = None if page is None or first[html] == page else first[html]
        wanted.append((page, url, "revisit" if refers is not None else "response", refers, len(html.encode()), digest(html.encode()), None if refers is not None else html.encode()))
    got = [(r.page_id, r.target, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.payload and bytes(r.payload) if r.payload is not None else None) for r in found]
    assert sorted(map(repr, got)) == sorted(map(repr, wanted))
    some = spark.createDataFrame([(9003, "http://x/"), (12345, "http://x/"), (1, "http://not.there/")], "page_id long, url string")
    assert [r.page_id for r in archive.read(some).collect()] == [9003]


def test_empty(spark):
    df = spark.createDataFrame([], PAGES)
    assert Archive.write(df).read(df).collect() == []


def test_a_changed_byte_is_noticed(spark, tmp_path):
    raw = record(5, "http://a/", b"<p>payload</p>", digest(b"<p>payload</p>"), None)
    at = raw.index(b"payload</p>")
    with pytest.raises(ValueError, match="urn:page:5"):
        parsed(raw[:at] + b"P" + raw[at + 1 :])
    with pytest.raises(ValueError, match="urn:page:5"):
        parsed(raw.replace(b"Content-Length: 7", b"Content-Length: 6"))
    pages = spark.createDataFrame([(k, f"http://h/{k}", f"<p>{k}" * 50) for k in range(40)], "page_id long, url string, html string")
    archive = Archive.write(pages, f"file://{tmp_path}/w")
    assert len({r.payload_digest for r in archive.read(pages).collect()}) == 40
    name = next(p for p in (tmp_path / "w").iterdir() if p.name.startswith("archive"))
    data = bytearray(name.read_bytes())
    data[len(data) // 2] ^= 1
    name.write_bytes(data)
    with pytest.raises(Exception, match="error|written"):
        archive.read(pages).collect()


def test_reading_tasks_follow_the_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("duewatch.llm.warc.READ_BYTES", 1000)
    pages = spark.createDataFrame([(k, f"http://h/{k}", f"<p>{k}" * 50) for k in range(60)], "page_id long, url string, html string")
    found = Archive.write(pages, f"file://{tmp_path}/w").read(pages)
    assert found.rdd.getNumPartitions() > 5 and found.count() == 60
