import base64
import hashlib

from tidemark.llm import warc

PAGES = [
    (1, "http://a.example.org/x?q=1", "<p>one</p>"),
    (2, "http://b.example.org/y", "<p>one</p>"),
    (5, "http://a.example.org/x?q=1", "größe\r\n\r\nUSER"),
    (7, None, None),
    (8, "no scheme \n here", ""),
    (None, "http://c.example.net", "<p>one</p>"),
    (9, "https://WWW.Example.com", "z" * 300_000),
    (9, "https://WWW.Example.com", "z" * 300_000),
]


def brute(rows, least):
    top = {}
    for k, _, h in rows:
        if k is not None:
            top[h or ""] = max(k, top.get(h or "", k))
    out = []
    for k, _, h in rows:
        data = (h or "").encode()
        keeper = top.get(h or "")
        alone = len(data) < least or k == keeper
        out.append((
            k, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
            "response" if alone else "revisit", None if alone else keeper,
        ))
    return sorted(out, key=repr)


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 key", "'d' digest")


def read(capture):
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted((tuple(r[c] for c in columns) for r in capture.read().collect()), key=repr)


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    monkeypatch.setattr(warc, "FILE_BYTES", 500)
    for least in (0, 11):
        assert read(warc.write(pages(spark).repartition(3), least)) == brute(PAGES, least)


def test_look_up_finds_all_captures_of_a_url(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    rows = [(i, f"http://h{i % 7}.example.org/p{i % 13}", f"text {i % 5}") for i in range(200)]
    capture = warc.write(pages(spark, rows))
    asked = spark.createDataFrame([("http://h3.example.org/p4#top",), ("http://none.example.org/",)], "url string")
    found = warc.look_up(capture, asked).collect()
    assert sorted(r["page_id"] for r in found) == [i for i in range(200) if i % 7 == 3 and i % 13 == 4]
    assert {r["asked_key"] for r in found} == {"org,example,h3)/p4"}


def test_looking_up_all_urls_reads_every_record(spark):
    """Several blocks of one URL, URLs that were not captured, and a URL key per odd page."""
    rows = PAGES + [(100 + i, "http://hot.example.org/", f"text {i % 50}") for i in range(2500)]
    rows += [(5000 + i, f"http://h{i}.example.org/", None) for i in range(1200)]
    df = pages(spark, rows).repartition(5)
    capture = warc.write(df)
    assert capture.directory.count() >= 4
    asked = df.select("url").unionByName(spark.createDataFrame([(f"http://n{i}.example.org/",) for i in range(300)], "url string"))
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    found = sorted((tuple(r[c] for c in columns) for r in warc.look_up(capture, asked).collect()), key=repr)
    assert found == brute(rows, 0) == read(capture)


def test_close_records_are_one_read(tmp_path, monkeypatch):
    (tmp_path / "a").write_bytes(bytes(range(200)))
    reads = []
    ranges = warc._Ranges(f"file://{tmp_path}")
    real = ranges.get
    monkeypatch.setattr(ranges, "get", lambda *a: reads.append(a) or real(*a))
    monkeypatch.setattr(warc, "GAP_BYTES", 5)
    monkeypatch.setattr(warc, "READ_BYTES", 60)
    asked = [("k", "a", 50, 10), ("k", "a", 0, 10), ("k", "a", 12, 8), ("k", "a", 62, 50), ("k", "a", 112, 20)]
    got = {r[2]: data for r, data in ranges.near(asked)}
    assert got == {p: bytes(range(p, p + n)) for _, _, p, n in asked}
    assert reads == [("a", 0, 20), ("a", 50, 10), ("a", 62, 50), ("a", 112, 20)]


def test_no_pages(spark):
    none = pages(spark, [])
    capture = warc.write(none)
    assert read(capture) == [] and warc.look_up(capture, none).count() == 0
