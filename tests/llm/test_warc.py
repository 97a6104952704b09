import gzip
import hashlib

from terrabrook.llm import warc
from terrabrook.llm.common import scratch_path

LONG = "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\n" * 60


def test_parse_arc_versions():
    for version in (1, 2):
        rows = [("http://a b/c", "1.2.3.4", "19970102030405", "text/html", 200, b"HTTP/1.0 200 OK\r\n\r\nhi\n\nhttp://x 1 2 3 4\n"), ("dns:x", "0.0.0.0", "199701020304", "text/dns", 0, b"")]
        raw = warc.arc_segment("n.arc", version, rows) + b"broken line\nhttp://z 0.0.0.0 nonsense text/plain "
        raw += (b"" if version == 1 else b"200 c - 0 f ") + b"99\nshort"
        got = list(warc.parse_arc(raw))
        assert [g[0] for g in got] == [version] * 4 and got[0][1] == "filedesc"
        assert [(g[2], g[4], g[8]) for g in got[1:3]] == [("http://a b/c", "1997-01-02T03:04:05Z", rows[0][5]), ("dns:x", "1997-01-02T03:04:00Z", b"")]
        assert got[3][4] == "1996-01-01T00:00:00Z" and got[3][7] and got[3][8] == b"short"
    assert list(warc.parse_arc(b"")) == [] and list(warc.parse_arc(b"\n\njunk")) == []


def test_round_trip(spark):
    pages = [(1, "http://a/ b", LONG), (2, None, LONG), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "short"), (6, "http://f", "short"), (9, "http://g", LONG), (7, "http://g", LONG + "é" * 2_000_000), (8, "", "é" * 500), (8, "", "é" * 500), (None, "http://n", "é" * 500)]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, payload string")
    path = scratch_path(spark, "test")
    warc.write_warc(warc.to_warc(warc.read_arc(warc.pages_to_arc(df.repartition(3))), warc.http_key("X-Page-Id")), path)
    rows = warc.read_warc(spark, path).withColumn("page_id", warc.http_key("X-Page-Id")).collect()
    assert len(rows) == len(pages) and all(r["intact"] is (None if r["record_type"] == "revisit" else True) for r in rows)
    for r in rows:
        body = next((h or "").encode() for p, _, h in pages if p == r["page_id"])
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), hashlib.sha1(body).hexdigest())
        assert r["payload"] == (None if r["record_type"] == "revisit" else body)
    pages_of = {r["record_id"]: r["page_id"] for r in rows}
    assert {r["page_id"]: pages_of[r["refers_to"]] for r in rows if r["record_type"] == "revisit"} == {1: 9, 2: 9, None: 8}
    assert len(pages_of) == len(pages)
    none = scratch_path(spark, "none")
    warc.write_warc(warc.to_warc(warc.read_arc(warc.pages_to_arc(df.limit(0))), warc.http_key("X-Page-Id")), none)
    assert warc.read_warc(spark, none).count() == 0


def test_any_bytes_and_gzip(spark):
    body = bytes(range(256)) * 8
    raw = warc.arc_segment("n.arc", 2, [("ftp://x", "0.0.0.0", "19970102030405", "application/x", 0, body)])
    files = spark.createDataFrame([("a", gzip.compress(raw)), ("b", raw), ("c", None)], "path string, content binary")
    path = scratch_path(spark, "bytes")
    warc.write_warc(warc.to_warc(warc.read_arc(files), warc.F.lit(None).cast("long")), path)
    rows = warc.read_warc(spark, path).collect()
    assert [(r["record_type"], bytes(r["payload"])) for r in rows] == [("resource", body)] * 2


def test_files_are_bounded_by_bytes(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "FILE_ROWS", 2)
    df = spark.createDataFrame([(i, f"http://a/{i}", f"{i} " * 300_000) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    path = str(tmp_path / "warc")
    warc.write_warc(warc.to_warc(warc.read_arc(warc.pages_to_arc(df)), warc.http_key("X-Page-Id")), path)
    sizes = [len(gzip.decompress(p.read_bytes())) for p in (tmp_path / "warc").glob("part-*")]
    assert len(sizes) > 2 and max(sizes) < 3 * warc.SEGMENT
    assert warc.read_warc(spark, path).where("intact").count() == 40
