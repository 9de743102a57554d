"""URL rules and archives, against SQL and round trips."""

import base64
import gzip
import hashlib

import pytest

from graphloom.llm import urlfilter, warc
from graphloom.llm.queries import ORACLE_SQL, QUERIES, URL_RULES

from ..oracle import connect, expected, rows


def test_queries_equal_sql(spark, data):
    duck = connect(data)
    for name in ("op4_url_filter", "op9_warc"):
        got, want = rows(QUERIES[name](spark, data)), expected(duck, ORACLE_SQL[name])
        assert got == want, name


def plain(url):
    host, path = urlfilter.host_and_path(url)
    best = None
    for rule, block in URL_RULES:
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(rule) > len(best[0])):
            best = (rule, block)
    return host, path, best and best[0], "block" if best and best[1] else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://A.EXAMPLE.Org/es/x?y#z", "http://example.org", "http://example.org/", "http://example.org/en/12", "http://xexample.org/es/", "https://m.example.com/de/1", "http://a.com/fr/", "x://b.com?/de/",
    "http://u:p@c.org:80/a", "http://.org/a", "http://a..org/a", "http://org/", "http://EXAMPLE.ORG/ES/", "http://é.org/é", "a://b.org/x://c.com/de/", "http://net/#org/",
]


def test_url_edge_cases(spark):
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)] + [(0, None, "again"), (None, "http://b.org/", "x")], "page_id long, url string, verdict string")
    out = urlfilter.url_filter(df, URL_RULES).collect()
    assert len(out) == len(URLS) + 2
    for r in out:
        url = URLS[r.page_id] if r.page_id is not None else "http://b.org/"
        assert (r.host, r.path, r.rule, r.verdict) == plain(url), url
    assert urlfilter.url_filter(df.limit(0), URL_RULES).count() == 0
    assert {r.verdict for r in urlfilter.url_filter(df, (), default="block").collect()} == {"block"}


def test_equal_digests_are_told_apart_by_their_strings(tmp_path, monkeypatch):
    monkeypatch.setattr(urlfilter.xxhash, "xxh64_intdigest", lambda b: 7)
    urlfilter.DigestArray.write([("org/", False), ("a.org/x", True)], f"{tmp_path}/r")
    a = urlfilter.DigestArray(f"{tmp_path}/r")
    assert a.judge(["http://a.org/xy", "http://b.org/", "http://b.com/"])[2] == ["a.org/x", "org/", None]


PAGES = [
    (1, "http://a/", "same"), (2, "http://b/", "same"), (3, "http://c/", None), (4, None, ""), (5, "http://d/", "WARC/1.1\r\nWARC-Type: response\r\n\r\nContent-Length: 5\r\n\r\n\r\n\r\n"),
    (6, "http://e/\r\nX: y", "é日😀\r\n\r\n"), (6, "http://e/", "other"), (7, "http://f/", "x" * 300_000), (8, "http://g/", "\n"),
]


def test_round_trip_of_odd_payloads(spark, tmp_path):
    df = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, record_type string").repartition(3)
    path = f"file://{tmp_path}/w"
    out = warc.roundtrip(df, path=path).collect()
    assert len(out) == len(PAGES) and not [r for r in out if r.digest_ok is False]
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out)
    assert [g[:3] for g in got] == sorted((p, len((t or "").encode()), sha(t)) for p, _, t in PAGES)
    assert {(g[0], g[3], g[4]) for g in got if g[0] in (1, 2, 3, 4)} == {(1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "revisit", 3)}
    payloads = {bytes(r.payload) for r in warc.read_warc(spark, path, payload=True).where("type = 'response'").collect()}
    assert payloads == {(t or "").encode() for _, _, t in PAGES}
    nested = warc.assemble(warc.read_warc(spark, path))
    assert nested.where("request is null or metadata is null").count() == 0


def test_small_payloads_are_not_revisits(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "same"), (2, "u", "same"), (3, "u", "longer text"), (4, "u", "longer text")], "page_id long, url string, html string")
    out = {r.page_id: r.record_type for r in warc.roundtrip(df, least_bytes=5, path=f"file://{tmp_path}/w").collect()}
    assert out == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_empty_table_and_gzip_members(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.roundtrip(df, path=f"file://{tmp_path}/w").count() == 0
    record = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [b for _, b in warc.parse(gzip.compress(record) + gzip.compress(record))] == [b"abc", b"abc"]
    assert [b for _, b in warc.parse(record * 2)] == [b"abc", b"abc"]


def test_ids_may_hold_anything(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "CAPTURES", 2)
    ids = ["a\r\nb: c", "50% >off<", " lead", "", None, "same", "same", "%00", "/x"]
    df = spark.createDataFrame([(i, "u", f"page {k // 2}") for k, i in enumerate(ids)], "page_id string, url string, html string").coalesce(1)
    path = f"file://{tmp_path}/w"
    out = warc.roundtrip(df, path=path).collect()
    assert sorted(str(r.page_id) for r in out) == sorted(map(str, ids))
    assert {(r.page_id, r.refers_to) for r in out if r.record_type == "revisit"} == {("a\r\nb: c", "50% >off<"), (" lead", ""), ("same", "%00")}
    assert len(list((tmp_path / "w").glob("*.gz"))) >= 4  # no file grows with the table


def test_damaged_payload_stops_the_read(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "some payload")], "page_id long, url string, html string")
    made = warc.write_warc

    def damaged(pages, path, *args):
        made(pages, path, *args)
        folder = tmp_path / "w"
        for f in folder.glob("*.gz"):
            f.write_bytes(gzip.compress(gzip.decompress(f.read_bytes()).replace(b"some payload", b"sime payload")))
        for f in folder.glob(".*.crc"):
            f.unlink()

    warc.write_warc = damaged
    try:
        with pytest.raises(Exception, match="damaged"):
            warc.roundtrip(df, path=f"file://{tmp_path}/w").collect()
    finally:
        warc.write_warc = made
