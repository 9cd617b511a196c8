"""WARC round trips and URL filters."""

import datetime as dt
import hashlib
import random

import pytest

from findery.llm import url_filters, warc

PAGES = [
    (1, "http://www.A.org:80/x?y#z", "p" * 200), (2, "https://a.org/x", "p" * 200), (3, None, None), (4, "not a url", ""), (5, "http://[bad", "short"),
    (6, "http://b.org/short", "short"), (7, "http://www.a.org/x?y", "é" * 60), (8, "http://c.org/a b\nc", "é" * 60), (None, "http://c.org/", "p" * 200), (9, "http://a.org/x", "line\r\n\r\nmore" * 20), (9, "http://a.org/x", "line\r\n\r\nmore" * 20),
]


@pytest.mark.parametrize("lines", [1000, 2])
def test_warc_round_trip(spark, monkeypatch, lines):
    monkeypatch.setattr(warc, "BLOCK_LINES", lines)
    pages = spark.createDataFrame([(*r, "x") for r in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    got = sorted(warc.read_back(spark, pages).collect(), key=lambda r: (r.page_id is None, r.page_id))
    assert [r.page_id for r in got] == [1, 2, 3, 4, 5, 6, 7, 8, 9, 9, None]
    refers = {2: 1, 8: 7}
    html = {i: h or "" for i, _, h in PAGES}
    for r in got:
        assert (r.record_type, r.refers_to) == (("revisit", refers[r.page_id]) if r.page_id in refers else ("response", None))
        assert r.size == len(html[r.page_id].encode())
        if r.payload is not None:
            assert bytes(r.payload).decode() == html[r.page_id]
    assert warc.read_back(spark, pages.limit(0)).count() == 0


def test_url_keys():
    assert warc.url_key("http://u@www.A.org:80/x?y#z") == "org,a,www)/x?y"
    assert warc.url_key(None) == "" and warc.url_key("nohost") == "nohost" and warc.url_key("http://a.b") == "b,a)/"


def test_lookup_of_unknown(spark):
    archive = warc.write(spark.createDataFrame(PAGES[:2], "page_id long, url string, html string"))
    asked = spark.createDataFrame([(1, PAGES[0][1]), (1, "http://zzz.org/"), (77, PAGES[1][1])], "page_id long, url string")
    assert [r.page_id for r in warc.lookup(archive, asked).collect()] == [1]


def test_url_filters(spark):
    day = lambda d: dt.date(2024, 1, d)
    entries = spark.createDataFrame([
        ("domain", "a.org", "block", day(5)), ("domain", "A.org", "drop", day(10)), ("domain", "www.a.org", "allow", day(7)), ("prefix", "www.a.org/x", "block", day(8)),
        ("domain", "b.org", "allow", day(3)), ("domain", "b.org", "block", day(3)), ("domain", None, "block", day(1)), ("bogus", "a.org", "block", day(1)), ("domain", "c.org", "block", None),
    ], "kind string, key string, action string, listed_at date")
    rows = [
        ("http://www.a.org/x/y", day(4), "allow", None), ("http://www.a.org/z", day(5), "block", "a.org"), ("http://www.a.org/z", day(7), "allow", "www.a.org"), ("http://www.A.org:8/x?q", day(8), "block", "www.a.org/x"),
        ("http://q.a.org/", day(9), "block", "a.org"), ("http://q.a.org/", day(10), "allow", None), ("http://b.org", day(3), "block", "b.org"), ("http://xb.org", day(3), "allow", None), (None, day(3), "allow", None), ("http://b.org", None, "allow", None), ("junk", day(3), "allow", None), ("http://b.org", day(3), "block", "b.org"),
    ]
    captures = spark.createDataFrame([(k, u, t, "clash") for k, (u, t, _, _) in enumerate(rows)], "k int, url string, fetched_at date, verdict string")
    got = {r.k: (r.verdict, r.matched_key) for r in url_filters.evaluate(captures, entries).collect()}
    assert got == {k: r[2:] for k, r in enumerate(rows)}
    assert url_filters.evaluate(captures.limit(0), entries).count() == 0
    assert url_filters.evaluate(captures, entries.limit(0)).where("verdict = 'allow'").count() == len(rows)
    plan = url_filters.evaluate(captures, entries)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_repeated_ids_with_other_payloads(spark):
    rnd = random.Random(4)
    payloads = ["a" * 200, "b" * 200, "é" * 60, "c" * 99, "d" * 100, "", None]
    urls = ["http://a.org/x", "https://a.org/x", "http://b.org/", None, "", "junk"]
    rows = [(rnd.choice([1, 2, 9, 9, 9, 20, 21, None]), rnd.choice(urls), rnd.choice(payloads)) for _ in range(150)]
    rows += [(1, "http://a.org/x", "a" * 200), (2, "http://a.org/x", "b" * 200), (9, "http://a.org/x", "a" * 200), (9, "http://a.org/x", "b" * 200)]
    pages = spark.createDataFrame([(*r, 5, "x") for r in rows], "page_id long, url string, html string, size int, digest string").repartition(5)
    first = {}
    for i, _, h in rows:
        if i is not None and h is not None and len(h.encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    want = []
    for i, _, h in rows:
        refers = first[h] if i is not None and h in first and first[h] < i else None
        raw = (h or "").encode()
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if refers is None else "revisit", refers))
    got = [(r.page_id, r.size, r.digest, r.record_type, r.refers_to) for r in warc.read_back(spark, pages).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
