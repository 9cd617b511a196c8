"""List entries for root urls and short hosts: against the query's SQL, and by hand."""

import datetime as dt

import duckdb

from findery.llm import queries, url_filters


def test_roots_and_short_hosts_against_sql(spark, tmp_path):
    hosts = ["example.com", "www.example.com", "a.b.example.com", "other.com", "localhost", "A.org", "x.a.org", "com", "b.net"]
    paths = ["", "/", "//", "//x", "/x", "/x/", "/x/y", "/X?q", "/?q", "#f", "?q"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] * 6
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)] + [(9990, "junk", "x"), (9991, None, "x")], "page_id long, url string, html string")
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    cur = con.execute(queries.OP3_SQL)
    cols = [d[0] for d in cur.description]
    got = [tuple(str(r[c]) for c in cols) for r in queries.op3_url_filters(spark, str(tmp_path)).collect()]
    want = [tuple(map(str, r)) for r in cur.fetchall()]
    assert {r[5] for r in want} >= {"com", "example.com/", "localhost", "localhost/"}
    assert sorted(got) == sorted(want)


def test_entry_spellings(spark):
    day = dt.date(2024, 1, 1)
    entries = [("prefix", "a.org/dir/", "block"), ("prefix", "B.org//", "block"), ("prefix", "c.org/d/e//", "block"), ("domain", "localhost", "block"), ("domain", "net", "block")]
    asked = {"http://a.org/dir/x": "block", "http://a.org/": "allow", "http://b.org": "block", "http://b.org/x": "allow", "http://c.org/d/e/f": "block", "http://c.org/d": "allow", "http://localhost:8/x": "block", "http://q.net/x": "block", "http://p.q.net/x": "allow"}
    listed = spark.createDataFrame([(*e, day) for e in entries], "kind string, key string, action string, listed_at date")
    captures = spark.createDataFrame([(u, day) for u in asked], "url string, fetched_at date")
    assert {r.url: r.verdict for r in url_filters.evaluate(captures, listed).collect()} == asked


def test_columns_of_captures_stay(spark):
    day = dt.date(2024, 1, 1)
    listed = spark.createDataFrame([("domain", "a.org", "block", day)], "kind string, key string, action string, listed_at date")
    names = ["a.b", "_u", "_t", "_m", "kind", "depth"]
    captures = spark.createDataFrame([("http://a.org/", day, *names, "old"), ("http://a.org/", day, *names, "old"), (None, day, *names, "old")], f"url string, fetched_at date, {', '.join(f'`{n}` string' for n in names)}, Verdict string")
    got = url_filters.evaluate(captures, listed)
    assert got.columns == ["url", "fetched_at", *names, "host", "verdict", "matched_kind", "matched_key", "active_from"]
    assert sorted((r.verdict, tuple(r)[2:8]) for r in got.collect()) == [("allow", tuple(names)), *[("block", tuple(names))] * 2]
    assert url_filters.evaluate(captures.limit(0), listed).count() == 0
