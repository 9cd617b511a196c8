"""Files that are listed twice count twice, and versions count runs."""

import shutil
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from findery.config import Config
from findery.jobs import deep_scan
from findery.plans import registry
from findery.sources import store as S
from findery.sources.store import Store, index_files
from findery.streaming import ingest
from tests.test_entry import plain


@pytest.fixture(scope="module")
def twice(spark, tmp_path_factory):
    """The smallest tables, with parts 10,000 keys on that share the paths of every second part."""
    at = tmp_path_factory.mktemp("twice")
    for f in Path(entry.SMOKE_DIR).glob("*.parquet"):
        shutil.copyfile(f, at / f.name)
    part = spark.read.parquet(f"{entry.SMOKE_DIR}/part.parquet")
    again = part.where("p_partkey % 2 = 0").withColumn("p_partkey", part.p_partkey + 10_000)
    part.unionByName(again).coalesce(1).write.parquet(f"{at}/p")
    shutil.copyfile(next((at / "p").glob("*.parquet")), at / "part.parquet")
    shutil.rmtree(at / "p")
    return str(at)


NAMES = ["indexed_documents", "gap_fill_merge", "feedback_field_stats", "ambiguity_flags", "search_fielded", "search_ext_filter", "search_combined_filter", "search_batch", "bitmap_candidate_counts", "cancelled_index", "search_batch_stored", "deep_scan_recovered", "streamed_field_stats"]


@pytest.mark.parametrize("name", NAMES)
def test_paths_of_two_parts(spark, twice, name):
    got = registry.QUERIES[name](spark, twice)
    cols = sorted(got.columns)
    rows = sorted(tuple(plain(r[c]) for c in cols) for r in got.collect())
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in ("part", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{twice}/{t}.parquet')")
    cur = con.execute(registry.ORACLE_SQL[name])
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    assert rows == sorted(tuple(plain(r[k]) for k in at) for r in cur.fetchall())


# found at 1 GB, where many parts share a path
@pytest.mark.parametrize("name", ["deep_scan_status", "deep_scan_resumed"])
def test_scans_of_paths_of_two_parts(spark, twice, name):
    test_paths_of_two_parts(spark, twice, name)


@pytest.mark.parametrize("name", ["stored_records", "streamed_index"])
def test_files_of_paths_of_two_parts(spark, twice, name):
    test_paths_of_two_parts(spark, twice, name)


@pytest.mark.parametrize("batch", [None, 2])
def test_files_of_a_path_that_stay_keep_their_records(spark, tmp_path, batch):
    store, config = Store(spark, f"{tmp_path}/i"), Config()

    def run(now, files, **kw):
        rows = [(f"a/{name}.xyz", 1.0, size) for name, size in files]
        index_files(store, spark.createDataFrame(rows, "file_path string, mtime double, size long"), "r", config, now, batch=batch, **kw)
        assert store.manifest().columns == ["file_path", "mtime", "size", "doc_id"] and store.manifest().count() == len(rows)
        return sorted((r.file_name[0], r.indexed_at, r.extraction_status) for r in store.records().collect())

    pending, review = "pending_deep_scan", "needs_review"
    assert run("t1", [("f", 1), ("f", 2), ("f", 2), ("g", 1)]) == [("f", "t1", pending)] * 3 + [("g", "t1", pending)]
    deep_scan(store, f"{tmp_path}/logs", registry._TableReader(), registry._NumberOcr(), config, "t1")
    # one copy changes, one goes, one comes
    assert run("t2", [("f", 3), ("f", 2), ("g", 1), ("g", 1)]) == [("f", "t1", review), ("f", "t2", pending), ("g", "t1", review), ("g", "t2", pending)]
    deep_scan(store, f"{tmp_path}/logs", registry._TableReader(), registry._NumberOcr(), config, "t2")
    assert {r.source_of_metadata for r in store.records().collect()} == {"filename"}
    assert run("t3", [("f", 3), ("g", 1)], drop_deleted=True) == [("f", "t2", review), ("g", "t1", review)]
    assert store.index().fields.count() == store.index().fields.distinct().count()


def test_what_a_stream_leaves_of_a_path(spark):
    arrived = ingest._arrived(spark.createDataFrame([("a", 1.0, 1, "t1"), ("a", 1.0, 2, "t1"), ("a", 2.0, 1, "t2"), ("b", 1.0, 1, "t1"), ("b", 2.0, 1, "t2")], "file_path string, mtime double, size long, seen_at string"))
    assert sorted(map(tuple, arrived.collect())) == [("a", 1.0, 2, "t1"), ("a", 2.0, 1, "t2"), ("b", 2.0, 1, "t2")]
    ddl = "file_path string, mtime double, size long, indexed_at string"
    held = [("a", 1.0, 2, "t0"), ("a", 1.0, 2, "t0"), ("a", 1.0, 3, "t0"), ("b", 2.0, 1, "t0"), ("b", 1.0, 1, "t0"), ("c", 1.0, 1, "t0")]
    left = ingest._listed(arrived, spark.createDataFrame(held, ddl))
    # of "a" one file is known, one takes the place of the first held; "b" is known; "c" is not named
    assert sorted(map(tuple, left.collect())) == [("a", 1.0, 2), ("a", 1.0, 3), ("a", 2.0, 1), ("b", 1.0, 1), ("b", 2.0, 1)]
    again = ingest._listed(arrived, left.selectExpr("*", "'t1' AS indexed_at"))
    assert sorted(again.collect()) == sorted(left.collect())


def test_a_run_of_batches_is_one_version(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "BATCH_FILES", 10)
    assert [S._batches(n, None) for n in (0, 1, 10, 11, 90, 91)] == [0, 1, 1, 2, 3, 4] and S._batches(91, 10) == 10
    store = Store(spark, f"{tmp_path}/i")

    def run(now, sizes, **kw):
        rows = [(f"a/f{k}.pdf", 1.0, s) for k, s in sizes.items()]
        index_files(store, spark.createDataFrame(rows, "file_path string, mtime double, size long"), "r", Config(), now, **kw)
        return store.snapshot()

    sizes = dict.fromkeys(range(100), 1)
    first = run("t1", sizes)
    assert (first.version, len(first.parts), first.rows) == (1, 1, (100,)) and first.step > 0
    second = run("t2", sizes | dict.fromkeys(range(20), 2))
    assert (second.version, len(second.parts), second.rows[0]) == (2, 2, 100) and store.records().count() == 100
    third = run("t3", {k: 2 if k < 20 else 1 for k in range(10, 100)}, drop_deleted=True)
    assert (third.version, len(third.parts)) == (3, 3) and store.records().count() == 90 == store.manifest().count()
    assert store.index().keywords.where("token = 'f5'").isEmpty() and not store.index().keywords.where("token = 'f15'").isEmpty()
