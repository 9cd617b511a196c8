"""Stopped and resumed runs, folders as filtered tables and as streams, logs that survive a crash, shared caches."""

import os
import shutil
import threading
import time

import pytest
from pyspark.sql import functions as F

from findery import jobs
from findery.config import Config
from findery.schema import REVIEW_QUEUE
from findery.sources import corpus, logs
from findery.sources import store as S
from findery.sources.corpus import Test
from findery.sources.store import Store, index_files
from findery.streaming.ingest import stream_index

Test.__test__ = False


def write(root, *paths, text="x"):
    for p in paths:
        at = root / p
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)


def files_frame(spark, n):
    return spark.createDataFrame([(f"a/memo_{k}.pdf", 1.0, k) for k in range(n)], "file_path string, mtime double, size long")


# ---- stopped runs ----


def test_a_stopped_run_keeps_its_batches(spark, tmp_path):
    store, log_dir, files = Store(spark, f"{tmp_path}/i"), f"{tmp_path}/l", files_frame(spark, 100)
    asked, heard = [], []

    def stop():
        asked.append(0)
        return len(asked) > 2

    first = jobs.index(store, log_dir, files, "r", Config(), "t1", batch=20, should_stop=stop, progress=lambda done, total: heard.append((done, total)))
    now = store.snapshot()
    assert first.cancelled and 0 < first.processed < 100 and store.records().count() == first.processed == store.manifest().count()
    assert (now.run.total_files, now.run.to_do, now.run.done) == (100, 100, first.processed)
    assert heard[0] == (0, 100) and heard[-1] == (first.processed, 100) and len(heard) == 3
    second = jobs.index(store, log_dir, files, "r", Config(), "t2", batch=20, progress=lambda done, total: heard.append((done, total)))
    assert not second.cancelled and (second.skipped_unchanged, second.processed) == (first.processed, 100 - first.processed)
    assert heard[3] == (first.processed, 100) and heard[-1] == (100, 100)
    assert {r.indexed_at: r["count"] for r in store.records().groupBy("indexed_at").count().collect()} == {"t1": first.processed, "t2": second.processed}
    third = jobs.index(store, log_dir, files, "r", Config(), "t3")
    assert (third.processed, third.skipped_unchanged, third.cancelled) == (0, 100, False)
    runs = logs.index_runs(spark, f"{log_dir}/index_runs").orderBy("timestamp").collect()
    assert [(r.timestamp, r.processed) for r in runs] == [("t1", first.processed), ("t2", second.processed), ("t3", 0)]


def test_cancelled_spark_jobs_cost_one_batch(spark, tmp_path, monkeypatch):
    """The jobs of the batch under way are cancelled, as the service does; what was published stays."""
    store, work = Store(spark, f"{tmp_path}/i"), jobs.Jobs(spark)
    published, real, long = [], Store.publish, threading.Event()

    def slow(self, *args, **kw):
        if len(published) == 2:
            long.set()
            spark.range(0, 1 << 42, 1, 4).selectExpr("max(hash(id))").collect()
        published.append(real(self, *args, **kw))
        return published[-1]

    monkeypatch.setattr(Store, "publish", slow)
    out = []
    work.start(lambda: out.append(jobs.index(store, f"{tmp_path}/l", files_frame(spark, 60), "r", Config(), "t1", batch=10, should_stop=work.cancelled.is_set, progress=work.count)))
    assert long.wait(120)
    while not work.progress()["tasks"]:
        work.wait(0.1)
    assert work.cancel()
    work.wait(120)
    assert not work.running() and work.error is None
    kept = store.records().count()
    assert 0 < kept < 60 and out[0].cancelled and out[0].processed == kept == work.done
    monkeypatch.setattr(Store, "publish", real)
    assert index_files(store, files_frame(spark, 60), "r", Config(), "t2").first().skipped_unchanged == kept


def test_a_moved_root_in_batches(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/i")
    index_files(store, files_frame(spark, 30), "old", Config(), "t1")
    asked = []
    stop = lambda: asked.append(0) or len(asked) > 1
    first = index_files(store, files_frame(spark, 50), "new", Config(), "t2", batch=10, should_stop=stop).first()
    assert first.corpus_root_changed and first.cancelled and store.records().count() == first.processed
    second = index_files(store, files_frame(spark, 50), "new", Config(), "t3", batch=10).first()
    assert not second.corpus_root_changed and second.skipped_unchanged == first.processed and store.records().count() == 50
    assert len(store.snapshot().parts) <= S.MAX_PARTS


def test_a_run_that_died_is_logged_by_the_next(spark, tmp_path, monkeypatch):
    store, log_dir, files = Store(spark, f"{tmp_path}/i"), f"{tmp_path}/l", files_frame(spark, 10)
    with monkeypatch.context() as m:
        m.setattr(jobs.logs, "put", lambda *a: (_ for _ in ()).throw(RuntimeError("died")))
        with pytest.raises(RuntimeError, match="died"):
            jobs.index(store, log_dir, files, "r", Config(), "t1")
    assert logs.index_runs(spark, f"{log_dir}/index_runs").count() == 0 and store.records().count() == 10
    for now in ("t2", "t3"):
        jobs.index(store, log_dir, files, "r", Config(), now)
    assert sorted((r.timestamp, r.processed) for r in logs.index_runs(spark, f"{log_dir}/index_runs").collect()) == [("t1", 10), ("t2", 0), ("t3", 0)]


def test_claims_of_dead_runs_expire(spark, tmp_path, monkeypatch):
    store = Store(spark, f"{tmp_path}/i")
    os.makedirs(f"{tmp_path}/i/claims")
    (tmp_path / "i/claims/after-0-0").write_text("")
    with pytest.raises(S.Conflict):
        index_files(store, files_frame(spark, 3), "r", Config(), "t1")
    monkeypatch.setattr(S, "CLAIM_SECONDS", 0)
    time.sleep(0.05)
    index_files(store, files_frame(spark, 3), "r", Config(), "t1")
    assert store.records().count() == 3
    with pytest.raises(S.Conflict):  # this one has a successor, however old its claim is
        store.publish(S.Snapshot(spark, store.path), store.records().limit(0), store.manifest().limit(0), "r", "late")


# ---- folders ----


def test_filters_reach_the_walk(spark, tmp_path):
    write(tmp_path, "Riverside/a.pdf", "Riverside/deep/b.PDF", "riverbank/c.docx", "Other/d.pdf", "root.pdf", "Riverside/~$x.pdf", "Riverside/.pdf", "Other/noext")
    os.utime(tmp_path / "Riverside/a.pdf", (5, 5))
    paths = lambda df: {r.file_path for r in df.collect()}
    assert paths(corpus.read_files(spark, str(tmp_path), extensions=[".pdf"], folders=["river"])) == {"Riverside/a.pdf", "Riverside/deep/b.PDF"}
    assert paths(corpus.read_files(spark, str(tmp_path), extensions=[".PDF"], since=100)) == {"Riverside/deep/b.PDF", "Other/d.pdf", "root.pdf"}
    assert paths(corpus.read_files(spark, str(tmp_path), folders=[" ", ""])) == set() == paths(corpus.read_files(spark, str(tmp_path), folders=["none"]))
    assert paths(corpus.read_files(spark, str(tmp_path), extensions=[""])) == {"Other/noext"}
    tree = corpus.read_tree(spark, str(tmp_path))
    plain = spark.createDataFrame(tree.collect(), tree.schema)
    for where in ("file_path like 'Riverside/deep/%'", "file_path = 'root.pdf'", "file_path in ('Other/d.pdf', 'Riverside/a.pdf')", "size < 1", "mtime <= 5 and not junk", "junk", "top_folder = 'Other' or junk", "file_ext is null", "file_path like '%d.pdf'", "size > 0 and upper(top_folder) = 'OTHER'"):
        assert paths(corpus.read_tree(spark, str(tmp_path), where)) == paths(tree.where(where)) == paths(plain.where(where)), where


def test_filters_of_one_frame_do_not_meet(spark, tmp_path):
    """Frames made from one read keep apart, in one plan and one after the other."""
    write(tmp_path, "A/a.pdf", "B/b.docx", "B/.hid")
    for files in (corpus.read_tree(spark, str(tmp_path)), corpus.read_tree(spark, str(tmp_path), "size >= 1")):
        a, b = files.where("top_folder = 'A' and mtime > 1 and size < 9"), files.where("file_ext = '.docx' or junk")
        names = lambda df: sorted(r.file_path for r in df.collect())
        assert names(a.union(b)) == ["A/a.pdf", "B/.hid", "B/b.docx"]
        assert names(a) == ["A/a.pdf"] and names(files.where("junk")) == ["B/.hid"] and names(files) == ["A/a.pdf", "B/.hid", "B/b.docx"] and names(a) == ["A/a.pdf"]


def test_the_plan_shows_pushed_filters(spark, tmp_path):
    write(tmp_path, "A/a.pdf", "B/b.pdf")
    plan = corpus.read_files(spark, str(tmp_path), extensions=[".pdf"], folders=["a"], since=1)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert all(x in pushed for x in ("EqualTo(file_ext,.pdf)", "EqualTo(top_folder,A)", "GreaterThanOrEqual(mtime,1.0)", "Not(EqualTo(junk,true))"))
    assert "Filter (" not in plan


def test_folders_that_stay_closed(spark, tmp_path):
    write(tmp_path, "A/x/1.pdf", "A/y/2.pdf", "B/x/3.pdf", "C/4.pdf")
    found = {r.dir_path: r.opened for r in corpus.visits(spark, str(tmp_path), [Test("file_path", "starts", "A/x/")]).collect()}
    assert found == {".": True, "A": True, "B": False, "C": False, "A/x": True, "A/y": False}
    assert {r.dir_path: r.opened for r in corpus.visits(spark, str(tmp_path), [Test("top_folder", "starts", "B")], walks=1).collect()} == {".": True, "A": False, "B": True, "C": False, "B/x": True}


def test_a_streamed_folder(spark, tmp_path):
    root, got = tmp_path / "tree", []
    write(root, "A/a.pdf", "A/deep/er/b.pdf", "top.pdf", "A/Thumbs.db")
    os.utime(root / "A/a.pdf", (2_000_000_000_000 // 1000, 2_000_000_000))  # a date of modification to come is of no matter

    def run():
        """Another query each time, on the same checkpoint."""
        time.sleep(0.3)
        got.clear()
        stream = corpus.stream_files(spark, str(root), settle=0.1)
        stream.writeStream.foreachBatch(lambda df, k: got.extend(r.file_path for r in df.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        return sorted(got)

    assert run() == ["A/a.pdf", "A/deep/er/b.pdf", "top.pdf"] and run() == []
    write(root, "A/deep/er/c.pdf", "B/d.pdf")
    write(root, "A/a.pdf", text="longer")
    os.utime(root / "A/a.pdf", (1, 1))  # set back, and still a change
    (root / "top.pdf").unlink()
    assert run() == ["A/a.pdf", "A/deep/er/c.pdf", "B/d.pdf"] and run() == []
    write(tmp_path / "elsewhere", "old.pdf", "in/old2.pdf")
    time.sleep(0.3)
    assert run() == []
    shutil.move(tmp_path / "elsewhere", root / "C")  # its files are older than the last run
    assert run() == ["C/in/old2.pdf", "C/old.pdf"] and run() == []


def test_a_streamed_folder_feeds_the_index(spark, tmp_path):
    root, store = tmp_path / "tree", Store(spark, f"{tmp_path}/i")
    for k in range(2):
        write(root, f"A/memo_{k}.pdf")
        time.sleep(0.3)
        stream_index(corpus.stream_files(spark, str(root), settle=0.1), store, str(root), Config(), f"{tmp_path}/cp").awaitTermination()
        assert store.records().count() == k + 1


# ---- logs ----


def entries(spark, n, reason="r"):
    return spark.range(0, n, 1, 3).select(F.lit("t").alias("timestamp"), F.concat(F.lit("f ü "), F.col("id").cast("string")).alias("file_path"), F.lit(reason).alias("reason"), F.lit(None).cast("double").alias("confidence"))


def test_staged_entries(spark, tmp_path):
    at = f"{tmp_path}/log"
    logs.stage(entries(spark, 5), at, "k1")
    assert logs.waiting(at) == ["k1"] and logs.review_queue(spark, at).count() == 0
    logs.stage(entries(spark, 5), at, "k1")  # once more, as by a run that is repeated
    logs.release(at, "k1")
    logs.release(at, "k1")
    logs.put(entries(spark, 5), at, "k1")
    logs.append(entries(spark, 2), at)
    logs.put(entries(spark, 0), at, "empty")
    found = logs.review_queue(spark, at).collect()
    assert len(found) == 7 and {r.file_path for r in found} == {f"f ü {k}" for k in range(5)} and logs.has(at, "empty") and not logs.waiting(at)
    logs.stage(entries(spark, 1), at, "a")
    logs.stage(entries(spark, 1), at, "b")
    logs.stage(entries(spark, 1), at, "c")
    logs.settle(at, {"a"}, ["b"])
    assert logs.waiting(at) == ["c"] and logs.has(at, "a") and not logs.has(at, "b") and logs.review_queue(spark, at).count() == 8
    streamed = []
    logs.read_stream(spark, at, REVIEW_QUEUE).writeStream.foreachBatch(lambda df, _: streamed.extend(df.collect())).trigger(availableNow=True).start().awaitTermination()
    assert len(streamed) == 8


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    at = f"{tmp_path}/log"
    bad = entries(spark, 30).withColumn("reason", F.when(F.col("file_path") == "f ü 29", F.raise_error(F.lit("bad row"))).otherwise("r"))
    with pytest.raises(Exception, match="bad row"):
        logs.stage(bad, at, "k")
    assert not logs.waiting(at) and not os.listdir(f"{at}/{logs.WRITING}") and logs.review_queue(spark, at).count() == 0
    logs.put(entries(spark, 30), at, "k")
    assert logs.review_queue(spark, at).count() == 30


def test_a_crash_between_version_and_log(spark, tmp_path, monkeypatch):
    from test_search import Ocr, Reader

    store, log_dir = Store(spark, f"{tmp_path}/i"), f"{tmp_path}/l"
    index_files(store, spark.createDataFrame([(f"Unsorted/blank_{k}.jpg", 1.0, 1) for k in range(4)], "file_path string, mtime double, size long"), "r", Config(), "t1")
    run = lambda: jobs.deep_scan(store, log_dir, Reader(), Ocr(), Config(), "t2", chunk=2)
    queue = lambda: sorted(r.file_path for r in logs.review_queue(spark, f"{log_dir}/review_queue").collect())

    def die(*_):
        raise RuntimeError("died")

    with monkeypatch.context() as m:  # after staging, before the version
        m.setattr(Store, "_point", die)
        with pytest.raises(RuntimeError):
            run()
    assert queue() == [] and len(logs.waiting(f"{log_dir}/review_queue")) == 1
    with monkeypatch.context() as m:  # after the version, before its entries are shown
        m.setattr(jobs.logs, "release", die)
        with pytest.raises(RuntimeError):
            run()
    assert queue() == [] and store.records().where("extraction_status = 'needs_review'").count() == 2
    assert run() == {"review": 2}
    assert queue() == [f"Unsorted/blank_{k}.jpg" for k in range(4)] and not logs.waiting(f"{log_dir}/review_queue") and run() == {}


def test_chunks_are_read_by_many_tasks(spark, tmp_path):
    from test_search import Ocr, Reader

    from findery.operators import extract

    rows = spark.range(500).select(F.col("id").cast("string").alias("doc_id"), F.lit("a/blank.jpg").alias("file_path"), F.lit(".jpg").alias("file_ext")).orderBy("doc_id").limit(100)
    found = extract.extract(rows, Reader(), Ocr(), Config().extraction)
    assert found.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1 and found.count() == 100


# ---- the cache ----


def test_searches_while_a_version_is_published(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/i")
    with store.cached_index() as index:
        assert index is None
    index_files(store, files_frame(spark, 5), "r", Config(), "t1")
    inside, go, seen, wrong = threading.Barrier(4), threading.Event(), [], []

    def reader():
        try:
            with store.cached_index() as index:
                inside.wait(60)
                go.wait(60)
                seen.append((index.records.count(), index.records.storageLevel.useMemory, id(index)))
        except Exception as e:  # shown below
            wrong.append(e)

    threads = [threading.Thread(target=reader) for _ in range(3)]
    for t in threads:
        t.start()
    inside.wait(60)
    index_files(store, files_frame(spark, 8), "r", Config(), "t2")
    with store.cached_index() as index:
        assert index.records.count() == 8
        old = store._held
        go.set()
        for t in threads:
            t.join(60)
        assert not wrong and len(seen) == 3 and {s[:2] for s in seen} == {(5, True)} and len({s[2] for s in seen}) == 1
        assert store._held is old and old.readers == 1
    assert old.readers == 0 and index.records.storageLevel.useMemory
    assert sum(1 for _ in spark.sparkContext._jsc.getPersistentRDDs()) <= 4
