import os
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from findery.config import Config, Ranking, Rules
from findery.operators import facets, records
from findery.operators import feedback as fb
from findery.schema import FEEDBACK, INDEX_RUNS
from findery.sources import corpus, logs
from findery.sources.store import Store, index_files
from findery.streaming.ingest import feedback_precision, stream_index


@pytest.fixture
def folder(tmp_path):
    for p in ("A/memo_2020.pdf", "A/_x.pdf", ".dot/y é&.pdf", "root.txt", "A/desktop.ini", "A/empty.pdf"):
        path = tmp_path / "corpus" / p
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"" if "empty" in p else b"x")
    return tmp_path


def test_folder_source(spark, folder):
    got = {r.file_path: r for r in corpus.read_files(spark, f"{folder}/corpus").collect()}
    assert set(got) == {"A/memo_2020.pdf", "A/_x.pdf", ".dot/y é&.pdf", "root.txt", "A/empty.pdf"}
    stat = os.stat(folder / "corpus/A/memo_2020.pdf")
    assert (got["A/memo_2020.pdf"].mtime, got["A/memo_2020.pdf"].size) == (stat.st_mtime, 1)
    assert {r.dir_path for r in corpus.read_folders(spark, f"{folder}/corpus").collect()} == {"A", ".dot"}


def test_incremental_index(spark, folder):
    store, root = Store(spark, f"{folder}/index"), f"{folder}/corpus"
    assert store.index() is None and store.records().count() == 0

    def run(now, **kw):
        return index_files(store, corpus.read_files(spark, root), root, Config(), now, **kw).first()

    first = run("t1")
    assert (first.total_files, first.processed, first.skipped_unchanged, first.corpus_root_changed) == (5, 5, 0, False)
    version = store.current().version
    again = run("t2")
    assert (again.processed, store.current().version) == (0, version)
    (folder / "corpus/A/memo_2020.pdf").write_bytes(b"longer")
    (folder / "corpus/root.txt").unlink()
    assert run("t3").processed == 1
    assert store.records().count() == 5 and store.record(store.records().where("file_name = 'memo_2020.pdf'").first().doc_id).indexed_at == "t3"
    assert run("t4", drop_deleted=True).processed == 0 and store.records().count() == 4
    moved = index_files(store, corpus.read_files(spark, root), "/elsewhere", Config(), "t5").first()
    assert moved.corpus_root_changed and store.records().count() == 4
    with pytest.raises(KeyError):
        store.record("nothing")


def test_a_run_writes_only_what_is_new(spark, tmp_path, monkeypatch):
    from findery.sources import store as S

    store = Store(spark, f"{tmp_path}/index")
    rows = {f"a/f{k}.pdf": 1.0 for k in range(40)}

    def run(now, **kw):
        return index_files(store, spark.createDataFrame([(p, m, 1) for p, m in rows.items()], "file_path string, mtime double, size long"), "r", Config(), now, **kw).first()

    run("t0")
    stamps = {p: "t0" for p in rows}
    for k in range(1, 4):
        path = f"a/f{k}.pdf"
        rows[path] += 1
        stamps[path] = f"t{k}"
        assert run(f"t{k}").processed == 1
    now = store.snapshot()
    assert now.rows == (40, 1, 1, 1) and len(now.parts) == 4
    assert {r.file_path: r.indexed_at for r in store.records().collect()} == stamps
    assert store.manifest().count() == 40 and store.index().fields.count() == sum(1 for _ in store.index().fields.distinct().collect())
    del rows["a/f1.pdf"], rows["a/f9.pdf"]
    run("t5", drop_deleted=True)
    assert store.records().count() == 38 == store.manifest().count() and store.index().keywords.where("token = 'f1'").count() == 0
    old = store.snapshot()
    monkeypatch.setattr(S, "MAX_PARTS", 2)
    rows["a/f3.pdf"] += 1
    run("t6")
    assert len(store.snapshot().parts) == 1 and store.records().count() == 38
    assert old.records().count() == 38  # an older version can still be read
    with pytest.raises(S.Conflict):
        store.publish(old, store.records().limit(0), store.manifest().limit(0), "r", "late")
    assert store.vacuum() >= 5 and store.records().count() == 38
    rows["a/new.pdf"] = 1.0
    assert run("t7").processed == 1 and store.records().count() == 39


def test_deep_folders(spark, tmp_path):
    paths = {f"top/{a}/{b}/{c}/f.txt" for a in "ab" for b in "cde" for c in "xy"} | {"top/one.txt", "top/a/two.txt", "top/b/c/three.txt"}
    for p in paths:
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    for walks in (1, 3, 64):
        files = corpus.read_files(spark, f"{tmp_path}", walks=walks)
        assert {r.file_path for r in files.collect()} == paths and files.count() == len(paths)
        assert files.rdd.getNumPartitions() >= {1: 1, 3: 6, 64: 20}[walks]
    assert {r.dir_path for r in corpus.read_folders(spark, f"{tmp_path}").collect()} == {str(q) for p in paths for q in Path(p).parents if str(q) != "."}


def test_stream_index(spark, folder):
    drop = f"{folder}/drop"
    spark.createDataFrame([("a/memo_1.pdf", 1.0, 2, "t1")], "file_path string, mtime double, size long, seen_at string").write.parquet(drop)
    store = Store(spark, f"{folder}/index2")
    files = spark.readStream.schema("file_path string, mtime double, size long, seen_at string").parquet(drop)
    stream_index(files, store, "s", Config(), f"{folder}/cp").awaitTermination()
    assert [r.file_path for r in store.records().collect()] == ["a/memo_1.pdf"]


def test_logs_and_runs(spark, tmp_path):
    path = f"{tmp_path}/runs"
    assert logs.index_runs(spark, path).count() == 0
    logs.append(spark.createDataFrame([(f"2024-01-{d:02d}", "r", d, 0, 0, False) for d in range(1, 26)], INDEX_RUNS), path)
    rows = facets.recent_runs(logs.index_runs(spark, path)).collect()
    assert len(rows) == 20 and rows[0].timestamp == "2024-01-25"


def test_tuning(spark):
    made = spark.createDataFrame([("d1", "a/TK-14.pdf", "TK-14")], "doc_id string, file_path string, equipment_tag string")
    for c, t in (("project_name", "string"), ("doc_type", "string"), ("department", "string"), ("year", "int")):
        made = made.withColumn(c, F.lit(None).cast(t))
    made = made.withColumns({"keywords": F.array(F.lit("tk"), F.lit("14")), "extraction_status": F.lit("ok")})
    rows = [("t", "TK-14", [], [], False, False, "d1", k < 9) for k in range(10)] + [("t", "TK-14", [], [], False, False, c, True) for c in (None, "", "gone")]
    stats = fb.field_stats(spark.createDataFrame(rows, FEEDBACK), made, Rules(), Ranking())
    got = {r.field_name: r for r in fb.suggestions(stats).collect()}
    assert got["equipment_tag"].suggested_weight == 48.0 and got["equipment_tag"].reason.startswith("high precision (90% over 10 samples)")
    assert got["keyword"].samples == 10 and got["year"].suggested_weight is None and got["year"].precision is None
    assert "equipment_tag = 48.0" in fb.weights_toml(fb.suggestions(stats))
    assert fb.unattributed(spark.createDataFrame(rows, FEEDBACK)).first().unattributed == 2


def test_bands(spark):
    stats = spark.createDataFrame([("a", 3.0, 2, 8), ("b", 15.0, 7, 3), ("c", 5.0, 2, 0)], "field_name string, current_weight double, correct long, incorrect long")
    stats = stats.withColumn("samples", F.expr("correct + incorrect")).withColumn("precision", F.expr("correct / samples"))
    assert {r.field_name: r.suggested_weight for r in fb.suggestions(stats).collect()} == {"a": 2.4, "b": 15.0, "c": None}


def test_feedback_windows(spark):
    rows = spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'd' chosen_doc_id, true correct union all select timestamp'2024-01-01 00:50:00', 'd', false union all select timestamp'2024-01-01 00:50:00', '', true")
    got = feedback_precision(rows).collect()
    assert [(r.entries, r.correct, r.precision) for r in got] == [(2, 1, 0.5)]


def test_command_line(spark, folder, capsys, monkeypatch):
    from findery import cli

    base = ["--index-dir", f"{folder}/ci", "--log-dir", f"{folder}/cl"]
    assert cli.main([*base, "search", "memo"]) == 1
    assert cli.main([*base, "index", "--corpus-root", f"{folder}/corpus"]) == 0
    assert "5 files, 5 processed, 0 unchanged, 5 pending" in capsys.readouterr().out
    assert cli.main([*base, "search", "memo 2020"]) == 0 and "1. A/memo_2020.pdf" in capsys.readouterr().out
    assert cli.main([*base, "suggest-projects", "--corpus-root", f"{folder}/corpus"]) == 0
    assert '"A" = ["A"]' in capsys.readouterr().out
    assert spark.range(1).select(records.project_rule(F.lit("Big Plant"))).first()[0] == '"Big Plant" = ["Big\\\\s*Plant"]'
    for name in ("a.b (c)", "x\\y-z", "1+1 & 2~3", "Ü [é]{2} ^$|*?#"):
        line = spark.range(1).select(records.project_rule(F.lit(name))).first()[0]
        assert re.fullmatch(line.split('["')[1].split('"]')[0].replace("\\\\", "\\"), name)
    for command in ("review-queue", "facets", "suggest-tuning"):
        assert cli.main([*base, command]) == 0
    assert "[ranking_weights]" in capsys.readouterr().out
    import json

    assert cli.main([*base, "search", "memo 2020", "--json"]) == 0
    payload = json.loads(capsys.readouterr().out)
    assert payload["query"] == "memo 2020" and payload["results"][0]["file_path"] == "A/memo_2020.pdf" and not payload["used_llm_rerank"]
    answers = iter(["7", "1"])
    monkeypatch.setattr("builtins.input", lambda _: next(answers))
    assert cli.main([*base, "search", "memo 2020", "--interactive"]) == 0
    entry = logs.feedback(spark, f"{folder}/cl/feedback").first()
    assert entry.query == "memo 2020" and entry.correct and entry.chosen_doc_id == payload["results"][0]["doc_id"]
    assert cli.main([*base, "vacuum"]) == 0
    (folder / "corpus/A/memo_2020.pdf").write_bytes(b"longer")
    assert cli.main([*base, "index", "--corpus-root", f"{folder}/corpus", "--deep-scan", "--workers", "2", "--reader", "test_deep_scan_command:Reader", "--ocr", "test_deep_scan_command:Ocr"]) == 0
    said = capsys.readouterr().out
    assert "5 files, 1 processed, 4 unchanged, 5 pending" in said and "0 filled, 5 to review" in said


def test_deep_scan_in_chunks(spark, folder):
    from test_search import Ocr, Reader

    from findery import jobs

    store = Store(spark, f"{folder}/ds")
    files = spark.createDataFrame([("Unsorted/old_backup.pdf", 1.0, 1), ("Unsorted/blank.jpg", 1.0, 1)], "file_path string, mtime double, size long")
    index_files(store, files, "r", Config(), "t1")
    seen = []
    stop = lambda: len(seen) == 1
    run = lambda **kw: jobs.deep_scan(store, f"{folder}/dl", Reader(), Ocr(), Config(), "t2", chunk=1, progress=lambda done, total: seen.append((done, total)) if done else None, **kw)
    assert sum(run(should_stop=stop).values()) == 1
    assert seen == [(1, 2)]
    seen.append(0)
    assert sum(run().values()) == 1 and run() == {}
    assert {r.extraction_status for r in store.records().collect()} == {"ok", "needs_review"}
    assert logs.review_queue(spark, f"{folder}/dl/review_queue").count() == 1


def test_service(spark, folder):
    import json
    import threading
    import urllib.error
    import urllib.request

    from findery.serve import Service, serve

    from test_search import Ocr, Reader

    shown = []
    service = Service(spark, Store(spark, f"{folder}/si"), f"{folder}/sl", f"{folder}/corpus", reader=lambda root: Reader(), ocr=Ocr(), revealer=lambda path: not shown.append(path))
    server = serve(service, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def ask(path, body=None):
        data = None if body is None else json.dumps(body).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", data)) as r:
                raw = r.read()
                return r.status, json.loads(raw) if "json" in r.headers["Content-Type"] else raw
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    try:
        assert ask("/healthz") == (200, {"status": "ok"}) and ask("/nowhere")[0] == 404 and ask("/file/")[0] == 404
        assert b"<form" in ask("/")[1] and b"<form" in ask("/index-documents")[1]
        assert ask("/search", {"query": "memo"})[0] == 409 and ask("/search", {"query": " "}) == (200, {"results": []})
        assert ask("/index-documents/start", {"corpus_root": f"{folder}/nowhere"})[0] == 400 and ask("/index-documents", {"corpus_root": f"{folder}/nowhere"})[0] == 400
        assert ask("/index-documents/cancel", {})[0] == 409 and ask("/deep-scan/cancel", {})[0] == 409
        assert ask("/index-documents/start", {})[0] == 202
        service.indexing.wait(120)
        done = ask("/index-documents/progress")[1]
        assert done["error"] is None and done["summary"]["processed"] == 5 and done["phase"] == "building" and not done["running"]
        assert ask("/index-documents", {"rebuild": True})[1]["processed"] == 5
        status, found = ask("/search", {"query": "memo 2020", "top_n": 1})
        assert status == 200 and found["results"][0]["file_path"] == "A/memo_2020.pdf" and found["results"][0]["direct_open"]
        doc = found["top_doc_ids"][0]
        assert ask(f"/file/{doc}") == (200, b"x") and ask("/file/nothing")[0] == 404
        assert ask(f"/reveal/{doc}", {}) == (200, {"status": "ok"}) and shown == [f"{folder}/corpus/A/memo_2020.pdf"]
        service.revealer = lambda path: False
        assert ask(f"/reveal/{doc}", {})[0] == 501
        (folder / "corpus/A/memo_2020.pdf").unlink()
        assert ask(f"/file/{doc}")[0] == 404
        assert ask("/feedback", {"query": "memo"})[0] == 400
        assert ask("/feedback", {"query": "memo", "correct": True, "chosen_doc_id": doc})[0] == 200
        assert logs.feedback(spark, f"{folder}/sl/feedback").count() == 1
        facets_ = ask("/facets")[1]
        assert facets_["pending"] == 5 and ask("/facets?offset=1")[1]["extensions"] == facets_["extensions"][1:] and len(ask("/runs")[1]) == 2 and ask("/review-queue")[1] == []
        assert ask("/index-documents?json")[1]["pending"] == 5
        assert ask("/deep-scan", {})[0] == 202
        service.scanning.wait(120)
        done = ask("/deep-scan/progress")[1]
        assert done["error"] is None and (done["done"], done["total"]) == (5, 5) and sum(done["summary"].values()) == 5
        assert ask("/facets")[1]["pending"] == 0
    finally:
        server.shutdown()
        server.server_close()


def test_jobs_stop_when_asked(spark):
    import threading

    from findery.jobs import Busy, Jobs

    jobs, go = Jobs(spark), threading.Event()

    def work():
        jobs.enter("first")
        go.wait(60)
        jobs.enter("second")

    assert not jobs.cancel()
    jobs.start(work)
    with pytest.raises(Busy):
        jobs.start(work)
    assert jobs.progress()["running"] and jobs.cancel()
    go.set()
    jobs.wait(60)
    end = jobs.progress()
    assert (end["phase"], end["cancelled"], end["error"], end["running"]) == ("first", True, None, False)
    slow = lambda: spark.range(0, 1 << 40, 1, 4).selectExpr("max(hash(id))").collect()
    jobs.start(slow)
    for _ in range(100):
        if jobs.progress()["tasks"]:
            break
        jobs.wait(0.1)
    assert jobs.progress()["tasks"] > 0 and jobs.cancel()
    jobs.wait(60)
    assert not jobs.running()


def test_loose_documents_and_entries(spark):
    from findery.operators import search

    kw = spark.createDataFrame([("compressor", "d1", 0), ("compressorstation", "d2", 0), ("pump", "d3", 0)], "token string, doc_id string, pos int")
    got = search.loose_documents(spark.createDataFrame([("compressor",)], "q_token string"), kw).collect()
    assert [(r.doc_id, r.token) for r in got] == [("d2", "compressorstation")]
    env = spark.createDataFrame([(1, "q", ["d1"], [1.0], False, 3, False)], "query_id int, raw_query string, top_doc_ids array<string>, scores array<double>, ambiguous boolean, candidate_count long, used_llm_rerank boolean")
    row = fb.entries(env, spark.createDataFrame([(1, "d1", True)], "query_id int, chosen_doc_id string, correct boolean"), "t").first()
    assert (row.query, row.chosen_doc_id, row.correct) == ("q", "d1", True)
