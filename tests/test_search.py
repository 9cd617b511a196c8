import random

import pytest
from pyspark.sql import functions as F

from findery.config import Ranking, Rules
from findery.operators import extract, records, search
from findery.operators.extract import Extraction, Recognized, mean_confidence, pixel_scale
from findery.config import Rerank
from findery.operators.rerank import NoBackend, ReplyBackend, backend_for

FILES = """RiversidePlant/PID/RiversidePlant_PID_Unit3_2021.pdf
RiversidePlant/Isometric/HX-203_Isometric_Rev2.pdf
RiversidePlant/Datasheet/TK-14_Datasheet_2019.pdf
RiversidePlant/Memo/RiversidePlant_Memo_2020_SafetyReview.pdf
CompressorStation/PID/CompressorStation_PID_Unit1_2018.pdf
CompressorStation/Electrical/IMG_20190304_Electrical_MotorRoom.jpg
Unsorted/old_backup_copy_final_v2.pdf
Unsorted/nameplate_photo_scan.pdf
Legacy/blurry_scan_noname.pdf
Unsorted/photo_0042.jpg""".split("\n")

TEXTS = {"old_backup": "Compressor Station Memo Safety Review 2015"}
SCANS = {"nameplate": "RIVERSIDE PLANT ISOMETRIC HX-450 2016", "photo_0042": "Riverside Plant Electrical MotorRoom P-330"}

GOLDEN = [
    ("P&ID for unit 3 riverside plant 2021", "648bf91868ec", 1, 53.4, 31.0, 7, False),
    ("isometric drawing for HX-203", "91a72c4d82e7", 1, 64.0, 6.0, 2, False),
    ("datasheet for TK-14 riverside plant 2019", "f62e5e13de9d", 1, 100.6, 31.0, 6, False),
    ("safety review memo riverside plant 2020", "fe27f2eafb06", 1, 58.2, 31.0, 7, False),
    ("P&ID compressor station unit 1 2018", "7362868437e5", 1, 53.4, 31.0, 4, False),
    ("electrical photo motor room 2019", "393171e38b4b", 2, 34.6, 31.6, 4, True),
    ("compressor station memo safety review 2015", "2239a7262c85", 1, 60.0, 28.6, 4, False),
    ("isometric HX-450", "cb301be4f2d9", 1, 49.0, 21.0, 2, False),
    ("electrical motor room P-330", "c54dc9f2aef1", 1, 59.6, 16.6, 2, False),
]


class Reader:
    def text_layer(self, path, max_pages):
        return next((t for k, t in TEXTS.items() if k in path), "")

    def images(self, path, ext, config):
        return [next((t for k, t in SCANS.items() if k in path), "")]


class Ocr:
    def recognize(self, images):
        return Recognized(images[0], 0.9 if images[0] else 0.0)


@pytest.fixture(scope="module")
def scanned(spark):
    made = records.to_records(spark.createDataFrame([(p,) for p in FILES], "file_path string"), Rules(), "2024")
    found = extract.extract(extract.pending(made), Reader(), Ocr(), Extraction()).cache()
    return made, found, extract.merge(made, found, Rules()).cache()


def test_deep_scan(scanned):
    _, found, done = scanned
    by = {r.doc_id: r for r in done.collect()}
    memo, plate, blurry, photo = (by[k] for k in ("2239a7262c85", "cb301be4f2d9", "32201fa53c52", "c54dc9f2aef1"))
    assert (memo.project_name, memo.doc_type, memo.year, memo.extraction_status, memo.source_of_metadata) == ("Compressor Station", "memo", 2015, "ok", "filename+pdf_text")
    assert (plate.doc_type, plate.year, plate.equipment_tag, plate.ocr_confidence) == ("photo", 2016, "HX-450", 0.9)
    assert (blurry.extraction_status, blurry.source_of_metadata) == ("needs_review", "filename")
    assert photo.keywords == ["photo", "0042", "unsorted", "riverside", "plant", "electrical", "motorroom", "330"] and photo.equipment_tag == "P-330"
    assert [r.reason for r in extract.review_entries(found, "t").collect()] == ["low_confidence_ocr"]
    assert extract.extraction_log(found, "t").count() == 4


def test_golden_queries(spark, scanned):
    index = search.Index.build(scanned[2])
    asked = spark.createDataFrame([(k, g[0]) for k, g in enumerate(GOLDEN)], "query_id int, raw_query string")
    rows = {}
    for r in search.search(asked, index, Rules(), Ranking(), top=3).collect():
        rows.setdefault(r.query_id, {})[r["rank"]] = r
    for k, (_, doc, rank, first, second, count, ambiguous) in enumerate(GOLDEN):
        got = rows[k]
        assert got[rank].doc_id == doc
        assert got[1].score == pytest.approx(first) and got[2].score == pytest.approx(second)
        assert got[1].candidate_count == count and got[1].ambiguous == ambiguous


def test_order_does_not_depend_on_partitions(spark, scanned):
    index = search.Index.build(scanned[2])
    asked = spark.createDataFrame([(1, "riverside plant")], "query_id int, raw_query string")
    run = lambda: [tuple(r) for r in search.search(asked, index, Rules(), Ranking(), top=10).orderBy("rank").collect()]
    first = run()
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert run() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_filters_and_fallback(spark, scanned):
    index = search.Index.build(scanned[2])
    asked = spark.createDataFrame([(1, "zzzz"), (2, "riverside")], "query_id int, raw_query string")
    every = search.search(asked, index, Rules(), Ranking(), top=20)
    assert every.where("query_id = 1").count() == 10 and every.where("query_id = 1 and not ambiguous").count() == 0
    jpg = search.search(asked, index, Rules(), Ranking(), top=20, extensions=[".jpg"], folders=["compressor"])
    assert {(r.query_id, r.file_path) for r in jpg.collect()} == {(1, FILES[5])}
    assert search.search(asked, index, Rules(), Ranking(), folders=["  "]).count() == 0
    assert search.clamp_top("x") == 25 and search.clamp_top(900) == 200 and search.clamp_top(0) == 1 and search.clamp_sort("?") == "relevance"
    env = {r.query_id: r for r in search.envelope(jpg, asked).collect()}
    assert env[2].top_doc_ids == [] and env[2].ambiguous and env[2].candidate_count == 0


def test_empty_index(spark, scanned):
    index = search.Index.build(scanned[2].limit(0))
    asked = spark.createDataFrame([(1, "memo")], "query_id int, raw_query string")
    assert search.search(asked, index, Rules(), Ranking()).count() == 0


class Recorder:
    """Turns the order around and remembers what it was asked."""

    def __init__(self):
        self.asked = []

    def enabled(self):
        return True

    def order(self, query, rows):
        self.asked.append((query, len(rows)))
        return list(range(len(rows)))[::-1]


def test_rerank_of_ambiguous_queries_only(spark, scanned):
    index = search.Index.build(scanned[2])
    asked = spark.createDataFrame([(k, g[0]) for k, g in enumerate(GOLDEN)] + [(20, "riverside plant")], "query_id int, raw_query string")
    plain = {}
    for r in search.search(asked, index, Rules(), Ranking(), top=20).collect():
        plain.setdefault(r.query_id, {})[r["rank"]] = r.doc_id
    for order in ("relevance", "newest", "file_type"):
        backend = Recorder()
        got = {}
        for r in search.search(asked, index, Rules(), Ranking(), top=2, sort_by=order, backend=backend).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = r
        # the pool is all there is up to ten, not the two that are shown
        assert sorted(backend.asked) == sorted([(GOLDEN[5][0], len(plain[5])), ("riverside plant", len(plain[20]))])
        for k, rows in got.items():
            pool = [plain[k][x] for x in sorted(plain[k])][:10]
            want = pool[::-1] if k in (5, 20) else pool
            assert [rows[x].doc_id for x in (1, 2)] == want[:2] and all(r.reranked == (k in (5, 20)) for r in rows.values())
            if order == "file_type":
                shown = sorted(rows.values(), key=lambda r: r.display_rank)
                assert [r.file_ext for r in shown] == sorted(r.file_ext for r in shown)


def test_one_query_is_answered_as_many_are(spark, scanned):
    index = search.Index.build(scanned[2]).cache()
    texts = [g[0] for g in GOLDEN] + ["riverside plant", "zzzz", "compresor memo", "HX-203 HX-203", "", "photo"]
    asked = spark.createDataFrame(list(enumerate(texts)), "query_id int, raw_query string")
    ways = [{}, {"top": 7, "sort_by": "newest"}, {"top": 4, "sort_by": "file_type", "extensions": [".pdf"], "folders": ["riverside", "un"]}, {"top": 1, "backend": Recorder()}]
    for kw in ways:
        many = {}
        for r in search.search(asked, index, Rules(), Ranking(), **kw).orderBy("query_id", "display_rank").collect():
            many.setdefault(r.query_id, []).append(r.asDict(recursive=True))
        for k, text in enumerate(texts):
            one = search.search_one(text, index, Rules(), Ranking(), **kw)
            clean = lambda rows: [{x: round(v, 9) if x == "score" else v for x, v in r.items() if x in search._SHOWN and x != "query_id"} for r in rows]
            assert clean(one.rows) == clean(many.get(k, []))
    index.unpersist()


def test_a_query_with_very_many_tokens(spark, scanned, monkeypatch):
    index = search.Index.build(scanned[2])
    want = search.search_one("riverside pid memo", index, Rules(), Ranking()).rows
    monkeypatch.setattr(search, "LITERAL_TOKENS", 1)
    got = search.search_one("riverside pid memo", index, Rules(), Ranking()).rows
    assert [(r["doc_id"], r["score"]) for r in got] == [(r["doc_id"], r["score"]) for r in want]


def test_replies():
    rows = [{"file_path": p, "score": 1.0, "justification": "j"} for p in "abc"]
    for reply, want in (("[2, 0, 1]", [2, 0, 1]), ("not json", [0, 1, 2]), ("[0, 0, 1]", [0, 1, 2]), ("[0, 1]", [0, 1, 2]), ('["a"]', [0, 1, 2])):
        assert ReplyBackend(lambda _, r=reply: r).order("q", rows) == want
    assert ReplyBackend(lambda _: 1 / 0).order("q", rows[:1]) == [0]
    assert not backend_for(Rerank()).enabled() and not backend_for(Rerank("key")).enabled() and not NoBackend().enabled()


def test_http_backend():
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.path, self.headers["x-api-key"], json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            raw = json.dumps({"content": [{"type": "text", "text": "[1, 0]"}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        backend = backend_for(Rerank("key", f"http://127.0.0.1:{server.server_port}/", "some-model"))
        rows = [{"file_path": p, "score": 1.0, "justification": "j"} for p in "ab"]
        assert backend.enabled() and backend.order("q", rows) == [1, 0]
        path, key, body = seen[0]
        assert (path, key, body["model"]) == ("/v1/messages", "key", "some-model") and "'q'" in body["messages"][0]["content"]
    finally:
        server.shutdown()
        server.server_close()
    assert backend.order("q", rows) == [0, 1]  # nobody answers


def test_loose_pairs_by_blocks(spark):
    rnd = random.Random(6)
    words = ["".join(rnd.choices("abcde12", k=rnd.randint(2, 7))) for _ in range(400)] + ["2018", "2019", "bolt", "bolts", "blot", "xbolty", "가나다", "가나다라", "나다"]
    asked = spark.createDataFrame([(w,) for w in words[::2] + words[-9:]], "q_token string")
    vocab = spark.createDataFrame([(w,) for w in words], "token string")
    got = [{tuple(r) for r in search.loose_pairs(asked, vocab, n).collect()} for n in (10_000, 0)]
    assert got[0] == got[1] and len(got[0]) > 500


def test_small_numbers():
    assert mean_confidence([-1, 50, 70]) == 0.6 and mean_confidence([-1]) == 0.0
    assert pixel_scale(595, 842, Extraction()) == 200 / 72 and pixel_scale(2384, 3370, Extraction()) == 2400 / 3370


def test_text_output(spark, scanned):
    index = search.Index.build(scanned[2])
    out = search.search(spark.createDataFrame([(1, "isometric HX-203")], "query_id int, raw_query string"), index, Rules(), Ranking(), top=1)
    row = search.as_text(out).first()
    assert row.line.startswith("1. RiversidePlant/Isometric/HX-203_Isometric_Rev2.pdf  (score: ") and "equipment tag matches 'HX-203'" in row.why
    assert '"rank":1' in search.as_json(out).first().payload
    assert search.batches(out.withColumn("display_rank", F.lit(30)), 25).first().batch == 0


def test_queries_of_many_tokens(spark):
    """More tokens than one number has bits, repeated ones too: the numbers of hits are those of the lists."""
    from findery.operators import search
    from findery.operators.records import to_records
    from findery.config import Config

    config = Config()
    paths = [(f"top/{' '.join(f'word{k}' for k in range(a, b))}.pdf",) for a, b in ((0, 3), (50, 75), (60, 64), (120, 150), (200, 210))]
    index = search.Index.build(to_records(spark.createDataFrame(paths, "file_path string"), config.rules, "t"))
    text = " ".join(f"word{k}" for k in [*range(150), 61, 61, 149])
    asked = spark.createDataFrame([(1, text), (2, "word121")], "query_id int, raw_query string")
    got = sorted((r.query_id, r.rank, r.file_path, r.score, r.justification, r.candidate_count) for r in search.search(asked, index, config.rules, config.ranking, top=5).collect())
    want = sorted((q, r["rank"], r["file_path"], r["score"], r["justification"], r["candidate_count"]) for q, t in ((1, text), (2, "word121")) for r in search.search_one(t, index, config.rules, config.ranking, top=5).rows)
    assert got == want and len(got) > 5


def test_the_fallback_has_no_product(spark):
    """Queries that find nothing: partial matches first, then documents by path, and no plan that pairs all records with all of them."""
    from findery.config import Ranking
    from findery.operators import search

    names = "query_id int, raw_query string, project_name string, doc_type string, department string, equipment_tag string, year int, keywords array<string>"
    missed = spark.createDataFrame([(1, "x", "Riverside", None, None, None, None, ["zz"]), (2, "y", None, None, None, None, 1900, []), (3, "z", "Riverside", None, None, None, None, ["qq"])], names)
    made = [(f"d{k}", f"f/{9 - k}.pdf", ".pdf", "t", "Riverside Plant" if k == 2 else None, "memo", None, None, 2000, "ok", ["a"]) for k in range(6)]
    records = spark.createDataFrame(made, "doc_id string, file_path string, file_ext string, indexed_at string, project_name string, doc_type string, department string, equipment_tag string, year int, extraction_status string, keywords array<string>")
    index = search.Index.build(records)
    out = search.best_of_all(missed, index, records, Ranking(), 3)
    assert sorted((r.query_id, r.rank, r.doc_id, r.score, r.candidate_count) for r in out.collect()) == [(q, k + 1, d, s, 6) for q in (1, 2, 3) for k, (d, s) in enumerate([("d2", 15.0), ("d5", 0.0), ("d4", 0.0)] if q != 2 else [("d5", 0.0), ("d4", 0.0), ("d3", 0.0)])]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
