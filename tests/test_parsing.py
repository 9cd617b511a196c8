import json
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from findery.config import Config, Rules, load_config
from findery.functions import text as T
from findery.operators import records

PATHS = {
    "RiversidePlant/PID/RiversidePlant_PID_Unit3_2021.pdf": ("648bf91868ec", "Riverside Plant", "P&ID", None, None, 2021, "riversideplant pid unit3 2021 riversideplant pid", "ok"),
    "RiversidePlant/Isometric/HX-203_Isometric_Rev2.pdf": ("91a72c4d82e7", "Riverside Plant", "isometric", None, "HX-203", None, "hx 203 isometric rev2 riversideplant isometric", "ok"),
    "CompressorStation/Electrical/IMG_20190304_Electrical_MotorRoom.jpg": ("393171e38b4b", "Compressor Station", "photo", "Electrical", None, None, "img 20190304 electrical motorroom compressorstation electrical", "ok"),
    "Unsorted/old_backup_copy_final_v2.pdf": ("2239a7262c85", None, None, None, None, None, "old backup copy final v2 unsorted", "pending_deep_scan"),
}


def test_records_from_paths(spark):
    files = spark.createDataFrame([(p,) for p in PATHS], "file_path string")
    for r in records.to_records(files, Rules(), "now").collect():
        assert (r.doc_id, r.project_name, r.doc_type, r.department, r.equipment_tag, r.year, " ".join(r.keywords), r.extraction_status) == PATHS[r.file_path]


def test_tokens(spark):
    rows = [("memo for the unit 3 review", "memo unit review"), ("압축기_데이터시트_2020", "압축기 데이터시트 2020"), ("", ""), ("a & b P&ID", "p&id")]
    df = spark.createDataFrame(rows, "t string, want string").select("want", F.array_join(T.tokens(F.col("t")), " ").alias("got"))
    assert all(r.want == r.got for r in df.collect())


def test_path_pieces(spark):
    want = {"a/b.tar.GZ": (".gz", "b.tar / a"), ".hidden": ("", ".hidden"), "x/noext": ("", "noext / x"), "x/y/.env.txt": (".txt", ".env / x / y"), "end.": ("", "end.")}
    df = spark.createDataFrame([(p,) for p in want], "p string").select("p", T.file_ext(F.col("p")).alias("e"), T.parse_text(F.col("p")).alias("t"))
    assert {r.p: (r.e, r.t) for r in df.collect()} == want


def brute_loose(a, b):
    if a == b:
        return True
    if (a.isascii() and a.isdigit()) or (b.isascii() and b.isdigit()):
        return False
    if a in b or b in a:
        return True
    if min(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    s, t = sorted((a, b), key=len)
    return any(t[:k] + t[k + 1 :] == s for k in range(len(t)))


def test_loose_against_brute_force(spark):
    rnd = random.Random(3)
    pairs = [tuple("".join(rnd.choice("ab1가") for _ in range(rnd.randint(1, 6))) for _ in "ab") for _ in range(4000)]
    pairs += [("compressor", "compressorstation"), ("compresor", "compressor"), ("compressirr", "compressor"), ("ab", "ac"), ("2018", "2019"), ("2018", "2018")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.loose(F.col("a"), F.col("b")).alias("m"))
    assert all(r.m == brute_loose(r.a, r.b) for r in df.collect())


def test_gap_fill(spark):
    files = spark.createDataFrame([("Unsorted/old_backup.pdf",), ("Unsorted/scan_photo.jpg",)], "file_path string")
    made = records.to_records(files, Rules(), "now")
    made = made.withColumn("x", F.when(F.col("file_ext") == ".pdf", "Compressor Station Memo 2015 memo")).withColumn("s", F.lit("pdf_text"))
    a, b = sorted(records.fill_gaps(made, "x", "s", Rules()).collect(), key=lambda r: r.file_path)
    assert (a.project_name, a.doc_type, a.year, a.source_of_metadata) == ("Compressor Station", "memo", 2015, "filename+pdf_text")
    assert a.keywords == ["old", "backup", "unsorted", "compressor", "station", "memo", "2015"]
    assert (b.doc_type, b.source_of_metadata, b.keywords) == ("photo", "filename", ["scan", "photo", "unsorted"])


def test_record_json(spark):
    made = records.to_records(spark.createDataFrame([(p,) for p in PATHS], "file_path string"), Rules(), "now")
    sent = records.to_json(made)
    first = json.loads(sent.first().json)
    assert list(first) == made.columns and first["schema_version"] == 1 and "ocr_confidence" in first
    assert sorted(map(str, records.from_json(sent).collect())) == sorted(map(str, made.collect()))


def test_local_minute(spark):
    df = spark.createDataFrame([("2024-05-06T07:08:09+00:00",), ("2024-05-06T07:08:09+02:00",), ("soon",), (None,)], "t string")
    assert [r.m for r in df.select(T.local_minute(F.col("t")).alias("m")).collect()] == ["2024-05-06 07:08", "2024-05-06 05:08", None, None]


def test_junk_and_empty_config(spark, tmp_path):
    names = {"desktop.ini": True, "THUMBS.DB": True, "~$a.docx": True, ".x": True, "a.pdf": False}
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", T.is_junk(F.col("n")).alias("j"))
    assert {r.n: r.j for r in df.collect()} == names
    path = tmp_path / "c.toml"
    path.write_text('[ranking_weights]\nkeyword = 4\n[ranking]\nambiguous_margin = 2\n[project_name_patterns]\n"X" = ["x+"]\n', encoding="utf-8")
    got = load_config(str(path))
    assert load_config() == Config()
    assert got.ranking.weights == {"keyword": 4.0} and got.ranking.close_within == 2 and got.rules.project_name == {"X": ["x+"]}


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(pairs=st.lists(st.tuples(st.text("abcd1", min_size=1, max_size=7), st.text("abcd1", min_size=1, max_size=7)), min_size=1, max_size=30))
def test_loose_is_symmetric(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.loose(F.col("a"), F.col("b")).alias("ab"), T.loose(F.col("b"), F.col("a")).alias("ba"))
    assert all(r.ab == r.ba == brute_loose(r.a, r.b) for r in df.collect())
