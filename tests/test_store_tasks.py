"""The records of a batch are made by as many tasks as it has files for, however few bytes their paths take."""

from findery.config import Config
from findery.sources import store as stores


def test_batch_is_parsed_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "TASK_FILES", 10)
    made = []
    real = stores.records.to_records
    monkeypatch.setattr(stores.records, "to_records", lambda files, *a: made.append(files.rdd.getNumPartitions()) or real(files, *a))
    files = spark.range(40, numPartitions=1).selectExpr("concat('a/f', id % 30, '.pdf') AS file_path", "1.0D AS mtime", "id AS size")
    store = stores.Store(spark, f"{tmp_path}/i")
    stores.index_files(store, files, "r", Config(), "t1")
    assert made == [4] and store.records().count() == 40
