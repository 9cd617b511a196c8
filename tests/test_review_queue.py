"""The service returns the whole review queue."""

from findery import schema
from findery.serve import Service
from findery.sources import logs
from findery.sources.store import Store


def test_whole_review_queue(spark, tmp_path):
    rows = [(f"2024-01-01T00:00:{k:05}", f"f{k}.pdf", "low_confidence_ocr", 0.1) for k in range(1500)]
    logs.append(spark.createDataFrame(rows, schema.REVIEW_QUEUE).repartition(3), f"{tmp_path}/logs/review_queue")
    status, got = Service(spark, Store(spark, f"{tmp_path}/index"), f"{tmp_path}/logs").answer("GET", "/review-queue", {})
    assert status == 200 and [r["file_path"] for r in got] == [r[1] for r in rows]
