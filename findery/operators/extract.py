"""Deep scan: fill the gaps of pending records from document text or OCR."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findery.config import Extraction, Rules
from findery.operators.records import fill_gaps
from findery.schema import STATUS_OK, STATUS_PENDING, STATUS_REVIEW


@dataclass(frozen=True)
class Recognized:
    text: str
    confidence: float


class Reader(Protocol):
    """Opens documents on executors; null means that the file cannot be opened."""

    def text_layer(self, path: str, max_pages: int) -> str | None: ...

    def images(self, path: str, ext: str, config: Extraction) -> Sequence[object] | None: ...


class OcrBackend(Protocol):
    def recognize(self, images: Sequence[object]) -> Recognized: ...


def mean_confidence(words: Sequence[float]) -> float:
    """Mean of word confidences in percent, without -1 (no word), as a fraction; 0 for none."""
    known = [w for w in words if w != -1]
    return sum(known) / len(known) / 100 if known else 0.0


def pixel_scale(width: float, height: float, config: Extraction) -> float:
    """Scale from points to pixels: the wanted resolution, unless the longer side would be too long."""
    return min(config.ocr_dpi / 72, config.max_side_px / max(width, height))


def kind_of(ext: Column, config: Extraction) -> Column:
    """How a file with this suffix is read: ``pdf``, ``image`` or ``other``."""
    return F.when(ext.isin(*config.pdf_extensions), "pdf").when(ext.isin(*config.image_extensions), "image").otherwise("other")


def _extract(path: str, ext: str, kind: str, reader: Reader, ocr: OcrBackend, config: Extraction) -> tuple:
    """``(text, source, confidence, reason)`` of one document."""
    try:
        if kind == "pdf":
            text = reader.text_layer(path, config.max_pages)
            if text is not None and len(text.strip()) >= config.min_text_chars:
                return text.strip(), "pdf_text", None, None
            missing = "unreadable_pdf"
        elif kind == "image":
            missing = "unreadable_image"
        else:
            return None, None, None, "unsupported_extension_for_deep_scan"
        images = reader.images(path, ext, config)
        if not images:
            return None, None, 0.0, missing
        got = ocr.recognize(images)
        return got.text, "ocr", got.confidence, None if got.confidence >= config.min_confidence else "low_confidence_ocr"
    except Exception as e:  # one bad document must not fail the scan
        return None, None, None, f"extraction_error: {e}"


def extract(pending: DataFrame, reader: Reader, ocr: OcrBackend, config: Extraction) -> DataFrame:
    """``(doc_id, file_path, text, source, confidence, reason)`` per pending record; a reason asks for review."""

    def run(frames):
        for frame in frames:
            rows = [_extract(p, e, k, reader, ocr, config) for p, e, k in zip(frame.file_path, frame.file_ext, frame.kind, strict=True)]
            out = frame[["doc_id", "file_path"]].copy()
            for k, name in enumerate(("text", "source", "confidence", "reason")):
                out[name] = [r[k] for r in rows]
            yield out

    src = pending.select("doc_id", "file_path", "file_ext", kind_of(F.col("file_ext"), config).alias("kind"))
    # a chunk comes out of a limit as one partition, and reading is the slow part
    dealt = src.repartition(config.workers or src.sparkSession.sparkContext.defaultParallelism)
    return dealt.mapInPandas(run, "doc_id string, file_path string, text string, source string, confidence double, reason string")


def merge(records: DataFrame, found: DataFrame, rules: Rules) -> DataFrame:
    """``records`` with the results of ``extract`` in those that are pending: usable text fills gaps, anything else asks for review."""
    got = found.select("doc_id", F.when(F.col("reason").isNull(), F.col("text")).alias("_text"), F.col("source").alias("_source"), F.col("confidence").alias("_conf"), F.col("reason").alias("_reason"), F.lit(True).alias("_seen"), F.lit(STATUS_PENDING).alias("extraction_status")).dropDuplicates(["doc_id"])
    joined = fill_gaps(records.join(got, ["doc_id", "extraction_status"], "left"), "_text", "_source", rules)
    status = F.when(F.col("_seen"), F.when(F.col("_reason").isNull(), STATUS_OK).otherwise(STATUS_REVIEW)).otherwise(F.col("extraction_status"))
    conf = F.when(F.col("_source") == "ocr", F.col("_conf")).otherwise(F.col("ocr_confidence"))
    return joined.withColumns({"extraction_status": status, "ocr_confidence": conf}).select(records.columns)


def extraction_log(found: DataFrame, timestamp: str) -> DataFrame:
    return found.where("source is not null").select(F.lit(timestamp).alias("timestamp"), "file_path", "source", "confidence", "text")


def review_entries(found: DataFrame, timestamp: str) -> DataFrame:
    return found.where("reason is not null").select(F.lit(timestamp).alias("timestamp"), "file_path", "reason", "confidence")


def pending(records: DataFrame) -> DataFrame:
    return records.where(F.col("extraction_status") == STATUS_PENDING)
