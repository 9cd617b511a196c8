"""Rules, weights and limits, with a TOML loader."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

# They decide what is recognised and how results are scored.
DOC_TYPES = {
    "P&ID": ["p&id", "p and id", r"\bpid\b", "배관계장도", r"배관\s*및\s*계장도"],
    "isometric": ["iso(metric)?", "아이소(메트릭)?", "등각도"],
    "memo": ["memo", "technical note", r"\btn\b", "메모", r"기술\s*메모"],
    "photo": ["photo", r"\bimg\b", r"\bpic\b", "사진"],
    "drawing": ["drawing", r"\bdwg\b", "도면"],
    "datasheet": ["datasheet", "data sheet", r"\bds\b", r"데이터\s*시트"],
}
PROJECTS = {"Riverside Plant": [r"riverside\s*plant", "riverside"], "Compressor Station": [r"compressor\s*station"]}
DEPARTMENTS = {
    "Electrical": ["electrical", r"\belec\b", "전기"],
    "Mechanical": ["mechanical", r"\bmech\b", "기계"],
    "Civil": ["civil", "토목"],
    "Process": ["process", "공정"],
}
TAG_PATTERN = r"\b[A-Z]{1,4}-\d{2,4}[A-Z]?\b"
YEAR_PATTERN = r"\b(19|20)\d{2}\b"
STOPWORDS = ("the", "a", "an", "for", "of", "and", "or", "to", "in", "on", "at", "is", "was", "from", "with", "pdf", "jpg", "jpeg", "png", "tif", "tiff")
WEIGHTS = {"equipment_tag": 40.0, "project_name": 25.0, "doc_type": 15.0, "department": 10.0, "year": 5.0, "keyword": 3.0}
PARTIAL_FACTOR, REVIEW_FACTOR = 0.6, 0.85


@dataclass(frozen=True)
class Rules:
    """Label to patterns for each labelled field (label order decides), and the two value patterns."""

    doc_type: dict[str, list[str]] = field(default_factory=lambda: dict(DOC_TYPES))
    project_name: dict[str, list[str]] = field(default_factory=lambda: dict(PROJECTS))
    department: dict[str, list[str]] = field(default_factory=lambda: dict(DEPARTMENTS))
    tag: str = TAG_PATTERN
    year: str = YEAR_PATTERN


@dataclass(frozen=True)
class Ranking:
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    weak_below: float = 20.0
    close_within: float = 5.0
    max_keyword_hits: int = 5


@dataclass(frozen=True)
class Extraction:
    min_text_chars: int = 20
    ocr_dpi: int = 200
    max_pages: int = 2
    max_side_px: int = 2400
    workers: int = 0
    min_confidence: float = 0.55
    pdf_extensions: tuple[str, ...] = (".pdf",)
    image_extensions: tuple[str, ...] = (".jpg", ".jpeg", ".png", ".tif", ".tiff")
    direct_open_extensions: tuple[str, ...] = (".pdf", ".jpg", ".jpeg", ".png", ".tif", ".tiff", ".hwpx")


@dataclass(frozen=True)
class Rerank:
    api_key: str = ""
    base_url: str = ""
    model: str = ""


@dataclass(frozen=True)
class Config:
    rules: Rules = field(default_factory=Rules)
    ranking: Ranking = field(default_factory=Ranking)
    extraction: Extraction = field(default_factory=Extraction)
    rerank: Rerank = field(default_factory=Rerank)


def _floats(table: dict) -> dict[str, float]:
    return {k: float(v) for k, v in table.items()}


#: Part of the configuration, field, TOML section, key in it (None: the whole section), and what is made of the value.
_KEYS = (
    *(("rules", f, f"{f}_patterns", None, dict) for f in ("doc_type", "project_name", "department")),
    ("rules", "tag", "equipment_tag_pattern", "regex", str),
    ("rules", "year", "year_pattern", "regex", str),
    ("ranking", "weights", "ranking_weights", None, _floats),
    ("ranking", "weak_below", "ranking", "ambiguous_absolute_threshold", float),
    ("ranking", "close_within", "ranking", "ambiguous_margin", float),
    ("ranking", "max_keyword_hits", "ranking", "max_keyword_hits", int),
    ("extraction", "max_pages", "extraction", "max_fallback_pages", int),
    ("extraction", "max_side_px", "extraction", "ocr_max_side_px", int),
    ("extraction", "workers", "extraction", "deep_scan_workers", int),
    ("extraction", "min_confidence", "extraction", "ocr_confidence_threshold", float),
    *(("extraction", f, "extraction", f, int) for f in ("min_text_chars", "ocr_dpi")),
    *(("extraction", f, "extraction", f, tuple) for f in ("pdf_extensions", "image_extensions", "direct_open_extensions")),
    *(("rerank", f, "llm", f, str) for f in ("api_key", "base_url", "model")),
)


def load_config(path: str | None = None) -> Config:
    """Read a TOML file; sections and keys that it leaves out keep their defaults."""
    given: dict[str, dict] = {"rules": {}, "ranking": {}, "extraction": {}, "rerank": {}}
    raw = {} if path is None else tomllib.loads(Path(path).read_text(encoding="utf-8"))
    for part, name, section, key, cast in _KEYS:
        value = raw.get(section) if key is None else raw.get(section, {}).get(key)
        if value is not None:
            given[part][name] = cast(value)
    return Config(Rules(**given["rules"]), Ranking(**given["ranking"]), Extraction(**given["extraction"]), Rerank(**given["rerank"]))
