"""Records from files, gap filling, change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findery.config import Rules
from findery.functions import text as T
from findery.schema import RECORD_FIELDS, RECORDS, STATUS_OK, STATUS_PENDING


def needs_fallback() -> Column:
    return F.col("project_name").isNull() | F.col("doc_type").isNull()


def to_records(files: DataFrame, rules: Rules, indexed_at: str) -> DataFrame:
    """One record per file of ``files`` (``file_path``), from its name and folders alone.

    ``indexed_at`` is given, not read from a clock, so that a run can be repeated.
    """
    path = F.col("file_path")
    meta = T.metadata(T.parse_text(path), rules)
    out = files.select(T.doc_id(path).alias("doc_id"), path, T.file_name(path).alias("file_name"), T.file_ext(path).alias("file_ext"), *(c.alias(k) for k, c in meta.items()))
    return out.select(
        "*",
        F.lit("filename").alias("source_of_metadata"),
        F.when(needs_fallback(), STATUS_PENDING).otherwise(STATUS_OK).alias("extraction_status"),
        F.lit(None).cast("double").alias("ocr_confidence"),
        F.lit(indexed_at).alias("indexed_at"),
        F.lit(1).alias("schema_version"),
    )


def fill_gaps(records: DataFrame, text: str, source: str, rules: Rules) -> DataFrame:
    """Fields that are null are taken from column ``text``; its unseen tokens are appended; the source is noted.

    Rows whose ``text`` is null stay as they are.
    """
    # one column, so that no plan evaluates a rule twice
    rows = records.withColumn("_found", F.when(F.col(text).isNotNull(), F.struct(*(c.alias(k) for k, c in T.metadata(F.col(text), rules).items()))))
    has = F.col("_found").isNotNull()
    new = F.array_distinct(F.filter("_found.keywords", lambda k: ~F.array_contains("keywords", k)))
    changed = {f: F.coalesce(f, F.col(f"_found.{f}")) for f in (*RECORD_FIELDS, "year")}
    changed["keywords"] = F.when(has, F.concat("keywords", new)).otherwise(F.col("keywords"))
    changed["source_of_metadata"] = F.when(has, F.concat_ws("+", "source_of_metadata", F.col(source))).otherwise(F.col("source_of_metadata"))
    return rows.withColumns(changed).drop("_found")


def _listed(of: Window | None = None) -> list[Column]:
    """How often a path is listed, and with which dates and sizes: least, greatest and a sum of hashes."""
    state = F.struct("mtime", "size")
    found = [F.count("*"), F.min(state), F.max(state), F.sum(F.xxhash64("mtime", "size").cast("decimal(38,0)"))]
    return found if of is None else [c.over(of) for c in found]


def changed_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """``files`` with ``changed``: not in ``manifest``, or there with another mtime or size, or not as often.

    A path that is listed several times is as many rows of ``files`` and of the result.
    """
    names = ("n", "least", "most", "sum")
    known = manifest.groupBy("file_path").agg(*(c.alias(f"_m_{k}") for k, c in zip(names, _listed(), strict=True)))
    marked = files.withColumns({f"_f_{k}": c for k, c in zip(names, _listed(Window.partitionBy("file_path")), strict=True)})
    same = F.col("size").isNotNull() & F.col("mtime").isNotNull()
    for k in names:
        same = same & (F.col(f"_f_{k}") == F.col(f"_m_{k}"))
    return marked.join(known, "file_path", "left").select(*files.columns, (~F.coalesce(same, F.lit(False))).alias("changed"))


def upsert(old: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """``old`` without the keys of ``fresh``, and ``fresh``."""
    return old.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def run_summary(files: DataFrame) -> DataFrame:
    """``total_files, processed, skipped_unchanged`` from ``changed_files``."""
    return files.agg(F.count("*").alias("total_files"), F.count_if("changed").alias("processed"), F.count_if(~F.col("changed")).alias("skipped_unchanged"))


def to_json(made: DataFrame) -> DataFrame:
    """``(doc_id, json)``: every record as a JSON object with all its fields, nulls included."""
    return made.select("doc_id", F.to_json(F.struct(*made.columns), {"ignoreNullFields": "false"}).alias("json"))


def from_json(rows: DataFrame) -> DataFrame:
    """Records from a column ``json``; an object that is no record gives nulls."""
    return rows.select(F.from_json("json", RECORDS).alias("r")).select("r.*")


def project_rule(name: Column) -> Column:
    """A TOML line for a folder name: a pattern that takes it literally, with any white space between its words."""
    # The characters with a meaning in patterns, and how the line is put together.
    literal = F.regexp_replace(name, r"([()\[\]{}?*+\-|^$\\.&~#])", r"\\$1")
    quoted = F.replace(literal, F.lit("\\"), F.lit("\\\\"))
    return F.concat(F.lit('"'), name, F.lit('" = ["'), F.regexp_replace(quoted, " ", r"\\\\s*"), F.lit('"]'))


def folder_names(dirs: DataFrame, depth: int = 1) -> DataFrame:
    """``(name, folders)``: how often each folder name occurs down to ``depth``; ties in order of name."""
    p = T.parts(F.col("dir_path"))
    return dirs.where(F.size(p) <= depth).groupBy(F.element_at(p, -1).alias("name")).agg(F.count("*").alias("folders")).orderBy(F.desc("folders"), "name")
