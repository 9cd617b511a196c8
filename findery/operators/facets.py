"""Counts for navigation and monitoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findery.functions import text as T
from findery.operators.search import NO_EXTENSION
from findery.schema import STATUS_PENDING


def extensions(records: DataFrame) -> DataFrame:
    """``(file_ext, documents)``, most frequent first."""
    ext = F.when(F.col("file_ext") == "", NO_EXTENSION).otherwise(F.col("file_ext"))
    return records.groupBy(ext.alias("file_ext")).agg(F.count("*").alias("documents")).orderBy(F.desc("documents"), "file_ext")


def folders(records: DataFrame) -> DataFrame:
    """``(folder, documents)`` of top folders, most frequent first; files at the root are left out."""
    path = F.col("file_path")
    return records.where(F.size(T.parts(path)) >= 2).groupBy(T.top_folder(path).alias("folder")).agg(F.count("*").alias("documents")).orderBy(F.desc("documents"), "folder")


def values(records: DataFrame, field: str, offset: int = 0, limit: int = 1000) -> DataFrame:
    """``(field, documents, place)`` of a field's values, the most frequent first; ties in order of value.

    A page of at most ``limit`` values from place ``offset`` + 1 on; only these meet in one task.
    """
    counts = records.where(F.col(field).isNotNull()).groupBy(field).agg(F.count("*").alias("documents"))
    shown = page(counts.orderBy(F.desc("documents"), field), offset, limit)
    return shown.withColumn("place", F.row_number().over(Window.orderBy(F.desc("documents"), field)) + F.lit(max(0, offset)))


def page(facet: DataFrame, offset: int = 0, limit: int = 1000) -> DataFrame:
    """Some rows of a sorted facet, so that no long list has to reach the driver at once."""
    return facet.offset(max(0, offset)).limit(max(1, min(limit, 1000)))


def pending(records: DataFrame) -> DataFrame:
    return records.agg(F.count_if(F.col("extraction_status") == STATUS_PENDING).alias("pending"))


def recent_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    return runs.orderBy(F.desc("timestamp"), F.desc("total_files")).limit(limit)
