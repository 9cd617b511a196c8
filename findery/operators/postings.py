"""Postings: which documents hold a field value or a keyword."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findery.functions import text as T
from findery.schema import INDEXED_FIELDS


def fields_of(rows: DataFrame, *keys: str) -> DataFrame:
    """Unpivot the indexed fields: ``(*keys, field, value)`` with normalised, non-empty values."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), T.normalize(F.col(f)).alias("value")) for f in INDEXED_FIELDS))
    return rows.select(*keys, F.inline(pairs)).where("value is not null and not (field = 'year' and value = '0')")


def field_postings(records: DataFrame) -> DataFrame:
    """Distinct ``(field, value, doc_id)``."""
    return fields_of(records, "doc_id").select("field", "value", "doc_id").distinct()


def keyword_postings(records: DataFrame) -> DataFrame:
    """``(token, doc_id, pos)``; pos is the token's first place in the document."""
    # from an inner posexplode Spark infers a filter on keywords, which it moves below the dealing of the files: one task would parse them all
    flat = records.select("doc_id", F.posexplode_outer("keywords").alias("pos", "k")).select(T.normalize(F.col("k")).alias("token"), "doc_id", "pos")
    return flat.where("token is not null").groupBy("token", "doc_id").agg(F.min("pos").alias("pos"))


def vocabulary(keywords: DataFrame) -> DataFrame:
    """``(token, documents)`` over keyword postings."""
    return keywords.groupBy("token").agg(F.count("*").alias("documents"))


def indexed_ids(fields: DataFrame, keywords: DataFrame) -> DataFrame:
    """Distinct ids of documents with at least one posting."""
    return fields.select("doc_id").union(keywords.select("doc_id")).distinct()


def compact(postings: DataFrame, *keys: str, size: int = 10_000) -> DataFrame:
    """Rows ``(*keys, chunk, doc_ids)`` with sorted ids, about ``size`` in a chunk: a key of any frequency fits in memory."""
    chunks = postings.groupBy(*keys).agg(F.ceil(F.count("*") / size).alias("_chunks"))
    dealt = postings.join(chunks, list(keys)).withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("_chunks")).cast("int"))
    return dealt.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_set("doc_id")).alias("doc_ids"))
