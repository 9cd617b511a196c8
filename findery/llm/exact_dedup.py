"""Exact duplicates of whole texts, with the frequent ones split from the rest (native: DataFrame functions only).

Texts are equal if they are identical once A-Z are lower-cased; SHA-256 of the UTF-8 bytes stands for a text. A
Misra-Gries summary over all rows names every digest that may hold more than ``SUPPORT`` of them. Those are counted
exactly, and the ones that do hold so many, at most ``1 / SUPPORT`` by definition, are broadcast with the row that stays
of each: their rows are settled where they lie. The other digests are grouped by an ordinary shuffle, in which no
key has more than ``SUPPORT`` of the rows, and less after partial aggregation.

Defined results: null texts count as empty and are copies of each other; a group whose ids are all null keeps the
null id; of rows that repeat the id that stays, all stay; an empty table gives an empty result. Other columns,
whatever their names, play no part.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, without_copies

#: Share of all rows from which on a digest is frequent; the summary has the reciprocal number of counters.
SUPPORT = 0.001


def normalized(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are; null is empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, digest)`` per row of ``docs``, the digest as 32 bytes."""
    return docs.select(docs[id_col].alias("doc_id"), F.unhex(F.sha2(normalized(docs[text_col]).cast("binary"), 256)).alias("digest"))


def frequent(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``(digest, keep_id, group_size)`` of each digest that more than ``support`` of ``rows`` have.

    The summary counts 64-bit hashes of digests, as those are short. It misses no frequent one but may name others, so
    what it names is counted; the result has fewer than ``1 / support`` rows whatever the input.
    """
    key = F.xxhash64("digest").alias("key")
    named = rows.select(key).stat.freqItems(["key"], support).select(F.explode("key_freqItems").alias("key"))
    counted = rows.withColumn("key", key).join(F.broadcast(named), "key", "left_semi").groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return counted.where(F.col("group_size") > support * rows.count())


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, digest)`` per row of ``docs``: the largest id of its group of equal texts, and whether it is its own."""
    rows = materialize(digests(docs, id_col, text_col), "digests")
    heavy = materialize(frequent(rows, support), "frequent-digests")
    settled = rows.join(F.broadcast(heavy), "digest").select("doc_id", "digest", "keep_id", "group_size")
    rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    # only digests that occur twice need a partner; a digest's rows meet as one row per task
    twice = rest.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    alone = F.col("group_size").isNull()
    found = rest.join(twice, "digest", "left").select("doc_id", "digest", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"))
    every = settled.unionByName(found)
    return every.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` without copies: of equal texts that with the largest id stays; rows without an id stay."""
    found = classes(docs.where(docs[id_col].isNotNull()), id_col, text_col, support)
    return without_copies(docs, found.select("doc_id", F.col("keep_id").alias("component_id")), id_col)
