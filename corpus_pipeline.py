"""A corpus pipeline in five stages, each one operator of ``findery.llm`` at work on what its predecessor kept.

The columns of ``documents`` (``doc_id, text, lang, source, n_chars``, and any others) pass through all stages but
the last as they are; only substring dedup changes ``text`` and ``n_chars``. Names that a user's columns share with
an operator's own are of no matter. Null and empty texts fail the base rules. Rows with a null id are neither
copies of anything nor lose passages; repeated rows are rows like others, and of the repeated id that stands for a
group of copies all stay. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from findery.llm import language_id, packing, quality_rules, simhash, substring_dedup
from findery.llm.common import materialize, table
from findery.llm.queries import WORD_BPE, tokenizer_path

#: Score under which a language counts as not identified.
MIN_LANG_SCORE = 0.5
#: Similarity of shingle sets from which texts are copies.
MIN_SIMILARITY = 0.8


def rule_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the certified cutoffs keep."""
    labels = table(spark, sf_dir, "labels")
    stats = quality_rules.with_stats(quality_rules.labelled(docs.select("doc_id", "lang", "text"), labels), keep_text=False)
    return quality_rules.keep(docs, quality_rules.calibrate(stats, labels))


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; a declared language that differs is no reason to reject.

    Where no document declares a language, nothing can be learnt and all texts with letters stay.
    """
    model = language_id.train(docs)
    return language_id.keep_identified(docs, model, MIN_LANG_SCORE) if model.langs else language_id.keep_letters(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more.

    Fingerprints and pigeonhole blocks propose the close ones; bands of minima propose the others, which fingerprints cannot
    find (see the README); exact shingle sets decide on both.
    """
    return simhash.keep_one(docs, similarity=MIN_SIMILARITY)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has; one that loses all its words stays, empty."""
    return substring_dedup.without_repeats(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path(WORD_BPE))


STAGES = [
    ("quality rules", rule_filter),
    ("language id", language_filter),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", passage_dedup),
    ("best-fit packing", sequence_packing),
]

#: No stage after the rules can be said in SQL; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
