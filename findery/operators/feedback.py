"""Feedback analytics: which fields led to right results, and bounded weight suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findery.config import Ranking, Rules
from findery.functions import text as T
from findery.operators.search import field_match
from findery.schema import RECORD_FIELDS

# Fixed values of the suggestion bands.
HIGH, LOW, STEP, MIN_SAMPLES = 0.85, 0.55, 0.2, 5


def entries(envelopes: DataFrame, verdicts: DataFrame, timestamp: str) -> DataFrame:
    """Log rows for searches: ``envelopes`` as ``search.envelope`` gives them, ``verdicts`` (``query_id, chosen_doc_id, correct``)."""
    joined = envelopes.join(verdicts, "query_id")
    return joined.select(F.lit(timestamp).alias("timestamp"), F.col("raw_query").alias("query"), "top_doc_ids", "scores", "ambiguous", "used_llm_rerank", "chosen_doc_id", "correct")


def row_hits(asked: Column, held: Column) -> tuple[Column, Column]:
    """Exact and loose hits of one query's tokens on one document's tokens, within a row."""
    exact = F.filter(asked, lambda k: F.array_contains(held, k))
    others = F.filter(asked, lambda k: ~F.array_contains(held, k))
    first = F.transform(others, lambda k: F.concat(k, F.lit("~"), F.get(F.filter(held, lambda r: T.loose(k, r)), 0)))
    return exact, F.filter(first, lambda x: x.isNotNull())


def attributable(feedback: DataFrame) -> DataFrame:
    return feedback.where("chosen_doc_id is not null and chosen_doc_id <> ''")


def unattributed(feedback: DataFrame) -> DataFrame:
    return feedback.agg(F.count_if(F.coalesce(F.col("chosen_doc_id") == "", F.lit(True))).alias("unattributed"))


def matches(pairs: DataFrame) -> DataFrame:
    """``pairs`` of a query (``q_*``) and a record with ``_fields``: the weights that their match would count under.

    Only what counts is computed, not the scores and texts of a search result.
    """
    named = [F.when(field_match(F.col(f"q_{f}"), F.col(f)).isNotNull(), f) for f in RECORD_FIELDS]
    named.append(F.when((F.col("q_year") == F.col("year")) & (F.col("year") != 0), "year"))
    named += [F.when(F.col(c) > 0, "keyword") for c in ("_exact", "_loose")]
    return pairs.withColumn("_fields", F.array_compact(F.array(*named)))


def _judged(feedback: DataFrame) -> DataFrame:
    """``(query, doc_id, correct, incorrect)``; one row for all entries that agree on both, or in a stream one for each."""
    right = F.coalesce("correct", F.lit(False))
    if feedback.isStreaming:
        return attributable(feedback).select("query", F.col("chosen_doc_id").alias("doc_id"), right.cast("long").alias("correct"), (~right).cast("long").alias("incorrect"))
    return attributable(feedback).groupBy("query", F.col("chosen_doc_id").alias("doc_id")).agg(F.count_if(right).alias("correct"), F.count_if(~right).alias("incorrect"))


def field_counts(feedback: DataFrame, records: DataFrame, rules: Rules) -> DataFrame:
    """``(field_name, correct, incorrect)`` of weights that count at all; works on streams too, where Spark keeps the sums as state.

    Each query is parsed, and scored against the record chosen, once for all entries that agree on both; a
    record with exact and loose keyword hits counts twice under ``keyword``; one that is listed twice counts once. Entries whose record is gone are
    left out.
    """
    entries, meta = _judged(feedback), T.metadata(F.col("query"), rules)
    asked = entries.select("doc_id", "correct", "incorrect", *(c.alias(f"q_{k}") for k, c in meta.items()))
    pairs = asked.join(records.select("doc_id", *RECORD_FIELDS, "year", "keywords", "extraction_status").dropDuplicates(["doc_id"]), "doc_id")
    exact, almost = row_hits(F.col("q_keywords"), F.col("keywords"))
    kinds = matches(pairs.withColumns({"_exact": F.size(exact), "_loose": F.size(almost)}))
    fields = kinds.select("correct", "incorrect", F.explode("_fields").alias("field_name"))
    return fields.groupBy("field_name").agg(F.sum("correct").alias("correct"), F.sum("incorrect").alias("incorrect"))


def field_stats(feedback: DataFrame, records: DataFrame, rules: Rules, ranking: Ranking) -> DataFrame:
    """``(field_name, correct, incorrect, samples, precision)`` per weight, zero rows included."""
    return stats_of(field_counts(feedback, records, rules), ranking)


def stats_of(counted: DataFrame, ranking: Ranking) -> DataFrame:
    """What ``field_stats`` gives, from counts."""
    names = counted.sparkSession.createDataFrame([(k, float(v)) for k, v in ranking.weights.items()], "field_name string, current_weight double")
    out = names.join(counted, "field_name", "left").na.fill(0, ["correct", "incorrect"])
    total = F.col("correct") + F.col("incorrect")
    return out.withColumn("samples", total).withColumn("precision", F.try_divide(F.col("correct"), total))


def suggestions(stats: DataFrame, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """``stats`` with ``suggested_weight`` (null: none) and ``reason``; never more than a fifth off the current weight."""
    p, n, w = F.col("precision"), F.col("samples"), F.col("current_weight")
    few = n < min_samples
    percent = F.format_string("%s%% over %d samples", F.bround(p * 100, 0).cast("int").cast("string"), n)
    weight = F.when(few, F.lit(None)).when(p >= HIGH, F.round(w * (1 + STEP), 1)).when(p <= LOW, F.round(w * (1 - STEP), 1)).otherwise(w)
    reason = (
        F.when(few, F.format_string(f"insufficient data (n=%d < {min_samples}) -- no suggestion", n))
        .when(p >= HIGH, F.concat(F.lit("high precision ("), percent, F.lit(") -- consider increasing")))
        .when(p <= LOW, F.concat(F.lit("low precision ("), percent, F.lit(") -- consider decreasing")))
        .otherwise(F.concat(F.lit("precision looks reasonable ("), percent, F.lit(") -- no change suggested")))
    )
    return stats.select("field_name", "current_weight", "samples", "precision", weight.alias("suggested_weight"), reason.alias("reason"))


def weights_toml(suggested: DataFrame) -> str:
    """A TOML block with the suggested weights, or the current ones; one row per weight reaches the driver."""
    rows = {r.field_name: r.current_weight if r.suggested_weight is None else r.suggested_weight for r in suggested.collect()}
    return "\n".join(["[ranking_weights]", *(f"{k} = {v}" for k, v in rows.items())])
