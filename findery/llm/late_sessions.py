"""Sessions of events that arrive late, as versions: what each batch makes new and which earlier versions that retracts.

After a batch, a user's events so far form sessions. A native batch ``session_window`` over ``(user, snapshot)``
makes them, with a gap of half a second more than allowed, as its windows are open at the end and times are whole
seconds. A containment join then links each version to the first later one that holds it.

A snapshot is not made from all events so far. Time is cut into slabs of ``width`` seconds. An event of a slab
may come ``late`` batches after it, so a slab that old is complete and never changes again: of complete slabs a snapshot
takes one row, the session that reaches the end of the last of them, however far back it began. So an event
enters ``late + 1`` snapshots at most, and the rows of a user and snapshot are bounded by the seconds of ``late + 1``
slabs, as equal events are counted together first. Sessions that run over many complete slabs are put
together by doubling, in joins on ``(user, slab)``, so a user with most of all events is spread like any other rows.

Defined results: events whose user, seconds or batch is null are in no session; a null weight counts as 0; equal
events count each; events may come before the batch of their own slab; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

GAP_SECONDS, BATCH_SECONDS = 240, 1800
#: Doublings after which an error is raised; each doubles the slabs that a session may run over.
MAX_ROUNDS = 60
VERSION = ("user", "batch", "start_s", "end_s", "n_events", "n_new", "n_retracted", "h_sum", "retracted_batch", "retracted_start_s")


def _window(gap: int) -> Column:
    return F.session_window(F.timestamp_seconds("seconds"), f"{gap} seconds 500 milliseconds")


def _slab(seconds: Column, width: int) -> Column:
    return F.floor(seconds / width)


def _counted(events: DataFrame) -> DataFrame:
    """``(user, seconds, batch, n, h)``: equal events together."""
    named = events.select("user", "seconds", "batch", F.coalesce("weight", F.lit(0)).alias("weight"))
    return named.dropna(subset=["user", "seconds", "batch"]).groupBy("user", "seconds", "batch").agg(F.count("*").alias("n"), F.sum("weight").alias("h"))


def _lateness(counted: DataFrame, width: int) -> int:
    """By how many batches an event comes after that of its own slab at most."""
    most = counted.agg(F.max(F.col("batch") - _slab(F.col("seconds"), width))).first()[0]
    return max(0, most or 0)


def _reaching(counted: DataFrame, gap: int, width: int) -> DataFrame:
    """``(user, slab, start, end, n, h)``: of each slab, once it is complete, the session that an event of the next slab may go on with."""
    per_slab = counted.withColumn("slab", _slab(F.col("seconds"), width)).groupBy("user", "slab", _window(gap)).agg(F.min("seconds").alias("start"), F.max("seconds").alias("end"), F.sum("n").alias("n"), F.sum("h").alias("h"))
    last = F.max_by(F.struct("start", "end", "n", "h"), "start").alias("last")
    slabs = per_slab.groupBy("user", "slab").agg(last, (F.count("*") == 1).alias("whole")).select("user", "slab", "last.*", "whole")
    slabs = slabs.where(F.col("end") >= (F.col("slab") + 1) * width - gap)
    before = slabs.select("user", (F.col("slab") + 1).alias("slab"), F.col("end").alias("_end"))
    goes_on = F.coalesce(F.col("whole") & (F.col("start") - F.col("_end") <= gap), F.lit(False))
    tails = materialize(slabs.join(before, ["user", "slab"], "left").select("user", "slab", "start", "end", "n", "h", F.when(goes_on, F.col("slab") - 1).alias("next")), "session-tails")
    for _ in range(MAX_ROUNDS):
        if tails.where("next is not null").isEmpty():
            return tails.drop("next")
        held = tails.select("user", F.col("slab").alias("next"), F.col("start").alias("_start"), F.col("n").alias("_n"), F.col("h").alias("_h"), F.col("next").alias("_next"))
        longer = tails.join(held, ["user", "next"], "left")
        tails = materialize(longer.select("user", "slab", F.coalesce("_start", "start").alias("start"), "end", (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"), (F.col("h") + F.coalesce("_h", F.lit(0))).alias("h"), F.col("_next").alias("next")), "session-tails")
    raise RuntimeError(f"a session runs over more than 2^{MAX_ROUNDS} slabs")


def _snapshots(counted: DataFrame, late: int, gap: int, width: int) -> DataFrame:
    """``(user, batch, start_s, end_s, n_events, n_new, h_sum)``: per batch the sessions that hold an event of it."""
    asked = counted.select("user", F.col("batch").alias("snapshot")).distinct()
    upto = _slab(F.col("seconds"), width) + late
    events = counted.select("user", "seconds", F.col("seconds").alias("start"), "n", "h", "batch", F.explode(F.sequence("batch", upto)).alias("snapshot"))
    events = events.select("user", "snapshot", "seconds", "start", "n", "h", F.when(F.col("batch") == F.col("snapshot"), F.col("n")).otherwise(0).alias("new"))
    history = _reaching(counted, gap, width).select("user", (F.col("slab") + late + 1).alias("snapshot"), F.col("end").alias("seconds"), "start", "n", "h", F.lit(0).cast("long").alias("new"))
    rows = events.unionByName(history).join(asked, ["user", "snapshot"], "left_semi")
    made = rows.groupBy("user", "snapshot", _window(gap)).agg(F.min("start").alias("start_s"), F.max("seconds").alias("end_s"), F.sum("n").alias("n_events"), F.sum("new").alias("n_new"), F.sum("h").alias("h_sum"))
    return made.where("n_new > 0").select("user", F.col("snapshot").alias("batch"), "start_s", "end_s", "n_events", "n_new", "h_sum")


def versions(events: DataFrame, gap: int = GAP_SECONDS, width: int = BATCH_SECONDS) -> DataFrame:
    """Every version of every session of ``events`` (``user, seconds, batch, weight``, all long): the columns ``VERSION``.

    A version is a session as it stands after a batch of which it holds an event. It retracts the standing sessions
    that it contains: each version has at most one retractor, the first later version of the user that
    contains it. ``n_events``, ``h_sum`` are over all its events (``h_sum`` of their weights), ``n_new`` over those of the batch.
    """
    if not 0 < gap < width:
        raise ValueError("a slab has to be longer than the gap")
    counted = materialize(_counted(events), "events")
    late = _lateness(counted, width)
    made = materialize(_snapshots(counted, late, gap, width), "versions")
    # a retractor has a new event within the gap of what it retracts, and that event is late by so much at most
    last = _slab(F.col("end_s") + gap, width) + late
    later = F.when(last > F.col("batch"), F.sequence(F.col("batch") + 1, last))
    asked = made.select("user", "batch", "start_s", "end_s", F.explode(later).alias("by"))
    by = made.select("user", F.col("batch").alias("by"), F.col("start_s").alias("_start"), F.col("end_s").alias("_end"))
    inside = (F.col("_start") <= F.col("start_s")) & (F.col("_end") >= F.col("end_s"))
    links = asked.join(by, ["user", "by"]).where(inside).groupBy("user", "batch", "start_s").agg(F.min(F.struct("by", "_start")).alias("r"))
    links = materialize(links.select("user", "batch", "start_s", F.col("r.by").alias("retracted_batch"), F.col("r._start").alias("retracted_start_s")), "retractions")
    held = links.groupBy("user", F.col("retracted_batch").alias("batch"), F.col("retracted_start_s").alias("start_s")).agg(F.count("*").alias("n_retracted"))
    key = ["user", "batch", "start_s"]
    return made.join(links, key, "left").join(held, key, "left").withColumn("n_retracted", F.coalesce("n_retracted", F.lit(0))).select(*VERSION)
