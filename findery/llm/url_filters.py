"""URL filters as a temporal list join, in DataFrame operations only.

Dated list entries become validity intervals per list key, and every capture is evaluated against the
entries active when it was fetched: its url gives the keys that a list could hold (each suffix of the host,
each prefix of the path), keys meet intervals in an equi-join with an as-of condition, and the most
specific active entry decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, unused

KINDS = ("domain", "prefix")
ACTIONS = ("allow", "block", "drop")


def host_of(url: Column) -> Column:
    """Lower-case host of an url, without user, port and a final dot; null if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(authority, r"^.*@|:[0-9]*$", ""))
    return F.nullif(F.regexp_replace(host, r"\.$", ""), F.lit(""))


def path_of(url: Column) -> Column:
    """Path of an url from its first slash, without query and fragment; ``/`` if empty."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def entry_key(key: Column) -> Column:
    """``key`` as candidates spell it: lower case, no slash at the end but that of ``host/``."""
    return F.regexp_replace(F.lower(key), "^([^/]+/.*[^/])/+$|^([^/]+/)/+$", "$1$2")


def intervals(entries: DataFrame) -> DataFrame:
    """``(kind, key, action, valid_from, valid_to)`` from dated entries ``(kind, key, action, listed_at)``.

    An entry holds from its date until the key's next one; ``drop`` ends an entry without a new one. Of
    entries with one key and date, ``block`` outranks ``allow`` and that ``drop``; repeated ones count once.
    Entries with a null column or an unknown kind or action are ignored; keys that spell one prefix are one.
    """
    sound = entries.where(F.col("kind").isin(*KINDS) & F.col("action").isin(*ACTIONS) & F.col("key").isNotNull() & F.col("listed_at").isNotNull())
    rank = F.when(F.col("action") == "block", 2).when(F.col("action") == "allow", 1).otherwise(0)
    one = sound.groupBy("kind", entry_key(F.col("key")).alias("key"), "listed_at").agg(F.max_by("action", rank).alias("action"))
    after = F.lead("listed_at").over(Window.partitionBy("kind", "key").orderBy("listed_at"))
    return one.withColumn("valid_to", after).where("action <> 'drop'").select("kind", "key", "action", F.col("listed_at").alias("valid_from"), "valid_to")


def candidate_keys(host: Column, path: Column) -> Column:
    """Array of ``(kind, key, depth)``: host suffixes, and path prefixes by segment.

    A suffix of one label counts for hosts of one or two labels only. An url whose first segment is empty
    has the prefix ``host/`` and no other; no other url has it.
    """
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.when(n <= 2, 1).otherwise(2), n), lambda k: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, n - k + 1, k), ".").alias("key"), k.alias("depth")))
    parts = F.when(F.split(path, "/")[1] == "", F.array(F.lit(""))).otherwise(F.filter(F.split(path, "/"), lambda x: x != ""))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.lit("prefix").alias("kind"), F.lower(F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("key"), (k + 1000).alias("depth")))
    return F.when(host.isNotNull(), F.concat(suffixes, prefixes))


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` (``url, fetched_at``, ...) with ``host, verdict, matched_kind, matched_key, active_from``.

    A path prefix outranks a domain, a longer key a shorter one. Without an active entry, a host or a fetch
    time the verdict is ``allow`` and the matched columns are null. Repeated captures are decided once and
    all returned; columns of ``captures`` with the name of a result are replaced, all others stay, whatever
    their names. An empty table gives an empty result.
    """
    own = captures.select(*columns_of(captures, "host", "verdict", "matched_kind", "matched_key", "active_from"))
    u, t, m = (unused(own, x) for x in ("_u", "_t", "_m"))
    asked = own.select(F.col("url").alias(u), F.col("fetched_at").alias(t)).where(F.col(u).isNotNull() & F.col(t).isNotNull()).distinct()
    keyed = asked.select(u, t, F.explode(candidate_keys(host_of(F.col(u)), path_of(F.col(u)))).alias("k")).select(u, t, "k.kind", "k.key", "k.depth")
    active = (F.col(t) >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col(t) < F.col("valid_to")))
    hits = keyed.join(intervals(entries), ["kind", "key"]).where(active)
    best = hits.groupBy(u, t).agg(F.max_by(F.struct("action", "kind", "key", "valid_from"), "depth").alias(m))
    joined = own.join(best, (F.col("url") == F.col(u)) & (F.col("fetched_at") == F.col(t)), "left")
    return joined.select(*columns_of(own), host_of(F.col("url")).alias("host"), F.coalesce(f"{m}.action", F.lit("allow")).alias("verdict"), F.col(f"{m}.kind").alias("matched_kind"), F.col(f"{m}.key").alias("matched_key"), F.col(f"{m}.valid_from").alias("active_from"))
