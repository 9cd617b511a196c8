"""Exact duplicates: odd tables, and frequent digests on both sides of the split."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from findery.llm import exact_dedup

CASES = [(1, "Ab c"), (2, "aB C"), (2, "aB C"), (3, "ab  c"), (4, None), (5, ""), (None, "AB C"), (None, "alone"), (None, "alone"), (6, "ÀÉ"), (7, "àé"), (8, "x" * 300_000), (9, "X" * 300_000), (10, " ")]


def by_hand(rows):
    held = defaultdict(list)
    key = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    for i, t in rows:
        held[key(t)].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in held[key(t)] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(held[key(t)]), i == keep, hashlib.sha256(key(t).encode()).hexdigest()))
    return sorted(map(repr, out))


def found(df, **kw):
    rows = exact_dedup.classes(df, **kw).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest"))).collect()
    return sorted(repr(tuple(r)) for r in rows)


@pytest.mark.parametrize("support", [exact_dedup.SUPPORT, 0.3, 0.05])
def test_odd_rows(spark, support):
    df = spark.createDataFrame(CASES, "doc_id long, text string").repartition(3)
    clash = df.withColumns({c: F.lit("clash") for c in ("digest", "Key", "keep_id", "group_size", "KEPT", "a.b", "key_freqItems")})
    assert found(df, support=support) == found(clash, support=support) == by_hand(CASES)
    assert found(df.limit(0), support=support) == []


def test_frequent_ones_are_split(spark):
    rnd = random.Random(3)
    rows = [(k, "hot" if k % 3 == 0 else "Warm" if k % 7 == 0 else f"t{rnd.randrange(900)}") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    heavy = exact_dedup.frequent(exact_dedup.digests(df), 0.01)
    assert {(r.keep_id, r.group_size) for r in heavy.collect()} == {(2997, 1000), (max(k for k, t in rows if t == "Warm"), sum(t == "Warm" for _, t in rows))}
    assert found(df, support=0.01) == by_hand(rows)


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame(CASES, "doc_id long, text string")
    plan = exact_dedup.classes(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert "BroadcastHashJoin" in plan


def test_keep_one(spark):
    df = spark.createDataFrame(CASES, "doc_id long, text string").withColumn("a.b", F.lit(1))
    kept = exact_dedup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted((i or 0, t) for i, t in CASES if i not in (1, 4, 8))
