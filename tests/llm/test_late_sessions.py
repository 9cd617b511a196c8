"""Versions of sessions, held against a plain replay of the batches."""

import random

import pytest
from pyspark.sql import functions as F

from findery.llm import late_sessions


def by_hand(rows, gap=240):
    """Replay batch by batch, all events of a user each time."""
    out = []
    for user in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == user]
        standing = {}
        for b in sorted({r[2] for r in mine}):
            upto = sorted((s, h, x) for _, s, x, h in mine if x <= b)
            sessions = []
            for e in upto:
                if sessions and e[0] - sessions[-1][-1][0] <= gap:
                    sessions[-1].append(e)
                else:
                    sessions.append([e])
            for held in sessions:
                new = sum(x == b for _, _, x in held)
                if new:
                    a, z = held[0][0], held[-1][0]
                    gone = [k for k in standing if a <= k[0] and k[1] <= z]
                    for k in gone:
                        standing.pop(k)[-2:] = [b, a]
                    row = [user, b, a, z, len(held), new, len(gone), sum(h or 0 for _, h, _ in held), None, None]
                    standing[a, z] = row
                    out.append(row)
    return sorted(map(repr, map(tuple, out)))


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, "user long, seconds long, batch long, weight long").repartition(3)
    return sorted(repr(tuple(r)) for r in late_sessions.versions(df, **kw).collect())


def test_a_bridge_and_the_borders(spark):
    """Exactly the gap joins, one second more does not; a late event joins two sessions."""
    rows = [(1, 0, 0, 5), (1, 240, 0, 7), (1, 481, 0, 1), (2, 0, 0, 1), (2, 480, 0, 1), (2, 240, 3, 1), (2, 10_000, 5, 2), (3, 1799, 0, 1), (3, 1800, 1, 1), (3, 1800, 1, 1)]
    assert found(spark, rows) == by_hand(rows)


@pytest.mark.parametrize("seed", range(3))
def test_random_events(spark, seed):
    """Dense and sparse users, over many slabs, with short slabs so that sessions run over several complete ones."""
    rnd = random.Random(seed)
    rows = []
    for user in range(12):
        step = rnd.choice([20, 60, 150, 400])
        at = rnd.randrange(-500, 500)
        for _ in range(rnd.randrange(1, 80)):
            at += rnd.randrange(0, 2 * step)
            rows.append((user, at, at // 300 + rnd.choice([0, 0, 0, 1, 2, 3]), rnd.randrange(100)))
    rows += rnd.sample(rows, 20)
    assert found(spark, rows, gap=240, width=300) == by_hand(rows)
    assert found(spark, rows, gap=100, width=300) == by_hand(rows, 100)


def test_one_session_over_many_slabs(spark):
    rows = [(7, 100 * k, 100 * k // 250, 1) for k in range(150)] + [(7, 5050, 22, 3), (8, 0, 4, 1), (8, 900, 1, 1)]
    assert found(spark, rows, gap=240, width=250) == by_hand(rows)


def test_odd_rows(spark):
    rows = [(None, 5, 1, 1), (1, None, 1, 1), (1, 5, None, 1), (1, 5, 0, None), (1, 5, 0, None), (1, 3600, 0, 2), (-4, -10, -1, 3)]
    whole = [r for r in rows if None not in r[:3]]
    assert found(spark, rows) == by_hand(whole)
    df = spark.createDataFrame(rows, "user long, seconds long, batch long, weight long")
    clash = df.withColumns({c: F.lit("clash") for c in ("slab", "n", "H", "start", "snapshot", "a.b", "session_window")})
    assert sorted(repr(tuple(r)) for r in late_sessions.versions(clash).collect()) == by_hand(whole)
    assert late_sessions.versions(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="gap"):
        late_sessions.versions(df, gap=1800)
