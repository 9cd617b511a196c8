"""Whitening, held against an eigendecomposition of the covariance that numpy makes of all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from findery.llm import queries, whitening


def by_hand(vectors):
    x = np.floor(256 * np.array(vectors, dtype=np.float64)).astype(np.int64)
    listed = np.unique(x, axis=0)
    n, sums = len(listed), listed.sum(axis=0)
    c = (listed - sums / n)
    e, v = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-e)
    return x, n, sums, e[order], v[:, order]


def check(got, ids, vectors, most=4, rel=1e-7):
    x, n, sums, e, v = by_hand(vectors)
    assert len(got) == len(ids) * most
    dev = (((n * x - sums).astype(object)) ** 2).sum(axis=1)
    want = (x - sums / n) @ v[:, :most] / np.sqrt(e[:most])
    held = {}
    for r in got:
        held.setdefault((r.vec_id, r.deviation, round(abs(r.whitened), 5)), []).append(r.component)
        assert r.n == n and r.identity_error < 1e-9
        assert r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-8)
    by = {(r.vec_id, r.component): r.whitened for r in got}
    for k in range(most):
        mine = np.array([by[i, k + 1] for i in ids])
        sign = np.sign(mine @ want[:, k])
        assert np.allclose(sign * mine, want[:, k], rtol=rel, atol=rel)
    assert {(r.vec_id, r.deviation) for r in got} == set(zip(ids, map(int, dev), strict=True))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    got = queries.op13_embedding_whitening(spark, sf).collect()
    check(got, [r.vec_id for r in rows], [r.embedding for r in rows])


def make(spark, vectors, parts=1, ids=None):
    rows = [(int(i), [None if v is None else float(v) for v in vec] if vec is not None else None) for i, vec in zip(ids or range(len(vectors)), vectors, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(parts, "vec_id")


def run(df, most=4):
    listed, dim = whitening.fit_list(df)
    model = whitening.fit(listed, dim)
    return model, whitening.whiten(df, model, most), whitening.identity_error(listed, model, most)


def test_a_tree_of_factors(spark):
    """More partitions than one merge takes, fewer rows in each than entries, and a third of all rows equal."""
    rnd = np.random.default_rng(5)
    vectors = np.vstack([rnd.normal(size=(400, 24)) * np.linspace(3, 0.1, 24), np.tile(rnd.normal(size=24), (200, 1))]).astype(np.float32)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "70")
    try:
        model, out, error = run(make(spark, vectors, 5))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    x, n, sums, e, v = by_hand(vectors)
    assert (model.n, model.sums) == (n, tuple(map(int, sums))) and n == 401 and error < 1e-10
    assert np.allclose(model.eigenvalues, e, rtol=1e-9)
    assert np.allclose(np.abs((model.components * v.T).sum(axis=1)), 1, atol=1e-7)
    rows = {r.vec_id: r for r in out.collect()}
    for k in (0, 399, 599):
        want = np.abs((x[k] - sums / n) @ v[:, :4] / np.sqrt(e[:4]))
        assert np.allclose(np.abs(rows[k].whitened), want, atol=1e-7)


def test_odd_rows(spark):
    vectors = [[1, 2, 3], [4, -1, 0], None, [], [1, None, 2], [float("nan"), 0, 0], [float("inf"), 0, 0], [7, 7], [2, 2, 5], [2, 2, 5], [-0.0, 0, 9]]
    df = make(spark, vectors, 3)
    model, out, error = run(df)
    kept = [0, 1, 8, 9, 10]
    assert sorted(r.vec_id for r in out.collect()) == kept and model.n == 4 and error < 1e-9
    clash = df.withColumns({c: F.lit("clash") for c in ("x", "Whitened", "found", "deviation", "a.b")})
    model2, out2, _ = run(clash)
    look = lambda d, w, v: sorted((r[0], r[1], tuple(r[2])) for r in d.select("vec_id", v, w).collect())
    assert look(out, "whitened", "deviation") == look(out2, "_whitened", "_deviation")
    assert {r[0] for r in out2.select("`a.b`").collect()} == {"clash"}


def test_without_variance(spark):
    """One distinct vector, and vectors on a line: components without variance have no value."""
    model, out, error = run(make(spark, [[1, 2, 3]] * 3))
    assert error == 0 and [r.whitened for r in out.collect()] == [[None] * 3] * 3 and {r.deviation for r in out.collect()} == {0}
    model, out, error = run(make(spark, [[k, 2 * k, 5] for k in range(9)], 2))
    assert error < 1e-9 and all(r.whitened[0] is not None and r.whitened[1:] == [None, None] for r in out.collect())
    assert whitening.fit(*whitening.fit_list(make(spark, [[1, 2]]).limit(0))) is None
    assert whitening.fit(*whitening.fit_list(make(spark, [[], None]))) is None


def test_large_entries(spark):
    """Sums and squares beyond 64 bits stay exact, or are null where a long cannot hold them."""
    big = float(2**50)
    vectors = [[big * (k + 1), 1.0 * k] for k in range(4)]
    df = make(spark, vectors)
    model, out, _ = run(df)
    assert model.sums[0] == sum(256 * 2**50 * (k + 1) for k in range(4))
    assert {r.deviation for r in out.collect()} == {None}
