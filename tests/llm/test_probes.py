"""Recall of the probes on vectors that fill few of their dimensions."""

import math

import numpy as np
import pytest

from findery.llm import embedding_dedup

RADIUS = math.sqrt(2 - 2 * 0.93)


def recall(index, x, queries):
    """Share of the links of some vectors whose list is visited, and the number of links."""
    of = embedding_dedup.nearest(x, index.centroids)[0]
    probes = index.probes(x[queries], RADIUS)
    met = total = 0
    for q, lists in zip(queries, probes, strict=True):
        linked = np.flatnonzero(x @ x[q] >= 0.93)
        linked = linked[linked != q]
        met += np.isin(of[linked], lists).sum()
        total += len(linked)
    return met / max(1, total), total


@pytest.mark.parametrize("effective", [3, 4, 6, 8, 16, 64])
def test_probes_reach_links(effective):
    rng = np.random.default_rng(effective)
    base = rng.normal(size=(8000, effective))
    copies = base / np.linalg.norm(base, axis=1, keepdims=True)
    shift = rng.normal(size=copies.shape)
    copies = copies + 0.33 * shift / np.linalg.norm(shift, axis=1, keepdims=True)
    turn = np.linalg.qr(rng.normal(size=(64, 64)))[0][:effective]
    x = embedding_dedup._unit((np.concatenate((base, copies)) @ turn).astype(np.float32))
    index = embedding_dedup.Index.fit(x, RADIUS)
    got, total = recall(index, x, np.arange(0, 16_000, 40))
    assert total > 50 and got >= 0.98
