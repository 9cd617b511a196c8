"""The near-copy stage of the pipeline against brute force over exact shingle sets."""

import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from findery.llm import shingle_dedup, simhash

sys.path.insert(0, str(Path(__file__).parent))
from test_dedup import components, words_of  # noqa: E402


def kept_by_hand(rows):
    sets = {}
    for i, t in rows:
        w = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    ids = sorted(i for i in sets if i is not None)
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    near = components(ids, [(a, b) for a in ids for b in ids if a < b and any(alike(x, y) for x in sets[a] for y in sets[b])])
    return {i for i in ids if near[i] == i}


@pytest.mark.parametrize("chunk", [1024, 3])
def test_stage_keeps_one_of_near_copies(spark, monkeypatch, chunk):
    monkeypatch.setattr(shingle_dedup, "CHUNK", chunk)
    rnd = random.Random(8)
    vocab = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(30):
        words = rnd.choices(vocab, k=rnd.choice([60, 120, 300]))
        rows.append((len(rows), " ".join(words)))
        for _ in range(k % 4):
            changed = list(words)
            for at in rnd.sample(range(len(words)), rnd.choice([1, 2, len(words) // 60, len(words) // 30])):
                changed[at] = rnd.choice(vocab)
            rows.append((len(rows), "\n".join(changed).title()))
    rows += [(500, None), (501, ""), (502, "one two"), (503, "One\ttwo"), (504, "two one"), (600, rows[0][1]), (600, rows[0][1]), (None, rows[0][1])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int").repartition(3)
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert {r.doc_id for r in got.collect()} == kept_by_hand(rows) | {None}
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_fingerprints_propose_pairs_by_themselves(spark):
    """With bands that no two texts share, near copies are found through fingerprints, and sets still decide."""
    rnd = random.Random(3)
    words = rnd.choices([f"w{k}" for k in range(400)], k=600)
    near = [*words[:300], "other", *words[301:]]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words * 2)), (4, " ".join(rnd.choices(words, k=600))), (5, ""), (6, "a b")]
    pair = spark.createDataFrame(rows, "doc_id long, text string")
    _, classes = shingle_dedup._classes(pair, shingle_dedup.SIZE)
    close = simhash.close_classes(pair, classes.where(F.size("keys") > 0), shingle_dedup.SIZE)
    reps = {r.cls: r.rep for r in classes.collect()}
    proposed = {tuple(sorted((reps[r.u], reps[r.v]))) for r in close.collect()}
    assert proposed and proposed <= {(1, 2), (1, 3), (2, 3)}
    alone = classes.withColumn("keys", F.array("cls"))
    assert shingle_dedup.links(pair, alone).count() == 0
    pairs = spark.createDataFrame([(c, d) for c in reps for d in reps if sorted((reps[c], reps[d])) in ([1, 2], [2, 4])], "u long, v long")
    assert {tuple(sorted(r)) for r in shingle_dedup.links(pair, alone, proposed=pairs).collect()} == {(1, 2)}
