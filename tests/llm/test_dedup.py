"""Fingerprints, components, passages and vectors against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash

from findery.llm import embedding_dedup, graph, simhash, substring_dedup

DOCS = "doc_id long, text string"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def slow_fingerprint(text):
    words = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, edges):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def make_texts(seed, n=120):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 6))) for _ in range(300)]
    base = [" ".join(rnd.choices(vocab, k=rnd.choice([1, 2, 5, 60, 150]))) for _ in range(n)]
    passage = " ".join(rnd.choices(vocab, k=70))
    rows = [(k, t) for k, t in enumerate(base)]
    for k in range(n, n + 40):
        src = rnd.choice(base).split()
        if rnd.random() < 0.5:
            src[rnd.randrange(len(src))] = "changed"
        rows.append((k, "\n".join(src)))
    rows += [(500 + k, f"{rnd.choice(base)}\t{passage} {rnd.choice(vocab)}") for k in range(10)]
    rows += [(600, None), (601, ""), (602, " \n"), (603, "one"), (604, "x " * 400), (605, "x " * 300), (None, base[0]), (700, base[3]), (700, base[3]), (701, base[5] + " tail")]
    return rows


def test_fingerprint_pieces():
    rnd = random.Random(1)
    for n in (0, 1, 2, 3, 4, 500):
        text = " ".join(rnd.choice(["A", "b", "Çé", "the"]) for _ in range(n))
        assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


@pytest.mark.parametrize("chunk", [1024, 4])
def test_near_duplicates(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rows = make_texts(2)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], DOCS + ", fingerprint string, fp long")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    fps = {i: slow_fingerprint(t) for i, t in rows if i is not None}
    ids = sorted(fps)
    want = components(ids, [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 3])
    for r in got:
        if r.doc_id is not None:
            assert (r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", want[r.doc_id])
    kept = {r.doc_id for r in simhash.keep_one(df).collect()}
    assert kept == {None, *(i for i in ids if want[i] == i)}


def test_hot_keys_are_filed_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 16)
    monkeypatch.setattr(simhash, "MOST_CHUNKS", 2)
    rnd = random.Random(5)
    base = rnd.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rnd.sample(range(64), rnd.choice([0, 1, 2, 3, 5, 8]))) for _ in range(600)}
    low = [b for k, n in enumerate(simhash.BLOCKS) if k > 1 for b in range(13 * k, 13 * k + n)]
    fps |= {base ^ sum(1 << b for b in rnd.sample(low, rnd.choice([4, 6, 9]))) for _ in range(900)}  # two blocks in common
    fps = sorted(fps)
    rows = [(int(np.uint64(f).view(np.int64)), k) for k, f in enumerate(fps)]
    edges = simhash.links(spark.createDataFrame(rows, "fp long, rep long").repartition(3), 3).collect()
    assert all((fps[r.u] ^ fps[r.v]).bit_count() <= 3 for r in edges)
    x = np.array(fps, np.uint64)
    near = np.argwhere(np.triu(np.bitwise_count(x[:, None] ^ x[None]) <= 3, 1)).tolist()
    assert components(range(len(fps)), [(r.u, r.v) for r in edges]) == components(range(len(fps)), near)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0
    assert embedding_dedup.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert graph.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_long_chain(spark):
    edges = [(k, k + 1) for k in range(60)] + [(5, 5), (None, 1), (100, 99), (99, 100)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, 99: 99, 100: 99}


def brute_removal(rows, size):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words_of(t)
        for k in range(len(w) - size + 1):
            first.setdefault(tuple(w[k : k + size]), i)
    out = []
    for i, t in rows:
        w = words_of(t)
        gone = [False] * len(w)
        if i is not None:
            for k in range(len(w) - size + 1):
                if first[tuple(w[k : k + size])] < i:
                    gone[k : k + size] = [True] * size
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return out


def test_echoes_of_a_passage(spark):
    """A text that repeats a passage sends one place; all of them go if an earlier text has the passage, none if not."""
    p = " ".join(f"p{k}" for k in range(60))
    rows = [(3, f"{p} x {p} y {p}"), (5, f"a {p} b {p}"), (2, "z " * 70), (9, "z " * 200), (9, f"other {p}"), (None, p), (11, p)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, DOCS).repartition(6), combine=1).collect()
    key = lambda r: tuple(str(x) for x in r)
    digest = lambda t: hashlib.sha256(" ".join(words_of(t)).encode()).hexdigest()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, digest(r.kept_text)) for r in got), key=key) == sorted(brute_removal(rows, 50), key=key)


@pytest.mark.parametrize(("size", "gram", "combine"), [(50, 12, 1 << 18), (4, 2, 64), (1, 1, 16)])
def test_substring_dedup(spark, size, gram, combine):
    rows = make_texts(3)
    df = spark.createDataFrame([(*r, 7) for r in rows], DOCS + ", n_words int").repartition(5)
    got = substring_dedup.remove_repeats(df, size, gram, combine).collect()
    digest = lambda t: hashlib.sha256(" ".join(words_of(t)).encode()).hexdigest()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, digest(r.kept_text)) for r in got), key=key) == sorted(brute_removal(rows, size), key=key)
    for r in got:
        assert sum(x.end - x.start for x in r.removed) == r.n_removed


def test_intervals_merge():
    assert substring_dedup.intervals(np.array([7, 0, 1, 2, 7]), 3) == [(0, 5), (7, 10)]
    assert substring_dedup.intervals(np.array([0, 3]), 3) == [(0, 6)]
    assert substring_dedup.intervals(np.array([], int), 3) == []


@pytest.mark.parametrize("chunks", [(4096, 65_536), (16, 32)])
def test_vectors(spark, monkeypatch, chunks):
    # as many vectors as these get the widest probes, so no link is lost
    monkeypatch.setattr(embedding_dedup, "CHUNK", chunks[0])
    monkeypatch.setattr(embedding_dedup, "QUERY_CHUNK", chunks[1])
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 24)).astype(np.float32)
    for k in range(150, 260):
        x[k] = x[k % 20] + rng.normal(scale=rng.choice([0.02, 0.3]), size=24)
    x[260:270] = x[3]
    rows = [(k, v.tolist(), int(k % 3 == 0)) for k, v in enumerate(x)]
    rows += [(900, None, 1), (901, [0.0] * 24, 1), (902, [float("nan")] + [1.0] * 23, 1), (903, [float("inf")] * 24, 1), (904, x[0].tolist(), None), (905, [], 1), (906, [1.0, 2.0], 1), (907, [None] + [1.0] * 23, 1), (None, x[0].tolist(), 1), (908, (x[3] * 5).tolist(), 1)]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert len(got) == len(rows)
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if i is not None and (i < 300 or i in (906, 908))]
    edges = []
    for a, (i, v, lab) in enumerate(good):
        for j, w, other in good[a + 1 :]:
            if lab == other and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.93:
                edges.append((i, j))
    links = {i: 0 for i, _, _ in good}
    for i, j in edges:
        links[i] += 1
        links[j] += 1
    assert {i: got[i].n_links for i in links} == links and sum(links.values()) > 400
    want = components([g[0] for g in good], edges)
    assert all(got[i].component_id == c and got[i].kept == (c == i) for i, c in want.items())
    assert all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903, 904, 905, 907))
    assert got[None].component_id is None and not got[None].kept


@pytest.mark.parametrize(("kind", "big"), [("float", 0), ("double", 1)])
def test_vectors_in_their_own_precision(spark, kind, big):
    """Links just above and just below the threshold, and components that only doubles hold."""
    on = lambda c: [c, math.sqrt(1 - c * c)]
    rows = [(1, [1.0, 0.0], 0), (2, on(0.930001), 0), (3, on(0.929999), 0), (4, [1e200, 1e200], 1), (5, [2e200, 2e200], 1), (6, [1e-3, -1e-3], 1)]
    clash = spark.createDataFrame([(*r, 1, 2) for r in rows], f"vec_id long, embedding array<{kind}>, label int, cid int, rep int")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicate_vectors(clash).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: big, 5: big, 6: 0}


def test_reach_travels_to_the_workers(spark):
    """More vectors than those that always get the widest probes: an infinite reach gives every link, a short one does not."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(1000, 24))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    shift = rng.normal(size=base.shape)
    x = np.concatenate((base, base + 0.36 * shift / np.linalg.norm(shift, axis=1, keepdims=True))).astype(np.float32)
    rows = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(4)
    unit = embedding_dedup._unit(x)
    near = unit @ unit.T >= 0.93
    np.fill_diagonal(near, False)
    got = {reach: {r.vec_id: r.n_links for r in embedding_dedup.near_duplicate_vectors(rows, reach=reach).collect()} for reach in (math.inf, 0.01)}
    assert near.sum() > 1000 and got[math.inf] == dict(enumerate(near.sum(1).tolist()))
    assert sum(got[0.01].values()) < near.sum()
    with pytest.raises(ValueError):
        embedding_dedup.near_duplicate_vectors(rows, reach=0)
