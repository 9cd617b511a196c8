"""The registered queries, as queries: against SQL, and against plain Python where SQL cannot say them."""

import hashlib
import math
import random
import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from findery.llm import language_id, quality_classifier, quality_rules, queries
from findery.llm.common import hash_order

sys.path.insert(0, str(Path(__file__).parent))
from test_dedup import brute_removal, components, slow_fingerprint, words_of  # noqa: E402
from test_shingles import kept_by_hand  # noqa: E402
from test_text import check_packing, public, slow_stats  # noqa: E402

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def documents(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


# op9's rules certify nothing with the labels of the smallest tables
@pytest.mark.parametrize(("name", "sf"), [*((n, SMALL) for n in sorted(queries.ORACLE_SQL)), ("op9_quality_rules", MIDDLE)])
def test_against_sql(spark, name, sf):
    con = duckdb.connect()
    for t in ("pages", "embeddings", "documents", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    cur = con.execute(queries.ORACLE_SQL[name])
    cols = sorted(d[0] for d in cur.description)
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == cols
    assert sorted(tuple(str(r[c]) for c in cols) for r in got.collect()) == sorted(tuple(str(r[k]) for k in at) for r in cur.fetchall())


def test_op1(spark):
    fps = {i: slow_fingerprint(t) for i, t, _ in documents(spark, SMALL)}
    near = components(list(fps), [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3])
    got = queries.op1_simhash_near_dedup(spark, SMALL).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{f:016x}", near[i]) for i, f in fps.items())


def plain_ftrl(rows, epochs=quality_classifier.EPOCHS):
    """FTRL-proximal over dictionaries, a coordinate at a time; rows are (slots, label)."""
    alpha, beta, l1, l2 = (getattr(quality_classifier, k) for k in ("ALPHA", "BETA", "L1", "L2"))
    z, n = {}, {}

    def weight(k):
        if abs(z.get(k, 0.0)) <= l1:
            return 0.0
        return -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    def margin(slots):
        return sum(weight(k) for k in slots) / math.sqrt(max(1, len(slots))) + weight("bias")

    for _ in range(epochs):
        for slots, label in rows:
            g0 = 1 / (1 + math.exp(-margin(slots))) - label
            for k in [*slots, "bias"]:
                g = g0 * (1.0 if k == "bias" else 1 / math.sqrt(len(slots)))
                w, had = weight(k), n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (math.sqrt(had + g * g) - math.sqrt(had)) / alpha * w
                n[k] = had + g * g
    return lambda slots: 1 / (1 + math.exp(-margin(slots)))


def test_op2(spark):
    docs = documents(spark, SMALL)
    slots = {i: quality_classifier.features(t).tolist() for i, t, _ in docs}
    said = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect() if r.quality is not None}
    order = spark.createDataFrame([(i,) for i in said if fold(i, 3) != 1 and i in slots], "doc_id long").orderBy(hash_order(F.col("doc_id")), "doc_id")
    score = plain_ftrl([(slots[r.doc_id], said[r.doc_id]) for r in order.collect()])
    got = {r.doc_id: r for r in queries.op2_quality_classifier(spark, SMALL).collect()}
    assert set(got) == set(slots)
    for i, r in got.items():
        assert r.score == pytest.approx(score(slots[i]), abs=1e-5)
        assert r.held_out == (fold(i, 3) == 1) and r.predicted == int(r.score >= 0.5)


def test_quality_features_by_hand():
    grams = quality_classifier.features("Ab ab! ab")
    assert len(grams) == 3 + 3  # Ab, ab, ! and three pairs
    assert len(quality_classifier.features("")) == len(quality_classifier.features(None)) == 0


def slow_presence(text):
    """Slots of the 1- to 4-grams of the lower-cased text."""
    points = [ord(c) for c in text.lower()]
    out = set()
    for n in range(1, 5):
        for k in range(len(points) - n + 1):
            code = 0
            for p in points[k : k + n]:
                code = (code * 0x100000001B3 + p) % 2**64
            out.add(((code ^ n << 56) * 0x9E3779B97F4A7C15) % 2**64 >> 64 - language_id.SLOT_BITS)
    return out


def explicit_kernel(train, landmarks, ridge=language_id.RIDGE):
    """Kernel ridge on Nystroem features from explicit kernel matrices; train is a list of (lang, set)."""
    kernel = lambda a, b: np.array([[len(x & y) / math.sqrt(max(1, len(x)) * max(1, len(y))) for y in b] for x in a])
    base = [s for _, s in train[:landmarks]]
    value, vector = np.linalg.eigh(kernel(base, base))
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    langs = sorted({lang for lang, _ in train})
    phi = kernel([s for _, s in train], base) @ root
    y = np.array([[1.0 if lang == k else -1.0 for k in langs] for lang, _ in train])
    w = np.linalg.solve(phi.T @ phi + ridge * np.eye(phi.shape[1]), phi.T @ y)
    return langs, lambda s: (kernel([s], base) @ root @ w)[0]


def test_op4(spark):
    docs = documents(spark, SMALL)
    sets = {i: slow_presence(t or "") for i, t, _ in docs}
    langs = sorted({lang for i, t, lang in docs if lang is not None and t is not None and fold(i, 4) != 2})
    each = max(language_id.LANG_ROWS, language_id.MAX_ROWS // len(langs))
    order = {r.doc_id: k for k, r in enumerate(spark.createDataFrame([(i,) for i, _, _ in docs], "doc_id long").orderBy(hash_order(F.col("doc_id"))).collect())}
    ranked = []
    for lang in langs:
        own = sorted((order[i], i) for i, t, x in docs if x == lang and t is not None and fold(i, 4) != 2)[:each]
        ranked += [(rank, lang, i) for rank, (_, i) in enumerate(own)]
    known, decide = explicit_kernel([(lang, sets[i]) for _, lang, i in sorted(ranked)], max(language_id.LANDMARKS, len(langs)))
    got = {r.doc_id: r for r in queries.op4_language_id(spark, SMALL).collect()}
    assert set(got) == set(sets)
    for i, t, _ in docs:
        r = got[i]
        assert r.held_out == (fold(i, 4) == 2)
        if not t or not any(c.isalpha() for c in t):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        f = language_id.SHARPNESS * decide(sets[i])
        share = np.exp(f - f.max()) / np.exp(f - f.max()).sum()
        assert r.score == pytest.approx(share.max(), abs=1e-3)
        if np.sort(share)[-2] < share.max() - 1e-2:
            assert r.lang_pred == known[int(share.argmax())]


def test_op8(spark):
    P = public()
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.tokenizer_path(queries.BYTE_BPE), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t, _ in documents(spark, SMALL):
        ids = own.encode_ordinary(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(t or "")))
    assert sorted(tuple(r) for r in queries.op8_byte_bpe(spark, SMALL).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == sorted(want)


def whole_pieces(rows):
    tokenizers = pytest.importorskip("tokenizers")
    whole = tokenizers.Tokenizer.from_file(queries.tokenizer_path(queries.WORD_BPE))
    whole.encode_special_tokens = True
    out = []
    for i, t in rows:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        out += [(i, k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    return out


PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]


def test_op10(spark):
    public()
    got = queries.op10_best_fit_packing(spark, SMALL).collect()
    want = whole_pieces([(i, t) for i, t, _ in documents(spark, SMALL)])
    assert sorted(tuple(r[c] for c in PIECE) for r in got) == sorted(want)
    total = sum(w[3] for w in want)
    bound = max(-(-total // 2048), sum(2 * w[3] > 2048 for w in want))
    assert check_packing(got, 2048) <= 1.02 * bound + 1


# ---- the pipeline ----


def brute_cutoffs(stats, labels):
    """Certified joint cutoffs in plain Python, from ``(id, text, stratum, counts)``; each labelled text of a stratum counts once."""
    limits, names = quality_rules.Limits(), quality_rules.STATS
    said = {}
    for i, q in labels:
        if i is not None and q in (0, 1):
            said.setdefault(i, set()).add(q)
    groups, borne, units = {}, {}, {}
    for i, text, _, _ in stats:
        borne.setdefault(i, set()).add(text or "")
    for i, text, stratum, counts in stats:
        if i is not None and len(said.get(i, ())) == 1 and len(borne[i]) == 1:
            units.setdefault((stratum, text or ""), (counts, set()))[1].update(said[i])
    for (stratum, text), (counts, verdicts) in units.items():
        s = dict(zip(names, counts, strict=True))
        if len(verdicts) != 1 or s["n_words"] < 50 or 100 * s["n_repeat_words"] > 50 * s["n_words"]:
            continue
        role = "bad" if 0 in verdicts else "design" if int(hashlib.md5(text.encode()).hexdigest()[:8], 16) % 5 == 0 else "good"
        groups.setdefault(stratum, {"bad": [], "design": [], "good": []})[role].append({r: s[a] / max(1, s[b]) for r, (a, b) in quality_rules.RULES.items()})
    groups = {k: g for k, g in groups.items() if (1 - limits.alpha) ** len(g["good"]) <= limits.delta}
    out = {}
    for stratum, g in groups.items():
        best = None
        for lift in quality_rules.LIFTS:
            joint = {}
            for rule in quality_rules.RULES:
                over = lambda role, c: sum(x[rule] > c for x in g[role])  # noqa: B023, E731
                bad = {c: over("bad", c) / max(1, len(g["bad"])) for c in quality_rules.GRID}
                fit = [bad[c] for c in quality_rules.GRID if bad[c] > 0 and bad[c] >= lift * ((over("design", c) + 1) / (len(g["design"]) + 1))]
                if fit:
                    joint[rule] = max(c for c in quality_rules.GRID if bad[c] >= limits.catch * max(fit))
            hit = {role: sum(any(x[r] > c for r, c in joint.items()) for x in g[role]) for role in ("good", "bad")}
            n = len(g["good"])
            if sum(math.comb(n, i) * limits.alpha**i * (1 - limits.alpha) ** (n - i) for i in range(hit["good"] + 1)) > limits.delta / len(groups):
                break
            best = [*(best or []), (hit["bad"], joint)]
        if best:
            out[stratum] = next(joint for caught, joint in best if caught >= limits.catch * best[-1][0])
    return out


def brute_pipeline(rows, labels, model_of):
    """The five stages in plain Python over ``(doc_id, text, lang)``: after each, the rows; at last the pieces."""
    marks = lambda t: sum(any(w[k : k + 2] in ("!!", "!?", "?!", "??") for k in range(len(w) - 1)) for w in words_of(t))
    lines = lambda t: sum(bool(words_of(x)) for x in (t or "").split("\n"))
    stats = [(i, t, lang or "und", (*slow_stats(t), lines(t), marks(t))) for i, t, lang in rows]
    cutoffs = brute_cutoffs(stats, labels)
    kept = []
    for row, (_, _, stratum, counts) in zip(rows, stats, strict=True):
        s = dict(zip(quality_rules.STATS, counts, strict=True))
        over = any(s[a] / max(1, s[b]) > cutoffs.get(stratum, {}).get(r, math.inf) for r, (a, b) in quality_rules.RULES.items())
        if s["n_words"] >= 50 and 100 * s["n_repeat_words"] <= 50 * s["n_words"] and not over:
            kept.append(row)
    best, score = model_of(kept)
    spoken = [r for r, b, s in zip(kept, best, score, strict=True) if b >= 0 and s >= 0.5]
    stay = kept_by_hand([(i, t) for i, t, _ in spoken])
    single = [r for r in spoken if r[0] is None or r[0] in stay]
    left = []
    for r, gone in zip(single, brute_removal([(i, t) for i, t, _ in single], 50), strict=True):
        left.append((r, gone))
    return cutoffs, [kept, spoken, single, left]


def stages(spark, docs, sf, folder):
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, sf)
        docs.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        assert k == 4 or docs.columns == before.columns
        out.append(docs)
    return out


def check_stages(out, want, key):
    text = lambda rows: sorted(map(str, rows))
    for k in range(3):
        assert text(key(r) for r in out[k].collect()) == text(want[k])
    # a changed text is its kept words, joined
    got = sorted(((r.doc_id, sha(" ".join(words_of(r.text)))) for r in out[3].collect()), key=str)
    assert got == sorted(((r[0], gone[3]) for r, gone in want[3]), key=str)
    unchanged = {(r[0], r[1]) for r, gone in want[3] if not gone[2]}
    assert unchanged <= {(r.doc_id, r.text) for r in out[3].collect()}
    pieces = whole_pieces([(r.doc_id, r.text) for r in out[3].collect()])
    assert text(tuple(r[c] for c in PIECE) for r in out[4].collect()) == text(pieces)
    check_packing(out[4].collect(), 2048)


def test_pipeline(spark, tmp_path):
    public()
    rows = documents(spark, MIDDLE)
    labels = [tuple(r) for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").select("doc_id", "quality").collect()]
    out = stages(spark, spark.read.parquet(f"{MIDDLE}/documents.parquet"), MIDDLE, tmp_path)
    model = language_id.train(out[0])
    cutoffs, want = brute_pipeline(rows, labels, lambda kept: model.scores([t for _, t, _ in kept]))
    assert cutoffs  # rules beyond the base ones act
    check_stages(out, want, lambda r: (r.doc_id, r.text, r.lang))
    again = corpus_pipeline.run(spark, MIDDLE)
    assert sorted(tuple(r[c] for c in PIECE) for r in again.collect()) == sorted(tuple(r[c] for c in PIECE) for r in out[4].collect())


def test_pipeline_edges(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows and ids, and columns that clash with operators' names."""
    public()
    rnd = random.Random(11)
    vocab = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 7))) for _ in range(3000)]
    say = lambda n: " ".join(rnd.choices(vocab, k=n))
    passage, base = say(80), say(120)
    rows = [(k, say(rnd.choice([60, 100, 300])), rnd.choice(["en", "en", None])) for k in range(40)]
    rows += [(50, None, "en"), (51, "", "en"), (52, " \n\t", None), (53, say(40_000), "en"), (54, "1 2 3 " * 40, "en"), (None, say(70), None), (None, None, None)]
    rows += [(60, base, "en"), (61, base, "en"), (62, base.upper(), "fr"), (63, base.replace(" ", "\n"), None), (60, base, "en"), (None, base, "en"), (60, say(90), "en")]
    rows += [(70 + k, f"{say(60)}\n{passage}  {say(60)}", "en") for k in range(4)] + [(80, f"{passage} x {passage} y", "en")]
    clash = "n_words int, score string, lang_pred string, kept string, base_failed int, removed string, kept_text string, places int, mins int, cls int, key string, `a.b` int, _stats int, _cut int, component_id string, n_chars int"
    extra = (777, "s", "lp", "k", 5, "r", "kt", 1, 2, 3, "key", 4, 6, 7, "c")
    docs = spark.createDataFrame([(*r, *extra, None if r[1] is None else len(r[1])) for r in rows], f"doc_id long, text string, lang string, {clash}").repartition(4)
    spark.createDataFrame([(None, 1), (60, None), (61, 0), (61, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/sf/labels.parquet")
    docs.write.parquet(f"{tmp_path}/sf/documents.parquet")
    out = stages(spark, docs, f"{tmp_path}/sf", tmp_path)
    model = language_id.train(out[0])
    cutoffs, want = brute_pipeline(rows, [(61, 0), (61, 1)], lambda kept: model.scores([t for _, t, _ in kept]))
    assert cutoffs == {}
    check_stages(out, want, lambda r: (r.doc_id, r.text, r.lang))
    for df in out[:4]:
        for r in df.collect():
            assert tuple(r)[3:-1] == extra
            assert r.n_chars == len(r.text)
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        got = stage(spark, none, f"{tmp_path}/sf")
        assert got.count() == 0
    assert corpus_pipeline.run(spark, f"{tmp_path}/sf").count() == out[4].count()
