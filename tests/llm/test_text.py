"""Tokens, packing, rules, languages and quality against plain Python."""

import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from findery.llm import byte_bpe, language_id, packing, quality_classifier, quality_rules
from findery.llm.common import fold_of, split_words
from findery.llm.queries import BYTE_BPE, WORD_BPE, tokenizer_path

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n", "don't I'LL  go\t!", "Éé ß ÀÞ × ½ªµ", "你好　a b", "x́ y", "<|endoftext|>", "a" * 5000, "\x00\x1c\x85", "é" * 700 + " Ω"]


def public():
    return pytest.importorskip("public_tokenizers")


def test_word_ids_match_the_library():
    public()
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokenizer_path(WORD_BPE))
    t.encode_special_tokens = True
    ours, rnd = packing.WordIds(tokenizer_path(WORD_BPE)), random.Random(4)
    pool = "abXYéÉßÀÿ'sdtmlve09½ªº µ×.,!-_|<>\"&́ 　你好ΣςİIıﬁ²\x1c\x85~     "
    texts = [x or "" for x in ODD] + ["".join(rnd.choices(pool, k=rnd.randint(0, 15))) for _ in range(3000)]
    ids, at = ours.of(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == t.encode(text, add_special_tokens=False).ids


def test_words():
    rnd = random.Random(2)
    texts = ODD + ["".join(rnd.choices("abÇ \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u2003Z", k=rnd.randint(0, 30))) for _ in range(500)]
    for lower in (False, True):
        found = split_words(pa.array(["skipped", *texts], pa.string()).slice(1), lower)
        for k, t in enumerate(texts):
            want = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if lower and "A" <= c <= "Z" else c for c in t or ""))
            assert [found.distinct[c].decode() for c in found.of(k)] == want
    assert len(split_words(pa.array([], pa.string()))) == 0


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_round_trip(spark):
    public()
    rows = [(k, t) for k, t in enumerate(ODD)] + [(1, "twice"), (1, "twice"), (None, "no id"), (99, "word, " * 3000)]
    got = packing.pack_documents(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length int"), tokenizer_path(WORD_BPE)).collect()
    check_packing(got, 2048)
    ours = packing.WordIds(tokenizer_path(WORD_BPE))
    want = []
    for i, t in rows:
        ids = ours.of(pa.array([t], pa.string()))[0].tobytes() + bytes(4)
        for k, at in enumerate(range(0, len(ids), 8192)):
            part = ids[at : at + 8192]
            want.append((i, k, at // 4, len(part) // 4, zlib.crc32(part)))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(want, key=key)
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path(WORD_BPE)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_valid_and_near_the_bound(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([64, 200, 2048])
    histogram = Counter(min(capacity, max(1, int(rnd.lognormvariate(math.log(capacity) - rnd.choice([0.7, 1.5, 3]), 1)))) for _ in range(3000))
    plan = packing.plan(histogram, capacity)
    runs = {}
    for row in plan.runs:
        runs.setdefault(row[0], []).append(row)
    fill = {}
    for length, n in histogram.items():
        rows = sorted(runs[length], key=lambda r: r[1])
        for k in range(n):
            _, first_rank, first, each, offset = max((r for r in rows if r[1] <= k), key=lambda r: r[1])
            fill.setdefault(first + (k - first_rank) // each, []).append((offset + (k - first_rank) % each * length, length))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    big = sum(n for length, n in histogram.items() if 2 * length > capacity)
    bound = max(big, -(-sum(k * n for k, n in histogram.items()) // capacity))
    assert len(fill) == plan.sequences <= 1.06 * bound + 2


def test_bpe_matches_the_library(spark):
    P = public()
    tiktoken = pytest.importorskip("tiktoken")
    ranks = byte_bpe.read_ranks(tokenizer_path(BYTE_BPE))
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = byte_bpe.Coder(ranks, P.PATTERN)
    rows = [(k, t) for k, t in enumerate(ODD)] + [(50, "the the théâtre and others'll  go\n 12345")]
    df = spark.createDataFrame([(*r, r[1]) for r in rows], "doc_id long, text string, t string")
    forms = {"python": byte_bpe.encode_texts(df, coder).collect(), "expressions": byte_bpe.decode(byte_bpe.encode(df.where("coalesce(length(text), 0) < 1000"), coder), coder).collect()}
    for got in forms.values():
        for r in got:
            ids = own.encode_ordinary(r.t or "")
            assert (r.n_tokens, r.ids, bytes(r.decoded)) == (len(ids), ",".join(map(str, ids)), (r.t or "").encode())
    assert len(forms["python"]) == len(rows)
    assert byte_bpe.encode_texts(df.limit(0), coder).count() == 0


def test_long_words_fold_fast():
    P = public()
    tiktoken = pytest.importorskip("tiktoken")
    ranks = byte_bpe.read_ranks(tokenizer_path(BYTE_BPE))
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = {r: p for p, r in ranks.items()}
    rnd = random.Random(9)
    words = ["-" * 3001, "a" * 3000, "".join(rnd.choices("etaoinshrdlué", k=3000)), "x" * byte_bpe.LONG_WORD, "ab" * 200, " " * 3001]
    words += ["".join(rnd.choices("ab-é", k=rnd.randint(60, 300))) for _ in range(300)]
    for word in words:
        assert byte_bpe.fold_bytes(word.encode(), ranks) == own._encode_single_piece(word.encode())
    start = time.time()
    for word in (b"-" * 1_000_000, b"a" * 1_000_000, "".join(rnd.choices("etaoinshrdlué", k=300_000)).encode()):
        assert b"".join(pieces[r] for r in byte_bpe.fold_bytes(word, ranks)) == word
    assert time.time() - start < 60


def slow_stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_rule_statistics():
    rnd = random.Random(6)
    texts = ODD + ["".join(rnd.choices("ab é#|\n\t ", k=rnd.randint(0, 80))) for _ in range(500)] + ["a b c " * 40]
    for t in texts:
        assert quality_rules.text_stats(t.encode() if t is not None else None)[:5] == slow_stats(t)


def test_binomial_tail():
    for k, n, p in ((0, 10, 0.1), (3, 20, 0.2), (20, 20, 0.5)):
        assert quality_rules.binomial_tail(k, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_certified_rules(spark):
    rnd = random.Random(7)
    rows, labels = [], []
    for k in range(4000):
        bad = k % 4 == 0
        words = [f"w{rnd.randrange(5000)}" + ("&&&" if bad else "") for _ in range(60)]
        rows.append((k, " ".join(words), "en" if k % 16 else None))
        labels.append((k, int(not bad)))
    labels += [(0, 1), (None, 1), (5, None)]
    docs = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, lang string, base_failed string, n_lines int")
    stats = quality_rules.with_stats(docs, keep_text=False)
    cutoffs = quality_rules.calibrate(stats, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert set(cutoffs) == {"en"} and set(cutoffs["en"]) == {"symbols"} and cutoffs["en"]["symbols"] > 0.1
    got = {r.doc_id: r.kept for r in quality_rules.verdict(stats, cutoffs).collect()}
    assert all(got[k] for k in range(4000) if k % 4 or not k % 16) and not any(got[k] for k in range(4, 4000, 4) if k % 16)
    kept = quality_rules.keep(docs, cutoffs)
    assert kept.columns == docs.columns and {(r.doc_id, r.base_failed, r.n_lines) for r in kept.collect()} == {(k, "x", 5) for k, v in got.items() if v}
    assert quality_rules.calibrate(stats, spark.createDataFrame([], "doc_id long, quality int")) == {}
    assert quality_rules.verdict(quality_rules.with_stats(docs.limit(0)), {}).count() == 0
    assert quality_rules.keep(docs.limit(0), cutoffs).count() == 0


def test_copies_are_no_further_trials(spark):
    """Eight good texts in 40 rows each, under one id or under 40, certify nothing; 200 distinct ones do."""
    rnd = random.Random(9)
    say = lambda k, end="": " ".join(f"w{rnd.randrange(5000)}{end}" for _ in range(60)) + f" {k}"
    bad = [(1000 + k, say(k, "&&&"), "en") for k in range(50)]
    good = [(k, say(k), "en") for k in range(8)]
    many = {"rows": [r for r in good for _ in range(40)], "ids": [(5000 + 40 * k + j, t, "en") for k, t, _ in good for j in range(40)], "texts": [(k, say(k), "en") for k in range(260)]}
    for name, rows in many.items():
        docs = spark.createDataFrame(bad + rows, "doc_id long, text string, lang string")
        labels = spark.createDataFrame([(i, int(i < 1000 or i >= 5000)) for i in {r[0] for r in bad + rows}], "doc_id long, quality int")
        stats = quality_rules.with_stats(quality_rules.labelled(docs, labels))
        assert bool(quality_rules.calibrate(stats, labels)) == (name == "texts")
    docs = spark.createDataFrame(good[:2] + [(0, "another text", "en"), (9, good[2][1], "en"), (10, good[2][1], None), (11, good[3][1], "en"), (12, good[3][1], "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(0, 1), (1, 1), (9, 1), (10, 1), (11, 0), (12, 1)], "doc_id int, quality long")
    got = [r.stratum for r in quality_rules.trials(quality_rules.with_stats(docs), labels).collect()]
    assert sorted(got) == ["en", "en", "und"]  # ids with two texts and texts labelled both ways do not count


def test_training_takes_any_whole_numbers(spark):
    docs = [(1, "a good text"), (2, "a bad !!! text"), (3, "good good words"), (4, "bad !!! words")]
    labels = [(1, 1), (2, 0), (3, 1), (4, 0)]
    plain = quality_classifier.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    other = quality_classifier.train(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(labels, "doc_id short, quality long"))
    assert plain.any() and np.array_equal(plain, other)


def test_false_rejection_holds_on_fresh_labels():
    """Over many draws a certified step rejects more than alpha of the good documents no more often than delta."""
    rng, limits = np.random.default_rng(1), quality_rules.Limits()
    true = np.linspace(0, 0.06, quality_rules.STEPS + 1)[1:]  # share of the good ones that each step rejects
    over = 0
    for _ in range(400):
        first = np.searchsorted(true, rng.random(600))
        at = quality_rules.choose(np.bincount(first, minlength=quality_rules.STEPS + 1), np.arange(quality_rules.STEPS + 1), limits, 1)
        over += at is not None and true[at] > limits.alpha
    assert over <= 0.05 * 400 * 1.5


def tables(spark):
    read = lambda n: spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet")
    return read("documents"), read("labels")


def test_language_accuracy(spark):
    docs, _ = tables(spark)
    fold = fold_of(F.col("doc_id"), 4)
    model = language_id.train(docs.where(fold != 2), max_rows=300)
    held = language_id.identify(docs.where(fold == 2), model)
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count()
    odd = spark.createDataFrame([(None,), ("",), ("123 !",), ("the house and the tree",)], "text string")
    got = language_id.identify(odd, model).collect()
    assert [r.lang_pred for r in got][:3] == ["und"] * 3 and got[3].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got)
    blank = language_id.train(docs.limit(0))
    assert language_id.identify(odd, blank).where("lang_pred = 'und'").count() == 4


def test_quality_accuracy(spark):
    docs, labels = tables(spark)
    fold = fold_of(F.col("doc_id"), 3)
    weights = quality_classifier.train(docs.where(fold != 1), labels.where(fold != 1))
    held = quality_classifier.score(docs.where(fold == 1).drop("lang"), weights).join(labels, "doc_id")
    right = held.where((F.col("score") >= 0.5).cast("int") == F.col("quality")).count()
    assert right >= 0.93 * held.count()
    blank = quality_classifier.train(docs, labels.limit(0))
    odd = spark.createDataFrame([(None,), ("",), ("x",)], "text string")
    assert [r.score for r in quality_classifier.score(odd, blank).collect()] == [0.5] * 3


def test_folds(spark):
    got = spark.createDataFrame([(0,), (7,), (None,)], "doc_id long").select("doc_id", fold_of(F.col("doc_id"), 3).alias("f")).collect()
    assert [r.f for r in got] == [zlib.crc32(b"0") % 3, zlib.crc32(b"7") % 3, -1]


def test_every_word_of_a_text_is_folded_by_the_expressions(spark):
    P = public()

    class Marked(byte_bpe.Coder):
        def fold(self, word):
            return F.array(F.lit(7), F.length(word))

    coder = Marked(byte_bpe.read_ranks(tokenizer_path(BYTE_BPE)), P.PATTERN)
    rows = [(1, "qzx the the"), (2, "the qzx é" + " zq" * 3), (3, None)]
    got = {r.doc_id: (r.n_tokens, r.ids) for r in byte_bpe.encode_texts(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), coder).drop("decoded").collect()}
    assert got == {1: (6, "7,3,7,4,7,4"), 2: (12, "7,3,7,4,7,3,7,3,7,3,7,3"), 3: (0, "")}


def test_pair_ranks_are_looked_up_at_displaced_rows():
    rnd = random.Random(5)
    rows = {x: {y: x * 1000 + y for y in rnd.sample(range(300), rnd.choice([1, 1, 1, 2, 5, 200]))} for x in rnd.sample(range(300), 250)}
    offsets, owners, values = byte_bpe.displaced(rows, 300)
    for x in range(300):
        for y in range(300):
            at = None if offsets[x] is None else offsets[x] + y
            got = values[at] if at is not None and 0 <= at < len(owners) and owners[at] == x else None
            assert got == rows.get(x, {}).get(y)
    assert byte_bpe.displaced({}, 3) == ([None] * 3, [], [])


def test_words_are_folded_without_positions_by_search_and_decoded_from_numbers(spark):
    P = public()
    ranks = byte_bpe.read_ranks(tokenizer_path(BYTE_BPE))
    coder, rnd = byte_bpe.Coder(ranks, P.PATTERN), random.Random(8)
    words = ["".join(rnd.choices(c, k=rnd.randint(1, 40))) for c in ("ab", "aé-", "etaoinshr") for _ in range(150)]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", coder.fold(byte_bpe.latin(F.col("w"))).alias("ids"))
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "array_position" not in plan and "concat(" not in plan
    for r in got.collect():
        assert r.ids == byte_bpe.fold_bytes(r.w.encode(), ranks)
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    assert "split(" not in byte_bpe.encode_texts(docs, coder)._jdf.queryExecution().analyzed().toString().split("MapInArrow")[0]
