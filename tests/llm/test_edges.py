"""Odd tables through every operator on texts: nulls, empty and very long texts, repeated rows, clashing columns, no rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from findery.llm import byte_bpe, language_id, packing, quality_classifier, quality_rules, shingle_dedup, simhash, substring_dedup
from findery.llm.queries import BYTE_BPE, WORD_BPE, tokenizer_path

rnd = random.Random(12)
LONG = " ".join("".join(rnd.choices("abcdefgh", k=rnd.randint(1, 9))) for _ in range(200_000))
ROWS = [(1, "the house and the tree", "en"), (1, "the house and the tree", "en"), (1, "another text of the same id", None), (2, None, "en"), (3, "", None), (4, " \n\t", "en"), (5, LONG, "en"), (None, "no id at all", "en"), (None, None, None), (6, "x́ 你好 😀 \x00", "zz"), (7, "-" * 300_000, None)]
#: Columns that operators use themselves, with values of another type than theirs.
CLASH = {c: "clash" for c in ("score", "lang_pred", "n_tokens", "ids", "decoded", "n_words", "base_failed", "kept", "removed", "kept_text", "fp", "cls", "key", "rank", "bucket", "length", "slots", "_stats", "_found", "_cut", "a.b", "N_REPEAT_WORDS", "_u", "_t", "_m")}


def tables(spark):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").repartition(3)
    return plain, plain.withColumns({c: F.lit(v) for c, v in CLASH.items()})


def model():
    marks = [np.packbits(np.random.default_rng(k).random(1 << language_id.SLOT_BITS) < 0.01).tobytes() for k in range(6)]
    return language_id.fit(["en", "fr"], ["en", "fr"] * 3, marks, 4)


def bpe():
    P = pytest.importorskip("public_tokenizers")
    return byte_bpe.Coder(byte_bpe.read_ranks(tokenizer_path(BYTE_BPE)), P.PATTERN)


OPERATORS = {
    "score": (lambda d: quality_classifier.score(d, np.full((1 << quality_classifier.BITS) + 1, 0.1)), ["score"]),
    "identify": (lambda d: language_id.identify(d, model()), ["lang_pred", "score"]),
    "with_stats": (lambda d: quality_rules.verdict(quality_rules.with_stats(d), {"en": {"symbols": 0.1}}), [*quality_rules.STATS, "base_failed", "kept"]),
    "remove_repeats": (lambda d: substring_dedup.remove_repeats(d), ["n_words", "n_removed", "removed", "kept_text"]),
    "encode_texts": (lambda d: byte_bpe.encode_texts(d, bpe()), ["n_tokens", "ids", "decoded"]),
    "near_duplicates": (simhash.near_duplicates, ["fingerprint", "component_id"]),
    "pieces": (lambda d: packing.pieces(d, tokenizer_path(WORD_BPE)), ["piece", "start", "length", "ids_crc32"]),
    "keep_one": (shingle_dedup.keep_one, []),
    "keep_letters": (language_id.keep_letters, []),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_tables(spark, name):
    if name in ("encode_texts", "pieces"):
        pytest.importorskip("public_tokenizers")
    run, added = OPERATORS[name]
    plain, clash = tables(spark)
    look = lambda df: sorted(map(repr, (tuple(r) for r in df.select("doc_id", *added).collect())))
    got = look(run(plain))
    assert got == look(run(clash))
    if name not in ("pieces", "keep_one", "keep_letters"):
        assert len(got) == len(ROWS)
    out = run(clash)
    for c in set(CLASH) & set(out.columns) - set(added):
        assert {r[0] for r in out.select(F.col(f"`{c}`")).distinct().collect()} == {"clash"}
    assert run(clash.limit(0)).count() == 0


def test_training_on_odd_tables(spark):
    plain, clash = tables(spark)
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (5, 1), (None, 1), (6, None), (7, 0), (7, 1), (99, 1), (4, 5)], "doc_id long, quality int").withColumn("q", F.lit("clash"))
    w = [quality_classifier.train(t, labels) for t in (plain, clash)]
    assert np.array_equal(*w) and np.isfinite(w[0]).all() and w[0].any()
    assert not quality_classifier.train(plain.limit(0), labels).any()
    models = [language_id.train(t) for t in (plain, clash)]
    assert models[0].langs == models[1].langs == ["en", "zz"] and np.array_equal(models[0].weights, models[1].weights)
    assert language_id.train(plain.where("lang is null")).langs == []
    stats = quality_rules.with_stats(clash)
    assert quality_rules.calibrate(stats, labels) == {}
