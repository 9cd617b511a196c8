"""Many and rare languages, and none at all."""

import random

import corpus_pipeline
from findery.llm import language_id

DOCS = "doc_id long, text string, lang string"


def tongue(k):
    rnd = random.Random(k)
    letters = rnd.sample("abcdefghijklmnopqrstuvwxyz", 12)
    return ["".join(rnd.choices(letters, k=rnd.randint(2, 8))) for _ in range(150)]


def test_every_language_is_learnt(spark):
    rnd = random.Random(3)
    tongues = {f"l{k:03}": tongue(k) for k in range(130)}
    say = lambda lang: " ".join(rnd.choices(tongues[lang], k=120))
    # the last ten have two rows each, fewer than any cut would leave
    rows = [(lang, k) for lang in tongues for k in range(2 if lang >= "l120" else 6)]
    docs = spark.createDataFrame([(n, say(lang), lang) for n, (lang, _) in enumerate(rows)], DOCS)
    model = language_id.train(docs)
    assert model.langs == sorted(tongues)
    held = [(lang, say(lang)) for lang in tongues for _ in range(2)]
    best, score = model.scores([t for _, t in held])
    right = [model.langs[b] == lang for b, (lang, _) in zip(best, held, strict=True)]
    assert sum(right) >= 0.97 * len(held) and sum(right[-20:]) >= 18


def test_filter_without_declared_languages(spark):
    rows = [(1, "the house and the tree", None), (2, "123 !", None), (3, None, None), (4, "ß", None)]
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted(r.doc_id for r in corpus_pipeline.language_filter(spark, docs, "").collect()) == [1, 4]
    few = spark.createDataFrame([(k, t, "en") for k, t, _ in rows], DOCS)
    assert sorted(r.doc_id for r in corpus_pipeline.language_filter(spark, few, "").collect()) == [1, 4]
