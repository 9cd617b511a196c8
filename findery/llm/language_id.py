"""Language identification with string kernels.

The kernel of two texts is the number of character n-grams of length 1 to 4 that both hold (presence,
not counts), divided by the root of the product of their own numbers. Nystroem landmarks turn it into a
finite feature space, in which one-versus-rest ridge regressions are solved. Since the kernel is linear in
the presence vector, landmarks and regressions fold into one matrix, and a batch of texts is scored by one
matrix product. N-grams are hashed to ``2**SLOT_BITS`` slots.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, hash_order, slices, text_column, unused

SLOT_BITS, MAX_GRAM = 18, 4
#: Rows that are learnt from and landmarks among them; each language has ``LANG_ROWS`` rows (or all it has) and a landmark at least.
MAX_ROWS, LANDMARKS, LANG_ROWS = 1600, 96, 5
RIDGE, SHARPNESS = 1e-2, 6.0
BLOCK = 1 << 18
#: Texts that are scored in one matrix product.
SCORED_ROWS = 48

_U = np.uint64


def presence(text: str, seen: np.ndarray) -> np.ndarray:
    """Slots of the n-grams in ``text``; ``seen`` is an all-false scratch array and is left so."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, len(points), BLOCK):
        p = points[at : at + BLOCK + MAX_GRAM - 1].astype(np.uint64)
        code = np.zeros(len(p), np.uint64)
        for n in range(1, min(MAX_GRAM, len(p)) + 1):
            code = code[: len(p) - n + 1] * _U(0x100000001B3) + p[n - 1 :]
            mixed = (code ^ _U(n << 56)) * _U(0x9E3779B97F4A7C15)
            seen[(mixed >> _U(64 - SLOT_BITS)).astype(np.intp)] = True
    slots = np.flatnonzero(seen)
    seen[slots] = False
    return slots


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    langs: list[str]
    slot_of: np.ndarray
    weights: np.ndarray

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language per text (-1: none) and its softmax score."""
        best, score = np.full(len(texts), -1), np.zeros(len(texts))
        rows = [k for k, t in enumerate(texts) if t and has_letter(t)]
        if not rows or not self.langs:
            return best, score
        seen = np.zeros(1 << SLOT_BITS, bool)
        x = np.zeros((len(rows), len(self.weights)), np.float32)
        for k, row in enumerate(rows):
            slots = presence(texts[row], seen)
            own = self.slot_of[slots]
            x[k, own[own >= 0]] = 1 / np.sqrt(len(slots))
        f = SHARPNESS * (x @ self.weights).astype(np.float64)
        f = np.exp(f - f.max(1, keepdims=True))
        best[rows] = f.argmax(1)
        score[rows] = f.max(1) / f.sum(1)
        return best, score


def train(docs: DataFrame, max_rows: int = MAX_ROWS, landmarks: int = LANDMARKS) -> Model:
    """Learn from the rows of ``docs`` (``doc_id, text, lang``) whose text and lang are not null.

    Rows come in a fixed hash order, equally many per language, ``max_rows`` in all or ``LANG_ROWS`` for each
    language; each reaches the driver as a bitmap of fixed size. Every language is learnt, so rows, landmarks
    and the model grow with their number. Without any, every text is ``und``.
    """
    usable = docs.where("text is not null and lang is not null")
    counts = usable.groupBy("lang").count().collect()
    if not counts:
        return Model([], np.full(1 << SLOT_BITS, -1), np.zeros((0, 0), np.float32))
    langs = sorted(r.lang for r in counts)
    each = max(LANG_ROWS, max_rows // len(langs))
    share = F.create_map(*(x for r in counts for x in (F.lit(r.lang), F.lit(min(1.0, (2 * each + 50) / r["count"])))))
    order = hash_order(F.col("doc_id"))
    drawn = usable.where((F.pmod(order, F.lit(1 << 30)) / float(1 << 30)) < share[F.col("lang")])
    ranked = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id", "text"))).where(F.col("rank") <= each)

    def bitmaps(batches):
        seen = np.zeros(1 << SLOT_BITS, bool)
        for part in slices(batches, 64):
            bits = []
            for t in part.column(2).to_pylist():
                mark = np.zeros(1 << SLOT_BITS, bool)
                mark[presence(t, seen)] = True
                bits.append(np.packbits(mark).tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(bits, pa.binary())], ["lang", "rank", "bits"])

    rows = sorted(ranked.select("lang", "rank", "text").mapInArrow(bitmaps, "lang string, rank int, bits binary").collect(), key=lambda r: (r["rank"], r.lang))
    return fit(langs, [r.lang for r in rows], [r.bits for r in rows], max(landmarks, len(langs)))


def fit(langs: list[str], of: list[str], bits: list[bytes], landmarks: int) -> Model:
    """Solve for the weights; the first ``landmarks`` rows are the landmarks. Bitmaps are unpacked a few at a time."""

    def marks(at: int, to: int) -> np.ndarray:
        return np.unpackbits(np.frombuffer(b"".join(bits[at:to]), np.uint8).reshape(-1, (1 << SLOT_BITS) // 8), axis=1)

    root = np.sqrt([max(1, int.from_bytes(b).bit_count()) for b in bits])
    first = marks(0, landmarks)
    used = np.flatnonzero(first.any(0))
    slot_of = np.full(1 << SLOT_BITS, -1, np.int32)
    slot_of[used] = np.arange(len(used))
    base = first[:, used] * (1 / root[: len(first), None]).astype(np.float32)
    k_nm = np.concatenate([(marks(a, a + 64)[:, used].astype(np.float32) / root[a : a + 64, None]) @ base.T for a in range(0, len(bits), 64)]).astype(np.float64)
    value, vector = np.linalg.eigh(k_nm[: len(first)])
    good = value > 1e-6 * value.max()
    to_features = vector[:, good] / np.sqrt(value[good])
    phi = k_nm @ to_features
    target = np.where(np.array(of)[:, None] == np.array(langs)[None, :], 1.0, -1.0)
    solved = np.linalg.solve(phi.T @ phi + RIDGE * np.eye(phi.shape[1]), phi.T @ target)
    return Model(langs, slot_of, (base.T @ (to_features @ solved).astype(np.float32)).astype(np.float32))


def keep_letters(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``text`` has a letter."""
    mark = unused(docs, "_letters")
    lettered = text_column(lambda texts: pa.array([bool(t) and has_letter(t) for t in texts.to_pylist()], pa.bool_()), "boolean")
    return docs.withColumn(mark, lettered(F.col("text"))).where(F.col(mark)).select(*columns_of(docs))


def found_in(docs: DataFrame, model: Model):
    """A struct column ``(lang_pred, score)`` of ``text``."""
    names = np.array([*model.langs, "und"], object)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def step(texts: pa.Array) -> pa.Array:
        parts = [shared.value.scores(texts.slice(at, SCORED_ROWS).to_pylist()) for at in range(0, max(1, len(texts)), SCORED_ROWS)]
        best, score = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(score)], ["lang_pred", "score"])

    return text_column(step, "struct<lang_pred: string, score: double>")(F.col("text"))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``.

    Null texts and texts without a letter are ``und`` with score 0, and so is every text if the model knows no
    language. Columns of those names are replaced; repeated rows and null ids are rows like others. An empty
    table gives an empty result.
    """
    name = unused(docs, "_found")
    own = columns_of(docs, "lang_pred", "score")
    return docs.select(*own, found_in(docs, model).alias(name)).select(*own, f"{name}.lang_pred", f"{name}.score")


def keep_identified(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of ``docs`` whose language is found with a score of ``least`` or more, with their own columns, whatever their names."""
    name = unused(docs, "_found")
    found = docs.withColumn(name, found_in(docs, model))
    return found.where((F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.score") >= least)).select(*columns_of(docs))
