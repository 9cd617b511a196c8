"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader.

Features are the distinct word 1- and 2-grams of a text, hashed to ``2**BITS`` weights; a token is a run of
letters and digits or a run of other signs, so shouting and stray symbols are features of their own. A
feature's value is one over the root of the number of features. A 4-gram of one repeated token is filed
under a slot of its own, whatever the token. Training is one pass per epoch over a
bounded sample of labelled rows in a fixed hash order; scoring is a sparse dot product per text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, columns_of, hash_order, held, materialize, slices, text_column

BITS = 20
#: Most labelled rows that are learnt from, and passes over them.
MAX_ROWS, EPOCHS = 8000, 4
#: Bytes of tokens whose codes a worker remembers.
MEMO_BYTES = 80 << 20
ALPHA, BETA, L1, L2 = 4.0, 1.0, 0.002, 0.001

#: Code of any 4-gram of one token.
STUCK = xxhash.xxh64_intdigest(b"\x00stuck")

TOKEN = re.compile(r"[^\W_]+|(?:[^\w\s]|_)+")


def _code(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"))


def features(text: str | None) -> np.ndarray:
    """Sorted distinct slots of the word 1- and 2-grams of ``text``."""
    tokens = TOKEN.findall(text or "")
    codes = held("token codes", lambda: Memo(_code, MEMO_BYTES))
    one = np.fromiter(map(codes.__getitem__, tokens), np.uint64, len(tokens))
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    same = one[1:] == one[:-1]
    stuck = np.full(int((same[2:] & same[1:-1] & same[:-2]).any()), STUCK, np.uint64)
    return np.unique((np.concatenate((one, two, stuck)) >> np.uint64(64 - BITS)).astype(np.int32))


class FtrlProximal:
    """Per-coordinate FTRL-proximal logistic regression on binary sparse rows; the last weight is the bias."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def _weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, slots: np.ndarray, label: int) -> None:
        at = np.append(slots, len(self.z) - 1)
        x = np.full(len(at), 1 / np.sqrt(max(1, len(slots))))
        x[-1] = 1.0
        w = self._weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g

    def weights(self) -> np.ndarray:
        return self._weights(np.arange(len(self.z)))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> np.ndarray:
    """Weights learnt from ``docs`` (``doc_id, text``) where ``labels`` (``doc_id, quality``) has one verdict.

    At most ``max_rows`` ids are drawn, in a fixed hash order; ids that are null or labelled both ways are
    left out. Ids and verdicts may be of any whole-number type. Without any label all weights are 0 and every
    score is 0.5.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    said = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("q2")).where("q = q2")
    drawn = said.join(docs.select("doc_id").where("doc_id is not null").distinct(), "doc_id").orderBy(hash_order(F.col("doc_id")), "doc_id").limit(max_rows).select("doc_id", "q")
    rows = docs.select("doc_id", "text").join(F.broadcast(materialize(drawn, "drawn")), "doc_id").select("doc_id", "q", F.col("text").cast("string").alias("text"))

    def run(batches):
        for part in slices(batches):
            found = [features(t) for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([f.tobytes() for f in found], pa.binary())], ["doc_id", "q", "slots"])

    table = materialize(rows.mapInArrow(run, "doc_id long, q int, slots binary"), "features")
    ordered = table.repartitionByRange(8, hash_order(F.col("doc_id"))).sortWithinPartitions(hash_order(F.col("doc_id")), "doc_id", "slots")
    model = FtrlProximal(1 << BITS)
    for _ in range(EPOCHS):
        for row in ordered.toLocalIterator():
            model.learn(np.frombuffer(row.slots, np.int32), row.q)
    return model.weights()


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``docs`` with ``score`` in 0 to 1, higher where label 1 is likelier; null and empty texts get the bias alone.

    A column of that name is replaced; repeated rows and null ids are rows like others. An empty table gives an
    empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def step(texts: pa.Array) -> pa.Array:
        w = shared.value
        found = [features(t) for t in texts.to_pylist()]
        size = np.array([len(f) for f in found], np.int64)
        ends = np.cumsum(size)
        sums = np.concatenate(([0.0], np.cumsum(w[np.concatenate(found or [np.empty(0, np.int32)])], dtype=np.float64)))
        margin = (sums[ends] - sums[ends - size]) / np.sqrt(np.maximum(size, 1)) + float(w[-1])
        return pa.array(1 / (1 + np.exp(-np.clip(margin, -35, 35))))

    return docs.select(*columns_of(docs, "score"), text_column(step, "double")(F.col("text")).alias("score"))
