"""Whitening of embeddings by a tall-skinny QR; no covariance matrix is formed.

Entries become whole numbers, ``floor(256 * c)``, so sums over any number of rows are exact. The fit list holds each
distinct whole-number vector once. Its rows are centred by the exact sums, each partition is reduced to an R
factor block by block, R factors are merged eight at a time, and the singular value decomposition of the last one gives the
components (its right vectors) and the eigenvalues of the covariance (squares over n). What meets in one place is
bounded by the dimension: ``d`` sums, and eight R factors of ``d * d`` numbers.

Defined results: rows whose vector is null or holds null, NaN or infinite entries are dropped, and so are vectors of
another length than most have (of lengths equally frequent, the longest holds), as they lie in no common space. Repeated rows
and ids, null ids too, each have their result. A component without variance has no whitened value (null). A sum of squares
beyond 64 bits is null. An empty table gives an empty result. Other columns pass through whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import columns_of, materialize, slices, small_batches, unused

SCALE = 256.0
#: R factors that are merged in one step.
FAN_IN = 8
#: Rows of a block; a task holds this many vectors as doubles.
BLOCK_ROWS = 2048
_SAFE = 2**62


@dataclass(frozen=True)
class Whitening:
    """What was learnt: ``n`` vectors with ``sums``, and components (rows) with their eigenvalues, largest first."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray

    @property
    def dim(self) -> int:
        return len(self.sums)

    @property
    def explained(self) -> np.ndarray:
        """Each component's share of the whole variance; NaN if there is none."""
        total = self.eigenvalues.sum()
        return self.eigenvalues / total if total > 0 else np.full(len(self.eigenvalues), np.nan)


def whole(vector: Column) -> Column:
    """The entries as whole numbers."""
    return F.transform(vector, lambda c: F.floor(F.lit(SCALE) * c.cast("double")))


def _usable(vector: Column) -> Column:
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """``n * x - sums``, exact: in 64 bits where they surely suffice, else in Python's numbers."""
    if not len(x) or n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums)) < _SAFE:
        return n * x - np.array([s if len(x) else 0 for s in sums], dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def _squares(c: np.ndarray) -> list[int | None]:
    """Sum of squares of each row; None beyond 64 bits."""
    if c.dtype != object:
        most = max(abs(int(c.min())), abs(int(c.max()))) if c.size else 0
        if most * most * c.shape[1] < _SAFE:
            return (c * c).sum(axis=1).tolist()
        c = c.astype(object)
    return [int(s) if s < 2**63 else None for s in (c * c).sum(axis=1)]


def _length(usable: DataFrame) -> int:
    found = usable.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return 0 if found is None else found.d


def _exact_sums(fit: DataFrame, dim: int) -> tuple[int, tuple[int, ...]]:
    """Number of rows and the sum of each entry. Tasks add halves of 32 bits, which cannot overflow, and Spark adds decimals."""

    def run(batches):
        n, high, low = 0, np.zeros(dim, dtype=np.int64), np.zeros(dim, dtype=np.int64)
        for part in slices(batches, BLOCK_ROWS):
            x = _matrix(part.column(0), dim)
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"pos": pa.array(range(dim), pa.int32()), "n": pa.array([n] * dim, pa.int64()), "high": pa.array(high), "low": pa.array(low)})

    total = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")]
    rows = fit.mapInArrow(run, "pos int, n long, high long, low long").groupBy("pos").agg(*total).collect()
    sums = {r.pos: int(r.high) * 2**32 + int(r.low) for r in rows}
    return (int(rows[0].n) if rows else 0), tuple(sums.get(k, 0) for k in range(dim))


def _merged(factors: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.vstack(factors), mode="r")


def _r_factor(fit: DataFrame, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """R of the centred rows over all partitions."""
    dim = len(sums)

    def each(batches):
        r = np.zeros((0, dim))
        for part in slices(batches, BLOCK_ROWS):
            r = _merged([r, _deviations(_matrix(part.column(0), dim), n, sums).astype(np.float64) / n])
        if len(r):
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "r": pa.array([r.tobytes()], pa.binary())})

    def merge(group: pa.Table) -> pa.Table:
        parts = group.column("part").to_pylist()
        held = [np.frombuffer(b).reshape(-1, dim) for _, b in sorted(zip(parts, group.column("r").to_pylist(), strict=True))]
        return pa.table({"part": pa.array([parts[0] // FAN_IN], pa.int32()), "r": pa.array([_merged(held).tobytes()], pa.binary())})

    factors = materialize(fit.mapInArrow(each, "part int, r binary"), "r-factors")
    most = factors.agg(F.max("part")).first()[0]
    while most > 0:
        factors, most = factors.groupBy(F.floor(F.col("part") / FAN_IN)).applyInArrow(merge, "part int, r binary"), most // FAN_IN
    return np.frombuffer(factors.first().r).reshape(-1, dim)


def _oriented(components: np.ndarray) -> np.ndarray:
    """Each component with its largest entry positive."""
    largest = np.abs(components).argmax(axis=1)
    return components * np.where(components[np.arange(len(components)), largest] < 0, -1.0, 1.0)[:, None]


def fit_list(vectors: DataFrame, vec_col: str = "embedding") -> tuple[DataFrame, int]:
    """Each distinct whole-number vector of the common length once (``x``), written to the shared folder, and that length."""
    usable = vectors.where(_usable(vectors[vec_col])).select(whole(vectors[vec_col]).alias("x"))
    dim = _length(usable)
    return materialize(usable.where(F.size("x") == dim).distinct(), "fit-list"), dim


def fit(listed: DataFrame, dim: int) -> Whitening | None:
    """Learn from a fit list; None if it is empty or has no entries."""
    n, sums = _exact_sums(listed, dim) if dim else (0, ())
    if not n:
        return None
    r = _r_factor(listed, n, sums)
    _, s, right = np.linalg.svd(r, full_matrices=True)
    s = np.concatenate([s, np.zeros(dim - len(s))])
    s[s <= s[0] * 64 * dim * np.finfo(float).eps] = 0.0
    return Whitening(n, sums, _oriented(right), s * s / n)


def _whiten(x: np.ndarray, model: Whitening, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact deviations and, per row, the first components' whitened values; NaN without variance."""
    c = _deviations(x, model.n, model.sums)
    e = model.eigenvalues[:most]
    scale = np.divide(1.0, np.sqrt(e), out=np.full(len(e), np.nan), where=e > 0)
    return c, (c.astype(np.float64) / model.n) @ model.components[:most].T * scale


def identity_error(listed: DataFrame, model: Whitening, most: int) -> float:
    """Largest absolute entry of the whitened fit list's covariance less the identity, over components with variance.

    The rows were centred by exact sums, so their whitened values have the mean zero.
    """
    k = min(most, int((model.eigenvalues > 0).sum()))
    if not k:
        return 0.0

    def run(batches):
        total = np.zeros((k, k))
        for part in slices(batches, BLOCK_ROWS):
            w = _whiten(_matrix(part.column(0), model.dim), model, k)[1]
            total += w.T @ w
        at = np.arange(k * k, dtype=np.int32)
        yield pa.RecordBatch.from_pydict({"at": at, "s": total.ravel()})

    rows = listed.mapInArrow(run, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()
    found = np.zeros(k * k)
    for r in rows:
        found[r.at] = r.s / model.n
    return float(np.abs(found.reshape(k, k) - np.eye(k)).max())


def whiten(vectors: DataFrame, model: Whitening, most: int | None = None, vec_col: str = "embedding") -> DataFrame:
    """The usable rows of ``vectors`` with ``whitened`` (array of the first ``most`` components) and ``deviation``.

    ``deviation`` is the exact sum of ``(n * x - S)^2``. Names that ``vectors`` has already get an underscore in front.
    Only the vector goes to Python.
    """
    most = model.dim if most is None else min(most, model.dim)

    @arrow_udf("struct<deviation: bigint, whitened: array<double>>")
    def run(column: pa.Array) -> pa.Array:
        deviations, values = [], []
        for at in range(0, len(column), BLOCK_ROWS):
            c, w = _whiten(_matrix(column.slice(at, BLOCK_ROWS), model.dim), model, most)
            deviations += _squares(c)
            values.append(w.ravel())
        flat = np.concatenate(values) if values else np.zeros(0)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(column) * most + 1, most), pa.int32()), pa.array(flat, mask=np.isnan(flat)))
        return pa.StructArray.from_arrays([pa.array(deviations, pa.int64()), lists], ["deviation", "whitened"])

    small_batches(vectors.sparkSession)
    made, x = unused(vectors, "found"), whole(vectors[vec_col])
    rows = vectors.where(_usable(vectors[vec_col]) & (F.size(vectors[vec_col]) == model.dim)).withColumn(made, run.asNondeterministic()(x))
    return rows.select(*columns_of(rows, made), *(F.col(f"{made}.{c}").alias(unused(vectors, c)) for c in ("whitened", "deviation")))
