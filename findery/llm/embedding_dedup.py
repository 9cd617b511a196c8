"""Near-duplicate vectors by product quantisation.

Unit vectors go to the nearest of a few coarse lists; what is left after the list's centroid is coded per
subspace. A query visits every list whose border with its own list it could reach by ``reach`` standard
deviations of a shift of the linking distance across that border, sums table look-ups per coded vector,
and keeps those whose coded distance is within the linking distance plus the vector's own coding error,
which loses no true link inside a visited list. How shifts spread over directions is measured on the sample
(residuals, and links in it) and never taken to be less than even; a link crosses no border farther than the
linking distance, so that is the widest probe, and vectors of few effective dimensions get it. Exact cosines in double precision then decide.

A pair of lists is searched once, by the queries of the lower one, for the links of both sides.

There are about half as many lists as the root of the number of vectors; a bounded sample fits them and the
codebooks, and every vector is indexed. Tasks hold one chunk of a list at a time, count links per query and
pass on a spanning forest, so no pairs are ever written.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_order, materialize, slices
from .graph import connected_components

#: Vectors that centroids and codebooks are fitted on, or this many for each list; most lists; subspaces and codes in each.
SAMPLE, LIST_SAMPLE, MAX_LISTS, SUBSPACES, CODES = 16_000, 16, 8192, 8, 64
#: Sampled vectors that codebooks and the spread of links are taken from at most.
SPREAD_SAMPLE = 16_000
#: Fewest sampled links that their spread is taken from; fewest vectors, with fewer the probes are the widest.
LEAST_LINKS, LEAST_VECTORS = 50, 1000
#: Reach of the probes, in standard deviations, unless a caller asks for another.
REACH = 3.0
#: Coded vectors in one group, queries that meet them in one group, and queries compared at a time.
CHUNK, QUERY_CHUNK, BLOCK = 4096, 65_536, 256


def number_of_lists(vectors: int) -> int:
    return int(min(MAX_LISTS, max(4, math.sqrt(vectors) / 2)))


def kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Lloyd's centroids from evenly spaced first rows; an empty cluster keeps its centroid."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        of = np.concatenate([nearest(x[at : at + 4096], c)[0] for at in range(0, len(x), 4096)])
        sums, sizes = np.zeros_like(c), np.bincount(of, minlength=len(c))
        np.add.at(sums, of, x)
        c[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centroid and squared distances to all, less the rows' own squares."""
    d = (c * c).sum(1) - 2 * (x @ c.T)
    return d.argmin(1), d


@dataclass
class Index:
    """Centroids and codebooks for vectors of one dimension."""

    centroids: np.ndarray
    books: list[np.ndarray]
    cuts: list[int]
    #: For each kind of shift, the mean of its outer product with itself at unit length; None: nothing is known.
    spreads: list[np.ndarray] | None
    #: Of the probes, in standard deviations; it travels with the index to the workers.
    reach: float = REACH

    @classmethod
    def fit(cls, units: np.ndarray, radius: float, lists: int | None = None, reach: float = REACH) -> Index:
        dim = units.shape[1]
        centroids = kmeans(units, lists or number_of_lists(len(units)))
        some = units[:SPREAD_SAMPLE]
        of = nearest(some, centroids)[0]
        left = some - centroids[of]
        spreads = _spreads([left, _shifts(some, of, radius)]) if len(some) >= LEAST_VECTORS else None
        cuts = np.linspace(0, dim, min(SUBSPACES, dim) + 1).astype(int).tolist()
        return cls(centroids, [kmeans(left[:, a:b], CODES) for a, b in zip(cuts, cuts[1:], strict=False)], cuts, spreads, reach)

    @classmethod
    def trivial(cls, dim: int) -> Index:
        return cls(np.zeros((1, dim)), [np.zeros((1, dim))], [0, dim], None)

    def encode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and coding error of each row."""
        of = nearest(units, self.centroids)[0]
        left = units - self.centroids[of]
        codes = np.empty((len(units), len(self.books)), np.uint8)
        for m, book in enumerate(self.books):
            part = left[:, self.cuts[m] : self.cuts[m + 1]]
            codes[:, m] = nearest(part, book)[0]
            left[:, self.cuts[m] : self.cuts[m + 1]] = part - book[codes[:, m]]
        return of, codes, np.sqrt((left * left).sum(1))

    def probes(self, units: np.ndarray, radius: float) -> list[np.ndarray]:
        """Lists to visit per row, its own among them."""
        of, d = nearest(units, self.centroids)
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        out = []
        for i, row in zip(of.tolist(), d, strict=True):
            if i not in known:
                known[i] = self._borders(i)
            apart, across = known[i]
            gap = (row - row[i]) / (2 * apart)
            gap[i] = 0
            out.append(np.flatnonzero(gap <= radius * np.minimum(1, self.reach * np.sqrt(across)) + 1e-9))
        return out

    def _borders(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """For each list its centroid's distance from that of list ``i``, and the largest mean share, over the kinds of shifts, of a shift's square along the line between them; even spread at least."""
        line = self.centroids - self.centroids[i]
        apart = np.maximum((line * line).sum(1), 1e-24)
        if self.spreads is None:
            return np.sqrt(apart), np.ones(len(line))
        share = np.full(len(line), 1 / line.shape[1])
        for spread in self.spreads:
            share = np.maximum(share, np.clip(((line @ spread) * line).sum(1) / apart, 0, 1))
        return np.sqrt(apart), share

    def distances(self, units: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries to coded vectors of list ``which``, by table look-up."""
        left = units - self.centroids[which]
        out = np.zeros((len(units), len(codes)), np.float32)
        for m, book in enumerate(self.books):
            part = left[:, self.cuts[m] : self.cuts[m + 1]]
            table = ((part * part).sum(1)[:, None] + (book * book).sum(1)[None] - 2 * part @ book.T).astype(np.float32)
            out += table[:, codes[:, m]]
        return out


def _shifts(units: np.ndarray, of: np.ndarray, radius: float) -> np.ndarray:
    """Shifts from vectors to their nearest others within ``radius``, over all lists; ``of`` orders the comparisons."""
    order = np.argsort(of, kind="stable")
    starts = order[np.linspace(0, len(order) - 1, min(len(order), 2048)).astype(int)]
    out = []
    for at in range(0, len(starts), BLOCK):
        rows = starts[at : at + BLOCK]
        cosine = units[rows] @ units.T
        cosine[np.arange(len(rows)), rows] = -1
        best = cosine.argmax(1)
        near = cosine.max(1) >= 1 - radius * radius / 2
        out.append(units[best[near]] - units[rows[near]])
    return np.concatenate(out)


def _spreads(shifts: list[np.ndarray]) -> list[np.ndarray]:
    out = []
    for x in shifts:
        length = np.sqrt((x * x).sum(1))
        x = x[length > 1e-9] / length[length > 1e-9, None]
        if len(x) >= LEAST_LINKS:
            out.append(x.T @ x / len(x))
    return out


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _bipartite(q: np.ndarray, d: np.ndarray, nq: int, nd: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (position, smallest coded position of its component): queries are counted after coded rows."""
    label = np.arange(nd)
    own = np.full(nq, nd)
    while True:
        np.minimum.at(own, q, label[d])
        new = label.copy()
        np.minimum.at(new, d, own[q])
        if (new == label).all():
            break
        label = new
    hit_q, hit_d = np.unique(q), np.unique(d)
    return np.concatenate((hit_d, hit_q + nd)), np.concatenate((label[hit_d], own[hit_q]))


def near_duplicate_vectors(rows: DataFrame, min_cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", reach: float = REACH) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row; vectors link within a label from ``min_cosine`` on.

    Nothing links with a null label, nor with a vector that is null, empty, zero or holds a null or
    non-finite component, nor do vectors of unequal dimension, nor rows with a null id (component null,
    not kept). Equal vectors of a label (told by 128 bits of two hashes) are one class with its number of rows,
    so copies cost nothing. Rows that repeat an id are vectors of their own that share a component, the least
    one that any of them has. Arrays of floats are compared as they are, all others as doubles. An empty table
    gives an empty result; other columns are ignored, whatever their names. ``reach`` is that of the probes in
    standard deviations; ``math.inf`` visits every list that a link could lead to, which loses none.
    """
    if not 0 < min_cosine <= 1:
        raise ValueError("min_cosine must be in (0, 1]")
    if not reach > 0:
        raise ValueError("reach must be above 0")
    radius = math.sqrt(2 - 2 * min_cosine)
    v = F.col("v")
    exact = "float" if dict(rows.dtypes)[vector_col] == "array<float>" else "double"
    src = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast(f"array<{exact}>").alias("v"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    sound = F.coalesce(sound, F.lit(False))
    src = src.select("*", *(F.when(sound, F.xxhash64(F.lit(k), "label", "v")).alias(f"h{k}") for k in range(2)))
    grouped = src.where("h0 is not null").groupBy("h0", "h1").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = materialize(grouped.select("*", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("cid")), "vectors")
    indexes = _fit(classes, radius, exact, reach)
    found = materialize(_search(classes, indexes, radius, min_cosine, exact), "links")
    links = found.where("cid is not null").groupBy("cid").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("u is not null").select("u", "v")).withColumnRenamed("node", "rep")
    of = classes.select("h0", "h1", "cid", "rep", "n").join(links, "cid", "left").join(parts, "rep", "left")
    of = of.select("h0", "h1", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = src.where("h0 is not null").select("vec_id", "h0", "h1").join(of, ["h0", "h1"]).select("vec_id", "n_links", "component_id")
    alone = src.where("h0 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _fit(classes: DataFrame, radius: float, kind: str, reach: float) -> dict[int, Index]:
    """An index per dimension; vectors of a dimension that the sample does not hold share one list."""
    n = classes.count()
    lists = number_of_lists(n)
    sample = max(SAMPLE, LIST_SAMPLE * lists)
    order = hash_order(F.col("h0"), F.col("h1"))
    drawn = classes.where(F.pmod(order, F.lit(1 << 30)) < (1 << 30) * min(1.0, 1.2 * sample / max(n, 1))).orderBy(order, "rep").limit(sample).select("dim", "v")

    def pack(batches):
        for part in slices(batches, 1024):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([np.array(v, kind).tobytes() for v in part.column(1).to_pylist()], pa.binary())], ["dim", "raw"])

    by: dict[int, list[bytes]] = {}
    for r in drawn.mapInArrow(pack, "dim int, raw binary").collect():
        by.setdefault(r.dim, []).append(r.raw)
    share = {dim: max(4, lists * len(vs) // max(1, sum(map(len, by.values())))) for dim, vs in by.items()}
    return {dim: Index.fit(_unit(np.frombuffer(b"".join(vs), kind).reshape(-1, dim)), radius, share[dim], reach) for dim, vs in by.items()}


def _search(classes: DataFrame, indexes: dict[int, Index], radius: float, min_cosine: float, kind: str) -> DataFrame:
    shared = classes.sparkSession.sparkContext.broadcast(indexes)

    def index(dim: int) -> Index:
        return shared.value.get(dim) or Index.trivial(dim)

    def file(batches):
        for part in slices(batches, 1024):
            cid, rep, n, label, vectors, dims = (part.column(k) for k in range(6))
            dims = dims.to_numpy()
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate(([0], np.cumsum(dims)))
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                raw = flat[starts[at][:, None] + np.arange(dim)].astype(kind)
                units, idx = _unit(raw), index(dim)
                of, codes, error = idx.encode(units)
                probes = [p[p >= k] for p, k in zip(idx.probes(units, radius), of.tolist(), strict=True)]
                who = np.concatenate((np.arange(len(at)), np.repeat(np.arange(len(at)), [len(p) for p in probes])))
                lists = np.concatenate((of, *probes))
                role = np.arange(len(who)) >= len(at)
                home = lists == of[who]
                blob = [r.tobytes() for r in raw]
                code = [c.tobytes() for c in codes]
                take = pa.array(at[who])
                cols = [cid.take(take), rep.take(take), n.take(take), label.take(take), pa.array(np.full(len(who), dim, np.int32)), pa.array(lists.astype(np.int32)), pa.array(role), pa.array([blob[k] for k in who], pa.binary()), pa.array([b"" if q else code[k] for k, q in zip(who, role, strict=True)], pa.binary()), pa.array(error[who]), pa.array(home)]
                yield pa.RecordBatch.from_arrays(cols, ["cid", "rep", "n", "label", "dim", "list", "query", "raw", "code", "error", "home"])

    label_type = classes.schema["label"].dataType.simpleString()
    src = classes.select("cid", "rep", "n", "label", "v", "dim")
    filed = materialize(src.mapInArrow(file, f"cid long, rep long, n long, label {label_type}, dim int, list int, query boolean, raw binary, code binary, error double, home boolean"), "lists")
    cell = ["label", "dim", "list"]
    sizes = filed.groupBy(*cell).agg(F.ceil(F.count_if(~F.col("query")) / CHUNK).alias("db"), F.ceil(F.count_if("query") / QUERY_CHUNK).alias("qs")).where("db > 0 and qs > 0")
    own = F.when(F.col("query"), F.pmod("cid", "qs")).otherwise(F.pmod("cid", "db"))
    against = F.explode(F.sequence(F.lit(0), F.when(F.col("query"), F.col("db")).otherwise(F.col("qs")) - 1))
    dealt = filed.join(sizes, cell).withColumn("own", own).withColumn("other", against)
    a, b = F.when(F.col("query"), F.col("other")).otherwise(F.col("own")), F.when(F.col("query"), F.col("own")).otherwise(F.col("other"))
    dealt = dealt.select(F.xxhash64(*cell, a, b).alias("group"), "query", "cid", "rep", "n", "dim", "list", "raw", "code", "error", "home").repartition("group").sortWithinPartitions("group", "query")

    def search(batches):
        group, held = None, []
        for batch in slices(batches, 8192):
            g = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.append(True, (g[1:] != g[:-1]))).tolist() + [len(g)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if g[lo] != group:
                    group, held = g[lo], []
                part = batch.slice(lo, hi - lo)
                db = int((~part.column(1).to_numpy(zero_copy_only=False)).sum())  # coded rows come first
                if db:
                    held.append(_rows(part.slice(0, db), kind))
                if db < hi - lo and held:
                    if len(held) > 1:
                        held = [{k: np.concatenate([h[k] for h in held]) if isinstance(held[0][k], np.ndarray) else held[0][k] for k in held[0]}]
                    queries = _rows(part.slice(db), kind)
                    for at in range(0, len(queries["cid"]), BLOCK):
                        if (out := _compare(index(queries["dim"]), {k: x[at : at + BLOCK] if isinstance(x, np.ndarray) else x for k, x in queries.items()}, held[0], radius, min_cosine)) is not None:
                            yield out

    return dealt.mapInArrow(search, "cid long, links long, u long, v long")


def _rows(part: pa.RecordBatch, kind: str) -> dict:
    dim = part.column(5)[0].as_py()
    n = part.num_rows
    raw = np.frombuffer(b"".join(part.column(7).to_pylist()), kind).reshape(n, dim)
    code = b"".join(part.column(8).to_pylist())
    return {"cid": part.column(2).to_numpy(), "rep": part.column(3).to_numpy(), "n": part.column(4).to_numpy(), "units": _unit(raw), "code": np.frombuffer(code, np.uint8).reshape(n, -1), "error": part.column(9).to_numpy(), "home": part.column(10).to_numpy(zero_copy_only=False), "dim": dim, "list": part.column(6)[0].as_py()}


def _compare(index: Index, q: dict, db: dict, radius: float, min_cosine: float) -> pa.RecordBatch | None:
    near = index.distances(q["units"], q["list"], db["code"])
    i, j = np.nonzero(near <= (radius + db["error"] + 1e-3)[None] ** 2)
    i, j = (x[q["cid"][i] != db["cid"][j]] for x in (i, j))
    cosine = np.concatenate([np.einsum("ij,ij->i", q["units"][i[at : at + 65536]], db["units"][j[at : at + 65536]]) for at in range(0, len(i), 65536)] or [np.empty(0)])
    linked = cosine >= min_cosine
    i, j = i[linked], j[linked]
    if not len(i):
        return None
    away = ~q["home"][i]  # within a list every vector is a query itself
    links = np.concatenate((np.bincount(i, weights=db["n"][j], minlength=len(q["cid"])), np.bincount(j[away], weights=q["n"][i[away]], minlength=len(db["cid"])))).astype(np.int64)
    cids, hit = np.concatenate((q["cid"], db["cid"])), np.flatnonzero(links)
    u, v = _bipartite(i, j, len(q["cid"]), len(db["cid"]))
    reps = np.concatenate((db["rep"], q["rep"]))
    u, v = reps[u], reps[v]
    u, v = u[u != v], v[u != v]
    none = np.zeros(len(hit) + len(u), bool)
    first = none.copy()
    first[: len(hit)] = True
    cols = [np.concatenate((a, np.zeros(len(u), np.int64))) for a in (cids[hit], links[hit])] + [np.concatenate((np.zeros(len(hit), np.int64), b)) for b in (u, v)]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], mask=~first), pa.array(cols[1], mask=~first), pa.array(cols[2], mask=first), pa.array(cols[3], mask=first)], ["cid", "links", "u", "v"])
