"""What ``simhash`` needs for a similarity of 0.8: MinHash bands propose further pairs, exact shingle sets decide.

Copies from a similarity of 0.8 on differ in up to 17 of 64 SimHash bits, too many for blocks of bits alone. So each
distinct shingle set is also filed under the hashes of ``BANDS`` bands of ``ROWS`` minima. Only sets that share a key,
or whose fingerprints are close, are fetched and compared, exactly; each group of comparisons passes on a spanning
forest of its links.

A pair at similarity ``s`` shares no key with probability ``(1 - s**ROWS) ** BANDS``: 7e-5 at 0.8, 1e-6 at 0.85.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, broadcast_if_small, materialize, slices, without_copies
from .graph import connected_components
from .substring_dedup import hashes_of, window_hashes

SIZE, MIN_SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
#: Rows of one key that are compared in one group; more are dealt to pairs of chunks.
CHUNK = 1024
#: Shingles whose minima are taken at a time.
BLOCK = 1024

_U = np.uint64
_XOR, _MUL = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
_MUL |= _U(1)


def shingles(texts: pa.Array, size: int = SIZE) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``size``-word shingles of each text; A-Z are lower-cased.

    With fewer words the whole sequence is the only shingle; without words, or for null, there is none.
    """
    return [np.unique(window_hashes(h, min(size, len(h)))) if len(h) else np.empty(0, np.uint64) for h in hashes_of(texts, lower=True)]


def band_keys(found: np.ndarray) -> np.ndarray:
    """The keys of a set that is not empty."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), BLOCK):
        least = np.minimum(least, ((found[at : at + BLOCK][None] ^ _XOR) * _MUL).min(1))
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def class_of(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes())).view(np.int64))


def _classes(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, cls)`` per document, and ``(cls, rep, keys)``: the distinct shingle sets with their least id."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingles(batch.column(1), size)
        keys = [band_keys(s).view(np.int64) if len(s) else [] for s in sets]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([class_of(s) for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "cls", "keys"])

    prints = materialize(arrow_pass(docs.where("doc_id is not null"), step, "doc_id long, cls long, keys array<long>"), "shingles")
    return prints.select("doc_id", "cls"), materialize(prints.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys")), "shingle-classes")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``(cls, grams)``: the shingle set of each wanted class, from its representative's text."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingles(batch.column(1), size)
        fits = [k for k, (s, c) in enumerate(zip(sets, batch.column(0).to_pylist(), strict=True)) if class_of(s) == c]  # a repeated id has other texts
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(fits, pa.int64())), pa.array([sets[k].tobytes() for k in fits], pa.binary())], ["cls", "grams"])

    texts = docs.join(wanted, docs["doc_id"] == wanted["rep"]).select("cls", "text")
    return arrow_pass(texts, step, "cls long, grams binary").dropDuplicates(["cls"])


def _link(reps: np.ndarray, sets: list[np.ndarray], least: float) -> tuple[list[int], list[int]]:
    """Spanning forest of the links among the sets of one group; pairs that are joined already are not compared."""
    n = np.array([len(s) for s in sets])
    root, us, vs = np.arange(len(sets)), [], []
    for a in range(len(sets) - 1):
        rest = np.arange(a + 1, len(sets))
        rest = rest[(root[rest] != root[a]) & (np.minimum(n[rest], n[a]) >= least * np.maximum(n[rest], n[a]))]
        if not len(rest):
            continue
        flat = np.concatenate([sets[k] for k in rest])
        place = np.minimum(np.searchsorted(sets[a], flat), n[a] - 1)
        common = np.add.reduceat((sets[a][place] == flat).astype(np.int64), np.concatenate(([0], np.cumsum(n[rest])[:-1])))
        for b in rest[common >= least * (n[a] + n[rest] - common)].tolist():
            if root[b] != root[a]:
                root[root == root[b]] = root[a]
                us.append(reps[a])
                vs.append(reps[b])
    return us, vs


def links(docs: DataFrame, classes: DataFrame, size: int = SIZE, least: float = MIN_SIMILARITY, proposed: DataFrame | None = None) -> DataFrame:
    """Edges ``(u, v)`` between representatives that connect what similarity ``least`` or more connects.

    Pairs ``proposed`` (``u, v``, of ``cls``) are compared besides those that share a key. Of keys that just the same sets share (told by their number and two sums of hashes) one is taken. A key
    with over ``CHUNK`` sets is dealt to chunks by hash, and every pair of chunks becomes a group.
    """
    filed = classes.select("cls", "rep", F.explode("keys").alias("key"))
    sums = [F.sum(F.xxhash64(F.lit(k), "cls").cast("decimal(20,0)")).alias(f"s{k}") for k in range(2)]
    shared = filed.groupBy("key").agg(F.count("*").alias("n"), *sums).where("n > 1")
    shared = shared.groupBy("n", "s0", "s1").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    met = filed.join(shared, "key")
    if proposed is not None:
        pair = proposed.select(F.explode(F.array("u", "v")).alias("cls"), F.xxhash64(F.lit("close"), "u", "v").alias("key"), F.lit(1).alias("chunks"))
        met = met.unionByName(pair.join(classes.select("cls", "rep"), "cls"))
    met = materialize(met, "shingle-keys")
    wanted = broadcast_if_small(met.select("cls", "rep").distinct(), "shingle-classes-met")
    sets = materialize(_sets(docs, wanted, size), "shingle-sets")
    own = F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    dealt = met.select("cls", "rep", "key", F.explode(pairs).alias("p")).select("cls", "rep", F.xxhash64("key", "p.i", "p.j").alias("group"))
    dealt = dealt.join(sets, "cls").select("group", "rep", "grams").repartition("group").sortWithinPartitions("group")

    def run(batches):
        group, reps, sets = None, [], []
        for batch in slices(batches, 1024):
            us, vs = [], []
            for g, rep, grams in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != group:
                    u, v = _link(np.array(reps, np.int64), sets, least)
                    us, vs = us + u, vs + v
                    group, reps, sets = g, [], []
                reps.append(rep)
                sets.append(np.frombuffer(grams, np.uint64))
            yield out(us, vs)
        yield out(*_link(np.array(reps, np.int64), sets, least))

    def out(us, vs):
        return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return dealt.mapInArrow(run, "u long, v long")


def keep_one(docs: DataFrame, size: int = SIZE, least: float = MIN_SIMILARITY, propose: Callable[[DataFrame, DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """The rows of ``docs`` (``doc_id, text``, ...) without all but the least id of each group of near copies.

    ``propose`` gives pairs of classes to compare besides those of the bands, from texts, classes with words and ``size``. Texts without words are copies of each other. Rows with a null id stay and link nothing. Of rows that
    repeat the kept id, all stay. An empty table gives an empty result.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be in (0, 1]")
    pair = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints, classes = _classes(pair, size)
    close = None if propose is None else propose(pair, classes.where(F.size("keys") > 0), size)
    found = connected_components(links(pair, classes, size, least, close)).withColumnRenamed("node", "rep")
    of = classes.select("cls", "rep").join(found, "rep", "left").select("cls", F.coalesce("component", "rep").alias("component_id"))
    return without_copies(docs, prints.join(of, "cls").select("doc_id", "component_id"))
