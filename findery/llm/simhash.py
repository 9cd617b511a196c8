"""SimHash near-duplicates: 64-bit fingerprints, pigeonhole blocks, Hamming check, components.

Fingerprints that differ in at most 3 of 64 bits agree on at least 2 of 5 blocks. Every distinct
fingerprint is filed under its 10 pairs of blocks (about 26 bits each), rows that share a key are
compared, and each group of comparisons passes on a spanning forest of its links, never all pairs. A key that
very many share is split the same way once more: its other 38 bits differ in at most 3 as well, so close rows
agree on 2 of 5 parts of them.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingle_dedup
from .common import LOWER_ASCII, arrow_pass, materialize, slices, utf8, without_copies
from .graph import connected_components

#: Bits of the five blocks, from the lowest.
BLOCKS = (13, 13, 13, 13, 12)
#: Rows of one key that are compared in one group; more are dealt to pairs of chunks.
CHUNK = 1024
#: Chunks of one key beyond which its rows are filed again under further bits, ten keys for each row.
MOST_CHUNKS = 10
SEED = 42


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """SimHash of the ``size``-word shingles of ``text`` (repeats included), as an unsigned integer.

    A-Z are lower-cased; words are runs of anything but ASCII space characters. With fewer words
    the whole sequence is the only shingle; without words, or for null, the result is 0.
    """
    words = (text or b"").translate(LOWER_ASCII).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, n = xxhash.xxh64_intdigest, len(words) - size + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        to = min(n, at + (1 << 16))
        spans = zip(starts[at:to].tolist(), ends[at + size - 1 : to + size - 1].tolist(), strict=True)
        h = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """``(doc_id, fp)`` per row; fp is the fingerprint of the ``size``-word shingles as a signed long."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, size) for t in utf8(batch, "text")], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    pair = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_pass(pair, step, "doc_id long, fp long")


_STARTS = np.concatenate(([0], np.cumsum(BLOCKS))).tolist()
_PAIRS = list(combinations(range(5), 2))


def _block_keys(fp):
    cut = [F.shiftrightunsigned(fp, _STARTS[i]).bitwiseAND(F.lit((1 << BLOCKS[i]) - 1)) for i in range(5)]
    pairs = [F.shiftleft(F.lit(k).cast("long"), 32) + F.shiftleft(cut[i], 13) + cut[j] for k, (i, j) in enumerate(_PAIRS)]
    return F.explode(F.array(*pairs))


def _rest_masks(pair: tuple[int, int]) -> list[int]:
    """Masks, as signed longs, of the 10 pairs of fifths of the bits outside a pair of blocks."""
    bits = [b for i in range(5) if i not in pair for b in range(_STARTS[i], _STARTS[i + 1])]
    fifths = [sum(1 << b for b in bits[k::5]) for k in range(5)]
    return [int(np.uint64(fifths[i] | fifths[j]).view(np.int64)) for i, j in _PAIRS]


def _finer_keys(fp, key):
    """Hashes of the key with each pair of fifths of the other bits."""
    masks = F.element_at(F.array(*(F.array(*(F.lit(m).cast("long") for m in _rest_masks(p))) for p in _PAIRS)), (F.shiftright(key, 32) + 1).cast("int"))
    return F.explode(F.transform(masks, lambda m, k: F.xxhash64(key, k, fp.bitwiseAND(m))))


def forest(n: int, a: np.ndarray, b: np.ndarray, parent: np.ndarray) -> list[int]:
    """Join the ends of each edge in ``parent``; the positions of the edges that joined two trees."""
    kept = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(k)
    return kept


def _chunks_of(count: str):
    return F.ceil(F.col(count) / CHUNK).cast("int").alias("chunks")


def _link_sorted(key: np.ndarray, fp: np.ndarray, rep: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links between rows of equal key; rows are sorted by key."""
    n, d = len(key), 1
    parent, us, vs = np.arange(n), [], []
    active = np.flatnonzero(key[:-1] == key[1:])
    while len(active):
        near = active[np.bitwise_count(fp[active] ^ fp[active + d]) <= most]
        if d > 8 and len(near):  # most links of a dense group are known by now
            root = parent
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
            parent = root
            near = near[parent[near] != parent[near + d]]
        joined = near[forest(n, near, near + d, parent)] if len(near) else near
        us.append(rep[joined])
        vs.append(rep[joined + d])
        d += 1
        active = active[active + d < n]
        active = active[key[active] == key[active + d]]
    return np.concatenate(us or [rep[:0]]), np.concatenate(vs or [rep[:0]])


def links(classes: DataFrame, most: int = 3) -> DataFrame:
    """Edges ``(u, v)`` between class ids that connect exactly what Hamming distance ``most`` or less connects.

    ``classes`` has one row ``(fp, rep)`` per distinct fingerprint. A key with over ``CHUNK`` rows is
    dealt to chunks by hash, and every pair of chunks becomes a group of its own, so no task's memory
    grows with a hot key; with over ``MOST_CHUNKS`` chunks it is filed under finer keys first.
    """
    if most > 3:
        raise ValueError("the block pairs cover distances up to 3")
    filed = classes.where("rep is not null").select("fp", "rep", _block_keys(F.col("fp")).alias("key"))
    sizes = filed.groupBy("key").count().where(F.col("count") > CHUNK).select("key", _chunks_of("count"))
    sized = filed.join(sizes, "key", "left")
    finer = sized.where(F.col("chunks") > MOST_CHUNKS).select("fp", "rep", _finer_keys(F.col("fp"), F.col("key")).alias("key"))
    again = finer.groupBy("key").count().where("count > 1").select("key", _chunks_of("count"))
    every = sized.where(F.coalesce(F.col("chunks") <= MOST_CHUNKS, F.lit(True))).unionByName(finer.join(again, "key"))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    other = F.sequence(F.lit(0), F.col("chunks") - 1)
    pairs = F.transform(other, lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    none = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    dealt = every.select("fp", "rep", "key", F.explode(F.when(F.col("chunks").isNull(), none).otherwise(pairs)).alias("p"))
    dealt = dealt.select(F.xxhash64("key", "p.i", "p.j").alias("group"), "fp", "rep").repartition("group").sortWithinPartitions("group")

    def run(batches):
        rest = [np.empty(0, np.int64)] * 3
        for batch in slices(batches, 1 << 16):
            cols = [np.concatenate((r, c.to_numpy())) for r, c in zip(rest, batch.columns, strict=True)]
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            rest = [c[cut:] for c in cols]
            yield out([c[:cut] for c in cols])
        yield out(rest)

    def out(cols):
        u, v = _link_sorted(cols[0], cols[1].view(np.uint64), cols[2], most)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return dealt.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` per row of ``docs``.

    Null and empty texts have fingerprint 0 and link like any other; repeated rows stay repeated.
    A row with a null id gets the component of its fingerprint's class (null if the class has no id)
    and links nothing by itself. An empty table gives an empty result; other columns are ignored.
    """
    fps = materialize(fingerprints(docs, id_col, text_col), "simhash")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-classes")
    found = connected_components(links(classes, most)).withColumnRenamed("node", "rep")
    of = classes.join(found, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def close_classes(docs: DataFrame, classes: DataFrame, size: int, most: int = 3) -> DataFrame:
    """Pairs ``(u, v)`` of ``cls`` in ``classes`` (``cls, rep``), which connect what fingerprints that differ in ``most`` bits or less connect.

    The fingerprint of a class is that of the ``size``-word shingles of its representative's text in ``docs`` (``doc_id, text``).
    """
    own = classes.select("cls", F.col("rep").alias("doc_id"))
    fps = materialize(fingerprints(docs, size=size).join(own, "doc_id").select("fp", "cls"), "simhash")
    distinct = materialize(fps.groupBy("fp").agg(F.min("cls").alias("rep")), "simhash-classes")
    same = fps.join(distinct, "fp").where("cls <> rep").select(F.col("rep").alias("u"), F.col("cls").alias("v"))
    return links(distinct, most).unionByName(same).distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", similarity: float | None = None) -> DataFrame:
    """The rows of ``docs`` that stand for their component: one document of each group stays.

    Groups are those of ``near_duplicates``; with ``similarity``, texts whose five-word shingle sets have that
    Jaccard similarity or more: fingerprints propose the close ones and ``shingle_dedup`` those that differ in more
    bits, and exact sets decide on both. Rows with a null id stay. Of rows that repeat the kept id, all stay.
    """
    if similarity is not None:
        return shingle_dedup.keep_one(docs, least=similarity, propose=close_classes)
    return without_copies(docs, near_duplicates(docs, id_col), id_col)
