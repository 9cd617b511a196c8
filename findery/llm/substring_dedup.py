"""Exact substring deduplication: words covered by a window that also starts in an earlier document go.

Every window of ``size`` consecutive words gets a Rabin-Karp hash. Shuffling all of them would move
several times the input, so windows are first grouped by a minimizer (the least hash of the ``GRAM``-word
pieces inside the window, which equal windows share): a window whose minimizer is found in one document
only cannot repeat elsewhere, and only the others are counted. Both counts are Spark windows over rows dealt
by hash; rows that a task has settled from what it has seen itself are dealt at random, and of a window that
a text repeats one place is sent, so a passage that a third of all documents share costs one row per chunk
and key, not one task.

Equality is decided by 96 bits of two hashes; among n counted windows a false match is expected n*n/2^97 times.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import SLICE_ROWS, Words, columns_of, slices, split_words, unused, utf8

SIZE, GRAM = 50, 12
#: Rows that a task settles together before it sends them on.
COMBINE_ROWS = 1 << 18
#: Bit of a place whose window the text repeats farther on; above it lies the text's tag.
ECHO = 1 << 31

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@cache
def _powers(base: int, log: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse, 2^log of each."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(1 << log, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _rolling(h: np.ndarray, size: int, base: int) -> np.ndarray:
    """Polynomial hash of every ``size`` consecutive values."""
    n = len(h)
    up, down = _powers(base, max(12, int(n).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * up[:n], out=sums[1:])
    return (sums[size:] - sums[:-size]) * down[: n - size + 1]


def word_hashes(words: Words) -> np.ndarray:
    """A hash of every word, in order."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words.distinct), np.uint64, len(words.distinct))[words.codes]


def hashes_of(texts: pa.Array, lower: bool = False) -> Iterator[np.ndarray]:
    """The hashes of each text's words."""
    words = split_words(texts, lower)
    h = word_hashes(words)
    for a, b in zip(words.starts[:-1].tolist(), words.starts[1:].tolist(), strict=True):
        yield h[a:b]


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    return _two_hashes(h, size)[0]


def _two_hashes(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits per window, from two Rabin-Karp hashes."""
    a, b = (_mix(_rolling(h, size, x) + _U(c)) for x, c in zip(_BASES, (0, _BASES[0]), strict=True))
    return a ^ b, ((a * _U(_BASES[1]) + b) >> _U(32)).astype(np.uint32).view(np.int32)


def minimizers(h: np.ndarray, size: int, gram: int) -> np.ndarray:
    """For every window the least mixed hash of the ``gram``-word pieces in it."""
    least, width, have = _mix(_rolling(h, gram, _BASES[1])), size - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return least


def _firsts(same: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """First document of each row's run; ``same`` tells which rows go on with the run of the row before."""
    return doc[np.maximum.accumulate(np.where(same, 0, np.arange(len(doc))))]


def _as_before(*cols: np.ndarray) -> np.ndarray:
    """Which rows equal the row before in all columns."""
    same = np.zeros(len(cols[0]), bool)
    same[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in cols])
    return same


def _chunks(rows: Iterator[tuple[np.ndarray, ...]], most: int) -> Iterator[list[np.ndarray]]:
    held: list[tuple[np.ndarray, ...]] = []
    n = 0
    for row in rows:
        held.append(row)
        n += len(row[0])
        if n >= most:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held, n = [], 0
    if n:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _batches(names: list[str], cols: list[np.ndarray], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(cols[0]), rows):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + rows]) for c in cols], names)


def _shared_minimizers(docs: DataFrame, size: int, gram: int, combine: int) -> DataFrame:
    """``(doc_id, mins)``: of each document the minimizers that another document has as well."""

    def emit(batches):
        def rows():
            for part in slices(batches):
                for doc, h in zip(part.column(0).to_pylist(), hashes_of(part.column(1)), strict=True):
                    if len(h) >= size:
                        m = np.unique(minimizers(h, size, gram))
                        yield m, np.full(len(m), doc, np.int64)

        for m, d in _chunks(rows(), combine):
            order = np.lexsort((d, m))
            m, d = m[order].view(np.int64), d[order]
            same = _as_before(m)
            first = _firsts(same, d)
            known = d > first
            # the run's first document stays behind as its witness, and counts itself once another one follows
            shared = known.copy()
            shared[:-1] |= known[1:] & same[1:]
            witness = shared & (d == first)
            yield from _batches(["m", "doc", "known"], [np.concatenate((m, m[witness])), np.concatenate((d, d[witness])), np.concatenate((shared, np.zeros(witness.sum(), bool)))])

    found = docs.select("doc_id", "text").mapInArrow(emit, "m long, doc long, known boolean")
    dealt = found.withColumn("key", F.when(F.col("known"), F.xxhash64("m", "doc")).otherwise(F.col("m")))
    among = Window.partitionBy("key", "known")
    spread = dealt.select("m", "doc", "known", F.min("doc").over(among).alias("lo"), F.max("doc").over(among).alias("hi"))
    return spread.where("known or lo < hi").groupBy(F.col("doc").alias("doc_id")).agg(F.collect_set("m").alias("mins"))


def _repeats(docs: DataFrame, mins: DataFrame, size: int, gram: int, combine: int) -> DataFrame:
    """``(doc_id, places)``: starts of windows that an earlier document has too, tagged with 31 bits of the text's hash.

    Of places whose windows are equal one stands for all, with the bit ``ECHO``.
    """
    at_mins = len(docs.columns)

    def emit(batches):
        def rows():
            for part in slices(batches):
                for doc, text, h, own in zip(part.column(0).to_pylist(), utf8(part, "text"), hashes_of(part.column(1)), part.column(at_mins).to_pylist(), strict=True):
                    if len(h) < size:
                        continue
                    at = np.flatnonzero(np.isin(minimizers(h, size, gram).view(np.int64), np.array(own, np.int64)))
                    w, x = _two_hashes(h, size)
                    yield w[at], x[at], np.full(len(at), doc, np.int64), at + text_tag(text)

        for w, x, d, p in _chunks(rows(), combine):
            order = np.lexsort((d, w))
            w, x, d, p = w[order].view(np.int64), x[order], d[order], p[order]
            same = _as_before(w, x)
            known = d > _firsts(same, d)
            again = _as_before(w, x, d, p >> 32)
            p[:-1] |= np.where(again[1:], ECHO, 0)
            yield from _batches(["w", "x", "doc", "place", "known"], [c[~again] for c in (w, x, d, p, known)])

    # all columns go to Python, so that this join reads the texts through the same exchange as the last one
    name = unused(docs, "mins")
    joined = docs.join(mins.withColumnRenamed("mins", name), "doc_id").select(*columns_of(docs), name)
    found = joined.toDF("doc_id", "text", *(f"c{k}" for k in range(2, at_mins)), "mins")
    found = found.mapInArrow(emit, "w long, x int, doc long, place long, known boolean")
    dealt = found.withColumn("key", F.when(F.col("known"), F.xxhash64("doc", "place")).otherwise(F.col("w")))
    earlier = Window.partitionBy("key", "x", "known").orderBy("doc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    judged = dealt.select("doc", "place", "known", F.first("doc").over(earlier).alias("first"))
    return judged.where("known or doc > first").groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list("place").alias("places"))


def text_tag(text: bytes) -> int:
    return (xxhash.xxh32_intdigest(text) >> 1) << 32


def intervals(starts: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Maximal ``[start, end)`` word ranges that windows at ``starts`` cover."""
    s = np.unique(starts)
    if not len(s):
        return []
    cut = np.flatnonzero(np.diff(s) > size) + 1
    return [(int(x[0]), int(x[-1]) + size) for x in np.split(s, cut)]


def _starts(h: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """Window starts from the places of one text, with all that echo them."""
    starts = places & (ECHO - 1)
    if not len(echoed := starts[(places & ECHO) != 0]):
        return starts
    w, x = _two_hashes(h, size)
    wanted = set(zip(w[echoed].tolist(), x[echoed].tolist(), strict=True))
    maybe = np.flatnonzero(np.isin(w, w[echoed]))
    return np.concatenate((starts, maybe[[k in wanted for k in zip(w[maybe].tolist(), x[maybe].tolist(), strict=True)]]))


def _cut(text: Column, places: Column, size: int) -> Column:
    """``(n_words, removed, kept)`` of a text without the windows at ``places``; kept is null if nothing goes."""
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def step(texts: pa.Array, places: pa.Array) -> pa.Array:
        words = split_words(texts)
        h = word_hashes(words)
        counts, removed, left = words.counts(), [], []
        for k, place in enumerate(places.to_pylist()):
            spans, solid = [], None
            if place:
                text = texts[k].as_py().encode()
                p, tag = np.array(place, np.int64), text_tag(text)
                if len(own := p[(p >= tag) & (p < tag + (1 << 32))] - tag):
                    spans = intervals(_starts(h[words.starts[k] : words.starts[k + 1]], own, size), size)
                    solid, kept, at = text.split(), [], 0
                    for a, b in spans:
                        kept += solid[at:a]
                        at = b
                    solid = b" ".join(kept + solid[at:]).decode()
            removed.append([{"start": a, "end": b} for a, b in spans])
            left.append(solid)
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(removed, spans_type), pa.array(left, pa.string())], ["n_words", "removed", "kept"])

    @arrow_udf("struct<n_words: long, removed: array<struct<start: long, end: long>>, kept: string>")
    def cut(texts: pa.Array, places: pa.Array) -> pa.Array:
        return pa.concat_arrays([step(texts.slice(at, SLICE_ROWS), places.slice(at, SLICE_ROWS)) for at in range(0, max(1, len(texts)), SLICE_ROWS)])

    return cut.asNondeterministic()(text, places)


def cut_repeats(docs: DataFrame, name: str, size: int = SIZE, gram: int = GRAM, combine: int = COMBINE_ROWS) -> DataFrame:
    """``docs`` with a struct ``(n_words, removed, kept)`` as column ``name``; kept is null where no word goes.

    A task settles ``combine`` windows together before it sends them on; that changes what is shuffled, not the result.
    """
    if not 0 < gram <= size:
        raise ValueError("gram must be between 1 and size")
    kinds = dict(docs.dtypes)
    # without needless casts both joins read the texts alike, so they share one exchange
    keys = [c if kinds[c] == kind else F.col(c).cast(kind).alias(c) for c, kind in (("doc_id", "bigint"), ("text", "string"))]
    src = docs.select(*keys, *columns_of(docs, "doc_id", "text"))
    places = unused(docs, "places")
    known = src.where("doc_id is not null")
    found = _repeats(known, _shared_minimizers(known, size, gram, combine), size, gram, combine).withColumnRenamed("places", places)
    # rows without an id take nothing and stay where they are
    rest = src.where("doc_id is null").withColumn(places, F.lit(None).cast("array<bigint>"))
    joined = known.join(found, "doc_id", "left").unionByName(rest)
    return joined.select(*columns_of(src), _cut(F.col("text"), F.col(places), size).alias(name))


def remove_repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM, combine: int = COMBINE_ROWS) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed``, ``removed`` (maximal word intervals) and ``kept_text``.

    Words are runs of anything but ASCII space characters. A word goes if a window of ``size`` words
    covers it whose word sequence also starts in a document with a smaller ``doc_id``; windows are judged
    on the input. ``kept_text`` joins the kept words with one space, or is the text itself if nothing goes.
    Null and empty texts have no words. Rows with a null id, and rows with equal ids among themselves,
    take nothing from each other. Columns of ``docs`` with the name of a result are replaced. An empty table
    gives an empty result.
    """
    own = docs.select(*columns_of(docs, "n_words", "n_removed", "removed", "kept_text"))
    name = unused(own, "_cut")
    out = cut_repeats(own, name, size, gram, combine)
    gone = F.aggregate(F.col(f"{name}.removed"), F.lit(0).cast("long"), lambda n, x: n + x.end - x.start)
    return out.select(*columns_of(out, name), f"{name}.n_words", gone.alias("n_removed"), f"{name}.removed", F.coalesce(f"{name}.kept", "text", F.lit("")).alias("kept_text"))


def without_repeats(docs: DataFrame, length: str = "n_chars") -> DataFrame:
    """``docs`` with what ``remove_repeats`` keeps as ``text``, and its length where it has changed as column ``length``, if there is one.

    All other columns stay as they are, whatever their names.
    """
    name = unused(docs, "_cut")
    out = cut_repeats(docs, name)
    kept = F.col(f"{name}.kept")
    new = {"text": F.coalesce(kept, "text").alias("text")}
    if length in docs.columns:
        new[length] = F.when(kept.isNotNull(), F.length(kept).cast(docs.schema[length].dataType)).otherwise(F.col(length)).alias(length)
    return out.select(*(new.get(c, k) for c, k in zip(docs.columns, columns_of(docs), strict=True)))
