"""Byte-level BPE with Spark higher-order functions.

A word is held as the ranks of its bytes, an array, and folded by merging its adjacent pair of lowest rank until none has
a rank. An item of the array is one number: the rank of its pair with the item before, room for a place, and its own id, so
the least sum of item and place is the pair that is next, with where it is. The ranks are literals in the plan: those of
pairs in one table in which the rows of all left ids lie displaced, so a look-up is two steps; those of pieces in an array
of small maps, indexed by a hash, because Spark searches a map from its start. Decoding looks up each id's bytes, kept as
ISO-8859-1 strings, one character a byte, and joins them. ``encode`` and ``decode`` say all of this in column expressions.

``encode`` folds every word where it stands. Over a corpus, ``encode_texts`` folds each distinct word of a task once: Python
workers split the texts and number the words, the same expressions fold the words that are new, other workers put the
texts' ids together, and the expressions of ``decode`` turn them into bytes. All of it is one stage without a shuffle. Only words of
``LONG_WORD`` bytes and more, for which the expressions take time with the square of the length, are merged by the workers,
through a heap. Both forms give the same ids.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .common import Memo, columns_of, slices, small_batches

#: Buckets of the literal with the ranks by piece.
RANK_BUCKETS = 1 << 14
#: Bits of an item: its id, its place, and above them the rank of its pair, or ``NO_PAIR``.
ID_BITS, PLACE_BITS, NO_PAIR = 20, 23, 1 << 62
#: Bytes of words that a task remembers.
MEMO_BYTES = 72 << 20
#: Bytes from which a word is merged through a heap.
LONG_WORD = 128


def read_ranks(path: str) -> dict[bytes, int]:
    """Piece to rank, from a file of base64 pieces and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def java_pattern(pattern: str) -> str:
    """The split pattern with Unicode classes for Java."""
    return "(?U)" + pattern


def _latin(raw: bytes) -> str:
    return raw.decode("latin-1")


def _literal(rows: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False, separators=(",", ":"))), kind)


def _bucketed(rows: dict[str, object], buckets: int, kind: str) -> Column:
    """A literal array of maps; the map for key ``k`` is at crc32(UTF-8 of ``k``) modulo ``buckets``."""
    cells: list[dict[str, object]] = [{} for _ in range(buckets)]
    for k, v in rows.items():
        cells[zlib.crc32(k.encode()) % buckets][k] = v
    return _literal(cells, f"array<map<string,{kind}>>")


def _found(table: Column, key: Column, buckets: int) -> Column:
    return F.get(table, F.pmod(F.crc32(key.cast("binary")), F.lit(buckets)).cast("int"))[key]


def displaced(rows: dict[int, dict[int, int]], size: int) -> tuple[list[int | None], list[int | None], list[int]]:
    """Rows of values by column, laid over each other in one table: offset of each row, row and value at each place.

    Column ``y`` of row ``x`` is at ``offset[x] + y``; what lies there may be of another row. Ids are below ``size``.
    """
    offset: list[int | None] = [None] * size
    starts = 1 << 16  # offsets that are tried
    owner, value, free = np.full(starts + size, -1), np.zeros(starts + size, np.int64), []
    for x, row in sorted(rows.items(), key=lambda r: (-len(r[1]), r[0])):
        ys = np.fromiter(row, np.int64, len(row))
        while len(ys) > 1:
            fits, unused = np.ones(starts, bool), owner < 0
            for y in row:
                fits &= unused[y : y + starts]
            at = int(fits.argmax())
            if fits[at]:
                break
            owner, value, starts = np.concatenate((owner, np.full(starts, -1))), np.concatenate((value, np.zeros(starts, np.int64))), 2 * starts
        if len(ys) == 1:
            if not free:
                owner, value = np.concatenate((owner, np.full(starts, -1))), np.concatenate((value, np.zeros(starts, np.int64)))
                free = np.flatnonzero(owner < 0)[::-1].tolist()
            at = free.pop() - int(ys[0])
        offset[x] = at
        owner[at + ys], value[at + ys] = x, list(row.values())
    n = int(np.flatnonzero(owner >= 0).max(initial=-1)) + 1
    return offset, [x if x >= 0 else None for x in owner[:n].tolist()], value[:n].tolist()


@dataclass
class Coder:
    """Column expressions for one vocabulary."""

    ranks: dict[bytes, int]
    pattern: str

    def __post_init__(self):
        size = max(self.ranks.values()) + 1
        if size > NO_PAIR >> ID_BITS + PLACE_BITS:
            raise ValueError(f"ranks up to {size - 1} do not fit into an item")
        pieces: list[str | None] = [None] * size
        for piece, rank in self.ranks.items():
            pieces[rank] = _latin(piece)
        self._ranks = _bucketed({_latin(p): r for p, r in self.ranks.items()}, RANK_BUCKETS, "int")
        self._bytes = _literal([self.ranks.get(bytes([k])) for k in range(256)], "array<bigint>")
        rows: dict[int, dict[int, int]] = {}
        for piece, rank in self.ranks.items():
            for k in range(1, len(piece)):
                a, b = self.ranks.get(piece[:k]), self.ranks.get(piece[k:])
                if a is not None and b is not None:
                    rows.setdefault(a, {})[b] = rank << ID_BITS + PLACE_BITS
        offsets, owners, ranks = displaced(rows, size)
        self._pairs = F.struct(_literal(offsets, "array<int>").alias("offsets"), _literal(owners, "array<bigint>").alias("owners"), _literal(ranks, "array<bigint>").alias("ranks"))
        self._pieces = _literal(pieces, "array<string>")

    def words(self, text: Column) -> Column:
        """The pattern's matches, in order."""
        return F.regexp_extract_all(text, F.lit(java_pattern(self.pattern)), F.lit(0))

    def rank(self, piece: Column) -> Column:
        return _found(self._ranks, piece, RANK_BUCKETS)

    def fold(self, word: Column) -> Column:
        """Ids of one word, given as ISO-8859-1 string: its own rank, or else its bytes after all merges."""
        whole = self.rank(word)
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(_let(self._pairs, lambda pairs: self._merged(word, pairs)))

    def _merged(self, word: Column, pairs: Column) -> Column:
        shift, one = ID_BITS + PLACE_BITS, _long(1 << ID_BITS)
        end = F.array(_long(NO_PAIR + (1 << ID_BITS) - 1))  # at both ends: an id of no pair

        def part(item: Column) -> Column:
            return item.bitwiseAND(_long((1 << ID_BITS) - 1))

        def item(a: Column, b: Column) -> Column:
            at = F.get(pairs.offsets, a.cast("int")) + b.cast("int")
            return F.when(F.get(pairs.owners, at) == a, F.get(pairs.ranks, at)).otherwise(_long(NO_PAIR)) + b

        def merge(items: Column, at: Column, low: Column) -> Column:
            changed = F.array(item(part(F.get(items, at - 2)), low), item(low, part(F.get(items, at + 1))))
            return F.flatten(F.array(F.slice(items, F.lit(1), at - 1), changed, F.slice(items, at + 3, F.size(items))))

        def step(items: Column, places: Column) -> Column:
            def found(least: Column) -> Column:
                at = F.shiftright(least, ID_BITS).bitwiseAND(_long((1 << PLACE_BITS) - 1)).cast("int")
                return _let(at, lambda at: _let(F.shiftright(least, shift), lambda low: merge(items, at, low)))

            least = F.array_min(F.zip_with(items, places, lambda item, place: item + place))
            return _let(least, lambda least: F.when(least >= _long(NO_PAIR), items).otherwise(found(least)))

        def folded(parts: Column) -> Column:
            start = F.flatten(F.array(end, F.transform(parts, lambda b, k: item(F.coalesce(F.get(parts, k - 1), _long((1 << ID_BITS) - 1)), b)), end))
            steps = F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))
            ids = lambda items: F.transform(F.slice(items, F.lit(2), F.size(items) - 2), lambda x: part(x).cast("int"))
            places = F.sequence(_long(0), (F.size(parts).cast("long") + 1) * one, one)
            return _let(places, lambda places: F.aggregate(steps, start, lambda items, _: step(items, places), ids))

        return _let(F.transform(F.split(word, ""), lambda c: F.get(self._bytes, F.ascii(c))), folded)

    def unfold(self, ids: Column) -> Column:
        """The bytes of ``ids`` as ISO-8859-1 string."""
        return F.array_join(F.transform(ids, lambda i: F.get(self._pieces, i)), "")

    def decoded(self, ids: Column) -> Column:
        """The bytes of ``ids``."""
        return F.encode(self.unfold(ids), "ISO-8859-1")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once and not copied."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda acc, _: acc, body)


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def latin(word: Column) -> Column:
    """UTF-8 bytes as ISO-8859-1 string."""
    return F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")


def encode(docs: DataFrame, coder: Coder) -> DataFrame:
    """``docs`` with ``ids`` (decimal ids joined by commas) and ``n_tokens``, in column expressions; null texts count as empty.

    Columns of ``docs`` with these names are replaced.
    """
    own = docs.select(*columns_of(docs, "ids", "n_tokens"))
    joined = F.array_join(F.transform(coder.words(F.coalesce("text", F.lit(""))), lambda w: F.array_join(coder.fold(latin(w)).cast("array<string>"), ",")), ",")
    out = own.withColumn("ids", joined)
    commas = F.length("ids") - F.length(F.replace("ids", F.lit(",")))
    return out.withColumn("n_tokens", F.when(F.col("ids") == "", 0).otherwise(commas + 1).cast("long"))


def decode(encoded: DataFrame, coder: Coder) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of its ``ids``, in column expressions."""
    ids = F.when(F.col("ids") == "", F.array().cast("array<int>")).otherwise(F.split("ids", ",").cast("array<int>"))
    return encoded.withColumn("decoded", coder.decoded(ids))


_NO_RANK = 1 << 62


def fold_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: its own rank, or else its bytes after merging the adjacent pair of lowest rank, leftmost first, while any has one."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if len(word) >= LONG_WORD:
        return list(_fold_long(word, ranks))
    parts = [word[k : k + 1] for k in range(len(word))]
    order = [ranks.get(word[k : k + 2], _NO_RANK) for k in range(len(word) - 1)]
    while order and (low := min(order)) != _NO_RANK:
        k = order.index(low)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
        del order[k]
        if k:
            order[k - 1] = ranks.get(parts[k - 1] + parts[k], _NO_RANK)
        if k < len(order):
            order[k] = ranks.get(parts[k] + parts[k + 1], _NO_RANK)
    return [ranks[p] for p in parts]


def _fold_long(word: bytes, ranks: dict[bytes, int]) -> Iterator[int]:
    """The same merges in time n log n: a heap of pairs by rank and place, over parts linked by where they end and begin."""
    n = len(word)
    end = list(range(1, n + 1))  # of the part that begins here
    begin = list(range(-1, n))  # of the part that ends here
    rank = [ranks.get(word[k : k + 2], _NO_RANK) for k in range(n - 1)] + [_NO_RANK]  # of the part that begins here with its successor
    heap = [r << 32 | k for k, r in enumerate(rank) if r != _NO_RANK]
    heapify(heap)
    while heap:
        low = heappop(heap)
        k = low & 0xFFFFFFFF
        if rank[k] != low >> 32:
            continue  # merged since
        middle = end[k]
        stop = end[middle]
        end[k], begin[stop], rank[middle] = stop, k, _NO_RANK
        for a, b in ((k, stop), (begin[k], k)):
            if a >= 0:
                r = rank[a] = ranks.get(word[a : end[b]], _NO_RANK) if b < n else _NO_RANK
                if r != _NO_RANK:
                    heappush(heap, r << 32 | a)
    k = 0
    while k < n:
        yield ranks[word[k : end[k]]]
        k = end[k]


class Numbers(dict):
    """Words numbered in the order in which they are first asked for; ``new`` has those since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


def _numbered(batches: Iterator[pa.RecordBatch], pattern: str, ranks: Callable[[], dict[bytes, int]], fields: list[str]) -> Iterator[pa.RecordBatch]:
    """Instead of texts: whether numbers start anew, the words that are new with the ids of long ones, and each word's number."""
    import regex

    split, numbers, taken = regex.compile(pattern).findall, Numbers(), 0
    for part in slices(batches, 128):
        fresh, ends, codes, words, ids = [], [0], [], [], []
        for text in part.column(part.num_columns - 1).to_pylist():
            fresh.append(taken > MEMO_BYTES)
            if fresh[-1]:
                numbers.clear()
                taken = 0
            found = split(text or "")
            codes.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)).tobytes())
            for word in numbers.new:
                taken += Memo.ENTRY_BYTES + len(word)
                raw = word.encode() if 4 * len(word) >= LONG_WORD else b""
                ids.append(fold_bytes(raw, ranks()) if len(raw) >= LONG_WORD else None)
            words += numbers.new
            numbers.new.clear()
            ends.append(len(words))
        new = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])
        yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(fresh), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), new), pa.array(codes, pa.binary())], fields)


class Ids:
    """Ids of the words so far, by number: as text, and one after the other."""

    #: Words whose ids are put together at a time.
    BLOCK = 1 << 18

    def __init__(self):
        self.text: list[str] = []
        self.flat, self.ends = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64)  # ends[k + 1] is of word k

    def clear(self) -> None:
        self.text.clear()

    def add(self, words: pa.ListArray) -> None:
        ids, sizes = words.flatten(), pc.list_value_length(words).to_numpy()
        n, m = len(self.text), int(self.ends[len(self.text)])
        self.flat, self.ends = _room(self.flat, m + len(ids)), _room(self.ends, n + len(sizes) + 1)
        self.flat[m : m + len(ids)] = ids.to_numpy()
        np.cumsum(sizes, out=self.ends[n + 1 : n + len(sizes) + 1])
        self.ends[n + 1 : n + len(sizes) + 1] += m
        places = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        self.text += pc.binary_join(pa.ListArray.from_arrays(pa.array(places), ids.cast(pa.string())), ",").to_pylist()

    def of(self, codes: np.ndarray) -> tuple[str, np.ndarray]:
        """The ids of the words ``codes``, joined by commas and as array."""
        out = []
        for k in range(0, len(codes), self.BLOCK):
            block = codes[k : k + self.BLOCK]
            starts = self.ends[block]
            sizes = self.ends[block + 1] - starts
            ends = np.cumsum(sizes)
            out.append(self.flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1])])
        return ",".join(map(self.text.__getitem__, codes.tolist())), np.concatenate(out) if out else self.flat[:0]


def _room(held: np.ndarray, n: int) -> np.ndarray:
    """``held``, or a longer copy of it, with ``n`` places at least."""
    return held if n <= len(held) else np.concatenate((held, np.zeros(max(n - len(held), len(held)), held.dtype)))


def _joined(batches: Iterator[pa.RecordBatch], fields: list[str]) -> Iterator[pa.RecordBatch]:
    """Instead of the last three columns (the second one now the ids of the new words): number of ids, and ids of each text as text and list."""
    known = Ids()
    for part in slices(batches, 128):
        *own, fresh, new, codes = part.columns
        at, text, ids = 0, [], []
        ends = np.cumsum(pc.list_value_length(new).to_numpy()).tolist()
        flat, anew = new.flatten(), [k for k, x in enumerate(fresh.to_pylist()) if x]
        # numbers start anew at few texts; up to the next of these all new words are taken at once
        for begin, end in zip([0, *anew], [*anew, part.num_rows], strict=True):
            if begin in anew:
                known.clear()
            if end > begin:
                known.add(flat.slice(at, ends[end - 1] - at))
                at = ends[end - 1]
            for code in codes.slice(begin, end - begin).to_pylist():
                found = known.of(np.frombuffer(code, np.int32))
                text.append(found[0])
                ids.append(found[1])
        places = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
        lists = pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
        yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(places), pa.int64()), pa.array(text, pa.string()), lists], fields)


def encode_texts(docs: DataFrame, coder: Coder) -> DataFrame:
    """``docs`` (without ``text``) with ``n_tokens``, ``ids`` and ``decoded``; null texts count as empty.

    Columns of those names are replaced; repeated rows and null ids are rows like others. A word of any length
    takes time in proportion to its length, but for a logarithm. An empty table gives an empty result.
    """
    src = docs.select(*columns_of(docs, "n_tokens", "ids", "decoded", "text"), F.col("text").cast("string").alias("text"))
    small_batches(docs.sparkSession)
    shared, pattern, own = docs.sparkSession.sparkContext.broadcast(coder.ranks), coder.pattern, src.columns[:-1]
    plain = [f"c{k}" for k in range(len(own))]  # names that mapInArrow takes
    kept = [StructField(c, f.dataType) for c, f in zip(plain, src.schema, strict=False)]
    word = StructType([StructField("word", StringType()), StructField("ids", ArrayType(IntegerType()))])
    split = StructType([*kept, StructField("fresh", BooleanType()), StructField("new", ArrayType(word)), StructField("codes", BinaryType())])
    done = StructType([*kept, StructField("n_tokens", LongType()), StructField("ids", StringType()), StructField("tokens", ArrayType(IntegerType()))])
    ids = F.transform("new", lambda w: F.coalesce(w.ids, coder.fold(latin(w.word))))
    numbered = src.toDF(*plain, "text").mapInArrow(lambda batches: _numbered(batches, pattern, lambda: shared.value, split.names), split)
    encoded = numbered.withColumn("new", ids).mapInArrow(lambda batches: _joined(batches, done.names), done)
    return encoded.withColumn("tokens", coder.decoded(F.col("tokens"))).toDF(*own, "n_tokens", "ids", "decoded")
