"""Packing token sequences: linear grouping for the large pieces, best fit for the small ones.

Only the histogram of piece lengths, at most ``capacity`` numbers, reaches the driver. There the large
lengths are cut into groups of about equal cardinality and rounded up to the largest of their group, the
few sizes left are combined into configurations by column generation, the lengths of actual pieces take
the places of the rounded ones, and what remains, the small pieces above all, is put into the tightest
sequence that has room. The plan consists of runs: "the pieces of length L with ranks s.. go to sequences
b.. at offset o", so its size depends on the capacity and not on the number of documents. Executors then
look up every piece by its rank among those of its length.
"""

from __future__ import annotations

import gc
import json
import re
import warnings
import zlib
from bisect import bisect_left, insort
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, Words, held, materialize, slices, split_words

CAPACITY = 2048
#: Groups of large lengths, and columns tried at most.
GROUPS, MAX_COLUMNS = 48, 400
#: Shares of the capacity above which a length is large; each gives a plan and the shortest is taken.
LARGE = (1 / 4, 2 / 5, 1 / 2)
#: Bytes of pre-tokens whose ids a worker remembers.
MEMO_BYTES = 48 << 20
#: Pieces of one length that share a rank counter, about.
RANK_ROWS = 1000


# ---- tokens ----------------------------------------------------------------------------------------


class WordIds:
    """Ids of white-space separated strings, as little-endian unsigned 32-bit numbers.

    The tokenizer's own splitting never joins characters across white space, so a text's ids are those of
    its strings in turn. Strings of ASCII signs and composed Latin letters are cut into pre-tokens here, by
    the tokenizer's rules for just those characters, and each distinct pre-token is merged once; any other
    string goes through the whole tokenizer. A worker remembers both from task to task.
    """

    #: Characters for which the rules below are complete, and the pre-tokens among them.
    PLAIN = re.compile("[!-~ß-öø-ÿ]+")
    #: A letter and the signs after it that end a string: those are one pre-token, and a space before them changes none.
    TAIL = r"([a-zß-öø-ÿ])([!-/:-@\[-`{-~]+)([\t-\r ]|$)"
    SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        bare = json.loads(self.whole.to_str())
        steps = {"NFC", "Replace", "Lowercase"}, {"Split", "ByteLevel"}
        held = {x["type"] for x in (bare["normalizer"] or {}).get("normalizers", [])}, {x["type"] for x in (bare["pre_tokenizer"] or {}).get("pretokenizers", [])}
        if held != steps or bare["model"].get("end_of_word_suffix") != "</w>":
            raise ValueError("the tokenizer does not split and normalise as the word-level one does")
        bare |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}}
        self.merger = Tokenizer.from_str(json.dumps(bare))
        self.known = Memo(None, MEMO_BYTES)

    def _encode(self, tokenizer, parts: list[bytes]) -> None:
        """Remember the ids of ``parts``."""
        for at in range(0, len(parts), 8192):
            some = parts[at : at + 8192]
            got = tokenizer.encode([p.decode() for p in some], is_pretokenized=True, add_special_tokens=False)
            ends = (4 * np.searchsorted(np.array(got.word_ids, np.int64), np.arange(len(some) + 1))).tolist()
            raw = np.array(got.ids, "<u4").tobytes()
            for p, a, b in zip(some, ends[:-1], ends[1:], strict=True):
                self.known.put(p, raw[a:b])

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts``, and where each text's begin, with the end as the last."""
        words, known = split_words(pc.replace_substring_regex(pc.ascii_lower(texts), self.TAIL, r"\1 \2\3")), self.known
        known.forget()
        wanted, cut, other = set(), {}, []
        for k, w in enumerate(words.distinct):
            if w in known:
                continue
            if w.isalpha():
                wanted.add(w)
                continue
            if self.PLAIN.fullmatch(plain := w.decode().lower()):
                cut[k] = [p.encode() for p in self.SPLIT.findall(plain)]
                wanted.update(cut[k])
            else:
                other.append(w)
        self._encode(self.merger, [p for p in wanted if p not in known])
        self._encode(self.whole, other)
        # strings of several pre-tokens are not remembered: there are too many, and their parts are
        return self._spread(words, [b"".join(map(known.__getitem__, cut[k])) if k in cut else known[w] for k, w in enumerate(words.distinct)])

    @staticmethod
    def _spread(words: Words, ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of every word in order, from those of each distinct one."""
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, first = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
        each = size[words.codes]
        ends = np.concatenate(([0], np.cumsum(each)))
        at = np.repeat(first[words.codes] - ends[:-1], each) + np.arange(ends[-1])
        return flat[at], ends[words.starts]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: a document's ids and ``end_id``, cut where longer than ``capacity``."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        words = held(("word ids", tokenizer), lambda: WordIds(tokenizer))
        for part in slices(batches):
            out = [[], [], [], [], []]
            gc.disable()  # nothing here is cyclic, and there is much of it
            ids, at = words.of(part.column(1))
            gc.enable()
            for doc, a, b in zip(part.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                raw = ids[a:b].tobytes() + end
                for k, start in enumerate(range(0, len(raw), 4 * capacity)):
                    own = raw[start : start + 4 * capacity]
                    for o, x in zip(out, (doc, k, start // 4, len(own) // 4, zlib.crc32(own)), strict=True):
                        o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], ["doc_id", "piece", "start", "length", "ids_crc32"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, piece long, start long, length long, ids_crc32 long")


# ---- plan ------------------------------------------------------------------------------------------


def configurations(sizes: list[int], demand: list[int], capacity: int, columns: int = MAX_COLUMNS) -> list[tuple[np.ndarray, float]]:
    """Configurations (how many of each size) and how often to use them, by column generation for the cutting-stock bound."""
    s, d = np.array(sizes), np.array(demand, float)
    basis = np.diag(capacity // s).astype(float)
    for _ in range(columns):
        inverse = np.linalg.inv(basis)
        worth = inverse.sum(0)
        new, value = _knapsack(s, worth, capacity)
        if value <= 1 + 1e-7:
            break
        amounts, step = inverse @ d, inverse @ new
        ratio = np.full(len(s), np.inf)
        np.divide(np.maximum(amounts, 0), step, out=ratio, where=step > 1e-9)
        basis[:, int(ratio.argmin())] = new
    else:
        warnings.warn(f"{columns} configurations were tried; the plan stands, but more might shorten it", stacklevel=2)
    amounts = np.linalg.solve(basis, d)
    return [(basis[:, k].round().astype(int), float(a)) for k, a in enumerate(amounts) if a > 1e-9]


def _knapsack(s: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The most valuable multiset of sizes within ``capacity``."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(s.min()), capacity + 1):
        value = np.where(s <= c, best[c - s] + worth, -1.0)
        k = int(value.argmax())
        if value[k] > best[c - 1] + 1e-12:
            best[c], pick[c] = value[k], k
        else:
            best[c] = best[c - 1]
    out, c = np.zeros(len(s)), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            out[pick[c]] += 1
            c -= s[pick[c]]
    return out, float(best[capacity])


@dataclass
class Plan:
    """``runs``: rows ``(length, first rank, first sequence, pieces a sequence, offset)``; ``sequences``: how many in all."""

    capacity: int
    sequences: int = 0
    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    _used: dict[int, int] = field(default_factory=dict)
    _room: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    _rooms: list[int] = field(default_factory=list)

    def open(self, count: int) -> int:
        first, self.sequences = self.sequences, self.sequences + count
        return first

    def place(self, length: int, count: int, first: int, each: int, offset: int) -> None:
        at = self._used.get(length, 0)
        self._used[length] = at + count
        self.runs.append((length, at, first, each, offset))

    def leave(self, room: int, first: int, count: int) -> None:
        """``count`` sequences from ``first`` on have ``room`` left."""
        if room and count:
            if room not in self._room:
                self._room[room] = []
                insort(self._rooms, room)
            self._room[room].append((first, count))

    def best_fit(self, length: int, count: int) -> None:
        """``count`` pieces of ``length`` go where least room is left over."""
        while count:
            at = bisect_left(self._rooms, length)
            if at == len(self._rooms):
                first = self.open(have := -(-count // (self.capacity // length)))
                room = self.capacity
            else:
                room = self._rooms[at]
                first, have = self._room[room].pop()
                if not self._room[room]:
                    del self._room[room], self._rooms[at]
            each = room // length
            full = min(have, count // each)
            if full:
                self.place(length, full * each, first, each, self.capacity - room)
                self.leave(room - each * length, first, full)
                count -= full * each
            if full < have:
                some = min(count, each) if count else 0
                if some:
                    self.place(length, some, first + full, some, self.capacity - room)
                    self.leave(room - some * length, first + full, 1)
                    count -= some
                    full += 1
                self.leave(room, first + full, have - full)


def grouped(lengths: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """Cut ``(length, count)`` rows into runs of about equal cardinality."""
    total, out, seen = sum(n for _, n in lengths), [[]], 0
    for length, n in lengths:
        if out[-1] and seen * groups >= total * len(out):
            out.append([])
        out[-1].append((length, n))
        seen += n
    return [g for g in out if g]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: tuple[float, ...] = LARGE) -> Plan:
    """Where the pieces of every length go; ``histogram`` maps length to count."""
    return min((_plan(histogram, capacity, groups, x) for x in large), key=lambda p: p.sequences)


def _plan(histogram: dict[int, int], capacity: int, groups: int, large: float) -> Plan:
    out = Plan(capacity)
    lengths = sorted((length, n) for length, n in histogram.items() if n)
    if any(not 0 < length <= capacity for length, _ in lengths):
        raise ValueError("a piece must have 1 to capacity tokens")
    if lengths and lengths[-1][0] == capacity:
        full = lengths.pop()[1]
        out.place(capacity, full, out.open(full), 1, 0)
    rest = dict(lengths)
    if big := [x for x in lengths if x[0] > large * capacity]:
        parts = grouped(big, groups)
        found = configurations([g[-1][0] for g in parts], [sum(n for _, n in g) for g in parts], capacity)
        queues = [[list(x) for x in reversed(g)] for g in parts]  # next: the last
        for counts, amount in sorted(found, key=lambda x: -x[1]):
            if use := int(amount + 1e-6):
                use = min([use, *(sum(n for _, n in queues[g]) // int(c) for g, c in enumerate(counts) if c)])
                _substitute(out, queues, counts, use, rest)
    for length in sorted(rest, reverse=True):
        out.best_fit(length, rest[length])
    return out


def _substitute(out: Plan, queues: list[list[list[int]]], counts: np.ndarray, use: int, rest: dict[int, int]) -> None:
    """``use`` sequences of one configuration get actual lengths, in order, from each group's queue."""
    spans = [(out.open(use), use, 0)] if use else []
    for g, c in enumerate(counts):
        for _ in range(int(c)):
            after = []
            for first, n, offset in spans:
                while n:
                    length, left = queues[g][-1]
                    take = min(n, left)
                    out.place(length, take, first, 1, offset)
                    rest[length] -= take
                    after.append((first, take, offset + length))
                    first, n = first + take, n - take
                    if take == left:
                        queues[g].pop()
                    else:
                        queues[g][-1][1] -= take
            spans = after
    for first, n, offset in spans:
        out.leave(out.capacity - offset, first, n)


# ---- placement -------------------------------------------------------------------------------------


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``found`` (rows of ``pieces``) with ``sequence_id`` and ``offset``.

    A piece's rank among those of its length is its row number in a hash bucket plus the sizes of the buckets
    before; a length has as many buckets as its pieces need, so no length, however common, meets in one task.
    """
    found = materialize(found, "pieces")
    histogram = {r.length: r["count"] for r in found.groupBy("length").count().collect()}
    runs = sorted(plan(histogram, capacity).runs)
    buckets = F.array(*(F.lit(1 + histogram.get(length, 0) // RANK_ROWS) for length in range(capacity + 1)))
    dealt = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.get(buckets, F.col("length").cast("int"))))
    sizes = dealt.groupBy("length", "bucket").count()
    before = sizes.select("length", "bucket", (F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = dealt.withColumn("own", own).join(before, ["length", "bucket"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("own") - 1 + F.col("before")).cast("long").alias("rank"))
    shared = found.sparkSession.sparkContext.broadcast(np.array(runs, np.int64).reshape(-1, 5))

    def run(batches):
        length, first_rank, first, each, offset = shared.value.T
        key = (length << 44) + first_rank
        for part in slices(batches, 1 << 16):
            own, rank = part.column(3).to_numpy(), part.column(5).to_numpy()
            at = np.searchsorted(key, (own << 44) + rank, side="right") - 1
            k = rank - first_rank[at]
            yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(first[at] + k // each[at]), pa.array(offset[at] + k % each[at] * own)], [*part.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack all rows of ``docs`` (``doc_id, text``) into few sequences of at most ``capacity`` tokens.

    Null and empty texts are one piece with the end id alone. Repeated rows and rows with null or equal ids
    are packed as rows of their own. An empty table gives an empty result; other columns are ignored.
    """
    return pack(pieces(docs, tokenizer, capacity), capacity)
