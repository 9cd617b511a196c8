"""Helpers that several operators share: scratch tables, Arrow passes, sampling, word rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Rows that one Python step takes from an Arrow batch at a time; bounds the objects alive at once.
SLICE_ROWS = 2048
#: Bytes of an Arrow batch on its way to Python, in sessions that set no limit of their own.
BATCH_BYTES = 4 << 20
#: Rows of up to three longs that are broadcast at most: some 50 MB.
BROADCAST_ROWS = 2_000_000
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"

#: ASCII upper-case letters to lower case, everything else unchanged.
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only a local-mode session may fall back to a temporary folder of its own.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="findery-"))
        return sc.getCheckpointDir().rstrip("/")
    raise ValueError("spark.checkpoint.dir is not set; a cluster needs a shared folder there")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/findery-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession | None) -> None:
    """Let whole texts go to Python a few megabytes at a time, unless the session has a limit of its own."""
    if spark is not None and _BATCH_KEY not in spark.conf.getAll:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    small_batches(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lean() -> None:
    """Have this worker give memory back that Arrow has freed."""
    if pa.default_memory_pool().backend_name != "system":
        pa.set_memory_pool(pa.system_memory_pool())


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Slices of bounded length, in a worker."""
    _lean()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def arrow_pass(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` with a step on slices of bounded length."""

    def run(batches):
        for part in slices(batches):
            if (out := step(part)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


@dataclass(frozen=True)
class Words:
    """The words of some texts: each distinct one, and the words in order as places among those."""

    distinct: list[bytes]
    codes: np.ndarray
    #: The words of text ``k`` are those from ``starts[k]`` to ``starts[k + 1]``.
    starts: np.ndarray

    def of(self, k: int) -> np.ndarray:
        return self.codes[self.starts[k] : self.starts[k + 1]]

    def __len__(self) -> int:
        return len(self.starts) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.starts)


def split_words(texts: pa.Array, lower: bool = False) -> Words:
    """Runs of anything but ASCII space characters; none for null. With ``lower``, A-Z become a-z."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    solid = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate(([0], np.cumsum(solid.to_numpy(zero_copy_only=False))))
    coded = flat.filter(solid).dictionary_encode()
    starts = before[np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))]
    return Words(coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy().astype(np.int64), starts)


def text_column(step: Callable[[pa.Array], pa.Array], kind: str) -> Callable[[Column], Column]:
    """A column of ``kind`` from whole texts, in slices of bounded length.

    Only the text goes to Python and only the result comes back; the rest of the row waits in the JVM. It is
    marked as not deterministic, so that no plan evaluates it twice.
    """

    @arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        _lean()
        parts = [step(texts.slice(at, SLICE_ROWS)) for at in range(0, max(1, len(texts)), SLICE_ROWS)]
        return pa.concat_arrays(parts) if len(parts) > 1 else parts[0]

    small_batches(SparkSession.getActiveSession())
    found = run.asNondeterministic()
    return lambda text: found(text.cast("string"))


class Memo(dict):
    """``make(key)`` for every key asked for, remembered until all take about ``limit`` bytes."""

    #: Bytes of an entry besides its key's and value's own length.
    ENTRY_BYTES = 150

    def __init__(self, make: Callable | None, limit: int):
        super().__init__()
        self.make, self.limit, self.taken = make, limit, 0

    def __missing__(self, key):
        if self.make is None:
            raise KeyError(key)
        self.forget()
        value = self.make(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        self.taken += self.ENTRY_BYTES + len(key) + (len(value) if isinstance(value, (bytes, str)) else 0)
        self[key] = value

    def forget(self) -> None:
        """Be empty again beyond the limit."""
        if self.taken > self.limit:
            self.clear()
            self.taken = 0


_held: dict[object, object] = {}


def held(name: object, make: Callable[[], object]):
    """What ``make`` gave for ``name`` in this worker. A worker outlives its stage, so it holds one such thing at a time."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def columns_of(df: DataFrame, *without: str) -> list[Column]:
    """The columns of ``df`` whose names are not in ``without``, whatever signs the names hold; as in Spark, case does not matter."""
    gone = {c.lower() for c in without}
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c.lower() not in gone]


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until ``df`` has no such column."""
    known = {c.lower() for c in df.columns}
    while name.lower() in known:
        name = "_" + name
    return name


def broadcast_if_small(df: DataFrame, name: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, written once and counted: with a broadcast hint up to ``rows`` rows of a few numbers, and without one beyond."""
    held = materialize(df, name)
    return F.broadcast(held) if held.count() <= rows else held


def without_copies(docs: DataFrame, of: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` but those whose id never is its own component in ``of`` (``doc_id, component_id``).

    Rows with a null id stay. As long as few ids go, no text is shuffled for it.
    """
    own = F.bool_or(F.col("doc_id") == F.col("component_id"))
    gone = of.where("doc_id is not null").groupBy(F.col("doc_id").alias("_gone")).agg(own.alias("own")).where("not own").select("_gone")
    gone = broadcast_if_small(gone, "copies")
    named = docs.where(docs[id_col].isNotNull())
    return named.join(gone, named[id_col] == gone["_gone"], "left_anti").unionByName(docs.where(docs[id_col].isNull()))


def hash_order(*cols: Column) -> Column:
    """A fixed pseudo-random order of rows, the same on every run and cluster."""
    return F.xxhash64(F.lit("findery"), *cols)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the decimal id modulo ``folds``; a null id is in no fold (-1)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1))
