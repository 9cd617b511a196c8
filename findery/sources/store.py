"""The index on disk: a base and a few additions to it, and a pointer row that publishes a version.

A run writes only the records that it makes, with their manifest rows and postings, as a part of its own, and then
appends a pointer row that lists the parts of the new version. A document's newest part holds, so nothing that
is read is ever overwritten, a failed run leaves the last version current, and a run that changes one percent
writes one percent. Once parts are many or large they are written anew as one base; ``vacuum`` deletes what no
version needs any more. Of two runs that follow the same version one is refused.

A run over many files is cut into batches, each of which is published by itself as a step of the run's version, so a
run that is stopped or dies keeps what it has done: the manifest of the last step is where the next run goes on. The
pointer row says how far the run came. Once all batches are published their parts are written anew as one. The number of
batches grows with the root of the number of files, as each costs several small jobs.
"""

from __future__ import annotations

import math
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from findery import schema
from findery.config import Config
from findery.operators import blocks, postings, records
from findery.operators.search import Index

RUN = "key: string, started: string, total_files: long, to_do: long, done: long, corpus_root_changed: boolean"
POINTER = f"version int, step int, corpus_root string, built_at string, parts array<string>, rows array<long>, run struct<{RUN}>, log string"
#: Parts of a version at most, and share of the base that additions may reach.
MAX_PARTS, MAX_SHARE = 8, 0.25
#: Files of a batch at least, and batches of a run at most.
BATCH_FILES, MAX_BATCHES = 25_000, 64
#: Files whose records one task makes, about.
TASK_FILES = 10_000
#: Distinct tokens whose block rows one task makes, about.
TASK_TOKENS = 50_000
#: Seconds after which a claim on a version without a successor counts as left by a run that died.
CLAIM_SECONDS = 600
TABLES = {
    "records": schema.RECORDS,
    # with when the record of the file was made; parts of earlier code have null
    "manifest": f"{schema.MANIFEST}, indexed_at string",
    "postings_field": "field string, value string, doc_id string",
    "postings_kw": "token string, doc_id string, pos int",
}
#: Tables that lie in order: columns by which they are dealt, and how many of these they are sorted by.
SORTED = {"postings_field": (("field", "value", "doc_id"), 2), "postings_kw": (("token", "doc_id"), 1), "blocks": (("kind", "b", "token"), 2)}


def _write_sorted(rows: DataFrame, at: str, name: str) -> None:
    keys, n = SORTED[name]
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys[:n]).write.parquet(f"{at}/{name}")


class Conflict(RuntimeError):
    """Another run has published the successor of the version that this one began with."""


@dataclass(frozen=True)
class Run:
    """An index run: files seen, files that were new or changed, and how many of those are published."""

    key: str
    started: str
    total_files: int
    to_do: int
    done: int
    corpus_root_changed: bool

    def summary(self, root: str) -> tuple:
        """As it is logged."""
        return (self.started, root, self.total_files, self.done, self.total_files - self.to_do, self.corpus_root_changed, self.done < self.to_do)


@dataclass(frozen=True)
class Snapshot:
    """One version; every table read from it belongs to it, whatever is published meanwhile."""

    spark: SparkSession
    path: str
    version: int = 0
    corpus_root: str | None = None
    built_at: str | None = None
    parts: tuple[str, ...] = ()
    rows: tuple[int, ...] = ()
    #: The index run that made it, if one did, and the key of the log entries that belong to it.
    run: Run | None = None
    log: str | None = None
    #: Publications within the version: further batches of its run, and parts written anew.
    step: int = 0

    @property
    def place(self) -> tuple[int, int]:
        """Where it stands among all that was published."""
        return self.version, self.step

    def _part(self, part: str, name: str, ddl: str) -> DataFrame:
        return self.spark.read.schema(ddl).parquet(f"{self.path}/{part}/{name}")

    def table(self, name: str) -> DataFrame:
        """Rows of each document from the newest part that names it."""
        ddl = TABLES[name]
        if len(self.parts) < 2:
            return self._part(self.parts[0], name, ddl) if self.parts else self.spark.createDataFrame([], ddl)
        every = changed = None
        for k, part in enumerate(self.parts):
            rows = self._part(part, name, ddl).withColumn("_part", F.lit(k))
            every = rows if every is None else every.unionByName(rows)
            if k:
                ids = self._part(part, "changed", "doc_id string").withColumn("_newest", F.lit(k))
                changed = ids if changed is None else changed.unionByName(ids)
        newest = changed.groupBy("doc_id").agg(F.max("_newest").alias("_newest"))
        kept = every.join(newest, "doc_id", "left").where("_newest is null or _newest = _part")
        return kept.select(*self.spark.createDataFrame([], ddl).columns)

    def records(self) -> DataFrame:
        return self.table("records")

    def manifest(self) -> DataFrame:
        return self.entries().drop("indexed_at")

    def entries(self) -> DataFrame:
        """The manifest with ``indexed_at`` of the record of each file."""
        return self.table("manifest")

    def records_of(self, entries: DataFrame) -> DataFrame:
        """As many records as ``entries`` (``doc_id, indexed_at``) has of each id and date; those that one run made of an id are alike."""
        key = ["doc_id", "indexed_at"]
        asked = entries.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy("doc_id")))
        held = self.records().join(entries.select(*key), key, "left_semi")
        held = held.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy("extraction_status")))
        return held.join(asked, [*key, "_k"], "left_semi").drop("_k")

    def blocks(self) -> DataFrame | None:
        """Block rows of all tokens, each from the part that had it first; None without parts, or if a part was written without.

        Tokens that no document has any more stay until the parts are merged.
        """
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        paths = [f"{self.path}/{part}/blocks" for part in self.parts]
        if not paths or not all(fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p)) for p in paths):
            return None
        return self.spark.read.schema(blocks.ROWS).parquet(*paths)

    def record(self, doc_id: str):
        """One record; ``KeyError`` if there is none."""
        found = self.records().where(F.col("doc_id") == doc_id).first()
        if found is None:
            raise KeyError(doc_id)
        return found

    def index(self) -> Index:
        return Index(self.records(), self.table("postings_field"), self.table("postings_kw"), blocks=self.blocks())


@dataclass
class _Held:
    """A cached index and the number of its readers."""

    place: tuple[int, int]
    index: Index
    readers: int = 0


@dataclass
class Store:
    spark: SparkSession
    path: str
    _held: _Held | None = field(default=None, repr=False)
    _lock: threading.Lock = field(default_factory=threading.Lock, repr=False)

    def _pointer(self) -> DataFrame | None:
        fs, path = self._fs()
        at = f"{self.path}/pointer"
        return self.spark.read.schema(POINTER).parquet(at) if fs.exists(path(at)) else None

    def snapshot(self) -> Snapshot:
        """The published version, or an empty one (version 0) before the first run."""
        found = self._pointer()
        row = None if found is None else found.orderBy(F.desc("version"), F.desc_nulls_last("step")).first()
        return Snapshot(self.spark, self.path) if row is None else Snapshot(self.spark, self.path, row.version, row.corpus_root, row.built_at, tuple(row.parts), tuple(row.rows), Run(*row.run) if row.run else None, row.log, row.step or 0)

    def logged_keys(self, keys: list[str]) -> set[str]:
        """Those of ``keys`` that belong to a published version."""
        found = self._pointer() if keys else None
        return set() if found is None else {r.log for r in found.where(F.col("log").isin(*keys)).select("log").collect()}

    def current(self) -> Snapshot | None:
        """The published version, or None before the first run."""
        found = self.snapshot()
        return found if found.version else None

    def records(self) -> DataFrame:
        return self.snapshot().records()

    def manifest(self) -> DataFrame:
        return self.snapshot().manifest()

    def record(self, doc_id: str):
        return self.snapshot().record(doc_id)

    def index(self) -> Index | None:
        """Records and postings of the published version, or None before the first run."""
        found = self.current()
        return None if found is None else found.index()

    @contextmanager
    def cached_index(self) -> Iterator[Index | None]:
        """The published version's index, kept in memory until another is published; None before the first run.

        Any number of threads may read at the same time. They share one copy of a version, and a version that has been
        replaced leaves memory when the last of its readers has ended.
        """
        now = self.current()
        with self._lock:
            if now is not None and (self._held is None or self._held.place < now.place):
                old, self._held = self._held, _Held(now.place, now.index().cache())
                if old is not None and not old.readers:
                    old.index.unpersist()
            mine = self._held
            if mine is not None:
                mine.readers += 1
        try:
            yield None if mine is None else mine.index
        finally:
            if mine is not None:
                with self._lock:
                    mine.readers -= 1
                    if mine is not self._held and not mine.readers:
                        mine.index.unpersist()

    # ---- writing ----

    def _fs(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _write_part(self, rows: DataFrame, manifest: DataFrame, gone: DataFrame | None, known: DataFrame | None = None) -> tuple[str, int]:
        """A part's folder and number of records. Postings and blocks are sorted by their keys, so look-ups skip row groups by their statistics; a key of very many documents is dealt by these.

        Tokens in the block rows ``known`` of earlier parts get none here.
        """
        part = f"part-{uuid.uuid4().hex}"
        at = f"{self.path}/{part}"
        rows.write.parquet(f"{at}/records")
        kept = self.spark.read.schema(schema.RECORDS).parquet(f"{at}/records")
        manifest.write.parquet(f"{at}/manifest")
        ids = kept.select("doc_id")
        (ids if gone is None else ids.unionByName(gone.select("doc_id"))).distinct().write.parquet(f"{at}/changed")
        _write_sorted(postings.field_postings(kept), at, "postings_field")
        _write_sorted(postings.keyword_postings(kept), at, "postings_kw")
        tokens = self.spark.read.schema(TABLES["postings_kw"]).parquet(f"{at}/postings_kw").select("token").distinct()
        if known is not None:
            tokens = tokens.join(known.where("kind = 'token'").select("token"), "token", "left_anti")
        # kept in a few files: cached rows would stay in as many partitions as the shuffle has, once for each kind of block rows
        tokens.write.parquet(f"{at}/tokens")
        tokens = self.spark.read.schema("token string").parquet(f"{at}/tokens")
        tokens = tokens.repartition(max(1, -(-tokens.count() // TASK_TOKENS)), "token")
        _write_sorted(blocks.rows_of(tokens), at, "blocks")
        return part, kept.count()

    def _join_parts(self, parts: tuple[str, ...]) -> str:
        """A part of the rows of ``parts``, as they are: these have no document in common, and each only the block rows of tokens that no earlier one has."""
        part = f"part-{uuid.uuid4().hex}"
        at = f"{self.path}/{part}"
        for name, ddl in {**TABLES, "changed": "doc_id string", "blocks": blocks.ROWS}.items():
            rows = self.spark.read.schema(ddl).parquet(*(f"{self.path}/{p}/{name}" for p in parts))
            if name in SORTED:
                _write_sorted(rows, at, name)
            else:
                rows.write.parquet(f"{at}/{name}")
        return part

    def _claim(self, after: Snapshot) -> None:
        """Be the one that writes the successor of ``after``, or raise. Atomic where creating a file is, as on HDFS."""
        fs, path = self._fs()
        name, turn = f"after-{after.version}" + f".{after.step}" * bool(after.step), 0
        while not fs.createNewFile(path(f"{self.path}/claims/{name}-{turn}")):
            age = time.time() - fs.getFileStatus(path(f"{self.path}/claims/{name}-{turn}")).getModificationTime() / 1000
            if age < CLAIM_SECONDS or self.snapshot().place > after.place:
                raise Conflict(f"version {name[6:]} has a successor already, or another run is writing it")
            turn += 1

    def _point(self, after: Snapshot, now: Snapshot) -> Snapshot:
        self._claim(after)
        run = None if now.run is None else tuple(getattr(now.run, k) for k in Run.__dataclass_fields__)
        row = (now.version, now.step, now.corpus_root, now.built_at, list(now.parts), list(now.rows), run, now.log)
        self.spark.createDataFrame([row], POINTER).coalesce(1).write.mode("append").parquet(f"{self.path}/pointer")
        return now

    def publish(self, after: Snapshot, rows: DataFrame, manifest: DataFrame, corpus_root: str, built_at: str, gone: DataFrame | None = None, anew: bool = False, run: Run | None = None, log: str | None = None, merge: bool = True, step: bool = False) -> Snapshot:
        """A version that follows ``after``: ``rows`` and ``manifest`` replace what it has of the same documents, and ``gone`` (``doc_id``) leave.

        With ``anew`` nothing of ``after`` stays. The version is current once this returns. Without ``merge`` parts may add
        up; the last of several versions should merge them. A ``step`` stays in the version of ``after``.
        """
        was = replace(after, parts=(), rows=()) if anew else after
        part, n = self._write_part(rows, manifest, gone, was.blocks())
        at = {"step": after.step + 1} if step else {"version": after.version + 1, "step": 0}
        now = replace(was, **at, corpus_root=corpus_root, built_at=built_at, parts=(*was.parts, part), rows=(*was.rows, n), run=run, log=log)
        self._point(after, now)
        return self.merged(now) if merge else now

    def merged(self, now: Snapshot, since: int | None = None) -> Snapshot:
        """``now`` with its parts written as one base, if they are many or large, or else with those from place ``since`` on, the batches of one run, written as one."""
        alone = len(now.parts) if since is None else since + 1
        if since == 0 and len(now.parts) > 1:
            return self._point(now, replace(now, step=now.step + 1, parts=(self._join_parts(now.parts),), rows=(sum(now.rows),), log=None))
        if alone > MAX_PARTS or (len(now.parts) > 1 and sum(now.rows[1:]) > MAX_SHARE * now.rows[0]):
            part, n = self._write_part(now.records(), now.entries(), None)
            return self._point(now, replace(now, step=now.step + 1, parts=(part,), rows=(n,), log=None))
        if since is None or len(now.parts) - since < 2:
            return now
        part = self._join_parts(now.parts[since:])
        return self._point(now, replace(now, step=now.step + 1, parts=(*now.parts[:since], part), rows=(*now.rows[:since], sum(now.rows[since:])), log=None))

    def vacuum(self, keep: int = 1) -> int:
        """Delete the parts that none of the last ``keep`` versions has, and leftovers of scans; the number of folders deleted.

        No run may be under way, nor a reader of an older version.
        """
        pointer = self._pointer()
        needed = set() if pointer is None else {p for r in pointer.orderBy(F.desc("version"), F.desc_nulls_last("step")).limit(keep).collect() for p in r.parts}
        fs, path = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(path(self.path))]
        old = [x for x in names if (x.startswith("part-") and x not in needed) or x == "scans"]
        return sum(bool(fs.delete(path(f"{self.path}/{x}"), True)) for x in old)


def _batches(changed: int, batch: int | None) -> int:
    """How many batches a run has: of about ``batch`` files, or else as many as the root of the number of batches of the least size."""
    each = -(-changed // (batch or BATCH_FILES))
    return min(MAX_BATCHES, each if batch else math.ceil(math.sqrt(each)))


def _since(new: DataFrame, entries: DataFrame) -> DataFrame:
    """``new`` with ``since``: when a file was indexed that ``entries`` hold as it is, while others of its path have changed."""
    same = ["file_path", "mtime", "size"]
    number = F.row_number().over(Window.partitionBy(*same).orderBy("indexed_at"))
    held = entries.where("indexed_at is not null").join(new.select("file_path"), "file_path", "left_semi").withColumn("_k", number)
    new = new.withColumn("_k", F.row_number().over(Window.partitionBy(*same).orderBy("file_path")))
    return new.join(held.select(*same, "_k", F.col("indexed_at").alias("since")), [*same, "_k"], "left").drop("_k")


def _scan(store: Store, marked: DataFrame, entries: DataFrame | None, batch: int | None) -> tuple[list[DataFrame], int, int, bool]:
    """Batches of the changed files of ``marked``, written below the store, with the number of files seen and of those changed, and whether any has a ``since``.

    One pass compares, counts and writes; with ``entries`` to compare to, another looks for files that have not changed themselves. Batches are cut by a hash of the path, so no task or sort sees all files.
    """
    seen, at = Observation(), f"{store.path}/scans/{uuid.uuid4().hex}"
    counted = marked.observe(seen, F.count("*").alias("total"), F.count_if("changed").alias("changed"))
    counted.where("changed").select("file_path", "mtime", "size").write.parquet(f"{at}/all")
    total, changed = seen.get["total"], seen.get["changed"]
    ddl = f"{schema.FILES}, since string"
    new, n, kept = store.spark.read.schema(ddl).parquet(f"{at}/all"), _batches(changed, batch), False
    if changed and entries is not None:
        found = Observation()
        _since(new.drop("since"), entries).observe(found, F.count("since").alias("kept")).write.parquet(f"{at}/since")
        new, kept = store.spark.read.schema(ddl).parquet(f"{at}/since"), found.get["kept"] > 0
    if n < 2:
        return [new] * n, total, changed, kept
    dealt = new.withColumn("batch", F.pmod(F.xxhash64("file_path"), F.lit(n)).cast("int"))
    dealt.repartition("batch", F.pmod(F.xxhash64("file_path", F.lit(1)), F.lit(8))).write.partitionBy("batch").parquet(f"{at}/dealt")
    parts = store.spark.read.schema(f"{ddl}, batch int").parquet(f"{at}/dealt")
    return [parts.where(F.col("batch") == k).drop("batch") for k in range(n)], total, changed, kept


def index_files(store: Store, files: DataFrame, corpus_root: str, config: Config, now: str, rebuild: bool = False, drop_deleted: bool = False, phase: Callable[[str], None] = lambda name: None, progress: Callable[[int, int], None] = lambda done, total: None, should_stop: Callable[[], bool] = lambda: False, batch: int | None = None) -> DataFrame:
    """Bring the index up to date with ``files`` (``file_path, mtime, size``); one row of counters, as in the run log, with ``cancelled``.

    Files that the manifest has with the same mtime and size are skipped; another root starts from nothing. Of a path that is listed
    several times, files that are as they were keep their records when others change or go.
    Records of files that are gone stay unless ``drop_deleted``. A run that finds nothing new publishes nothing.
    What is new is published in batches of about ``batch`` files, which together make one version. ``should_stop`` is asked before each; batches that are
    published stay, and the next run skips just their files. A Spark job that is cancelled meanwhile costs its batch only.
    ``phase`` is told when scanning, indexing and building begin and may raise; ``progress`` hears of files
    looked at (unchanged ones included) out of all.
    """
    was = store.snapshot()
    moved = was.version > 0 and was.corpus_root != corpus_root
    anew = rebuild or moved or not was.version
    phase("scanning")
    gone = None
    if drop_deleted and not moved:
        files = files.persist()
        gone = was.manifest().join(files, "file_path", "left_anti").select("doc_id")
        gone = None if gone.isEmpty() else gone
    try:
        marked = files.withColumn("changed", F.lit(True)) if anew else records.changed_files(files, was.manifest())
        batches, total, changed, kept = _scan(store, marked, None if anew else was.entries(), batch)
        phase("indexing")
        run = Run(uuid.uuid4().hex, now, total, changed, 0, moved)
        progress(total - changed, total)
        if not batches and (gone is not None or not was.version or moved):
            batches = [store.spark.createDataFrame([], f"{schema.FILES}, since string")]
        at, stopped = was, False
        for k, new in enumerate(batches):
            stopped = should_stop()
            if stopped:
                break
            n = new.count()
            # many paths fit in a small file, which one task would read and parse by itself
            fresh = records.to_records(new.where("since is null").select("file_path").repartition(max(1, -(-n // TASK_FILES)), "file_path"), config.rules, now)
            seen = new.select("file_path", "mtime", "size", records.T.doc_id(F.col("file_path")).alias("doc_id"), F.coalesce("since", F.lit(now)).alias("indexed_at"))
            if kept:
                fresh = fresh.unionByName(was.records_of(new.where("since is not null").select(records.T.doc_id(F.col("file_path")).alias("doc_id"), F.col("since").alias("indexed_at"))))
            done = changed if k + 1 == len(batches) else run.done + n
            try:
                at = store.publish(at, fresh, seen, corpus_root, now, gone if k == 0 else None, anew=moved and k == 0, run=replace(run, done=done), merge=False, step=k > 0)
            except Exception:
                if not should_stop():
                    raise
                stopped = True  # the jobs of this batch were cancelled, and nothing of it is published
                break
            run = replace(run, done=done)
            progress(total - changed + done, total)
        if at is not was and not stopped:
            phase("building")
            store.merged(at, 0 if moved else len(was.parts))
        return store.spark.createDataFrame([run.summary(corpus_root)[:-1] + (stopped,)], f"{schema.INDEX_RUNS}, cancelled boolean")
    finally:
        if drop_deleted and not moved:
            files.unpersist()
