"""Long-running work: index runs and deep scans with their logs, and background jobs with progress and cancellation."""

from __future__ import annotations

import threading
import uuid
from collections import Counter
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from findery.config import Config
from findery.operators import extract
from findery.schema import INDEX_RUNS
from findery.sources import logs
from findery.sources.store import Snapshot, Store, index_files

RUN_LOG = f"{INDEX_RUNS}, cancelled boolean"


#: Chunks of a deep scan at most; with more to read, chunks are larger.
MAX_CHUNKS = 64


def _log_key(was: Snapshot) -> str:
    """A fresh key for the entries of the version that follows ``was``."""
    return f"after-{was.version}-{uuid.uuid4().hex}"


def settle(store: Store, log_dir: str) -> None:
    """Finish what a process left that died while it logged: its entries are shown if their version was published.

    If not, they are deleted once their place has been taken; until then another process may be about to publish them.
    """
    paths = [f"{log_dir}/{name}" for name in ("extraction", "review_queue")]
    found = sorted({key for p in paths for key in logs.waiting(p)})
    if found:
        published, version = store.logged_keys(found), store.snapshot().version
        lost = [k for k in found if k not in published and int(k.split("-")[1]) < version]
        for p in paths:
            logs.settle(p, published, lost)
    run = (now := store.snapshot()).run
    if run is not None:
        logs.put(store.spark.createDataFrame([run.summary(now.corpus_root)], RUN_LOG), f"{log_dir}/index_runs", run.key)


def index(store: Store, log_dir: str, files: DataFrame, corpus_root: str, config: Config, now: str, **options) -> Row:
    """``index_files``, and its row in the run log, once per run: if this process dies in between, the next run logs it."""
    settle(store, log_dir)
    before = store.snapshot().version
    row = index_files(store, files, corpus_root, config, now, **options).first()
    after = store.snapshot()
    mine = after.version > before and after.run is not None and after.run.started == now
    key = after.run.key if mine else uuid.uuid4().hex
    logs.put(store.spark.createDataFrame([tuple(row)], RUN_LOG), f"{log_dir}/index_runs", key)
    return row


def deep_scan(store: Store, log_dir: str, reader: extract.Reader, ocr: extract.OcrBackend, config: Config, now: str, chunk: int | None = None, should_stop: Callable[[], bool] = lambda: False, progress: Callable[[int, int], None] = lambda done, total: None) -> dict[str, int]:
    """Scan pending records and publish them merged; counts by outcome.

    With ``chunk``, about that many records make a version of their own, so a scan that is stopped or fails goes
    on where it was: what is pending is the state. Each chunk is read by as many tasks as the cluster runs at
    once, or ``workers`` of the configuration. What was read is written below the store first, so a lost executor has no document read
    twice. Log entries are staged before their version is published and shown after it, under a key that the
    version records, so a process that dies anywhere in between loses and doubles none (``settle``).
    """
    counts: Counter[str] = Counter()
    settle(store, log_dir)
    total = extract.pending(store.records()).count()
    each = None if chunk is None else max(chunk, -(-total // MAX_CHUNKS))
    progress(0, total)
    while not should_stop():
        was = store.snapshot()
        todo = extract.pending(was.records())
        if each is not None:
            # with all records of an id, as these are merged together
            todo = todo.join(todo.select("doc_id").orderBy("doc_id").limit(each).distinct(), "doc_id", "left_semi")
        at = f"{store.path}/scans/{uuid.uuid4().hex}"
        extract.extract(todo, reader, ocr, config.extraction).write.parquet(at)
        found = store.spark.read.parquet(at)
        outcome = F.when(F.col("reason").isNull(), "filled").otherwise("review").alias("s")
        seen = {r.s: r["count"] for r in found.groupBy(outcome).count().collect()}
        if not seen:
            break
        scanned = was.records().join(found.select("doc_id"), "doc_id", "left_semi")
        same = was.entries().join(found.select("doc_id"), "doc_id", "left_semi")
        key = _log_key(was)
        logs.stage(extract.extraction_log(found, now), f"{log_dir}/extraction", key)
        logs.stage(extract.review_entries(found, now), f"{log_dir}/review_queue", key)
        store.publish(was, extract.merge(scanned, found, config.rules), same, was.corpus_root, now, log=key, merge=False)
        for name in ("extraction", "review_queue"):
            logs.release(f"{log_dir}/{name}", key)
        counts.update(seen)
        progress(counts.total(), total)
    if counts:
        store.merged(store.snapshot())
    return dict(counts)


class Busy(RuntimeError):
    """A job is running already."""


class Cancelled(RuntimeError):
    """The job was asked to stop."""


class Jobs:
    """One background job at a time; its Spark jobs carry a tag by which they are followed and cancelled."""

    def __init__(self, spark: SparkSession):
        self.spark, self._lock, self._thread = spark, threading.Lock(), None
        self._tag, self.phase, self.done, self.total = "", "", 0, 0
        self.error, self.result, self.cancelled = None, None, threading.Event()

    def running(self) -> bool:
        return self._thread is not None and self._thread.is_alive()

    def start(self, work: Callable[[], object]) -> None:
        with self._lock:
            if self.running():
                raise Busy
            self._tag, self.phase, self.done, self.total = f"findery-{uuid.uuid4().hex}", "", 0, 0
            self.error, self.result = None, None
            self.cancelled.clear()

            def run():
                self.spark.sparkContext.addJobTag(self._tag)
                try:
                    self.result = work()
                except Exception as e:  # reported by progress()
                    self.error = None if self.cancelled.is_set() else str(e)

            self._thread = InheritableThread(target=run, daemon=True)
            self._thread.start()

    def enter(self, phase: str) -> None:
        """Note a phase of the work; stops the job here if that was asked for."""
        if self.cancelled.is_set():
            raise Cancelled
        self.phase = phase

    def count(self, done: int, total: int) -> None:
        self.done, self.total = done, total

    def cancel(self) -> bool:
        """Ask the job to stop; false if none is running."""
        if not self.running():
            return False
        self.cancelled.set()
        self.spark.sparkContext.cancelJobsWithTag(self._tag)
        return True

    def wait(self, seconds: float | None = None) -> None:
        if self._thread is not None:
            self._thread.join(seconds)

    def _tasks(self) -> tuple[int, int]:
        """Tasks done and in all over the active stages of this job."""
        if not self.running():
            return 0, 0
        tracker = self.spark.sparkContext.statusTracker()
        jobs = map(tracker.getJobInfo, self.spark.sparkContext._jsc.sc().statusTracker().getJobIdsForTag(self._tag))
        active = set(tracker.getActiveStageIds())
        stages = [s for j in jobs if j for k in j.stageIds if k in active and (s := tracker.getStageInfo(k))]
        return sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages)

    def progress(self) -> dict:
        """The phase, what is done of it in documents and in Spark tasks, and how the job stands."""
        tasks, of = self._tasks()
        return {"running": self.running(), "phase": self.phase, "done": self.done, "total": self.total, "tasks_done": tasks, "tasks": of, "cancelled": self.cancelled.is_set(), "error": self.error, "summary": self.result}
