"""JSON logs: plain appends, and entries that become visible together with the version of the index they tell of.

``append`` adds rows at once. For entries that must neither be lost nor doubled when a process dies, ``stage``
writes them under a key into a hidden folder, through a data source whose commit keeps just the files of tasks that
succeeded, and ``release`` shows them by renaming that folder. A key is shown once, however often it is
released. Whoever publishes a version between the two steps records the key with it, so that ``settle`` can
later finish or drop what a process that died has left (see ``findery.jobs``). Renaming a folder is atomic on HDFS and local
disks; on an object store it is not.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Collection, Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from findery import schema

#: Folders that readers of a log skip: entries under way, and entries that wait for their version.
WRITING, READY = "_writing", "_ready"


def _folder(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def _exists(files: pafs.FileSystem, path: str) -> bool:
    return files.get_file_info(path).type != pafs.FileType.NotFound


@dataclass
class _Wrote(WriterCommitMessage):
    name: str


class _LogWriter(DataSourceWriter):
    """Each task writes a file of its own; commit leaves those of the tasks that count, and moves them to the entries that wait."""

    def __init__(self, path: str, key: str):
        self.path, self.key = path, key

    def write(self, iterator: Iterator) -> _Wrote:
        files, root = _folder(self.path)
        name = f"{uuid.uuid4().hex}.json"
        files.create_dir(f"{root}/{WRITING}/{self.key}", recursive=True)
        with files.open_output_stream(f"{root}/{WRITING}/{self.key}/{name}") as out:
            for row in iterator:
                out.write(json.dumps(row.asDict(recursive=True), ensure_ascii=False).encode() + b"\n")
        return _Wrote(name)

    def commit(self, messages: list[_Wrote | None]) -> None:
        files, root = _folder(self.path)
        at, ready = f"{root}/{WRITING}/{self.key}", f"{root}/{READY}/{self.key}"
        if _exists(files, ready) or _exists(files, f"{root}/{self.key}"):  # staged before
            self.abort(messages)
            return
        files.create_dir(at, recursive=True)
        kept = {m.name for m in messages if m is not None}
        for found in files.get_file_info(pafs.FileSelector(at)):
            if found.base_name not in kept:
                files.delete_file(found.path)
        files.create_dir(f"{root}/{READY}", recursive=True)
        files.move(at, ready)

    def abort(self, messages: list[_Wrote | None]) -> None:
        files, root = _folder(self.path)
        if _exists(files, at := f"{root}/{WRITING}/{self.key}"):
            files.delete_dir(at)


class LogSink(DataSource):
    """Options: ``path`` of the log, ``key`` of the entries."""

    @classmethod
    def name(cls) -> str:
        return "findery_log"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _LogWriter(self.options["path"], self.options["key"])


def stage(rows: DataFrame, path: str, key: str) -> None:
    """Write ``rows`` so that ``release`` can show them all; nothing if ``key`` was staged before."""
    rows.sparkSession.dataSource.register(LogSink)
    rows.write.format("findery_log").mode("append").option("path", path).option("key", key).save()


def release(path: str, key: str) -> None:
    """Show the entries staged under ``key``; nothing if they are shown already or were never staged."""
    files, root = _folder(path)
    if _exists(files, f"{root}/{READY}/{key}") and not _exists(files, f"{root}/{key}"):
        files.move(f"{root}/{READY}/{key}", f"{root}/{key}")


def put(rows: DataFrame, path: str, key: str) -> None:
    """Add ``rows`` once: nothing if ``key`` is there already."""
    if not has(path, key):
        stage(rows, path, key)
        release(path, key)


def has(path: str, key: str) -> bool:
    files, root = _folder(path)
    return _exists(files, f"{root}/{key}")


def waiting(path: str) -> list[str]:
    """Keys of the entries that are staged but not shown."""
    files, root = _folder(path)
    if not _exists(files, f"{root}/{READY}"):
        return []
    return [f.base_name for f in files.get_file_info(pafs.FileSelector(f"{root}/{READY}"))]


def settle(path: str, published: Collection[str], lost: Collection[str] = ()) -> None:
    """Show the waiting entries whose key is ``published`` and delete those that are ``lost``; others keep waiting."""
    files, root = _folder(path)
    for key in waiting(path):
        if key in published:
            release(path, key)
        elif key in lost:
            files.delete_dir(f"{root}/{READY}/{key}")


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """The log at ``path`` (one JSON object a line, blank lines skipped); empty if nothing was logged yet."""
    try:
        return spark.read.schema(ddl).option("recursiveFileLookup", "true").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], ddl)


def read_stream(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.readStream.schema(ddl).option("recursiveFileLookup", "true").json(path)


def review_queue(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, path, schema.REVIEW_QUEUE)


def index_runs(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, path, schema.INDEX_RUNS)


def feedback(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, path, schema.FEEDBACK)
