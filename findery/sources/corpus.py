"""A folder tree as a table of files, or as a stream of them, through Spark's Python data source interface.

Filters on the columns reach the walk: folders that cannot hold a file asked for are never opened. A stream gives out
each file once for every time that it appears or changes.
"""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from findery.schema import FILES

#: Partitions that a walk is cut into, if the tree has as many folders.
WALKS = 64
#: Seconds that a change must be old before a stream gives it out: more than clocks of disks and driver differ.
SETTLE = 1.0
TREE = f"{FILES}, top_folder string, file_ext string, junk boolean"
_EXT = re.compile(r"(?<=.)\.[^.]+$")
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_OPS = {D.EqualTo: "=", D.In: "in", D.StringStartsWith: "starts", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<="}


def _holds(value, op: str, wanted) -> bool:
    if op == "=":
        return value == wanted
    if op == "in":
        return value in wanted
    if op == "starts":
        return value.startswith(wanted)
    return {">": value > wanted, ">=": value >= wanted, "<": value < wanted, "<=": value <= wanted}[op]


@dataclass(frozen=True)
class Test:
    """A condition on one column of a file."""

    column: str
    op: str
    wanted: object

    def may_hold_below(self, folder: str) -> bool:
        """Whether a file below ``folder`` (its path under the root) may pass."""
        if self.column == "top_folder":
            return _holds(folder.split("/")[0], self.op, self.wanted)
        if self.column != "file_path" or self.op not in ("=", "in", "starts"):
            return True
        start = f"{folder}/"
        wanted = self.wanted if self.op == "in" else [self.wanted]
        return any(w.startswith(start) or (self.op == "starts" and start.startswith(w)) for w in wanted)


_COLUMNS = {c.split()[0] for c in TREE.split(", ")}


def _test(given: D.Filter) -> Test | None:
    """The condition that a filter states, if the walk can apply it."""
    if isinstance(given, D.Not) and isinstance(given.child, D.EqualTo) and given.child.attribute == ("junk",):
        return Test("junk", "=", not given.child.value)
    op = _OPS.get(type(given))
    if op is None or len(given.attribute) != 1 or given.attribute[0] not in _COLUMNS or given.value is None:
        return None
    value = tuple(v for v in given.value if v is not None) if op == "in" else given.value
    return Test(given.attribute[0], op, value)


def _is_junk(name: str) -> bool:
    return name.lower() in ("desktop.ini", "thumbs.db") or name.startswith(("~$", "."))


class _Folders(D.InputPartition):
    """Folders to walk, with what lies below or without; for streams with the span of change times."""

    def __init__(self, paths: list[str], deep: bool, since: int = 0, until: int = 0):
        self.paths, self.deep, self.since, self.until = paths, deep, since, until


@dataclass
class _Walker:
    root: str
    tests: list[Test]

    def rel(self, path: str) -> str:
        return os.path.relpath(path, self.root)

    def opens(self, path: str) -> bool:
        rel = self.rel(path)
        return rel == "." or all(t.may_hold_below(rel) for t in self.tests)

    def below(self, path: str) -> list[str]:
        """The folders in a folder that are to be opened."""
        with os.scandir(path) as found:
            inner = sorted(e.path for e in found if e.is_dir(follow_symlinks=False))
        return [p for p in inner if self.opens(p)]

    def deal(self, top: str, walks: int) -> list[tuple[list[str], bool]]:
        """``(folders, deep)``: listed level by level until there are enough to deal out; those listed are read without what lies below."""
        listed, level = [], [top]
        while level and len(level) < walks:
            listed, level = listed + level, [p for path in level for p in self.below(path)]
        size = max(1, -(-len(level) // (4 * walks)))
        return [*(([p], False) for p in listed), *((level[k : k + size], True) for k in range(0, len(level), size))]

    def folders(self, part: _Folders) -> Iterator[tuple[str, list[str], list[str]]]:
        """``(folder, folders in it that stay closed, names)`` of every folder opened."""
        for top in part.paths:
            for folder, inner, names in os.walk(top):
                closed = [x for x in inner if not self.opens(os.path.join(folder, x))]
                inner[:] = [x for x in inner if x not in set(closed)] if part.deep else []
                yield folder, closed, names

    def files(self, part: _Folders) -> Iterator[tuple[tuple, os.stat_result]]:
        """Rows of ``TREE`` that pass all tests, each with what the disk says of it."""
        for folder, _, names in self.folders(part):
            for name in names:
                path = os.path.join(folder, name)
                try:
                    stat = os.stat(path)
                except FileNotFoundError:  # gone since it was listed, or a link to nothing
                    continue
                rel = self.rel(path)
                ext = _EXT.search(name)
                row = {"file_path": rel, "mtime": stat.st_mtime, "size": stat.st_size, "top_folder": rel.split("/")[0], "file_ext": ext.group().lower() if ext else "", "junk": _is_junk(name)}
                if all(_holds(row[t.column], t.op, t.wanted) for t in self.tests):
                    yield tuple(row.values()), stat


class _Walk(D.DataSourceReader):
    def __init__(self, root: str, kind: str, walks: int, tests: list[Test]):
        self.walker, self.kind, self.walks = _Walker(root, tests), kind, walks

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for given in filters:
            test = _test(given) if self.kind == "files" else None
            if test is not None:
                self.walker.tests.append(test)
            elif not (self.kind == "files" and isinstance(given, D.IsNotNull)):  # no column is ever null
                yield given

    def partitions(self) -> list[D.InputPartition]:
        return [_Folders(paths, deep) for paths, deep in self.walker.deal(self.walker.root, self.walks)]

    def read(self, partition: _Folders) -> Iterator[tuple]:
        walker = self.walker
        if self.kind == "files":
            for row, _ in walker.files(partition):
                yield row
            return
        for folder, closed, names in walker.folders(partition):
            if self.kind == "visits":
                yield (walker.rel(folder), True, len(names))
                yield from ((walker.rel(os.path.join(folder, x)), False, None) for x in closed)
            elif (rel := walker.rel(folder)) != ".":
                yield (rel,)


class _Changes(D.DataSourceStreamReader):
    """Files by the time of their last change, as the disk's inodes have it: it cannot be set back, unlike the time of modification.

    The offset names, for each folder at the root and for the root's own files, the inode and the time up to which changes
    have been given out. So a folder that is moved in comes with all its files, however old these are.
    A folder that is moved to a deeper place brings files whose own change is old; these do not arrive.
    """

    def __init__(self, root: str, walks: int, settle: float):
        self.walker, self.walks, self.settle = _Walker(root, []), walks, settle

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        until = time.time_ns() - int(self.settle * 1e9)
        tops = [self.walker.root, *self.walker.below(self.walker.root)]
        return {self.walker.rel(p): {"inode": os.stat(p).st_ino, "until": until} for p in tops}

    def partitions(self, start: dict, end: dict) -> list[D.InputPartition]:
        out, each = [], max(1, self.walks // max(1, len(end)))
        for name, now in end.items():
            was = start.get(name)
            since = was["until"] if was and was["inode"] == now["inode"] else -1
            path = os.path.normpath(os.path.join(self.walker.root, name))
            if since >= now["until"] or not os.path.isdir(path):
                continue
            dealt = [([path], False)] if name == "." else self.walker.deal(path, each)
            out += [_Folders(paths, deep, since, now["until"]) for paths, deep in dealt]
        return out

    def read(self, partition: _Folders) -> Iterator[tuple]:
        seen_at = datetime.fromtimestamp(partition.until / 1e9, timezone.utc).isoformat()
        for row, stat in self.walker.files(partition):
            if partition.since < stat.st_ctime_ns <= partition.until:
                yield (*row, seen_at)

    def commit(self, end: dict) -> None:
        """Nothing is held for offsets that are done: the offset alone says what comes next."""


class FolderSource(D.DataSource):
    """Options: ``path``; ``kind`` = files, folders, or visits (folders met, and whether they were opened); ``walks``, the partitions to aim at; ``tests``, conditions as JSON; ``settle`` for streams."""

    @classmethod
    def name(cls) -> str:
        return "findery_folder"

    def _kind(self) -> str:
        return self.options.get("kind", "files")

    def _walks(self) -> int:
        return int(self.options.get("walks", WALKS))

    def schema(self) -> str:
        return {"files": TREE, "changes": f"{TREE}, seen_at string", "folders": "dir_path string", "visits": "dir_path string, opened boolean, files long"}[self._kind()]

    def reader(self, schema) -> D.DataSourceReader:
        tests = [Test(c, op, tuple(w) if op == "in" else w) for c, op, w in json.loads(self.options.get("tests", "[]"))]
        return _Walk(self.options["path"], self._kind(), self._walks(), tests)

    def streamReader(self, schema) -> D.DataSourceStreamReader:
        return _Changes(self.options["path"], self._walks(), float(self.options.get("settle", SETTLE)))


def _registered(spark: SparkSession) -> SparkSession:
    """The session, once it knows the source and hands filters to it, without which Spark refuses sources that take any."""
    spark.dataSource.register(FolderSource)
    spark.conf.set(_PUSHDOWN, "true")
    return spark


def _sealed(files: DataFrame) -> DataFrame:
    """The same rows, in columns through which no further filter reaches the source.

    Spark 4.1 makes one reader for all scans of a loaded frame, with the filters of the scan that was planned last, so frames
    that differ in the filters that reach the walk must not come from one load.
    """
    text = lambda c: F.concat(c.cast("string"), F.lit(""))
    as_it_is = {"string": text, "boolean": lambda c: text(c) == "true", "double": lambda c: c + F.lit(0.0), "bigint": lambda c: c + F.lit(0)}
    return files.select(*(as_it_is[kind](F.col(name)).alias(name) for name, kind in files.dtypes))


def read_tree(spark: SparkSession, root: str, where: Column | str | None = None, walks: int = WALKS) -> DataFrame:
    """The columns ``TREE`` of every file below ``root`` for which ``where`` holds, junk included.

    Comparisons of ``where`` with constants reach the walk; what is filtered afterwards does not.
    """
    files = _registered(spark).read.format("findery_folder").option("path", os.path.abspath(root)).option("walks", walks).load()
    return _sealed(files if where is None else files.where(where))


def read_files(spark: SparkSession, root: str, junk: bool = False, walks: int = WALKS, extensions: Sequence[str] | None = None, folders: Sequence[str] | None = None, since: float | None = None) -> DataFrame:
    """``(file_path, mtime, size)`` of every file below ``root``, empty and hidden folders' ones included, without junk files.

    With ``extensions`` only of these (the empty one for none), with ``folders`` only of top folders that begin with one of them in
    any case, with ``since`` only those modified then or later. Other folders are not opened.
    """
    keep = F.lit(True) if junk else ~F.col("junk")
    if extensions is not None:
        keep = keep & F.col("file_ext").isin(*(e.lower() for e in extensions))
    if folders is not None:
        starts = tuple(p for p in (x.strip().lower() for x in folders) if p)
        keep = keep & F.col("top_folder").isin(*(n for n in os.listdir(root) if starts and n.lower().startswith(starts)))
    if since is not None:
        keep = keep & (F.col("mtime") >= float(since))
    return read_tree(spark, root, keep, walks).select("file_path", "mtime", "size")


def read_folders(spark: SparkSession, root: str) -> DataFrame:
    """``(dir_path)`` of every folder below ``root``."""
    return _registered(spark).read.format("findery_folder").option("path", os.path.abspath(root)).option("kind", "folders").load()


def visits(spark: SparkSession, root: str, tests: Sequence[Test], walks: int = WALKS) -> DataFrame:
    """``(dir_path, opened, files)``: the folders that a walk for files which pass ``tests`` meets, and those it leaves closed."""
    stated = json.dumps([(t.column, t.op, t.wanted) for t in tests])
    return _registered(spark).read.format("findery_folder").option("path", os.path.abspath(root)).option("kind", "visits").option("walks", walks).option("tests", stated).load()


def stream_files(spark: SparkSession, root: str, junk: bool = False, walks: int = WALKS, settle: float = SETTLE) -> DataFrame:
    """A stream of ``(file_path, mtime, size, seen_at)``: each file below ``root`` once for every time that it appears or changes.

    A batch holds the changes up to ``settle`` seconds before it began; executors list the folders, the driver only those at the root.
    """
    files = _registered(spark).readStream.format("findery_folder").option("path", os.path.abspath(root)).option("kind", "changes").option("walks", walks).option("settle", settle).load()
    return (files if junk else files.where(~F.col("junk"))).select("file_path", "mtime", "size", "seen_at")
