"""WARC archives with a two-level capture index.

Records are written as members of gzip files in the shared folder. The index sorts captures by
reversed-host URL key into compressed blocks, and a sparse directory keeps each block's first key. A
look-up binary-searches the directory, reads one block's byte range, binary-searches its lines, and then
reads the record's byte range. The directory is bounded: blocks grow with the corpus.
"""

from __future__ import annotations

import json
import uuid
import zlib
from bisect import bisect_left
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch_path, slices

#: Payloads of fewer bytes are stored again rather than referred to.
MIN_REVISIT_BYTES = 100
#: Size after which a task starts another archive, captures in an index block at least, and blocks at most.
FILE_BYTES, BLOCK_LINES, MAX_BLOCKS = 1 << 30, 1000, 1 << 16
#: Bytes of an archive whose records one group reads back.
SPAN_BYTES = 64 << 20
LEVEL = 4
WARC_DATE = "2024-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """Sort key with the host's labels reversed: ``http://www.a.org/x?y`` gives ``org,a,www)/x?y``.

    Scheme, user, port and fragment are left out and the host is lower-cased; an url without a host is
    its own key, and null is the empty key. Control characters and spaces are percent-encoded.
    """
    text = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in (url or "").strip())
    try:
        parts = urlsplit(text)
        host = parts.hostname
    except ValueError:
        return text
    if not host:
        return text
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def _filesystem(path: str):
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _page_uri(page_id: int | None) -> str:
    return "<urn:findery:page:%s>" % ("none" if page_id is None else page_id)


def _page_id(uri: str) -> int | None:
    last = uri.rstrip(">").rpartition(":")[2]
    return None if last == "none" else int(last)


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit (``refers_to`` given) keeps the HTTP header of the capture and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if refers_to is not None else http + payload
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in (url or "").strip())
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_page_uri(page_id)}", f"WARC-Date: {WARC_DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if target:
        head.append(f"WARC-Target-URI: {target}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_page_uri(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """``page_id, url, record_type, digest, size, refers_to, payload`` of one record; payload is None for a revisit."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line[15:]) for line in http.split(b"\r\n") if line.startswith(b"Content-Length:"))
    kind = fields["WARC-Type"]
    refers = fields.get("WARC-Refers-To")
    return {"page_id": _page_id(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": kind, "digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"), "size": size, "refers_to": _page_id(refers) if refers else None, "payload": payload if kind == "response" else None}


@dataclass(frozen=True)
class Archive:
    """``captures`` (page_id, url, key, file, offset, length) and ``directory`` (first, file, offset, length, lines)."""

    folder: str
    captures: DataFrame
    directory: DataFrame


def write(pages: DataFrame, folder: str | None = None) -> Archive:
    """Write a record per row of ``pages`` (``page_id, url, html``) below ``folder``, and the index.

    Null html is an empty payload. Of equal payloads of ``MIN_REVISIT_BYTES`` or more, rows with the
    smallest page_id are responses and the others revisits of it; rows with a null id are responses. A repeated
    id is settled for each of its payloads apart. An empty table gives an empty archive; other columns are
    ignored, whatever their names. Files have names of their own per attempt, so a lost or repeated task
    leaves at most files nobody refers to.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    src = src.withColumn("digest", F.sha2("payload", 256))
    sizes = src.select("page_id", F.length("payload").alias("size"), "digest").where(f"size >= {MIN_REVISIT_BYTES} and page_id is not null")
    firsts = sizes.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last")
    revisits = sizes.join(firsts, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()
    joined = src.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")

    def run(batches):
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for part in slices(batches, 256):
            rows = []
            for page, url, payload, digest, refers in zip(*(c.to_pylist() for c in part.columns), strict=True):
                raw = zlib_member(record(page, url, payload, len(payload), digest, refers))
                if out is None or at + len(raw) > FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"records-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                out.write(raw)
                rows.append((page, url, url_key(url), name, at, len(raw)))
                at += len(raw)
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["page_id", "url", "key", "file", "offset", "length"])
        if out is not None:
            out.close()

    captures = materialize(joined.mapInArrow(run, "page_id long, url string, key string, file string, offset long, length long"), "captures")
    return Archive(folder, captures, _index(captures, folder))


def zlib_member(raw: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


_DIRECTORY = pa.schema([("first", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("lines", pa.int32())])


def _index(captures: DataFrame, folder: str) -> DataFrame:
    lines_each = max(BLOCK_LINES, -(-captures.count() // MAX_BLOCKS))

    def run(batches):
        fs, root = _filesystem(folder)
        held: list[str] = []
        name, at, out = f"index-{uuid.uuid4().hex}.cdx.gz", 0, None

        def flush():
            nonlocal at, out, held
            out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
            raw = zlib_member("\n".join(held).encode())
            out.write(raw)
            row = pa.RecordBatch.from_pylist([{"first": held[0].partition("\t")[0], "file": name, "offset": at, "length": len(raw), "lines": len(held)}], schema=_DIRECTORY)
            at, held = at + len(raw), []
            return row

        for part in slices(batches):
            held += part.column(0).to_pylist()
            while len(held) >= lines_each:
                rest, held = held[lines_each:], held[:lines_each]
                yield flush()
                held = rest
        if held:
            yield flush()
        if out is not None:
            out.close()

    page = F.when(F.col("page_id").isNull(), "").otherwise(F.lpad((F.col("page_id").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0"))
    key = F.concat_ws(" ", "key", page, "file", F.format_string("%012d", "offset"))
    line = F.concat_ws("\t", key, F.to_json(F.struct("page_id", "url", "file", "offset", "length")))
    sorted_ = captures.select(key.alias("position"), line.alias("line")).repartitionByRange("position").sortWithinPartitions("position").select("line")
    return materialize(sorted_.mapInArrow(run, "first string, file string, offset long, length long, lines int"), "directory")


def lookup(archive: Archive, wanted: DataFrame) -> DataFrame:
    """Captures ``(page_id, url, file, offset, length)`` of the rows ``(page_id, url)`` of ``wanted``, through the index.

    A query's position is searched in the directory (at most ``MAX_BLOCKS`` keys), queries meet at their
    block, and each block is read once per group of queries by its byte range. An unknown url or page gives
    no row; a page captured more than once from one url gives a row per capture, repeated queries give no more.
    """
    rows = sorted(archive.directory.select("first", "file", "offset", "length").collect(), key=lambda r: r["first"].encode())
    if not rows:
        return archive.captures.select("page_id", "url", "file", "offset", "length").limit(0)
    folder = archive.folder
    firsts = [r["first"].encode() for r in rows]
    shared = wanted.sparkSession.sparkContext.broadcast((firsts, [(r.file, r.offset, r.length) for r in rows]))

    def find(batches):
        firsts, _ = shared.value
        for part in slices(batches):
            out = []
            for page, url in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                lo = f"{url_key(url)} {'' if page is None else format(page + (1 << 63), '020d')} ".encode()
                # captures of one page may run over a block's end
                a, b = max(0, bisect_left(firsts, lo) - 1), bisect_left(firsts, lo + b"\xff")
                out += [{"block": k, "position": lo, "url": url} for k in range(a, max(b, a + 1))]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("block", pa.int32()), ("position", pa.binary()), ("url", pa.string())]))

    def read(batches):
        fs, root = _filesystem(folder)
        _, places = shared.value
        block, keys, lines, handle, open_name = None, [], [], None, None
        for part in slices(batches):
            out = []
            for k, lo, url in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if k != block:
                    name, offset, length = places[k]
                    if name != open_name:
                        handle, open_name = fs.open_input_file(f"{root}/{name}"), name
                    text = zlib.decompress(handle.read_at(length, offset), 31)
                    lines = text.split(b"\n")
                    keys, block = [x.partition(b"\t")[0] for x in lines], k
                at = bisect_left(keys, lo)
                while at < len(keys) and keys[at].startswith(lo):
                    capture = json.loads(lines[at].partition(b"\t")[2])
                    if capture.setdefault("url") == url:  # urls that differ may have one key
                        out.append(capture)
                    at += 1
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

    # queries of one block are dealt to up to 8 tasks, each of which reads the block's range once
    hits = wanted.select(F.col("page_id").cast("long"), F.col("url").cast("string")).distinct().mapInArrow(find, "block int, position binary, url string")
    dealt = hits.repartition(F.col("block"), F.pmod(F.xxhash64("position"), F.lit(8))).sortWithinPartitions("block")
    return dealt.mapInArrow(read, "page_id long, url string, file string, offset long, length long")


def read_records(archive: Archive, places: DataFrame) -> DataFrame:
    """Fetch and parse the records at ``places`` (``file, offset, length``): ``page_id, url, record_type, digest, size, refers_to, payload``.

    Places of one span of a file meet in a task in order, so archives are read forward.
    """
    folder = archive.folder

    def run(batches):
        fs, root = _filesystem(folder)
        open_name, handle = None, None
        for part in slices(batches, 64):
            out = []
            for name, offset, length in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if name != open_name:
                    handle, open_name = fs.open_input_file(f"{root}/{name}"), name
                out.append(parse(zlib.decompress(handle.read_at(length, offset), 31)))
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("digest", pa.string()), ("size", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())]))

    dealt = places.select("file", "offset", "length").repartition(F.col("file"), F.floor(F.col("offset") / SPAN_BYTES)).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, "page_id long, url string, record_type string, digest string, size long, refers_to long, payload binary")


def read_back(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages``, look every page up in the index and read its record: one row per row of ``pages``.

    Repeated rows, repeated ids with other urls or payloads, and null ids, urls and html all come back.
    """
    archive = write(pages, folder)
    return read_records(archive, lookup(archive, pages.select("page_id", "url")))
