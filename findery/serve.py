"""A small service over a store, with JSON routes and two plain pages; only the standard library is needed."""

from __future__ import annotations

import json
import mimetypes
import os
import shutil
import subprocess
from collections.abc import Callable
from datetime import datetime, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import SparkSession

from findery import schema
from findery.config import Config
from findery.jobs import Busy, Jobs, deep_scan, index
from findery.operators import extract, facets, feedback, rerank, search
from findery.sources import corpus, documents, logs
from findery.sources.store import Store

#: Records that a deep scan publishes at a time, so that it can be stopped in between.
SCAN_CHUNK = 500

_PAGE = """<!doctype html><meta charset="utf-8"><title>findery</title>
<form onsubmit="ask(event)"><input id="q" size="60" autofocus> <select id="s"><option>relevance<option>newest<option>file_type</select> <button>Search</button></form>
<p id="n"></p><ol id="r"></ol>
<script>
async function ask(e) {
  e.preventDefault()
  const a = await (await fetch("/search", {method: "POST", body: JSON.stringify({query: q.value, sort_by: s.value})})).json()
  n.textContent = a.error || `${a.candidate_count ?? 0} candidates${a.ambiguous ? ", ambiguous" : ""}`
  r.replaceChildren(...(a.results || []).map(x => {
    const li = document.createElement("li"), link = document.createElement("a"), why = document.createElement("div")
    link.textContent = x.file_path; link.href = "/file/" + x.doc_id; why.textContent = x.justification
    li.append(x.direct_open ? link : x.file_path, why)
    return li
  }))
}
</script>"""

_INDEX_PAGE = """<!doctype html><meta charset="utf-8"><title>findery: index</title>
<form onsubmit="go(event)"><input id="root" size="60" placeholder="folder"> <label><input type="checkbox" id="anew">rebuild</label> <button>Index</button></form>
<button onclick="post('/deep-scan')">Deep scan</button> <button onclick="post('/index-documents/cancel');post('/deep-scan/cancel')">Cancel</button><pre id="p"></pre>
<script>
const post = (to, body) => fetch(to, {method: "POST", body: JSON.stringify(body || {})})
function go(e) { e.preventDefault(); post("/index-documents/start", {corpus_root: root.value, rebuild: anew.checked}) }
setInterval(async () => { p.textContent = JSON.stringify([await (await fetch("/index-documents/progress")).json(), await (await fetch("/deep-scan/progress")).json()], null, 1) }, 1000)
</script>"""


class Raw:
    """A reply that is no JSON: bytes, or the path of a file."""

    def __init__(self, kind: str, body: bytes = b"", path: str | None = None):
        self.kind, self.body, self.path = kind, body, path


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


def reveal(path: str) -> bool:
    """Open the file manager of this machine at a file; false if it has none."""
    command = shutil.which("open") or shutil.which("xdg-open")
    if command is None:
        return False
    subprocess.Popen([command, "-R", path] if command.endswith("/open") else [command, os.path.dirname(path)])
    return True


class Service:
    """Routes as methods: each takes the request's fields and returns a status and a value."""

    def __init__(self, spark: SparkSession, store: Store, log_dir: str, corpus_root: str | None = None, config: Config | None = None, reader: Callable[[str], extract.Reader] = documents.FolderReader, ocr: extract.OcrBackend | None = None, backend: rerank.Backend | None = None, revealer: Callable[[str], bool] = reveal):
        self.spark, self.store, self.log_dir, self.root = spark, store, log_dir, corpus_root
        self.config = config or Config()
        self.indexing, self.scanning = Jobs(spark), Jobs(spark)
        self.reader, self.ocr, self.revealer = reader, ocr or documents.ocr_backend(), revealer
        self.backend = backend or rerank.backend_for(self.config.rerank)
        self.routes = {
            ("GET", "/healthz"): lambda _: (200, {"status": "ok"}),
            ("GET", "/"): lambda _: (200, Raw("text/html; charset=utf-8", _PAGE.encode())),
            ("GET", "/facets"): self.facets,
            ("GET", "/review-queue"): self.review_queue,
            ("GET", "/runs"): self.runs,
            ("POST", "/search"): self.search,
            ("POST", "/feedback"): self.feedback,
            ("GET", "/index-documents"): self.index_documents,
            ("POST", "/index-documents"): self.index_now,
            ("POST", "/index-documents/start"): self.index,
            ("GET", "/index-documents/progress"): lambda _: (200, self.indexing.progress()),
            ("POST", "/index-documents/cancel"): lambda _: self._cancel(self.indexing),
            ("POST", "/deep-scan"): self.deep_scan,
            ("GET", "/deep-scan/progress"): lambda _: (200, self.scanning.progress()),
            ("POST", "/deep-scan/cancel"): lambda _: self._cancel(self.scanning),
        }

    # ---- reading ----

    def facets(self, f):
        """A page of each list of facet values, and the number of pending records."""
        records = self.store.records()
        offset = int(f.get("offset") or 0)
        rows = {"extensions": facets.extensions(records), "folders": facets.folders(records)}
        return 200, {k: [list(r) for r in facets.page(v, offset).collect()] for k, v in rows.items()} | {"pending": facets.pending(records).first().pending}

    def review_queue(self, f):
        """The entries, the oldest first: all from ``offset`` on, or a page of at most ``limit``."""
        entries = logs.review_queue(self.spark, f"{self.log_dir}/review_queue").orderBy("timestamp", "file_path")
        offset = int(f.get("offset") or 0)
        shown = facets.page(entries, offset, int(f["limit"])) if f.get("limit") else entries.offset(max(0, offset))
        return 200, [r.asDict() for r in shown.collect()]

    def runs(self, _):
        return 200, [r.asDict() for r in facets.recent_runs(logs.index_runs(self.spark, f"{self.log_dir}/index_runs")).collect()]

    def search(self, f):
        text = str(f.get("query", "")).strip()
        if not text:
            return 200, {"results": []}
        folders = [x for x in f.get("folders") or [] if x.strip()]
        top, order = search.clamp_top(f.get("top_n")), search.clamp_sort(f.get("sort_by"))
        with self.store.cached_index() as index:
            if index is None:
                return 409, {"error": "nothing is indexed yet"}
            got = search.search_one(text, index, self.config.rules, self.config.ranking, top, order, f.get("extensions") or None, folders or None, self.backend)
        opened = self.config.extraction.direct_open_extensions
        shown = [{k: r[k] for k in ("display_rank", "doc_id", "file_path", "score", "justification", "indexed_at")} | {"direct_open": r["file_ext"] in opened} for r in got.rows]
        return 200, got.payload() | {"results": shown, "top_doc_ids": [r["doc_id"] for r in got.rows], "scores": [r["score"] for r in got.rows]}

    def _path(self, doc_id: str) -> tuple[int, str]:
        """Status and path of a document, or what is wrong."""
        now = self.store.snapshot()
        root = self.root or now.corpus_root
        try:
            record = now.record(doc_id)
        except KeyError:
            return 404, "no such document"
        if root is None:
            return 500, "the corpus root is unknown"
        path = os.path.join(root, record.file_path)
        return (200, path) if os.path.isfile(path) else (404, "the file is gone")

    def file(self, doc_id: str):
        status, path = self._path(doc_id)
        return (status, {"error": path}) if status != 200 else (200, Raw(mimetypes.guess_type(path)[0] or "application/octet-stream", path=path))

    def reveal(self, doc_id: str):
        status, path = self._path(doc_id)
        if status != 200:
            return status, {"error": path}
        return (200, {"status": "ok"}) if self.revealer(path) else (501, {"status": "unsupported"})

    # ---- writing ----

    def feedback(self, f):
        if not {"query", "correct"} <= f.keys():
            return 400, {"error": "query and correct are needed"}
        row = (_now(), f["query"], f.get("top_doc_ids", []), [float(x) for x in f.get("scores", [])], bool(f.get("ambiguous")), bool(f.get("used_llm_rerank")), f.get("chosen_doc_id") or f.get("doc_id"), bool(f["correct"]))
        logs.append(self.spark.createDataFrame([row], schema.FEEDBACK), f"{self.log_dir}/feedback")
        return 200, {"status": "ok"}

    def index_documents(self, f):
        """The page for indexing, or with ``json`` what it shows."""
        if "json" not in f:
            return 200, Raw("text/html; charset=utf-8", _INDEX_PAGE.encode())
        now = self.store.snapshot()
        return 200, {"corpus_root": self.root or now.corpus_root, "last_indexed": now.built_at, "pending": facets.pending(now.records()).first().pending, "runs": self.runs(f)[1]}

    def _index_work(self, root: str, rebuild: bool, **follow) -> dict:
        row = index(self.store, self.log_dir, corpus.read_files(self.spark, root), root, self.config, _now(), rebuild=rebuild, **follow)
        self.root = root
        return row.asDict() | {"pending": facets.pending(self.store.records()).first().pending}

    def _root_of(self, f) -> str | None:
        root = os.path.expanduser(str(f.get("corpus_root") or self.root or ""))
        return os.path.abspath(root) if os.path.isdir(root) else None

    def index_now(self, f):
        if (root := self._root_of(f)) is None:
            return 400, {"error": "corpus_root is no folder on this machine"}
        return 200, self._index_work(root, bool(f.get("rebuild")))

    def index(self, f):
        if (root := self._root_of(f)) is None:
            return 400, {"error": "corpus_root is no folder on this machine"}
        jobs = self.indexing
        return self._start(jobs, lambda: self._index_work(root, bool(f.get("rebuild")), phase=jobs.enter, progress=jobs.count, should_stop=jobs.cancelled.is_set))

    def deep_scan(self, _):
        if (root := self.root or self.store.snapshot().corpus_root) is None:
            return 400, {"error": "index a folder first"}
        jobs = self.scanning

        def work():
            jobs.enter("scanning")
            return deep_scan(self.store, self.log_dir, self.reader(root), self.ocr, self.config, _now(), SCAN_CHUNK, jobs.cancelled.is_set, jobs.count)

        return self._start(jobs, work)

    def _start(self, jobs: Jobs, work: Callable[[], object]):
        if any(j.running() for j in (self.indexing, self.scanning) if j is not jobs):
            return 409, {"error": "another job is running"}
        try:
            jobs.start(work)
        except Busy:
            return 409, {"error": "a job is running"}
        return 202, {"status": "started"}

    def _cancel(self, jobs: Jobs):
        return (200, {"status": "cancel_requested"}) if jobs.cancel() else (409, {"status": "not_running"})

    def answer(self, method: str, path: str, fields: dict) -> tuple[int, object]:
        route = self.routes.get((method, path))
        if route is not None:
            return route(fields)
        start, _, last = path.rpartition("/")
        by_id = {("GET", "/file"): self.file, ("POST", "/reveal"): self.reveal}.get((method, start))
        return by_id(unquote(last)) if by_id and last else (404, {"error": "no such route"})


def serve(service: Service, port: int = 8765) -> ThreadingHTTPServer:
    """A server on the local interface; the caller runs ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self, method):
            url = urlsplit(self.path)
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                fields = json.loads(body) if body else {k: v[-1] for k, v in parse_qs(url.query, keep_blank_values=True).items()}
                status, value = service.answer(method, url.path, fields)
            except ValueError as e:
                status, value = 400, {"error": str(e)}
            if not isinstance(value, Raw):
                value = Raw("application/json; charset=utf-8", json.dumps(value, ensure_ascii=False).encode())
            size = len(value.body) if value.path is None else os.path.getsize(value.path)
            self.send_response(status)
            self.send_header("Content-Type", value.kind)
            self.send_header("Content-Length", str(size))
            self.end_headers()
            if value.path is None:
                self.wfile.write(value.body)
            else:
                with open(value.path, "rb") as f:
                    shutil.copyfileobj(f, self.wfile)

        def do_GET(self):
            self._reply("GET")

        def do_POST(self):
            self._reply("POST")

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
