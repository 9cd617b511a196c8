"""Command line: index, deep-scan, search, serve, review-queue, facets, suggest-tuning, suggest-projects, vacuum."""

from __future__ import annotations

import argparse
import importlib
import json
import os
import signal
import sys
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import replace
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from findery import schema
from findery.config import Config, load_config
from findery.jobs import deep_scan, index
from findery.operators import facets, feedback, records, rerank, search
from findery.sources import corpus, documents, logs
from findery.sources.store import Store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="findery")
    p.add_argument("--index-dir", default="data/index")
    p.add_argument("--log-dir", default="data/logs")
    p.add_argument("--config")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("index")
    a.add_argument("--corpus-root", required=True)
    a.add_argument("--rebuild", action="store_true")
    a.add_argument("--drop-deleted", action="store_true")
    a.add_argument("--deep-scan", action="store_true", help="read the documents that names do not identify, right after")
    scan = sub.add_parser("deep-scan", help="read pending documents; stops and goes on between chunks")
    for a in (a, scan):
        a.add_argument("--reader", help="module:name, called with the corpus root for a Reader (a folder of PDF files and images)")
        a.add_argument("--ocr", help="module:name, called for an OcrBackend (the command tesseract)")
        a.add_argument("--workers", type=int, help="tasks that read documents")
        a.add_argument("--chunk", type=int, help="records after which the results are published")
    scan.add_argument("--corpus-root", help="instead of the root that was indexed")
    a = sub.add_parser("search")
    a.add_argument("query")
    a.add_argument("--top", type=int, default=3)
    a.add_argument("--sort", default="relevance", choices=search.SORTS)
    a.add_argument("--ext", action="append")
    a.add_argument("--folder", action="append")
    a.add_argument("--json", action="store_true")
    a.add_argument("--interactive", action="store_true", help="ask which result was right, and log the answer")
    a = sub.add_parser("serve")
    a.add_argument("--corpus-root", help="instead of the root that was indexed")
    a.add_argument("--port", type=int, default=8765)
    sub.add_parser("vacuum", help="delete what the current version of the index does not need")
    sub.add_parser("review-queue")
    sub.add_parser("facets")
    a = sub.add_parser("suggest-tuning")
    a.add_argument("--min-samples", type=int, default=feedback.MIN_SAMPLES)
    a = sub.add_parser("suggest-projects")
    a.add_argument("--corpus-root", required=True)
    a.add_argument("--depth", type=int, default=1)
    return p


def backend(name: str, *args: str):
    """What ``module:name`` makes of the arguments."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)(*args)


def now() -> str:
    return datetime.now(timezone.utc).isoformat()


@contextmanager
def interruptible() -> Iterator[threading.Event]:
    """An event that is set by the first interrupt from the keyboard, so that work can stop at its next step."""
    asked = threading.Event()
    in_main = threading.current_thread() is threading.main_thread()
    before = signal.signal(signal.SIGINT, lambda *_: asked.set()) if in_main else None
    try:
        yield asked
    finally:
        if in_main:
            signal.signal(signal.SIGINT, before)


def scan(args: argparse.Namespace, store: Store, config: Config, root: str) -> None:
    """Read what is pending below ``root`` and say how it went."""
    if args.workers is not None:
        config = replace(config, extraction=replace(config.extraction, workers=args.workers))
    reader = backend(args.reader, root) if args.reader else documents.FolderReader(root)
    ocr = backend(args.ocr) if args.ocr else documents.ocr_backend()
    tell = lambda done, total: print(f"\r  {done}/{total}", end="", file=sys.stderr)
    counts = deep_scan(store, args.log_dir, reader, ocr, config, now(), args.chunk, progress=tell)
    print(file=sys.stderr)
    print(f"{counts.get('filled', 0)} filled, {counts.get('review', 0)} to review")


def ask(found: search.Answer, log_dir: str, spark: SparkSession) -> None:
    """Ask which result was right, and log the answer as feedback."""
    shown = [str(k) for k in range(1, len(found.rows) + 1)]
    while (answer := input("Which one is right? (number, or n for none) ").strip().lower()) not in (*shown, "n"):
        pass
    chosen = None if answer == "n" else found.rows[int(answer) - 1]["doc_id"]
    row = (now(), found.query, [r["doc_id"] for r in found.rows], [r["score"] for r in found.rows], found.ambiguous, found.reranked, chosen, chosen is not None)
    logs.append(spark.createDataFrame([row], schema.FEEDBACK), f"{log_dir}/feedback")
    print("Thanks, it is logged.")


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("findery").getOrCreate()
    config, store = load_config(args.config), Store(spark, args.index_dir)
    if args.command == "index":
        root = os.path.abspath(args.corpus_root)
        tell = lambda done, total: print(f"  {done}/{total}", file=sys.stderr)
        with interruptible() as stopped:
            r = index(store, args.log_dir, corpus.read_files(spark, root), root, config, now(), rebuild=args.rebuild, drop_deleted=args.drop_deleted, phase=lambda name: print(f"  {name}", file=sys.stderr), progress=tell, should_stop=stopped.is_set)
        waiting = facets.pending(store.records()).first().pending
        if r.cancelled:
            print(f"Stopped: {r.processed} files are kept, the next run goes on with the rest.")
        print(f"{r.total_files} files, {r.processed} processed, {r.skipped_unchanged} unchanged, {waiting} pending")
        if args.deep_scan and waiting and not r.cancelled:
            scan(args, store, config, root)
    elif args.command == "deep-scan":
        if (current := store.current()) is None:
            print("Nothing is indexed yet; run index first.")
            return 1
        scan(args, store, config, os.path.abspath(args.corpus_root) if args.corpus_root else current.corpus_root)
    elif args.command == "search":
        if (held := store.index()) is None:
            print("Nothing is indexed yet; run index first.")
            return 1
        found = search.search_one(args.query, held, config.rules, config.ranking, search.clamp_top(args.top), args.sort, args.ext, args.folder, rerank.backend_for(config.rerank))
        if args.json:
            print(json.dumps(found.payload(), ensure_ascii=False, indent=2))
            return 0
        for r in found.rows:
            print(f"{r['display_rank']}. {r['file_path']}  (score: {r['score']:.1f})\n   why: {r['justification']}")
        print("Ambiguous." if found.ambiguous and found.rows else "" if found.rows else "No results.")
        if args.interactive and found.rows:
            ask(found, args.log_dir, spark)
    elif args.command == "serve":
        from findery.serve import Service, serve

        server = serve(Service(spark, store, args.log_dir, args.corpus_root, config), args.port)
        print(f"Serving at http://127.0.0.1:{server.server_port}", flush=True)
        try:
            server.serve_forever()
        except KeyboardInterrupt:
            pass
        finally:
            server.server_close()
    elif args.command == "vacuum":
        print(f"{store.vacuum()} folders deleted")
    elif args.command == "review-queue":
        for r in logs.review_queue(spark, f"{args.log_dir}/review_queue").toLocalIterator():
            print(f"{r.file_path}: {r.reason} ({'n/a' if r.confidence is None else format(r.confidence, '.2f')})")
    elif args.command == "facets":
        for r in facets.extensions(store.records()).toLocalIterator():
            print(f"{r.file_ext}\t{r.documents}")
    elif args.command == "suggest-tuning":
        entries = logs.feedback(spark, f"{args.log_dir}/feedback")
        suggested = feedback.suggestions(feedback.field_stats(entries, store.records(), config.rules, config.ranking), args.min_samples)
        for r in suggested.collect():
            print(f"{r.field_name}: {r.reason}")
        print(f"{feedback.unattributed(entries).first().unattributed} entries name no document\n")
        print(feedback.weights_toml(suggested))
    else:
        names = records.folder_names(corpus.read_folders(spark, args.corpus_root), args.depth)
        for r in names.select(records.project_rule(F.col("name")).alias("line"), "folders").toLocalIterator():
            print(f"{r.line}  # {r.folders}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
