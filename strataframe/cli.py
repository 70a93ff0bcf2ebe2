"""Command line over the engine: ``python -m strataframe.cli STORE COMMAND ...``."""

from __future__ import annotations

import argparse
import json
import logging
import shlex
import sys
import time
from logging.handlers import RotatingFileHandler

from pyspark.sql import DataFrame, SparkSession

from . import config, server
from .engine import Engine

LOG = logging.getLogger("strataframe")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strataframe")
    p.add_argument("store")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("--log-file")
    p.add_argument("--profile", action="store_true", help="say how long the command took")
    p.add_argument("--dimension", type=int)
    p.add_argument("--chunk-overlap", type=int)
    p.add_argument("--image-mode")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *positional: str, **options) -> None:
        c = sub.add_parser(name)
        for arg in positional:
            c.add_argument(arg, nargs="?" if arg == "directory" else None)
        for key, kind in options.items():
            flag = "--" + key.replace("_", "-")
            if kind is bool:
                c.add_argument(flag, action="store_true")
            else:
                c.add_argument(flag, **({"nargs": "*", "default": []} if kind is list else {"type": kind}))

    filters = {"type": str, "tags": list, "parent": str, "limit": int}
    add("init")
    add("model-info")
    add("import", "folder")
    add("ingest", "file", id=str, title=str, description=str, tags=list)
    add("think", "topic", "text", tags=list)
    add("search", "query", include_chunks=bool, include_reserved=bool, **filters)
    add("search-images", "query", limit=int)
    add("search-chunks", "query", max_per_doc=int, **filters)
    add("context", "query", limit=int)
    add("hub-search", "query", limit=int, weight=float)
    add("traverse", "id", relation=str, direction=str, depth=int, node_type=str)
    add("list", "directory")
    add("get", "id")
    add("chunks", "id")
    add("export", "folder", type=str, tags=list, parent=str)
    add("reconstruct", "id")
    add("path", "start", "end", max_length=int)
    add("shell")
    add("serve")
    add("ingest-pdf", "file", reader=str, routing=str)
    add("broken-links")
    add("repair-links")
    add("reindex", force=bool)
    add("siblings", "id", limit=int)
    add("ancestry", "id")
    add("delete", "id")
    add("deleted-list")
    add("deleted-recover", "id")
    add("deleted-purge")
    return p


def _given(**options) -> dict:
    return {k: v for k, v in options.items() if v not in (None, [])}


def run(engine: Engine, a: argparse.Namespace):
    """The result of one command."""
    match a.command:
        case "init":
            return {"store": engine.store.path, "manifest": engine.store.manifest()["number"], "dimension": engine.dimension}
        case "model-info":
            return engine.model_info()
        case "import":
            return engine.import_files(a.folder)
        case "ingest":
            return engine.ingest_md(a.file, **_given(concept_id=a.id, title=a.title, description=a.description, tags=a.tags))
        case "ingest-pdf":
            return engine.ingest_pdf(a.file, **_given(reader=a.reader, routing_mode=a.routing))
        case "think":
            return engine.ingest_thoughts(a.text, a.topic, **_given(tags=a.tags))
        case "search":
            more = _given(concept_type=a.type, tags=a.tags, parent_id=a.parent, limit=a.limit)
            return engine.search_hybrid(a.query, exclude_reserved=not a.include_reserved, include_chunks=a.include_chunks, **more)
        case "search-images":
            return engine.search_images(a.query, **_given(limit=a.limit))
        case "search-chunks":
            return engine.search_chunks(a.query, **_given(concept_type=a.type, tags=a.tags, parent_id=a.parent, limit=a.limit, max_chunks_per_doc=a.max_per_doc))
        case "context":
            return engine.search_with_context(a.query, **_given(limit=a.limit))
        case "hub-search":
            return engine.search_chunks_with_hub_score(a.query, **_given(limit=a.limit, hub_weight=a.weight))
        case "traverse":
            return engine.traverse(a.id, **_given(relationship=a.relation, direction=a.direction, depth=a.depth, node_type=a.node_type))
        case "list":
            return engine.list_directory(a.directory)
        case "get":
            return engine.get_by_id(a.id)
        case "chunks":
            return engine.get_chunks(a.id)
        case "export":
            return engine.export_files(a.folder, **_given(parent_id=a.parent, concept_type=a.type, tags=a.tags))
        case "reconstruct":
            return engine.reconstruct_document(a.id)
        case "path":
            return engine.find_path(a.start, a.end, **_given(max_length=a.max_length))
        case "broken-links":
            return engine.list_broken_links()
        case "repair-links":
            return engine.repair_links(engine.list_broken_links())
        case "reindex":
            return engine.reindex(a.force)
        case "siblings":
            return engine.siblings(a.id, **_given(limit=a.limit))
        case "ancestry":
            return engine.ancestry(a.id)
        case "delete":
            return engine.soft_delete(a.id)
        case "deleted-list":
            return engine.list_deleted()
        case "deleted-recover":
            return engine.recover(a.id)
        case "deleted-purge":
            return engine.purge_expired()


def show(found) -> None:
    if isinstance(found, DataFrame):
        for row in found.toJSON().toLocalIterator():
            print(row)
    else:
        print(found if isinstance(found, str) else json.dumps(found, default=str, ensure_ascii=False))


def shell(engine: Engine, store: str) -> None:
    """Commands line by line until ``exit``; in ``search`` words like ``type:note`` and ``tags:a,b`` filter."""
    for line in sys.stdin:
        words = shlex.split(line)
        if not words:
            continue
        if words[0] in ("exit", "quit"):
            return
        extra = []
        if words[0] == "search":
            for w in [w for w in words if w.partition(":")[0] in ("type", "tags", "parent") and ":" in w]:
                words.remove(w)
                key, _, value = w.partition(":")
                extra += [f"--{key}", *(value.split(",") if key == "tags" else [value])]
            words = ["search", " ".join(words[1:])]
        try:
            show(run(engine, parser().parse_args([store, *words, *extra])))
        except SystemExit:
            continue
        except Exception as e:  # a failed command doesn't end the shell
            print(f"error: {e}", file=sys.stderr)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    handlers = [RotatingFileHandler(a.log_file, maxBytes=5 << 20, backupCount=3)] if a.log_file else [logging.StreamHandler()]
    logging.basicConfig(level=logging.DEBUG if a.verbose else logging.ERROR if a.quiet else logging.INFO, handlers=handlers, force=True)
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName("strataframe").getOrCreate()
    began = time.perf_counter()
    settings = config.load({"dimension": a.dimension, "chunk_overlap": a.chunk_overlap, "image_mode": a.image_mode}, a.store)
    engine = Engine(spark, a.store, settings)
    if a.command == "shell":
        shell(engine, a.store)
    elif a.command == "serve":
        server.serve(engine)
    else:
        show(run(engine, a))
    if a.profile:
        LOG.warning("%s took %.2f s", a.command, time.perf_counter() - began)
    return 0


if __name__ == "__main__":
    sys.exit(main())
