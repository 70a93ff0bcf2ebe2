"""The engine's operations as tools: names, parameters as JSON schema, whether they write, and calls by name."""

from __future__ import annotations

import inspect
import json
import typing

from pyspark.sql import DataFrame

from .engine import Engine

READ = ("search_hybrid", "search_chunks", "search_images", "search_with_context", "search_chunks_with_hub_score", "expand_with_graph_context", "traverse",
        "find_path", "get_by_id", "list_directory", "get_chunks", "reconstruct_document")
WRITE = ("export_bundle", "ingest_md", "ingest_thoughts", "ingest_pdf")
_KINDS = {str: "string", int: "integer", float: "number", bool: "boolean"}


def _schema(kind) -> dict:
    args = [a for a in typing.get_args(kind) if a is not type(None)]
    if typing.get_origin(kind) is not None and args and not isinstance(kind, type) and typing.get_origin(kind).__name__ == "Sequence":
        return {"type": "array", "items": _schema(args[0])}
    if args:
        return _schema(args[0])
    return {"type": _KINDS.get(kind, "string")}


def schemas() -> list[dict]:
    """One entry a tool, from the signatures of the engine's methods."""
    out = []
    for name in (*READ, *WRITE):
        method = getattr(Engine, name)
        hints = typing.get_type_hints(method)
        params = {k: p for k, p in inspect.signature(method).parameters.items() if k != "self" and not k.startswith("_") and hints.get(k) is not None and k != "now"}
        out.append(
            {
                "name": name,
                "description": (method.__doc__ or name.replace("_", " ")).strip().splitlines()[0],
                "inputSchema": {
                    "type": "object",
                    "properties": {k: _schema(hints[k]) for k in params},
                    "required": [k for k, p in params.items() if p.default is inspect.Parameter.empty],
                },
                "annotations": {"readOnlyHint": name in READ},
            }
        )
    return out


def call(engine: Engine, name: str, arguments: dict) -> str:
    """Run a tool; its result as JSON. Result tables are bounded by the operation's own limit."""
    if name not in (*READ, *WRITE):
        raise ValueError(f"no tool {name!r}")
    found = getattr(engine, name)(**arguments)
    if isinstance(found, DataFrame):
        found = [json.loads(r) for r in found.toJSON().collect()]
    return json.dumps(found, default=str, ensure_ascii=False)
