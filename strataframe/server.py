"""A tool server on standard input and output: one JSON-RPC message a line."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable, Iterator

from . import tools
from .engine import Engine

PROTOCOL = "2024-11-05"


def answers(engine: Engine, lines: Iterable[str]) -> Iterator[dict]:
    """The replies to messages; notifications have none."""
    for line in lines:
        if not line.strip():
            continue
        number = None
        try:
            message = json.loads(line)
            number, method, params = message.get("id"), message.get("method"), message.get("params") or {}
            if number is None:
                continue
            if method == "initialize":
                result = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "strataframe", "version": "1"}}
            elif method == "tools/list":
                result = {"tools": tools.schemas()}
            elif method == "tools/call":
                try:
                    result = {"content": [{"type": "text", "text": tools.call(engine, params["name"], params.get("arguments") or {})}]}
                except Exception as e:  # the caller is told, the server goes on
                    result = {"content": [{"type": "text", "text": str(e)}], "isError": True}
            else:
                yield {"jsonrpc": "2.0", "id": number, "error": {"code": -32601, "message": f"no method {method!r}"}}
                continue
            yield {"jsonrpc": "2.0", "id": number, "result": result}
        except ValueError as e:
            yield {"jsonrpc": "2.0", "id": number, "error": {"code": -32700, "message": str(e)}}


def serve(engine: Engine) -> None:
    for reply in answers(engine, sys.stdin):
        print(json.dumps(reply, ensure_ascii=False), flush=True)
