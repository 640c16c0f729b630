"""Requests to an engine as JSON-RPC, one in a line, and the command line.

Beside the engine's own methods, those of the Model Context Protocol are answered
(``initialize``, ``tools/list``, ``tools/call``), so ``serve`` is a tool server on
standard input and output. Requests without an id get no answer.

    python -m lodeview.surface --index DIR scan ROOT...
    python -m lodeview.surface --index DIR find WORDS... | get ID | show ID | recent [--since T] [--limit N] | doctor [ROOT...] | serve
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable, Iterable
from typing import Any, TextIO

from lodeview.engine import Engine, cards, doctor, file_link

# The error codes of JSON-RPC 2.0.
PARSE, REQUEST, METHOD, FAILED = -32700, -32600, -32601, -32000

TOOLS = {
    "find": {
        "type": "object", "required": ["query"],
        "properties": {
            "query": {"type": "string", "minLength": 1}, "kinds": {"type": "array", "items": {"enum": ["file", "repo"]}}, "path_prefix": {"type": "string"}, "since": {"type": "string"},
            "limit": {"type": "integer", "minimum": 1, "maximum": 10},
        },
    },
    "get": {"type": "object", "properties": {"id": {"type": "string"}}, "required": ["id"]},
    "recent": {"type": "object", "properties": {"since": {"type": "string"}, "limit": {"type": "integer", "minimum": 1, "maximum": 100, "default": 20}}},
}


def _rows(frame: Any) -> list[dict]:
    """At most a hundred rows, with links to files."""
    out = [r.asDict(recursive=True) for r in frame.collect()]
    for r in out:
        if r.get("path"):
            r["link"] = file_link(r["path"])
    return out


def _find(engine: Engine, query: str, **filters: Any) -> list[dict]:
    if not isinstance(query, str) or not query:
        raise ValueError("query must be a text")
    return _rows(engine.find(query, **filters))


def _get(engine: Engine, id: str) -> dict | None:  # noqa: A002
    found = _rows(engine.get(id))
    return found[0] if found else None


def _recent(engine: Engine, since: str | None = None, limit: int = 20) -> list[dict]:
    return _rows(engine.recent(since, limit))


ABOUT = {"find": "Ranked files and repositories for a question in words.", "get": "A record by its id, with the begin of its texts.", "recent": "The files that changed last."}


def _call(engine: Engine, name: str, arguments: dict | None = None, **_: Any) -> dict:
    """A tool's rows as text; what goes wrong in it is a result, too."""
    if name not in TOOLS:
        raise ValueError(f"no tool {name}")
    try:
        text, failed = json.dumps(METHODS[name](engine, **(arguments or {})), default=str), False
    except Exception as e:
        text, failed = str(e), True
    return {"content": [{"type": "text", "text": text}], "isError": failed}


METHODS: dict[str, Callable[..., Any]] = {
    "find": _find, "get": _get, "recent": _recent, "ping": lambda engine: "pong", "tools/call": _call,
    "initialize": lambda engine, protocolVersion="2024-11-05", **_: {"protocolVersion": protocolVersion, "capabilities": {"tools": {}}, "serverInfo": {"name": "lodeview", "version": "1"}},
    "tools/list": lambda engine, **_: {"tools": [{"name": n, "description": ABOUT[n], "inputSchema": x} for n, x in TOOLS.items()]},
}


def answer(engine: Engine, line: str) -> dict:
    """The response to one request."""

    def error(id_: Any, code: int, message: str) -> dict:
        return {"jsonrpc": "2.0", "id": id_, "error": {"code": code, "message": message}}

    try:
        request = json.loads(line)
    except ValueError as e:
        return error(None, PARSE, str(e))
    if not isinstance(request, dict) or not isinstance(request.get("method"), str) or not isinstance(request.get("params", {}), dict):
        return error(request.get("id") if isinstance(request, dict) else None, REQUEST, "a request has a method and named parameters")
    method = METHODS.get(request["method"])
    if method is None:
        return error(request.get("id"), METHOD, f"no method {request['method']}")
    try:
        return {"jsonrpc": "2.0", "id": request.get("id"), "result": method(engine, **request.get("params", {}))}
    except Exception as e:  # any failure is an answer
        return error(request.get("id"), FAILED, str(e))


def serve(engine: Engine, lines: Iterable[str], out: TextIO) -> None:
    """Answer requests line by line until they end."""
    for line in lines:
        if line.strip() and not _told(line):
            print(json.dumps(answer(engine, line), default=str), file=out, flush=True)


def _told(line: str) -> bool:
    """Whether a line is a notification: a request without an id."""
    try:
        held = json.loads(line)
    except ValueError:
        return False
    return isinstance(held, dict) and isinstance(held.get("method"), str) and "id" not in held


def record_card(record: dict | None) -> str:
    """A record's fields and the begin of each of its texts, in lines."""
    if record is None:
        return "No such record."
    lines = [f"{k}: {v}" for k, v in record.items() if v is not None and k not in ("blobs", "link")]
    return "\n".join(lines + [f"  [{b['extractor_type']}] {b['snippet']}" for b in record.get("blobs") or ()])


def main(args: list[str] | None = None, out: TextIO = sys.stdout) -> int:
    parser = argparse.ArgumentParser(prog="lodeview")
    parser.add_argument("--index", required=True)
    sub = parser.add_subparsers(dest="command", required=True)
    scan = sub.add_parser("scan")
    scan.add_argument("roots", nargs="+")
    scan.add_argument("--ocr", choices=["off", "screenshots", "all"], default="off")
    scan.add_argument("--exclude", action="append", default=[])
    sub.add_parser("find").add_argument("words", nargs="+")
    sub.add_parser("get").add_argument("id")
    sub.add_parser("show").add_argument("id")
    recent = sub.add_parser("recent")
    recent.add_argument("--since")
    recent.add_argument("--limit", type=int, default=20)
    sub.add_parser("doctor").add_argument("roots", nargs="*")
    sub.add_parser("serve")
    a = parser.parse_args(args)
    if a.command == "doctor":
        print(json.dumps(doctor(a.index, a.roots), indent=2), file=out)
        return 0
    from pyspark.sql import SparkSession

    engine = Engine(SparkSession.builder.appName("lodeview").getOrCreate(), a.index)
    if a.command == "scan":
        print(json.dumps(engine.scan(a.roots, excludes=a.exclude, ocr=a.ocr)), file=out)
    elif a.command == "find":
        print(cards(engine.find(" ".join(a.words))), file=out)
    elif a.command == "get":
        print(json.dumps(_get(engine, a.id), indent=2, default=str), file=out)
    elif a.command == "show":
        print(record_card(_get(engine, a.id)), file=out)
    elif a.command == "recent":
        print(cards(engine.recent(a.since, a.limit)), file=out)
    else:
        serve(engine, sys.stdin, out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
