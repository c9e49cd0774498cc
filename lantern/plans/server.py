"""The tools as a service: JSON-RPC requests, one to a line, as the Model Context Protocol has them over standard input and output."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from typing import IO, Any

from pyspark.sql import DataFrame, Row

from lantern.plans.api import Tools

PROTOCOL = "2024-11-05"
UNKNOWN_METHOD, FAILED = -32601, -32603
#: Per tool: the method of ``Tools``, what it does, and its arguments (type, and whether it must be there).
TOOLS: dict[str, tuple[str, dict[str, tuple[str, bool]]]] = {
    "search": ("Hybrid search of the documentation", {"version": ("string", True), "query": ("string", True), "limit": ("integer", False), "mode": ("string", False), "subsystem": ("string", False), "group": ("string", False)}),
    "list_sections": ("The sections of the navigation", {"version": ("string", True)}),
    "discover": ("Sections by what they are about", {"version": ("string", True), "query": ("string", True), "limit": ("integer", False)}),
    "section_map": ("The groups and methods of one section", {"version": ("string", True), "subsystem": ("string", True)}),
    "demo_location": ("The demo release that fits a version", {"version": ("string", True)}),
    "section": ("One section by its id", {"version": ("string", True), "section_id": ("string", True)}),
    "source_section": ("The page that a section is from", {"version": ("string", True), "section_id": ("string", True), "form": ("string", False)}),
    "detect_version": ("The release that a project's files name", {"project": ("string", True), "marker": ("string", True)}),
    "list_versions": ("The versions that are indexed", {}),
}


def described() -> list[dict]:
    """The tools with the schemas of their arguments."""
    form = lambda args: {"type": "object", "properties": {k: {"type": kind} for k, (kind, _) in args.items()}, "required": [k for k, (_, must) in args.items() if must]}
    return [{"name": name, "description": text, "inputSchema": form(args)} for name, (text, args) in TOOLS.items()]


def plain(value: Any) -> Any:
    """A tool's answer as JSON; absent fields are left out."""
    if isinstance(value, DataFrame):  # the rows of one answer, bounded by its limit
        return [{k: v for k, v in row.asDict(recursive=True).items() if v is not None} for row in value.collect()]
    return value.asDict() if isinstance(value, Row) else value._asdict() if hasattr(value, "_asdict") else vars(value) if hasattr(value, "__dataclass_fields__") else value


def answer(tools: Tools, request: dict) -> dict | None:
    """The response to a request; none to a notification."""
    if "id" not in request:
        return None
    called, given = request.get("method"), request.get("params") or {}
    methods: dict[str, Callable[[], dict]] = {
        "initialize": lambda: {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "lantern", "version": "1"}},
        "ping": dict,
        "tools/list": lambda: {"tools": described()},
        "tools/call": lambda: run(tools, given.get("name", ""), given.get("arguments") or {}),
    }
    head = {"jsonrpc": "2.0", "id": request["id"]}
    if called not in methods:
        return head | {"error": {"code": UNKNOWN_METHOD, "message": f"no such method: {called}"}}
    try:
        return head | {"result": methods[called]()}
    except Exception as error:  # noqa: BLE001  whatever fails is answered under the request's id
        return head | {"error": {"code": FAILED, "message": f"{type(error).__name__}: {error}"}}


def run(tools: Tools, name: str, arguments: dict) -> dict:
    """One tool's result; what is wrong with a call is told in the result."""
    try:
        if name not in TOOLS:
            raise KeyError(f"no such tool: {name}")
        if unknown := set(arguments) - set(TOOLS[name][1]):
            raise ValueError(f"unknown arguments: {', '.join(sorted(unknown))}")
        text = json.dumps(plain(getattr(tools, name)(**arguments)), ensure_ascii=False, default=str)
        return {"content": [{"type": "text", "text": text}], "isError": False}
    except (KeyError, ValueError, TypeError, RuntimeError, FileNotFoundError) as error:
        return {"content": [{"type": "text", "text": str(error)}], "isError": True}


def serve(tools: Tools, requests: Iterable[str], out: IO[str]) -> None:
    """Answers each line of ``requests`` until they end."""
    for line in filter(str.strip, requests):
        try:
            response = answer(tools, json.loads(line))
        except Exception as error:  # noqa: BLE001  a request that fails doesn't end the service
            response = {"jsonrpc": "2.0", "id": None, "error": {"code": FAILED, "message": f"{type(error).__name__}: {error}"}}
        if response is not None:
            print(json.dumps(response, ensure_ascii=False), file=out, flush=True)
