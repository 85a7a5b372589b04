"""The named queries over JSON-RPC, one message a line: initialize, ping, tools/list and tools/call.

Long answers are cut into sections that `read_response_section` gives out; `stats` tells what was asked so far.
"""

from __future__ import annotations

import json
import os
from typing import TextIO

from graphloom import render, surface
from graphloom.model import Graph
from graphloom.operators import delta
from graphloom.sources.go_source import index, workspace_files
from graphloom.sources.sinks import Store, suppress

READ = {"response_id": surface.text(True), "section": surface.Arg(int, low=0, high=1_000_000), "query": surface.text(), "limit": surface.number(10, 1, 100)}


class Server:
    """roots: module name (empty: from go.mod) to folder, what reindex reads and write tools may touch; store: where the
    graph is kept; allow_write: whether sources may be changed."""

    def __init__(self, graph: Graph, gate: int = render.GATE, stored: int = render.STORED, roots: dict[str, str] | None = None, store: Store | None = None, allow_write: bool = False) -> None:
        self.graph, self.gate, self.stored = graph, gate, stored
        self.roots, self.store, self.allow_write = roots or {}, store, allow_write
        self.responses: dict[str, list[render.Section]] = {}
        self.usage: dict[str, list[int]] = {}

    def handle(self, line: str) -> dict | None:
        """The answer to one message, None for a notification. No message ends the server."""
        try:
            message = json.loads(line)
        except ValueError as e:
            return {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
        if not isinstance(message, dict) or "method" not in message:
            return {"jsonrpc": "2.0", "id": message.get("id") if isinstance(message, dict) else None, "error": {"code": -32600, "message": "not a request"}}
        if "id" not in message:
            return None
        answer = {"jsonrpc": "2.0", "id": message["id"]}
        try:
            return answer | {"result": self.result(message["method"], message.get("params") or {})}
        except KeyError as e:
            return answer | {"error": {"code": -32601, "message": f"unknown method {e}"}}
        except surface.ArgumentError as e:
            return answer | {"error": {"code": -32602, "message": str(e)}}
        except Exception as e:  # noqa: BLE001  a failed query is an answer; the next one may succeed
            return answer | {"result": {"isError": True, "content": [{"type": "text", "text": f"{type(e).__name__}: {e}"}]}}

    def result(self, method: str, params: dict) -> dict:
        return {"initialize": self.initialize, "ping": lambda _: {}, "tools/list": self.tools, "tools/call": self.call}[method](params)

    def initialize(self, params: dict) -> dict:
        return {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "graphloom", "version": "1"}}

    def tools(self, _: dict) -> dict:
        kinds = {"str": "string", "int": "integer", "float": "number", "bool": "boolean"}
        out = []
        own = {"read_response_section": READ, "stats": {}, "schema": {"tool": surface.text(True)}}
        for tool in [*surface.TOOLS, *surface.STATEFUL, *(surface.WRITES if self.allow_write else ()), *own]:
            spec = own[tool] if tool in own else surface.spec(tool)
            one = {n: {"type": kinds[a.kind.__name__]} | ({"enum": list(a.values)} if a.values else {}) | ({"minimum": a.low, "maximum": a.high} if a.low is not None else {}) for n, a in spec.items()}
            properties = {n: {"type": "array", "items": one[n]} if a.many else one[n] for n, a in spec.items()}
            out.append({"name": tool, "inputSchema": {"type": "object", "properties": properties, "required": [n for n, a in spec.items() if a.required]}})
        return {"tools": out}

    def call(self, params: dict) -> dict:
        tool, given = params.get("name", ""), dict(params.get("arguments") or {})
        if tool == "read_response_section":
            return said(self.section(given))
        if tool == "stats":
            return said(render.table("tools", [{"tool": t, "calls": n, "errors": e, "bytes": b} for t, (n, e, b) in sorted(self.usage.items())]))
        if tool == "schema":
            return said(json.dumps(surface.schema(given.get("tool") or "")))
        form = given.pop("format", "table")
        count = self.usage.setdefault(tool, [0, 0, 0])
        count[0] += 1
        try:
            text = self.changed(tool, given) if tool in surface.STATEFUL or tool in surface.WRITES else render.render(tool, surface.call(self.graph, tool, **given), form)
        except Exception:
            count[1] += 1
            raise
        count[2] += len(text.encode())
        return said(self.gated(tool, text))

    def changed(self, tool: str, given: dict) -> str:
        """What a tool that changes the index or the sources did."""
        a = surface.arguments(tool, given)
        if tool == "suppress_contract":
            self.graph.suppressions = suppress(self.graph.suppressions, a["from_ref"], a["to_ref"])
            if self.store is not None:
                self.store.write(self.graph)
                self.graph = self.store.read()
            return f"{a['from_ref']} and {a['to_ref']} are left out from now on"
        if tool == "reindex":
            return self.reindexed()
        if not self.allow_write:
            raise surface.ArgumentError(f"{tool} changes files, and the server was started without leave to write")
        edit = surface.planned(self.graph, tool, a)
        roots = [os.path.realpath(r) for r in self.roots.values()]
        for path in edit.files:
            if not any(os.path.realpath(path).startswith(r + os.sep) for r in roots):
                raise surface.ArgumentError(f"{path} is outside of the indexed folders")
        edit.apply()
        told = f"{edit.action} {edit.symbol}: " + ("nothing to change" if edit.unchanged else f"{edit.sites} places in {len(edit.files)} files")
        return told if edit.unchanged else f"{told}\n{self.reindexed()}"

    def reindexed(self) -> str:
        """The stale ones of the roots indexed again."""
        if not self.roots:
            raise surface.ArgumentError("the server knows no folders to index")
        spark = self.graph.spark
        files = workspace_files(spark, self.roots)
        old = delta.fingerprint(self.graph.files)
        stale = [r["repo"] for r in delta.stale(files, old).collect()]
        if stale:
            suppressions = self.graph.suppressions
            self.graph = index(files)
            self.graph.suppressions = suppressions
            if self.store is not None:
                self.store.write(self.graph)
                self.graph = self.store.read()
        return f"indexed again: {', '.join(sorted(stale)) or 'nothing was stale'}"

    def gated(self, tool: str, text: str) -> str:
        """The text, or the list of its sections if it is too long; the oldest stored responses make room."""
        if len(text.encode()) <= self.gate:
            return text
        name = f"{tool}-{len(self.responses)}-{hash(text) & 0xFFFFFFFF:08x}"
        self.responses[name] = render.sections(text, self.gate)
        while len(self.responses) > 1 and sum(s.size for r in self.responses.values() for s in r) > self.stored:
            del self.responses[next(iter(self.responses))]
        rows = [{"section": k, "title": s.title, "bytes": s.size} for k, s in enumerate(self.responses[name])]
        return f"response_id: {name}\n" + render.table("sections", rows) + "\n" + render.cut_bytes(text, 800)

    def section(self, given: dict) -> str:
        for name in given:
            if name not in READ:
                raise surface.ArgumentError(f"read_response_section has no argument {name}")
        checked = {n: a.check(n, given[n]) if given.get(n) is not None else a.default for n, a in READ.items()}
        parts = self.responses.get(checked["response_id"] or "")
        if parts is None:
            raise surface.ArgumentError("unknown response_id; stored are " + (", ".join(self.responses) or "none"))
        if checked["section"] is not None:
            if checked["section"] >= len(parts):
                raise surface.ArgumentError(f"section must be 0 to {len(parts) - 1}")
            return parts[checked["section"]].content
        if checked["query"]:
            hits = [(k, s) for k, s in enumerate(parts) if checked["query"].lower() in s.content.lower()][: checked["limit"]]
            return "\n".join(f"section {k}: {s.title}\n{render.cut_bytes(s.content, self.gate // max(1, len(hits)))}" for k, s in hits) or "no section has it"
        return render.cut_bytes("".join(s.content for s in parts), self.gate)


def said(text: str) -> dict:
    return {"content": [{"type": "text", "text": text}]}


def serve(graph: Graph, lines: TextIO, out: TextIO, **more) -> None:
    """Answer until the input ends. more: as for Server."""
    server = Server(graph, **more)
    for line in lines:
        if line.strip() and (answer := server.handle(line)) is not None:
            out.write(json.dumps(answer) + "\n")
            out.flush()
