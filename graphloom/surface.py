"""The named queries with their arguments: validation before any work, and one way to call them all."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import edits
from graphloom.model import EDGE_TYPES, KINDS, Graph
from graphloom.operators import contracts, delta, fulltext, graph, lookup, pattern, rank, runtime


class ArgumentError(ValueError):
    pass


@dataclass(frozen=True)
class Arg:
    """An argument: its type, whether it must be given, its default, and a range or the values it may have."""

    kind: type
    required: bool = False
    default: Any = None
    low: float | None = None
    high: float | None = None
    values: tuple[str, ...] = ()
    many: bool = False

    def check(self, name: str, value: Any) -> Any:
        if self.many:
            if not isinstance(value, list | tuple):
                raise ArgumentError(f"{name} must be a list")
            return tuple(Arg(self.kind, values=self.values).check(name, v) for v in value)
        if isinstance(value, bool) != (self.kind is bool) or not isinstance(value, (int, float) if self.kind is float else self.kind):
            raise ArgumentError(f"{name} must be of type {self.kind.__name__}")
        if self.values and value not in self.values:
            raise ArgumentError(f"{name} must be one of {', '.join(self.values)}")
        if self.low is not None and not self.low <= value <= self.high:
            raise ArgumentError(f"{name} must be {self.low} to {self.high}")
        return value


def text(required: bool = False, *values: str) -> Arg:
    return Arg(str, required, values=values)


def number(default: int, low: int, high: int) -> Arg:
    return Arg(int, default=default, low=low, high=high)


def flag() -> Arg:
    return Arg(bool, default=False)


TYPES = Arg(str, default=(), values=EDGE_TYPES, many=True)
DEPTH = number(1, 1, 100)
SEVERITIES, DIRECTIONS = ("breaking", "compatible", "unknown"), ("producer", "consumer", "shared")


def search(g: Graph, a: dict) -> DataFrame:
    filters = {k: a[k] for k in ("kind", "exported", "file", "repo") if a[k] is not None} | {"tests": a["include_tests"]}
    if a["generated"]:
        filters["generated"] = a["generated"]
    if a["mode"] == "prefix":
        return lookup.search_prefix(g, a["pattern"], **filters)
    if a["mode"] == "method":
        filters.pop("kind", None)
        return lookup.method_search(g, a["pattern"], **filters)
    return lookup.search(g, a["pattern"], **filters)


def imports(g: Graph, a: dict) -> DataFrame:
    if a["transitive"]:
        return graph.transitive_imports(g, a["package_path"])
    return graph.importers_of(g, a["package_path"]) if a["direction"] == "in" else graph.imports_of(g, a["package_path"])


def declaration(g: Graph, a: dict) -> DataFrame:
    if a["symbol"]:
        return lookup.find_occurrence(g, a["file_path"], a["symbol"])
    if not a["line"]:
        raise ArgumentError("line or symbol must be given")
    return lookup.find_declaration(g, a["file_path"], a["line"])


def hot(g: Graph, a: dict) -> DataFrame:
    return rank.importance(g, a["top_n"]) if a["mode"] == "pagerank" else rank.hotspots(g, a["top_n"], a["min_complexity"], a["min_churn"])


def drift(g: Graph, a: dict) -> DataFrame:
    rows = contracts.unsuppressed(contracts.all_drift(contracts.constants_of(g.symbols), contracts.shapes_of(g.symbols)), g.suppressions)
    return rows.where(F.col("severity") == a["severity"]) if a["severity"] else rows


def found_contracts(g: Graph, a: dict) -> DataFrame:
    roles = contracts.site_roles(contracts.constant_uses(g))
    rows = contracts.contracts(contracts.constants_of(g.symbols), contracts.shapes_of(g.symbols), roles)
    return contracts.read_contracts(rows, g.suppressions, None, a["direction"], a["severity"], a["min_confidence"])


def lines(g: Graph, a: dict) -> DataFrame:
    """Result lines, then what was corrected or may help: their section tells which."""
    if a["is_regex"]:
        return fulltext.search_regex(g, a["pattern"], a["file_pattern"])
    rows, made, hint = fulltext.search_corrected(g, a["pattern"], a["file_pattern"])
    notes = [("correction", f"{term} -> {better}") for term, better in sorted(made.items())] + ([("hint", hint)] if hint else [])
    notes = g.spark.createDataFrame(notes, "section string, text string")
    return rows.withColumn("section", F.lit("line")).unionByName(notes, allowMissingColumns=True).orderBy(F.col("rank").asc_nulls_last(), "section", "text")


def entities(g: Graph, a: dict) -> DataFrame:
    rows = runtime.runtime_contracts(g)
    for key in ("kind", "repo"):
        if a[key]:
            rows = rows.where(F.col(key) == a[key])
    return rows.orderBy("kind", "pattern", "from_ref")


TOOLS: dict[str, tuple[dict[str, Arg], Callable[[Graph, dict], DataFrame]]] = {
    "health": ({}, lambda g, a: lookup.repo_states(g)),
    "overview": ({"include_tests": flag(), "repo": text()}, lambda g, a: lookup.overview(g, a["include_tests"], a["repo"])),
    "summary": ({"repo": text()}, lambda g, a: lookup.summary(g, a["repo"])),
    "dependencies": ({}, lambda g, a: lookup.dependencies(g)),
    "show": ({"qualified_name": text(True), "source": flag(), "context_lines": number(0, 0, 500), "include_doc": flag()}, lambda g, a: lookup.symbol_body(g, a["qualified_name"], a["context_lines"], a["include_doc"]) if a["source"] else lookup.show(g, a["qualified_name"])),
    "callers_of": ({"qualified_name": text(True), "edge_types": TYPES, "depth": DEPTH, "repo": text()}, lambda g, a: graph.callers_of(g, a["qualified_name"], a["depth"], a["edge_types"], a["repo"])),
    "callees_of": ({"qualified_name": text(True), "edge_types": TYPES, "depth": DEPTH, "repo": text()}, lambda g, a: graph.callees_of(g, a["qualified_name"], a["depth"], a["edge_types"], a["repo"])),
    "list_packages": ({"include_tests": flag(), "repo": text()}, lambda g, a: lookup.list_packages(g, a["include_tests"], a["repo"])),
    "package": ({"path": text(True), "include_unexported": flag(), "include_tests": flag()}, lambda g, a: lookup.package(g, a["path"], a["include_unexported"], a["include_tests"])),
    "methods_of": ({"type_name": text(True)}, lambda g, a: lookup.methods_of(g, a["type_name"])),
    "search": ({"pattern": text(True), "mode": text(False, "substring", "prefix", "method"), "include_tests": flag(), "kind": text(False, *KINDS), "exported": Arg(bool), "file": text(), "generated": text(False, *lookup.GENERATED), "repo": text()}, search),
    "imports_of": ({"package_path": text(True), "direction": text(False, "in", "out"), "transitive": flag()}, imports),
    "all_edges": ({"edge_type": text(False, *EDGE_TYPES)}, lambda g, a: lookup.edge_filter(g.edges, (a["edge_type"],) if a["edge_type"] else ())),
    "search_text": ({"pattern": text(True), "file_pattern": text(), "is_regex": flag()}, lines),
    "pattern": ({"pattern": text(True), "file_pattern": text(), "repo": text()}, lambda g, a: pattern.pattern_search(g, a["pattern"], a["file_pattern"], a["repo"])),
    "get_context_bundle": ({"qualified_name": text(True), "token_budget": number(4000, 1, 1_000_000)}, lambda g, a: graph.context_bundle(g, a["qualified_name"], a["token_budget"])),
    "get_hotspots": ({"mode": text(False, "churn", "pagerank"), "top_n": number(20, 1, 500), "min_complexity": number(1, 0, 1_000_000), "min_churn": number(1, 0, 1_000_000)}, hot),
    "type_usage": ({"type_name": text(True), "include_tests": flag()}, lambda g, a: lookup.type_usage(g, a["type_name"], a["include_tests"])),
    "diagnostics": ({"file": text(), "repo": text()}, lambda g, a: lookup.diagnostics(g, a["file"], a["repo"])),
    "interface_impls": ({"interface_name": text(True)}, lambda g, a: lookup.interface_impls(g, a["interface_name"])),
    "unused": ({"include_tests": flag()}, lambda g, a: graph.unused(g, a["include_tests"])),
    "cycles": ({"edge_type": text(True, *EDGE_TYPES)}, lambda g, a: graph.cycles(g, a["edge_type"])),
    "affected_tests": ({"files": Arg(str, True, many=True), "depth": number(5, 1, 100)}, lambda g, a: graph.affected_tests(g, list(a["files"]), a["depth"])),
    "blast_radius": ({"qualified_name": text(True), "depth": number(3, 1, 100)}, lambda g, a: graph.blast_radius(g, a["qualified_name"], a["depth"])),
    "find_path": ({"from": text(True), "to": text(True), "max_depth": number(10, 1, 100)}, lambda g, a: graph.find_path(g, a["from"], a["to"], a["max_depth"])),
    "symbols_in_file": ({"file_path": text(True)}, lambda g, a: lookup.symbols_in_file(g, a["file_path"])),
    "find_declaration": ({"file_path": text(True), "line": Arg(int), "symbol": text()}, declaration),
    "dependency_flow": ({"package_path": text(), "layers": flag(), "top_hubs": number(5, 1, 500)}, lambda g, a: graph.dependency_layers(g) if a["layers"] or not a["package_path"] else graph.dependency_flow(g, a["package_path"])),
    "hubs": ({"top_hubs": number(5, 1, 500)}, lambda g, a: graph.hubs(g, a["top_hubs"])),
    "entry_points": ({"heuristics": Arg(str, default=("main", "test", "uncalled_exported"), values=graph.HEURISTICS, many=True), "include_tests": flag()}, lambda g, a: graph.entry_points(g, a["heuristics"], a["include_tests"])),
    "contracts": ({"direction": text(False, *DIRECTIONS), "severity": text(False, *SEVERITIES), "min_confidence": Arg(float, low=0, high=1)}, found_contracts),
    "contract_drift": ({"severity": text(False, *SEVERITIES)}, drift),
    "runtime_contracts": ({"kind": text(), "repo": text()}, entities),
    "changed_symbols": ({"root": text(True), "ref": text(), "include_bodies": flag(), "include_tests": flag()}, lambda g, a: delta.working_changes(g, a["root"], a["ref"], bodies=a["include_bodies"], tests=a["include_tests"])),
    "fingerprint": ({}, lambda g, a: delta.fingerprint(g.files)),
}


#: What a server with a graph of its own may change: the index, and with leave to write, the sources.
STATEFUL: dict[str, dict[str, Arg]] = {"reindex": {}, "suppress_contract": {"from_ref": text(True), "to_ref": text(True)}}
WRITES: dict[str, dict[str, Arg]] = {
    "replace_symbol_body": {"qualified_name": text(True), "body": text(True), "include_doc": flag()},
    "insert_before_symbol": {"qualified_name": text(True), "text": text(True)},
    "insert_after_symbol": {"qualified_name": text(True), "text": text(True)},
    "safe_delete_symbol": {"qualified_name": text(True), "allow_exported": flag(), "allow_test_only": flag()},
    "rename_symbol": {"qualified_name": text(True), "new_name": text(True), "force": flag()},
}


def spec(tool: str) -> dict[str, Arg]:
    if tool in TOOLS:
        return TOOLS[tool][0]
    if tool in STATEFUL or tool in WRITES:
        return (STATEFUL | WRITES)[tool]
    raise ArgumentError(f"unknown tool {tool}")


def planned(g: Graph, tool: str, a: dict) -> edits.Edit:
    """The edit that a write tool stands for, not yet written."""
    name = a["qualified_name"]
    if tool == "replace_symbol_body":
        return edits.replace_body(g, name, a["body"], a["include_doc"])
    if tool == "safe_delete_symbol":
        return edits.delete(g, name, a["allow_exported"], a["allow_test_only"])
    if tool == "rename_symbol":
        return edits.rename(g, name, a["new_name"], a["force"])
    return edits.insert(g, name, a["text"], after=tool == "insert_after_symbol")


def arguments(tool: str, given: dict[str, Any]) -> dict[str, Any]:
    """The checked arguments of a tool, defaults filled in; unknown and missing ones are errors."""
    expected = spec(tool)
    if extra := sorted(set(given) - set(expected)):
        raise ArgumentError(f"{tool} has no argument {', '.join(extra)}")
    out = {}
    for name, arg in expected.items():
        if given.get(name) is None:
            if arg.required:
                raise ArgumentError(f"{tool} needs {name}")
            out[name] = arg.default
        else:
            out[name] = arg.check(name, given[name])
    return out


def call(g: Graph, tool: str, **given: Any) -> DataFrame:
    """Run a named query. Arguments are checked before any job starts."""
    checked = arguments(tool, given)
    return TOOLS[tool][1](g, checked)


def schema(tool: str) -> dict[str, dict]:
    """A tool's arguments as plain data, for clients."""
    return {n: {"type": a.kind.__name__, "required": a.required, "default": a.default, "values": list(a.values), "low": a.low, "high": a.high, "list": a.many} for n, a in spec(tool).items()}
