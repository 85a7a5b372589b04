"""Structural search: a piece of Go with metavariables against the syntax trees of files.

`$NAME` stands for any node; the same name twice for equal ones. In a composite literal a last `...` stands for any
further elements. Patterns are expressions, else statements, else declarations; a pattern is exactly one node.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import Graph
from graphloom.operators.lookup import enclosing
from graphloom.plans.materialize import cut, dealt, shipped
from graphloom.sources.golang.syntax import TOKEN, Lines, Node, Parser, SyntaxProblem, parse, uncollected

META = "metavar__"
STATEMENTS = ("ExprStmt",)


@dataclass
class Pattern:
    root: Node
    literals: list[str]


def compiled(source: str) -> Pattern:
    """The tree of a pattern, and the tokens that a file with a match must contain."""
    text, literals, at = [], [], 0
    while at < len(source):
        if m := re.compile(r"\$([A-Z][A-Z0-9_]*)").match(source, at):
            before = "".join(text).rstrip()
            whole = re.search(r"(^|[\s;{])(defer|go)$", before) and not source[m.end() :].lstrip().startswith(("(", "."))
            text.append(META + m[1] + ("()" if whole else ""))
            at = m.end()
            continue
        m = TOKEN.match(source, at)
        if not m:
            raise ValueError(f"pattern: unexpected character {source[at]!r}")
        if m.lastgroup in ("ident", "number", "string", "rune"):
            literals.append(m.group())
        text.append(m.group())
        at = m.end()
    code, problem = "".join(text), None
    for read in (expression, statement, declaration):
        try:
            return Pattern(read(code), literals)
        except SyntaxProblem as e:
            problem = problem or e
    raise ValueError(f"pattern doesn't parse: {problem.message}")


def whole(parser: Parser, node: Node) -> Node:
    while parser.maybe(";"):
        pass
    if parser.kind != "eof":
        parser.fail("a pattern is one node")
    return node


def expression(code: str) -> Node:
    p = Parser(code)
    return whole(p, p.expression())


def statement(code: str) -> Node:
    p = Parser(code)
    return whole(p, p.statement())


def declaration(code: str) -> Node:
    p = Parser(code)
    return whole(p, p.declaration())


def metavariable(node) -> str | None:
    """The name a pattern node binds: a placeholder, alone, as a statement or called without arguments."""
    if not isinstance(node, Node):
        return None
    if node.kind == "ExprStmt":
        return metavariable(node.fields["value"])
    if node.kind == "Call" and not node.args and not node.spread:
        node = node.function
    return node.name.removeprefix(META) if node.kind == "Ident" and node.name.startswith(META) else None


def matches(pattern, node, bound: dict[str, Node]) -> bool:
    """Whether a node has the pattern's shape; fills in what its metavariables stand for."""
    if (name := metavariable(pattern)) is not None:
        if not isinstance(node, Node):
            return False
        return bound.setdefault(name, node) == node
    if isinstance(pattern, list):
        if not isinstance(node, list):
            return False
        if pattern and isinstance(pattern[-1], Node) and pattern[-1].kind == "Ellipsis" and pattern[-1].type is None:
            pattern = pattern[:-1]
            return len(node) >= len(pattern) and all(matches(p, n, bound) for p, n in zip(pattern, node, strict=False))
        return len(pattern) == len(node) and all(matches(p, n, bound) for p, n in zip(pattern, node, strict=True))
    if not isinstance(pattern, Node):
        return pattern == node
    return isinstance(node, Node) and pattern.kind == node.kind and all(matches(p, node.fields.get(k), bound) for k, p in pattern.fields.items())


def found(pattern: Pattern, text: str) -> Iterator[tuple[int, int, str]]:
    """(line, column, source) of each node that matches. A file that doesn't parse has none."""
    try:
        tree, _ = parse(text)
    except SyntaxProblem:
        return
    lines = Lines(text)
    kind = None if metavariable(pattern.root) is not None else pattern.root.kind
    for node in tree.walk():
        # A bare expression stands in its statement; it is found once, as the expression.
        if (kind is None or node.kind == kind) and node.kind not in STATEMENTS and matches(pattern.root, node, {}):
            yield *lines.at(node.start), text[node.start : node.end]


def pattern_search(g: Graph, source: str, file: str | None = None, repo: str | None = None) -> DataFrame:
    """file, line, column, text, symbol: matches in order of file, line and text, each with its nearest declaration.

    Files without the pattern's literal tokens are filtered out before any is parsed.
    """
    shipped(g.spark)
    pattern = compiled(source)
    files = g.files.where(F.endswith("path", F.lit(".go")))
    for literal in dict.fromkeys(pattern.literals):
        files = files.where(F.contains("content", F.lit(literal)))
    if file:
        files = files.where(F.contains("path", F.lit(file)))
    if repo:
        files = files.where(F.col("repo") == repo)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with uncollected():
            for path, content in (x for b in batches for x in zip(*b.columns, strict=True)):
                rows = [(path.as_py(), *hit) for hit in found(pattern, content.as_py())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["file", "line", "column", "text"])

    hits = dealt(files.select("path", "content")).mapInArrow(run, "file string, line int, column int, text string")
    if g.symbols is None:
        return hits
    # Hits are read twice, files parsed once.
    hits = cut(hits)
    near = enclosing(hits, g.symbols).withColumnsRenamed({"file": "_f", "line": "_l", "enclosing": "symbol"})
    return hits.join(near, (hits["file"] == F.col("_f")) & (hits["line"] == F.col("_l"))).drop("_f", "_l").orderBy("file", "line", "text")
