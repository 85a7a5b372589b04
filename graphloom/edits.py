"""Source edits: what to change is planned from the graph, checked by parsing, and only then written.

Every edit is refused whole: nothing is written unless all files of it parse afterwards.
"""

from __future__ import annotations

import os
import re
import tempfile
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from graphloom.model import LIVE, Graph
from graphloom.operators.lookup import require_symbol
from graphloom.sources.golang.syntax import KEYWORDS, Lines, Node, SyntaxProblem, parse


class Refused(ValueError):
    """The edit can't be made safely."""


@dataclass
class Edit:
    action: str
    symbol: str
    files: dict[str, str]
    sites: int = 0
    unchanged: bool = False
    shadowed: list[str] = field(default_factory=list)

    def apply(self) -> None:
        """Write all files, each by a rename from a temporary one beside it; modes stay."""
        for path, text in self.files.items():
            folder = os.path.dirname(path) or "."
            with tempfile.NamedTemporaryFile("w", dir=folder, delete=False) as f:
                f.write(text)
            os.chmod(f.name, os.stat(path).st_mode)
            os.replace(f.name, path)


def checked(text: str, what: str) -> str:
    try:
        parse(text)
    except SyntaxProblem as e:
        raise Refused(f"{what} would break the file: {e}") from e
    return text


def snippet(text: str) -> str:
    if not text.strip():
        raise Refused("the text is empty")
    try:
        parse("package snippet\n" + text)
    except SyntaxProblem as e:
        raise Refused(f"the text doesn't parse: {e}") from e
    return text


def target(g: Graph, name: str):
    """The symbol's row; a name declared more than once is refused."""
    name = require_symbol(g, name)
    rows = g.symbols.where(F.col("qualified_name") == name).limit(2).collect()
    if len(rows) != 1:
        raise Refused(f"{name} has {len(rows)} declarations")
    return rows[0]


@dataclass
class Span:
    start: int
    end: int
    doc: int
    members: int


def located(text: str, row) -> Span:
    """Offsets of a symbol's declaration: of the whole group if it is one of several in it."""
    tree, comments = parse(text)
    lines = Lines(text)
    for decl in tree.decls:
        inner = [decl] if decl.kind == "FuncDecl" else decl.specs
        for spec in inner:
            names = spec.names if spec.kind == "ValueSpec" else [spec.name]
            if any(n.name == row["name"] and row["pos_line"] in (lines.at(n.start)[0], lines.at(spec.start)[0]) for n in names):
                start, end = decl.start, max(decl.end, *(s.end for s in inner))
                doc, above = start, lines.at(start)[0]
                for a, b, _ in reversed(comments):
                    if b <= start and lines.at(b)[0] == above - 1:
                        doc, above = a, lines.at(a)[0]
                members = sum(len(s.names) if s.kind == "ValueSpec" else 1 for s in inner)
                return Span(start, end, doc, members)
    raise Refused(f"{row['qualified_name']} isn't where the index says; the file has changed")


def read(path: str) -> str:
    with open(path) as f:
        return f.read()


def ungrouped(span: Span, row, action: str) -> None:
    if span.members > 1:
        raise Refused(f"can't {action} {row['qualified_name']}: it is one of {span.members} in a grouped declaration")


def replace_body(g: Graph, name: str, body: str, with_doc: bool = False) -> Edit:
    """The declaration replaced by another text."""
    row = target(g, name)
    text = read(row["pos_file"])
    span = located(text, row)
    ungrouped(span, row, "replace")
    start = span.doc if with_doc else span.start
    if text[start : span.end] == body:
        return Edit("replace", row["qualified_name"], {}, unchanged=True)
    return Edit("replace", row["qualified_name"], {row["pos_file"]: checked(text[:start] + snippet(body) + text[span.end :], "the replacement")}, 1)


def insert(g: Graph, name: str, new: str, after: bool) -> Edit:
    """Text before (above the comment of) or after a declaration, one empty line apart."""
    row = target(g, name)
    text = read(row["pos_file"])
    span = located(text, row)
    at = span.end if after else span.doc
    head, tail = text[:at].rstrip("\n"), text[at:].lstrip("\n")
    joined = f"{head}\n\n{snippet(new).strip(chr(10))}\n" + (f"\n{tail}" if tail else "")
    return Edit("insert", row["qualified_name"], {row["pos_file"]: checked(joined, "the insertion")}, 1)


def delete(g: Graph, name: str, exported: bool = False, test_only: bool = False) -> Edit:
    """The declaration and its comment removed, if nothing indexed uses it."""
    row = target(g, name)
    text = read(row["pos_file"])
    span = located(text, row)
    ungrouped(span, row, "delete")
    if row["exported"] and not exported:
        raise Refused(f"{row['qualified_name']} is exported: code outside of the index may use it")
    uses = g.edges.where((F.col("to_ref") == row["qualified_name"]) & F.col("edge_type").isin(*LIVE)).select("from_ref", "pos_file", "pos_line").orderBy("pos_file", "pos_line").collect()
    only_tests = all(u["pos_file"].endswith("_test.go") for u in uses)
    if uses and not (only_tests and test_only):
        where = ", ".join(f"{u['from_ref']} ({u['pos_file']}:{u['pos_line']})" for u in uses[:10])
        raise Refused(f"{row['qualified_name']} is used {len(uses)} times: {where}" + ("; all in tests" if only_tests else ""))
    head, tail = text[: span.doc], text[span.end :].removeprefix("\n")
    if head.endswith("\n\n") and tail.startswith("\n"):
        tail = tail[1:]
    return Edit("delete", row["qualified_name"], {row["pos_file"]: checked(head + tail, "the deletion")}, 1)


def rename(g: Graph, name: str, new: str, force: bool = False) -> Edit:
    """The symbol renamed at its declaration and at every indexed use."""
    row = target(g, name)
    old, ref = row["name"], row["qualified_name"]
    if new == old:
        raise Refused(f"{ref} already has this name")
    if not re.fullmatch(r"[^\W\d]\w*", new) or new in KEYWORDS:
        raise Refused(f"{new!r} isn't an identifier")
    owner = ref.removesuffix(f".{old}")
    same = g.symbols.where(F.col("name") == new)
    clash = same.where(F.col("qualified_name") == f"{owner}.{new}") if row["kind"] == "method" else same.where((F.col("package_path") == row["package_path"]) & (F.col("kind") != "method"))
    if not clash.isEmpty():
        raise Refused(f"{owner} already declares {new}")
    edges = g.edges.where((F.col("to_ref") == ref) & F.col("edge_type").isin(*LIVE))
    homes = g.symbols.select(F.col("qualified_name").alias("from_ref"), F.col("package_path").alias("home")).distinct()
    sites = edges.join(homes, "from_ref", "left").select("home", F.explode("sites").alias("s")).where("s.file <> ''").select("home", "s.*").distinct().collect()
    if not row["exported"] and (far := [s for s in sites if s["home"] not in (None, row["package_path"], row["package_path"] + "_test")]):
        raise Refused(f"{ref} is unexported, but used in {far[0]['home']}")
    if row["exported"] and not new[:1].isupper() and any(s["home"] != row["package_path"] for s in sites):
        raise Refused(f"{new} would be unexported, but other packages use {ref}")
    places: dict[str, set[tuple[int, int]]] = {}
    for s in sites:
        places.setdefault(s["file"], set()).add((s["line"], s["column"]))
    places.setdefault(row["pos_file"], set())
    files, shadowed, count = {}, [], 0
    for path, marks in places.items():
        text = read(path)
        tree, _ = parse(text)
        lines = Lines(text)
        idents = {lines.at(n.start): n for n in tree.walk() if n.kind == "Ident" and n.name == old}
        if path == row["pos_file"]:
            declared = [n for at, n in idents.items() if at[0] == row["pos_line"]]
            if not declared:
                raise Refused(f"{ref} isn't where the index says; {path} has changed")
            marks = marks | {lines.at(declared[0].start)}
        chosen = []
        for mark in sorted(marks):
            node = idents.get(mark)
            if node is None:
                raise Refused(f"{path}:{mark[0]}:{mark[1]} isn't {old} any more")
            if hidden(tree, node, old):
                shadowed.append(f"{path}:{mark[0]}")
            chosen.append(node)
        for node in sorted(chosen, key=lambda n: -n.start):
            text = text[: node.start] + new + text[node.end :]
        count += len(chosen)
        files[path] = checked(text, "the rename")
    if shadowed and not force:
        raise Refused(f"a local {old} may be meant at {', '.join(shadowed)}")
    return Edit("rename", ref, files, count, shadowed=shadowed)


def hidden(tree: Node, node: Node, name: str) -> bool:
    """Whether a function around the node declares a local of this name."""
    for f in tree.decls:
        if f.kind == "FuncDecl" and f.start <= node.start < f.end and f.name is not node:
            fields = [*(f.receiver or []), *f.type.params, *f.type.results]
            local = [n for x in fields for n in x.names]
            for inner in f.body.walk() if f.body else ():
                if inner.kind in ("Assign", "Range") and inner.op == ":=":
                    local += [x for x in inner.left if x.kind == "Ident"]
                elif inner.kind == "ValueSpec":
                    local += inner.names
                elif inner.kind == "FuncLit":
                    local += [n for x in inner.type.params for n in x.names]
            return any(n.name == name for n in local)
    return False
