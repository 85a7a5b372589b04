"""Contracts that only show at run time: keys, subjects and message types in string literals.

An extractor says which method calls, config literals, plain literals and switch cases name an entity, and how such names
are normalised. Calls and cases are read from the syntax tree; a file that doesn't parse still has its literals scanned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.model import Graph
from graphloom.operators.contracts import constants_of
from graphloom.operators.lookup import enclosing
from graphloom.plans.materialize import cut, dealt, shipped
from graphloom.sources.golang.syntax import Lines, Node, SyntaxProblem, parse, uncollected

#: Rules (regular expression, replacement) of the built-in normalisers, in order.
REDIS_RULES = ((r"\d{4}-\d{2}-\d{2}", "{date}"), (r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "{ip}"), (r"[a-f0-9-]{36}", "{id}"), (r"<[^>]+>", ":{name}"), (r"%[sdv]", ":{name}"))
SUBJECT_RULES = ((r"<[^>]+>", ":request_id"), (r"[a-f0-9-]{36}", ":id"), (r"%[sdv]", ":request_id"))
NORMALIZERS = {"raw": (), "redis": REDIS_RULES, "subject": SUBJECT_RULES}
#: Fields that tell a message's type.
SUBJECTS = ("For", "MsgType", "Msgtype")


@dataclass(frozen=True)
class Extractor:
    kind: str
    name: str = ""
    producers: tuple[str, ...] = ()
    consumers: tuple[str, ...] = ()
    imports: tuple[str, ...] = ()
    config: tuple[str, ...] = ()
    literals: tuple[str, ...] = ()
    const_prefix: str = ""
    decode_switch: bool = False
    argument: int = 0
    normalize: str = "raw"
    rules: tuple[tuple[str, str], ...] = field(default=())


#: The built-in extractors' methods, gates and literal shapes.
DEFAULTS = (
    Extractor("redis", "redis", ("Set", "LPush", "RPush", "SAdd", "ZAdd", "Incr", "Decr", "MSet", "HSet", "Expire", "Del"), ("Get", "Exists", "Scan", "HGet", "LPop", "RPop", "SMembers", "ZRange", "MGet"), ("redis", "valkey", "rueidis", "keydb"), literals=(r'"([a-z][a-z0-9_-]*/)"',), normalize="redis"),
    Extractor("jetstream", "jetstream", ("Publish", "PublishResponse"), ("Subscribe", "SubscribeSync"), ("nats",), (r'StreamConfig\s*\{[^}]*?(?:Name|Subject|FilterSubject)\s*:\s*\[?[^"]*"([^"\n]+)"',), (r'"([a-z][a-z0-9_]*(?:\.[a-z0-9_]+)*\.>)"',), normalize="subject"),
    Extractor("ws_type", "ws_type", const_prefix="MsgType", decode_switch=True),
)


def merged(defaults: tuple[Extractor, ...], custom: tuple[Extractor, ...]) -> tuple[Extractor, ...]:
    """Custom extractors extend the one of their kind: lists are united, given values win; new kinds are added."""
    out = list(defaults)
    for c in custom:
        k = next((i for i, e in enumerate(out) if e.kind == c.kind), None)
        if k is None:
            out.append(c)
            continue
        e = out[k]
        lists = {n: tuple(dict.fromkeys((*getattr(e, n), *getattr(c, n)))) for n in ("producers", "consumers", "imports", "config", "literals")}
        out[k] = replace(e, **lists, const_prefix=c.const_prefix or e.const_prefix, decode_switch=e.decode_switch or c.decode_switch, argument=c.argument or e.argument, rules=e.rules + c.rules)
    return tuple(out)


def rules_of(e: Extractor) -> tuple[tuple[str, str], ...]:
    return NORMALIZERS[e.normalize] + e.rules


def normalized(column: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """Quotes off, then each rule in turn."""
    out = F.regexp_replace(column, '^["`]+|["`]+$', "")
    for pattern, by in rules:
        out = F.regexp_replace(out, pattern, by.replace("$", r"\$"))
    return out


def literal(node) -> str | None:
    return node.text[1:-1] if isinstance(node, Node) and node.kind == "Literal" and node.type == "string" else None


def scan(e: Extractor, text: str) -> Iterator[tuple[str, str, int, str]]:
    """(direction, literal or name, line, how) of the entities in a file; `how` tells the names of constants."""
    lines = Lines(text)
    recorded = set()
    try:
        tree = parse(text)[0]
    except SyntaxProblem:
        tree = None
    gate = [i.path for i in tree.imports] if tree else re.findall(r'^\s*(?:import\s+)?(?:\w+\s+)?"([^"]+)"', text, re.M)
    if e.imports and not any(part in path for path in gate for part in e.imports):
        return
    methods = dict.fromkeys(e.consumers, "consumer") | dict.fromkeys(e.producers, "producer")
    for node in tree.walk() if tree and (methods or e.decode_switch) else ():
        if node.kind == "Call":
            f = node.function.fields["value"] if node.function.kind == "Index" else node.function
            if f.kind == "Selector" and f.name.name in methods:
                line = lines.at(f.name.start)[0]
                strings = [v for a in node.args if (v := literal(a)) is not None]
                for value in strings[e.argument :]:
                    recorded.add((value, line))
                    yield methods[f.name.name], value, line, "call"
        elif node.kind == "Switch" and e.decode_switch and message_subject(node) and (not e.const_prefix or uses_prefix(e.const_prefix, text)):
            for clause in node.clauses:
                line = lines.at(clause.start)[0]
                for v in clause.values:
                    if (value := literal(v)) is not None:
                        yield "consumer", value, line, "case"
                    elif v.kind == "Ident" or v.kind == "Selector" and v.fields["value"].kind == "Ident":
                        name = v.name if v.kind == "Ident" else f"{v.fields['value'].name}.{v.name.name}"
                        yield "consumer", name, line, "name"
    for k, row in enumerate(text.split("\n"), 1):
        for pattern in e.config:
            if m := re.search(pattern, row):
                recorded.add((m[1], k))
                yield "producer", m[1], k, "config"
    seen = set()
    for k, row in enumerate(text.split("\n"), 1):
        for pattern in e.literals:
            for m in re.finditer(pattern, row):
                if m[1] and m[1] not in seen:
                    seen.add(m[1])
                    if (m[1], k) not in recorded:
                        yield "shared", m[1], k, "literal"


def message_subject(node: Node) -> bool:
    """Whether a switch is on a message's type: a field that is one by name, or a name that says so."""
    tag = node.tag
    if tag is None:
        return False
    if tag.kind == "ExprStmt":
        tag = tag.fields["value"]
    if tag.kind == "Selector":
        return tag.name.name in SUBJECTS
    return tag.kind == "Ident" and "msgtype" in tag.name.lower()


def uses_prefix(prefix: str, text: str) -> bool:
    return re.search(rf"(?<![\w]){re.escape(prefix)}", text) is not None


def sites(files: DataFrame, e: Extractor) -> DataFrame:
    """file, repo, line, direction, value, how for one extractor; its method names filter the files before the scan."""
    shipped(files.sparkSession)
    words = [*e.producers, *e.consumers]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
        with uncollected():
            for path, content, repo in (x for b in batches for x in zip(*b.columns, strict=True)):
                p, r = path.as_py(), repo.as_py()
                rows = [(p, r, line, d, v, how) for d, v, line, how in scan(e, content.as_py() or "")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=["file", "repo", "line", "direction", "value", "how"])

    gated = files.select("path", "content", "repo")
    if e.imports:
        gated = gated.where(F.col("content").rlike("|".join(map(re.escape, e.imports))))
    elif words:
        gated = gated.where(F.col("content").rlike("|".join(words)))
    elif e.const_prefix:
        gated = gated.where(F.contains("content", F.lit(e.const_prefix)))
    return dealt(gated).mapInArrow(run, "file string, repo string, line int, direction string, value string, how string")


def runtime_contracts(g: Graph, extractors: tuple[Extractor, ...] = DEFAULTS) -> DataFrame:
    """kind, pattern, from_ref, direction, evidence, repo: entities of all extractors.

    Constants with an extractor's prefix are shared entities. A case that names a constant stands for the values of the
    constants of that name in its own package, or with a qualifier in any package whose path ends in it.
    """
    every, constants = None, constants_of(g.symbols)
    package = g.symbols.groupBy(F.col("pos_file").alias("_file")).agg(F.min("package_path").alias("_package"))
    for e in extractors:
        # Read for each way of naming and again for what encloses them, but files are parsed once.
        found = cut(sites(g.files, e))
        names = found.where("how = 'name'").join(package, F.col("file") == F.col("_file"))
        bare = names.where("not contains(value, '.')").join(constants.select("ref", F.col("value").alias("v")), F.concat("_package", F.lit("."), "value") == F.col("ref"))
        base = constants.select(F.concat(F.substring_index("package_path", "/", -1), F.lit("."), "name").alias("ref"), F.col("value").alias("v"))
        far = names.where("contains(value, '.')").join(base, F.col("value") == F.col("ref"))
        keep = ["file", "repo", "line", "direction", F.col("v").alias("value"), F.lit("case").alias("how")]
        rows = found.where("how <> 'name'").unionByName(bare.select(*keep)).unionByName(far.select(*keep))
        near = enclosing(rows, g.symbols).withColumnsRenamed({"file": "_f", "line": "_l"})
        rows = rows.join(near, (F.col("file") == F.col("_f")) & (F.col("line") == F.col("_l")))
        evidence = F.concat(F.lit(e.name or e.kind), F.lit(" "), "how", F.lit(' "'), "value", F.lit('" at '), "file", F.lit(":"), F.col("line").cast("string"))
        rows = rows.select(F.lit(e.kind).alias("kind"), normalized(F.col("value"), rules_of(e)).alias("pattern"), F.col("enclosing").alias("from_ref"), "direction", evidence.alias("evidence"), "repo")
        if e.const_prefix:
            own = constants.where(F.startswith("name", F.lit(e.const_prefix)))
            rows = rows.unionByName(own.select(F.lit(e.kind).alias("kind"), normalized(F.col("value"), rules_of(e)).alias("pattern"), F.col("ref").alias("from_ref"), F.lit("shared").alias("direction"), F.concat(F.lit(f"{e.name or e.kind} constant "), "name").alias("evidence"), "repo"))
        every = rows if every is None else every.unionByName(rows)
    return every.distinct()
