"""Command line: index a module or workspace into a store, and run a named query on it.

    python -m graphloom index ROOT STORE
    python -m graphloom workspace CONFIG STORE
    python -m graphloom query STORE TOOL [name=value ...] [--format table|json|compact]
    python -m graphloom tools
    python -m graphloom serve STORE [name=ROOT ...] [--allow-write]
"""

from __future__ import annotations

import json
import sys

from graphloom import server, surface
from graphloom.render import render


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("graphloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def value(text: str):
    """An argument's value: JSON where it is, else the text."""
    try:
        return json.loads(text)
    except ValueError:
        return text


def main(args: list[str]) -> int:
    from graphloom.sources.go_source import index, index_workspace, read_files
    from graphloom.sources.sinks import Store
    from graphloom.sources.workspace import load

    if args[:1] == ["tools"]:
        for tool in surface.TOOLS:
            print(tool, json.dumps(surface.schema(tool)))
        return 0
    if args[:1] == ["index"] and len(args) == 3:
        spark = session()
        print(Store(spark, args[2]).write(index(read_files(spark, args[1]))))
        return 0
    if args[:1] == ["workspace"] and len(args) == 3:
        spark, config = session(), load(args[1])
        print(Store(spark, args[2]).write(index_workspace(spark, config.members)))
        return 0
    if args[:1] == ["serve"] and len(args) >= 2:
        store = Store(session(), args[1])
        roots = dict(x.split("=", 1) for x in args[2:] if "=" in x)
        server.serve(store.read(), sys.stdin, sys.stdout, roots=roots, store=store, allow_write="--allow-write" in args)
        return 0
    if args[:1] == ["query"] and len(args) >= 3:
        form, rest = "table", args[3:]
        if "--format" in rest:
            k = rest.index("--format")
            form, rest = rest[k + 1], rest[:k] + rest[k + 2 :]
        given = {n: value(v) for n, _, v in (x.partition("=") for x in rest)}
        surface.arguments(args[2], given)
        try:
            print(render(args[2], surface.call(Store(session(), args[1]).read(), args[2], **given), form))
        except LookupError as e:
            print(e, file=sys.stderr)
            return 1
        return 0
    print(__doc__, file=sys.stderr)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
