"""Lookups, filters and listings over symbols, packages, edges and files.

Every operator is a function of the Graph that returns a DataFrame. Where an order matters it is a column (`rank`), so
that it survives shuffles. Names that aren't indexed raise NotFound with candidates: an empty result is never a typo.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.model import KINDS, LIVE, TYPE_KINDS, Ambiguous, Graph, NotFound, normalize_name
from graphloom.plans.materialize import cut

GENERATED = ("any", "exclude", "only")


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """df with a 1-based rank, for results that a limit bounds: one task orders them."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def ranked_wide(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """df with a 1-based rank, of any size: rows are dealt by ranges of the order, numbered within, and shifted by the
    sizes of the ranges before (one row for each)."""
    keys = [f"_o{k}" for k in range(len(order))]
    rows = df.select("*", *(c.alias(k) for k, c in zip(keys, order, strict=True)))
    # A descending key sorts by its own direction; ranges are cut on plain columns.
    rows = cut(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return rows.withColumn("_at", within).join(F.broadcast(sizes), "_part").withColumn(name, (F.col("_at") + F.col("_before")).cast("int")).drop("_part", "_before", "_at", *keys)


# -- filters ---------------------------------------------------------------------------------------------------------


def symbol_filter(symbols: DataFrame, tests: bool = False, generated: str = "any", kind: str | None = None, exported: bool | None = None, file: str | None = None, package: str | None = None, repo: str | None = None) -> DataFrame:
    """The usual filters, each pushed to the scan. kind `type` also means interfaces and aliases."""
    if generated not in GENERATED:
        raise ValueError(f"generated must be one of {GENERATED}")
    if kind is not None and kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    if not tests:
        symbols = symbols.where(~F.col("is_test"))
    if generated != "any":
        symbols = symbols.where(F.col("is_generated") if generated == "only" else ~F.col("is_generated"))
    if kind is not None:
        symbols = symbols.where(F.col("kind").isin(*(TYPE_KINDS if kind == "type" else (kind,))))
    if exported is not None:
        symbols = symbols.where(F.col("exported") == exported)
    for column, value in (("package_path", package), ("repo", repo)):
        if value:
            symbols = symbols.where(F.col(column) == value)
    return symbols.where(F.contains("pos_file", F.lit(file))) if file else symbols


def edge_filter(edges: DataFrame, types=(), repo: str | None = None) -> DataFrame:
    """Edges of the types (all if none is given) and of the repository."""
    if types:
        edges = edges.where(F.col("edge_type").isin(*types))
    return edges.where(F.col("repo") == repo) if repo else edges


def without_test_sites(edges: DataFrame) -> DataFrame:
    """Edges with a site outside of test files, their test sites removed; the position is the first site left."""
    left = edges.withColumn("sites", F.filter("sites", lambda s: ~X.is_test_file(s["file"]))).where(F.size("sites") > 0)
    first = F.get("sites", F.lit(0))
    return left.withColumn("pos_file", first["file"]).withColumn("pos_line", first["line"])


def mark_external(edges: DataFrame, g: Graph) -> DataFrame:
    """edges with external: to_ref is neither an indexed symbol nor a package."""
    known = g.symbols.select(F.col("qualified_name").alias("_n")).unionAll(g.packages.select("path")).distinct()
    return edges.join(known, edges["to_ref"] == F.col("_n"), "left").withColumn("external", F.col("_n").isNull()).drop("_n")


# -- existence -------------------------------------------------------------------------------------------------------


def suggestions(g: Graph, name: str, limit: int = 5) -> DataFrame:
    """qualified_name, rank: candidates for a name that isn't there: same short name, same package, then the rest.

    Candidates are symbols whose name or qualified name contains the short name.
    """
    short = name.rpartition(".")[2]
    package = name.rpartition(".")[0]
    found = g.symbols.where(X.contains_ci(F.col("name"), short) | X.contains_ci(F.col("qualified_name"), short))
    rank = F.when(F.col("name") == short, 0).when(F.startswith("qualified_name", F.lit(package + ".")) if package else F.lit(False), 1).otherwise(2)
    best = found.groupBy("qualified_name").agg(F.min(rank).alias("tier")).orderBy("tier", "qualified_name").limit(limit)
    return ranked(best, F.col("tier"), F.col("qualified_name"))


def require_symbol(g: Graph, name: str) -> str:
    """The normalised name, if it is a symbol or a package."""
    name = normalize_name(name)
    if g.symbols.where(F.col("qualified_name") == name).isEmpty() and g.packages.where(F.col("path") == name).isEmpty():
        raise NotFound(f"symbol not found: {name}", [r["qualified_name"] for r in suggestions(g, name).orderBy("rank").collect()])
    return name


def resolve_type(g: Graph, name: str) -> str:
    """The qualified name of a type given by its qualified or short name."""
    name = normalize_name(name)
    types = g.symbols.where(F.col("kind").isin(*TYPE_KINDS))
    exact = types.where((F.col("qualified_name") == name) | (F.col("name") == name)).select("qualified_name").distinct().limit(6).collect()
    names = sorted(r[0] for r in exact)
    if name in names:
        return name
    if not names:
        raise NotFound(f"type not found: {name}", [r["qualified_name"] for r in suggestions(g, name).orderBy("rank").collect()])
    if len(names) > 1:
        raise Ambiguous(f"{name} is ambiguous: {', '.join(names)}")
    return names[0]


# -- packages --------------------------------------------------------------------------------------------------------


def list_packages(g: Graph, tests: bool = False, repo: str | None = None) -> DataFrame:
    """path, name, repo, is_test, is_generated, missing, sym_count."""
    counts = g.symbols.groupBy("package_path").agg(F.count("*").alias("sym_count"))
    packages = g.packages if tests else g.packages.where(~F.col("is_test"))
    if repo:
        packages = packages.where(F.col("repo") == repo)
    rows = packages.join(counts, packages["path"] == counts["package_path"], "left").join(g.repos.select(F.col("module_path").alias("_m"), "missing"), F.col("repo") == F.col("_m"), "left")
    return rows.select("path", "name", "repo", "is_test", "is_generated", "missing", F.coalesce("sym_count", F.lit(0)).alias("sym_count"))


def import_counts(g: Graph) -> DataFrame:
    """path, imports: distinct targets with a site outside of test files."""
    rows = g.edges.where(F.col("edge_type") == "imports").select("from_ref", "to_ref", F.explode("sites").alias("s")).where(~X.is_test_file(F.col("s.file")))
    return rows.groupBy(F.col("from_ref").alias("path")).agg(F.countDistinct("to_ref").alias("imports"))


def overview(g: Graph, tests: bool = False, repo: str | None = None) -> DataFrame:
    """list_packages with imports and the numbers of exported and other symbols."""
    split = g.symbols.groupBy(F.col("package_path").alias("_p")).agg(F.count_if("exported").alias("exported"), F.count_if(~F.col("exported")).alias("unexported"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = list_packages(g, tests, repo).join(import_counts(g).withColumnRenamed("path", "_i"), F.col("path") == F.col("_i"), "left").join(split, F.col("path") == F.col("_p"), "left")
    return rows.select("path", "repo", "sym_count", zero("imports"), zero("exported"), zero("unexported"))


def totals(g: Graph) -> DataFrame:
    """relation, n: sizes of packages, symbols and edges, index-wide, whatever a listing filters."""
    sizes = [r.agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "n") for name, r in (("packages", g.packages), ("symbols", g.symbols), ("edges", g.edges))]
    return sizes[0].unionAll(sizes[1]).unionAll(sizes[2])


def package(g: Graph, path: str, unexported: bool = False, tests: bool = True) -> DataFrame:
    """Symbols of one package."""
    if g.packages.where(F.col("path") == path).isEmpty():
        near = g.packages.where(X.contains_ci(F.col("path"), path.rpartition("/")[2])).orderBy("path").limit(5).collect()
        raise NotFound(f"package not found: {path}", [r["path"] for r in near])
    rows = symbol_filter(g.symbols, tests=tests, package=path)
    return (rows if unexported else rows.where("exported")).select("qualified_name", "kind", "signature", "pos_file", "pos_line")


def repo_states(g: Graph) -> DataFrame:
    """module_path, state: missing, stale (a package without symbols) or indexed, with the number of packages."""
    packages = g.packages.groupBy(F.col("repo").alias("_r")).agg(F.count("*").alias("packages"))
    rows = g.repos.join(packages, g.repos["module_path"] == F.col("_r"), "left")
    return rows.select("module_path", F.when(F.col("missing"), "missing").when(F.col("packages").isNull(), "stale").otherwise("indexed").alias("state"), F.coalesce("packages", F.lit(0)).alias("packages"))


# -- symbols ---------------------------------------------------------------------------------------------------------


def show(g: Graph, name: str) -> DataFrame:
    """section (declaration, incoming, outgoing), ref, edge_type or kind, external: one symbol with its edges."""
    name = require_symbol(g, name)
    declared = g.symbols.where(F.col("qualified_name") == name).select(F.lit("declaration").alias("section"), F.col("qualified_name").alias("ref"), F.col("kind").alias("what"), F.lit(False).alias("external"))
    edges = g.edges.select("from_ref", "to_ref", "edge_type")
    incoming = edges.where(F.col("to_ref") == name).select(F.lit("incoming").alias("section"), F.col("from_ref").alias("ref"), F.col("edge_type").alias("what"), F.lit(False).alias("external"))
    outgoing = mark_external(edges.where(F.col("from_ref") == name), g).select(F.lit("outgoing").alias("section"), F.col("to_ref").alias("ref"), F.col("edge_type").alias("what"), "external")
    return declared.unionAll(incoming).unionAll(outgoing)


def search_rank(pattern: str) -> list[Column]:
    """Tier of the match, exported, kind, tests and generated code last; then pass and name, so the order is total."""
    p = pattern.lower()
    tier = lambda c: F.when(F.lower(c) == p, 0).when(F.startswith(F.lower(c), F.lit(p)), 1).otherwise(2)
    kind = F.when(F.col("kind").isin("function", "method"), 0).when(F.col("kind").isin(*TYPE_KINDS), 1).otherwise(2)
    best = F.least(tier(F.col("name")), tier(F.col("qualified_name")))
    return [best, ~F.col("exported"), kind, F.col("is_test"), F.col("is_generated"), F.col("pass"), F.col("qualified_name"), F.col("pos_file"), F.col("pos_line")]


FOUND = ("qualified_name", "kind", "signature", "pos_file", "pos_line")


def first_pass(*passes: DataFrame) -> DataFrame:
    """The ordered union of lists of symbols: each (qualified_name, pos_file, pos_line) once, from its first list."""
    rows = None
    for k, found in enumerate(passes):
        found = found.withColumn("pass", F.lit(k))
        rows = found if rows is None else rows.unionByName(found)
    key = Window.partitionBy("qualified_name", "pos_file", "pos_line").orderBy("pass")
    return rows.withColumn("_r", F.row_number().over(key)).where("_r = 1").drop("_r")


def search(g: Graph, pattern: str, limit: int | None = None, **filters) -> DataFrame:
    """Symbols found by whole tokens or name prefix, by the pattern's identifier runs, or as a substring; ranked.

    A pattern without a letter or digit finds nothing. limit keeps the best (a top-k).
    """
    from graphloom.operators.fulltext import symbol_matches

    symbols = symbol_filter(g.symbols, **filters)
    if not any(c.isalnum() for c in pattern):
        return symbols.where("false").select(*FOUND, F.lit(0).alias("rank"))
    loose = X.contains_ci(F.col("name"), pattern) | X.contains_ci(F.col("qualified_name"), pattern) | X.contains_ci(F.col("signature"), pattern) | X.contains_ci(F.col("doc"), pattern)
    rows = first_pass(symbol_matches(symbols, pattern), symbol_matches(symbols, pattern, runs=True), symbols.where(loose))
    if limit:
        return ranked(rows.orderBy(*search_rank(pattern)).limit(limit), *search_rank(pattern)).select(*FOUND, "rank")
    return ranked_wide(rows, *search_rank(pattern)).select(*FOUND, "rank")


def search_substring(g: Graph, pattern: str, **filters) -> DataFrame:
    """The substring pass alone, with its rank."""
    p = X.contains_ci
    rows = symbol_filter(g.symbols, **filters).where(p(F.col("name"), pattern) | p(F.col("qualified_name"), pattern) | p(F.col("signature"), pattern) | p(F.col("doc"), pattern))
    return ranked_wide(rows.withColumn("pass", F.lit(0)), *search_rank(pattern)).select(*FOUND, "rank")


def search_prefix(g: Graph, prefix: str, **filters) -> DataFrame:
    """Symbols whose name or qualified name starts with the prefix, case aside."""
    p = F.lit(prefix.lower())
    return symbol_filter(g.symbols, **filters).where(F.startswith(F.lower("qualified_name"), p) | F.startswith(F.lower("name"), p)).select(*FOUND)


def method_search(g: Graph, name: str, **filters) -> DataFrame:
    """Methods with exactly this name."""
    return symbol_filter(g.symbols, kind="method", **filters).where(F.col("name") == name).select(*FOUND)


def methods_of(g: Graph, type_name: str, **filters) -> DataFrame:
    """Methods declared on a type."""
    owner = resolve_type(g, type_name)
    return symbol_filter(g.symbols, kind="method", **filters).where(F.startswith("qualified_name", F.lit(owner + "."))).select(*FOUND)


def symbols_in_file(g: Graph, path: str) -> DataFrame:
    """Symbols of the files whose path contains `path`, tests aside."""
    return symbol_filter(g.symbols, file=path).select(*FOUND)


def symbol_edges(g: Graph) -> DataFrame:
    """Edges both of whose ends are indexed symbols."""
    names = g.symbols.select("qualified_name").distinct()
    kept = g.edges.join(names.withColumnRenamed("qualified_name", "from_ref"), "from_ref", "left_semi")
    return kept.join(names.withColumnRenamed("qualified_name", "to_ref"), "to_ref", "left_semi")


def edges_for(g: Graph, nodes: DataFrame, incoming: bool = False, types=()) -> DataFrame:
    """Edges out of (or into) the nodes (column node)."""
    near = "to_ref" if incoming else "from_ref"
    return edge_filter(g.edges, types).join(nodes.select(F.col("node").alias(near)).distinct(), near, "left_semi")


def diagnostics(g: Graph, file: str | None = None, repo: str | None = None) -> DataFrame:
    rows = g.diagnostics.where(F.endswith("file", F.lit(file))) if file else g.diagnostics
    return rows.where(F.col("repo") == repo) if repo else rows


def attribute(refs: DataFrame, packages: DataFrame) -> DataFrame:
    """refs (ref) with package_path: the ref itself, or its longest part before a dot that is a package. Others are dropped."""
    tried = refs.select("ref", F.explode(X.prefixes(F.col("ref"), ".")).alias("path"))
    found = tried.join(packages.select("path").distinct(), "path")
    return found.groupBy("ref").agg(F.max_by("path", F.length("path")).alias("package_path"))


def module_of(refs: DataFrame, repos: DataFrame) -> DataFrame:
    """refs (ref) with module_path: the longest module that ends at a slash or dot of the ref, null if none."""
    tried = refs.select("ref", F.explode(X.prefixes(F.col("ref"), ".", "/")).alias("module_path"))
    found = tried.join(repos.select("module_path").distinct(), "module_path").groupBy("ref").agg(F.max_by("module_path", F.length("module_path")).alias("module_path"))
    return refs.select("ref").distinct().join(found, "ref", "left")


def project_targets(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """imports (path) with target: the package itself or the one that ends in the path or that the path ends in; the
    longest shared end, then the least path."""
    paths = packages.select(F.col("path").alias("target")).distinct()
    long = imports.select("path", F.explode(X.suffixes(F.col("path"))).alias("target")).join(paths, "target").select("path", "target")
    short = paths.select("target", F.explode(X.suffixes(F.col("target"))).alias("path")).join(imports.select("path"), "path").select("path", "target")
    both = long.unionAll(short).distinct()
    best = F.row_number().over(Window.partitionBy("path").orderBy(F.col("target") != F.col("path"), F.least(F.length("target"), F.length("path")).desc(), "target"))
    return both.withColumn("_r", best).where("_r = 1").drop("_r")


def enclosing(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """points (file, line) with enclosing: the nearest declaration at or above the line in the same file, else the file.

    An as-of join as one union and one window, so no pair of a file is ever built.
    """
    marks = symbols.select(F.col("pos_file").alias("file"), F.col("pos_line").alias("line"), F.lit(0).alias("point"), F.col("qualified_name").alias("name"))
    asked = points.select("file", "line").distinct().select("file", "line", F.lit(1).alias("point"), F.lit(None).cast("string").alias("name"))
    order = Window.partitionBy("file").orderBy("line", "point", F.col("name").desc()).rowsBetween(Window.unboundedPreceding, 0)
    both = marks.unionAll(asked).withColumn("enclosing", F.last("name", ignorenulls=True).over(order))
    return both.where("point = 1").select("file", "line", F.coalesce("enclosing", "file").alias("enclosing"))


def find_declaration(g: Graph, file: str, line: int) -> DataFrame:
    """The innermost declaration whose span holds the line; spans: qualified_name, file, start_line, end_line."""
    rows = g.spans.where((F.col("file") == file) & (F.col("start_line") <= line) & (F.col("end_line") >= line))
    return rows.orderBy(F.col("start_line").desc(), "end_line", "qualified_name").limit(1).select("qualified_name", "file", "start_line", "end_line")


def find_occurrence(g: Graph, file: str, name: str) -> DataFrame:
    """Declarations that a name in a file may stand for: those of the file with this name, and the live-edge targets
    with this short name of the symbols declared in the file."""
    own = g.symbols.where((F.col("pos_file") == file) & (F.col("name") == name)).select("qualified_name")
    inside = g.symbols.where(F.col("pos_file") == file).select(F.col("qualified_name").alias("from_ref"))
    used = edge_filter(g.edges, LIVE).join(inside, "from_ref", "left_semi").select(F.col("to_ref").alias("qualified_name")).where(X.short_name(F.col("qualified_name")) == name)
    return own.unionAll(used).distinct().join(g.symbols.select(*FOUND), "qualified_name")


def symbol_body(g: Graph, name: str, context: int = 0, doc: bool = False) -> DataFrame:
    """qualified_name, file, start_line, end_line, body: the declaration's lines from the file's content."""
    spans = g.spans.where(F.col("qualified_name") == require_symbol(g, name))
    first = F.least("doc_line", "start_line") if doc else F.col("start_line")
    first = F.greatest(first - context, F.lit(1))
    lines = F.split("content", "\n")
    rows = spans.join(g.files.select(F.col("path").alias("file"), "content"), "file")
    last = F.least(F.col("end_line") + context, F.size(lines))
    return rows.select("qualified_name", "file", first.alias("start_line"), last.alias("end_line"), F.array_join(F.slice(lines, first, last - first + 1), "\n").alias("body"))


# -- types -----------------------------------------------------------------------------------------------------------


def type_usage(g: Graph, type_name: str, tests: bool = False) -> DataFrame:
    """qualified_name, how (signature, embeds, references), rank: who uses a type; the first way counts.

    A signature mentions the type as a whole identifier. If the short name is declared in several packages, the user
    must be of the same package, write the qualified name, or import the declaring package.
    """
    owner = resolve_type(g, type_name)
    declared = g.symbols.where(F.col("kind").isin(*TYPE_KINDS))
    short = owner.rpartition(".")[2]
    same = declared.where(F.col("name") == short).select("package_path").distinct().limit(2).count()
    home = owner.rpartition(".")[0]
    users = symbol_filter(g.symbols, tests=tests).where(F.col("qualified_name") != owner)
    qualified = X.mentions(F.col("signature"), F.lit(f"{home.rpartition('/')[2]}.{short}"))
    bare = X.mentions(F.col("signature"), F.lit(short))
    if same > 1:
        importing = edge_filter(g.edges, ("imports",)).where(F.col("to_ref") == home).select(F.col("from_ref").alias("_p")).distinct()
        users_i = users.join(importing, users["package_path"] == F.col("_p"), "left")
        by_signature = users_i.where(qualified | bare & ((F.col("package_path") == home) | F.col("_p").isNotNull())).drop("_p")
    else:
        by_signature = users.where(qualified | bare)
    into = g.edges.where(F.col("to_ref") == owner)
    embedding = into.where("edge_type = 'embeds'").select(F.col("from_ref").alias("qualified_name")).distinct()
    referring = into.where(F.col("edge_type").isin("references", "calls")).select(F.col("from_ref").alias("qualified_name")).distinct()
    names = users.select("qualified_name").distinct()
    rows = by_signature.select("qualified_name", F.lit(0).alias("way")).unionAll(embedding.join(names, "qualified_name", "left_semi").select("qualified_name", F.lit(1))).unionAll(referring.join(names, "qualified_name", "left_semi").select("qualified_name", F.lit(2)))
    best = rows.groupBy("qualified_name").agg(F.min("way").alias("way"))
    how = F.element_at(F.array(F.lit("signature"), F.lit("embeds"), F.lit("references")), F.col("way") + 1)
    return ranked_wide(best, F.col("way"), F.col("qualified_name")).select("qualified_name", how.alias("how"), "rank")


def interface_impls(g: Graph, interface: str) -> DataFrame:
    """implementer, method: types that satisfy an interface, with their methods that it or an embedded one names."""
    from graphloom.plans.fixpoint import levels

    name = resolve_type(g, interface)
    start = g.spark.createDataFrame([(name,)], "node string")
    embedded = levels(edge_filter(g.edges, ("embeds",)).select(F.col("from_ref").alias("near"), F.col("to_ref").alias("far")), start)
    methods = g.symbols.where("kind = 'method'").select("qualified_name", "name", X.owner_name(F.col("qualified_name")).alias("owner"))
    wanted = methods.join(embedded.select(F.col("node").alias("owner")), "owner", "left_semi").select("name").distinct()
    types = edge_filter(g.edges, ("satisfies",)).where(F.col("to_ref") == name).select(F.col("from_ref").alias("owner")).distinct()
    own = methods.join(types, "owner", "left_semi").join(wanted, "name", "left_semi")
    return types.join(own, "owner", "left").select(F.col("owner").alias("implementer"), F.col("qualified_name").alias("method"))


# -- summary ---------------------------------------------------------------------------------------------------------


def dependencies(g: Graph, limit: int = 12) -> DataFrame:
    """path, importers, third_party, rank: imported packages outside of the project, by number of importing packages.

    Third-party paths have a dot before the first slash; each of the two classes has its own ranks up to limit.
    """
    project = g.packages.where(~F.col("is_test")).select("path")
    imports = without_test_sites(edge_filter(g.edges, ("imports",))).select("from_ref", "to_ref")
    rows = imports.join(project.withColumnRenamed("path", "from_ref"), "from_ref", "left_semi").join(project.withColumnRenamed("path", "to_ref"), "to_ref", "left_anti")
    counts = rows.groupBy(F.col("to_ref").alias("path")).agg(F.countDistinct("from_ref").alias("importers"))
    split = counts.withColumn("third_party", F.contains(F.substring_index("path", "/", 1), F.lit(".")))
    best = Window.partitionBy("third_party").orderBy(F.col("importers").desc(), "path")
    return split.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)


def summary_packages(g: Graph, repo: str | None = None) -> DataFrame:
    """path, sym_count, doc, rank: packages by size."""
    docs = g.packages.select(F.col("path").alias("_d"), X.cut_at_word(F.col("doc"), 120).alias("doc"))
    rows = list_packages(g, repo=repo).join(docs, F.col("path") == F.col("_d"), "left")
    return ranked_wide(rows, -F.col("sym_count"), F.col("path")).select("path", "sym_count", "doc", "rank")


def summary(g: Graph, repo: str | None = None) -> DataFrame:
    """section, name, detail, n, rank: the whole summary as one answer. Packages (with symbol counts), main entry points
    (12), dependencies (third_party and stdlib, with importers), hubs (with fan-in), totals, and the description of each
    repository whose folder the driver can read: the first paragraph of its README."""
    from graphloom.operators.graph import entry_points, hubs

    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    part = lambda rows, section, name, detail, n, rank: rows.select(section.alias("section"), name.alias("name"), detail.cast("string").alias("detail"), n.cast("long").alias("n"), rank.cast("int").alias("rank"))
    c = F.col
    out = part(summary_packages(g, repo), F.lit("package"), c("path"), c("doc"), c("sym_count"), c("rank"))
    mains = entry_points(g, ("main",))
    out = out.unionAll(part(ranked(mains.orderBy("qualified_name").limit(12), c("qualified_name")), F.lit("entry_point"), c("qualified_name"), none, zero, c("rank")))
    out = out.unionAll(part(dependencies(g), F.when(c("third_party"), "third_party").otherwise("stdlib"), c("path"), none, c("importers"), c("rank")))
    out = out.unionAll(part(hubs(g), F.lit("hub"), c("path"), none, c("fan_in"), c("rank")))
    out = out.unionAll(part(totals(g), F.lit("total"), c("relation"), none, c("n"), F.lit(1)))
    told = []
    for r in g.repos.select("module_path", "dir").collect():
        if repo in (None, r["module_path"]) and os.path.isfile(path := os.path.join(r["dir"] or "", "README.md")):
            with open(path, errors="replace") as f:
                told.append((r["module_path"], first_paragraph(f.read())))
    return out.unionAll(part(g.spark.createDataFrame(told, "name string, text string"), F.lit("description"), c("name"), c("text"), zero, F.lit(1)))


def first_paragraph(markdown: str) -> str:
    """The first prose paragraph of a README: no heading, badge, rule, list, table, quote, fence or markup."""
    fenced, lines = False, []
    for line in markdown.splitlines():
        text = line.strip()
        if text.startswith("```"):
            fenced = not fenced
            continue
        noise = fenced or text.startswith(("#", "[!", "![", "<", "---", "===", "- ", "* ", "> ", "|"))
        if text and not noise:
            lines.append(text)
        elif lines:
            break
    return " ".join(lines)
