"""Graph operators: traversal, reachability, paths, cycles, imports, layers, impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.model import EDGE_TYPES, LIVE, TYPE_KINDS, Graph, NoPath, NotFound
from graphloom.operators.lookup import FOUND, edge_filter, edges_for, mark_external, project_targets, ranked, ranked_wide, require_symbol, type_usage, without_test_sites
from graphloom.plans.fixpoint import kept, levels, longest
from graphloom.plans.materialize import cut, offered

MAX_DEPTH = 100


def checked_depth(depth: int | None, default: int = 1) -> int:
    depth = default if not depth or depth <= 0 else depth
    if depth > MAX_DEPTH:
        raise ValueError(f"depth must be 1 to {MAX_DEPTH}")
    return depth


def hops(edges: DataFrame, incoming: bool) -> DataFrame:
    near, far = ("to_ref", "from_ref") if incoming else ("from_ref", "to_ref")
    return edges.select(F.col(near).alias("near"), F.col(far).alias("far"))


def traverse(g: Graph, start: DataFrame, incoming: bool, depth: int, types=()) -> DataFrame:
    """from_ref, to_ref, edge_type, level: the edges met in a breadth-first search from start (column node).

    An edge is met when its near end is first visited, so each comes once; it is kept even if its far end was visited.
    """
    edges = edge_filter(g.edges, types or EDGE_TYPES).select("from_ref", "to_ref", "edge_type")
    near = "to_ref" if incoming else "from_ref"
    # Nodes at the last level end the search; their own edges aren't followed.
    nodes = levels(hops(edges, incoming), start, depth - 1)
    return edges.join(nodes.withColumnRenamed("node", near), near).select("from_ref", "to_ref", "edge_type", (F.col("level") + 1).alias("level"))


def callers_of(g: Graph, name: str, depth: int = 1, types=(), repo: str | None = None) -> DataFrame:
    """Edges that lead to a symbol within depth steps, with external and dispatch flags.

    For a method on a concrete type, uses of the type from outside of it follow as dispatch rows.
    """
    name = require_symbol(g, name)
    start = g.spark.createDataFrame([(name,)], "node string")
    rows = mark_external(traverse(g, start, True, checked_depth(depth), types), g).withColumn("dispatch", F.lit(False))
    more = dispatch(g, name).withColumn("level", F.lit(1)).withColumn("external", F.lit(False)).withColumn("dispatch", F.lit(True))
    rows = rows.unionByName(more)
    return in_repo(rows, g, repo)


def callees_of(g: Graph, name: str, depth: int = 1, types=(), repo: str | None = None) -> DataFrame:
    """Edges that lead from a symbol within depth steps."""
    start = g.spark.createDataFrame([(require_symbol(g, name),)], "node string")
    return in_repo(mark_external(traverse(g, start, False, checked_depth(depth), types), g), g, repo)


def in_repo(rows: DataFrame, g: Graph, repo: str | None) -> DataFrame:
    if not repo:
        return rows
    key = ["from_ref", "to_ref", "edge_type"]
    return rows.join(g.edges.where(F.col("repo") == repo).select(*key).distinct(), key, "left_semi")


def dispatch(g: Graph, name: str) -> DataFrame:
    """Uses of the receiver type of a method: references, satisfies and embeds from outside of the type."""
    method = g.symbols.where((F.col("qualified_name") == name) & (F.col("kind") == "method") & (F.col("receiver") != ""))
    receiver = method.select(F.concat("package_path", F.lit("."), F.regexp_replace("receiver", r"^\*|\[.*$", "")).alias("recv")).distinct()
    concrete = receiver.join(g.symbols.where("kind <> 'interface'").select(F.col("qualified_name").alias("recv")), "recv", "left_semi")
    uses = edge_filter(g.edges, ("references", "satisfies", "embeds")).select("from_ref", "to_ref", "edge_type")
    rows = uses.join(concrete, uses["to_ref"] == F.col("recv"))
    own = (F.col("from_ref") == F.col("recv")) | F.startswith("from_ref", F.concat("recv", F.lit(".")))
    return rows.where(~own).select("from_ref", "to_ref", "edge_type")


def by_design(symbols: DataFrame, packages: DataFrame) -> DataFrame:
    """symbols with by_design: blank names, init, and main of a main package; nothing needs to call these."""
    mains = packages.where("name = 'main'").select(F.col("path").alias("_main")).distinct()
    rows = symbols.join(mains, symbols["package_path"] == F.col("_main"), "left")
    plain = (F.col("receiver") == "") & (F.col("kind") == "function")
    flag = (F.col("name") == "_") | plain & ((F.col("name") == "init") | (F.col("name") == "main") & F.col("_main").isNotNull())
    return rows.withColumn("by_design", flag).drop("_main")


def roots(g: Graph, tests: bool = False) -> DataFrame:
    """node: what is alive without a use: exported symbols, main and init, and test entry points."""
    symbols = g.symbols if tests else g.symbols.where(~F.col("is_test"))
    alive = by_design(symbols, g.packages).where(F.col("exported") | F.col("by_design")).select(F.col("qualified_name").alias("node"))
    entries = g.symbols.where(F.col("is_test") & (F.col("receiver") == "") & X.is_test_entry(F.col("name"))).select("qualified_name")
    return alive.unionAll(entries).distinct()


def reachable(g: Graph, start: DataFrame, types=LIVE) -> DataFrame:
    """node: everything that outgoing edges lead to from start, start included."""
    return levels(hops(edge_filter(g.edges, types), False), start).select("node")


def unused(g: Graph, tests: bool = False) -> DataFrame:
    """Symbols that nothing alive uses, directly or through an interface. Exported and generated ones aren't judged."""
    symbols = g.symbols if tests else g.symbols.where(~F.col("is_test"))
    alive = cut(reachable(g, roots(g, tests)))
    interfaces = symbols.where("kind = 'interface'").select(F.col("qualified_name").alias("owner")).distinct()
    methods = symbols.where("kind = 'method'").select("qualified_name", "name", X.owner_name(F.col("qualified_name")).alias("owner"))
    called = methods.join(alive.withColumnRenamed("node", "qualified_name"), "qualified_name", "left_semi")
    implementing = edge_filter(g.edges, ("satisfies",)).select(F.col("from_ref").alias("impl"), F.col("to_ref").alias("owner"))
    dispatched = called.join(implementing, "owner").select(F.concat("impl", F.lit("."), "name").alias("qualified_name"))
    live = alive.select(F.col("node").alias("qualified_name")).unionAll(dispatched).distinct()
    judged = by_design(symbols, g.packages).where(~F.col("exported") & ~F.col("is_generated") & ~F.col("by_design"))
    judged = judged.withColumn("owner", F.when(F.col("kind") == "method", X.owner_name(F.col("qualified_name")))).join(interfaces, "owner", "left_anti")
    return judged.join(live, "qualified_name", "left_anti").select(*FOUND)


def find_path(g: Graph, start: str, end: str, max_depth: int = 10) -> DataFrame:
    """step, from_ref, to_ref, edge_type: a shortest path along outgoing edges and contracts that aren't mere suggestions.

    Each node remembers the least name it was reached from, so the path is the same at every run. A path from a node to
    itself isn't one. Raises NoPath if none is within max_depth.
    """
    start, end = require_symbol(g, start), require_symbol(g, end)
    edges = g.edges.select("from_ref", "to_ref", "edge_type")
    if g.contracts is not None:
        edges = edges.unionByName(g.contracts.where(~F.col("suggested")).select("from_ref", "to_ref", F.lit("contract").alias("edge_type")))
    with kept(edges.groupBy(F.col("from_ref").alias("near"), F.col("to_ref").alias("far")).agg(F.min("edge_type").alias("edge_type"))) as hop:
        visited = cut(g.spark.createDataFrame([(start, None, None, 0)], "node string, parent string, edge_type string, level int"))
        frontier, rows, level = visited, 1, 0
        while rows and level < max_depth:
            level += 1
            step = hop.join(offered(frontier.select(F.col("node").alias("near")), rows), "near")
            best = step.groupBy(F.col("far").alias("node")).agg(F.min(F.struct("near", "edge_type")).alias("m"))
            new = best.join(visited.select("node"), "node", "left_anti").select("node", F.col("m.near").alias("parent"), F.col("m.edge_type").alias("edge_type"), F.lit(level).alias("level"))
            frontier = cut(new)
            rows = frontier.count()
            visited = visited.unionByName(frontier)
            if not frontier.where(F.col("node") == end).isEmpty():
                break
        # A step back reads one row a level: the path is as long as the search was deep.
        path, node = [], end
        while node != start:
            found = visited.where(F.col("node") == node).first()
            if found is None:
                raise NoPath(f"no path from {start} to {end} within {max_depth}")
            path.append((found["level"], found["parent"], node, found["edge_type"]))
            node = found["parent"]
    if not path:
        raise NoPath(f"no path from {start} to itself")
    return g.spark.createDataFrame(sorted(path), "step int, from_ref string, to_ref string, edge_type string")


def cycle_core(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """The edges (near, far) left when nodes without an edge in or out are taken away again and again: all cycles' edges
    and some between cycles."""
    core = cut(edges.select("near", "far").distinct())
    size = core.count()
    for _ in range(rounds):
        keep = core.select(F.col("near").alias("n")).distinct().join(core.select(F.col("far").alias("n")).distinct(), "n", "left_semi")
        core = cut(core.join(keep.withColumnRenamed("n", "near"), "near", "left_semi").join(keep.withColumnRenamed("n", "far"), "far", "left_semi"))
        before, size = size, core.count()
        if size == before:
            break
    return core


def cycles(g: Graph, edge_type: str, max_length: int | None = None, limit: int = 1000) -> DataFrame:
    """cycle (array of refs, the least first), length: distinct simple cycles of one edge type.

    A cycle of n edges is a path of n - n // 2 edges from its least node, through larger ones only, and a path of n // 2
    edges back to it, which meet in their ends and share nothing else; so each cycle is found once, in its canonical
    rotation, and paths grow half as long as cycles. The edges are cut down to the cycles' core first. The report has
    `limit` cycles at most, the shortest first, and the search ends at the length that passes it (or max_length);
    truncated says whether there are more, or paths of max_length edges that may close later.
    """

    def longer(paths: DataFrame) -> DataFrame:
        grown = paths.select("head", F.array_append("path", F.col("last")).alias("path"), F.col("last").alias("near")).join(hop, "near")
        return cut(grown.where((F.col("far") > F.col("head")) & ~F.array_contains("path", F.col("far"))).select("head", "path", F.col("far").alias("last")))

    core = cycle_core(hops(edge_filter(g.edges, (edge_type,)), False))
    found = cut(core.where("near = far").select(F.array("near").alias("cycle"), F.lit(1).alias("length")))
    upward = core.where("far > near")
    with kept(core.where("near <> far")) as hop:
        # head: the least node; path: from it on, last: the end. Of the ways back, path ends at the head.
        there = cut(upward.select(F.col("near").alias("head"), F.array("near").alias("path"), F.col("far").alias("last")))
        back = cut(core.where("near > far").select(F.col("far").alias("head"), F.array("near").alias("path"), F.col("near").alias("last")))
        length, size, more = 1, found.limit(limit + 1).count(), False
        while size <= limit and length != max_length and not there.isEmpty():
            length += 1
            if length > 2 and length % 2:
                there = longer(there)
            elif length > 2:
                grown = back.withColumnRenamed("last", "far").join(hop, "far")
                back = cut(grown.where((F.col("near") > F.col("head")) & ~F.array_contains("path", F.col("near"))).select("head", F.array_prepend("path", F.col("near")).alias("path"), F.col("near").alias("last")))
            met = there.join(back.withColumnRenamed("path", "rest"), ["head", "last"]).where(~F.arrays_overlap("path", "rest"))
            found = cut(found.unionAll(met.select(F.concat("path", "rest").alias("cycle"), F.lit(length).alias("length"))))
            size = found.limit(limit + 1).count()
        more = size > limit
        if length == max_length and not more:
            for _ in range(length // 2):
                there = longer(there)
            more = not there.isEmpty()
    return found.orderBy("length", "cycle").limit(limit).withColumn("truncated", F.lit(more))


# -- imports ---------------------------------------------------------------------------------------------------------


def importers_of(g: Graph, path: str) -> DataFrame:
    """Packages with an import of path outside of their tests; if none, importers of what the path resolves to."""
    edges = without_test_sites(edge_filter(g.edges, ("imports",)))
    rows = edges.where(F.col("to_ref") == path)
    if rows.isEmpty():
        one = g.spark.createDataFrame([(path,)], "path string")
        targets = project_targets(one, g.packages).select(F.col("target").alias("to_ref"))
        rows = edges.join(targets, "to_ref", "left_semi")
    return rows.select("from_ref", "to_ref", F.size("sites").alias("n_sites"))


def imports_of(g: Graph, path: str) -> DataFrame:
    """to_ref, state: imports outside of tests; indexed, not indexed (of a known module) or external."""
    from graphloom.operators.lookup import module_of

    edges = without_test_sites(edge_filter(g.edges, ("imports",)).where(F.col("from_ref") == path)).select("to_ref").distinct()
    known = g.packages.select(F.col("path").alias("_p")).distinct()
    modules = module_of(edges.select(F.col("to_ref").alias("ref")), g.repos).withColumnsRenamed({"ref": "_ref", "module_path": "_module"})
    rows = edges.join(known, F.col("to_ref") == F.col("_p"), "left").join(modules, F.col("to_ref") == F.col("_ref"), "left")
    state = F.when(F.col("_p").isNotNull(), "indexed").when(F.col("_module").isNotNull(), "not indexed").otherwise("external")
    return rows.select("to_ref", state.alias("state"))


def project_imports(g: Graph) -> DataFrame:
    """near, far: runtime imports between project packages."""
    edges = without_test_sites(edge_filter(g.edges, ("imports",))).select("from_ref", "to_ref")
    project = g.packages.where(~F.col("is_test")).select("path")
    inside = edges.join(project.withColumnRenamed("path", "from_ref"), "from_ref", "left_semi")
    targets = project_targets(inside.select(F.col("to_ref").alias("path")).distinct(), project).withColumnRenamed("path", "to_ref")
    return inside.join(targets, "to_ref").select(F.col("from_ref").alias("near"), F.col("target").alias("far")).where("near <> far").distinct()


def transitive_imports(g: Graph, path: str) -> DataFrame:
    """path, level: project packages reached by imports."""
    if g.packages.where(F.col("path") == path).isEmpty():
        raise NotFound(f"package not found: {path}")
    start = g.spark.createDataFrame([(path,)], "node string")
    return levels(project_imports(g), start).where("level > 0").select(F.col("node").alias("path"), "level")


def dependency_flow(g: Graph, path: str) -> DataFrame:
    """section (imports, importers, transitive), path of one package."""
    direct = imports_of(g, path).select(F.lit("imports").alias("section"), F.col("to_ref").alias("path"))
    importing = importers_of(g, path).select(F.lit("importers").alias("section"), F.col("from_ref").alias("path"))
    return direct.unionAll(importing).unionAll(transitive_imports(g, path).select(F.lit("transitive").alias("section"), "path")).distinct()


def dependency_layers(g: Graph) -> DataFrame:
    """path, level: the longest chain of imports below a package; 0 for leaves and for packages in or above a cycle."""
    nodes = g.packages.where(~F.col("is_test")).select(F.col("path").alias("node"))
    return longest(project_imports(g), nodes).select(F.col("node").alias("path"), "level")


def hubs(g: Graph, limit: int | None = 5) -> DataFrame:
    """path, fan_in, fan_out, rank: project packages by number of importers."""
    imports = cut(project_imports(g))
    into = imports.groupBy(F.col("far").alias("path")).agg(F.count("*").alias("fan_in"))
    out = imports.groupBy(F.col("near").alias("_p")).agg(F.count("*").alias("fan_out"))
    rows = into.join(out, into["path"] == F.col("_p"), "left").select("path", "fan_in", F.coalesce("fan_out", F.lit(0)).alias("fan_out"))
    if not limit:
        return ranked_wide(rows, -F.col("fan_in"), F.col("path"))
    return ranked(rows.orderBy(F.col("fan_in").desc(), "path").limit(limit), F.col("fan_in").desc(), F.col("path"))


# -- impact ----------------------------------------------------------------------------------------------------------


def blast_radius(g: Graph, name: str, depth: int = 3, contracts: bool = True) -> DataFrame:
    """One row: symbol, direct_callers, transitive_callers (edge rows), implementations, embedders, type_users."""
    name = require_symbol(g, name)
    one = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    into = g.edges.where(F.col("to_ref") == name)
    totals = [one(into.where(F.col("edge_type").isin(*t)), what) for what, t in (("direct", ("calls", "references")), ("implementations", ("satisfies",)), ("embedders", ("embeds",)))]
    totals.append(one(callers_of(g, name, depth), "transitive"))
    if not g.symbols.where((F.col("qualified_name") == name) & F.col("kind").isin(*TYPE_KINDS)).isEmpty():
        totals.append(one(type_usage(g, name), "users"))
    if contracts and g.contracts is not None:
        mine = (F.col("from_ref") == name) & (F.col("direction") == "producer") | (F.col("to_ref") == name) & (F.col("direction") == "consumer")
        totals.append(one(g.contracts.where(mine & ~F.col("suggested")), "direct"))
    rows = totals[0]
    for t in totals[1:]:
        rows = rows.unionAll(t)
    total = lambda what, alias: F.coalesce(F.sum(F.when(F.col("what") == what, F.col("n"))), F.lit(0)).alias(alias)
    return rows.agg(F.lit(name).alias("symbol"), total("direct", "direct_callers"), total("transitive", "transitive_callers"), total("implementations", "implementations"), total("embedders", "embedders"), total("users", "type_users"))


HEURISTICS = ("main", "test", "uncalled_exported", "handler_sig", "handler_name")
#: Method names that start a service.
HANDLERS = ("Serve", "Handle", "Run", "Start", "Listen")


def entry_points(g: Graph, heuristics=("main", "test", "uncalled_exported"), tests: bool = False) -> DataFrame:
    """qualified_name, kind, pos_file, pos_line, reason: the first heuristic that holds, in a fixed order."""
    chosen = [h for h in heuristics if h in HEURISTICS]
    if not chosen:
        raise ValueError(f"no known heuristic in {list(heuristics)}")
    symbols = g.symbols if tests else g.symbols.where(~F.col("is_test"))
    about = g.packages.select(F.col("path").alias("_p"), F.col("is_test").alias("_test"), ((F.col("name") == "main") & ~F.col("is_test")).alias("_main"))
    used = edge_filter(g.edges, ("calls", "references")).select(F.col("to_ref").alias("_used")).distinct()
    rows = symbols.join(about, symbols["package_path"] == F.col("_p"), "left").join(used, F.col("qualified_name") == F.col("_used"), "left")
    test = F.col("is_test") | F.coalesce("_test", F.lit(False))
    code = F.col("kind").isin("function", "method")
    conditions: dict[str, Column] = {
        "test": test & X.is_test_entry(F.col("name")),
        "main": ~test & (F.col("name") == "main") & (F.col("kind") == "function") & F.coalesce("_main", F.lit(False)),
        "uncalled_exported": ~test & F.col("exported") & code & F.col("_used").isNull() & ~X.is_test_entry(F.col("name")),
        "handler_sig": ~test & F.contains("signature", F.lit("http.ResponseWriter")) & F.contains("signature", F.lit("*http.Request")),
        "handler_name": ~test & (F.col("kind") == "method") & F.col("name").isin(*HANDLERS),
    }
    reason = F.coalesce(*(F.when(c, F.lit(n)) for n, c in conditions.items() if n in chosen))
    first = Window.partitionBy("qualified_name").orderBy("pos_file", "pos_line")
    rows = rows.withColumn("reason", reason).where("reason is not null").withColumn("_r", F.row_number().over(first)).where("_r = 1")
    return rows.select("qualified_name", "kind", "pos_file", "pos_line", "reason")


def affected_tests(g: Graph, files: list[str], depth: int = 5, evidence: int = 5) -> DataFrame:
    """file, reason (callers or convention), via (up to `evidence` changed symbols), truncated.

    Calls and references are followed back from all symbols of the files, a level at a time; a node takes over the
    origins of the least node it was found from. Test files on these edges are affected; so is the `_test.go` sibling of
    a changed file. A real edge is the stronger reason.
    """
    depth = checked_depth(depth, 5)
    changed = g.spark.createDataFrame([(f,) for f in files], "file string")
    declared = g.symbols.select(F.col("qualified_name").alias("node"), F.col("pos_file").alias("file")).join(changed, "file")
    start = declared.select("node", F.array("node").alias("origins")).distinct()
    edges = edge_filter(g.edges, ("calls", "references")).select(F.col("to_ref").alias("near"), F.col("from_ref").alias("far"), "pos_file")
    hits = None
    with kept(edges) as hop:
        visited = frontier = cut(start)
        rows = frontier.count()
        for _ in range(depth):
            if not rows:
                break
            met = hop.join(offered(frontier.withColumnRenamed("node", "near"), rows), "near")
            here = cut(met.where(X.is_test_file(F.col("pos_file"))).select(F.col("pos_file").alias("file"), F.explode("origins").alias("via")).distinct())
            hits = here if hits is None else hits.unionByName(here)
            new = met.groupBy(F.col("far").alias("node")).agg(F.min_by("origins", "near").alias("origins"))
            frontier = cut(new.join(visited.select("node"), "node", "left_anti"))
            rows = frontier.count()
            visited = visited.unionByName(frontier)
    sibling = declared.where(F.endswith("file", F.lit(".go")) & ~X.is_test_file(F.col("file"))).select(F.concat(F.regexp_replace("file", r"\.go$", ""), F.lit("_test.go")).alias("file"), F.col("node").alias("via"))
    known = g.symbols.select(F.col("pos_file").alias("file")).unionAll(g.files.select(F.col("path").alias("file"))).distinct()
    rows = sibling.join(known, "file", "left_semi").withColumn("weak", F.lit(1))
    if hits is not None:
        rows = rows.unionByName(hits.withColumn("weak", F.lit(0)))
    best = rows.join(rows.groupBy("file").agg(F.min("weak").alias("weak")), ["file", "weak"])
    per = best.groupBy("file", "weak").agg(F.array_sort(F.collect_set("via")).alias("via"))
    return per.select("file", F.when(F.col("weak") == 0, "callers").otherwise("convention").alias("reason"), F.slice("via", 1, evidence).alias("via"), (F.size("via") > evidence).alias("truncated"))


def context_bundle(g: Graph, name: str, budget: int = 4000) -> DataFrame:
    """section (symbol, callees, callers, same_file), ref, tokens, kept: what to read with a symbol within a token budget.

    A token is four bytes of a row's text and 8 for the row. Rows are dropped from the tail: same file first, then
    callers, then callees; the symbol itself stays.
    """
    name = require_symbol(g, name)
    symbol = g.symbols.where(F.col("qualified_name") == name)
    edges = edge_filter(g.edges, EDGE_TYPES).select("from_ref", "to_ref", "edge_type")
    own = symbol.select(F.lit(0).alias("o"), F.lit("symbol").alias("section"), F.col("qualified_name").alias("ref"), F.concat_ws(" ", "signature", "doc").alias("t"))
    out = edges.where(F.col("from_ref") == name).select(F.lit(1), F.lit("callees"), F.col("to_ref"), F.col("edge_type"))
    into = edges.where(F.col("to_ref") == name).select(F.lit(2), F.lit("callers"), F.col("from_ref"), F.col("edge_type"))
    beside = g.symbols.join(symbol.select("pos_file").distinct(), "pos_file", "left_semi").where(F.col("qualified_name") != name).select(F.lit(3), F.lit("same_file"), F.col("qualified_name"), F.col("signature"))
    rows = own.unionAll(out).unionAll(into).unionAll(beside).withColumn("tokens", F.floor((F.octet_length("ref") + F.octet_length("t")) / 4) + 8)
    total = F.sum("tokens").over(Window.orderBy("o", "ref", "t").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("upto", total).select("section", "ref", "tokens", ((F.col("o") == 0) | (F.col("upto") <= budget)).alias("kept"))


def frontier_edges(g: Graph, names: list[str], incoming: bool = False, types=()) -> DataFrame:
    """Edges of a set of nodes, in one semi-join."""
    return edges_for(g, g.spark.createDataFrame([(n,) for n in names], "node string"), incoming, types)
