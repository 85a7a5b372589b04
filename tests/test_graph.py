"""Graph operators on a graph made by hand and on random ones, against plain searches."""

import random
from collections import defaultdict, deque

import pytest

from graphloom.model import Ambiguous, Graph, NoPath, NotFound, normalize_name
from graphloom.operators import graph as G
from graphloom.operators import lookup as L
from graphloom.operators import rank as R
from graphloom.plans.fixpoint import levels, longest
from graphloom.sources import sinks as S

SYMBOLS = "qualified_name string, package_path string, name string, kind string, receiver string, signature string, doc string, pos_file string, pos_line int, exported boolean, is_test boolean, is_generated boolean, complexity int, churn_count int, repo string"
USES = "from_ref string, to_ref string, edge_type string, file string, line int, column int, repo string"


def symbol(ref, kind="function", receiver="", file=None, line=1, test=False, generated=False, signature="func()", repo="r", complexity=1, churn=0):
    package = ref.split(".")[0]
    name = ref.rpartition(".")[2]
    return ref, package, name, kind, receiver, signature, "", file or f"{package}/x{'_test' if test else ''}.go", line, name[:1].isupper(), test, generated, complexity, churn, repo


@pytest.fixture(scope="module")
def g(spark):
    symbols = [symbol("a.main", line=1), symbol("a.A", line=5), symbol("a.b", line=9), symbol("a.c", line=12), symbol("a.dead", line=20), symbol("a.deader", line=25), symbol("a.init", line=30), symbol("a.init", file="a/y.go", line=3)]
    symbols += [symbol("b.Face", "interface", line=1), symbol("b.Base", "interface", line=4), symbol("b.Base.Do", "method", "Base", line=5), symbol("b.Face.Run", "method", "Face", line=2), symbol("b.impl", "type", line=10), symbol("b.impl.Do", "method", "impl", line=11), symbol("b.impl.Run", "method", "impl", line=14), symbol("b.impl.Else", "method", "impl", line=17), symbol("b.impl.hid", "method", "impl", line=19)]
    symbols += [symbol("c.gen", generated=True), symbol("c.TestIt", test=True, line=2), symbol("c.helper", test=True, line=6), symbol("c.T", "type", signature="struct { x int }", line=8), symbol("d.T", "type", line=1), symbol("d.use", signature="func(t c.T) *T", line=4), symbol("e.lonely", line=2)]
    uses = [("a.main", "a.A", "calls"), ("a.A", "a.b", "calls"), ("a.b", "a.c", "calls"), ("a.c", "a.A", "calls"), ("a.c", "a.c", "calls"), ("a.A", "a.c", "references"), ("a.A", "a.b", "references"), ("a.dead", "a.deader", "calls"), ("a.A", "ext/lib.F", "calls"), ("a.A", "b.Face.Run", "calls"), ("c.TestIt", "c.helper", "calls"), ("b.Face", "b.Base", "embeds"), ("b.impl", "b.Face", "satisfies"), ("b.impl", "b.Base", "satisfies"), ("d.use", "b.impl", "references"), ("b.impl.Do", "b.impl", "references")]
    rows = [(*u, f"{u[0].split('.')[0]}/x.go", k + 1, 2, "r") for k, u in enumerate(uses)]
    rows += [("a", "b", "imports", "a/x.go", 1, 1, "r"), ("a", "b", "imports", "a/x_test.go", 1, 1, "r"), ("b", "c", "imports", "b/x_test.go", 1, 1, "r"), ("c", "a", "imports", "c/x.go", 1, 1, "r"), ("a", "os", "imports", "a/x.go", 2, 1, "r"), ("a", "x.org/y", "imports", "a/x.go", 3, 1, "r"), ("d", "m/c", "imports", "d/x.go", 3, 1, "r")]
    packages = spark.createDataFrame([(p, "main" if p == "a" else p, f"/{p}", "", False, False, "r") for p in "abcde"], "path string, name string, dir string, doc string, is_test boolean, is_generated boolean, repo string")
    repos = spark.createDataFrame([("r", "/", False), ("gone", "/gone", True), ("x.org", "/x", False)], "module_path string, dir string, missing boolean")
    files = spark.createDataFrame([("a/x.go", "one\ntwo\nthree\nfour", "r"), ("a/x_test.go", "", "r")], "path string, content string, repo string")
    return Graph(repos=repos, packages=packages, symbols=spark.createDataFrame(symbols, SYMBOLS), edges=S.merge_edges(spark.createDataFrame(rows, USES)), files=files, contracts=spark.createDataFrame([("a.c", "e.lonely", "producer", False), ("a.c", "c.gen", "producer", True)], "from_ref string, to_ref string, direction string, suggested boolean"), suppressions=spark.createDataFrame([], "from_ref string, to_ref string"))


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_callers(g):
    rows = G.callers_of(g, "a.c", 2)
    assert pairs(rows, "from_ref", "to_ref", "edge_type", "level") == [("a.A", "a.b", "calls", 2), ("a.A", "a.b", "references", 2), ("a.A", "a.c", "references", 1), ("a.b", "a.c", "calls", 1), ("a.c", "a.A", "calls", 2), ("a.c", "a.c", "calls", 1), ("a.main", "a.A", "calls", 2)]
    assert pairs(G.callers_of(g, "a.c", 1, ("calls",)), "from_ref") == [("a.b",), ("a.c",)]
    assert G.callers_of(g, "a.c", repo="other").count() == 0


def test_dispatch(g):
    rows = G.callers_of(g, "b.(*impl).Do")
    assert pairs(rows, "from_ref", "dispatch") == [("d.use", True)]
    assert G.dispatch(g, "b.Face.Run").count() == 0


def test_callees_external(g):
    rows = G.callees_of(g, "a.A", 1)
    assert ("ext/lib.F", True) in pairs(rows, "to_ref", "external") and ("a.b", False) in pairs(rows, "to_ref", "external")


def test_missing_names(g):
    with pytest.raises(NotFound) as e:
        G.callers_of(g, "b.dead")
    assert e.value.suggestions[0] == "a.dead"
    with pytest.raises(Ambiguous):
        L.methods_of(g, "T")
    with pytest.raises(ValueError):
        G.callers_of(g, "a.A", 101)
    assert normalize_name("p.(*T).M") == "p.T.M" and normalize_name("p.(T).M") == "p.T.M" and normalize_name("p.f") == "p.f"


def test_unused(g):
    assert pairs(G.unused(g), "qualified_name") == [("a.dead",), ("a.deader",), ("b.impl.hid",), ("d.use",), ("e.lonely",)]


def test_path(g):
    assert [(r["from_ref"], r["to_ref"]) for r in G.find_path(g, "a.main", "e.lonely").orderBy("step").collect()] == [("a.main", "a.A"), ("a.A", "a.c"), ("a.c", "e.lonely")]
    assert G.find_path(g, "a.main", "e.lonely", 3).count() == 3
    for a, b, depth in (("a.main", "e.lonely", 2), ("a.main", "c.gen", 10), ("a.c", "a.c", 10), ("e.lonely", "a.A", 10)):
        with pytest.raises(NoPath):
            G.find_path(g, a, b, depth)


def test_cycles(g):
    found = G.cycles(g, "calls").collect()
    assert sorted(tuple(r["cycle"]) for r in found) == [("a.A", "a.b", "a.c"), ("a.c",)] and not found[0]["truncated"]
    assert G.cycles(g, "calls", limit=1).collect()[0]["truncated"]


def test_cycles_up_to_a_length(g):
    """truncated tells that paths are left at max_length."""
    short = G.cycles(g, "calls", max_length=1).collect()
    assert [tuple(r["cycle"]) for r in short] == [("a.c",)] and short[0]["truncated"]
    assert [r["truncated"] for r in G.cycles(g, "calls", max_length=3).collect()] == [False, False]


def test_imports(g):
    assert pairs(G.importers_of(g, "b"), "from_ref", "n_sites") == [("a", 1)]
    assert pairs(G.importers_of(g, "m/c"), "from_ref") == [("d",)]
    assert pairs(G.imports_of(g, "a"), "to_ref", "state") == [("b", "indexed"), ("os", "external"), ("x.org/y", "not indexed")]
    assert pairs(G.transitive_imports(g, "d"), "path", "level") == [("a", 2), ("b", 3), ("c", 1)]
    assert pairs(L.import_counts(g), "path", "imports") == [("a", 3), ("c", 1), ("d", 1)]
    assert pairs(G.dependency_layers(g), "path", "level") == [("a", 1), ("b", 0), ("c", 2), ("d", 3), ("e", 0)]
    assert [(r["path"], r["fan_in"]) for r in G.hubs(g, 1).collect()] == [("a", 1)]
    assert pairs(L.dependencies(g), "path", "third_party") == [("m/c", False), ("os", False), ("x.org/y", True)]


def test_layers_end_with_a_cycle_and_a_ready_leaf(spark):
    edges = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "A"), ("B", "C")], "near string, far string")
    nodes = spark.createDataFrame([("A",), ("B",), ("C",)], "node string")
    assert pairs(longest(edges, nodes), "node", "level") == [("A", 0), ("B", 0), ("C", 0)]


def test_types(g):
    assert pairs(L.type_usage(g, "c.T"), "qualified_name", "how") == [("d.use", "signature")]
    assert pairs(L.interface_impls(g, "b.Face"), "implementer", "method") == [("b.impl", "b.impl.Do"), ("b.impl", "b.impl.Run")]


def test_blast_radius(g):
    row = G.blast_radius(g, "b.impl").first()
    assert (row["direct_callers"], row["implementations"], row["embedders"], row["type_users"]) == (2, 0, 0, 2)
    assert G.blast_radius(g, "a.c").first()["direct_callers"] == 4


def test_entry_points(g):
    assert pairs(G.entry_points(g, tests=True), "qualified_name", "reason") == [("a.main", "main"), ("b.Base.Do", "uncalled_exported"), ("b.impl.Do", "uncalled_exported"), ("b.impl.Else", "uncalled_exported"), ("b.impl.Run", "uncalled_exported"), ("c.TestIt", "test")]
    with pytest.raises(ValueError):
        G.entry_points(g, ("nothing",))


def test_affected(g):
    assert pairs(G.affected_tests(g, ["a/x.go"]), "file", "reason", "truncated") == [("a/x_test.go", "convention", True)]


def test_bundle(g):
    rows = G.context_bundle(g, "a.A", 60).collect()
    kept = [r for r in rows if r["kept"]]
    assert sum(r["tokens"] for r in kept) <= 60 and any(r["section"] == "symbol" for r in kept) and len(kept) < len(rows)


def test_states_and_search(g):
    assert pairs(L.repo_states(g), "module_path", "state") == [("gone", "missing"), ("r", "indexed"), ("x.org", "stale")]
    assert [r["qualified_name"] for r in L.search(g, "DEAD").orderBy("rank").collect()] == ["a.dead", "a.deader"]
    assert L.search(g, "%").count() == 0 and L.search_substring(g, "%").count() == 0
    assert pairs(L.search_prefix(g, "b.impl.R"), "qualified_name") == [("b.impl.Run",)]
    with pytest.raises(ValueError):
        L.symbol_filter(g.symbols, kind="klass")


def test_enclosing(spark, g):
    points = spark.createDataFrame([("a/x.go", 4), ("a/x.go", 5), ("a/x.go", 100), ("zz.go", 1), ("d/x.go", 0)], "file string, line int")
    assert pairs(L.enclosing(points, g.symbols), "file", "line", "enclosing") == [("a/x.go", 4, "a.main"), ("a/x.go", 5, "a.A"), ("a/x.go", 100, "a.init"), ("d/x.go", 0, "d/x.go"), ("zz.go", 1, "zz.go")]


def plain_levels(edges, start, depth=None):
    out, seen, near = defaultdict(list), dict.fromkeys(start, 0), deque(start)
    for a, b in edges:
        out[a].append(b)
    while near:
        n = near.popleft()
        if depth is None or seen[n] < depth:
            for m in out[n]:
                if m not in seen:
                    seen[m] = seen[n] + 1
                    near.append(m)
    return seen


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = list({(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(70)})
    df, start = spark.createDataFrame(edges, "near string, far string"), spark.createDataFrame([("n1",), ("n2",)], "node string")
    for depth in (0, 2, None):
        assert dict(pairs(levels(df, start, depth), "node", "level")) == plain_levels(edges, ["n1", "n2"], depth)
    nodes = sorted({n for e in edges for n in e})
    score = dict.fromkeys(nodes, 1 / len(nodes))
    out = defaultdict(list)
    for a, b in edges:
        out[a].append(b)
    for _ in range(5):
        lost = sum(score[n] for n in nodes if not out[n])
        new = dict.fromkeys(nodes, 0.15 / len(nodes) + 0.85 * lost / len(nodes))
        for a in nodes:
            for b in out[a]:
                new[b] += 0.85 * score[a] / len(out[a])
        score = new
    got = R.pagerank(spark.createDataFrame([(n,) for n in nodes], "node string"), df, rounds=5, tolerance=None)
    assert dict(pairs(got, "node", "score")) == pytest.approx(score)


def test_pagerank_ends(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "node string")
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "near string, far string")
    assert dict(pairs(R.pagerank(nodes, edges), "node", "score")) == pytest.approx({"a": 0.5, "b": 0.5})
    assert R.pagerank(nodes.limit(0), edges.limit(0)).count() == 0


def test_store(spark, g, tmp_path):
    store = S.Store(spark, f"file://{tmp_path}/store")
    with pytest.raises(FileNotFoundError):
        store.read()
    store.write(g)
    assert store.read().symbols.count() == g.symbols.count()
    other = Graph(symbols=g.symbols.limit(0), packages=g.packages.limit(1).withColumn("path", g.packages["name"]))
    store.replace_repo("r", other)
    assert len(store.versions()) == 2 and store.read().symbols.count() == 0 and store.read().packages.count() == 1
    assert store.read().edges.count() == g.edges.count()


def test_sinks(spark):
    old = spark.createDataFrame([("a", "1", "r"), ("b", "2", "r"), ("c", None, "r")], "path string, content string, repo string")
    new = spark.createDataFrame([("a", "1", "r"), ("b", "3", "r"), ("d", "", "r")] + [(f"p{k}", "x", "r") for k in range(700)], "path string, content string, repo string")
    assert pairs(S.file_changes(old, new), "path", "action")[:3] == [("b", "update"), ("c", "delete"), ("d", "insert")]
    assert S.file_changes(new, new).count() == 0 and S.file_changes(new, new.limit(0)).count() == 703
    uses = [("f", "t", "calls", "b.go", 2, 1, "r"), ("f", "t", "calls", "a.go", 9, 1, "r"), ("f", "t", "calls", "a.go", 9, 5, "r"), ("f", "t", "calls", "a.go", 9, 5, "r")]
    one = S.merge_edges(spark.createDataFrame(uses[:1], USES))
    row = S.union_edges(one, S.merge_edges(spark.createDataFrame(uses, USES))).collect()
    assert len(row) == 1 and (row[0]["pos_file"], len(row[0]["sites"]), row[0]["sites"][0]["file"]) == ("b.go", 3, "a.go")


def test_store_conflicts_and_folders(spark, tmp_path, monkeypatch):
    """A snapshot's number is taken once; replacing writes one repository; folders are put together after some time."""
    from graphloom.model import SCHEMAS, Graph

    def graph(rows):
        whole = Graph.empty(spark)
        whole.files = spark.createDataFrame(rows, SCHEMAS["files"])
        return whole

    store = S.Store(spark, f"file://{tmp_path}/store")
    first = store.write(graph([("a", "1", "r"), ("b", "1", "s"), ("c", "1", "007")]))
    for taken in (None, first):
        if taken is not None:
            store._point([], taken)
        with pytest.raises(S.Conflict):
            store._point([], taken)
    store = S.Store(spark, f"file://{tmp_path}/other")
    store.write(graph([("a", "1", "r"), ("b", "1", "s"), ("c", "1", "x")]))
    point, lost = S.Store._point, []

    def beaten(self, folders, after):
        """Another writer comes first, once."""
        if not lost:
            lost.append(point(self, self.folders(after), after))
        return point(self, folders, after)

    monkeypatch.setattr(S.Store, "_point", beaten)
    monkeypatch.setattr(S.Store, "FOLDERS", 2)
    for k, repo in enumerate(("r", "s", "r")):
        store.replace_repo(repo, graph([("n", str(k), repo), ("stray", "", "elsewhere")]))
    assert {tuple(r) for r in store.read().files.select("path", "content", "repo").collect()} == {("n", "2", "r"), ("n", "1", "s"), ("c", "1", "x")}
    assert len(lost) == 1 and len(store.folders(store.versions()[-1])) <= 2 and len(store.versions()) == 5
