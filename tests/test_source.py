"""The Go front end, structural search, runtime contracts, edits, git, streaming and the surface, on small modules."""

import json
import os
import subprocess

import pytest

from graphloom import edits, render, surface
from graphloom.model import NotFound
from graphloom.operators import contracts as C
from graphloom.operators import delta as D
from graphloom.operators import fulltext as T
from graphloom.operators import pattern as P
from graphloom.operators import runtime as R
from graphloom.plans.materialize import dealt
from graphloom.sources import go_source as S
from graphloom.sources import vcs, workspace
from graphloom.sources.golang.extract import facts, integer, wire_name
from graphloom.sources.golang.syntax import SyntaxProblem, parse
from graphloom.sources.sinks import Store
from graphloom.functions.stem import stem

A = """// Package a does things. And more.
package a

import (
	"ex.com/m/b"
	"github.com/nats-io/nats.go"
)

// Runner runs.
type Runner interface {
	Run(n int) error
}

type Wide interface {
	Runner
	Log(s string)
}

// Impl is one.
type Impl struct {
	b.Base
	helper *b.Tool
	Name string `json:"name,omitempty"`
}

func (i *Impl) Run(n int) error {
	i.Log("x")
	i.helper.Fix(n)
	if n > 1 && n < 3 {
		return b.Make().Fix(1)
	}
	return nil
}

const (
	MsgTypeAsk = "agent.ask"
	one = iota + 1
	two
)

func use(r Runner) {
	defer dead()
	r.Run(1)
	t := b.Make()
	f := t.Fix
	_ = f
	for k := range list() {
		k.Fix(2)
	}
}

func dead() {}

func list() []*b.Tool { return nil }

var shared = b.Make()

func more(nc *nats.Conn, m b.Msg) {
	shared.Fix(b.Limit)
	nc.Publish("orders."+"x", "orders.%s")
	switch m.MsgType {
	case "hello",
		MsgTypeAsk, b.MsgTypeOther:
	}
}
"""
B = """package b

const Limit = 10
const MsgTypeOther = "other"

type Msg struct{ MsgType string }
type Base struct{}

func (Base) Log(s string) {}

type Tool struct{}

func (t *Tool) Fix(n int) error { return nil }

func Make() *Tool { return &Tool{} }

type Broken struct{ ext.Thing }

func (Broken) Run(n int) error { return nil }
"""


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("mod")
    for path, text in {"go.mod": "module ex.com/m\n", "a/a.go": A, "b/b.go": B, "b/bad.go": "package b\nfunc {\n", "vendor/v/v.go": "package v\n", "a/a_test.go": 'package a\n\nimport "testing"\n\nfunc TestUse(t *testing.T) { dead() }\n'}.items():
        (base / path).parent.mkdir(parents=True, exist_ok=True)
        (base / path).write_text(text)
    return base


@pytest.fixture(scope="module")
def g(spark, root):
    return S.index(S.read_files(spark, str(root)))


def edges(g, kind):
    return {(r["from_ref"].removeprefix("ex.com/m/"), r["to_ref"].removeprefix("ex.com/m/")) for r in g.edges.where(f"edge_type = '{kind}'").collect()}


def test_calls(g):
    assert edges(g, "calls") >= {("a.Impl.Run", "b.Base.Log"), ("a.Impl.Run", "b.Tool.Fix"), ("a.Impl.Run", "b.Make"), ("a.use", "a.Runner.Run"), ("a.use", "b.Make"), ("a.use", "a.dead"), ("a.more", "b.Tool.Fix"), ("a.TestUse", "a.dead"), ("a.shared", "b.Make")}
    assert edges(g, "references") >= {("a.use", "b.Tool.Fix"), ("a.use", "a.Runner"), ("a.more", "a.shared"), ("a.more", "b.Limit"), ("b.Make", "b.Tool")}
    assert edges(g, "embeds") == {("a.Impl", "b.Base"), ("a.Wide", "a.Runner"), ("b.Broken", "ext.Thing")}
    assert edges(g, "satisfies") == {("a.Impl", "a.Runner"), ("a.Impl", "a.Wide")}
    assert ("a", "b") in edges(g, "imports")


def test_relations(g):
    symbols = {r["qualified_name"].removeprefix("ex.com/m/"): r for r in g.symbols.collect()}
    assert symbols["a.Impl.Run"]["complexity"] == 3 and symbols["a.Impl.Run"]["receiver"] == "Impl"
    assert (symbols["a.one"]["signature"], symbols["a.two"]["signature"], symbols["a.MsgTypeAsk"]["signature"]) == ("2", "3", '"agent.ask"')
    assert symbols["a.Impl"]["fields"][2]["wire_name"] == "name" and symbols["a.TestUse"]["is_test"]
    assert {r["path"]: (r["doc"], r["is_test"]) for r in g.packages.collect()}["ex.com/m/a"] == ("Package a does things.", False)
    problem = g.diagnostics.collect()
    assert len(problem) == 1 and problem[0]["line"] == 2


def test_syntax():
    for text in ("x := map[string][]int{\"a\": {1, 2}}[k][0]", "for i := range 10 {}", "if x := (T{1}); x.ok {}", "switch y := v.(type) { case []int, map[string]int: }", "select { case ch <- 1: default: }", "L: for { break L }", "var f func(a, b int, c ...string) (x, y error) = nil", "go func() { defer close(c) }()", "a[1:2:3], *p = f(g[int](x)...), <-c", "type P[T any, K comparable] struct { m map[K]T }"):
        parse(f"package p\nfunc f() {{\n{text}\n}}\n")
    parse("package p\ntype A [N]int\ntype B[T ~int | string] []T\nfunc (b *B[T]) M() {}\ntype I interface { ~int | string; M() }\nvar _ = [...]string{2: \"x\"}\nvar r = 'a'\nvar s = `raw\n`\n")
    for text in ("package p\nfunc f( {", "package p\nvar x = ", "func f() {}", "package p\n#"):
        with pytest.raises(SyntaxProblem):
            parse(text)
    assert facts("x.go", "package p\nvar", "r", "p")["error"]["line"] == 2


def test_values():
    value = lambda text, iota=0: integer(parse(f"package p\nconst x = {text}")[0].decls[0].specs[0].values[0], iota)
    assert (value("1 << iota", 4), value("-7 / 2"), value("-7 % 2"), value("0x10 | 1"), value("^0"), value("1 / 0"), value("y")) == (16, -3, -1, 17, -1, None, None)
    assert wire_name('`json:"-" yaml:"y,inline" db:"d"`', "N") == "y" and wire_name('`cbor:"c" json:"j"`', "N") == "c" and wire_name(None, "N") == "N"


@pytest.mark.parametrize(("source", "want"), [("run($X, $X)", ["run(a, a)"]), ("defer $X", ["defer mu.Unlock()"]), ("$A == $A", ["x == x"]), ("if $E := $C; $E != nil { return $E }", ["if err := run(a, a); err != nil { return err }"]), ("T{A: 1, ...}", ["T{A: 1, B: 2}"]), ("g($A...)", ["g(xs...)"]), ("g($A)", []), ("go $F", ["go work(1)"])])
def test_patterns(source, want):
    text = "package p\nfunc f(xs ...int) error {\n\tdefer mu.Unlock()\n\tif err := run(a, a); err != nil { return err }\n\tx := T{A: 1, B: 2}\n\tif x == x { go work(1) }\n\tg(xs...)\n\treturn nil\n}\n"
    assert [hit[2] for hit in P.found(P.compiled(source), text)] == want


def test_pattern_search(g):
    with pytest.raises(ValueError):
        P.compiled("if {")
    assert [(r["text"], r["symbol"].rpartition(".")[2]) for r in P.pattern_search(g, "b.Make()").collect()] == [("b.Make()", "Run"), ("b.Make()", "use"), ("b.Make()", "shared")]


def test_runtime(g):
    found = {(r["kind"], r["pattern"], r["direction"]) for r in R.runtime_contracts(g).collect()}
    assert found == {("jetstream", "orders.:request_id", "producer"), ("ws_type", "agent.ask", "shared"), ("ws_type", "other", "shared"), ("ws_type", "hello", "consumer"), ("ws_type", "agent.ask", "consumer"), ("ws_type", "other", "consumer")}
    more = R.merged(R.DEFAULTS, (R.Extractor("redis", producers=("Put",)), R.Extractor("amqp", consumers=("Consume",))))
    assert len(more) == 4 and more[0].producers[-1] == "Put" and "Set" in more[0].producers


def test_normalizers(spark):
    some = "0123abcd-0123-4567-89ab-0123456789ab"
    cases = [
        (R.REDIS_RULES, '"job:2024-01-02:10.0.0.1:%s:<name>"', "job:{date}:{ip}::{name}::{name}"),
        (R.REDIS_RULES, f"`a.<x>.b:{some}:{some.upper()}`", "a.:{name}.b:{id}:" + some.upper()),
        (R.SUBJECT_RULES, f'"orders.<id>.{some}.%d.{{user_id}}"', "orders.:request_id.:id.:request_id.{user_id}"),
    ]
    for rules, text, want in cases:
        df = spark.createDataFrame([(text,)], "v string")
        assert df.select(R.normalized(df["v"], rules)).first()[0] == want


def test_contracts_from_source(spark, tmp_path):
    for repo, text in {"x": 'package w\nconst MsgTypeA = "v"\ntype A struct { Id int; Name string }\nfunc send() { encode(MsgTypeA) }\n', "y": 'package w\nconst MsgTypeA = "v"\ntype A struct { Id int; Title string }\n'}.items():
        (tmp_path / repo).mkdir()
        (tmp_path / repo / "w.go").write_text(text)
        (tmp_path / repo / "go.mod").write_text(f"module ex.com/{repo}\n")
    g = S.index_workspace(spark, {"": str(tmp_path / "x"), "ex.com/y": str(tmp_path / "y")})
    constants, shapes = C.constants_of(g.symbols), C.shapes_of(g.symbols)
    rows = C.contracts(constants, shapes).collect()
    assert [(r["from_ref"], r["confidence"], r["severity"], r["suggested"]) for r in rows] == [("ex.com/x.MsgTypeA", 1.0, "breaking", False)]
    assert [(r["wire_name"], r["status"]) for r in C.shape_drift(constants, shapes).collect()] == [("Name → Title", "renamed")]
    pair = spark.createDataFrame([("ex.com/y.MsgTypeA", "ex.com/x.MsgTypeA")], "from_ref string, to_ref string")
    assert C.unsuppressed(C.contracts(constants, shapes), pair).count() == 0
    # The constant's own declaration is no use; the call inside of send tells its role.
    assert [tuple(r) for r in C.constant_uses(g).select("ref", "line", "enclosing").collect() if r["enclosing"] != r["ref"]] == [("ex.com/x.MsgTypeA", 4, "ex.com/x.send")]
    assert [(r["ref"], r["role"]) for r in C.site_roles(C.constant_uses(g)).collect()] == [("ex.com/x.MsgTypeA", "producer")]
    assert {(r["field"], r["status"]) for r in surface.call(g, "contract_drift").collect()} == {("Name → Title", "renamed")}
    beside = workspace.siblings(str(tmp_path / "x"))
    assert [os.path.basename(p) for p in beside] == ["x", "y"]


def test_text_search(g):
    rows = T.search_text(g, "helper Fix|MsgTypeAsk").orderBy("rank").collect()
    assert rows and {r["path"].rpartition("/")[2] for r in rows} == {"a.go"}
    assert "i.helper.Fix(n)" in rows[0]["text"] or "MsgTypeAsk" in rows[0]["text"]
    found, made, hint = T.search_corrected(g, "MsgTypeAsq")
    assert made == {"MsgTypeAsq": "msgtypeask"} and found.count() > 0 and hint is None
    assert T.search_corrected(g, "nothing[a-z]+here")[2]
    assert T.alternatives(" a | | -- |b") == ["a", "b"]
    assert T.search_regex(g, "^func use").count() == 1


def test_stemmer():
    #: Pairs from the published description of the algorithm.
    for word, want in {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit", "triplicate": "triplic", "hopefulness": "hope", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "controll": "control"}.items():
        assert stem(word) == want


@pytest.fixture
def work(spark, tmp_path):
    (tmp_path / "go.mod").write_text("module ex.com/w\n")
    (tmp_path / "w.go").write_text("package w\n\n// F does.\nfunc F() int { return g() }\n\nfunc g() int { return 1 }\n\nfunc lonely() {}\n\nvar (\n\tx = 1\n\ty = g()\n)\n")
    (tmp_path / "v.go").write_text("package w\n\nfunc h() { g := 2; _ = g; F() }\n")
    return tmp_path, S.index(S.read_files(spark, str(tmp_path)))


def test_edits(work):
    path, g = work
    with pytest.raises(edits.Refused, match="used 2 times"):
        edits.delete(g, "ex.com/w.g")
    with pytest.raises(edits.Refused, match="exported"):
        edits.delete(g, "ex.com/w.F")
    with pytest.raises(edits.Refused, match="grouped"):
        edits.delete(g, "ex.com/w.x")
    with pytest.raises(edits.Refused, match="parse"):
        edits.replace_body(g, "ex.com/w.g", "func g( {")
    with pytest.raises(NotFound):
        edits.delete(g, "ex.com/w.nope")
    edits.delete(g, "ex.com/w.lonely").apply()
    assert "lonely" not in (path / "w.go").read_text()
    assert edits.replace_body(g, "ex.com/w.g", "func g() int { return 1 }").unchanged
    edits.replace_body(g, "ex.com/w.g", "func g() int { return 2 }").apply()
    edits.insert(g, "ex.com/w.F", "func before() {}", after=False).apply()
    text = (path / "w.go").read_text()
    assert "return 2" in text and text.index("before") < text.index("// F does.")


def test_rename(work):
    path, g = work
    for new, why in (("F", "already"), ("func", "identifier"), ("g", "already")):
        with pytest.raises(edits.Refused, match=why):
            edits.rename(g, "ex.com/w.g" if new != "func" else "ex.com/w.g", new)
    plan = edits.rename(g, "ex.com/w.g", "compute")
    assert plan.sites == 3
    plan.apply()
    assert (path / "w.go").read_text().count("compute") == 3 and "compute" not in (path / "v.go").read_text()


def test_git(spark, tmp_path):
    run = lambda *args: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@example.com", *args], check=True, capture_output=True)
    assert not vcs.is_repo(str(tmp_path))
    run("init", "-b", "trunk")
    with pytest.raises(vcs.NoCommits):
        vcs.churn(spark, str(tmp_path))
    (tmp_path / "w.go").write_text("package w\n\nfunc A() int { return 1 }\n\nfunc B() {}\n\nfunc C() {}\n")
    run("add", ".")
    run("commit", "-m", "one")
    (tmp_path / "w.go").write_text("package w\n\nfunc A() int { return 2 }\n\nfunc D() {}\n\nfunc E() { A() }\n")
    (tmp_path / "n.go").write_text("package w\n")
    assert vcs.default_ref(str(tmp_path)) == "trunk" and vcs.untracked(str(tmp_path)) == ["n.go"] and vcs.changed(str(tmp_path), "HEAD") == ["w.go"]
    assert [tuple(r)[1:] for r in vcs.churn(spark, str(tmp_path)).collect()] == [(1,)]
    assert [r["status"] for r in vcs.statuses(spark, str(tmp_path), "HEAD").collect()] == ["M"]
    assert {(r["side"], r["first"], r["last"]) for r in D.hunks(vcs.diff_lines(spark, str(tmp_path), "HEAD")).collect()} == {("removed", 3, 3), ("added", 3, 3), ("removed", 5, 5), ("added", 5, 5), ("removed", 7, 7), ("added", 7, 7)}
    with pytest.raises(vcs.NotInRef):
        vcs.show(str(tmp_path), "HEAD", "n.go")
    changes = D.changed_symbols(vcs.shapes_at(spark, str(tmp_path), "HEAD", "w"), vcs.shapes_at(spark, str(tmp_path), None, "w"))
    assert {(r["name"], r["change"], r["was"]) for r in changes.collect()} == {("w.A", "modified", None), ("w.D", "renamed", "w.B"), ("w.C", "removed", None), ("w.E", "added", None)}
    run("mv", "w.go", "v.go")
    g = S.index(S.read_files(spark, str(tmp_path), "w"))
    rows = surface.call(g, "changed_symbols", root=str(tmp_path), include_bodies=True).collect()
    assert {(r["name"], r["change"], r["file"], r["line"], r["direct_callers"]) for r in rows if r["section"] == "symbol"} == {("w.A", "modified", "v.go", 3, 1), ("w.D", "renamed", "v.go", 5, 0), ("w.C", "removed", "w.go", 7, 0), ("w.E", "added", "v.go", 7, 0)}
    assert {r["detail"] for r in rows if r["name"] == "w.A"} == {"func A() int { return 2 }"}
    run("remote", "add", "origin", str(tmp_path))
    run("update-ref", "refs/remotes/origin/main", "HEAD")
    run("symbolic-ref", "refs/remotes/origin/HEAD", "refs/remotes/origin/main")
    assert vcs.default_ref(str(tmp_path)) == "main"


def test_workspace(tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "go.mod").write_text("module ex.com/one\n")
    config = tmp_path / "w.json"
    good = {"members": ["one", "gone"], "contracts": {"suppress": ["a.B <-> c.D"], "runtime_extractors": [{"kind": "amqp", "producer_methods": ["Send"], "normalize": "subject"}]}}
    config.write_text(json.dumps(good))
    found = workspace.load(str(config))
    assert list(found.members) == ["ex.com/one"] and len(found.missing) == 1 and found.suppress == [("a.B", "c.D")] and found.extractors[-1].kind == "amqp"
    for bad in ({}, {"members": ["one"], "extra": 1}, {"members": ["one", "one"]}, {"members": ["one"], "contracts": {"confidence_threshold": 2}}, {"members": ["one"], "contracts": {"suppress": ["a"]}}, {"members": ["one"], "contracts": {"runtime_extractors": [{"kind": "k", "normalize": "x"}]}}, {"members": ["one"], "contracts": {"runtime_extractors": [{"kind": "k", "config_patterns": ["("]}]}}):
        config.write_text(json.dumps(bad))
        with pytest.raises(workspace.ConfigError):
            workspace.load(str(config))


def test_surface(g):
    for tool, given in (("nope", {}), ("callers_of", {}), ("callers_of", {"qualified_name": "x", "depth": 0}), ("callers_of", {"qualified_name": "x", "depth": True}), ("callers_of", {"qualified_name": "x", "edge_types": ["x"]}), ("search", {"pattern": "x", "kind": "y"}), ("contracts", {"min_confidence": 2.0}), ("unused", {"depth": 1}), ("find_declaration", {"file_path": "x"})):
        with pytest.raises(surface.ArgumentError):
            surface.call(g, tool, **given)
    assert surface.call(g, "search", pattern="impl", kind="type").count() == 1
    assert surface.call(g, "show", qualified_name="ex.com/m/a.dead", source=True).first()["body"] == "func dead() {}"
    assert surface.call(g, "find_declaration", file_path=g.symbols.where("name = 'use'").first()["pos_file"], line=46).first()["qualified_name"] == "ex.com/m/a.use"
    assert surface.schema("callers_of")["depth"]["high"] == 100
    given = {"qualified_name": "ex.com/m/a.dead", "path": "ex.com/m/a", "type_name": "ex.com/m/a.Impl", "pattern": "dead", "package_path": "ex.com/m/a", "interface_name": "ex.com/m/a.Runner", "edge_type": "calls", "files": ["a/a.go"], "from": "ex.com/m/a.use", "to": "ex.com/m/a.dead", "file_path": "a.go", "symbol": "dead", "root": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    for tool, (spec, _) in surface.TOOLS.items():
        surface.call(g, tool, **{n: given[n] for n, a in spec.items() if a.required or n == "symbol"}).collect()


def test_render(spark):
    df = spark.createDataFrame([("a,b", 1, "", None), ("plain", 2, "", 1.5)], "name string, n int, repo string, x double")
    assert render.render("rows", df) == 'rows[2]{name,n,x}:\n  "a,b",1,null\n  plain,2,1.5'
    assert json.loads(render.render("rows", df, "json"))["rows"][1]["name"] == "plain"
    for text in (json.dumps({"a": ["x" * 30] * 40, "b": {"c": "},{\""}, "d": 1}), "\n".join(f"t{k}[1]{{a}}:\n  {'v' * 300}" for k in range(40)), "é" * 5000, "one\n" * 3000):
        parts = render.sections(text, 2000)
        assert "".join(p.content for p in parts) == text and len(parts) > 1 or len(text) < 2000
        assert all(p.size <= 2000 for p in parts)
    chunks = spark.createDataFrame([(f"r{k}", "t", 0, "x", "Hello", 100 * (k + 1), k) for k in range(5)], "response_id string, tool string, section_idx int, title string, content string, byte_count long, created_at long")
    assert {r["response_id"] for r in render.kept_responses(chunks, 900).collect()} == {"r4", "r3"}
    assert {r["response_id"] for r in render.kept_responses(chunks, 1).collect()} == {"r4"}
    assert render.find_sections(chunks, "r1", "hELLO").count() == 1 and render.manifest(chunks).count() == 5
    calls = spark.createDataFrame([("a", False, 10, 100), ("a", True, 10, 0), ("b", False, 5, 1)], "tool string, error boolean, response_bytes long, raw_bytes long")
    assert {r["tool"]: (r["calls"], r["errors"], r["saved"]) for r in render.usage(calls).collect()} == {"a": (2, 1, 0.8), "b": (1, 0, 0.0)}


def test_stream(spark, tmp_path):
    from graphloom.streaming.ingest import FILES, follow

    changes, store = str(tmp_path / "changes"), Store(spark, f"file://{tmp_path}/store")
    rows = lambda *xs: spark.createDataFrame(xs, FILES).write.mode("append").parquet(changes)
    from datetime import datetime

    rows(("a.go", "package a\nfunc F() { G() }\nfunc G() {}\n", "r", "", datetime(2024, 1, 1)), ("q.go", "package q\nfunc Q() {}\n", "s", "", datetime(2024, 1, 1)))
    follow(spark, changes, str(tmp_path / "history"), store, str(tmp_path / "cp")).awaitTermination()
    assert {r["name"] for r in store.read().symbols.collect()} == {"F", "G", "Q"}
    rows(("a.go", "package a\nfunc F() {}\n", "r", "", datetime(2024, 1, 2)))
    follow(spark, changes, str(tmp_path / "history"), store, str(tmp_path / "cp")).awaitTermination()
    assert {r["name"] for r in store.read().symbols.collect()} == {"F", "Q"}


def test_server(g):
    from graphloom.server import Server

    server = Server(g, gate=1500)
    ask = lambda method, **params: server.handle(json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params}))
    call = lambda name, **arguments: ask("tools/call", name=name, arguments=arguments)
    assert ask("initialize")["result"]["serverInfo"]["name"] == "graphloom" and ask("ping")["result"] == {}
    tools = {t["name"]: t["inputSchema"] for t in ask("tools/list")["result"]["tools"]}
    assert tools["callers_of"]["required"] == ["qualified_name"] and tools["callers_of"]["properties"]["edge_types"]["type"] == "array"
    assert "a.use" in call("callers_of", qualified_name="ex.com/m/a.dead")["result"]["content"][0]["text"]
    assert call("callers_of", qualified_name="nope")["result"]["isError"]
    assert call("callers_of", qualified_name="x", depth=0)["error"]["code"] == -32602 and ask("nothing")["error"]["code"] == -32601
    assert server.handle("{")["error"]["code"] == -32700 and server.handle("[]")["error"]["code"] == -32600 and server.handle('{"method": "x"}') is None
    text = call("all_edges")["result"]["content"][0]["text"]
    name = text.split("\n")[0].removeprefix("response_id: ")
    parts = [call("read_response_section", response_id=name, section=k)["result"]["content"][0]["text"] for k in range(len(server.responses[name]))]
    assert "".join(parts).startswith("all_edges[") and len(parts) > 1
    assert "section" in call("read_response_section", response_id=name, query="DEAD")["result"]["content"][0]["text"]
    assert "error" in call("read_response_section", response_id="x")
    assert "callers_of,3,2" in call("stats")["result"]["content"][0]["text"]


def test_server_changes(spark, tmp_path):
    """Suppressing, indexing again and the write tools, which need leave and stay inside of the roots."""
    from graphloom.server import Server

    root = tmp_path / "m"
    root.mkdir()
    (root / "go.mod").write_text("module ex.com/w\n")
    (root / "README.md").write_text("# W\n\nDoes one thing.\n")
    (root / "w.go").write_text("package main\n\nfunc main() { A() }\n\nfunc A() {}\n\nfunc lone() {}\n")
    roots = {"": str(root)}
    store = Store(spark, f"file://{tmp_path}/store")
    store.write(S.index_workspace(spark, roots))

    def talk(server):
        def call(name, **arguments):
            answer = server.handle(json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": arguments}}))
            return answer["error"]["message"] if "error" in answer else answer["result"]["content"][0]["text"]

        return call

    closed = talk(Server(store.read(), roots=roots, store=store))
    assert "leave to write" in closed("safe_delete_symbol", qualified_name="ex.com/w.lone") and "lone" in (root / "w.go").read_text()
    assert "nothing was stale" in closed("reindex")
    assert "left out" in closed("suppress_contract", from_ref="a.B", to_ref="c.D") and store.read().suppressions.count() == 1
    server = Server(store.read(), roots=roots, store=store, allow_write=True)
    call = talk(server)
    assert "rename_symbol" in {t["name"] for t in server.tools({})["tools"]} and "depth" in call("schema", tool="callers_of")
    assert "2 places" in call("rename_symbol", qualified_name="ex.com/w.A", new_name="B") and "main() { B() }" in (root / "w.go").read_text()
    call("safe_delete_symbol", qualified_name="ex.com/w.lone")
    call("insert_after_symbol", qualified_name="ex.com/w.B", text="func C() {}")
    call("insert_before_symbol", qualified_name="ex.com/w.C", text="func D() {}")
    call("replace_symbol_body", qualified_name="ex.com/w.B", body="func B() { C() }")
    assert {r["name"] for r in store.read().symbols.collect()} == {"main", "B", "C", "D"} and store.read().suppressions.count() == 1
    outside = talk(Server(store.read(), roots={"": str(tmp_path / "other")}, allow_write=True))
    assert "outside" in outside("rename_symbol", qualified_name="ex.com/w.B", new_name="X")
    told = {(r["section"], r["name"], r["detail"]) for r in surface.call(store.read(), "summary").collect()}
    assert ("description", "ex.com/w", "Does one thing.") in told and ("entry_point", "ex.com/w.main", None) in told


def test_search_notes(g):
    """Corrections and hints come with the lines."""
    rows = surface.call(g, "search_text", pattern="sharedd").collect()
    assert ("correction", "sharedd -> shared") in {(r["section"], r["text"]) for r in rows} and any(r["section"] == "line" for r in rows)
    assert [r["section"] for r in surface.call(g, "search_text", pattern="no.such[x]+").collect()] == ["hint"]


def test_command_line(spark, root, tmp_path, capsys):
    from graphloom.__main__ import main

    assert main([]) == 2 and main(["tools"]) == 0
    assert main(["index", str(root), f"file://{tmp_path}/store"]) == 0
    capsys.readouterr()
    assert main(["query", f"file://{tmp_path}/store", "callers_of", "qualified_name=ex.com/m/a.dead", "depth=1", "--format", "json"]) == 0
    assert {r["from_ref"] for r in json.loads(capsys.readouterr().out)["callers_of"]} == {"ex.com/m/a.use", "ex.com/m/a.TestUse"}
    assert main(["query", f"file://{tmp_path}/store", "callers_of", "qualified_name=nope"]) == 1


def test_large_file(monkeypatch):
    """Comments are found where they are needed: the work for a declaration doesn't grow with the file."""
    from graphloom.sources.golang.syntax import Lines

    calls, at = [0], Lines.at
    monkeypatch.setattr(Lines, "at", lambda self, offset: (calls.__setitem__(0, calls[0] + 1), at(self, offset))[1])
    text = "package p\n" + "".join(f"\n// F{k} is one.\n// And more.\nfunc F{k}() {{}} // not this\n" for k in range(500))
    out = facts("/p/x.go", text, "m", "m/p")
    assert [s["doc"] for s in out["symbols"]] == [f"F{k} is one.\nAnd more." for k in range(500)]
    assert calls[0] < 20 * 500


def test_index_without_edges(spark, root, g):
    bare = S.index(S.read_files(spark, str(root)), edges=False)
    assert bare.edges is None
    assert sorted(r[0] for r in bare.symbols.select("qualified_name").collect()) == sorted(r[0] for r in g.symbols.select("qualified_name").collect())
    assert sorted(map(tuple, bare.spans.collect())) == sorted(map(tuple, g.spans.collect()))


def test_files_dealt(spark, g):
    """Sources that compress well are still parsed by all cores."""
    assert dealt(g.files).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("search", [lambda g: P.pattern_search(g, "b.Make()"), R.runtime_contracts])
def test_parsed_once(g, search):
    """What files gave is kept before it is joined with itself; nothing is parsed again for the result."""
    assert "MapInArrow" not in search(g)._jdf.queryExecution().optimizedPlan().toString()
