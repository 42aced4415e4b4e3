from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graphloom.operators import evolve, link, traverse
from graphloom.operators import graph as graphs
from graphloom.operators.graph import PropertyGraph, dedup_nodes
from graphloom.sources import extract as x

NODE = "id string, kind string, name string, repo string, path string, line int, doc string, ord long"
EDGE = "src string, dst string, kind string, ord long"


def graph(spark, nodes, edges):
    n = [(i, k, i, "r", i, 0, None, o) for o, (i, k) in enumerate(nodes)]
    return PropertyGraph(spark.createDataFrame(n, NODE), spark.createDataFrame([(*e, o) for o, e in enumerate(edges)], EDGE))


def test_first_write_wins_and_meta_is_merged(spark):
    rows = [("a", "file", "one", "r", "p", 1, "old", 0), ("a", "class", "two", "r", "q", 2, None, 1), ("a", "class", "x", "r", "q", 2, "new", 2)]
    (row,) = dedup_nodes(spark.createDataFrame(rows, NODE)).collect()
    assert (row.kind, row.name, row.line, row.doc, row.ord) == ("file", "one", 1, "new", 0)


def test_merge_replays_the_other_graph(spark):
    a, b = graph(spark, [("a", "file")], [("a", "b", "calls")]), graph(spark, [("a", "class"), ("b", "file")], [("a", "b", "calls")])
    m = a.merge(b)
    assert {(r.id, r.kind) for r in m.nodes.collect()} == {("a", "file"), ("b", "file")}
    assert m.edges.count() == 1


def test_structure(spark):
    g = graph(spark, [("a", "file"), ("b", "file"), ("c", "file")], [("a", "b", "imports"), ("b", "b", "calls"), ("a", "z", "calls")])
    assert {(r.id, r.degree) for r in g.degree().collect()} == {("a", 2), ("b", 3), ("z", 1)}
    assert [r.dst for r in g.dangling().collect()] == ["z"]
    assert [r.id for r in g.orphans().collect()] == ["c"]
    assert g.repaired().edges.count() == 2
    assert {(r.direction, r.other) for r in g.neighbors(spark.createDataFrame([("b",)], "id string")).collect()} == {("in", "a"), ("out", "b")}


def test_search_in_breadth(spark):
    g = graph(spark, [(c, "file") for c in "abcde"], [("a", "b", "imports"), ("b", "c", "imports"), ("a", "c", "calls"), ("c", "d", "imports"), ("d", "a", "imports"), ("e", "a", "other")])
    seeds = spark.createDataFrame([("a",)], "id string")
    assert {(r.id, r.distance) for r in traverse.bfs(g.edges, seeds, ("imports", "calls"), "out", 5).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    assert {(r.id, r.distance) for r in traverse.impact(g.edges, spark.createDataFrame([("c",)], "id string"), 1).collect()} == {("a", 1), ("b", 1)}
    assert traverse.impact(g.edges, spark.createDataFrame([("none",)], "id string")).count() == 0


def test_pagerank_sums_to_one(spark):
    g = graph(spark, [(c, "file") for c in "abcd"], [("a", "b", "imports"), ("c", "b", "calls"), ("b", "a", "imports")])
    ranks = {r.id: r["rank"] for r in traverse.pagerank(g.nodes, g.edges).collect()}
    assert sum(ranks.values()) == pytest.approx(1)
    assert max(ranks, key=ranks.get) == "b"
    assert traverse.centrality(traverse.pagerank(g.nodes, g.edges)).agg(F.max("centrality")).first()[0] == pytest.approx(1)


def test_reading_order_and_levels(spark):
    g = graph(spark, [(c, "file") for c in "abcxy"], [("a", "b", "imports"), ("b", "c", "imports"), ("x", "y", "imports"), ("y", "x", "imports")])
    assert {r.id: r.level for r in traverse.reading_levels(g.edges, g.nodes).collect()} == {"c": 0, "b": 1, "a": 2, "x": None, "y": None}
    assert traverse.reading_order(g.nodes, g.edges) == ["c", "b", "a", "x", "y"]


def test_api_calls_meet_suffixes(spark):
    calls = spark.createDataFrame([("c1", "GET", "/api/users/*"), ("c2", "POST", "/api/users/*"), ("c3", "GET", "/*")], "id string, method string, path string")
    ends = spark.createDataFrame([("e1", "GET", "/users/*"), ("e2", "GET", "/*")], "id string, method string, path string")
    assert [tuple(r) for r in link.link_api(calls, ends).collect()] == [("c1", "e1", 1)]


def test_longest_prefix(spark):
    calls = spark.createDataFrame([("c", "/api/agent/run"), ("d", "/api/agents")], "id string, path string")
    routes = spark.createDataFrame([("r1", "/api"), ("r2", "/api/agent")], "id string, prefix string")
    assert {(r.call, r.route) for r in link.longest_prefix(calls, routes).collect()} == {("c", "r2"), ("d", "r1")}


def test_calls_need_a_unique_name(spark):
    calls = spark.createDataFrame([("a", "r", "f"), ("a", "r", "g"), ("a", "r", "h")], "file string, repo string, name string")
    defs = spark.createDataFrame([("a#f", "a", "r", "f"), ("b#f", "b", "r", "f"), ("b#g", "b", "r", "g"), ("c#h", "c", "r", "h"), ("d#h", "d", "r", "h")], "id string, file string, repo string, name string")
    assert {(r.id, r.role) for r in link.link_calls(calls, defs).collect()} == {("a#f", "same_file"), ("b#g", "cross_file")}


def test_overlay(spark):
    g = graph(spark, [("a", "file"), ("b", "file")], [])
    notes = spark.createDataFrame([("a", "by hand", True), ("gone", "x", None)], "id string, doc string, deprecated boolean")
    out, missing = evolve.apply_overlay(g, notes, spark.createDataFrame([("a", "b", None), ("a", "q", "calls")], "src string, dst string, kind string"))
    assert {(r.id, r.doc, r.deprecated) for r in out.nodes.collect()} == {("a", "by hand", True), ("b", None, None)}
    assert [r.kind for r in out.edges.collect()] == ["relates_to"]
    assert {(r.part, r.key) for r in missing.collect()} == {("node", "gone"), ("edge", "a calls q")}


def files(spark, *rows):
    return spark.createDataFrame([("r", p, t) for p, t in rows], "repo string, path string, text string")


PY = '''"""Users."""
from fastapi import APIRouter
from svc import util
router = APIRouter(prefix="/users")
class Store:
    """Keeps."""
    def get(self): return 1
def helper(): return "fake(1)"
@router.get("/{user_id}")
async def read_user(user_id): return helper()
'''


def test_python_files(spark):
    rows = x.extract(files(spark, ("api.py", PY), ("bad.py", "def ("))).collect()
    nodes = {r.id: r for r in rows if r.part == "node"}
    assert nodes["r:api.py#Store.get"].kind == "function" and nodes["r:api.py#Store"].doc == "Keeps."
    assert nodes["r:api.py#EP GET /users/{user_id}"].handler == "read_user"
    assert nodes["r:bad.py"].error == "parse_error"
    assert "helper" in nodes["r:api.py"].calls and "fake" not in nodes["r:api.py"].calls
    edges = {(r.src, r.dst, r.kind) for r in rows if r.part == "edge"}
    assert ("r:api.py", "r:api.py#helper", "calls") in edges
    assert ("r:api.py#EP GET /users/{user_id}", "r:api.py#read_user", "route_of") in edges
    assert ("r:api.py", "svc/util", "import_of") in edges


def test_imports_resolve_to_known_files(spark):
    rows = x.extract(files(spark, ("api.py", PY), ("svc/util.py", ""), ("svc/__init__.py", "")))
    imports = rows.filter("kind = 'import_of'").select("src", "repo", F.col("dst").alias("base"))
    known = rows.filter("kind = 'file'").select("repo", "path", "id")
    found = {(r.src, r.target) for r in link.resolve_imports(imports, known).collect()}
    assert found == {("r:api.py", "r:svc/util.py"), ("r:api.py", "r:svc/__init__.py")}


def test_script_files(spark):
    text = "/** Users page */\nimport {a} from './util';\nexport default async function Page() {}\nexport const get_all_users = 1;\napi.get(`/api/users/${id}`);\n"
    rows = x.extract(files(spark, ("src/app/(main)/users/page.tsx", text))).collect()
    nodes = {(r.kind, r.name) for r in rows if r.part == "node"}
    assert {("function", "Page"), ("function", "get_all_users"), ("api_call", "GET /api/users/*"), ("route", "/users")} <= nodes
    assert any(r.kind == "import_of" and r.dst == "src/app/(main)/users/util" for r in rows)


def test_rust_files(spark):
    text = '//! Gate.\nuse crate::auth::check;\npub struct App;\nimpl App {\n  pub fn run(&self) { let s = "fn no("; }\n}\nfn health() {}\nfn main() { Router::new().route("/health", get(health)); }\n'
    rows = x.extract(files(spark, ("src/main.rs", text))).collect()
    nodes = {(r.kind, r.name) for r in rows if r.part == "node"}
    assert {("class", "App"), ("function", "App::run"), ("function", "health"), ("endpoint", "GET /health")} <= nodes
    edges = {(r.dst, r.kind) for r in rows if r.part == "edge"}
    assert ("r:src/main.rs#health", "route_of") in edges and ("src/auth/check", "import_of") in edges


def test_gateway_and_infra(spark):
    pytest.importorskip("yaml")
    gate = "base_path: /api\nservices:\n  agents:\n    host: http://agent-svc:8000\n    modules: [agent, chat]\n"
    rows = x.extract(files(spark, ("config/services.yaml", gate))).collect()
    assert {(r.prefix, r.host) for r in rows if r.kind == "gateway_route"} == {("/api/agent", "agent-svc"), ("/api/chat", "agent-svc")}
    project = "destinations: {dev: {domain: d.example}}\nenvironments: {dev: {services: [{name: web, hasDomain: true}]}, prd: {services: [{name: web}]}}\n"
    rows = x.extract(files(spark, ("k/values/web.yaml", "serviceName: w"), ("argocd/projects/main.yaml", project)), infra=True).collect()
    assert {(r.kind, r.role) for r in rows if r.part == "edge" and r.kind in ("deploys", "serves")} == {("deploys", "dev,prd"), ("serves", "dev=d.example")}


def test_call_names_agree(spark):
    text = 'a(1) # b(2)\nc = "d(3)" + f"{e(4)}"; if (x) g (5)\n/* h(6) */ `${i(7)} j(8)`'
    by_column = spark.createDataFrame([(text,)], "t string").select(x.call_names(F.col("t"))).first()[0]
    assert by_column == x.called(text) == ["a", "e", "g", "i"]


def test_specs_mean_files_before_workspaces(spark, tmp_path, monkeypatch):
    """The same targets whether the tables to look up in are few rows or many, and imports are broadcast in no case."""
    rows = [("a", "r", "@/ui"), ("a", "r", "@x/ui/deep"), ("b", "r", "@/gone"), ("c", "r", "gone"), ("d", "r", "./ui"), ("e", "q", "@/ui"), ("f", "r", "@/lib"), ("a", "r", "@/ui")]
    spark.createDataFrame(rows, "src string, repo string, spec string").write.parquet(str(tmp_path / "i"))
    imports = spark.read.parquet(str(tmp_path / "i"))
    files = spark.createDataFrame([("r", "web/ui.tsx", "1"), ("r", "web/ui/index.ts", "2"), ("r", "web/lib/index.js", "3")], "repo string, path string, id string")
    aliases = spark.createDataFrame([("r", "@/", "web"), ("r", "@", "lib")], "repo string, alias string, target string")
    ways = spark.createDataFrame([("r", "@x/ui", "packages/ui"), ("r", "@x", "packages"), ("r", "@", "p")], "repo string, name string, dir string")
    for most in (100, 0):
        monkeypatch.setattr(link, "LOOKUP_ROWS", most)
        out = link.resolve_specs(imports, files, aliases, ways)
        assert sorted(map(tuple, out.collect())) == [("a", "@/ui", "file", "1"), ("a", "@x/ui/deep", "feature", "@x"), ("b", "@/gone", "feature", "@"), ("f", "@/lib", "file", "3")]
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("SortMergeJoin") == (0 if most else 3) and "BuildLeft" not in plan and "LeftAnti" not in plan


def test_routing_tables_are_parsed_by_the_fast_loader(monkeypatch):
    """The plain loader takes about a millisecond for a small file; it is for builds without the other."""
    yaml = pytest.importorskip("yaml")
    texts = ["base_path: /api/\nservices:\n  s:\n    host: http://h:80\n    modules: [m, /n/, 1, null]\n", "services: [", "a: *b", "services: {s: {host: \x00}}", "- 1", "", "d: 2024-01-01", "a: &x [1]\nb: *x"]
    seen = [x._yaml(t) for t in texts]
    assert seen[0]["services"]["s"]["modules"] == ["m", "/n/", 1, None] and seen[1] == seen[2] == seen[4] == seen[5] == {} and seen[7] == {"a": [1], "b": [1]}
    if yaml.__with_libyaml__:
        with monkeypatch.context() as m:
            m.setattr(yaml.SafeLoader, "__init__", lambda *a: pytest.fail("the plain loader"))
            assert x._yaml(texts[0]) == seen[0]
    with monkeypatch.context() as m:
        m.delattr(yaml, "CSafeLoader", raising=False)
        assert [x._yaml(t) for t in texts] == seen


def odd_graph(spark, tmp_path):
    """Repeated and null ids, repeated edges, null ends, loops, nodes that only dangling edges touch."""
    nodes = [(i, "file", i, "r", i, 0, None, o) for o, i in enumerate(["a", "b", "b", "c", "d", "d", "e", None, *(f"n{k}" for k in range(200))])]
    pairs = [("a", "b"), ("a", "b"), ("b", "b"), ("c", "z"), ("z", "c"), ("z", "z"), ("d", None), (None, "d"), (None, None), ("y", "b"), (None, "z")]
    pairs += [(f"n{k}", f"n{k + 1}" if k % 3 else f"x{k}") for k in range(150)]
    spark.createDataFrame(nodes, NODE).write.parquet(str(tmp_path / "n"))
    spark.createDataFrame([(*p, "calls", o) for o, p in enumerate(pairs)], EDGE).write.parquet(str(tmp_path / "e"))
    return PropertyGraph(spark.read.parquet(str(tmp_path / "n")), spark.read.parquet(str(tmp_path / "e")))


def test_health_before_and_after_the_repair(spark, tmp_path, monkeypatch):
    """As counted on the frames themselves, whether the bitmap tells most ids apart or none."""
    g = odd_graph(spark, tmp_path)
    count = lambda h: {"nodes": h.nodes.count(), "edges": h.edges.count(), "dangling": h.dangling().count(), "orphans": h.orphans().count()}
    before, after = count(g), count(g.repaired())
    assert before["dangling"] > after["dangling"] == 0 and after["orphans"] > before["orphans"] > 1
    for words in (graphs.BITMAP_WORDS, 1):
        monkeypatch.setattr(graphs, "BITMAP_WORDS", words)
        assert {r.measure: r.n for r in g.health(repaired=True).collect()} == before | {f"repaired {k}": v for k, v in after.items()}
        assert {r.measure: r.n for r in g.health().collect()} == before
        e = graphs.edges_at(g.edges, spark.createDataFrame([("a",), ("x3",), ("n7",), ("gone",)], "id string"))
        found = sorted((r.src or "", r.dst or "") for r in e.collect())
        assert found == sorted([("", ""), ("", "d"), ("", "z"), ("d", ""), ("a", "b"), ("a", "b"), ("n3", "x3"), ("n7", "n8")])
    empty = PropertyGraph(g.nodes.limit(0), g.edges.limit(0))
    assert [(r.measure, r.n) for r in empty.health().collect()] == [("nodes", 0), ("edges", 0), ("dangling", 0), ("orphans", 0)]


def test_health_shuffles_each_table_once(spark, tmp_path):
    """Every shuffle stays on disk until the query ends: edges without duplicates are made once, and ends are shuffled as counts."""
    g = odd_graph(spark, tmp_path)
    trade = PropertyGraph(g.nodes, g.edges.select("src", "dst").distinct())
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    was = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        plan = trade.health(repaired=True)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    own = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "ReusedExchange" not in line]
    assert sum("(src#" in x and ", dst#" in x for x in own) == 1
    assert len(own) <= 8, plan
