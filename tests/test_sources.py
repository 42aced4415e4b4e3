from __future__ import annotations

import json
import subprocess

from graphloom.operators import journal
from graphloom.operators.graph import PropertyGraph
from graphloom.sources import files, reports
from graphloom.sources.git import GitRefSource
from graphloom.streaming import journal as stream


def test_tree_skips_what_is_no_source(spark, tmp_path):
    for p in ("src/a.py", "node_modules/b.js", ".git/c.py", "x/Z.TSX", "pic.png", ".env"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x = 1")
    got = files.read_tree(spark, str(tmp_path), "r").collect()
    assert sorted(r.path for r in got) == ["src/a.py", "x/Z.TSX"]


def test_git_ref_is_read_without_the_working_tree(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.py").write_text("one = 1")
    git("add", "-A")
    git("commit", "-qm", "x")
    (tmp_path / "a.py").write_text("two = 2")
    spark.dataSource.register(GitRefSource)
    (row,) = spark.read.format("gitref").option("repo", "r").load(str(tmp_path)).collect()
    assert (row.repo, row.path, row.text) == ("r", "a.py", "one = 1")


def journals(tmp_path):
    for name, lines in {"s1": [{"ts": 1, "step": "a", "status": "ok"}, "broken"], "s2": [{"ts": 2, "step": "b", "status": "skipped"}, {"ts": 1, "step": "a", "status": "ok"}]}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "journal.jsonl").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))


def test_events_leave_out_lines_or_sessions(spark, tmp_path):
    journals(tmp_path)
    assert [tuple(r)[:2] + (r.step,) for r in files.read_events(spark, str(tmp_path)).orderBy("session", "seq").collect()] == [("s1", 1, "a"), ("s2", 1, "a"), ("s2", 2, "b")]
    assert {r.session for r in files.read_events(spark, str(tmp_path), drop_sessions=True).collect()} == {"s2"}


def test_graph_round_trip(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"meta": {}, "nodes": [{"id": "a", "kind": "file"}, {"id": "b", "kind": "file"}], "edges": [{"src": "a", "dst": "b", "kind": "imports"}]}))
    g = files.read_graph_json(spark, str(tmp_path / "g.json"))
    files.write_graph(g, str(tmp_path / "out"))
    back = files.read_graph(spark, str(tmp_path / "out"))
    assert back.nodes.count() == 2 and back.edges.first().dst == "b"


def test_json_round_trip_and_versions(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "file", 0), ("b", "file", 1)], "id string, kind string, ord long")
    edges = spark.createDataFrame([("a", "b", "imports", 0)], "src string, dst string, kind string, ord long")
    at = str(tmp_path / "g")
    files.write_graph_json(PropertyGraph(nodes, edges), at)
    files.write_graph_json(PropertyGraph(nodes.limit(1), edges), at)
    back = files.read_graph_json(spark, at)
    assert [r.id for r in back.nodes.collect()] == ["a"] and back.edges.first().dst == "b"
    assert len([p for p in (tmp_path / "g").iterdir() if p.name.startswith("version-")]) == 1
    # a version that was written but never named is not seen
    (tmp_path / "g" / "version-half" / "nodes").mkdir(parents=True)
    assert files.read_graph_json(spark, at).nodes.count() == 1


def test_vector_index_is_absent_rather_than_broken(spark, tmp_path):
    at = str(tmp_path / "v")
    assert files.read_vectors(spark, at) is None
    v = spark.createDataFrame([("a", [1.0, 2.0], "d")], "id string, embedding array<double>, digest string")
    files.write_vectors(v, at)
    index = files.read_vectors(spark, at)
    assert index.first().embedding == [1.0, 2.0]
    assert files.dense_reason("", index, v) == files.NO_ENDPOINT and files.dense_reason("u", None, v) == files.NO_INDEX
    assert files.dense_reason("u", index, v.limit(0)) == files.NO_ANSWER and files.dense_reason("u", index, v) is None
    for part in (tmp_path / "v").rglob("*.parquet"):
        part.write_bytes(b"half a file")
    assert files.read_vectors(spark, at) is None
    (tmp_path / "v" / "CURRENT").write_text("version-gone")
    assert files.read_vectors(spark, at) is None


def test_workspaces_and_aliases(spark):
    f = spark.createDataFrame(
        [("r", "package.json", '{"name": "root"}'), ("r", "packages/ui/package.json", '{"name": "@x/ui", /* c */ "v": 1,}'), ("r", "web/tsconfig.json", '{"compilerOptions": {"paths": {"@/*": ["./src/*"]}}} // end')],
        "repo string, path string, text string",
    )
    assert [(r.name, r.dir) for r in files.workspaces(f).collect()] == [("@x/ui", "packages/ui")]
    assert [(r.alias, r.target) for r in files.aliases(f).collect()] == [("@/", "web/src")]


def test_stream_equals_batch(spark, tmp_path):
    rows = [{"session": f"s{i}", "seq": i, "ts": f"2024-01-01T0{i % 3}:00:00Z", "step": "plan", "status": "skipped" if i % 2 else "ok"} for i in range(6)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)) + "\nbroken")
    events = stream.read_journal(spark, str(tmp_path / "in"))
    got = []
    q = stream.run_batches(events, lambda df, _: got.extend(journal.stage_coverage(df, spark.createDataFrame([("plan",)], "stage string")).collect()), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert [(r.stage, r.ran, r.skipped) for r in got] == [("plan", 3, 3)]
    counts = stream.stage_counts(stream.read_journal(spark, str(tmp_path / "in")))
    q = counts.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("counts").agg({"ran": "sum", "skipped": "sum"}).first().asDict() == {"sum(ran)": 3, "sum(skipped)": 3}


def test_reports(spark, tmp_path):
    nodes = spark.createDataFrame(
        [("r", "route", "/a/x", "web", "", 0, 0), ("f", "file", "page.tsx", "web", "page.tsx", 0, 1), ("g", "file", "<lib>.ts", "web", "lib.ts", 0, 2),
         ("c", "api_call", "GET /u", "web", "lib.ts", 0, 3), ("e", "endpoint", "GET /u", "api", "u.py", 0, 4)],
        "id string, kind string, name string, repo string, path string, line int, ord long",
    )
    edges = spark.createDataFrame([("r", "f", "route_of"), ("f", "g", "imports"), ("g", "c", "contains"), ("c", "e", "resolves_to")], "src string, dst string, kind string")
    g = PropertyGraph(nodes, edges)
    page = "\n".join(reports.domain_map(g))
    assert "<h2>/a <small>(1)</small></h2>" in page and page.count("GET /u") == 2
    assert "&lt;lib&gt;.ts" in "\n".join(reports.dashboard(g)) and "<td>api</td><td>web</td><td>1</td>" in "\n".join(reports.dashboard(g))
    lines = reports.tour(g, "web")
    assert lines[2:4] == ["## 1. `lib.ts`", "- used by 1"] and lines[5] == "## 2. `page.tsx`"
    reports.write_text(spark, str(tmp_path / "tour.md"), lines)
    assert (tmp_path / "tour.md").read_text().startswith("# Tour of web")
