from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from graphloom.functions import rules
from graphloom.sources import files


def value(spark, column, **row):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in row.items())).select(column.alias("v")).first()[0]


@pytest.mark.parametrize(("path", "infra"), [("k8s/app.yaml", True), ("a/Dockerfile.dev", True), ("src/chart_service.py", False), ("charts/x.yaml", True), ("values-prd.yml", True), ("src/a.py", False)])
def test_infra(spark, path, infra):
    assert value(spark, rules.is_infra(F.col("p")), p=path) is infra


@pytest.mark.parametrize(("name", "issue"), [("feature/ontology-v4", None), ("topic/x", "prefix"), ("fix/", "empty"), ("fix/js", "short"), ("fix/251205", "meaningless"), ("chore/tidy-up", None), ("fix/TEMP", "meaningless"), ("main", "prefix")])
def test_branch_names(spark, name, issue):
    assert value(spark, rules.branch_issue(F.col("n")), n=name) == issue


def test_suggested_branch(spark):
    assert value(spark, rules.suggest_branch("fix/", F.col("k")), k=["Back button", "ontology page", "backbutton", "legacy", "style"]) == "fix/back-button-ontology-page"
    assert value(spark, rules.suggest_branch("fix/", F.col("k")), k=["한글"]) == "fix/change"


def test_verdict(spark):
    v = lambda d, f: tuple(value(spark, rules.verdict(F.col("d"), F.col("f"), F.lit(0.8)), d=d, f=f))
    assert v("x", ["src/a.py"]) == (0.8, None)
    assert v("x", ["infra/a.tf"]) == (0.0, "infra")


def test_node_text_and_summaries(spark):
    n = spark.createDataFrame([("f", "file", "a.py", "r", "a.py", 0, None, " 저장 ", 0), ("g", "function", "go", "r", "a.py", 3, "Runs.", None, 1)], "id string, kind string, name string, repo string, path string, line int, doc string, labels string, ord long")
    e = spark.createDataFrame([("f", "g", "contains")], "src string, dst string, kind string")
    assert [r[0] for r in n.orderBy("id").select(rules.node_text(n)).collect()] == ["file a.py — r/a.py — 저장", "function go — r/a.py — Runs."]
    assert {r.id: r.summary for r in rules.summaries(n, e).collect()} == {"f": "File: functions go", "g": "Runs."}


def test_related_tests(spark):
    t = spark.createDataFrame([("tests/test_foo.py", ""), ("tests/test_x.py", "import pkg.foo"), ("tests/test_y.py", "")], "path string, text string")
    got = rules.related_tests(t, spark.createDataFrame([("pkg/foo.py",)], "path string"))
    assert sorted(r.path for r in got.collect()) == ["tests/test_foo.py", "tests/test_x.py"]
    assert rules.related_tests(t.limit(2), spark.createDataFrame([("pkg/foo.py",)], "path string")).count() == 0


def test_first_json():
    assert json.loads(rules.first_json('so {x} then {"a": "}", "b": {"c": 1}} end {"d": 2}')) == {"a": "}", "b": {"c": 1}}
    assert rules.first_json("none {") is None and rules.first_json(None) is None


def test_next_step(spark):
    step = lambda s, b, j, u, r: value(spark, rules.next_step(F.lit(s), F.lit(b), F.lit(j).cast("boolean"), F.lit(u).cast("string"), F.lit(r), 3))
    assert [step("failed", False, None, None, 1), step("ok", True, None, None, 3), step("ok", False, False, None, 1), step("ok", False, True, None, 1)] == ["retry", "stop", "retry", "stop"]


def test_overlay_file(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps({"node_overrides": {"a": {"note": "n", "deprecated": True}}, "custom_edges": [{"src": "a", "dst": "b"}]}))
    nodes, edges = files.read_overlay(spark, str(tmp_path / "o.json"))
    assert (nodes.first().id, nodes.first().deprecated) == ("a", True) and edges.first().dst == "b"
