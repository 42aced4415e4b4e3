"""Reports for people: a dashboard, a map of domains with what their routes lead to, a guided tour, failures.

What a report lists is bounded by its limits, so its lines are gathered on the driver and written
as one file of any store that Spark writes to.
"""

from __future__ import annotations

import html
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.graph import PropertyGraph
from graphloom.operators.traverse import domain_of, reading_order, trace_flow
from graphloom.plans.scratch import cut
from graphloom.sources.files import _hadoop

# Kinds in the order in which a dashboard lists them, and how many of each part of a flow a map shows.
DASHBOARD_KINDS = {
    "repo": 0, "deploy_project": 0, "helm_app": 1, "helm_chart": 1, "route": 1, "endpoint": 2, "api_call": 3, "file": 4, "class": 5, "function": 6, "feature": 4,
}
FLOW_LIMITS = {"features": 8, "api_calls": 10, "endpoints": 10}


def write_text(spark: SparkSession, path: str, lines: list[str]) -> None:
    fs, at = _hadoop(spark, path)
    out = fs.create(at, True)
    out.write(bytearray("\n".join(lines).encode()))
    out.close()


def _esc(value: object) -> str:
    return html.escape("" if value is None else str(value))


def _page(title: str, body: list[str]) -> list[str]:
    return ["<!DOCTYPE html><html><head><meta charset='utf-8'>", f"<title>{_esc(title)}</title></head><body>", f"<h1>{_esc(title)}</h1>", *body, "</body></html>"]


def dashboard(graph: PropertyGraph, title: str = "Graph", most: int = 1200) -> list[str]:
    """Counts by kind, edges between repositories, the first ``most`` nodes by kind and degree and the edges among them, as a page."""
    counts = graph.stats().filter("kind is not null").orderBy("part", F.desc("n"), "kind").collect()
    links = graph.repo_links().orderBy(F.desc("weight"), "a", "b").limit(most).collect()
    shown = cut(graph.top_nodes(most, DASHBOARD_KINDS), "dashboard")
    nodes = shown.orderBy("priority", F.desc("degree"), "id").collect()
    edges = graph.induced(shown).edges.orderBy("src", "dst", "kind").collect()
    body = ["<table>", *(f"<tr><td>{_esc(r['part'])}</td><td>{_esc(r['kind'])}</td><td>{r['n']}</td></tr>" for r in counts), "</table>"]
    body += ["<h2>Links</h2><table>", *(f"<tr><td>{_esc(r['a'])}</td><td>{_esc(r['b'])}</td><td>{r['weight']}</td></tr>" for r in links), "</table>"]
    body += ["<h2>Nodes</h2><table>"]
    body += [f"<tr><td>{_esc(r['kind'])}</td><td>{_esc(r['name'])}</td><td>{_esc(r['repo'])}</td><td>{_esc(r['path'])}</td><td>{r['degree']}</td></tr>" for r in nodes]
    body += ["</table>", "<h2>Edges</h2><table>", *(f"<tr><td>{_esc(e['src'])}</td><td>{_esc(e['kind'])}</td><td>{_esc(e['dst'])}</td></tr>" for e in edges)]
    return _page(title, [*body, "</table>"])


def domain_map(graph: PropertyGraph, title: str = "Domains", depth: int = 3, most: int = 2000) -> list[str]:
    """Domains by name, the routes of each by name (at most ``most`` in all), and under each what it leads to, as a page."""
    routes = graph.nodes.filter("kind = 'route'").select("id", "name", domain_of(F.col("name")).alias("domain")).orderBy("domain", "name", "id").limit(most)
    flow = trace_flow(graph.nodes, graph.edges, routes, depth).filter(F.col("part").isin(*FLOW_LIMITS))
    named = flow.join(graph.nodes.select("id", "name", "repo"), "id").select("route", "part", "id", "name", "repo")
    place = F.struct("part", "id", "name", "repo")
    parts = named.groupBy("route", "part").agg(F.slice(F.array_sort(F.collect_list(place)), 1, max(FLOW_LIMITS.values())).alias("l"))
    found: dict = defaultdict(dict)
    for r in parts.collect():
        found[r["route"]][r["part"]] = r["l"][: FLOW_LIMITS[r["part"]]]
    by_domain: dict = defaultdict(list)
    for r in routes.collect():
        by_domain[r["domain"]].append(r)
    body = []
    for domain, rs in by_domain.items():
        body.append(f"<h2>/{_esc(domain)} <small>({len(rs)})</small></h2>")
        for r in rs:
            body.append(f"<div class='route'><b>{_esc(r['name'])}</b>")
            body += [f"<div class='{part}'>{_esc(x['name'])} <small>{_esc(x['repo'])}</small></div>" for part in FLOW_LIMITS for x in found[r["id"]].get(part, [])]
            body.append("</div>")
    return _page(title, body)


def tour(graph: PropertyGraph, repo: str, limit: int = 30) -> list[str]:
    """A repository's files in the order in which to read them, as Markdown."""
    files = graph.nodes.filter((F.col("kind") == "file") & (F.col("repo") == repo))
    order = reading_order(files, graph.edges, limit)
    users = graph.edges.filter((F.col("kind") == "imports") & F.col("dst").isin(*order)) if order else graph.edges.limit(0)
    users = users.join(files.select(F.col("id").alias("src")), "src", "left_semi").groupBy("dst").agg(F.count_distinct("src").alias("n"))
    known = {r["id"]: r for r in files.filter(F.col("id").isin(*order)).collect()} if order else {}
    count = {r["dst"]: r["n"] for r in users.collect()}
    lines = [f"# Tour of {repo}", ""]
    for i, f in enumerate(order, 1):
        lines += [f"## {i}. `{known[f]['path']}`", f"- used by {count.get(f, 0)}", ""]
    return lines


def write_failures(failures: DataFrame, path: str) -> None:
    """Failures as lines of JSON."""
    failures.write.mode("overwrite").json(path)
