"""Keeping derived tables right under change: overlays, snapshot diffs, refresh and repair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import PropertyGraph


def apply_overlay(graph: PropertyGraph, overrides: DataFrame, edges: DataFrame | None = None) -> tuple[PropertyGraph, DataFrame]:
    """The graph with hand-made notes, and ``(part, key)`` of notes whose nodes are gone.

    ``overrides(id, ...)`` replace the columns they share with the nodes where not null and add
    the others. ``edges(src, dst, kind)`` are added where both ends exist; the kind is
    ``relates_to`` if null.
    """
    shared = [c for c in overrides.columns if c != "id" and c in graph.nodes.columns]
    more = [c for c in overrides.columns if c != "id" and c not in shared]
    n, o = graph.nodes.alias("n"), overrides.alias("o")
    cols = [F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) if c in shared else F.col(f"n.{c}") for c in graph.nodes.columns]
    nodes = n.join(o, F.col("n.id") == F.col("o.id"), "left").select(*cols, *(F.col(f"o.{c}") for c in more))
    ids = graph.nodes.select("id")
    missing = overrides.join(ids, "id", "left_anti").select(F.lit("node").alias("part"), F.col("id").alias("key"))
    out = graph.edges
    if edges is not None:
        e = edges.select("src", "dst", F.coalesce("kind", F.lit("relates_to")).alias("kind"))
        good = e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "kind")
        gone = e.exceptAll(good).select(F.lit("edge").alias("part"), F.concat_ws(" ", "src", "kind", "dst").alias("key"))
        missing = missing.unionAll(gone)
        new = good.join(graph.edges, ["src", "dst", "kind"], "left_anti")
        out = graph.edges.unionByName(new, allowMissingColumns=True)
    return PropertyGraph(nodes, out), missing


def snapshot_diff(old: DataFrame, new: DataFrame, key: Sequence[str] = ("path",), digest: str = "digest") -> DataFrame:
    """``(*key, change)`` between two snapshots: added, removed, changed or same."""
    o = old.select(*key, F.col(digest).alias("_o"))
    n = new.select(*key, F.col(digest).alias("_n"))
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o") == F.col("_n"), "same").otherwise("changed")
    return o.join(n, list(key), "full_outer").select(*key, change.alias("change"))


def digest_plan(have: DataFrame, want: DataFrame) -> DataFrame:
    """``(action, n)``: vectors to reuse, to add or to drop, of ``(id, digest)`` tables."""
    d = snapshot_diff(have, want, ("id",))
    action = F.when(F.col("change") == "same", "reuse").when(F.col("change") == "removed", "drop").otherwise("add")
    return d.groupBy(action.alias("action")).agg(F.count(F.lit(1)).alias("n"))


def refresh(graph: PropertyGraph, changed: DataFrame, extracted: PropertyGraph) -> PropertyGraph:
    """The graph after files changed: nodes of ``changed(repo, path)`` give way to the extracted ones.

    Edges that start in a changed file go, those that lead into one stay if their end is there
    again. Links across files are derived again by the caller, so the outcome equals a rebuild.
    """
    stale = graph.nodes.join(changed.select("repo", "path").distinct(), ["repo", "path"], "left_semi").select("id")
    nodes = graph.nodes.join(stale, "id", "left_anti").select(*graph.nodes.columns)
    edges = graph.edges.join(stale.withColumnRenamed("id", "src"), "src", "left_anti").select(*graph.edges.columns)
    kept = PropertyGraph(nodes, edges)
    merged = PropertyGraph(
        kept.nodes.unionByName(extracted.nodes, allowMissingColumns=True),
        kept.edges.unionByName(extracted.edges, allowMissingColumns=True).dropDuplicates(["src", "dst", "kind"]),
    )
    return merged.repaired()


def append_new(notes: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh notes ``(area, note, ...)`` that are not there yet, by normalised area and note."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    key = [norm(F.col("area")).alias("_a"), norm(F.col("note")).alias("_n")]
    mine = notes.select(*key)
    theirs = fresh.select("*", *key).dropDuplicates(["_a", "_n"])
    return theirs.join(mine, ["_a", "_n"], "left_anti").drop("_a", "_n")


def changed_files(committed: DataFrame, worktree: DataFrame) -> DataFrame:
    """``(path)``: what was committed ``(path)`` and what the working tree holds ``(status, path)``, once each.

    A renamed or copied file counts under its new path, which ``path`` is; slashes are forward.
    """
    both = committed.select("path").unionAll(worktree.filter("path <> ''").select("path"))
    return both.select(F.replace("path", F.lit("\\"), F.lit("/")).alias("path")).distinct()


def relevant(changed: DataFrame, scope: str | None = None) -> DataFrame:
    """The changed paths that sources are read from: known suffixes, inside the scope's folder if there is one."""
    from graphloom.sources.files import SUFFIXES

    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    out = changed.filter(suffix.isin(*SUFFIXES))
    return out.filter(F.startswith("path", F.lit(scope.rstrip("/") + "/"))) if scope else out


def pull_plan(clones: DataFrame) -> DataFrame:
    """``(repo, action, shared)`` of clones ``(ord, repo, root, is_git, fetched, dirty, ahead, behind, forwarded)``.

    Only a clean clone that is merely behind is moved, and only forward; ``forwarded`` says whether
    that worked. ``ahead`` and ``behind`` are null without an upstream. Clones in one folder share
    the outcome of the first.
    """
    action = (
        F.when(~F.col("is_git"), "skipped")
        .when(~F.col("fetched"), "fetch_failed")
        .when(F.col("dirty") | F.col("ahead").isNull() | F.col("behind").isNull(), "fetched_only")
        .when(F.col("behind") == 0, "already_latest")
        .when(F.col("ahead") > 0, "fetched_only")
        .when(F.col("forwarded"), "updated")
        .otherwise("ff_failed")
    )
    root = F.lower("root").alias("root")
    first = clones.groupBy(root).agg(F.min(F.struct("ord", action.alias("action"))).alias("first"))
    return clones.select("ord", "repo", root).join(first, "root").select("repo", F.col("first.action").alias("action"), (F.col("ord") != F.col("first.ord")).alias("shared"))


def sync_all(graph: PropertyGraph, changed: DataFrame, extracted: PropertyGraph, gateway: PropertyGraph | None = None) -> tuple[PropertyGraph, DataFrame]:
    """The graph after a round over all sources, and ``(action, n)`` of what was done.

    Files of ``changed(repo, path)`` give way to what was extracted of them; the routing tables, which
    are small, are replaced as a whole; edges that then lead nowhere are dropped.
    """
    stale = graph.nodes.join(changed.select("repo", "path").distinct(), ["repo", "path"], "left_semi").select("id")
    old = graph.nodes.join(stale, "id", "left_anti").select(*graph.nodes.columns)
    out = PropertyGraph(
        old.unionByName(extracted.nodes, allowMissingColumns=True),
        graph.edges.join(stale.withColumnRenamed("id", "src"), "src", "left_anti").select(*graph.edges.columns).unionByName(extracted.edges, allowMissingColumns=True).dropDuplicates(["src", "dst", "kind"]),
    )
    done = [changed.distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit("changed").alias("action"), "n")]
    if gateway is not None:
        gone = out.nodes.filter("kind = 'gateway_route'").select("id")
        kept = out.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        out = PropertyGraph(
            out.nodes.filter("kind <> 'gateway_route'").unionByName(gateway.nodes, allowMissingColumns=True),
            kept.select(*graph.edges.columns).unionByName(gateway.edges, allowMissingColumns=True),
        )
        done.append(gateway.nodes.agg(F.count(F.lit(1)).alias("n")).select(F.lit("gateway routes").alias("action"), "n"))
    done.append(out.dangling().agg(F.count(F.lit(1)).alias("n")).select(F.lit("dropped").alias("action"), "n"))
    report = done[0]
    for more in done[1:]:
        report = report.unionAll(more)
    return out.repaired(), report
