"""Bounded breadth-first expansion, its uses, PageRank and reading order.

One generic search serves all uses. A level joins the frontier with the edges, drops what
was seen and is written as a scratch table, so a plan never grows with the depth.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.scratch import cut

# Edge kinds that each use follows.
IMPACT_KINDS = ("imports", "calls", "resolves_to", "route_of", "contains", "same_package")
CHAIN_KINDS = ("imports", "calls", "resolves_to", "route_of", "contains")
ANCHOR_KINDS = ("route_of", "contains", "imports", "same_package", "resolves_to", "routes_via")
TEST_KINDS = ("imports", "contains", "same_package")


def steps(edges: DataFrame, kinds: Sequence[str] | None, direction: str) -> DataFrame:
    """``(src, dst, kind)`` along which a search moves: ``out``, ``in`` or ``both``."""
    e = edges.filter(F.col("kind").isin(*kinds)) if kinds else edges
    out = e.select("src", "dst", "kind")
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind")
    return {"out": out, "in": back, "both": out.unionAll(back)}[direction]


def bfs(
    edges: DataFrame, seeds: DataFrame, kinds: Sequence[str] | None = None, direction: str = "out", depth: int = 3
) -> DataFrame:
    """``(id, distance, via)`` of all nodes within ``depth`` steps of ``seeds(id)``, seeds at 0.

    ``via`` is the smallest kind of an edge that first reached the node.
    """
    e = cut(steps(edges, kinds, direction).distinct(), "bfs-edges")
    level = cut(seeds.select("id").distinct().select("id", F.lit(0).alias("distance"), F.lit(None).cast("string").alias("via")), "bfs0")
    seen = level
    for d in range(1, depth + 1):
        ahead = e.join(level.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("kind").alias("via"))
        fresh = ahead.join(seen.select("id"), "id", "left_anti").select("id", F.lit(d).alias("distance"), "via")
        level = cut(fresh, f"bfs{d}")
        if level.isEmpty():
            break
        seen = seen.unionAll(level)
    return seen


def impact(edges: DataFrame, seeds: DataFrame, depth: int = 3, kinds: Sequence[str] = IMPACT_KINDS) -> DataFrame:
    """``(id, distance)`` of what depends on the seeds, seeds excluded."""
    return bfs(edges, seeds, kinds, "in", depth).filter("distance > 0").select("id", "distance")


def expand(edges: DataFrame, anchors: DataFrame, hops: int = 5, limit: int | None = 120) -> DataFrame:
    """``(id, distance, via)`` forward of the anchors; truncated by (distance, id)."""
    out = bfs(edges, anchors, ANCHOR_KINDS, "out", hops)
    return out.orderBy("distance", "id").limit(limit) if limit else out


def subgraph(edges: DataFrame, seeds: DataFrame, most: int, depth: int = 4) -> DataFrame:
    """The nearest ``most`` nodes (20 to 700) around the seeds, whatever the direction."""
    most = max(20, min(700, most))
    return bfs(edges, seeds, None, "both", depth).orderBy("distance", "id").limit(most)


def affected(nodes: DataFrame, edges: DataFrame, changed: DataFrame, kind: str = "file", hops: int = 4) -> DataFrame:
    """Nodes of a kind that reach the changed ones by imports, membership or package, the changed included."""
    return bfs(edges, changed, TEST_KINDS, "in", hops).join(nodes.filter(F.col("kind") == kind).select("id"), "id", "left_semi").select("id", "distance")


def traversed_kinds(edges: DataFrame, reached: DataFrame, kinds: Sequence[str] = CHAIN_KINDS, hops: int = 2) -> DataFrame:
    """``(id, relations)``: kinds of all edges that the search walked into a node."""
    e = steps(edges, kinds, "out")
    inside = reached.filter(F.col("distance") < hops).select(F.col("id").alias("src"))
    return e.join(inside, "src").groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set("kind")).alias("relations"))


def trace_flow(nodes: DataFrame, edges: DataFrame, routes: DataFrame, depth: int = 3) -> DataFrame:
    """``(route, part, id)`` of each of ``routes(id)``: the files and features it leads over, its API calls and their endpoints.

    A route leads to its page files (``route_of``); they are at no depth. From there it follows
    ``imports`` into any known node and ``contains`` into files and calls only. Files and features
    count when they are walked on from, so those first reached in the last of ``depth`` rounds do
    not; a call is not walked on from, and only calls lead to endpoints (``resolves_to``).
    """
    kinds = cut(nodes.select("id", "kind"), "flow-kinds")
    ends = kinds.select(F.col("id").alias("dst"), F.col("kind").alias("to"))
    e = edges.filter(F.col("kind").isin("imports", "contains")).join(ends, "dst")
    e = cut(e.filter((F.col("kind") == "imports") | F.col("to").isin("file", "api_call")).select("src", "dst", "to").distinct(), "flow-edges")
    start = edges.filter("kind = 'route_of'").join(routes.select(F.col("id").alias("src")).distinct(), "src")
    level = cut(start.select(F.col("src").alias("route"), F.col("dst").alias("id")).distinct(), "flow0")
    seen, parts = level, []
    for d in range(1, depth + 1):
        known = level.join(kinds, "id")
        parts.append(known.filter(F.col("kind").isin("file", "feature")).select("route", F.concat("kind", F.lit("s")).alias("part"), "id"))
        ahead = known.select("route", F.col("id").alias("src")).join(e, "src").select("route", F.col("dst").alias("id"), "to").distinct()
        fresh = cut(ahead.join(seen, ["route", "id"], "left_anti"), f"flow{d}")
        calls = fresh.filter("to = 'api_call'").select("route", "id")
        reached = edges.filter("kind = 'resolves_to'").select(F.col("src").alias("id"), "dst")
        parts += [calls.select("route", F.lit("api_calls").alias("part"), "id"), calls.join(reached, "id").select("route", F.lit("endpoints").alias("part"), F.col("dst").alias("id"))]
        level = fresh.filter("to <> 'api_call'").select("route", "id")
        if fresh.isEmpty():
            break
        seen = seen.unionAll(fresh.select("route", "id"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out.distinct()


def affected_routes(nodes: DataFrame, edges: DataFrame, changed: DataFrame, most: int = 3, hops: int = 4) -> DataFrame:
    """``(id, name)`` of the first ``most`` routes, as they were written, with a page that reaches a changed node."""
    reached = bfs(edges, changed, TEST_KINDS, "in", hops).select(F.col("id").alias("dst"))
    pages = edges.filter("kind = 'route_of'").join(reached, "dst", "left_semi").select(F.col("src").alias("id"))
    return nodes.filter("kind = 'route'").join(pages, "id", "left_semi").orderBy("ord", "id").limit(most).select("id", "name")


def hub_seeds(nodes: DataFrame, edges: DataFrame, most: int = 14) -> DataFrame:
    """The known ones of the ``most`` nodes with the most edge ends: where an overview begins."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return ends.orderBy(F.desc("degree"), "id").limit(most).join(nodes.select("id"), "id", "left_semi").select("id")


def retrieve_chain(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, k: int = 6, hops: int = 2, weight: float = 0.5) -> DataFrame:
    """``(query_id, rank, id, rrf, relations, hop)``: hits ``seeds(query_id, rank, id)`` with what they lead to.

    The first ``k`` hits of a query are walked from over ``CHAIN_KINDS``. What an edge of the walk
    leads to is ranked by its least number of steps, then id; a hit that another hit leads to is
    ranked too. A node's score is 1 / (60 + place) among the hits plus ``weight`` / (60 + place)
    along the walk, places from 0. Of the known nodes the first 4 ``k`` stay, ties by id. A node that
    no edge led to has the relation ``seed`` and hop 0.
    """
    s = cut(seeds.filter(F.col("rank") <= k).select("query_id", "id", (F.col("rank") - 1).alias("place")), "chain-seeds")
    e = cut(steps(edges, CHAIN_KINDS, "out").distinct(), "chain-edges")
    level = s.select("query_id", "id").distinct()
    seen, walked = level, None
    for d in range(1, hops + 1):
        step = level.withColumnRenamed("id", "src").join(e, "src").select("query_id", F.col("dst").alias("id"), "kind").distinct()
        step = cut(step.withColumn("hop", F.lit(d)), f"chain{d}")
        walked = step if walked is None else walked.unionAll(step)
        level = cut(step.select("query_id", "id").distinct().join(seen, ["query_id", "id"], "left_anti"), f"chain-level{d}")
        if level.isEmpty():
            break
        seen = seen.unionAll(level)
    by_query = Window.partitionBy("query_id")
    reached = walked.groupBy("query_id", "id").agg(F.min("hop").alias("hop"), F.array_sort(F.collect_set("kind")).alias("relations"))
    reached = reached.withColumn("step", F.row_number().over(by_query.orderBy("hop", "id")) - 1)
    both = reached.join(s, ["query_id", "id"], "full_outer").join(nodes.select("id"), "id", "left_semi")
    score = F.coalesce(1 / (60 + F.col("place")), F.lit(0.0)) + F.coalesce(F.lit(weight) / (60 + F.col("step")), F.lit(0.0))
    ranked = both.withColumn("score", F.round(score, 12)).withColumn("rank", F.row_number().over(by_query.orderBy(F.desc("score"), "id")))
    return ranked.filter(F.col("rank") <= 4 * k).select(
        "query_id", "rank", "id", F.round("score", 5).alias("rrf"), F.coalesce("relations", F.array(F.lit("seed"))).alias("relations"), F.coalesce("hop", F.lit(0)).alias("hop")
    )


def domain_of(path: Column) -> Column:
    """The first segment of a route: ``root`` if there is none, ``dynamic`` for a parameter or group."""
    head = F.get(F.filter(F.split(path, "/"), lambda s: s != ""), F.lit(0))
    return F.when(head.isNull(), "root").when(head.startswith("[") | head.startswith("("), "dynamic").otherwise(head)


def pagerank(
    nodes: DataFrame, edges: DataFrame, kinds: Sequence[str] = ("calls", "imports"), damping: float = 0.85, rounds: int = 20
) -> DataFrame:
    """``(id, rank)`` after a fixed number of rounds.

    Uniform start; the mass of nodes without outgoing edges is spread evenly each round;
    parallel edges of different kinds count separately.
    """
    ids = cut(nodes.select("id").distinct(), "pagerank-ids")
    n = ids.count()
    if n == 0:
        return ids.withColumn("rank", F.lit(0.0))
    e = edges.filter(F.col("kind").isin(*kinds)).select("src", "dst")
    e = e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    share = e.groupBy("src").agg(F.count(F.lit(1)).alias("fan"))
    # dealt by source once; a round then shuffles one partial sum per task and node
    e = cut(e.join(share, "src").select("src", "dst", "fan"), "pagerank-edges").repartition("src").persist()
    # a rank is base + damping * what came in; the ranks add up to 1, so what sinks hold is 1 less all that was sent
    base, got, held = 1.0 / n, None, []
    for i in range(rounds):
        if got is None:
            rank = F.lit(base)
            sent = e
        else:
            rank = F.lit(base) + damping * F.coalesce("got", F.lit(0.0))
            sent = e.join(got.withColumnRenamed("id", "src"), "src", "left")
        new = sent.groupBy(F.col("dst").alias("id")).agg(F.sum(rank / F.col("fan")).alias("got"))
        # a table now and then keeps the lineage of what is cached short
        new = cut(new, f"pagerank{i + 1}") if i % 5 == 4 or i == rounds - 1 else new.persist()
        held.append(new)
        base = (1 - damping) / n + damping * (1 - (new.agg(F.sum("got")).first()[0] or 0.0)) / n
        got = new
        if i % 5 == 4:
            for old in held[:-1]:
                old.unpersist()
            held = held[-1:]
    for old in [e, *held]:
        old.unpersist()
    if got is None:
        return ids.withColumn("rank", F.lit(base))
    return ids.join(got, "id", "left").select("id", (F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))


def centrality(ranks: DataFrame) -> DataFrame:
    """``(id, centrality)``: ln(1 + rank) over its largest value, 0 if that is not positive."""
    top = ranks.agg(F.max("rank").alias("top"))
    value = F.when(F.col("top") > 0, F.log1p("rank") / F.log1p("top")).otherwise(0.0)
    return ranks.crossJoin(F.broadcast(top)).select("id", value.alias("centrality"))


def reading_levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(id, level)`` by layered topological order over ``imports``: what imports nothing comes first.

    A node's level is the longest chain of imports below it, however long. Nodes on or above a
    cycle have no level (null). One round a level; only edges between open nodes go on.
    """
    e = cut(edges.filter(F.col("kind") == "imports").select("src", "dst").distinct(), "levels-edges")
    left = cut(nodes.select("id").distinct(), "levels")
    e = cut(e.join(left.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"), "levels-edges")
    done, level = None, 0
    while True:
        ready = cut(left.join(e.select(F.col("src").alias("id")), "id", "left_anti").withColumn("level", F.lit(level)), "levels-ready")
        if ready.isEmpty():
            break
        done = ready if done is None else done.unionAll(ready)
        if level % 20 == 19:  # a plan of few parts however many levels
            done = cut(done, "levels-done")
        left = cut(left.join(ready.select("id"), "id", "left_anti"), "levels-left")
        e = cut(e.join(ready.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"), "levels-edges")
        level += 1
    rest = left.withColumn("level", F.lit(None).cast("int"))
    return rest if done is None else done.unionAll(rest)


def reading_order(nodes: DataFrame, edges: DataFrame, limit: int = 30) -> list[str]:
    """The order in which to read one repository's files, at most ``limit``: the most connected, foundations first.

    An exact first-in-first-out order needs one place; the file imports of one repository
    (thousands of rows) are gathered on the driver for it.
    """
    files = sorted(r[0] for r in nodes.filter(F.col("kind") == "file").select("id").collect())
    needs: dict[str, set[str]] = {f: set() for f in files}
    users: dict[str, set[str]] = {f: set() for f in files}
    inside = edges.filter("kind = 'imports' and src <> dst").select("src", "dst")
    own = nodes.filter(F.col("kind") == "file").select("id")
    inside = inside.join(own.withColumnRenamed("id", "src"), "src", "left_semi").join(own.withColumnRenamed("id", "dst"), "dst", "left_semi")
    for src, dst in inside.select("src", "dst").distinct().collect():
        needs[src].add(dst)
        users[dst].add(src)
    weight = {f: len(needs[f]) + len(users[f]) for f in files}
    order: list[str] = []
    ready = sorted((f for f in files if not needs[f]), key=lambda f: (-len(users[f]), f))
    open_needs = {f: set(v) for f, v in needs.items()}
    while ready:
        now = ready.pop(0)
        order.append(now)
        freed = []
        for u in sorted(users[now], key=lambda f: (-weight[f], f)):
            open_needs[u].discard(now)
            if not open_needs[u]:
                freed.append(u)
        ready += freed
    placed = set(order)
    order += sorted((f for f in files if f not in placed), key=lambda f: (-weight[f], f))
    top = set(sorted(files, key=lambda f: (-weight[f], f))[:limit])
    return [f for f in order if f in top]
