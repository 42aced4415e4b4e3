"""Queries over the trade graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import evolve, traverse
from graphloom.operators.graph import PropertyGraph
from graphloom.plans.tables import GRAPH_SQL, read, trade_graph


def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return trade_graph(spark, d).stats().select("part", F.coalesce("kind", F.lit("all")).alias("kind"), "n")


def graph_by_repo(spark: SparkSession, d: str) -> DataFrame:
    return trade_graph(spark, d).stats_by_repo()


def graph_merge_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers and customers merged with a renamed copy of the even ones: the first name stays, the last note wins."""
    g = trade_graph(spark, d)
    n = g.nodes.filter(F.col("kind").isin("supplier", "customer")).withColumn("note", F.lit("old"))
    even = F.col("ord") % 2 == 0
    copy = n.filter(even).withColumn("name", F.concat(F.lit("copy "), "name")).withColumn("note", F.when(F.col("ord") % 4 == 0, "new"))
    e = g.edges.filter("kind = 'contains'")
    m = PropertyGraph(n, e).merge(PropertyGraph(copy, e))
    kept = m.edges.groupBy("src").agg(F.count(F.lit(1)).alias("fan"))
    return m.nodes.join(kept, F.col("id") == F.col("src"), "left").select("id", "name", "note", F.coalesce("fan", F.lit(0)).alias("fan"))


def degree_top(spark: SparkSession, d: str) -> DataFrame:
    top = trade_graph(spark, d).top_nodes(50, {"nation": 0, "supplier": 1, "part": 2})
    return top.select("id", "kind", "degree")


def neighbors(spark: SparkSession, d: str) -> DataFrame:
    g = trade_graph(spark, d)
    return g.neighbors(spark.createDataFrame([("s:1",), ("n:3",), ("p:7",)], "id string"))


def repo_pair_weights(spark: SparkSession, d: str) -> DataFrame:
    return trade_graph(spark, d).repo_links()


def impact_bfs(spark: SparkSession, d: str) -> DataFrame:
    g = trade_graph(spark, d)
    return traverse.impact(g.edges, spark.createDataFrame([("s:1",)], "id string"), 3)


def affected_set(spark: SparkSession, d: str) -> DataFrame:
    g = trade_graph(spark, d)
    changed = g.nodes.filter("kind = 'part' and ord % 100 = 7").select("id")
    return traverse.affected(g.nodes, g.edges, changed, kind="order")


def anchor_expand(spark: SparkSession, d: str) -> DataFrame:
    g = trade_graph(spark, d)
    return traverse.expand(g.edges, spark.createDataFrame([("r:1",), ("o:1",)], "id string"), 3, None)


def subgraph_induced(spark: SparkSession, d: str) -> DataFrame:
    """Edges among the nearest 200 nodes around one nation."""
    g = trade_graph(spark, d)
    near = traverse.subgraph(g.edges, spark.createDataFrame([("n:5",)], "id string"), 200, 2)
    return g.induced(near).edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def chain_relations(spark: SparkSession, d: str) -> DataFrame:
    g = trade_graph(spark, d)
    reached = traverse.bfs(g.edges, spark.createDataFrame([("c:1",), ("c:2",)], "id string"), traverse.CHAIN_KINDS, "out", 2)
    rel = traverse.traversed_kinds(g.edges, reached, hops=2)
    return reached.join(rel, "id", "left").select("id", F.col("distance").alias("hop"), F.coalesce(F.array_join("relations", ","), F.lit("")).alias("relations"))


def dangling_orphans(spark: SparkSession, d: str) -> DataFrame:
    g = trade_graph(spark, d, by_order=True)
    broken = PropertyGraph(g.nodes.filter("not (kind = 'part' and ord % 10 = 0)"), g.edges)
    return broken.health(repaired=True)


def _ranked_graph(spark: SparkSession, d: str) -> PropertyGraph:
    g = trade_graph(spark, d)
    nodes = g.nodes.filter(F.col("kind").isin("region", "nation", "supplier", "part"))
    e = g.edges.filter("kind = 'resolves_to'").select("src", "dst", F.lit("calls").alias("kind"))
    back = g.edges.filter("kind = 'contains' and dst not like 'c:%'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("imports").alias("kind"))
    return PropertyGraph(nodes, e.unionAll(back))


def pagerank(spark: SparkSession, d: str) -> DataFrame:
    g = _ranked_graph(spark, d)
    return traverse.pagerank(g.nodes, g.edges, rounds=20).select("id", F.round("rank", 9).alias("rank"))


def centrality(spark: SparkSession, d: str) -> DataFrame:
    g = _ranked_graph(spark, d)
    return traverse.centrality(traverse.pagerank(g.nodes, g.edges, rounds=20)).select("id", F.round("centrality", 7).alias("centrality"))


def reading_levels(spark: SparkSession, d: str) -> DataFrame:
    """Layers of a graph in which parts import suppliers, suppliers nations, nations regions; one region pair forms a cycle."""
    g = _ranked_graph(spark, d)
    loop = spark.createDataFrame([("r:3", "r:4", "imports"), ("r:4", "r:3", "imports")], "src string, dst string, kind string")
    e = g.edges.withColumn("kind", F.lit("imports")).unionAll(loop)
    return traverse.reading_levels(e, g.nodes).select("id", F.coalesce("level", F.lit(-1)).alias("level"))


def overlay_apply(spark: SparkSession, d: str) -> DataFrame:
    """Names of suppliers replaced by hand, one of them for a node that is gone."""
    g = trade_graph(spark, d)
    own = PropertyGraph(g.nodes.filter("kind = 'supplier'"), g.edges.filter("kind = 'contains'"))
    notes = read(spark, d, "supplier").filter("s_suppkey % 5 = 0").select(F.concat(F.lit("s:"), "s_suppkey").alias("id"), F.lit("by hand").alias("name"), F.lit(True).alias("deprecated"))
    notes = notes.unionAll(spark.createDataFrame([("s:gone", "x", False)], notes.schema))
    extra = spark.createDataFrame([("s:1", "s:2", None), ("s:1", "s:none", "calls")], "src string, dst string, kind string")
    out, missing = evolve.apply_overlay(own, notes, extra)
    done = out.nodes.filter("name = 'by hand'").select(F.lit("applied").alias("part"), F.col("id").alias("key"))
    new = out.edges.filter("kind = 'relates_to'").select(F.lit("added").alias("part"), F.concat_ws(" ", "src", "kind", "dst").alias("key"))
    return done.unionAll(new).unionAll(missing)


def incremental_equals_full(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and edges after a refresh of the changed documents, as a rebuild has them."""

    def extract(docs: DataFrame) -> PropertyGraph:
        key = F.concat(F.lit("doc:"), "doc_id")
        nodes = docs.select(key.alias("id"), F.lit("file").alias("kind"), F.md5("text").alias("name"), F.col("lang").alias("repo"), F.col("doc_id").cast("string").alias("path"), F.col("doc_id").alias("ord"))
        return PropertyGraph(nodes, docs.select(key.alias("src"), F.concat(F.lit("source:"), "source").alias("dst"), F.lit("contains").alias("kind")))

    docs = read(spark, d, "documents").select("doc_id", "text", "lang", "source")
    hubs = docs.select(F.concat(F.lit("source:"), "source").alias("id"), F.lit("feature").alias("kind"), F.col("source").alias("name"), F.lit("").alias("repo"), F.lit("").alias("path"), F.lit(0).cast("long").alias("ord")).distinct()
    old = extract(docs.filter("doc_id % 7 <> 3").withColumn("text", F.when(F.col("doc_id") % 11 == 0, "old").otherwise(F.col("text"))))
    old = PropertyGraph(old.nodes.unionByName(hubs), old.edges)
    change = docs.filter("doc_id % 7 = 3 or doc_id % 11 = 0")
    changed = change.select(F.col("lang").alias("repo"), F.col("doc_id").cast("string").alias("path"))
    out = evolve.refresh(old, changed, extract(change))
    n = out.nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("name").alias("names"))
    e = out.edges.groupBy(F.concat(F.lit("edge "), "kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("dst").alias("names"))
    return n.unionAll(e)


def digest_diff(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    have = docs.filter("doc_id % 5 <> 1").select(F.col("doc_id").alias("id"), F.md5(F.when(F.col("doc_id") % 9 == 0, F.lit("old")).otherwise(F.col("text"))).alias("digest"))
    want = docs.filter("doc_id % 5 <> 2").select(F.col("doc_id").alias("id"), F.md5("text").alias("digest"))
    return evolve.digest_plan(have, want)


QUERIES = {
    f.__name__: f
    for f in (
        graph_stats, graph_by_repo, graph_merge_dedup, degree_top, neighbors, repo_pair_weights, impact_bfs, affected_set, anchor_expand,
        subgraph_induced, chain_relations, dangling_orphans, pagerank, centrality, reading_levels, overlay_apply,
        incremental_equals_full, digest_diff,
    )
}


def _bfs_sql(seeds: str, kinds: str, depth: int, src: str = "src", dst: str = "dst") -> str:
    return f"""walk(id, distance) AS (
        SELECT unnest([{seeds}]), 0
        UNION SELECT e.{dst}, w.distance + 1 FROM walk w JOIN edges e ON e.{src} = w.id WHERE w.distance < {depth} AND e.kind IN ({kinds})),
    found AS (SELECT id, min(distance) AS distance FROM walk GROUP BY id)"""


_VIA = """SELECT f.id, f.distance, min(CASE WHEN b.distance = f.distance - 1 THEN e.kind END) AS via
    FROM found f LEFT JOIN edges e ON e.dst = f.id AND e.kind IN ({kinds}) LEFT JOIN found b ON b.id = e.src GROUP BY ALL"""


def _pagerank_sql(rounds: int, last: str) -> str:
    parts = [
        f"WITH {GRAPH_SQL}",
        "v AS MATERIALIZED (SELECT id FROM nodes WHERE kind IN ('region', 'nation', 'supplier', 'part'))",
        "x AS MATERIALIZED (SELECT src, dst FROM edges WHERE kind = 'resolves_to' UNION ALL SELECT dst, src FROM edges WHERE kind = 'contains' AND dst NOT LIKE 'c:%')",
        "fan AS MATERIALIZED (SELECT src, count(*) AS fan FROM x GROUP BY src)",
        "size AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM v)",
        "k0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / n AS rank FROM v, size)",
    ]
    for i in range(rounds):
        parts.append(f"""k{i + 1} AS MATERIALIZED (
            SELECT v.id, (1 - 0.85::DOUBLE) / n + 0.85::DOUBLE * (coalesce(got, 0) + (SELECT coalesce(sum(rank), 0) FROM k{i} WHERE id NOT IN (SELECT src FROM fan)) / n) AS rank
            FROM v CROSS JOIN size LEFT JOIN (
                SELECT x.dst, sum(k.rank / fan.fan) AS got FROM x JOIN k{i} k ON k.id = x.src JOIN fan ON fan.src = x.src GROUP BY x.dst) g ON g.dst = v.id)""")
    return ", ".join(parts).replace("WITH ,", "WITH ") + " " + last.format(k=f"k{rounds}")


ORACLE_SQL = {
    "graph_stats": f"""WITH {GRAPH_SQL}, b AS (SELECT 'node' AS part, kind FROM nodes UNION ALL SELECT 'edge', kind FROM edges)
        SELECT part, coalesce(kind, 'all') AS kind, count(*) AS n FROM b GROUP BY GROUPING SETS ((part, kind), (part))""",
    "graph_by_repo": f"WITH {GRAPH_SQL} SELECT repo, kind, count(*) AS n FROM nodes GROUP BY ALL",
    "graph_merge_dedup": f"""WITH {GRAPH_SQL}
        SELECT id, name, CASE WHEN ord % 4 = 0 THEN 'new' ELSE 'old' END AS note,
               (SELECT count(*) FROM edges e WHERE e.src = n.id AND e.kind = 'contains') AS fan
        FROM nodes n WHERE kind IN ('supplier', 'customer')""",
    "degree_top": f"""WITH {GRAPH_SQL}, ends AS (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges),
        deg AS (SELECT id, count(*) AS degree FROM ends GROUP BY id)
        SELECT id, kind, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN deg USING (id)
        ORDER BY CASE kind WHEN 'nation' THEN 0 WHEN 'supplier' THEN 1 WHEN 'part' THEN 2 ELSE 9 END, coalesce(degree, 0) DESC, id LIMIT 50""",
    "neighbors": f"""WITH {GRAPH_SQL}, a AS (
            SELECT src AS id, 'out' AS direction, dst AS other, kind FROM edges
            UNION ALL SELECT dst, 'in', src, kind FROM edges WHERE src <> dst)
        SELECT * FROM a WHERE id IN ('s:1', 'n:3', 'p:7')""",
    "repo_pair_weights": f"""WITH {GRAPH_SQL}
        SELECT least(a.repo, b.repo) AS a, greatest(a.repo, b.repo) AS b, count(*) AS weight
        FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE a.repo <> b.repo GROUP BY 1, 2""",
    "impact_bfs": f"""WITH RECURSIVE {GRAPH_SQL}, {_bfs_sql("'s:1'", "'imports', 'calls', 'resolves_to', 'contains'", 3, "dst", "src")}
        SELECT id, distance FROM found WHERE distance > 0""",
    "affected_set": f"""WITH RECURSIVE {GRAPH_SQL}, walk(id, distance) AS (
            SELECT id, 0 FROM nodes WHERE kind = 'part' AND ord % 100 = 7
            UNION SELECT e.src, w.distance + 1 FROM walk w JOIN edges e ON e.dst = w.id WHERE w.distance < 4 AND e.kind IN ('imports', 'contains')),
        found AS (SELECT id, min(distance) AS distance FROM walk GROUP BY id)
        SELECT id, distance FROM found WHERE id LIKE 'o:%'""",
    "anchor_expand": f"""WITH RECURSIVE {GRAPH_SQL}, {_bfs_sql("'r:1', 'o:1'", "'contains', 'imports', 'resolves_to'", 3)}
        {_VIA.format(kinds="'contains', 'imports', 'resolves_to'")}""",
    "subgraph_induced": f"""WITH RECURSIVE {GRAPH_SQL}, both_ways AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges),
        walk(id, distance) AS (SELECT 'n:5', 0 UNION SELECT b.dst, w.distance + 1 FROM walk w JOIN both_ways b ON b.src = w.id WHERE w.distance < 2),
        near AS (SELECT id, min(distance) AS d FROM walk GROUP BY id ORDER BY d, id LIMIT 200)
        SELECT kind, count(*) AS n FROM edges WHERE src IN (SELECT id FROM near) AND dst IN (SELECT id FROM near) GROUP BY kind""",
    "chain_relations": f"""WITH RECURSIVE {GRAPH_SQL}, {_bfs_sql("'c:1', 'c:2'", "'imports', 'calls', 'resolves_to', 'contains'", 2)},
        rel AS (SELECT e.dst AS id, string_agg(DISTINCT e.kind, ',' ORDER BY e.kind) AS relations FROM found f JOIN edges e ON e.src = f.id WHERE f.distance < 2 GROUP BY 1)
        SELECT id, distance AS hop, coalesce(relations, '') AS relations FROM found LEFT JOIN rel USING (id)""",
    "dangling_orphans": f"""WITH {GRAPH_SQL}, v AS (SELECT * FROM nodes WHERE NOT (kind = 'part' AND ord % 10 = 0)),
        good AS (SELECT * FROM edges WHERE src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v)),
        touched AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges), held AS (SELECT src AS id FROM good UNION SELECT dst FROM good)
        SELECT 'nodes' AS measure, (SELECT count(*) FROM v) AS n UNION ALL SELECT 'edges', (SELECT count(*) FROM edges)
        UNION ALL SELECT 'dangling', (SELECT count(*) FROM edges) - (SELECT count(*) FROM good)
        UNION ALL SELECT 'orphans', (SELECT count(*) FROM v WHERE id NOT IN (SELECT id FROM touched))
        UNION ALL SELECT 'repaired nodes', (SELECT count(*) FROM v) UNION ALL SELECT 'repaired edges', (SELECT count(*) FROM good)
        UNION ALL SELECT 'repaired dangling', 0 UNION ALL SELECT 'repaired orphans', (SELECT count(*) FROM v WHERE id NOT IN (SELECT id FROM held))""",
    "pagerank": _pagerank_sql(20, "SELECT id, round(rank, 9) AS rank FROM {k}"),
    "centrality": _pagerank_sql(20, "SELECT id, round(ln(1 + rank) / ln(1 + (SELECT max(rank) FROM {k})), 7) AS centrality FROM {k}"),
    "reading_levels": f"""WITH RECURSIVE {GRAPH_SQL}, v AS (SELECT id FROM nodes WHERE kind IN ('region', 'nation', 'supplier', 'part')),
        x AS (SELECT src, dst FROM edges WHERE kind = 'resolves_to' UNION ALL SELECT dst, src FROM edges WHERE kind = 'contains' AND dst NOT LIKE 'c:%'),
        loops(id) AS (SELECT unnest(['r:3', 'r:4']) UNION SELECT x.src FROM loops JOIN x ON x.dst = loops.id),
        deep(id, level) AS (SELECT id, 0 FROM v UNION SELECT x.src, deep.level + 1 FROM deep JOIN x ON x.dst = deep.id)
        SELECT v.id, CASE WHEN v.id IN (SELECT id FROM loops) THEN -1 ELSE (SELECT max(level) FROM deep WHERE deep.id = v.id) END AS level FROM v""",
    "overlay_apply": """SELECT 'applied' AS part, 's:' || s_suppkey AS key FROM supplier WHERE s_suppkey % 5 = 0
        UNION ALL SELECT 'added', 's:1 relates_to s:2' UNION ALL SELECT 'node', 's:gone' UNION ALL SELECT 'edge', 's:1 calls s:none'""",
    "incremental_equals_full": """SELECT 'file' AS kind, count(*) AS n, count(DISTINCT md5(text)) AS names FROM documents
        UNION ALL SELECT 'feature', count(DISTINCT source), count(DISTINCT source) FROM documents
        UNION ALL SELECT 'edge contains', count(*), count(DISTINCT source) FROM documents""",
    "digest_diff": """WITH h AS (SELECT doc_id, md5(CASE WHEN doc_id % 9 = 0 THEN 'old' ELSE text END) AS a FROM documents WHERE doc_id % 5 <> 1),
        w AS (SELECT doc_id, md5(text) AS b FROM documents WHERE doc_id % 5 <> 2)
        SELECT CASE WHEN b IS NULL THEN 'drop' WHEN a = b THEN 'reuse' ELSE 'add' END AS action, count(*) AS n
        FROM h FULL JOIN w USING (doc_id) GROUP BY 1""",
}
