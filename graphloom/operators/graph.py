"""A directed labelled property graph as two DataFrames.

Nodes: ``id, kind, name, repo, path, line, ord`` and any further columns as meta.
Edges: ``src, dst, kind, ord`` and any further columns. ``ord`` is the order of insertion;
it decides which of two writes of a key came first.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALARS = ("kind", "name", "repo", "path", "line")


def dedup_nodes(nodes: DataFrame) -> DataFrame:
    """One row per id: the first write decides the scalar columns, the last non-null one each meta column."""
    meta = [c for c in nodes.columns if c not in ("id", "ord", *SCALARS)]
    first = [F.min_by(c, "ord").alias(c) for c in SCALARS if c in nodes.columns]
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c) for c in meta]
    return nodes.groupBy("id").agg(*first, *last, F.min("ord").alias("ord")).select(*nodes.columns)


def dedup_edges(edges: DataFrame) -> DataFrame:
    """One row per (src, dst, kind): the first write, with all its columns."""
    rest = [c for c in edges.columns if c not in ("src", "dst", "kind")]
    first = F.min_by(F.struct(*rest), "ord").alias("r")
    return edges.groupBy("src", "dst", "kind").agg(first).select("src", "dst", "kind", *(F.col(f"r.{c}") for c in rest)).select(*edges.columns)


@dataclass(frozen=True)
class PropertyGraph:
    """An immutable graph; every operation returns new DataFrames."""

    nodes: DataFrame
    edges: DataFrame

    def dedup(self) -> PropertyGraph:
        return PropertyGraph(dedup_nodes(self.nodes), dedup_edges(self.edges))

    def merge(self, other: PropertyGraph) -> PropertyGraph:
        """This graph, then the other written over it, under the same rules of precedence."""

        def after(mine: DataFrame, theirs: DataFrame) -> DataFrame:
            shift = mine.agg((F.coalesce(F.max("ord"), F.lit(-1)) + 1).alias("_shift"))
            moved = theirs.crossJoin(F.broadcast(shift)).withColumn("ord", F.col("ord") + F.col("_shift")).drop("_shift")
            return mine.unionByName(moved, allowMissingColumns=True)

        return PropertyGraph(after(self.nodes, other.nodes), after(self.edges, other.edges)).dedup()

    def nodes_by_kind(self, *kinds: str) -> DataFrame:
        return self.nodes.filter(F.col("kind").isin(*kinds))

    def stats(self) -> DataFrame:
        """``(part, kind, n)``: nodes and edges by kind, and in total (null kind)."""
        both = self.nodes.select(F.lit("node").alias("part"), "kind").unionAll(self.edges.select(F.lit("edge").alias("part"), "kind"))
        return both.rollup("part", "kind").agg(F.count(F.lit(1)).alias("n")).filter("part is not null")

    def stats_by_repo(self) -> DataFrame:
        return self.nodes.groupBy("repo", "kind").agg(F.count(F.lit(1)).alias("n"))

    def degree(self) -> DataFrame:
        """``(id, degree)``: ends of edges, a self-loop counting twice; nodes without edges are absent."""
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("id"))
        return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))

    def top_nodes(self, n: int, priority: dict[str, int] | None = None) -> DataFrame:
        """The n first nodes by priority of their kind (9 by default), then degree, then id."""
        rank = kind_priority(priority or {})
        d = self.nodes.join(self.degree(), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
        return d.withColumn("priority", rank).orderBy("priority", F.desc("degree"), "id").limit(n)

    def neighbors(self, ids: DataFrame) -> DataFrame:
        """``(id, direction, other, kind)`` for each id of ``ids``; a self-loop goes out only."""
        out = self.edges.select(F.col("src").alias("id"), F.lit("out").alias("direction"), F.col("dst").alias("other"), "kind")
        back = self.edges.filter("src <> dst").select(F.col("dst").alias("id"), F.lit("in").alias("direction"), F.col("src").alias("other"), "kind")
        return out.unionAll(back).join(ids.select("id").distinct(), "id")

    def dangling(self) -> DataFrame:
        """Edges with an end that is no node."""
        ids = self.nodes.select("id")
        ends = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").unionByName(
            self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
        )
        return ends.select(*self.edges.columns)

    def repaired(self) -> PropertyGraph:
        return self.induced(self.nodes)

    def induced(self, nodes: DataFrame) -> PropertyGraph:
        """The nodes and the edges with both ends among them."""
        ids = nodes.select("id")
        e = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
        e = e.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return PropertyGraph(nodes, e.select(*self.edges.columns))

    def orphans(self) -> DataFrame:
        """Nodes that no edge touches."""
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("id"))
        return self.nodes.join(ends, "id", "left_anti")

    def repo_links(self) -> DataFrame:
        """``(a, b, weight)``: edges between two repositories, undirected, a < b."""
        of = self.nodes.select("id", "repo")
        e = self.edges.join(of.withColumnsRenamed({"id": "src", "repo": "ra"}), "src")
        e = e.join(of.withColumnsRenamed({"id": "dst", "repo": "rb"}), "dst").filter("ra <> rb")
        return e.groupBy(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).agg(F.count(F.lit(1)).alias("weight"))

    def health(self, repaired: bool = False) -> DataFrame:
        """``(measure, n)``: nodes, edges, dangling edges and orphan nodes; with ``repaired`` also those of the repaired graph.

        Nodes and ends of edges are counted by id in one shuffle. Its ids that are no nodes tell the dangling edges, and a
        node is an orphan after the repair if all its ends are ends of dangling edges; none of those is left then. Of the edges
        only those that may dangle are shuffled.
        """
        node, end = (F.lit(1).cast("long"), F.lit(0).cast("long")), (F.lit(0).cast("long"), F.lit(1).cast("long"))
        of = self.nodes.select("id", node[0].alias("nodes"), node[1].alias("ends")).unionAll(_ends(self.edges).select("id", *end))
        of = of.groupBy("id").agg(F.sum("nodes").alias("nodes"), F.sum("ends").alias("ends"))
        # both sums are asked for, and the id depends on one, lest columns be pruned or filters pushed down: the shuffle of ``of`` is used again
        gone = of.filter("nodes = 0 and ends > 0").select(F.when(F.col("ends") > 0, F.col("id")).alias("id"))
        lost = _ends(edges_at(self.edges, gone)).groupBy("id").agg(F.count(F.lit(1)).alias("lost"))
        kept = F.col("ends") - F.coalesce("lost", F.lit(0))
        total = lambda c, when=F.lit(True): F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
        half = lambda c: F.call_function("div", total(c), F.lit(2))
        null = F.col("id").isNull()  # a null id is the end of no edge
        n = of.join(lost, "id", "full").agg(total("nodes").alias("nodes"), half("ends").alias("edges"), half("lost").alias("dangling"),
            total("nodes", null | (F.col("ends") == 0)).alias("orphans"), total("nodes", null | (kept == 0)).alias("left"))
        parts = {"nodes": "nodes", "edges": "edges", "dangling": "dangling", "orphans": "orphans"}
        if repaired:
            parts |= {"repaired nodes": "nodes", "repaired edges": "edges - dangling", "repaired dangling": "0L", "repaired orphans": "left"}
        return n.select(F.inline(F.array(*(F.struct(F.lit(k).alias("measure"), F.expr(v).alias("n")) for k, v in parts.items()))))


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id"))


#: Words of 64 bits in the bitmap of ``edges_at``.
BITMAP_WORDS = 1 << 20


def edges_at(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """``(src, dst)`` of the edges with an end that is null or among ``ids``, each of which stands there once.

    A bitmap of hashes of the ids, of bounded size at any number of them, is broadcast; edges without an end in it are
    left out where they are, the others are shuffled and looked up in the ids themselves.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(64 * BITMAP_WORDS))
    word, place = lambda c: F.shiftright(bit(c), 6), lambda c: (bit(c) % 64).cast("int")
    bitmap = ids.groupBy(word("id").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place("id"))).alias("bits"))
    e, null = edges.select("src", "dst"), F.col("src").isNull() | F.col("dst").isNull()
    for end in ("src", "dst"):
        m = bitmap.withColumnsRenamed({"word": f"{end}_word", "bits": f"{end}_bits"})
        e = e.join(F.broadcast(m), word(end) == F.col(f"{end}_word"), "left")
    marked = [F.coalesce(F.getbit(f"{end}_bits", place(end)) == 1, F.lit(False)) for end in ("src", "dst")]
    e = e.filter(null | marked[0] | marked[1]).select("src", "dst")
    for end in ("src", "dst"):
        e = e.join(ids.select(F.col("id").alias(end), F.lit(True).alias(f"{end}_in")), end, "left")
    return e.filter(null | F.col("src_in") | F.col("dst_in")).select("src", "dst")


def kind_priority(priority: dict[str, int], kind: str = "kind") -> Column:
    rank = F.lit(9)
    for k, v in priority.items():
        rank = F.when(F.col(kind) == k, v).otherwise(rank)
    return rank


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    frames = list(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
