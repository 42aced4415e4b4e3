"""The driver's tables, and a typed property graph over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.graph import PropertyGraph, union_all


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _node(df: DataFrame, prefix: str, key: str, kind: str, name: str, repo: str, base: int) -> DataFrame:
    return df.select(
        F.concat(F.lit(prefix), key).alias("id"),
        F.lit(kind).alias("kind"),
        F.col(name).cast("string").alias("name"),
        F.concat(F.lit(repo.split("|")[0]), F.col(repo.split("|")[1]).cast("string") if "|" in repo else F.lit("")).alias("repo"),
        F.lit(f"{kind}s").alias("path"),
        F.lit(0).alias("line"),
        (F.lit(base).cast("long") + F.col(key)).alias("ord"),
    )


def _edge(df: DataFrame, a: str, b: str, kind: str, base: int) -> DataFrame:
    (pa, ka), (pb, kb) = a.split(":"), b.split(":")
    return df.select(
        F.concat(F.lit(f"{pa}:"), ka).alias("src"), F.concat(F.lit(f"{pb}:"), kb).alias("dst"), F.lit(kind).alias("kind"), F.lit(base).cast("long").alias("ord")
    )


def trade_graph(spark: SparkSession, sf_dir: str, by_order: bool = False) -> PropertyGraph:
    """Regions contain nations, nations contain customers and suppliers, customers call orders, orders import parts,
    parts resolve to suppliers. ``by_order``: an order's imports lie in one task, so counts by order are small before a shuffle."""
    t = lambda n: read(spark, sf_dir, n)
    nodes = union_all(
        [
            _node(t("region"), "r:", "r_regionkey", "region", "r_name", "world", 0),
            _node(t("nation"), "n:", "n_nationkey", "nation", "n_name", "region|n_regionkey", 1_000),
            _node(t("supplier"), "s:", "s_suppkey", "supplier", "s_name", "nation|s_nationkey", 1_000_000),
            _node(t("customer"), "c:", "c_custkey", "customer", "c_name", "nation|c_nationkey", 100_000_000),
            _node(t("part"), "p:", "p_partkey", "part", "p_name", "brand|p_brand", 10_000_000_000),
            _node(t("orders"), "o:", "o_orderkey", "order", "o_orderstatus", "orders", 1_000_000_000_000),
        ]
    )
    items = t("lineitem")
    imports = items.select("l_orderkey", "l_partkey")
    imports = (imports.repartition("l_orderkey") if by_order else imports).distinct()
    edges = union_all(
        [
            _edge(t("nation"), "r:n_regionkey", "n:n_nationkey", "contains", 1),
            _edge(t("supplier"), "n:s_nationkey", "s:s_suppkey", "contains", 2),
            _edge(t("customer"), "n:c_nationkey", "c:c_custkey", "contains", 3),
            _edge(t("orders"), "c:o_custkey", "o:o_orderkey", "calls", 4),
            _edge(imports, "o:l_orderkey", "p:l_partkey", "imports", 5),
            _edge(items.select("l_partkey", "l_suppkey").distinct(), "p:l_partkey", "s:l_suppkey", "resolves_to", 6),
        ]
    )
    return PropertyGraph(nodes, edges)


#: The same graph in SQL.
GRAPH_SQL = """
nodes AS (
    SELECT 'r:' || r_regionkey AS id, 'region' AS kind, r_name AS name, 'world' AS repo, r_regionkey::BIGINT AS ord FROM region
    UNION ALL SELECT 'n:' || n_nationkey, 'nation', n_name, 'region' || n_regionkey, 1000 + n_nationkey FROM nation
    UNION ALL SELECT 's:' || s_suppkey, 'supplier', s_name, 'nation' || s_nationkey, 1000000 + s_suppkey FROM supplier
    UNION ALL SELECT 'c:' || c_custkey, 'customer', c_name, 'nation' || c_nationkey, 100000000 + c_custkey FROM customer
    UNION ALL SELECT 'p:' || p_partkey, 'part', p_name, 'brand' || p_brand, 10000000000 + p_partkey FROM part
    UNION ALL SELECT 'o:' || o_orderkey, 'order', o_orderstatus, 'orders', 1000000000000 + o_orderkey FROM orders),
edges AS (
    SELECT 'r:' || n_regionkey AS src, 'n:' || n_nationkey AS dst, 'contains' AS kind FROM nation
    UNION ALL SELECT 'n:' || s_nationkey, 's:' || s_suppkey, 'contains' FROM supplier
    UNION ALL SELECT 'n:' || c_nationkey, 'c:' || c_custkey, 'contains' FROM customer
    UNION ALL SELECT 'c:' || o_custkey, 'o:' || o_orderkey, 'calls' FROM orders
    UNION ALL SELECT DISTINCT 'o:' || l_orderkey, 'p:' || l_partkey, 'imports' FROM lineitem
    UNION ALL SELECT DISTINCT 'p:' || l_partkey, 's:' || l_suppkey, 'resolves_to' FROM lineitem)"""

#: Tokens of a text in SQL; ``{x}`` is the text.
TOKENS_SQL = (
    "(list_filter(string_split_regex(lower(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^0-9a-z가-힣]+'), lambda w: w <> '') || "
    "list_filter(string_split_regex({x}, '[^\\pL\\pM\\pN_.]+'), lambda v: regexp_full_match(v, '[0-9]+([.][0-9]+){{1,3}}')))"
)
