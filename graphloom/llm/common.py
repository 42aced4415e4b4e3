"""Scratch tables, connected components and small helpers shared by the operators.

Scratch tables cut lineage: a lost executor costs a reread of a Parquet file, not
a rerun of the stages behind it. They go to the folder that the cluster names in
``spark.checkpoint.dir`` and are deleted when the application ends.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space between words: space and \x09 to \x0D.
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Edges of two longs, about 100 bytes each while they are contracted, up to which one task does it.
FEW_EDGES = 500_000


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for scratch tables.

    ``spark.checkpoint.dir`` when set. Otherwise, for a local master only, a folder
    under /tmp/checkpoints; for any other master the warehouse, which is shared.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.startswith("local"):
            base = "file:///tmp/checkpoints"
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a scratch table and return a DataFrame that reads it."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop_scratch(*tables: DataFrame) -> None:
    """Delete scratch tables that no later plan reads."""
    for t in tables:
        path = getattr(t, "_scratch_path", None)
        if path:
            sc = t.sparkSession.sparkContext
            hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hadoop, True)


def give_back_memory() -> None:
    """Return the freed memory of a Python worker, which outlives its tasks, to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it as long as a column of ``df`` is called so."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def text_of(col: Column) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(col, F.lit(""))


def crc32_text(col: Column) -> Column:
    """crc32 of an id written as text (unsigned)."""
    return F.crc32(F.encode(col.cast("string"), "UTF-8"))


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``(node, root)`` for every node of ``edges(src, dst)``; root is the smallest node reachable.

    Up to ``FEW_EDGES`` edges, which fit into one task, are contracted there; more by
    alternating large-star and small-star contraction. Every round is joins against a
    table of one minimum per node and partial aggregations, so a hub costs no task its
    whole neighbourhood; the edge list is a scratch table after each round. Self-loops
    and repeated or reversed edges are allowed. No edges: no rows. Nodes keep the type of
    ``src``.
    """
    lo, hi = F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")
    cur = materialize(edges.filter(F.col("src") != F.col("dst")).select(lo, hi).distinct(), "cc0")
    state = _edge_state(cur)
    if 0 < state[0] <= FEW_EDGES and isinstance(cur.schema["lo"].dataType, T.LongType):
        found = materialize(cur.coalesce(1).mapInArrow(_contract, "node bigint, root bigint"), "cc")
        drop_scratch(cur)
        return found
    for i in range(max_rounds):
        if state[0] == 0:
            break
        both = cur.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
            cur.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.filter("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        )
        large = materialize(large, f"cc{i}l")
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(down, "hi")
            .select(
                F.explode(
                    F.when(F.col("lo") == F.col("m"), F.array(F.struct(F.col("m").alias("lo"), F.col("hi").alias("hi"))))
                    .otherwise(
                        F.array(
                            F.struct(F.col("m").alias("lo"), F.col("lo").alias("hi")),
                            F.struct(F.col("m").alias("lo"), F.col("hi").alias("hi")),
                        )
                    )
                ).alias("e")
            )
            .select("e.lo", "e.hi")
            .distinct()
        )
        small = materialize(small, f"cc{i}s")
        drop_scratch(cur, large)
        cur, before = small, state
        state = _edge_state(cur)
        if state == before:
            break
    else:
        raise RuntimeError("connected components did not converge")
    # at the fixed point every edge joins a node to its root
    roots = cur.select("lo").distinct()
    return cur.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(
        roots.select(F.col("lo").alias("node"), F.col("lo").alias("root"))
    )


def roots_of(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges and the smallest node that each reaches: hooking roots to smaller ones, then halving paths."""
    nodes, at = np.unique(np.concatenate([lo, hi]), return_inverse=True)
    a, b = at[: len(lo)], at[len(lo) :]
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while (root != root[root]).any():
            root = root[root]


def _contract(batches: Iterator) -> Iterator:
    import pyarrow as pa

    edges = pa.Table.from_batches(list(batches))
    node, root = roots_of(*(edges[c].to_numpy() for c in ("lo", "hi")))
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "root"])


def _edge_state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("lo", "hi")).alias("x"), F.bit_xor(F.hash("hi", "lo")).alias("y")
    ).first()
    return tuple(row)
