"""Vector search, rank fusion and the landing list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries of a block; of 64 components each, about 10 MB.
QUERY_BLOCK = 20_000
#: Queries that a batch of vectors is multiplied with at once.
QUERIES_AT_ONCE = 256


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, rank, id, score)``: the nearest vectors of each query by cosine, in double precision.

    The queries are a stated set. They are sent to the vectors in blocks of at most
    ``QUERY_BLOCK`` of each length, however many there are. A batch of vectors is multiplied with
    some of them at once and leaves ``k`` rows a query. Null and empty vectors are near to nothing.
    """
    import pyarrow as pa

    kind = vectors.schema["id"].dataType.simpleString()
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {kind}, score double"
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    asked = queries.filter("size(embedding) > 0").select("query_id", F.col("embedding").cast("array<double>").alias("q"))
    count = asked.groupBy(F.size("q").alias("n")).count().collect()
    blocks = max([1, *(-(-r["count"] // QUERY_BLOCK) for r in count)])
    v = vectors.filter("size(embedding) > 0").select("id", F.col("embedding").cast("array<double>").alias("v"))
    out = None
    for b in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else asked
        sent = vectors.sparkSession.sparkContext.broadcast(part.toArrow())

        def run(batches: Iterator[pa.RecordBatch], sent: object = sent) -> Iterator[pa.RecordBatch]:
            block = dict(_matrices(sent.value.combine_chunks()))
            for batch in batches:
                for dim, (ids, x) in _matrices(pa.table(batch.columns, names=["id", "v"])):
                    if dim in block:
                        keys, q = block[dim]
                        names = np.array(ids.to_pylist())
                        for lo in range(0, len(q), QUERIES_AT_ONCE):
                            at, row, score = _first(np.round(x @ q[lo : lo + QUERIES_AT_ONCE].T, 9), names, k)
                            yield pa.RecordBatch.from_arrays([keys.take(pa.array(at + lo)), ids.take(pa.array(row)), pa.array(score)], names=["query_id", "id", "score"])

        s = v.mapInArrow(run, schema).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
        out = s if out is None else out.unionAll(s)
    return out


def _matrices(table: object) -> Iterator:
    """``(length, (ids, rows of length one))`` of the vectors of a table, by their length."""
    import pyarrow as pa

    ids, lists = (c.combine_chunks() for c in table.columns)
    n = np.diff(lists.offsets.to_numpy())
    for dim in np.unique(n):
        at = pa.array(np.flatnonzero(n == dim))
        x = lists.take(at).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)
        yield int(dim), (ids.take(at), x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9))


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(column, row, score)`` of the first ``k`` rows of each column, by score, then id."""
    score = np.where(np.isnan(score), -np.inf, score)
    columns, rows = [], []
    least = -np.partition(-score, k - 1, axis=0)[k - 1] if len(score) > k else np.full(score.shape[1], -np.inf)
    for j in range(score.shape[1]):
        at = np.flatnonzero(score[:, j] >= least[j])
        at = at[np.lexsort((ids[at], -score[at, j]))[:k]]
        columns.append(np.full(len(at), j))
        rows.append(at)
    c, r = np.concatenate(columns), np.concatenate(rows)
    return c, r, score[r, c]


def fuse(primary: DataFrame, secondary: DataFrame, k: int, head: int = 2, c: float = 60.0, offset: int = 1) -> DataFrame:
    """Reciprocal-rank fusion of two lists ``(query_id, rank, id)``: ``(query_id, rank, id, score)``.

    The first ``head`` of the primary list keep their places; the others follow by the sum of
    1 / (c + place + offset) over both lists (places from 0), ties by first appearance. Where
    one list is empty the other one stands.
    """
    both = primary.select("query_id", "id", F.col("rank").alias("p"), F.lit(0).alias("l")).unionAll(
        secondary.select("query_id", "id", F.col("rank").alias("p"), F.lit(1).alias("l"))
    )
    s = both.groupBy("query_id", "id").agg(
        F.sum(1 / (F.lit(c) + F.col("p") - 1 + offset)).alias("score"),
        F.min(F.when(F.col("l") == 0, F.col("p"))).alias("first"),
        F.min(F.struct("l", "p")).alias("seen"),
    )
    lead = F.when(F.col("first") <= head, F.col("first"))
    order = Window.partitionBy("query_id").orderBy(lead.asc_nulls_last(), F.desc(F.round("score", 12)), "seen")
    return s.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def weighted_fuse(text: DataFrame, graph: DataFrame, weight: float = 0.5, c: float = 60.0) -> DataFrame:
    """``(query_id, id, score)``: 1 / (c + place) of the text list and ``weight`` of that of the graph list, places from 0."""
    both = text.select("query_id", "id", (1 / (F.lit(c) + F.col("rank") - 1)).alias("s")).unionAll(
        graph.select("query_id", "id", (F.lit(weight) / (F.lit(c) + F.col("rank") - 1)).alias("s"))
    )
    return both.groupBy("query_id", "id").agg(F.sum("s").alias("score"))


def one_per_file(hits: DataFrame, k: int, keys: tuple[str, ...] = ("repo", "path"), path: str = "path") -> DataFrame:
    """The best row of each file first, displaced rows after all others; rows without a path never collapse."""
    place = F.row_number().over(Window.partitionBy("query_id", *keys).orderBy("rank"))
    late = (place > 1) & (F.coalesce(F.col(path), F.lit("")) != "")
    order = Window.partitionBy("query_id").orderBy("late", "rank")
    h = hits.withColumn("late", late)
    return h.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("late")


def land(raw: DataFrame, expanded: DataFrame | None, anchors: DataFrame | None, dense: DataFrame | None, nodes: DataFrame, k: int = 8, material: int = 16, head: int = 1) -> DataFrame:
    """The landing list: the request's hits fused with those of its expansion, the anchors first, then vectors, one row a file."""
    out = raw
    if expanded is not None:
        out = fuse(out, expanded, material, head=head)
    if anchors is not None:
        out = fuse(anchors, out, material, head=head)
    if dense is not None:
        out = fuse(out, dense, material, head=0)
    return one_per_file(out.join(nodes.select("id", "repo", "path"), "id"), k)


def budget_take(rows: DataFrame, size: str, budget: int, *order: str, by: str | None = None) -> DataFrame:
    """Rows in order until one overflows ``budget``; the first one is always kept, and nothing after an overflow."""
    group = Window.partitionBy(by) if by else Window.partitionBy(F.lit(1))
    w = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    r = rows.withColumn("used", F.sum(size).over(w)).withColumn("place", F.row_number().over(group.orderBy(*order)))
    return r.filter((F.col("used") <= budget) | (F.col("place") == 1))


def promotion_path(env: Column, ladder: Column) -> Column:
    """The steps of a release ladder after an environment."""
    at = F.array_position(ladder, env)
    return F.when(at > 0, F.slice(ladder, at + 1, F.size(ladder))).otherwise(F.array().cast("array<string>"))
