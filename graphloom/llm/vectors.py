"""Near-duplicate embeddings by randomised-rotation binary codes.

Vectors are normalised and turned by random rotations; the signs are a binary code.

* Tables of short keys cut from the codes bring together pairs that may be close; their
  number is set so that a pair at the threshold meets in one with probability ``recall``.
  A row of a table holds a key, an id and the sign code, so what is shuffled grows with the
  number of tables only; pairs whose sign codes differ in too many bits go no further.
* For a pair that meets, the inner product is estimated from one vector's code and its
  stored correction factor and the other vector's coordinates in four bits (bit planes, so
  the estimate is a few popcounts). The estimate is unbiased; its confidence bound decides
  whether the pair may reach the threshold.
* Pairs that may are recomputed exactly, in double precision.

Equal vectors are compared once. Where a bucket is crowded, its vectors are first compared
with one of them; those that links join so are a class. The pairs of a class are counted, not
formed: two vectors whose angles to the class's centre add up to no more than the
threshold's are linked for certain, and the others are multiplied in blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import connected_components, drop_scratch, materialize

#: Confidence of the bounds, in standard errors of the estimate.
SIGMAS = 4.0
#: Vectors of a bucket from which it is crowded.
CROWD = 32
#: Parts of the threshold's angle by which angles to a centre are told apart.
RINGS = 128
#: Vectors of a block, on average, that is multiplied with another.
BLOCK = 2048


def plan_tables(rows: int, cosine: float, recall: float) -> tuple[int, int]:
    """Bits of a key and number of tables for so many vectors.

    A key has about log2(rows) bits, so random vectors share a bucket with few others.
    """
    bits = max(8, min(30, math.ceil(math.log2(max(rows, 2))) - 1))
    agree = (1 - math.acos(min(1.0, cosine)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree))) if agree < 1 else 1


@lru_cache(maxsize=4)
def rotations(dim: int, count: int, seed: int) -> np.ndarray:
    """``count`` random directions in groups of ``dim`` orthogonal ones, as columns."""
    rng = np.random.default_rng([seed, dim])
    groups = []
    for _ in range(-(-count // dim)):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        groups.append(q * np.sign(np.diag(r)))
    return np.concatenate(groups, axis=1)[:, : max(count, dim)]


def _pack(bits: np.ndarray, width: int) -> np.ndarray:
    """Rows of 0/1 as longs, ``width`` bits each."""
    n = bits.shape[1] // width
    weights = (np.uint64(1) << np.arange(width, dtype=np.uint64)).astype(np.uint64)
    b = bits[:, : n * width].reshape(len(bits), n, width).astype(np.uint64)
    return (b * weights).sum(axis=2, dtype=np.uint64).view(np.int64)


def words_of(dim: int) -> int:
    """Longs of a sign code, 63 bits each."""
    return -(-dim // 63)


def encode(x: np.ndarray, bits: int, tables: int, seed: int, width: int) -> dict[str, np.ndarray]:
    """Codes of normalised rows: keys, sign code, correction factor, four-bit planes and their scale.

    Codes and planes are padded to ``width`` longs, the most that any vector of the table needs.
    """
    dim = x.shape[1]
    turned = x @ rotations(dim, bits * tables, seed)
    keys = _pack(turned[:, : bits * tables] > 0, bits)
    own = turned[:, :dim]
    sign = own > 0
    pad = width * 63 - dim
    words = lambda b: _pack(np.pad(b, ((0, 0), (0, pad))), 63)
    factor = np.abs(own).sum(axis=1) / math.sqrt(dim)
    low = own.min(axis=1)
    step = np.maximum((own.max(axis=1) - low) / 15, 1e-12)
    level = np.clip(np.rint((own - low[:, None]) / step[:, None]), 0, 15).astype(np.int64)
    planes = np.concatenate([words((level >> b) & 1 > 0) for b in range(4)], axis=1)
    return {
        "keys": keys, "code": words(sign), "ones": sign.sum(axis=1), "factor": factor,
        "planes": planes, "low": low, "step": step, "total": (low[:, None] + step[:, None] * level).sum(axis=1),
    }


_CODED = (
    "rep bigint, dim int, keys array<bigint>, code array<bigint>, ones bigint, factor double, "
    "planes array<bigint>, low double, step double, total double"
)


def _matrix(column: object) -> np.ndarray:
    """An Arrow column of lists of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _lists(a: np.ndarray) -> object:
    import pyarrow as pa

    ends = np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(a.ravel()))


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither overflow nor vanish."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _by_length(batch: object, column: int) -> Iterator:
    """Parts of a record batch whose lists in ``column`` have one length."""
    import pyarrow as pa

    n = np.diff(batch.column(column).offsets.to_numpy())
    for dim in np.unique(n):
        yield int(dim), batch if (n == dim).all() else batch.take(pa.array(np.flatnonzero(n == dim)))


def _codes(vectors: DataFrame, bits: int, tables: int, seed: int, width: int) -> DataFrame:
    """Codes of ``(rep, v array<double>)``."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, part in _by_length(b, 1):
                e = encode(_unit(_matrix(part.column(1))), bits, tables, seed, width)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(np.full(len(part), dim, np.int32)), _lists(e["keys"]), _lists(e["code"]),
                        pa.array(e["ones"], pa.int64()), pa.array(e["factor"]), _lists(e["planes"]),
                        pa.array(e["low"]), pa.array(e["step"]), pa.array(e["total"]),
                    ],
                    names=[c.split()[0] for c in _CODED.split(", ")],
                )

    return vectors.mapInArrow(run, _CODED)


def _upper_bound(words: int) -> Column:
    """Largest inner product that a's coordinates and b's code leave possible, within the confidence."""
    dim = F.col("a.dim").cast("double")
    pops = F.lit(0)
    for plane in range(4):
        for w in range(words):
            both = F.get(F.col("a.planes"), F.lit(plane * words + w)).bitwiseAND(F.get(F.col("b.code"), F.lit(w)))
            pops = pops + F.bit_count(both) * (1 << plane)
    on = F.col("a.low") * F.col("b.ones") + F.col("a.step") * pops
    estimate = (2 * on - F.col("a.total")) / F.sqrt(dim) / F.col("b.factor")
    f2 = F.col("b.factor") * F.col("b.factor")
    error = SIGMAS * F.sqrt(F.greatest(F.lit(0.0), 1 - f2) / f2 / F.greatest(dim - 1, F.lit(1.0)))
    return estimate + error + F.col("a.step") * 0.5


def _most_bits(dim: Column, cosine: float) -> Column:
    """Bits of their sign codes in which vectors at the threshold differ, at most, within the confidence."""
    p = math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    return F.ceil(dim * p + SIGMAS * F.sqrt(dim * p * (1 - p))) + 1


def _cosine(pairs: DataFrame) -> DataFrame:
    """``(a, b, cosine)`` of ``(a, b, va, vb)``, in double precision; the lists of a pair have one length."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in _by_length(batch, 2):
                u, v = _unit(_matrix(part.column(2))), _unit(_matrix(part.column(3)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.einsum("ij,ij->i", u, v))], names=["a", "b", "cosine"])

    return pairs.mapInArrow(run, "a bigint, b bigint, cosine double")


def _linked(pairs: DataFrame, distinct: DataFrame, cosine: float) -> DataFrame:
    """The pairs ``(a, b)`` of ids whose vectors have the cosine."""
    left = distinct.select(F.col("rep").alias("a"), F.col("v").alias("va"))
    right = distinct.select(F.col("rep").alias("b"), F.col("v").alias("vb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "va", "vb")
    return _cosine(both).filter(F.col("cosine") >= cosine).select("a", "b")


def _centres(members: DataFrame) -> DataFrame:
    """``(root, centre)``: the sum of a class's unit vectors, added up by batch, then by component."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, part in _by_length(b, 1):
                roots, at = np.unique(part.column(0).to_numpy(), return_inverse=True)
                x = _unit(_matrix(part.column(1)))
                sums = np.zeros((len(roots), x.shape[1]))
                np.add.at(sums, at, x)
                yield pa.RecordBatch.from_arrays([pa.array(roots), _lists(sums)], names=["root", "s"])

    some = members.select("root", "v").mapInArrow(run, "root bigint, s array<double>")
    each = some.select("root", F.posexplode("s").alias("i", "x")).groupBy("root", "i").agg(F.sum("x").alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "x")))  # as many as a vector has components
    return each.groupBy("root").agg(F.transform(ordered, lambda c: c["x"]).alias("centre"))


def _rings(members: DataFrame, cosine: float) -> DataFrame:
    """``members``, vectors at length one, with ``ring``: the angle to the class's centre in parts of the threshold's, rounded up."""
    import pyarrow as pa
    from pyspark.sql import types as T

    width = math.acos(cosine) / RINGS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, part in _by_length(b, 3):
                c = _matrix(part.column(4))
                c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
                unit = _unit(_matrix(part.column(3)))
                angle = 2 * np.arcsin(np.minimum(1.0, np.linalg.norm(unit - c, axis=1) / 2))
                ring = np.ceil(angle / width + 1e-6).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], _lists(unit), pa.array(ring)], names=["rep", "root", "copies", "v", "ring"])

    both = members.join(_centres(members), "root").select("rep", "root", "copies", "v", "centre")
    schema = T.StructType([*both.schema.fields[:4], T.StructField("ring", T.IntegerType())])
    return both.mapInArrow(run, schema)


def _class_links(members: DataFrame, cosine: float) -> DataFrame:
    """``(a, others)``: for ``members(rep, root, copies, v)``, the copies of other members of the class that are linked.

    No pair of a class becomes a row. Rings that add up to less than the threshold's angle are
    linked whole, rings further apart than it are not; what is left is multiplied block by
    block, of ``BLOCK`` vectors on average, however large the class is.
    """
    import pyarrow as pa

    m = materialize(_rings(members, cosine), "vectors-rings")
    rings = materialize(m.groupBy("root", "ring").agg(F.sum("copies").alias("held"), F.count(F.lit(1)).alias("n")), "vectors-held")
    x = rings.select("root", "ring", "n").alias("x")
    pair = x.join(rings.select("root", F.col("ring").alias("other"), "held", F.col("n").alias("m")).alias("y"), "root")
    sure = pair.filter(F.col("ring") + F.col("other") < RINGS).groupBy("root", "ring").agg(F.sum("held").alias("held"))
    own = F.when(2 * F.col("ring") < RINGS, F.col("copies")).otherwise(F.lit(0))
    counted = m.join(sure, ["root", "ring"]).select(F.col("rep").alias("a"), (F.col("held") - own).alias("others"))

    open_rings = (F.col("ring") + F.col("other") >= RINGS) & (F.col("other") - F.col("ring") <= RINGS + 2) & (F.col("ring") <= F.col("other"))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    todo = pair.filter(open_rings).select("root", "ring", "other", blocks("n").alias("p"), blocks("m").alias("q"))
    todo = materialize(todo, "vectors-blocks")
    turn = lambda n: F.pmod(F.xxhash64("rep"), F.col(n).cast("long")).cast("int")
    to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cell = ["root", "ring", "other", "i", "j"]
    left = m.join(todo, ["root", "ring"]).withColumn("i", turn("p")).withColumn("j", to("q")).withColumn("side", F.lit(0))
    right = m.withColumnRenamed("ring", "other").join(todo, ["root", "other"]).withColumn("j", turn("q")).withColumn("i", to("p")).withColumn("side", F.lit(1))
    # within one ring each two blocks meet once
    left, right = (f.filter("ring < other or i <= j").select(*cell, "side", "rep", "copies", "v") for f in (left, right))
    right = right.filter("ring < other or i < j")
    dealt = left.unionAll(right).repartition(*cell).sortWithinPartitions(*cell, "side")

    def count(a: list, b: list, out: list) -> None:
        x, cx = np.array([r[2] for r in a]), np.array([r[1] for r in a], np.int64)
        if not b:
            near = x @ x.T >= cosine
            np.fill_diagonal(near, False)
            out.append(([r[0] for r in a], near @ cx))
        else:
            y, cy = np.array([r[2] for r in b]), np.array([r[1] for r in b], np.int64)
            near = x @ y.T >= cosine
            out += [([r[0] for r in a], near @ cy), ([r[0] for r in b], near.T @ cx)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, ([], [])
        for batch in batches:
            out: list = []
            cells = zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)
            flat, ends = batch.column(8).flatten().to_numpy(zero_copy_only=False), batch.column(8).offsets.to_numpy()
            units = (flat[i - ends[0] : j - ends[0]] for i, j in zip(ends[:-1], ends[1:], strict=True))
            for cell, side, rep, copies, unit in zip(cells, *(batch.column(i).to_pylist() for i in (5, 6, 7)), units, strict=True):
                if cell != now:
                    _close(now, sides, out, count)
                    now, sides = cell, ([], [])
                sides[side].append((rep, copies, unit))
            yield from _counts(out)
        out = []
        _close(now, sides, out, count)
        yield from _counts(out)

    return counted.unionAll(dealt.mapInArrow(run, "a bigint, others bigint"))


def _close(cell: tuple | None, sides: tuple[list, list], out: list, count: Callable) -> None:
    """Count a finished block pair; a block that meets itself has one side, blocks that miss a side have no pair."""
    if cell is None:
        return
    same = cell[1] == cell[2] and cell[3] == cell[4]
    if sides[0] and (sides[1] or same):
        count(*sides, out)


def _counts(out: list) -> Iterator:
    import pyarrow as pa

    for ids, n in out:
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.asarray(n, np.int64))], names=["a", "others"])


def near_vectors(
    vectors: DataFrame,
    cosine: float = 0.9,
    recall: float = 0.99,
    seed: int = 11,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``vectors``.

    Rows link when the cosine of their vectors, recomputed in double precision, is ``cosine``
    or more; a pair at the threshold is found with probability ``recall``, closer pairs with
    more, equal vectors always. ``n_links`` counts the other rows linked directly,
    ``component_id`` is the smallest id reachable over links, own included, and ``kept`` says
    that it is the row's own. Null, zero-length and zero vectors and those with a null or
    non-finite component link with nothing; vectors of different length never link. Null ids
    are kept and never name a component that has another id; rows that repeat an id are rows of
    their own. Other columns are ignored. No rows: no rows.
    """
    # adding zero makes of a negative zero a positive one, so equal vectors have equal hashes
    plain = F.transform(F.col(vec_col).cast("array<double>"), lambda x: x + F.lit(0.0))
    v = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), plain.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(F.col("v").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    key = [F.when(good, F.xxhash64("v")).alias("h1"), F.when(good, F.xxhash64(F.lit(1), "v")).alias("h2")]
    v = materialize(v.select("vec_id", *key, F.when(good, F.col("v")).alias("v")), "vectors")
    distinct = v.filter("h1 is not null").groupBy("h1", "h2").agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.any_value("v").alias("v")
    )
    distinct = materialize(distinct.withColumn("rep", F.monotonically_increasing_id()), "vectors-distinct")
    rows, longest = distinct.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    width = words_of(longest or 1)
    bits, tables = plan_tables(rows, cosine, recall)
    coded = materialize(_codes(distinct.select("rep", "v"), bits, tables, seed, width), "vectors-codes")

    dealt = coded.select("rep", "dim", "code", F.posexplode("keys").alias("table", "key"))
    bucket = ["table", "key", "dim"]
    crowded = dealt.groupBy(*bucket).agg(F.min("rep").alias("head"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= CROWD)
    stars = dealt.join(crowded, bucket).filter("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct()
    stars = materialize(_linked(stars, distinct, cosine), "vectors-stars")
    classes = connected_components(stars.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    classes = materialize(classes.select(F.col("node").alias("rep"), "root"), "vectors-classes")
    members = distinct.select("rep", "copies", "v").join(classes, "rep").select("rep", "root", "copies", "v")
    within = materialize(_class_links(members, cosine), "vectors-within")

    # pairs that are not of one class
    dealt = coded.join(classes, "rep", "left").select("rep", "dim", "code", "root", F.posexplode("keys").alias("table", "key"))
    a, b = dealt.alias("a"), dealt.alias("b")
    differ = F.lit(0)
    for w in range(width):
        differ = differ + F.bit_count(F.get(F.col("a.code"), F.lit(w)).bitwiseXOR(F.get(F.col("b.code"), F.lit(w))))
    meet = (
        (F.col("a.table") == F.col("b.table"))
        & (F.col("a.key") == F.col("b.key"))
        & (F.col("a.dim") == F.col("b.dim"))
        & (F.col("a.rep") < F.col("b.rep"))
        & ~F.coalesce(F.col("a.root") == F.col("b.root"), F.lit(False))
        & (differ <= _most_bits(F.col("a.dim"), cosine))
    )
    met = materialize(a.join(b, meet).select(F.col("a.rep").alias("x"), F.col("b.rep").alias("y")).distinct(), "vectors-met")
    codes = coded.drop("keys")
    pairs = met.join(codes.alias("a"), F.col("x") == F.col("a.rep")).join(codes.alias("b"), F.col("y") == F.col("b.rep"))
    pairs = pairs.filter(_upper_bound(width) >= cosine).select(F.col("x").alias("a"), F.col("y").alias("b"))
    links = materialize(_linked(pairs, distinct, cosine), "vectors-links")

    every = links.unionAll(stars).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    roots = connected_components(every)
    n = distinct.select(F.col("rep").alias("b"), "copies")
    ends = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = ends.join(n, "b").select("a", F.col("copies").alias("others")).unionAll(within)
    linked = linked.groupBy("a").agg(F.sum("others").alias("others"))
    group = (
        distinct.select("rep", "h1", "h2", "least", "copies")
        .join(linked, F.col("rep") == F.col("a"), "left")
        .join(roots, F.col("rep") == F.col("node"), "left")
        .select("h1", "h2", "least", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    )
    names = group.groupBy("root").agg(F.min("least").alias("component_id"))
    group = materialize(group.join(names, "root").select("h1", "h2", "n_links", "component_id"), "vectors-groups")
    drop_scratch(coded, met)
    out = v.select("vec_id", "h1", "h2").join(group, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
