"""Mixing sources to target weights by balanced sampling (the cube method).

Each source has a target number of words. Its documents are taken floor(r) times for
certain, r being target over size, and once more with probability r - floor(r). Which ones
is decided by the cube method: the vector of probabilities moves within the null space of
the balancing constraints until nearly all entries are 0 or 1, so the taken words and the
taken documents of a source both meet their expectation; a small landing problem remains.

A document that holds a large share of its source's words cannot be balanced by one block of
the others. Such documents, at most 1 / ``OUTLIER`` a source, fly first, together with the rest
of their source as one unit: each step keeps the source's expected words (and documents, while
three units are open), and the rest's probability is what its documents then fly with.

The flight of all other documents runs in blocks dealt by a hash of the document, few units at a time, and
leaves at most two undecided units a block and source. What the blocks leave is gathered
and flown again by source; the landing gives up the document count, then rounds one unit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import materialize, text_of

WEIGHTS = (5.0, 2.0, 1.0)
#: Documents a block holds on average.
BLOCK_ROWS = 2_000
#: Undecided units of a source up to which it is flown in one go.
GATHER_ROWS = 20_000
WORD = r"[^\x20\x09-\x0D]+"
#: Share of its source's words from which a document flies before all others.
OUTLIER = 0.01
_EDGE = 1e-9


def n_words(text: Column) -> Column:
    """Number of runs of anything but ASCII white space."""
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def targets(sizes: dict, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> dict:
    """Target words by source.

    Sources in code point order, null last, weigh ``weights``, repeating. ``share`` of all
    words is divided by weight; a target stops at ``most`` times its source's size and the
    excess is divided again among the others, until none is above.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    got = dict.fromkeys(order, 0.0)
    free, left = list(order), share * sum(sizes.values())
    while free:
        unit = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * unit >= most * sizes[s]]
        if not full:
            return got | {s: weight[s] * unit for s in free}
        for s in full:
            got[s] = most * sizes[s]
            left -= got[s]
        free = [s for s in free if s not in set(full)]
        left = max(left, 0.0)
    return got


class Flight:
    """Cube flight over units fed one by one, largest first, balancing the sums of ``pi`` and of ``pi * size``.

    A step moves along the unit vector of a large undecided unit, projected on the null
    space of both constraints over the units held: the others make up for it in small
    shares, so large units are decided early and what is left at last is small. Holds
    ``HELD`` undecided units. ``done`` receives ``(unit, 0 or 1)``.
    """

    HELD = 48

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed % 2**63)
        self.units: list = []
        self.pi: list[float] = []
        self.size: list[float] = []
        self.done: list[tuple] = []

    def feed(self, unit: object, pi: float, size: float) -> None:
        if pi <= _EDGE or pi >= 1 - _EDGE:
            self.done.append((unit, int(pi >= 0.5)))
            return
        self.units.append(unit)
        self.pi.append(pi)
        self.size.append(size)
        if len(self.units) >= self.HELD:
            self._step()

    def finish(self) -> None:
        """Fly on until at most two units are undecided."""
        while len(self.units) > 2:
            self._step()

    def land(self) -> None:
        """Give up the document count and balance words alone, then round the last unit."""
        self.finish()
        while len(self.units) > 1:
            a, b = self.size
            self._move(np.array([b, -a]) if a or b else np.array([1.0, -1.0]))
        if self.units:
            self.done.append((self.units.pop(), int(self.rng.random() < self.pi.pop())))
            self.size.pop()

    def _step(self) -> None:
        size = np.array(self.size)
        c = size - size.mean()
        v = float(c @ c)
        free = 1 - 1 / len(c) - (c * c / v if v > _EDGE else 0.0 * c)
        large = np.where(free > 0.2, size, -1.0)
        j = int(large.argmax()) if large.max() >= 0 else int(free.argmax())
        u = -1 / len(c) - (c[j] / v * c if v > _EDGE else 0.0 * c)
        u[j] += 1
        u[np.abs(u) < 1e-12] = 0.0
        self._move(u)

    def _move(self, u: np.ndarray) -> None:
        """One random step of the cube method along ``u``, a null vector of the constraints."""
        pi = np.array(self.pi)
        on = u != 0
        to_one, to_zero = (1 - pi[on]) / np.abs(u[on]), pi[on] / np.abs(u[on])
        up = np.where(u[on] > 0, to_one, to_zero).min()
        down = np.where(u[on] > 0, to_zero, to_one).min()
        pi += u * (up if self.rng.random() * (up + down) < down else -down)
        out = (pi <= _EDGE) | (pi >= 1 - _EDGE)
        if not out.any():  # rounding kept the wall just out of reach
            out[np.minimum(pi, 1 - pi).argmin()] = True
        self.done += [(self.units[i], int(pi[i] >= 0.5)) for i in np.flatnonzero(out)]
        stay = np.flatnonzero(~out).tolist()
        self.pi = [float(pi[i]) for i in stay]
        self.units = [self.units[i] for i in stay]
        self.size = [self.size[i] for i in stay]


def fly_outliers(sizes: list[int], pi: float, rest_size: float, rest_rows: int, seed: int) -> tuple[list[int], float]:
    """0 or 1 for each of ``sizes`` (largest first), and the probability left to the rest.

    The cube method over these units and the rest, which stands for ``rest_rows`` units of
    ``rest_size`` in all, every one with probability ``pi`` at first. A step moves along the
    largest open unit, projected on the null space of the constraints. What is open when no
    unit can make up for another is rounded by its probability.
    """
    rng = np.random.default_rng(seed % 2**63)
    p = np.full(len(sizes) + 1, pi)
    a = np.array([[*([1.0] * len(sizes)), float(rest_rows)], [*map(float, sizes), float(rest_size)]])
    a /= np.maximum(a.max(axis=1, keepdims=True), 1e-300)
    is_open = lambda: (p > _EDGE) & (p < 1 - _EDGE) & (a.any(axis=0))
    while is_open()[:-1].any():
        at = np.flatnonzero(is_open())
        j = int(at[0])
        u = None
        for k in (2, 1):  # both totals, then words alone
            if len(at) > k:
                c = a[2 - k :, at]
                e = np.eye(len(at))[0]
                v = e - np.linalg.pinv(c) @ (c @ e)
                if v[0] > 1e-6:
                    u = np.zeros(len(p))
                    u[at] = np.where(np.abs(v) > 1e-12, v, 0.0)
                    break
        if u is None:
            p[j] = float(rng.random() < p[j])
            continue
        on = u != 0
        to_one, to_zero = (1 - p[on]) / np.abs(u[on]), p[on] / np.abs(u[on])
        up, down = np.where(u[on] > 0, to_one, to_zero).min(), np.where(u[on] > 0, to_zero, to_one).min()
        p = p + u * (up if rng.random() * (up + down) < down else -down)
        near = np.minimum(p, 1 - p)
        if not (near[at] <= _EDGE).any():  # rounding kept the wall just out of reach
            w = at[near[at].argmin()]
            p[w] = round(p[w])
    return [int(x >= 0.5) for x in p[:-1]], float(min(1.0, max(0.0, p[-1])))


def _outliers(large: DataFrame, seed: int) -> DataFrame:
    """``(group, row, extra, pi)``: what ``fly_outliers`` decides, and with null ``row`` the rest's probability, source by source."""
    import pyarrow as pa

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        rows.sort(key=lambda r: (-r["size"], r["tie"], str(r["doc_id"]), r["row"]))
        one = rows[0]
        rest = one["source_size"] - sum(r["size"] for r in rows)
        choice, pi = fly_outliers([r["size"] for r in rows], one["part"], rest, one["rows"] - len(rows), hash((seed, one["group"])))
        return pa.table(
            {
                "group": pa.array([one["group"]] * (len(rows) + 1), pa.int32()),
                "row": pa.array([*(r["row"] for r in rows), None], pa.int64()),
                "extra": pa.array([*choice, None], pa.int32()),
                "pi": pa.array([*([0.0] * len(rows)), pi], pa.float64()),
            }
        )

    return large.groupBy("group").applyInArrow(run, "group int, row long, extra int, pi double")


def _fly(units: DataFrame, seed: int, land: bool) -> DataFrame:
    """Fly each ``(source, block)`` of ``units``, sorted and streamed: a task holds few units, not a block.

    Adds ``extra``: 0 or 1, or null where the unit stays undecided, with ``pi`` as it is left.
    """
    import pyarrow as pa

    schema = T.StructType([*units.schema, T.StructField("extra", T.IntegerType())])
    names = [f.name for f in schema]
    place = {c: i for i, c in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, flight, out, kinds = None, None, [], []

        def close() -> None:
            if flight is None:
                return
            flight.land() if land else flight.finish()
            out.extend((*unit, x) for unit, x in flight.done)
            for unit, p in zip(flight.units, flight.pi, strict=True):
                row = [*unit, None]
                row[place["pi"]] = p
                out.append(tuple(row))

        def frame() -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for b in batches:
            kinds = [*b.schema.types, pa.int32()]
            rows = zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True)
            for row in rows:
                key = (row[place["group"]], row[place["block"]])
                if key != now:
                    close()
                    now, flight = key, Flight(hash((seed, *key)))
                flight.feed(row, row[place["pi"]], float(row[place["size"]]))
            if flight:
                out.extend((*unit, x) for unit, x in flight.done)
                flight.done.clear()
            if out:
                yield frame()
        close()
        if out:
            yield frame()

    dealt = units.repartition("group", "block").sortWithinPartitions("group", "block", F.desc("size"), "tie", "doc_id")
    return dealt.mapInArrow(run, schema)


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)``, one row per row of ``docs``.

    ``size`` counts words (null text: 0); ``copies`` says how often the mix takes the
    document and ``taken`` is copies * size. A source's taken words differ from its target by
    about one of its smaller documents. The result depends on the rows and ``seed``
    alone, not on how they are split, but for rows that are equal in id, source and size,
    which may swap places. A source without words has target 0 and is not taken. A null
    source is a source of its own. Other columns are ignored. No rows: no rows.

    One row per source goes to the driver: the table of weights is the mix's definition.
    """
    spark = docs.sparkSession
    d = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        n_words(F.col(f"`{text_col}`")).alias("size"),
    )
    d = materialize(d.withColumn("row", F.monotonically_increasing_id()), "mix")
    totals = {r["source"]: r for r in d.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).collect()}
    sums = {s: r["size"] for s, r in totals.items()}
    aim = targets(sums, weights, share, most)
    order = sorted(sums, key=lambda s: (s is None, s or ""))
    ratio = [aim[s] / sums[s] if sums[s] else 0.0 for s in order]
    part = [r - math.floor(r) if _EDGE < r - math.floor(r) < 1 - _EDGE else 0.0 for r in ratio]
    sure = [round(r) if p == 0 else math.floor(r) for r, p in zip(ratio, part, strict=True)]
    blocks = [max(1, totals[s]["rows"] // BLOCK_ROWS) for s in order]
    plan = spark.createDataFrame(
        [(s, i, int(sums[s]), float(aim[s]), sure[i], part[i], blocks[i], totals[s]["rows"]) for i, s in enumerate(order)],
        "plan_source string, group int, source_size long, target double, sure int, part double, blocks int, rows long",
    )
    d = d.join(plan.select("plan_source", "group", "source_size", "part", "blocks", "rows"), d["source"].eqNullSafe(F.col("plan_source")))
    tie = F.xxhash64(F.lit(seed), "doc_id", "size")
    outlier = (F.col("part") > 0) & (F.col("size") > F.col("source_size") * OUTLIER)
    large = d.filter(outlier).select("group", "size", tie.alias("tie"), "doc_id", "row", "source_size", "part", "rows")
    large = materialize(_outliers(large, seed), "mix-outliers")
    parts = large.filter("row is null").select("group", F.col("pi").alias("left_part"))
    units = (
        d.filter(~outlier)
        .join(parts, "group", "left")
        .withColumn("pi", F.coalesce("left_part", "part"))
        .select("doc_id", "source", "size", "row", "group", F.pmod(tie, F.col("blocks").cast("long")).cast("int").alias("block"), tie.alias("tie"), "pi")
    )
    outliers = d.filter(outlier).join(large.filter("row is not null").select("row", "extra"), "row")
    outliers = outliers.select("doc_id", "source", "size", "row", "group", F.lit(0).alias("block"), tie.alias("tie"), F.lit(0.0).alias("pi"), "extra")
    flown = materialize(_fly(units, seed, land=False), "mix-flown")
    decided = [outliers, flown.filter("extra is not null")]
    level = 0
    while True:
        open_units = flown.filter("extra is null").drop("extra")
        left = {r[0]: r[1] for r in open_units.groupBy("group").count().collect()}
        if not left:
            break
        level += 1
        last = max(left.values()) <= GATHER_ROWS
        blocks = max(1, max(left.values()) // BLOCK_ROWS)
        open_units = open_units.withColumn("block", F.lit(0) if last else F.pmod(F.xxhash64("tie"), F.lit(blocks)).cast("int"))
        flown = materialize(_fly(open_units, seed + level, land=last), f"mix-flown{level}")
        decided.append(flown.filter("extra is not null"))
        if last:
            break
    out = decided[0]
    for more in decided[1:]:
        out = out.unionAll(more)
    p = plan.select("group", "source_size", "target", "sure")
    copies = (F.col("sure") + F.col("extra")).cast("int")
    return out.join(F.broadcast(p) if len(order) <= 100_000 else p, "group").select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def resample(docs: DataFrame, seed: int = 7, id_col: str = "doc_id", **columns: str) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as ``mix`` takes it.

    Rows that repeat an id (or have none) share their copies: each is taken as often as the first of them.
    """
    copies = mix(docs, seed=seed, id_col=id_col, **columns).groupBy("doc_id").agg(F.max("copies").alias("copies")).filter("copies > 0")
    # as fields of one column the caller's names clash with none of these
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), F.col(f"`{id_col}`").alias("id"))
    out = d.join(copies, F.col("id").eqNullSafe(F.col("doc_id"))).select("d", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    return out.select(*(F.col("d").getField(c).alias(c) for c in docs.columns))
