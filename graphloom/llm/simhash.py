"""Near-duplicate documents by SimHash.

Fingerprints that occur are compared once each, however many documents share one. A
fingerprint is embedded as the bit counts of its 32 two-bit segments. The Manhattan
distance of two such embeddings never exceeds the number of differing bits, so pairs
within three bits lie within Manhattan distance three, and in one half of the segments
within one. A grid range-join over each half (a cell and its neighbours at distance one)
therefore meets every such pair; the bits themselves are compared in the join.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import connected_components, drop_scratch, give_back_memory, materialize

#: Shingles hashed and counted at once.
CHUNK = 1 << 16
#: Largest number of differing bits that the halves of the embedding can promise to find.
MAX_BITS = 3


def _hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles in their order, repeats included, ``CHUNK`` at a time; none without words."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return
    size = min(words, len(w))
    total = len(w) - size + 1
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, total, CHUNK):
        n = min(CHUNK, total - at)
        yield np.array([digest(join(s), 42) for s in zip(*(w[at + k : at + k + n] for k in range(size)))], "<u8")


def _fingerprint(parts: Iterable[np.ndarray]) -> int:
    ones, total = np.zeros(64, np.int64), 0
    for h in parts:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += len(h)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprint_text(text: str | None, words: int) -> int:
    """The unsigned 64-bit SimHash of a whole text; 0 without words.

    A-Z is lower-cased; words are runs of anything but ASCII white space; shingles are
    ``words`` words (all of a shorter text) and count as often as they occur.
    """
    return _fingerprint(_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp long)``, one row per row of ``docs``; null text counts as empty."""
    import pyarrow as pa

    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([T.StructField("doc_id", d.schema["doc_id"].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [fingerprint_text(x.as_py(), words) for x in b.column(1)]
            fps = pa.array(np.array(got, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fps], names=["doc_id", "fp"])

    return d.mapInArrow(run, schema)


def segment_counts(half: Column) -> Column:
    """Bit counts of the 16 two-bit segments of a 32-bit value, two bits each, packed in place."""
    return half - F.shiftright(half, 1).bitwiseAND(F.lit(0x55555555).cast("long"))


def links(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """``(src, dst)`` for every pair of distinct values of ``fp`` within ``max_bits`` differing bits.

    ``fps`` must hold each value once. A pair may come twice. Pairs between documents of
    equal fingerprint are not emitted.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"max_bits must be 0 to {MAX_BITS}")
    low = F.lit(0xFFFFFFFF).cast("long")
    halves = F.array(
        F.struct(F.lit(0).alias("half"), segment_counts(F.col("fp").bitwiseAND(low)).alias("cell")),
        F.struct(F.lit(1).alias("half"), segment_counts(F.shiftrightunsigned("fp", 32)).alias("cell")),
    )
    cells = fps.select("fp", F.explode(halves).alias("h")).select("fp", "h.half", "h.cell")
    steps = []
    for i in range(16):
        one = F.lit(1 << (2 * i)).cast("long")
        count = F.shiftright("cell", 2 * i).bitwiseAND(F.lit(3).cast("long"))
        steps.append(F.when(count < 2, F.col("cell") + one))
        steps.append(F.when(count > 0, F.col("cell") - one))
    near = cells.select("fp", "half", F.explode(F.array(F.col("cell"), *steps)).alias("cell")).filter(
        F.col("cell").isNotNull()
    )
    a, b = near.alias("a"), cells.alias("b")
    on = (
        (F.col("a.half") == F.col("b.half"))
        & (F.col("a.cell") == F.col("b.cell"))
        & (F.col("a.fp") < F.col("b.fp"))
        & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits)
    )
    return a.join(b, on).select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst"))


def _components(d: DataFrame, max_bits: int) -> DataFrame:
    """``(fp, component_id)`` of every value of ``fp`` in ``d(doc_id, fp)``: the smallest ``doc_id`` that links of fingerprints reach."""
    distinct = materialize(d.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-values")
    roots = connected_components(links(distinct.select("fp"), max_bits))
    near = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = near.groupBy("root").agg(F.min("first").alias("component_id"))
    return near.join(least, "root").select("fp", "component_id")


def near_duplicates(
    docs: DataFrame, words: int = 5, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, fp, component_id)``: documents link when their fingerprints differ in at most ``max_bits`` bits.

    ``component_id`` is the smallest document id reachable over links, the document's own
    included. Every row of ``docs`` returns one row, repeated rows too. Null and empty texts
    share fingerprint zero, which links like any other. Null ids are kept and never become
    a component's id unless it has no other. Other columns are ignored. No rows: no rows.
    """
    d = materialize(fingerprints(docs, words, id_col, text_col), "simhash")
    return d.join(_components(d, max_bits), "fp").select("doc_id", "fp", "component_id")


def digest(near: DataFrame) -> DataFrame:
    """The columns of the SimHash query."""
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Documents of a given similarity. Fingerprints group texts first, by the grid join above, and the exact
# similarity decides. Three bits of 64 mean nearly equal texts; for what they leave apart the shingle sets
# themselves are joined, exactly: of two sets that are alike enough, the first shingles in any order
# common to all sets share at least one.

#: Texts, in expectation, whose shingles say which are common. They set an order, never a result.
ORDER_TEXTS = 20_000
#: Common shingles that are put last in the order, at most; the order of the others is their hash.
ORDER_SHINGLES = 200_000
#: Texts of a shingle outside its largest group from which they are a crowd, and the texts of each that
#: all others meet. They set how links are found, never which.
CROWD, CROWD_HEADS = 200, 8
#: Longs of a set's bitmap.
BITMAP = 8
#: How many shingles two sets must share at their beginnings, between one (0, the shortest beginnings) and as
#: many as all first shingles promise (1). It sets how many pairs are looked at, never which links are found.
DEPTH = 0.5
#: Numbers of removed rows (8 bytes each) up to which they are broadcast; beyond, they are joined by shuffling.
BROADCAST_ROWS = 500_000


def shingles(text: str | None, words: int) -> np.ndarray:
    """The set of 64-bit hashes of a text's shingles, sorted; words and shingles as in ``fingerprint_text``."""
    return _set_of([np.unique(h) for h in _hashes(text, words)])


def _set_of(parts: list[np.ndarray]) -> np.ndarray:
    if not parts:
        return np.zeros(0, np.uint64)
    return np.unique(parts[0] if len(parts) == 1 else np.concatenate(parts))


def first_shingles(found: np.ndarray, similarity: float, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first of a set's shingles: rare before common, then by hash; so many that a set of this similarity has one of them among its own first."""
    n = len(found)
    keep = min(n, n - math.ceil(similarity * n - 1e-9) + 1)
    if len(common) and n:
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        order = np.where(common[at] == found, rank[at], 0)
        return found[np.lexsort((found, order))[:keep]]
    return found[:keep]


def bitmap(found: np.ndarray) -> np.ndarray:
    """Whether an odd number of a set's shingles fall on each of 64 ``BITMAP`` places, as longs.

    Two sets differ in at least as many shingles as their bitmaps in bits.
    """
    odd = np.bincount((found % np.uint64(64 * BITMAP)).astype(np.int64), minlength=64 * BITMAP) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _common_shingles(docs: DataFrame, words: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of the texts shares, sorted, and their counts."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(x.as_py(), words).view(np.int64))], names=["h"])

    some = docs.sample(fraction=min(1.0, ORDER_TEXTS / max(rows, 1)), seed=17)
    counts = some.select("text").mapInArrow(run, "h bigint").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 2")
    got = counts.orderBy(F.desc("n"), "h").limit(ORDER_SHINGLES).toArrow()
    h, n = got["h"].to_numpy().view(np.uint64), got["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _shingled(docs: DataFrame, words: int, similarity: float, rows: int) -> DataFrame:
    """``docs(doc_id, text, rest)`` with ``(h1, h2, n, firsts, bits, fp, row)``: two hashes of the set of shingles, its size, first shingles and bitmap, the fingerprint, a number of the row."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(_common_shingles(docs, words, rows))
    own = [T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("firsts", T.ArrayType(T.LongType())), T.StructField("bits", T.ArrayType(T.LongType())), T.StructField("fp", T.LongType())]
    schema = T.StructType([*docs.schema, *own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, rank = shared.value
        for b in batches:
            h1, h2, size, firsts, bits, fp = [], [], [], [], [], []
            for x in b.column(1):
                parts = list(_hashes(x.as_py(), words))
                fp.append(_fingerprint(parts))
                found = _set_of(parts)
                h1.append(xxhash.xxh64_intdigest(found.tobytes(), 42))
                h2.append(xxhash.xxh64_intdigest(found.tobytes(), 43))
                size.append(len(found))
                firsts.append(first_shingles(found, similarity, common, rank).view(np.int64))
                bits.append(bitmap(found))
            signed = lambda h: pa.array(np.array(h, np.uint64).view(np.int64))
            columns = [*b.columns, signed(h1), signed(h2), pa.array(size, pa.int32()), pa.array(firsts, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64())), signed(fp)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        give_back_memory()

    return docs.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())


def _alike(pairs: DataFrame, d: DataFrame, words: int, similarity: float) -> DataFrame:
    """``(src, dst)`` of the pairs of rows whose sets of shingles have the Jaccard similarity, computed from the texts."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([shingles(x.as_py(), words).view(np.int64) for x in b.column(1)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), found], names=["row", "found"])

    ends = pairs.select(F.col("src").alias("row")).unionAll(pairs.select(F.col("dst").alias("row"))).distinct()
    sets = materialize(d.select("row", "text").join(ends, "row", "left_semi").mapInArrow(run, "row bigint, found array<bigint>"), "similar-sets")
    a, b = sets.select(F.col("row").alias("src"), F.col("found").alias("fa")), sets.select(F.col("row").alias("dst"), F.col("found").alias("fb"))
    both = F.size(F.array_intersect("fa", "fb"))
    out = pairs.join(a, "src").join(b, "dst").filter(both / (F.size("fa") + F.size("fb") - both) >= similarity).select("src", "dst")
    out = materialize(out, "similar-links")
    drop_scratch(pairs, sets)
    return out


def _roots(d: DataFrame, words: int, similarity: float) -> DataFrame:
    """``(h1, h2, root)`` of every set of shingles in ``d``: the smallest row that links lead to."""
    texts = d.groupBy("h1", "h2").agg(
        F.min("row").alias("row"), F.any_value("n").alias("n"), F.any_value("firsts").alias("firsts"), F.any_value("bits").alias("bits"),
        F.min("fp").alias("fp"),
    )
    texts = materialize(texts, "similar-texts")
    # texts whose fingerprints lie within a few bits, or are joined by such, meet the first of their group
    grouped = texts.select("row", "fp").join(_components(texts.select(F.col("row").alias("doc_id"), "fp"), MAX_BITS), "fp")
    grouped = grouped.filter("row <> component_id").select(F.col("component_id").alias("src"), F.col("row").alias("dst"))
    alike = _alike(materialize(grouped, "similar-fingerprints"), d, words, similarity)
    dealt = texts.select(F.posexplode("firsts").alias("i", "h"), "row", "n")
    # most shingles are one text's alone; only the others are dealt out with their texts
    often = dealt.groupBy("h").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    shared = materialize(dealt.join(often, "h", "left_semi"), "similar-shared")
    heads = shared.groupBy("h").agg(F.min(F.struct("row", "n")).alias("head"))

    def pairs(a: Column, an: Column, b: Column, bn: Column) -> list[Column]:
        return [F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), F.least(an, bn).alias("lo"), F.greatest(an, bn).alias("hi")]

    def least_shared(an: Column, bn: Column, depth: float) -> tuple[Column, Column]:
        """How many shingles two sets of the similarity share, and how many of these their beginnings do, if each leaves out as many as the others less one.

        All first shingles are such beginnings for the largest number of the second kind, ``depth`` 1.
        """
        whole = F.ceil(similarity / (1 + similarity) * (an + bn) - 1e-9)
        most = whole - F.ceil(similarity * F.greatest(an, bn) - 1e-9)
        return whole, 1 + F.floor(most * depth)

    sizes = F.col("lo") >= similarity * F.col("hi") - 1e-9
    near = lambda p, depth: (
        p.filter(sizes).groupBy("src", "dst", "lo", "hi").agg(F.count(F.lit(1)).alias("k"))
        .filter(F.col("k") >= least_shared(F.col("lo"), F.col("hi"), depth)[1]).select("src", "dst")
    )
    stars = shared.join(heads, "h").filter(F.col("row") != F.col("head.row")).select(pairs(F.col("row"), F.col("n"), F.col("head.row"), F.col("head.n")))
    stars = near(stars, 1).join(alike, ["src", "dst"], "left_anti")
    found = alike.unionAll(_alike(materialize(stars, "similar-stars"), d, words, similarity))

    def mixed_groups(of: DataFrame) -> DataFrame:
        """The rows ``(h, i, row, n)`` of shingles whose texts no links join yet, with the root of most of them."""
        roots = connected_components(found).withColumnRenamed("node", "row")
        placed = materialize(of.join(roots, "row", "left").select("h", "i", "row", "n", F.coalesce("root", "row").alias("root")), "similar-placed")
        each = placed.groupBy("h", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("h")
        each = each.agg(F.max(F.struct("k", "root"))["root"].alias("top"), F.sum("k").alias("k"), F.max("k").alias("most"), F.count(F.lit(1)).alias("roots"))
        out = materialize(placed.join(each.filter("roots > 1").select("h", "top", (F.col("k") - F.col("most")).alias("outside")), "h"), "similar-mixed")
        drop_scratch(placed)
        return out

    mixed = mixed_groups(shared)
    drop_scratch(shared)
    # a crowd of near copies that one text does not join: its texts meet a few others first
    crowd = materialize(mixed.filter(F.col("outside") >= CROWD).select("h", "i", "row", "n", "root"), "similar-crowd")
    place = F.row_number().over(Window.partitionBy("h").orderBy(F.xxhash64("row")))
    some = crowd.withColumn("place", place).filter(F.col("place") <= CROWD_HEADS).select("h", F.col("row").alias("r"), F.col("n").alias("m"), F.col("root").alias("s"))
    met = crowd.join(some, "h").filter((F.col("root") != F.col("s")) & (F.least("n", "m") >= similarity * F.greatest("n", "m") - 1e-9))
    met = materialize(met.select(F.least("row", "r").alias("src"), F.greatest("row", "r").alias("dst")).distinct(), "similar-met")
    found = found.unionAll(_alike(met, d, words, similarity))
    crowd = mixed_groups(crowd.select("h", "i", "row", "n"))
    # the others meet at the beginnings of their sets, where their bitmaps leave the similarity possible
    left = mixed.filter(F.col("outside") < CROWD).unionByName(crowd)
    left = left.select("h", "i", "row", "n", "root", (F.col("root") == F.col("top")).alias("in_top")).join(texts.select("row", "bits"), "row")
    a, b = left.alias("a"), left.alias("b")
    an, bn = F.col("a.n"), F.col("b.n")
    whole, begun = least_shared(an, bn, DEPTH)
    differ = F.lit(0)
    for i in range(BITMAP):
        differ = differ + F.bit_count(F.get("a.bits", F.lit(i)).bitwiseXOR(F.get("b.bits", F.lit(i))))
    on = (
        (F.col("a.h") == F.col("b.h"))
        & (F.col("a.root") != F.col("b.root"))
        & ~F.col("a.in_top")
        & (F.col("b.in_top") | (F.col("a.row") < F.col("b.row")))
        & (F.least(an, bn) >= similarity * F.greatest(an, bn) - 1e-9)
        & (F.col("a.i") + whole - begun < an)
        & (F.col("b.i") + whole - begun < bn)
        & (differ <= an + bn - 2 * whole)
    )
    others = materialize(near(a.join(b, on).select(pairs(F.col("a.row"), an, F.col("b.row"), bn)), DEPTH), "similar-others")
    drop_scratch(mixed, crowd)
    roots = connected_components(found.unionAll(_alike(others, d, words, similarity)))
    return texts.join(roots, F.col("row") == F.col("node"), "left").select("h1", "h2", F.coalesce("root", "row").alias("root"))


def similar_documents(
    docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, component_id)``: documents link when the Jaccard similarity of their sets of shingles is ``similarity`` or more.

    Exact at any size of input: every pair of that similarity is met or already linked by
    others, and every link is decided on the whole sets. Equal sets are one text. Fingerprints
    are grouped as in ``near_duplicates``, and every text is compared with the first of its group.
    For pairs further apart: two sets that are alike enough share one of their first shingles
    (about a fifth of a set for 0.8), in an order that puts the common ones last, so a passage of
    many texts brings few of them together. Texts are compared with one text of each of their
    first shingles, in crowds with a few more; then only pairs that no link joins yet are met, each
    text outside the largest group of a shingle with the others. So a group of near copies does not
    cost the square of its size. Pairs that share too few shingles at the beginnings of their sets
    to reach the similarity, or whose bitmaps differ in too many bits, are not compared.

    Null and empty texts are alike. Every row returns one row; null ids are kept. Other
    columns are ignored. No rows: no rows.
    """
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    d = materialize(_shingled(docs, words, similarity, docs.count()), "similar")
    of = d.select("doc_id", "h1", "h2").join(_roots(d, words, similarity), ["h1", "h2"])
    of = materialize(of.select("doc_id", "root"), "similar-of")
    drop_scratch(d)
    return of.join(of.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "component_id")


def drop_similar(
    docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with one row of each group of ``similar_documents``, all its columns as they are.

    The row with the smallest id stays; a row with an id goes before one without, and of rows that
    share the id one stays.
    """
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    others = F.struct(*(F.col(f"`{c}`") for c in rest)) if rest else F.lit(True)
    docs_ = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), others.alias("rest"))
    d = materialize(_shingled(docs_, words, similarity, docs.count()), "similar")
    of = d.select("doc_id", "row", "h1", "h2").join(_roots(d, words, similarity), ["h1", "h2"])
    of = materialize(of.select("doc_id", "row", "root"), "similar-of")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    several = of.groupBy("root").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    gone = materialize(of.join(several, "root").filter(F.col("row") != F.col("first.row")).select("row"), "similar-gone")
    out = d.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, "row", "left_anti")
    kept = {id_col: F.col("doc_id"), text_col: F.col("text")}
    return out.select(*(kept.get(c, F.col("rest").getField(c) if rest else None).alias(c) for c in docs.columns))
