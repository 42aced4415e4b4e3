"""Document fingerprints: a threshold-scaled sketch of shingle hashes, in DataFrame functions only.

Of all distinct shingle hashes of a text, those below a fixed fraction of the hash range are
kept, and no others. So the sketch grows with the text, the union of two sketches is the sketch
of the two texts together, and sketches of very unequal texts can be compared: the share of the
smaller one's hashes that the other has estimates how much of the smaller text the other contains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import WORD_GAP, text_of

#: One hash in so many is kept.
SCALE = 4
#: Rows of a bucket of neighbouring ids, on average.
BUCKET_ROWS = 500
#: Bounds of buckets, about, beyond which buckets grow instead; 16 bytes each go to every task.
MOST_BUCKETS = 500_000


def _limit(scale: int) -> int:
    """Hashes below it are kept; longs, counted from the smallest one."""
    return -(2**63) + 2**64 // scale


def sketch(text: Column, words: int = 5, scale: int = SCALE) -> Column:
    """Sorted distinct shingle hashes, as longs: those in the lowest 1/scale of the range.

    The text is lower-cased; words are runs of anything but ASCII white space; shingles are
    ``words`` words, all of a shorter text. No words (or null): an empty array, as for a short
    text of which no hash falls below the limit. A shingle's hash is the hash of its words' hashes.
    """
    parts = F.filter(F.split(F.lower(text_of(text)), WORD_GAP), lambda w: w != "")

    def shingles(h: Column) -> Column:
        last = F.greatest(F.size(h) - words, F.lit(0))
        # beyond the end of a short text stands null, which a hash leaves out
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(words))))

    hashed = F.transform(parts, lambda w: F.xxhash64(w))
    every = F.flatten(F.transform(F.filter(F.array(hashed), lambda h: F.size(h) > 0), shingles))
    return F.sort_array(F.array_distinct(F.filter(every, lambda h: h < F.lit(_limit(scale)))))


def merge(a: Column, b: Column) -> Column:
    """The sketch of two texts' shingles together."""
    return F.sort_array(F.array_union(a, b))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the smaller text's shingles found in the other: 0 to 1; 0 where a sketch is empty and tells nothing."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0).cast("double")


def jaccard(a: Column, b: Column) -> Column:
    """Estimated share of common shingles among all; 0 where both sketches are empty."""
    every = F.size(F.array_union(a, b))
    return F.when(every > 0, F.size(F.array_intersect(a, b)) / every).otherwise(0.0).cast("double")


def to_hex(s: Column) -> Column:
    """A sketch as text: 16 hex digits a hash, in order."""
    return F.array_join(F.transform(s, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def fingerprint(
    docs: DataFrame, words: int = 5, scale: int = SCALE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, sketch)`` of every row; null text counts as empty. No rows: no rows."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), sketch(F.col(f"`{text_col}`"), words, scale).alias("sketch"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, h, text, bucket, turn)`` laid out so that a window over ``bucket`` sees each document's successor.

    Rows are ordered by (id, hash of the text, text), null ids first, so rows that share an id
    are spread too. Buckets are ranges of that order of about ``BUCKET_ROWS`` rows; their bounds
    are the first row and a share of the rows that a hash picks. The first row of a bucket is
    also dealt, as a guest, to the bucket before it (of the first bucket: to the last one).
    ``turn`` is 0 for own rows, 1 for guests.
    """
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(F.col(f"`{text_col}`")).alias("text")).withColumn("h", F.xxhash64("text"))
    key = F.struct(F.col("doc_id").alias("d"), F.col("h"))
    each = max(BUCKET_ROWS, docs.count() // MOST_BUCKETS)
    picked = F.when(F.pmod(F.xxhash64(F.lit(3), "doc_id", "h"), F.lit(each)) == 0, key)
    bounds = F.array_sort(F.array_union(F.collect_set(picked), F.array(F.min(key))))
    bounds = d.agg(F.count(F.lit(1)).alias("n"), bounds.alias("b")).select(F.when(F.col("n") > 0, F.to_json("b")), F.when(F.col("n") > 0, F.size("b"))).first()
    many = bounds[1] or 0
    bounds = F.from_json(F.lit(bounds[0] or "[]"), f"array<struct<d:{d.schema['doc_id'].dataType.simpleString()},h:bigint>>")
    steps = [1 << k for k in range(max(many, 1).bit_length() - 1, -1, -1)]
    # the place of the last bound not above a row, by halving
    place = F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(-1),
        lambda at, s: F.when((at + s < many) & (F.get(bounds, at + s) <= key), at + s).otherwise(at),
    )
    d = d.withColumn("bucket", place)
    before = F.when(F.get(bounds, F.col("bucket")) == key, F.when(F.col("bucket") == 0, many - 1).otherwise(F.col("bucket") - 1))
    both = F.filter(
        F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("t")), F.struct(before.alias("b"), F.lit(1).alias("t"))),
        lambda s: s["b"].isNotNull(),
    )
    return d.select("doc_id", "h", "text", F.explode(both).alias("s")).select("doc_id", "h", "text", F.col("s.b").alias("bucket"), F.col("s.t").alias("turn"))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: dict[str, Column] | None = None) -> DataFrame:
    """``(doc_id, text, edited, next)``: each text, the text with its last quarter replaced, the next document's text.

    The last floor(n/4) code points give way to the first as many (or all) of the next
    document's, in ascending order of ids (ties by a hash of the text; null ids first); the first
    document follows the last. A single document follows itself. Null text: empty. ``also`` holds
    columns made of ``text``; each comes with ``next_`` and its name for the next document.
    """
    also = also or {}
    # what a text costs is paid once it lies in its bucket, so no more is shuffled than texts
    t = with_next(docs, id_col, text_col).repartition("bucket").withColumns(also)
    order = Window.partitionBy("bucket").orderBy("turn", "doc_id", "h", "text")
    t = t.withColumns({"next": F.lead("text").over(order), **{f"next_{c}": F.lead(c).over(order) for c in also}}).filter("turn = 0")
    n = F.length("text")
    k = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr(F.col("text"), F.lit(1), n - k), F.substr(F.col("next"), F.lit(1), k))
    return t.select("doc_id", "text", edited.alias("edited"), "next", *also, *(f"next_{c}" for c in also))


def edited_likeness(
    docs: DataFrame, words: int = 5, scale: int = SCALE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The columns of the fingerprint query: every document against its edited text and the next document.

    ``near_edited`` and ``near_next`` are containments of sketches, 1 for equal texts. Equal
    texts have equal fingerprints. Repeated rows and repeated or null ids stay. Other columns are
    ignored. No rows: no rows.
    """
    t = edited_pairs(docs, id_col, text_col, {"s": sketch(F.col("text"), words, scale)})
    t = t.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        (F.col("text") == F.col("edited")).alias("same"),
        (F.col("text") == F.col("next")).alias("same_next"),
        "s",
        "next_s",
        # as an element of an array the edited text's sketch is made once, however often it is read
        F.transform(F.array("edited"), lambda x: sketch(x, words, scale))[0].alias("e"),
    )
    return t.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.transform(
            F.array(F.struct("s", "e", "next_s")),
            lambda x: F.struct(
                to_hex(x["s"]).alias("fingerprint"),
                to_hex(x["e"]).alias("edited_fingerprint"),
                F.when(F.col("same"), 1.0).otherwise(containment(x["s"], x["e"])).alias("near_edited"),
                F.when(F.col("same_next"), 1.0).otherwise(containment(x["s"], x["next_s"])).alias("near_next"),
            ),
        )[0].alias("r"),
    ).select("doc_id", "n_chars", "edited_sha256", "r.*")
