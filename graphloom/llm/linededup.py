"""Near-duplicate lines by a deletion-neighbourhood join, in DataFrame functions only.

Every non-blank line is compared by its text without surrounding blanks. Of equal lines
the earliest stays, by document id and place. Of lines within one edit (a character
inserted, removed or replaced) the earliest stays too, if both have ``near_chars``
characters or more.

A line's deletion neighbourhood is emitted as hashed keys; lines that meet in a key are
within one edit, so only the earliest line of a key is joined back and no pair of a group
is ever formed. It is emitted where a match is possible, in three steps that lose none:

* one edit leaves the beginning or the end of a line as it was, so only lines that share
  either with a different line go on;
* an edit lies in one block of characters, so only blocks go on whose surroundings (the
  hash of all before, the hash of all after) two different lines share;
* of such a block every deletion of one character is emitted, under the hash of the
  surroundings and of what is left of the block.

The edit distance of a line and the one that displaces it is verified on the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import drop_scratch, materialize

#: Characters of a block of the deletion neighbourhood.
BLOCK = 64
#: The shared beginning or end of two near lines is cut at multiples of it.
STEP = 8
#: Rows of 16 bytes up to which a list of line hashes is broadcast; beyond, it is joined by shuffling.
BROADCAST_ROWS = 500_000


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def line_key(line: Column) -> list[Column]:
    """Two 64-bit hashes of a line."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def _end_keys(line: Column, n: Column) -> Column:
    """Hashes of the first and the last h characters, h being half the length rounded down to STEP.

    Lengths that differ by one have the same h, but for multiples of 2 * STEP, which take
    both.
    """
    h = (F.floor(n / (2 * STEP)) * STEP).cast("int")
    keys = lambda h: [
        F.xxhash64(F.lit("first"), h, F.substr(line, F.lit(1), h)),
        F.xxhash64(F.lit("last"), h, F.substr(line, n - h + 1)),
    ]
    return F.when(n % (2 * STEP) == 0, F.array(*keys(h), *keys(h - STEP))).otherwise(F.array(*keys(h)))


def _blocks(line: Column, n: Column) -> Column:
    """Structs ``(around, text, whole)`` for each block of a line.

    ``around`` hashes what stands before and after the block. With ``whole`` false, the block
    has ``BLOCK`` characters; deletions of one are to be emitted. With ``whole`` true it has
    one less, as a line one character longer would show it after a deletion.
    """

    def block(c: Column) -> Column:
        first = c * BLOCK
        before = F.xxhash64(F.substr(line, F.lit(1), first))
        return F.array(
            *(
                F.struct(
                    F.xxhash64(c, before, F.xxhash64(F.substr(line, first + size + 1))).alias("around"),
                    F.substr(line, first + 1, F.lit(size)).alias("text"),
                    F.lit(size != BLOCK).alias("whole"),
                    first.alias("first"),
                )
                for size in (BLOCK, BLOCK - 1)
            )
        )

    return F.flatten(F.transform(F.sequence(F.lit(0), F.floor(n / BLOCK).cast("int")), block))


def _variants(around: Column, text: Column, whole: Column, first: Column) -> Column:
    """Structs ``(key, at)``: a whole block at 0, or the block without one character, at its place."""
    cut = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))),
        lambda i: F.struct(
            F.xxhash64(around, F.concat(F.substr(text, F.lit(1), i - 1), F.substr(text, i + 1))).alias("key"),
            (first + i).alias("at"),
        ),
    )
    one = F.array(F.struct(F.xxhash64(around, text).alias("key"), F.lit(0).alias("at")))
    return F.when(whole, one).when(text != "", cut)


def _key(id_: Column, text: Column) -> list[Column]:
    """Tells rows apart and orders them: the id, nulls first, then a hash of the text for rows that share an id."""
    return [id_.alias("doc_id"), F.xxhash64(text).alias("h")]


def _lines(docs: DataFrame) -> DataFrame:
    return (
        docs.select("doc_id", "h", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .select("doc_id", "h", "pos", F.trim("line").alias("line"))
        .filter(F.col("line") != "")
    )


def _shared(keys: DataFrame, name: str) -> DataFrame:
    """The values of ``key`` that lines of different ``h1`` have."""
    both = keys.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a <> b")
    out = materialize(both.select("key"), name)
    return _bounded(out, out.count())


def kept_lines(
    docs: DataFrame, near_chars: int = 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, h, kept array<int>)``: places of the non-blank lines that stay, for documents that keep any; ``h`` as of ``_key``."""
    if near_chars < 2 * STEP + 1:
        raise ValueError(f"near_chars must be {2 * STEP + 1} or more")
    text = F.col(f"`{text_col}`")
    d = docs.select(*_key(F.col(f"`{id_col}`"), text), text.alias("text"))
    hashed = _lines(d).select("doc_id", "h", "pos", *line_key(F.col("line")))
    firsts = materialize(hashed.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "h", "pos")).alias("first")), "lines")
    beaten = _beaten(d, near_chars)
    stay = firsts.join(_bounded(beaten, beaten.count()), ["h1", "h2"], "left_anti")
    return stay.groupBy("first.doc_id", "first.h").agg(F.collect_list("first.pos").alias("kept"))


def _beaten(d: DataFrame, near_chars: int) -> DataFrame:
    """``(h1, h2)`` of the lines that have an earlier line within one edit."""
    n = F.length("line")
    long = _lines(d).filter(n >= near_chars)
    ends = long.select(F.xxhash64("line").alias("h1"), F.explode(_end_keys(F.col("line"), n)).alias("key"))
    shared = _shared(ends, "lines-ends")
    texts = (
        long.select("doc_id", "h", "pos", "line", F.explode(_end_keys(F.col("line"), n)).alias("end"))
        .join(shared.withColumnRenamed("key", "end"), "end", "left_semi")
        .select(*line_key(F.col("line")), "doc_id", "h", "pos", "line")
        .groupBy("h1", "h2")
        .agg(F.min(F.struct("doc_id", "h", "pos")).alias("first"), F.min("line").alias("line"))
    )
    texts = materialize(texts, "lines-text")
    who = F.struct("first", "h1", "h2").alias("who")
    blocks = texts.select("h1", who, n.alias("n"), F.explode(_blocks(F.col("line"), n)).alias("b"))
    blocks = blocks.select("h1", "who", "n", F.col("b.around").alias("key"), "b.text", "b.whole", "b.first")
    near = blocks.join(_shared(blocks, "lines-blocks"), "key", "left_semi")
    keys = near.select("who", "n", F.explode(_variants(F.col("key"), F.col("text"), F.col("whole"), F.col("first"))).alias("k"))
    keys = materialize(keys.select("who", "n", "k.key", "k.at"), "lines-keys")
    cut, whole = keys.filter("at > 0"), keys.filter("at = 0")
    least = F.min("who").alias("by")
    # equal without the character at one place; a longer line that becomes this one; a line that this one becomes
    replaced = cut.join(cut.groupBy("key", "at", "n").agg(least), ["key", "at", "n"])
    removed = cut.join(whole.groupBy("key", (F.col("n") + 1).alias("n")).agg(least), ["key", "n"])
    added = whole.join(cut.groupBy("key", (F.col("n") - 1).alias("n")).agg(least), ["key", "n"])
    by = replaced.select("who", "by").unionAll(removed.select("who", "by")).unionAll(added.select("who", "by"))
    by = by.filter("by.first < who.first").groupBy("who").agg(F.min("by").alias("by"))
    mine = texts.select("h1", "h2", "line")
    other = texts.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("line").alias("before"))
    out = (
        by.select("who.h1", "who.h2", F.col("by.h1").alias("b1"), F.col("by.h2").alias("b2"))
        .join(mine, ["h1", "h2"])
        .join(other, ["b1", "b2"])
        .filter(F.levenshtein("line", "before", 1) >= 0)
        .select("h1", "h2")
    )
    out = materialize(out, "lines-beaten")
    drop_scratch(keys, texts)
    return out


def dedup_lines(
    docs: DataFrame,
    near_chars: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    count_cols: tuple[str, str] = ("n_lines", "n_kept"),
) -> DataFrame:
    """``docs`` with the text of ``text_col`` replaced, and ``count_cols``: non-blank lines before and after.

    A repeated line goes, whichever document has it, unless it is the earliest by
    (document id, place); null ids come first. A near line goes if one within one edit is
    earlier; whether that one stays itself does not matter. Blank lines always stay. Null
    text stays null, with no lines. A document may end up with no line: its text then has
    no more than blank lines. Rows that share an id (or have none) are documents of their own,
    in the order of a hash of their texts; of rows equal in both, one comes first. Columns of
    ``docs`` stay; one that is called as a count is replaced. No rows: no rows.
    """
    kept = kept_lines(docs, near_chars, id_col, text_col)
    names = [c for c in docs.columns if c not in count_cols]
    # as fields of one column the caller's names clash with none of these
    key = F.struct(*_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))).alias("key")
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("d"), key)
    d = d.join(kept.select(F.struct("doc_id", "h").alias("key"), "kept"), "key", "left")
    equal = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    d = d.select("d", F.when(equal == 1, F.col("kept")).alias("kept"))
    text = F.col("d").getField(text_col)
    split = F.split(text, "\n")
    places = F.coalesce(F.col("kept"), F.array().cast("array<int>"))

    def stay(lines: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(lines) - 1)
        blank = F.filter(every, lambda i: F.trim(F.get(lines, i)) == "")
        at = F.sort_array(F.concat(blank, F.array_intersect(places, every)))
        return F.transform(at, lambda i: F.get(lines, i))

    left = F.flatten(F.transform(F.array(split), stay))
    some = lambda a: F.coalesce(F.size(F.filter(a, lambda x: F.trim(x) != "")), F.lit(0)).cast("long")
    others = [F.when(text.isNotNull(), F.array_join(left, "\n")).alias(c) if c == text_col else F.col("d").getField(c).alias(c) for c in names]
    count = lambda a: F.when(text.isNull(), 0).otherwise(some(a)).cast("long")
    return d.select(*others, count(split).alias(count_cols[0]), count(left).alias(count_cols[1]))
