"""Retrieval metrics, benchmark hygiene and failure taxonomy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.scratch import cut

# Titles of bookkeeping changes. Narrow on purpose: a title that says what is to be done stays.
BOOKKEEPING = r"(?iU)^\s*(?:revert\b|merge\s+(?:branch|remote)\b|\[release\]|release:\s)|develop\s*(?:→|->)\s*(?:stage|stg|main|master)"
MIN_TITLE = 15


def retrieval_metrics(ranked: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """``(queries, r_at_1, r_at_k, mrr)`` of ``ranked(query_id, rank, key)`` against ``truth(query_id, key)``; a query without a hit counts 0."""
    hit = ranked.join(truth.distinct(), ["query_id", "key"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first"))
    q = truth.select("query_id").distinct().join(hit, "query_id", "left")
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return q.agg(
        F.count(F.lit(1)).alias("queries"),
        share(F.col("first") <= 1).alias("r_at_1"),
        share(F.col("first") <= k).alias(f"r_at_{k}"),
        F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"),
    )


def holders(docs: DataFrame, heads: DataFrame, most: int = 200_000) -> DataFrame:
    """``(query_id, id)``: the documents ``(id, text)`` that contain a ``head`` of ``(query_id, head)``.

    A text that contains a head has every word that stands inside it between blanks, so the longest
    of them is looked up first; only texts that have it are searched. Heads without such a word
    are searched in all texts. Up to ``most`` words are broadcast, more are joined by shuffling.
    """
    inner = F.split("head", "[ \n]+")
    inner = F.slice(inner, 2, F.greatest(F.size(inner) - 2, F.lit(0)))
    anchor = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    h = cut(heads.filter("head <> ''").select("query_id", "head", anchor.alias("word")), "heads")
    words = h.filter("word is not null").select("word").distinct()
    words = F.broadcast(words) if h.count() <= most else words
    have = docs.select("id", F.explode(F.array_distinct(F.split("text", "[ \n]+"))).alias("word")).join(words, "word", "left_semi")
    found = have.join(h, "word").join(docs, "id").filter(F.contains("text", F.col("head"))).select("query_id", "id")
    rest = h.filter("word is null")
    if not rest.isEmpty():
        found = found.unionAll(docs.join(rest, F.contains("text", F.col("head"))).select("query_id", "id"))
    return found


def coverage(found: DataFrame, truth: DataFrame) -> DataFrame:
    """``(mean_recall, fully_covered)`` of ``found(query_id, files)`` against ``truth(query_id, files)``."""
    both = truth.select("query_id", F.col("files").alias("want")).join(found.select("query_id", "files"), "query_id", "left")
    got = F.size(F.array_intersect("want", F.coalesce("files", F.array().cast("array<string>"))))
    r = both.select((got / F.size(F.array_distinct("want"))).alias("r"))
    return r.agg(F.avg("r").alias("mean_recall"), F.avg((F.col("r") >= 1).cast("double")).alias("fully_covered"))


def exclusion(title: Column, ambiguous: Column, indexed: Column, expanded: Column) -> Column:
    """Why a case is left out: the first rule that holds; null if none does.

    In this order: a bookkeeping title, a short one (blanks count), one that stands for several
    sets of files, files that are all unknown, a request without expansion or vector.
    """
    return (
        F.when(title.rlike(BOOKKEEPING), "bookkeeping")
        .when(F.length(title) < MIN_TITLE, "short")
        .when(ambiguous, "ambiguous")
        .when(~indexed, "unindexed")
        .when(~expanded, "unexpanded")
    )


def stale_repos(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """``(repo, recorded, current, stale, no_head)`` of two ``(repo, head)`` tables: heads of 12 digits; unknown now is not stale."""
    cut = lambda c: F.substring(F.coalesce(c, F.lit("")), 1, 12)
    both = recorded.select("repo", F.col("head").alias("a")).join(current.select("repo", F.col("head").alias("b")), "repo", "left")
    both = both.select("repo", cut(F.col("a")).alias("recorded"), cut(F.col("b")).alias("current"))
    return both.select("*", ((F.col("current") != "") & (F.col("recorded") != F.col("current"))).alias("stale"), (F.col("recorded") == "").alias("no_head"))


def ambiguous_titles(cases: DataFrame) -> DataFrame:
    """``(title, n)``: titles that stand for more than one set of files."""
    return cases.groupBy("title").agg(F.count_distinct(F.array_sort("files")).alias("n")).filter("n > 1")


def regression_verdict(checks: DataFrame, by: str) -> DataFrame:
    """``(by, verdict)`` of ``checks(by, status)``: failed, else unverified, else partial or verified, else none."""
    is_ = lambda s: F.bool_or(F.col("status") == s)
    return checks.groupBy(by).agg(
        F.when(is_("failed"), "failed")
        .when(is_("unverified"), "unverified")
        .when(is_("passed") & is_("skipped"), "partial")
        .when(is_("passed"), "verified")
        .otherwise("none")
        .alias("verdict")
    )


def failure_taxonomy(failures: DataFrame) -> DataFrame:
    """``(area, n, not_found, hint_right)`` of ``failures(path, rank, hint_ok)`` by the first segment of the path."""
    area = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise("root")
    return failures.groupBy(area.alias("area")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("rank").isNull()).alias("not_found"), F.count_if(F.col("hint_ok")).alias("hint_right")
    )


def ghost_calls(names: DataFrame) -> DataFrame:
    """``(raw, clean, ghosts)`` of ``names(id, raw, clean)``: call names that vanish once strings and comments are stripped."""
    r = names.select(F.size(F.array_distinct("raw")).alias("r"), F.size(F.array_distinct("clean")).alias("c"), F.size(F.array_except("raw", "clean")).alias("g"))
    return r.agg(F.sum("r").alias("raw"), F.sum("c").alias("clean"), F.sum("g").alias("ghosts"))


def symbol_accuracy(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """``(checked, right)``: symbols whose name stands in the line they point to, of ``lines(repo, path, line, text)``."""
    s = nodes.filter(F.col("kind").isin("function", "class") & (F.col("line") > 0)).join(lines, ["repo", "path", "line"])
    last = F.element_at(F.split("name", "[.:]+"), -1)
    return s.agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("text").contains(last)).alias("right"))
