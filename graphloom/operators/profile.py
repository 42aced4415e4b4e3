"""Profiles mined from the graph and its texts: repository profiles, lexicons, companions, references, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import tokenize


def top_per_group(counts: DataFrame, group: list[str], n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each group; Spark cuts each task's rows to n before it deals them out."""
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("place") <= n)


def repo_profile(nodes: DataFrame, n: int = 6) -> DataFrame:
    """``(repo, nodes, folders, names)``: size, the commonest folders of two levels and symbol names of four letters or more."""
    size = nodes.groupBy("repo").agg(F.count(F.lit(1)).alias("nodes"))

    def commonest(values: DataFrame, name: str) -> DataFrame:
        c = values.groupBy("repo", "value").agg(F.count(F.lit(1)).alias("c"))
        top = top_per_group(c, ["repo"], n, F.desc("c"), F.asc("value"))
        return top.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("l")).select("repo", F.transform("l", lambda x: x["value"]).alias(name))

    parts = F.split("path", "/")
    folders = nodes.filter(F.col("path").contains("/")).select("repo", F.array_join(F.slice(parts, 1, F.least(F.lit(2), F.size(parts) - 1)), "/").alias("value"))
    names = nodes.filter(F.col("kind").isin("function", "class") & (F.length("name") > 3)).select("repo", F.col("name").alias("value"))
    return size.join(commonest(folders, "folders"), "repo", "left").join(commonest(names, "names"), "repo", "left")


def lexicon(pairs: DataFrame, least: int = 3) -> DataFrame:
    """``(word, term, n, pmi)`` of ``pairs(id, words, terms)``: pointwise mutual information of what stands together.

    Distinct words and terms of a row are paired; pairs in ``least`` rows or more with a
    positive value stay.
    """
    p = pairs.select("id", F.array_distinct("words").alias("words"), F.array_distinct("terms").alias("terms")).filter("size(words) > 0 and size(terms) > 0")
    w, t = p.select("id", F.explode("words").alias("word"), "terms"), p.select(F.explode("terms").alias("term"))
    both = w.select("word", F.explode("terms").alias("term")).groupBy("word", "term").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    by_word = w.groupBy("word").agg(F.count(F.lit(1)).alias("nw"))
    by_term = t.groupBy("term").agg(F.count(F.lit(1)).alias("nt"))
    rows = p.agg(F.count(F.lit(1)).alias("rows"))
    pmi = F.log(F.col("n") * F.col("rows") / (F.col("nw") * F.col("nt")))
    out = both.join(by_word, "word").join(by_term, "term").crossJoin(F.broadcast(rows))
    return out.select("word", "term", "n", pmi.alias("pmi")).filter("pmi > 0")


def bridge(tokens: DataFrame, learned: DataFrame, per_word: int = 1) -> DataFrame:
    """``(query_id, tokens)`` with the best learned terms of each word added, in order and without repeats."""
    best = top_per_group(learned, ["word"], per_word, F.desc("pmi"), F.asc("term")).groupBy("word").agg(F.array_sort(F.collect_list("term")).alias("more"))
    t = tokens.select("query_id", F.posexplode("tokens").alias("pos", "word")).join(best, "word", "left")
    t = t.select("query_id", "pos", "word", F.coalesce("more", F.array().cast("array<string>")).alias("more"))
    t = t.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "word", "more"))).alias("l"))
    return t.select("query_id", F.array_distinct(F.concat(F.transform("l", lambda x: x["word"]), F.flatten(F.transform("l", lambda x: x["more"])))).alias("tokens"))


def companions(landed: DataFrame, links: DataFrame, n: int = 12) -> DataFrame:
    """``(query_id, place, path, votes)``: files linked with landed ones.

    ``landed(query_id, path, pos)`` vote 1 / (1 + pos) times the number of edge kinds in
    ``links(a, b, kind)``, either way; landed files are no companions.
    """
    both = links.select("a", "b", "kind").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "kind"))
    kinds = both.filter("a <> b").groupBy("a", "b").agg(F.count_distinct("kind").alias("kinds"))
    v = landed.select("query_id", F.col("path").alias("a"), "pos").join(kinds, "a")
    v = v.groupBy("query_id", F.col("b").alias("path")).agg(F.sum(F.col("kinds") / (1 + F.col("pos"))).alias("votes"))
    v = v.join(landed.select("query_id", "path"), ["query_id", "path"], "left_anti")
    return top_per_group(v, ["query_id"], n, F.desc(F.round("votes", 9)), F.asc("path"))


def commonest_words(texts: DataFrame, found: Column, n: int, longer_first: bool = True) -> DataFrame:
    """``(id, place, word, c)``: the commonest words that ``found`` (an array) yields for each text, by (-count, -length, word)."""
    c = texts.select("id", F.explode(found).alias("word")).groupBy("id", "word").agg(F.count(F.lit(1)).alias("c"))
    order = [F.desc("c"), *([F.desc(F.length("word"))] if longer_first else []), F.asc("word")]
    return top_per_group(c, ["id"], n, *order)


def references(text: Column, defined: Column) -> Column:
    """Identifiers of six characters or more, with an underscore or mixed case, that are not defined here; repeats kept."""
    every = F.regexp_extract_all(text, F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))
    mixed = lambda w: w.contains("_") | ((F.lower(w) != w) & (F.upper(w) != w))
    return F.filter(every, lambda w: (F.length(w) >= 6) & mixed(w) & ~F.coalesce(F.array_contains(defined, w), F.lit(False)))


def ui_labels(text: Column, pattern: str = "[가-힣]{2,}") -> Column:
    """Runs of Hangul of two syllables or more, or of another pattern."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def stratified_sample(rows: DataFrame, strata: list[str], size: int, seed: int, key: str) -> DataFrame:
    """About ``size`` rows: max(1, round(size * stratum / all)) of each stratum (halves to even), chosen by md5 of seed and key."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    each = rows.groupBy(*strata).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total))
    each = each.select(*strata, F.greatest(F.lit(1), F.bround(F.lit(float(size)) * F.col("n") / F.col("total"))).alias("take"))
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    r = rows.withColumn("place", F.row_number().over(Window.partitionBy(*strata).orderBy(draw, key)))
    on = F.lit(True)
    for c in strata:
        on = on & F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}"))
    return r.alias("r").join(each.alias("s"), on).filter("place <= take").select("r.*")


def rank_within(scope: DataFrame, asked: DataFrame, k: int = 8) -> DataFrame:
    """``(query_id, place, id, score)``: of ``scope(query_id, id, kind, name, path, hop)`` what is nearest to ``asked(query_id, words)``.

    Ten for each word that name or path has, twice that for functions, classes and files, less the
    steps from the anchor; without words the score is 0. Ties by steps, then id.
    """
    s = scope.join(asked.select("query_id", F.array_distinct("words").alias("words")), "query_id")
    has = F.size(F.array_intersect("words", F.array_distinct(F.concat(tokenize("name"), tokenize("path")))))
    weight = F.when(F.col("kind").isin("function", "class", "file"), 2).otherwise(1)
    score = F.when(F.size("words") == 0, 0).otherwise(has * 10 * weight - F.col("hop")).cast("double")
    s = s.select("query_id", "id", "hop", score.alias("score"))
    return top_per_group(s, ["query_id"], k, F.desc("score"), F.asc("hop"), F.asc("id")).select("query_id", "place", "id", "score")


def retrieve_notes(notes: DataFrame, query: str, n: int = 5) -> DataFrame:
    """The ``n`` notes with the most of the query's words of three letters or more, newest first among equals."""
    wanted = sorted({w for w in query.lower().split() if len(w) >= 3})
    text = F.lower(F.concat_ws(" ", "area", "note"))
    score = F.lit(0)
    for w in wanted:
        score = score + text.contains(w).cast("int")
    out = notes.withColumn("score", score)
    out = out.filter("score > 0") if wanted else out
    return out.orderBy(F.desc("score"), F.desc("ts"), "note").limit(n)
