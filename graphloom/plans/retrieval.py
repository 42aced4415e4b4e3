"""Ranked retrieval over documents and embeddings.

Documents play the part of nodes: ``kind`` is file, ``repo`` the language, ``path`` the source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.text import has_tokens, tokenize
from graphloom.operators import evaluate, fuse, profile, rank
from graphloom.plans.scratch import cut, spread
from graphloom.plans.tables import GRAPH_SQL, TOKENS_SQL, read, trade_graph

TEXT_ONLY = {"text": 1}


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    """Documents as nodes named by their first two words, with what the priors read."""
    docs, labels = spread(read(spark, d, "documents")), read(spark, d, "labels")
    kind = F.when(F.col("doc_id") % 3 == 0, "function").when(F.col("doc_id") % 3 == 1, "file").otherwise("feature")
    first = F.array_join(F.slice(F.split("text", "[ \n]+"), 1, 2), " ")
    n = docs.select(F.col("doc_id").alias("id"), kind.alias("kind"), first.alias("name"), F.concat("lang", F.lit("-store")).alias("repo"), F.col("source").alias("path"), F.col("text").alias("summary"))
    return n.join(labels.select(F.col("doc_id").alias("id"), (F.col("toxic") == 1).alias("deprecated")), "id", "left")


def tokenize_docs(spark: SparkSession, d: str) -> DataFrame:
    t = _docs(spark, d).select("id", tokenize("text").alias("ts"))
    return t.select("id", F.size("ts").alias("n_tokens"), F.md5(F.array_join("ts", " ")).alias("tokens_md5"))


def node_terms_tf(spark: SparkSession, d: str) -> DataFrame:
    """Term statistics of the field-weighted bags: document frequency and weighted term frequency."""
    t = rank.node_terms(_nodes(spark, d).select("id", "kind", "name", "repo", "path", "summary"))
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


def bm25(docs: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """BM25 (exact terms) of a bounded set of questions over documents, one scan and two aggregations.

    Documents are cut down to the questions' terms while they are scanned, so neither shuffle
    carries a term that no question has.
    """
    tokens = cut(rank.tokens_of_queries(questions), "query-tokens")
    small = tokens.count() <= rank.BROADCAST_TOKENS
    wanted = tokens.select(F.col("token").alias("term")).distinct()
    t = docs.select("id", F.explode(tokenize("text")).alias("term")).join(F.broadcast(wanted) if small else wanted, "term", "left_semi")
    # one shuffle, by document: counts and scores of a document then meet in one task
    postings = t.repartition("id").groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    total = docs.filter(has_tokens("text")).count()
    postings = cut(postings, "postings")
    terms = rank.terms_of(postings, total).select("term", "idf")
    weighted = tokens.withColumnRenamed("token", "term").join(terms, "term")
    hits = postings.join(F.broadcast(weighted) if small else weighted, "term")
    each = F.col("times") * F.col("idf") * rank.saturated(F.col("tf").cast("double"))
    s = hits.groupBy("query_id", "id").agg(F.round(F.sum(each), 6).alias("score"))
    return rank.top_k(s, k, F.desc("score"), F.asc("id"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return bm25(_docs(spark, d), _questions(spark, d), 10).select("query_id", "rank", "id", "score")


def metrics_mrr(spark: SparkSession, d: str) -> DataFrame:
    """Recall and mean reciprocal rank against documents that hold the first 60 characters of a passage."""
    docs, q = _docs(spark, d), _questions(spark, d)
    heads = q.select("query_id", F.substring("text", 1, 60).alias("head"))
    truth = evaluate.holders(docs, heads).withColumnRenamed("id", "key")
    found = bm25(docs, q, 10).select("query_id", "rank", F.col("id").alias("key"))
    m = evaluate.retrieval_metrics(found, truth, 10)
    return m.select("queries", *(F.round(c, 6).alias(c) for c in ("r_at_1", "r_at_10", "mrr")))


def coverage_files(spark: SparkSession, d: str) -> DataFrame:
    """How far ten hits cover the sources of the true documents."""
    docs, q = spread(read(spark, d, "documents")), _questions(spark, d)
    heads = q.select("query_id", F.substring("text", 1, 60).alias("head"))
    held = evaluate.holders(docs.select(F.col("doc_id").alias("id"), "text"), heads)
    truth = held.join(docs.select(F.col("doc_id").alias("id"), "source"), "id").groupBy("query_id").agg(F.collect_set("source").alias("files"))
    hits = bm25(docs.select(F.col("doc_id").alias("id"), "text"), q, 10).join(docs.select(F.col("doc_id").alias("id"), "source"), "id")
    c = evaluate.coverage(hits.groupBy("query_id").agg(F.collect_set("source").alias("files")), truth)
    return c.select(F.round("mean_recall", 6).alias("mean_recall"), F.round("fully_covered", 6).alias("fully_covered"))


def bm25_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Terms that stand in for tokens that no document has: longer ones they begin, the longest one that begins them."""
    terms = rank.node_terms(_docs(spark, d), TEXT_ONLY).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    t = _questions(spark, d).select(F.explode(tokenize("text")).alias("w")).distinct()
    made = t.select(F.explode(F.array("w", F.concat("w", F.lit("zq")), F.substr("w", F.lit(1), F.lit(4)))).alias("token")).distinct()
    m = rank.match_terms(made, terms)
    return m.select("token", "term", F.round("fidelity", 6).alias("fidelity"))


def bm25_priors(spark: SparkSession, d: str) -> DataFrame:
    """Search over weighted fields with kind, test and repository priors, deprecated nodes left out."""
    index = rank.Index.build(_nodes(spark, d))
    q = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 4 == 0, F.concat(F.lit("fr "), "text")).otherwise(F.col("text")).alias("text"))
    return rank.search(index, q, 10, prefixes=False, digits=6).select("query_id", "rank", "id", "score")


def token_exclusivity(spark: SparkSession, d: str) -> DataFrame:
    t = rank.token_exclusivity(_nodes(spark, d).select("id", "kind", "name", "repo", "path", "summary"))
    return t.select("token", F.round("exclusivity", 6).alias("exclusivity"))


def lexicon_pmi(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(read(spark, d, "documents"))
    words = F.array_distinct(tokenize("text"))
    bags = cut(docs.select(F.col("doc_id").alias("id"), words.alias("words"), F.array("lang", "source").alias("terms")), "bags")
    learned = profile.lexicon(bags, 5)
    return learned.select("word", "term", "n", F.round("pmi", 6).alias("pmi"))


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    q = v.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding")
    top = fuse.dense_top_k(v, q, 10)
    return top.select("query_id", "rank", "id", F.round("score", 5).alias("score"))


def _two_lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two rankings of documents a source: by length and by id."""
    docs = read(spark, d, "documents")
    w = lambda *o: F.row_number().over(Window.partitionBy("source").orderBy(*o))
    cut = lambda c: docs.select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"), c.alias("rank")).filter("rank <= 12")
    return cut(w(F.desc("n_chars"), "doc_id")), cut(w("doc_id"))


def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two_lists(spark, d)
    return fuse.fuse(a, b, 16, head=2).select("query_id", "rank", "id", F.round("score", 9).alias("score"))


def chain_wrrf(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two_lists(spark, d)
    s = fuse.weighted_fuse(a, b, 0.5).select("query_id", "id", F.round("score", 9).alias("score"))
    return rank.top_k(s, 24, F.desc("score"), F.asc("id")).select("query_id", "rank", "id", "score")


def one_per_file(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    order = Window.partitionBy("source").orderBy("doc_id")
    hits = docs.select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"), F.col("lang").alias("repo"), F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.substring(F.md5("text"), 1, 1)).alias("path"), F.row_number().over(order).alias("rank"))
    return fuse.one_per_file(hits.filter("rank <= 40"), 20).select("query_id", "place", "id", "rank")


def landing(spark: SparkSession, d: str) -> DataFrame:
    """The landing list of four rankings, one row a language and source."""
    a, b = _two_lists(spark, d)
    c = a.filter("rank <= 2").select("query_id", (F.col("id")).alias("id"), (3 - F.col("rank")).alias("rank"))
    nodes = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("repo"), F.substring(F.md5("text"), 1, 1).alias("path"))
    return fuse.land(a, b, c, b, nodes, 8).select("query_id", "place", "id")


def companion_votes(spark: SparkSession, d: str) -> DataFrame:
    """Parts that stand in orders with a landed part, by the number of shipping modes that link them."""
    items = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.col("l_returnflag").alias("kind")).distinct()
    two = items.alias("a").join(items.alias("b"), "l_orderkey").filter("a.l_partkey < b.l_partkey")
    links = two.select(F.col("a.l_partkey").alias("a"), F.col("b.l_partkey").alias("b"), F.col("a.kind").alias("kind"))
    landed = read(spark, d, "part").filter("p_partkey <= 20").select((F.col("p_partkey") % 4).alias("query_id"), F.col("p_partkey").alias("path"), F.floor(F.col("p_partkey") / 4).alias("pos"))
    return profile.companions(landed, links).select("query_id", "place", "path", F.round("votes", 6).alias("votes"))


def scope_rank(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a source by how many words they share with a request, twice as much for functions, less their distance."""
    kind = F.when(F.col("doc_id") % 3 == 0, "function").otherwise("feature")
    scope = read(spark, d, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"), kind.alias("kind"), F.col("text").alias("name"), F.lit("").alias("path"), (F.col("doc_id") % 5).alias("hop"))
    asked = scope.select("query_id").distinct().withColumn("words", F.array(*map(F.lit, ("the", "and", "la", "die", "with", "license"))))
    s = profile.rank_within(scope, asked, 5)
    return s.select(F.col("query_id").alias("source"), "place", F.col("id").alias("doc_id"), F.col("score").cast("long").alias("score"))


def deprecated_filter(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d).filter(~F.coalesce("deprecated", F.lit(False)) & F.col("kind").isin("function", "file"))
    return n.groupBy("kind", "repo").agg(F.count(F.lit(1)).alias("n"))


def graph_search(spark: SparkSession, d: str) -> DataFrame:
    """Names of the trade graph by prefix terms: nations and parts for four requests."""
    g = trade_graph(spark, d)
    nodes = g.nodes.filter("kind in ('nation', 'region', 'supplier')").select("id", "kind", "name", "repo")
    q = spark.createDataFrame([(1, "nation"), (2, "supplier 1"), (3, "europe"), (4, "ASIA")], "query_id int, text string")
    hits = rank.search(rank.Index.build(nodes), q, 5, digits=6)
    return hits.select("query_id", "rank", "id", F.round("score", 4).alias("score"))


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_docs, node_terms_tf, bm25_topk, metrics_mrr, coverage_files, bm25_prefix, bm25_priors, token_exclusivity, lexicon_pmi,
        dense_topk, rrf_fuse, chain_wrrf, one_per_file, landing, companion_votes, scope_rank, deprecated_filter, graph_search,
    )
}

_STOP = "if else for while return break continue def class function func const let var import from export default public private static void new this self true false null none type interface struct enum impl trait fn pub mut async await try catch throw finally"
_TOK = TOKENS_SQL.format
_BM25 = f"""
    q0 AS (SELECT item_id AS query_id, {_TOK(x="text")} AS ts FROM benchmark),
    q1 AS (SELECT query_id, CASE WHEN len(list_filter(ts, lambda w: NOT list_contains(string_split('{_STOP}', ' '), w))) > 0
        THEN list_filter(ts, lambda w: NOT list_contains(string_split('{_STOP}', ' '), w)) ELSE ts END AS ts FROM q0),
    q AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(ts) AS term FROM q1) GROUP BY ALL),
    d0 AS (SELECT doc_id AS id, {_TOK(x="text")} AS ts FROM documents),
    p AS (SELECT id, term, count(*)::DOUBLE AS tf FROM (SELECT id, unnest(ts) AS term FROM d0) GROUP BY ALL),
    n AS (SELECT count(*)::DOUBLE AS n FROM d0 WHERE len(ts) > 0),
    t AS (SELECT term, ln(1 + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM p, n GROUP BY term, n),
    s AS (SELECT query_id, id, round(sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE)), 6) AS score FROM q JOIN t USING (term) JOIN p USING (term) GROUP BY ALL),
    top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10)"""
_TRUTH = """truth AS (SELECT DISTINCT item_id AS query_id, doc_id AS id, source FROM documents, benchmark WHERE contains(documents.text, substr(benchmark.text, 1, 60)))"""
_NODES = """nodes AS (
        SELECT d.doc_id AS id, CASE d.doc_id % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'file' ELSE 'feature' END AS kind,
               array_to_string(list_slice(string_split_regex(text, '[ \n]+'), 1, 2), ' ') AS name, lang || '-store' AS repo, source AS path,
               text AS summary, coalesce(toxic = 1, false) AS deprecated
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
_TERMS = f"""bag AS (
        SELECT id, 3 AS w, unnest({_TOK(x="name")}) AS term FROM nodes UNION ALL SELECT id, 2, unnest({_TOK(x="path")}) FROM nodes
        UNION ALL SELECT id, 1, unnest({_TOK(x="repo")}) FROM nodes UNION ALL SELECT id, 1, unnest({_TOK(x="kind")}) FROM nodes
        UNION ALL SELECT id, 1, unnest({_TOK(x="summary")}) FROM nodes),
    p AS (SELECT id, term, sum(w)::DOUBLE AS tf FROM bag GROUP BY ALL)"""
_LISTS = """a AS (SELECT source AS query_id, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 12),
    b AS (SELECT source AS query_id, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents QUALIFY rank <= 12)"""


def _fuse_sql(name: str, one: str, two: str, k: int, head: int) -> str:
    return f"""{name} AS (
        SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN f <= {head} THEN f END NULLS LAST, round(score, 12) DESC, seen) AS rank
        FROM (SELECT query_id, id, sum(1 / (60::DOUBLE + rank)) AS score, min(rank) FILTER (l = 0) AS f, min(l * 1000000 + rank) AS seen
              FROM (SELECT *, 0 AS l FROM (SELECT query_id, id, rank FROM {one}) UNION ALL SELECT *, 1 FROM (SELECT query_id, id, rank FROM {two})) GROUP BY 1, 2)
        QUALIFY rank <= {k})"""


ORACLE_SQL = {
    "tokenize_docs": f"""WITH t AS (SELECT doc_id AS id, {_TOK(x="text")} AS ts FROM documents)
        SELECT id, len(ts)::INT AS n_tokens, md5(array_to_string(ts, ' ')) AS tokens_md5 FROM t""",
    "node_terms_tf": f"WITH {_NODES}, {_TERMS} SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM p GROUP BY term",
    "bm25_topk": f"WITH {_BM25} SELECT query_id, rank, id, score FROM top",
    "metrics_mrr": f"""WITH {_BM25}, {_TRUTH}, h AS (SELECT query_id, min(rank) AS first FROM top SEMI JOIN truth USING (query_id, id) GROUP BY 1)
        SELECT count(*) AS queries, round(avg(CASE WHEN first <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS r_at_1,
               round(avg(CASE WHEN first <= 10 THEN 1.0::DOUBLE ELSE 0 END), 6) AS r_at_10, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr
        FROM (SELECT DISTINCT query_id FROM truth) LEFT JOIN h USING (query_id)""",
    "coverage_files": f"""WITH {_BM25}, {_TRUTH}, want AS (SELECT query_id, list(DISTINCT source) AS want FROM truth GROUP BY 1),
        got AS (SELECT query_id, list(DISTINCT source) AS got FROM top JOIN documents ON doc_id = id GROUP BY 1),
        r AS (SELECT len(list_intersect(want, coalesce(got, [])))::DOUBLE / len(want) AS r FROM want LEFT JOIN got USING (query_id))
        SELECT round(avg(r), 6) AS mean_recall, round(avg(CASE WHEN r >= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS fully_covered FROM r""",
    "bm25_prefix": f"""WITH v AS (SELECT DISTINCT unnest({_TOK(x="text")}) AS term FROM documents),
        w AS (SELECT DISTINCT unnest({_TOK(x="text")}) AS w FROM benchmark),
        k AS (SELECT DISTINCT unnest([w, w || 'zq', substr(w, 1, 4)]) AS token FROM w),
        e AS (SELECT token, term FROM k JOIN v ON token = term), r AS (SELECT token FROM k ANTI JOIN v ON token = term),
        l AS (SELECT token, term FROM r JOIN v ON starts_with(term, token)),
        h AS (SELECT token, unnest(list_transform(range(2, length(token)), lambda i: substr(token, 1, i::INT))) AS head FROM r WHERE length(token) > 2),
        s AS (SELECT token, arg_max(head, length(head)) AS term FROM h SEMI JOIN v ON head = term GROUP BY 1),
        m AS (SELECT * FROM e UNION SELECT * FROM l UNION SELECT * FROM s)
        SELECT token, term, round(length(token)::DOUBLE / length(term), 6) AS fidelity FROM m""",
    "bm25_priors": f"""WITH {_NODES}, {_TERMS},
        qs AS (SELECT item_id AS query_id, CASE WHEN item_id % 4 = 0 THEN 'fr ' || text ELSE text END AS text FROM benchmark),
        q0 AS (SELECT query_id, lower(trim(text)) AS needle, list_filter({_TOK(x="text")}, lambda w: NOT list_contains(string_split('{_STOP}', ' '), w)) AS ts FROM qs),
        q AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(ts) AS term FROM q0) GROUP BY ALL),
        n AS (SELECT count(DISTINCT id)::DOUBLE AS n FROM p),
        t AS (SELECT term, ln(1 + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM p, n GROUP BY term, n),
        base AS (SELECT query_id, id, sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE)) AS base, count(*) AS matched FROM q JOIN t USING (term) JOIN p USING (term) GROUP BY ALL),
        rt AS (SELECT DISTINCT repo, unnest({_TOK(x="repo")}) AS token FROM (SELECT DISTINCT repo FROM nodes)),
        ex AS (SELECT p.term AS token, avg(CASE WHEN r.repo IS NULL THEN 0 ELSE 1.0::DOUBLE END) AS e
               FROM p JOIN nodes USING (id) LEFT JOIN rt r ON r.token = p.term AND r.repo = nodes.repo WHERE p.term IN (SELECT token FROM rt) GROUP BY 1),
        tg AS (SELECT query_id, list(DISTINCT repo) AS repos, list(DISTINCT q.term) AS named, 1 + 1.5::DOUBLE * coalesce(max(e), 0) AS lift
               FROM q JOIN rt ON rt.token = q.term LEFT JOIN ex ON ex.token = q.term GROUP BY 1 HAVING count(DISTINCT repo) < (SELECT count(DISTINCT repo) FROM nodes)),
        x AS (SELECT b.query_id, b.id, kind, name, needle, lower(name || ' ' || path) AS hay, repo, repos, named, lift,
                     base * (1 + 2 * pow(matched::DOUBLE / len(ts), 1.5)) * CASE kind WHEN 'function' THEN 2.0::DOUBLE WHEN 'file' THEN 1.6 ELSE 0.5 END AS s
              FROM base b JOIN nodes USING (id) JOIN q0 ON q0.query_id = b.query_id LEFT JOIN tg ON tg.query_id = b.query_id WHERE NOT deprecated),
        y AS (SELECT query_id, id, kind <> 'feature' AND lower(name) = needle AS exact, kind <> 'feature' AND lower(name) <> needle AND length(needle) > 2 AND contains(lower(name), needle) AS partial,
                     round(s * CASE WHEN regexp_matches(hay, 'test|spec|conftest|fixture') AND NOT regexp_matches(needle, 'test|spec|conftest|fixture') THEN 0.35::DOUBLE ELSE 1 END
                           * CASE WHEN lift IS NOT NULL AND (list_contains(repos, repo) OR len(list_filter(named, lambda w: contains(hay, w))) > 0) THEN lift ELSE 1 END, 6) AS score
              FROM x)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, partial DESC, score DESC, id) AS rank, id, score FROM y QUALIFY rank <= 10""",
    "token_exclusivity": f"""WITH {_NODES}, {_TERMS}, rt AS (SELECT DISTINCT repo, unnest({_TOK(x="repo")}) AS token FROM (SELECT DISTINCT repo FROM nodes))
        SELECT p.term AS token, round(avg(CASE WHEN r.repo IS NULL THEN 0 ELSE 1.0::DOUBLE END), 6) AS exclusivity
        FROM p JOIN nodes USING (id) LEFT JOIN rt r ON r.token = p.term AND r.repo = nodes.repo WHERE p.term IN (SELECT token FROM rt) GROUP BY 1""",
    "lexicon_pmi": f"""WITH b AS (SELECT doc_id AS id, list_distinct({_TOK(x="text")}) AS words, list_distinct([lang, source]) AS terms FROM documents),
        p AS (SELECT * FROM b WHERE len(words) > 0), w AS (SELECT id, unnest(words) AS word FROM p), t AS (SELECT id, unnest(terms) AS term FROM p),
        x AS (SELECT word, term, count(*) AS n FROM w JOIN t USING (id) GROUP BY ALL HAVING count(*) >= 5),
        y AS (SELECT x.*, ln(n * (SELECT count(*) FROM p)::DOUBLE / (nw * nt)) AS pmi FROM x
              JOIN (SELECT word, count(*) AS nw FROM w GROUP BY 1) USING (word) JOIN (SELECT term, count(*) AS nt FROM t GROUP BY 1) USING (term))
        SELECT word, term, n, round(pmi, 6) AS pmi FROM y WHERE pmi > 0""",
    "dense_topk": """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT id, v, sqrt(list_dot_product(v, v)) + 1e-9::DOUBLE AS l FROM v),
        s AS (SELECT q.id AS query_id, u.id, round(list_dot_product(list_transform(u.v, lambda x: x / u.l), list_transform(q.v, lambda x: x / q.l)), 9) AS score FROM u, u q WHERE q.id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
        SELECT query_id, rank, id, round(score, 5) AS score FROM r WHERE rank <= 10""",
    "rrf_fuse": f"WITH {_LISTS}, {_fuse_sql('f', 'a', 'b', 16, 2)} SELECT query_id, rank, id, round(score, 9) AS score FROM f",
    "chain_wrrf": f"""WITH {_LISTS}, s AS (SELECT query_id, id, round(sum(x), 9) AS score FROM (
            SELECT query_id, id, 1 / (59::DOUBLE + rank) AS x FROM a UNION ALL SELECT query_id, id, 0.5::DOUBLE / (59 + rank) FROM b) GROUP BY ALL)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score FROM s QUALIFY rank <= 24""",
    "one_per_file": """WITH h AS (SELECT source AS query_id, doc_id AS id, lang AS repo, CASE WHEN doc_id % 5 = 0 THEN '' ELSE substr(md5(text), 1, 1) END AS path,
            row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents QUALIFY rank <= 40),
        l AS (SELECT *, path <> '' AND row_number() OVER (PARTITION BY query_id, repo, path ORDER BY rank) > 1 AS late FROM h)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY late, rank) AS place, id, rank FROM l QUALIFY place <= 20""",
    "landing": f"""WITH {_LISTS}, c AS (SELECT query_id, id, 3 - rank AS rank FROM a WHERE rank <= 2), {_fuse_sql('f1', 'a', 'b', 16, 1)}, {_fuse_sql('f2', 'c', 'f1', 16, 1)}, {_fuse_sql('f3', 'f2', 'b', 16, 0)},
        l AS (SELECT f3.*, row_number() OVER (PARTITION BY query_id, lang, substr(md5(text), 1, 1) ORDER BY rank) > 1 AS late FROM f3 JOIN documents ON doc_id = id)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY late, rank) AS place, id FROM l QUALIFY place <= 8""",
    "companion_votes": """WITH i AS (SELECT DISTINCT l_orderkey, l_partkey, l_returnflag AS kind FROM lineitem),
        one AS (SELECT a.l_partkey AS a, b.l_partkey AS b, a.kind FROM i a JOIN i b USING (l_orderkey) WHERE a.l_partkey < b.l_partkey),
        k AS (SELECT a, b, count(DISTINCT kind) AS kinds FROM (SELECT a, b, kind FROM one UNION ALL SELECT b, a, kind FROM one) GROUP BY 1, 2),
        l AS (SELECT p_partkey % 4 AS query_id, p_partkey AS path, p_partkey // 4 AS pos FROM part WHERE p_partkey <= 20),
        v AS (SELECT query_id, k.b AS path, sum(kinds / (1::DOUBLE + pos)) AS votes FROM l JOIN k ON k.a = l.path GROUP BY 1, 2),
        w AS (SELECT v.* FROM v ANTI JOIN l ON l.query_id = v.query_id AND l.path = v.path)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(votes, 9) DESC, path) AS place, path, round(votes, 6) AS votes FROM w QUALIFY place <= 12""",
    "scope_rank": f"""WITH s AS (SELECT source, doc_id, len(list_intersect(list_distinct({_TOK(x="text")}), ['the', 'and', 'la', 'die', 'with', 'license'])) * 10
            * CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END - doc_id % 5 AS score FROM documents)
        SELECT source, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id % 5, doc_id) AS place, doc_id, score FROM s QUALIFY place <= 5""",
    "graph_search": f"""WITH {GRAPH_SQL}, g AS (SELECT * FROM nodes WHERE kind IN ('nation', 'region', 'supplier')),
        bag AS (SELECT id, 3 AS w, unnest({_TOK(x="name")}) AS term FROM g UNION ALL SELECT id, 1, unnest({_TOK(x="kind")}) FROM g UNION ALL SELECT id, 1, unnest({_TOK(x="repo")}) FROM g),
        p AS (SELECT id, term, sum(w)::DOUBLE AS tf FROM bag GROUP BY ALL), c AS (SELECT count(*)::DOUBLE AS n FROM g),
        t AS (SELECT term, ln(1 + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM p, c GROUP BY term, n),
        q AS (SELECT * FROM (VALUES (1, 'nation', 1), (2, 'supplier', 2), (2, '1', 2), (3, 'europe', 1), (4, 'asia', 1)) v(query_id, token, total)), k AS (SELECT DISTINCT token FROM q),
        r AS (SELECT token FROM k ANTI JOIN t ON token = term), h AS (SELECT token, unnest(list_transform(range(2, length(token)), lambda i: substr(token, 1, i::INT))) AS head FROM r WHERE length(token) > 2),
        m AS (SELECT token, term FROM k JOIN t ON token = term UNION SELECT token, term FROM r JOIN t ON starts_with(term, token)
              UNION SELECT token, arg_max(head, length(head)) FROM h SEMI JOIN t ON head = term GROUP BY 1),
        b AS (SELECT query_id, id, sum(idf * length(token)::DOUBLE / length(term) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE)) AS base, count(DISTINCT token)::DOUBLE / any_value(total) AS share
              FROM q JOIN m USING (token) JOIN t USING (term) JOIN p USING (term) GROUP BY ALL),
        n AS (SELECT query_id, string_agg(token, ' ') AS needle FROM (VALUES (1, 'nation'), (2, 'supplier 1'), (3, 'europe'), (4, 'asia')) v(query_id, token) GROUP BY 1),
        s AS (SELECT query_id, id, lower(name) = needle AS exact, lower(name) <> needle AND contains(lower(name), needle) AS part, round(base * (1 + 2 * pow(share, 1.5)), 6) AS score FROM b JOIN g USING (id) JOIN n USING (query_id))
        SELECT query_id::INT AS query_id, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, part DESC, score DESC, id) AS rank, id, round(score, 4) AS score FROM s QUALIFY rank <= 5""",
    "deprecated_filter": f"WITH {_NODES} SELECT kind, repo, count(*) AS n FROM nodes WHERE NOT deprecated AND kind IN ('function', 'file') GROUP BY ALL",
}
