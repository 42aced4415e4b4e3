from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from graphloom.operators import evaluate, fuse, journal, profile, rank

NODE = "id string, kind string, name string, repo string, path string, summary string, deprecated boolean"


def search(spark, nodes, query, **more):
    rows = [(f"n{i:02d}", k, n, r, p, s, d) for i, (k, n, r, p, s, d) in enumerate(nodes)]
    index = rank.Index.build(spark.createDataFrame(rows, NODE))
    hits = rank.search(index, spark.createDataFrame([(1, query)], "query_id int, text string"), **more)
    names = {r[0]: r[2] for r in rows}
    return [names[h.id] for h in hits.orderBy("rank").collect()]


def n(kind, name, repo="r", path="src/a.py", summary=None, deprecated=False):
    return kind, name, repo, path, summary, deprecated


def test_rare_words_and_exact_names(spark):
    many = [n("function", f"api_handler_{i}") for i in range(20)]
    assert search(spark, [*many, n("function", "api_collections_card")], "api collections")[0] == "api_collections_card"
    assert search(spark, [n("function", "get_user_sessions_by_id"), n("function", "get_user"), n("endpoint", "GET /user")], "get_user")[0] == "get_user"


def test_priors(spark):
    assert search(spark, [n("function", "test_back_button", path="tests/x.py"), n("function", "back_button", path="src/nav.py")], "back button") == ["back_button", "test_back_button"]
    assert search(spark, [n("repo", "payments"), n("feature", "payments"), n("function", "payments")], "payments")[0] == "payments"
    assert search(spark, [n("function", "health", "beta-worker"), n("function", "health2", "alpha-gateway")], "alpha health check", prefixes=True)[0] == "health2"
    assert search(spark, [n("function", "token_a", deprecated=True), n("function", "token_b")], "token") == ["token_b"]
    assert search(spark, [n("function", "a1", summary="로그인 처리"), n("function", "b1", summary="결제 처리")], "로그인") == ["a1"]


def test_centrality_breaks_ties(spark):
    rows = [("a", "function", "execute", "r", "a.py", None, False), ("b", "function", "execute", "r", "b.py", None, False)]
    index = rank.Index.build(spark.createDataFrame(rows, NODE))
    hits = rank.search(index, spark.createDataFrame([(1, "execute")], "query_id int, text string"), centrality=spark.createDataFrame([("b", 1.0)], "id string, centrality double"))
    assert [h.id for h in hits.orderBy("rank").collect()] == ["b", "a"]


def test_prefixes_in_both_directions(spark):
    terms = spark.createDataFrame([(t,) for t in ("auth", "authentic", "au", "login")], "term string")
    tokens = spark.createDataFrame([(t,) for t in ("authe", "login", "logi", "zz")], "token string")
    got = {(r.token, r.term): r.fidelity for r in rank.match_terms(tokens, terms).collect()}
    assert got == {("authe", "authentic"): 5 / 9, ("authe", "auth"): 5 / 4, ("login", "login"): 1.0, ("logi", "login"): 0.8}


def test_bm25_formula(spark):
    index = rank.Index.build(spark.createDataFrame([("a", "x x y"), ("b", "y")], "id string, text string"), {"text": 1})
    got = rank.base_scores(index, spark.createDataFrame([(1, "x")], "query_id int, text string")).collect()
    assert got[0].base == pytest.approx(math.log(1 + 1.5 / 1.5) * 2 * 2.5 / 3.5)


def ranked(spark, ids):
    return spark.createDataFrame([(1, i + 1, v) for i, v in enumerate(ids)], "query_id int, rank int, id string")


def test_fusion_keeps_the_head(spark):
    a, b = ranked(spark, ["a1", "a2", "a3", "a4"]), ranked(spark, ["b1", "a4", "b2"])
    got = [r.id for r in fuse.fuse(a, b, 6, head=2).orderBy("rank").collect()]
    assert got[:3] == ["a1", "a2", "a4"] and set(got) == {"a1", "a2", "a3", "a4", "b1", "b2"}
    assert [r.id for r in fuse.fuse(a.limit(0), b, 2).orderBy("rank").collect()] == ["b1", "a4"]


def test_one_per_file(spark):
    h = spark.createDataFrame([(1, i + 1, f"n{i}", "r", p) for i, p in enumerate(["a", "a", "b", "", ""])], "query_id int, rank int, id string, repo string, path string")
    assert [r.id for r in fuse.one_per_file(h, 5).orderBy("place").collect()] == ["n0", "n2", "n3", "n4", "n1"]


def test_dense(spark):
    v = spark.createDataFrame([(i, x) for i, x in enumerate([[1.0, 0.0], [2.0, 0.1], [0.0, 3.0]])], "id int, embedding array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id int, embedding array<float>")
    assert [r.id for r in fuse.dense_top_k(v, q, 2).orderBy("rank").collect()] == [0, 1]


def test_budget_stops_at_the_first_overflow(spark):
    r = spark.createDataFrame([(1, 9), (2, 5), (3, 1)], "k int, size int")
    assert [x.k for x in fuse.budget_take(r, "size", 3, "k").collect()] == [1]
    assert [x.k for x in fuse.budget_take(r, "size", 14, "k").collect()] == [1, 2]


def test_metrics(spark):
    truth = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "query_id int, key string")
    found = spark.createDataFrame([(1, 1, "a"), (2, 2, "b"), (2, 1, "x")], "query_id int, rank int, key string")
    m = evaluate.retrieval_metrics(found, truth).first()
    assert (m.queries, m.r_at_1, m.r_at_10, m.mrr) == (3, pytest.approx(1 / 3), pytest.approx(2 / 3), pytest.approx(0.5))


def test_exclusions(spark):
    rows = [("a", "Merge branch x into y"), ("b", "fix it"), ("c", "Add a page for the users"), ("d", "Add a page for the users"), ("e", "Add a page for the users"), ("f", "Merge the two lists of users")]
    d = spark.createDataFrame(rows, "k string, title string")
    got = {r.k: r.why for r in d.select("k", evaluate.exclusion(F.col("title"), F.col("k") == "e", F.col("k") != "d", F.col("k") != "f").alias("why")).collect()}
    assert got == {"a": "bookkeeping", "b": "short", "c": None, "d": "unindexed", "e": "ambiguous", "f": "unexpanded"}


def test_journal(spark):
    e = spark.createDataFrame(
        [("s", 1, "plan", "ok", None), ("s", 2, "judge", "skipped", "no model"), ("s", 3, "judge", "ok", None)],
        "session string, seq int, step string, status string, reason string",
    )
    got = {r.stage: (r.ran, r.skipped, r.reason, r.silent) for r in journal.stage_coverage(e, spark.createDataFrame([("plan",), ("judge",), ("mr",)], "stage string")).collect()}
    assert got == {"plan": (1, 0, None, False), "judge": (1, 1, "no model", False), "mr": (0, 0, None, True)}


def test_lexicon_bridge(spark):
    rows = [(i, ["카드"], ["card"]) for i in range(3)] + [(i, ["표"], ["table"]) for i in range(3, 7)]
    learned = profile.lexicon(spark.createDataFrame(rows, "id int, words array<string>, terms array<string>"))
    t = spark.createDataFrame([(1, ["카드", "new"])], "query_id int, tokens array<string>")
    assert profile.bridge(t, learned).first().tokens == ["카드", "new", "card"]
