"""Links, profiles and text rules over pages, conversations, documents and the trade tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import evaluate, evolve, fuse, link, profile, traverse
from graphloom.plans.tables import read

def _pages(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)?", 1)
    return read(spark, d, "pages").select("page_id", "url", F.when(path == "", "/").otherwise(path).alias("path"), text.host_of("url").alias("host"))


def domains(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).groupBy(traverse.domain_of(F.col("path")).alias("domain")).agg(F.count(F.lit(1)).alias("pages"))


def normalize_urls(spark: SparkSession, d: str) -> DataFrame:
    """Numbers in paths written as parameters, and segments that hold templates, wildcards or slots, then normalised."""
    made = F.element_at(F.array(*map(F.lit, ("/user${id}/x", "/a*b/y", "/z{k}", "/q[slug]/", "/${a}${b}", "/:n", "/plain"))), (F.col("page_id") % 7 + 1).cast("int"))
    p = _pages(spark, d).withColumn("call", F.concat(F.regexp_replace("path", r"\d+", ":id"), made, F.lit("?q=1")))
    return p.groupBy(text.normalize_url("call").alias("path")).agg(F.count(F.lit(1)).alias("n"))


def hosts(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d)
    return p.groupBy("host", text.area_of("path").alias("area"), text.slugify("path").alias("slug")).agg(F.count(F.lit(1)).alias("n"))


def api_link(spark: SparkSession, d: str) -> DataFrame:
    """Page paths as calls against endpoints that are the last one or two segments of every third page."""
    p = _pages(spark, d).select("page_id", text.normalize_url(F.regexp_replace("path", r"\d+", ":id")).alias("path"), F.when(F.col("page_id") % 2 == 0, "GET").otherwise("POST").alias("method"))
    calls = p.select(F.col("page_id").alias("id"), "method", F.concat(F.lit("/api"), "path").alias("path"))
    segs = link.segments(F.col("path"))
    ends = p.filter("page_id % 3 = 0").select("method", F.concat(F.lit("/"), F.array_join(F.slice(segs, F.greatest(F.lit(1), F.size(segs) - 1), F.lit(2)), "/")).alias("path")).distinct()
    return link.link_api(calls, ends.select(F.concat_ws(" ", "method", "path").alias("id"), "method", "path"))


def longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d).select(F.col("page_id").alias("id"), F.concat("host", "path").alias("path"))
    parts = F.split("path", "/")
    routes = p.filter("id % 4 = 0").select(F.array_join(F.slice(parts, 1, 2), "/").alias("prefix")).unionAll(p.select(F.substring_index("path", "/", 1).alias("prefix"))).distinct()
    return link.longest_prefix(p, routes.select(F.col("prefix").alias("id"), "prefix")).select("call", "prefix")


def calls_unique(spark: SparkSession, d: str) -> DataFrame:
    """Orders call part brands; a part defines its brand, within its size class, and orders of the same number are its file."""
    calls = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    calls = calls.select(F.concat(F.lit("f"), F.col("l_orderkey") % 50).alias("file"), (F.col("p_size") % 4).cast("string").alias("repo"), F.concat("p_brand", F.col("p_partkey") % 40).alias("name"))
    defs = read(spark, d, "part").select(F.concat(F.lit("d"), "p_partkey").alias("id"), F.concat(F.lit("f"), F.col("p_partkey") % 50).alias("file"), (F.col("p_size") % 4).cast("string").alias("repo"), F.concat("p_brand", F.col("p_partkey") % 40).alias("name"))
    return link.link_calls(calls, defs)


def package_link(spark: SparkSession, d: str) -> DataFrame:
    """Customers' segments as packages of nations: the nation with the most customers of a segment is canonical."""
    c = read(spark, d, "customer").select(F.concat_ws(":", "c_nationkey", "c_mktsegment").alias("f"), F.col("c_mktsegment").alias("name"), F.col("c_nationkey").cast("string").alias("repo"), "c_custkey")
    feats = c.select(F.col("f").alias("id"), "name", "repo").distinct()
    return link.link_packages(feats, c.select(F.col("f").alias("src"), "c_custkey"))


def folder_members(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d).select(F.col("page_id").alias("id"), F.col("host").alias("repo"), F.ltrim("path", F.lit("/")).alias("path"))
    feats = p.filter(F.col("path").contains("/")).select("repo", F.substring_index("path", "/", 1).alias("dir")).distinct()
    return link.members_by_folder(p, feats.select(F.concat_ws("/", "repo", "dir").alias("id"), "repo", "dir"))


def deploy_targets(spark: SparkSession, d: str) -> DataFrame:
    """Nations as repositories, suppliers as deploying projects, market segments of customers as environments."""
    n = read(spark, d, "nation")
    repos = n.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    aliases = n.filter("n_nationkey % 3 = 0").select(F.col("n_name").alias("name"), F.concat(F.lit("app-"), "n_name").alias("alias"))
    apps = n.select(F.concat(F.lit("a"), "n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("app-"), "n_name")).otherwise(F.col("n_name")).alias("name"))
    envs = read(spark, d, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("envs"))
    s = read(spark, d, "supplier").join(envs, F.col("s_nationkey") == F.col("c_nationkey"))
    dep = s.select(F.col("s_name").alias("project"), F.concat(F.lit("a"), "s_nationkey").alias("app"), "envs", F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("own."), "s_name")).alias("edge_domain"), F.create_map(F.lit("BUILDING"), F.lit("b.example")).alias("project_domains"))
    return link.deploy_targets(repos, apps, aliases, dep)


def anchors(spark: SparkSession, d: str) -> DataFrame:
    """First words of documents as mentions, kept while few documents have them or the query names their language."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("repo"), F.lower(F.get(F.split("text", "[ \n]+"), F.lit(0))).alias("mention"))
    hits = docs.crossJoin(F.broadcast(spark.createDataFrame([(1,), (2,)], "query_id int")))
    words = spark.createDataFrame([(2, "fr"), (2, "es")], "query_id int, token string")
    repos = spark.createDataFrame([("fr", "fr"), ("es", "es"), ("en", "en")], "repo string, token string")
    return link.pick_mentions(hits, words, repos).select("query_id", "mention", "id")


def fragments(spark: SparkSession, d: str) -> DataFrame:
    parts = read(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.lit("function").alias("kind"), F.lower(F.replace(F.concat_ws("_", "p_name", F.col("p_partkey").cast("string")), F.lit(" "), F.lit("_"))).alias("name"))
    f = spark.createDataFrame([(1, "ring_15"), (2, "Widget_7"), (3, "abc"), (4, "bolt_99"), (5, "gear_1")], "query_id int, fragment string")
    return link.fragment_hits(f, parts)


def mentions(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations")
    made = F.concat_ws(" ", F.lit("See /chat/"), F.concat("role", F.lit(".py")), F.lit("and snake_case_name or CamelCaseName at /admin/users"), "text")
    m = c.select("conv_id", "turn", text.mentions(made).alias("m"))
    j = lambda a: F.array_join(a, "|")
    return m.select("conv_id", "turn", j("m.routes").alias("routes"), j("m.files").alias("files"), j("m.symbols").alias("symbols"))


def intent(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations").filter("role = 'user'")
    asked = F.concat(F.col("text"), F.element_at(F.array(*map(F.lit, (" fix it", " add this", " why?", " 삭제 수정", ""))), (F.col("conv_id") % 5 + 1).cast("int")))
    return c.groupBy(text.intent(asked).alias("intent")).agg(F.count(F.lit(1)).alias("n"))


def cost_estimate(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").groupBy("role").agg(F.sum(text.token_estimate(F.length("text"))).alias("tokens"))


def mask_secrets(spark: SparkSession, d: str) -> DataFrame:
    """Passwords and tokens in URLs of several schemes, and bare tokens of every issuer, one of them too short to be one."""
    tokens = ("glpat-", "gldt-", "ghp_", "gho_", "ghu_", "ghs_", "github_pat_", "sk-", "xoxb-")
    token = F.concat(F.element_at(F.array(*map(F.lit, tokens)), (F.col("page_id") % 9 + 1).cast("int")), F.when(F.col("page_id") % 10 == 0, "abcdefg").otherwise("Abcdef-8"))
    scheme = F.when(F.col("page_id") % 2 == 0, "ssh").otherwise("git+https")
    who = F.when(F.col("page_id") % 3 == 0, "bob:p/w" ).otherwise("tok3n")
    p = read(spark, d, "pages").select("page_id", F.concat(F.lit("clone "), scheme, F.lit("://"), who, F.lit("@"), text.host_of("url"), F.lit(" by "), token, F.lit(" or a_"), token).alias("t"))
    return p.select("page_id", text.mask_secrets("t").alias("masked"))


def quality_score(spark: SparkSession, d: str) -> DataFrame:
    """Orders as changes: distinct parts as files, quantity as lines, a returned item as a test."""
    o = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_partkey").alias("files"), F.sum("l_quantity").alias("lines"), F.bool_or(F.col("l_returnflag") == "R").alias("tests"))
    s = o.select(F.round(text.quality_score(F.col("files"), F.col("lines") * 3, F.col("tests")), 6).alias("score"))
    return s.groupBy("score").agg(F.count(F.lit(1)).alias("n"))


def repo_profile(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    nodes = docs.select(F.col("doc_id").alias("id"), F.lit("function").alias("kind"), F.lower(F.get(F.split("text", "[ \n.,]+"), F.lit(0))).alias("name"), F.col("lang").alias("repo"), F.concat_ws("/", "source", (F.col("doc_id") % 3).cast("string"), F.lit("x.py")).alias("path"))
    p = profile.repo_profile(nodes)
    return p.select("repo", "nodes", F.array_join("folders", ",").alias("folders"), F.array_join("names", ",").alias("names"))


def refs_topn(spark: SparkSession, d: str) -> DataFrame:
    """Identifier-like words: documents in which every vowel pair is joined by an underscore."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.regexp_replace("text", "(ea|ou)", "$1_").alias("t"))
    top = profile.commonest_words(docs, profile.references(F.col("t"), F.array(F.lit("thea_"))), 5)
    return top.select("id", "place", "word", "c")


def labels_topn(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("t"))
    return profile.commonest_words(docs, profile.ui_labels(F.col("t"), "[a-z]{5,}"), 3).select("id", "place", "word", "c")


def call_names(spark: SparkSession, d: str) -> DataFrame:
    """Part names written as calls, with a comment and a string that hold other calls."""
    p = read(spark, d, "part").select("p_partkey", F.concat(F.lit("def go(): return "), F.regexp_replace("p_type", "[^A-Za-z]+", "_"), F.lit("(1) # ghost(2)\nx = 'no(3)' + real(f\"{inner(4)}\")")).alias("t"))
    from graphloom.sources.extract import call_names as rule

    c = p.select(F.explode(rule(F.col("t"))).alias("name"))
    return c.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def learn_retrieve(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(F.col("source").alias("area"), F.col("text").alias("note"), F.col("doc_id").alias("ts"))
    return profile.retrieve_notes(docs, "the license and security error", 5).select("area", "ts", "score")


def learn_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(F.col("source").alias("area"), F.col("text").alias("note"), "doc_id")
    new = evolve.append_new(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1"))
    return new.groupBy("area").agg(F.count(F.lit(1)).alias("fresh"))


def ambiguous(spark: SparkSession, d: str) -> DataFrame:
    cases = read(spark, d, "documents").groupBy(F.get(F.split("text", "[ \n]+"), F.lit(0)).alias("title"), "lang").agg(F.collect_set("source").alias("files"))
    return evaluate.ambiguous_titles(cases)


def exclusions(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    heads = F.array(*map(F.lit, ("Merge branch ", "merge the ", "[Release] ", "release: ", "release note ", "Revert ", "reverted ", "develop -> STG ", " ", "")))
    title = F.concat(F.element_at(heads, (F.col("doc_id") % 10 + 1).cast("int")), F.substring(F.get(F.split("text", "\n"), F.lit(0)), 1, 9))
    why = evaluate.exclusion(title, F.col("doc_id") % 7 == 4, F.col("source") != "src3", F.col("doc_id") % 6 != 5)
    return docs.groupBy(F.coalesce(why, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def stratified(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "lang", "source")
    return profile.stratified_sample(docs, ["lang", "source"], 150, 42, "doc_id")


def budget_take(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "source", F.col("n_chars").alias("size"))
    return fuse.budget_take(docs, "size", 12_000, "doc_id", by="source").select("source", "doc_id", "used")


def failures(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d).select(F.ltrim("path", F.lit("/")).alias("path"), F.when(F.col("page_id") % 3 > 0, F.col("page_id")).alias("rank"), (F.col("page_id") % 2 == 0).alias("hint_ok"))
    return evaluate.failure_taxonomy(p)


QUERIES = {
    f.__name__: f
    for f in (
        domains, normalize_urls, hosts, api_link, longest_prefix, calls_unique, package_link, folder_members, deploy_targets, anchors, fragments, mentions,
        intent, cost_estimate, mask_secrets, quality_score, repo_profile, refs_topn, labels_topn, call_names, learn_retrieve, learn_dedup, ambiguous,
        exclusions, stratified, budget_take, failures,
    )
}

_PAGES = """pg AS (SELECT page_id, url, CASE WHEN p = '' THEN '/' ELSE p END AS path, host FROM (
    SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)?', 1) AS p, regexp_extract(url, '^(?:[a-z][a-z0-9+.-]*://)?([^/:?#]+)', 1) AS host FROM pages))"""
_SEGS = "list_filter(string_split({x}, '/'), lambda s: s <> '')"
_NORM = "'/' || array_to_string(list_transform(list_filter(string_split(string_split({x}, '?')[1], '/'), lambda s: s <> ''), lambda s: CASE WHEN starts_with(s, ':') OR regexp_matches(s, '[*{{\\[]') THEN '*' ELSE s END), '/')"
_HINTS = {k: "[" + ", ".join(f"'{h}'" for h in v) + "]" for k, v in text.INTENT_HINTS.items()}
_COUNT = "len(list_filter({h}, lambda h: contains(t, h)))"

ORACLE_SQL = {
    "domains": f"""WITH {_PAGES}, s AS (SELECT {_SEGS.format(x="path")}[1] AS h FROM pg)
        SELECT CASE WHEN h IS NULL THEN 'root' WHEN starts_with(h, '[') OR starts_with(h, '(') THEN 'dynamic' ELSE h END AS domain, count(*) AS pages FROM s GROUP BY 1""",
    "normalize_urls": f"""WITH {_PAGES}, c AS (SELECT regexp_replace(path, '[0-9]+', ':id', 'g') || (['/user${{id}}/x', '/a*b/y', '/z{{k}}', '/q[slug]/', '/${{a}}${{b}}', '/:n', '/plain'])[page_id % 7 + 1] || '?q=1' AS c FROM pg) SELECT {_NORM.format(x="c")} AS path, count(*) AS n FROM c GROUP BY 1""",
    "hosts": f"""WITH {_PAGES} SELECT host, array_to_string(list_slice(string_split(path, '/'), 1, 3), '/') AS area,
        rtrim(substr(regexp_replace(regexp_replace(lower(path), '[^0-9a-z가-힣]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40), '-') AS slug, count(*) AS n FROM pg GROUP BY ALL""",
    "api_link": f"""WITH {_PAGES}, n AS (SELECT page_id, regexp_replace(path, '[0-9]+', ':id', 'g') AS p, CASE WHEN page_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method FROM pg),
        m AS (SELECT page_id, method, {_NORM.format(x="p")} AS path FROM n),
        c AS (SELECT page_id AS call, method, {_SEGS.format(x="('/api' || path)")} AS segs FROM m),
        e0 AS (SELECT DISTINCT method, list_slice(segs, greatest(1, len(segs) - 1), len(segs)) AS segs FROM (SELECT method, page_id, {_SEGS.format(x="path")} AS segs FROM m) WHERE page_id % 3 = 0),
        e AS (SELECT method || ' /' || array_to_string(segs, '/') AS endpoint, method, segs, len(list_filter(segs, lambda s: s <> '*')) AS lit FROM e0),
        h AS (SELECT call, endpoint, lit, len(e.segs) AS n FROM c JOIN e ON c.method = e.method AND lit > 0 AND len(e.segs) <= len(c.segs) AND list_slice(c.segs, len(c.segs) - len(e.segs) + 1, len(c.segs)) = e.segs)
        SELECT call, endpoint, lit::INT AS literal_hits FROM h QUALIFY row_number() OVER (PARTITION BY call ORDER BY lit DESC, n DESC, endpoint) = 1""",
    "longest_prefix": f"""WITH {_PAGES}, p AS (SELECT page_id AS id, host || path AS path FROM pg),
        r AS (SELECT array_to_string(list_slice(string_split(path, '/'), 1, 2), '/') AS prefix FROM p WHERE id % 4 = 0 UNION SELECT string_split(path, '/')[1] FROM p)
        SELECT id AS call, arg_max(prefix, length(prefix)) AS prefix FROM p JOIN r ON prefix <> '' AND (path = prefix OR starts_with(path, prefix || '/')) GROUP BY id""",
    "calls_unique": """WITH c AS (SELECT DISTINCT 'f' || l_orderkey % 50 AS file, (p_size % 4)::VARCHAR AS repo, p_brand || p_partkey % 40 AS name FROM lineitem JOIN part ON l_partkey = p_partkey),
        f AS (SELECT 'd' || p_partkey AS id, 'f' || p_partkey % 50 AS home, (p_size % 4)::VARCHAR AS repo, p_brand || p_partkey % 40 AS name FROM part),
        s AS (SELECT file, repo, name, id FROM c JOIN f USING (repo, name) WHERE file = home),
        u AS (SELECT repo, name, min(id) AS id, min(home) AS home FROM f GROUP BY ALL HAVING count(*) = 1)
        SELECT file, id, 'same_file' AS role FROM s UNION ALL
        SELECT file, id, 'cross_file' FROM (SELECT * FROM c ANTI JOIN s USING (file, repo, name)) JOIN u USING (repo, name) WHERE file <> home""",
    "package_link": """WITH f AS (SELECT c_nationkey || ':' || c_mktsegment AS id, c_mktsegment AS name, c_nationkey AS repo, count(*) AS n FROM customer GROUP BY ALL),
        t AS (SELECT name, id, repo FROM f QUALIFY row_number() OVER (PARTITION BY name ORDER BY n DESC, id) = 1),
        p AS (SELECT f.id AS src, t.id AS dst FROM f JOIN t USING (name) WHERE f.id <> t.id AND f.repo <> t.repo)
        SELECT src, dst FROM p UNION ALL SELECT dst, src FROM p""",
    "folder_members": f"""WITH {_PAGES}, p AS (SELECT page_id AS id, host, ltrim(path, '/') AS path FROM pg),
        f AS (SELECT DISTINCT host, string_split(path, '/')[1] AS dir FROM p WHERE contains(path, '/'))
        SELECT p.host || '/' || dir AS src, id AS dst FROM p JOIN f ON f.host = p.host AND starts_with(path, dir || '/')""",
    "deploy_targets": """WITH e AS (SELECT DISTINCT c_nationkey AS k, c_mktsegment AS env FROM customer)
        SELECT n_nationkey::VARCHAR AS repo, s_name AS project, 'a' || n_nationkey AS app, env,
               CASE WHEN s_suppkey % 2 = 0 THEN 'own.' || s_name WHEN env = 'BUILDING' THEN 'b.example' END AS domain
        FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN e ON k = n_nationkey""",
    "anchors": """WITH d AS (SELECT doc_id AS id, lang, lower(string_split_regex(text, '[ \n]+')[1]) AS mention, count(*) OVER (PARTITION BY mention) AS n FROM documents),
        m AS (SELECT *, count(*) OVER (PARTITION BY mention) AS k FROM d WHERE n > 4 AND lang IN ('fr', 'es'))
        SELECT q.query_id::INT AS query_id, mention, id FROM d, (SELECT unnest([1, 2]) AS query_id) q WHERE n <= 4 UNION ALL SELECT 2, mention, id FROM m WHERE k <= 4""",
    "fragments": """WITH p AS (SELECT 'p' || p_partkey AS id, lower(replace(p_name || '_' || p_partkey, ' ', '_')) AS name FROM part),
        f AS (SELECT * FROM (VALUES (1, 'ring_15'), (2, 'widget_7'), (4, 'bolt_99'), (5, 'gear_1')) t(query_id, fragment)),
        h AS (SELECT query_id, fragment, id, count(*) OVER (PARTITION BY query_id) AS n FROM p JOIN f ON contains(name, fragment))
        SELECT query_id, fragment, id FROM h WHERE n <= 8""",
    "mentions": """WITH m AS (SELECT conv_id, turn, 'See /chat/ ' || role || '.py and snake_case_name or CamelCaseName at /admin/users ' || text AS t FROM conversations)
        SELECT conv_id, turn,
            array_to_string(list_transform(regexp_extract_all(t, '(?i)(?:^|[^\\pL\\pM\\pN_/])(/[a-z0-9][\\pL\\pM\\pN_\\-/\\[\\]]*)', 1), lambda r: CASE WHEN rtrim(r, '/') = '' THEN '/' ELSE rtrim(r, '/') END), '|') AS routes,
            array_to_string(regexp_extract_all(t, '(?i)[\\pL\\pM\\pN_\\-]+\\.(?:py|tsx?|jsx?|rs|vue|svelte|go|java|rb)\\b'), '|') AS files,
            array_to_string(list_filter(string_split_regex(t, '[^\\pL\\pM\\pN_]+'), lambda w: regexp_full_match(w, '[a-z]+(_[a-z0-9]+)+|[A-Z][a-z0-9]+([A-Z][a-z0-9]*)+')), '|') AS symbols
        FROM m""",
    "intent": f"""WITH c AS (SELECT lower(text || (['' || ' fix it', ' add this', ' why?', ' 삭제 수정', ''])[conv_id % 5 + 1]) AS t FROM conversations WHERE role = 'user'),
        s AS (SELECT {_COUNT.format(h=_HINTS["bug"])} AS b, {_COUNT.format(h=_HINTS["feature"])} AS f, {_COUNT.format(h=_HINTS["refactor"])} AS r, {_COUNT.format(h=_HINTS["question"])} AS q FROM c)
        SELECT CASE WHEN greatest(b, f, r) = 0 OR greatest(b, f, r) < q THEN 'question' WHEN b = greatest(b, f, r) THEN 'bug' WHEN f = greatest(b, f, r) THEN 'feature' ELSE 'refactor' END AS intent, count(*) AS n FROM s GROUP BY 1""",
    "cost_estimate": "SELECT role, sum(length(text) // 4)::BIGINT AS tokens FROM conversations GROUP BY role",
    "mask_secrets": f"""WITH {_PAGES}, t AS (SELECT *, (['glpat-', 'gldt-', 'ghp_', 'gho_', 'ghu_', 'ghs_', 'github_pat_', 'sk-', 'xoxb-'])[page_id % 9 + 1] AS mark FROM pg),
        k AS (SELECT *, CASE WHEN page_id % 10 = 0 THEN 'abcdefg' ELSE 'Abcdef-8' END AS secret FROM t)
        SELECT page_id, 'clone ' || CASE WHEN page_id % 2 = 0 THEN 'ssh' ELSE 'git+https' END || '://' || CASE WHEN page_id % 3 = 0 THEN 'bob:' ELSE '' END || '***@' || host
            || ' by ' || mark || CASE WHEN page_id % 10 = 0 THEN secret ELSE '***' END || ' or a_' || mark || secret AS masked FROM k""",
    "quality_score": """WITH o AS (SELECT count(DISTINCT l_partkey) AS f, sum(l_quantity) * 3 AS l, bool_or(l_returnflag = 'R') AS t FROM lineitem GROUP BY l_orderkey)
        SELECT round(least(1.0::DOUBLE, 0.6::DOUBLE + CASE WHEN f <= 5 THEN 0.2 ELSE 0 END + CASE WHEN l <= 400 THEN 0.1 ELSE 0 END + CASE WHEN t THEN 0.1 ELSE 0 END), 6) AS score, count(*) AS n FROM o GROUP BY 1""",
    "repo_profile": """WITH v AS (SELECT lang AS repo, lower(string_split_regex(text, '[ \n.,]+')[1]) AS name, source || '/' || doc_id % 3 AS folder FROM documents),
        f AS (SELECT repo, folder, row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, folder) AS p FROM v GROUP BY repo, folder QUALIFY p <= 6),
        n AS (SELECT repo, name, row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, name) AS p FROM v WHERE length(name) > 3 GROUP BY repo, name QUALIFY p <= 6)
        SELECT repo, count(*) AS nodes, (SELECT string_agg(folder, ',' ORDER BY p) FROM f WHERE f.repo = v.repo) AS folders, (SELECT string_agg(name, ',' ORDER BY p) FROM n WHERE n.repo = v.repo) AS names FROM v GROUP BY repo""",
    "refs_topn": """WITH w AS (SELECT doc_id AS id, unnest(regexp_extract_all(regexp_replace(text, '(ea|ou)', '\\1_', 'g'), '[A-Za-z_][A-Za-z0-9_]*')) AS word FROM documents),
        c AS (SELECT id, word, count(*) AS c FROM w WHERE length(word) >= 6 AND (contains(word, '_') OR (lower(word) <> word AND upper(word) <> word)) AND word <> 'thea_' GROUP BY ALL)
        SELECT id, row_number() OVER (PARTITION BY id ORDER BY c DESC, length(word) DESC, word) AS place, word, c FROM c QUALIFY place <= 5""",
    "labels_topn": """WITH w AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS word FROM documents), c AS (SELECT id, word, count(*) AS c FROM w GROUP BY ALL)
        SELECT id, row_number() OVER (PARTITION BY id ORDER BY c DESC, length(word) DESC, word) AS place, word, c FROM c QUALIFY place <= 3""",
    "call_names": """SELECT regexp_replace(p_type, '[^A-Za-z]+', '_', 'g') AS name, count(*) AS n FROM part GROUP BY 1
        UNION ALL SELECT unnest(['go', 'real', 'inner']), (SELECT count(*) FROM part)""",
    "learn_retrieve": """WITH n AS (SELECT source AS area, doc_id AS ts, lower(source || ' ' || text) AS t, text AS note FROM documents),
        s AS (SELECT *, len(list_filter(['the', 'license', 'and', 'security', 'error'], lambda w: contains(t, w)))::INT AS score FROM n)
        SELECT area, ts, score FROM s WHERE score > 0 ORDER BY score DESC, ts DESC, note LIMIT 5""",
    "learn_dedup": """WITH n AS (SELECT trim(regexp_replace(lower(source), '\\s+', ' ', 'g')) AS a, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS n, source, doc_id FROM documents),
        f AS (SELECT DISTINCT a, n FROM n WHERE doc_id % 2 = 1 EXCEPT SELECT a, n FROM n WHERE doc_id % 2 = 0)
        SELECT a AS area, count(*) AS fresh FROM f GROUP BY 1""",
    "ambiguous": """WITH c AS (SELECT string_split_regex(text, '[ \n]+')[1] AS title, lang, list_sort(list(DISTINCT source)) AS files FROM documents GROUP BY ALL)
        SELECT title, count(DISTINCT files) AS n FROM c GROUP BY 1 HAVING count(DISTINCT files) > 1""",
    "exclusions": """WITH d AS (SELECT *, doc_id % 10 AS k, (['Merge branch ', 'merge the ', '[Release] ', 'release: ', 'release note ', 'Revert ', 'reverted ', 'develop -> STG ', ' ', ''])[doc_id % 10 + 1]
            || substr(string_split(text, chr(10))[1], 1, 9) AS title FROM documents)
        SELECT CASE WHEN k IN (0, 2, 3, 5, 7) THEN 'bookkeeping' WHEN length(title) < 15 THEN 'short' WHEN doc_id % 7 = 4 THEN 'ambiguous' WHEN source = 'src3' THEN 'unindexed'
            WHEN doc_id % 6 = 5 THEN 'unexpanded' ELSE 'kept' END AS reason, count(*) AS n FROM d GROUP BY 1""",
    "stratified": """WITH d AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5('42:' || doc_id), doc_id) AS place, count(*) OVER (PARTITION BY lang, source) AS n FROM documents)
        SELECT doc_id, lang, source, place FROM d WHERE place <= greatest(1, round_even(150::DOUBLE * n / (SELECT count(*) FROM documents), 0))""",
    "budget_take": """WITH d AS (SELECT source, doc_id, sum(n_chars) OVER w AS used, row_number() OVER w AS p FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id))
        SELECT source, doc_id, used::BIGINT AS used FROM d WHERE used <= 12000 OR p = 1""",
    "failures": f"""WITH {_PAGES}, p AS (SELECT ltrim(path, '/') AS path, page_id FROM pg)
        SELECT CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE 'root' END AS area, count(*) AS n, count(*) FILTER (page_id % 3 = 0) AS not_found, count(*) FILTER (page_id % 2 = 0) AS hint_right FROM p GROUP BY 1""",
}
