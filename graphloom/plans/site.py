"""Queries over a graph of web pages: routes, page files, features, API calls and endpoints; and over small sources made of parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import rules
from graphloom.operators import evaluate, evolve, link, profile, rank, traverse
from graphloom.operators.fuse import promotion_path
from graphloom.operators.graph import PropertyGraph, union_all
from graphloom.plans.linking import _PAGES, _pages
from graphloom.plans.scratch import cut, spread
from graphloom.plans.tables import GRAPH_SQL, TOKENS_SQL, read, trade_graph
from graphloom.sources.extract import extract
from graphloom.sources.files import pick_routing_tables


def site_graph(spark: SparkSession, d: str) -> PropertyGraph:
    """Every fifth page has a route; pages import others (some that are gone) and their host's feature, hold calls and endpoints."""
    p = _pages(spark, d).select(F.col("page_id").alias("i"), "path", "host")
    key = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    node = lambda df, id_, kind, name, repo: df.select(id_.alias("id"), F.lit(kind).alias("kind"), name.alias("name"), repo.alias("repo"), F.concat("path", F.lit(".tsx")).alias("path"), F.col("i").alias("ord"))
    i, host = F.col("i"), F.col("host")
    nodes = union_all(
        [
            node(p, key("f:", i), "file", F.concat(F.lit("page"), (i % 60).cast("string"), F.lit(".tsx")), host),
            node(p.filter("i % 5 = 0"), key("r:", i), "route", F.concat(F.lit("/"), F.split_part("path", F.lit("/"), F.lit(2))), host),
            node(p.filter("i % 2 = 0"), key("c:", i), "api_call", F.col("path"), host),
            node(p.filter("i < 20"), key("e:", i), "endpoint", F.col("path"), host),
            node(p.groupBy("host").agg(F.min("i").alias("i"), F.min("path").alias("path")), key("d:", host), "feature", host, host),
        ]
    )
    edge = lambda df, src, dst, kind: df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"))
    edges = union_all(
        [
            edge(p.filter("i % 5 = 0"), key("r:", i), key("f:", i), "route_of"),
            edge(p, key("f:", i), key("f:", i * 3 + 1), "imports"),
            edge(p.filter("i % 3 = 0"), key("f:", i), key("d:", host), "imports"),
            edge(p.filter("i % 4 = 1"), key("d:", host), key("f:", i), "contains"),
            edge(p.filter("i % 2 = 0"), key("f:", i), key("c:", i), "contains"),
            edge(p.filter("i % 7 = 0"), key("f:", i), key("e:", i % 20), "contains"),
            edge(p.filter("i % 2 = 0"), key("c:", i), key("e:", i % 20), "resolves_to"),
            edge(p.filter("i % 9 = 0"), key("f:", i), key("e:", i % 20), "resolves_to"),
        ]
    )
    return PropertyGraph(nodes, edges)


_SITE = f"""{_PAGES}, p AS (SELECT page_id AS i, path, host FROM pg),
    nodes AS (
        SELECT 'f:' || i AS id, 'file' AS kind, 'page' || i % 60 || '.tsx' AS name, host AS repo, i AS ord FROM p
        UNION ALL SELECT 'r:' || i, 'route', '/' || split_part(path, '/', 2), host, i FROM p WHERE i % 5 = 0
        UNION ALL SELECT 'c:' || i, 'api_call', path, host, i FROM p WHERE i % 2 = 0
        UNION ALL SELECT 'e:' || i, 'endpoint', path, host, i FROM p WHERE i < 20
        UNION ALL SELECT 'd:' || host, 'feature', host, host, min(i) FROM p GROUP BY host),
    edges AS (
        SELECT 'r:' || i AS src, 'f:' || i AS dst, 'route_of' AS kind FROM p WHERE i % 5 = 0
        UNION ALL SELECT 'f:' || i, 'f:' || (i * 3 + 1), 'imports' FROM p
        UNION ALL SELECT 'f:' || i, 'd:' || host, 'imports' FROM p WHERE i % 3 = 0
        UNION ALL SELECT 'd:' || host, 'f:' || i, 'contains' FROM p WHERE i % 4 = 1
        UNION ALL SELECT 'f:' || i, 'c:' || i, 'contains' FROM p WHERE i % 2 = 0
        UNION ALL SELECT 'f:' || i, 'e:' || i % 20, 'contains' FROM p WHERE i % 7 = 0
        UNION ALL SELECT 'c:' || i, 'e:' || i % 20, 'resolves_to' FROM p WHERE i % 2 = 0
        UNION ALL SELECT 'f:' || i, 'e:' || i % 20, 'resolves_to' FROM p WHERE i % 9 = 0)"""


def trace_flow(spark: SparkSession, d: str) -> DataFrame:
    """Every route of the site, three levels deep."""
    g = site_graph(spark, d)
    return traverse.trace_flow(g.nodes, g.edges, g.nodes.filter("kind = 'route'").select("id"), 3)


def affected_routes(spark: SparkSession, d: str) -> DataFrame:
    g = site_graph(spark, d)
    changed = g.nodes.filter("kind = 'file' and ord % 50 = 11").select("id")
    return traverse.affected_routes(g.nodes, g.edges, changed, most=12)


def hub_seeds(spark: SparkSession, d: str) -> DataFrame:
    g = trade_graph(spark, d)
    return traverse.hub_seeds(g.nodes, g.edges)


def retrieve_chain(spark: SparkSession, d: str) -> DataFrame:
    """Regions and their first nations as hits; nations are led to by their region, too."""
    g = trade_graph(spark, d)
    n = read(spark, d, "nation").select(F.col("n_regionkey").alias("query_id"), F.col("n_nationkey").alias("k"))
    first = profile.top_per_group(n, ["query_id"], 5, F.asc("k")).select("query_id", (F.col("place") + 1).alias("rank"), F.concat(F.lit("n:"), "k").alias("id"))
    own = read(spark, d, "region").select(F.col("r_regionkey").alias("query_id"), F.lit(1).alias("rank"), F.concat(F.lit("r:"), "r_regionkey").alias("id"))
    out = traverse.retrieve_chain(g.nodes, g.edges, own.unionAll(first), k=6)
    return out.select("query_id", "rank", "id", "rrf", F.array_join("relations", ",").alias("relations"), "hop")


def nodes_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return site_graph(spark, d).nodes_by_kind("route", "endpoint").select("id", "kind", "name")


def _functions(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    name = F.concat_ws("_", F.replace("p_name", F.lit(" "), F.lit("_")), (key % 40).cast("string"))
    return read(spark, d, "part").select(
        F.concat(F.lit("p:"), key).alias("id"), F.lit("function").alias("kind"), F.when(key % 2 == 0, F.concat(F.lit("Mod::"), name)).otherwise(name).alias("name"),
        (F.col("p_size") % 30).cast("string").alias("repo"), F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"), "p_brand", F.lit(".rs")).alias("path"), key.alias("ord"),
    )


def endpoint_handlers(spark: SparkSession, d: str) -> DataFrame:
    """Endpoints for three parts each, named with a module that is the part's folder, with another, or without one."""
    key = F.col("p_partkey")
    bare = F.concat_ws("_", F.replace("p_name", F.lit(" "), F.lit("_")), (key % 40).cast("string"))
    module = F.when(key % 9 == 0, F.concat(F.lit("routes::"), F.lower("p_type"), F.lit("::"))).when(key % 9 == 3, "nowhere::").otherwise("")
    e = read(spark, d, "part").filter("p_partkey % 3 = 0").select(F.concat(F.lit("e:"), key).alias("id"), (F.col("p_size") % 30).cast("string").alias("repo"), F.when(key % 27 == 6, "").otherwise(F.concat(module, bare)).alias("handler"))
    return link.link_handlers(e, _functions(spark, d))


_REQUESTS = (
    (1, "open /en/ now", "blog code"), (2, "see PAGE7.tsx please", ""), (3, "fix Small_ring_4 then", ""), (4, "why does ot_widget_1 break", ""),
    (5, "the /de/ page", "net"), (6, "nothing named", "blog"), (7, "call red_widget_21 and /fr/ for m.example", ""),
)


def find_anchors(spark: SparkSession, d: str) -> DataFrame:
    f = _functions(spark, d)
    f = f.select("id", "kind", F.element_at(F.split("name", "::"), -1).alias("name"), F.concat(F.lit("store"), "repo").alias("repo"))
    site = site_graph(spark, d).nodes.select("id", "kind", "name", "repo", F.when(F.col("kind") == "endpoint", F.concat(F.lit("/"), F.split_part("name", F.lit("/"), F.lit(2)))).alias("route_path"))
    asked = spark.createDataFrame(list(_REQUESTS), "query_id int, text string, hint string")
    return link.find_anchors(site.unionByName(f, allowMissingColumns=True), asked)


def rank_within(spark: SparkSession, d: str) -> DataFrame:
    """Nodes two steps around a page, nearest to a request first."""
    g = site_graph(spark, d)
    near = traverse.expand(g.edges, spark.createDataFrame([("f:1",), ("f:4",)], "id string"), 2, None)
    scope = near.join(g.nodes, "id").select(F.lit(1).alias("query_id"), "id", "kind", "name", F.lit("").alias("path"), F.col("distance").alias("hop"))
    asked = spark.createDataFrame([(1, ["page4", "tsx", "com", "en"])], "query_id int, words array<string>")
    return profile.rank_within(scope, asked, 40)


def host_links(spark: SparkSession, d: str) -> DataFrame:
    """Pages as gateway routes, hosts of every second page as repositories."""
    p = _pages(spark, d)
    repos = p.filter("page_id % 2 = 0").select("host").distinct().select(F.concat(F.lit("repo "), "host").alias("id"), F.col("host").alias("name"))
    return link.link_hosts(p.select(F.col("page_id").alias("id"), "host"), repos)


def import_targets(spark: SparkSession, d: str) -> DataFrame:
    """Imports of brands by alias, of types by workspace, and of things unknown."""
    part = read(spark, d, "part")
    brand = F.replace("p_brand", F.lit("#"), F.lit(""))
    files = part.select(F.lit("r").alias("repo"), F.concat(F.lit("web/src/"), brand, F.when(F.col("p_size") % 2 == 0, ".tsx").otherwise("/index.ts")).alias("path")).distinct()
    files = files.withColumn("id", F.concat(F.lit("r:"), "path"))
    spec = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("@/"), brand)).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("@x/"), F.lower("p_type"), F.lit("/deep"))).otherwise("gone")
    imports = part.select(F.concat(F.lit("f"), "p_partkey").alias("src"), F.lit("r").alias("repo"), spec.alias("spec"))
    aliases = spark.createDataFrame([("r", "@", "lib"), ("r", "@/", "web/src")], "repo string, alias string, target string")
    ways = spark.createDataFrame([("r", "@x/small", "packages/small"), ("r", "@x/economy", "packages/economy")], "repo string, name string, dir string")
    return link.resolve_specs(imports, files, aliases, ways)


# text rules


def branch_lint(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part")
    i = F.col("p_partkey")
    name = F.element_at(
        F.array(
            F.concat(F.lit("chore/"), F.replace("p_name", F.lit(" "), F.lit("-"))), F.concat(F.lit("topic/"), "p_name"), F.lit("fix/"), F.lit("fix/abc"),
            F.concat(F.lit("feature/25"), F.lpad((i % 100).cast("string"), 4, "0")), F.lit("hotfix/TEMP"), F.lit("main"),
        ),
        (i % 7 + 1).cast("int"),
    )
    out = part.select(F.coalesce(rules.branch_issue(name), F.lit("fit")).alias("issue"), rules.is_protected(name).alias("protected"))
    return out.groupBy("issue", "protected").agg(F.count(F.lit(1)).alias("n"))


def branch_names(spark: SparkSession, d: str) -> DataFrame:
    words = F.array(F.col("p_name"), F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.lit("s")), F.lit("wip 12 v2"), F.lower("p_type"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), F.lit("end of it"))
    return read(spark, d, "part").groupBy(rules.suggest_branch("fix/", words).alias("branch")).agg(F.count(F.lit(1)).alias("n"))


def infra_paths(spark: SparkSession, d: str) -> DataFrame:
    made = F.element_at(F.array(*map(F.lit, ("Charts/a.yaml", "src/chart_service.py", "a\\k8s\\b.py", "x/DOCKERFILE.dev", "values-prd.yml", "my_values.yml", "m/main.TF", "readme.md"))), (F.col("page_id") % 8 + 1).cast("int"))
    return read(spark, d, "pages").select(made.alias("path")).groupBy("path", rules.is_infra(F.col("path")).alias("infra")).agg(F.count(F.lit(1)).alias("n"))


def node_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts to embed, by their md5."""
    n = _functions(spark, d).withColumns({"doc": F.when(F.col("ord") % 2 == 0, F.concat(F.lit("  About "), "name", F.lit(" "), F.repeat(F.lit("x"), F.lit(500)))), "labels": F.when(F.col("ord") % 3 == 0, F.col("path"))})
    return n.select("id", F.md5(rules.node_text(n)).alias("text_md5"))


def template_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Parts as functions of files, one a brand."""
    f = _functions(spark, d).withColumns({"line": F.lit(3), "doc": F.when(F.col("ord") % 5 == 0, F.concat(F.lit("Runs "), "name"))})
    brand = read(spark, d, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("ord"))
    files = brand.select(F.concat(F.lit("b:"), "p_brand").alias("id"), F.lit("file").alias("kind"), F.col("p_brand").alias("name"), F.lit("r").alias("repo"), F.col("p_brand").alias("path"), F.lit(0).alias("line"), F.lit(None).cast("string").alias("doc"), "ord")
    inside = read(spark, d, "part").select(F.concat(F.lit("b:"), "p_brand").alias("src"), F.concat(F.lit("p:"), "p_partkey").alias("dst"), F.lit("contains").alias("kind"))
    return rules.summaries(files.unionByName(f.select(*files.columns)), inside)


def related_tests(spark: SparkSession, d: str) -> DataFrame:
    """Tests named after parts, or mentioning one, of which two are changed."""
    part = read(spark, d, "part").select(F.concat(F.lit("tests/test_item"), "p_partkey", F.lit(".py")).alias("path"), F.when(F.col("p_partkey") % 11 == 0, "import src.item42").otherwise("pass").alias("text"))
    return rules.related_tests(part, spark.createDataFrame([("src/item42.py",), ("src/item1999.py",)], "path string"))


def first_json(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_id", F.concat(F.lit("so {x} then "), "props", F.lit(' or {"k": 0}')).alias("t"))
    got = e.select(F.get_json_object(rules.first_json_column(F.col("t")), "$.k").alias("k"))
    return got.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def promotion_paths(spark: SparkSession, d: str) -> DataFrame:
    ladder = F.array(*map(F.lit, ("MACHINERY", "BUILDING", "AUTOMOBILE", "FURNITURE")))
    return read(spark, d, "customer").groupBy("c_mktsegment", F.array_join(promotion_path(F.col("c_mktsegment"), ladder), ">").alias("path")).agg(F.count(F.lit(1)).alias("n"))


# change and evaluation


def changed_files(spark: SparkSession, d: str) -> DataFrame:
    """Pages as paths: committed ones, and a working tree's state with renames."""
    p = _pages(spark, d)
    committed = p.filter("page_id % 3 = 0").select(F.concat(F.lit("a\\"), "page_id", F.lit(".py")).alias("path"))
    tree = p.filter("page_id % 4 = 0").select(F.when(F.col("page_id") % 8 == 0, "R ").otherwise(" M").alias("status"), F.concat(F.lit("a/"), "page_id", F.lit(".py")).alias("path"), F.concat(F.lit("old"), "page_id").alias("before"))
    return evolve.relevant(evolve.changed_files(committed, tree), "a")


def stale_repos(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "nation").select(F.col("n_name").alias("repo"), "n_nationkey", F.md5("n_name").alias("m"))
    old = n.select("repo", F.when(F.col("n_nationkey") % 5 != 0, F.col("m")).alias("head"))
    new = n.filter("n_nationkey % 4 <> 1").select("repo", F.when(F.col("n_nationkey") % 3 == 0, F.md5("m")).otherwise(F.substring("m", 1, 12)).alias("head"))
    return evaluate.stale_repos(old, new)


def pull_plan(spark: SparkSession, d: str) -> DataFrame:
    """Customers as clones in every state; those of one nation and segment share a folder."""
    c = read(spark, d, "customer")
    i = F.col("c_custkey")
    state = c.select(
        i.alias("ord"), F.col("c_name").alias("repo"), F.concat_ws("/", "c_nationkey", "c_mktsegment").alias("root"), (i % 11 != 0).alias("is_git"), (i % 7 != 0).alias("fetched"),
        (i % 5 == 0).alias("dirty"), F.when(i % 13 != 0, i % 3).alias("ahead"), F.when(i % 13 != 0, i % 2).alias("behind"), (i % 17 != 0).alias("forwarded"),
    )
    return evolve.pull_plan(state).groupBy("action", "shared").agg(F.count(F.lit(1)).alias("n"))


def sync_sources(spark: SparkSession, d: str) -> DataFrame:
    """Nations as sources whose parts changed: nodes and edges after the refresh, the new routing table and the repair."""
    f = _functions(spark, d)
    old = f.filter("ord % 6 <> 1").select("id", "kind", "name", "repo", F.col("id").alias("path"), "ord")
    gates = read(spark, d, "nation").select(F.concat(F.lit("g:"), "n_nationkey").alias("id"), F.lit("gateway_route").alias("kind"), F.col("n_name").alias("name"), F.lit("gw").alias("repo"), F.lit("routes.yml").alias("path"), F.lit(0).cast("long").alias("ord"))
    edges = f.select(F.col("id").alias("src"), F.concat(F.lit("p:"), F.col("ord") + 1).alias("dst"), F.lit("calls").alias("kind"))
    edges = edges.unionAll(gates.select(F.col("id").alias("src"), F.lit("p:0").alias("dst"), F.lit("serves").alias("kind")))
    graph = PropertyGraph(old.unionAll(gates), edges)
    changed = f.filter("ord % 12 = 1").select("repo", F.col("id").alias("path"))
    fresh = f.filter("ord % 12 = 1").select("id", "kind", F.concat("name", F.lit("!")).alias("name"), "repo", F.col("id").alias("path"), "ord")
    again = edges.filter("kind = 'calls'").join(fresh.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst", "kind")
    table = gates.filter("id <> 'g:3'")
    gateway = PropertyGraph(table, table.select(F.col("id").alias("src"), F.lit("p:2").alias("dst"), F.lit("serves").alias("kind")))
    out, report = evolve.sync_all(graph, changed, PropertyGraph(fresh, again), gateway)
    n = out.nodes.groupBy(F.concat(F.lit("node "), "kind").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    e = out.edges.groupBy(F.concat(F.lit("edge "), "kind").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    return n.unionAll(e).unionAll(report.select(F.concat(F.lit("report "), "action").alias("part"), "n"))


def ghost_calls(spark: SparkSession, d: str) -> DataFrame:
    """Names called in sources with a comment and a string that hold other calls, with and without them."""
    from graphloom.sources.extract import CALL, NOT_CALLS, call_names

    p = read(spark, d, "part").select(F.concat(F.lit("p:"), "p_partkey").alias("id"), F.concat(F.regexp_replace("p_type", "[^A-Za-z]+", "_"), F.lit("(1) # ghost(2)\nx = 'no(3)' + real(4) if (5) else 6")).alias("t"))
    raw = F.filter(F.regexp_extract_all("t", F.lit(CALL), F.lit(1)), lambda n: ~n.isin(NOT_CALLS))
    return evaluate.ghost_calls(p.select("id", raw.alias("raw"), call_names(F.col("t")).alias("clean")))


def symbol_accuracy(spark: SparkSession, d: str) -> DataFrame:
    f = _functions(spark, d)
    n = f.select("id", "kind", "name", "repo", "path", (F.col("ord") % 3).cast("int").alias("line"))
    lines = f.select("repo", "path", F.explode(F.array(F.lit(1), F.lit(2))).alias("line"), F.concat(F.lit("fn "), "name").alias("text")).dropDuplicates(["repo", "path", "line", "text"])
    one = lines.groupBy("repo", "path", "line").agg(F.array_join(F.array_sort(F.collect_set("text")), " ").alias("text"))
    return evaluate.symbol_accuracy(n, one)


def lexicon_bridge(spark: SparkSession, d: str) -> DataFrame:
    """Part types as learned terms of part names."""
    part = read(spark, d, "part")
    learned = profile.lexicon(part.select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("words"), F.array(F.lower("p_type")).alias("terms")), 5)
    asked = spark.createDataFrame([(1, ["small", "ring", "zebra"]), (2, ["hot", "hot", "gear"])], "query_id int, tokens array<string>")
    return profile.bridge(asked, learned).select("query_id", F.array_join("tokens", " ").alias("tokens"))


def name_and_hint_rank(spark: SparkSession, d: str) -> DataFrame:
    """A name that is the request goes first, one that holds it second; a hinted repository lifts the rest."""
    n = read(spark, d, "part").select(F.concat(F.lit("p:"), F.lpad("p_partkey", 9, "0")).alias("id"), F.lit("function").alias("kind"), F.concat_ws(" ", "p_name", F.when(F.col("p_partkey") % 50 > 0, F.concat(F.lit("x"), F.col("p_partkey") % 50))).alias("name"), F.concat(F.lit("store"), F.col("p_size") % 5).alias("repo"))
    q = spark.createDataFrame([(1, "small ring", "store1"), (2, "hot gear", None), (3, "ring x4", "store2")], "query_id int, text string, hint_repo string")
    return rank.search(rank.Index.build(n), q, 10, prefixes=False, digits=6).select("query_id", "rank", "id", "score")


# sources, file by file


def _sources(spark: SparkSession, d: str, path: Column, text: Column) -> DataFrame:
    return read(spark, d, "part").select(F.lit("r").alias("repo"), path.alias("path"), text.alias("text"))


def _rows(files: DataFrame) -> DataFrame:
    r = extract(files)
    return r.select("part", "kind", F.coalesce("id", F.concat_ws(" ", "src", "dst")).alias("key"), F.coalesce("line", F.lit(0)).alias("line"))


def _made(*pieces: str) -> Column:
    """A source text; ``@`` stands for a part's key."""
    return F.replace(F.lit("\n".join(pieces)), F.lit("@"), F.col("p_partkey").cast("string"))


def extract_python(spark: SparkSession, d: str) -> DataFrame:
    text = _made("import os", "from pkg.mod@ import thing", 'router = APIRouter(prefix="/v@")', '@@router.get("/x")'.replace("@@", "\\"), "def go(): return helper()", "def helper(): pass", "class Part@:", "    def run(self): pass")
    return _rows(_sources(spark, d, F.concat(F.lit("m"), "p_partkey", F.lit(".py")), F.replace(text, F.lit("\\"), F.lit("@"))))


def extract_script(spark: SparkSession, d: str) -> DataFrame:
    text = _made("import { a } from './side@'", "import x from 'pkg'", "export default function Page() {", "  return api.post(`/u/${id}/p@?q=1`)", "}", "export class Store@ {}")
    return _rows(_sources(spark, d, F.concat(F.lit("app/(g)/p"), "p_partkey", F.lit("/page.tsx")), text))


def extract_rust(spark: SparkSession, d: str) -> DataFrame:
    text = _made("use crate::db::pool;", "pub struct Part@;", "impl Part@ {", "    pub async fn run(&self) {}", "}", 'fn app() { r.route("/p@", get(mod_@::show)); }', "fn show() {}")
    return _rows(_sources(spark, d, F.concat(F.lit("src/m"), "p_partkey", F.lit(".rs")), text))


def extract_config(spark: SparkSession, d: str) -> DataFrame:
    """Names of configurations, as the node's references."""
    text = _made("name: part@", "items:", "  - alpha_@", "flag: true")
    r = extract(_sources(spark, d, F.concat(F.lit("c"), "p_partkey", F.lit(".yml")), text)).filter("part = 'node'")
    return r.select("id", "refs")


def extract_gateway(spark: SparkSession, d: str) -> DataFrame:
    """Two routing tables a repository, of which the main one counts."""
    text = _made("base_path: /api/", "services:", "  s@:", "    host: http://h@:80", "    modules: [m@, /n@/]")
    part = spread(read(spark, d, "part"))
    one = part.select(F.concat(F.lit("r"), "p_partkey").alias("repo"), F.lit("gw/services.yml").alias("path"), text.alias("text"))
    two = part.filter("p_partkey % 2 = 0").select(F.concat(F.lit("r"), "p_partkey").alias("repo"), F.lit("gw/deep/services.yml").alias("path"), F.replace(text, F.lit("m"), F.lit("z")).alias("text"))
    routes = extract(one.unionAll(two)).filter("kind = 'gateway_route'").select("kind", "repo", "path", "id", "service", "host", "prefix")
    # parsed once: the main tables are told from the same rows
    return pick_routing_tables(cut(routes, "gateway-routes")).select("id", "service", "host", "prefix")


def extract_infra(spark: SparkSession, d: str) -> DataFrame:
    text = _made("destinations:", "  prd: {domain: p@.example}", "environments:", "  prd: {services: [{name: app@, hasDomain: true}]}", "  dev: {services: [{name: app@}]}")
    r = extract(_sources(spark, d, F.concat(F.lit("projects/p"), "p_partkey", F.lit(".yaml")), text), infra=True).filter("part = 'edge' and kind in ('deploys', 'serves')")
    return r.select("kind", "src", "dst", "role")


QUERIES = {
    f.__name__: f
    for f in (
        trace_flow, affected_routes, hub_seeds, retrieve_chain, nodes_by_kind, endpoint_handlers, find_anchors, rank_within, host_links, import_targets,
        branch_lint, branch_names, infra_paths, node_texts, template_summaries, related_tests, first_json, promotion_paths, changed_files, stale_repos,
        pull_plan, sync_sources, ghost_calls, symbol_accuracy, lexicon_bridge, name_and_hint_rank, extract_python, extract_script, extract_rust,
        extract_config, extract_gateway, extract_infra,
    )
}

_TOK = TOKENS_SQL.format
_BARE = "replace(p_name, ' ', '_') || '_' || p_partkey % 40"
_FUNCTIONS = f"""fn AS (SELECT 'p:' || p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'Mod::' ELSE '' END || {_BARE} AS name, {_BARE} AS bare,
    (p_size % 30)::VARCHAR AS repo, 'src/' || lower(p_type) || '/' || p_brand || '.rs' AS path, p_partkey AS ord FROM part)"""

ORACLE_SQL = {
    "trace_flow": f"""WITH RECURSIVE {_SITE}, walk(route, id, d) AS (
            SELECT src, dst, 0 FROM edges WHERE kind = 'route_of'
            UNION SELECT w.route, e.dst, w.d + 1 FROM walk w JOIN nodes n ON n.id = w.id AND n.kind <> 'api_call' JOIN edges e ON e.src = w.id JOIN nodes t ON t.id = e.dst
            WHERE w.d < 3 AND (e.kind = 'imports' OR e.kind = 'contains' AND t.kind IN ('file', 'api_call'))),
        found AS (SELECT route, id, min(d) AS d FROM walk GROUP BY ALL)
        SELECT route, kind || 's' AS part, id FROM found JOIN nodes USING (id) WHERE kind IN ('file', 'feature') AND d < 3
        UNION SELECT route, 'api_calls', id FROM found JOIN nodes USING (id) WHERE kind = 'api_call'
        UNION SELECT route, 'endpoints', dst FROM found JOIN nodes USING (id) JOIN edges ON src = id WHERE nodes.kind = 'api_call' AND edges.kind = 'resolves_to'""",
    "affected_routes": f"""WITH RECURSIVE {_SITE}, walk(id, d) AS (
            SELECT id, 0 FROM nodes WHERE kind = 'file' AND ord % 50 = 11
            UNION SELECT e.src, w.d + 1 FROM walk w JOIN edges e ON e.dst = w.id WHERE w.d < 4 AND e.kind IN ('imports', 'contains', 'same_package'))
        SELECT id, name FROM nodes WHERE kind = 'route' AND id IN (SELECT src FROM edges WHERE kind = 'route_of' AND dst IN (SELECT id FROM walk)) ORDER BY ord, id LIMIT 12""",
    "hub_seeds": f"""WITH {GRAPH_SQL}, ends AS (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges),
        top AS (SELECT id, count(*) AS n FROM ends GROUP BY 1 ORDER BY n DESC, id LIMIT 14) SELECT id FROM top WHERE id IN (SELECT id FROM nodes)""",
    "retrieve_chain": f"""WITH {GRAPH_SQL}, x AS (SELECT DISTINCT src, dst, kind FROM edges WHERE kind IN ('imports', 'calls', 'resolves_to', 'contains')),
        s AS (SELECT r_regionkey AS query_id, 0 AS place, 'r:' || r_regionkey AS id FROM region
              UNION ALL SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), 'n:' || n_nationkey FROM nation QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) <= 5),
        w1 AS (SELECT query_id, dst AS id, kind, 1 AS hop FROM s JOIN x ON x.src = s.id),
        w2 AS (SELECT query_id, dst, kind, 2 FROM (SELECT DISTINCT query_id, id FROM w1 ANTI JOIN s USING (query_id, id)) f JOIN x ON x.src = f.id),
        r AS (SELECT query_id, id, min(hop) AS hop, string_agg(DISTINCT kind, ',' ORDER BY kind) AS relations FROM (SELECT * FROM w1 UNION ALL SELECT * FROM w2) GROUP BY 1, 2),
        g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hop, id) - 1 AS step FROM r),
        b AS (SELECT query_id, id, round(coalesce(1::DOUBLE / (60 + place), 0) + coalesce(0.5::DOUBLE / (60 + step), 0), 12) AS score, coalesce(relations, 'seed') AS relations, coalesce(hop, 0) AS hop
              FROM g FULL JOIN s USING (query_id, id) WHERE id IN (SELECT id FROM nodes))
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, round(score, 5) AS rrf, relations, hop FROM b QUALIFY rank <= 24""",
    "nodes_by_kind": f"WITH {_SITE} SELECT id, kind, name FROM nodes WHERE kind IN ('route', 'endpoint')",
    "endpoint_handlers": f"""WITH {_FUNCTIONS}, e AS (SELECT 'e:' || p_partkey AS src, (p_size % 30)::VARCHAR AS repo, {_BARE} AS bare,
            CASE p_partkey % 9 WHEN 0 THEN lower(p_type) WHEN 3 THEN 'nowhere' ELSE '' END AS module FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 27 <> 6),
        h AS (SELECT src, fn.id, ord, module <> '' AND contains(path, module) AS near, count(*) OVER (PARTITION BY src) AS n FROM e JOIN fn USING (repo, bare))
        SELECT src, coalesce(arg_min(id, ord) FILTER (near), min(id) FILTER (n = 1)) AS dst FROM h GROUP BY src HAVING dst IS NOT NULL""",
    "find_anchors": f"""WITH {_SITE}, {_FUNCTIONS},
        v AS (SELECT id, repo, 'route' AS sort, lower(name) AS name FROM nodes WHERE kind = 'route' UNION ALL SELECT id, repo, 'route', '/' || lower(split_part(name, '/', 2)) FROM nodes WHERE kind = 'endpoint'
              UNION ALL SELECT id, repo, 'file', lower(name) FROM nodes WHERE kind = 'file' UNION ALL SELECT id, 'store' || repo, 'symbol', lower(bare) FROM fn),
        m AS (SELECT * FROM (VALUES (1, 'route', '/en'), (2, 'file', 'page7.tsx'), (3, 'symbol', 'small_ring_4'), (4, 'symbol', 'ot_widget_1'), (5, 'route', '/de'), (7, 'symbol', 'red_widget_21'), (7, 'route', '/fr')) t(query_id, sort, name)),
        k AS (SELECT * FROM (VALUES (1, 'blog'), (1, 'code'), (1, 'open'), (1, 'en'), (1, 'now'), (2, 'page7'), (5, 'net'), (5, 'de'), (5, 'page'), (5, 'the'), (7, 'm'), (7, 'example'), (7, 'for')) t(query_id, token)),
        h AS (SELECT query_id, sort || ':' || name AS mention, id, repo, count(*) OVER (PARTITION BY query_id, sort, name) AS n FROM v JOIN m USING (sort, name)),
        near AS (SELECT *, count(*) OVER (PARTITION BY query_id, mention) AS c FROM h WHERE n > 4 AND EXISTS (SELECT 1 FROM k WHERE k.query_id = h.query_id AND list_contains({_TOK(x="h.repo")}, token))),
        a AS (SELECT query_id, mention, id FROM h WHERE n <= 4 UNION ALL SELECT query_id, mention, id FROM near WHERE c <= 4),
        q AS (SELECT * FROM (VALUES (4, 'ot_widget_1'), (7, 'red_widget_21')) t(query_id, fragment) WHERE query_id NOT IN (SELECT query_id FROM a)),
        z AS (SELECT query_id, fragment, id, count(*) OVER (PARTITION BY query_id, fragment) AS n FROM q JOIN fn ON contains(lower(bare), fragment))
        SELECT query_id::INT AS query_id, mention, id FROM a UNION ALL SELECT query_id::INT, 'part:' || fragment, id FROM z WHERE n <= 8""",
    "rank_within": f"""WITH RECURSIVE {_SITE}, walk(id, hop) AS (SELECT unnest(['f:1', 'f:4']), 0
            UNION SELECT e.dst, w.hop + 1 FROM walk w JOIN edges e ON e.src = w.id WHERE w.hop < 2 AND e.kind IN ('route_of', 'contains', 'imports', 'resolves_to')),
        f AS (SELECT id, min(hop) AS hop FROM walk GROUP BY id),
        s AS (SELECT id, hop, len(list_intersect(['page4', 'tsx', 'com', 'en'], {_TOK(x="name")})) * 10 * CASE WHEN kind IN ('function', 'class', 'file') THEN 2 ELSE 1 END - hop AS score FROM f JOIN nodes USING (id))
        SELECT 1 AS query_id, row_number() OVER (ORDER BY score DESC, hop, id) AS place, id, score::DOUBLE AS score FROM s QUALIFY place <= 40""",
    "host_links": f"WITH {_PAGES} SELECT page_id AS route, 'repo ' || host AS repo FROM pg WHERE host IN (SELECT host FROM pg WHERE page_id % 2 = 0)",
    "import_targets": """WITH f AS (SELECT DISTINCT replace(p_brand, '#', '') AS brand, p_size % 2 = 0 AS tsx FROM part),
        b AS (SELECT brand, 'r:web/src/' || brand || CASE WHEN bool_or(tsx) THEN '.tsx' ELSE '/index.ts' END AS id FROM f GROUP BY 1)
        SELECT 'f' || p_partkey AS src, '@/' || brand AS spec, 'file' AS kind, id AS target FROM part JOIN b ON brand = replace(p_brand, '#', '') WHERE p_partkey % 3 = 0
        UNION ALL SELECT 'f' || p_partkey, '@x/' || lower(p_type) || '/deep', 'feature', '@x/' || lower(p_type) FROM part WHERE p_partkey % 3 = 1 AND lower(p_type) IN ('small', 'economy')""",
    "branch_lint": """SELECT CASE p_partkey % 7 WHEN 0 THEN 'fit' WHEN 2 THEN 'empty' WHEN 3 THEN 'short' WHEN 4 THEN 'meaningless' WHEN 5 THEN 'meaningless' ELSE 'prefix' END AS issue,
        p_partkey % 7 = 6 AS protected, count(*) AS n FROM part GROUP BY ALL""",
    "branch_names": """SELECT 'fix/' || replace(p_name, ' ', '-') || CASE WHEN list_contains(string_split(p_name, ' '), lower(p_type)) THEN '-brand-end' ELSE '-' || lower(p_type) || '-brand' END AS branch, count(*) AS n FROM part GROUP BY 1""",
    "infra_paths": """WITH v AS (SELECT * FROM (VALUES (0, 'Charts/a.yaml', true), (1, 'src/chart_service.py', false), (2, 'a\\k8s\\b.py', true), (3, 'x/DOCKERFILE.dev', true),
        (4, 'values-prd.yml', true), (5, 'my_values.yml', false), (6, 'm/main.TF', true), (7, 'readme.md', false)) t(k, path, infra)) SELECT path, infra, count(*) AS n FROM pages JOIN v ON k = page_id % 8 GROUP BY ALL""",
    "node_texts": f"""WITH {_FUNCTIONS} SELECT id, md5('function ' || name || ' — ' || repo || '/' || path || CASE WHEN ord % 2 = 0 THEN ' — ' || substr('About ' || name || ' ' || repeat('x', 500), 1, 400) ELSE '' END
        || CASE WHEN ord % 3 = 0 THEN ' — ' || path ELSE '' END) AS text_md5 FROM fn""",
    "template_summaries": f"""WITH {_FUNCTIONS}, m AS (SELECT p_brand, p_partkey AS ord FROM part),
        l AS (SELECT p_brand, string_agg(name, ', ' ORDER BY ord) AS names FROM (SELECT p_brand, name, fn.ord FROM m JOIN fn USING (ord) QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY fn.ord) <= 5) GROUP BY 1)
        SELECT id, CASE WHEN ord % 5 = 0 THEN 'Runs ' || name ELSE 'function ' || name || ' at ' || path || ':3' END AS summary FROM fn
        UNION ALL SELECT 'b:' || p_brand, 'File: functions ' || names FROM l""",
    "related_tests": "SELECT 'tests/test_item' || p_partkey || '.py' AS path FROM part WHERE contains('item' || p_partkey, 'item42') OR contains('item' || p_partkey, 'item1999') OR p_partkey % 11 = 0",
    "first_json": "SELECT props->>'$.k' AS k, count(*) AS n FROM events GROUP BY 1",
    "promotion_paths": """SELECT c_mktsegment, CASE c_mktsegment WHEN 'MACHINERY' THEN 'BUILDING>AUTOMOBILE>FURNITURE' WHEN 'BUILDING' THEN 'AUTOMOBILE>FURNITURE' WHEN 'AUTOMOBILE' THEN 'FURNITURE' ELSE '' END AS path, count(*) AS n FROM customer GROUP BY 1""",
    "changed_files": "SELECT 'a/' || page_id || '.py' AS path FROM pages WHERE page_id % 3 = 0 OR page_id % 4 = 0",
    "stale_repos": """WITH n AS (SELECT n_name AS repo, n_nationkey AS k, md5(n_name) AS m FROM nation),
        b AS (SELECT repo, CASE WHEN k % 5 <> 0 THEN m[:12] ELSE '' END AS recorded, CASE WHEN k % 4 = 1 THEN '' WHEN k % 3 = 0 THEN md5(m)[:12] ELSE m[:12] END AS current FROM n)
        SELECT *, current <> '' AND recorded <> current AS stale, recorded = '' AS no_head FROM b""",
    "pull_plan": """WITH c AS (SELECT *, c_custkey AS i, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) > 1 AS shared,
            min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS k FROM customer)
        SELECT CASE WHEN k % 11 = 0 THEN 'skipped' WHEN k % 7 = 0 THEN 'fetch_failed' WHEN k % 5 = 0 OR k % 13 = 0 THEN 'fetched_only' WHEN k % 2 = 0 THEN 'already_latest'
            WHEN k % 3 > 0 THEN 'fetched_only' WHEN k % 17 = 0 THEN 'ff_failed' ELSE 'updated' END AS action, shared, count(*) AS n FROM c GROUP BY ALL""",
    "sync_sources": """WITH f AS (SELECT p_partkey AS i FROM part), v AS (SELECT i FROM f WHERE i % 6 <> 1 OR i % 12 = 1)
        SELECT 'node function' AS part, count(*) AS n FROM v UNION ALL SELECT 'node gateway_route', count(*) - 1 FROM nation
        UNION ALL SELECT 'edge calls', count(*) FROM v WHERE i + 1 IN (SELECT i FROM v) UNION ALL SELECT 'edge serves', count(*) - 1 FROM nation
        UNION ALL SELECT 'report changed', count(*) FROM f WHERE i % 12 = 1 UNION ALL SELECT 'report gateway routes', count(*) - 1 FROM nation
        UNION ALL SELECT 'report dropped', (SELECT count(*) FROM f) - (SELECT count(*) FROM v WHERE i + 1 IN (SELECT i FROM v))""",
    "ghost_calls": "SELECT 4 * count(*) AS raw, 2 * count(*) AS clean, 2 * count(*) AS ghosts FROM part",
    "symbol_accuracy": f"WITH {_FUNCTIONS} SELECT count(*) AS checked, count(*) AS right FROM fn WHERE ord % 3 > 0",
    "lexicon_bridge": """WITH w AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS word, lower(p_type) AS term FROM part),
        x AS (SELECT word, term, count(*) AS n, sum(count(*)) OVER (PARTITION BY word) AS nw FROM w GROUP BY 1, 2),
        y AS (SELECT x.*, ln(n * (SELECT count(*) FROM part)::DOUBLE / (nw * (SELECT count(*) FROM part WHERE lower(p_type) = term))) AS pmi FROM x WHERE n >= 5),
        b AS (SELECT word, term FROM y WHERE pmi > 0 QUALIFY row_number() OVER (PARTITION BY word ORDER BY pmi DESC, term) = 1),
        q AS (SELECT * FROM (VALUES (1, 1, 'small'), (1, 2, 'ring'), (1, 3, 'zebra'), (2, 1, 'hot'), (2, 3, 'gear')) t(query_id, pos, word)),
        e AS (SELECT query_id, 1 AS l, pos, word AS t FROM q UNION ALL SELECT query_id, 2, pos, term FROM q JOIN b USING (word)),
        o AS (SELECT query_id, t, min(l * 100 + pos) AS o FROM e GROUP BY 1, 2)
        SELECT query_id::INT AS query_id, string_agg(t, ' ' ORDER BY o) AS tokens FROM o GROUP BY 1""",
    "name_and_hint_rank": """WITH n AS (SELECT 'p:' || lpad(p_partkey::VARCHAR, 9, '0') AS id, p_name || CASE WHEN p_partkey % 50 > 0 THEN ' x' || p_partkey % 50 ELSE '' END AS name, 'store' || p_size % 5 AS repo FROM part),
        bag AS (SELECT id, 3 AS w, unnest(string_split(name, ' ')) AS term FROM n UNION ALL SELECT id, 1, repo FROM n UNION ALL SELECT id, 1, 'function' FROM n),
        p AS (SELECT id, term, sum(w)::DOUBLE AS tf FROM bag GROUP BY ALL), c AS (SELECT count(*)::DOUBLE AS n FROM n),
        t AS (SELECT term, ln(1 + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM p, c GROUP BY term, n),
        q AS (SELECT * FROM (VALUES (1, 'small ring', 'store1'), (2, 'hot gear', NULL), (3, 'ring x4', 'store2')) v(query_id, needle, hint)),
        b AS (SELECT query_id, id, sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE)) AS base, count(*) AS matched FROM (SELECT query_id, unnest(string_split(needle, ' ')) AS term FROM q) JOIN t USING (term) JOIN p USING (term) GROUP BY ALL),
        x AS (SELECT query_id, id, name = needle AS exact, name <> needle AND contains(name, needle) AS part, round(base * (1 + 2 * pow(matched::DOUBLE / 2, 1.5)) * 2 * CASE WHEN hint = repo THEN 1.3::DOUBLE ELSE 1 END, 6) AS score
              FROM b JOIN n USING (id) JOIN q USING (query_id))
        SELECT query_id::INT AS query_id, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, part DESC, score DESC, id) AS rank, id, score FROM x QUALIFY rank <= 10""",
    "extract_python": """WITH k AS (SELECT p_partkey::VARCHAR AS k, 'r:m' || p_partkey || '.py' AS f FROM part)
        SELECT 'node' AS part, 'file' AS kind, f AS key, 0 AS line FROM k UNION ALL SELECT 'node', 'function', f || '#go', 5 FROM k UNION ALL SELECT 'node', 'function', f || '#helper', 6 FROM k
        UNION ALL SELECT 'node', 'class', f || '#Part' || k, 7 FROM k UNION ALL SELECT 'node', 'function', f || '#Part' || k || '.run', 8 FROM k
        UNION ALL SELECT 'node', 'endpoint', f || '#EP GET /v' || k || '/x', 5 FROM k
        UNION ALL SELECT 'edge', 'contains', f || ' ' || f || unnest(['#go', '#helper', '#Part' || k, '#EP GET /v' || k || '/x']), 0 FROM k
        UNION ALL SELECT 'edge', 'contains', f || '#Part' || k || ' ' || f || '#Part' || k || '.run', 0 FROM k
        UNION ALL SELECT 'edge', 'route_of', f || '#EP GET /v' || k || '/x ' || f || '#go', 0 FROM k UNION ALL SELECT 'edge', 'calls', f || ' ' || f || '#helper', 0 FROM k
        UNION ALL SELECT 'edge', 'import_of', f || ' ' || unnest(['os', 'pkg/mod' || k || '/thing', 'pkg/mod' || k]), 0 FROM k""",
    "extract_script": """WITH k AS (SELECT p_partkey::VARCHAR AS k, 'r:app/(g)/p' || p_partkey || '/page.tsx' AS f FROM part)
        SELECT 'node' AS part, 'file' AS kind, f AS key, 0 AS line FROM k UNION ALL SELECT 'node', 'function', f || '#Page', 3 FROM k UNION ALL SELECT 'node', 'class', f || '#Store' || k, 6 FROM k
        UNION ALL SELECT 'node', 'api_call', f || '#CALL POST /u/*/p' || k, 4 FROM k UNION ALL SELECT 'node', 'route', 'r:route:/p' || k, 0 FROM k
        UNION ALL SELECT 'edge', 'contains', f || ' ' || f || unnest(['#Page', '#Store' || k, '#CALL POST /u/*/p' || k]), 0 FROM k
        UNION ALL SELECT 'edge', 'import_of', f || ' ' || unnest(['app/(g)/p' || k || '/side' || k, 'pkg']), 0 FROM k UNION ALL SELECT 'edge', 'route_of', 'r:route:/p' || k || ' ' || f, 0 FROM k""",
    "extract_rust": """WITH k AS (SELECT p_partkey::VARCHAR AS k, 'r:src/m' || p_partkey || '.rs' AS f FROM part)
        SELECT 'node' AS part, 'file' AS kind, f AS key, 0 AS line FROM k UNION ALL SELECT 'node', 'class', f || '#Part' || k, 2 FROM k UNION ALL SELECT 'node', 'function', f || '#Part' || k || '::run', 4 FROM k
        UNION ALL SELECT 'node', 'function', f || '#app', 6 FROM k UNION ALL SELECT 'node', 'function', f || '#show', 7 FROM k UNION ALL SELECT 'node', 'endpoint', f || '#EP GET /p' || k, 6 FROM k
        UNION ALL SELECT 'edge', 'contains', f || ' ' || f || unnest(['#Part' || k, '#Part' || k || '::run', '#app', '#show', '#EP GET /p' || k]), 0 FROM k
        UNION ALL SELECT 'edge', 'route_of', f || '#EP GET /p' || k || ' ' || f || '#show', 0 FROM k UNION ALL SELECT 'edge', 'import_of', f || ' src/db/pool', 0 FROM k""",
    "extract_config": "SELECT 'r:c' || p_partkey || '.yml' AS id, array_to_string(list_sort(['name', 'items', 'flag', 'alpha_' || p_partkey, 'part' || p_partkey]), ' ') AS refs FROM part",
    "extract_gateway": """SELECT 'r' || p_partkey || ':gwroute:/api/' || m || p_partkey AS id, 's' || p_partkey AS service, 'h' || p_partkey AS host, '/api/' || m || p_partkey AS prefix
        FROM part, (SELECT unnest(['m', 'n']) AS m)""",
    "extract_infra": """SELECT 'deploys' AS kind, 'r:project:p' || p_partkey AS src, 'r:app:app' || p_partkey AS dst, 'dev,prd' AS role FROM part
        UNION ALL SELECT 'serves', 'r:project:p' || p_partkey, 'r:app:app' || p_partkey, 'prd=p' || p_partkey || '.example' FROM part""",
}
