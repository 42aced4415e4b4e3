"""Derived edges: calls to definitions, API calls to endpoints and gateways, packages, deployments, anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import mentions, tokenize
from graphloom.plans.scratch import cut


def link_calls(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """``(file, id, role)`` of ``calls(file, repo, name)`` against ``definitions(id, file, repo, name)``.

    Definitions of the same file first, all of them; else one of another file, if the name is
    the only one in its repository.
    """
    c = calls.select("file", "repo", "name").distinct()
    d = definitions.select("id", F.col("file").alias("home"), "repo", "name")
    same = c.join(d, ["repo", "name"]).filter("file = home").select("file", "repo", "name", "id")
    only = d.groupBy("repo", "name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"), F.min("home").alias("home")).filter("n = 1")
    rest = c.join(same.select("file", "repo", "name"), ["file", "repo", "name"], "left_anti")
    cross = rest.join(only, ["repo", "name"]).filter("file <> home")
    return same.select("file", "id", F.lit("same_file").alias("role")).unionAll(cross.select("file", "id", F.lit("cross_file").alias("role")))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def link_api(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """``(call, endpoint, literal_hits)`` of ``calls(id, method, path)`` against ``endpoints(id, method, path)``.

    An endpoint's segments are a suffix of the call's; ``*`` meets ``*`` only; at least one
    literal meets. The most literals win, then the longest endpoint, then the smallest id.
    Calls are dealt out under each of their suffixes, so the join is an equi-join.
    """
    c = calls.select(F.col("id").alias("call"), "method", segments(F.col("path")).alias("segs")).filter(F.size("segs") > 0)
    tails = F.transform(F.sequence(F.lit(1), F.size("segs")), lambda n: F.array_join(F.slice(F.col("segs"), F.size("segs") - n + 1, n), "/"))
    c = c.select("call", "method", F.explode(tails).alias("tail"))
    e = endpoints.select(F.col("id").alias("endpoint"), "method", segments(F.col("path")).alias("segs"))
    literal = F.size(F.filter("segs", lambda s: s != "*"))
    e = e.select("endpoint", "method", F.array_join("segs", "/").alias("tail"), literal.alias("literal_hits"), F.size("segs").alias("n")).filter("literal_hits > 0")
    best = Window.partitionBy("call").orderBy(F.desc("literal_hits"), F.desc("n"), "endpoint")
    hits = c.join(e, ["method", "tail"]).withColumn("r", F.row_number().over(best))
    return hits.filter("r = 1").select("call", "endpoint", "literal_hits")


def longest_prefix(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """``(call, route, prefix)``: the route whose prefix is the call's path or its longest leading part at a slash."""
    segs = F.split("path", "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(segs)), lambda n: F.array_join(F.slice(segs, 1, n), "/"))
    c = calls.select(F.col("id").alias("call"), F.explode(heads).alias("prefix"))
    r = routes.select(F.col("id").alias("route"), "prefix").filter("prefix <> ''")
    hits = c.join(r, "prefix")
    return hits.groupBy("call").agg(F.max(F.struct(F.length("prefix").alias("n"), "prefix", "route")).alias("b")).select("call", "b.route", "b.prefix")


def link_hosts(routes: DataFrame, repos: DataFrame) -> DataFrame:
    """``(route, repo)`` where a route's host is a repository's name."""
    return routes.select(F.col("id").alias("route"), "host").join(repos.select(F.col("id").alias("repo"), F.col("name").alias("host")), "host").select("route", "repo")


def link_packages(features: DataFrame, contains: DataFrame) -> DataFrame:
    """``(src, dst)`` both ways between each feature and the canonical one of its name in another repository.

    Canonical is the feature with the most members, then the smallest id.
    """
    n = contains.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("members"))
    f = features.select("id", "name", "repo").join(n, "id", "left").withColumn("members", F.coalesce("members", F.lit(0)))
    top = f.groupBy("name").agg(F.min(F.struct((-F.col("members")).alias("m"), "id", "repo")).alias("top")).select("name", "top.id", "top.repo")
    pairs = f.select(F.col("id").alias("src"), "name", F.col("repo").alias("r")).join(top.withColumnRenamed("id", "dst"), "name").filter("src <> dst and r <> repo")
    return pairs.select("src", "dst").unionAll(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def members_by_folder(files: DataFrame, features: DataFrame) -> DataFrame:
    """``(src, dst)`` from a workspace feature ``(id, repo, dir)`` to the files ``(id, repo, path)`` under its folder."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    f = files.filter(F.col("path").contains("/")).select(F.col("id").alias("dst"), "repo", F.explode(up).alias("dir"))
    return f.join(features.select(F.col("id").alias("src"), "repo", F.rtrim("dir", F.lit("/")).alias("dir")), ["repo", "dir"]).select("src", "dst")


def deploy_targets(repos: DataFrame, apps: DataFrame, aliases: DataFrame, deploys: DataFrame) -> DataFrame:
    """``(repo, project, app, env, domain)``: a repository's app by alias or name, each project that deploys it, each environment.

    ``repos(id, name)``, ``apps(id, name)``, ``aliases(name, alias)``, ``deploys(project, app,
    envs, edge_domain, project_domains)``; the domain of an environment is the edge's, else the
    project's.
    """
    named = repos.select(F.col("id").alias("repo"), "name").join(aliases, "name", "left").select("repo", F.coalesce("alias", "name").alias("app_name"))
    a = named.join(apps.select(F.col("id").alias("app"), F.col("name").alias("app_name")), "app_name")
    d = a.join(deploys, "app").select("*", F.explode("envs").alias("env"))
    return d.select("repo", "project", "app", "env", F.coalesce("edge_domain", F.try_element_at("project_domains", F.col("env"))).alias("domain"))


def pick_mentions(hits: DataFrame, query_words: DataFrame, repo_words: DataFrame, most: int = 4) -> DataFrame:
    """Anchors of ``hits(query_id, mention, id, repo)``: a mention with more than ``most`` hits counts only for the
    repositories that the query names, and only if these hits are 1 to ``most``."""
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id", "mention"))
    h = hits.withColumn("n", n)
    few = h.filter(F.col("n") <= most)
    named = query_words.join(repo_words, "token").select("query_id", "repo").distinct()
    many = h.filter(F.col("n") > most).join(named, ["query_id", "repo"], "left_semi").withColumn("n", n)
    return few.unionByName(many.filter(F.col("n") <= most)).drop("n")


def fragment_hits(fragments: DataFrame, nodes: DataFrame, most: int = 8) -> DataFrame:
    """``(query_id, fragment, id)``: functions and classes whose name contains an identifier-like fragment, if 1 to ``most`` do.

    ``fragments(query_id, fragment)`` come from requests; the pieces of names that are as long as
    some fragment meet them by equality.
    """
    f = fragments.filter((F.length("fragment") >= 6) & (F.col("fragment").contains("_") | (F.lower("fragment") != F.col("fragment"))))
    f = cut(f.select("query_id", F.lower("fragment").alias("fragment")).distinct(), "fragments")
    lengths = [r[0] for r in f.select(F.length("fragment").alias("n")).distinct().orderBy("n").collect()]
    d = nodes.filter(F.col("kind").isin("function", "class")).select("id", F.lower("name").alias("name"))
    sizes = F.filter(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length("name"))
    pieces = F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.length("name") - n + 1), lambda i: F.substr(F.col("name"), i, n))))
    d = d.select("id", F.explode(F.array_distinct(pieces)).alias("fragment"))
    hits = d.join(f, "fragment").select("query_id", "fragment", "id")
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id", "fragment"))
    return hits.withColumn("n", n).filter(F.col("n") <= most).drop("n")


def find_anchors(nodes: DataFrame, queries: DataFrame, most: int = 4) -> DataFrame:
    """``(query_id, mention, id)``: the nodes that requests ``(query_id, text, hint)`` name.

    A mentioned route meets routes and gateway routes by name and endpoints by ``route_path``, a
    file name files, a symbol functions and classes, letter case aside. What ``pick_mentions``
    keeps counts; ``hint`` only helps to tell repositories apart. A request of which no mention
    counts is tried by fragments of its symbols.
    """
    m = cut(queries.select("query_id", "hint", "text", mentions("text").alias("m")), "anchor-requests")
    low = lambda c: F.transform(F.col(c), lambda x: F.lower(x))
    named = lambda c, sort: F.transform(low(c), lambda x: F.struct(F.lit(sort).alias("sort"), x.alias("name")))
    wanted = m.select("query_id", F.explode(F.concat(named("m.routes", "route"), named("m.files", "file"), named("m.symbols", "symbol"))).alias("w"))
    wanted = wanted.select("query_id", "w.sort", "w.name").distinct()
    kind = F.col("kind")
    sort = F.when(kind.isin("route", "gateway_route", "endpoint"), "route").when(kind == "file", "file").when(kind.isin("function", "class"), "symbol")
    path = F.col("route_path") if "route_path" in nodes.columns else F.lit(None).cast("string")
    n = nodes.select("id", "repo", sort.alias("sort"), F.lower(F.when(kind == "endpoint", path).otherwise(F.col("name"))).alias("name")).filter("sort is not null and name <> ''")
    hits = n.join(wanted, ["sort", "name"]).select("query_id", F.concat_ws(":", "sort", "name").alias("mention"), "id", "repo")
    asked = m.select("query_id", F.explode(F.concat(tokenize("text"), tokenize("hint"))).alias("token")).distinct()
    repos = nodes.select("repo").distinct().select("repo", F.explode(F.array_distinct(tokenize("repo"))).alias("token"))
    found = cut(pick_mentions(hits, asked, repos, most).select("query_id", "mention", "id"), "anchors")
    rest = m.join(found.select("query_id").distinct(), "query_id", "left_anti")
    rest = rest.select("query_id", F.explode("m.symbols").alias("fragment"))
    return found.unionAll(fragment_hits(rest, nodes).select("query_id", F.concat(F.lit("part:"), "fragment").alias("mention"), "id"))


def link_handlers(endpoints: DataFrame, functions: DataFrame) -> DataFrame:
    """``(src, dst)`` from endpoints ``(id, repo, handler)`` to the functions ``(id, repo, name, path, ord)`` that serve them.

    A handler is a name with the modules it lies in, ``a::b::name``. Functions of the repository
    meet it by the last part of their name. The first one, as written, whose path contains the
    handler's last module is taken; without such a one, the only one of that name.
    """
    last = lambda c: F.element_at(F.split(c, "::"), -1)
    parts = F.split("handler", "::")
    module = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("")
    e = endpoints.filter("handler <> ''").select(F.col("id").alias("src"), "repo", last("handler").alias("name"), module.alias("module"))
    f = functions.select("repo", last("name").alias("name"), "path", F.col("id").alias("fid"), "ord")
    near = (F.col("module") != "") & F.contains("path", F.col("module"))
    key = F.struct("ord", "fid")
    hits = e.join(f, ["repo", "name"]).groupBy("src").agg(
        F.min(F.when(near, key))["fid"].alias("best"), F.count(F.lit(1)).alias("n"), F.min("fid").alias("only")
    )
    return hits.select("src", F.coalesce("best", F.when(F.col("n") == 1, F.col("only"))).alias("dst")).filter("dst is not null")


# Suffixes that a script's import may leave out, in the order in which they are tried.
SCRIPT_TAILS = (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")


#: Rows of a table to look up in up to which it is broadcast; beyond, it is joined by shuffling.
LOOKUP_ROWS = 100_000


def _lookup(table: DataFrame) -> DataFrame:
    """``table`` as the right side of a join whose left side, of unknown size, is never the one that is broadcast."""
    few = table.limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS
    return F.broadcast(table) if few else table.hint("merge")


def resolve_specs(imports: DataFrame, files: DataFrame, aliases: DataFrame, workspaces: DataFrame) -> DataFrame:
    """``(src, spec, kind, target)`` of imports ``(src, repo, spec)`` that are no relative paths.

    ``aliases(repo, alias, target)`` whose alias begins the spec are tried, the longest first; the
    first target that is a known file of ``files(repo, path, id)`` is meant (kind ``file``). Else a
    workspace of ``workspaces(repo, name, dir)`` that is the spec or its first part (``feature``).
    """
    i = imports.filter(~F.startswith("spec", F.lit("."))).select("src", "repo", "spec").distinct()
    heads = F.array_distinct(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.length("spec")), lambda n: F.substr(F.col("spec"), F.lit(1), n))))
    a = i.select("*", F.explode(heads).alias("alias")).join(_lookup(aliases.select("repo", "alias", "target")), ["repo", "alias"])
    rest = F.ltrim(F.substr(F.col("spec"), F.length("alias") + 1), F.lit("/"))
    base = F.rtrim(F.when(rest == "", F.col("target")).otherwise(F.concat_ws("/", "target", rest)), F.lit("/"))
    whole = F.when(F.element_at(F.split(base, "/"), -1).rlike(r".\.[^.]+$"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    tails = F.concat(whole, F.array(*map(F.lit, SCRIPT_TAILS)))
    a = a.select("src", "repo", "spec", "alias", "target", base.alias("base"), F.posexplode(tails).alias("p", "tail"))
    a = a.withColumn("path", F.concat("base", "tail")).join(_lookup(files.select("repo", "path", "id")), ["repo", "path"])
    a = a.select("src", "spec", F.struct((-F.length("alias")).alias("n"), "alias", "target", "p").alias("order"), "id", F.lit(None).cast("string").alias("name"))
    ways = F.transform(F.sequence(F.lit(1), F.size(F.split("spec", "/"))), lambda n: F.array_join(F.slice(F.split("spec", "/"), 1, n), "/"))
    w = i.select("src", "repo", "spec", F.explode(ways).alias("name")).join(_lookup(workspaces.select("repo", "name")), ["repo", "name"])
    w = w.select("src", "spec", F.lit(None).cast(a.schema["order"].dataType).alias("order"), F.lit(None).cast("string").alias("id"), "name")
    # one aggregation tells both kinds apart; an anti-join would hold every resolved import at once where it is broadcast
    found = a.unionAll(w).groupBy("src", "spec").agg(F.count("order").alias("n"), F.min_by("id", "order").alias("id"), F.min("name").alias("name"))
    is_file = F.col("n") > 0
    return found.select("src", "spec", F.when(is_file, "file").otherwise("feature").alias("kind"), F.when(is_file, F.col("id")).otherwise(F.col("name")).alias("target"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``(src, target)``: the known file a dotted module or a relative or aliased path means, by order of candidates.

    ``imports(src, repo, base)`` hold normalised paths without suffix; ``files(repo, path, id)``.
    """
    tails = [".py", "/__init__.py", "", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
    options = F.array(*(F.struct(F.lit(i).alias("p"), F.concat("base", F.lit(t)).alias("path")) for i, t in enumerate(tails)))
    c = imports.select("src", "repo", "base", F.explode(options).alias("o")).select("src", "repo", "base", "o.p", "o.path")
    hits = c.join(files.select("repo", "path", "id"), ["repo", "path"])
    return hits.groupBy("src", "base").agg(F.min_by("id", "p").alias("target")).select("src", "target")
