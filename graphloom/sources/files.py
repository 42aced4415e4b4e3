"""Reading source trees, logs and tables; writing reports."""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.graph import PropertyGraph
from graphloom.sources.extract import CONFIG, PYTHON, RUST, SCRIPT

# Folders that hold no sources.
SKIP_DIRS = (
    "node_modules", ".git", ".next", "dist", "build", "__pycache__", ".venv", "venv", ".turbo", "coverage",
    ".pnpm-store", ".cache", "storybook-static", ".idea", ".vscode", "migrations_backup",
)
SUFFIXES = (*PYTHON, *SCRIPT, *RUST, *CONFIG)


def read_tree(spark: SparkSession, root: str, repo: str, scope: str | None = None, limit: int | None = None) -> DataFrame:
    """``(repo, path, text, digest)`` of the source files under a folder of any store, skipped folders left out.

    Spark lists no files whose names begin with a dot or underscore; the git source does.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root.rstrip('/')}/{scope or ''}")
    bare = re.sub(r"^\w+:/*", "/", root.rstrip("/"))
    path = F.regexp_replace(F.regexp_replace("path", r"^\w+:/*", "/"), f"^{re.escape(bare)}/", "")
    f = raw.select(F.lit(repo).alias("repo"), path.alias("path"), "content")
    hidden = F.exists(F.split("path", "/"), lambda s: s.isin(*SKIP_DIRS) | (s.startswith(".") & (s != ".env")))
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    wanted = F.lit(False)
    for s in SUFFIXES:
        wanted = wanted | name.endswith(s)
    f = f.filter(~hidden & wanted).select("repo", "path", F.decode("content", "UTF-8").alias("text"), F.md5("content").alias("digest"))
    return f.orderBy("path").limit(limit) if limit else f


def _hadoop(spark: SparkSession, path: str) -> tuple:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _current(spark: SparkSession, path: str) -> str | None:
    """The folder of the version that was committed last; None where nothing was."""
    fs, at = _hadoop(spark, f"{path.rstrip('/')}/CURRENT")
    if not fs.exists(at):
        return None
    name = spark.read.text(at.toString()).first()
    return f"{path.rstrip('/')}/{name[0]}" if name else None


def _commit(spark: SparkSession, path: str, tables: dict[str, DataFrame], kind: str) -> None:
    """Write the tables as one version; naming it in one small file is what makes all of them visible at once."""
    before, version = _current(spark, path), f"version-{uuid.uuid4().hex[:12]}"
    for name, df in tables.items():
        df.write.format(kind).save(f"{path.rstrip('/')}/{version}/{name}")
    fs, at = _hadoop(spark, f"{path.rstrip('/')}/CURRENT")
    out = fs.create(at, True)
    out.write(bytearray(version.encode()))
    out.close()
    if before:
        fs, at = _hadoop(spark, before)
        fs.delete(at, True)


def read_graph(spark: SparkSession, path: str) -> PropertyGraph:
    """The graph that ``write_graph`` committed last."""
    at = _current(spark, path)
    if at is None:
        raise FileNotFoundError(f"no graph at {path}")
    return PropertyGraph(spark.read.parquet(f"{at}/nodes"), spark.read.parquet(f"{at}/edges"))


def write_graph(graph: PropertyGraph, path: str) -> None:
    """Nodes and edges, committed together: a reader sees the old graph or the new one, never a mix."""
    _commit(graph.nodes.sparkSession, path, {"nodes": graph.nodes, "edges": graph.edges}, "parquet")


def read_graph_json(spark: SparkSession, path: str) -> PropertyGraph:
    """A graph from one JSON document ``{"nodes": [...], "edges": [...]}``, or as ``write_graph_json`` wrote it."""
    at = _current(spark, path)
    if at is not None:
        return PropertyGraph(spark.read.json(f"{at}/nodes"), spark.read.json(f"{at}/edges"))
    doc = spark.read.option("multiLine", True).json(path)
    nodes = doc.select(F.posexplode("nodes").alias("ord", "n")).select("n.*", F.col("ord").cast("long"))
    edges = doc.select(F.posexplode("edges").alias("ord", "e")).select("e.*", F.col("ord").cast("long"))
    return PropertyGraph(nodes, edges)


def write_graph_json(graph: PropertyGraph, path: str) -> None:
    """Nodes and edges as lines of JSON, committed together."""
    _commit(graph.nodes.sparkSession, path, {"nodes": graph.nodes, "edges": graph.edges}, "json")


def write_vectors(vectors: DataFrame, path: str) -> None:
    """``(id, embedding, digest)`` of a vector index, committed at once; components of four bytes."""
    v = vectors.select("id", F.col("embedding").cast("array<float>").alias("embedding"), "digest")
    _commit(vectors.sparkSession, path, {"vectors": v}, "parquet")


def read_vectors(spark: SparkSession, path: str) -> DataFrame | None:
    """The vector index; None where there is none, it cannot be read, or it knows no digests. Never raises for what it finds there."""
    try:
        at = _current(spark, path)
        v = None if at is None else spark.read.parquet(f"{at}/vectors")
        if v is None or not {"id", "embedding", "digest"} <= set(v.columns) or v.isEmpty():
            return None
    except (PySparkException, Py4JError):
        return None
    return v


# Why a search by meaning was not made.
NO_ENDPOINT, NO_INDEX, NO_ANSWER = "no endpoint", "no index", "no answer"


def dense_reason(endpoint: str | None, index: DataFrame | None, asked: DataFrame | None) -> str | None:
    """Why there are no hits by meaning: nothing that embeds, no index, or no vectors of the requests; None if there can be some."""
    if not endpoint:
        return NO_ENDPOINT
    if index is None:
        return NO_INDEX
    return NO_ANSWER if asked is None or asked.isEmpty() else None


def read_events(spark: SparkSession, path: str, fields: str = "ts double, step string, status string", drop_sessions: bool = False) -> DataFrame:
    """``(session, seq, ...)`` of ``SESSION/journal.jsonl`` files; the folder names the session.

    A broken line is left out; with ``drop_sessions`` its whole session is. ``seq`` orders by
    time, then by text.
    """
    raw = spark.read.option("recursiveFileLookup", True).text(path).select("value", F.input_file_name().alias("file")).filter(F.trim("value") != "")
    e = raw.select(F.element_at(F.split("file", "/"), -2).alias("session"), "value", F.from_json("value", f"{fields}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("e"))
    broken = F.col("e._broken").isNotNull()
    if drop_sessions:
        e = e.withColumn("bad", F.max(broken.cast("int")).over(Window.partitionBy("session"))).filter("bad = 0")
    e = e.filter(~broken)
    seq = F.row_number().over(Window.partitionBy("session").orderBy("e.ts", "value"))
    return e.select("session", seq.alias("seq"), "e.*").drop("_broken")


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """Notes ``(ts, repo, area, kind, note, query)`` of JSON lines; broken lines are left out."""
    return spark.read.schema("ts double, repo string, area string, kind string, note string, query string").option("mode", "DROPMALFORMED").json(path)


def read_cases(spark: SparkSession, path: str, most_files: int = 12) -> DataFrame:
    """Benchmark cases ``(repo, iid, title, merged_at, files)`` with 1 to ``most_files`` files, the first of each (repo, iid)."""
    c = spark.read.schema("repo string, iid long, title string, merged_at string, files array<string>").json(path)
    return c.filter(F.size("files").between(1, most_files)).dropDuplicates(["repo", "iid"])


def tolerant_json(text: Column, schema: str) -> Column:
    """JSON with comments and trailing commas."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", ""), r'(?m)(^|[\s,{\[])//[^\n]*', "$1")
    return F.from_json(F.regexp_replace(bare, r",\s*([}\]])", "$1"), schema)


def workspaces(files: DataFrame) -> DataFrame:
    """``(repo, name, dir)`` of the packages below a repository's root."""
    f = files.filter(F.col("path").endswith("/package.json") & ~F.col("path").contains("node_modules/"))
    name = tolerant_json(F.col("text"), "name string")["name"]
    return f.select("repo", name.alias("name"), F.regexp_replace("path", "/package\\.json$", "").alias("dir")).filter("name is not null")


def aliases(files: DataFrame) -> DataFrame:
    """``(repo, alias, target)`` of compiler path settings, the longest alias first."""
    f = files.filter(F.element_at(F.split("path", "/"), -1).rlike(r"^tsconfig.*\.json$"))
    paths = tolerant_json(F.col("text"), "compilerOptions struct<baseUrl: string, paths: map<string, array<string>>>")["compilerOptions"]
    e = f.select("repo", F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("").alias("dir"), F.explode(paths["paths"]).alias("alias", "targets"))
    e = e.select("repo", "dir", F.regexp_replace("alias", r"\*$", "").alias("alias"), F.explode("targets").alias("t"))
    target = F.regexp_replace(F.concat_ws("/", F.nullif(F.col("dir"), F.lit("")), F.regexp_replace("t", r"\*$", "")), r"(^|/)\./", "$1")
    return e.select("repo", "alias", F.rtrim(target, F.lit("/")).alias("target")).orderBy(F.desc(F.length("alias")), "alias")


def write_report(rows: DataFrame, line: Column, path: str, order: str) -> None:
    """One text file of rendered rows, in order: for reports whose size a limit bounds."""
    rows.select(line.alias("value"), order).orderBy(order).select("value").coalesce(1).write.mode("overwrite").text(path)


def markdown_item(title: Column, detail: Column) -> Column:
    return F.concat(F.lit("- **"), title, F.lit("** "), F.coalesce(detail, F.lit("")))


def html_row(*cells: Column) -> Column:
    esc = lambda c: F.replace(F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), F.coalesce(esc(c), F.lit("")), F.lit("</td>")) for c in cells), F.lit("</tr>"))


def read_overlay(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Hand-made notes of ``{"node_overrides": {id: {...}}, "custom_edges": [...]}`` as two tables."""
    schema = (
        "node_overrides map<string, struct<summary: string, note: string, deprecated: boolean, redirect: string, tags: array<string>>>, "
        "custom_edges array<struct<src: string, dst: string, kind: string, note: string>>"
    )
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    nodes = doc.select(F.explode("node_overrides").alias("id", "o")).select("id", "o.*")
    return nodes, doc.select(F.explode("custom_edges").alias("e")).select("e.*")


def pick_routing_tables(rows: DataFrame) -> DataFrame:
    """Of the extracted gateway rows, those of each repository's main table: least depth, shortest name, first path."""
    where = rows.filter("kind = 'gateway_route'").select("repo", "path").distinct()
    rank = F.struct(F.size(F.split("path", "/")), F.length(F.element_at(F.split("path", "/"), -1)), F.col("path"))
    main = where.groupBy("repo").agg(F.min(rank).alias("r")).select("repo", F.col("r.path").alias("path"))
    return rows.join(main, ["repo", "path"], "left_semi")
