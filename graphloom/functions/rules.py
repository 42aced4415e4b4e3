"""Rules about changes, nodes and answers: infrastructure paths, branch names, summaries, retries."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Paths of deployment and pipeline files, prefixes of work branches.
INFRA = (
    r"(^|/)(docker-compose[^/]*\.ya?ml|Dockerfile[^/]*|\.gitlab-ci\.ya?ml|"
    r"Jenkinsfile[^/]*|\.drone\.ya?ml|azure-pipelines[^/]*\.ya?ml|bitbucket-pipelines\.ya?ml|"
    r"helm[^/]*/|charts?/|infra/|k8s/|k3s/|kubernetes/|argo(cd)?/|flux/|"
    r"ansible/|terraform/|\.github/workflows/|\.circleci/|"
    r"kustomization\.ya?ml|values(-[^/]*)?\.ya?ml|[^/]+\.tfvars|[^/]+\.tf)"
)
BRANCH_PREFIXES = ("feature/", "fix/", "refactor/", "hotfix/", "chore/")
PROTECTED_BRANCHES = ("main", "master", "develop", "stg", "staging", "release", "production")
MEANINGLESS = r"(?i)^(js|ts|py|tmp|test|temp|wip|\d+|[a-z]{1,2}\d*)$"
DOC_CHARS, LABEL_CHARS = 400, 300


def is_infra(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/")).rlike("(?i)" + INFRA)


def verdict(diff: Column, files: Column, score: Column) -> Column:
    """``struct<score, veto>``: an empty change or one of deployment files scores 0, with the reason."""
    empty = (F.trim(diff) == "") & (F.size(files) == 0)
    infra = F.exists(files, is_infra)
    veto = F.when(empty, "empty").when(infra, "infra")
    return F.struct(F.when(veto.isNull(), score).otherwise(0.0).alias("score"), veto.alias("veto"))


def is_protected(name: Column) -> Column:
    return F.lower(F.trim(name)).isin(*PROTECTED_BRANCHES)


def branch_issue(name: Column) -> Column:
    """Why a branch name is not fit: prefix, protected, empty, short or meaningless; null if it is."""
    known = F.lit(False)
    for p in BRANCH_PREFIXES:
        known = known | name.startswith(p)
    slug = F.regexp_extract(name, "^[^/]*/(.*)$", 1)
    return (
        F.when(~known, "prefix").when(is_protected(name), "protected").when(slug == "", "empty").when(F.length(slug) < 4, "short").when(slug.rlike(MEANINGLESS), "meaningless")
    )


def suggest_branch(prefix: str, keywords: Column, most: int = 4) -> Column:
    """A branch name of the first distinct words, at most ``most`` and 50 characters."""
    words = F.flatten(F.transform(keywords, lambda k: F.split(F.lower(k), "[^a-z0-9]+")))
    words = F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.rlike(MEANINGLESS)))
    # a word that another, earlier one is part of says nothing new
    novel = F.filter(words, lambda w, i: ~F.exists(F.slice(words, F.lit(1), i), lambda v: w.contains(v)))
    slug = F.regexp_replace(F.substring(F.array_join(F.slice(novel, 1, most), "-"), 1, 50), "^-+|-+$", "")
    return F.concat(F.lit(prefix), F.when(slug == "", "change").otherwise(slug))


def node_text(nodes: DataFrame) -> Column:
    """What is embedded of a node: kind and name, place, the first of hint, summary and document, labels."""
    has = lambda c, n: F.nullif(F.substring(F.trim(F.col(c)), 1, n), F.lit("")) if c in nodes.columns else F.lit(None).cast("string")
    about = F.coalesce(*(has(c, DOC_CHARS) for c in ("embed_hint", "summary", "doc")))
    return F.concat_ws(" — ", F.concat_ws(" ", "kind", "name"), F.concat_ws("/", "repo", "path"), about, has("labels", LABEL_CHARS))


def digest(text: Column) -> Column:
    """A stable 64-bit digest, as 16 hex digits."""
    return F.lower(F.lpad(F.hex(F.xxhash64(text)), 16, "0"))


def summaries(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, summary)`` without a model: the document if there is one, else a sentence for the kind.

    Files list up to four endpoints, four classes and five functions. Not meant for search:
    sentences that all nodes share make words common.
    """
    inside = edges.filter("kind = 'contains'").join(nodes.select(F.col("id").alias("dst"), F.col("kind").alias("k"), F.col("name").alias("n"), F.col("ord").alias("o")), "dst")

    def listed(kind: str, most: int) -> Column:
        found = F.array_sort(F.collect_list(F.when(F.col("k") == kind, F.struct("o", "n"))))
        return F.nullif(F.array_join(F.transform(F.slice(found, 1, most), lambda x: x["n"]), ", "), F.lit(""))

    members = inside.groupBy(F.col("src").alias("id")).agg(
        F.concat_ws("; ", F.concat(F.lit("endpoints "), listed("endpoint", 4)), F.concat(F.lit("classes "), listed("class", 4)), F.concat(F.lit("functions "), listed("function", 5))).alias("members"),
        F.count(F.lit(1)).alias("size"),
    )
    n = nodes.join(members, "id", "left")
    kind = F.col("kind")
    text = (
        F.when(F.trim(F.coalesce("doc", F.lit(""))) != "", F.col("doc"))
        .when(kind == "file", F.concat(F.lit("File: "), F.coalesce(F.nullif(F.col("members"), F.lit("")), F.lit("no symbols"))))
        .when(kind == "feature", F.concat(F.lit("Package "), "name", F.lit(" of "), F.coalesce("size", F.lit(0)).cast("string"), F.lit(" files")))
        .when(kind.isin("class", "function"), F.concat(kind, F.lit(" "), "name", F.lit(" at "), "path", F.lit(":"), F.col("line").cast("string")))
        .when(kind.isin("endpoint", "route", "api_call"), F.concat(kind, F.lit(" "), "name", F.lit(" in "), "path"))
        .otherwise(F.col("name"))
    )
    return n.select("id", text.alias("summary"))


def related_tests(tests: DataFrame, changed: DataFrame) -> DataFrame:
    """``(path)`` of the tests ``(path, text)`` named after, or mentioning, a changed ``(path)``; none if that is all of them."""
    stem = lambda c: F.regexp_extract(c, r"([^/]+?)(\.[^./]+)?$", 1)
    c = changed.select(stem(F.col("path")).alias("stem"), F.regexp_replace(F.replace("path", F.lit("/"), F.lit(".")), r"\.py$", "").alias("module")).filter("stem <> ''")
    t = tests.select("path", "text", stem(F.col("path")).alias("name"))
    hit = F.col("name").contains(F.col("stem")) | F.col("text").contains(F.col("stem")) | F.col("text").contains(F.col("module"))
    found = t.join(F.broadcast(c), hit, "left_semi").select("path")
    rest = t.join(found, "path", "left_anti").agg((F.count(F.lit(1)) > 0).alias("some"))
    return found.crossJoin(F.broadcast(rest)).filter("some").select("path")


def next_step(sandbox: Column, blocked: Column, judged: Column, ui: Column, round_: Column, most: int) -> Column:
    """``retry`` while something failed and rounds are left, else ``stop``; a null judgement or view counts as passed."""
    failed = (sandbox == "failed") | blocked | ~F.coalesce(judged, F.lit(True)) | (F.coalesce(ui, F.lit("")) == "failed")
    return F.when(failed & (round_ < most), "retry").otherwise("stop")


def first_json(text: str | None) -> str | None:
    """The first JSON object in a text, as JSON; null without one."""
    decoder, text = json.JSONDecoder(), text or ""
    at = text.find("{")
    while at >= 0:
        try:
            value, _ = decoder.raw_decode(text, at)
        except json.JSONDecodeError:
            at = text.find("{", at + 1)
            continue
        return json.dumps(value, ensure_ascii=False)
    return None


def first_json_column(text: Column) -> Column:
    @F.pandas_udf("string")
    def rule(texts: pd.Series) -> pd.Series:
        return texts.map(first_json, na_action="ignore")

    return rule(text)
