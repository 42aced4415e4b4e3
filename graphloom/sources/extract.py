"""Source text to graph rows: one file in, many rows out.

``extract`` takes ``files(repo, path, text)`` and returns rows of nodes and edges with one
schema. Files are parsed one by one in Arrow batches; links across files are joins
(``graphloom.operators.link``).
"""

from __future__ import annotations

import ast
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = (
    "part", "id", "kind", "name", "repo", "path", "line", "src", "dst", "lang", "doc", "summary", "refs", "labels",
    "method", "route_path", "norm_path", "handler", "service", "host", "module", "prefix", "role", "calls", "error",
)
SCHEMA = ", ".join(f"{c} {'int' if c == 'line' else 'array<string>' if c == 'calls' else 'string'}" for c in COLUMNS)
PYTHON, SCRIPT, RUST = (".py",), (".ts", ".tsx", ".js", ".jsx"), (".rs",)
CONFIG = (".yaml", ".yml", ".toml", ".json", ".ini", ".cfg", ".env", ".sh", ".md")
DOC_CHARS, REF_LIMIT, NAME_LIMIT, CONFIG_CHARS = 200, 400, 120, 400_000
# Words before a parenthesis that are no calls.
NOT_CALLS = (
    "if elif else for while switch case catch return yield def class function fn func "
    "new await async match with as in is and or not import from export public private "
    "static void const let var type interface struct enum impl trait pub mut where use"
).split()
HTTP_METHODS = ("get", "post", "put", "delete", "patch", "head", "options")
# What is no code, in the order in which it is taken out.
NONCODE = (
    r'"""[\s\S]*?"""', r"'''[\s\S]*?'''", r"/\*[\s\S]*?\*/", r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'",
    r"`(?:\\.|[^`\\])*`", r"#[^\n]*", r"//[^\n]*",
)
# An interpolation inside a string, a call.
INTERPOLATED = r"\$?\{([^{}]*)\}"
CALL = r"\b([A-Za-z_$][A-Za-z0-9_$]*)\s*\("


def call_names(text: Column) -> Column:
    """Distinct names called in a source text, without comments and strings but with what is interpolated into strings."""
    code = text
    for rule in NONCODE:
        code = F.regexp_replace(code, rule, " ")
    inner = F.array_join(F.regexp_extract_all(text, F.lit(INTERPOLATED), F.lit(1)), " ")
    names = F.regexp_extract_all(F.concat(code, F.lit(" "), inner), F.lit(CALL), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: ~n.isin(NOT_CALLS))))


def called(text: str) -> list[str]:
    """The same names for one text."""
    inner = " ".join(re.findall(INTERPOLATED, text))
    for rule in NONCODE:
        text = re.sub(rule, " ", text)
    return sorted(set(re.findall(CALL, f"{text} {inner}")) - set(NOT_CALLS))


def _top(words: list[str], limit: int) -> str | None:
    count = Counter(words)
    return " ".join(sorted(count, key=lambda w: (-count[w], -len(w), w))[:limit]) or None


def refs(text: str, defined: set[str]) -> str | None:
    """Identifiers that a file handles but does not define, commonest first."""
    found = re.findall(r"[A-Za-z_][A-Za-z0-9_]*", text)
    return _top([w for w in found if len(w) >= 6 and w not in defined and ("_" in w or (w.lower() != w != w.upper()))], REF_LIMIT)


def labels(text: str) -> str | None:
    return _top(re.findall(r"[가-힣]{2,}", text), REF_LIMIT)


def normalize_url(url: str) -> str:
    """The rule of ``functions.text.normalize_url`` for one call, as it is extracted."""
    bare = re.sub(r"\$\{[^}]*\}", "*", url.partition("?")[0])
    parts = [s for s in bare.split("/") if s]
    return "/" + "/".join("*" if s[0] == ":" or set("*{[") & set(s) else s for s in parts)


class Rows:
    """Collects the rows of one file."""

    def __init__(self, repo: str, path: str):
        self.repo, self.path, self.file = repo, path, f"{repo}:{path}"
        self.rows: list[dict] = []

    def node(self, id: str, kind: str, name: str, line: int = 0, **meta: object) -> str:
        self.rows.append({"part": "node", "id": id, "kind": kind, "name": name, "repo": self.repo, "path": self.path, "line": line} | meta)
        return id

    def edge(self, src: str, dst: str, kind: str, role: str | None = None) -> None:
        self.rows.append({"part": "edge", "kind": kind, "repo": self.repo, "path": self.path, "src": src, "dst": dst, "role": role})

    def symbol(self, name: str, kind: str, line: int, parent: str, **meta: object) -> str:
        id = self.node(f"{self.file}#{name}", kind, name, line, **meta)
        self.edge(parent, id, "contains")
        return id

    def endpoint(self, method: str, path: str, line: int, handler: str) -> str:
        id = self.node(f"{self.file}#EP {method} {path}", "endpoint", f"{method} {path}", line, method=method, route_path=path, handler=handler)
        self.edge(self.file, id, "contains")
        return id

    def head(self, lang: str, text: str, defined: set[str], doc: str = "", **meta: object) -> None:
        self.node(
            self.file, "file", PurePosixPath(self.path).name, lang=lang, doc=doc.strip()[:DOC_CHARS] or None,
            refs=refs(text, defined), labels=labels(text), calls=called(text), **meta,
        )


def python_rows(out: Rows, text: str) -> None:
    """Classes, functions in modules and class bodies, HTTP handlers, imports and calls within the file."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        out.node(out.file, "file", PurePosixPath(out.path).name, lang="python", error="parse_error")
        return
    kinds = (ast.FunctionDef, ast.AsyncFunctionDef)
    defined = {n.name for n in ast.walk(tree) if isinstance(n, (*kinds, ast.ClassDef))}
    out.head("python", text, defined, ast.get_docstring(tree) or "")
    prefixes = {"app": "", "router": ""}
    for n in ast.walk(tree):
        if isinstance(n, ast.Assign) and isinstance(n.value, ast.Call) and getattr(n.value.func, "id", getattr(n.value.func, "attr", "")).endswith("Router"):
            given = next((k.value.value for k in n.value.keywords if k.arg == "prefix" and isinstance(k.value, ast.Constant)), "")
            prefixes |= {t.id: given for t in n.targets if isinstance(t, ast.Name)}
    own: dict[str, str] = {}
    todo = [(tree.body, out.file, "")]
    while todo:
        body, parent, lead = todo.pop(0)
        for n in body:
            doc = (ast.get_docstring(n) or "")[:DOC_CHARS] or None if isinstance(n, (*kinds, ast.ClassDef)) else None
            if isinstance(n, ast.ClassDef):
                todo.append((n.body, out.symbol(lead + n.name, "class", n.lineno, parent, doc=doc), f"{lead}{n.name}."))
            elif isinstance(n, kinds):
                own[n.name] = out.symbol(lead + n.name, "function", n.lineno, parent, doc=doc)
                for d in n.decorator_list:
                    owner = getattr(getattr(getattr(d, "func", None), "value", None), "id", None)
                    if isinstance(d, ast.Call) and owner in prefixes and d.func.attr in HTTP_METHODS:
                        given = d.args[0].value if d.args and isinstance(d.args[0], ast.Constant) else ""
                        end = out.endpoint(d.func.attr.upper(), f"{prefixes[owner]}{given}" or "/", n.lineno, lead + n.name)
                        out.edge(end, own[n.name], "route_of", "handler")
    for n in ast.walk(tree):
        modules = []
        if isinstance(n, ast.Import):
            modules = [a.name for a in n.names]
        elif isinstance(n, ast.ImportFrom) and n.module:
            modules = [*(f"{n.module}.{a.name}" for a in n.names), n.module]
        elif isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in own:
            out.edge(out.file, own[n.func.id], "calls", "same_file")
        for m in modules:
            out.edge(out.file, m.replace(".", "/"), "import_of")


_EXPORT = re.compile(r"^\s*export\s+(?:default\s+)?(?:async\s+)?(?:abstract\s+)?(function|class|const|interface|type)\s*\*?\s+([A-Za-z_$][\w$]*)", re.M)
_IMPORT = re.compile(r"""\bimport\s+(?:[^'";]+?\s+from\s+)?['"]([^'"]+)['"]""")
_CLIENT = re.compile(r"""(?:\b(?:api|apiClient|axios|http|client)\.(get|post|put|delete|patch)(?:<[^>]*>)?|\bfetch)\s*\(\s*[`'"]([^`'"]+)[`'"]""", re.I)
_OPENING = re.compile(r"\s*/\*\*(.*?)\*/", re.S)


def script_rows(out: Rows, text: str) -> None:
    """Exports, imports and HTTP client calls of TypeScript and JavaScript; page routes."""
    exports = list(_EXPORT.finditer(text))
    doc = _OPENING.match(text)
    out.head("typescript", text, {m[2] for m in exports}, re.sub(r"(?m)^\s*\*\s?", "", doc[1]) if doc else "")
    line = lambda at: text.count("\n", 0, at) + 1
    for m in exports:
        out.symbol(m[2], "class" if m[1] == "class" else "function", line(m.start(1)), out.file)
    here = PurePosixPath(out.path).parent
    for m in _IMPORT.finditer(text):
        if m[1].startswith("."):
            parts: list[str] = []
            for p in [*here.parts, *m[1].split("/")]:
                parts = parts[:-1] if p == ".." else parts if p == "." else [*parts, p]
            out.edge(out.file, re.sub(r"\.(tsx?|jsx?)$", "", "/".join(parts)), "import_of")
        else:
            out.edge(out.file, m[1], "import_of", "package")
    for m in _CLIENT.finditer(text):
        if "/" in m[2] or m[2][0] == "$":
            method, norm = (m[1] or "get").upper(), normalize_url(m[2])
            id = out.node(f"{out.file}#CALL {method} {norm}", "api_call", f"{method} {norm}", line(m.start()), method=method, norm_path=norm)
            out.edge(out.file, id, "contains")
    if page := re.search(r"(?:^|/)app/(.*/)?page\.(?:tsx?|jsx?)$", out.path):
        parts = [p for p in (page[1] or "").split("/") if p and not (p[0] == "(" and p[-1] == ")")]
        route = "/" + "/".join(parts)
        out.edge(out.node(f"{out.repo}:route:{route}", "route", route, route_path=route), out.file, "route_of")


_RUST = {
    "impl": re.compile(r"\s*(?:unsafe\s+)?impl\b(?:\s*<[^{]*?>)?\s+(?:[\w:<>, ]+\s+for\s+)?([\w:]+)"),
    "type": re.compile(r"\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait|union)\s+(\w+)"),
    "fn": re.compile(r"\s*(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern\s+\"\")\s+)*fn\s+(\w+)"),
    "use": re.compile(r"\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([\w:]+)"),
}
_RUST_ROUTE = re.compile(r"""\.route\(\s*"([^"]+)"\s*,\s*([^)]*\([^)]*\))""")
_RUST_METHOD = re.compile(r"\b(get|post|put|patch|delete|head|options|any)\s*\(\s*([\w:]+)")


def rust_rows(out: Rows, text: str) -> None:
    """Types, functions (with their type inside ``impl``), uses within the crate and routes."""
    lines = text.splitlines()
    doc = " ".join(s.strip()[3:].strip() for s in lines[:12] if s.strip().startswith("//!"))
    first = len(out.rows)
    inside: list[tuple[str, int]] = []
    depth, own = 0, {}
    for at, raw in enumerate(lines, 1):
        open_code = re.sub(r"//.*", "", raw)
        code = re.sub(r'"(?:\\.|[^"\\])*"', '""', open_code)
        while inside and depth <= inside[-1][1]:
            inside.pop()
        if m := _RUST["impl"].match(code):
            inside.append((m[1].rsplit("::", 1)[-1], depth))
        elif m := _RUST["type"].match(code):
            out.symbol(m[1], "class", at, out.file)
        elif m := _RUST["fn"].match(code):
            own[m[1]] = out.symbol(f"{inside[-1][0]}::{m[1]}" if inside else m[1], "function", at, out.file)
        elif (m := _RUST["use"].match(code)) and m[1].split("::")[0] in ("crate", "self", "super"):
            if parts := [p for p in m[1].split("::")[1:] if p[:1].islower()]:
                out.edge(out.file, "src/" + "/".join(parts), "import_of", "rust")
        for r in _RUST_ROUTE.finditer(open_code):
            if h := _RUST_METHOD.search(r[2]):
                out.endpoint(h[1].upper(), r[1], at, h[2])
        depth += code.count("{") - code.count("}")
    for row in [r for r in out.rows[first:] if r.get("kind") == "endpoint"]:
        if target := own.get(row["handler"].rsplit("::", 1)[-1]):
            out.edge(row["id"], target, "route_of", "handler")
    out.head("rust", text, {r["name"] for r in out.rows if r.get("kind") in ("class", "function")} | set(own), doc)


# Names written in configurations and documents, by file type.
_WORD = r"[A-Za-z_][\w.-]{2,}"
_CONFIG_RULES = {
    "yaml": (rf"(?m)^\s*({_WORD})\s*:", rf"(?m)^\s*-\s+({_WORD})\s*$", rf"(?m)^\s*[A-Za-z_][\w.-]*\s*:\s*((?!(?i:true|false|null|none|yes|no|on|off)\s*$){_WORD})\s*$"),
    "toml": (r"(?m)^\s*\[([^\]]+)\]", rf"(?m)^\s*({_WORD})\s*=", rf"""["']({_WORD})(?:[<>=!~\[\s][^"'\n]*)?["']""", r"(?<![\w.])\d+(?:\.\d+){1,3}(?![\w.])"),
    "json": (rf'"({_WORD})"\s*:', rf'"({_WORD})(?:[<>=!~\[\s][^"\n]*)?"', r"(?<![\w.])\d+(?:\.\d+){1,3}(?![\w.])"),
    "md": (r"(?m)^#{1,3}\s+(.+)$",),
    "sh": (r"(?m)^\s*(?:function\s+)?([A-Za-z_][\w-]{2,})\s*\(\)\s*\{",),
}


def config_rows(out: Rows, text: str) -> None:
    """Names written in a configuration or document: keys, list items, dependencies and versions, headings."""
    suffix = PurePosixPath(out.path).suffix.lower().lstrip(".")
    rules = _CONFIG_RULES.get({"yml": "yaml"}.get(suffix, suffix), (rf"(?m)^\s*({_WORD})\s*:",))
    names = None
    if len(text) <= CONFIG_CHARS:
        count = Counter(n.strip() for r in rules for n in re.findall(r, text) if n.strip())
        names = " ".join(sorted(count, key=lambda n: (-count[n], n))[:NAME_LIMIT]) or None
    out.node(out.file, "file", PurePosixPath(out.path).name, lang="config", refs=names, labels=labels(text) if len(text) <= CONFIG_CHARS else None)
    out.edge(out.repo, out.file, "contains")


def _yaml(text: str) -> dict:
    try:
        import yaml
    except ImportError:
        return {}
    try:
        # libyaml's parser gives the same values many times faster; not every build of PyYAML has it
        data = yaml.load(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    except yaml.YAMLError:
        return {}
    return data if isinstance(data, dict) else {}


def gateway_rows(out: Rows, text: str) -> None:
    """A routing table, known by its shape: a route for each module of each service."""
    data = _yaml(text) if "services:" in text else {}
    services = data.get("services")
    specs = {k: v for k, v in services.items() if isinstance(v, dict)} if isinstance(services, dict) else {}
    if not any("modules" in v or "host" in v for v in specs.values()):
        return
    base = str(data.get("base_path") or "").rstrip("/")
    for service, spec in specs.items():
        host = re.sub(r"^\w+://", "", str(spec.get("host") or "")).split("/")[0].split(":")[0]
        for module in (str(m).strip().strip("/") for m in spec.get("modules") or []):
            if module:
                prefix = f"{base}/{module}"
                id = out.node(f"{out.repo}:gwroute:{prefix}", "gateway_route", prefix, service=str(service), host=host, module=module, prefix=prefix)
                out.edge(out.file, id, "contains")
    names = ", ".join(map(str, specs))
    out.node(out.file, "file", PurePosixPath(out.path).name, lang="config", summary=f"Routing table of {names}")


def infra_rows(out: Rows, text: str) -> None:
    """Charts, apps from values files and projects with the apps they deploy to environments."""
    where = PurePosixPath(out.path)
    if where.parent.name == "values" and where.suffix == ".yaml":
        app = out.node(f"{out.repo}:app:{where.stem}", "helm_app", where.stem, service=str(_yaml(text).get("serviceName") or where.stem))
        out.edge(app, f"{out.repo}:chart:{where.parent.parent.name}", "values_of")
        out.edge(out.repo, app, "contains")
    elif where.name == "Chart.yaml":
        out.edge(out.repo, out.node(f"{out.repo}:chart:{where.parent.name}", "helm_chart", where.parent.name), "contains")
    elif where.parent.name == "projects" and where.suffix == ".yaml" and (data := _yaml(text)):
        project = out.node(f"{out.repo}:project:{where.stem}", "deploy_project", where.stem)
        out.edge(out.repo, project, "contains")
        ends = data.get("destinations") if isinstance(data.get("destinations"), dict) else {}
        domain = {e: (d or {}).get("domain") for e, d in ends.items() if isinstance(d, dict)}
        found: dict[str, set] = {}
        served: dict[str, set] = {}
        for env, spec in (data.get("environments") or {}).items():
            for s in (spec or {}).get("services") or []:
                if isinstance(s, dict) and s.get("name"):
                    found.setdefault(s["name"], set()).add(str(env))
                    if s.get("hasDomain") and domain.get(env):
                        served.setdefault(s["name"], set()).add(f"{env}={domain[env]}")
        for name, envs in sorted(found.items()):
            app = out.node(f"{out.repo}:app:{name}", "helm_app", name, service=name)
            out.edge(project, app, "deploys", ",".join(sorted(envs)))
            if name in served:
                out.edge(project, app, "serves", ",".join(sorted(served[name])))


def file_rows(repo: str, path: str, text: str, infra: bool = False) -> list[dict]:
    """The rows of one file by its suffix (any case; ``.env`` also as a whole name)."""
    out, name = Rows(repo, path), PurePosixPath(path)
    suffix = name.suffix.lower() or (name.name.lower() if name.name.lower() in CONFIG else "")
    text = (text or "").removeprefix("﻿")
    if suffix in PYTHON:
        python_rows(out, text)
    elif suffix in SCRIPT:
        script_rows(out, text)
    elif suffix in RUST:
        rust_rows(out, text)
    elif suffix in CONFIG:
        config_rows(out, text)
        if suffix in (".yaml", ".yml"):
            (infra_rows if infra else gateway_rows)(out, text)
    return out.rows


def extract(files: DataFrame, infra: bool = False) -> DataFrame:
    """Node and edge rows (``COLUMNS``) of ``files(repo, path, text)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for f in b.itertuples() for r in file_rows(f.repo, f.path, f.text, infra)]
            frame = pd.DataFrame(rows, columns=list(COLUMNS)).astype(object)
            frame = frame.where(frame.notna(), None)
            yield frame.assign(line=pd.array(frame["line"], dtype="Int32"))

    return files.select("repo", "path", "text").mapInPandas(run, SCHEMA)
