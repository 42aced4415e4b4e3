"""Text rules as Spark expressions: tokens, mentions, identifiers, URLs, small classifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of programming languages that tell nothing in a request.
CODE_STOPWORDS = (
    "if else for while return break continue def class function func const let var "
    "import from export default public private static void new this self true false null none "
    "type interface struct enum impl trait fn pub mut async await try catch throw finally"
).split()
# Marks of test code.
TEST_MARKERS = ("test", "spec", "__tests__", "conftest", "fixture")
# Phrases that hint at what a request wants.
INTENT_HINTS = {
    "bug": (
        "버그", "고쳐", "고쳐줘", "고장", "안 돼", "안돼", "안된다", "에러", "오류", "깨져", "깨짐",
        "fix", "bug", "error", "broken", "crash", "실패",
    ),
    "feature": (
        "추가", "만들어", "만들자", "새로", "구현해", "붙여", "feature", "add", "implement", "create", "지원",
    ),
    "refactor": (
        "리팩토링", "리팩터", "정리해", "정리", "개선해", "개선", "refactor", "cleanup", "단순화",
        "지워", "지우", "삭제", "제거", "없애", "빼줘", "빼라", "빼자", "줄여", "줄이", "간소화",
        "수정해", "수정", "변경", "바꿔", "바꾸", "교체", "이름바꿔", "옮겨",
        "remove", "delete", "strip", "drop", "prune", "rename", "replace", "modify", "update", "change",
    ),
    "question": (
        "뭐야", "뭐가", "어디", "어때", "왜", "how", "what", "where", "why", "설명", "알려줘", "있어?", "?",
    ),
}

# What counts as a version, a route, a file name and a symbol in a request.
VERSION = r"(?U)(?<![\w.])\d+(?:\.\d+){1,3}(?![\w.])"
ROUTE = r"(?iU)(?<![\w/])/[a-z0-9][\w\-/\[\]]*"
FILE = r"(?iU)\b[\w\-]+\.(?:py|tsx?|jsx?|rs|vue|svelte|go|java|rb)\b"
SYMBOL = r"(?U)\b(?:[a-z]+(?:_[a-z0-9]+)+|[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+)\b"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: Column | str) -> Column:
    """Lower-case words: camel case is split, anything but 0-9, a-z and Hangul syllables separates."""
    # the capital is looked for first and what stands before it second: most characters fail at once
    spaced = F.regexp_replace(F.coalesce(_col(text), F.lit("")), "([A-Z])(?<=[a-z0-9][A-Z])", " $1")
    return F.array_remove(F.split(F.lower(spaced), "[^0-9a-z가-힣]+"), "")


def versions(text: Column | str) -> Column:
    """Dotted version literals, whole."""
    c = F.coalesce(_col(text), F.lit(""))
    found = F.regexp_extract_all(c, F.lit(VERSION), F.lit(0))
    return F.when(c.rlike(r"\d\.\d"), found).otherwise(F.array().cast("array<string>"))


def has_tokens(text: Column | str) -> Column:
    """Whether a text has any token; far cheaper than the tokens."""
    return F.coalesce(_col(text), F.lit("")).rlike("[0-9A-Za-z가-힣]")


def tokenize(text: Column | str) -> Column:
    """Words, then whole version literals."""
    return F.concat(words(text), versions(text))


def query_tokens(text: Column | str) -> Column:
    """Tokens of a request without code stop words, repeats kept; all tokens if nothing else is left."""
    every = tokenize(text)
    telling = F.filter(every, lambda t: ~t.isin(CODE_STOPWORDS))
    return F.when(F.size(telling) > 0, telling).otherwise(every)


def wants_tests(text: Column | str) -> Column:
    low = F.lower(_col(text))
    out = F.lit(False)
    for m in TEST_MARKERS:
        out = out | low.contains(m)
    return out


def mentions(text: Column | str) -> Column:
    """``struct<routes, files, symbols>`` that a request names, as written."""
    c = F.coalesce(_col(text), F.lit(""))
    routes = F.transform(
        F.regexp_extract_all(c, F.lit(ROUTE), F.lit(0)),
        lambda r: F.when(F.rtrim(r, F.lit("/")) == "", F.lit("/")).otherwise(F.rtrim(r, F.lit("/"))),
    )
    return F.struct(
        routes.alias("routes"),
        F.regexp_extract_all(c, F.lit(FILE), F.lit(0)).alias("files"),
        F.regexp_extract_all(c, F.lit(SYMBOL), F.lit(0)).alias("symbols"),
    )


def normalize_url(url: Column | str) -> Column:
    """A called path: query dropped, parameter segments as ``*``, leading slash; a scheme stays a segment.

    A segment is a parameter if it begins with a colon or has a ``*``, ``{`` or ``[`` once templates are ``*``.
    """
    bare = F.regexp_replace(F.substring_index(_col(url), "?", 1), r"\$\{[^}]*\}", "*")
    parts = F.filter(F.split(bare, "/"), lambda s: s != "")
    param = lambda s: s.startswith(":") | s.contains("*") | s.contains("{") | s.contains("[")
    return F.concat(F.lit("/"), F.array_join(F.transform(parts, lambda s: F.when(param(s), "*").otherwise(s)), "/"))


def slugify(text: Column | str, limit: int = 40) -> Column:
    """Lower-case words joined by hyphens."""
    s = F.regexp_replace(F.lower(_col(text)), "[^0-9a-z가-힣]+", "-")
    return F.rtrim(F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, limit), F.lit("-"))


def area_of(path: Column | str) -> Column:
    """The first three segments of a path."""
    return F.array_join(F.slice(F.split(_col(path), "/"), 1, 3), "/")


def host_of(url: Column | str) -> Column:
    """The host of a URL or of a bare host with a port."""
    return F.regexp_extract(_col(url), r"^(?:[a-z][a-z0-9+.-]*://)?([^/:?#]+)", 1)


# Credentials in URLs of any scheme, and prefixes by which issuers mark access tokens.
URL_SECRET = r"(?U)([a-zA-Z][a-zA-Z0-9+.-]*://)([^:/@\s]+):([^@\s]+)@"
URL_TOKEN = r"(?U)([a-zA-Z][a-zA-Z0-9+.-]*://)([^:/@\s]+)@"
BARE_TOKEN = r"(?U)\b(glpat-|gldt-|ghp_|gho_|ghu_|ghs_|github_pat_|sk-|xoxb-)[A-Za-z0-9_-]{8,}"


def mask_secrets(text: Column | str) -> Column:
    """Secrets as ``***``: a URL's password (its user stays) or token, and what follows a bare token's prefix."""
    c = F.regexp_replace(_col(text), URL_SECRET, "$1$2:***@")
    c = F.regexp_replace(c, URL_TOKEN, "$1***@")
    return F.regexp_replace(c, BARE_TOKEN, "$1***")


def hint_count(text: Column | str, hints: Sequence[str]) -> Column:
    """How many of ``hints`` stand in a text, each at most once."""
    low = F.lower(F.coalesce(_col(text), F.lit("")))
    out = F.lit(0)
    for h in hints:
        out = out + low.contains(h).cast("int")
    return out


def intent(text: Column | str) -> Column:
    """bug, feature, refactor or question: a change wins a tie against a question; the first kind wins among changes."""
    n = {k: hint_count(text, h) for k, h in INTENT_HINTS.items()}
    change = F.greatest(n["bug"], n["feature"], n["refactor"])
    return (
        F.when((change == 0) | (change < n["question"]), "question")
        .when(n["bug"] == change, "bug")
        .when(n["feature"] == change, "feature")
        .otherwise("refactor")
    )


def token_estimate(chars: Column | str) -> Column:
    """A token for every four characters."""
    return F.floor(_col(chars) / 4).cast("long")


def quality_score(files: Column, lines: Column, tests: Column) -> Column:
    """0.6, plus 0.2 for at most 5 files, 0.1 for at most 400 lines, 0.1 for tests; at most 1."""
    plus = lambda cond, v: F.when(cond, v).otherwise(0.0)
    return F.least(F.lit(1.0), F.lit(0.6) + plus(files <= 5, 0.2) + plus(lines <= 400, 0.1) + plus(tests, 0.1))
