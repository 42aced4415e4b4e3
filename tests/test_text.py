from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text


def value(spark, column, **row):
    cols = [F.lit(v).alias(k) for k, v in row.items()]
    return spark.range(1).select(*cols).select(column.alias("v")).first()[0]


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("listApiCollections", ["list", "api", "collections"]),
        ("user_id", ["user", "id"]),
        ("sdk 1.33.0 up", ["sdk", "1", "33", "0", "up", "1.33.0"]),
        ("plain 12 and a1.2b", ["plain", "12", "and", "a1", "2b"]),
        ("로그인 화면", ["로그인", "화면"]),
        ("", []),
        (None, []),
    ],
)
def test_tokenize(spark, given, expected):
    assert value(spark, text.tokenize("t"), t=given if given is not None else None) == expected


def test_query_tokens_fall_back_to_all(spark):
    assert value(spark, text.query_tokens("t"), t="for the class") == ["the"]
    assert value(spark, text.query_tokens("t"), t="for class") == ["for", "class"]
    assert value(spark, text.query_tokens("t"), t="go go") == ["go", "go"]


def test_mentions(spark):
    m = value(spark, text.mentions("t"), t="open /ontology/ and page.tsx, then validate_token or ToolCard")
    assert (m.routes, m.files, m.symbols) == (["/ontology"], ["page.tsx"], ["validate_token", "ToolCard"])


@pytest.mark.parametrize(
    ("url", "expected"), [("/users/${id}?a=1", "/users/*"), ("/a/:b/{c}/[d]", "/a/*/*/*"), ("http://x/y", "/http:/x/y"), ("/", "/"), ("/user${id}/a*b/x{y", "/*/*/*")]
)
def test_normalize_url(spark, url, expected):
    assert value(spark, text.normalize_url("u"), u=url) == expected


@pytest.mark.parametrize(
    ("request_text", "expected"),
    [("fix the crash", "bug"), ("add a page", "feature"), ("rename it", "refactor"), ("why?", "question"), ("hello", "question"), ("버그 고쳐줘", "bug")],
)
def test_intent(spark, request_text, expected):
    assert value(spark, text.intent("t"), t=request_text) == expected


def test_small_rules(spark):
    assert value(spark, text.mask_secrets("t"), t="https://bob:pw@host/x ghp_abcdefgh xoxb-1234567 ssh://t0ken@h github_pat_abcdefgh") == "https://bob:***@host/x ghp_*** xoxb-1234567 ssh://***@h github_pat_***"
    assert value(spark, text.slugify("t"), t=" Add: New Page! ") == "add-new-page"
    assert value(spark, text.host_of("t"), t="http://some-host:8000/x") == "some-host"
    assert value(spark, text.area_of("t"), t="a/b/c/d.py") == "a/b/c"
    assert value(spark, text.token_estimate(F.length("t")), t="123456789") == 2
