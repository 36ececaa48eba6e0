import hashlib

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as T

LINKABLE = ["EventViewImpl", "getPullRequest", "get_pull_request", "XMLParser", "MAX_RETRY", "JsonParser"]
PLAIN = ["User", "Configuration", "init", "JSON", "id", "AB", "OK", "User_", "_internal", "__init__"]


def test_linkable_words(spark):
    df = spark.createDataFrame([(w,) for w in LINKABLE + PLAIN], "w string")
    assert {r.w for r in df.filter(T.is_linkable(F.col("w"))).collect()} == set(LINKABLE)


@pytest.mark.parametrize(
    "content, strict, tokens",
    [
        ("see `Foo` and `bar_baz` but `Foo` again", False, ["Foo", "bar_baz"]),
        ("the getPullRequest of EventViewImpl is old", False, ["getPullRequest", "EventViewImpl"]),
        ("the getPullRequest of `X`", True, ["X"]),
        ("```\nfooBar\n```\nbazQux `a b`", False, ["a b", "bazQux"]),
        ("", False, []),
        (None, False, []),
    ],
)
def test_tokens(spark, content, strict, tokens):
    df = spark.createDataFrame([(content,)], "c string")
    assert df.select(T.link_tokens(F.col("c"), strict)).collect()[0][0] == tokens


def test_hashes(spark):
    df = spark.createDataFrame([("ab", "c", "Hello   world.\n\nSecond line."), ("a", "bc", "Hello world.\nSecond line."), (None, None, None)], "s string, b string, c string")
    got = df.select(T.anchor_id(F.col("s"), F.col("b")).alias("a"), T.content_hash(F.col("c")).alias("h")).collect()
    assert got[0].a == hashlib.sha256(b"ab\0c").hexdigest() != got[1].a
    assert got[0].h == got[1].h == hashlib.sha256(b"Hello world. Second line.").hexdigest()
    assert got[2].a == hashlib.sha256(b"\0").hexdigest() and got[2].h == hashlib.sha256(b"").hexdigest()


def test_oversized_counts_bytes(spark):
    df = spark.createDataFrame([("é" * 3001,), ("e" * 6000,), (None,)], "c string")
    assert [r[0] for r in df.select(T.is_oversized(F.col("c"))).collect()] == [True, False, None]


def test_ignore_list():
    merged = T.merge_ignore(["generated", "node_modules", "generated"])
    assert merged == [*T.DEFAULT_IGNORE, "generated"]
