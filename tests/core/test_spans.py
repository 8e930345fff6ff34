"""Placeholders on texts with odd spans."""

import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glossaflow.functions import spans


def prepared(spark, texts, names):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    filters = spans.resolve(names)
    df = spans.protect(df, "text", filters).withColumn("back", spans.restore(F.col("prepared"), F.col("spans"), len(filters)))
    return df.orderBy("i").collect()


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("see https://a.b/c. End", "see @@0@@ End"),
        ("mailto:x@y and mailto://x@y", "mailto:x@y and @@0@@"),
        ("яhttp://a.b", "я@@0@@"),
        ("xhttp://a.b", "xhttp://a.b"),
        ("HTTP://A.B\nftp://c]'", "@@0@@\n@@1@@"),
        ("(http://a.b)", "(@@0@@)"),
        ("http://a b c", "@@0@@ c"),
        ("http://a http://b", "@@0@@ @@1@@"),
        ("", ""),
        ("none", "none"),
    ],
)
def test_addresses(spark, text, want):
    row = prepared(spark, [text], ["url"])[0]
    assert row.prepared == want and row.back == text


def test_elements(spark):
    cases = [
        ("<article>x</a> <a href=1>y</a>", ["html_a"], "@@0@@ @@1@@"),
        ("<b><b>x</b></b>", ["html_b"], "@@0@@</b>"),
        ("<CODE>\n1</code>2", ["html_code"], "@@0@@2"),
        ("<h1>a</h1><h7>b</h7>", ["html_h[1-6]"], "@@0@@<h7>b</h7>"),
    ]
    for text, names, want in cases:
        row = prepared(spark, [text], names)[0]
        assert row.prepared == want and row.back == text


def test_a_later_filter_takes_earlier_placeholders(spark):
    row = prepared(spark, ["<a>x http://u </a> http://v"], ["url", "html_a"])[0]
    assert row.prepared == "@@2@@ @@1@@" and row.back == row.text
    assert [s.found for s in row.spans] == [["http://u", "http://v"], ["<a>x @@0@@ </a>"]]
    other = prepared(spark, ["<a>x http://u </a> http://v"], ["html_a", "url"])[0]
    assert other.prepared == "@@0@@ @@1@@" and other.back == other.text


def test_what_looks_like_a_placeholder(spark):
    """Marks in the text, and a number between two spans, don't come back as they were; holds_marks() tells of the first."""
    row = prepared(spark, ["@@0@@ http://z", "<code>a</code><code>b</code>0<code>c</code>", "<code>a</code>0<code>b</code>c"], ["url", "html_code"])
    assert row[0].back == "http://z http://z"
    assert row[1].prepared == "@@0@@@@1@@0@@2@@" and row[1].back == "<code>a</code>@@1<code>a</code>2@@"
    assert row[2].back == row[2].text
    df = spark.createDataFrame([("@@0@@ x",), ("@@ x",)], "t string")
    assert [r[0] for r in df.select(spans.holds_marks(F.col("t"))).collect()] == [True, False]


def test_null_and_no_filters(spark):
    row = prepared(spark, [None, "a"], ["url"])
    assert row[0].prepared is None and row[0].back is None and row[0].spans is None
    row = prepared(spark, ["http://a"], ["nothing"])
    assert row[0].prepared == "http://a" and row[0].spans == []


def test_names():
    assert [f.name for f in spans.resolve(["url", "x", "html_a", "url"])] == ["url", "html_a", "url"]
    assert spans.parse_names(" url,html_a ,") == ["url", "html_a", ""] and spans.parse_names(None) == []


def test_stats(spark):
    df = spans.protect(spark.createDataFrame([("http://a http://b",)], "text string"), "text", spans.resolve(["html_a", "url"]))
    assert [tuple(x) for x in df.select(spans.stats(F.col("spans")).alias("s")).first().s] == [("html_a", 0), ("url", 2)]


def test_native_plan(spark):
    df = spans.protect(spark.createDataFrame([("a",)], "text string"), "text", spans.resolve(["url", "html_a", "html_b"]))
    plan = df.select("prepared")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


_PIECE = st.sampled_from(["http://a.b/c", "<a href=x>y</a>", "text ", " <a>", "</a> ", "\n", "é中 ", "mailto://q ", "<A>z</A>"])


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(_PIECE, max_size=8).map(" ".join), min_size=20, max_size=40))
def test_back_is_the_text(spark, texts):
    for names in (["url", "html_a"], ["html_a", "url", "html_a"]):
        assert all(r.back == r.text for r in prepared(spark, texts, names))


def by_one_after_another(text, names):
    """Prepared, spans and restored text by plain matching and replacing, as the filters are defined."""
    n, held = 0, []
    for made in spans.resolve(names):
        pattern = re.compile(made.pattern.replace("\\s", " \\t\\n\\x0b\\f\\r"))
        found = pattern.findall(text)
        numbers = iter(range(n, n + len(found)))
        text = pattern.sub(lambda _, it=numbers: f"@@{next(it)}@@", text)
        held.append((n, found))
        n += len(found)
    prepared = text
    for first, found in reversed(held):
        for i, v in enumerate(found):
            text = text.replace(f"@@{first + i}@@", v)
    return prepared, held, text


_ODD = ["<a", "<A href=1>", "</a>", "</A>", ">", "<article>", "<b>", "x ", "</b>", "\n", "http://q.r/s", "@@", "@@0@@", "@", "1", "0", "12@@", "<h1>", "</h2>", "é😀", "@@007@@", "@@99999999999999999999@@"]


@pytest.mark.parametrize("names", [["html_a"], ["html_a", "url", "html_h[1-6]"], ["url", "html_a", "html_b"], ["html_a", "html_a"], ["html_a|b", "url"]])
def test_equals_plain_matching_and_replacing(spark, names):
    """Openings without >, end tags alone, marks that share characters or arise from spans."""
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(_ODD) for _ in range(rnd.randrange(25))) for _ in range(1500)]
    for r in prepared(spark, texts, names):
        assert (r.prepared, [(s.first, list(s.found)) for s in r.spans], r.back) == by_one_after_another(r.text, names), r.text


@pytest.mark.parametrize(
    ("text", "names", "n"),
    [
        ("<article>" + "x y" * 3_300_000, ["html_a"], 0),
        ("<a>" * 100_000 + "</b>", ["html_a"], 0),
        ("<a " * 100_000 + "</a>", ["html_a"], 0),
        ("<a </a>" * 100_000, ["html_a"], 50_000),
        ("x<a>y</a>" * 100_000, ["html_a"], 100_000),
        ("http://a.b/c <a>y</a> " * 100_000, ["html_a", "url"], 100_000),
    ],
    ids=["one opening", "openings alone", "openings without >", "pairs", "elements", "two filters"],
)
def test_large_pages_take_linear_time(spark, text, names, n):
    """Each takes some seconds; by matching with backtracking, or replacing one by one, minutes to hours."""
    filters = spans.resolve(names)
    df = spans.protect(spark.createDataFrame([(text,)], "text string"), "text", filters)
    began = time.monotonic()
    row = df.select(F.size(F.col("spans")[0]["found"]).alias("n"), (spans.restore(F.col("prepared"), F.col("spans"), len(filters)) == F.col("text")).alias("same")).first()
    assert row.n == n and row.same and time.monotonic() - began < 60
