"""Lines of pages: against the plain patterns on made-up markup, and in linear time on long pages."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quillspark.llm import line_dedup

PARTS = ["<!--", "-->", "<script>", "<SCRIPT a='>'>", "</script>", "</ScRipt  >", "</script x", "<style", "</style>", "<scripts>", "<p>", "</p", "<br/>", "<", ">", "< b", "a", " ", "  ", "\n", "&nbsp;", "&lt;", "&amp;gt;", "é ", "<!-", "-", "--", "<i>", "</i>"]


def plain(html):
    text = re.sub(line_dedup.BLOCK, " ", html or "")
    text = re.sub(r"[ \t\n\x0b\f\r]+", " ", text)
    text = re.sub(line_dedup.BREAK, "\n", text)
    text = re.sub(r"<[^>]*>", "", text)
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = text.replace(name, char)
    return re.sub(" *\n[ \n]*", "\n", text).strip(" \n")


def lines(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    return [r["x"] for r in df.select("i", line_dedup.html_lines(F.col("html")).alias("x")).orderBy("i").collect()]


def test_lines_against_plain_patterns(spark):
    r = random.Random(8)
    pages = [None, "", *("".join(r.choices(PARTS, k=r.randrange(1, 25))) for _ in range(3000))]
    assert lines(spark, pages) == [plain(x) for x in pages]


@pytest.mark.parametrize("unit", ["<", "<!--", "<script>", "<p ", "</script ", "<b> ", "&nbsp;", "<style", "<!-- <script>", "-->", "<p><!--"])
@pytest.mark.parametrize("end", ["", " x", "-->", "</script>", ">"])
def test_a_megabyte_takes_seconds(spark, unit, end):
    html = "head <b>bold</b><p>" + unit * (1_000_000 // len(unit)) + end
    lines(spark, ["warm"])
    began = time.time()
    assert lines(spark, [html])[0].startswith("head bold")
    assert time.time() - began < 6


def chain(html):
    """The lines by the SQL's own steps, each a pattern over the whole page: quadratic where openers are not closed."""
    text = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</(script|style)\s*>", " ")
    text = F.regexp_replace(text, r"\s+", " ")
    text = F.regexp_replace(F.regexp_replace(text, line_dedup.BREAK, "\n"), r"<[^>]*>", "")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.btrim(F.regexp_replace(text, "(?<! ) *\n[ \n]*", "\n"), F.lit(" \n"))


def test_lines_against_the_chain_of_the_sql(spark):
    """With spaces and letters of all kinds, and openers that look like those of scripts."""
    r = random.Random(9)
    parts = [*PARTS, "<span>", "<STRONG ", "<Style>", "</STYLE\t>", "</style", "   ", "\t", "\r\n", "\f", " \n ", "<p><p>", "&amp;nbsp;", "&&nbsp;", "ß", "漢", "<!-- -->", "<script></script>"]
    df = spark.createDataFrame([("".join(r.choices(parts, k=r.randrange(1, 25))),) for _ in range(5000)], "html string").cache()
    got = df.select("html", line_dedup.html_lines(F.col("html")).alias("x"), chain(F.col("html")).alias("y")).filter("x <> y").collect()
    assert got == []


def test_a_plain_page_costs_as_little_as_the_chain(spark):
    """What keeps bad pages linear must not be paid for by pages that close all they open."""
    words = ("Some words of a page, é ñ and others that fill its lines. " * 6).strip()
    page = "<html><head><style>p{margin:0}</style><script>var t='</p>';</script></head><body><!-- ad --><h1>Title</h1>" + f"<p><b>{words}</b> &copy; x</p>" * 12 + "</body></html>"
    df = spark.range(4000).repartition(2).select(F.concat(F.lit(page), F.col("id").cast("string")).alias("html")).cache()
    df.count()

    def seconds(f):
        began = time.time()
        df.select(F.sum(F.length(f(F.col("html"))))).collect()
        return time.time() - began

    both = [(seconds(line_dedup.html_lines), seconds(chain)) for _ in range(6)]
    assert min(x for x, _ in both) < 1.15 * min(y for _, y in both)
