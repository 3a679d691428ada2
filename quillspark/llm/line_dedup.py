"""Site-relative line dedup: a line that too large a share of a host's pages contains is boilerplate and is dropped.

Built of DataFrame operations only. Each page sends each of its distinct lines once, as a 128-bit hash, and counts are
pre-aggregated before the shuffle, so neither a hot host nor a hot line gathers rows in one task. A host's boilerplate
is short by construction: lines on more than `ratio` of its pages number at most (mean distinct lines a page) / ratio.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import join_counted, scratch, written

RATIO, MIN_PAGES = 0.2, 3
#: Hosts' boilerplate up to so many hashes (16 bytes each) is broadcast; more is joined by a shuffle.
BROADCAST_HASHES = 200_000

BLOCK = r"(?is)<(?:!--.*?-->|(?:script|style)\b.*?</(?:script|style)\s*>)"
BREAK = r"(?i)</?(?:p|div|li|ul|ol|nav|article|section|header|footer|main|aside|h[1-6]|br|hr|tr|td|th|table|title|head|body|html|meta|form|blockquote|pre)\b[^>]*>"

#: Behind an '&', and what it stands for.
ENTITIES = (("nbsp;", " "), ("lt;", "<"), ("gt;", ">"), ("quot;", '"'), ("#39;", "'"), ("amp;", "&"))

#: Stands in for an opener that nothing closes, while blocks are taken out.
OFF = "\0"


def _let(value: Column, f) -> Column:
    """f of a value that is made once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def _blocks(html: Column) -> Column:
    """A space for each comment, script and style. An opener that nothing closes would be followed to the page's end, each
    anew, so those behind the last end are switched off first: then every opener meets its end, in linear time. Most pages
    have none; there a search from the page's end says so, and nothing is rewritten."""

    def comments(t: Column) -> Column:
        off = lambda tail: F.when(F.contains(tail, F.lit("<!--")), F.concat(_head(t, tail), F.replace(tail, F.lit("<!--"), F.lit(f"<!-{OFF}-")))).otherwise(t)
        return _let(F.substring_index(t, "-->", -1), off)

    def scripts(t: Column) -> Column:
        off = lambda head: F.concat(head, F.regexp_replace(F.substr(t, F.length(head) + 1), r"(?i)<(?=(script|style)\b)", f"<{OFF}"))
        cut = _let(F.regexp_extract(t, r"(?is)^.*</(script|style)\s*>", 0), off)
        # what stands behind the last plain end holds all that stands behind the last end; searches cost less than patterns
        opens = _let(F.substring_index(t, "</script>", -1), lambda x: _any(x, ("<s", "<S")) & F.substring_index(x, "</style>", -1).rlike(r"(?i)<(?:script|style)\b"))
        return F.when(opens, cut).otherwise(t)

    def on(t: Column) -> Column:
        return F.when(F.contains(t, F.lit(OFF)), F.replace(F.replace(t, F.lit(f"<!-{OFF}-"), F.lit("<!--")), F.lit(f"<{OFF}"), F.lit("<"))).otherwise(t)

    return _let(F.regexp_replace(_let(_let(html, comments), scripts), BLOCK, " "), on)


def _head(text: Column, tail: Column) -> Column:
    return F.substr(text, F.lit(1), F.length(text) - F.length(tail))


def _any(text: Column, parts: Iterable[str]) -> Column:
    return reduce(Column.__or__, (F.contains(text, F.lit(x)) for x in parts))


def _spaces(text: Column) -> Column:
    """A space for each run of white space; the pattern runs only where pairs of spaces made one do not do."""
    return _let(F.replace(text, F.lit("  "), F.lit(" ")), lambda t: F.when(_any(t, ("\n", "  ", "\r", "\t", "\f", "\v")), F.regexp_replace(t, r"\s+", " ")).otherwise(t))


def _tags(text: Column, pattern: str, by: str) -> Column:
    """Replaces a pattern that begins with '<' and ends in '>'; what stands behind the last '>' cannot match, and is not
    tried where it has a '<'."""

    def cut(t: Column, tail: Column) -> Column:
        return F.when(F.contains(tail, F.lit("<")), F.concat(F.regexp_replace(_head(t, tail), pattern, by), tail)).otherwise(F.regexp_replace(t, pattern, by))

    return _let(text, lambda t: _let(F.substring_index(t, ">", -1), lambda tail: cut(t, tail)))


def _entities(text: Column) -> Column:
    """All in one pass, which is the same as one after the other: no entity has the signs that they stand for, but '&' of the last."""

    def read(part: Column) -> Column:  # that stood behind an '&'
        out = F.concat(F.lit("&"), part)
        for name, char in ENTITIES:
            out = F.when(F.startswith(part, F.lit(name)), F.concat(F.lit(char), F.substr(part, F.lit(len(name) + 1)))).otherwise(out)
        return out

    return _let(F.split(text, "&"), lambda p: F.concat(F.get(p, 0), F.array_join(F.transform(F.slice(p, 2, F.size(p)), read), "")))


def html_lines(html: Column) -> Column:
    """The visible text of a page, a line for each block element; a null or empty page has no line.

    Time is linear in the page, however many openers are never closed and however long its runs of spaces are.
    """
    text = _spaces(_blocks(F.coalesce(html, F.lit(""))))
    text = _tags(text, BREAK, "\n")
    text = _tags(text, r"<[^>]*>", "")
    return F.array_join(F.filter(F.transform(F.split(_entities(text), "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")


def host_of(url: Column) -> Column:
    """The lower-case host of a URL, without user and port; '' where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit(7)).alias("b"))


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float, min_pages: int, copies: bool = True) -> DataFrame:
    """(host, bad): the hashes of the lines on at least min_pages pages and on more than ratio of the host's pages.

    Without copies the pages of a host with the same text, told apart by a 128-bit hash, are one page.
    """
    lines = F.array_distinct(F.transform(F.split(F.col(text), "\n"), lambda x: F.trim(x)))
    keys = F.transform(F.filter(lines, lambda x: x != ""), _key)
    pages = pages.select(F.col(host).alias("host"), keys.alias("keys"), *([] if copies else [_key(F.col(text)).alias("page")]))
    if not copies:
        pages = pages.groupBy("host", "page").agg(F.first("keys").alias("keys"))
    seen = pages.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    total = pages.groupBy("host").agg(F.count("*").alias("pages"))
    return seen.join(total, "host").filter(F.col("n") > ratio * F.col("pages")).groupBy("host").agg(F.collect_list("key").alias("bad"))


def drop_boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES, copies: bool = True) -> DataFrame:
    """pages with `text` cut, and with n_lines and n_dropped (non-empty lines before, and dropped) added.

    A line is what stands between line breaks, compared without spaces at its ends; empty lines are never counted nor
    dropped. Each row is a page of its own, repeated rows too; without `copies` the rows of a host with the same text
    count as one page, so that a group of copies does not make its own lines boilerplate. A null host is a host of its
    own; a null text is left null, with no line. Columns n_lines and n_dropped of the input are overwritten; all others
    are carried along, whatever their names.
    """
    spark = pages.sparkSession
    folder = scratch(spark)
    made = pages.select(F.coalesce(F.col(host).cast("string"), F.lit("\0")).alias("host"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bad = written(boilerplate(made, "host", "text", ratio, min_pages, copies), folder, "boilerplate")
    n = bad.agg(F.sum(F.size("bad"))).first()[0] or 0
    tag = next(t for t in ("__", *(f"__{i}_" for i in range(len(pages.columns) + 1))) if not any(c.startswith(t) for c in pages.columns))
    key, lines, kept, name, hashes = (tag + x for x in ("key", "lines", "kept", "host", "bad"))
    bad = bad.select(F.col("host").alias(name), F.col("bad").alias(hashes))
    rows = pages.withColumn(key, F.coalesce(F.col(host).cast("string"), F.lit("\0"))).withColumn(lines, F.split(F.coalesce(F.col(text), F.lit("")), "\n"))
    if n <= BROADCAST_HASHES:
        rows = rows.join(F.broadcast(bad), F.col(key) == F.col(name), "left")
    else:  # every host has a row, so that hosts with very many pages can be told from the others
        hosts = rows.groupBy(key).agg(F.count("*").alias("n")).join(bad, F.col(key) == F.col(name), "left").select(key, "n", hashes)
        rows = join_counted(rows, written(hosts, folder, "hosts"), [key], "n").withColumn(name, F.lit(None))
    left = F.when(F.col(hashes).isNull(), F.col(lines)).otherwise(F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(hashes), _key(F.trim(x)))))
    full = lambda c: F.size(F.filter(c, lambda x: F.trim(x) != "")).cast("long")
    rows = rows.withColumn(kept, left).withColumn("n_lines", full(lines)).withColumn("n_dropped", F.col("n_lines") - full(kept))
    cut = F.when(F.col(text).isNotNull(), F.array_join(kept, "\n"))
    return rows.withColumn(text, cut).drop(key, lines, kept, name, hashes)


def page_lines(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per page: page_id, host, n_lines, n_dropped, kept (the text without its host's boilerplate).

    A null or empty html has no line and an empty text; a null url, or one without a host, belongs to the host ''. Repeated
    page ids and repeated rows are pages of their own; a null page_id is kept; other columns are not read. An empty table
    gives no row.
    """
    made = pages.select("page_id", host_of(F.col("url")).alias("host"), html_lines(F.col("html")).alias("kept"))
    folder = scratch(pages.sparkSession)
    made = written(made, folder, "lines")  # the text is made once, for counting and for cutting
    return drop_boilerplate(made, "host", "kept", ratio, min_pages).select("page_id", "host", "n_lines", "n_dropped", "kept")


PAGE_SQL = r"""
WITH cleaned AS (
  SELECT page_id,
    lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
      '(?is)<!--.*?-->|<(script|style)\b.*?</(script|style)\s*>', ' ', 'g'), '\s+', ' ', 'g'),
      '(?i)</?(p|div|li|ul|ol|nav|article|section|header|footer|main|aside|h[1-6]|br|hr|tr|td|th|table|title|head|body|html|meta|form|blockquote|pre)\b[^>]*>', chr(10), 'g'),
      '<[^>]*>', '', 'g') AS t
  FROM pages),
made AS (
  SELECT row_number() OVER () AS r, page_id, host,
    regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'),
      ' *\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') AS kept
  FROM cleaned),
lines AS (SELECT r, host, unnest(list_distinct(list_filter(list_transform(string_split(kept, chr(10)), lambda x: trim(x)), lambda x: x <> ''))) AS line FROM made),
seen AS (SELECT host, line, count(*) AS n FROM lines GROUP BY ALL HAVING count(*) >= 3),
total AS (SELECT host, count(*) AS pages FROM made GROUP BY host),
bad AS (SELECT host, list(line) AS bad FROM seen JOIN total USING (host) WHERE n > 0.2 * pages GROUP BY host),
cut AS (SELECT page_id, m.host, list_filter(string_split(kept, chr(10)), lambda x: trim(x) <> '') AS before,
    list_filter(string_split(kept, chr(10)), lambda x: trim(x) = '' OR NOT list_contains(coalesce(b.bad, []), trim(x))) AS after
  FROM made m LEFT JOIN bad b ON m.host = b.host)
SELECT page_id, host, len(before)::BIGINT AS n_lines, (len(before) - len(list_filter(after, lambda x: trim(x) <> '')))::BIGINT AS n_dropped,
  array_to_string(after, chr(10)) AS kept
FROM cut
"""
