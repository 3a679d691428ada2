"""How the filters of a chain interact, from one pass over the documents, by a subset-zeta transform.

A document's failures are a mask with a bit for each filter. Documents are counted by part and mask; a zeta transform
over the subsets turns the counts of a part, at most 2**k numbers, into survivors: how many documents fail nothing
outside a set. What a filter removes after others is the difference of two neighbouring sets, so every order and every
step of it is read off without another look at a document; the same with counts of labelled documents.

All of it is DataFrame operations. Texts are read once and digested; equal texts share a digest, and only (digest, id)
pairs and ids are shuffled, so a text with very many copies makes no hot key.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import scratch, written

#: Filters of the registered query, in the order of their bits.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
SIGNS = "[#$%&*|]"
#: What is counted of each part and mask: documents, good ones, toxic ones.
VALUES = ["n", "good", "toxic"]


def text_mask(text: Column, words: Column) -> Column:
    """Bits of the filters A to D, which look at one text alone. words: its words."""
    capitals = F.regexp_count(text, F.lit("[A-Z]")).cast("long")
    fails = [
        F.size(words) < LEAST_WORDS,
        F.size(F.array_distinct(words)).cast("long") * 100 < F.size(words).cast("long") * LEAST_DISTINCT,
        capitals * 100 > F.length(text).cast("long") * MOST_CAPITALS,
        text.rlike(SIGNS),
    ]
    return sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(fails)), F.lit(0))


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, mask) of each row: A few words, B few distinct ones, C capitals, D signs, E a text that a smaller id has.

    A null text is an empty one, a null part the empty string. A null id is neither smaller nor larger than another
    one, so such a row never fails E and makes no other row fail it; rows with the same id and text do not either.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), text_mask(F.col("text"), F.col("words")).alias("mask"))
    rows = written(rows, scratch(docs.sparkSession), "masks")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    later = F.col("first").isNull() & F.col("doc_id").isNotNull()
    # by digest and id, so the copies of a text are dealt out
    return rows.join(first, ["digest", "doc_id"], "left").select("doc_id", "part", F.when(later, F.col("mask") + 16).otherwise(F.col("mask")).alias("mask"))


def counts(rows: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(part, mask, n, good, toxic) from (doc_id, part, mask). A document is good, or toxic, if any label row of its id says so."""
    if labels is None:
        rows = rows.withColumn("good", F.lit(False)).withColumn("toxic", F.lit(False))
    else:
        flags = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
        rows = rows.join(flags.filter("good or toxic"), "doc_id", "left")
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def survivors(counted: DataFrame, filters: int, values: list[str]) -> DataFrame:
    """A row for each part: for each value an array whose place T holds its sum over the masks within T.

    So place T is what stays when all filters outside T are applied. One step of the zeta transform for each filter.
    """
    places = F.sequence(F.lit(0), F.lit((1 << filters) - 1))
    cells = F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*values))))  # 2**filters at most
    out = counted.groupBy("part").agg(cells.alias("cells"))

    def listed(v: str) -> Column:
        return F.transform(places, lambda m: F.coalesce(F.try_element_at("cells", m).getField(v), F.lit(0).cast("long")))

    def summed(v: str, bit: int) -> Column:
        return F.transform(v, lambda x, m: F.when(m.bitwiseAND(F.lit(bit)) > 0, x + F.get(F.col(v), m - F.lit(bit))).otherwise(x))

    out = out.select("part", *(listed(v).alias(v) for v in values))
    for i in range(filters):
        out = out.select("part", *(summed(v, 1 << i).alias(v) for v in values))
    return out


def steps(kept: DataFrame, names: str) -> DataFrame:
    """Every order of the filters and every step of it, from `survivors`: what stays, goes, would have gone, and is lost.

    names: one letter for each filter, in the order of the bits. shapley: removed by the step's filter, over all orders.
    """
    k = len(names)
    full = (1 << k) - 1
    orders = F.array(*(F.lit("".join(p)) for p in permutations(names)))
    weights = F.array(*(F.lit(factorial(j) * factorial(k - 1 - j)).cast("long") for j in range(k)))
    at = lambda v, sets: F.get(F.col(v), sets)
    bit_of = lambda letter: F.pow(F.lit(2), F.instr(F.lit(names), letter) - 1).cast("int")
    out = kept.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    place = F.filter(F.sequence(F.lit(1), F.lit(k)), lambda i: i < F.col("step"))
    before = F.aggregate(place, F.lit(0), lambda s, i: s + bit_of(F.substring("filter_order", i, F.lit(1))))
    out = out.withColumn("bit", bit_of(F.substring("filter_order", F.col("step"), F.lit(1)))).withColumn("before", before)
    bit, before = F.col("bit"), F.col("before")
    after = full - before - bit
    others = F.filter(F.sequence(F.lit(0), F.lit(full)), lambda s: s.bitwiseAND(bit) == 0)
    shapley = F.aggregate(others, F.lit(0).cast("long"), lambda t, s: t + F.get(weights, F.bit_count(s)) * (at("n", full - s) - at("n", full - s - bit)))
    lost = lambda v: at(v, full - before) - at(v, after)
    return out.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), at("n", after).alias("kept"), lost("n").alias("removed"),
        (at("n", F.lit(full)) - at("n", full - bit) - lost("n")).alias("redundant"), (at("n", bit) - at("n", F.lit(0))).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), shapley.alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One row per part, order of the filters A to E and step; see `masks` and `counts` for nulls, repeats and labels.

    Repeated rows count as often as they come. Zeros are rows like others. Without documents there is no part and no
    row. Columns of other names are not read; label columns that are null say nothing.
    """
    return steps(survivors(counts(masks(docs), labels), len(FILTERS), VALUES), FILTERS)


#: The same by direct counts for each set of filters, without a transform.
SQL = """
with words as (
  select doc_id, coalesce(text, '') as text, coalesce(source, '') as part, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w
  from documents
), first as (
  select text, min(doc_id) as first from words group by text
), flags as (
  select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id
), rows_ as (
  select d.part, coalesce(f.good, 0) as good, coalesce(f.toxic, 0) as toxic,
    (case when len(w) < 200 then 1 else 0 end) + (case when 100 * len(list_distinct(w)) < 50 * len(w) then 2 else 0 end)
    + (case when 100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 2 * length(d.text) then 4 else 0 end)
    + (case when regexp_matches(d.text, '[#$%&*|]') then 8 else 0 end) + (case when d.doc_id > x.first then 16 else 0 end) as mask
  from words d join first x on d.text = x.text left join flags f on d.doc_id = f.doc_id
), counted as (
  select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from rows_ group by part, mask
), letters as (
  select unnest(['A', 'B', 'C', 'D', 'E']) as l
), orders as (
  select a.l || b.l || c.l || d.l || e.l as filter_order
  from letters a, letters b, letters c, letters d, letters e
  where a.l <> b.l and a.l <> c.l and a.l <> d.l and a.l <> e.l and b.l <> c.l and b.l <> d.l and b.l <> e.l and c.l <> d.l and c.l <> e.l and d.l <> e.l
), places as (
  select filter_order, step, cast(1 << (instr('ABCDE', substring(filter_order, step, 1)) - 1) as int) as bit,
    cast(list_sum([0] || [1 << (instr('ABCDE', substring(filter_order, cast(j as int), 1)) - 1) for j in range(1, step)]) as int) as before
  from orders, (select cast(unnest(range(1, 6)) as int) as step)
), found as (
  select part, filter_order, step, bit,
    sum(case when mask & (before | bit) = 0 then n else 0 end) as kept,
    sum(case when mask & before = 0 and mask & bit > 0 then n else 0 end) as removed,
    sum(case when mask & before > 0 and mask & bit > 0 then n else 0 end) as redundant,
    sum(case when mask = bit then n else 0 end) as unique_fails,
    sum(case when mask & before = 0 and mask & bit > 0 then good else 0 end) as good_lost,
    sum(case when mask & before = 0 and mask & bit > 0 then toxic else 0 end) as toxic_lost
  from counted, places group by part, filter_order, step, bit
)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
  cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
  cast(sum(removed) over (partition by part, bit) as bigint) as shapley
from found
"""
