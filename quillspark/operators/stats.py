"""Corpus statistics by group. Standard deviations are of the population; quantiles interpolate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def length_stats(df: DataFrame, by: list[str], n: Column) -> DataFrame:
    q = lambda p: F.percentile(n, F.lit(p))
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.min(n).cast("long").alias("min_len"), F.max(n).cast("long").alias("max_len"), F.round(F.avg(n), 6).alias("mean_len"),
        F.round(q(0.5), 6).alias("median_len"), F.round(F.stddev_pop(n), 6).alias("std_len"), F.round(q(0.25), 6).alias("q25"), F.round(q(0.75), 6).alias("q75"), F.sum(n).cast("long").alias("total"),
    )


def long_form(df: DataFrame, by: list[str]) -> DataFrame:
    """(by..., metric, value) of a table of metrics of one type."""
    return df.unpivot(by, [c for c in df.columns if c not in by], "metric", "value")


def quantiles(df: DataFrame, value: Column, points: dict[str, float], step: float) -> DataFrame:
    """One row: interpolated quantiles of a column over a whole table, without gathering it: rows are numbered by buckets of `step`."""
    from quillspark.operators.numbering import positions

    rows = positions(df.select(value.alias("__v")).filter("__v is not null"), [(F.floor(F.col("__v") / step), True)], [F.col("__v")], name="__i")
    n = df.filter(value.isNotNull()).count()
    out = []
    for name, p in points.items():
        at = p * (n - 1) + 1
        low, part = int(at), at - int(at)
        pick = lambda k: F.max(F.when(F.col("__i") == k, F.col("__v")))
        out.append((pick(low) * (1 - part) + F.coalesce(pick(low + 1), F.lit(0.0)) * part).alias(name))
    return rows.agg(*out)


def box_plot(df: DataFrame, by: list[str], value: Column, reach: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """The data of a box plot for each group: (boxes, outliers).

    boxes: (by..., n, q1, median, q3, whisker_low, whisker_high, n_outliers); the whiskers end at the farthest values
    within `reach` times the quartiles' distance, and quantiles interpolate. outliers: (by..., side, value, n), the values
    beyond the whiskers, equal ones together. Values are counted first, so a group is as large as its distinct values
    are many; null values take no part, and a group of one value has whiskers at its quartiles.
    """
    counts = df.select(*by, value.cast("double").alias("value")).filter("value is not null and not isnan(value)").groupBy(*by, "value").agg(F.count("*").alias("c"))
    q = lambda p: F.percentile("value", F.lit(p), F.col("c"))
    quartiles = counts.groupBy(*by).agg(F.sum("c").alias("n"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"))
    limit = reach * (F.col("q3") - F.col("q1"))
    at = [F.col(f"v.{c}").eqNullSafe(F.col(f"q.{c}")) for c in by]
    j = counts.alias("v").join(F.broadcast(quartiles).alias("q"), reduce(lambda a, b: a & b, at, F.lit(True)))  # a row for each group
    j = j.select(*(f"v.{c}" for c in by), "v.value", "v.c", "q.n", "q.q1", "q.median", "q.q3").withColumn("side", F.when(F.col("value") < F.col("q1") - limit, "low").when(F.col("value") > F.col("q3") + limit, "high"))
    inside = F.when(F.col("side").isNull(), F.col("value"))
    whisker = lambda f, edge: F.coalesce(f(inside), F.col(edge)).alias
    boxes = j.groupBy(*by, "n", "q1", "median", "q3").agg(whisker(F.min, "q1")("whisker_low"), whisker(F.max, "q3")("whisker_high"), F.coalesce(F.sum(F.when(F.col("side").isNotNull(), F.col("c"))), F.lit(0)).alias("n_outliers"))
    return boxes, j.filter("side is not null").select(*by, "side", "value", F.col("c").alias("n"))


def heat_map(df: DataFrame, row: str, column: str, value: Column) -> DataFrame:
    """(row, column, value, share, scaled) of a two-way matrix in long form, a line for every cell, empty ones with 0.

    value: an aggregate of a cell's rows. share: of its row's sum; scaled: between its column's least (0) and largest (1),
    0 where they are equal. Names of rows and columns are few: their pairs are a line each, null names are names.
    """
    cells = df.groupBy(F.col(row).cast("string").alias("row"), F.col(column).cast("string").alias("column")).agg(value.cast("double").alias("value"))
    return scaled_cells(cells)


def scaled_cells(cells: DataFrame) -> DataFrame:
    """The lines of `heat_map` from (row, column, value): any metrics, one line a cell at most."""
    lists = cells.agg(F.collect_set(F.struct("row")).alias("rows"), F.collect_set(F.struct("column")).alias("columns"))
    grid = lists.select(F.explode("rows").alias("r"), "columns").select("r.row", F.explode("columns").alias("c")).select("row", "c.column")
    full = grid.alias("g").join(cells.alias("c"), F.col("g.row").eqNullSafe(F.col("c.row")) & F.col("g.column").eqNullSafe(F.col("c.column")), "left").select("g.row", "g.column", F.coalesce("c.value", F.lit(0.0)).alias("value"))
    of_row, of_column = Window.partitionBy("row"), Window.partitionBy("column")
    low, high = F.min("value").over(of_column), F.max("value").over(of_column)
    return full.select("row", "column", "value", ratio(F.col("value"), F.sum("value").over(of_row)).alias("share"), ratio(F.col("value") - low, high - low).alias("scaled"))


def difficulty_a(rows: DataFrame, freq: DataFrame, positions: DataFrame, by: str) -> DataFrame:
    """rows: (by, n, uniq); freq: (by, token, freq); positions: (by, pos, distinct tokens there)."""
    n, u = F.col("n"), F.col("uniq")
    a = rows.groupBy(by).agg(F.count("*").alias("entries"), F.avg(n).alias("mean"), F.stddev_pop(n).alias("std"), F.avg(u).alias("uniq"), F.avg(F.when(n > 0, 1 - u / n)).alias("rep"), F.sum(n).alias("tokens"))
    b = freq.groupBy(by).agg(F.count("*").alias("vocab"), F.avg("freq").alias("fmean"), F.stddev_pop("freq").alias("fstd"))
    c = positions.groupBy(by).agg(F.stddev_pop("distinct").alias("pstd"))
    j = a.join(b, by).join(c, by)
    cv, fcv = ratio(F.col("std"), F.col("mean")), ratio(F.col("fstd"), F.col("fmean"))
    out = j.select(
        by, "entries", F.col("tokens").cast("long").alias("tokens"), "vocab", (1 / (1 + cv)).alias("length_consistency"), ratio(F.col("vocab"), F.col("tokens")).alias("vocabulary_efficiency"), ratio(F.col("uniq"), F.col("vocab")).alias("sequence_diversity"),
        (1 / (1 + cv + fcv)).alias("stability"), ratio(F.col("vocab"), F.col("mean")).alias("memory_efficiency"), ratio(F.col("uniq"), F.col("mean")).alias("complexity"), F.col("rep").alias("repetition"), F.col("pstd").alias("position_consistency"),
    )
    score = F.col("length_consistency") * 0.25 + F.col("vocabulary_efficiency") * 100 * 0.2 + F.col("stability") * 0.25 + F.least(F.col("memory_efficiency") / 100, F.lit(1.0)) * 0.2 + F.col("sequence_diversity") * 0.1
    out = out.withColumn("overall", score).withColumn("tier", F.when(score > 0.7, "easy").when(score > 0.5, "moderate").otherwise("difficult"))
    tier = lambda c, hi, lo: F.when(F.col(c) > hi, "good").when(F.col(c) > lo, "moderate").otherwise("poor")
    out = out.withColumn("length_tier", tier("length_consistency", 0.8, 0.6)).withColumn("efficiency_tier", tier("vocabulary_efficiency", 0.1, 0.05)).withColumn("stability_tier", tier("stability", 0.7, 0.5)).withColumn("memory_tier", tier("memory_efficiency", 50, 20)).withColumn("diversity_tier", tier("sequence_diversity", 0.8, 0.5))
    return out.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


def difficulty_b(rows: DataFrame, size: DataFrame, by: str, seq: str) -> DataFrame:
    """The other bundle of difficulty metrics, of sequences of ids; size: one row with vs, the vocabulary's size.

    The sequences are read twice: for their cells (by, position, id), counted once, and for themselves.
    """
    cells = rows.select(by, F.posexplode(seq).alias("i", "id")).groupBy(by, "i", "id").agg(F.count("*").alias("n"))
    k = cells.groupBy(by, "id").agg(F.sum("n").alias("n"))
    u = k.groupBy(by).agg(F.count("*").alias("used"), F.sum("n").alias("tokens"))
    top = k.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "id"))).filter("r <= 10").groupBy(by).agg(F.sum("n").alias("top"))
    id_, n = F.col("id").cast("double"), F.col("n")
    mean = F.sum(id_ * n) / F.sum(n)
    spread = F.sqrt(F.greatest(F.sum(id_ * id_ * n) / F.sum(n) - mean * mean, F.lit(0.0)))
    pv = cells.filter("i < 50").groupBy(by, "i").agg(spread.alias("s")).groupBy(by).agg(F.avg("s").alias("pv"))
    length = F.size(seq)
    per = rows.groupBy(by, F.md5(F.array_join(F.col(seq).cast("array<string>"), " ")).alias("h")).agg(F.count("*").alias("c"), F.sum(length).alias("l"), F.sum(length * length).alias("ll"))
    per = per.groupBy(by).agg(F.sum("c").alias("sequences"), F.count("*").alias("kinds"), (F.sum("l") / F.sum("c")).alias("mean"), F.sqrt(F.greatest(F.sum("ll") / F.sum("c") - (F.sum("l") / F.sum("c")) ** 2, F.lit(0.0))).alias("std"))
    j = per.join(u, by).join(top, by).join(pv, by).crossJoin(size)
    eff, cv, div = F.col("used") / F.col("vs"), ratio(F.col("std"), F.col("mean")), F.col("kinds") / F.col("sequences")
    r = lambda c, n: F.round(c, 6).alias(n)
    return j.select(by, "sequences", "tokens", F.col("used").alias("unique_tokens"), r(eff, "vocab_efficiency"), r(cv, "length_consistency"), r(eff / (1 + cv), "stability"), r(1 / (1 + F.col("mean") / 100), "memory_efficiency"), r(div, "sequence_diversity"), r((cv + (1 - eff) + (1 - div)) / 3, "complexity"), r(F.col("top") / F.col("tokens"), "repetition"), r(1 / (1 + F.col("pv")), "position_consistency"))
