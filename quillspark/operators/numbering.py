"""Row numbers over a whole table without one task that sorts it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def positions(df: DataFrame, buckets: list[Column], order: list[Column], group: list[str] | None = None, name: str = "pos") -> DataFrame:
    """df with `name`: the row's number from 1 in the order of (buckets, order), by group.

    Buckets are sort expressions of few distinct values (a frequency, a prefix of the key); rows are numbered within
    their bucket, and the table of bucket sizes, which is small, gives each its offset.
    """
    group = group or []
    keys = [f"__b{i}" for i in range(len(buckets))]
    plain = [b for b, _ in buckets]
    rows = df.select("*", *(b.alias(k) for b, k in zip(plain, keys)))
    sort = [F.asc(k) if up else F.desc(k) for k, (_, up) in zip(keys, buckets)]
    sizes = rows.groupBy(*group, *keys).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy(*sort).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__first", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    cond = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*group, *keys]]
    joined = rows.alias("r").join(sizes.alias("s"), cond).select("r.*", "s.__first")
    inner = F.row_number().over(Window.partitionBy(*group, *keys).orderBy(*order))
    return joined.withColumn(name, (F.col("__first") + inner).cast("long")).drop("__first", *keys)


def hash_positions(df: DataFrame, key: Column, seed: str, group: list[str] | None = None, name: str = "pos") -> DataFrame:
    """Numbers in the order of md5(seed || '|' || key): a reproducible permutation."""
    rows = df.withColumn("__h", F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string"))))
    return positions(rows, [(F.substring("__h", 1, 3), True)], [F.col("__h"), key], group, name).drop("__h")
