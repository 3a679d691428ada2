"""Splits, shards and the checks of their disjointness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.operators.numbering import hash_positions, positions


def assign(df: DataFrame, key: str, train: float, val: float, seed: str, min_test: int = 0) -> DataFrame:
    """df with `split`: a permutation by hash, cut at whole numbers of rows; the rest is the test split.

    min_test raises the share of the test split; the other two shrink in proportion to their given values.
    """
    n = df.count()
    test = 1 - train - val
    if min_test and n and test * n < min_test:
        new = min(min_test / n, 1.0)
        train, val = (x * (1 - new) / (1 - test) for x in (train, val))
    a = int(n * train + 1e-9)
    b = a + int(n * val + 1e-9)
    out = hash_positions(df, F.col(key), seed)
    return out.withColumn("split", F.when(F.col("pos") <= a, "train").when(F.col("pos") <= b, "val").otherwise("test")).drop("pos")


def shards(df: DataFrame, key: str, size: int, bucket: int = 10_000) -> DataFrame:
    """df (with `split`) with shard_id, image_id from 0, and the image's name, each by split in the order of a number key."""
    out = positions(df, [(F.floor(F.col(key) / bucket), True)], [F.col(key)], ["split"])
    i = F.col("pos") - 1
    return out.withColumn("shard_id", F.floor(i / size).cast("int")).withColumn("image_id", i).withColumn("image", F.format_string("%s_image_%06d.jpg", "split", i)).drop("pos")


def leaks(df: DataFrame, key: str, name: str) -> DataFrame:
    """Keys with more than one row; `leaks` where they lie in more than one split."""
    per = df.groupBy(F.col(key).alias(name), "split").agg(F.count("*").alias("c"))
    g = per.groupBy(name).agg(F.sum("c").alias("n_rows"), F.count("*").alias("n_splits")).filter("n_rows > 1")
    return g.withColumn("as_coded", F.lit(True)).withColumn("leaks", F.col("n_splits") > 1)


def text_overlap(df: DataFrame, text: str) -> DataFrame:
    """(split_1, split_2, shared): different texts that two splits share; empty ones do not count."""
    t = df.filter(F.col(text) != "").select(F.md5(text).alias("h"), "split").distinct()
    s = t.groupBy("h").agg(F.array_sort(F.collect_set("split")).alias("s")).filter(F.size("s") > 1)
    one = s.select(F.posexplode("s").alias("i", "split_1"), "s")
    two = one.select("split_1", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("split_2"))
    return two.groupBy("split_1", "split_2").agg(F.count("*").alias("shared"))


def overlap(df: DataFrame, key: str) -> DataFrame:
    """(ids, in_two): distinct keys, and those in more than one split."""
    k = df.select(key, "split").distinct().groupBy(key).agg(F.count("*").alias("k"))
    return k.agg(F.count("*").alias("ids"), F.count_if(F.col("k") > 1).alias("in_two"))


def repeated(df: DataFrame, text: str, key: str, places: int) -> DataFrame:
    """(h, split, n, places) of texts that a split holds more than once, with their first keys. The window keeps but that many of a text."""
    rows = df.select(F.md5(text).alias("h"), "split", key)
    n = rows.groupBy("h", "split").agg(F.count("*").alias("n")).filter("n > 1")
    first = rows.withColumn("__r", F.row_number().over(Window.partitionBy("h", "split").orderBy(key))).filter(F.col("__r") <= places)
    lists = first.groupBy("h", "split").agg(F.array_sort(F.collect_list(key)).alias("places"))
    return n.join(lists, ["h", "split"])
