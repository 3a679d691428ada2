"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.splits import shards


def write_shards(df: DataFrame, key: str, size: int, path: str, per_file: int = 256) -> None:
    """df (with `split`) as Parquet in folders by split; `shard_id` numbers runs of `size` rows in the order of key.

    A file holds up to per_file whole shards, sorted, so that a filter on shard_id reads a file or two; the number of
    files follows the rows, not the number of shards.
    """
    numbered = shards(df, key, size).withColumnRenamed("image_id", "pos")
    dealt = numbered.repartition("split", F.floor(F.col("shard_id") / per_file))
    dealt.sortWithinPartitions("split", "shard_id", "pos").write.partitionBy("split").mode("overwrite").parquet(path)


def write_metadata(df: DataFrame, path: str, **facts) -> DataFrame:
    """One row of facts about a written table (rows, columns, and what is given), as JSON; returns it."""
    one = df.agg(F.count("*").alias("rows")).withColumn("columns", F.array(*map(F.lit, df.columns)))
    for k, v in facts.items():
        one = one.withColumn(k, F.lit(v))
    write_json(one, path)
    return one


def write_export(df: DataFrame, key: str, columns: list[str], path: str) -> None:
    """df (with `split`) as JSON, a folder for each split, with image_id from 0 and image names of six digits."""
    shards(df, key, 1).select("split", "image_id", "image", *columns).write.partitionBy("split").mode("overwrite").json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, lists: list[str] = ()) -> None:
    """Array columns named in lists become text joined by semicolons."""
    for c in lists:
        df = df.withColumn(c, F.array_join(c, ";"))
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_vocabulary(vocab: DataFrame, folder: str, lines: int = 1000) -> None:
    """A vocabulary (token, id, freq) in all its forms: a table, JSON objects of words to ids and of ids to words (of so
    many entries a line, so no task holds all of it), lines 'id: word', and its statistics. readers.vocabulary reads them back."""
    folder = folder.rstrip("/")
    vocab.write.mode("overwrite").parquet(f"{folder}/vocabulary.parquet")
    vocab = vocab.sparkSession.read.schema(vocab.schema).parquet(f"{folder}/vocabulary.parquet")  # made once
    part = F.floor(F.col("id") / lines)
    objects = lambda k, v: vocab.groupBy(part).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(k, v)))).alias("value")).select("value")
    objects(F.col("token"), F.col("id")).write.mode("overwrite").text(f"{folder}/word_index.json")
    objects(F.col("id").cast("string"), F.col("token")).write.mode("overwrite").text(f"{folder}/index_word.json")
    vocab.select(F.format_string("%4d: %s", "id", "token").alias("value")).write.mode("overwrite").text(f"{folder}/vocabulary.txt")
    write_json(vocab.agg(F.count("*").alias("vocab_size"), F.sum("freq").alias("total_tokens"), F.max("id").alias("last_id")), f"{folder}/statistics.json")


def progress(expected: DataFrame, done: DataFrame, key: str, by: str) -> DataFrame:
    """(by, expected, done, pct, status) of a job whose rows are to be found in `done`."""
    j = expected.select(key, by).join(done.select(key).distinct().withColumn("__done", F.lit(1)), key, "left")
    g = j.groupBy(by).agg(F.count("*").alias("expected"), F.count("__done").alias("done"))
    pct = F.round(100 * F.col("done") / F.col("expected"), 4)
    return g.withColumn("pct", pct).withColumn("status", F.when(F.col("done") == F.col("expected"), "complete").when(F.col("done") > 0, "running").otherwise("waiting"))


def copy_manifest(files: DataFrame, folder: str) -> DataFrame:
    """(source, target) of a copy of files into folder, flat; copying itself is left to the store's own tool."""
    return files.select(F.col("path").alias("source"), F.concat(F.lit(folder.rstrip("/") + "/"), F.element_at(F.split("path", "/"), -1)).alias("target"))
