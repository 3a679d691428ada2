"""What several operators share: shared scratch tables, Arrow mapping, words."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.tables import shared

#: A word: a run without space, tab, line feed, vertical tab, form feed, carriage return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Memory:
    """What a Python worker has worked out for short strings: the most recent ones, within a number of bytes.

    A worker lives on from stage to stage, so only the memory that was used last is kept: that of another operator, or
    of another model, is let go when a batch begins.
    """

    used: Memory | None = None
    #: Bytes of an entry besides its characters (two objects and a place in the table).
    ENTRY = 230

    def __init__(self, most: int = 48 << 20, longest: int = 64):
        self.half, self.longest = most // 2, longest
        self.clear()

    def clear(self) -> None:
        self.known, self.old, self.size = {}, {}, 0
        self.long: list[str] = []

    def begin(self, keys) -> list[str]:
        """Starts a batch: those of its distinct keys that are to be put; after that `known` has them all, until the next batch."""
        if Memory.used is not self:
            if Memory.used is not None:
                Memory.used.clear()
            Memory.used = self
        for x in self.long:
            del self.known[x]
        self.long = []
        if self.size > self.half:
            self.known, self.old, self.size = {}, self.known, 0
        known, old, need = self.known, self.old, []
        for x in keys:
            if x not in known:
                if x in old:
                    self.put(x, old[x])
                else:
                    need.append(x)
        return need

    def put(self, key: str, value) -> None:
        self.known[key] = value
        if len(key) > self.longest:
            self.long.append(key)
        else:
            self.size += len(key) + self.ENTRY


#: A key with more than one row in so many is joined by a broadcast: there are at most as many such keys.
PARTS = 2000


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share."""
    return f"{shared(spark)}/quillspark-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, outlives executors."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folder: str, *kept: str) -> None:
    """Deletes a scratch folder, or all its tables but those kept, through Spark's own file system layer."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not kept:
        files.delete(path, True)
        return
    for x in files.listStatus(path):
        if x.getPath().getName() not in kept:
            files.delete(x.getPath(), True)


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], n: str) -> DataFrame:
    """left inner-joined with right, which has one row a key and in column n how many rows of left have it (n goes).

    No task gets a frequent key's rows: such keys, at most PARTS in number, are broadcast, the others go through a
    shuffle. Both sides are read twice, so they should be tables.
    """
    total, most = right.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.max(n), F.lit(0))).first()
    if most * PARTS <= total or total < PARTS:
        return left.join(right.drop(n), keys)
    hot = F.broadcast(right.filter(F.col(n) * PARTS > total).drop(n))
    few = left.join(hot.select(*keys), keys, "left_anti").join(right.filter(F.col(n) * PARTS <= total).drop(n), keys)
    return left.join(hot, keys).unionByName(few)


def map_texts(df: DataFrame, function: Callable[[list[str]], dict[str, list]], schema: str, arrow: pa.Schema, keep: list[str], text: str = "text") -> DataFrame:
    """One output row per input row: the columns of keep, then what function makes of the batch's texts (null: empty).

    Rows go through Arrow in batches; a batch is cut by bytes so that long texts do not pile up in the worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("__text"))
            for a, b in cuts(texts):
                made = function([x or "" for x in texts.slice(a, b - a).to_pylist()])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *(pa.array(made[f.name], f.type) for f in arrow)], names=[*keep, *arrow.names])

    picked = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").cast("string").alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[: len(keep)])
    return picked.mapInArrow(run, f"{kept}, {schema}" if keep else schema)


def cuts(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes of text; a longer text has a range of its own."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    a = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)
