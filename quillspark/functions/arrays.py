"""Functions of token and label arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def padded(seq: Column, length: int, side: str = "post", value: int = 0) -> Column:
    """seq cut or filled to length; 'pre' fills at the front and keeps the last ids. An empty one is all fill."""
    fill = F.array_repeat(F.lit(value), length)
    if side == "post":
        return F.slice(F.concat(seq, fill), 1, length)
    return F.slice(F.concat(fill, seq), -length, length)


def unpadded(seq: Column) -> Column:
    return F.filter(seq, lambda x: x != 0)


def known_labels(df: DataFrame, column: str, most: int = 10_000) -> list[str]:
    """The distinct labels of an array column, in order; an error above `most`, as each is a place of a vector."""
    found = [r[0] for r in df.select(F.explode(column).alias("x")).distinct().orderBy("x").limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} labels")
    return found


def multi_hot(labels: Column, known: list[str]) -> Column:
    return F.array(*(F.array_contains(labels, x).cast("float") for x in known))


def unit(v: Column) -> Column:
    """v over its Euclidean norm; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(F.arrays_zip(v.alias("x"), F.array_repeat(norm, F.size(v)).alias("n")), lambda p: F.when(p["n"] == 0, p["x"].cast("double")).otherwise(p["x"] / p["n"]))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
