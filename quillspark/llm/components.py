"""Connected components of a graph given by its edges, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import join_counted, written

#: Edges that are made stars of in place at a time, at most but for one batch.
CHUNK = 200_000


def _linked(f: pd.DataFrame) -> pd.DataFrame:
    """The same vertices linked by fewer edges: each with the least one that it is linked with."""
    ids, at = np.unique(np.concatenate([f["a"].to_numpy(), f["b"].to_numpy()]), return_inverse=True)
    a, b = at[: len(f)], at[len(f) :]
    up = np.arange(len(ids))
    while (up[a] != up[b]).any():
        low = np.minimum(up[a], up[b])
        for x in (up[a], up[b]):
            np.minimum.at(up, x, low)
        while (up[up] != up).any():
            up = up[up]
    rest = np.flatnonzero(up != np.arange(len(ids)))
    return pd.DataFrame({"a": ids[up[rest]], "b": ids[rest]})


def _chunks(frames):
    """Edges that lie together made stars of, so that few rounds are left and chains are short."""
    held, n = [], 0
    for f in frames:
        held.append(f)
        n += len(f)
        if n >= CHUNK:
            yield _linked(pd.concat(held))
            held, n = [], 0
    if n:
        yield _linked(pd.concat(held))


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """(v, c): for each end v of the edges (a, b), the least vertex c that it is linked with.

    Edges stay in tables of the shared folder; of a round the driver sees whether it was the last, and the sizes of
    joins. Minima are pre-aggregated, so a vertex of many edges is no burden; the number of rounds follows the logarithm
    of the longest chain. A task makes stars of the edges that it has, which leaves few rounds: each is half a dozen
    queries, whose plans and generated code the driver has to hold.
    """
    near = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b")
    now = written(near.mapInPandas(_chunks, "a long, b long").distinct(), folder, f"{name}0")
    k = 0
    while True:
        k += 1
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), folder, f"{name}least{k}")
        # only stars are left if each vertex with a smaller neighbour has no other one
        if least.filter("m < u and n > 1").isEmpty():
            break
        large = written(join_counted(both, least, ["u"], "n").filter("v > u and v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct(), folder, f"{name}large{k}")
        low = written(large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"), F.count("*").alias("n")), folder, f"{name}low{k}")
        small = join_counted(large.withColumnRenamed("b", "u"), low, ["u"], "n").select(F.col("m").alias("a"), F.explode(F.array("a", "u")).alias("b")).filter("a <> b")
        now = written(small.mapInPandas(_chunks, "a long, b long").distinct(), folder, f"{name}{k}")
    return least.select(F.col("u").alias("v"), F.col("m").alias("c"))
