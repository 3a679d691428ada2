"""Cross-modal ranking of given embeddings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.arrays import dot

__all__ = ["batches", "contrastive_loss", "dot", "match_ranks", "nearest", "normalised", "sides"]


def normalised(df: DataFrame, column: str) -> DataFrame:
    """column over its Euclidean norm; zero vectors stay. The norm is a column of its own, so that it is made once a row."""
    rows = df.withColumn(column, F.col(column).cast("array<double>"))
    rows = rows.withColumn("__n", F.sqrt(F.aggregate(column, F.lit(0.0), lambda s, x: s + x * x)))
    parts = F.arrays_zip(F.col(column).alias("x"), F.array_repeat(F.when(F.col("__n") == 0, 1.0).otherwise(F.col("__n")), F.size(column)).alias("n"))
    return rows.withColumn(column, F.transform(parts, lambda p: p["x"] / p["n"])).drop("__n")


def sides(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(i, v) and (j, w): every row's vector, and as its match that of the next id."""
    u = normalised(embeddings.filter("vec_id is not null"), "embedding")
    return u.select(F.col("vec_id").alias("i"), F.col("embedding").alias("v")), u.select((F.col("vec_id") - 1).alias("j"), F.col("embedding").alias("w"))


def batches(embeddings: DataFrame, size: int) -> DataFrame:
    """(batch, i, j, sim) of all pairs within each batch of `size` ids: what training steps see, one after the other."""
    left, right = sides(embeddings)
    a, b = left.withColumn("batch", F.floor(F.col("i") / size)), right.withColumn("batch", F.floor(F.col("j") / size)).filter("j >= 0")
    return a.join(b, "batch").select("batch", "i", "j", dot(F.col("v"), F.col("w")).alias("sim"))


#: Blocks a side at least, where there are rows enough for them, and rows of a block that a task holds at most.
GRID, BLOCK = 8, 1 << 16
#: Rows and columns of the products that are looked at at once.
ROWS, COLUMNS = 1024, 4096
#: Two sums that are as near as this may be equal to nine digits.
NEAR = 0.6e-9


def _dealt(df: DataFrame, key: str, least: int, block: int) -> tuple[DataFrame, int]:
    """df with the number of each row's block. Up to GRID * block rows their number is fixed, so what is sent grows with the rows alone."""
    rows = df.count()
    n = max(min(GRID, -(-rows // least)), -(-rows // block), 1)
    return df.withColumn(f"b{key}", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")), n


def _meet(left: DataFrame, right: DataFrame, block: int, work, schema: str) -> DataFrame:
    """work(left's frame, right's frame) for every pair of blocks: a task holds one block of each side."""
    left, n = _dealt(left, "i", COLUMNS, block)
    right, m = _dealt(right, "j", COLUMNS, block)
    each = lambda df, c, k: df.withColumn(c, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))

    def run(key, x, y):
        return work(x.sort_values("i"), y.sort_values("j")) if len(x) and len(y) else pd.DataFrame({f.split()[0]: [] for f in schema.split(", ")})

    return each(left, "bj", m).groupBy("bi", "bj").cogroup(each(right, "bi", n).groupBy("bi", "bj")).applyInPandas(run, schema)


def _best(v: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of v, row of w, product): the k largest products of each row of v to nine digits, ties to the first rows of w.

    Once a row has k of them, only larger ones are looked at: a later tie has no place.
    """
    floor = np.full(len(v), -np.inf)
    row, col, sim = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    at = 0
    while at < len(w):
        s = v @ w[at : at + (COLUMNS if at else max(COLUMNS // 8, k))].T
        if not at and s.shape[1] > k:
            r, c = np.nonzero(s >= np.partition(s, -k, axis=1)[:, -k][:, None] - 2 * NEAR)
        else:
            r, c = np.nonzero(s > (floor + (0.5e-9 - 1e-12))[:, None])
        x = np.round(s[r, c], 9)
        new = x > floor[r]
        row, col, sim = np.concatenate([row, r[new]]), np.concatenate([col, c[new] + at]), np.concatenate([sim, x[new]])
        at += s.shape[1]
        if new.any():
            order = np.lexsort((col, -sim, row))
            row, col, sim = row[order], col[order], sim[order]
            first = np.searchsorted(row, np.arange(len(v)))
            keep = np.arange(len(row)) - first[row] < k
            row, col, sim = row[keep], col[keep], sim[keep]
            n = np.bincount(row, minlength=len(v))
            full = n >= k
            floor[full] = sim[np.cumsum(n)[full] - 1]
    return row, col, sim


def nearest(left: DataFrame, right: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(i, rank, j, sim): the k best matches of every row among all, by blocks; sums equal to nine digits are ties, which go to the smaller id."""

    def work(x, y):
        i, j, w = x["i"].to_numpy(), y["j"].to_numpy(), np.stack(y["w"].to_numpy())
        parts = []
        for a in range(0, len(i), ROWS):
            row, col, sim = _best(np.stack(x["v"].to_numpy()[a : a + ROWS]), w, k)
            parts.append(pd.DataFrame({"i": i[a + row], "j": j[col], "sim": sim}))
        return pd.concat(parts)

    hits = _meet(left, right, block, work, "i long, j long, sim double")
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("sim"), "j"))).filter(F.col("rank") <= k).select("i", "rank", "j", "sim")


def _better(s: np.ndarray, m: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many products of each row are better than its own, m, to nine digits; ties go to the smaller j. Only rows with near ones are rounded."""
    n = (s > (m + NEAR)[:, None]).sum(1)
    near = np.flatnonzero((s >= (m - NEAR)[:, None]).sum(1) != n)
    r, own = np.round(s[near], 9), m[near][:, None]
    n[near] = ((r > own) | ((r == own) & (j[None] < i[near][:, None]))).sum(1)
    return n


def match_ranks(left: DataFrame, right: DataFrame, block: int = BLOCK) -> DataFrame:
    """(i, rank, back): the place of each row's own match among all, both ways. Only better ones are counted; no matrix is kept."""
    own = left.join(right, left["i"] == right["j"]).select("i", dot(F.col("v"), F.col("w")).alias("m"))
    a = left.join(own.select("i", F.round("m", 9).alias("m")), "i")
    b = right.join(own.select(F.col("i").alias("j"), F.round("m", 9).alias("m")), "j")

    def work(x, y):
        i, j, mi, mj = x["i"].to_numpy(), y["j"].to_numpy(), x["m"].to_numpy(), y["m"].to_numpy()
        w = np.stack(y["w"].to_numpy())
        for_i, for_j = np.zeros(len(i), np.int64), np.zeros(len(j), np.int64)
        for r in range(0, len(i), ROWS):
            v, p = np.stack(x["v"].to_numpy()[r : r + ROWS]), slice(r, r + ROWS)
            for c in range(0, len(j), COLUMNS):
                q = slice(c, c + COLUMNS)
                s = v @ w[q].T
                for_i[p] += _better(s, mi[p], i[p], j[q])
                for_j[q] += _better(s.T, mj[q], j[q], i[p])
        return pd.DataFrame({"id": np.concatenate([i, j]), "better": np.concatenate([for_i, for_j]), "way": np.repeat([0, 1], [len(i), len(j)])})

    counted = _meet(a, b, block, work, "id long, better long, way int").groupBy(F.col("id").alias("i"), "way").agg(F.sum("better").alias("n"))
    place = lambda k: (F.max(F.when(F.col("way") == k, F.col("n"))) + 1).alias("rank" if k == 0 else "back")
    return counted.groupBy("i").agg(place(0), place(1))


def contrastive_loss(sim: DataFrame, temperature: float) -> DataFrame:
    """(batch, loss): the symmetric loss of each batch: mean of -log softmax of the matches, by row and by column."""
    z = sim.withColumn("z", F.col("sim") / temperature)
    row, col = Window.partitionBy("batch", "i"), Window.partitionBy("batch", "j")
    z = z.withColumn("mi", F.max("z").over(row)).withColumn("mj", F.max("z").over(col))
    z = z.withColumn("li", F.col("mi") + F.log(F.sum(F.exp(F.col("z") - F.col("mi"))).over(row))).withColumn("lj", F.col("mj") + F.log(F.sum(F.exp(F.col("z") - F.col("mj"))).over(col)))
    return z.filter("i = j").groupBy("batch").agg(F.round((F.avg(F.col("li") - F.col("z")) + F.avg(F.col("lj") - F.col("z"))) / 2, 5).alias("loss"))
