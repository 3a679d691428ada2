"""Whitening of embeddings by hierarchical SVD merging, without a covariance matrix made of uncentred products.

Entries become integers, so counts and sums are exact. Each partition of the fit list centres its vectors, block by
block, and keeps all singular values and right vectors beside its exact sums; two such summaries are merged by stacking
their scaled vectors over one more row, the difference of their means times sqrt(n1 * n2 / (n1 + n2)), and taking the
SVD again. No dimension is dropped on the way, so the result is that of one SVD of all centred vectors. Summaries meet
in a tree of groups on the executors, and the driver gets one of them, of d by d numbers.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import remove, scratch, written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Rows that are decomposed at once, and summaries that meet in one task.
BLOCK, FAN = 8192, 16
#: Scaled entries of this size or more are beyond what a long number is made of, and their rows are dropped like non-finite ones.
HUGE = float(1 << 62)
#: A component whose singular value is below this share of the largest, for each dimension, has no variance.
NOTHING = 1e-14
#: Below this, int64 arithmetic is exact.
SAFE = 1 << 62


@dataclass
class Summary:
    """Of some rows: how many, their exact sums by dimension, and singular values and right vectors of the centred rows."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    def merge(self, other: Summary) -> Summary:
        """That of both sets of rows; nothing is cut off."""
        n = self.n + other.n
        # the means' difference from exact numbers, however far from zero both lie
        gap = np.array([(a * other.n - b * self.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums)])
        stacked = np.vstack([self.values[:, None] * self.vectors, other.values[:, None] * other.vectors, sqrt(self.n * other.n / n) * gap])
        return Summary(n, [a + b for a, b in zip(self.sums, other.sums)], *_svd(stacked))

    def packed(self) -> dict:
        return {"n": str(self.n), "sums": [str(x) for x in self.sums], "values": self.values.tolist(), "vectors": np.ascontiguousarray(self.vectors).tobytes()}

    @classmethod
    def unpacked(cls, n: str, sums: list[str], values: list[float], vectors: bytes) -> Summary:
        return cls(int(n), [int(x) for x in sums], np.asarray(values, float), np.frombuffer(vectors).reshape(len(values), -1))


SUMMARY = "node long, n string, sums array<string>, values array<double>, vectors binary"


def _svd(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    return s, v


def summarize(x: np.ndarray) -> Summary:
    """Of a block of integer rows. Differences to the first row are taken before anything becomes a float."""
    big = int(np.abs(x).max()) * 2 * len(x) >= SAFE
    d = x.astype(object) - x[0].astype(object) if big else x - x[0]
    total = d.sum(0)
    y = d.astype(float) - np.array([int(t) / len(x) for t in total])
    return Summary(len(x), [int(a) * len(x) + int(t) for a, t in zip(x[0], total)], *_svd(y))


def matrix(col: pa.Array, d: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def scaled(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, x): the rows that take part, with entries floor(64 * c) + 1000000.

    Vectors that are null, empty, or with null, non-finite or huge entries (see HUGE) are dropped, and so are those of
    another length than the most frequent one (the longer one of equally frequent ones), for they have no place in one space.
    """
    v = F.col("vec")
    entry = lambda c: c.cast("double") * SCALE
    good = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec")).filter(
        v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(entry(c)) < HUGE))
    )
    common = good.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    x = F.transform("vec", lambda c: F.floor(entry(c)) + F.lit(SHIFT).cast("long"))
    return good.filter(F.size("vec") == (common["d"] if common else 0)).select("vec_id", x.alias("x"))


def fit(distinct: DataFrame, d: int, folder: str) -> Summary | None:
    """The summary of all rows of (x): of partitions, then of groups of summaries until one is left."""

    def leaves(batches):
        found, held, size = None, [], 0

        def add():
            new = summarize(np.concatenate(held))
            return new if found is None else found.merge(new)

        for batch in batches:
            x = matrix(batch.column(0), d)
            for a in range(0, len(x), BLOCK):
                held.append(x[a : a + BLOCK])
                size += len(held[-1])
                if size >= BLOCK:
                    found, held, size = add(), [], 0
        if held:
            found = add()
        if found is not None:
            yield pa.RecordBatch.from_pylist([found.packed() | {"node": TaskContext.get().partitionId()}], pa.schema([("node", pa.int64()), ("n", pa.string()), ("sums", pa.list_(pa.string())), ("values", pa.list_(pa.float64())), ("vectors", pa.binary())]))

    def merged(f: pd.DataFrame) -> pd.DataFrame:
        found = None
        for r in f.sort_values("node").itertuples(index=False):
            new = Summary.unpacked(r.n, r.sums, r.values, r.vectors)
            found = new if found is None else found.merge(new)
        return pd.DataFrame([{"node": int(f["node"].min()) // FAN} | found.packed()])

    level = written(distinct.select("x").mapInArrow(leaves, SUMMARY), folder, "leaves")
    rows, last = level.count(), level.agg(F.max("node")).first()[0]
    while rows > 1:
        level = level.groupBy(F.floor(F.col("node") / FAN).alias("group")).applyInPandas(merged, SUMMARY)
        last //= FAN
        rows = last + 1  # at most
    found = level.first()
    return Summary.unpacked(*found[1:]) if found else None


@dataclass
class Whitener:
    n: int
    sums: list[int]
    vectors: np.ndarray  # components by dimensions
    variances: np.ndarray
    trace: float

    @classmethod
    def of(cls, s: Summary, most: int) -> Whitener:
        d = len(s.sums)
        some = s.values > s.values.max(initial=0) * d * NOTHING
        e = s.values**2 / s.n
        return cls(s.n, s.sums, s.vectors[some][:most], e[some][:most], float(e.sum()))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: of int64 numbers, or of Python's where these would not hold them."""
        most = max(int(np.abs(x).max(initial=0)) * self.n, max(map(abs, self.sums), default=0))
        if most < SAFE:
            return x * np.int64(self.n) - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def deviation(self, y: np.ndarray) -> list[int | None]:
        """Sums of squares, exactly; null where a long number cannot hold it."""
        most = int(max(y.max(initial=0), -y.min(initial=0)))
        if most * most * y.shape[1] < SAFE:
            return (y * y).sum(1).tolist()
        return [t if t < 1 << 63 else None for t in (sum(int(v) ** 2 for v in row) for row in y)]

    def whitened(self, y: np.ndarray) -> np.ndarray:
        return (y.astype(float) / self.n) @ self.vectors.T / np.sqrt(self.variances)


def identity_error(distinct: DataFrame, w: Whitener, d: int) -> float:
    """Largest absolute entry of (covariance of the whitened fit list - identity), measured over all its rows."""
    k = len(w.variances)

    def sums(batches):
        total = np.zeros((k + 1, k))
        for batch in batches:
            x = matrix(batch.column(0), d)
            for a in range(0, len(x), BLOCK):
                z = w.whitened(w.centred(x[a : a + BLOCK]))
                total += np.vstack([z.T @ z, z.sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["place", "total"])

    rows = distinct.select("x").mapInArrow(sums, "place long, total double").groupBy("place").agg(F.sum("total").alias("total")).collect()  # (k + 1) * k numbers
    total = np.zeros((k + 1) * k)
    for place, x in rows:
        total[place] = x
    total = total.reshape(k + 1, k) / w.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each vector and component.

    See `scaled` for the vectors that take part. Equal x-vectors count once in the fit. Repeated rows and null ids come
    as often as they are. Components without variance are left out, so there are fewer than asked for where the fit
    list spans fewer dimensions, and none (no row) where it has one vector or none. Other columns are not read.
    """
    spark = vectors.sparkSession
    folder = scratch(spark)
    rows = scaled(vectors, id_col, vec_col)
    distinct = written(rows.select("x").distinct(), folder, "distinct")
    first = distinct.first()
    d = len(first["x"]) if first else 0
    found = fit(distinct, d, folder) if d else None
    w = Whitener.of(found, components) if found else None
    if w is None or not len(w.variances):
        remove(spark, folder)
        return spark.createDataFrame([], SCHEMA)
    error, k = identity_error(distinct, w, d), len(w.variances)
    remove(spark, folder)
    explained = w.variances / w.trace

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                y = w.centred(matrix(part.column(1), d))
                m = len(y)
                arrays = [
                    pa.array(np.repeat(np.arange(m), k)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, w.n)),
                    pa.array(w.deviation(y), pa.int64()), pa.array(w.whitened(y).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ]
                arrays[3] = arrays[3].take(arrays[0])
                arrays[0] = part.column(0).take(arrays[0])
                yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, SCHEMA)
