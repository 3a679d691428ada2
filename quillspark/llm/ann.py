"""Maximum inner product search: score-aware (anisotropic) product quantization, four-bit table scans, exact reranking.

Equal vectors are one entry with their smallest ids, so a crowd of copies takes one place among the candidates. Entries
fall into leaves around trained centroids; the rest of each is coded in subspaces of two components with 16 centres
(four bits) each. Codes and centres minimise |r|^2 + (eta - 1) * (r . x/|x|)^2, which charges an error along the vector
more than one across it. A query probes the leaves whose centroids give the largest product. A leaf is cut into blocks
of entries and its queries into blocks too, so a task never holds more than a block of each; the candidates of all
blocks are ranked by their quantized score, and the best of them by the exact one.

How many leaves are probed and how many candidates are reranked is measured on the table itself: for a bounded number of
its queries the true neighbours are found by brute force over all entries, and where they stand among the leaves and
among all quantized scores says what a recall of `RECALL` asks for. So both numbers grow with the table where they must.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.common import join_counted, remove, scratch, written

K, EVERY = 20, 20
#: Entries on which centroids and centres are trained at most; every entry is indexed.
SAMPLE = 20_000
SUB, CENTRES, PASSES = 2, 16, 4
THRESHOLD = 0.2  # T of the score-aware loss
#: Entries and queries that meet in one task at most; entries a leaf aims at.
BLOCK, QUERIES, LEAF = 65_536, 512, 32_768
#: Queries on which probing and reranking are measured, and the share of their true neighbours that each of the two keeps.
MEASURED, RECALL = 64, 0.985


@dataclass
class Codec:
    centroids: np.ndarray  # leaves x d
    centres: np.ndarray  # d / SUB x CENTRES x SUB
    eta: float

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.centroids.T - 0.5 * (self.centroids**2).sum(1)).argmax(1)

    def encode(self, x: np.ndarray, leaf: np.ndarray, passes: int = 2) -> np.ndarray:
        """Codes by coordinate descent over the subspaces; the shares of one vector's loss meet in its parallel error."""
        n, m = len(x), len(self.centres)
        r = (x - self.centroids[leaf]).reshape(n, m, SUB)
        unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).reshape(n, m, SUB)
        codes = np.empty((n, m), np.uint8)
        along = np.empty((n, m))
        for j in range(m):
            codes[:, j] = ((r[:, j, None] - self.centres[j]) ** 2).sum(2).argmin(1)
            along[:, j] = ((r[:, j] - self.centres[j][codes[:, j]]) * unit[:, j]).sum(1)
        total = along.sum(1)
        for _ in range(passes):
            for j in range(m):
                gap = r[:, j, None] - self.centres[j]
                part = (gap * unit[:, j, None]).sum(2)
                rest = total - along[:, j]
                codes[:, j] = ((gap**2).sum(2) + (self.eta - 1) * (rest[:, None] + part) ** 2).argmin(1)
                along[:, j] = part[np.arange(n), codes[:, j]]
                total = rest + along[:, j]
        return codes

    def scan(self, q: np.ndarray, leaf: int, codes: np.ndarray) -> np.ndarray:
        """Quantized products of queries with the coded entries of one leaf: a table for each query, added up by codes."""
        m = len(self.centres)
        tables = np.einsum("qms,mcs->mcq", q.reshape(len(q), m, SUB), self.centres).astype(np.float32)
        out = np.repeat((q @ self.centroids[leaf]).astype(np.float32)[None], len(codes), 0)
        for j in range(m):
            out += tables[j][codes[:, j]]
        return out.T


def train(x: np.ndarray, leaves: int, seed: int = 0) -> Codec:
    r = np.random.default_rng(seed)
    x = x.astype(np.float64)
    n, d = x.shape
    m = d // SUB
    cent = x[r.choice(n, min(leaves, n), replace=False)].copy()
    for _ in range(8):
        leaf = (x @ cent.T - 0.5 * (cent**2).sum(1)).argmax(1)
        size = np.bincount(leaf, minlength=len(cent))
        sums = np.zeros_like(cent)
        np.add.at(sums, leaf, x)
        cent[size > 0] = sums[size > 0] / size[size > 0, None]
    eta = max(1.0, (d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    leaf = (x @ cent.T - 0.5 * (cent**2).sum(1)).argmax(1)
    rest = (x - cent[leaf]).reshape(n, m, SUB)
    pick = r.choice(n, CENTRES, replace=n < CENTRES)
    codec = Codec(cent, np.ascontiguousarray(rest[pick].transpose(1, 0, 2)), eta)
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).reshape(n, m, SUB)
    for _ in range(PASSES):
        codes = codec.encode(x, leaf, 1)
        gap = rest - codec.centres[np.arange(m), codes]
        total = (gap * unit).sum((1, 2))
        for j in range(m):
            u = unit[:, j]
            other = total - (gap[:, j] * u).sum(1)
            a = np.zeros((CENTRES, SUB, SUB))
            b = np.zeros((CENTRES, SUB))
            np.add.at(a, codes[:, j], np.eye(SUB) + (eta - 1) * u[:, :, None] * u[:, None, :])
            np.add.at(b, codes[:, j], rest[:, j] + (eta - 1) * u * (other + (rest[:, j] * u).sum(1))[:, None])
            used = np.bincount(codes[:, j], minlength=CENTRES) > 0
            codec.centres[j][used] = np.linalg.solve(a[used], b[used][:, :, None])[:, :, 0]
            new = rest[:, j] - codec.centres[j][codes[:, j]]
            total = other + (new * u).sum(1)
            gap[:, j] = new
    return codec


def _pack(codes: np.ndarray) -> list[bytes]:
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return [row.tobytes() for row in codes[:, ::2] | codes[:, 1::2] << 4]


def _unpack(rows: list[bytes], m: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
    return np.stack([raw & 15, raw >> 4], 2).reshape(len(rows), -1)[:, :m]


def product(a: Column, b: Column) -> Column:
    """Inner product in double precision, added up in the order of the components; what one of them lacks counts as zero."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)


def _ones(f: pd.DataFrame, d: int, padded: int, column: str = "vec") -> np.ndarray:
    """The vectors of a frame as rows, shorter ones filled with zeros."""
    x = np.zeros((len(f), padded))
    for i, v in enumerate(f[column]):
        x[i, : min(len(v), d)] = v[:d]
    return x


def measure(entries: DataFrame, asked: DataFrame, shared, d: int, padded: int, k: int, leaves: int) -> tuple[int, int]:
    """(leaves to probe, candidates to rerank) that keep a share RECALL of the true k neighbours of some queries each."""
    some = asked.orderBy(F.xxhash64("qid")).limit(MEASURED).toPandas()
    q = _ones(some, d, padded)

    def frames_of(frames):
        """(entries' vectors, exact and quantized products, leaves) of each batch."""
        c = shared.value
        for f in frames:
            for a in range(0, len(f), 4096):
                part = f.iloc[a : a + 4096]
                x = _ones(part, d, padded)
                leaf = c.leaf_of(x)
                codes = c.encode(x, leaf)
                near = np.empty((len(q), len(x)), np.float32)
                for one in np.unique(leaf):
                    at = leaf == one
                    near[:, at] = c.scan(q, int(one), codes[at])
                yield x, near, leaf

    def best(frames):
        for x, near, leaf in frames_of(frames):
            exact = q @ x.T
            for i in range(len(q)):
                at = np.flatnonzero(x[:, 0] == q[i, 0])
                exact[i, at[(x[at] == q[i]).all(1)]] = -np.inf  # the query itself
            keep = min(k, len(x))
            top = np.argpartition(-exact, keep - 1, axis=1)[:, :keep]
            yield pd.DataFrame({"i": np.repeat(np.arange(len(q)), keep).astype(np.int32), "score": np.take_along_axis(exact, top, 1).ravel(), "approx": np.take_along_axis(near, top, 1).ravel(), "leaf": leaf[top].ravel().astype(np.int32)})

    found = entries.select("vec").mapInPandas(best, "i int, score double, approx float, leaf int")
    first = found.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("score")))).filter(F.col("r") <= k).toPandas()
    first = first[np.isfinite(first["score"])].sort_values(["i", "r"])
    if not len(first):
        return leaves, 4 * k
    bounds = [np.sort(first["approx"][first["i"] == i].to_numpy()) for i in range(len(q))]

    def above(frames):
        total = [np.zeros(len(x), np.int64) for x in bounds]
        for _, near, _ in frames_of(frames):
            for i, x in enumerate(bounds):
                total[i] += len(near[i]) - np.searchsorted(np.sort(near[i]), x, "left")
        yield pd.DataFrame({"i": np.repeat(np.arange(len(q)), [len(x) for x in bounds]).astype(np.int32), "j": np.concatenate([np.arange(len(x)) for x in bounds]).astype(np.int32), "n": np.concatenate(total)})

    places = entries.select("vec").mapInPandas(above, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).toPandas()["n"].to_numpy()
    c = shared.value
    order = np.argsort(np.argsort(-(q @ c.centroids.T), axis=1), axis=1)
    far = order[first["i"].to_numpy(), first["leaf"].to_numpy()] + 1
    need = lambda x: int(np.ceil(np.quantile(x, RECALL, method="higher")))
    return min(leaves, need(far)), max(4 * k, 2 * need(places))


def search(vectors: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vec_col: str = "embedding", leaves: int | None = None, probes: int | None = None, rerank: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, the k rows with the largest product.

    Ties go to the smaller id; a query is never its own result, its copies are. Null ids, vectors that are null, empty,
    zero, or with null or non-finite components take no part; a shorter vector counts as filled with zeros; repeated
    (id, vector) rows count once. An empty table gives no row. probes and rerank are measured where they are not given.
    """
    spark = vectors.sparkSession
    folder = scratch(spark)
    v, kind = F.col("vec"), vectors.schema[vec_col].dataType.simpleString()
    good = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).filter(
        F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    )
    rank = F.row_number().over(Window.partitionBy("vec").orderBy("id"))  # ids beyond the first k + 1 of equal vectors are never results
    few = good.dropDuplicates(["id", "vec"]).withColumn("r", rank).filter(F.col("r") <= k + 1)
    entries = few.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("eid", F.xxhash64(F.element_at("ids", 1), "vec"))
    entries = written(entries, folder, "entries")
    n = entries.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not n:
        return empty
    share = min(1.0, 0.95 * SAMPLE / n)
    part = entries.filter(F.pmod("eid", F.lit(1 << 53)) < int(share * (1 << 53))).select("vec").limit(SAMPLE) if n > SAMPLE else entries.select("vec")
    d = entries.agg(F.max(F.size("vec"))).first()[0]
    padded = d + d % SUB
    sample = _ones(part.toPandas(), d, padded)
    leaves = leaves or int(np.clip(np.ceil(n / LEAF), 1, 4096))
    codec = train(sample, min(leaves, len(sample)))
    leaves = len(codec.centroids)
    shared = spark.sparkContext.broadcast(codec)

    def index(frames):
        c = shared.value
        for f in frames:
            if not len(f):
                continue
            x = _ones(f, d, padded)
            leaf = c.leaf_of(x)
            yield pd.DataFrame({"eid": f["eid"], "leaf": leaf.astype(np.int32), "codes": _pack(c.encode(x, leaf))})

    coded = written(entries.select("eid", "vec").mapInPandas(index, "eid long, leaf int, codes binary"), folder, "codes")

    def route(frames):
        c = shared.value
        for f in frames:
            if not len(f):
                continue
            x = _ones(f, d, padded)
            top = np.argpartition(-(x @ c.centroids.T), probes - 1, axis=1)[:, :probes]
            yield pd.DataFrame({"qid": np.repeat(f["qid"].to_numpy(), probes), "leaf": top.ravel().astype(np.int32), "vec": [y for y in f["vec"] for _ in range(probes)]})

    queries = good.filter(F.col("id") % every == 0).dropDuplicates(["id", "vec"])
    # equal queries are asked once
    asked = written(queries.groupBy("vec").agg(F.min("id").alias("qid")), folder, "asked")
    count = asked.count()
    if not count:
        return empty
    if probes is None or rerank is None:
        measured = measure(entries, asked, shared, d, padded, k, leaves)
        probes, rerank = probes or measured[0], rerank or measured[1]
    probes = min(probes, leaves)
    # with many meetings queries stand in larger blocks, so that each code is dealt out less often
    block = QUERIES * int(np.clip(probes * -(-n // (leaves * BLOCK)) * -(-count // QUERIES) // 256, 1, 8))
    routed = written(asked.mapInPandas(route, f"qid long, leaf int, vec {kind}"), folder, "routed")
    sizes = coded.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nv"))
    loads = routed.groupBy("leaf").agg(F.ceil(F.count("*") / block).cast("int").alias("nq"))
    blocks = F.broadcast(sizes.join(loads, "leaf"))  # a row for each leaf: 4096 at most
    left = coded.join(blocks, "leaf").withColumn("bv", F.pmod("eid", F.col("nv")).cast("int")).withColumn("bq", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
    right = routed.join(blocks, "leaf").withColumn("bq", F.pmod(F.xxhash64("qid"), F.col("nq")).cast("int")).withColumn("bv", F.explode(F.sequence(F.lit(0), F.col("nv") - 1)))
    m = padded // SUB

    def scan(key, e: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(e) or not len(q):
            return pd.DataFrame({"qid": [], "eid": [], "approx": []})
        c = shared.value
        codes, eids, out = _unpack(e["codes"].tolist(), m), e["eid"].to_numpy(), []
        keep = min(rerank, len(eids))
        for a in range(0, len(q), 256):
            x = _ones(q.iloc[a : a + 256], d, padded)
            s = c.scan(x, int(key[0]), codes)
            top = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
            out.append(pd.DataFrame({"qid": np.repeat(q["qid"].to_numpy()[a : a + 256], keep), "eid": eids[top].ravel(), "approx": np.take_along_axis(s, top, 1).ravel()}))
        return pd.concat(out)

    hits = left.select("leaf", "bv", "bq", "eid", "codes").groupBy("leaf", "bv", "bq").cogroup(right.select("leaf", "bv", "bq", "qid", "vec").groupBy("leaf", "bv", "bq")).applyInPandas(scan, "qid long, eid long, approx float")
    best = hits.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("approx"), "eid"))).filter(F.col("r") <= rerank).select("qid", "eid")
    best = written(best, folder, "best")
    # equal queries are one row of asked, equal entries one of entries: no key is frequent
    exact = best.join(entries, "eid").join(asked.withColumnRenamed("vec", "q"), "qid").select("qid", "q", "ids", product(F.col("q"), F.col("vec")).alias("score"))
    near = exact.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.element_at("ids", 1)))).filter(F.col("r") <= k + 1)  # one entry may be the query alone
    crowd = written(queries.groupBy("vec").agg(F.count("*").alias("n"), F.min("id").alias("qid")), folder, "crowd")
    named = written(join_counted(written(queries, folder, "queries"), crowd, ["vec"], "n").select("id", "qid"), folder, "namedqueries")
    lists = near.groupBy("qid").agg(F.collect_list(F.struct("ids", "score")).alias("found")).join(crowd.select("qid", "n"), "qid")  # k + 1 each
    lists = written(lists, folder, "lists")
    remove(spark, folder, "lists", "namedqueries")
    found = join_counted(named, lists, ["qid"], "n").select(F.col("id").alias("query_id"), F.explode("found").alias("x"))
    found = found.select("query_id", F.explode("x.ids").alias("vec_id"), "x.score").filter("query_id <> vec_id")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
