"""Toxicity of whole texts: subword-bag embeddings, averaged, under a linear softmax.

A word is the bag of its hashed character n-grams (with marks at its ends) and itself; its vector is their mean, so a
misspelling shares most of it. A text is scored in windows of `WINDOW` words: the mean of their vectors goes through a
linear softmax, and the text's score is that of its most toxic window, whatever its length. Embeddings and softmax are
trained together in numpy, by Adagrad on a bounded sample of labelled rows. The trained model gives each n-gram one
number (embedding times the difference of the two class weights), so scoring a text is a mean of remembered words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Memory, map_texts

#: Training rows at most (a hash of the id chooses) and bytes of a training text; scoring has no such limits.
SAMPLE_ROWS, SAMPLE_BYTES = 5_000, 20_000
BUCKETS, DIM, WINDOW, SIZES = 1 << 16, 16, 8, (3, 4, 5, 6)
#: In the first epochs a text's windows are pooled (their sum over the root of their number), then its top one counts.
EPOCHS, POOLED, RATE, DECAY, BATCH = 7, 2, 0.08, 1e-6, 32
THRESHOLD = 0.3
#: So many clean texts lost weigh as much as a toxic one missed: by its logarithm the log odds are raised.
MISSED = 2.0
WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of its word) for all n-grams of distinct words, the whole word among them."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # characters from here to the word's end
    step, mix = np.uint64(1099511628211), np.uint64(0x9E3779B97F4A7C15)
    h = np.zeros(len(codes), np.uint64)
    buckets, owners = [], []
    for n in range(1, max(SIZES) + 1):
        if n > len(codes):
            break
        h[: len(codes) - n + 1] = h[: len(codes) - n + 1] * step + codes[n - 1 :] + np.uint64(1)
        if n in SIZES:
            at = np.flatnonzero(left >= n)
            buckets.append(_bucket(h[at], mix, n))
            owners.append(owner[at])
    powers = np.cumprod(np.full(int(sizes.max()), step, np.uint64))
    first = np.cumsum(sizes) - sizes
    whole = np.add.reduceat((codes + np.uint64(1)) * powers[np.arange(len(codes)) - np.repeat(first, sizes)], first)
    buckets.append(_bucket(whole, mix, 0))
    owners.append(np.arange(len(words)))
    return np.concatenate(buckets), np.concatenate(owners)


def _bucket(h: np.ndarray, mix: np.uint64, n: int) -> np.ndarray:
    h = (h ^ np.uint64(n * 0x51ED27)) * mix
    return ((h ^ (h >> np.uint64(29))) * mix >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


@dataclass
class Model:
    weight: np.ndarray  # for each bucket, its share of the log odds
    bias: float
    memory: Memory = field(default_factory=Memory)  # of words, each word's share

    def __reduce__(self):
        return Model, (self.weight, self.bias)

    def learn(self, words: list[str]) -> None:
        bucket, owner = grams(words)
        total = np.bincount(owner, self.weight[bucket], len(words)) / np.bincount(owner, minlength=len(words))
        for w, x in zip(words, total.tolist()):
            self.memory.put(w, x)

    def scores(self, texts: list[str]) -> list[float]:
        rows = [words_of(x) for x in texts]
        need = self.memory.begin({w for row in rows for w in row})
        for i in range(0, len(need), 20_000):
            self.learn(need[i : i + 20_000])
        known = self.memory.known
        out = []
        for row in rows:
            if row:
                s = np.fromiter(map(known.__getitem__, row), np.float64, len(row))
                at = np.arange(0, len(s), WINDOW)
                top = float((np.add.reduceat(s, at) / np.maximum(np.diff(np.append(at, len(s))), WINDOW // 2)).max())
            else:
                top = 0.0
            out.append(float(1 / (1 + np.exp(-np.clip(self.bias + top, -50, 50)))))
        return out


def train(texts: list[str], labels: list[int], seed: int = 0) -> Model:
    """Texts with labels 0 or 1, in any order; without rows of both labels the model gives the base rate."""
    y = np.asarray(labels, np.float64)
    rate = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS), float(np.log(rate / (1 - rate))))
    index: dict[str, int] = {}
    # a text at a time: the words of all would take ten times their texts
    ids = [np.fromiter((index.setdefault(w, len(index)) for w in words_of(x)), np.int32) for x in texts]
    if not index:
        return Model(np.zeros(BUCKETS), float(np.log(rate / (1 - rate))))
    r = np.random.default_rng(seed)
    # the n-grams of each word, in four bytes each, made for some words at a time: the driver's memory is small
    parts, sizes, known = [], [], list(index)
    for a in range(0, len(known), 20_000):
        b, owner = grams(known[a : a + 20_000])
        parts.append(b[np.argsort(owner, kind="stable")].astype(np.int32))
        sizes.append(np.bincount(owner, minlength=len(known[a : a + 20_000])))
    bucket, starts = np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    del parts, known, index
    e = r.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    u = r.normal(0, 0.3, (DIM, 2)).astype(np.float32)
    bias = np.log([1 - rate, rate])
    e2, u2, b2 = np.full(BUCKETS, 1e-9), np.full((DIM, 2), 1e-6), np.full(2, 1e-2)
    for epoch in range(EPOCHS):
        rate_now = RATE * (1 - epoch / EPOCHS)
        deal = r.permutation(len(ids))
        for a in range(0, len(deal), BATCH):
            docs = [i for i in deal[a : a + BATCH] if len(ids[i])]
            if not docs:
                continue
            tokens = np.concatenate([ids[i] for i in docs])
            uniq, inverse = np.unique(tokens, return_inverse=True)
            n = starts[uniq + 1] - starts[uniq]
            flat = np.repeat(starts[uniq] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            g = bucket[flat]
            z = (e @ u)[g]  # of each n-gram, by class
            word = np.add.reduceat(z, np.cumsum(n) - n) / n[:, None]
            lengths = np.array([len(ids[i]) for i in docs])
            first = np.cumsum(lengths) - lengths
            at = np.concatenate([np.arange(f, f + k, WINDOW) for f, k in zip(first, lengths)])
            of = np.repeat(np.arange(len(docs)), -(-lengths // WINDOW))
            size = np.maximum(np.diff(np.append(at, len(tokens))), WINDOW // 2)
            win = np.add.reduceat(word[inverse], at) / size[:, None]
            if epoch < POOLED:
                share = 1 / np.sqrt(np.bincount(of))[of]
            else:
                best = np.lexsort((win[:, 0] - win[:, 1], of))[np.searchsorted(of, np.arange(len(docs)))]
                share = np.zeros(len(of))
                share[best] = 1
            logits = np.stack([np.bincount(of, win[:, k] * share) for k in range(2)], 1) + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            err = p
            err[:, 0] -= 1 - y[docs]
            err[:, 1] -= y[docs]
            err /= len(docs)
            each = np.repeat(err[of] * (share / size)[:, None], np.diff(np.append(at, len(tokens))), axis=0)
            back = np.stack([np.bincount(inverse, each[:, k], len(uniq)) for k in range(2)], 1)
            coef = np.repeat(back / n[:, None], n, axis=0)
            hit = coef.any(1)
            c = np.stack([np.bincount(g[hit], coef[hit, k], BUCKETS) for k in range(2)], 1)
            at_b = np.flatnonzero(c.any(1))
            c = c[at_b]
            ge, gu, gbias = c @ u.T, e[at_b].T @ c, err.sum(0)
            ge += DECAY * e[at_b]
            e2[at_b] += (ge**2).mean(1)
            u2 += gu**2
            b2 += gbias**2
            e[at_b] -= (rate_now * ge / np.sqrt(e2[at_b])[:, None]).astype(np.float32)
            u -= (rate_now * gu / np.sqrt(u2)).astype(np.float32)
            bias -= rate_now * gbias / np.sqrt(b2)
    w = (e @ (u[:, 1] - u[:, 0])).astype(np.float64)
    seen = np.zeros(BUCKETS, bool)
    seen[bucket] = True
    w[~seen] = 0
    return Model(w, float(bias[1] - bias[0] + np.log(MISSED)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> Model:
    """The model of a bounded sample: rows whose crc32(doc_id as text) mod 4 is not 2, with a label 0 or 1."""
    labels = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1) and pmod(crc32(cast(doc_id as string)), 4) <> 2")
    n = labels.count()
    part = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 53)) < int(0.95 * sample / n * (1 << 53))) if n > sample else labels
    part = part.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).limit(sample)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.octet_length("text") <= SAMPLE_BYTES)
    got = rows.join(F.broadcast(part), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "toxic")
    found = got.repartition(1).mapInArrow(_train, "weight binary, bias double").collect()
    return Model(np.frombuffer(found[0]["weight"]), found[0]["bias"]) if found else train([], [])


def _train(batches):
    """The one row of a model, from the sample: in a task, as what training leaves behind would stay in the driver's memory."""
    held = list(batches)
    got = pa.Table.from_batches(held).sort_by("doc_id") if held else None
    model = train(got.column("text").to_pylist(), got.column("toxic").to_pylist()) if held else train([], [])
    yield pa.RecordBatch.from_arrays([pa.array([model.weight.tobytes()], pa.binary()), pa.array([model.bias], pa.float64())], names=["weight", "bias"])


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: its id (or the columns of keep), held_out, score, predicted.

    A null or empty text has the model's score of no words; a null id counts as not held out; repeated rows are kept and
    other columns are neither read nor used. The model (1 MB) goes out with the tasks.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    s = map_texts(docs, lambda texts: {"score": shared.value.scores(texts)}, "score double", pa.schema([("score", pa.float64())]), keep or ["doc_id"])
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    return s.withColumn("held_out", held).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels)).select("doc_id", "held_out", "score", "predicted")
