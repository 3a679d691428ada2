"""Removal of long byte strings that also start elsewhere, by suffix arrays of shards made so that no match is missed.

Every 400-byte string holds an anchor: the first of its 145 positions whose 256-byte hash is the least, so that equal
strings have it at the same place. All occurrences of a repeated string thus meet at one anchor hash. An anchor's surroundings
are the bytes, 544 at most, of the strings that have it. Equal surroundings of one hash are one entry with
their number. A shard's suffix
array is induced from the entries' bytes; in it, strings that share 400 bytes stand together, and of these the ones at
the same distance from their anchors are true repeats (two anchors of one text may surround the same bytes).

A hash with very many different surroundings (a passage that a large part of all texts holds) is not put in one task:
its entries are dealt again by longer seeds, those bytes that all strings starting in one half of the surroundings
have in common. Entries that share no longer seed fall away, equal ones become one, and the halving ends at single
strings.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import PARTS, cuts, join_counted, remove, scratch, written
from quillspark.llm.hashing import _TABLE, _power, mix
from quillspark.llm.induced_sort import common_prefixes, suffix_array

LENGTH, SEED = 400, 256
BEFORE = LENGTH - SEED
#: Different surroundings of one hash in a task at most, and bytes of a shard's suffix array.
MANY, SHARD = 500, 1_000_000
#: Entries of a task that searches shards, about: tasks become more with the input, not longer.
ENTRIES = 8000
#: Keys of common passages that are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 100_000
#: Starts in a range of the search for entries that can repeat.
STEP = 18


def _sums(data: np.ndarray) -> np.ndarray:
    power, _ = _power(len(data) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * power[: len(data)])])


def _hash(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    _, inverse = _power(len(sums))
    return mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))


def _slide(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over each run of w values in a row."""
    n = len(x)
    fill = np.full(-n % w, x[-1], x.dtype)
    y = np.concatenate([x, fill]).reshape(-1, w)
    head = op.accumulate(y, 1).ravel()
    tail = op.accumulate(y[:, ::-1], 1)[:, ::-1].ravel()
    return op(tail[: n - w + 1], head[w - 1 : n])


def anchors_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash, hash of the surroundings, their start, their length) of a text's anchors."""
    n = len(data)
    if n < LENGTH:
        z = np.zeros(0, np.int64)
        return z, z.view(np.uint64), z.view(np.uint64), z, z
    sums = _sums(data)
    count = n - SEED + 1
    _, inverse = _power(len(sums))
    v = (sums[SEED:] - sums[:count]) * inverse[:count]  # equal for equal bytes; its upper bits are well mixed
    shift = np.uint64(max(24, int(count).bit_length()))
    # the upper bits with the position behind them: the least of a run is the leftmost of the least
    least = _slide(v >> shift << shift | np.arange(count, dtype=np.uint64), BEFORE + 1, np.minimum) & ((np.uint64(1) << shift) - np.uint64(1))
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))  # starts of strings with the same anchor are a run
    pos = least[first].astype(np.int64)
    start, stop = first, np.append(first[1:], len(least)) - 1 + LENGTH
    h = mix(v[pos] + np.uint64(SEED))
    around = mix(_hash(sums, start, stop) + (pos - start).astype(np.uint64))
    return pos, h, around, start, stop - start


def _bytes(batch: pa.RecordBatch, name: str = "text"):
    col = batch.column(batch.schema.get_field_index(name))
    for a, b in cuts(col):
        yield a, b, [x or b"" for x in col.slice(a, b - a).cast(pa.binary()).to_pylist()]


def _find_anchors(batches):
    for batch in batches:
        for a, b, texts in _bytes(batch):
            found = [anchors_of(np.frombuffer(x, np.uint8)) for x in texts]
            ids = batch.column(0).slice(a, b - a).to_numpy(zero_copy_only=False)
            n = [len(x[0]) for x in found]
            cols = [np.concatenate([x[k] for x in found]) for k in range(5)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, n).astype(np.int64)), pa.array(cols[1].view(np.int64)), pa.array(cols[2].view(np.int64)), pa.array(cols[3].astype(np.int32)), pa.array((cols[0] - cols[3]).astype(np.int32)), pa.array(cols[4].astype(np.int32))],
                names=["id", "h", "nh", "start", "anchor", "len"],
            )


def _repeated(contents: list[bytes], anchor: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each entry the ranges covered by strings that other entries hold at the same distance from their anchors."""
    size = np.array([len(x) for x in contents])
    first = np.cumsum(size + 1) - size - 1
    t = np.concatenate([*(y for x in contents for y in (np.frombuffer(x, np.uint8).astype(np.int64) + 2, np.ones(1, np.int64))), np.zeros(1, np.int64)])
    sa = suffix_array(t)
    plcp = common_prefixes(t, sa, LENGTH * 2, first)
    block = np.empty(len(t), np.int64)
    block[sa] = np.cumsum(plcp[sa] < LENGTH)
    a, b = np.maximum(low + anchor, 0), np.minimum(high + anchor, size - LENGTH)  # starts of whole strings
    count = np.maximum(b - a + 1, 0)
    entry = np.repeat(np.arange(len(contents)), count)
    s = np.repeat(a - (np.cumsum(count) - count), count) + np.arange(count.sum())
    same = block[first[entry] + s] << 11 | (s - anchor[entry] + 1024)
    order = np.argsort(same)
    times = np.diff(np.append(np.flatnonzero(np.concatenate([[True], np.diff(same[order]) != 0])), len(same)))
    hit = np.empty(len(same), bool)
    hit[order] = np.repeat(times > 1, times)
    out: list[list[tuple[int, int]]] = [[] for _ in contents]
    e, s = entry[hit], s[hit]
    new = np.concatenate([[True], (e[1:] != e[:-1]) | (s[1:] != s[:-1] + 1)]) if len(e) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    for x, p, q in zip(e[head].tolist(), s[head].tolist(), s[np.append(head[1:], len(s)) - 1].tolist() if len(head) else []):
        out[x].append((p, q + LENGTH))
    return out


def _promising(keys: list, contents: list[bytes], anchors: list[int], lows: list[int], highs: list[int]) -> list[tuple[int, int, int]]:
    """(entry, first start, last start) of the entries that can repeat, cut to where they can.

    The starts are dealt into ranges; the strings of one range share all but some 18 of their bytes. Where no other entry
    of the key has these, none of them repeats, and the suffix array can do without their ends.
    """
    seen: dict[tuple, int] = {}
    ranges: list[list[tuple[int, int, tuple]]] = []
    for key, content, anchor, lo, hi in zip(keys, contents, anchors, lows, highs):
        mine = []
        for a in range(lo, hi + 1, STEP):
            b = min(a + STEP - 1, hi)
            p, q = max(a + anchor, 0), min(b + anchor, len(content) - LENGTH)
            if p <= q:
                k = (key, a, hash(content[b + anchor : a + anchor + LENGTH]))
                seen[k] = seen.get(k, 0) + 1
                mine.append((p, q, k))
        ranges.append(mine)
    out = []
    for i, mine in enumerate(ranges):
        left = [(p, q) for p, q, k in mine if seen[k] > 1]
        if left:
            out.append((i, left[0][0], left[-1][1]))
    return out


def _shards(frames):
    """Sorted by key: whole keys together, in suffix arrays of about SHARD bytes."""

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        keys, contents = f["key"].tolist(), f["content"].tolist()
        at = _promising(keys, contents, f["anchor"].tolist(), f["lo"].tolist(), f["hi"].tolist())
        if not at:
            return pd.DataFrame({"key": [], "chash": [], "a": [], "b": []})
        anchor, lo, hi = (f[c].to_numpy(np.int64) for c in ("anchor", "lo", "hi"))
        i = np.array([x[0] for x in at])
        p, q = np.array([x[1] for x in at]), np.array([x[2] for x in at])
        found = _repeated([contents[k][a : b + LENGTH] for k, a, b in at], anchor[i] - p, np.maximum(lo[i], p - anchor[i]), np.minimum(hi[i], q - anchor[i]))
        chash = f["chash"].tolist()
        rows = [(keys[k], chash[k], a + c, a + d) for (k, a, _), x in zip(at, found) for c, d in x]
        return pd.DataFrame(rows, columns=["key", "chash", "a", "b"])

    rest, total = [], 0
    for f in frames:
        for _, g in f.groupby("key", sort=False):
            if rest and total > SHARD and rest[-1]["key"].iloc[-1] != g["key"].iloc[0]:
                yield solve(pd.concat(rest))
                rest, total = [], 0
            rest.append(g)
            total += int(g["content"].str.len().sum())
    if rest:
        yield solve(pd.concat(rest))


def _halves(frames):
    """Entries dealt again by longer seeds: strings that start in the lower, and in the upper half of the range."""
    for f in frames:
        rows = []
        for key, content, anchor, w, okey, ochash, off, lo, hi in zip(*(f[c] for c in ("key", "content", "anchor", "w", "okey", "ochash", "off", "lo", "hi"))):
            mid = (lo + hi) // 2
            for a, b in ((lo, mid), (mid + 1, hi)):
                p, q = max(a + anchor, 0), min(b + anchor, len(content) - LENGTH)
                if a > b or p > q:
                    continue
                seed = content[max(b + anchor, 0) : a + anchor + LENGTH]  # in each string that starts from a to b before the anchor
                part = content[p : q + LENGTH]
                k = hashlib.blake2b(seed + b"%d,%d,%d" % (key, a, b), digest_size=8).digest()
                c = hashlib.blake2b(part + b"%d" % (anchor - p), digest_size=8).digest()
                rows.append((int.from_bytes(k, "big", signed=True), int.from_bytes(c, "big", signed=True), part, anchor - p, w, okey, ochash, off + p, a, b))
        yield pd.DataFrame(rows, columns=["key", "chash", "content", "anchor", "w", "okey", "ochash", "off", "lo", "hi"])


ENTRY = "key long, chash long, content binary, anchor int, w long, okey long, ochash long, off int, lo int, hi int"


def repeated_ranges(texts: DataFrame, folder: str, many: int = MANY) -> DataFrame:
    """(id, runs): for texts (id unique, text) with repeated strings, ranges of bytes that they cover, in any order."""
    anchors = written(texts.mapInArrow(_find_anchors, "id long, h long, nh long, start int, anchor int, len int"), folder, "anchors")
    twice = written(anchors.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), folder, "twice")
    dup = written(join_counted(anchors, twice, ["h"], "n"), folder, "dup")
    same = written(dup.groupBy("h", "nh").agg(F.count("*").alias("w"), F.min(F.struct("id", "start", "anchor", "len")).alias("x")), folder, "same")
    mixed = written(same.groupBy("h").agg(F.count("*").alias("d")).filter("d > 1"), folder, "mixed")
    need = join_counted(same, mixed, ["h"], "d").select("h", "nh", "w", "x.*")
    places = need.groupBy("id").agg(F.collect_list(F.struct("h", "nh", "start", "anchor", "len", "w")).alias("places"))  # of one text, as many as its anchors

    def fetch(batches):
        for batch in batches:
            for text, places in zip(batch.column(0), batch.column(1)):
                data = text.cast(pa.binary()).as_py()
                rows = places.as_py()
                cols = {k: [r[k] for r in rows] for k in ("h", "nh", "start", "anchor", "len", "w")}
                content = [data[s : s + n] for s, n in zip(cols["start"], cols["len"])]
                i64, i32, n = pa.int64(), pa.int32(), len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols["h"], i64), pa.array(cols["nh"], i64), pa.array(content, pa.binary()), pa.array(cols["anchor"], i32), pa.array(cols["w"], i64), pa.array(cols["h"], i64), pa.array(cols["nh"], i64), pa.array([0] * n, i32), pa.array([-BEFORE] * n, i32), pa.array([0] * n, i32)],
                    names=["key", "chash", "content", "anchor", "w", "okey", "ochash", "off", "lo", "hi"],
                )

    entries = written(texts.join(places, "id").select("text", "places").mapInArrow(fetch, ENTRY), folder, "entries0")
    found = [same.filter("w > 1").select("h", "nh", "w", F.lit(0).alias("a"), F.col("x.len").alias("b"))]
    level = 0
    while True:
        one = entries.groupBy("key", "chash").agg(F.first("content").alias("content"), F.first("anchor").alias("anchor"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.sum("w").alias("w")) if level else entries
        one = written(one, folder, f"one{level}") if level else one
        sizes = written(one.groupBy("key").agg(F.count("*").alias("d")).filter("d > 1"), folder, f"sizes{level}")
        hot = sizes.filter(F.col("d") > many)
        n, total, left = sizes.agg(F.count_if(F.col("d") > many), F.coalesce(F.sum("d"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("d") <= many, F.col("d"))), F.lit(0))).first()
        origin = entries.select("key", "chash", "okey", "ochash", "off", "w")
        if level:  # equal ones of different origins
            found.append(one.filter("w > 1").select("key", "chash", F.length("content").alias("n")).join(origin, ["key", "chash"]).select(F.col("okey").alias("h"), F.col("ochash").alias("nh"), "w", F.col("off").alias("a"), (F.col("off") + F.col("n")).alias("b")))
        # those of hot keys, or of the most frequent ones if there are too many keys, are left out before any shuffle by key
        shown = hot if n <= BROADCAST_KEYS else hot.filter(F.col("d") * PARTS > total)
        cold = one.join(F.broadcast(shown.select("key")), "key", "left_anti") if n else one
        few = cold.join(sizes.filter(F.col("d") <= many), "key").select("key", "chash", "content", "anchor", "lo", "hi")
        hits = few.repartition(max(1, -(-left // ENTRIES)), "key").sortWithinPartitions("key").mapInPandas(_shards, "key long, chash long, a int, b int")
        found.append(hits.join(origin, ["key", "chash"]).select(F.col("okey").alias("h"), F.col("ochash").alias("nh"), "w", (F.col("a") + F.col("off")).alias("a"), (F.col("b") + F.col("off")).alias("b")))
        if not n:
            break
        level += 1
        if n <= BROADCAST_KEYS:
            again = entries.join(F.broadcast(hot.select("key")), "key")
        else:
            again = join_counted(entries, written(entries.join(hot.select("key"), "key", "left_semi").groupBy("key").agg(F.count("*").alias("n")), folder, f"hot{level}"), ["key"], "n")
        entries = written(again.mapInPandas(_halves, ENTRY), folder, f"entries{level}")
    ranges = found[0]
    for x in found[1:]:
        ranges = ranges.unionAll(x)
    ranges = written(ranges.groupBy("h", "nh").agg(F.max("w").alias("w"), F.collect_set(F.struct("a", "b")).alias("r")), folder, "ranges")  # within 544 bytes
    runs = join_counted(dup, ranges, ["h", "nh"], "w").select("id", F.explode("r").alias("r"), "start").select("id", F.struct((F.col("start") + F.col("r.a")).alias("a"), (F.col("start") + F.col("r.b")).alias("b")).alias("r"))
    runs = written(runs.groupBy("id").agg(F.collect_list("r").alias("runs")), folder, "runs")
    remove(texts.sparkSession, folder, "texts", "runs")
    return runs


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", many: int = MANY, with_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes; a null one is empty. A byte goes if a 400-byte string over it also starts anywhere else, in
    another row or in the same one, overlapping or not; repeated rows are copies of one another and go whole from 400
    bytes on. Null and repeated ids are kept. Other columns are not read. with_text adds the bytes left as `kept`.
    """
    spark = docs.sparkSession
    folder = scratch(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if not texts.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").isEmpty():  # ids that name rows, written once so that they stay
        texts = written(texts.withColumn("id", F.monotonically_increasing_id()), folder, "texts")
    else:
        texts = texts.withColumn("id", F.col("doc_id"))
    runs = repeated_ranges(texts.filter(F.octet_length("text") >= LENGTH).select("id", "text"), folder, many)

    def cut(batches):
        for batch in batches:
            for a, b, raw in _bytes(batch):
                out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
                for data, r in zip(raw, batch.column(2).slice(a, b - a)):
                    spans = merged([(x["a"], x["b"]) for x in r.as_py() or []])
                    kept, at = [], 0
                    for p, q in spans:
                        kept.append(data[at:p])
                        at = q
                    left = b"".join([*kept, data[at:]])
                    for k, v in (("n_bytes", len(data)), ("n_removed", len(data) - len(left)), ("n_spans", len(spans)), ("kept_sha256", hashlib.sha256(left).hexdigest()), ("kept", left)):
                        out[k].append(v)
                i = pa.int64()
                arrays = [batch.column(0).slice(a, b - a), *(pa.array(out[k], i) for k in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept_sha256"])]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_text:
                    arrays, names = [*arrays, pa.array(out["kept"], pa.binary())], [*names, "kept"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return texts.join(runs, "id", "left").select("doc_id", "text", "runs").mapInArrow(cut, schema)
