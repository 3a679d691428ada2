"""Near duplicates by a chosen-path set similarity join on word shingles, confirmed on full sets, as components.

Equal sets are one vertex. Each vertex carries minwise tokens: for each of `TOKENS` hash functions the least of its
shingles. A tree starts with all vertices in one node. At each level a node, by its own path, chooses one coordinate,
and now and then a second, and its members go on to the children named by their token there; two sets of similarity s
share a child with a chance of s for each choice. Independent trees of `DEPTH` levels, as many as the threshold asks for,
bring a pair at the threshold together with a chance of 1 - 3e-5. Nodes of up to `SMALL` members are compared
exhaustively: their pairs are estimated by the tokens. First only a spanning forest of the best pairs is confirmed; then
every pair left that is likely enough and lies in different components.

Larger nodes that share members are a crowd, and a crowd is joined exactly, without comparing all its pairs. Its centre
holds the shingles that most of a few members have; a member's distance d is the number of shingles that only one of it
and the centre has, its deviations. Two sets of sizes m and n are linked if they differ in at most q * (m + n) shingles,
q = (100 - percent) / (100 + percent). Their difference is at most the sum of their distances, so all members that are near
enough are linked with the nearest one (the hub), by arithmetic alone. Those left have further centres, as long as these
link a good part of them. Of all other pairs, those in different components, one end is outside the hub's component, and
the difference is the sum of the distances less twice the number of deviations in common: so they have a known number of
deviations in common, and meet in a prefix filter over deviations, the rare kinds of which come first. Its candidates are
confirmed like the others. A crowd of copies thus costs as much as it has members, and none of its links is lost.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.common import cuts, join_counted, remove, scratch, written
from quillspark.llm.components import components
from quillspark.llm.hashing import mix, shingles, words

WORDS, PERCENT = 5, 85
TOKENS, DEPTH, SECOND, SMALL = 96, 3, 0.25, 40
#: The chance that no tree brings a pair at the threshold together.
MISSED = 3e-5
#: Members that make a centre, rows of a crowd in a block, rows of a list of postings in a block.
CENTRE, BLOCK, LIST = 15, 2000, 1000
#: A crowd's members left have a further centre while the last one has linked such a share of them.
PROGRESS = 0.3
#: A pair is confirmed if its tokens agree in a share of the threshold less so many standard deviations.
DEVIATIONS = 4.665
_SEEDS = np.random.default_rng(7).integers(1, 1 << 62, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Setting:
    percent: int
    likely: float
    trees: int


def setting(percent: int) -> Setting:
    """What a threshold asks for; 85: a likely share of 0.68 and 8 trees."""
    if not 0 < percent < 100:
        raise ValueError("percent must lie between 1 and 99")
    s = percent / 100
    meet = 1.0
    for _ in range(DEPTH):
        meet = (1 - SECOND) * s * meet + SECOND * (1 - (1 - s * meet) ** 2)
    trees = math.ceil(math.log(MISSED) / math.log1p(-meet))
    return Setting(percent, s - DEVIATIONS * math.sqrt(s * (1 - s) / TOKENS), trees)


def tokens_of(sets: list[np.ndarray]) -> np.ndarray:
    """The minwise tokens (16 bits each) of non-empty sets."""
    flat = np.concatenate(sets)
    first = np.concatenate([[0], np.cumsum([len(x) for x in sets])[:-1]])
    out = np.empty((len(sets), TOKENS), np.uint16)
    for k, seed in enumerate(_SEEDS):
        low = np.minimum.reduceat(flat * seed + (flat >> np.uint64(32)), first)
        out[:, k] = (mix(low) >> np.uint64(48)).astype(np.uint16)
    return out


def _texts(batch: pa.RecordBatch):
    col = batch.column(batch.schema.get_field_index("text"))
    for a, b in cuts(col):
        yield a, b, [x or b"" for x in col.slice(a, b - a).cast(pa.binary()).to_pylist()]


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, v, tokens): v is a hash of the set, null for an empty one."""

    def run(batches):
        for batch in batches:
            for a, b, texts in _texts(batch):
                sets = shingles(*words(texts), WORDS)
                n = np.array([len(x) for x in sets], np.int64)
                full = [x for x in sets if len(x)]
                v: list = [None] * len(sets)
                t: list = [None] * len(sets)
                if full:
                    flat = np.concatenate(full)
                    first = np.concatenate([[0], np.cumsum([len(x) for x in full])[:-1]])
                    keys = mix(np.add.reduceat(mix(flat ^ np.uint64(0x5BD1E995)), first) + n[n > 0].astype(np.uint64)).view(np.int64).tolist()
                    rows = [x.tobytes() for x in tokens_of(full)]
                    for i, k, r in zip(np.flatnonzero(n).tolist(), keys, rows):
                        v[i], t[i] = k, r
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), pa.array(v, pa.int64()), pa.array(t, pa.binary())], names=["doc_id", "n_shingles", "v", "tokens"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, v long, tokens binary")


def _branch(paths: np.ndarray, level: int, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(child's path, row) of rows at nodes `paths`: by the coordinate, or two, that the node chooses."""
    h = mix(paths ^ np.uint64(level * 0x9E3779B9 + 1))
    at = np.arange(len(paths))
    first = (h & np.uint64(0xFFFF)).astype(np.int64) % TOKENS
    second = np.flatnonzero((h >> np.uint64(32)).astype(np.float64) / 2**32 < SECOND)
    other = (first[second] + 1 + ((h[second] >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64) % (TOKENS - 1)) % TOKENS
    rows, coordinate = np.concatenate([at, second]), np.concatenate([first, other])
    token = tokens[rows, coordinate].astype(np.uint64)
    return mix(h[rows] + mix(token * np.uint64(TOKENS) + coordinate.astype(np.uint64) + np.uint64(1))), rows


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(len(column), TOKENS)


def grow(vertices: DataFrame, trees: int) -> DataFrame:
    """(path, v): the nodes of all trees at DEPTH."""

    def run(frames):
        for f in frames:
            if not len(f):
                continue
            t, v = _matrix(f["tokens"]), f["v"].to_numpy()
            for tree in range(trees):
                paths, rows = np.full(len(f), tree * 7919 + 13, np.uint64), np.arange(len(f))
                for level in range(DEPTH):
                    paths, pick = _branch(paths, level, t[rows])
                    rows = rows[pick]
                yield pd.DataFrame({"path": paths.view(np.int64), "v": v[rows]})

    return vertices.select("v", "tokens").mapInPandas(run, "path long, v long")


def nodes_of(vertices: DataFrame, folder: str, how: Setting) -> tuple[DataFrame, DataFrame]:
    """(path, v, tokens) of nodes with 2 to SMALL members, (path, v) of larger ones."""
    paths = written(grow(vertices, how.trees).distinct(), folder, "paths")
    sizes = written(paths.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1"), folder, "sizes")
    sized = written(join_counted(paths, sizes.withColumn("large", F.col("n") > SMALL), ["path"], "n"), folder, "sized")
    small = sized.filter("not large").select("path", "v").join(vertices.select("v", "tokens"), "v").select("path", "v", "tokens")
    return written(small, folder, "nodes"), sized.filter("large").select("path", "v")


def _pairs(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all pairs within runs of the given sizes."""
    first = np.cumsum(size) - size
    left = np.repeat(np.arange(size.sum()), np.repeat(first + size, size) - np.arange(size.sum()) - 1)
    if not len(left):
        return left, left
    start = np.flatnonzero(np.diff(np.concatenate([[-1], left])))
    run = np.diff(np.append(start, len(left)))
    return left, left + 1 + np.arange(len(left)) - np.repeat(start, run)


def compare(nodes: DataFrame, forest: bool, likely: float) -> DataFrame:
    """(a, b): likely pairs of the same node; a spanning forest of them, or all that lie in different components c."""
    columns = ["path", "v", "tokens"] + ["c"] * (not forest)

    def emit(f: pd.DataFrame) -> pd.DataFrame:
        size = np.diff(np.append(np.flatnonzero(np.concatenate([[True], f["path"].to_numpy()[1:] != f["path"].to_numpy()[:-1]])), len(f)))
        t, v = _matrix(f["tokens"]), f["v"].to_numpy()
        i, j = _pairs(size)
        if not forest:
            c = f["c"].to_numpy()
            keep = c[i] != c[j]
            i, j = i[keep], j[keep]
        share = np.empty(len(i), np.float32)
        for a in range(0, len(i), 100_000):
            share[a : a + 100_000] = (t[i[a : a + 100_000]] == t[j[a : a + 100_000]]).mean(1)
        keep = share >= likely
        i, j, share = i[keep], j[keep], share[keep]
        if forest:
            up = list(range(len(f)))

            def top(x):
                while up[x] != x:
                    up[x] = up[up[x]]
                    x = up[x]
                return x

            chosen = []
            for k in np.argsort(-share, kind="stable").tolist():
                p, q = top(int(i[k])), top(int(j[k]))
                if p != q:
                    up[p] = q
                    chosen.append(k)
            i, j = i[chosen], j[chosen]
        return pd.DataFrame({"a": np.minimum(v[i], v[j]), "b": np.maximum(v[i], v[j])})

    def run(frames):
        rest = None
        for f in frames:
            f = f if rest is None else pd.concat([rest, f], ignore_index=True)
            if not len(f):
                continue
            cut = int(np.searchsorted((f["path"] != f["path"].iloc[-1]).to_numpy()[::-1], True))
            head, rest = f.iloc[: len(f) - cut], f.iloc[len(f) - cut :]
            for a in _steps(head["path"].to_numpy()):
                yield emit(head.iloc[a])
        if rest is not None and len(rest):
            yield emit(rest)

    return nodes.select(*columns).repartition("path").sortWithinPartitions("path", "v").mapInPandas(run, "a long, b long").filter("a <> b").distinct()


def _steps(paths: np.ndarray, most: int = 4000):
    """Slices of about `most` rows that part no node."""
    edges = np.append(np.flatnonzero(np.concatenate([[True], paths[1:] != paths[:-1]])), len(paths)) if len(paths) else np.zeros(1, int)
    a = 0
    for b, after in zip(edges[1:], [*edges[2:], None]):
        if after is None or after - a > most:
            yield slice(a, b)
            a = b


def confirm(pairs: DataFrame, texts: DataFrame, folder: str, name: str, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    pairs = written(pairs, folder, f"{name}pairs")
    need = pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct()

    def sets(batches):
        for batch in batches:
            for a, b, t in _texts(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([x.tobytes() for x in shingles(*words(t), WORDS)], pa.binary())], names=["v", "s"])

    full = written(texts.join(need, "v", "left_semi").select("v", "text").mapInArrow(sets, "v long, s binary"), folder, f"{name}sets")

    def run(batches):
        for batch in batches:
            ok = []
            for s, t in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(s.as_py(), np.uint64), np.frombuffer(t.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    joined = pairs.join(full.select(F.col("v").alias("a"), F.col("s").alias("s")), "a").join(full.select(F.col("v").alias("b"), F.col("s").alias("t")), "b")
    return written(joined.select("a", "b", "s", "t").mapInArrow(run, "a long, b long"), folder, name)


def gather(large: DataFrame, folder: str) -> DataFrame:
    """(v, k, salt, salts): the members of crowds k, dealt into blocks."""
    first = written(large.groupBy("path").agg(F.min("v").alias("a"), F.count("*").alias("n")), folder, "first")
    crowd = written(components(join_counted(large, first, ["path"], "n").select("a", F.col("v").alias("b")), folder, "ck"), folder, "crowd")
    sizes = written(crowd.groupBy(F.col("c").alias("k")).agg(F.count("*").alias("n")).withColumn("salts", F.ceil(F.col("n") / BLOCK).cast("int")), folder, "crowdsizes")
    dealt = join_counted(crowd.withColumnRenamed("c", "k"), sizes, ["k"], "n")
    return written(dealt.withColumn("salt", F.pmod(F.xxhash64("v"), F.col("salts")).cast("int")), folder, "dealt")


def _blocks(table: DataFrame) -> DataFrame:
    """A row for each block of the crowd."""
    return table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")


def stars(members: DataFrame, folder: str, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links by arithmetic in crowds: (edges (a, b), distances from the first centre, first centres).

    members: (k, salt, salts, v, s), s the set. Distances: (k, salt, v, x, d, hub, x0), where x is
    (100 + percent) * d - (100 - percent) * size: two members are linked if the sum of their x is not above 0.
    """
    edges, first, left, k = [], None, members.select("k", "salt", "salts", "v"), 0
    while True:
        order = Window.partitionBy("k").orderBy(F.xxhash64("v", F.lit(k)), "v")
        few = left.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= CENTRE)
        seen = members.join(few.select("v"), "v", "left_semi").select("k", "salts", F.explode("s").alias("t")).groupBy("k", "salts", "t").agg(F.count("*").alias("n"))
        size = few.groupBy("k").agg(F.count("*").alias("m"))
        kind = lambda c: F.collect_list(F.when(c, F.col("t")))
        most = F.col("n") * 2 > F.col("m")
        centres = seen.join(size, "k").groupBy("k", "salts").agg(kind(most).alias("centre"), kind(~most & (F.col("n") > 1)).alias("common"))
        centres = written(_blocks(centres), folder, f"centres{k}")
        both = members.join(left.select("v"), "v", "left_semi") if k else members
        both = both.join(centres, ["k", "salt"])
        many = lambda c: F.size(c).cast("long")
        d = many("s") + many("centre") - 2 * many(F.array_intersect("s", "centre"))
        x = (100 + percent) * d - (100 - percent) * many("s")
        far = written(both.select("k", "salt", "salts", "v", d.alias("d"), x.alias("x")), folder, f"far{k}")
        hubs = far.groupBy("k", "salts").agg(F.min(F.struct("x", "v")).alias("y")).select("k", "salts", F.col("y.v").alias("hub"), F.col("y.x").alias("x0"))
        star = written(far.join(_blocks(hubs), ["k", "salt"]), folder, f"star{k}")
        first = first or (star, centres)
        near = (F.col("x") + F.col("x0") <= 0) | (F.col("v") == F.col("hub"))
        edges.append(star.filter(near & (F.col("v") != F.col("hub"))).select(F.col("hub").alias("a"), F.col("v").alias("b")))
        n, linked = star.agg(F.count("*"), F.count_if(near)).first()
        if n - linked <= SMALL or linked < PROGRESS * n:
            break
        left, k = star.filter(~near).select("k", "salt", "salts", "v"), k + 1
    out = edges[0]
    for e in edges[1:]:
        out = out.unionAll(e)
    return out, *first


def candidates(members: DataFrame, star: DataFrame, centres: DataFrame, part: DataFrame, folder: str, percent: int) -> DataFrame:
    """(a, b): all pairs of a crowd in different components c that may be linked, by a prefix filter over deviations."""
    named = star.join(part, "v", "left").withColumn("c", F.coalesce("c", "v"))
    hubs = named.filter("v = hub").select("k", "salts", F.col("c").alias("main"))
    named = written(named.join(_blocks(hubs), ["k", "salt"]).withColumn("out", F.col("c") != F.col("main")), folder, "namedcrowd")
    mixed = named.filter("out").groupBy("k", "salts").agg(F.min("x").alias("xo"))
    twice = 2 * (100 + percent)
    # deviations in common with any partner at least: a partner of one inside the main component is outside it
    least = F.greatest(F.ceil((F.col("x") + F.when(F.col("out"), F.col("x0")).otherwise(F.col("xo"))) / twice), F.lit(1))
    open_ = named.join(_blocks(mixed), ["k", "salt"]).withColumn("p", (F.col("d") - least + 1).cast("int")).filter("p > 0").select("k", "salt", "v", "x", "d", "c", "out", "p")
    both = members.select("v", "s").join(open_, "v").join(centres, ["k", "salt"])
    new = F.array_except("s", "centre")
    order = F.concat(F.array_sort(F.array_except(new, F.col("common"))), F.array_sort(F.array_intersect(new, F.col("common"))), F.array_sort(F.array_except("centre", "s")))
    posts = both.select("k", "v", "x", "d", "c", "out", F.posexplode(F.slice(order, F.lit(1), F.col("p"))).alias("i", "t"))
    posts = written(posts, folder, "postings")
    lists = posts.groupBy("k", "t").agg(F.count("*").alias("n"), F.max("out").alias("o"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("o and lo <> hi")
    lists = written(lists.select("k", "t", "n", F.ceil(F.col("n") / LIST).cast("int").alias("salts")), folder, "lists")
    good = written(join_counted(posts, lists, ["k", "t"], "n"), folder, "listed")
    here = _blocks(good.filter("out")).select("k", "t", "salt", *(F.col(c).alias(f"{c}1") for c in ("v", "x", "d", "c", "i")))
    there = good.withColumn("salt", F.pmod(F.xxhash64("v"), F.col("salts")).cast("int")).select("k", "t", "salt", "v", "x", "d", "c", "i", "out")
    # of a pair that is outside on both sides one order; and as many deviations behind this one as are still wanted
    apart = "c <> c1 and not (out and v < v1)"
    enough = (F.least(F.col("d") - F.col("i"), F.col("d1") - F.col("i1")) * twice) >= F.col("x") + F.col("x1")
    pairs = here.join(there, ["k", "t", "salt"]).filter(apart).filter(enough)
    return pairs.select(F.least("v", "v1").alias("a"), F.greatest("v", "v1").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (least id reachable), kept (doc_id = component_id).

    Two sets of shingles are linked if their similarity is at least percent / 100.

    A null, empty or blank text has no shingle and is linked with nothing: its component is its own id. Repeated rows
    are copies of one another. A null id is kept, never the name of a component, and not `kept`, unless nothing else
    is in its component (component_id null, kept true). Other columns are not read.
    """
    spark = docs.sparkSession
    folder = scratch(spark)
    how = setting(percent)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = written(describe(texts), folder, "rows")
    # of each distinct set the least id (its text is read again for confirming) and the tokens
    vertices = written(rows.filter("v is not null").groupBy("v").agg(F.min(F.struct("doc_id", "tokens")).alias("x"), F.min("doc_id").alias("least"), F.count("*").alias("n")).select("v", "n", "least", F.col("x.doc_id").alias("doc_id"), F.col("x.tokens").alias("tokens")), folder, "vertices")
    nodes, large = nodes_of(vertices.select("v", "tokens"), folder, how)

    # a vertex's text: that of the row with its id; a null id has its text found by its set
    def with_v(batches):
        for batch in batches:
            for a, b, t in _texts(batch):
                s = shingles(*words(t), WORDS)
                v = [mix(np.add.reduce(mix(x ^ np.uint64(0x5BD1E995)), keepdims=True) + np.uint64(len(x))).view(np.int64)[0] if len(x) else None for x in s]
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), batch.column(1).slice(a, b - a)], names=["v", "text"])

    members = nodes.select("v").unionAll(large.select("v")).distinct()
    wanted = vertices.join(members, "v", "left_semi").select("v", "doc_id")
    sources = texts.join(wanted.filter("doc_id is not null").select("doc_id"), "doc_id", "left_semi").unionAll(texts.filter("doc_id is null"))
    read = written(sources.mapInArrow(with_v, "v long, text string").filter("v is not null").join(wanted, "v", "left_semi").dropDuplicates(["v"]), folder, "texts")
    first = confirm(compare(nodes, True, how.likely), read, folder, "forest", percent)
    crowded = not large.isEmpty()
    if crowded:
        crowd = gather(large, folder)
        sets = written(read.join(crowd, "v").select("k", "salt", "salts", "v", "text").mapInArrow(_sets, "k long, salt int, salts int, v long, s array<long>"), folder, "crowdsets")
        linked, star, centres = stars(sets, folder, percent)
        first = first.unionAll(linked)
    part = written(components(first, folder, "ca"), folder, "parts")
    again = nodes.join(part, "v", "left").select("path", "v", "tokens", F.coalesce("c", "v").alias("c"))
    mixed = again.groupBy("path").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("path")
    pairs = compare(again.join(mixed, "path", "left_semi"), False, how.likely).join(first, ["a", "b"], "left_anti")
    if crowded:
        pairs = pairs.unionAll(candidates(sets, star, centres, part, folder, percent)).distinct()
    second = confirm(pairs, read, folder, "rest", percent)
    # a component's least id, by vertices; then that of components which the second links join; then each vertex's
    named = written(vertices.select("v", "n", "least").join(part, "v", "left").withColumn("g", F.coalesce("c", "v")).drop("c"), folder, "named")
    ends = second.join(part.select(F.col("v").alias("a"), F.col("c").alias("ca")), "a", "left").join(part.select(F.col("v").alias("b"), F.col("c").alias("cb")), "b", "left")
    joined = components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), folder, "cb").select(F.col("v").alias("g"), "c")
    least = named.groupBy("g").agg(F.min("least").alias("least"), F.count("*").alias("m"))
    least = written(least.join(joined, "g", "left").withColumn("c", F.coalesce("c", "g")), folder, "least")
    most = written(least.groupBy("c").agg(F.min("least").alias("component_id"), F.count("*").alias("k")), folder, "most")
    least = written(join_counted(least, most, ["c"], "k").select("g", "m", "component_id"), folder, "ids")
    names = written(join_counted(named, least, ["g"], "m").select("v", "n", "component_id"), folder, "names")
    remove(spark, folder, "rows", "names")
    out = join_counted(rows.select("v", "doc_id", "n_shingles"), names, ["v"], "n").drop("v")
    out = out.unionByName(rows.filter("v is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"))


def _sets(batches):
    """The set of shingles, as an array, in place of the text."""
    for batch in batches:
        for a, b, t in _texts(batch):
            found = shingles(*words(t), WORDS)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            s = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(4)), s], names=["k", "salt", "salts", "v", "s"])
