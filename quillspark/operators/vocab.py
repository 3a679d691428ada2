"""Vocabularies: fit, build, extend, encode, decode, coverage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.numbering import positions
from quillspark.sources.tables import kept

SPECIALS = ["<pad>", "<unk>", "<start>", "<end>"]


def counts(df: DataFrame, tokens: Column, by: list[str] | None = None, order: Column | None = None) -> DataFrame:
    """(by..., token, freq), and with order, a number that orders rows, (first_row, first_pos): where a token is first seen."""
    by = by or []
    if order is None:
        return df.select(*by, F.explode(tokens).alias("token")).groupBy(*by, "token").agg(F.count("*").alias("freq"))
    found = df.select(*by, order.alias("__o"), F.posexplode(tokens).alias("__p", "token")).groupBy(*by, "token")
    return found.agg(F.count("*").alias("freq"), F.min(F.struct("__o", "__p")).alias("x")).select(*by, "token", "freq", F.col("x.__o").alias("first_row"), F.col("x.__p").alias("first_pos"))


def ranked(freq: DataFrame, first_id: int = 1) -> DataFrame:
    """freq with `id` in the order of (freq descending, first seen), or (freq descending, token) where that is not known."""
    if "first_row" in freq.columns:
        out = positions(freq, [(F.col("freq"), False), (F.floor(F.col("first_row") / 1000), True)], [F.col("first_row"), F.col("first_pos")], name="id")
    else:
        out = positions(freq, [(F.col("freq"), False), (F.substring("token", 1, 2), True)], [F.col("token")], name="id")
    return out.withColumn("id", F.col("id") + (first_id - 1))


def fitted(freq: DataFrame) -> DataFrame:
    """1 is the unknown word, words from 2, 0 the fill."""
    return ranked(freq, 2)


def fit(freq: DataFrame, loaded: DataFrame | None = None) -> DataFrame:
    """(token, id): a vocabulary that was loaded is kept as it is, else the words counted are numbered."""
    return loaded.select("token", "id") if loaded is not None else fitted(freq).select("token", "id")


def built(freq: DataFrame, min_freq: int = 5, cap: int | None = 1500) -> DataFrame:
    """(token, freq, id, is_special): four specials, then the words that are frequent enough, at most cap of them."""
    words = ranked(freq.filter(F.col("freq") >= min_freq), len(SPECIALS))
    if cap is not None:
        words = words.filter(F.col("id") < len(SPECIALS) + cap)
    words = words.drop("first_row", "first_pos")
    special = freq.sparkSession.createDataFrame([(t, 0, i, True) for i, t in enumerate(SPECIALS)], "token string, freq long, id long, is_special boolean")
    return special.unionByName(words.withColumn("is_special", F.lit(False)))


def extended(vocab: DataFrame, terms: DataFrame) -> DataFrame:
    """vocab and the terms it lacks, sorted, behind its last id; `reachable`: a white-space encoder can produce the token."""
    new = terms.select(F.col("term").alias("token")).distinct().join(vocab, "token", "left_anti")
    top = vocab.agg(F.max("id").alias("top"))
    new = positions(new, [(F.substring("token", 1, 2), True)], [F.col("token")], name="n").crossJoin(F.broadcast(top)).select("token", (F.col("top") + F.col("n")).alias("id"))
    out = vocab.select("token", "id").unionByName(new)
    return out.withColumn("reachable", ~F.contains("token", F.lit(" ")))


def _shared(vocab: DataFrame, most: int):
    """The first `most` words of a vocabulary (by id, that is by frequency), sent to all executors, and the rest as a table, or None.

    One pass over the vocabulary: one row more than are sent says whether there is a rest.
    """
    plain = vocab.select("token", F.col("id").cast("int").alias("id"))
    head = plain.orderBy("id").limit(most + 1).toArrow()
    rest = plain.filter(F.col("id") >= head["id"][most].as_py()) if head.num_rows > most else None
    head = head.slice(0, most)
    return vocab.sparkSession.sparkContext.broadcast((head["token"].combine_chunks(), head["id"].combine_chunks())), rest


def _mapped(column: pa.ListArray, known: pa.Array, values: pa.Array) -> pa.ListArray:
    """Each element's value, null where it is not known; null lists become empty. One hash look-up for a whole batch."""
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy())]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pc.take(values, pc.index_in(column.flatten(), value_set=known)))


def encode(df: DataFrame, key: str, tokens: Column, vocab: DataFrame, unknown: int = 1, most: int = 200_000) -> DataFrame:
    """(key, ids), one row per row of df; a row without tokens has an empty array.

    The `most` first words are looked up in place, batch by batch, without a shuffle. Of a larger vocabulary the words
    behind them, none of which is frequent, are joined.
    """
    shared, rest = _shared(vocab, most)
    extra = [] if rest is None else ["__t"]  # the words come back only where some of them are looked up elsewhere

    def run(batches):
        known, ids = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _mapped(b.column(1), known, ids), *(b.column(1) for _ in extra)], names=[key, "ids", *extra])

    rows = df.select(key, tokens.alias("__t"))
    kind = rows.schema[key].dataType.simpleString()
    got = rows.mapInArrow(run, f"`{key}` {kind}, ids array<int>" + ", __t array<string>" * len(extra))
    if rest is not None:
        got = _rest(got, "ids", rest, "token", "id")
    return got.select(key, F.transform("ids", lambda x: F.coalesce(x, F.lit(unknown))).alias("ids"))


def _rest(got: DataFrame, column: str, rest: DataFrame, key: str, value: str) -> DataFrame:
    """got with the null elements of a column of arrays looked up in rest (key, value), by what stands in `__t` at their places.

    Rows are numbered and written down first, so that both readings of them see the same numbers.
    """
    got = kept(got.withColumn("__row", F.monotonically_increasing_id()))
    cells = F.filter(F.arrays_zip(F.col(column).alias("v"), F.col("__t").alias("t"), F.sequence(F.lit(0), F.size(column) - 1).alias("p")), lambda x: x["v"].isNull())
    away = got.filter(F.exists(column, lambda x: x.isNull())).select("__row", F.explode(cells).alias("c")).select("__row", F.col("c.p").alias("p"), F.col("c.t").alias(key))
    found = away.join(rest.select(key, F.col(value).alias("__v")), key).groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("p", "__v"))).alias("__found"))
    filled = F.transform(column, lambda x, i: F.coalesce(x, F.try_element_at(F.col("__found"), i)))
    return got.join(found, "__row", "left").withColumn(column, F.when(F.col("__found").isNull(), F.col(column)).otherwise(filled))


def decode(df: DataFrame, key: str, ids: Column, vocab: DataFrame, most: int = 200_000) -> DataFrame:
    """(key, text), one row per row of df: fills, specials and unknown ids dropped. Words behind the `most` first ones are joined, as in encode."""
    words = vocab.filter(~F.col("is_special")) if "is_special" in vocab.columns else vocab
    shared, rest = _shared(words, most)
    extra = [] if rest is None else ["__t"]

    def run(batches):
        known, found = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _mapped(b.column(1), found, known), *(b.column(1) for _ in extra)], names=[key, "__w", *extra])

    rows = df.select(key, F.filter(ids, lambda x: x != 0).cast("array<int>").alias("__t"))
    got = rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, __w array<string>" + ", __t array<int>" * len(extra))
    if rest is not None:
        got = _rest(got, "__w", rest, "id", "token")
    return got.select(key, F.array_join("__w", " ").alias("text"))


def of_ids(df: DataFrame, ids: Column, vocab: DataFrame) -> DataFrame:
    """(token, freq) of encoded rows, by the vocabulary they were encoded with; fills do not count."""
    n = df.select(F.explode(ids).alias("id")).filter("id <> 0").groupBy("id").agg(F.count("*").alias("freq"))
    return n.join(vocab.select(F.col("id").cast("int").alias("id"), "token"), "id").select("token", "freq")


def coverage(encoded: DataFrame, by: str, unknown: int = 1) -> DataFrame:
    """(by, tokens, oov, coverage_pct, oov_pct) of encoded rows (by, ids)."""
    out = F.size(F.filter("ids", lambda x: x == unknown))
    g = encoded.groupBy(by).agg(F.sum(F.size("ids")).alias("tokens"), F.sum(out).alias("oov"))
    pct = lambda c: F.round(100 * c / F.nullif(F.col("tokens"), F.lit(0)), 6)
    return g.select(by, "tokens", "oov", pct(F.col("tokens") - F.col("oov")).alias("coverage_pct"), pct(F.col("oov")).alias("oov_pct"))


def covered(freq: DataFrame, by: str, corpus: str) -> DataFrame:
    """The columns of `coverage` for the words of every corpus of a table (by, token, freq), under the vocabulary of one of them.

    One pass over the counts: a word's rows, one a corpus, come together and say whether that corpus is among them.
    """
    words = freq.groupBy("token").agg(F.coalesce(F.bool_or(F.col(by) == corpus), F.lit(False)).alias("known"), F.collect_list(F.struct(by, "freq")).alias("x"))
    g = words.select("known", F.inline("x")).groupBy(by).agg(F.sum("freq").alias("tokens"), F.sum(F.when(F.col("known"), 0).otherwise(F.col("freq"))).alias("oov"))
    pct = lambda c: F.round(100 * c / F.col("tokens"), 6)
    return g.select(by, "tokens", "oov", pct(F.col("tokens") - F.col("oov")).alias("coverage_pct"), pct(F.col("oov")).alias("oov_pct"))


def frequent(freq: DataFrame, most: int) -> int:
    """The least count that no more than `most` words of a table (token, freq) reach. Counts are of few kinds: n words have about the root of 2n at most."""
    kinds = freq.groupBy("freq").agg(F.count("*").alias("n")).orderBy(F.desc("freq")).collect()
    total, least = 0, (kinds[0]["freq"] if kinds else 0) + 1
    for r in kinds:
        total += r["n"]
        if total > most:
            break
        least = r["freq"]
    return least


def hits(df: DataFrame, key: str, tokens: Column, whole: Column, most: int = 200_000) -> DataFrame:
    """(key, n, hit) of rows with tokens: how many there are, and how many are words of the rows where `whole` holds.

    Words are counted once. The `most` most frequent of all rows are looked up in place, whether they are known or not;
    of the others, none of which is frequent, those that are known and stand more than once are joined.
    """
    rows = df.select(F.col(key).alias("key"), F.coalesce(whole, F.lit(False)).alias("whole"), tokens.alias("t"))
    words = kept(rows.select("whole", F.explode("t").alias("token")).groupBy("token").agg(F.count("*").alias("freq"), F.bool_or("whole").alias("known")))
    least = frequent(words, most)
    head = words.filter(F.col("freq") >= least).select("token", "known").toArrow()
    shared = df.sparkSession.sparkContext.broadcast((head["token"].combine_chunks(), head["known"].combine_chunks()))

    def run(batches):
        known, flags = shared.value
        for b in batches:
            n = pc.fill_null(pc.list_value_length(b.column(2)), 0)
            flat, owner = b.column(2).flatten(), pc.list_parent_indices(b.column(2))
            found = pc.take(flags, pc.index_in(flat, value_set=known))
            good = np.bincount(owner.to_numpy().astype(np.int64)[pc.fill_null(found, False).to_numpy(zero_copy_only=False)], minlength=b.num_rows)
            rest = pc.and_(pc.is_null(found), pc.invert(pc.take(b.column(1), owner)))  # rows where whole holds have no others
            at = np.concatenate([[0], np.cumsum(np.bincount(owner.filter(rest).to_numpy().astype(np.int64), minlength=b.num_rows))]).astype(np.int32)
            hit = pc.if_else(b.column(1), n, pa.array(good.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), n, hit, pa.ListArray.from_arrays(pa.array(at), flat.filter(rest))], names=["key", "n", "hit", "rest"])

    got = kept(rows.filter(F.size("t") > 0).mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, n int, hit int, rest array<string>"))
    tail = words.filter((F.col("freq") < least) & (F.col("freq") > 1) & F.col("known")).select("token")
    more = got.select("key", F.explode("rest").alias("token")).join(tail, "token").groupBy("key").agg(F.count("*").alias("more"))
    sums = got.groupBy("key").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit")).alias("s")
    j = sums.join(more.alias("m"), F.col("s.key").eqNullSafe(F.col("m.key")), "left")
    return j.select(F.col("s.key").alias(key), "n", (F.col("hit") + F.coalesce("more", F.lit(0))).alias("hit"))


def compared(freq: DataFrame, by: str) -> DataFrame:
    """Sizes, overlap and shares of the vocabularies of every two corpora of a table (by, token, freq).

    Overlaps are counted by words: each gives the pairs of the corpora that have it, which are few.
    """
    freq = kept(freq)
    sizes = freq.groupBy(by).agg(F.count("*").alias("n"))
    have = freq.groupBy("token").agg(F.array_sort(F.collect_set(by)).alias("s")).filter(F.size("s") > 1)
    pairs = have.select(F.posexplode("s").alias("i", "a"), "s").select("a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b")).groupBy("a", "b").agg(F.count("*").alias("k"))
    one, two = sizes.toDF(f"{by}_1", "vocab_1"), sizes.toDF(f"{by}_2", "vocab_2")
    j = one.join(F.broadcast(two), F.col(f"{by}_1") < F.col(f"{by}_2"))  # a row for each corpus
    j = j.join(pairs.toDF(f"{by}_1", f"{by}_2", "k"), [f"{by}_1", f"{by}_2"], "left").fillna(0, ["k"])
    a, b, k = F.col("vocab_1"), F.col("vocab_2"), F.col("k")
    return j.select(f"{by}_1", f"{by}_2", "vocab_1", "vocab_2", k.alias("overlap"), (a + b - k).alias("union_size"), (a - k).alias("only_1"), (b - k).alias("only_2"), F.round(100 * k / F.least(a, b), 6).alias("overlap_pct"), F.round(100 * (a - k) / a, 6).alias("unique_1_pct"), F.round(100 * (b - k) / b, 6).alias("unique_2_pct"), F.round(k / (a + b - k), 6).alias("jaccard"))


def problems(vocab: DataFrame) -> DataFrame:
    """(problem, n): repeated ids, repeated tokens, missing specials."""
    twice = lambda c: vocab.groupBy(c).agg(F.count("*").alias("k")).filter("k > 1").agg(F.count("*").alias("n")).select(F.lit(f"repeated {c}").alias("problem"), "n")
    have = vocab.filter(F.col("token").isin(SPECIALS)).agg((F.lit(len(SPECIALS)) - F.countDistinct("token")).alias("n")).select(F.lit("missing special").alias("problem"), "n")
    return twice("id").unionByName(twice("token")).unionByName(have)
