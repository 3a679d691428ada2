"""Benchmark decontamination: short test items found inside long documents, by containment of word shingles.

Size-partitioned MinHash containment search, of DataFrame operations only. An item's signature are its smallest shingle
hashes. Items are partitioned by size (powers of two of their shingle count); a partition whose items have up to U
shingles takes floor((1 - threshold) * U) + 1 minima, and an item of k shingles is a candidate where at least
minima - floor((1 - threshold) * k) of them occur. As a document that contains a share `threshold` of an item misses at
most floor((1 - threshold) * k) of its shingles, no such pair is lost. The document side is not sampled, so its length
does not matter. Candidates are then verified on all shingles of the item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import scratch, written

WORDS, THRESHOLD = 5, 0.8
#: Signatures, items' shingles and candidates' ids up to so many rows (24 bytes or less each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null: none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def with_shingles(rows: DataFrame, text: str, n: int = WORDS) -> DataFrame:
    """Adds `__h`: a 64-bit hash for each n-word shingle; of fewer words, one for the whole sequence; without words, none."""
    rows = rows.withColumn("__w", words_of(F.col(text)))
    w = F.col("__w")
    heads = F.arrays_zip(*(F.slice(w, F.lit(k + 1), F.greatest(F.size(w) - (n - 1), F.lit(0))).alias(f"w{k}") for k in range(n)))
    grams = F.transform(heads, lambda x: F.xxhash64(*(x[f"w{k}"] for k in range(n))))  # no outer column inside: it would be made anew for each element
    return rows.withColumn("__h", F.when(F.size(w) >= n, grams).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))).drop("__w")


#: Into so many parts a shingle's documents are dealt where items are too many to be broadcast.
PARTS = 32


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def _meet(shingles: DataFrame, side: DataFrame, n: int) -> DataFrame:
    """Joins (doc_id, h) with (h, ...): by a broadcast, or by a shuffle in which a frequent shingle is dealt out by document."""
    if n <= BROADCAST_ROWS:
        return shingles.join(F.broadcast(side), "h")
    dealt = side.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return shingles.withColumn("__part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")).join(dealt, ["h", "__part"]).drop("__part")


def find_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, n: int = WORDS, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment) for each document that holds a share `threshold` or more of an item's distinct shingles.

    Rows with a null id take no part; rows with the same id count as one text each joined in one set. Items and documents
    without words match nothing; an item of fewer than n words matches a text of just these words. Other columns are
    not read.
    """
    folder = scratch(docs.sparkSession)
    items = with_shingles(items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).filter("item_id is not null"), "text", n)
    grams = items.select("item_id", F.explode("__h").alias("h")).distinct()
    sets = grams.groupBy("item_id").agg(F.array_sort(F.collect_set("h")).alias("hs")).withColumn("k", F.size("hs"))
    miss = 1 - threshold + 1e-9
    upper = F.pow(F.lit(2), F.ceil(F.log2(F.col("k").cast("double"))))
    sets = sets.withColumn("minima", F.least(F.col("k"), (F.floor(upper * miss) + 1).cast("int"))).withColumn("least", (F.col("minima") - F.floor(F.col("k") * miss)).cast("int"))
    sets = written(sets, folder, "items")
    sketch = sets.select("item_id", "least", F.explode(F.slice("hs", F.lit(1), F.col("minima"))).alias("h"))
    sizes = sets.agg(F.sum("minima"), F.sum("k")).first()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    # not explode(): from it a filter on the shingles is inferred, which is pushed below the joins and makes them all once more
    shingles = with_shingles(texts, "text", n).select("doc_id", F.explode_outer("__h").alias("h"))
    hits = _meet(shingles, sketch, sizes[0] or 0)
    found = hits.groupBy("doc_id", "item_id", "least").agg(F.countDistinct("h").alias("hits")).filter("hits >= least").select("doc_id", "item_id")
    found = written(found, folder, "candidates")
    pairs = found.count()
    again = texts.join(_small(found.select("doc_id").distinct(), pairs), "doc_id", "left_semi")
    parts = with_shingles(again, "text", n).select("doc_id", F.explode_outer("__h").alias("h"))
    wanted = sets.join(_small(found.select("item_id").distinct(), pairs), "item_id", "left_semi").select("item_id", F.col("k").cast("long").alias("n_shingles"), F.explode("hs").alias("h"))
    shared = _meet(parts, wanted, sizes[1] or 0).groupBy("doc_id", "item_id", "n_shingles").agg(F.countDistinct("h").alias("n_found"))
    return shared.withColumn("containment", F.col("n_found") / F.col("n_shingles")).filter(F.col("containment") >= threshold).join(found, ["doc_id", "item_id"], "left_semi")


SQL = r"""
WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT item_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
ds AS (SELECT DISTINCT id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT id, w, unnest(generate_series(1, greatest(len(w) - 4, least(len(w), 1)))) AS i FROM d)),
bs AS (SELECT DISTINCT id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT id, w, unnest(generate_series(1, greatest(len(w) - 4, least(len(w), 1)))) AS i FROM b)),
k AS (SELECT id, count(*) AS n FROM bs GROUP BY id)
SELECT ds.id AS doc_id, bs.id AS item_id, k.n::BIGINT AS n_shingles, count(*)::BIGINT AS n_found, count(*) / k.n AS containment
FROM bs JOIN ds ON bs.s = ds.s JOIN k ON k.id = bs.id
GROUP BY ds.id, bs.id, k.n HAVING count(*) / k.n >= 0.8
"""
