"""Queries of embeddings: every row's image vector, and as its text vector that of the next id."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import retrieval as R
from quillspark.plans.registry import query
from quillspark.sources.tables import table

#: Ids of a training batch.
BATCH = 64
_UNIT = "u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM (SELECT vec_id, label, embedding::DOUBLE[] AS embedding FROM embeddings))"
_SIDES = f"WITH {_UNIT}, a AS (SELECT vec_id AS i, v FROM u), b AS (SELECT vec_id - 1 AS j, v FROM u)"
_SIM = f"{_SIDES}, s AS (SELECT i // {BATCH} AS batch, i, j, list_dot_product(a.v, b.v) AS sim FROM a JOIN b ON i // {BATCH} = j // {BATCH} AND j >= 0)"
_RANK = f"{_SIDES}, s AS (SELECT i, j, round(list_dot_product(a.v, b.v), 9) AS sim FROM a, b), m AS (SELECT i AS k, sim AS own FROM s WHERE i = j), r AS (SELECT i, count(*) FILTER (sim > own OR (sim = own AND j < i)) + 1 AS rank FROM s JOIN m ON i = k WHERE j IN (SELECT k FROM m) GROUP BY i), q AS (SELECT j, count(*) FILTER (sim > own OR (sim = own AND i < j)) + 1 AS back FROM s JOIN m ON j = k WHERE i IN (SELECT k FROM m) GROUP BY j)"


@query(f"WITH {_UNIT} SELECT vec_id, round(list_sum(v), 6) AS total, round(list_dot_product(v, v), 6) AS norm FROM u")
def l2_normalise(spark, d):
    u = R.normalised(table(spark, d, "embeddings"), "embedding").withColumnRenamed("embedding", "v")
    return u.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(R.dot(F.col("v"), F.col("v")), 6).alias("norm"))


@query(f"{_SIM} SELECT batch, i, j, round(sim, 6) AS sim FROM s")
def similarity_matrix(spark, d):
    """The matrices of all batches."""
    return R.batches(table(spark, d, "embeddings"), BATCH).select("batch", "i", "j", F.round("sim", 6).alias("sim"))


@query(f"{_SIDES}, s AS (SELECT i, j, round(list_dot_product(a.v, b.v), 9) AS sim FROM a, b) SELECT i, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS rank, j, round(sim, 6) AS sim FROM s QUALIFY rank <= 10")
def topk_retrieval(spark, d):
    """The ten best matches of every row among all."""
    return R.nearest(*R.sides(table(spark, d, "embeddings")), 10).select("i", F.col("rank").cast("long").alias("rank"), "j", F.round("sim", 6).alias("sim"))


@query(f"{_RANK} SELECT i, rank AS image_to_text, back AS text_to_image FROM r JOIN q ON i = j")
def match_rank(spark, d):
    r = R.match_ranks(*R.sides(table(spark, d, "embeddings")))
    return r.select("i", F.col("rank").alias("image_to_text"), F.col("back").alias("text_to_image"))


@query(f"{_RANK} SELECT round(avg((rank <= 1)::INT), 6) AS recall_1, round(avg((rank <= 5)::INT), 6) AS recall_5, round(avg((rank <= 10)::INT), 6) AS recall_10 FROM r")
def recall_at_k(spark, d):
    r = R.match_ranks(*R.sides(table(spark, d, "embeddings")))
    return r.agg(*(F.round(F.avg((F.col("rank") <= k).cast("int")), 6).alias(f"recall_{k}") for k in (1, 5, 10)))


@query(f"{_SIM}, z AS (SELECT batch, i, j, sim / 0.07 AS z FROM s), zi AS (SELECT batch, i, ln(sum(exp(z))) AS l FROM z GROUP BY ALL), zj AS (SELECT batch, j, ln(sum(exp(z))) AS l FROM z GROUP BY ALL) SELECT z.batch, round((avg(zi.l - z) + avg(zj.l - z)) / 2, 5) AS loss FROM z JOIN zi USING (batch, i) JOIN zj USING (batch, j) WHERE i = j GROUP BY z.batch")
def contrastive_loss(spark, d):
    return R.contrastive_loss(R.batches(table(spark, d, "embeddings"), BATCH), 0.07)


@query()
def image_augmentation(spark, d):
    """Vectors as 8 x 8 one-channel images, each changed twice by draws of its own."""
    from quillspark.operators import image

    x = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.least(F.greatest(v / 2 + 0.5, F.lit(0.0)), F.lit(1.0)).cast("float")).alias("pixels"))
    return image.augmented(x, "vec_id", "pixels", (8, 8, 1), 2)


@query("SELECT len(p)::INT AS n_values, count(*) AS n_images, min(list_min(p)) AS low, max(list_max(p)) AS high, round(100 * sum(len(list_filter(p, lambda x: x <> 0))) / sum(len(p)), 6) AS non_zero_pct FROM (SELECT list_transform(embedding, lambda x: greatest(x, 0)::FLOAT) AS p FROM embeddings) GROUP BY 1")
def image_stats(spark, d):
    """Shapes and ranges of images, as which vectors without their negative parts stand."""
    from quillspark.operators import image

    x = table(spark, d, "embeddings").select(F.transform("embedding", lambda v: F.greatest(v, F.lit(0.0).cast("float"))).alias("pixels"))
    return image.stats(x, "pixels")
