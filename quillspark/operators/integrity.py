"""A manifest (id, expected) against what was processed (id, actual)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def violations(manifest: DataFrame, processed: DataFrame) -> DataFrame:
    """(id, expected, actual) where the two differ."""
    return manifest.join(processed, "id").filter("expected <> actual").select("id", "expected", "actual")


def cross_check(manifest: DataFrame, processed: DataFrame, full: int = 99, sampled: int = 95) -> DataFrame:
    """One row: counts of expected, processed, matched, missing, extra and misplaced ids, two shares, and whether both reach `full` and `sampled` percent."""
    j = manifest.join(processed, "id", "full")
    e, a = F.col("expected").isNotNull(), F.col("actual").isNotNull()
    n = j.agg(F.count_if(e).alias("expected_n"), F.count_if(a).alias("processed_n"), F.count_if(e & a).alias("matched"), F.count_if(e & ~a).alias("missing"), F.count_if(a & ~e).alias("extra"), F.count_if(F.col("expected") != F.col("actual")).alias("misplaced"))
    k, ok = F.col("matched"), F.col("matched") - F.col("misplaced")
    share = lambda x, y: F.round(100 * x / F.nullif(y, F.lit(0)), 6)
    passes = lambda t: (100 * k >= t * F.col("expected_n")) & (100 * ok >= t * k)
    return n.select("*", share(k, F.col("expected_n")).alias("consistency_pct"), share(ok, k).alias("split_accuracy_pct"), passes(full).alias("passes_full"), passes(sampled).alias("passes_sample"))
