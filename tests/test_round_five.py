"""What the findings of round four named: odd texts, and the whole job on larger tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import augment, similarity
from quillspark.plans import registry
from tests.oracle import compare
from tests.test_round_four import documents, folder_of

# F3


def test_texts_without_words_count_in_sequence_metrics_as_in_the_sql(spark, tmp_path):
    d = folder_of(tmp_path, documents=documents("a b a", "x y", "q q", "", "x", " \t\n", "c d", "x z z"))  # an empty text in en, a blank one in de, none in fr
    got = registry.QUERIES["sequence_metrics"](spark, d)
    rows = {r["lang"]: r for r in got.collect()}
    assert rows["en"]["use_mean"] == 0.333333 and [math.isnan(rows[x]["density_mean"] or 0) for x in ("en", "de", "fr")] == [True, True, False]
    compare(got, registry.ORACLE_SQL["sequence_metrics"], d, str(tmp_path / "out"))


# F4


def test_sentences_that_no_step_may_change_are_told_apart_and_the_variants_stay_the_same(spark, monkeypatch):
    plain = ["Nothing north, noon.", "Abc def ghi.", "No.", "  wide  space　x.", "snow nose."]
    live = ["No x.", "x (no) y.", "OPACITY.", "xABNORMAL.", "There are x.", "x Is Seen.", "cannot exclude x.", "mild.", "Know no: x.", *(f"a {x} b." for x in augment.SYNONYMS)]
    df = spark.createDataFrame([(x,) for x in plain + live], "x string")
    assert {r[0] for r in df.filter(augment.may_change(F.col("x"))).collect()} == {*live, "No."}
    rows = spark.createDataFrame([(i, " ".join([*(plain + live)[i:], *plain])) for i in range(len(plain + live))], "k long, text string")
    want = augment.variants(rows, "k", "text", 3).collect()
    monkeypatch.setattr(augment, "may_change", lambda s: s.isNotNull())
    assert augment.variants(rows, "k", "text", 3).collect() == want and len({r["text"] for r in want}) > len(live)


def test_quality_from_one_pass_equals_that_of_a_join(spark):
    rows = spark.createDataFrame([(1, "no x. mild x. b"), (2, ""), (3, None), (4, "　a  a\x1cNo severe opacity. y "), (5, " ")], "k long, text string")
    made = augment.variants(rows.withColumn("s", F.col("text")), "k", "text", 3, carry=("s",)).filter("s is not null")
    beside = augment.quality_beside(made, "s")
    assert beside.collect()[0].asDict() == augment.quality(rows.filter("text is not null"), made, "k", "text").collect()[0].asDict()
    plan = beside._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "array_intersect" not in plan


# F2


def test_blocks_of_sets_give_the_likeness_of_every_pair(spark, monkeypatch):
    r = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in r.integers(0, r.choice([4, 30, 300]), r.integers(1, 200))) for _ in range(60)] + ["", " ", None, "  w1　w1 w2\x1c", " ".join(f"w{i}" for i in range(128))]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string").repartition(3)
    made = rows.select(F.concat(F.lit("v"), "k").alias("aug_id"), "text")
    words = lambda c: F.array_distinct(augment._words(F.col(c)))
    plain = rows.select("k", words("text").alias("a")).crossJoin(made.select("aug_id", words("text").alias("z"))).select("k", "aug_id", F.round(T.jaccard(F.col("a"), F.col("z")), 6))
    want = {(k, v, s) for k, v, s in plain.collect()}
    for blocks, dense, at_once in (((512, 2500), 200, 4_000_000), ((7, 11), 0, 10), ((9, 5), 10**9, 10), ((20, 30), 5, 50)):
        for name, x in zip(("ORIGINALS", "VARIANTS", "DENSE", "AT_ONCE", "OUT"), (*blocks, dense, at_once, 40)):
            monkeypatch.setattr(augment, name, x)
        got = augment.against(rows, made, "k", "text")
        assert got.columns == ["original", "variant", "similarity"]
        assert sorted(map(str, got.collect())) == sorted(f"Row(original={k}, variant={v!r}, similarity={s!r})" for k, v, s in want) and len(want) == len(texts) ** 2
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "array_intersect" not in plan


# F1


def test_similar_sets_move_as_numbers_and_their_words_are_deleted(spark, tmp_path):
    d = folder_of(tmp_path, documents=documents(*(f"No opacity {i % 5}. word{i % 7} x y z. mild q" for i in range(40))))
    got = registry.QUERIES["similar_variants"](spark, d)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "words" not in plan and got.count() > 0


@pytest.mark.parametrize("most", [10, 200, 3_000_000])
def test_rising_numbers_are_read_as_they_were_written(most):
    r = np.random.default_rng(most)
    for sizes in ([0], [0, 3, 0, 0, 5, 1], [4, 0], [7] * 50):
        rows = [np.sort(r.choice(most, n, replace=False)) for n in sizes]
        written = similarity._written(np.concatenate(rows).astype(np.int64), np.array(sizes))
        row, number = similarity._read(written)
        assert row.tolist() == np.repeat(np.arange(len(sizes)), sizes).tolist() and number.tolist() == np.concatenate(rows).tolist()
        assert similarity._read(written.slice(1))[1].tolist() == np.concatenate([*rows[1:], []]).tolist()
