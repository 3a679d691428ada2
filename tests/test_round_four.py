"""What the findings of round three named: odd texts, and the whole job on larger tables."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import augment, retrieval, similarity, vocab
from quillspark.plans import registry
from tests.oracle import compare


def folder_of(tmp_path, **tables):
    """A folder of tables, each given by the SQL of its rows."""
    for name, sql in tables.items():
        duckdb.connect().execute(f"copy ({sql}) to '{tmp_path}/{name}.parquet'")
    return str(tmp_path)


def documents(*texts):
    rows = ", ".join(f"({i}, $${t}$$, '{['en', 'fr', 'de'][i % 3]}', 's')" for i, t in enumerate(texts))
    return f"select doc_id::bigint as doc_id, text, lang, source, length(text)::bigint as n_chars from (values {rows}) v(doc_id, text, lang, source)"


# F2


def test_words_that_share_signs_are_rewritten_as_the_sql_does(spark, tmp_path):
    d = folder_of(tmp_path, documents=documents("No no. no", "no no no no no.", "chest x-ray-xray chest", "yes positive yes\nno\n", "negative no negative no", "no", "noé no_ no"))
    compare(registry.QUERIES["domain_tokenizer"](spark, d), registry.ORACLE_SQL["domain_tokenizer"], d, str(tmp_path / "out"))
    assert spark.createDataFrame([("No no. no",)], "x string").select(T.domain_tokens(F.col("x"))).first()[0] == ["negative", "negative.", "negative"]


# F3


def test_sentences_are_capitalized_letter_by_letter_as_the_sql_does(spark, tmp_path):
    heads = ["ßau Wort", "\u00a0x y\u3000", "ÉTÉ", "ŉa ΑΣ", "ᾳx İn", "ﬁx ΟΔΟΣ. ΑΣ ", "ǰ", "\u2003ß", "ᾼΣ", "", " "]
    d = folder_of(tmp_path, documents=documents(*(x for x in heads for _ in range(9))))
    compare(registry.QUERIES["sentence_restructure"](spark, d), registry.ORACLE_SQL["sentence_restructure"], d, str(tmp_path / "out"))


# F6, F8, F9


def vectors(spark, n, size=6, kinds=40):
    r = np.random.default_rng(3)
    v = r.normal(0, 1, (kinds, size))[r.integers(0, kinds, n)]  # many copies
    v[: n // 2] += r.normal(0, 1, (n // 2, size))
    return spark.createDataFrame([(int(i), x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")


def test_blocks_grow_with_the_rows_so_that_each_row_is_sent_equally_often(spark):
    sent = []
    for n in (40_000, 500_000):
        df = spark.range(n).select(F.col("id").alias("i"))
        sent.append(retrieval._dealt(df, "i", retrieval.COLUMNS, retrieval.BLOCK)[1])
    assert sent == [8, 8]


def test_ranks_and_nearest_in_small_blocks_equal_the_whole_matrix(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "ROWS", 37)
    monkeypatch.setattr(retrieval, "COLUMNS", 64)
    left, right = retrieval.sides(vectors(spark, 400))
    x, y = left.toPandas().sort_values("i"), right.toPandas().sort_values("j")
    s, i, j = np.round(np.stack(x["v"]) @ np.stack(y["w"]).T, 9), x["i"].to_numpy(), y["j"].to_numpy()
    want = {(int(i[r]), k + 1, int(j[c])) for r in range(len(i)) for k, c in enumerate(np.lexsort((j, -s[r]))[:10])}
    got = retrieval.nearest(left, right, 10, 100).collect()
    assert {(r["i"], r["rank"], r["j"]) for r in got} == want and len(got) == len(want)
    own = {int(k): s[np.flatnonzero(i == k)[0], np.flatnonzero(j == k)[0]] for k in set(i) & set(j)}
    ii, jj = np.isin(i, list(own)), np.isin(j, list(own))
    s, i, j = s[ii][:, jj], i[ii], j[jj]
    m = np.array([own[int(k)] for k in i])
    rank = ((s > m[:, None]) | ((s == m[:, None]) & (j[None] < i[:, None]))).sum(1) + 1
    back = ((s > m[None]) | ((s == m[None]) & (i[:, None] < j[None]))).sum(0) + 1
    assert {tuple(r) for r in retrieval.match_ranks(left, right, 100).collect()} == set(zip(i.tolist(), rank.tolist(), back.tolist()))


# F7, F10 to F13

ODD = ["a b c", "a  zz\u3000\u00a0yy\n", "", "  ", "a a b q q q", "zz \x1cw\u2003", "c d e", "none zz", "x"]


@pytest.mark.parametrize("name", ["report_coverage", "foreign_vocabulary", "difficulty_a", "difficulty_b", "augmentation_encoded", "augmentation_quality", "sample_variants", "similar_variants"])
def test_odd_texts_give_what_the_sql_gives(spark, tmp_path, name):
    long = " ".join(f"w{i % 150}" for i in range(400))
    d = folder_of(tmp_path, documents=documents(*ODD, long, long + " end. No opacity.  Mild effusion. x", *ODD))
    compare(registry.QUERIES[name](spark, d), registry.ORACLE_SQL[name], d, str(tmp_path / "out"))


@pytest.mark.parametrize("most", [0, 1, 3, 100])
def test_hits_whether_words_are_looked_up_in_place_or_joined(spark, most):
    rows = [(1, True, ["a", "b", "b", "c"]), (2, False, ["a", "z", "c", "c", "y"]), (3, None, ["b"]), (4, False, []), (None, False, ["q", "a"])]
    df = spark.createDataFrame(rows, "id long, en boolean, t array<string>")
    got = {tuple(r) for r in vocab.hits(df, "id", F.col("t"), F.col("en"), most).collect()}
    assert got == {(1, 4, 4), (2, 5, 3), (3, 1, 1), (None, 2, 1)}


def test_only_the_words_that_are_kept_are_encoded(spark):
    made = spark.createDataFrame([(1, 1, "x", "a " * 100_000)], "doc_id long, aug_no int, aug_id string, text string")
    v = spark.createDataFrame([("a", 5)], "token string, id long")
    e = augment.encoded(made, "doc_id", v, 4)
    assert e.first()["ids"] == [5] * 4
    assert "slice(" in e._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[1]


# F1, F5, F14


@pytest.mark.parametrize("most", [0, 5, 200_000])
def test_similar_pairs_are_all_found_and_only_prefixes_are_shuffled_by_word(spark, monkeypatch, most):
    monkeypatch.setattr(similarity, "MOST", most)
    r = np.random.default_rng(5)
    base = [set(r.choice(60, r.integers(1, 25), replace=False).tolist()) for _ in range(60)]
    rows = [(i, [f"w{x}" for x in sorted(base[i % 60] - set(r.choice(60, 4).tolist()))]) for i in range(180)]
    a, b = spark.createDataFrame(rows[:90], "k long, t array<string>"), spark.createDataFrame(rows[90:], "k long, t array<string>")
    got = {(x["left"], x["right"]) for x in similarity.similar_pairs(a, b, "k", "k", F.col("t"), F.col("t")).collect()}
    least = lambda part: {frozenset(t): min(k for k, u in part if set(u) == set(t)) for _, t in part if t}
    l, m = least(rows[:90]), least(rows[90:])
    assert got == {(l[x], m[y]) for x in l for y in m if 100 * len(x & y) >= 80 * len(x | y)} and got
    made = similarity._prefixes(spark.createDataFrame([(0, 2, ["a", "b"])], "id long, n int, words array<string>"), spark.sparkContext.broadcast((pa.array(["a"]), pa.array([3]))), 80)
    assert [tuple(x) for x in made.collect()] == [("b", 0, 0, 2)] and "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_quality_and_samples_move_no_texts(spark, sf):
    for name in ("augmentation_quality", "sample_variants"):
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("sentence") == 0 and plan.count("FileScan parquet") <= 2
    assert registry.QUERIES["augmentation_quality"](spark, sf)._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1


# F4


def test_every_twentieth_original_is_held_against_all_variants(spark, tmp_path):
    d = folder_of(tmp_path, documents=documents(*(f"No opacity {i}. word{i % 7} x" for i in range(61))))
    got = registry.QUERIES["pairwise_similarity"](spark, d)
    assert got.count() == 4 * 61 * 3 and {r[0] for r in got.select("original").distinct().collect()} == {0, 20, 40, 60}
    compare(got, registry.ORACLE_SQL["pairwise_similarity"], d, str(tmp_path / "out"))
