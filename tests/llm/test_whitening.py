"""Whitening against one eigendecomposition of the whole fit list, and over awkward rows."""

import numpy as np
import pytest

from quillspark.llm import queries, whitening
from quillspark.llm.whitening import Summary, summarize
from quillspark.sources.tables import table

FOLDER = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, x int, label int"


def plain(rows, components=16):
    """{(vec_id, component): (n, deviation, |whitened|, explained)} of lists of equal length, in plain numpy."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in rows]
    fit = np.array(sorted(set(map(tuple, x))), dtype=np.int64)
    n, s = len(fit), [int(t) for t in fit.sum(0)]
    centred = fit - fit.mean(0)
    e, vectors = np.linalg.eigh(centred.T @ centred / n)
    e, vectors = e[::-1], vectors[:, ::-1]
    k = min(components, int((e > e[0] * 1e-12).sum()))
    out = {}
    for (i, _), v in zip(rows, x):
        z = (np.array(v) - fit.mean(0)) @ vectors[:, :k] / np.sqrt(e[:k])
        deviation = sum((n * a - b) ** 2 for a, b in zip(v, s))
        for c in range(k):
            out[i, c + 1] = (n, deviation, abs(z[c]), e[c] / e.sum())
    return out


def check(got, want):
    assert len(got) == len(want) and {(r["vec_id"], r["component"]) for r in got} == want.keys()
    for r in got:
        n, deviation, z, share = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(r["whitened"]) == pytest.approx(z, abs=1e-6) and r["explained"] == pytest.approx(share, rel=1e-6)
        assert r["identity_error"] <= 1e-4
    assert len({r["identity_error"] for r in got}) <= 1


def test_whitening_of_embeddings(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, FOLDER, "embeddings").collect()]
    check(queries.op12_whitening(spark, FOLDER).collect(), plain(rows))


def test_signs_are_the_same_for_all_rows(spark):
    got = queries.op12_whitening(spark, FOLDER).filter("component <= 3").orderBy("component", "vec_id").collect()
    z = np.array([r["whitened"] for r in got]).reshape(3, -1)
    x = np.array([[np.floor(64 * float(c)) for c in r["embedding"]] for r in table(spark, FOLDER, "embeddings").orderBy("vec_id").collect()])
    axis = np.linalg.lstsq(np.c_[x, np.ones(len(x))], z.T, rcond=None)
    assert np.abs(np.c_[x, np.ones(len(x))] @ axis[0] - z.T).max() < 1e-6  # one linear map, so no row has a sign of its own


def test_awkward_vectors(spark):
    nan, inf, r = float("nan"), float("inf"), np.random.default_rng(3)
    good = [(i, (r.normal(size=5) * [9, 4, 2, 1, 0.3] + 1e6).tolist()) for i in range(70)]
    good += [(100 + i, [1e6] * 5) for i in range(40)] + [(200, (1e6 - 7 * np.arange(5.0)).tolist())]
    bad = [(300, None), (301, [nan] * 5), (302, [inf, 1.0, 1.0, 1.0, 1.0]), (303, [1.0, None, 1.0, 1.0, 1.0]), (304, []), (305, [1.0, 2.0]), (306, [1e300] * 5)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in good + bad], VECTORS).repartition(7)
    check(whitening.whiten(df).collect(), plain(good))


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (None, [1.0, 0.5]), (None, [1.0, 0.5]), (2, [-1.0, 4.0])]
    got = whitening.whiten(spark.createDataFrame([(i, v, 1, 1) for i, v in rows], VECTORS)).collect()
    assert len(got) == 10 and {r["n"] for r in got} == {3} and sum(r["vec_id"] is None for r in got) == 4
    flat = [(1, [0.0, 3.0, 0.0]), (2, [1.0, 3.0, -2.0]), (3, [2.0, 3.0, -4.0])]  # one line: one component
    got = whitening.whiten(spark.createDataFrame([(i, v, 1, 1) for i, v in flat], VECTORS)).collect()
    assert {r["component"] for r in got} == {1} and all(r["explained"] == pytest.approx(1) for r in got)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_whiten(spark, rows):
    got = whitening.whiten(spark.createDataFrame([(i, v, 1, 1) for i, v in rows], VECTORS))
    assert got.count() == 0 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_merging_loses_nothing():
    r = np.random.default_rng(5)
    x = (r.normal(size=(500, 7)) * 1000).astype(np.int64) + np.arange(7) * 10**12
    whole, parts = summarize(x), [summarize(y) for y in np.array_split(x, [3, 4, 90, 400])]
    found = parts[0]
    for p in parts[1:]:
        found = found.merge(p)
    again = Summary.unpacked(*found.packed().values())
    for s in (found, again):
        assert (s.n, s.sums) == (500, [int(t) for t in x.sum(0)])
        assert np.allclose(s.values, whole.values, rtol=1e-9)
        assert np.allclose(np.abs(np.diag(s.vectors @ whole.vectors.T)), 1, atol=1e-9)


def test_sums_beyond_64_bits_stay_exact():
    x = np.array([[1 << 61, 3], [(1 << 61) + 9, -(1 << 61)], [(1 << 61) - 5, 7]], np.int64)
    s = summarize(x)
    assert s.sums == [3 * (1 << 61) + 4, 10 - (1 << 61)]
    w = whitening.Whitener.of(s, 2)
    y = w.centred(x)
    assert y[0].tolist() == [3 * (1 << 61) - s.sums[0], 9 - s.sums[1]] and w.deviation(y)[0] is None


def test_many_partitions_meet_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    r = np.random.default_rng(6)
    rows = [(i, r.normal(size=4).tolist()) for i in range(400)]
    check(whitening.whiten(spark.createDataFrame([(i, v, 1, 1) for i, v in rows], VECTORS).repartition(13)).collect(), plain(rows))
