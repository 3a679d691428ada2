"""Pickled shards as a data source, term matching, statistics by name, plot data, joins by similarity and by names in paths."""

import itertools
import pickle
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import augment, files, metrics, similarity, stats, terms, vocab
from quillspark.sources import pickles, readers
from tests.test_functions import one

# trimming


@pytest.mark.parametrize("text", ["", " ", "a", "  a b ", "　 a  b \n", "\x1c\x85a​ ", "\t\r\n\x0b\x0c", None])
def test_trimming_takes_white_space_of_any_script(spark, text):
    assert one(spark, text, T.stripped) == (None if text is None else text.strip(T.SPACES))


def test_a_megabyte_of_white_space_is_trimmed_in_a_second(spark):
    text = "a" + " \t" * 500_000 + "b" + "　" * 500_000
    df = spark.createDataFrame([(f"FINDINGS: {text}",)], "x string")
    df.select(T.stripped(F.col("x"))).collect()
    began = time.time()
    got = df.select(T.stripped(F.col("x")).alias("y"), T.findings(F.col("x")).alias("f"), T.sentences(F.col("x")).alias("s")).first()
    assert time.time() - began < 5
    assert got["y"].endswith("b") and got["f"].startswith("a") and len(got["s"]) == 1


# pickled shards


class Dangerous:
    def __reduce__(self):
        return (print, ("executed",))


def shard_files(folder):
    img = [np.arange(3, dtype=np.float32) + k for k in range(5)]
    (folder / "a").mkdir()
    with open(folder / "a" / "s.pkl", "wb") as f:  # two pickles in a row
        pickle.dump({"images": img[:2], "captions": np.array([[1, 2], [3, 0]]), "study_ids": np.array(["a", "b"]), "split": "train", "scores": [0.5]}, f)
        pickle.dump([{"study_id": "c", "caption_seq": [5], "frontal_img": img[2], "split": "val"}, {"study_id": np.str_("d")}], f)
    (folder / "t.pkl").write_bytes(pickle.dumps({"images": img[3:], "captions": [[7], []], "study_ids": ["e", "f"], "split": "test", "n": np.int64(3)}))
    (folder / "u.txt").write_text("no pickle")


@pytest.mark.parametrize("rows, size", [(1000, 1 << 26), (1, 40), (2, 100), (3, 1)])
def test_shards_of_all_layouts_in_ranges(spark, tmp_path, rows, size):
    shard_files(tmp_path)
    pickles.register(spark)
    reader = spark.read.format(pickles.NAME).option("rows", rows).option("bytes", size)
    reader.schema("study_id string, caption array<int>, image array<float>, split string, n long, nowhere string").load(str(tmp_path)).createOrReplaceTempView("shards")
    got = spark.sql("select study_id, caption, split, image[0] as first, n, nowhere from shards order by study_id").collect()
    assert [tuple(r) for r in got] == [("a", [1, 2], "train", 0.0, None, None), ("b", [3, 0], "train", 1.0, None, None), ("c", [5], "val", 2.0, None, None), ("d", None, None, None, None, None), ("e", [7], "test", 3.0, 3, None), ("f", [], "test", 4.0, 3, None)]
    assert spark.sql("select split, count(*) as n from shards where split is not null group by split order by split").collect() == [("test", 2), ("train", 2), ("val", 1)]


def test_only_plain_values_are_loaded_without_trust(spark, tmp_path):
    pickles.register(spark)
    (tmp_path / "x.pkl").write_bytes(pickle.dumps({"study_ids": ["a"], "captions": [Dangerous()]}))
    df = spark.read.format(pickles.NAME).load(str(tmp_path))
    with pytest.raises(Exception, match="no plain value"):
        df.collect()
    assert spark.read.format(pickles.NAME).option("trusted", "true").schema("study_id string").load(str(tmp_path)).collect() == [("a",)]


def test_shards_are_written_overwritten_and_empty(spark, tmp_path):
    pickles.register(spark)
    path, df = str(tmp_path / "out"), spark.range(25).select(F.col("id").cast("string").alias("study_ids"), F.array("id").cast("array<int>").alias("captions"))
    for _ in range(2):
        df.repartition(3).write.format(pickles.NAME).option("rows", 4).mode("overwrite").save(path)
    read = lambda: spark.read.format(pickles.NAME).option("bytes", 200).option("rows", 4).load(path)
    assert sorted((int(r["study_id"]), r["caption"][0]) for r in read().collect()) == [(i, i) for i in range(25)]
    assert read().rdd.getNumPartitions() > 3
    df.limit(0).write.format(pickles.NAME).mode("append").save(path)
    assert read().count() == 25
    (tmp_path / "none").mkdir()
    assert spark.read.format(pickles.NAME).load(str(tmp_path / "none")).count() == 0


# terms


def plain_terms(rows, wanted):
    out = {}
    for key, t in rows:
        for term in wanted:
            w = term.split()
            n = sum(t[i : i + len(w)] == w for i in range(len(t or []))) if t and w else 0
            if n:
                a, b = out.get((key, term), (0, 0))
                out[key, term] = (a + n, b + 1)
    return out


def test_terms_overlap_and_match_whole_tokens(spark):
    wanted = ["pleural fluid", "fluid collection", "fluid", "pleural", "no no", "no", "x", "a b a", "", "é ü"]
    rows = [("k", "the pleural fluid collection of fluids".split()), ("k", "no no no nob".split()), ("m", ["a", "b", "a", "b", "a"]), ("m", []), ("m", None), (None, ["é", "ü", "x"]), ("k", ["x\x1fno"])]
    df = spark.createDataFrame(rows, "lang string, t array<string>")
    got = {(r["lang"], r["term"]): (r["n"], r["n_rows"]) for r in terms.occurrences(df, ["lang"], F.col("t"), wanted).collect()}
    assert got == plain_terms(rows, wanted)
    assert terms.occurrences(df, [], F.col("t"), []).count() == 0
    assert terms.occurrences(df.limit(0), ["lang"], F.col("t"), wanted).count() == 0


def test_coverage_by_category_and_kind(spark):
    categories = spark.createDataFrame([("c", "a"), ("c", "a b"), ("d", "a"), ("d", "z")], "category string, term string")
    have = spark.createDataFrame([("a",), ("q",)], "token string")
    found = spark.createDataFrame([("a b", 3), ("z", 2)], "term string, n long")
    got = {(r[0], r[1]): tuple(r)[2:] for r in terms.coverage(categories, have, found).collect()}
    assert got["c", "any"] == (2, 1, 50.0, 1, 50.0, 3) and got["c", "multi"] == (1, 0, 0.0, 1, 100.0, 3) and got["d", "single"] == (2, 1, 50.0, 1, 50.0, 2)
    assert got["all", "any"] == (3, 1, 33.333333, 2, 66.666667, 5)


# statistics by name


def test_statistics_are_read_from_one_scan(spark, tmp_path):
    rows = [("en", ["a", "b", "a"]), ("en", []), ("en", None), ("de", ["a"]), (None, ["q", "q"])]
    df = spark.createDataFrame(rows, "lang string, t array<string>")
    names = ["entries", "filled", "tokens", "length_mean", "length_median", "length_std", "distinct_mean", "repetition", "words", "once", "places_std"]
    got = {r["lang"]: r.asDict() for r in metrics.compute(df, ["lang"], F.col("t"), names).collect()}
    en = got["en"]
    assert (en["entries"], en["filled"], en["tokens"], en["words"], en["once"]) == (3, 1, 3, 2, 1)
    assert en["length_mean"] == pytest.approx(1) and en["length_median"] == 0 and en["length_std"] == pytest.approx(2**0.5) and en["repetition"] == pytest.approx(1 / 3)
    assert en["places_std"] == 0 and got["de"]["words"] == 1
    with pytest.raises(ValueError, match="no statistic"):
        metrics.compute(df, ["lang"], F.col("t"), ["never"])
    with pytest.raises(ValueError, match="no part"):
        metrics.register("x", ["never"], lambda x: x)
    with pytest.raises(ValueError, match="no level"):
        metrics.register_part("x", "never", lambda: F.count("*"))


# plot data


def test_boxes_and_outliers(spark):
    values = [1, 2, 3, 4, 5, 100, -90, None]
    df = spark.createDataFrame([("a", float(v) if v is not None else None) for v in values] + [("b", 7.0), (None, 1.0), (None, 1.0)], "g string, v double")
    boxes, outliers = stats.box_plot(df, ["g"], F.col("v"))
    got = {r["g"]: tuple(r)[1:] for r in boxes.collect()}
    x = np.array([v for v in values if v is not None], float)
    q1, median, q3 = np.percentile(x, [25, 50, 75])
    inside = x[(x >= q1 - 1.5 * (q3 - q1)) & (x <= q3 + 1.5 * (q3 - q1))]
    assert got["a"] == (7, q1, median, q3, inside.min(), inside.max(), 2) and got["b"] == (1, 7, 7, 7, 7, 7, 0) and got[None][0] == 2
    assert sorted(map(tuple, outliers.collect())) == [("a", "high", 100.0, 1), ("a", "low", -90.0, 1)]


def test_heat_map_has_every_cell(spark):
    df = spark.createDataFrame([("r", "x", 1.0), ("r", "x", 2.0), ("r", "y", 1.0), ("s", "y", 5.0), (None, "y", 0.0)], "a string, b string, v double")
    got = {(r["row"], r["column"]): (r["value"], r["share"], r["scaled"]) for r in stats.heat_map(df, "a", "b", F.sum("v")).collect()}
    assert got == {("r", "x"): (3, 0.75, 1), ("r", "y"): (1, 0.25, 0.2), ("s", "x"): (0, 0, 0), ("s", "y"): (5, 1, 1), (None, "x"): (0, 0, 0), (None, "y"): (0, 0, 0)}


# similarity join


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_similar_pairs_against_all_pairs(spark, percent):
    r = np.random.default_rng(percent)
    base = [r.choice(60, r.integers(1, 14), replace=False) for _ in range(12)]
    made = lambda n: [(i, [f"w{x}" for x in np.append(base[r.integers(12)], r.integers(0, 70, r.integers(0, 3)))]) for i in range(n)]
    a, b = made(80) + [(900, []), (901, None)], made(90) + [(900, []), (902, ["w1", None])]
    got = {(x["left"], x["right"]): (x["n_left"], x["n_right"], x["similarity"]) for x in similarity.similar_pairs(spark.createDataFrame(a, "l long, t array<string>"), spark.createDataFrame(b, "r long, t array<string>"), "l", "r", F.col("t"), F.col("t"), percent).collect()}
    groups = lambda rows: {s: [i for i, t in rows if frozenset(x for x in t or [] if x) == s] for s in {frozenset(x for x in t or [] if x) for _, t in rows} if s}
    want = {}
    for (s, i), (t, j) in itertools.product(groups(a).items(), groups(b).items()):
        if 100 * len(s & t) >= percent * len(s | t):
            want[min(i), min(j)] = (len(i), len(j), round(len(s & t) / len(s | t), 6))
    assert got == want


def test_a_sheet_stays_a_sheet(spark):
    docs = spark.range(500).select("id", F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    o = augment.sheet(docs, "id", 5)
    got = augment.pairwise(o, augment.variants(o, "id", "text", 2), "id", "text", most=5, each=2)
    assert got.count() == 50 and {r["original"] for r in got.collect()} == set(range(5))


# names in paths


def test_studies_and_files_meet_by_names(spark):
    paths = ["/d/p1/s10/a.jpg", "/d/p1/s10/b.png", "/d/p1/s100/c.jpg", "/d/p2/s10/d.jpg", "/d/p1/x/p1_s10_1.jpg", "/d/p1/s10/e.txt", "/d/s10.jpg"]
    studies = spark.createDataFrame([("p1", "s10"), ("p1", "s10"), ("p1", "s1"), ("p2", "s10"), (None, "s10"), ("p1", None)], "patient string, uid string")
    listing = spark.createDataFrame([(p, 1) for p in paths], "path string, length long")
    got = sorted(((r["patient"] or "", r["uid"] or "", r["images"]) for r in files.with_images(studies, listing, "patient", "uid").collect()), key=str)
    first = ["/d/p1/s10/a.jpg", "/d/p1/s10/b.png", "/d/p1/x/p1_s10_1.jpg"]
    assert got == sorted([("p1", "s10", first), ("p1", "s10", first), ("p1", "s1", []), ("p2", "s10", ["/d/p2/s10/d.jpg"]), ("", "s10", []), ("p1", "", [])], key=str)


def test_tree_of_a_listing(spark):
    paths = [f"/d/p{100 + i % 7}/s{2000 + i}/{i}.{'txt' if i % 3 else 'jpg'}" for i in range(60)] + ["/d/plain"]
    got = {r["level"]: (r["n"], r["samples"]) for r in readers.tree(spark.createDataFrame([(p, 1) for p in paths], "path string, length long")).collect()}
    assert got["patient"] == (7, ["p100", "p101", "p102"]) and got["study"] == (60, ["s2000", "s2001", "s2002"]) and got["extension"] == (2, ["jpg", "txt"]) and got["report folder"][0] == 40
    assert readers.tree(spark.createDataFrame([], "path string, length long")).count() == 0


# words behind the shared ones


def test_rows_keep_their_words_where_they_are_read_twice(spark):
    words = [f"w{i}" for i in range(40)]
    v = spark.createDataFrame([(w, i + 2) for i, w in enumerate(words)], "token string, id long")
    rows = [(i, [words[(i * k) % 40] for k in range(1, 6)] + ["none"]) for i in range(300)]
    df = spark.createDataFrame(rows, "key long, t array<string>").repartition(7).repartition(5, F.rand())  # an order that differs from one evaluation to the next
    want = {i: [words.index(w) + 2 if w != "none" else 1 for w in t] for i, t in rows}
    e = vocab.encode(df, "key", F.col("t"), v, most=3)
    assert {r["key"]: r["ids"] for r in e.collect()} == want
    back = vocab.decode(e.repartition(6, F.rand()), "key", F.col("ids"), v, most=3)
    assert {r["key"]: r["text"] for r in back.collect()} == {i: " ".join(t[:-1]) for i, t in rows}


def test_synonyms_only_where_a_term_stands(spark):
    sure = augment.Config(synonym_replacement_prob=1.0, sentence_restructure_prob=0, terminology_style_prob=0, certainty_modifier_prob=0, finding_order_prob=0)
    texts = ["Mild  opacity\there.", "nothing  to　change", "(SEVERE), no: fine", "abnormality is noted", "mildly. (normal)"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: r["text"] for r in augment.variants(df, "id", "text", 1, sure).collect()}
    assert got[1] == "nothing to change." and got[3] == "abnormality is noted."
    assert got[0].split()[0] in {w.capitalize() for w in augment.SYNONYMS["mild"]} and "opacity" not in got[0]
    assert "SEVERE" not in got[2] and "normal)" not in got[4] and got[4].startswith("mildly.")
