"""Hand-computed cases of rules whose behaviour is easily got wrong."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import arrays as A
from quillspark.functions import text as T
from quillspark.functions import views as V
from quillspark.operators import augment, image, retrieval, splits, vocab
from quillspark.sources import readers, sinks


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "report, f, i",
    [
        ("FINDINGS: a b\nIMPRESSION: c", "a b", "c"),
        ("findings: a", "a", ""),
        ("IMPRESSION: c", "", "c"),
        ("FINDINGS:\nIMPRESSION: c", "", "c"),
        ("nothing", "", ""),
        (None, "", ""),
    ],
)
def test_sections(spark, report, f, i):
    assert one(spark, report, T.findings) == f
    assert one(spark, report, T.impression) == i


def test_body_takes_the_impression_line_unless_told_not_to(spark):
    report = "FINAL REPORT\n___ x\nclear  lungs\nIMPRESSION: fine"
    assert one(spark, report, T.findings_or_body) == "clear lungs IMPRESSION: fine"
    assert one(spark, report, lambda c: T.body(c, True)) == "clear lungs"


@pytest.mark.parametrize("text, want", [("vs. b", ["vs."]), ("vs.c", ["versusc"]), ("für Ärzte, no!", ["für", "ärzte", "no"]), ("", []), (None, [])])
def test_clean_tokens(spark, text, want):
    assert one(spark, text, T.clean_tokens) == want


def test_fixed_abbreviations(spark):
    assert one(spark, "vs. b2", lambda c: T.clean_tokens(c, fix_abbreviations=True)) == ["versus", "b2"]


def test_noise(spark):
    assert one(spark, "a XXXX n/a None b  x", T.without_noise) in ("a b", "a / b")


@pytest.mark.parametrize("text, n, want", [("a b c", 2, ["a b", "b c"]), ("a", 2, ["a"]), ("", 2, [])])
def test_ngrams(spark, text, n, want):
    assert one(spark, text, lambda c: T.ngrams(T.tokens(c), n)) == want


def test_style_has_no_word_edges_unless_asked_for(spark):
    assert one(spark, "abnormal", lambda c: T.styled(c, "academic")) == "abwithin normal radiographic limits"
    assert one(spark, "abnormal", lambda c: T.styled(c, "academic", True)) == "abnormal"
    assert one(spark, "Clear", lambda c: T.styled(c, "academic")) == "Aerated"
    assert one(spark, "x", lambda c: T.styled(c, "other")) == "x"


def test_restructured(spark):
    assert one(spark, "There is Mild edema", T.restructured) == "Mild edema is present."
    assert one(spark, "No effusion", T.restructured) == "Effusion is not identified."


def test_certainty(spark):
    assert one(spark, "Cannot exclude x", lambda c: T.certainty(c, "increase")) == "demonstrates x"
    assert one(spark, "shows x", lambda c: T.certainty(c, "decrease")) == "may show x"


@pytest.mark.parametrize("seq, post, pre", [([], [0, 0, 0], [0, 0, 0]), ([1], [1, 0, 0], [0, 0, 1]), ([1, 2, 3], [1, 2, 3], [1, 2, 3]), ([1, 2, 3, 4], [1, 2, 3], [2, 3, 4])])
def test_padded(spark, seq, post, pre):
    assert one(spark, seq, lambda c: A.padded(c, 3), "array<int>") == post
    assert one(spark, seq, lambda c: A.padded(c, 3, "pre"), "array<int>") == pre


def test_jaccard_of_nothing(spark):
    assert one(spark, [], lambda c: T.jaccard(c, c), "array<string>") == 0


def test_portable_study_is_in_the_high_tier(spark):
    assert one(spark, "DG CHEST 1V PORT", V.confidence) == "high"
    assert one(spark, "PORTABLE CHEST - 1 VIEW", V.confidence) == "medium"


def test_view_letters_inside_words(spark):
    d = spark.createDataFrame([("x", "patchy")], "d string, t string")
    f, w = V.flags(F.col("d"), F.col("t")), V.flags(F.col("d"), F.col("t"), True)
    assert d.select(f["frontal"], w["frontal"]).first() == (True, False)


def test_vocabulary(spark):
    docs = spark.createDataFrame([(1, "b a a"), (2, ""), (3, None), (4, "c zz")], "id int, text string").withColumn("t", T.tokens(F.col("text")))
    v = vocab.fitted(vocab.counts(docs.filter("id < 4"), F.col("t")))
    assert {r["token"]: r["id"] for r in v.collect()} == {"a": 2, "b": 3}
    e = vocab.encode(docs, "id", F.col("t"), v)
    assert {r["id"]: r["ids"] for r in e.collect()} == {1: [3, 2, 2], 2: [], 3: [], 4: [1, 1]}
    assert {r["id"]: r["text"] for r in vocab.decode(e, "id", F.col("ids"), v).collect()} == {1: "b a a", 2: "", 3: "", 4: ""}
    x = vocab.extended(v, spark.createDataFrame([("a",), ("two words",)], "term string")).collect()
    assert {(r["token"], r["id"], r["reachable"]) for r in x} == {("a", 2, True), ("b", 3, True), ("two words", 4, False)}


def test_splits(spark):
    ids = spark.range(101).withColumnRenamed("id", "k")
    n = {r["split"]: r["count"] for r in splits.assign(ids, "k", 0.7, 0.15, "s").groupBy("split").count().collect()}
    assert n == {"train": 70, "val": 15, "test": 16}
    n = {r["split"]: r["count"] for r in splits.assign(ids, "k", 0.8, 0.19, "s", min_test=20).groupBy("split").count().collect()}
    assert n["test"] >= 20 and sum(n.values()) == 101


def test_leaks_tell_doubles_from_leaks(spark):
    d = spark.createDataFrame([("a", "train"), ("a", "train"), ("b", "train"), ("b", "test"), ("c", "val")], "k string, split string")
    assert {r["x"]: r["leaks"] for r in splits.leaks(d, "k", "x").collect()} == {"a": False, "b": True}


def test_text_augmentation_takes_whole_documents(spark, tmp_path):
    from quillspark.plans.registry import QUERIES

    texts = {i: ". ".join(f"w{i}x{k} goes with v{i}x{k}" for k in range(150)) for i in range(3)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["doc_id"], r["aug_no"]): r["text"] for r in QUERIES["text_augmentation"](spark, str(tmp_path)).collect()}
    assert got.keys() == {(i, n) for i in texts for n in (1, 2, 3)}
    for (i, _), text in got.items():
        assert {f"{w}{i}x{k}" for w in "wv" for k in range(150)} <= set(text.lower().replace(".", " ").split())


def test_variants_at_the_ends_of_chance(spark):
    d = spark.createDataFrame([(1, "No Opacity. Lungs are clear. x. y."), (2, ""), (3, None)], "id int, text string")
    never = augment.Config(synonym_replacement_prob=0, sentence_restructure_prob=0, terminology_style_prob=0, finding_order_prob=0, certainty_modifier_prob=0)
    got = {(r["id"], r["aug_no"]): r["text"] for r in augment.variants(d, "id", "text", 2, never, keep_original=True).collect()}
    assert got[1, 1] == got[1, 2] == "No Opacity. Lungs are clear. x. y." and got[2, 1] == got[3, 2] == "" and len(got) == 9
    always = augment.Config.from_dict(never.to_dict() | {"synonym_replacement_prob": 1, "finding_order_prob": 1, "other": 3})
    text = augment.variants(d, "id", "text", 1, always).filter("id = 1").first()["text"]
    first, last = text.split(" ")[0], text.split(" ")[-1]
    assert first in [x.capitalize().split(" ")[0] for x in augment.SYNONYMS["no"]] and last == "y."


def test_image_functions():
    r = np.random.default_rng(0)
    img = r.random((12, 10, 3))
    assert np.allclose(image.resize(img, 12, 10), img)
    assert image.resize(img, 5, 7).shape == (5, 7, 3)
    assert np.allclose(image.elastic(img, r, 0, 2), img)
    for seed in range(20):
        out = image.augment(img, np.random.default_rng(seed))
        assert out.shape == img.shape and out.min() >= 0 and out.max() <= 1
        assert np.allclose(out, image.augment(img, np.random.default_rng(seed)))


def test_loss_of_equal_similarities(spark):
    s = spark.createDataFrame([(0, i, j, 0.5) for i in range(4) for j in range(4)], "batch long, i long, j long, sim double")
    assert retrieval.contrastive_loss(s, 0.07).first()["loss"] == pytest.approx(np.log(4), abs=1e-5)


def test_readers_and_sinks(spark, tmp_path):
    p = str(tmp_path)
    (tmp_path / "a.jsonl").write_text('{"study_id": "1", "text": "x"}\nbroken\n\n{"study_id": "2", "text": "y"}\n')
    good, bad = readers.jsonl(spark, f"{p}/a.jsonl", "study_id string, text string")
    assert good.count() == 2 and bad.count() == 1
    (tmp_path / "b.json").write_text('[{"study_id": "1"}, {"study_id": "2"}]')
    assert readers.load(spark, f"{p}/b.json").count() == 2
    (tmp_path / "c.csv").write_text('uid,findings\n1,"two\nlines, ""quoted"""\n')
    assert readers.load(spark, f"{p}/c.csv").first()["findings"] == 'two\nlines, "quoted"'
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "s1.txt").write_text(" FINDINGS: x ")
    (tmp_path / "r" / "s2.txt").write_text("  ")
    assert [x["text"] for x in readers.reports(spark, f"{p}/r").collect()] == ["FINDINGS: x"]
    (tmp_path / "v.json").write_text('{"<pad>": 0, "a": 4}')
    assert {x["token"]: x["id"] for x in readers.vocabulary(spark, f"{p}/v.json").collect()} == {"<pad>": 0, "a": 4}
    assert {x["ext"]: x["n"] for x in readers.profile(spark, p).collect()}["txt"] == 2
    rows = spark.createDataFrame([(i, "train" if i < 5 else "val", [i]) for i in range(8)], "k long, split string, caption array<int>")
    sinks.write_shards(rows, "k", 2, f"{p}/shards")
    back = readers.shards(spark, f"{p}/shards", "train")
    assert back.count() == 5 and back.select("shard_id").distinct().count() == 3
    sinks.write_json(rows, f"{p}/out.json")
    assert spark.read.json(f"{p}/out.json").count() == 8


def test_pickled_shards_need_trust(spark, tmp_path):
    import pickle

    (tmp_path / "s.pkl").write_bytes(pickle.dumps({"captions": np.array([[1, 2], [3, 0]], np.int32), "study_ids": np.array(["a", "b"])}))
    with pytest.raises(ValueError):
        readers.pickled_shards(spark, str(tmp_path / "s.pkl"))
    got = readers.pickled_shards(spark, str(tmp_path / "s.pkl"), trusted=True).collect()
    assert {(r["study_id"], tuple(r["caption"])) for r in got} == {("a", (1, 2)), ("b", (3, 0))}


def test_published_identities():
    for std, mean, vocab_size, total, want in ((19.44, 38.19, 9015, 1682040, (0.6626, 0.0054)), (20.62, 47.44, 4442, 2535578, (0.6970, 0.0018))):
        assert round(1 / (1 + std / mean), 4) == pytest.approx(want[0], abs=1e-4)
        assert round(vocab_size / total, 4) == want[1]
    assert 9015 + 4442 - 4361 == 9096


def test_rows_with_equal_keys_stay_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "b"), (None, "a"), (None, "b c")], "id int, text string").withColumn("t", T.tokens(F.col("text")))
    v = vocab.fitted(vocab.counts(docs, F.col("t")))
    ids = {r["token"]: r["id"] for r in v.collect()}
    want = sorted([(1, [ids["a"], ids["b"]]), (1, [ids["b"]]), (None, [ids["a"]]), (None, [ids["b"], ids["c"]])], key=str)
    for most in (200_000, 1):  # all words in place, and all but the first by a join
        e = vocab.encode(docs, "id", F.col("t"), v, most=most)
        assert sorted(((r["id"], r["ids"]) for r in e.collect()), key=str) == want
        assert sorted((str(r["id"]), r["text"]) for r in vocab.decode(e, "id", F.col("ids"), v, most=most).collect()) == sorted([("1", "a b"), ("1", "b"), ("None", "a"), ("None", "b c")])
    made = augment.variants(docs, "id", "text", 2)
    assert made.count() == 8 and made.filter("id = 1").count() == 4


def test_words_part_at_any_white_space(spark):
    d = spark.createDataFrame([("a b　c d\x1ce f\n",)], "x string")
    assert d.select(T.tokens(F.col("x"))).first()[0] == "a b　c d\x1ce f\n".split() == ["a", "b", "c", "d", "e", "f"]
    assert d.select(T.tokenizer("bigram")(F.col("x"))).first()[0][:2] == ["a b", "b c"]
    with pytest.raises(ValueError):
        T.tokenizer("none")


def test_ties_go_to_the_word_seen_first(spark):
    docs = spark.createDataFrame([(2, "z a"), (1, "m b z")], "id long, text string").withColumn("t", T.tokens(F.col("text")))
    v = vocab.fitted(vocab.counts(docs, F.col("t"), order=F.col("id")))
    assert [r["token"] for r in v.orderBy("id").collect()] == ["z", "m", "b", "a"]
    loaded = spark.createDataFrame([("q", 7)], "token string, id long")
    assert vocab.fit(vocab.counts(docs, F.col("t")), loaded).collect() == [("q", 7)]


def test_failed_variants_and_ids_to_ids(spark):
    d = spark.createDataFrame([(1, None), (2, "No opacity. clear lungs.")], "id int, text string")
    assert {r["aug_id"]: r["text"] for r in augment.variants(d, "id", "text", 1).filter("id = 1").collect()} == {"1_aug_1_failed": ""}
    rows = d.withColumn("t", T.tokens(F.col("text")))
    v = vocab.built(vocab.counts(rows, F.col("t")), 1)
    e = vocab.encode(rows, "id", F.col("t"), v)
    never = augment.Config(synonym_replacement_prob=0, sentence_restructure_prob=0, terminology_style_prob=0, finding_order_prob=0, certainty_modifier_prob=0)
    out = augment.variants_of_ids(e, "id", F.col("ids"), v, 1, 6, never).filter("id = 2").first()
    assert out["aug_id"] == "2_aug_1" and out["ids"] == e.filter("id = 2").first()["ids"] + [0, 0]
    joined = {r["id"]: [x["aug_id"] for x in r["variants"]] for r in augment.with_variants(d, augment.variants(d, "id", "text", 2).filter("id = 2"), "id").collect()}
    assert joined == {1: [], 2: ["2_aug_1", "2_aug_2"]}


def test_pickled_shards_of_all_layouts(spark, tmp_path):
    import pickle

    img = np.arange(12, dtype=np.float32).reshape(2, 6)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "s.pkl").write_bytes(pickle.dumps({"images": img, "captions": np.array([[1, 2], [3, 0]]), "study_ids": ["a", "b"], "split": "train"}))
    (tmp_path / "t.pkl").write_bytes(pickle.dumps([{"study_id": "c", "caption_seq": [5], "frontal_img": [1.0], "split": "val"}, {"study_id": "d"}]))
    (tmp_path / "u.txt").write_text("no pickle")
    got = readers.load(spark, str(tmp_path / "a" / "s.pkl"), trusted=True, schema="study_id string, caption array<int>, image array<float>, split string").orderBy("study_id").collect()
    assert [(r["study_id"], r["caption"], r["image"], r["split"]) for r in got] == [("a", [1, 2], img[0].tolist(), "train"), ("b", [3, 0], img[1].tolist(), "train")]
    got = readers.pickled_shards(spark, str(tmp_path), trusted=True, schema="study_id string, caption array<int>, split string").collect()
    assert {(r["study_id"], tuple(r["caption"] or ()), r["split"]) for r in got} == {("a", (1, 2), "train"), ("b", (3, 0), "train"), ("c", (5,), "val"), ("d", (), None)}


def test_shards_in_an_order_of_choice(spark, tmp_path):
    rows = spark.createDataFrame([(i, "train") for i in range(30)], "k long, split string")
    sinks.write_shards(rows, "k", 4, str(tmp_path / "s"))
    read = lambda **o: [r["k"] for r in readers.shards(spark, str(tmp_path / "s"), "train", 5, **o).collect()]
    assert read() == [0, 1, 2, 3, 4] and read(seed="x") == read(seed="x") != read() and read(seed="y") != read(seed="x")


def test_broken_texts_and_the_first_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.txt").write_bytes(b"  caf\xe9 au lait \n")
    (tmp_path / "b.txt").write_bytes("größe".encode())
    (tmp_path / "c.txt").write_bytes(b" \n")
    assert {r["text"] for r in readers.reports(spark, str(tmp_path)).collect()} == {"caf au lait", "größe"}
    assert [r["text"] for r in readers.reports(spark, str(tmp_path), 1).collect()] == ["größe"]
    with pytest.raises(ValueError):
        readers.load(spark, "x.unknown")
    d = spark.createDataFrame([("", "r"), ("c", "r"), (None, None)], "caption string, report string")
    assert [r["entry_text"] for r in readers.first_text(d).collect()] == ["r", "r", None]


def test_images_are_read_and_described(spark, tmp_path):
    raw = b"P6 2 2 255\n" + bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 255, 255, 255])
    (tmp_path / "i.ppm").write_bytes(raw)
    (tmp_path / "j.png").write_bytes(b"no image")
    rows = {r["path"].rsplit("/", 1)[-1]: r["pixels"] for r in readers.images(spark, str(tmp_path), 2, 2).collect()}
    assert rows["j.png"] is None
    d = spark.createDataFrame([([0, 3, 0, 5],)], "s array<int>")
    assert d.select(A.unpadded(F.col("s"))).first()[0] == [3, 5]


def test_streams(spark, tmp_path):
    from quillspark.streaming import vocab as S

    spark.createDataFrame([(1, "a b a"), (2, "b")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    q = S.token_counts(S.read(spark, str(tmp_path / "in"), "doc_id long, text string")).writeStream.outputMode("complete").format("memory").queryName("tokens_seen").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r["token"], r["freq"]) for r in spark.table("tokens_seen").collect()} == {("a", 2), ("b", 2)}
    spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'x' event_type union all select timestamp'2024-01-01 00:50:00', 'x' union all select timestamp'2024-01-01 03:00:00', 'y'").write.parquet(str(tmp_path / "ev"))
    q = S.event_counts(S.read(spark, str(tmp_path / "ev"), "ts timestamp, event_type string")).writeStream.outputMode("complete").format("memory").queryName("events_seen").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r["event_type"], r["n"]) for r in spark.table("events_seen").collect()) == [("x", 2), ("y", 1)]


def test_views_only_the_text_names(spark):
    d = spark.createDataFrame([("DG CHEST 1V", "portable frontal film")], "d string, t string")
    assert d.select(V.detected(F.col("d"), F.col("t"))).first()[0] == ["Single", "Frontal_in_text", "Portable_in_text"]


class Draws:
    """A generator that gives chances in order, and the middle of every range or a fixed share of it."""

    def __init__(self, chances, share=0.5):
        self.chances, self.share = list(chances), share

    def random(self):
        return self.chances.pop(0)

    def uniform(self, a, b, shape=None):
        x = a + (b - a) * self.share
        return x if shape is None else np.full(shape, x)

    def normal(self, m, s, shape):
        return np.full(shape, s)


def test_image_steps_one_by_one():
    img = np.zeros((4, 4, 1))
    img[1, 2] = 0.5
    c = image.Config()
    one = lambda k, share=0.5: image.augment(img, Draws([0.0 if j == k else 1.0 for j in range(7)], share))
    assert np.allclose(one(9), img)
    for k in (0, 1, 2, 3, 5, 6):  # the middle of every range changes nothing
        assert np.allclose(one(k), img), k
    assert np.allclose(one(4), np.clip(img + c.noise_level, 0, 1))
    assert np.allclose(one(2, 1.0), img * (1 + c.brightness_range))
    m = img.mean()
    assert np.allclose(one(3, 1.0), np.clip((img - m) * (1 + c.contrast_range) + m, 0, 1))
    assert np.allclose(one(0, 1.0), image.sample(img, *(np.mgrid[0:4, 0:4] - c.translation_range * 4)))
