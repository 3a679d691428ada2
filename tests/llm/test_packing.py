"""Packing: ids against the library, sequences against their rules and the best that is possible, bounds against search."""

import collections
import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest

from quillspark.llm import packing, queries
from quillspark.sources.tables import table

PATH = public_tokenizers.path("word_bpe_49k.json")
FOLDER = "/root/testdata/sf0.001"


def library_ids(text):
    from tokenizers import Tokenizer

    global _tokenizer
    if "_tokenizer" not in globals():
        _tokenizer = Tokenizer.from_file(PATH)
    return [*_tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def pieces(docs, length):
    """Multiset of (doc_id, piece, start, length, crc)."""
    out = collections.Counter()
    for i, text in docs:
        ids = library_ids(text)
        for k, a in enumerate(range(0, len(ids), length)):
            part = ids[a : a + length]
            out[i, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    return out


def check(rows, docs, length=2048):
    """The pieces are those of the documents, and stand in their sequences without gap or overlap. The number of sequences."""
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == pieces(docs, length)
    found = collections.defaultdict(list)
    for r in rows:
        found[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in found.values():
        x.sort()
        assert [a for a, _ in x] == [0, *itertools.accumulate(n for _, n in x)][:-1] and sum(n for _, n in x) <= length
    return len(found)


def test_documents_are_packed_as_well_as_can_be(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, FOLDER, "documents").collect()]
    rows = queries.op13_packing(spark, FOLDER).collect()
    tokens = sum(r["length"] for r in rows)
    assert check(rows, docs) <= -(-tokens // 2048) + 1  # 2.5 pieces a sequence: one more than their sum asks for


def test_awkward_rows(spark):
    texts = [None, "", " \n\t ", "a b", "a b", "x" * 3000, "the end of it " * 9000, "é 日本 😀 <|endoftext|> a<|startoftext|>b ▁ '" * 3, "Ünïcode spacé 1234 don't\r\nx", "́ á"]
    docs = [*enumerate(texts), (3, "a b"), (None, "a b"), (None, None)]
    df = spark.createDataFrame([(i, t, 1, 2, "r") for i, t in docs], "doc_id long, text string, piece int, offset long, room string")
    for length in (2048, 7):
        check(packing.pack(df, PATH, length=length).collect(), docs, length)
    assert packing.pack(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize("block", [40, 400])
def test_small_blocks_exchange_until_the_bound_is_reached(spark, block):
    docs = [(r["doc_id"], r["text"][:2000]) for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(9)
    one = packing.first_packing(df, PATH, 512, False, block, "doc_id", "text").select("sequence_id").distinct().count()
    rows = packing.pack(df, PATH, length=512, block=block).collect()
    bound = packing.lower_bound(np.bincount([r["length"] for r in rows], minlength=513), 512)
    assert bound <= check(rows, docs, 512) <= min(one, bound * 1.01 + 1)


def test_whole_sequences(spark):
    docs = [(i, f"text number {i} " * (i % 9)) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    packed = packing.pack(df, PATH, length=64, ids=True, block=20)
    ids = {i: library_ids(t) for i, t in docs}
    whole = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
    assert sum(map(len, whole.values())) == sum(map(len, ids.values()))


def best(sizes, length):
    """Fewest bins, by trying everything."""
    sizes = sorted(sizes, reverse=True)
    for n in range(1, len(sizes) + 1):
        def fits(i, rooms):
            return i == len(sizes) or any(fits(i + 1, tuple(sorted((*rooms[:j], r - sizes[i], *rooms[j + 1 :])))) for j, r in enumerate(rooms) if r >= sizes[i] and r not in rooms[:j])

        if fits(0, (length,) * n):
            return n
    return 0


def test_bounds_never_exceed_the_best():
    r = np.random.default_rng(4)
    tight = 0
    for _ in range(150):
        length = int(r.integers(8, 40))
        sizes = r.integers(1, length + 1, int(r.integers(1, 9))).tolist()
        bound, want = packing.lower_bound(np.bincount(sizes, minlength=length + 1), length), best(sizes, length)
        _, _, got = packing.best_fit(np.array(sizes), length)
        assert bound <= want <= got
        tight += bound == want
    assert tight > 130
    assert packing.lower_bound(np.bincount([1025] * 50, minlength=2049)) == 50  # more than their sum says
    assert packing.lower_bound(np.bincount([683] * 50, minlength=2049)) == 25
    many = np.zeros(2049, np.int64)
    many[2048] = 1 << 50
    assert packing.lower_bound(many) == 1 << 50


def plain_best_fit(sizes, length):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fit = min((x for x in rooms if x >= s), default=None)
        if fit is None:
            rooms.append(length - s)
        else:
            rooms[rooms.index(fit)] = fit - s
    return sorted(rooms)


def test_best_fit_against_a_plain_one():
    r = np.random.default_rng(7)
    for _ in range(60):
        sizes = np.minimum(64, r.integers(1, 70, 200) // r.integers(1, 9, 200) + 1)
        sequence, offset, count = packing.best_fit(sizes, 64)
        filled = np.bincount(sequence, sizes, count)
        assert sorted((64 - filled).astype(int).tolist()) == plain_best_fit(sizes.tolist(), 64)
        for k in range(count):
            at = np.flatnonzero(sequence == k)
            at = at[np.argsort(offset[at])]
            assert offset[at].tolist() == [0, *np.cumsum(sizes[at])[:-1]]
    assert packing.best_fit(np.zeros(0, np.int64), 64)[2] == 0
