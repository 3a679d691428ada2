"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax, beside a smoothed unigram score.

Every counted word is an outcome. Words are counted over all training rows, and each belongs to one of `CLASSES` classes:
the `LISTED` most frequent ones are dealt so that the classes weigh alike, the others go by their hash; an unknown word
stands in each class. A word's chance is that of its class in its context times its chance within the class behind the
word before. Both are maximum-entropy distributions over the unigram ones:

* The class behind a listed word is a softmax whose features are the word before, the two words before (hashed into
  `HASHED` rows) and the word before the last (a skip). It is trained in rounds over disjoint parts of all training rows:
  each task takes gradient steps (Adagrad) from the round's weights, and the weights of all tasks are averaged, piece by
  piece and in two steps, on the executors.
* The class behind any other word, and the word within its class, have a sparse feature for each pair that occurs in the
  training rows, so these grow with the corpus. Their weights are never in one place: contexts are hashed into ranges of
  keys (those of a listed word by the class too, so that no frequent word is a hot key), and each range is one shard that
  takes gradient steps on its own. Blocks of rows send each of their pairs once, with its count, as differences of sorted
  keys, and get one number for each back.

All of this works on blocks of rows, written once: the distinct words of a block and its tokens as numbers of them.
Counting goes the same way as pairs do: a block sends each of its distinct words once to the shard of its hash, and gets
its count back. Words, pairs and contexts are told apart by hashes: of 64 bits for words, of as many as the vocabulary
asks for in keys.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cuts, scratch, written
from quillspark.llm.hashing import mix, words

LISTED, CLASSES, HASHED = 4096, 32, 1 << 13
#: Classes that words go to by their hash which are not listed; each has an unknown word.
OPEN_CLASSES = 8
PIECES, ROUNDS, RATE, SLICE = 32, 2, 0.1, 50_000
ALPHA = 0.1
#: Counts are discounted by what their own numbers of ones and twos say (see `discount_of`), within these bounds.
BOUNDS, STEPS = (0.1, 0.95), 12
#: Tokens in a block, about; tokens that a shard of pairs, and one of words, aims at.
BLOCK, SHARD, WORD_SHARD = 1_200_000, 1_500_000, 6_000_000
#: Bits of a word within a key behind a word that is not listed, besides its class; of an index of a listed word and a class;
#: of the parts of a key together, at least, so that listed words are told apart by 31 bits and their class.
WORD_BITS, INDEX_BITS, KEY_BITS = 18, 18, 49
SCRAMBLE = np.uint64(0x2545F)
UNSCRAMBLE = np.uint64(pow(0x2545F, -1, 1 << 18))
END, BEGIN = np.uint64(0x5E11D0F5A11), np.uint64(0xB0B0B0B0B0B1)
K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
CLASS_MASK, OPEN_MASK = np.uint64(CLASSES - 1), np.uint64(OPEN_CLASSES - 1)


@dataclass
class Model:
    listed: np.ndarray  # hashes of the listed words, sorted
    count: np.ndarray
    classes: np.ndarray  # of the listed words
    total: int  # N
    distinct: int  # V
    mass: np.ndarray  # of each class: the sum of the discounted counts of its words, and what its unknown word has
    weights: np.ndarray  # rows of features by CLASSES
    discount: float = 0.5  # of a word's count
    unknown: float = 1.0  # what the unknown word of a class has: an equal part of what was taken from all counts
    shards: int = 1
    context_bits: int = KEY_BITS - WORD_BITS - 5

    def share(self, count: np.ndarray) -> np.ndarray:
        """What words of these counts have of their class' mass."""
        return np.where(count > 0, count - self.discount, self.unknown)

    @property
    def payload(self) -> int:
        """Bits of a key below its flag."""
        return self.context_bits + CLASSES.bit_length() - 1 + WORD_BITS

    @property
    def split(self) -> int:
        """Shards of words behind words that are not listed; the others are behind listed ones, by their part of the tokens."""
        share = int(self.count.sum()) / max(self.total, 1)
        return min(max(1, round(self.shards * (1 - share))), self.shards - 1) if self.shards > 1 else 0

    @property
    def prior(self) -> np.ndarray:
        return np.log(self.mass / self.mass.sum()).astype(np.float32)

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Place in the list, or -1."""
        at = np.minimum(np.searchsorted(self.listed, h), len(self.listed) - 1)
        return np.where(self.listed[at] == h, at, -1)

    def class_of(self, h: np.ndarray, place: np.ndarray) -> np.ndarray:
        return np.where(place >= 0, self.classes[place], (h & OPEN_MASK).astype(np.int64))

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        return self.prior + self.weights[rows[0]] + self.weights[rows[1]] + self.weights[rows[2]]

    def chances(self, rows: list[np.ndarray]) -> np.ndarray:
        x = self.logits(rows)
        x = np.exp(x - x.max(1, keepdims=True))
        return x / x.sum(1, keepdims=True)

    def keys(self, h: np.ndarray, place: np.ndarray, cls: np.ndarray, last: np.ndarray, last_place: np.ndarray) -> np.ndarray:
        """Of each token a pair's key, below a flag that says whether the word before is listed.

        Behind a listed word: its exact place with the class, and all other bits for the word's hash. Behind another one:
        a hash of it, the class, and WORD_BITS of the word's hash.
        """
        c, low = cls.astype(np.uint64), np.uint64((1 << INDEX_BITS) - 1)
        word = mix(h)
        index = (np.maximum(last_place, 0).astype(np.uint64) * np.uint64(CLASSES) + c) * SCRAMBLE & low
        ours = index << np.uint64(self.payload - INDEX_BITS) | word >> np.uint64(64 - self.payload + INDEX_BITS)
        context = mix(last * K[0]) >> np.uint64(64 - self.context_bits)
        others = (context << np.uint64(CLASSES.bit_length() - 1) | c) << np.uint64(WORD_BITS) | word >> np.uint64(64 - WORD_BITS)
        return np.where(last_place >= 0, ours | np.uint64(1 << self.payload), others)

    def shard_of(self, keys: np.ndarray) -> np.ndarray:
        """By ranges of contexts, so in the keys' order."""
        flag = np.uint64(1 << self.payload)
        index = (keys & (flag - np.uint64(1))) >> np.uint64(self.payload - INDEX_BITS)
        context = keys >> np.uint64(WORD_BITS + CLASSES.bit_length() - 1)
        spread = lambda x, n, bits: (x >> np.uint64(max(bits - 32, 0))) * np.uint64(n) >> np.uint64(min(bits, 32))
        return np.where(keys >= flag, np.uint64(self.split) + spread(index, self.shards - self.split, INDEX_BITS), spread(context, max(self.split, 1), self.context_bits)).astype(np.int64)


def discount_of(ones: float, twos: float) -> float:
    """What a count is lowered by so that what is taken is what new events have: ones / (ones + 2 * twos)."""
    return float(np.clip(ones / (ones + 2 * twos), *BOUNDS)) if ones else BOUNDS[0]


def table_rows(distinct: int) -> int:
    """Rows of weights: words before (and the begin), words before the last (and the begin, and all unlisted), pairs."""
    return 2 * distinct + 3 + HASHED


def sequence(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens with an end behind each text, first token of each text and the end, tokens before, tokens before these)."""
    n = len(first) - 1
    start = first + np.arange(n + 1)
    seq = np.full(start[-1], END, np.uint64)
    body = np.ones(len(seq), bool)
    body[start[1:] - 1] = False
    seq[body] = h
    return seq, start, *_before(seq, start)


def _before(seq: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    last = np.concatenate([[BEGIN], seq[:-1]])
    last[start[:-1]] = BEGIN
    skip = np.concatenate([[BEGIN], last[:-1]])
    skip[start[:-1]] = BEGIN
    return last, skip


def _context(place: np.ndarray, last: np.ndarray, start: np.ndarray, listed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the list of the token before each, and of the one before that; the begin has the next place, others -1."""
    last_place = np.concatenate([[listed], place[:-1]])
    last_place[start[:-1]] = listed
    skip_place = np.concatenate([[listed], last_place[:-1]])
    skip_place[start[:-1]] = listed
    return last_place, skip_place


def features(last: np.ndarray, skip: np.ndarray, last_place: np.ndarray, skip_place: np.ndarray, listed: int) -> list[np.ndarray]:
    """Rows of weights of tokens behind listed words."""
    pair = (mix(last * K[0] + mix(skip * K[1])) >> np.uint64(64 - HASHED.bit_length() + 1)).astype(np.int64)
    return [last_place, listed + 2 + skip_place, 2 * listed + 3 + pair]


def steps(m: Model, seq: np.ndarray, start: np.ndarray, sums: np.ndarray) -> int:
    """Gradient steps of the class weights on texts; sums: the squared gradients so far. The number of tokens."""
    last, skip = _before(seq, start)
    place, listed = m.look_up(seq), len(m.listed)
    cls = m.class_of(seq, place)
    last_place, skip_place = _context(place, last, start, listed)
    ours = np.flatnonzero(last_place >= 0)
    for a in range(0, len(ours), SLICE):
        at = ours[a : a + SLICE]
        rows = features(last[at], skip[at], last_place[at], skip_place[at], listed)
        x = m.chances(rows)
        x[np.arange(len(x)), cls[at]] -= 1
        flat = np.concatenate(rows)
        used, inverse = np.unique(flat, return_inverse=True)
        g = np.stack([np.bincount(inverse, np.tile(x[:, k], 3), len(used)) for k in range(CLASSES)], 1)
        sums[used] += g**2
        m.weights[used] -= (RATE * g / np.sqrt(sums[used] + 1e-6)).astype(np.float32)
    return len(seq)


def ascend(n: np.ndarray, group: np.ndarray, base: np.ndarray, discount: float, rounds: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(weights of the pairs, normalizer of each group) of sparse maximum-entropy distributions.

    Within a group, a pair's chance is (base + weight) / normalizer, that of an outcome without a feature base /
    normalizer; the normalizer is 1 + the sum of the group's weights. Steps of gradient ascent in the logarithm of the
    weights, scaled by the pair's counts, on sum((n - discount) * log(base + weight)) - total * log(normalizer).
    """
    groups = int(group[-1]) + 1 if len(group) else 0
    want = np.maximum(n - discount, 1e-3)
    total = np.bincount(group, n, groups)
    left = total - np.bincount(group, want, groups)
    weight = want / left[group]
    for _ in range(rounds):
        z = 1 + np.bincount(group, weight, groups)
        up, down = want * weight / (base + weight), total[group] * weight / z[group]
        weight = weight * np.exp(np.clip((up - down) / (up + down), -1, 1))
    return weight, 1 + np.bincount(group, weight, groups)


def train_shard(m: Model, keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each of the sorted distinct keys, with training counts n (0: only asked for), log10 of its chance, packed (`packed`).

    The chance of the word within its class, times that of the class where the context is not listed. Where it depends
    on the unigram count of a word that is not listed, that factor is left out, and the number says so.
    """
    flag = np.uint64(1 << m.payload)
    edge = int(np.searchsorted(keys, flag))
    parts = []
    if edge:
        group = keys[:edge] >> np.uint64(WORD_BITS)
        cls = (group & CLASS_MASK).astype(np.int64)
        out, open_, number = _words(m, keys[:edge], n[:edge], group, cls, WORD_BITS)
        parts.append((out + _classes(m, n[:edge], group, cls)[number], open_))
    if edge < len(keys):
        rest = keys[edge:] ^ flag
        bits = m.payload - INDEX_BITS
        group = rest >> np.uint64(bits)
        cls = (group * UNSCRAMBLE & np.uint64((1 << INDEX_BITS) - 1) & CLASS_MASK).astype(np.int64)
        parts.append(_words(m, rest, n[edge:], group, cls, bits)[:2])
    return packed(np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts]))


def _words(m: Model, keys: np.ndarray, n: np.ndarray, group: np.ndarray, cls: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log10 of each word's chance within its class, whether the unigram factor is left out, number of its group)."""
    # hashes of listed words, told apart by class and bits; both fit into 64 bits, as a key does
    top = np.uint64(bits)
    word = keys & np.uint64((1 << bits) - 1) | cls.astype(np.uint64) << top
    named = m.classes.astype(np.uint64) << top | mix(m.listed) >> np.uint64(64 - bits)
    order = np.argsort(named)
    named, share = named[order], (m.share(m.count) / m.mass[m.classes])[order]
    at = np.minimum(np.searchsorted(named, word), len(named) - 1)
    hit = named[at] == word
    base = np.where(hit, share[at], 0.0)
    number = np.cumsum(np.concatenate([[True], group[1:] != group[:-1]])) - 1
    seen = n > 0
    weight, z = np.zeros(len(keys)), np.ones(int(number[-1]) + 1)
    if seen.any():
        compact, inverse = np.unique(number[seen], return_inverse=True)
        weight[seen], z[compact] = ascend(n[seen].astype(np.float64), inverse, base[seen], discount_of((n == 1).sum(), (n == 2).sum()))
    with np.errstate(divide="ignore"):
        return np.where(hit | seen, np.log10(base + weight), 0.0) - np.log10(z)[number], ~hit & ~seen, number


def _classes(m: Model, n: np.ndarray, group: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """log10 of the chance of each group's class behind its context, a word that is not listed."""
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    pair_n = np.add.reduceat(n, first).astype(np.float64)
    context = group[first] >> np.uint64(CLASSES.bit_length() - 1)
    c = cls[first]
    prior = np.exp(m.prior.astype(np.float64))
    owner = np.cumsum(np.concatenate([[True], context[1:] != context[:-1]])) - 1
    weight, z = np.zeros(len(first)), np.ones(int(owner[-1]) + 1)
    seen = pair_n > 0
    if seen.any():
        compact, inverse = np.unique(owner[seen], return_inverse=True)
        weight[seen], z[compact] = ascend(pair_n[seen], inverse, prior[c[seen]], discount_of((pair_n == 1).sum(), (pair_n == 2).sum()))
    return np.log10((prior[c] + weight) / z[owner])


#: log10 of chances travel as 15 bits, in steps of 1 / STEP, and one that says that a factor is left out.
STEP, OPEN = 2700, 1 << 15


def packed(logs: np.ndarray, open_: np.ndarray) -> np.ndarray:
    return (np.clip(np.rint(-logs * STEP), 0, OPEN - 1).astype(np.uint16) | np.where(open_, np.uint16(OPEN), np.uint16(0))).astype(np.uint16)


def unpacked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log10, whether a factor is left out)."""
    return (x & np.uint16(OPEN - 1)).astype(np.float64) / -STEP, x >= OPEN


def pack(keys: np.ndarray) -> bytes:
    """Sorted distinct keys as differences of so many bytes as make them short: the number of bytes, then the differences.

    A difference that these bytes cannot hold goes as several, of which all but the last are the largest number.
    """
    gap = np.diff(np.concatenate([np.zeros(1, np.uint64), keys]))
    size = lambda k: k * (len(gap) + int((gap // np.uint64((1 << 8 * k) - 1)).sum()))
    width = min(range(4, 9), key=size) if len(gap) and int(gap.max()) >= (1 << 32) - 1 else 4
    if width == 8:
        return b"\x08" + gap.astype("<u8").tobytes()
    far = np.uint64((1 << 8 * width) - 1)
    skips = (gap // far).astype(np.int64)
    out = np.full(len(keys) + int(skips.sum()), far, "<u8")
    out[np.cumsum(skips + 1) - 1] = gap % far
    return bytes([width]) + np.ascontiguousarray(out.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    width = raw[0]
    if width == 8:
        return np.cumsum(np.frombuffer(raw, "<u8", offset=1))
    cells = np.zeros((len(raw) // width, 8), np.uint8)
    cells[:, :width] = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, width)
    gap = cells.view("<u8").ravel()
    return np.cumsum(gap)[gap != np.uint64((1 << 8 * width) - 1)]


def pack_counts(n: np.ndarray) -> bytes:
    """Counts of one byte each, and the large ones behind them."""
    big = np.flatnonzero(n >= 255)
    return np.minimum(n, 255).astype(np.uint8).tobytes() + np.concatenate([big, n[big]]).astype("<i8").tobytes()


def unpack_counts(raw: bytes, size: int) -> np.ndarray:
    n = np.frombuffer(raw, np.uint8, size).astype(np.int64)
    more = np.frombuffer(raw, "<i8", offset=size).reshape(2, -1)
    n[more[0]] = more[1]
    return n


def _texts(batch: pa.RecordBatch):
    col = batch.column(batch.schema.get_field_index("text"))
    for a, b in cuts(col):
        yield a, b, [x or b"" for x in col.slice(a, b - a).cast(pa.binary()).to_pylist()]


class Block:
    """Rows of texts as numbers: ids, held-out flags, sizes, and of all tokens the word (by its hash)."""

    def __init__(self, row: dict):
        self.id, self.doc_id, self.held = row["block"], row["doc_id"], np.asarray(row["held_out"], bool)
        self.sizes = np.asarray(row["n_tokens"], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.sizes)])
        self.words = np.frombuffer(row["words"], np.uint64)
        raw = np.frombuffer(zstandard.decompress(row["tokens"]), np.uint8).reshape(-1, self.start[-1])
        self.local = sum(x.astype(np.int32) << 8 * k for k, x in enumerate(raw))
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)

    @property
    def train(self) -> np.ndarray:
        """Of each token, whether it is learned from."""
        return ~self.held[self.owner]

    def sorted_words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words in order, their training counts, where each stands in `words`)."""
        order = np.argsort(self.words)
        return self.words[order], np.bincount(self.local, self.train, len(self.words)).astype(np.int64)[order], order

    def pairs(self, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct keys in order, their training counts, token -> key)."""
        place = m.look_up(self.words)
        cls = m.class_of(self.words, place)
        seq = self.words[self.local]
        last, _ = _before(seq, self.start)
        last_place, _ = _context(place[self.local], last, self.start, len(m.listed))
        keys, index = np.unique(m.keys(seq, place[self.local], cls[self.local], last, last_place), return_inverse=True)
        return keys, np.bincount(index, self.train, len(keys)).astype(np.int64), index


def blocks_in(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield Block(batch.slice(i, 1).to_pylist()[0])


BLOCKS = "block long, doc_id array<long>, held_out array<boolean>, n_tokens array<long>, tokens binary, words binary"
ANSWERS = "block long, kind int, i int, a binary"


def make_blocks(batches):
    """From (doc_id, held_out, text). Words are numbered by their frequency in the block, and numbers stand byte by byte, which packs well."""
    long = pa.int64()
    kinds = {"block": long, "doc_id": pa.list_(long), "held_out": pa.list_(pa.bool_()), "n_tokens": pa.list_(long), "tokens": pa.binary(), "words": pa.binary()}
    at, pending, size = 0, [], 0

    def out():
        w, local, n = np.unique(np.concatenate([x[3] for x in pending]), return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        number = np.empty(len(w), np.uint32)
        number[order] = np.arange(len(w))
        bytes_ = number[local].view(np.uint8).reshape(-1, 4).T[: max(1, (len(w).bit_length() + 7) // 8)]
        cells = {"block": TaskContext.get().partitionId() << 32 | at, "doc_id": [y for x in pending for y in x[0]], "held_out": [y for x in pending for y in x[1]], "n_tokens": np.concatenate([x[2] for x in pending]).tolist(), "tokens": zstandard.compress(np.ascontiguousarray(bytes_).tobytes(), 1), "words": w[order].tobytes()}
        return pa.RecordBatch.from_arrays([pa.array([cells[k]], t) for k, t in kinds.items()], names=list(kinds))

    for batch in batches:
        for a, b, texts in _texts(batch):
            seq, start, _, _ = sequence(*words(texts))
            if pending and size + len(seq) > BLOCK:
                yield out()
                at, pending, size = at + 1, [], 0
            pending.append((batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist(), np.diff(start), seq))
            size += len(seq)
    if pending:
        yield out()


def count_words(table: DataFrame, folder: str) -> DataFrame:
    """Answers: kind 0, of each block and shard i the training counts of the block's words in order; kind 1, of each
    shard its sums (total, distinct words, words seen once and twice, and total and distinct words by hash classes); kind 2, its most frequent words."""
    tokens = table.agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda s, x: s + x))).first()[0] or 0
    shards = max(1, -(-tokens // WORD_SHARD))
    width = (1 << 64) // shards + 1

    def ask(batches):
        for b in blocks_in(batches):
            w, n, _ = b.sorted_words()
            edge = np.searchsorted(w, np.array([min(k * width, (1 << 64) - 1) for k in range(shards)], np.uint64))
            edge = np.append(edge, len(w))
            full = np.flatnonzero(np.diff(edge))
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), b.id)), pa.array([w[edge[s] : edge[s + 1]].tobytes() for s in full], pa.binary()), pa.array([pack_counts(n[edge[s] : edge[s + 1]]) for s in full], pa.binary())], names=["shard", "block", "words", "n"])

    def answer(f: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(x, np.uint64) for x in f["words"]]
        n = [unpack_counts(x, len(k)) for x, k in zip(f["n"], parts)]
        w, index = np.unique(np.concatenate(parts), return_inverse=True)
        count = np.bincount(index, np.concatenate(n), len(w)).astype(np.int64)
        back = [len(x).to_bytes(4, "little") + pack_counts(x) for x in np.split(count[index], np.cumsum([len(k) for k in parts])[:-1])]
        known = np.flatnonzero(count)
        c = (w[known] & OPEN_MASK).astype(np.int64)
        sums = np.concatenate([[count.sum(), len(known), (count == 1).sum(), (count == 2).sum()], np.bincount(c, count[known], CLASSES), np.bincount(c, minlength=CLASSES)]).astype(np.int64)
        top = known[np.lexsort((w[known], -count[known]))[:LISTED]]
        shard = int(f["shard"].iloc[0])
        return pd.DataFrame({"block": [*f["block"], -1, -1], "kind": [0] * len(f) + [1, 2], "i": shard, "a": [*back, sums.tobytes(), np.concatenate([w[top].view(np.int64), count[top]]).tobytes()]})

    asked = table.mapInArrow(ask, "shard int, block long, words binary, n binary")
    return written(asked.groupBy("shard").applyInPandas(answer, ANSWERS), folder, "words")


def fit(table: DataFrame, counted: DataFrame) -> Model:
    """The model without its pairs: list, classes and class weights."""
    sums = np.zeros(4 + 2 * CLASSES, np.int64)
    for (x,) in counted.filter("kind = 1").select("a").collect():  # some 500 bytes a shard
        sums += np.frombuffer(x, np.int64)
    total, distinct = int(sums[0]), int(sums[1])

    def listed(batches):
        for batch in batches:
            for x in batch.column(0):
                w, n = np.frombuffer(x.as_py(), np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(n)], names=["w", "n"])

    top = counted.filter("kind = 2").select("a").mapInArrow(listed, "w long, n long").orderBy(F.desc("n"), "w").limit(LISTED).toPandas()
    w, n = top["w"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    discount = discount_of(int(sums[2]), int(sums[3]))
    unknown = max(discount * distinct, 1.0) / OPEN_CLASSES
    mass = sums[4 : 4 + CLASSES] - discount * sums[4 + CLASSES :]
    mass[:OPEN_CLASSES] += unknown
    if len(w):
        np.subtract.at(mass, (w & OPEN_MASK).astype(np.int64), n - discount)
    else:
        w, n = np.array([END]), np.array([0])
    # the listed words, most frequent first, each to the class that weighs least
    heap = [(x, c) for c, x in enumerate(mass.tolist())]
    heapq.heapify(heap)
    classes = np.empty(len(w), np.int64)
    for i, k in enumerate(n.tolist()):
        x, c = heapq.heappop(heap)
        classes[i] = c
        heapq.heappush(heap, (x + k - discount, c))
    np.add.at(mass, classes, np.where(n > 0, n - discount, 0))
    o = np.argsort(w)
    m = Model(w[o], n[o], classes[o], total, distinct, mass, np.zeros((table_rows(len(w)), CLASSES), np.float32), discount, unknown)
    m.shards = max(1, -(-total // SHARD))
    m.context_bits = max(m.context_bits, int(np.ceil(np.log2(distinct + 1))) + 2)
    sc = table.sparkSession.sparkContext
    for k in range(ROUNDS):
        shared = sc.broadcast(m)

        def run(batches, shared=shared, k=k):
            base = shared.value
            mine = Model(**(base.__dict__ | {"weights": base.weights.copy()}))
            sums, tokens = np.zeros(mine.weights.shape, np.float32), 0
            for b in blocks_in(batches):
                mine_too = ~b.held & (np.arange(len(b.sizes)) % ROUNDS == k)
                seq = b.words[b.local[mine_too[b.owner]]]
                if len(seq):
                    tokens += steps(mine, seq, np.concatenate([[0], np.cumsum(b.sizes[mine_too])]), sums)
            if tokens:
                task = TaskContext.get().partitionId() % 64
                parts = [x.astype(np.float16).tobytes() for x in np.array_split(mine.weights.ravel(), PIECES)]
                yield pa.RecordBatch.from_arrays([pa.array([task] * PIECES, pa.int32()), pa.array(range(PIECES), pa.int32()), pa.array([float(tokens)] * PIECES), pa.array(parts, pa.binary())], names=["g", "piece", "tokens", "w"])

        def mean(f: pd.DataFrame) -> pd.DataFrame:
            t = f["tokens"].sum()
            total = sum(np.frombuffer(x, np.float16).astype(np.float64) * y for x, y in zip(f["w"], f["tokens"]))
            return pd.DataFrame({"g": [0], "piece": [f["piece"].iloc[0]], "tokens": [t], "w": [(total / t).astype(np.float16).tobytes()]})

        schema = "g int, piece int, tokens double, w binary"
        tasks = table.mapInArrow(run, schema)
        rows = tasks.groupBy("piece", "g").applyInPandas(mean, schema).groupBy("piece").applyInPandas(mean, schema).toPandas().sort_values("piece")
        if len(rows) == PIECES:
            m.weights = np.concatenate([np.frombuffer(x, np.float16) for x in rows["w"]]).astype(np.float32).reshape(m.weights.shape)
    return m


def class_scores(m: Model, seq: np.ndarray, start: np.ndarray) -> np.ndarray:
    """log10 of each token's class behind a listed word, 0 behind others."""
    out = np.zeros(len(seq))
    listed, place = len(m.listed), m.look_up(seq)
    last, skip = _before(seq, start)
    cls = m.class_of(seq, place)
    last_place, skip_place = _context(place, last, start, listed)
    ours = np.flatnonzero(last_place >= 0)
    for a in range(0, len(ours), SLICE):
        at = ours[a : a + SLICE]
        p = m.chances(features(last[at], skip[at], last_place[at], skip_place[at], listed))
        out[at] = np.log10(p[np.arange(len(at)), cls[at]])
    return out


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null or empty text is the end alone. A null id counts as a training row; repeated rows are counted and returned as
    often as they come. Without training rows every word is unknown. Other columns are not read. Words are told apart by
    64-bit hashes. `score` varies a little with the partitioning of the input, by which the class weights are averaged;
    the other columns do not.
    """
    spark = docs.sparkSession
    folder = scratch(spark)
    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(10)) == 0, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    table = written(rows.mapInArrow(make_blocks, BLOCKS), folder, "blocks")
    counted = count_words(table, folder)
    m = fit(table, counted)
    shared = spark.sparkContext.broadcast(m)

    def ask(batches):
        m = shared.value
        for b in blocks_in(batches):
            keys, n, _ = b.pairs(m)
            edge = np.searchsorted(m.shard_of(keys), np.arange(m.shards + 1))
            full = np.flatnonzero(np.diff(edge))
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), b.id)), pa.array([pack(keys[edge[s] : edge[s + 1]]) for s in full], pa.binary()), pa.array([pack_counts(n[edge[s] : edge[s + 1]]) for s in full], pa.binary())], names=["shard", "block", "keys", "n"])

    def answer(f: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack(x) for x in f["keys"]]
        n = [unpack_counts(x, len(k)) for x, k in zip(f["n"], keys)]
        all_keys, index = np.unique(np.concatenate(keys), return_inverse=True)
        lp = train_shard(shared.value, all_keys, np.bincount(index, np.concatenate(n), len(all_keys)).astype(np.int64))[index]
        return pd.DataFrame({"block": f["block"], "kind": 3, "i": f["shard"], "a": [x.tobytes() for x in np.split(lp, np.cumsum([len(k) for k in keys])[:-1])]})

    pairs = table.mapInArrow(ask, "shard int, block long, keys binary, n binary").groupBy("shard").applyInPandas(answer, ANSWERS)
    answers = counted.filter("kind = 0").unionByName(pairs)
    norm = float(np.log10(m.total + ALPHA * (m.distinct + 1)))

    def finish(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        m, out = shared.value, []
        for r in left.to_dict("records"):
            b = Block(r)
            _, _, order = b.sorted_words()
            c = np.empty(len(b.words))
            right = right.sort_values("i")
            c[order] = np.concatenate([unpack_counts(x[4:], int.from_bytes(x[:4], "little")) for x in right[right["kind"] == 0]["a"]])
            share = np.log10(c + ALPHA)
            inner = np.log10(m.share(c) / m.mass[m.class_of(b.words, m.look_up(b.words))])
            _, _, index = b.pairs(m)
            lp, open_ = unpacked(np.concatenate([np.frombuffer(x, np.uint16) for x in right[right["kind"] == 3]["a"]])[index])
            lp = np.where(open_, lp + inner[b.local], lp) + class_scores(m, b.words[b.local], b.start)
            size = len(b.sizes)
            out.append(pd.DataFrame({"doc_id": pd.array(list(b.doc_id), "Int64"), "held_out": b.held, "n_tokens": b.sizes, "n_known": np.bincount(b.owner, (c > 0)[b.local], size).astype(np.int64), "train_tokens": m.total, "base_score": np.bincount(b.owner, share[b.local], size) - b.sizes * norm, "score": np.bincount(b.owner, lp, size)}))
        return pd.concat(out) if out else pd.DataFrame(columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return table.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
