"""Best-fit packing of documents into token sequences, certified by lower bounds.

Texts are encoded and cut into pieces of at most a sequence's length, and a task packs blocks of its pieces at once by
best-fit decreasing, so the first packing needs no shuffle. Lengths are small numbers, so a block is a table of how many
pieces there are of each length: best fit goes by classes of room left, and lower bounds by dual-feasible functions
(length itself, Martello and Toth's threshold functions, Fekete and Schepers' rounded ones, and both in turn) are
products of such tables. A block whose number of sequences equals a bound is certified: nobody can pack it better.

The same bounds over the lengths of all pieces say what all blocks together can reach. As long as there are more
sequences, those with room left are dealt anew into groups, so that their documents meet those of other blocks, and are
packed again; a group that does not gain keeps what it had. Full sequences stay. Where one group is left and it is still
above the bound, it also gets the sequences outside that have most room, and those of most pieces, whose small documents
fill gaps.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections import defaultdict
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Memory, cuts, scratch, written
from quillspark.llm.token_count import _stable_json

LENGTH, END = 2048, 0
#: Pieces that are packed at once; rounds of exchange at most; bytes of text that are encoded at once.
BLOCK, ROUNDS, BYTES = 50_000, 8, 4 << 20
#: From this round on a deal that gains nothing is the last one.
LAST = 4
#: Parameters of the rounded functions, alone and behind thresholds.
FACTORS, BEHIND, THRESHOLDS = 100, 24, 32


#: Letters that every normalization but lower case leaves alone, and signs that stand in no contraction and no special string.
PLAIN = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]*)([!-&(-/:;=-@\[-`{-~]*)")


class Encoder:
    """Token ids of texts, each with the end id behind it.

    Where the model parts texts for good at spaces and line breaks, each distinct word of a batch is encoded once, for as
    long as it is remembered. A word of Latin letters with signs behind them is two units of such a model, which its
    merges get as they are; any other word goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.parts = _stable_json(spec)
        pre = [x for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if x["type"] != "Split"]
        self.plain = self.parts and [(x["type"], x.get("add_prefix_space"), x.get("use_regex")) for x in pre] == [("ByteLevel", False, False)] and all(x["content"].startswith("<") for x in spec.get("added_tokens", []))
        self.of_byte = {b: c for b, c in enumerate(_byte_letters()) if chr(b) != c}
        self.memory, self.signs = Memory(192 << 20), {}

    def unit(self, text: str) -> list[int]:
        """Ids of lower-case letters, or of signs."""
        raw = text if text.isascii() else text.encode().decode("latin-1").translate(self.of_byte)
        return [t.id for t in self.tokenizer.model.tokenize(raw)]

    def learn(self, words: list[bytes]) -> None:
        rest, put, match, unit, signs = [], self.memory.put, PLAIN.fullmatch, self.unit, self.signs
        for w in words:
            m = match(w.decode()) if self.plain else None
            if m is None:
                rest.append(w)
                continue
            letters, end = m.groups()
            ids = array("I", unit(letters.lower()) if letters else ())
            if end:
                if end not in signs:
                    if len(signs) >= 10_000:
                        signs.clear()
                    signs[end] = array("I", unit(end))
                ids += signs[end]
            put(w, ids.tobytes())
        for i in range(0, len(rest), 5000):
            part = rest[i : i + 5000]
            for w, x in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)):
                self.memory.put(w, array("I", x.ids).tobytes())

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids begin and the end). Null: empty."""
        texts = pc.fill_null(texts, "")
        if self.parts:
            if self.plain and not pc.any(pc.match_substring(texts, "<")).as_py():  # no special string, so case does not matter
                texts = pc.ascii_lower(texts)
            lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
            words, edge = lists.flatten().dictionary_encode(), lists.offsets.to_numpy()
            edge = edge - edge[0]
        else:
            words, edge = texts.dictionary_encode(), np.arange(len(texts) + 1)
        distinct = _raw(words.dictionary)
        self.learn(self.memory.begin(distinct))
        known = [*map(self.memory.known.__getitem__, distinct), array("I", [END]).tobytes()]
        table, n = np.frombuffer(b"".join(known), "<u4"), np.fromiter(map(len, known), np.int64, len(known)) // 4
        at = np.insert(words.indices.to_numpy(), edge[1:], len(distinct))  # the end is a word behind each text
        size = n[at]
        stop = np.cumsum(size)
        ids = table[np.arange(stop[-1]) + np.repeat((np.cumsum(n) - n)[at] - stop + size, size)]
        return ids, np.concatenate([[0], stop[edge[1:] + np.arange(len(texts))]])


def _raw(texts: pa.Array) -> list[bytes]:
    """The texts' bytes, cut out of their buffer."""
    edge = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1 + texts.offset)[texts.offset :].tolist()
    data = memoryview(texts.buffers()[2] or b"")
    return [bytes(data[a:b]) for a, b in zip(edge, edge[1:])]


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level models: printable ones for themselves, the others from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


@lru_cache(maxsize=2)
def load(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=4)
def _functions(c: int) -> tuple[np.ndarray, np.ndarray]:
    """(dual-feasible functions as rows of values of the lengths 0 to c, what a full sequence is worth in each)."""
    x = np.arange(c + 1, dtype=np.int64)

    def rounded(v: np.ndarray, k: int) -> np.ndarray:  # in units of 1 / (k * c)
        return np.where((k + 1) * v % c == 0, k * v, (k + 1) * v // c * c)

    def threshold(t: int) -> np.ndarray:
        return np.where(x > c - t, c, np.where(x >= t, x, 0))

    rows, worth = [x], [c]
    for t in range(1, c // 2 + 1):
        rows.append(threshold(t))
        worth.append(c)
    for k in range(1, FACTORS + 1):
        rows.append(rounded(x, k))
        worth.append(k * c)
    for t in range(max(1, c // (2 * THRESHOLDS)), c // 2 + 1, max(1, c // (2 * THRESHOLDS))):
        for k in range(1, BEHIND + 1):
            rows.append(rounded(threshold(t), k))
            worth.append(k * c)
    return np.array(rows), np.array(worth, np.int64)


def lower_bound(histogram: np.ndarray, length: int = LENGTH) -> int:
    """Sequences that pieces need at least; histogram: how many there are of each length from 0."""
    values, worth = _functions(length)
    h = np.asarray(histogram, np.int64)
    if int(h.sum()) * int(values.max()) >= 1 << 62:  # beyond 64 bits: the plain functions in Python's numbers
        h, values, worth = h.astype(object), values[: length // 2 + 1].astype(object), worth[: length // 2 + 1].astype(object)
    return int(max(-(-(values @ h) // worth)))


def best_fit(lengths: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, int]:
    """(sequence of each piece, its place there, number of sequences) by best-fit decreasing."""
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    sizes, first = np.unique(-lengths[order], return_index=True)
    stops = np.append(first[1:], len(lengths))
    room: defaultdict[int, list[int]] = defaultdict(list)  # sequences by the room that they have left
    some, count = 0, 0  # bits of the rooms that occur; sequences
    for size, i, stop in zip((-sizes).tolist(), first.tolist(), stops.tolist()):
        while i < stop:
            rest = some >> size
            if rest:
                left = (rest & -rest).bit_length() - 1 + size
                of = room[left].pop()
                if not room[left]:
                    some &= ~(1 << left)
            else:
                of, left, count = count, length, count + 1
            n = min(left // size, stop - i)  # the fullest sequence stays the fullest
            at = order[i : i + n]
            sequence[at], offset[at] = of, length - left + size * np.arange(n)
            i, left = i + n, left - n * size
            if left:
                room[left].append(of)
                some |= 1 << left
    return sequence, offset, count


#: How a sequence's number is made: round, block or group, number there.
BITS_ROUND, BITS_SEQUENCE = 58, 22
COLUMNS = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long, room long, pieces long, certified boolean"
#: A certified block gives sequences to the exchange whose room is this share of a sequence at least; others give all with room.
SHARE = 16


def _packed(f: pd.DataFrame, base: int, length: int) -> pd.DataFrame:
    """f with each piece's sequence and offset, the room that is left there, how many pieces stand there, and whether nobody packs f better."""
    lengths = f["length"].to_numpy()
    sequence, offset, count = best_fit(lengths, length)
    filled, pieces = np.bincount(sequence, lengths, count).astype(np.int64), np.bincount(sequence, minlength=count)
    certified = count == lower_bound(np.bincount(lengths, minlength=length + 1), length)
    return f.assign(sequence_id=base + sequence, offset=offset, room=(length - filled)[sequence], pieces=pieces[sequence], certified=certified)


def first_packing(docs: DataFrame, path: str, length: int, ids: bool, block: int, id_col: str, text_col: str) -> DataFrame:
    """All pieces, packed in blocks of the tasks that encode them. ids: whether the ids themselves are kept, four bytes each."""

    def run(batches):
        held, size, blocks = [], 0, 0

        def out():
            f = pd.DataFrame({k: np.concatenate([x[k] for x in held]) for k in ("piece", "start", "length", "ids_crc32")})
            base = (TaskContext.get().partitionId() << 14) + blocks << BITS_SEQUENCE
            f = _packed(f, base, length)
            arrays = {"doc_id": pa.concat_arrays([x["doc_id"] for x in held])} | {k: pa.array(f[k].to_numpy()) for k in ("piece", "start", "length", "ids_crc32", "sequence_id", "offset", "room", "pieces", "certified")}
            arrays["ids"] = pa.array([y for x in held for y in x["ids"]], pa.binary()) if ids else pa.nulls(len(f), pa.binary())
            return pa.RecordBatch.from_pydict({k.split()[0]: arrays[k.split()[0]] for k in COLUMNS.split(", ")})

        for batch in batches:
            texts = batch.column(1)
            for a, b in cuts(texts, BYTES):
                tokens, edge = load(path).encode(texts.slice(a, b - a))
                n = np.diff(edge)
                parts = -(-n // length)
                doc = np.repeat(np.arange(len(n)), parts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = piece * length
                sizes = np.minimum(n[doc] - start, length)
                raw, at = memoryview(tokens.tobytes()), ((edge[doc] + start) * 4).tolist()
                cells = [raw[x : x + 4 * k] for x, k in zip(at, sizes.tolist())]
                crc = np.fromiter(map(zlib.crc32, cells), np.int64, len(cells))
                held.append({"doc_id": batch.column(0).slice(a, b - a).take(pa.array(doc)), "piece": piece.astype(np.int32), "start": start, "length": sizes, "ids_crc32": crc, "ids": [bytes(x) for x in cells] if ids else []})
                size += len(doc)
                if size >= block:
                    yield out()
                    held, size, blocks = [], 0, blocks + 1
        if held:
            yield out()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, COLUMNS)


def _state(table: DataFrame) -> tuple[int, int]:
    """(sequences, pieces)."""
    return table.agg(F.count_if(F.col("offset") == 0), F.count("*")).first()


def pack(docs: DataFrame, path: str, length: int = LENGTH, ids: bool = False, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, ids (null unless asked for), sequence_id, offset, room, pieces, certified.

    A null or empty text is the end id alone. Rows with the same or a null id are documents of their own. room: what is
    left of the piece's sequence; pieces: how many stand there; certified: whether a bound says that the block or group
    it was packed with cannot take fewer sequences. No documents give no row. Other columns are not read.
    The result reads the tables of the rounds, which stay until they are removed.
    """
    spark = docs.sparkSession
    folder = scratch(spark)
    table = written(first_packing(docs, path, length, ids, block, id_col, text_col), folder, "round0")
    lengths = table.groupBy("length").agg(F.count("*").alias("n")).collect()  # as many as a sequence is long
    histogram = np.zeros(length + 1, np.int64)
    for size, n in lengths:
        histogram[size] = n
    bound, (count, _) = lower_bound(histogram, length), _state(table)
    done, pool = [], table
    for k in range(1, ROUNDS + 1):
        if count <= bound:
            break
        open_ = (F.col("room") * SHARE >= length) | (F.col("room") > 0) & ~F.col("certified")
        done.append(pool.filter(~open_))
        pool = pool.filter(open_)
        bins, rows = _state(pool)
        groups = max(1, -(-rows // block))
        if groups == 1 and k > 1:  # what lies in one group does not get better alone
            firsts, most = reduce(DataFrame.unionByName, done).filter("offset = 0"), max(1, k * block // 50)
            best = lambda by, firsts=firsts, most=most: firsts.orderBy(F.desc(by), "sequence_id").limit(most).select("sequence_id")
            rich = F.broadcast(written(best("room").unionByName(best("pieces")).distinct(), folder, f"rich{k}"))  # some thousand numbers
            pool = reduce(DataFrame.unionByName, [pool, *(x.join(rich, "sequence_id", "left_semi") for x in done)])
            done = [x.join(rich, "sequence_id", "left_anti") for x in done]
            bins = _state(pool)[0]
        pool = written(_again(pool, k, groups, length), folder, f"round{k}")
        before, count = count, count - bins + _state(pool)[0]
        if before == count and (groups > 1 or k >= LAST):
            break  # groups as large as these do not gain by another deal
    return reduce(DataFrame.unionByName, [*done, pool])


def _again(pool: DataFrame, k: int, groups: int, length: int) -> DataFrame:
    """The pool's sequences, dealt into groups whole and packed anew; a group that needs more than before keeps what it had."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        group, f = int(f["group"].iloc[0]), f.drop(columns="group")
        new = _packed(f, (k << BITS_ROUND) + (group << BITS_SEQUENCE), length)
        return new if new["sequence_id"].nunique() <= f["sequence_id"].nunique() else f

    dealt = pool.withColumn("group", F.pmod(F.xxhash64("sequence_id", F.lit(k)), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(run, COLUMNS)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): whole sequences as binary little-endian numbers of four bytes, from `pack` with ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # a sequence's length at most
    joined = F.aggregate(parts, F.lit(b""), lambda s, x: F.concat(s, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))
