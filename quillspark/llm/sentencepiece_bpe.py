"""Exact encoding and decoding with a merge-type (BPE) sentencepiece model, by backtracking.

Merging takes the pair of neighbours whose union ranks best, again and again. Its result is the one sequence of
pieces in which every two neighbours stay apart when their text is merged by itself. So a text is covered from left
to right with the longest pieces that an Aho-Corasick automaton finds; a piece that may not follow the one before
gives way to its next shorter match, and where none is left the last piece is taken back. A bitfield marks the
positions from which the rest has failed, so no position is tried twice and the time is linear in the text.

Characters in no piece stand alone and become bytes. No piece of the model has a space mark behind another character
(checked at loading), so the text falls into units of space marks and what follows them; the ids of short units are
kept in a memory bounded by bytes, and decoding can differ from the text only where a unit has byte ids.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Memory, map_texts

SPACE = "▁"
UNIT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: Pairs of pieces that are remembered, some 140 bytes each.
REMEMBERED = 250_000
GAP = "\x00\n"


class PieceCodec:
    def __init__(self, path: str):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(p.get_piece_size())
        self.pieces = [p.id_to_piece(i) for i in ids]
        self.bytes = {int(self.pieces[i][1:-1], 16): i for i in ids if p.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.special = {i for i in ids if p.is_control(i)}
        self.unk, self.eos = p.unk_id(), p.eos_id()
        self.id = {self.pieces[i]: i for i in ids if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))}
        self.rank = {x: p.get_score(i) for x, i in self.id.items()}
        if p.normalize("a  b \t") != f"{SPACE}a{SPACE}{SPACE}b{SPACE}\t" or len(self.bytes) != 256:
            raise ValueError(f"{path}: a model with identity normalization and byte fallback is needed")
        if any(re.search(f"[^{SPACE}]{SPACE}", x) for x in self.id):
            raise ValueError(f"{path}: its pieces cross the starts of words")
        self.find = ahocorasick.Automaton()
        self.usable = {x: i for x, i in self.id.items() if self.merged(x) == [x]}  # no text ever gets another piece
        for x in self.usable:
            if len(x) > 1:
                self.find.add_word(x, len(x))
        self.find.make_automaton()
        self.last_byte = max(self.byte_of)
        self.any_odd = False
        if any(c not in self.usable for x in self.usable for c in x):
            raise ValueError(f"{path}: a character of its pieces is no piece")
        self.apart: dict[int, bool] = {}
        self.memory = Memory()  # of a unit without its first space mark: its ids in decimal, and its decoded text where that is another one
        self.decimal = [str(i) for i in ids]

    def merged(self, text: str) -> list[str]:
        """text by the merges themselves; for texts of a few characters."""
        parts, rank = [*text], self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r > best):
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging the pieces a and b gives them again."""
        found = self.apart.get(a << 20 | b)
        if found is None:
            if len(self.apart) >= REMEMBERED:
                self.apart.clear()
            x, y = self.pieces[a], self.pieces[b]
            found = self.apart[a << 20 | b] = self.merged(x + y) == [x, y]
        return found

    def split(self, unit: str) -> list[int]:
        """The ids of a unit."""
        longest = [1] * len(unit)
        for end, size in self.find.iter(unit):  # by ends: the last for a start is the longest
            longest[end - size + 1] = size
        return self.cover(unit, longest)

    def cover(self, unit: str, longest: list[int]) -> list[int]:
        n, usable, apart = len(unit), self.usable, self.apart
        failed = bytearray((n >> 3) + 1)
        out: list[int] = []  # -1: a character in no piece, which stays apart from all
        sizes: list[int] = []
        at, size, last = 0, longest[0], -1
        while at < n:
            end = at + size
            if not failed[end >> 3] >> (end & 7) & 1:
                i = usable.get(unit[at:end], -1)
                if last < 0 or i < 0 or ((ok := apart.get(last << 20 | i)) is None and self.may_follow(last, i)) or ok:
                    out.append(i)
                    sizes.append(size)
                    at, last = end, i
                    size = longest[at] if at < n else 0
                    continue
            size -= 1
            while size > 1 and unit[at : at + size] not in usable:
                size -= 1
            while size < 1:  # nothing fits here: this position has failed, the last piece goes
                failed[at >> 3] |= 1 << (at & 7)
                size = sizes.pop()
                at -= size
                out.pop()
                last = out[-1] if out else -1
                size -= 1
                while size > 1 and unit[at : at + size] not in usable:
                    size -= 1
        if -1 in out:
            ids, at = [], 0
            for i, size in zip(out, sizes):
                ids += [i] if i >= 0 else [self.bytes[b] for b in unit[at].encode("utf-8", "surrogatepass")]
                at += size
            return ids
        return out

    def encode(self, text: str) -> list[int]:
        """Without begin or end ids."""
        return [i for u in self.units(text) for i in self.split(u)]

    @staticmethod
    def units(text: str) -> list[str]:
        return UNIT.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def decode(self, ids: list[int]) -> str:
        text = self.text_of(ids)
        return text[1:] if text[:1] == " " else text

    def text_of(self, ids: list[int]) -> str:
        """Pieces joined, space marks as spaces; runs of byte ids as UTF-8, each wrong byte as U+FFFD."""
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(_utf8(bytes(raw)))
                raw.clear()
            if i == self.unk:
                out.append(" ⁇ ")
            elif i not in self.special:
                out.append(self.pieces[i].replace(SPACE, " "))
        if raw:
            out.append(_utf8(bytes(raw)))
        return "".join(out)

    def learn(self, units: list[str]) -> None:
        """Remembers units, given without their first space mark.

        The automaton runs once over the units joined by a line break behind a null character, which no piece holds.
        """
        text = "".join([f"{SPACE}{u}{GAP}" for u in units])
        longest = [1] * len(text)
        for end, size in self.find.iter(text):
            longest[end - size + 1] = size
        at, decimal, put, byte_of, last_byte = 0, self.decimal, self.memory.put, self.byte_of, self.last_byte
        for u in units:
            n = len(u) + 1
            ids = self.cover(text[at : at + n], longest[at : at + n])
            at += n + len(GAP)
            spelled = " ".join([decimal[i] for i in ids])
            if min(ids) <= last_byte and any(i in byte_of for i in ids) and (back := self.text_of(ids)) != f" {u}".replace(SPACE, " "):
                put(u, (spelled, back))
                self.any_odd = True
            else:
                put(u, spelled)

    def digests(self, texts: list[str]) -> list[tuple[int, str, str, str]]:
        """For each text: number of ids with the end id, SHA-256 of the ids, SHA-256 of the decoded text, that text."""
        rows = []
        for x in texts:
            if not x:
                rows.append([])
            elif "  " in x or x[0] == " " or SPACE in x:
                rows.append([u[1:] for u in self.units(x)])
            else:
                rows.append(x.split(" "))
        need = self.memory.begin({u for row in rows for u in row})
        for i in range(0, len(need), 5000):
            self.learn(need[i : i + 5000])
        known, out, end = self.memory.known, [], str(self.eos)
        for text, row in zip(texts, rows):
            found = [known[u] for u in row]
            if self.any_odd and any(type(x) is tuple for x in found):
                back = "".join([x[1] if type(x) is tuple else f" {u}" for u, x in zip(row, found)]).replace(SPACE, " ")[1:]
                found = [x[0] if type(x) is tuple else x for x in found]
            else:
                back = text.replace(SPACE, " ")
            ids = " ".join([*found, end])
            out.append((ids.count(" ") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back))
        return out


def _utf8(raw: bytes) -> str:
    """raw decoded; each byte that starts no valid character becomes U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


@lru_cache(maxsize=2)
def load(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode_decode(docs: DataFrame, path: str, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per input row: its id (or the columns of keep), n_tokens (with the end id), ids_sha256, decoded_sha256.

    A null or empty text has the end id only and decodes to ''. Null ids and repeated rows are kept; columns that are
    not named are not read. with_text adds the decoded text as `decoded`. A map: no shuffle; the memory of units and
    pairs is bounded.
    """

    def run(texts: list[str]) -> dict[str, list]:
        codec = load(path)
        rows = codec.digests(texts)
        return {"n_tokens": [x[0] for x in rows], "ids_sha256": [x[1] for x in rows], "decoded_sha256": [x[2] for x in rows], "decoded": [x[3] for x in rows] if with_text else None}

    s = pa.string()
    fields = [("n_tokens", pa.int64()), ("ids_sha256", s), ("decoded_sha256", s)] + [("decoded", s)] * with_text
    keep = keep or ["doc_id"]
    docs = docs.withColumn("doc_id", F.col(id_col)) if id_col != "doc_id" else docs
    return map_texts(docs, run, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", decoded string" * with_text, pa.schema(fields), keep, text_col)
