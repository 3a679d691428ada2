"""Token counts of whole texts by a public tokenizer file (tokenizers' .json or sentencepiece's .model).

Texts of more than a chunk's length are cut into overlapping chunks. A chunk's tokens are counted (word by word where
words are stable, each word once for as long as it is remembered); the overlap of two neighbours is encoded with offsets
as the end of the one and as the begin of the other, and they are spliced at a boundary that both have and that is proven
stable: what the one has behind it and the other before it is taken off again. Where an overlap holds none, the text goes
chunk by chunk, and the overlap is widened until one is found or the chunks have become one.

A boundary is stable if nothing on its left can change what stands on its right, and the reverse:
* .json: the position before a white-space character that follows another character, or behind a digit.
  White space is dropped by the splitter, composes with nothing, and is part of no added token, and a digit
  is a split of its own. The class of models for which this holds is checked when the file is loaded
  (`_stable_json`); others have no stable boundary, so their texts are encoded whole.
* .model: the position before a space that follows a non-space, if no piece holds such a pair.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_left
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Memory, map_texts

#: In code points.
CHUNK, OVERLAP = 8_192, 192
LIMIT = 2048


class _Json:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            self.stable = re.compile(r"(?<=\S)(?=\s)|(?<=[0-9])(?=\S)") if _stable_json(json.load(f)) else None

        self.memory = Memory(64 << 20)

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text: the sum over its parts between spaces and line breaks, which part it for good."""
        if self.stable is None:
            return self.lengths(texts)
        rows = [x.replace("\n", " ").split(" ") for x in texts]
        need = self.memory.begin({w for row in rows for w in row})
        for i in range(0, len(need), 5000):
            part = need[i : i + 5000]
            for w, n in zip(part, self.lengths(part)):
                self.memory.put(w, n)
        known = self.memory.known
        return [sum(map(known.__getitem__, row)) for row in rows]

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def spans(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        return [x.offsets for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]


class _Model:
    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        p = self.processor
        crossing = any(re.search("[^▁]▁", p.id_to_piece(i)) for i in range(p.get_piece_size()))
        plain = p.normalize("a  b \t") == "▁a▁▁b▁\t"  # spaces are kept and only they are rewritten
        self.stable = re.compile("(?<=[^ ])(?= )") if plain and not crossing else None

    def count(self, texts: list[str]) -> list[int]:
        return self.lengths(texts)

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.processor.encode(texts, num_threads=1)] if texts else []

    def spans(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """The mark put before a text is a token, or part of one, that starts at 0."""
        return [x["offsets"] for x in self.processor.encode_as_offset_mapping(texts, num_threads=1)] if texts else []


def _stable_json(spec: dict) -> bool:
    """Whether white space and digits part the text for good in this tokenizer."""
    kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = next((x for x in pre if x["type"] == "Split"), None)
    added = [x["content"] for x in spec.get("added_tokens", [])]
    return (
        kinds == ["NFC", "Replace", "Lowercase"]
        and split is not None
        and split["behavior"] == "Removed"
        and split["invert"]
        and split["pattern"].get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        and not any(re.search(r"[\s0-9]", x) for x in added)
        and not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec.get("added_tokens", []))
    )


@lru_cache(maxsize=4)
def load(path: str) -> _Json | _Model:
    return _Json(path) if path.endswith(".json") else _Model(path)


def counts(coder: _Json | _Model, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Tokens of each text: short ones at once, long ones in overlapping chunks that are spliced."""
    if coder.stable is None:
        return coder.lengths(texts)
    starts = [range(0, max(len(x) - overlap, 1), chunk - overlap) if len(x) > chunk else range(1) for x in texts]
    each = iter(coder.count([x[a : a + chunk] for x, s in zip(texts, starts) for a in s]))
    n = [sum(next(each) for _ in s) for s in starts]
    # the overlaps: as the left chunk's end, with some text before it, and as the right chunk's begin
    joints = [(i, max(a, b - overlap), b, a + chunk) for i, s in enumerate(starts) for a, b in zip(s, s[1:])]
    ends = coder.spans([texts[i][a:end] for i, a, _, end in joints])
    begins = coder.spans([texts[i][at:end] for i, _, at, end in joints])
    failed = set()
    for (i, a, at, end), left, right in zip(joints, ends, begins):
        cut = _boundary(coder, texts[i], a, left, at, right, end)
        if cut is None:
            failed.add(i)
        else:
            n[i] -= len(left) - bisect_left(left, (cut - a,)) + bisect_left(right, (cut - at,))
    for i in failed:
        n[i] = splice(coder, texts[i], chunk, overlap)
    return n


def splice(coder: _Json | _Model, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of text, chunk by chunk, with overlaps that widen where alignment fails."""
    if coder.stable is None or len(text) <= chunk:
        return coder.lengths([text])[0]
    total, start, end = 0, 0, chunk
    left = coder.spans([text[:end]])[0]  # offsets count from start
    begin = 0  # tokens before it are counted
    while end < len(text):
        width = overlap
        while True:
            at = max(start, end - width)
            if at == start:  # no stable boundary in the whole chunk: the chunk grows
                end = min(len(text), end + max(chunk, end - start))
                left = coder.spans([text[start:end]])[0]
                break
            stop = min(len(text), at + max(chunk, 2 * width))
            right = coder.spans([text[at:stop]])[0]
            cut = _boundary(coder, text, start, left, at, right, end)
            if cut is not None and cut >= begin:
                total += bisect_left(left, (cut - start,)) - bisect_left(left, (begin - start,))
                left, start, end, begin = right, at, stop, cut
                break
            width *= 2
    return total + len(left) - bisect_left(left, (begin - start,))


def _boundary(coder, text: str, start: int, left: list, at: int, right: list, end: int) -> int | None:
    """A stable position in the middle half of the overlap (from at to end) around which both encodings have the same tokens.

    left's spans count from start, right's from at; both are in order.
    """
    low, high = at + (end - at) // 4, end - (end - at) // 4
    for m in coder.stable.finditer(text, low, high):
        cut = m.start()
        i, j = bisect_left(left, (cut - start,)), bisect_left(right, (cut - at,))
        # what a token covers before the boundary, back to the middle of the way to the overlap's begin
        near = at + (cut - at) // 2
        if (not i or start + left[i - 1][1] <= cut) and (not j or at + right[j - 1][1] <= cut):
            p, q = bisect_left(left, (near - start,)), bisect_left(right, (near - at,))
            if i - p == j - q and all(start + a == at + c and start + b == at + d for (a, b), (c, d) in zip(left[p:i], right[q:j])):
                return cut
    return None


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per input row: its id, n_bytes (UTF-8), n_tokens, over_limit.

    A null or empty text has 0 bytes and 0 tokens; a null id is kept; repeated rows give repeated rows; other columns
    are not read. Special strings inside texts are what the library makes of them by default. A plain map: no shuffle,
    and no row is held longer than its batch.
    """

    def run(texts: list[str]) -> dict[str, list]:
        return {"n_tokens": counts(load(path), texts, chunk, overlap)}

    sized = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    out = map_texts(sized, run, "n_tokens long", pa.schema([("n_tokens", pa.int64())]), ["doc_id", "n_bytes"])
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
