"""Secret spans of whole texts, with multipart credential linking.

Base spans are strong by themselves: assignments to a secret's name, access identifiers, long hexadecimal runs.
Weak candidates (a 40-character token, a service endpoint) mean nothing alone. They are reported only where the parts
of one credential meet: an interval join, in each document, of access identifiers with weak tokens and with endpoints
whose gap is at most `scope` code points. The join sorts by position and looks up by bisection, so its cost follows
the links, never the product of the parts.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.llm.common import map_texts

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: '=' or ':' may stand before it (KEY=value), and a full stop or '=' padding behind it; padding belongs to it.
WEAK = re.compile(r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/_-])={0,2}")
#: A host name is tried once, at its first label, so a long run of labels costs no more than its length.
ENDPOINT = re.compile(r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?|(?<![a-z0-9-])(?<![a-z0-9-]\.)[a-z0-9-]+(?:\.[a-z0-9-]+)*\.amazonaws\.com")
SCOPE = 500
ORDER = {"assign": 0, "access": 1, "hex": 2, "linked_secret": 3, "linked_endpoint": 4}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping matches of each kind; (start, end, kind), in code points."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], ORDER[x[2]]))


def linked(text: str, base: list[tuple[int, int, str]], scope: int = SCOPE) -> list[tuple[int, int, str]]:
    """Weak tokens near an access identifier, and endpoints near an identifier that has a secret part near it too."""
    access = [x for x in base if x[2] == "access"]
    if not access:
        return []
    taken = [x for x in base if x[2] != "access"]
    strong = Intervals(taken)
    weak = [(m.start(), m.end(), "linked_secret") for m in WEAK.finditer(text)]
    weak = [w for w in weak if not strong.near(w, 0)]
    secrets, ids = Intervals(sorted([*weak, *taken])), Intervals(access)
    whole = Intervals([a for a in access if secrets.near(a, scope)])
    points = [(m.start(), m.end(), "linked_endpoint") for m in ENDPOINT.finditer(text)]
    return [w for w in weak if ids.near(w, scope)] + [p for p in points if whole.near(p, scope)]


class Intervals:
    """Spans in the order of their starts, with the furthest end of each head of the list."""

    def __init__(self, spans: list[tuple[int, int, str]]):
        self.starts = [x[0] for x in spans]
        self.ends = list(accumulate((x[1] for x in spans), max))

    def near(self, span: tuple[int, int, str], scope: int) -> bool:
        """Whether a span of the list starts at most `scope` behind the end of this one and ends at most `scope` before its start."""
        i = bisect_right(self.starts, span[1] + scope)
        return i > 0 and self.ends[i - 1] >= span[0] - scope


def show(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find_secrets(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id, counts of the base kinds, a digest of the base spans, and all spans as text.

    A null or empty text has no span (the digest is that of the empty string); null ids and repeated rows are kept;
    other columns are not read. Links never cross documents, so this is a map without any shuffle.
    """

    def run(texts: list[str]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked")}
        for text in texts:
            base = base_spans(text)
            more = linked(text, base, scope) if base else []
            kinds = [x[2] for x in base]
            for k in ("assign", "access", "hex"):
                out[f"n_{k}"].append(kinds.count(k))
            out["base_sha256"].append(hashlib.sha256(show(base).encode()).hexdigest())
            out["spans"].append(show(sorted([*base, *more], key=lambda x: (x[0], ORDER[x[2]]))))
            out["n_linked"].append(len(more))
        return out

    i, s = pa.int64(), pa.string()
    arrow = pa.schema([("n_assign", i), ("n_access", i), ("n_hex", i), ("base_sha256", s), ("spans", s), ("n_linked", i)])
    return map_texts(docs.withColumnRenamed(id_col, "doc_id") if id_col != "doc_id" else docs, run, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long", arrow, ["doc_id"], text_col)
