"""The filter audit against SQL, and against a plain run of every order over awkward rows."""

import collections
import itertools
import re

from quillspark.llm import filter_audit, queries
from tests.oracle import compare

FOLDER = "/root/testdata/sf0.001"
ROWS = [
    (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "a b", ""), (5, "a b", "b"), (None, "a b", "b"), (None, None, None), (6, "X" * 3000, "c"),
    (7, "the end of it " * 9000, "c"), (8, "the end of it " * 9000, "c"), (4, "a b", "b"), (9, "É 日本 😀 $ " * 90, "a"), (10, " ".join(f"w{i}" for i in range(300)), "a"),
    (11, " ".join(f"W{i}" for i in range(300)), "a"), (12, " ".join(f"w{i % 149}" for i in range(300)), "a"), (13, " ".join(f"w{i % 150}" for i in range(300)), "a"), (14, "\x0b a\x0cb\r", "d"), (15, "a | b", "d"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (4, 1, 1), (4, 0, 0), (5, None, 1), (8, 1, None), (None, 1, 1), (99, 1, 1), (10, 1, 0), (11, 0, 1)]


def plain(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    docs = []
    for i, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and i > first[text],
        }
        docs.append((i, part or "", {f for f, x in fails.items() if x}))
    shapley, out = collections.Counter(), {}
    for order in itertools.permutations("ABCDE"):
        for part in {p for _, p, _ in docs}:
            left = [(i, f) for i, p, f in docs if p == part]
            everyone = left
            for step, name in enumerate(order, 1):
                gone = [(i, f) for i, f in left if name in f]
                left = [(i, f) for i, f in left if name not in f]
                shapley[part, name] += len(gone)
                failing = [f for _, f in everyone if name in f]
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(f == {name} for f in failing), sum(i in good for i, _ in gone if i is not None), sum(i in toxic for i, _ in gone if i is not None)]
    return {(p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def test_audit_gives_what_sql_gives(spark, tmp_path):
    compare(queries.op11_filter_audit(spark, FOLDER), queries.ORACLE_SQL["op11_filter_audit"], FOLDER, str(tmp_path / "out"))


def test_audit_of_awkward_rows(spark):
    docs = spark.createDataFrame([(i, t, p, "x", "y", 1) for i, t, p in ROWS], "doc_id long, text string, source string, mask string, digest string, first int")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = filter_audit.filter_audit(docs, labels).collect()
    assert len(got) == 600 * 5 and {tuple(r) for r in got} == plain(ROWS, LABELS)
    assert {tuple(r) for r in filter_audit.filter_audit(docs).collect()} == plain(ROWS, [])


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filter_audit.filter_audit(docs, labels)
    assert got.count() == 0
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_other_filters(spark):
    """Survivors and steps of three filters, by a plain sum over masks."""
    counted = spark.createDataFrame([("p", 0, 5, 1), ("p", 3, 2, 2), ("p", 4, 7, 0), ("p", 7, 1, 1)], "part string, mask int, n long, weight long")
    row = filter_audit.survivors(counted, 3, ["n", "weight"]).first()
    masks = {0: (5, 1), 3: (2, 2), 4: (7, 0), 7: (1, 1)}
    for k, v in enumerate(["n", "weight"]):
        assert row[v] == [sum(c[k] for m, c in masks.items() if m & ~s == 0) for s in range(8)]
