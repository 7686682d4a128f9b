"""The filter audit against brute force over messy documents, whole groups cut by partitions, and no rows."""

import itertools
import re

import pytest

from graphloom.llm import filter_audit

W = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(docs, labels):
    last = float("inf")
    first = {}
    for i, t, _ in docs:
        first[t or ""] = min(first.get(t or "", last), last if i is None else i)
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    found = []
    for i, t, s in docs:
        t = t or ""
        w = W.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": any(c in t for c in "#$%&*|"), "E": first[t] < (last if i is None else i)}
        found.append((s or "", {k for k, v in fails.items() if v}, i is not None and i in good, i is not None and i in toxic))
    out = {}
    for part in {s for s, *_ in found}:
        rows = [x for x in found if x[0] == part]
        removed = {}
        for order in itertools.permutations("ABCDE"):
            left = rows
            for k, f in enumerate(order):
                here = [x for x in left if f in x[1]]
                out[part, "".join(order), k + 1] = [len(left) - len(here), len(here), sum(f in x[1] and bool(x[1] & set(order[:k])) for x in rows), sum(x[1] == {f} for x in rows), sum(x[2] for x in here), sum(x[3] for x in here)]
                removed[f] = removed.get(f, 0) + len(here)
                left = [x for x in left if f not in x[1]]
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                out[part, "".join(order), k + 1].append(removed[f])
    return {k: tuple(v) for k, v in out.items()}


def got(spark, docs, labels, parts=None):
    d = spark.createDataFrame([(*x, "m", 3, "b") for x in docs], "doc_id long, text string, source string, mask string, part int, before string").repartition(5)
    rows = filter_audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), parts)
    assert rows.columns == COLUMNS
    return {(r[0], r[1], r[2]): tuple(r[3:]) for r in rows.collect()}


LONG = " ".join(f"word{i}" for i in range(300))
DOCS = [(1, LONG, "a"), (2, LONG, "a"), (3, LONG + " $", "b"), (4, None, None), (5, "", "b"), (6, " \t\n ", ""), (7, "x " * 400, "a"), (8, LONG.upper(), "a"), (9, LONG + " É", "c"), (None, LONG, "a"), (None, "null id", "c"), (None, "null id", "c"), (7, "x " * 400, "b"), (12, "x " * 200000 + "#", "b"), (13, "A\x0bb\x1cc", None), (2, LONG, None)]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (7, 1, None), (8, 1, 1), (None, 1, 1), (99, 1, 1), (5, 1, 0)]


def test_audit_matches_brute_force(spark):
    assert got(spark, DOCS, LABELS) == brute(DOCS, LABELS)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_copies_over_many_partitions(spark, parts):
    docs = [(i % 90, "same", "a") for i in range(300)] + [(i, LONG, "b") for i in range(200, 300)] + [(i, f"other {i}", "a") for i in range(20)] + [(None, "same", "b")] * 3
    assert got(spark, docs, LABELS, parts) == brute(docs, LABELS)
    m = filter_audit.masks(spark.createDataFrame(docs, "doc_id long, text string, source string"), parts)
    assert m.count() == len(docs) and m.where("mask >= 16").count() == sum(i is None or i > 0 for i, t, _ in docs if t == "same") + 99


def test_no_rows(spark):
    assert got(spark, [], LABELS) == {}
    assert got(spark, DOCS, []) == brute(DOCS, [])


def test_texts_with_one_fingerprint_are_told_apart():
    import pyarrow as pa

    texts = [b"a", b"a", b"b", b"b", b"b"]
    batch = pa.RecordBatch.from_pydict({"fingerprint": [5] * 5, "doc_id": [3, 4, 1, 1, 2], "part": ["p"] * 5, "chars": [1] * 5, "text": texts})
    out = [r for b in filter_audit._compare(iter([batch.slice(0, 3), batch.slice(3)])) for r in b.to_pylist()]
    rows = [r for r in out if not r["head"]]
    assert [r["mask"] >= 16 for r in rows] == [False, True, False, False, True]
    assert [r["key"] is None for r in rows] == [False, True, False, False, True]
    assert {(r["doc_id"], r["key"]) for r in out if r["head"]} == {(3, filter_audit.text_key(b"a")), (1, filter_audit.text_key(b"b"))}
