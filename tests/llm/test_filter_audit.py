import itertools
import random
import re

from forgepulse.llm.filter_audit import COUNTS, filter_audit, packed
from tests.llm.cases import TEXTS, empty

FAILS = {
    "A": lambda t, w: len(w) < 200,
    "B": lambda t, w: 100 * len(set(w)) < 50 * len(w),
    "C": lambda t, w: 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
    "D": lambda t, w: bool(re.search(r"[#$%&*|]", t)),
}


def brute(rows, labels):
    """Each order run filter by filter over the documents."""
    docs, least = [], {}
    rank = lambda i: -(2**63) if i is None else i
    for i, t, _ in rows:
        least[t or ""] = min(least.get(t or "", 2**63), rank(i))
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {k for k, f in FAILS.items() if f(t, w)} | ({"E"} if rank(i) > least[t] else set())
        docs.append((lang or "", fails, any(a == i and q == 1 for a, q, _ in labels if i is not None), any(a == i and x == 1 for a, _, x in labels if i is not None)))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        shap = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [d for d in left if letter in d[1]]
                kept = [d for d in left if letter not in d[1]]
                earlier = sum(letter in d[1] for d in own) - len(gone)
                out[part, order, step] = [len(kept), len(gone), earlier, sum(d[1] == {letter} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                shap[letter] += len(gone)
                left = kept
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shap[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def told(df):
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in (*COUNTS, "shapley")) for r in df.collect()}


def tables(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, s, "x", 1) for i, t, s in rows], "doc_id long, text string, lang string, part string, mask int")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_awkward_rows(spark):
    labels = [(5, 1, 0), (7, 0, 1), (7, 1, None), (None, 1, 1), (13, None, 1), (99, 1, 1), (16, 1, 1)]
    docs, marks = tables(spark, TEXTS, labels)
    out = filter_audit(docs, marks)
    assert out.columns == ["part", "filter_order", "step", *COUNTS, "shapley"]
    assert told(out) == brute(TEXTS, labels)


def test_copies_across_parts_and_labels(spark):
    rng = random.Random(2)
    texts = ["a b c", "A B", "x # y", " ".join(f"w{i}" for i in range(250)), "same " * 250, None, ""]
    rows = [(rng.choice([*range(40), None]), rng.choice(texts), rng.choice(["en", "de", None])) for _ in range(400)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 40, 2)] * 2
    docs, marks = tables(spark, rows, labels)
    assert told(filter_audit(docs, marks)) == brute(rows, labels)


def test_empty_tables(spark):
    docs, marks = tables(spark, [], [])
    assert filter_audit(docs, marks).count() == 0
    rows = [(1, "a", "en")]
    docs, _ = tables(spark, rows, [])
    assert told(filter_audit(docs, marks)) == brute(rows, [])
    assert empty(spark).count() == 0


def test_fields_hold_any_number_of_documents():
    """The sum of all masks' integers, each many times, still has each field on its own."""
    n = 2**62 // 32
    total = sum(m * n for m in packed()["removed"])
    fields = [(total >> 64 * i) & (2**64 - 1) for i in range(600)]
    assert fields == [sum((m >> 64 * i) & 1 for m in packed()["removed"]) * n for i in range(600)] and total >> 64 * 600 == 0
