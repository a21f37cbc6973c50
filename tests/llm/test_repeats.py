import hashlib
import re
from collections import Counter

import pytest

from forgepulse.llm.substring_dedup import substring_dedup
from forgepulse.llm.suffix_array_dedup import suffix_array_dedup

from .cases import awkward, empty, real

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LEAST = -(2**63)


def brute_words(rows, window=13):
    first = {}
    words = [(LEAST if d is None else d, WORD.findall(t or "")) for d, t in rows]
    for d, w in words:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(d, first.get(key, d))
    out = []
    for (own, _), (d, w) in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((own, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def brute_bytes(rows, window=400):
    count = Counter()
    raw = [(d, (t or "").encode()) for d, t in rows]
    for _, b in raw:
        for i in range(len(b) - window + 1):
            count[b[i : i + window]] += 1
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if count[b[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("most", [50_000, 1])
def test_words(spark, small, most):
    for df in (awkward(spark), real(spark, small).limit(120)):
        df = df.cache()
        got = [tuple(r)[:4] for r in substring_dedup(df, most=most).collect()]
        assert order(got) == order(brute_words([(r.doc_id, r.text) for r in df.collect()]))


@pytest.mark.parametrize("most", [50_000, 1])
def test_bytes(spark, small, most):
    for df in (awkward(spark), real(spark, small).where("n_chars < 4000").limit(60)):
        df = df.cache()
        got = [tuple(r)[:5] for r in suffix_array_dedup(df, most=most).collect()]
        assert order(got) == order(brute_bytes([(r.doc_id, r.text) for r in df.collect()]))


def test_empty(spark):
    assert substring_dedup(empty(spark)).count() == 0
    assert suffix_array_dedup(empty(spark)).count() == 0




def test_nothing_is_left_of_the_index(spark, small):
    """Level tables and their folder go before the rows are read."""
    import os

    from forgepulse.llm import common as C

    rows = suffix_array_dedup(real(spark, small))
    folder = C.shared_folder(spark).removeprefix("file:")
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("arrays_")]
    assert not [n for n in os.listdir(folder) if n.startswith("suffix-arrays-")] and rows.count() > 0
