import hashlib
import random
import re
import zlib

import numpy as np

from forgepulse.llm.periodic_runs import collapse_runs, find_runs, periodic_runs
from tests.llm.cases import awkward, empty, real

COLUMNS = ["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "collapsed"]


def brute(w):
    """(start, length, period) of all runs, by every lag and every place."""
    n, out = len(w), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if size >= max(6, 4 * q):
                s = w[i : i + size]
                if not any(all(a == b for a, b in zip(s, s[p:])) for p in range(1, q)):
                    out.add((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain(doc_id, text, arrange):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if arrange and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    text = " ".join(x for i, x in enumerate(w) if i not in gone)
    best = None
    for s, size, q in runs:
        if best is None or size * best[2] > best[1] * q:
            best = (s, size, q)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, n, len(runs), *top, hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), text)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_runs_equal_every_lag_at_every_place():
    rng = random.Random(1)
    for _ in range(1500):
        n, k = rng.randrange(0, 150), rng.choice([1, 2, 2, 3, 5, 20])
        w = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.7:
            a = rng.randrange(n)
            p = 1 + (n - a) // (3 + rng.randrange(8))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        for _ in range(rng.choice([0, 0, 3]) if n else 0):
            w[rng.randrange(n)] = rng.randrange(k)
        got = sorted(zip(*(x.tolist() for x in find_runs(np.array(w, dtype=np.int64))), strict=True), key=lambda r: (r[0], r[2]))
        assert got == brute(w), w


def test_long_periods_and_one_word():
    one = find_runs(np.zeros(300_000, dtype=np.int64))
    assert [x.tolist() for x in one] == [[0], [300_000], [1]]
    w = np.concatenate([np.arange(1000), 2000 + np.tile(np.arange(5000), 4), [1, 1, 1]])
    assert [x.tolist() for x in find_runs(w)] == [[1000], [20_000], [5000]]
    assert [x.tolist() for x in find_runs(w[: 1000 + 19_999])] == [[], [], []]


def test_awkward_and_empty(spark):
    for arrange in (False, True):
        df = awkward(spark)
        assert rows(periodic_runs(df, arrange)) == sorted((plain(r.doc_id, r.text, arrange) for r in df.collect()), key=repr)
    out = periodic_runs(empty(spark))
    assert out.columns == COLUMNS and out.count() == 0


def test_whole_table_equals_brute_force(spark, small):
    df = real(spark, small)
    assert rows(periodic_runs(df, True)) == sorted((plain(r.doc_id, r.text, True) for r in df.collect()), key=repr)


def test_collapse_keeps_columns_and_texts_without_runs(spark):
    df = awkward(spark)
    got = collapse_runs(df)
    assert got.schema == df.schema
    want = []
    for r in df.collect():
        told = plain(r.doc_id, r.text, False)
        want.append((r.doc_id, told[-1] if told[2] else r.text, r.source, r.akey, r.n, r.size, r.repeats))
    assert rows(got) == sorted(want, key=repr) and collapse_runs(empty(spark)).count() == 0
