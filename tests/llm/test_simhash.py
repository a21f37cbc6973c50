import re

import numpy as np
import xxhash

from forgepulse.llm.simhash import components, keep_one_of_each, simhash_near_dedup, trie_self_join
from forgepulse.llm import common as C

from .cases import awkward, empty, real

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute_print(text):
    w = WORD.findall((text or "").translate(AZ))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_against_brute_force(spark, small):
    for df in (awkward(spark), real(spark, small)):
        rows = [(r.doc_id, brute_print(r.text)) for r in df.collect()]
        up = list(range(len(rows)))
        changed = True
        while changed:
            changed = False
            for i in range(len(rows)):
                for j in range(len(rows)):
                    if (rows[i][1] ^ rows[j][1]).bit_count() <= 3 and up[j] > up[i]:
                        up[j] = up[i]
                        changed = True
        want = []
        for i, (d, f) in enumerate(rows):
            ids = [rows[j][0] for j in range(len(rows)) if up[j] == up[i]]
            want.append((d, f"{f:016x}", None if None in ids else min(ids)))
        assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in simhash_near_dedup(df).collect())
    assert simhash_near_dedup(empty(spark)).count() == 0


def test_trie_join_finds_all_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = [b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, k, dtype=np.uint64)) for b in base for k in (1, 2, 3, 4, 5)]
    points = np.unique(np.concatenate((base, np.array(near, dtype=np.uint64))))
    got = {(min(i, j), max(i, j)) for a, b in trie_self_join(points, 3, fixed=0) for i, j in zip(a.tolist(), b.tolist())}
    want = {(i, j) for i in range(len(points)) for j in range(i + 1, len(points)) if int(points[i] ^ points[j]).bit_count() <= 3}
    assert got == want and want


def test_long_chains(spark):
    C.prepare(spark)
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 102), (101, 102)], "u long, v long")
    got = dict(map(tuple, components(edges).collect()))
    assert got == {i: 1 for i in range(2, 41)} | {101: 100, 102: 100}


def test_rows_without_or_with_one_id_meet_by_text_alone(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(30)) for k in "abcd"}
    rows = [(None, text["a"]), (None, text["a"]), (None, text["b"]), (4, text["b"]), (7, text["c"]), (7, text["d"]), (5, text["d"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash_near_dedup(df).collect())
    assert got == sorted([("None", "None")] * 3 + [("4", "None"), ("7", "7"), ("7", "5"), ("5", "5")])
    kept = [tuple(r) for r in keep_one_of_each(df).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [(None, text["a"]), (None, text["b"]), (7, text["c"]), (5, text["d"])]))
