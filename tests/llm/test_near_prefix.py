"""The order of a set's shingles costs what the set's own hashes do."""

import math
import time

import numpy as np

from forgepulse.llm.near_copies import prefix, simhash


def plain(hashes, similarity, common):
    told = set(common.tolist())
    order = [h for h in hashes.tolist() if h not in told] + [h for h in hashes.tolist() if h in told]
    return order[: len(order) - math.ceil(similarity * len(order) - 1e-9) + 1 if order else 0]


def test_common_shingles_come_last():
    rng = np.random.default_rng(1)
    for n, m in ((0, 0), (0, 5), (1, 0), (7, 3), (40, 1), (40, 400), (300, 100)):
        hashes = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        common = np.unique(np.concatenate((rng.integers(0, 2**64, m, dtype=np.uint64), hashes[::3], hashes[-1:]))) if m else hashes[:0]
        for similarity in (0.5, 0.8, 1.0):
            assert prefix(hashes, similarity, common).tolist() == plain(hashes, similarity, common)


def test_a_set_costs_no_sort_of_all_common_shingles():
    """A tenth of a second for 50 texts and a million common shingles; a sort of them for each text takes many seconds."""
    rng = np.random.default_rng(2)
    common, hashes = np.sort(rng.integers(0, 2**64, 1 << 20, dtype=np.uint64)), np.sort(rng.integers(0, 2**64, 500, dtype=np.uint64))
    began = time.process_time()
    for _ in range(50):
        prefix(hashes, 0.8, common)
    assert time.process_time() - began < 1


def test_simhash_of_a_set():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 500, 70_000):
        hashes = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        want = sum(1 << i for i in range(64) if 2 * int((hashes >> np.uint64(i) & np.uint64(1)).sum()) > len(hashes))
        assert simhash(hashes) == want
