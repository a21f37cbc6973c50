import hashlib

import numpy as np
from pyspark.sql import functions as F

from forgepulse.llm import common as C
from forgepulse.llm import fingerprints as P

from .cases import awkward, empty, real


def brute_bins(data):
    out = []
    for i in range(len(data) - 63):
        counts = np.bincount(np.frombuffer(data[i : i + 64], dtype=np.uint8))
        total = int(P.G[counts].sum())
        out.append((6 * 64 * 65536 - total) * 1000 // (6 * 64 * 65536))
    return out


def test_entropy_of_every_window():
    rng = np.random.default_rng(2)
    data = bytes(rng.integers(97, 105, 500, dtype=np.uint8)) + b"a" * 200 + bytes(rng.integers(0, 256, 300, dtype=np.uint8))
    assert P.entropy_bins(np.frombuffer(data, dtype=np.uint8)).tolist() == brute_bins(data)
    assert P.entropy_bins(np.frombuffer(data, dtype=np.uint8), block=100).tolist() == brute_bins(data)


def test_digest_of_a_text_does_not_depend_on_its_neighbours():
    rng = np.random.default_rng(4)
    texts = [bytes(rng.integers(97, 123, int(n), dtype=np.uint8)) for n in (0, 10, 63, 64, 70, 130, 1000, 5000)]
    rank = P.rarity(np.arange(P.BINS))
    together = P.digests(texts, rank)
    assert all((a == P.digests([t], rank)[0]).all() for a, t in zip(together, texts, strict=True))
    assert P.likeness(together[-1], together[-1]) == 1.0 and P.likeness(together[-1], together[-2]) < 0.1
    assert (P.read(P.written(together[-1])) == together[-1]).all()


def test_contract(spark, small):
    for df in (awkward(spark), real(spark, small)):
        rows = sorted(df.collect(), key=lambda r: -(2**63) if r.doc_id is None else r.doc_id)
        got = P.fingerprint_documents(df).collect()
        assert sorted(map(str, [r.doc_id for r in got])) == sorted(map(str, [r.doc_id for r in rows]))
        want = []
        for a, b in zip(rows, rows[1:] + rows[:1], strict=True):
            t, n = a.text or "", b.text or ""
            half = len(t) // 2
            want.append(str((a.doc_id, len(t), hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest())))
        assert sorted(str(tuple(r)[:3]) for r in got) == sorted(want)
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    long = [r for r in got if r.n_chars > 2000]
    assert np.mean([r.near_edited for r in long]) > 0.3 and np.mean([r.near_next for r in long]) < 0.2
    assert P.fingerprint_documents(empty(spark)).count() == 0


def plain_hash(data: bytes) -> int:
    """A polynomial over the bytes' numbers, then mixed, in plain whole numbers."""
    top, h, power = 2**64 - 1, 0, 1
    for b in data:
        h, power = (h + int(C.BYTE[b]) * power) & top, power * C.BASES[0] & top
    h ^= h >> 32
    h = h * 0xD6E8FEB86659FD93 & top
    h ^= h >> 29
    h = h * 0xCA5A826395121157 & top
    return h ^ h >> 32


def plain_digest(data: bytes, rank) -> list[int]:
    """The chain of filters, each one whole number of 2,048 bits, by looking at each window and each neighbourhood."""
    if not data:
        return []
    if len(data) < 64:
        features = [plain_hash(data)]
    else:
        order = [(int(rank[b]), i) for i, b in enumerate(brute_bins(data))]
        picked = {}
        for i in range(len(order) - 63):
            best = min(order[i : i + 64])
            picked[best] = picked.get(best, 0) + 1
        places = sorted(i for (r, i), n in picked.items() if n >= 16 and r < P.BINS) or [min(order)[1]]
        features = list(dict.fromkeys(plain_hash(data[i : i + 64]) for i in places))
    chain = []
    for a in range(0, len(features), 160):
        bits = 0
        for h in features[a : a + 160]:
            for j in range(5):
                bits |= 1 << (h >> 11 * j & 2047)
        chain.append(bits)
    return chain


def plain_likeness(a: list[int], b: list[int]) -> float:
    if not a or not b or a == b:
        return float(a == b)
    as_bytes = lambda c: b"".join(x.to_bytes(256, "little") for x in c)
    a, b = sorted((a, b), key=lambda c: (len(c), as_bytes(c)))
    total = 0.0
    for x in a:
        best = 0.0
        for y in b:
            nx, ny, both = x.bit_count(), y.bit_count(), (x & y).bit_count()
            chance, most = nx * ny / 2048, min(nx, ny)
            cut = chance + 0.3 * (most - chance)
            best = max(best, min(1.0, max(0.0, (both - cut) / max(most - cut, 1e-9))))
        total += best
    return total / len(a)


def test_digests_and_likeness_equal_a_plain_version(spark, small):
    """All columns of the whole table, from each window of each text."""
    for df in (awkward(spark), real(spark, small)):
        tie = F.xxhash64(F.coalesce("text", F.lit("")))  # the order of rows with one id
        rows = sorted(df.withColumn("tie", tie).collect(), key=lambda r: (-(2**63) if r.doc_id is None else r.doc_id, r.tie))
        texts = [r.text or "" for r in rows]
        counts = np.zeros(P.BINS, dtype=np.int64)
        for t in texts:
            for b in brute_bins(t.encode()):
                counts[b] += 1
        assert (P.entropy_counts(df.select(C.text_col().alias("text"))) == counts).all()
        rank = [0] * P.BINS
        for place, b in enumerate(sorted(range(P.BINS), key=lambda b: (counts[b], b))):
            rank[b] = place if b >= P.LOW else P.BINS
        chains = [plain_digest(t.encode(), rank) for t in texts]
        want = []
        for i, t in enumerate(texts):
            after = (i + 1) % len(texts)
            half = len(t) // 2
            edited = plain_digest((t[: len(t) - half] + texts[after][:half]).encode(), rank)
            want.append((rows[i].doc_id, chains[i], edited, plain_likeness(chains[i], edited), plain_likeness(chains[i], chains[after])))
        whole = lambda f: [int.from_bytes(row.tobytes(), "little") for row in P.read(f)]
        got = [(r.doc_id, whole(r.fingerprint), whole(r.edited_fingerprint), r.near_edited, r.near_next) for r in P.fingerprint_documents(df).collect()]
        key = lambda r: (str(r[0]), r[1], r[2])
        for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
            assert g[:3] == w[:3] and abs(g[3] - w[3]) < 1e-12 and abs(g[4] - w[4]) < 1e-12

