"""Operator 5: document fingerprints from improbable features.

Windows of 64 bytes are ranked by how rare their entropy is over all documents; a window that is the rarest of its
neighbourhood often enough is a feature.  Features fill Bloom filters of 256 bytes, 160 to each, chained in order of place; two
chains are compared by the bits that their filters share beyond chance.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .repeats import groups

WINDOW, NEAR, OFTEN = 64, 64, 16
BITS, HASHES, FILL = 2048, 5, 160
BINS = 1001
#: Windows below this bin (of 1000, for 6 bits) say too little.
LOW = 100
_c = np.arange(1, WINDOW + 1, dtype=np.float64)
_g = np.concatenate(([0.0], _c * np.log2(_c)))
#: c log c in 1/65536, and its steps; whole numbers, so that equal windows have equal entropy wherever they stand.
G = np.round(_g * 65536).astype(np.int64)
STEP = np.concatenate(([0], np.diff(G)))


def entropy_bins(data: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """Entropy of each 64-byte window, in 1/1000 of 6 bits."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int16)
    ahead = np.empty(len(data), dtype=np.uint8)
    behind = np.empty(len(data), dtype=np.uint8)
    for a in range(0, len(data), block):
        part = data[max(0, a - WINDOW + 1) : a + block + WINDOW - 1]
        own, size = min(a, WINDOW - 1), min(block, len(data) - a)
        f = np.ones(len(part), dtype=np.uint8)
        b = np.ones(len(part), dtype=np.uint8)
        for lag in range(1, min(WINDOW, len(part))):
            same = (part[lag:] == part[:-lag]).view(np.uint8)
            f[:-lag] += same
            b[lag:] += same
        ahead[a : a + size], behind[a : a + size] = f[own : own + size], b[own : own + size]
    total = np.empty(n, dtype=np.int64)
    total[0] = G[np.bincount(data[:WINDOW], minlength=256)].sum()
    if n > 1:
        total[1:] = total[0] + np.cumsum(STEP[behind[WINDOW:]] - STEP[ahead[: n - 1]])
    # 6 bits minus the mean of log c
    return ((6 * 64 * 65536 - total) * 1000 // (6 * 64 * 65536)).astype(np.int16)


def rarity(counts: np.ndarray) -> np.ndarray:
    """Rank of each bin, the rarest first; bins that say too little come last."""
    order = np.argsort(counts, kind="stable")
    rank = np.empty(BINS, dtype=np.uint64)
    rank[order] = np.arange(BINS, dtype=np.uint64)
    rank[:LOW] = BINS
    return rank


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate(([0], np.cumsum(sizes)))


def digests(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """For each text its chain of filters, as rows of 32 numbers of 64 bits.  Under 64 bytes the text itself is the feature."""
    data, offsets = joined(texts)
    sizes = np.diff(offsets)
    doc_of = np.repeat(np.arange(len(texts)), sizes)
    codes = C.Rolling(C.BYTE[data])
    found_doc, found = [], []
    short = np.flatnonzero((sizes > 0) & (sizes < WINDOW))
    if len(short):
        found_doc.append(short)
        found.append(codes.of(offsets[short], offsets[short + 1]))
    n = len(data) - WINDOW + 1
    if n > 0:
        keys = rank[entropy_bins(data)] << np.uint64(32)
        inside = doc_of[:n] == doc_of[WINDOW - 1 :]
        keys[~inside] = np.uint64((BINS + 1) << 32)
        m = n - NEAR + 1
        if m > 0:
            at = C.sliding_argmin(keys, NEAR)
            at = at[inside[:m] & inside[NEAR - 1 :] & (doc_of[:m] == doc_of[NEAR - 1 : NEAR - 1 + m])]
            often = np.bincount(at, minlength=n)
            at = np.flatnonzero((often >= OFTEN) & (keys < np.uint64(BINS << 32)))
            found_doc.append(doc_of[at])
            found.append(codes.of(at, at + WINDOW))
        # texts with fewer windows than a neighbourhood, or with none picked: their rarest window
        long = sizes >= WINDOW
        has = np.zeros(len(texts), dtype=bool)
        if m > 0:
            has[doc_of[at]] = True
        for d in np.flatnonzero(long & ~has).tolist():
            k = offsets[d] + int(keys[offsets[d] : offsets[d + 1] - WINDOW + 1].argmin())
            found_doc.append(np.array([d]))
            found.append(codes.of(np.array([k]), np.array([k + WINDOW])))
    if not found:
        return [np.zeros((0, BITS // 64), dtype=np.uint64)] * len(texts)
    doc, h = np.concatenate(found_doc), np.concatenate(found)
    first = _firsts(doc, h)
    doc, h = doc[first], h[first]
    count = np.bincount(doc, minlength=len(texts))
    place = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    filters = -(-count // FILL)
    base = np.concatenate(([0], np.cumsum(filters)))
    bits = np.zeros((base[-1], BITS), dtype=bool)
    row = base[doc] + place // FILL
    for j in range(HASHES):
        bits[row, ((h >> np.uint64(11 * j)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    packed = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    return [packed[a:b] for a, b in zip(base.tolist(), base[1:].tolist(), strict=False)]


def _firsts(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Indices of the first of each (doc, hash), by doc, then place."""
    order = np.lexsort((np.arange(len(doc)), h, doc))
    new = np.concatenate(([True], (doc[order][1:] != doc[order][:-1]) | (h[order][1:] != h[order][:-1])))
    first = np.sort(order[new])
    return first[np.argsort(doc[first], kind="stable")]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: for each filter of the shorter chain its best match in the other, by shared bits beyond chance; the mean."""
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if len(a) > len(b) or (len(a) == len(b) and a.tobytes() > b.tobytes()):
        a, b = b, a
    nb = np.bitwise_count(b).sum(axis=1, dtype=np.int64)
    out = 0.0
    for row in a:
        na = int(np.bitwise_count(row).sum())
        both = np.bitwise_count(b & row).sum(axis=1, dtype=np.int64)
        most = np.minimum(na, nb)
        chance = na * nb / BITS
        cut = chance + 0.3 * (most - chance)
        out += float(np.clip((both - cut) / np.maximum(most - cut, 1e-9), 0.0, 1.0).max())
    return out / len(a)


def written(chain: np.ndarray) -> str:
    return f"{len(chain)}:{base64.b64encode(chain.tobytes()).decode()}"


def read(fingerprint: str) -> np.ndarray:
    """The chain of a written fingerprint."""
    return np.frombuffer(base64.b64decode(fingerprint.split(":", 1)[1]), dtype=np.uint64).reshape(-1, BITS // 64)


def _histogram(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BINS, dtype=np.int64)
    for _, texts in groups(frames, 1 << 18):
        data, offsets = joined([t.data for t in texts])
        doc_of = np.repeat(np.arange(len(texts)), np.diff(offsets))
        bins = entropy_bins(data)
        counts += np.bincount(bins[doc_of[: len(bins)] == doc_of[WINDOW - 1 :]] if len(bins) else bins, minlength=BINS)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["bin", "n"])


def entropy_counts(docs: DataFrame) -> np.ndarray:
    """How often each entropy bin is met over all windows of all documents: at most 1001 rows come to the driver."""
    out = np.zeros(BINS, dtype=np.int64)
    for r in docs.select("text").mapInArrow(_histogram, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        out[r["bin"]] = r["n"]
    return out


FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _fingerprint(rank: np.ndarray):
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def flush(rows: list[tuple]) -> pa.RecordBatch | None:
        """rows of one chunk in order, (doc_id, text, guest): each with a successor is fingerprinted."""
        plain = [t for _, t, _ in rows]
        edited = []
        for a, b in zip(plain, plain[1:], strict=False):
            half = len(a) // 2
            edited.append(a[: len(a) - half] + b[:half])
        raw = [e.encode() for e in edited]
        chains = digests([t.encode() for t in plain] + raw, rank)
        out = []
        for i, r in enumerate(raw):
            own, changed, after = chains[i], chains[len(plain) + i], chains[i + 1]
            out.append((rows[i][0], len(plain[i]), hashlib.sha256(r).hexdigest(), written(own), written(changed), likeness(own, changed), likeness(own, after)))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names) if out else None

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now, size = None, 0
        for batch in frames:
            for chunk, guest, dk, text in zip(*(batch.column(n).to_pylist() for n in ("chunk", "guest", "dk", "text")), strict=True):
                if chunk != now:
                    if len(held) > 1:
                        yield flush(held)
                    held, now, size = [], chunk, 0
                if held and held[-1][2]:  # one guest ends the chunk
                    continue
                held.append((None if dk == -(2**63) else dk, text, guest))
                size += len(text)
                if size > 1 << 18:
                    if len(held) > 1:
                        yield flush(held)
                    held, size = held[-1:], 0
        if len(held) > 1:
            yield flush(held)

    return run


def fingerprint_documents(df: DataFrame, counts: np.ndarray | None = None) -> DataFrame:
    """One row per row of df (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next document, by doc_id
    (null first; rows with one id by a hash of their text), or all of it if it is shorter; after the last comes the first.
    Null text is empty; an empty text has no filter and is like other empty ones only; a lone document is its own next;
    an empty table gives an empty one; other columns are ignored.  counts: entropy counts of another corpus, to make its
    fingerprints comparable.
    """
    spark = df.sparkSession
    C.prepare(spark)
    docs = df.select(C.doc_key().alias("dk"), C.text_col().alias("text"))
    rank = rarity(entropy_counts(docs) if counts is None else counts)
    # chunks of neighbouring ids, and the first document of each goes to the one before as a guest
    parts = C.parallelism(spark)
    place = docs.select(F.col("dk").cast("double").alias("place"), "dk", "text")
    cuts = sorted(set(place.approxQuantile("place", [i / (4 * parts) for i in range(1, 4 * parts)], 1 / (16 * parts)))) if parts else []
    chunked = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="place", outputCol="chunk_").transform(place) if cuts else place.withColumn("chunk_", F.lit(0.0))
    chunked = chunked.select(F.col("chunk_").cast("int").alias("chunk"), "dk", "text")
    firsts = [(r["chunk"], r["dk"]) for r in chunked.groupBy("chunk").agg(F.min("dk").alias("dk")).orderBy("chunk").collect()]  # one for each chunk
    before = spark.createDataFrame([(dk, firsts[i - 1][0], own) for i, (own, dk) in enumerate(firsts)], "first long, host int, own int")
    sent = chunked.join(F.broadcast(before), (F.col("dk") == F.col("first")), "left")
    sent = sent.select(F.explode(F.when(F.col("host").isNull(), F.array(F.struct("chunk", F.lit(False).alias("guest")))).otherwise(F.array(F.struct("chunk", F.lit(False).alias("guest")), F.struct(F.col("host").alias("chunk"), F.lit(True).alias("guest"))))).alias("to"), "dk", "text")
    sent = sent.select("to.chunk", "to.guest", "dk", "text", F.xxhash64("text").alias("tie"))
    placed = sent.repartition(parts, "chunk").sortWithinPartitions("chunk", "guest", "dk", "tie")
    return placed.mapInArrow(_fingerprint(rank), FIELDS)
