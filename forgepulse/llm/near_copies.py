"""Near copies for the pipeline: operator 9's trie join of SimHashes proposes pairs, an exact Jaccard similarity decides, and a
set-similarity join by prefixes adds the similar pairs whose SimHashes lie further apart.

Two sets with a similarity of t or more share a shingle of their prefixes, the first n - ceil(t * n) + 1 of n in one order
for all sets; the order puts shingles that a sample finds common last, which changes the cost and no result.  Equal sets are
one node.  Candidates are held against the texts themselves, after a bound from parity bitmaps that drops no similar pair.
Of a prefix key's sets all are first paired with one of them, or with some where they are many; after that only sets in different components
are paired.  Either way a pair
counts at a key only if what is left of both sets from the key on could make them similar: so it does at the first key that they share.
As shingles of one set alone come first, sets that share too little meet behind that point, and a large group of them makes no pairs.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .simhash import components, lower_ascii, single, trie_links

#: Bits of the map of wanted rows, by which texts that nobody asks for stay where they are; a full map only lets more through.
MAP_BITS = 1 << 23
#: Sets that a task remembers to have sent whole; a further copy goes without its keys and bitmap.
REMEMBERED = 1 << 18
#: One in so many texts is asked for common shingles; at least so many of them hold one; at most so many shingles are told to tasks.
SAMPLE, COMMON, TOLD = 16, 4, 100_000
#: A key with more than MANY sets has PIVOTS that all are paired with before those in different components are; changes the cost and no result.
MANY, PIVOTS = 64, 12
#: Numbers of 64 bits in the bitmap that pairs of different components are held against before they become rows.
FOLD = 8


def shingles(data: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `width` words, A-Z in lower case; fewer words: the whole sequence; none: no hash."""
    data = np.frombuffer(lower_ascii(data), dtype=np.uint8)
    starts, ends = C.word_bounds(data)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    words = C.word_hashes(data, starts, ends)
    first = np.arange(max(1, len(words) - width + 1))
    hashes = np.sort(C.Rolling(words, 1).of(first, np.minimum(first + width, len(words))))
    return hashes[np.concatenate(([True], hashes[1:] != hashes[:-1]))]


def signature(hashes: np.ndarray) -> int:
    """One 64-bit hash of a set."""
    total = C.mix(hashes ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(C.mix(np.array([total], dtype=np.uint64) + np.uint64(len(hashes)))[0])


def simhash(hashes: np.ndarray) -> int:
    """The SimHash of a set: bit i is 1 if it is set in over half the hashes; no hash: 0.  Equal sets have one, and no shingle is hashed again for it."""
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[i : i + (1 << 16)].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def parity(hashes: np.ndarray) -> bytes:
    """Bit i tells whether an odd number of hashes falls on i: two to four bits an element, a power of two of them.

    Two bitmaps of one size differ in no more bits than their sets in elements; `apart` folds the larger one.
    """
    size = 1 << max(6, (2 * len(hashes) - 1).bit_length())
    bits = np.bincount((hashes >> np.uint64(7)) & np.uint64(size - 1), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def apart(x: bytes, y: bytes) -> int:
    """Bits in which two bitmaps differ."""
    a, b = (np.frombuffer(z, dtype=np.uint64) for z in sorted((x, y), key=len))
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum())


def folded(hashes: np.ndarray) -> np.ndarray:
    """The parity bitmap of any set at one size, FOLD numbers of 64 bits: what a join's condition compares."""
    bits = np.bincount((hashes >> np.uint64(7)) & np.uint64(64 * FOLD - 1), minlength=64 * FOLD) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<u8")


def prefix(hashes: np.ndarray, similarity: float, common: np.ndarray) -> np.ndarray:
    """The first hashes in the order for all sets; common is sorted, so that a text costs what its own hashes do, however many are told."""
    n = len(hashes)
    size = n - math.ceil(similarity * n - 1e-9) + 1 if n else 0
    last = common.take(np.searchsorted(common, hashes), mode="clip") == hashes if len(common) else np.zeros(n, dtype=bool)
    return np.concatenate((hashes[~last], hashes[last]))[:size]


def _long_lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(C.signed(np.concatenate(rows).astype(np.uint64, copy=False)) if len(rows) else np.zeros(0, np.int64)))


def _every(width: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(C.signed(np.concatenate([shingles(d, width) for d in C.raw_texts(batch.column("text"))])))], names=["h"])

    return run


def _sets(width: int, similarity: float, common: np.ndarray):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in frames:
            if not batch.num_rows:
                continue
            sets = [shingles(d, width) for d in C.raw_texts(batch.column("text"))]
            sig = [signature(s) for s in sets]
            new = []
            for x in sig:
                new.append(x not in sent)
                if len(sent) >= REMEMBERED:
                    sent.clear()
                sent.add(x)
            prints = np.fromiter((simhash(s) if n else 0 for s, n in zip(sets, new, strict=True)), dtype=np.uint64, count=len(new))
            prints = pa.array(C.signed(prints), mask=~np.array(new))
            bits = [parity(s) if n else None for s, n in zip(sets, new, strict=True)]
            folds = [folded(s) if n else s[:0] for s, n in zip(sets, new, strict=True)]
            keys = [prefix(s, similarity, common) if n else s[:0] for s, n in zip(sets, new, strict=True)]
            columns = [batch.column("dk"), batch.column("row_key"), pa.array(C.signed(np.array(sig, dtype=np.uint64))), pa.array([len(s) for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, prints, pa.array(bits, pa.binary()), _long_lists(folds), _long_lists(keys)], names=["dk", "row_key", "sig", "n", "fp", "bits", "fold", "keys"])

    return run


def _map_of(rows: DataFrame):
    """A function of row keys: true for those of rows, and for some others.  The map has MAP_BITS bits, whatever there is."""
    at = F.col("row_key").bitwiseAND(F.lit(MAP_BITS - 1))
    marks = rows.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(row_key & 63 as int))")).alias("marks")).toArrow()
    words = np.zeros(MAP_BITS // 64, dtype=np.int64)
    words[marks.column("word").to_numpy()] = marks.column("marks").to_numpy()
    words = words.view(np.uint64)

    def asked(keys: pd.Series) -> pd.Series:
        at = keys.to_numpy() & (MAP_BITS - 1)
        return pd.Series((words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool))

    return F.pandas_udf(asked, "boolean")


def _packed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor().compress
    for batch in frames:
        yield pa.RecordBatch.from_arrays([batch.column("sig"), pa.array([pack(d.tobytes()) for d in C.raw_texts(batch.column("text"))], pa.binary())], names=["sig", "packed"])


def _possible(similarity: float):
    """Pairs whose bitmaps do not rule out the similarity."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            most = (1 - similarity) / (1 + similarity) * (batch.column("n_u").to_numpy() + batch.column("n_v").to_numpy()) + 1e-9
            bits = zip(*(batch.column(c).to_pylist() for c in ("bits_u", "bits_v")), strict=True)
            keep = [apart(x, y) <= m for (x, y), m in zip(bits, most, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _similar(width: int, similarity: float):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, last = zstandard.ZstdDecompressor().decompress, {}

        def held(packed: bytes) -> np.ndarray:
            if packed not in last:
                if len(last) >= 16:
                    last.pop(next(iter(last)))
                last[packed] = shingles(np.frombuffer(unpack(packed), dtype=np.uint8), width)
            return last[packed]

        for batch in frames:
            keep = []
            for x, y in zip(*(batch.column(c).to_pylist() for c in ("x", "y")), strict=True):
                a, b = held(x), held(y)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= similarity * (len(a) + len(b) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def keep_one_of_near(df: DataFrame, shingle: int = 5, similarity: float = 0.8, budget: int = 3) -> DataFrame:
    """The rows of df (doc_id, text), with its columns, that have the least id of their component.

    Texts whose sets of `shingle`-word shingles have a Jaccard similarity of `similarity` or more are linked, all such pairs
    (those within `budget` bits of SimHash by the trie join, the others by shared prefixes);
    texts without words (null too) have the empty set and are linked.  Of equal rows one stays; rows with one id, or none,
    meet by their texts alone.  64-bit hashes stand for shingles and for sets.  An empty table gives an empty one;
    other columns stay, whatever their names.
    """
    spark = df.sparkSession
    C.prepare(spark)
    docs = df.select(C.doc_key().alias("dk"), F.xxhash64("doc_id", "text").alias("row_key"), C.text_col().alias("text"))
    asked = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").distinct()
    often = asked.mapInArrow(_every(shingle), "h long").groupBy("h").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "h").limit(TOLD)
    common = np.sort(often.select("h").toArrow().column("h").to_numpy().view(np.uint64))
    folder = f"{C.shared_folder(spark)}/near-{uuid.uuid4().hex}"

    def stored(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    sets = stored(docs.mapInArrow(_sets(shingle, similarity, common), "dk long, row_key long, sig long, n long, fp long, bits binary, fold array<long>, keys array<long>"), "sets")
    one = F.struct("dk", "row_key").alias("first")
    nodes = stored(sets.groupBy("sig").agg(F.min(one).alias("first"), F.first("n").alias("n"), F.first("fp", ignorenulls=True).alias("fp"), F.first("bits", ignorenulls=True).alias("bits"), F.max("fold").alias("fold")), "nodes")  # a copy that went without has an empty fold, which is less

    def fits(a: Column, b: Column) -> Column:
        return F.least(a, b) >= similarity * F.greatest(a, b) - 1e-9

    def may_be(n_a: Column, left_a: Column, n_b: Column, left_b: Column) -> Column:
        """Two sets whose first common key has so many elements from it on may be similar."""
        return F.least(left_a, left_b) >= similarity / (1 + similarity) * (n_a + n_b) - 1e-9

    # copies that several tasks sent are one again here, in the tasks of their keys
    keyed = sets.select(F.posexplode("keys").alias("at", "key"), "sig", "n").select("key", "sig", "n", (F.col("n") - F.col("at")).alias("left"))
    keyed = keyed.repartition(C.parallelism(spark), "key").dropDuplicates(["key", "sig"])
    drawn = lambda j: F.min(F.struct(F.xxhash64("sig", F.lit(j)), "sig", "n", "left"))  # noqa: E731  much the same for all keys of a group of sets
    members = keyed.groupBy("key").agg(drawn(0).alias("p"), F.count("*").alias("c")).where("c > 1").select("key", "c", F.col("p.sig").alias("pivot"), F.col("p.n").alias("pivot_n"), F.col("p.left").alias("pivot_left"))
    members = stored(keyed.join(members, "key").sortWithinPartitions("key", "sig"), "members")
    C.delete(spark, f"{folder}/sets")  # what is needed of it stands in nodes and members
    ends = nodes.select("sig", "n", "bits")

    def asked_texts(touched: DataFrame) -> DataFrame:
        """sig and packed text of the asked nodes; the map keeps most other texts out of the shuffle, the join the rest."""
        texts = docs.where(_map_of(touched)("row_key"))
        return texts.join(touched, ["dk", "row_key"]).dropDuplicates(["dk", "row_key"]).select("sig", "text").mapInArrow(_packed, "sig long, packed binary").checkpoint()

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of the distinct pairs (u, v) that are similar."""
        a, b = (ends.select(F.col("sig").alias(k), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}")) for k in "uv")
        left = pairs.distinct().join(a, "u").join(b, "v").select("u", "v", "n_u", "n_v", "bits_u", "bits_v").mapInArrow(_possible(similarity), "u long, v long").checkpoint()
        touched = left.select(F.col("u").alias("sig")).union(left.select("v")).distinct().join(nodes.select("sig", "first"), "sig").select("sig", "first.dk", "first.row_key").checkpoint()
        texts = asked_texts(touched)
        both = left.join(texts.select(F.col("sig").alias("u"), F.col("packed").alias("x")), "u").join(texts.select(F.col("sig").alias("v"), F.col("packed").alias("y")), "v")
        return both.select("u", "v", "x", "y").mapInArrow(_similar(shingle, similarity), "u long, v long").checkpoint()

    # sets of one SimHash are paired with the least of them, and those of near SimHashes with each other
    prints = nodes.groupBy("fp").agg(F.min("sig").alias("rep")).checkpoint()
    same = nodes.join(prints, "fp").where("rep < sig").select(F.col("rep").alias("u"), F.col("sig").alias("v"))
    near = trie_links(prints, budget, "rep")
    with_pivot = fits(F.col("n"), F.col("pivot_n")) & may_be(F.col("n"), F.col("left"), F.col("pivot_n"), F.col("pivot_left"))
    sharing = members.where((F.col("sig") != F.col("pivot")) & with_pivot).select(F.least("pivot", "sig").alias("u"), F.greatest("pivot", "sig").alias("v"))
    many = members.where(F.col("c") > MANY)
    pivots = many.groupBy("key").agg(F.array(*map(drawn, range(1, PIVOTS))).alias("p")).select("key", F.explode(F.array_distinct("p")).alias("p"))
    with_drawn = fits(F.col("n"), F.col("p.n")) & may_be(F.col("n"), F.col("left"), F.col("p.n"), F.col("p.left"))
    drawn_pairs = many.join(pivots, "key").where((F.col("sig") != F.col("p.sig")) & with_drawn).select(F.least("sig", "p.sig").alias("u"), F.greatest("sig", "p.sig").alias("v")).distinct().checkpoint()
    links = verified(same.union(near).union(sharing).union(drawn_pairs))
    # members of keys whose sets are not all in one component yet
    least = components(links)
    named = members.select("key", "sig", "n", "left", "pivot").join(least, F.col("sig") == F.col("node"), "left").select("key", "sig", "n", "left", "pivot", F.coalesce("least", "sig").alias("label"))
    mixed = named.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("c")).where("a < b AND c > 2").select("key")
    named = named.join(mixed, "key", "left_semi").join(nodes.select("sig", "fold"), "sig").checkpoint()
    x, y = (named.select("key", "pivot" if s == "u" else F.lit(0).alias("_"), *(F.col(c).alias(f"{c}_{s}") for c in ("sig", "n", "left", "label", "fold"))) for s in "uv")
    apart_still = (F.col("label_u") < F.col("label_v")) & (F.col("sig_u") != F.col("pivot")) & (F.col("sig_v") != F.col("pivot"))
    # of sets that share a passage and little else, pairs fall here, in the join, and are never rows
    differ = sum((F.bit_count(F.col("fold_u")[i].bitwiseXOR(F.col("fold_v")[i])) for i in range(FOLD)), F.lit(0)) <= (1 - similarity) / (1 + similarity) * (F.col("n_u") + F.col("n_v")) + 1e-9
    more = x.join(y, "key").where(apart_still & fits(F.col("n_u"), F.col("n_v")) & may_be(F.col("n_u"), F.col("left_u"), F.col("n_v"), F.col("left_v")) & differ)
    more = more.select(F.least("sig_u", "sig_v").alias("u"), F.greatest("sig_u", "sig_v").alias("v"))
    rest = verified(more.distinct().join(drawn_pairs, ["u", "v"], "left_anti"))
    # what is left joins components, not sets
    for end in "uv":
        rest = rest.join(least.select(F.col("node").alias(end), F.col("least").alias(f"_{end}")), end, "left")
    over = components(rest.select(F.coalesce("_u", "u").alias("u"), F.coalesce("_v", "v").alias("v"))).select(F.col("node").alias("label"), F.col("least").alias("over"))
    labelled = nodes.join(least, F.col("sig") == F.col("node"), "left").select("first", F.coalesce("least", "sig").alias("label"))
    kept = labelled.join(over, "label", "left").groupBy(F.coalesce("over", "label").alias("label")).agg(F.min("first").alias("first"))
    kept = kept.select(F.col("first.dk").alias("dk"), F.col("first.row_key").alias("row_key")).checkpoint()
    C.delete(spark, folder)
    # rows outside the map of those that go stay where they are; the others are told apart by a join
    gone = docs.select("dk", "row_key").join(kept, ["dk", "row_key"], "left_anti")
    dk, row_key = names = C.free_names(df, "dk", "row_key")
    rows = df.withColumn(dk, C.doc_key()).withColumn(row_key, F.xxhash64("doc_id", "text"))
    may_go = _map_of(gone)(row_key)
    stays = rows.where(~may_go).unionByName(rows.where(may_go).join(kept.toDF(*names), names, "left_semi").select(*rows.columns))
    return single(stays, df, names)
