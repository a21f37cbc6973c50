"""Operator 9: SimHash near-duplicates, by a self-join of a binary trie over fingerprints.

Distinct fingerprints go, once for each of four blocks of 16 bits, to the task that holds the subtree under that block
(two fingerprints within three bits agree in some block).  There the trie is joined with itself: pairs of nodes are
traversed together, level by level, differing bits add up, and a pair is dropped once the budget is exceeded.
A task keeps a spanning forest of its links; forests meet in rounds of large-star and small-star joins.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BLOCK = 16
#: Node pairs that are expanded at once; the rest wait on a stack, so memory is bounded.
FRONTIER = 1 << 18


def lower_ascii(data: np.ndarray) -> bytes:
    return data.tobytes().lower()  # bytes.lower() touches A-Z only


def fingerprint(words: list[bytes], shingle: int = 3, seed: int = 42) -> int:
    """Bit i is 1 if it is set in over half the shingles' XXH64; repeats count; no words: 0."""
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    text = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[:n].tolist(), ends[len(words) - n :].tolist()
    h = np.fromiter((digest(text[a:b], seed) for a, b in zip(starts, ends, strict=True)), dtype="<u8", count=n)
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 16):
        total += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * total > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            out = np.fromiter((fingerprint(lower_ascii(d).split(), shingle) for d in C.raw_texts(batch.column("text"))), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("dk"), batch.column("row_key"), pa.array(C.signed(out))], names=["doc_id", "dk", "row_key", "fp"])

    return run


def trie_self_join(points: np.ndarray, budget: int, fixed: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sorted distinct 64-bit points that agree in the first `fixed` bits and differ in at most `budget` of the rest.

    A node is a range of the sorted points; its children split where the next bit turns to 1.
    """
    n = len(points)
    if n < 2:
        return
    top = points >> np.uint64(64 - fixed)
    edge = np.concatenate(([0], np.flatnonzero(np.diff(top)) + 1, [n]))
    lo, hi = edge[:-1], edge[1:]
    big = hi - lo > 1
    lo, hi = lo[big], hi[big]
    stack = [(fixed, lo, hi, lo, hi, np.zeros(len(lo), dtype=np.int8))]
    ones: dict[int, np.ndarray] = {}
    while stack:
        depth, a0, a1, b0, b1, diff = stack.pop()
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            stack += [(depth, a0[half:], a1[half:], b0[half:], b1[half:], diff[half:]), (depth, a0[:half], a1[:half], b0[:half], b1[:half], diff[:half])]
            continue
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():  # two leaves: the bits that are left are counted at once
            i, j = a0[single], b0[single]
            near = (i != j) & (np.bitwise_count(points[i] ^ points[j]) <= budget)
            if near.any():
                yield i[near], j[near]
            a0, a1, b0, b1, diff = (x[~single] for x in (a0, a1, b0, b1, diff))
        if not len(a0) or depth == 64:
            continue
        if depth not in ones:
            ones[depth] = np.concatenate(([0], np.cumsum((points >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)))
        c = ones[depth]
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
        same = (a0 == b0) & (a1 == b1)
        kids = [(a0, am, b0, bm, diff), (am, a1, bm, b1, diff), (a0, am, bm, b1, diff + 1)]
        other = ~same  # a node with itself meets its mixed children once
        kids.append((am[other], a1[other], b0[other], bm[other], diff[other] + 1))
        a0, a1, b0, b1, diff = (np.concatenate([k[x] for k in kids]) for x in range(5))
        live = (a1 > a0) & (b1 > b0) & (diff <= budget) & ~((a0 == b0) & (a1 == b1) & (a1 - a0 == 1))
        stack.append((depth + 1, a0[live], a1[live], b0[live], b1[live], diff[live]))


class Forest:
    """Union-find that keeps the links that joined something."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            s = self.up[r]
            if (s == r).all():
                self.up[x] = r
                return r
            r = s

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.roots(i), self.roots(j)
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def _links(budget: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes = [], []
        for batch in frames:
            keys.append(batch.column("key").to_numpy())
            nodes.append(batch.column("node").to_numpy())
        if not keys:
            return
        keys, nodes = np.concatenate(keys).view(np.uint64), np.concatenate(nodes)
        order = np.argsort(keys, kind="stable")
        keys, nodes = keys[order], nodes[order]
        forest = Forest(len(keys))
        for i, j in trie_self_join(keys, budget):
            forest.join(i, j)
        at = np.arange(len(keys))
        root = forest.roots(at)
        linked = root != at
        if linked.any():
            a, b = nodes[at[linked]], nodes[root[linked]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["u", "v"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, least): the least node that each linked node reaches.  Large-star and small-star rounds until nothing moves; after prepare().

    Joins are by sort and merge of two sides dealt out for it, so that AQE may split a hub, and nothing is built in the driver.  Each round is a
    table in the shared folder, which is gone at the end: a checkpoint would hand the optimizer what it knew of all rounds before.
    """
    spark = edges.sparkSession
    folder = f"{C.shared_folder(spark)}/components-{uuid.uuid4().hex}"

    def kept(rows: DataFrame, turn: int):
        """The rows as a table, and what tells one set of edges from another."""
        rows.write.parquet(f"{folder}/{turn}")
        rows = spark.read.schema(rows.schema).parquet(f"{folder}/{turn}")
        return rows, rows.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", F.lit(1), "u"))).first()

    turn = 0
    edges, before = kept(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct(), turn)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).select(C.dealt_anew("u"), "m")
        # large-star: each larger neighbour of u is tied to the least of u and its neighbours
        large = edges.join(near.hint("merge"), "u").select(F.col("m").alias("u"), "v")
        # small-star: u and its smaller neighbours are tied to the least of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low.select(C.dealt_anew("v"), "m").hint("merge"), "v").select(F.col("m").alias("u"), F.col("u").alias("v")).unionByName(low.select(F.col("m").alias("u"), "v"))
        edges, now = kept(small.where("u < v").distinct(), turn + 1)
        C.delete(spark, f"{folder}/{turn}")
        turn += 1
        if now == before:
            out = edges.groupBy("v").agg(F.min("u").alias("least")).withColumnRenamed("v", "node").checkpoint()
            C.delete(spark, folder)
            return out
        before = now


def trie_links(nodes: DataFrame, budget: int, name: str = "fp") -> DataFrame:
    """(u, v): links between nodes, by `name`, whose distinct fingerprints fp differ in `budget` bits or fewer; of each task a spanning forest."""
    turned = F.array(*(F.expr(f"shiftleft(fp, {r}) | shiftrightunsigned(fp, {64 - r})") if r else F.col("fp") for r in range(0, 64, BLOCK)))
    keys = nodes.select(F.col(name).alias("node"), F.posexplode(turned).alias("turn", "key"))
    parts = C.parallelism(nodes.sparkSession)
    placed = keys.repartition(parts, "turn", F.expr(f"shiftrightunsigned(key, {64 - BLOCK})")).select("turn", "key", "node").sortWithinPartitions("turn", "key")
    return placed.mapInArrow(_links_by_turn(budget), "u long, v long")


def _classes(df: DataFrame, shingle: int, budget: int) -> DataFrame:
    """doc_id, dk, row_key (of id and text), fp, least (the least fingerprint reachable) and component (the least dk reachable) of each row.

    Fingerprints are the nodes, so that rows which share an id, or have none, meet by their texts alone.
    """
    C.prepare(df.sparkSession)
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), C.doc_key().alias("dk"), F.xxhash64("doc_id", "text").alias("row_key"), C.text_col().alias("text"))
    prints = docs.mapInArrow(_fingerprints(shingle), "doc_id long, dk long, row_key long, fp long").checkpoint()
    nodes = prints.groupBy("fp").agg(F.min("dk").alias("dk")).checkpoint()
    least = components(trie_links(nodes, budget))
    named = nodes.join(least, nodes["fp"] == least["node"], "left").select("fp", "dk", F.coalesce("least", "fp").alias("least"))
    component = named.groupBy("least").agg(F.min("dk").alias("component"))
    return prints.join(named.drop("dk").join(component, "least"), "fp")


def simhash_near_dedup(df: DataFrame, shingle: int = 3, budget: int = 3) -> DataFrame:
    """One row per row of df (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    Texts with A-Z in lower case; words are runs without white space; fewer words than a shingle: the whole sequence; none
    (null text too): fingerprint zero, linked like any other.  Documents whose fingerprints differ in `budget` bits or fewer
    are linked; component_id is the least doc_id reachable.  A null id comes before all others and gives a null component.
    Equal rows each get a row; an empty table gives an empty one; other columns are ignored.
    """
    rows = _classes(df, shingle, budget)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("component") != -(2**63), F.col("component")).alias("component_id"))


def keep_one_of_each(df: DataFrame, shingle: int = 3, budget: int = 3) -> DataFrame:
    """The rows of df, with its columns, that have the least id of their component; of equal rows one stays, and of rows with one id and different texts one a component.  Other columns stay, whatever their names."""
    dk, row_key = names = C.free_names(df, "dk", "row_key")
    first = F.min(F.struct("dk", "row_key")).alias("first")
    kept = _classes(df, shingle, budget).groupBy("least").agg(first).select(F.col("first.dk").alias(dk), F.col("first.row_key").alias(row_key))
    named = df.withColumn(dk, C.doc_key()).withColumn(row_key, F.xxhash64("doc_id", "text"))
    return single(named.join(kept, names, "left_semi"), df, names)


def single(rows: DataFrame, df: DataFrame, names: list[str]) -> DataFrame:
    """One row of those with equal id and text hash (the named columns), with df's columns.  They stand in one task already; only ids that are met again are told apart there."""
    ids = df.groupBy(C.doc_key().alias(names[0])).count().where("count > 1").select(names[0])
    if not ids.take(1):
        return rows.select(*df.columns)
    again = rows.join(ids, names[0], "left_semi").dropDuplicates(names)
    return rows.join(ids, names[0], "left_anti").unionByName(again).select(*df.columns)


def _links_by_turn(budget: int, most: int = 200_000):
    """Rows in order of turn and key, whole subtrees of a block at a time, as many as make up about `most` rows."""
    one = _links(budget)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0
        for batch in frames:
            block = batch.column("key").to_numpy().view(np.uint64) >> np.uint64(64 - BLOCK)
            tree = batch.column("turn").to_numpy().astype(np.int64) << BLOCK | block.astype(np.int64)
            edge = [0, *(np.flatnonzero(np.diff(tree)) + 1).tolist(), len(tree)]
            for a, b in zip(edge, edge[1:], strict=False):
                if a == b:
                    continue
                if held and tree[a] != now and (size > most or tree[a] >> BLOCK != now >> BLOCK):
                    yield from one(iter(held))
                    held, size = [], 0
                now = tree[a]
                held.append(batch.slice(a, b - a))
                size += b - a
        yield from one(iter(held))

    return run
