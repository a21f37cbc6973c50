"""Anchored search for repeated windows, shared by the two exact-substring operators.

A window (13 words, or 400 bytes) belongs to its smallest k-gram by hash, its anchor; equal windows have equal anchors at equal
offsets.  The run of windows around one anchor is a chunk.  Suffixes are indexed at anchors only; what stands before the
anchor is the chunk's left context.  Documents are dealt by a hash of the row to slabs, four a shuffle partition, so
that a key, however frequent, has one row a slab at most:

1. each slab counts its anchor keys; keys that a single place has are done with;
2. each slab lists its different chunks at the keys that are left; a key with more than `most` places gets a longer prefix, the
   whole window, and its windows are listed one by one;
3. the first slab of each different chunk sends its content, once;
4. an index over a group of chunks (subtree, or suffix-array family) says which windows repeat;
5. what it says goes back to the slabs that have the chunk.

All steps read one shuffle of the texts.  Chunks are told apart by two 64-bit hashes; windows of different chunks are
compared symbol by symbol.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

LEAST = -(2**63)
SLABS = 4


@dataclass(frozen=True)
class Windows:
    """What a window is made of: `window` symbols, words or bytes; anchors are `gram` symbols."""

    kind: str
    window: int
    gram: int
    #: Places of a key beyond which its prefix grows to the whole window.
    most: int = 50_000
    #: Only windows of another document count as repeats.
    across: bool = False


@dataclass
class Chunks:
    """The chunks of a batch of documents, as arrays: document's number, anchor key, places of anchor and of first and last window."""

    data: np.ndarray
    codes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray  # each document's first symbol, and the end
    doc: np.ndarray
    key: np.ndarray
    anchor: np.ndarray
    first: np.ndarray
    last: np.ndarray


def symbols(spec: Windows, texts: list[np.ndarray], hashes: bool = True):
    """All texts in one array, with the symbols' codes, byte starts and ends, and each text's first symbol."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    if spec.kind == "bytes":
        data = np.concatenate([*texts, np.zeros(0, dtype=np.uint8)])
        at = np.arange(len(data) + 1)
        return data, C.BYTE[data] if hashes else None, at[:-1], at[1:], np.concatenate(([0], np.cumsum(sizes)))
    data = np.frombuffer(b" ".join([t.data for t in texts]), dtype=np.uint8)
    starts, ends = C.word_bounds(data)
    offsets = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes + 1))))
    return data, C.word_hashes(data, starts, ends) if hashes else None, starts, ends, offsets


def chunks(spec: Windows, texts: list[np.ndarray]) -> Chunks:
    data, codes, starts, ends, offsets = symbols(spec, texts)
    none = np.zeros(0, dtype=np.int64)
    if len(codes) < spec.window:
        return Chunks(data, codes, starts, ends, offsets, none, none.view(np.uint64), none, none, none)
    i = np.arange(len(codes) - spec.gram + 1)
    grams = C.Rolling(codes).of(i, i + spec.gram)
    at = C.sliding_argmin(grams, spec.window - spec.gram + 1)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    head, tail = doc[: len(at)], doc[spec.window - 1 :]
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:] - 1, [len(at) - 1]))
    inside = head[first] == tail[first]
    first, last = first[inside], last[inside]
    return Chunks(data, codes, starts, ends, offsets, head[first], grams[at[first]], at[first], first, last)


def groups(frames: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Batches with their texts, cut so that the texts of one hold about `most` bytes or are a single one."""
    for batch in frames:
        texts = list(C.raw_texts(batch.column("text")))
        start = size = 0
        for i, t in enumerate(texts):
            if i > start and size + len(t) > most:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(t)
        if texts:
            yield batch.slice(start), texts[start:]


def slabs(df: DataFrame) -> DataFrame:
    """slab, dk (the id in order, null as the least number) and text."""
    n = SLABS * C.parallelism(df.sparkSession)
    rows = df.select(C.doc_key().alias("dk"), C.text_col().alias("text"))
    return rows.select(F.pmod(F.xxhash64("dk", "text"), F.lit(n)).cast("int").alias("slab"), "dk", "text")


def joined(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate([*parts, np.zeros(0, dtype=kind)]).astype(kind, copy=False)


def heads(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows starts."""
    new = np.ones(len(columns[0]), dtype=bool)
    if len(new):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def _slab(table: pa.Table) -> int:
    return table.column("slab")[0].as_py()


def _keys(spec: Windows):
    schema = pa.schema([("akey", pa.int64()), ("slab", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64()), ("n", pa.int64())])

    def run(docs: pa.Table) -> pa.Table:
        key, dk = [], []
        for batch, texts in groups(docs.to_batches()):
            c = chunks(spec, texts)
            key.append(c.key)
            dk.append(batch.column("dk").to_numpy()[c.doc])
        key, dk = joined(key, np.uint64), joined(dk, np.int64)
        order = np.argsort(key)
        key, dk = key[order], dk[order]
        at = heads(key)
        if not len(at):
            return schema.empty_table()
        lo, hi, n = np.minimum.reduceat(dk, at), np.maximum.reduceat(dk, at), np.diff(np.append(at, len(key)))
        return pa.table([C.signed(key[at]), np.full(len(at), _slab(docs), dtype=np.int32), lo, hi, n], schema=schema)

    return run


def _windows_of(c: Chunks, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each window of the picked chunks, and its chunk."""
    chunk = np.flatnonzero(pick)
    count = c.last[chunk] - c.first[chunk] + 1
    before = np.cumsum(count) - count
    return np.arange(count.sum()) + np.repeat(c.first[chunk] - before, count), np.repeat(chunk, count)


def _outline(spec: Windows):
    schema = pa.schema([("akey", pa.int64()), ("second", pa.int64()), ("slab", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64()), ("n", pa.int64()), ("anchor", pa.int64())])

    def run(docs: pa.Table, flagged: pa.Table) -> pa.Table:
        if not docs.num_rows or not flagged.num_rows:
            return schema.empty_table()
        keys, deep = flagged.column("akey").to_numpy().view(np.uint64), flagged.column("deep").to_numpy()
        order = np.argsort(keys)
        keys, deep = keys[order], deep[order]
        parts: list[list[np.ndarray]] = [[], [], [], [], []]
        for batch, texts in groups(docs.to_batches()):
            c = chunks(spec, texts)
            ids, second = batch.column("dk").to_numpy(), C.Rolling(c.codes, 1)
            at = np.minimum(np.searchsorted(keys, c.key), len(keys) - 1)
            hit = keys[at] == c.key
            long = hit & deep[at]
            pick = hit & ~long
            rows = (c.key[pick], second.of(c.first[pick], c.last[pick] + spec.window), ids[c.doc[pick]], np.zeros(pick.sum(), dtype=bool), c.key[pick])
            w, chunk = _windows_of(c, long)
            more = (C.Rolling(c.codes).of(w, w + spec.window), second.of(w, w + spec.window), ids[c.doc[chunk]], np.ones(len(w), dtype=bool), c.key[chunk])
            for col, a, b in zip(parts, rows, more, strict=True):
                col += [a, b]
        key, two, dk, long, anchor = (joined(p, k) for p, k in zip(parts, (np.uint64, np.uint64, np.int64, bool, np.uint64), strict=True))
        order = np.lexsort((long, two, key))
        key, two, dk, long, anchor = (x[order] for x in (key, two, dk, long, anchor))
        at = heads(key, two, long)
        if not len(at):
            return schema.empty_table()
        n = np.diff(np.append(at, len(key)))
        columns = [C.signed(key[at]), C.signed(two[at]), np.full(len(at), _slab(docs), dtype=np.int32), np.minimum.reduceat(dk, at), np.maximum.reduceat(dk, at), n, pa.array(C.signed(anchor[at]), mask=~long[at])]
        return pa.table(columns, schema=schema)

    return run


def matched(asked: pa.Table, key: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks with the two hashes of a row of `asked`, and that row; all pairs of them."""
    one, two = (asked.column(n).to_numpy().view(np.uint64) for n in ("akey", "second"))
    have, ask = two ^ C.mix(one), second ^ C.mix(key)
    order = np.argsort(have)
    have = have[order]
    low = np.searchsorted(have, ask)
    count = np.searchsorted(have, ask, side="right") - low
    at = np.repeat(np.arange(len(key)), count)
    row = order[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())]
    same = (one[row] == key[at]) & (two[row] == second[at])
    return at[same], row[same]


ODD = (b"\t", b"\n", b"\x0b", b"\x0c", b"\r", b"  ")


def _plain(spec: Windows, raw: bytes) -> bytes:
    """Words with one space between them."""
    return b" ".join(raw.split()) if spec.kind == "words" and any(x in raw for x in ODD) else raw


#: A different chunk: hashes, slabs that have it (with their latest id where only other documents count), its key where its prefix is the whole window, content, anchor's place in it and number of windows.
PLACES = {True: "array<struct<slab:int,hi:long>>", False: "array<struct<slab:int>>"}
FACTS = {True: "least long", False: "n long"}


def content_schema(across: bool) -> str:
    return f"akey long, second long, {FACTS[across]}, places {PLACES[across]}, anchor long, content binary, back int, windows int"


def arrow_places(across: bool) -> pa.DataType:
    return pa.list_(pa.struct([("slab", pa.int32()), *([("hi", pa.int64())] if across else [])]))


def _contents(spec: Windows):
    """Each asked chunk, with its content where it is to be compared with others."""

    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        names = [n for n in asked.column_names if n not in ("slab", "alone")]

        def rows(part: pa.Table, content: pa.Array, back: np.ndarray, windows: np.ndarray) -> pa.Table:
            known = [part.column(n).cast(arrow_places(spec.across)) if n == "places" else part.column(n) for n in names]
            return pa.table([*known, content, back.astype(np.int32), windows.astype(np.int32)], names=[*names, "content", "back", "windows"])

        alone = asked.filter(asked.column("alone"))
        none = np.zeros(alone.num_rows)
        out = [rows(alone, pa.nulls(alone.num_rows, pa.binary()), none, none)]
        asked = asked.filter(pc.invert(asked.column("alone")))
        served = np.zeros(asked.num_rows, dtype=bool)
        for _, texts in groups(docs.to_batches()) if asked.num_rows else ():
            c = chunks(spec, texts)
            at, row = matched(asked, c.key, C.Rolling(c.codes, 1).of(c.first, c.last + spec.window))
            row, first = np.unique(row, return_index=True)
            row, at = row[~served[row]], at[first][~served[row]]
            served[row] = True
            raw = c.data.tobytes()
            content = [_plain(spec, raw[b:e]) for b, e in zip(c.starts[c.first[at]].tolist(), c.ends[c.last[at] + spec.window - 1].tolist(), strict=True)]
            out.append(rows(asked.take(pa.array(row)), pa.array(content, pa.binary()), c.anchor[at] - c.first[at], c.last[at] - c.first[at] + 1))
        return pa.concat_tables(out)

    return run


class Repeats:
    """The steps before and after an index, as DataFrames."""

    def __init__(self, df: DataFrame, spec: Windows):
        self.spec, self.parts = spec, C.parallelism(df.sparkSession)
        self.slabs = slabs(df).groupBy("slab")
        met = Window.partitionBy("akey")
        keys = self.slabs.applyInArrow(_keys(spec), "akey long, slab int, lo long, hi long, n long")
        keys = keys.select("akey", "slab", F.sum("n").over(met).alias("n"), F.min("lo").over(met).alias("lo"), F.max("hi").over(met).alias("hi"))
        again = keys.where(F.col("lo") < F.col("hi") if spec.across else F.col("n") > 1)
        self.flagged = again.select("slab", "akey", (F.col("n") > spec.most).alias("deep"))

    def contents(self, leave_alone: bool = False) -> DataFrame:
        """Every different chunk, as content_schema.

        Content is null where there is nothing to compare: its prefix is the whole window or, if leave_alone, no other chunk has its key.
        """
        outline = self.slabs.cogroup(self.flagged.groupBy("slab")).applyInArrow(_outline(self.spec), "akey long, second long, slab int, lo long, hi long, n long, anchor long")
        # a key has few rows: one a slab for each different chunk, of which there are at most spec.most
        place = F.struct("slab", "hi") if self.spec.across else F.struct("slab")
        asked = outline.repartition(self.parts, "akey").groupBy("akey", "second").agg(
            F.min("lo").alias("least") if self.spec.across else F.sum("n").alias("n"), F.collect_list(place).alias("places"), F.min("anchor").alias("anchor")
        )
        alone = F.col("anchor").isNotNull()
        if leave_alone:
            alone = alone | (F.count("*").over(Window.partitionBy("akey")) == 1)
        asked = asked.select("*", F.array_min("places")["slab"].alias("slab"), alone.alias("alone"))
        return self.slabs.cogroup(asked.groupBy("slab")).applyInArrow(_contents(self.spec), content_schema(self.spec.across))

    def apply(self, told: DataFrame, run, schema: str) -> DataFrame:
        """told: slab, akey, second, anchor and verdict."""
        return self.slabs.cogroup(told.groupBy("slab")).applyInArrow(run, schema)


def places(spec: Windows, c: Chunks, told: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, document and row of `told` for each chunk, or single window, that something is told of."""
    none = np.zeros(0, dtype=np.int64)
    if not told.num_rows or not len(c.key):
        return none, none, none, none
    second = C.Rolling(c.codes, 1)
    anchors = told.column("anchor").drop_null().unique().to_numpy().view(np.uint64)
    long = np.isin(c.key, anchors) if len(anchors) else np.zeros(len(c.key), dtype=bool)
    at, row = matched(told, c.key, second.of(c.first, c.last + spec.window))
    w, chunk = _windows_of(c, long)
    at_2, row_2 = matched(told, C.Rolling(c.codes).of(w, w + spec.window), second.of(w, w + spec.window))
    first, count = np.concatenate((c.first[at], w[at_2])), np.concatenate((c.last[at] - c.first[at] + 1, np.ones(len(at_2), dtype=np.int64)))
    return first, count, np.concatenate((c.doc[at], c.doc[chunk[at_2]])), np.concatenate((row, row_2))


@dataclass
class Leaves:
    """Chunks as leaves of subtrees, one subtree a group: symbols from the anchor on, and backwards from it."""

    group: np.ndarray
    right: np.ndarray  # a row of symbols each, zeros behind its end
    n_right: np.ndarray
    left: np.ndarray
    back: np.ndarray  # symbols of left context
    windows: np.ndarray

    def __len__(self) -> int:
        return len(self.group)


def gathered(flat: np.ndarray, start: np.ndarray, count: np.ndarray, step: int, width: int) -> np.ndarray:
    """Rows of up to `width` symbols from start on, forwards or backwards, with zeros behind their end."""
    k = np.arange(width)
    inside = k < count[:, None]
    return np.where(inside, flat[np.where(inside, start[:, None] + step * k, 0)], flat.dtype.type(0)) if len(flat) else np.zeros((len(start), width), dtype=flat.dtype)


def subtree(group: np.ndarray, symbols: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaves in order, and the depth of the node between each and the one before it; -1 between groups.

    Sorted suffixes with the depths between them are a suffix tree: a run of leaves with depths of d and more between them
    is the subtree of an internal node at least that deep.
    """
    big = symbols.astype(symbols.dtype.newbyteorder(">"))
    rows = np.concatenate([x.astype(">u4").reshape(-1, 1).view(np.uint8) if x.ndim == 1 else x.view(np.uint8).reshape(len(x), x.shape[1] * x.itemsize) for x in (group + 1, big, count + 1)], axis=1)
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")
    a, b = symbols[order[1:]], symbols[order[:-1]]
    differ = np.concatenate((a != b, np.ones((len(a), 1), dtype=bool)), axis=1)
    depth = np.minimum(differ.argmax(axis=1), np.minimum(count[order[1:]], count[order[:-1]]))
    depth[group[order[1:]] != group[order[:-1]]] = -1
    return order, np.concatenate((np.full(min(1, len(order)), -1), depth))


def _deepest(order: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Depth of the deepest node above each leaf."""
    out = np.zeros(len(order), dtype=np.int64)
    out[order] = np.maximum(depth, np.append(depth[1:], -1))
    return out


def repeats_of(leaves: Leaves, window: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The repeats among different chunks: leaves, number of the window in each, and the set that the window belongs to.

    A window with o symbols before the anchor repeats where two leaves are below one node of window - o symbols to the right and
    below one node of o symbols in the tree of the left contexts; such pairs of nodes hold the maximal repeats.
    """
    if len(leaves) < 2:
        return
    right = subtree(leaves.group, leaves.right, leaves.n_right)
    left = subtree(leaves.group, leaves.left, leaves.back)
    far, near = _deepest(*right), _deepest(*left)
    if not np.any(far + near >= window):
        return
    node_r, node_l = np.zeros(len(leaves), dtype=np.int64), np.zeros(len(leaves), dtype=np.int64)
    for o in range(window - gram + 1):
        at = leaves.back - o
        some = np.flatnonzero((at >= 0) & (at < leaves.windows) & (far >= window - o) & (near >= o))
        if len(some) < 2:
            continue
        node_r[right[0]] = np.cumsum(right[1] < window - o)
        node_l[left[0]] = np.cumsum(left[1] < o)
        _, which, count = np.unique(node_r[some] * len(leaves) + node_l[some], return_inverse=True, return_counts=True)
        more = count[which] > 1
        if more.any():
            yield some[more], at[some[more]], which[more]


def by_group(frames: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Tables of whole keys, about `most` bytes of content each, from rows in order of akey."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in frames:
        if not batch.num_rows:
            continue
        key = batch.column(batch.schema.get_field_index("akey")).to_numpy()
        cut = heads(key)
        if held and held[-1].column(held[-1].schema.get_field_index("akey"))[-1].as_py() == key[0]:
            cut = cut[1:]
        if size > most and len(cut):
            held.append(batch.slice(0, cut[0]))
            yield pa.Table.from_batches(held)
            held, size, batch = [], 0, batch.slice(cut[0])
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.Table.from_batches(held)


def ids_of(dk: list[int]) -> list[int | None]:
    return [None if d == LEAST else d for d in dk]
