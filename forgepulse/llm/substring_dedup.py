"""Operator 1: removal of word windows that an earlier document has, by prefix-partitioned suffix trees.

Suffixes that start at an anchor are split by a prefix of five words; where more places share it than a task should
hold, the prefix grows to the whole window.  Each group of suffixes that share a prefix gets its own subtree; nodes at least as
deep as what a window still needs behind its anchor, met with those of its left context, give the maximal repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import repeats as R


def leaves_of(spec: R.Windows, rows: pa.Table) -> R.Leaves:
    """The chunks' words, each word by a number of its own, around each anchor."""
    data = b"".join([x + b" " for x in rows.column("content").to_pylist()])
    starts, _ = C.word_bounds(np.frombuffer(data, dtype=np.uint8))
    # a word and the one space behind it are a value
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data)])
    codes = words.dictionary_encode().indices.to_numpy() + np.int32(1)
    group = np.cumsum(np.concatenate(([0], np.diff(rows.column("akey").to_numpy()) != 0)))
    ends = np.cumsum(pc.binary_length(rows.column("content")).to_numpy().astype(np.int64) + 1)
    first = np.searchsorted(starts, np.concatenate(([0], ends[:-1])))
    count = np.diff(np.append(first, len(starts)))
    back, windows = (rows.column(n).to_numpy().astype(np.int64) for n in ("back", "windows"))
    right = np.minimum(count - back, spec.window)
    most = spec.window - spec.gram
    return R.Leaves(group, R.gathered(codes, first + back, right, 1, spec.window), right, R.gathered(codes, first + back - 1, back, -1, most), back, windows)


def _index(spec: R.Windows, most: int = 8 << 20):
    """For each chunk the least ids that hold its windows; one for all where they are alike."""
    schema = pa.schema([("akey", pa.int64()), ("second", pa.int64()), ("anchor", pa.int64()), ("places", R.arrow_places(True)), ("verdict", pa.list_(pa.int64()))])

    def verdicts(rows: pa.Table, windows: np.ndarray, lowest: np.ndarray) -> Iterator[pa.RecordBatch]:
        """lowest: the windows' least ids, chunk after chunk."""
        first = np.cumsum(windows) - windows
        alike = np.minimum.reduceat(lowest, first) == np.maximum.reduceat(lowest, first)
        sizes = np.where(alike, 1, windows)
        which = np.arange(sizes.sum()) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
        lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), pa.array(lowest[which]))
        yield from pa.table([*(rows.column(n).cast(schema.field(n).type) for n in schema.names[:4]), lists], schema=schema).to_batches()

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in R.by_group(frames, most):
            leaf = rows.filter(pc.is_null(rows.column("content")))  # a subtree of one leaf
            if leaf.num_rows:
                yield from verdicts(leaf, np.ones(leaf.num_rows, dtype=np.int64), leaf.column("least").to_numpy())
            rows = rows.filter(pc.is_valid(rows.column("content")))
            if rows.num_rows:
                leaves, least = leaves_of(spec, rows), rows.column("least").to_numpy()
                first = np.cumsum(leaves.windows) - leaves.windows
                lowest = np.repeat(least, leaves.windows)
                for chunk, at, which in R.repeats_of(leaves, spec.window, spec.gram):
                    lows = np.full(which.max() + 1, np.iinfo(np.int64).max)
                    np.minimum.at(lows, which, least[chunk])
                    lowest[first[chunk] + at] = lows[which]
                yield from verdicts(rows, leaves.windows, lowest)

    return run


def _apply(spec: R.Windows):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        lists = told.column("verdict").combine_chunks() if told.num_rows else None
        out: list[list] = [[], [], [], [], []]
        for batch, texts in R.groups(docs.to_batches()):
            dk = batch.column("dk").to_numpy()
            if lists is None:
                data, _, starts, ends, offsets = R.symbols(spec, texts, hashes=False)
            else:
                c = R.chunks(spec, texts)
                data, starts, ends, offsets = c.data, c.starts, c.ends, c.offsets
            lost = np.zeros(len(starts) + 1, dtype=np.int32)
            if lists is not None:
                first, count, doc, row = R.places(spec, c, told)
                offset, least = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                which = np.repeat(offset[row], count) + np.where(np.repeat(offset[row + 1] - offset[row], count) == 1, 0, step)
                at = (np.repeat(first, count) + step)[least[which] < np.repeat(dk[doc], count)]
                np.add.at(lost, at, 1)
                np.add.at(lost, at + spec.window, -1)
            keep = np.cumsum(lost[:-1]) == 0
            raw = data.tobytes()
            for i, d in enumerate(dk.tolist()):
                a, b = offsets[i], offsets[i + 1]
                own = keep[a:b]
                s, e = starts[a:b][own], ends[a:b][own]
                kept = b" ".join([raw[x:y] for x, y in zip(s.tolist(), e.tolist(), strict=True)])
                for col, x in zip(out, (d, b - a, b - a - len(s), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    col.append(x)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip([R.ids_of(out[0]), *out[1:]], types, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def substring_dedup(df: DataFrame, window: int = 13, gram: int = 5, most: int = 50_000) -> DataFrame:
    """One row per row of df (doc_id, text): doc_id, n_words, n_removed, kept_sha256 and the kept text.

    A word goes if a window of `window` words over it also starts in a document with a smaller id.  Windows are judged on the
    input.  Null text has no words; a null id comes before all others; rows with one id never remove each other's
    words (their ids are not smaller) and each gets its own row; short texts are kept whole; an empty table gives an empty
    one; other columns are ignored.  `most` says how many places may share a short prefix; the rows are the same with any.
    """
    C.prepare(df.sparkSession)
    spec = R.Windows("words", window, gram, most, across=True)
    steps = R.Repeats(df, spec)
    grouped = steps.contents(leave_alone=True).repartition(steps.parts, "akey").sortWithinPartitions("akey")
    verdicts = grouped.mapInArrow(_index(spec), f"akey long, second long, anchor long, places {R.PLACES[True]}, verdict array<long>")
    told = verdicts.select("akey", "second", "anchor", "verdict", F.explode("places").alias("place")).where(F.array_min("verdict") < F.col("place.hi"))
    told = told.select("place.slab", "akey", "second", "anchor", "verdict")
    out = steps.apply(told, _apply(spec), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary")
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", F.decode("kept", "UTF-8").alias("kept"))
