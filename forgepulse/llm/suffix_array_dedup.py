"""Operator 6: removal of 400-byte strings that occur elsewhere, by a logarithmic family of suffix arrays.

Documents come in batches.  The suffixes at a batch's anchors are sorted into a suffix array, split by a hash of the anchor
into buckets; it is merge-scanned against the array of every level for long matches; levels of one size then merge into
the next, as digits carry.  Levels are bucketed tables in the shared folder, so that scans and merges move no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import repeats as R

RUNS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
ROW = f"bucket int, akey long, second long, n long, places {R.PLACES[False]}, anchor long, content binary, back int, windows int"
#: A suffix of the merged array, or what is known of one: the runs of its windows that occur elsewhere.
STEP = f"{ROW}, place int, runs array<struct<lo:int,hi:int>>, found boolean"
_STEP = pa.schema([("bucket", pa.int32()), ("akey", pa.int64()), ("second", pa.int64()), ("n", pa.int64()), ("places", R.arrow_places(False)), ("anchor", pa.int64()), ("content", pa.binary()), ("back", pa.int32()), ("windows", pa.int32()), ("place", pa.int32()), ("runs", RUNS), ("found", pa.bool_())])


def leaves_of(spec: R.Windows, rows: pa.Table) -> R.Leaves:
    """The chunks' bytes around each anchor."""
    flat = np.frombuffer(b"".join(rows.column("content").to_pylist()), dtype=np.uint8)
    count = pc.binary_length(rows.column("content")).to_numpy().astype(np.int64)
    first = np.cumsum(count) - count
    back, windows = (rows.column(n).to_numpy().astype(np.int64) for n in ("back", "windows"))
    group = np.cumsum(np.concatenate((np.zeros(min(1, len(count)), dtype=np.int64), np.diff(rows.column("akey").to_numpy()) != 0)))
    right = np.minimum(count - back, spec.window)
    most = spec.window - spec.gram
    return R.Leaves(group, R.gathered(flat, first + back, right, 1, spec.window), right, R.gathered(flat, first + back - 1, np.minimum(back, most), -1, most), back, windows)


def runs_of(flags: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Chunks with a flagged window, and the runs of flagged windows in each; flags stand chunk after chunk."""
    first = np.cumsum(windows) - windows
    chunk = np.repeat(np.arange(len(windows)), windows)
    before = np.concatenate((np.zeros(min(1, len(flags)), dtype=bool), flags[:-1] & (chunk[1:] == chunk[:-1])))
    after = np.concatenate((flags[1:] & (chunk[1:] == chunk[:-1]), np.zeros(min(1, len(flags)), dtype=bool)))
    lo, hi = np.flatnonzero(flags & ~before), np.flatnonzero(flags & ~after)
    own = chunk[lo]
    runs = pa.StructArray.from_arrays([pa.array((lo - first[own]).astype(np.int32)), pa.array((hi - first[own] + 1).astype(np.int32))], fields=list(RUNS.value_type))
    at = R.heads(own)
    return own[at], pa.ListArray.from_arrays(np.append(at, len(own)).astype(np.int32), runs)


def scanned(spec: R.Windows, rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the windows that more than one of these chunks has, chunk after chunk, and the chunks in the order of their suffixes."""
    leaves = leaves_of(spec, rows)
    first = np.cumsum(leaves.windows) - leaves.windows
    flags = np.zeros(leaves.windows.sum(), dtype=bool)
    for chunk, at, _ in R.repeats_of(leaves, spec.window, spec.gram):
        flags[first[chunk] + at] = True
    return flags, R.subtree(leaves.group, leaves.right, leaves.n_right)[0]


def _step(spec: R.Windows, carried: list[int], most: int = 8 << 20):
    """A bucket's share of a new batch against that of each level; the batch and the levels in `carried` come out as one array."""
    names = _STEP.names[:9]

    def found(rows: pa.Table, flags: np.ndarray) -> pa.Table:
        chunk, runs = runs_of(flags, rows.column("windows").to_numpy().astype(np.int64))
        part = rows.take(pa.array(chunk))
        known = {n: part.column(n) for n in ("bucket", "akey", "second", "places", "anchor")} | {"runs": runs, "found": np.ones(len(chunk), dtype=bool)}
        return pa.table([known.get(f.name, pa.nulls(len(chunk), f.type)) for f in _STEP], schema=_STEP)

    def share(rows: pa.Table, at_place: list[int]) -> Iterator[pa.Table]:
        """Some keys' rows, in order of akey; level is -1 for the new batch."""
        level = rows.column("level").to_numpy()
        new, merged = level == -1, None
        copies = np.repeat(new & (rows.column("n").to_numpy() > 1), rows.column("windows").to_numpy())
        if copies.any():
            yield found(rows, copies)
        content = pc.is_valid(rows.column("content")).to_numpy()
        for at in [None, *np.unique(level[level >= 0]).tolist()]:
            part = rows.filter(pa.array(content & (new if at is None else new | (level == at))))
            if not part.num_rows or at is not None and np.all(part.column("level").to_numpy() == at):
                continue  # nothing new meets this level
            flags, order = scanned(spec, part)
            if flags.any():
                yield found(part, flags)
            if at is None and not carried:
                merged = part.take(pa.array(order))
        if carried:
            part = rows.filter(pa.array(content & np.isin(level, [-1, *carried])))
            if part.num_rows:
                leaves = leaves_of(spec, part)
                merged = part.take(pa.array(R.subtree(leaves.group, leaves.right, leaves.n_right)[0]))
        if merged is not None and merged.num_rows:
            n = merged.num_rows
            place = np.arange(at_place[0], at_place[0] + n, dtype=np.int32)
            at_place[0] += n
            yield pa.table([*(merged.column(x) for x in names), place, pa.nulls(n, RUNS), np.zeros(n, dtype=bool)], schema=_STEP)

    def run(batch: pa.Table, levels: pa.Table) -> pa.Table:
        if not batch.num_rows and not carried:
            return _STEP.empty_table()
        count, at_place = batch.num_rows, [0]
        batch = batch.append_column("place", pa.array(np.arange(count, dtype=np.int32))).append_column("level", pa.array(np.full(count, -1, dtype=np.int32)))
        kinds = pa.schema([*(_STEP.field(n) for n in (*names, "place")), pa.field("level", pa.int32())])
        rows = pa.concat_tables([batch.select(kinds.names).cast(kinds), levels.select(kinds.names).cast(kinds)])
        # by key, each array in its own order
        rows = rows.take(pa.array(np.lexsort([rows.column(n).to_numpy() for n in ("place", "level", "akey")])))
        out = [t for part in R.by_group(iter(rows.combine_chunks().to_batches(max_chunksize=4096)), most) for t in share(part, at_place)]
        return pa.concat_tables(out) if out else _STEP.empty_table()

    return run


class IndexFamily:
    """Suffix arrays of geometrically growing sizes, as tables in a shared folder, each bucketed alike."""

    def __init__(self, spark: SparkSession, spec: R.Windows, buckets: int, parts: int):
        self.spark, self.spec, self.buckets, self.parts = spark, spec, buckets, parts
        self.folder = f"{C.shared_folder(spark)}/suffix-arrays-{uuid.uuid4().hex}"
        self.levels: dict[int, str] = {}
        self.made = 0
        self.names: list[str] = []

    def write(self, rows: DataFrame, folder: str, order: str) -> str:
        """A table of rows that come with those of a bucket together, in a folder for each value of a column."""
        name = f"arrays_{self.folder[-32:]}_{self.made}"
        self.made += 1
        self.names.append(name)
        writer = rows.write.format("parquet").option("compression", "zstd").option("path", f"{self.folder}/{name}")
        writer.partitionBy(folder).bucketBy(self.parts, "bucket").sortBy("bucket", order).saveAsTable(name)
        return name

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        C.delete(self.spark, f"{self.folder}/{name}")

    def close(self) -> None:
        """Drops all tables and the folder; nothing may be read of them any more."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        C.delete(self.spark, self.folder)

    def add(self, batch: DataFrame) -> DataFrame:
        """Takes a batch (as ROW) in; gives the chunks, new or old, with windows that a new one shares: akey, second, anchor, places, runs."""
        carried = []
        while len(carried) in self.levels:
            carried.append(len(carried))
        none = self.spark.createDataFrame([], f"{ROW}, place int, level int")
        levels = None
        for rank, name in self.levels.items():
            rows = self.spark.table(name).where("NOT found").select(*none.columns[:-1], F.lit(rank).alias("level"))
            levels = rows if levels is None else levels.unionByName(rows)
        grouped = batch.groupBy("bucket").cogroup((none if levels is None else levels).groupBy("bucket"))
        name = self.write(grouped.applyInArrow(_step(self.spec, carried), STEP), "found", "place")
        for rank in carried:  # the matches that were told stay
            C.delete(self.spark, f"{self.folder}/{self.levels.pop(rank)}/found=false")
        self.levels[len(carried)] = name
        return self.spark.table(name).where("found").select("akey", "second", "anchor", "places", "runs")


def _apply(spec: R.Windows):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        lists = told.column("verdict").combine_chunks() if told.num_rows else None
        out: list[list] = [[], [], [], [], [], []]
        for batch, texts in R.groups(docs.to_batches()):
            starts = ends = doc = np.zeros(0, dtype=np.int64)
            sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
            offsets = np.concatenate(([0], np.cumsum(sizes)))
            if lists is not None:
                first, _, doc, row = R.places(spec, R.chunks(spec, texts), told)
                offset, runs = lists.offsets.to_numpy().astype(np.int64), lists.values
                count = offset[row + 1] - offset[row]
                which = np.repeat(offset[row], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                first, doc = np.repeat(first, count), np.repeat(doc, count)
                starts, ends = first + runs.field("lo").to_numpy()[which], first + runs.field("hi").to_numpy()[which] - 1 + spec.window
                order = np.argsort(doc, kind="stable")
                starts, ends, doc = starts[order], ends[order], doc[order]
            edge = np.searchsorted(doc, np.arange(len(texts) + 1))
            for i, (d, data) in enumerate(zip(batch.column("dk").to_pylist(), texts, strict=True)):
                kept, s, e = data.tobytes(), starts[edge[i] : edge[i + 1]] - offsets[i], ends[edge[i] : edge[i + 1]] - offsets[i]
                if len(s):
                    s, e = C.merge_spans(s, e)
                    cut = [0, *np.stack((s, e), axis=1).ravel().tolist(), len(kept)]
                    kept = b"".join([kept[a:b] for a, b in zip(cut[::2], cut[1::2], strict=True)])
                spans = [{"start": a, "end": b} for a, b in zip(s.tolist(), e.tolist(), strict=True)]
                for col, x in zip(out, (d, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans), strict=True):
                    col.append(x)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip([R.ids_of(out[0]), *out[1:]], types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return run


def suffix_array_dedup(df: DataFrame, window: int = 400, gram: int = 32, most: int = 50_000, batches: int = 4) -> DataFrame:
    """One row per row of df (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed byte spans.

    A byte goes if a string of `window` bytes over it also starts anywhere else, in the same document too; all copies go.
    Null text is empty; rows with one id are two places like any others; texts under `window` bytes are kept whole; an
    empty table gives an empty one; other columns are ignored.  The documents come in `batches` batches; an anchor with more
    than `most` places gets the whole window as its prefix.  The rows are the same with any number of either.
    """
    spark = df.sparkSession
    C.prepare(spark)
    spec = R.Windows("bytes", window, gram, most)
    steps = R.Repeats(df, spec)
    buckets = R.SLABS * steps.parts
    family = IndexFamily(spark, spec, buckets, steps.parts)
    windows = F.greatest("windows", F.lit(1))
    first = F.array_min("places")["slab"]
    rows = steps.contents().select(F.pmod(F.xxhash64("akey"), F.lit(buckets)).cast("int").alias("bucket"), "akey", "second", "n", "places", "anchor", "content", "back", windows.alias("windows"), F.pmod(first, F.lit(batches)).alias("batch"))
    arriving = family.write(rows.repartition(steps.parts, "bucket"), "batch", "akey")
    matches = None
    for b in range(batches):
        got = family.add(spark.table(arriving).where(F.col("batch") == b).drop("batch"))
        matches = got if matches is None else matches.unionByName(got)
    family.drop(arriving)
    told = matches.select("akey", "second", "anchor", F.col("runs").alias("verdict"), F.explode("places").alias("place"))
    told = told.select("place.slab", "akey", "second", "anchor", "verdict").checkpoint()
    family.close()
    return steps.apply(told, _apply(spec), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")
