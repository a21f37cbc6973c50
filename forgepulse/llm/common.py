"""Helpers shared by the operators: session settings, documents, word and byte hashing with numpy."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import dealt_anew as dealt_anew
from ..runtime import ship

#: White space of the word rules: space and \x09 to \x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
WORD = r"[^\x20\x09-\x0D]+"

#: Rows in an Arrow batch; keeps a batch of long documents in a worker's memory.
BATCH_ROWS = 256

_rng = np.random.default_rng(20240117)
#: A random odd 64-bit number for each byte, and two odd bases with their inverses modulo 2**64.
BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
INVERSES = tuple(pow(b, -1, 2**64) for b in BASES)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 17, 1 << int(n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 24:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xCA5A826395121157)
    return h ^ (h >> np.uint64(32))


class Rolling:
    """Hashes of any slice of a sequence of 64-bit codes, from prefix sums."""

    def __init__(self, codes: np.ndarray, which: int = 0):
        n = len(codes)
        self.inv = powers(INVERSES[which], n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(codes * powers(BASES[which], n), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inv[start])


def word_bounds(data: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the words' starts and ends."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~space[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Rolling(BYTE[data]).of(starts, ends)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` hashes, the index of its smallest by the upper 32 bits, the first one of equals; by doubling."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    keys = (values & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(values), dtype=np.uint64)
    have = 1
    while have < width:
        step = min(have, width - have)
        keys = np.minimum(keys[:-step], keys[step:])
        have += step
    return (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans, as maximal runs in order; spans that touch become one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > ends[:-1]))
    return starts[new], ends[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(ends) - 1]))]


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, and a checkpoint folder: the cluster's own, or a local one where it names none (tests)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    if not context.getConf().get("spark.checkpoint.dir", "") and context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))


    ship(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints, which all executors share; after prepare()."""
    set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    return set_dir.get() if set_dir.isDefined() else spark.sparkContext.getConf().get("spark.checkpoint.dir")


def delete(spark: SparkSession, folder: str) -> None:
    """Removes a folder of a store that Spark writes to."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def doc_key(name: str = "doc_id") -> Column:
    """A document's place in the order of ids: null comes before every id."""
    return F.coalesce(F.col(name).cast("long"), doc_key_of_null())


def doc_key_of_null() -> Column:
    return F.lit(-(2**63))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each behind as many underscores as it takes to be none of df's columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n in taken:
            n = f"_{n}"
        out.append(n)
    return out


def text_col(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def batches(frames, *names: str):
    """Python lists of the named columns, batch by batch."""
    for batch in frames:
        if batch.num_rows:
            yield tuple(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)


def raw_texts(array: pa.Array):
    """The UTF-8 bytes of each value, without making Python strings; null counts as empty."""
    binary = array.cast(pa.large_binary()) if pa.types.is_large_string(array.type) else array.cast(pa.binary())
    wide = np.int64 if pa.types.is_large_binary(binary.type) else np.int32
    if not len(binary):
        return
    _, offsets, data = binary.buffers()
    offsets = np.frombuffer(offsets, dtype=wide, count=len(binary) + 1, offset=binary.offset * wide().itemsize)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    valid = binary.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(binary)):
        yield data[offsets[i] : offsets[i + 1]] if valid[i] else data[:0]


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


