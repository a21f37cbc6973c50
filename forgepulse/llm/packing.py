"""Operator 7: sum-of-squares online packing of token sequences.

A document's full windows go out at once; what is left of it is placed into the fill level that makes the sum of the
squared counts of partially filled windows least, by an array of counts per level.  Every task packs its own documents; at its
end the open windows fill one another up, and the last one is cut into sequences of a power of two, which need no padding.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import common as C

#: Pre-tokens whose ids a worker keeps.
CACHE = 400_000
#: The vocabulary's splitting pattern, for texts of characters on which Python's classes agree with it; others take the slow way.
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
PLAIN = re.compile("[\x00-\x1b\x20-\x7fÀ-ɏ–-―‘-‟…]*")


class Tokens:
    """Ids of texts as little-endian unsigned 32-bit numbers.  Pre-tokens met before come from a cache of bounded size."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.cache: dict[str, bytes] = {}
        self.piece = self._pieces(path)

    def _pieces(self, path: str):
        """The same vocabulary's ranks, if they lie beside it, give the ids of single pre-tokens faster."""
        import base64
        from pathlib import Path

        ranks = Path(path).with_suffix(".tiktoken")
        if not ranks.exists():
            return lambda piece: self.whole.encode(piece, add_special_tokens=False).ids
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.open("rb"))}
        core = tiktoken.Encoding("own", pat_str=r"\s+|\S+", mergeable_ranks=table, special_tokens={})._core_bpe
        return lambda piece: core.encode_single_piece(piece.encode())

    def ids(self, text: str) -> bytes:
        if not (text.isascii() or PLAIN.fullmatch(text)) or PLAIN.fullmatch(text) is None or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        cache = self.cache
        out = []
        for piece in SPLIT.findall(text):
            ids = cache.get(piece)
            if ids is None:
                if len(cache) >= CACHE:
                    cache.clear()
                ids = cache[piece] = np.array(self.piece(piece), dtype="<u4").tobytes()
            out.append(ids)
        return b"".join(out)


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokens(path)


class Packer:
    """Windows of `size` ids.  A piece is [document's number, start, ids]; closed windows come out as (window number, pieces)."""

    def __init__(self, size: int):
        self.size = size
        self.counts = np.zeros(size + 1, dtype=np.int64)  # open windows at each level; 0 and size stay 0
        self.open: dict[int, list[tuple[int, list]]] = {}
        self.next = 0

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, piece: list) -> Iterator[tuple[int, list]]:
        n = len(piece[2]) // 4
        if n == self.size:
            yield self._new(), [piece]
            return
        levels = np.flatnonzero(self.counts[1 : self.size - n + 1]) + 1
        best, level = 2 * self.counts[n] + 1, 0  # a new window
        if len(levels):
            cost = 2 * (self.counts[levels + n] - self.counts[levels]) + 2 - (levels + n == self.size)
            k = int(cost.argmin())
            if cost[k] <= best:
                level = int(levels[k])
        if level:
            number, pieces = self.open[level].pop()
            self.counts[level] -= 1
        else:
            number, pieces = self._new(), []
        pieces.append(piece)
        if level + n == self.size:
            yield number, pieces
        else:
            self.open.setdefault(level + n, []).append((number, pieces))
            self.counts[level + n] += 1

    def finish(self) -> Iterator[tuple[int, list]]:
        left = [(level, number, pieces) for level in sorted(self.open, reverse=True) for number, pieces in self.open[level]]
        self.open, self.counts[:] = {}, 0
        i, j = 0, len(left) - 1
        while i < j:
            level, number, pieces = left[i]
            while level < self.size and i < j:
                gap = self.size - level
                small, other, source = left[j]
                piece = source.pop()
                n = len(piece[2]) // 4
                if n > gap:  # the tail moves, the head stays
                    source.append([piece[0], piece[1], piece[2][: 4 * (n - gap)]])
                    piece = [piece[0], piece[1] + n - gap, piece[2][4 * (n - gap) :]]
                    n = gap
                pieces.append(piece)
                level += n
                left[j] = (small - n, other, source)
                if not source:
                    j -= 1
            left[i] = (level, number, pieces)
            if level == self.size:
                yield number, pieces
                i += 1
        if i == j:
            level, _, pieces = left[i]
            if level == self.size:
                yield left[i][1], pieces
                return
            for bit in reversed(range(self.size.bit_length())):
                want, part = level & (1 << bit), []
                while want:
                    piece = pieces.pop()
                    n = len(piece[2]) // 4
                    if n > want:
                        pieces.append([piece[0], piece[1], piece[2][: 4 * (n - want)]])
                        piece = [piece[0], piece[1] + n - want, piece[2][4 * (n - want) :]]
                        n = want
                    part.append(piece)
                    want -= n
                if part:
                    yield self._new(), part


FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


def _pack(path: str, size: int, end: int, with_ids: bool):
    schema = pa.schema([*FIELDS, *([("ids", pa.list_(pa.int64()))] if with_ids else [])])
    stop = int(end).to_bytes(4, "little")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TaskContext.get().partitionId() << 36  # the same at each try, as the input's parts are
        ids_of = tokens(path).ids
        packer = Packer(size)
        rows: list[tuple] = []

        def note(closed):
            for number, pieces in closed:
                at = 0
                for (doc_id, total), start, ids in pieces:
                    n = len(ids) // 4
                    rows.append((doc_id, start, n, zlib.crc32(ids), total, own + number, at, *([np.frombuffer(ids, dtype="<u4").tolist()] if with_ids else [])))
                    at += n

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        for batch in frames:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = ids_of(text) + stop
                total = len(ids) // 4
                for start in range(0, total, size):
                    note(packer.add([(doc_id, total), start, ids[4 * start : 4 * (start + size)]]))
                if len(rows) >= (2048 if not with_ids else 256):
                    yield out()
                    rows.clear()
        note(packer.finish())
        if rows:
            yield out()

    return run


def pack(df: DataFrame, tokenizer: str, size: int = 1024, end: int = 0, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and the piece's ids.

    A document is its text's ids and the id `end`; a sequence holds at most `size` ids.  Null text is empty (one id);
    rows with one id are documents of their own; a null id stays null; an empty table gives an empty one; other columns
    are ignored.  No shuffle: each task packs what it reads, and at most one of its windows is cut into powers of two.
    """
    C.prepare(df.sparkSession)
    docs = df.selectExpr("cast(doc_id AS long) AS doc_id", "coalesce(cast(text AS string), '') AS text")
    kind = ", ".join(f"{n} long" for n, _ in FIELDS) + (", ids array<long>" if with_ids else "")
    return docs.mapInArrow(_pack(tokenizer, size, end, with_ids), kind)
