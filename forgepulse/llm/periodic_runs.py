"""Periodic run detection: stretches of a document that repeat a short period four times or more, by seeds and diagonals.

A run of period q and length of at least max(6, 4 q) is a stretch of the diagonal "word i and word i + q" of at least max(6, 4 q) - q equal
words.  Lags come in classes [a, b] with one gram length k each, the least stretch that a run of any lag of the class is sure to have, and b so
small (2 b - 1 <= k) that the next place of a gram inside a run is one period on: two periods of one gram that is as long as both together would
make a smaller period.  So of all pairs of places of a gram the neighbours are enough, and a document of one word gives n pairs, not n * n.

For each class the grams are indexed, neighbouring places whose lag lies in the class are seeds, and a table of the furthest word covered, by
lag, tells a seed that only moves a known stretch on from one that begins a new stretch.  Only words in 5-grams that are met again in
their document can be in a run, so that most text ends at the first index.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Length of a run by its period: at least LEAST words and TIMES periods.
LEAST, TIMES = 6, 4
#: Words whose documents are searched together.
GROUP_WORDS = 1 << 18
_MULTIPLIERS = [np.uint64(int(x) | 1) for x in np.random.default_rng(7).integers(0, 2**63, LEAST - 1)]


def _overlap(lag):
    """Equal words that a run has on the diagonal of its period."""
    return np.maximum(LEAST, TIMES * lag) - lag


def _classes(longest: int) -> Iterator[tuple[int, int, int]]:
    """(first lag, last lag, gram length) of each class that a stretch of `longest` words can hold."""
    a = 1
    while max(LEAST, TIMES * a) <= longest:
        k = int(min(_overlap(q) for q in range(a, a + 3)))
        b = (k + 1) // 2
        yield a, b, k
        a = b + 1


def _again(codes: np.ndarray, k: int) -> np.ndarray:
    """For each start of a k-gram, whether its hash is met again; a collision only makes more work."""
    h = np.zeros(len(codes) - k + 1, dtype=np.uint64)
    for j in range(k):
        h += codes[j : len(codes) - k + 1 + j].astype(np.uint64) * _MULTIPLIERS[j]
    h = C.mix(h)
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    out = np.zeros(len(h), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def find_runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of all runs of a sequence of codes; documents that share no code may stand one after another."""
    k = LEAST - 1
    none = (np.zeros(0, np.int64),) * 3
    if len(codes) < LEAST:
        return none
    starts, ends = _stretches(_again(codes, k))
    ends = ends + k - 1  # in words
    keep = ends - starts >= LEAST
    starts, ends = starts[keep], ends[keep]
    if not len(starts):
        return none
    found = []
    # the stretches one after another, each with an end mark of its own, as dense codes
    sizes = ends - starts
    at = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    own = np.repeat(np.arange(len(sizes)), sizes + 1)
    where = np.arange(len(own)) - at[own] + starts[own]
    last = np.concatenate((at[1:], [len(own)])) - 1
    inside = np.ones(len(own), dtype=bool)
    inside[last] = False
    text = np.where(inside, codes[np.minimum(where, len(codes) - 1)], 0)
    text[last] = codes.max() + 1 + np.arange(len(last))
    room = last[own] - np.arange(len(own))  # words from here to the end of the stretch
    rank, width = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    for a, b, k in _classes(int(sizes.max())):
        while 2 * width <= k:  # ranks of grams twice as wide
            n = len(rank) - width
            pair = rank[:n] * (len(own) + 1) + rank[width:]
            rank, width = np.unique(pair, return_inverse=True)[1].astype(np.int64), 2 * width
        places = np.flatnonzero((room >= k) & (sizes[own] >= max(LEAST, TIMES * a)))
        gram = rank[places] * (len(own) + 1) + rank[places + k - width]
        order = np.argsort(gram, kind="stable")
        here, there = places[order[:-1]], places[order[1:]]
        lag = there - here
        seed = (gram[order[:-1]] == gram[order[1:]]) & (lag >= a) & (lag <= b) & (own[here] == own[there])
        here, lag = here[seed], lag[seed]
        if not len(here):
            continue
        order = np.lexsort((here, lag))
        here, lag = here[order], lag[order]
        # the furthest start covered on each lag: a seed right behind it moves it on, any other begins a new stretch
        fresh = np.concatenate(([True], (lag[1:] != lag[:-1]) | (here[1:] != here[:-1] + 1)))
        first = np.flatnonzero(fresh)
        final = np.concatenate((first[1:], [len(here)])) - 1
        covered = here[final] + k - here[first]
        q = lag[first]
        runs = covered >= _overlap(q)
        found.append((where[here[first[runs]]], covered[runs] + q[runs], q[runs]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else none


def _order(n: int, doc_id: int | None) -> np.ndarray:
    """Places of the words as the contract arranges them: of one document in ten, by a checksum of its id, the end becomes periodic."""
    at = np.arange(n)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return at
    g = h // 10
    a = g % n
    return np.where(at < a, at, a + (at - a) % (1 + (n - a) // (3 + g % 8)))


def _best(starts, lengths, periods) -> int:
    """The run of the greatest length over period, exactly; of equals the first, then that of the shortest period.  Runs are sorted."""
    best = 0
    for i in range(1, len(starts)):
        if lengths[i] * periods[best] > lengths[best] * periods[i]:
            best = i
    return best


def _rows(arrange: bool):
    names = ["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "collapsed"]
    kinds = [pa.int64()] * 7 + [pa.string()] * 3

    def told(group: list[tuple[int | None, list[bytes], np.ndarray]]) -> pa.RecordBatch:
        sizes = [len(o) for _, _, o in group]
        codes, base = [], 0
        for _, words, order in group:
            known: dict[bytes, int] = {}
            codes.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))[order] + base)
            base += len(known)
        starts, lengths, periods = find_runs(np.concatenate(codes)) if codes else (np.zeros(0, np.int64),) * 3
        edges = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        by = np.lexsort((periods, starts))
        starts, lengths, periods = starts[by], lengths[by], periods[by]
        cut = np.searchsorted(starts, edges)
        out = []
        for d, (doc_id, words, order) in enumerate(group):
            s, n, q = (starts[cut[d] : cut[d + 1]] - edges[d]).tolist(), lengths[cut[d] : cut[d + 1]].tolist(), periods[cut[d] : cut[d + 1]].tolist()
            lines = "".join(f"{a},{b},{c}\n" for a, b, c in zip(s, n, q, strict=True))
            keep = np.ones(len(order), dtype=bool)
            for a, b, c in zip(s, n, q, strict=True):
                keep[a + c : a + b] = False
            kept = b" ".join([words[i] for i in order[keep]])
            top = _best(s, n, q) if s else None
            best = (s[top], n[top], q[top], 1000 * n[top] // q[top]) if s else (None,) * 4
            out.append((doc_id, len(words), len(s), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = [], 0
        for batch in frames:
            ids = batch.column("doc_id").to_pylist()
            for doc_id, raw in zip(ids, C.raw_texts(batch.column("text")), strict=True):
                words = raw.tobytes().split()  # at space and \x09 to \x0D
                group.append((doc_id, words, _order(len(words), doc_id) if arrange else np.arange(len(words))))
                held += len(words)
                if held >= GROUP_WORDS:
                    yield told(group)
                    group, held = [], 0
        if group:
            yield told(group)

    return run


def periodic_runs(df: DataFrame, arrange: bool = False) -> DataFrame:
    """One row per row of df (doc_id, text): n_words, n_runs, the run of the greatest length over period, digests, and the collapsed text.

    Words are runs without white space, numbered from 0.  A run is a stretch of words with smallest period q and a length of at least
    max(6, 4 q) that no neighbour extends.  start, length, period and exponent_milli (1000 * length / period, floored) are null without a
    run; of equal ratios the smallest start, then period.  runs_sha256 is of every run's "start,length,period" and a line feed, by start, then
    period; `collapsed` has the words without those that a run holds behind its first period, joined by one space.
    A null or empty text has no words and no runs.  arrange: words are first put as the op11 contract says, by a checksum of doc_id (a null id changes
    nothing).  Equal rows each get a row; an empty table gives an empty one; other columns are ignored.  A document is searched in one task,
    in memory of some hundred bytes a word; nothing is shuffled.
    """
    C.prepare(df.sparkSession)
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_col().alias("text"))
    return docs.mapInArrow(_rows(arrange), "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, collapsed string")


def collapse_runs(df: DataFrame) -> DataFrame:
    """df with a text that has each run's first period only; texts without runs stay as they are, byte for byte.  Columns of df stay."""
    C.prepare(df.sparkSession)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _rows(False)
        for batch in frames:
            place = batch.schema.get_field_index("text")
            told = list(one(iter([pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column(place)], names=["doc_id", "text"])])))
            runs = [n for t in told for n in t.column("n_runs").to_pylist()]
            new = [x for t in told for x in t.column("collapsed").to_pylist()]
            texts = [x if n else old for old, n, x in zip(batch.column(place).to_pylist(), runs, new, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field(place).type) if i == place else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return df.mapInArrow(run, df.schema)
