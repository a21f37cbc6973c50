"""Filter interaction audit: what each of five filters removes at each place of each of their 120 orders, without running the orders.

A document is reduced to a mask of the filters that it fails.  A mask decides all 600 outcomes (order and step), which one wide integer holds as 600
fields of 64 bits, each 0 or 1.  Masks are counted by part first; a part's counters are then the sum of its masks' integers, each times its number
of documents.  No field can carry into the next one, as none exceeds the number of documents.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
FIELD = 64
STEPS = len(FILTERS)
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
_UPPER = bytes(set(range(256)) - set(range(0x41, 0x5B)))
_SYMBOLS = bytes(set(range(256)) - set(b"#$%&*|"))
_CONTINUED = bytes(range(0x80, 0xC0))


def own_mask(text: bytes) -> int:
    """Bits 0 to 3: fails A (under 200 words), B (under half of the words are distinct), C (over 3 % capitals), D (holds a symbol)."""
    words = text.split()  # at space and \x09 to \x0D
    n = len(words)
    fails = (n < 200, 100 * len(set(words)) < 50 * n, 100 * len(text.translate(None, _UPPER)) > 3 * len(text.translate(None, _CONTINUED)), bool(text.translate(None, _SYMBOLS)))
    return sum(1 << i for i, f in enumerate(fails) if f)


def _facts(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in frames:
        masks, prints = [], []
        for raw in C.raw_texts(batch.column("text")):
            text = raw.tobytes()
            masks.append(own_mask(text))
            prints.append(hashlib.sha256(text).digest())
        yield pa.RecordBatch.from_arrays([batch.column("dk"), batch.column("part"), pa.array(masks, pa.int32()), pa.array(prints, pa.binary())], names=["dk", "part", "mask", "print"])


@cache
def packed() -> dict[str, list[int]]:
    """For each mask its integers: kept, removed, redundant, and unique_fails (its filter alone fails)."""
    out: dict[str, list[int]] = {n: [] for n in ("kept", "removed", "redundant", "unique_fails")}
    for mask in range(1 << STEPS):
        total = dict.fromkeys(out, 0)
        for o, order in enumerate(ORDERS):
            gone = False
            for step, letter in enumerate(order):
                one = 1 << FIELD * (STEPS * o + step)
                fails = mask >> FILTERS.index(letter) & 1
                if fails:
                    total["redundant" if gone else "removed"] += one
                    gone = True
                if not gone:
                    total["kept"] += one
                if fails and mask == 1 << FILTERS.index(letter):
                    total["unique_fails"] += one
        for n in out:
            out[n].append(total[n])
    return out


def _fields(total: int) -> np.ndarray:
    return np.frombuffer(total.to_bytes(len(ORDERS) * STEPS * FIELD // 8, "little"), dtype="<u8").astype(np.int64)


def _audit(rows: pd.DataFrame) -> pd.DataFrame:
    """All rows of one part, from its counts by mask: 128 at most."""
    of = packed()
    total = dict.fromkeys(COUNTS, 0)
    for mask, good, toxic, n in zip(rows["mask"], rows["quality"], rows["toxic"], rows["n"], strict=True):
        for name, masks in of.items():
            total[name] += masks[mask] * int(n)
        total["good_lost"] += of["removed"][mask] * int(n) * int(good)
        total["toxic_lost"] += of["removed"][mask] * int(n) * int(toxic)
    out = pd.DataFrame({"part": rows["part"].iloc[0], "filter_order": np.repeat(ORDERS, STEPS), "step": np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS)), **{n: _fields(total[n]) for n in COUNTS}})
    letter = out["filter_order"].to_numpy().astype("U5").view("U1").reshape(len(out), STEPS)[np.arange(len(out)), out["step"] - 1]
    out["shapley"] = out.groupby(letter)["removed"].transform("sum")
    return out


def masks(df: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic, n: documents by what they fail and how they are labelled.

    Equal texts are told by SHA-256.  Documents are counted by id and text, then by text, part and label: however many copies a text has, what
    is left of it is a row for each of its parts and labels, with the least id and how many have that.
    """
    C.prepare(df.sparkSession)
    docs = df.select(C.doc_key().alias("dk"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), C.text_col().alias("text"))
    facts = docs.mapInArrow(_facts, "dk long, part string, mask int, print binary").groupBy("dk", "part", "mask", "print").agg(F.count("*").alias("n"))
    # no label has a null id; texts without an id are spread by what they say
    facts = facts.withColumn("_salt", F.when(F.col("dk") == C.doc_key_of_null(), F.crc32("print")).otherwise(F.lit(0)))
    yes = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(c)
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("dk")).agg(yes("quality"), yes("toxic")).withColumn("_salt", F.lit(0).cast("long"))
    named = facts.join(marks, ["dk", "_salt"], "left").na.fill(0, ["quality", "toxic"])
    texts = named.groupBy("print", "part", "mask", "quality", "toxic").agg(F.sum("n").alias("n"), F.min(F.struct("dk", "n")).alias("first"))
    least = F.min("first.dk").over(Window.partitionBy("print"))
    texts = texts.withColumn("firsts", F.when(F.col("first.dk") == least, F.col("first.n")).otherwise(F.lit(0)))
    sides = F.array(F.struct(F.col("mask"), F.col("firsts").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("firsts")).alias("n")))
    rows = texts.select("part", "quality", "toxic", F.explode(sides).alias("s")).select("part", "quality", "toxic", "s.*").where("n > 0")
    return rows.groupBy("part", "mask", "quality", "toxic").agg(F.sum("n").alias("n"))


def filter_audit(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows for each part (lang; null: empty), each of the 120 orders of the filters A to E and each step: what is kept after it, removed by it, and so on.

    A: under 200 words; B: under half of the words distinct; C: over 3 % capitals A-Z of all code points; D: any of #$%&*|; E: equal to the text of
    a smaller doc_id, in any part, removed or not.  A null text is an empty one.  A null doc_id counts as smaller than all and has no label; rows
    that repeat an id and its text don't fail E for each other.  A label counts if any row of labels with that id has a 1.  kept, removed,
    redundant (fails, but removed earlier), unique_fails (fails this filter only), good_lost and toxic_lost (removed, label 1) and shapley (removed by
    this filter, over all orders) are longs.  An empty table gives no part, so no rows; other columns are ignored.
    """
    schema = "part string, filter_order string, step int, " + ", ".join(f"{n} long" for n in (*COUNTS, "shapley"))
    return masks(df, labels).groupBy("part").applyInPandas(_audit, schema)
