"""Operator 10: mixing of sources to target weights, along a time-varying curriculum.

A source's weight over training time t in [0, 1] runs from a start to an end multiplier; its integral is the source's cumulative
demand for words.  The source's documents, in a pseudo-random order, meet that demand one after another, pass after
pass; a document's training position is the t at which its demand comes up, and the output is range-sorted by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Weights of the sources in order, and (start, end) multipliers of their schedules, both repeating.
WEIGHTS = (3, 1, 2)
SCHEDULES = ((1.4, 0.6), (0.6, 1.4), (1.0, 1.0))


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(C.WORD)), F.lit(0)).cast("long")


def _repeating(values: tuple, place: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (place % len(values) + 1).cast("int"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """source, place (by code point, null last), source_size and target, from (source, size).

    Words are shared by weight; a source at `most` times its size stops there.  Sorted by how soon they stop, the
    sources before some place are full and the others get weight times one level; windows over the table of sources.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("place", F.row_number().over(order) - 1).withColumn("weight", _repeating(weights, F.col("place")))
    soon = Window.orderBy((most * F.col("source_size") / F.col("weight")).asc(), F.col("place"))
    every = Window.partitionBy()
    before, rest = soon.rowsBetween(Window.unboundedPreceding, -1), soon.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(every) - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0))) / F.sum("weight").over(rest)
    per = per.withColumn("level", level).withColumn("stops", F.col("level") * F.col("weight") >= most * F.col("source_size"))
    # the first source that doesn't stop fixes the level of all that follow
    per = per.withColumn("level", F.first(F.when(~F.col("stops"), F.col("level")), ignorenulls=True).over(soon.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    full = (most * F.col("source_size")).cast("double")
    return per.select("source", "place", "source_size", F.when(F.col("level").isNull() | (F.col("level") * F.col("weight") >= full), full).otherwise(F.col("level") * F.col("weight")).alias("target"))


def position(x: Column, start: Column, end: Column) -> Column:
    """The t in [0, 1] at which a weight that runs linearly from start to end has given the share x of its integral."""
    a = (end - start) / (end + start)
    root = (-(1 - a) + F.sqrt(F.pow(1 - a, 2) + 4 * a * x)) / (2 * a)
    return F.when(F.abs(a) < 1e-9, x).otherwise(F.least(F.greatest(root, F.lit(0.0)), F.lit(1.0)))


def mixing_plan(df: DataFrame, weights: tuple = WEIGHTS, schedules: tuple = SCHEDULES, share: float = 1.5, most: int = 2, per_bucket: int = 2000) -> DataFrame:
    """One row per row of df (doc_id, text, source): doc_id, size, source_size, target, taken, position and row_key.

    A source's demand is the integral of its schedule; at the end of training it is the target, rounded down.  The source's words stand in
    line, pass after pass, and taken is what that demand reaches of the document.  position is where the demand comes to its
    first word (null if nothing is taken); rows are range-sorted by it.  Null text has size 0; the
    null source comes last; equal rows are documents of their own; a null id is ordered as the word null; an empty table
    gives an empty one; other columns are ignored.  The order within a source is by the id's MD5, so that reruns agree.
    """
    C.prepare(df.sparkSession)
    key = F.xxhash64("doc_id", "source", "text")
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words().alias("size"), key.alias("row_key"))
    rows = rows.withColumn("draw", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).checkpoint()
    # prefix sums in two steps: of buckets of draws, then within each bucket, so that a large source fills many tasks
    digits, n = 1, rows.count()
    while 16**digits * per_bucket < n:
        digits += 1
    rows = rows.withColumn("bucket", F.substring("draw", 1, digits))
    goal = targets(rows, weights, share, most)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    buckets = buckets.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    heads = buckets.join(goal.withColumnRenamed("source", "source_2"), F.col("source").eqNullSafe(F.col("source_2"))).drop("source_2")
    heads = heads.withColumnsRenamed({"source": "source_2", "bucket": "bucket_2"})
    inside = Window.partitionBy("source", "bucket").orderBy("draw", "size", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner_start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(heads, F.col("source").eqNullSafe(F.col("source_2")) & (F.col("bucket") == F.col("bucket_2")))
    words = F.floor("target")
    start = F.col("bucket_start") + F.col("inner_start")
    passes = F.when(F.col("source_size") > 0, F.floor(words / F.greatest("source_size", F.lit(1)))).otherwise(0)
    more = F.least(F.greatest(words - passes * F.col("source_size") - start, F.lit(0)), F.col("size"))
    x = F.when(words > 0, start / words)
    where = position(x, _repeating(tuple(float(a) for a, _ in schedules), F.col("place")), _repeating(tuple(float(b) for _, b in schedules), F.col("place")))
    taken = (passes * F.col("size") + more).cast("long")
    out = rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.when(taken > 0, where).alias("position"), "row_key", start.alias("start"), words.alias("words"), F.col("place"))
    return out.repartitionByRange(C.parallelism(df.sparkSession), "position", "row_key").sortWithinPartitions("position", "row_key")


def mix(df: DataFrame, weights: tuple = WEIGHTS, schedules: tuple = SCHEDULES, share: float = 1.5, most: int = 2) -> DataFrame:
    """The rows of df that the mix takes, with df's columns, once for each pass, range-sorted by training position.

    A document that is taken in part gives its first words, joined by one space.  Rows of one id, source and text stand in line one
    after another; their copies are those of one of them (whose other columns count), as many as the demand reaches of all.  Words taken equal
    the plan's.  Documents without words are never asked for, and go.  Columns of df named _mix_... are not kept apart.
    """
    start, end = (_repeating(tuple(float(s[i]) for s in schedules), F.col("place")) for i in (0, 1))
    plan = mixing_plan(df, weights, schedules, share, most).groupBy(F.col("doc_id").alias("_mix_id"), F.col("row_key").alias("_mix_plan")).agg(
        F.first("size").alias("_mix_size"), F.count("*").alias("_mix_rows"), F.sum("taken").alias("_mix_taken"), F.min("start").alias("_mix_start"), F.first("words").alias("_mix_words"), F.max("source_size").alias("_mix_source"), F.first(start).alias("_mix_a"), F.first(end).alias("_mix_b")
    ).where("_mix_taken > 0")
    names = df.columns
    # a group of equal rows is one row before it is moved
    one = df.withColumn("_mix_key", F.xxhash64("doc_id", "source", "text")).dropDuplicates(["doc_id", "_mix_key"])
    out = one.join(plan, (F.col("_mix_key") == F.col("_mix_plan")) & F.col("doc_id").eqNullSafe(F.col("_mix_id")))
    copies = F.ceil(F.col("_mix_taken") / F.col("_mix_size")).cast("long")
    out = out.withColumn("_mix_copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    left = F.least(F.col("_mix_taken") - F.col("_mix_copy") * F.col("_mix_size"), F.col("_mix_size"))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(C.WORD), F.lit(0)), 1, F.greatest(left, F.lit(1)).cast("int")), " ")
    lap, turn = F.floor(F.col("_mix_copy") / F.col("_mix_rows")), F.col("_mix_copy") % F.col("_mix_rows")
    place = position((F.col("_mix_start") + turn * F.col("_mix_size") + lap * F.col("_mix_source")) / F.col("_mix_words"), F.col("_mix_a"), F.col("_mix_b"))
    out = out.withColumn("_mix_position", place).withColumn("text", F.when(left < F.col("_mix_size"), cut).otherwise(F.col("text")))
    parts = C.parallelism(df.sparkSession)
    return out.repartitionByRange(parts, "_mix_position").sortWithinPartitions("_mix_position", "_mix_key").select(*names)
