"""Counts in sliding windows of several sizes at once: as a snapshot, and as the log of all changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import TREND_WEIGHTS, WINDOW_SIZES
from .history import fan_out


def at_second(as_of: str | Column) -> Column:
    return F.date_trunc("second", F.lit(as_of).cast("timestamp_ntz") if isinstance(as_of, str) else as_of)


def snapshot(events: DataFrame, key: str, as_of: str | Column, metric: str = "num_events", sizes: dict[str, int] = WINDOW_SIZES) -> DataFrame:
    """window_size, key, count of the events in [T - size, T), and their greatest seq_num.  One pass: conditional sums, then one row a size."""
    end = at_second(as_of)
    age = lambda s: F.col("created_at") >= end - F.make_interval(secs=F.lit(s))
    rows = events.where(age(max(sizes.values())) & (F.col("created_at") < end))
    rows = rows.groupBy(key).agg(*(F.count_if(age(s)).alias(f"n_{n}") for n, s in sizes.items()), *(F.max(F.when(age(s), F.col("seq_num"))).alias(f"s_{n}") for n, s in sizes.items()))
    if key == "kind":
        rows = rows.select(F.explode(F.array("kind", F.lit("all"))).alias("kind"), *(c for c in rows.columns if c != "kind"))
        rows = rows.groupBy("kind").agg(*(F.sum(f"n_{n}").alias(f"n_{n}") for n in sizes), *(F.max(f"s_{n}").alias(f"s_{n}") for n in sizes))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("window_size"), F.col(f"n_{n}").alias(metric), F.col(f"s_{n}").alias("seq_num")) for n in sizes)))
    return rows.select(key, each.alias("w")).select("w.window_size", key, f"w.{metric}", "w.seq_num").where(F.col(metric) > 0)


def changes(events: DataFrame, key: str, metric: str = "num_events", sizes: dict[str, int] = WINDOW_SIZES) -> DataFrame:
    """window_size, key, changed_at, count: each second at which a window's count changes, with the new count.

    Events become one-second buckets; a bucket that ends at e adds at e and takes away at e + size; the count is the running
    sum.  A key's window has at most two changes for each of its busy seconds, which bounds a group by time, not by events.
    """
    ended = F.date_trunc("second", "created_at") + F.make_interval(secs=F.lit(1))
    buckets = events.groupBy(key, ended.alias("e")).agg(F.count("*").alias("c"))
    if key == "kind":
        buckets = fan_out(buckets).groupBy("kind", "e").agg(F.sum("c").alias("c"))
    each = [F.struct(F.lit(n).alias("window_size"), t.alias("at"), c.alias("c")) for n, s in sizes.items() for t, c in ((F.col("e"), F.col("c")), (F.col("e") + F.make_interval(secs=F.lit(s)), -F.col("c")))]
    deltas = buckets.select(key, F.explode(F.array(*each)).alias("d")).groupBy(F.col("d.window_size").alias("window_size"), key, F.col("d.at").alias("changed_at")).agg(F.sum("d.c").alias("delta")).where("delta <> 0")
    running = Window.partitionBy("window_size", key).orderBy("changed_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return deltas.select("window_size", key, "changed_at", F.sum("delta").over(running).alias(metric))


def trending(stars_live: DataFrame, weights: dict[str, int] = TREND_WEIGHTS) -> DataFrame:
    """repo_id, trending_score, seq_num: the weighted sum over window sizes, absent ones 0; zero scores go."""
    weight = F.create_map(*(F.lit(x) for p in weights.items() for x in p))[F.col("window_size")]
    return stars_live.groupBy("repo_id").agg(F.sum(weight * F.col("num_stars")).alias("trending_score"), F.max("seq_num").alias("seq_num")).where("trending_score <> 0")


def trending_changes(star_changes: DataFrame, at: str = "changed_at", weights: dict[str, int] = TREND_WEIGHTS) -> DataFrame:
    """repo_id, changed_at, trending_score after each change of a star count; of changes at one time the last state counts."""
    wide = star_changes.groupBy("repo_id", at).pivot("window_size", list(weights)).agg(F.max("num_stars"))
    order = Window.partitionBy("repo_id").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    score = sum((w * F.coalesce(F.last(n, ignorenulls=True).over(order), F.lit(0)) for n, w in weights.items()), F.lit(0))
    return wide.select("repo_id", at, score.cast("long").alias("trending_score"))
