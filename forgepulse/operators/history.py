"""Tumbling counts, and the shaping of their series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of a series: window size to (number of buckets, seconds of one, buckets summed into one).
SERIES = {"5m": (30, 10, 1), "1h": (360, 10, 6), "6h": (72, 300, 1), "24h": (288, 300, 4)}


def fan_out(events: DataFrame) -> DataFrame:
    """Each event also with kind all; for streams."""
    return events.withColumn("kind", F.explode(F.array(F.col("kind"), F.lit("all"))))


def stars(events: DataFrame) -> DataFrame:
    return events.where(F.col("kind") == "watch")


def tumbling(events: DataFrame, key: str, seconds: int = 300, metric: str = "num_events") -> DataFrame:
    """key, ts_start, ts_end and the count of each epoch-aligned window with events.  With key kind, also kind all."""
    window = F.window("created_at", f"{seconds} seconds")
    rows = events
    if key == "kind" and not events.isStreaming:
        counted = rows.groupBy(window.alias("w"), "kind").agg(F.count("*").alias(metric))  # the all rows sum the kinds' counts
        counted = fan_out(counted).groupBy("w", "kind").agg(F.sum(metric).alias(metric))
    else:
        counted = (fan_out(rows) if key == "kind" else rows).groupBy(window.alias("w"), key).agg(F.count("*").alias(metric))
    return counted.select(key, F.col("w.start").alias("ts_start"), F.col("w.end").alias("ts_end"), metric)


def latest(history: DataFrame) -> DataFrame:
    """ts_start of the newest window of all kinds."""
    return history.where(F.col("kind") == "all").agg(F.max("ts_start").alias("ts_start"))


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def gap_filled(history: DataFrame, key: str, metric: str, last: Column, buckets: int, seconds: int, open_bucket: bool = True) -> DataFrame:
    """The last `buckets` windows up to the one that starts at `last`, for each key that has any: missing ones are 0, an open last one null.

    Rows are key, place (0 oldest), x (window start), y.
    """
    step = seconds * 1_000_000
    end = _micros(last)
    found = history.select(key, F.floor((_micros(F.col("ts_start")) - end) / step + buckets - 1).cast("int").alias("place"), F.col(metric).alias("y"), end.alias("_end"))
    found = found.where((F.col("place") >= 0) & (F.col("place") < buckets))
    grid = found.select(key, "_end").distinct().withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    out = grid.join(found.select(key, "place", "y"), [key, "place"], "left")
    missing = F.when(F.col("place") < buckets - 1, F.lit(0)) if open_bucket else F.lit(0)
    x = F.timestamp_micros(F.col("_end") + (F.col("place") - (buckets - 1)).cast("long") * step).cast("timestamp_ntz")
    return out.select(key, "place", x.alias("x"), F.coalesce("y", missing).cast("long").alias("y"))


def downsampled(series: DataFrame, key: str, buckets: int, factor: int) -> DataFrame:
    """Sums of `factor` windows, counted from the newest backward; x is the oldest of a group; a group with an open window is null."""
    group = F.floor((buckets - 1 - F.col("place")) / factor).cast("int")
    total = F.when(F.count_if(F.col("y").isNull()) == 0, F.sum("y"))
    return series.groupBy(key, group.alias("back")).agg(F.min("x").alias("x"), total.alias("y"))


def pivoted(history: DataFrame, kinds: list[str], metric: str = "num_events") -> DataFrame:
    """One row a window with a column for each kind, 0 where it has none, and the total y."""
    wide = history.where(F.col("kind").isin(kinds)).groupBy("ts_start").pivot("kind", kinds).agg(F.sum(metric)).na.fill(0)
    return wide.withColumn("y", sum((F.col(k) for k in kinds[1:]), F.col(kinds[0])))


def proportions(live: DataFrame, size: str = "1h") -> DataFrame:
    """Counts of one window size by kind, without all, and their shares; kinds are few, so the total is a small aggregate."""
    rows = live.where((F.col("window_size") == size) & (F.col("kind") != "all"))
    total = rows.agg(F.sum("num_events").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select("kind", "num_events", (F.col("num_events") / F.col("total")).alias("share"))
