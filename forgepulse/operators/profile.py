"""How far out of order events arrive; it picks the watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def out_of_orderness(events: DataFrame, arrival: str = "seq_num", source: str | None = None) -> DataFrame:
    """Delays behind the newest event so far, by order of arrival within a source (a file or topic partition at scale).

    Without a source, arrival is cut into blocks: the newest of the earlier blocks joins the running maximum within each block.
    """
    at = F.unix_micros(F.col("created_at").cast("timestamp")) / 1_000_000
    if source is not None:
        newest = F.max(at).over(Window.partitionBy(source).orderBy(arrival).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        rows = events.select((newest - at).alias("delay"))
    else:
        block = F.floor(F.col(arrival) / 10_000)
        rows = events.select(F.col(arrival).alias("a"), at.alias("t"), block.alias("block"))
        before = rows.groupBy("block").agg(F.max("t").alias("m"))
        before = before.select("block", F.max("m").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
        inside = F.max("t").over(Window.partitionBy("block").orderBy("a").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        rows = rows.withColumn("inside", inside).join(before, "block").select((F.greatest("inside", F.coalesce("earlier", "inside")) - F.col("t")).alias("delay"))
    share = lambda s: (F.count_if(F.col("delay") < s) / F.count("*")).alias(f"under_{s}s")
    told = rows.agg(F.max("delay").alias("longest"), share(1), share(5), share(10), F.count("*").alias("n"))
    quantiles = exact_quantiles(rows, "delay", {"p90": 0.9, "p99": 0.99, "p9975": 0.9975, "p999": 0.999})
    return quantiles.crossJoin(F.broadcast(told))


def exact_quantiles(rows: DataFrame, name: str, shares: dict[str, float], blocks: int | None = None) -> DataFrame:
    """One row: the exact quantiles of a column, between neighbours by straight line as F.percentile; nulls do not count, and no values give null.

    Values are counted and cut into blocks by approximate quantiles, which change the cost and no result; block totals tell where
    a block's places begin, so no task holds all distinct values.
    """
    counts = rows.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("v")).agg(F.count("*").alias("c"))
    blocks = blocks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(counts.approxQuantile("v", [i / blocks for i in range(1, blocks)], 0.01))) if blocks > 1 else []
    block = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut <= F.col("v"))) if cuts else F.lit(0)
    counts = counts.withColumn("block", block)
    totals = counts.groupBy("block").agg(F.sum("c").alias("t"))
    ahead = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("block", F.coalesce(F.sum("t").over(ahead), F.lit(0)).alias("ahead"), F.sum("t").over(Window.partitionBy()).alias("all"))
    inside = Window.partitionBy("block").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumn("end", F.sum("c").over(inside)).join(F.broadcast(totals), "block").withColumn("end", F.col("end") + F.col("ahead"))

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("end") - F.col("c") <= place) & (place < F.col("end")), F.col("v")))

    def quantile(q: float) -> Column:
        place = F.lit(q) * (F.col("all") - 1)
        low, high = F.floor(place), F.ceil(place)
        part = F.max(place - low)
        return F.when(part == 0, at(low)).otherwise((1 - part) * at(low) + part * at(high))

    return placed.agg(*(quantile(q).alias(k) for k, q in shares.items()))


def overlap(items: DataFrame) -> DataFrame:
    """Events polled, distinct ids, and how much polls overlap."""
    return items.agg(F.count("*").alias("polled"), F.countDistinct("id").alias("ids")).withColumn("overlap", F.col("polled") / F.col("ids") - 1)
