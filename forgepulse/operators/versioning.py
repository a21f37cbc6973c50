"""Deduplication, merges by version, and sequence numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedup(events: DataFrame, key: str = "id", version: str = "seq_num") -> DataFrame:
    """One row for each id: the one with the least version."""
    names = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.min_by(F.struct(*names), F.struct(version, *[c for c in names if c != version and c != "event"])).alias("_row")).select(key, *(F.col(f"_row.{c}").alias(c) for c in names)).select(*events.columns)


def merge_rows(rows: DataFrame, keys: list[str], version: str = "seq_num") -> DataFrame:
    """The row with the greatest version of each key."""
    names = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), version).alias("_row")).select(*keys, *(F.col(f"_row.{c}").alias(c) for c in names)).select(*rows.columns)


def with_versions(rows: DataFrame, fields: list[str], version: str = "seq_num") -> DataFrame:
    """Adds <field>_seq_num: the row's version, or 0 where the field is null."""
    return rows.withColumns({f"{f}_seq_num": F.when(F.col(f).isNotNull(), F.col(version)).otherwise(0).cast("long") for f in fields})


def merge_fields(rows: DataFrame, keys: list[str], fields: list[str], version: str = "seq_num") -> DataFrame:
    """Field by field the value with the greatest version of its own; a null never overwrites."""
    return rows.groupBy(*keys).agg(
        *(F.max_by(f, f"{f}_seq_num").alias(f) for f in fields), *(F.max(f"{f}_seq_num").alias(f"{f}_seq_num") for f in fields), F.max(version).alias(version)
    )


def drop_redundant(rows: DataFrame, keys: list[str], fields: list[str], version: str = "seq_num", ignore_version: bool = False) -> DataFrame:
    """Updates, in order of arrival (version order here), that bring something newer.

    By default the version counts as a value, so any update newer than all before it passes; ignore_version asks that
    some field is newer and differs from what was known.
    """
    order = Window.partitionBy(*keys).orderBy(version, *[F.col(f).asc_nulls_first() for f in fields]).rowsBetween(Window.unboundedPreceding, -1)
    if not ignore_version:
        return rows.withColumn("_known", F.max(version).over(order)).where(F.col("_known").isNull() | (F.col(version) > F.col("_known"))).drop("_known")
    differs = F.lit(False)
    for f in fields:
        known = F.last(f, ignorenulls=True).over(order)
        differs = differs | (F.col(f).isNotNull() & ~F.col(f).eqNullSafe(known))
    return rows.withColumn("_new", differs).where("_new").drop("_new")


def assign_sequence(rows: DataFrame, key: list[str], order: list[Column | str], base: int, last: DataFrame | None = None) -> DataFrame:
    """Numbers rows that have none: from the greater of base and the key's last number + 1, by order.  last: key, last_seq."""
    place = F.row_number().over(Window.partitionBy(*key, F.col("seq_num").isNull()).orderBy(*order)) - 1
    if last is not None:
        rows = rows.join(last, key, "left")
        start = F.greatest(F.lit(base).cast("long"), F.coalesce(F.col("last_seq") + 1, F.lit(0)))
    else:
        start = F.lit(base).cast("long")
    return rows.withColumn("seq_num", F.coalesce("seq_num", start + place)).drop("last_seq")
