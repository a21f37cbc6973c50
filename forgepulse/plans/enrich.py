"""Joins of rankings, entities and histories, and name search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.history import SERIES, downsampled, gap_filled


def named(rows: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Rows with the dimension's fields of key = id; Spark chooses the join by size."""
    other = dimension.select(F.col("id").alias(key), *(c for c in dimension.columns if c not in ("id", "seq_num") and not c.endswith("_seq_num")))
    return rows.join(other, key, "left")


def with_owner(repos: DataFrame, users: DataFrame) -> DataFrame:
    """repos with owner_name: the owner by id, else by the name before the slash."""
    by_id = users.select(F.col("id").alias("owner_id"), F.col("username").alias("_by_id"))
    by_name = users.where("username IS NOT NULL").groupBy(F.col("username").alias("_name")).agg(F.min("id").alias("_named_id"))
    out = repos.join(by_id, "owner_id", "left").withColumn("_name", F.when(F.col("_by_id").isNull(), F.substring_index("fullname", "/", 1)))
    out = out.join(by_name, "_name", "left")
    return out.select(*repos.columns, F.coalesce("_by_id", F.when(F.col("_named_id").isNotNull(), F.col("_name"))).alias("owner_name"))


def with_history(page: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """The histories of the entities on a page."""
    return history.join(page.select(key).distinct(), key, "left_semi")


def with_series(page: DataFrame, history: DataFrame, key: str, metric: str, last: Column, size: str = "24h") -> DataFrame:
    """The page's rows with series: the gap-filled counts of the window size, oldest first, null for an entity without any."""
    buckets, seconds, factor = SERIES[size]
    points = downsampled(gap_filled(with_history(page, history, key), key, metric, last, buckets, seconds), key, buckets, factor)
    lists = points.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("place"), "y"))), lambda p: p["y"]).alias("series"))
    return page.join(lists, key, "left")


def entity_page(entity: DataFrame, rankings: dict[str, DataFrame], key: str) -> DataFrame:
    """One row an entity: its fields, and its places in each window of each ranking, as an array of structs."""
    places = None
    for name, ranking in rankings.items():
        size = F.col("window_size") if "window_size" in ranking.columns else F.lit("")
        rows = ranking.select(key, F.lit(name).alias("ranking"), size.alias("window_size"), "row_number", "rank")
        places = rows if places is None else places.unionByName(rows)
    grouped = places.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ranking", "window_size", "row_number", "rank"))).alias("places"))
    return entity.join(grouped, entity["id"] == grouped[key], "left").drop(key)


def name_score(name: str, query: str):
    """1 / (1 + difference of lengths) for names that contain the query (lower case both), else 0."""
    return F.when(F.lower(name).contains(query.lower()), 1 / (1 + F.abs(F.length(name) - len(query)))).otherwise(F.lit(0.0))


def best_names(rows: DataFrame, name: str, query: str, n: int = 10) -> DataFrame:
    return rows.withColumn("score", name_score(name, query)).where("score > 0").orderBy(F.desc("score"), F.col(name), *(["id"] if "id" in rows.columns else [])).limit(n)


def global_search(users: DataFrame, repos: DataFrame, query: str, n: int = 10) -> DataFrame:
    """The n shortest names that contain the query, of users and repositories (by name or full name)."""
    q = query.lower()
    hits = users.where(F.lower("username").contains(q)).select(F.lit("user").alias("type"), "id", F.col("username").alias("name"))
    hits = hits.unionByName(repos.where(F.lower("reponame").contains(q) | F.lower("fullname").contains(q)).select(F.lit("repo").alias("type"), "id", F.coalesce("fullname", "reponame").alias("name")))
    return hits.orderBy(F.length("name"), "name", "type", "id").limit(n)
