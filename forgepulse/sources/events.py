"""Where events come from: a topic or files of raw JSON, hourly archives, page files, and the driver's events table."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import events as E
from ..functions import json as J

#: How the types of the driver's events table stand for kinds.
DRIVER_KINDS = {"click": "push", "purchase": "watch", "signup": "create_repo", "view": "fork", "error": "issue_open"}


def from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed events from the driver's table: id, created_at, kind, user_id, repo_id, seq_num."""
    return of_table(spark.read.parquet(f"{sf_dir}/events.parquet"))


def table_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream; created_at as a point in time, as watermarks want it."""
    path = f"{sf_dir}/events.parquet"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")  # a pattern, as a stream's folder may be one file here
    return of_table(rows).withColumn("created_at", F.col("created_at").cast("timestamp"))


def of_table(rows: DataFrame) -> DataFrame:
    kinds = F.create_map(*(F.lit(x) for p in DRIVER_KINDS.items() for x in p))
    return rows.select(
        F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.coalesce(F.try_element_at(kinds, F.col("event_type")), F.lit("other")).alias("kind"), "user_id",
        F.get_json_object("props", "$.k").cast("long").alias("repo_id"), F.col("event_id").alias("seq_num"),
    )


def raw_stream(spark: SparkSession, path: str | None = None, servers: str | None = None, topic: str | None = None, rewind: bool = False, files_per_batch: int | None = None) -> DataFrame:
    """A stream of raw events, column raw: of a topic, or of text files that arrive in a folder."""
    if topic is not None:
        stream = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
        if rewind:
            stream = stream.option("startingOffsets", "earliest")
        return stream.load().select(F.col("value").cast("string").alias("raw"))
    stream = spark.readStream.format("text")
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    return stream.load(path).select(F.col("value").alias("raw"))


def archive_paths(base: str, start: datetime, end: datetime) -> list[str]:
    """One file an hour, both ends included; the hour has no leading zero."""
    hour, out = start.replace(minute=0, second=0, microsecond=0), []
    while hour <= end:
        out.append(f"{base.rstrip('/')}/{hour:%Y-%m-%d}-{hour.hour}.json.gz")
        hour += timedelta(hours=1)
    return out


def archive_hours(spark: SparkSession, base: str, start: datetime, end: datetime) -> tuple[list[str], list[str]]:
    """The archive paths that are there and those that are missing, by one listing of the folder."""
    paths = archive_paths(base, start, end)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = {x.getPath().getName() for x in fs.listStatus(folder)} if fs.exists(folder) else set()
    found = [p for p in paths if p.rsplit("/", 1)[1] in there]
    return found, [p for p in paths if p.rsplit("/", 1)[1] not in there]


def archive(spark: SparkSession, base: str, start: datetime, end: datetime, missing_ok: bool = False) -> DataFrame:
    """Raw events of hourly archives; an hour may be a file or a folder of parts.  A gzip file is one task, so rows are dealt out again after the scan."""
    paths = archive_hours(spark, base, start, end)[0] if missing_ok else archive_paths(base, start, end)
    if not paths:
        return spark.createDataFrame([], "raw string")
    return spark.read.text(paths).select(F.col("value").alias("raw")).repartition(spark.sparkContext.defaultParallelism * 4)


def write_archive(raw: DataFrame, base: str) -> None:
    """Raw events as hourly archives, each a folder of gzip parts under the hour's archive name; rows without created_at have no hour and aren't written."""
    spark = raw.sparkSession
    at = F.col("at")
    rows = decode(raw).select("raw", F.explode(F.array(F.to_timestamp(F.try_variant_get("event", "$.created_at", "string")))).alias("at"))
    rows = rows.select(F.col("raw").alias("value"), F.concat(F.date_format(at, "yyyy-MM-dd-"), F.hour(at), F.lit(".json.gz")).alias("hour")).where("hour IS NOT NULL")
    rows.hint("rebalance", "hour").write.partitionBy("hour").option("compression", "gzip").text(f"{base}/parts")
    parts = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/parts")
    fs = parts.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for x in fs.listStatus(parts):  # one rename an hour
        name = x.getPath().getName()
        if name.startswith("hour="):
            fs.rename(x.getPath(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/{name[5:]}"))


def pages(spark: SparkSession, path: str, base_seq: int = 0) -> DataFrame:
    """Raw events of page files, newest first in each file `<poll>-<page>.json` (an array a line): oldest first, each id once, numbered.

    Later polls overlap earlier ones; the first poll that has an id counts.
    """
    rows = spark.read.text(path, wholetext=True).select("value", F.regexp_extract(F.input_file_name(), r"(\d+)-(\d+)\.json$", 1).cast("long").alias("poll"), F.regexp_extract(F.input_file_name(), r"(\d+)-(\d+)\.json$", 2).cast("long").alias("page"))
    return flattened(rows, base_seq)


def flattened(rows: DataFrame, base_seq: int = 0) -> DataFrame:
    """The events of pages: value (a JSON array), poll, page."""
    items = rows.select("poll", "page", F.posexplode(F.from_json("value", "array<variant>")).alias("pos", "event")).withColumn("id", J.number(F.col("event"), "$.id"))
    return number_polls(items, base_seq)


def number_polls(items: DataFrame, base_seq: int = 0) -> DataFrame:
    """poll, page, pos, id: each id once, from its first poll, with seq_num counted oldest first within a poll."""
    first = Window.partitionBy("id").orderBy("poll", F.desc("page"), F.desc("pos"))
    once = items.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    order = Window.partitionBy("poll").orderBy(F.desc("page"), F.desc("pos"))
    return once.withColumn("seq_num", F.col("poll") * 1000 + F.lit(base_seq) + F.row_number().over(order) - 1)


def decode(raw: DataFrame) -> DataFrame:
    """raw with event, a VARIANT, null where the text is no JSON.

    The generator keeps the optimizer from parsing again wherever the event is read, or for a filter far below, before rows are dealt out.
    """
    return raw.select("*", F.explode(F.array(J.parse("raw"))).alias("event"))


def rejects(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("event").isNull() & F.col("raw").isNotNull()).select("raw")


def typed(decoded: DataFrame, archive_seq: str = "created") -> DataFrame:
    """id, created_at, kind, user_id, repo_id, seq_num, event.  Rows without a seq_num get the microseconds of created_at, or 0."""
    v, f = F.col("event"), E.Parts(F.col("_parts"))
    rows = E.with_parts(decoded.where(v.isNotNull()), (*E.KIND_TEXTS, "created_at"), ("id", "actor.id", "repo.id", "seq_num"), (*E.KIND_PRESENT, "seq_num"), ())
    at = F.to_timestamp(f.text("created_at"))
    own = F.unix_micros(at) if archive_seq == "created" else F.lit(0).cast("long")
    return rows.select(
        f.number("id").alias("id"), at.alias("created_at"), E.classify(f).alias("kind"), f.number("actor.id").alias("user_id"), f.number("repo.id").alias("repo_id"),
        F.when(f.has("seq_num"), f.number("seq_num")).otherwise(own).alias("seq_num"), "event",
    )


def sequenced(decoded: DataFrame, archive_seq: str = "created") -> DataFrame:
    """event and seq_num, as typed() has them: all that mentions need, read straight from the event."""
    v = F.col("event")
    own = F.unix_micros(F.to_timestamp(J.text(v, "$.created_at"))) if archive_seq == "created" else F.lit(0).cast("long")
    return decoded.where(v.isNotNull()).select("event", F.when(J.has(v, "$.seq_num"), J.number(v, "$.seq_num")).otherwise(own).alias("seq_num"))


def detailed(events: DataFrame, strict: bool = True) -> DataFrame:
    """The events table: typed events with details."""
    rows = E.with_parts(events)
    return rows.select(*(c for c in events.columns if c != "event"), E.describe(E.Parts(F.col("_parts")), F.col("kind"), strict).alias("details"))


def recent(events: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Events that are not stale at as_of (a Column or a literal)."""
    return events.where(F.col("created_at") > (as_of if not isinstance(as_of, str) else F.lit(as_of).cast("timestamp_ntz")) - F.make_interval(days=F.lit(days)))
