"""Queries of the stored tables, guarded reads and streams: each runs its job over the whole events table and returns what it stored."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries as BASE
from .operators import entities as N
from .operators import history as H
from .operators import ranking as R
from .operators import sliding as S
from .plans import enrich as J
from .plans.query import Query, subscribed_totals
from .queries import _CASE, _log, _OLDNEW, _updates, _add, _ev, _literal, _live, _live_sql, _parts, _ranking, _ranking_sql, _typed, AS_OF, EARLIER, EV, ORDER, RAW, raw_events
from .runtime import shared_folder
from .schema import TABLES
from .sources import events as X
from .sources import tables as T
from .streaming import jobs as L

BUCKET = "time_bucket(INTERVAL {n} SECOND, {c}, TIMESTAMP '1970-01-01')"


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{shared_folder(spark)}/job-{uuid.uuid4().hex}"


def _to_end(stream: DataFrame, mode: str, write, folder: str, idle: bool = True) -> None:
    """Runs a stream over all that there is.  idle: batches without data run too, as event-time timers want; state that ages by the clock would ask for them without end."""
    conf = stream.sparkSession.conf
    wanted = {"spark.sql.streaming.stateStore.providerClass": L.ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": str(idle).lower()}
    before = {k: conf.get(k) for k in wanted}
    for k, v in wanted.items():
        conf.set(k, v)
    try:
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            conf.set(k, v)


def _files(folder: str):
    return lambda rows, n: rows.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")


def stream_silver(s: SparkSession, d: str) -> DataFrame:
    """Raw text, with a third of the rows twice, to typed events without repeats."""
    folder = scratch(s)
    raw = raw_events(s, d)
    raw.unionByName(raw.where("raw LIKE '%7\",\"seq_num%'")).write.text(f"{folder}/raw")
    L.silver(X.raw_stream(s, f"{folder}/raw"), f"{folder}/out", f"{folder}/checkpoint", availableNow=True).awaitTermination()
    return s.read.parquet(f"{folder}/out").select("id", F.col("created_at").cast("timestamp_ntz").alias("created_at"), "kind", "user_id", "repo_id", "seq_num")


_add("stream_silver", stream_silver, f"{EV} SELECT id, date_trunc('second', created_at) AS created_at, {_CASE} AS kind, user_id, repo_id, seq_num FROM ev")


def stream_table(s: SparkSession, d: str) -> DataFrame:
    """Tumbling counts as a stream, upserted into a table that is kept by day, and published; the rows of the table."""
    folder = scratch(s)
    store = T.Store(s, f"{folder}/tables")
    _to_end(L.tumbling_stream(X.table_stream(s, d), "user_id"), "update", L.table_writer(store, TABLES["users_history"], L.publish_to_files(f"{folder}/topic"), partition_by="date_format(ts_start, 'yyyy-MM-dd')"), folder)
    rows = store.read("users_history")
    return rows.select("user_id", F.col("ts_start").cast("timestamp_ntz").alias("ts_start"), F.col("ts_end").cast("timestamp_ntz").alias("ts_end"), "num_events")


_HISTORY = f"SELECT user_id, {BUCKET.format(n=300, c='created_at')} AS ts_start, {BUCKET.format(n=300, c='created_at')} + INTERVAL 300 SECOND AS ts_end, count(*) AS num_events FROM ev GROUP BY ALL"
_add("stream_table", stream_table, f"{EV} {_HISTORY}")


def stream_topic(s: SparkSession, d: str) -> DataFrame:
    """What the table's writer publishes after the table is written."""
    folder = scratch(s)
    _to_end(L.tumbling_stream(X.table_stream(s, d), "kind", 86400), "update", L.table_writer(T.Store(s, f"{folder}/tables"), TABLES["counts_history"], L.publish_to_files(f"{folder}/topic")), folder)
    told = s.read.parquet(f"{folder}/topic").select("key", F.from_json("value", "kind string, num_events long").alias("v"))
    return told.select(F.get_json_object("key", "$[0]").alias("kind"), F.get_json_object("key", "$[1]").alias("ts_start"), F.col("v.num_events").alias("num_events"))


_add("stream_topic", stream_topic, f"{EV} SELECT kind, strftime({BUCKET.format(n=86400, c='created_at')}, '%Y-%m-%dT%H:%M:%SZ') AS ts_start, count(*) AS num_events FROM fan GROUP BY ALL")


def stream_sliding(s: SparkSession, d: str) -> DataFrame:
    """Changes of sliding counts by timers, up to the watermark."""
    folder = scratch(s)
    _to_end(L.sliding_stream(H.stars(X.table_stream(s, d)), "repo_id"), "update", _files(folder), folder)
    return s.read.parquet(f"{folder}/out").select("window_size", "repo_id", F.col("changed_at").cast("timestamp_ntz").alias("changed_at"), F.col("n").alias("num_stars"))


_add(
    "stream_sliding", stream_sliding,
    f"""{EV}, w AS (SELECT * FROM ev WHERE kind = 'watch'), b AS (SELECT repo_id, date_trunc('second', created_at) + INTERVAL 1 SECOND AS e, count(*) AS c FROM w GROUP BY ALL),
 dl AS (SELECT window_size, repo_id, changed_at, sum(c) AS delta FROM (SELECT window_size, repo_id, e AS changed_at, c FROM b, sizes UNION ALL SELECT window_size, repo_id, e + s * INTERVAL 1 SECOND, -c FROM b, sizes) GROUP BY ALL HAVING sum(c) <> 0),
 ch AS (SELECT window_size, repo_id, changed_at, CAST(sum(delta) OVER (PARTITION BY window_size, repo_id ORDER BY changed_at) AS BIGINT) AS num_stars FROM dl) SELECT * FROM ch WHERE changed_at <= (SELECT max(created_at) - INTERVAL 10 SECOND FROM w)""",
)


def stream_late(s: SparkSession, d: str) -> DataFrame:
    """Sliding counts of stars in two runs: a fifth of the stars of 20 hours come with the second, hours late; the changes told from then on."""
    folder = scratch(s)
    stars = H.stars(_ev(s, d))
    early, late = F.col("created_at") < _literal(AS_OF), (F.col("created_at") >= _literal(AS_OF) - F.expr("INTERVAL 20 HOURS")) & (F.col("id") % 5 == 0)
    for rows in (stars.where(early & ~late), stars.where(~early | late)):
        rows.withColumn("created_at", F.col("created_at").cast("timestamp")).write.mode("append").parquet(f"{folder}/in")
        stream = s.readStream.schema("id long, created_at timestamp, kind string, user_id long, repo_id long, seq_num long").parquet(f"{folder}/in")
        _to_end(L.sliding_stream(stream, "repo_id"), "update", _files(folder), folder)
    told = s.read.parquet(f"{folder}/out").select("window_size", "repo_id", F.col("changed_at").cast("timestamp_ntz").alias("changed_at"), F.col("n").alias("num_stars"))
    return told.where(F.col("changed_at") > _literal(AS_OF))


_add("stream_late", stream_late, f"SELECT * FROM ({BASE._sql['stream_sliding']}) WHERE changed_at > TIMESTAMP '{AS_OF}'")


def stream_trending(s: SparkSession, d: str) -> DataFrame:
    """Two streams: sliding counts of stars, and from their changes the trending scores, by state."""
    folder = scratch(s)
    _to_end(L.sliding_stream(H.stars(X.table_stream(s, d)), "repo_id"), "update", _files(folder), folder)
    told = s.readStream.schema("repo_id long, window_size string, changed_at timestamp, n long").parquet(f"{folder}/out/batch=*").withColumnRenamed("n", "num_stars")
    _to_end(L.trending_stream(told), "append", _files(f"{folder}/scores"), f"{folder}/scores", idle=False)
    return s.read.parquet(f"{folder}/scores/out").select("repo_id", F.col("changed_at").cast("timestamp_ntz").alias("changed_at"), "trending_score")


_WATCHED = "(SELECT max(ts) - INTERVAL 10 SECOND FROM events WHERE event_type = 'purchase')"
_add("stream_trending", stream_trending, f"SELECT * FROM ({BASE._sql['trending_changelog']}) WHERE changed_at <= {_WATCHED}")


def stream_dedup(s: SparkSession, d: str) -> DataFrame:
    """Events in two runs, a third of them again in each: those of the first go, of the second only those whose time is not over."""
    folder = scratch(s)
    e = _ev(s, d).withColumn("created_at", F.col("created_at").cast("timestamp"))
    again = e.where("id % 3 = 0").withColumn("seq_num", F.col("seq_num") + 1_000_000)
    for rows in (e.unionByName(again), again):
        rows.write.mode("append").parquet(f"{folder}/in")
        stream = s.readStream.schema("id long, created_at timestamp, kind string, user_id long, repo_id long, seq_num long").parquet(f"{folder}/in")
        _to_end(L.seen_once(stream), "append", _files(folder), folder)
    return s.read.parquet(f"{folder}/out").select("id", "kind", "seq_num")


_add("stream_dedup", stream_dedup, f"{EV} SELECT id, kind, seq_num FROM ev UNION ALL SELECT id, kind, seq_num + 1000000 FROM ev WHERE id % 3 = 0 AND epoch_ms(created_at) + 1800000 <= (SELECT max(epoch_ms(created_at)) - 10000 FROM ev)")


def stream_days(s: SparkSession, d: str) -> DataFrame:
    """Events appended by day in three batches, the second tried twice, with a week's retention."""
    store = T.Store(s, scratch(s))
    write = L.days_writer(store, days=7)
    for n in (0, 1, 1, 2):
        write(_ev(s, d).where(F.col("id") % 3 == n), n)
    store.compact("events", "9")
    return store.read("events").select("id", "created_at", "kind", "user_id", "repo_id", "seq_num")


_add("stream_days", stream_days, f"{EV} SELECT id, created_at, kind, user_id, repo_id, seq_num FROM ev WHERE CAST(created_at AS DATE) >= (SELECT CAST(max(created_at) AS DATE) - 7 FROM ev)")


def stream_ranking(s: SparkSession, d: str) -> DataFrame:
    """The exact log of the stars' ranking over three micro-batches, the second tried twice: each starts from the state of those before it."""
    store = T.Store(s, scratch(s))
    write = L.ranking_writer(store, "stars", "repo_id", "num_stars")
    rows = _updates(s, d)
    first, second = (F.unix_seconds(F.lit(t).cast("timestamp")) for t in (EARLIER, AS_OF))
    at = F.when(F.col("seq_num") < first, 0).when(F.col("seq_num") < second, 1).otherwise(2)
    for n in (0, 1, 1, 2):
        write(rows.where(at == n), n)
    return store.read("stars_log").select("window_size", "seq_num", "repo_id", "num_stars", "row_number", "rank", "old_row_number", "old_rank")


_add("stream_ranking", stream_ranking, BASE._sql["ranking_changelog"])


def ranking_check(s: SparkSession, d: str) -> DataFrame:
    """A log with wrong places in some rows: the rows that the check tells."""
    log = _log(s, d).checkpoint()
    wrong = (F.col("seq_num") % 50 == 0) & F.col("old_rank").isNotNull()
    bad = log.withColumns({f"old_{p}": F.when(wrong, F.col(f"old_{p}") + 1).otherwise(F.col(f"old_{p}")) for p in R.PLACES})
    return R.broken(bad, "repo_id", "num_stars").select("window_size", "seq_num", "repo_id", "old_rank", "problem")


_add("ranking_check", ranking_check, f"SELECT window_size, seq_num, repo_id, old_rank + 1 AS old_rank, 'old places aren''t where the log had left the key' AS problem FROM ({BASE._sql['ranking_changelog']}) WHERE seq_num % 50 = 0 AND old_rank IS NOT NULL")


def stream_numbers(s: SparkSession, d: str) -> DataFrame:
    folder = scratch(s)
    _to_end(L.numbered_stream(X.table_stream(s, d).select("user_id", "id"), "user_id", "id", 5000), "append", _files(folder), folder, idle=False)
    return s.read.parquet(f"{folder}/out").drop("batch")


_add("stream_numbers", stream_numbers, f"{EV} SELECT user_id, id, 5000 + row_number() OVER (PARTITION BY user_id ORDER BY id) - 1 AS seq_num FROM ev")


def stream_updates(s: SparkSession, d: str) -> DataFrame:
    folder = scratch(s)
    _to_end(L.update_stream(X.table_stream(s, d).select("user_id", "kind", "seq_num"), "user_id", ["kind"]), "append", _files(folder), folder, idle=False)
    return s.read.parquet(f"{folder}/out").drop("batch")


_add("stream_updates", stream_updates, f"{EV} SELECT user_id, kind, seq_num FROM (SELECT user_id, kind, seq_num, lag(kind) OVER (PARTITION BY user_id ORDER BY seq_num) AS p FROM ev) WHERE p IS DISTINCT FROM kind")


def _archived(s: SparkSession, d: str, folder: str) -> DataFrame:
    """Raw events as hourly archives, scanned back over all hours from the first to the last."""
    X.write_archive(raw_events(s, d), f"{folder}/archive")
    first, last = _ev(s, d).agg(F.min("created_at"), F.max("created_at")).first()
    return X.archive(s, f"{folder}/archive", first, last, missing_ok=True)


def archive_scan(s: SparkSession, d: str) -> DataFrame:
    rows = X.typed(X.decode(_archived(s, d, scratch(s))))
    return rows.select("id", F.col("created_at").cast("timestamp_ntz").alias("created_at"), "kind", "user_id", "repo_id", "seq_num")


_add("archive_scan", archive_scan, BASE._sql["kind_classify"])


def archive_backfill(s: SparkSession, d: str) -> DataFrame:
    """The batch job over hourly archives: what it stored of the four histories."""
    folder = scratch(s)
    store = T.Store(s, folder)
    L.backfill(_archived(s, d, folder), store)
    out = None
    for name, (key, metric, _, _) in BASE.ENTITIES.items():
        rows = store.read(f"{name}_history").select(F.lit(name).alias("history"), F.col(key).cast("string").alias("key"), F.col("ts_start").cast("timestamp_ntz").alias("ts_start"), F.col(metric).alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


def archive_entities(s: SparkSession, d: str) -> DataFrame:
    """The batch job over raw events: the users and repositories that it stored, field by field."""
    store = T.Store(s, scratch(s))
    once = L.archived_events(raw_events(s, d)).persist(StorageLevel.DISK_ONLY)
    L.backfill_entities(once, store)
    once.unpersist()
    out = None
    for name, fields in (("users", N.USER_FIELDS), ("repos", N.REPO_FIELDS)):
        told = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), F.col(f"{f}_seq_num").alias("seq_num")) for f in fields)))
        rows = store.read(name).select(F.lit(name).alias("entity"), "id", told.alias("t")).select("entity", "id", "t.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def _stored_sql(entity: str, merged: str, fields: tuple[str, ...]) -> str:
    return " UNION ALL ".join(f"SELECT '{entity}' AS entity, id, '{f}' AS field, CAST({f} AS VARCHAR) AS value, CAST({f}_seq_num AS BIGINT) AS seq_num FROM ({merged})" for f in fields)


_add(
    "archive_entities", archive_entities,
    f"SELECT * FROM ({BASE._MENTIONS} {_stored_sql('users', BASE._merged_sql('ue', N.USER_FIELDS), N.USER_FIELDS)}) UNION ALL SELECT * FROM ({BASE._REPOS} {_stored_sql('repos', BASE._merged_sql('re', N.REPO_FIELDS), N.REPO_FIELDS)})",
)
_EACH = {"counts": ("kind", "(SELECT * FROM k UNION ALL SELECT created_at, 'all', user_id, repo_id FROM k)"), "users": ("user_id", "k"), "repos": ("repo_id", "k"), "stars": ("repo_id", "(SELECT * FROM k WHERE kind = 'watch')")}
_add(
    "archive_backfill", archive_backfill,
    f"{EV}, k AS (SELECT created_at, {_CASE} AS kind, user_id, repo_id FROM ev) " + " UNION ALL ".join(f"SELECT '{n}' AS history, CAST({k} AS VARCHAR) AS key, {BUCKET.format(n=300, c='created_at')} AS ts_start, count(*) AS n FROM {rows} GROUP BY ALL" for n, (k, rows) in _EACH.items()),
)


def live_jobs(s: SparkSession, d: str) -> DataFrame:
    """Two micro-batches of the live job, the second tried twice: the changes of all five rankings between them."""
    store = T.Store(s, scratch(s))
    write = L.live_tables(store)
    e = _ev(s, d).where(f"created_at < TIMESTAMP_NTZ'{AS_OF}'")
    early = F.col("created_at") < _literal(EARLIER)
    write(e.where(early), 0)
    for _ in range(2):
        write(e.where(~early), 1)
    out = None
    for name, (key, metric) in _RANKINGS.items():
        rows = store.read(f"{name}_ranking_changes")
        by = F.col("window_size") if "window_size" in rows.columns else F.lit("-")
        rows = rows.select(F.lit(name).alias("ranking"), by.alias("window_size"), F.col(key).cast("string").alias("key"), F.col(metric).alias("metric"), "row_number", "rank", "old_row_number", "old_rank")
        out = rows if out is None else out.unionByName(rows)
    return out


_RANKINGS = {n: (k, m) for n, (k, m, _, _) in BASE.ENTITIES.items()} | {"trending": ("repo_id", "trending_score")}


def _until(name: str, before: str) -> str:
    end = f"(SELECT date_trunc('second', max(created_at)) + INTERVAL 1 SECOND FROM ev WHERE created_at < TIMESTAMP '{before}')"
    source = "stars" if name == "trending" else name
    key, metric, _, rows = BASE.ENTITIES[source]
    live = f"SELECT window_size, {key}, count(*) AS {metric}, max(seq_num) AS seq_num FROM {rows} e, sizes WHERE created_at < {end} AND created_at >= {end} - s * INTERVAL 1 SECOND GROUP BY window_size, {key}"
    if name != "trending":
        return BASE._rank_sql(live, key, metric, "window_size")
    score = f"SELECT repo_id, CAST(sum(num_stars * CASE window_size WHEN '5m' THEN 10 WHEN '1h' THEN 5 WHEN '6h' THEN 2 ELSE 1 END) AS BIGINT) AS trending_score, max(seq_num) AS seq_num FROM ({live}) GROUP BY repo_id"
    return BASE._rank_sql(score, "repo_id", "trending_score", None)


def _between(name: str) -> str:
    """The changes of one ranking between the two batches."""
    key, metric = _RANKINGS[name]
    by = "'-'" if name == "trending" else "coalesce(n.window_size, o.window_size)"
    same = "true" if name == "trending" else "o.window_size = n.window_size"
    return f"""SELECT '{name}' AS ranking, {by} AS window_size, CAST(coalesce(n.{key}, o.{key}) AS VARCHAR) AS key, n.{metric} AS metric, n.row_number, n.rank, o.row_number AS old_row_number, o.rank AS old_rank
 FROM ({_until(name, EARLIER)}) o FULL JOIN ({_until(name, AS_OF)}) n ON {same} AND o.{key} = n.{key} WHERE n.{metric} IS DISTINCT FROM o.{metric}"""


_add("live_jobs", live_jobs, f"{EV} {' UNION ALL '.join(_between(n) for n in _RANKINGS)}")


def stored_upsert(s: SparkSession, d: str) -> DataFrame:
    """Two batches into a table kept by window size, the second applied twice."""
    store, spec = T.Store(s, scratch(s)), TABLES["repos_live"]
    for rows in (_live("repos", EARLIER)(s, d), _live("repos")(s, d), _live("repos")(s, d)):
        store.upsert(rows, spec, "window_size")
    return store.read(spec.name)


_ONR = f"{EV}, o AS ({_live_sql('repos', EARLIER)}), n AS ({_live_sql('repos')})"
_add(
    "stored_upsert", stored_upsert,
    f"{_ONR} SELECT coalesce(n.window_size, o.window_size) AS window_size, coalesce(n.repo_id, o.repo_id) AS repo_id, CASE WHEN o.seq_num IS NULL OR n.seq_num > o.seq_num THEN n.num_events ELSE o.num_events END AS num_events, greatest(n.seq_num, o.seq_num) AS seq_num FROM o FULL JOIN n ON n.window_size = o.window_size AND n.repo_id = o.repo_id",
)


def partition_retention(s: SparkSession, d: str) -> DataFrame:
    """Histories kept by week; old weeks are removed without reading them."""
    store, spec = T.Store(s, scratch(s)), TABLES["users_history"]
    rows = H.tumbling(_ev(s, d), "user_id").withColumn("seq_num", F.unix_seconds(F.col("ts_end").cast("timestamp")))
    store.upsert(rows, spec, "date_format(date_trunc('week', ts_start), 'yyyy-MM-dd')")
    store.drop_partitions(spec.name, "2024-01-15")
    return store.read(spec.name).drop("seq_num")


_add("partition_retention", partition_retention, f"{EV}, h AS ({_HISTORY}) SELECT * FROM h WHERE ts_start >= TIMESTAMP '2024-01-15'")
# the changes of a ranking in order: place tells a reader where each belongs
_add(
    "ordered_topic", lambda s, d: T.ordered_topic_rows(_log(s, d, EARLIER).select("window_size", "repo_id", "num_stars", "row_number", "rank", "seq_num"), TABLES["stars_ranking"]),
    f"""SELECT '["' || window_size || '",' || repo_id || ']' AS key, '{{"window_size":"' || window_size || '","repo_id":' || repo_id || ',"num_stars":' || num_stars || coalesce(',"row_number":' || row_number || ',"rank":' || rank, '') || ',"seq_num":' || seq_num || '}}' AS value,
 row_number() OVER (PARTITION BY window_size ORDER BY seq_num, repo_id) - 1 AS place FROM ({BASE._sql['ranking_changelog']}) WHERE seq_num <= epoch(TIMESTAMP '{EARLIER}')""",
)
_add("clean_text", lambda s, d: T.clean_text(_ev(s, d).select("id", F.concat("kind", F.lit("\x00-"), "kind").alias("text"))), f"{EV} SELECT id, kind || '-' || kind AS text FROM ev")
_add("json_rejects", lambda s, d: X.rejects(X.decode(raw_events(s, d).select(F.when(F.col("raw").contains('"size":2'), F.expr("left(raw, 40)")).otherwise(F.col("raw")).alias("raw")))).groupBy("raw").agg(F.count("*").alias("n")), f"{EV} SELECT left('{{\"id\":\"' || id || '\",\"seq_num\":' || seq_num || ',\"type\":\"PushEvent\",\"created_at\":\"', 40) AS raw, 1 AS n FROM ev WHERE id % {len(RAW)} = 0")
_add(
    "page_flatten",
    lambda s, d: X.flattened(_ev(s, d).groupBy(F.floor(F.col("id") / 200).alias("poll"), (F.floor(F.col("id") % 200 / 100) + 1).alias("page")).agg(F.to_json(F.transform(F.sort_array(F.collect_list("id")), lambda i: F.struct((i % 5000).alias("id")))).alias("value"))).select("poll", "page", "pos", "id", "seq_num"),
    f"{EV}, p AS (SELECT id // 200 AS poll, id % 200 // 100 + 1 AS page, row_number() OVER (PARTITION BY id // 100 ORDER BY id) - 1 AS pos, id % 5000 AS id FROM ev), o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY poll, page DESC, pos DESC) AS n FROM p) SELECT poll, page, pos, id, poll * 1000 + row_number() OVER (PARTITION BY poll ORDER BY page DESC, pos DESC) - 1 AS seq_num FROM o WHERE n = 1",
)
_add("feed_grouped", lambda s, d: _ev(s, d).groupBy("kind", "repo_id").agg(F.count("*").alias("n"), F.max("seq_num").alias("seq_num")).orderBy("kind", F.desc("n"), "repo_id"), f"{EV} SELECT kind, repo_id, count(*) AS n, max(seq_num) AS seq_num FROM ev GROUP BY ALL")
_add(
    "guarded_read", lambda s, d: Query(TABLES["repos_ranking"]).where("row_number", start=0, end=20).where("window_size", "24h").read(_ranking("repos")(s, d)),
    f"{EV} SELECT window_size, repo_id, num_events, row_number, rank, max_rank, seq_num FROM ({_ranking_sql('repos')}) WHERE window_size = '24h' AND row_number < 20",
)
_add(
    "point_dispatch", lambda s, d: Query(TABLES["repos_ranking"]).where("repo_id", 42).read_ranking(_live("repos")(s, d), "repo_id", "num_events"),
    f"{EV} SELECT window_size, repo_id, num_events, row_number, rank, max_rank FROM ({_ranking_sql('repos')}) WHERE repo_id = 42",
)
_add(
    "full_dispatch", lambda s, d: Query(TABLES["repos_ranking"]).where("repo_id", *range(40)).read_ranking(_live("repos")(s, d), "repo_id", "num_events"),
    f"{EV} SELECT window_size, repo_id, num_events, row_number, rank, max_rank FROM ({_ranking_sql('repos')}) WHERE repo_id < 40",
)


def subscription_join(s: SparkSession, d: str) -> DataFrame:
    """Every user follows its own watches and the pushes of a range of repositories: subscriptions as a table, made from the events."""
    users = _ev(s, d).where("user_id IS NOT NULL").select("user_id").distinct()
    row = lambda branch, field, options=None, least=None, below=None: F.struct(F.lit(branch).alias("branch"), F.lit(field).alias("field"), (F.array(*options) if options else F.lit(None).cast("array<string>")).alias("options"), F.lit(least).cast("long").alias("least"), F.lit(below).cast("long").alias("below"))
    text = F.col("user_id").cast("string")
    low, high = F.col("user_id") % 90, F.col("user_id") % 90 + 2
    rows = users.select(F.concat(F.lit("s"), text).alias("name"), F.explode(F.array(row(0, "kind", [F.lit("watch")]), row(0, "user_id", [text]), row(1, "kind", [F.lit("push")]), row(1, "repo_id", None, low, high))).alias("r")).select("name", "r.*")
    return subscribed_totals(_ev(s, d).select("id", "kind", "user_id", "repo_id"), rows, ["id"]).withColumnRenamed("id", "ids")


_add(
    "subscription_join", subscription_join,
    f"{EV}, u AS (SELECT DISTINCT user_id AS u FROM ev), m AS (SELECT id, 's' || u AS name FROM ev, u WHERE kind = 'watch' AND user_id = u OR kind = 'push' AND repo_id >= u % 90 AND repo_id < u % 90 + 2) SELECT name, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM m GROUP BY name",
)


def entity_history(s: SparkSession, d: str) -> DataFrame:
    """The page of a repository: its fields, places, and the series of its last day."""
    page = J.entity_page(_parts(s, d), {"repos": _ranking("repos")(s, d)}, "repo_id").where(F.size("places") > 0).withColumnRenamed("id", "repo_id")
    out = J.with_series(page, H.tumbling(_ev(s, d), "repo_id"), "repo_id", "num_events", _literal(AS_OF))
    return out.select("repo_id", "reponame", F.size("places").alias("n_places"), F.array_join(F.transform("series", lambda y: F.coalesce(y.cast("string"), F.lit("-"))), ",").alias("series"))


_add(
    "entity_history", entity_history,
    f"""{EV}, {BASE._PARTS}, h AS (SELECT repo_id, {BUCKET.format(n=300, c='created_at')} AS x, count(*) AS y FROM ev GROUP BY 1, 2), r AS ({_ranking_sql('repos')}), pl AS (SELECT repo_id, count(*) AS n FROM r GROUP BY repo_id),
 g AS (SELECT repo_id, p, coalesce(y, CASE WHEN p < 287 THEN 0 END) AS y FROM (SELECT DISTINCT repo_id FROM h WHERE x <= TIMESTAMP '{AS_OF}' AND x > TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY) CROSS JOIN range(288) t(p) LEFT JOIN h USING (repo_id) WHERE false),
 k AS (SELECT DISTINCT repo_id FROM h WHERE x <= TIMESTAMP '{AS_OF}' AND x > TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY), se AS (SELECT k.repo_id, (287 - p) // 4 AS back, CASE WHEN count(*) FILTER (WHERE y IS NULL AND p = 287) = 0 THEN CAST(sum(coalesce(y, 0)) AS BIGINT) END AS y
 FROM k CROSS JOIN range(288) t(p) LEFT JOIN h ON h.repo_id = k.repo_id AND h.x = TIMESTAMP '{AS_OF}' + (p - 287) * INTERVAL 300 SECOND GROUP BY ALL), li AS (SELECT repo_id, string_agg(coalesce(CAST(y AS VARCHAR), '-'), ',' ORDER BY back DESC) AS series FROM se GROUP BY repo_id)
 SELECT id AS repo_id, reponame, n AS n_places, series FROM pa JOIN pl ON id = pl.repo_id LEFT JOIN li ON id = li.repo_id""",
)
