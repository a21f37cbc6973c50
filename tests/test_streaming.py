import json
import tempfile
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from forgepulse.operators import history as H
from forgepulse.operators import sliding as S
from forgepulse.schema import TABLES
from forgepulse.sources import events as X
from forgepulse.sources.tables import Store
from forgepulse.streaming import jobs as L


def micro(t):
    return datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=t)


def raw(i, t, type_="WatchEvent", user=1, repo=2):
    return json.dumps({"id": str(i), "seq_num": i, "type": type_, "created_at": micro(t).strftime("%Y-%m-%dT%H:%M:%SZ"), "actor": {"id": user, "login": f"u{user}"}, "repo": {"id": repo, "name": "a/b"}})


def feed(folder, *batches):
    """One text file a batch, in order of time."""
    import os
    import time

    for n, rows in enumerate(batches):
        path = folder / f"{n:03}.txt"
        path.write_text("\n".join(rows) + "\n")
        os.utime(path, (time.time() - 1000 + n, time.time() - 1000 + n))


def run(stream, mode, name, checkpoint):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_silver_drops_repeats_and_survives_a_restart(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    feed(source, [raw(1, 0), raw(2, 1)], [raw(2, 1), raw(3, 2), "{broken"])
    go = lambda: L.silver(X.raw_stream(spark, str(source), files_per_batch=1), str(out), str(tmp_path / "c"), availableNow=True).awaitTermination()
    go()
    (source / "100.txt").write_text(raw(3, 2) + "\n" + raw(4, 3) + "\n")
    go()
    rows = spark.read.parquet(str(out)).collect()
    assert sorted(r.id for r in rows) == [1, 2, 3, 4] and {r.kind for r in rows} == {"watch"}


def test_tumbling_stream_equals_the_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    times = [0, 5, 12, 299, 300, 601, 7, 302]
    rows = [raw(i, t, "PushEvent" if i % 2 else "WatchEvent") for i, t in enumerate(times)]
    feed(source, rows[:4], rows[4:6], rows[6:])
    stream = X.typed(X.decode(X.raw_stream(spark, str(source), files_per_batch=1))).drop("event")
    run(L.tumbling_stream(stream, "kind"), "update", "tumbling", tmp_path / "c")
    got = {}
    for r in spark.sql("SELECT * FROM tumbling").collect():
        got[r.kind, r.ts_start] = max(r.num_events, got.get((r.kind, r.ts_start), 0))
    batch = H.tumbling(X.typed(X.decode(spark.createDataFrame([(r,) for r in rows], "raw string"))), "kind")
    assert got == {(r.kind, r.ts_start): r.num_events for r in batch.collect()}


def test_sliding_stream_equals_the_change_log(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", L.ROCKSDB)
    source = tmp_path / "in"
    source.mkdir()
    sizes = {"s": 10, "l": 60}
    times = [0, 1, 1, 5, 30, 31, 90, 91, 200, 400]
    rows = [raw(i, t, repo=i % 2) for i, t in enumerate(times)]
    feed(source, rows[:5], rows[5:8], rows[8:], [raw(99, 1000, repo=5)])
    stream = X.typed(X.decode(X.raw_stream(spark, str(source), files_per_batch=1))).drop("event")
    run(L.sliding_stream(stream, "repo_id", sizes), "update", "sliding", tmp_path / "c")
    got = {(r.window_size, r.repo_id, r.changed_at): r.n for r in spark.sql("SELECT * FROM sliding").collect()}
    events = X.typed(X.decode(spark.createDataFrame([(r,) for r in rows], "raw string")))
    want = {(r.window_size, r.repo_id, r.changed_at): r.num_events for r in S.changes(events, "repo_id", sizes=sizes).collect()}
    assert got == want and want


def test_late_events_are_told_at_the_last_second(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", L.ROCKSDB)
    source = tmp_path / "in"
    source.mkdir()
    feed(source, [raw(1, 100), raw(2, 103)], [raw(3, 150)], [raw(4, 101)], [raw(5, 300, repo=9)], [raw(6, 500, repo=9)])
    stream = X.typed(X.decode(X.raw_stream(spark, str(source), files_per_batch=1))).drop("event")
    run(L.sliding_stream(stream, "repo_id", {"l": 60}), "update", "late", tmp_path / "c")
    last = {}
    for r in spark.sql("SELECT * FROM late").collect():
        last.setdefault(r.changed_at, []).append(r.n)
    base = micro(0).replace(tzinfo=None)
    at = lambda t: last.get(base + timedelta(seconds=t))
    assert at(101) == [1] and max(at(104)) == 3  # the late event joins what was told last


def test_tables_are_upserted_and_published(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    feed(source, [raw(1, 0), raw(2, 400)], [raw(3, 10)])
    store, said = Store(spark, str(tmp_path / "t")), []
    stream = X.typed(X.decode(X.raw_stream(spark, str(source), files_per_batch=1))).drop("event")
    write = L.table_writer(store, TABLES["repos_history"], lambda rows, n: said.extend((n, r.key, json.loads(r.value)["num_events"]) for r in rows.collect()))
    L.tumbling_stream(stream, "repo_id").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    rows = store.read("repos_history").collect()
    assert sorted(r.num_events for r in rows) == [1, 2] and [n for _, _, n in said][-1] == 2 and len(said) == 3


def test_live_tables_and_their_ranking_changes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"))
    write = L.live_tables(store)
    typed = lambda rows: X.typed(X.decode(spark.createDataFrame([(r,) for r in rows], "raw string"))).drop("event")
    write(typed([raw(1, 0, repo=1), raw(2, 1, repo=1), raw(3, 2, repo=2)]), 0)
    write(typed([raw(4, 5, repo=2), raw(5, 6, repo=2), raw(5, 6, repo=2)]), 1)
    first = store.read("stars_ranking").where("window_size = '5m'").orderBy("row_number").collect()
    assert [(r.repo_id, r.num_stars) for r in first] == [(2, 3), (1, 2)]
    change = store.read("stars_ranking_changes").where("window_size = '5m'").collect()
    assert [(r.repo_id, r.row_number, r.old_row_number) for r in change] == [(2, 0, 1)]
    assert store.read("trending_live").orderBy("repo_id").first().trending_score == 2 * 18


def test_backfill(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"))
    L.backfill(spark.createDataFrame([(raw(1, 0),), (raw(1, 0),), (raw(2, 301, "PushEvent"),)], "raw string"), store)
    assert {r.id: r.username for r in store.read("users").collect()} == {1: "u1"}
    assert store.read("repos").first().fullname == "a/b" and store.read("stars_history").count() == 1 and store.read("counts_history").count() == 4


def test_batch_dedup_keeps_the_first_version(spark):
    from forgepulse.operators.versioning import dedup

    df = spark.createDataFrame([(1, 5, "b"), (1, 3, "a"), (2, 1, "c")], "id long, seq_num long, kind string")
    assert sorted(map(tuple, dedup(df).collect())) == [(1, 3, "a"), (2, 1, "c")]
