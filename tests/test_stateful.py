import json
import random
import time
from datetime import datetime, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from forgepulse.operators import ranking as R
from forgepulse.operators import sliding as S
from forgepulse.schema import TABLES
from forgepulse.sources import events as X
from forgepulse.sources.tables import Store
from forgepulse.streaming import jobs as L
from tests.test_rankings import log
from tests.test_streaming import feed, micro, raw
from tests.test_tables import brute_changes, brute_log


class Held:
    """State of one key in plain dicts; counts what is read of it."""

    def __init__(self):
        self.values, self.maps, self.timers, self.reads = {}, {}, set(), 0

    def getValueState(self, name, schema, ttl=None):  # noqa: N802
        held = self

        class Value:
            exists = staticmethod(lambda: name in held.values)
            update = staticmethod(lambda v: held.values.__setitem__(name, v))
            clear = staticmethod(lambda: held.values.pop(name, None))

            @staticmethod
            def get():
                held.reads += 1
                return held.values.get(name)

        return Value

    def getMapState(self, name, key, value, ttl=None):  # noqa: N802
        held, own = self, self.maps.setdefault(name, {})

        class Map:
            updateValue = staticmethod(own.__setitem__)  # noqa: N815
            removeKey = staticmethod(lambda k: own.pop(k))  # noqa: N815

            @staticmethod
            def getValue(k):  # noqa: N802
                held.reads += 1
                return own.get(k)

            @staticmethod
            def iterator():
                held.reads += len(own)
                return iter(list(own.items()))

        return Map

    def listTimers(self):  # noqa: N802
        return list(self.timers)

    def registerTimer(self, t):  # noqa: N802
        self.timers.add(t)

    def deleteTimer(self, t):  # noqa: N802
        self.timers.discard(t)


class Clock:
    def __init__(self, second):
        self.second = second

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.second * 1000


def events_at(times):
    return iter([pd.DataFrame({"created_at": pd.to_datetime([t + 0.5 for t in times], unit="s")})])


def simulate(sizes, batches):
    """Runs batches of event times, and the timers that are due at the watermark that each ends with; rows told, and the most state that a call read."""
    held, out, most = Held(), [], 0
    job = L.SlidingCounts("k", "long", sizes)
    job.init(held)

    def call(rows):
        nonlocal most
        out.extend((r.window_size, int(r.changed_at.timestamp()), r.n) for f in rows for r in f.itertuples())
        most, held.reads = max(most, held.reads), 0

    for times, watermark in batches:
        if times:
            call(job.handleInputRows((1,), events_at(times), Clock(watermark)))
        if held.timers and min(held.timers) <= watermark * 1000:
            call(job.handleExpiredTimer((1,), Clock(watermark), None))
    return out, most, held


def test_sliding_state_equals_the_log_and_ends(spark):
    rng = random.Random(3)
    sizes = {"s": 7, "m": 90, "l": 400}
    for _ in range(30):
        times = sorted(rng.randrange(3000) for _ in range(rng.randrange(1, 60)))
        batches, i = [], 0
        while i < len(times):
            n = rng.randrange(1, 8)
            batches.append((times[i : i + n], max(0, times[i : i + n][0] - 1)))
            batches.append(([], max(0, times[min(i + n, len(times)) - 1])))
            i += n
        out, _, held = simulate(sizes, [*batches, ([], 10_000)])
        got = {(n, 1, t): c for n, t, c in out}
        assert got == brute_changes([(1, t) for t in times], sizes) and len(got) == len(out)
        assert not held.values and not held.maps["chunks"] and not held.timers  # nothing is left of the key


def test_a_call_reads_what_moves_and_not_the_window():
    """A key that is busy each second of a day: a call reads a few chunks, not those of 24 hours."""
    day = [([t], t - 1) for t in range(0, 90_000, 7)]
    _, most, held = simulate({"5m": 300, "24h": 86_400}, day)
    assert len(held.maps["chunks"]) > 1400 and most <= 12


def test_late_events_of_a_second_batch_move_closed_windows():
    sizes = {"s": 10, "l": 100}
    out, _, _ = simulate(sizes, [([50, 60, 95], 96), ([55, 94, 20], 97), ([], 1000)])
    last = {}
    for n, t, c in out:
        last[n, t] = c
    # 96 is the last second told: the late 55 and 94 join the long window there, 94 the short one too; 20 counts for the long one
    assert last["l", 96] == 6 and last["s", 96] == 2
    assert last["l", 121] == 5 and last["l", 196] == 0 and last["s", 106] == 0


def rows_of(spark, folder, make, name, batches, mode="append", pause=()):
    """Runs a stream over JSON files, one run a batch, with pauses before them; rows of the sink by run."""
    out = []
    folder.mkdir()
    for i, rows in enumerate(batches):
        time.sleep(pause[i] if pause else 0)
        (folder / f"{i:03}.json").write_text("\n".join(json.dumps(r) for r in rows) + "\n")
        got = []
        stream = make(spark.readStream.schema(SCHEMA).json(str(folder)))
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", str(folder) + "-c").foreachBatch(lambda f, n, got=got: got.extend(f.collect())).trigger(availableNow=True).start()
        q.awaitTermination()
        out.append(got)
    return out


SCHEMA = "id long, created_at timestamp, seq_num long, repo_id long, window_size string, changed_at timestamp, num_stars long, name string"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", L.ROCKSDB)
    yield
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def at(minutes):
    return micro(60 * minutes).strftime("%Y-%m-%dT%H:%M:%SZ")


def test_each_sight_of_an_event_starts_its_time_anew(spark, tmp_path, rocks):
    one = lambda i, m, seq: {"id": i, "created_at": at(m), "seq_num": seq}
    batches = [
        [one(1, 0, 5), one(1, 0, 3)],  # the least seq_num of a batch
        [one(1, 0, 9), one(2, 25, 1)],  # a repeat, seen at minute 0; the clock goes to 25
        [one(1, 0, 10), one(3, 41, 1)],  # seen at 25, so remembered to 55
        [one(1, 0, 11), one(4, 50, 1)],  # 50 minutes after the first sight
        [one(5, 120, 1)], [one(6, 121, 1)],
        [one(1, 0, 12)],  # forgotten by now
    ]
    got = rows_of(spark, tmp_path / "in", L.seen_once, "seen", batches)
    assert [sorted((r.id, r.seq_num) for r in rows if r.id == 1) for rows in got] == [[(1, 3)], [], [], [], [], [], [(1, 12)]]
    assert sorted(r.id for rows in got for r in rows) == [1, 1, 2, 3, 4, 5, 6]


def test_trending_scores_as_a_stream(spark, tmp_path, rocks):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    steps = [("5m", 3), ("1h", 4), ("6h", 7), ("24h", 9), ("5m", 1), ("1h", 0), ("5m", 0)]
    rows = [{"repo_id": 1, "window_size": w, "changed_at": at(i), "num_stars": n} for i, (w, n) in enumerate(steps)]
    more = [{"repo_id": 2, "window_size": w, "changed_at": at(0), "num_stars": 1} for w in ("5m", "1h")]
    got = rows_of(spark, tmp_path / "in", lambda s: L.trending_stream(s.select("repo_id", "window_size", "changed_at", "num_stars")), "trend", [rows[:2] + more, rows[2:5], rows[5:]])
    told = [r.trending_score for part in got for r in sorted(part, key=lambda r: r.changed_at) if r.repo_id == 1]
    assert told == [30, 50, 64, 73, 53, 33, 23]
    assert [r.trending_score for part in got for r in part if r.repo_id == 2] == [15]
    batch = S.trending_changes(spark.createDataFrame([(r["repo_id"], r["window_size"], r["changed_at"], r["num_stars"]) for r in rows], "repo_id long, window_size string, changed_at string, num_stars long"))
    assert [r.trending_score for r in batch.orderBy("changed_at").collect()] == told


def test_counts_are_forgotten_after_their_time_and_kept_while_met(spark, tmp_path, rocks):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    one = lambda w, m, n: [{"repo_id": 1, "window_size": w, "changed_at": at(m), "num_stars": n}]
    make = lambda s: L.trending_stream(s.select("repo_id", "window_size", "changed_at", "num_stars"), ttl_ms=12_000)
    got = rows_of(spark, tmp_path / "in", make, "ttl", [one("24h", 0, 5), one("1h", 1, 1), one("1h", 2, 2), one("1h", 3, 1)], pause=(0, 6, 6, 16))
    # met again after 6 seconds twice, the five stars of the day live on past 12; after 16 all are gone
    assert [r.trending_score for rows in got for r in rows] == [5, 10, 15, 5]


def test_numbers_and_updates_forget_a_key(spark, tmp_path, rocks):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    one = lambda i, name: [{"repo_id": 1, "id": i, "seq_num": i, "name": name}]
    numbers = lambda s: L.numbered_stream(s.select("repo_id", "id"), "repo_id", "id", 100, ttl_ms=4000)
    got = rows_of(spark, tmp_path / "n", numbers, "n", [one(1, "a"), one(2, "a"), one(3, "a")], pause=(0, 0, 8))
    assert [r.seq_num for rows in got for r in rows] == [100, 101, 100]
    updates = lambda s: L.update_stream(s.select("repo_id", "name", "seq_num"), "repo_id", ["name"], ttl_ms=4000)
    got = rows_of(spark, tmp_path / "u", updates, "u", [one(1, "a") + one(2, "a") + one(3, "b") + one(4, None), one(5, "b"), one(6, "b")], pause=(0, 0, 8))
    assert [sorted(r.seq_num for r in rows) for rows in got] == [[1, 3], [], [6]]


HISTORY = "user_id long, ts_start timestamp_ntz, ts_end timestamp_ntz, num_events long, seq_num long"


def history(spark, *rows):
    day = lambda d, h: datetime(2024, 1, d, h)
    return spark.createDataFrame([(u, day(d, 0), day(d, 1), n, s) for u, d, n, s in rows], HISTORY)


def files(tmp_path, name):
    return {str(p.relative_to(tmp_path)): p.stat().st_mtime_ns for p in (tmp_path / name).rglob("part-*.parquet")}


def test_an_upsert_touches_its_partitions_only_and_shows_all_or_nothing(spark, tmp_path, monkeypatch):
    store, spec, by = Store(spark, str(tmp_path)), TABLES["users_history"], "date_format(ts_start, 'yyyy-MM-dd')"
    store.upsert(history(spark, (1, 1, 5, 1), (1, 2, 6, 1), (1, 3, 7, 1)), spec, by, "a:0")
    first = files(tmp_path, spec.name)
    read = lambda: sorted((r.user_id, r.ts_start.day, r.num_events) for r in store.read(spec.name).collect())
    before = read()
    write = Store._write_text
    monkeypatch.setattr(Store, "_write_text", lambda *a: (_ for _ in ()).throw(OSError("crash")))
    batch = history(spark, (1, 2, 8, 2), (2, 3, 1, 1))
    with pytest.raises(OSError, match="crash"):
        store.upsert(batch, spec, by, "a:1")
    assert read() == before  # both partitions are written, neither is seen
    monkeypatch.setattr(Store, "_write_text", write)
    for _ in range(2):
        store.upsert(batch, spec, by, "a:1")
    assert read() == [(1, 1, 5), (1, 2, 8), (1, 3, 7), (2, 3, 1)]
    kept = {k for k in first if "p=2024-01-01" in k}
    assert kept and all(files(tmp_path, spec.name).get(k) == first[k] for k in kept)
    store.upsert(history(spark, (1, 2, 9, 3)), spec, by, "a:2")
    store.upsert(history(spark, (1, 2, 10, 4)), spec, by, "a:3", keep_from="2024-01-02")
    assert read() == [(1, 2, 10), (1, 3, 7), (2, 3, 1)] and store.partitions(spec.name) == ["2024-01-02", "2024-01-03"]
    left = {k.split("/")[1] for k in files(tmp_path, spec.name)}
    assert len(left) <= 4  # folders of old versions, and what the crash left, are gone


def test_a_writer_publishes_what_the_table_took(spark, tmp_path):
    store, said = Store(spark, str(tmp_path)), []
    write = L.table_writer(store, TABLES["users_history"], lambda rows, n: said.append(sorted(json.loads(r.value)["num_events"] for r in rows.collect())), partition_by="date_format(ts_start, 'yyyy-MM-dd')")
    rows = lambda *r: history(spark, *r).drop("seq_num")
    write(rows((1, 1, 5, 0), (2, 2, 6, 0)), 0)
    write(rows((1, 1, 7, 0)), 1)
    write(rows((1, 1, 7, 0)), 1)  # tried again: stored and said as before
    assert said == [[5, 6], [7], [7]] and sorted(r.num_events for r in store.read("users_history").collect()) == [6, 7]
    numbers = [r.seq_num for r in store.read("users_history").collect()]
    assert min(numbers) > 1_700_000_000_000_000  # above any number of a day long gone
    old = history(spark, (1, 1, 1, 5))
    write(old, 2)  # a version below the stored one is neither taken nor said
    assert said[-1] == [] and sorted(r.num_events for r in store.read("users_history").collect()) == [6, 7]


def test_days_are_kept_while_the_stream_runs_and_after_a_restart(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    day = 86400
    batches = [[raw(1, 0), raw(2, day)], [raw(3, 2 * day), raw(4, 2 * day + 5)], [raw(5, 4 * day)], [raw(6, 3 * day)]]
    feed(source, *batches[:2])
    store = Store(spark, str(tmp_path / "t"))

    def go(write):
        stream = X.typed(X.decode(X.raw_stream(spark, str(source), files_per_batch=1))).drop("event")
        stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()

    write, calls = L.days_writer(store, days=2), []

    def failing(batch, n):
        calls.append(n)
        write(batch, n)
        if n == 1 and calls.count(1) == 1:
            raise OSError("after the write, before the commit")

    with pytest.raises(Exception, match="before the commit"):
        go(failing)
    go(failing)
    assert calls == [0, 1, 1]
    ids = lambda: sorted(r.id for r in store.read("events").collect())
    assert ids() == [1, 2, 3, 4]
    for n, rows in enumerate(batches[2:], 2):
        (source / f"{n:03}.txt").write_text("\n".join(rows) + "\n")
        go(write)
    assert ids() == [3, 4, 5, 6] and {p[:10] for p in store.partitions("events")} == {"2024-01-03", "2024-01-04", "2024-01-05"}
    store.append("events", store.read("events").limit(0), 9)
    assert store.compact("events", "2024-01-05") == [] and ids() == [3, 4, 5, 6]


def test_appended_parts_become_one(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    one = lambda i: spark.createDataFrame([(i, "x")], "id long, day string")
    for i in range(4):
        store.append("t", one(i), i, "day")
    assert len(store.partitions("t")) == 4 and store.compact("t", "y") == ["x"] and store.partitions("t") == ["x"]
    assert sorted(r.id for r in store.read("t").collect()) == [0, 1, 2, 3]


def test_rankings_over_micro_batches_equal_one_call(spark, tmp_path):
    rng = random.Random(8)
    updates = [(rng.randrange(9000), rng.choice([None, 0, *range(6)])) for _ in range(500)]
    make = lambda part, start: spark.createDataFrame([("5m", k, v, start + i) for i, (k, v) in enumerate(part)], "window_size string, repo_id long, num_stars long, seq_num long")
    store, said = Store(spark, str(tmp_path)), []
    write = L.ranking_writer(store, "stars", "repo_id", "num_stars", publish=lambda rows, n: said.append([json.loads(r.value)["seq_num"] for r in rows.orderBy("place").collect()]))
    cuts = [0, 200, 320, 500]
    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
        write(make(updates[a:b], a), n)
        if n == 1:
            write(make(updates[a:b], a), n)
    want = [(k, v, *rest) for k, v, *rest in brute_log(updates)[0]]
    got = store.read("stars_log").select("window_size", "seq_num", "repo_id", "num_stars", *R.PLACES, *(f"old_{p}" for p in R.PLACES))
    assert log(got) == want
    assert said[1] == said[2] and [s for part in (said[0], said[1], said[3]) for s in part] == [r.seq_num for r in got.orderBy("seq_num").collect()]
    assert R.broken(got, "repo_id", "num_stars").count() == 0
