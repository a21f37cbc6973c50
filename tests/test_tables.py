import json
import random

import pytest
from pyspark.sql import functions as F

from forgepulse.operators import history as H
from forgepulse.operators import ranking as R
from forgepulse.operators import sliding as S
from forgepulse.operators import versioning as V
from forgepulse.plans.query import Filter, Query
from forgepulse.schema import TABLES, Field, TableSpec
from forgepulse.sources import tables as T

RANKED = "window_size string, seq_num long, id string, value long"


def changes(spark, updates):
    rows = spark.createDataFrame([("5m", i, k, v) for i, (k, v) in enumerate(updates)], RANKED)
    return [tuple(r)[2:] for r in R.exact_changes(rows, "id", "value").orderBy("seq_num").collect()]


@pytest.mark.parametrize(
    ("updates", "rows"),
    [
        ([("m", 7)], [("m", 7, 0, 0, 1, None, None, None)]),
        ([("n", 0)], []),
        ([("m", 7), ("n", 12), ("k", 12), ("m", 13)], [("m", 7, 0, 0, 1, None, None, None), ("n", 12, 0, 0, 1, None, None, None), ("k", 12, 0, 0, 2, None, None, None), ("m", 13, 0, 0, 1, 2, 2, 3)]),
        ([("A", 5), ("B", 5), ("A", 0), ("B", 5)], [("A", 5, 0, 0, 1, None, None, None), ("B", 5, 1, 0, 2, None, None, None), ("A", 0, None, None, None, 0, 0, 2), ("B", 5, 0, 0, 1, 0, 0, 1)]),
    ],
)
def test_ranking_changes(spark, updates, rows):
    assert changes(spark, updates) == rows


def brute_log(updates):
    """One update at a time, all places counted anew."""
    values, out = {}, []

    def places(k):
        if k not in values:
            return None, None, None
        above = sum(v > values[k] for v in values.values())
        tied = sorted(n for n, v in values.items() if v == values[k])
        return above + tied.index(k), above, above + len(tied)

    for k, v in updates:
        old = places(k)
        values.pop(k, None)
        if v is not None and v > 0:
            values[k] = v
        new = places(k)
        if new[0] is not None or old[0] is not None:
            out.append((k, v, *new, *old))
    return out, values


def test_random_updates_equal_one_at_a_time(spark):
    rng = random.Random(0)
    updates = [(f"id{rng.randrange(16)}", rng.choice([None, *range(12)])) for _ in range(700)]
    want, values = brute_log(updates)
    assert changes(spark, updates) == want
    frame = spark.createDataFrame([("5m", i, k, v) for i, (k, v) in enumerate(updates)], RANKED)
    got = R.replay(R.exact_changes(frame, "id", "value"), "id", "value").orderBy("row_number").collect()
    assert [(-r.value, r.id) for r in got] == sorted((-v, k) for k, v in values.items())


def brute_changes(rows, sizes):
    ends = sorted((k, t + 1) for k, t in rows)
    out = {}
    for k in {k for k, _ in ends}:
        for n, s in sizes.items():
            times = sorted({x for kk, e in ends if kk == k for x in (e, e + s)})
            last = 0
            for t in times:
                now = sum(1 for kk, e in ends if kk == k and t - s < e <= t)
                if now != last:
                    out[n, k, t] = now
                last = now
    return out


def test_sliding_changes_equal_the_timers(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.randrange(200)) for _ in range(60)]
    sizes = {"s": 10, "l": 60}
    df = spark.createDataFrame([(k, t) for k, t in rows], "key string, t long").select("key", F.timestamp_micros(F.col("t") * 1_000_000 + 250_000).cast("timestamp_ntz").alias("created_at"))
    got = {(r.window_size, r.key, int((r.changed_at - __import__("datetime").datetime(1970, 1, 1)).total_seconds())): r.num_events for r in S.changes(df, "key", sizes=sizes).collect()}
    assert got == brute_changes(rows, sizes)


def test_trending_scores(spark):
    updates = [("5m", 10), ("1h", 5), ("6h", 2), ("24h", 1), ("5m", 0), ("1h", 0)]
    rows = spark.createDataFrame([(1, w, i, n) for i, (w, n) in enumerate(updates)], "repo_id long, window_size string, changed_at long, num_stars long")
    assert [r.trending_score for r in S.trending_changes(rows).orderBy("changed_at").collect()] == [100, 125, 129, 130, 30, 5]


def test_store_is_idempotent(spark, tmp_path):
    store, spec = T.Store(spark, str(tmp_path)), TABLES["users_live"]
    batch = lambda *rows: spark.createDataFrame(rows, "window_size string, user_id long, num_events long, seq_num long")
    first = batch(("5m", 1, 4, 1), ("5m", 2, 5, 1))
    second = batch(("5m", 1, 0, 2), ("5m", 2, 9, 1), ("5m", 3, 1, 2))
    for b in (first, second, second):
        store.upsert(b, spec, partition_by="window_size")
    assert sorted((r.user_id, r.num_events) for r in store.read("users_live").collect()) == [(2, 5), (3, 1)]


def test_per_field_upsert(spark, tmp_path):
    store, spec = T.Store(spark, str(tmp_path)), TableSpec("t", (Field("id", int, "key"), Field("a", str), Field("b", str), Field("seq_num", int)), per_field=True)
    for row in ((1, "x", None, 5), (1, None, "y", 3), (1, "z\0", "w", 4)):
        store.upsert(spark.createDataFrame([row], "id long, a string, b string, seq_num long"), spec)
    r = store.read("t").first()
    assert (r.a, r.b, r.a_seq_num, r.b_seq_num, r.seq_num) == ("x", "w", 5, 4, 5)


def test_topic_rows(spark):
    spec = TableSpec("t", (Field("id", int, "key"), Field("name", str, "key"), Field("at", str), Field("seq_num", int)))
    df = spark.createDataFrame([(123, "te\"st", 1)], "id long, name string, seq_num long").withColumn("at", F.lit("2023-01-01 10:00:00").cast("timestamp_ntz"))
    row = T.topic_rows(df, spec).first()
    assert json.loads(row.key) == [123, 'te"st'] and json.loads(row.value) == {"id": 123, "name": 'te"st', "at": "2023-01-01T10:00:00Z", "seq_num": 1}
    with pytest.raises(Exception, match="seq_num is null"):
        T.topic_rows(df.withColumn("seq_num", F.lit(None).cast("long")), spec).collect()


PEOPLE = "name string, age long, active boolean, seq_num long"
PERSON = TableSpec("p", (Field("name", str, "key", 100), Field("age", int, "indexed", 5), Field("active", bool), Field("seq_num", int)), 1000, ranking=True)


def test_filters(spark):
    df = spark.createDataFrame([("Alice", 25, True, 1), (None, None, None, 2)], PEOPLE)
    count = lambda q: q.live(df).count()
    q = Query(PERSON)
    assert count(q) == 2 and count(q.none()) == 0
    assert count(q.where("name", "Alice").where("age", start=20, end=30).where("active", True)) == 1
    assert count(q.where("age", start=25, end=25)) == 0 and count(q.where("age", start=25, end=25, inclusive=True)) == 1
    assert [count(q.where("name", contains=s)) for s in ("lic", "ali", "ALI", "x%")] == [1, 1, 1, 0]
    assert count(q.where("name", None)) == 1 and count(q.where("name")) == 0 and count(q.where("name", "x").or_().where("name", None)) == 1


def test_guards():
    q = Query(PERSON)
    for bad in (lambda: q.where("name", 1), lambda: q.where("age", "x"), lambda: q.where("age", contains="1"), lambda: q.where("nothing", 1), lambda: q.check_read(), lambda: q.where("active", True).check_read(), lambda: q.limit(2000).check_read()):
        with pytest.raises(ValueError):
            bad()
    assert q.where("age", start=10, end=110).estimate() == 500 and q.where("name", "a").estimate() == 100 and q.where("name", "a").where("age", start=0, end=2).estimate() == 10
    assert q.where("name", "a").or_().where("age", 1).estimate() == 105 and q.estimate() is None
    one = Query(TABLES["users_ranking"]).where("user_id", 1)
    assert one.point() and not one.or_().where("user_id", 2).point() and not Query(TABLES["users_ranking"]).where("row_number", start=0, end=1).point()
    assert Filter(options=(None,)).options == (None,)


def test_gap_fill_and_downsample(spark):
    df = spark.createDataFrame([("k", 1, 5), ("k", 3, 2)], "kind string, b long, n long").select("kind", F.timestamp_micros(F.col("b") * 10_000_000).cast("timestamp_ntz").alias("ts_start"), "n")
    last = F.timestamp_micros(F.lit(50_000_000)).cast("timestamp_ntz")
    rows = H.gap_filled(df, "kind", "n", last, 6, 10)
    assert [r.y for r in rows.orderBy("place").collect()] == [0, 5, 0, 2, 0, None]
    closed = H.gap_filled(df, "kind", "n", last, 6, 10, open_bucket=False)
    assert [r.y for r in H.downsampled(closed, "kind", 6, 4).orderBy("back").collect()] == [2, 5]
    assert [r.y for r in H.downsampled(rows, "kind", 6, 4).orderBy("back").collect()] == [None, 5]


def test_points_of_many_or_few(spark):
    live = spark.createDataFrame([("5m", i, i % 7, 1) for i in range(50)], "window_size string, user_id long, num_events long, seq_num long")
    wanted = spark.range(0, 50, 3).select(F.col("id").alias("user_id"))
    few, many = R.points(live, wanted, "user_id", "num_events"), R.points(live, wanted, "user_id", "num_events", limit=2)
    assert sorted(few.collect()) == sorted(many.collect()) and few.count() == 14


def test_redundant_updates(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "b", 3), (1, None, 4), (1, "c", 4)], "id long, f string, seq_num long")
    assert sorted(r.seq_num for r in V.drop_redundant(rows, ["id"], ["f"]).collect()) == [1, 2, 3, 4]
    assert [(r.f, r.seq_num) for r in V.drop_redundant(rows, ["id"], ["f"], ignore_version=True).orderBy("seq_num").collect()] == [("a", 1), ("b", 2), ("c", 4)]
