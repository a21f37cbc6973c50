import random

from pyspark.sql import functions as F

from forgepulse.operators import ranking as R
from tests.test_tables import RANKED, brute_log


def frame(spark, updates, start=0):
    return spark.createDataFrame([("5m", start + i, k, v) for i, (k, v) in enumerate(updates)], RANKED)


def log(rows):
    return [tuple(r)[2:] for r in rows.orderBy("seq_num").collect()]


def test_batches_start_from_the_state(spark):
    """Three batches, each from the state of those before it, give the log of one call over all."""
    rng = random.Random(5)
    updates = [(f"id{rng.randrange(25):02}", rng.choice([None, 0, *range(9)])) for _ in range(400)]
    want, _ = brute_log(updates)
    got, at = [], 0
    state = R.RankingState.of(frame(spark, []), "id", "value")
    for n in (150, 200, 50):
        batch = frame(spark, updates[at : at + n], at)
        got += log(R.exact_changes(batch, "id", "value", state=state))
        state = state.after(batch, "value")
        at += n
    assert got == want
    points = {r.id: r.value for r in state.points.collect()}
    assert points == brute_log(updates)[1]
    made = R.RankingState.of(state.points, "id", "value")
    assert sorted(made.counts.collect()) == sorted(state.counts.select(*made.counts.columns).collect())


def test_large_ties_and_blocks_of_whole_numbers(spark, monkeypatch):
    """Keys in many blocks, nine in ten with one value, and tie groups of large blocks cut by ranges."""
    monkeypatch.setattr(R, "SMALL", 3)
    rng = random.Random(6)
    keys = [rng.randrange(-40_000, 60_000) for _ in range(120)]
    updates = [(rng.choice(keys), 1 if rng.random() < 0.9 else rng.choice([None, 2, 5])) for _ in range(600)]
    want, _ = brute_log(updates)
    make = lambda part, start: spark.createDataFrame([("5m", start + i, k, v) for i, (k, v) in enumerate(part)], "window_size string, seq_num long, id long, value long")
    whole = make(updates, 0)
    assert log(R.exact_changes(whole, "id", "value")) == want
    first, second = make(updates[:350], 0), make(updates[350:], 350)
    state = R.RankingState.of(make([], 0), "id", "value").after(first, "value")
    assert log(R.exact_changes(second, "id", "value", state=state)) == want[len(brute_log(updates[:350])[0]) :]


def test_a_tie_group_is_cut_into_even_tasks(spark):
    rows = spark.range(4000).select(F.lit("5m").alias("window_size"), (F.col("id") * 7919 % 4001).alias("user_id"), F.when(F.col("id") % 10 == 0, F.col("id") % 70).otherwise(1).alias("num_events"), F.col("id").alias("seq_num"))
    placed = R.numbered(rows.where("num_events > 0").select("window_size", "user_id", "num_events"), ["window_size", F.desc("num_events"), "user_id"])
    sizes = [r["count"] for r in placed.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]
    got = {(r.user_id, r.row_number, r.rank, r.max_rank) for r in R.snapshot(rows, "user_id", "num_events").collect()}
    part = "PARTITION BY window_size ORDER BY num_events DESC"
    rows.createOrReplaceTempView("tied")
    want = spark.sql(f"SELECT user_id, row_number() OVER ({part}, user_id) - 1 AS a, rank() OVER ({part}) - 1 AS b, count(*) OVER ({part} RANGE UNBOUNDED PRECEDING) AS c FROM tied WHERE num_events > 0")
    assert got == {tuple(r) for r in want.collect()}


def test_broken_logs_are_told_by_row(spark):
    rng = random.Random(7)
    updates = [(f"id{rng.randrange(12)}", rng.choice([None, *range(7)])) for _ in range(200)]
    good = R.exact_changes(frame(spark, updates), "id", "value").checkpoint()
    assert R.broken(good, "id", "value").count() == 0
    at = [r.seq_num for r in good.where("row_number IS NOT NULL AND old_row_number IS NOT NULL").orderBy("seq_num").collect()]
    wrong = good.withColumn("row_number", F.when(F.col("seq_num") == at[3], F.col("row_number") + 40).otherwise(F.col("row_number")))
    assert [(r.seq_num, r.problem) for r in R.broken(wrong, "id", "value").collect()] == [(at[3], "row_number is outside its tie group")]
    moved = good.withColumns({c: F.when(F.col("seq_num") == at[5], F.col(c) + 1).otherwise(F.col(c)) for c in ("old_row_number", "old_rank", "old_max_rank")})
    assert [(r.seq_num, r.problem) for r in R.broken(moved, "id", "value").collect()] == [(at[5], "old places aren't where the log had left the key")]
    fresh = good.withColumns({c: F.when(F.col("seq_num") == at[7], None).otherwise(F.col(c)) for c in ("old_row_number", "old_rank", "old_max_rank")})
    assert [(r.seq_num, r.problem) for r in R.broken(fresh, "id", "value").collect()] == [(at[7], "a ranked key has no old places")]
    lost = good.where(F.col("seq_num") != at[9])  # a change is missing: its key's next one, and places that it moved, don't fit
    assert R.broken(lost, "id", "value").count() > 0
