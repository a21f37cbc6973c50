"""Joins of rankings merge sorted sides: no side is sent to all through the driver because it is small when packed."""

import re

from pyspark.sql import functions as F

from forgepulse.operators import ranking as R


def updates(spark, start=0):
    row = F.col("id") + start
    return spark.range(2000).select(F.lit("5m").alias("window_size"), row.alias("seq_num"), (F.col("id") % 97).alias("repo_id"), (row * 31 % 13).alias("num_stars"))


def sent(rows):
    """Keys of joins whose one side the engine chose to send to all; sides of a row a partition or a ranking are sent on purpose."""
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [k for k in re.findall(r"BroadcastHashJoin \[([^\]]*)\]", plan) if not re.fullmatch(r"(_part|window_size)#\w+", k)]


def test_the_log_of_a_ranking_sends_nothing_to_all(spark):
    log = R.exact_changes(updates(spark), "repo_id", "num_stars")
    assert sent(log) == []
    state = R.RankingState.of(log.limit(0), "repo_id", "num_stars").after(updates(spark), "num_stars")
    assert sent(R.exact_changes(updates(spark, 2000), "repo_id", "num_stars", state=state)) == []


def test_the_check_of_a_log_sends_nothing_to_all(spark):
    log = R.exact_changes(updates(spark), "repo_id", "num_stars").checkpoint()
    assert sent(R.broken(log, "repo_id", "num_stars")) == []


def test_a_replay_sends_no_tie_groups_to_all(spark):
    log = R.exact_changes(updates(spark), "repo_id", "num_stars").checkpoint()
    assert sent(R.replay(log, "repo_id", "num_stars")) == []
