"""What subscriptions match in all: rows are counted by groups, each once."""

import random

from forgepulse import queries as Q
from forgepulse.plans.query import subscribed_totals

from .compare import difference
from .test_subscription_pairs import joined
from .test_subscriptions import SUBS, matches


def events(spark, folder, rows):
    table = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, k long")
    table.selectExpr("event_id", "timestamp_ntz '2024-01-01 00:00:00' AS ts", "user_id", "event_type", "1D AS value", "to_json(struct(k)) AS props").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_pairs_are_users_times_repositories_not_times_events(spark, tmp_path):
    """Two hundred users follow the same ten repositories of 4,000 pushes."""
    users, pushes = 200, 4000
    rows = [(i, i % users * 90, "click", i % 10) for i in range(pushes)] + [(pushes + i, i % users * 90, "purchase", None) for i in range(400)]
    folder = events(spark, tmp_path, rows)
    got = Q.queries()["subscription_join"](spark, folder)
    assert difference(got, Q.oracle_sql()["subscription_join"], folder) == ""
    assert 0 < max(joined(got._jdf.queryExecution().executedPlan())) <= 10 * users


def test_odd_events(spark, tmp_path):
    """Users and repositories that are null or negative, ids that are met again."""
    rng = random.Random(4)
    rows = [(rng.randrange(300), rng.choice([None, -95, -1, 0, 1, 89, 90, 500]), rng.choice(["click", "purchase", "view", None]), rng.choice([None, -5, -4, 0, 1, 2, 50, 90])) for _ in range(600)]
    folder = events(spark, tmp_path, rows)
    assert difference(Q.queries()["subscription_join"](spark, folder), Q.oracle_sql()["subscription_join"], folder) == ""


def test_branches_that_meet_and_that_stay_apart(spark):
    rng = random.Random(5)
    changes = [{"id": i, "kind": rng.choice(["push", "watch", None]), "n": rng.choice([None, *range(-5, 30)]), "big": rng.randrange(40), "worth": rng.choice([None, *range(9)])} for i in range(200)]
    subs = []
    for s in range(60):
        for branch in range(rng.randrange(1, 4)):
            for field in rng.sample(["kind", "n", "big", "gone"], rng.randrange(1, 4)):
                if field == "kind":
                    subs.append((f"s{s}", branch, field, rng.choice([["push"], ["watch"], ["push", "watch", "push"], [], [None]]), None, None))
                else:
                    a = rng.choice([None, rng.randrange(-6, 31)])
                    subs.append((f"s{s}", branch, field, None, a, rng.choice([None, (a or 0) + rng.randrange(12)])))
    subs += [("two", 0, "n", None, 0, 5), ("two", 1, "n", None, 5, 9), ("two", 2, "kind", ["push"], None, None), ("no", 0, "gone", None, None, None), ("rest", 0, "n", None, 3, None), ("rest", 1, "n", None, None, 3)]
    want = {}
    for i, name in matches([c | {"gone": None} for c in changes], subs):
        n, total = want.get(name, (0, None))
        worth = changes[i]["worth"]
        want[name] = n + 1, total if worth is None else (total or 0) + worth
    frame = spark.createDataFrame([tuple(c.values()) for c in changes], "id long, kind string, n long, big long, worth long")
    got = subscribed_totals(frame, spark.createDataFrame(subs, SUBS), ["worth"])
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == want and got.columns == ["name", "n", "worth"]
    assert subscribed_totals(frame, spark.createDataFrame([], SUBS), ["worth"]).count() == 0
    assert subscribed_totals(frame, spark.createDataFrame(subs[-3:-2], SUBS), ["worth"]).count() == 0
