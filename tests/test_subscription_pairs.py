"""How many pairs the join of subscriptions makes."""

from pyspark.sql import functions as F

from forgepulse.plans.query import subscribed
from tests.test_subscriptions import SUBS


def joined(plan):
    """Rows out of each join of a plan that has run."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return joined(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return joined(plan.plan())
    children = plan.children()
    out = [n for i in range(children.size()) for n in joined(children.apply(i))]
    return [*out, plan.metrics().apply("numOutputRows").value()] if "Join" in name else out


def test_a_filter_that_most_rows_meet_makes_no_pairs(spark):
    """Of two filters the rarer one joins, be it the options or the range: pairs are matches, not users times events."""
    users, events = 300, 3000
    subs = [row for u in range(users) for row in ((f"s{u}", 0, "kind", ["watch"], None, None), (f"s{u}", 0, "user", [str(u)], None, None), (f"s{u}", 1, "kind", ["watch"], None, None), (f"s{u}", 1, "n", None, u, u + 1))]
    changes = spark.range(events).select("id", F.lit("watch").alias("kind"), (F.col("id") % users).alias("user"), (F.col("id") % users).alias("n"))
    got = subscribed(changes, spark.createDataFrame(subs, SUBS), "id")
    assert {(r.id, r.name) for r in got.collect()} == {(i, f"s{i % users}") for i in range(events)}
    assert max(joined(got._jdf.queryExecution().executedPlan())) <= 2 * events
