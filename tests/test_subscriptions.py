import random

import numpy as np
from pyspark.sql import functions as F

from forgepulse.plans.query import intervals, subscribed

SUBS = "name string, branch int, field string, options array<string>, least long, below long"


def matches(changes, subs):
    """key and name by the plain reading of every filter."""
    out = set()
    for row in changes:
        by = {}
        for name, branch, field, options, least, below in subs:
            v = row[field]
            ok = v is not None and (str(v) in options if options is not None else isinstance(v, int) and (least is None or v >= least) and (below is None or v < below))
            by.setdefault((name, branch), []).append(ok)
        out |= {(row["id"], name) for (name, _), all_ in by.items() if all(all_)}
    return out


def test_ranges_are_made_of_intervals(spark):
    rng = random.Random(1)
    ends = [None, 0, 1, -1, 7, 8, 2**62, -(2**62), 2**63 - 1, -(2**63), *(rng.randrange(-(2**63), 2**63) for _ in range(6)), *(rng.randrange(-40, 40) for _ in range(10))]
    rows = [(a, b) for a in ends for b in ends]
    df = spark.createDataFrame(rows, "a long, b long").select("a", "b", intervals(F.col("a"), F.col("b")).alias("i"))
    for r in df.collect():
        assert len(r.i) <= 124
        for v in {*range(-45, 45), *(x + d for x in (r.a, r.b) if x is not None and abs(x) < 2**61 for d in (-1, 0, 1))}:
            inside = (r.a is None or v >= r.a) and (r.b is None or v < r.b)
            assert sum(v >> x.level == x.prefix for x in r.i) == inside, (r.a, r.b, v)


def test_branches_options_and_ranges(spark):
    rng = random.Random(2)
    changes = [{"id": i, "kind": rng.choice(["push", "watch", None]), "n": rng.choice([None, *range(-5, 30), 2**62 + 5, 2**63 - 1, -(2**63)]), "big": rng.randrange(10**12)} for i in range(120)]
    subs = []
    for s in range(60):
        for branch in range(rng.randrange(1, 3)):
            for field in rng.sample(["kind", "n", "big"], rng.randrange(1, 4)):
                if field == "kind":
                    subs.append((f"s{s}", branch, field, rng.choice([["push"], ["push", "watch", "push"], []]), None, None))
                else:
                    a, b = (rng.choice([None, rng.randrange(-6, 31) if field == "n" else rng.randrange(10**12)]) for _ in range(2))
                    subs.append((f"s{s}", branch, field, None, a, b))
    subs += [("far", 0, "n", None, 2**62 + 1, None), ("edge", 0, "n", None, 2**63 - 1, None), ("low", 0, "n", None, None, -(2**62))]
    frame = spark.createDataFrame([(c["id"], c["kind"], c["n"], c["big"]) for c in changes], "id long, kind string, n long, big long")
    got = {tuple(r) for r in subscribed(frame, spark.createDataFrame(subs, SUBS), "id").collect()}
    assert got == matches(changes, subs)
    assert subscribed(frame, spark.createDataFrame([], SUBS), "id").count() == 0


def test_a_hundred_thousand_ranges(spark):
    """Every value meets the ranges that hold it, and the join makes no pair more than its matches."""
    n, m = 100_000, 400
    subs = spark.range(n).select(F.concat(F.lit("s"), "id").alias("name"), F.lit(0).alias("branch"), F.lit("n").alias("field"), F.lit(None).cast("array<string>").alias("options"), (F.col("id") * 7919 % 1_000_003).alias("least"), (F.col("id") * 7919 % 1_000_003 + 1 + F.col("id") % 50).alias("below"))
    changes = spark.range(m).select("id", (F.col("id") * 2503 % 1_000_000).alias("n"))
    got = subscribed(changes, subs, "id").groupBy("id").count().collect()
    ids = np.arange(n)
    least = ids * 7919 % 1_000_003
    below = least + 1 + ids % 50
    want = {i: int(((least <= v) & (v < below)).sum()) for i, v in ((i, i * 2503 % 1_000_000) for i in range(m))}
    assert {r.id: r["count"] for r in got} == {i: c for i, c in want.items() if c}
    plan = subscribed(changes, subs, "id")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "prefix" in plan
