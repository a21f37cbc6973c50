import random

import numpy as np
import pytest

from forgepulse import queries as Q
from forgepulse.operators.profile import exact_quantiles

SHARES = {"p90": 0.9, "p99": 0.99, "p999": 0.999, "half": 0.5, "least": 0.0, "most": 1.0}


def test_quantiles_are_exact(spark):
    rng = random.Random(2)
    for values in ([rng.choice([0.0, 0.0, rng.random() * 9]) for _ in range(3001)], [2.5], [1.0, 4.0], [3.0] * 50):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
        got = exact_quantiles(df, "x", SHARES, blocks=7).first()
        assert [got[k] for k in SHARES] == pytest.approx([np.quantile(values, q) for q in SHARES.values()])
    assert set(exact_quantiles(df.where("false"), "x", SHARES).first()) == {None}


def test_out_of_orderness_holds_no_map_of_all_delays(spark, small):
    plan = Q.queries()["out_of_orderness"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan
