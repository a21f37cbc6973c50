"""Places counted by slabs of times and of places, whatever lies across their ends."""

import numpy as np
import pytest

from forgepulse.operators import ranking as R

from tests.test_rankings import log
from tests.test_tables import brute_log


@pytest.mark.parametrize("size, times", [(0, 1), (1, 1), (200, 7), (300, 300), (50, 70_000)])
def test_sums_ahead_equal_all_pairs(size, times):
    draw = np.random.default_rng(size)
    t, d = draw.integers(0, times, size), draw.integers(-1, 2, size)
    assert R._before(t, d).tolist() == [int(d[:i][t[:i] < t[i]].sum()) for i in range(size)]


def test_a_point_isnt_dealt_out_by_level(spark):
    rows = spark.createDataFrame([("5m", i, i % 5, i % 3) for i in range(100)], "window_size string, seq_num long, id long, value long")
    plan = R.exact_changes(rows, "id", "value")._jdf.queryExecution().optimizedPlan().toString()
    assert "_level" not in plan and "sequence(" not in plan


def test_one_key_and_value_across_slabs(spark, monkeypatch):
    monkeypatch.setattr(R, "SMALL", 2)
    updates = [("24h" if i % 2 else "5m", i, (0, 0, 0, 1)[i // 2 % 4], (1, 1, 2, 0)[i // 2 % 4 - i // 8 % 2]) for i in range(80)]
    rows = spark.createDataFrame(updates, "window_size string, seq_num long, id long, value long")
    told = R.exact_changes(rows, "id", "value").checkpoint()
    for by in ("24h", "5m"):
        assert log(told.where(told.window_size == by)) == brute_log([u[2:] for u in updates if u[0] == by])[0]
