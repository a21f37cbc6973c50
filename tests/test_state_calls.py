"""How much a call of the stateful jobs does: frames told and state read, whatever the number of ids or seconds."""

import random

import pandas as pd
from pyspark.sql.types import LongType

from forgepulse.streaming import jobs as L
from tests.test_stateful import Clock, Held

COLUMNS = ["id", "created_at", "seq_num"]


def sights(rows):
    return pd.DataFrame({"id": [i for i, _, _ in rows], "created_at": pd.to_datetime([t for _, t, _ in rows], unit="s"), "seq_num": [n for _, _, n in rows]})


def test_a_bucket_remembers_each_of_its_ids_and_is_read_once():
    """Batches of sights against a plain memory by id; a call reads one value and tells one frame."""
    rng, ms, behind = random.Random(8), 60_000, 5_000_000
    held, plain, want, got, n = Held(), {}, [], [], 0
    job = L.Seen(LongType(), COLUMNS, ms, behind)
    job.init(held)
    for batch in range(40):
        clock = 10_000 + 20 * batch
        mark = Clock(clock - behind // 1000)
        rows = [(rng.randrange(300), clock + rng.randrange(-30, 30), n + i) for i in range(150)]
        n += 150
        rng.shuffle(rows)
        for i in sorted({i for i, _, _ in rows}):
            mine = [r for r in rows if r[0] == i]
            if i not in plain:
                want.append(min(r[2] for r in mine))
            plain[i] = max(plain.get(i, 0), max(clock * 1000, *(t * 1000 for _, t, _ in mine)) + ms)
        held.reads = 0
        frames = list(job.handleInputRows((1,), iter([sights(rows[:70]), sights(rows[70:])]), mark))
        assert len(frames) <= 1 and held.reads <= 1 and len(held.timers) == 1
        got += [s for f in frames for s in f["seq_num"]]
        if min(held.timers) < mark.getCurrentWatermarkInMs():
            list(job.handleExpiredTimer((1,), mark, None))
        plain = {i: u for i, u in plain.items() if u >= clock * 1000}
    assert sorted(got) == sorted(want) and len(got) > 300
    list(job.handleExpiredTimer((1,), Clock(20_000), None))
    assert not held.values and not held.timers  # nothing is left of the bucket


def test_a_timer_tells_all_its_seconds_in_one_frame():
    held = Held()
    job = L.SlidingCounts("k", LongType(), {"5m": 300, "1h": 3600})
    job.init(held)
    list(job.handleInputRows((1,), iter([pd.DataFrame({"created_at": pd.to_datetime([7 * i for i in range(400)], unit="s")})]), Clock(0)))
    frames = list(job.handleExpiredTimer((1,), Clock(20_000), None))
    assert len(frames) == 1 and len(frames[0]) == 4 * 400
    assert frames[0]["n"].tolist()[-1] == 0 and frames[0].groupby("window_size")["n"].max().to_dict() == {"5m": 43, "1h": 400}


def test_rows_in_any_order_are_placed_in_one_walk():
    """Frames that each span all the time, as rows of many files come: as much work as sorted rows, and the same told."""
    walked = []

    class Counted(L.SlidingCounts):
        def _chunk(self, at):
            walked.append(at)
            return super()._chunk(at)

    def told(seconds, size):
        held = Held()
        job = Counted("k", LongType(), {"5m": 300, "1h": 3600})
        job.init(held)
        walked.clear()
        frames = [pd.DataFrame({"created_at": pd.to_datetime(seconds[i : i + size], unit="s")}) for i in range(0, len(seconds), size)]
        list(job.handleInputRows((1,), iter(frames), Clock(0)))
        steps = len(walked)
        out = pd.concat(list(job.handleExpiredTimer((1,), Clock(20_000_000), None)))
        return steps, out.values.tolist()

    seconds = [4000 * i + 7 * (i % 3) for i in range(1200)]
    mixed = list(seconds)
    random.Random(5).shuffle(mixed)
    sorted_steps, want = told(seconds, len(seconds))
    steps, got = told(mixed, 100)
    assert got == want and len(got) == 4 * len(seconds)
    assert steps <= sorted_steps + len(seconds) <= 6 * len(seconds)
