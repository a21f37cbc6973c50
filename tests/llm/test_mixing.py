import re

import pytest

from forgepulse.llm.mixing import mix, mixing_plan

from .cases import awkward, empty, real

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= 2 * sizes[s]}
        if not over:
            out |= {s: level * weight[s] for s in free}
            break
        for s in over:
            out[s] = 2 * sizes[s]
            left -= 2 * sizes[s]
        free -= over
    return out


def test_targets_and_taken(spark, small):
    for df in (awkward(spark), real(spark, small)):
        sizes = {}
        for r in df.collect():
            sizes[r.source] = sizes.get(r.source, 0) + len(WORD.findall(r.text or ""))
        want = brute_targets(sizes)
        source = {(r.doc_id, len(WORD.findall(r.text or ""))): r.source for r in df.collect()}
        rows = mixing_plan(df).collect()
        assert len(rows) == df.count()
        taken = {}
        for r in rows:
            s = source[r.doc_id, r.size]
            assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r.size
            taken[s] = taken.get(s, 0) + r.taken
        assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
        again = mixing_plan(df.repartition(3)).collect()
        assert sorted(map(str, [r[:6] for r in rows])) == sorted(map(str, [r[:6] for r in again]))
    assert mixing_plan(empty(spark)).count() == 0


def test_mix_takes_what_the_plan_says(spark, small):
    for df in (awkward(spark), real(spark, small)):
        plan = mixing_plan(df).collect()
        out = mix(df)
        assert out.columns == df.columns
        words = sum(len(WORD.findall(r.text or "")) for r in out.collect())
        assert words == sum(r.taken for r in plan)
    assert mix(empty(spark)).count() == 0


def test_equal_rows_take_what_the_plan_says(spark):
    import random

    for seed in range(4):
        rng = random.Random(seed)
        rows = []
        for i in range(rng.randint(3, 12)):
            rows += [(rng.choice([None, i, 1]), " ".join("w" * rng.randint(0, 9)), rng.choice(["a", "b", None]))] * rng.choice([1, 1, 2, 7])
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
        plan = mixing_plan(df).collect()
        got = [len(WORD.findall(r.text)) for r in mix(df).collect()]
        assert sum(got) == sum(r.taken for r in plan)
    seven = spark.createDataFrame([(1, "one two three four five six seven eight nine", "a")] * 7 + [(2, " ".join("w" * 30), "b")], "doc_id long, text string, source string")
    plan = sum(r.taken for r in mixing_plan(seven).collect() if r.doc_id == 1)
    assert sum(len(WORD.findall(r.text)) for r in mix(seven).collect() if r.doc_id == 1) == plan
