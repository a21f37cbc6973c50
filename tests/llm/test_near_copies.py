import random
import re

from forgepulse.llm.near_copies import keep_one_of_near

from .cases import awkward, empty, real

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute(rows):
    """The (doc_id, text) that stay, from all pairs; a null id is the least."""
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(AZ))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            if up[i] != up[j]:
                up[i] = up[j] = min(up[i], up[j])
                changed = True
    return [[rows[i] for i in range(len(rows)) if up[i] == r] for r in sorted(set(up))]


def check(df):
    groups = brute([(r.doc_id, r.text) for r in df.collect()])
    out = keep_one_of_near(df)
    assert out.columns == df.columns
    kept = [(r.doc_id, r.text) for r in out.collect()]
    assert len(kept) == len(groups)
    least = lambda g: -1 if any(i is None for i, _ in g) else min(i for i, _ in g)
    assert sorted(-1 if i is None else i for i, _ in kept) == sorted(map(least, groups))
    assert all(sum(row in g for row in kept) == 1 for g in groups)
    return groups


def planted():
    """Near copies at all similarities around the bound, a group of many near copies, rows without an id and with one id."""
    rng, rows = random.Random(3), []
    for i in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(120)]
        rows.append((10 * i, " ".join(words)))
        for k in range(1, 6):
            other = list(words)
            for at in rng.sample(range(120), k):
                other[at] = f"x{rng.randrange(5000)}"
            rows.append((10 * i + k, " ".join(other).title()))
    base = [f"b{i}" for i in range(200)]
    for i in range(60):
        other = list(base)
        for at in rng.sample(range(200), 4):
            other[at] = f"y{rng.randrange(5000)}"
        rows.append((1000 + i, " ".join(other)))
    own = [" ".join(f"{k}{i}" for i in range(40)) for k in "cdef"]
    return rows + [(None, own[0]), (None, own[1]), (None, own[1]), (2000, own[1]), (2001, own[2]), (2001, own[3])]


def test_stage_against_all_pairs(spark, small):
    groups = check(spark.createDataFrame(planted(), "doc_id long, text string"))
    assert any(1 < len(g) < 6 for g in groups)
    check(awkward(spark))
    check(real(spark, small))
    assert keep_one_of_near(empty(spark)).count() == 0


def test_pipeline_stage(spark, small):
    import corpus_pipeline

    df = spark.createDataFrame(planted(), "doc_id long, text string")
    rows = corpus_pipeline.near_dedup(spark, df, small).collect()
    groups = brute(planted())
    assert len(rows) == len(groups) and all(sum(tuple(r) in g for r in rows) == 1 for g in groups)
