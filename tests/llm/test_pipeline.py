import re

import corpus_pipeline
from forgepulse.llm.quality_rules import keep_quality, quality_rules
from forgepulse.llm.simhash import keep_one_of_each, simhash_near_dedup

from .cases import awkward, empty, real

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_quality(text):
    text = text or ""
    w = WORD.findall(text)
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    again = {k for v in seen.values() if len(v) > 1 for i in v for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def test_quality_base(spark, small):
    for df in (awkward(spark), real(spark, small)):
        got = sorted(str(tuple(r)[:7]) for r in quality_rules(df).collect())
        want = []
        for r in df.collect():
            b = brute_quality(r.text)
            want.append(str((r.doc_id, *b, b[0] < 10 or 100 * b[4] > 20 * b[0])))
        assert got == sorted(want)
    assert quality_rules(empty(spark)).count() == 0


def test_quality_keeps_clean_and_rejects_junk(spark, small):
    df = real(spark, small.replace("sf0.001", "sf0.01"))
    got = {r.doc_id: r for r in quality_rules(df).collect()}
    labels = spark.read.parquet(f"{small.replace('sf0.001', 'sf0.01')}/labels.parquet").collect()
    assert all(got[r.doc_id].kept for r in labels if r.quality == 1 and not got[r.doc_id].base_failed)
    junk = [r.doc_id for r in labels if r.quality == 0]
    assert sum(not got[i].kept for i in junk) >= 0.95 * len(junk)
    kept = {r.doc_id: r.text for r in keep_quality(df).collect()}
    assert kept == {i: r.cleaned for i, r in got.items() if r.kept}


def test_one_of_each_stays(spark, small):
    for df in (awkward(spark), real(spark, small)):
        rows = simhash_near_dedup(df).collect()
        out = keep_one_of_each(df)
        assert out.columns == df.columns
        kept = [r.doc_id for r in out.collect()]
        assert sorted(map(str, kept)) == sorted({str(r.component_id) for r in rows})
    assert keep_one_of_each(empty(spark)).count() == 0


def test_stages_on_awkward_and_empty_input(spark, small):
    for start in (awkward(spark), empty(spark)):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, small)
            rows = out.collect()
            if name != "packing":
                assert out.columns == start.columns
                docs = spark.createDataFrame(rows, out.schema)
    assert out.columns[0] == "doc_id"


def test_run(spark, small):
    rows = corpus_pipeline.run(spark, small).collect()
    fills = {}
    for r in rows:
        fills[r.sequence_id] = fills.get(r.sequence_id, 0) + r.length
    assert rows and max(fills.values()) <= 1024


def test_clashing_columns_stay(spark):
    """Columns that are named like those that the stages make for themselves."""
    from pyspark.sql import functions as F

    from forgepulse.llm.mixing import mix
    from forgepulse.llm.near_copies import keep_one_of_near

    names = ("dk", "_dk", "row_key", "_row_key", "cleaned", "_cleaned", "row", "_row", "label", "sig", "n")
    df = awkward(spark).drop("n").withColumns({n: F.concat(F.lit(f"{n} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for n in names})
    for keep in (keep_quality, keep_one_of_each, keep_one_of_near, mix):
        out = keep(df)
        assert out.columns == df.columns
        rows = out.collect()
        assert rows and all(r[n] == f"{n} {'-' if r.doc_id is None else r.doc_id}" for r in rows for n in names)
