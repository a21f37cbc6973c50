"""What the archive job's plans do once for an event."""

import pytest

from forgepulse.operators import entities as N
from forgepulse.sources import events as X


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def raw(spark):
    return spark.createDataFrame([('{"id":"1"}',)], "raw string").repartition(3)


def test_an_event_is_parsed_once_and_above_the_deal(raw):
    told = plan(X.typed(X.decode(raw)))
    assert told.count("parseJson") == 1
    assert told.index("parseJson") < told.index("Repartition")


def test_mentions_take_an_event_apart_once(raw):
    for mentions in (N.user_mentions, N.repo_mentions):
        told = plan(mentions(X.sequenced(X.decode(raw))))
        assert told.count("parseJson") == 1 and told.count("try_variant_get(event#") <= 8  # the cast, and the reads of seq_num and created_at


def test_no_event_is_parsed_before_an_archive_is_dealt_out(spark, raw, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    told = []
    text = DataFrameWriter.text
    monkeypatch.setattr(DataFrameWriter, "text", lambda self, *a, **k: (told.append(plan(self._df)), text(self, *a, **k))[1])
    X.write_archive(spark.createDataFrame([('{"created_at":"2024-01-01T05:00:00Z"}',)], "raw string").repartition(3), str(tmp_path))
    assert told[0].count("parseJson") == 1
    assert told[0].index("parseJson") < told[0].index("Repartition ")


def test_objects_only_are_mentioned(spark):
    texts = [
        '{"seq_num":1,"actor":"u","payload":[1],"repo":{"id":3,"name":"a/b","topics":"x","license":[],"forks":null}}',
        '{"seq_num":2,"actor":{"id":5,"login":null},"payload":{"comment":7,"performed_via_github_app":{"owner":{"id":6}},"issue":{"user":"s","assignees":[3,{"id":"8"},{"login":"n"}]}}}',
    ]
    events = X.sequenced(X.decode(spark.createDataFrame([(t,) for t in texts], "raw string")))
    assert sorted((r.id, r.username) for r in N.user_mentions(events).collect()) == [(5, "null"), (8, None)]
    row = N.repo_mentions(events).collect()[0]
    assert (row.id, row.reponame, row.fullname, row.topics, row.license, row.fork_count) == (3, "b", "a/b", None, None, 0)


def test_an_archived_event_is_parsed_once_for_all_its_tables(spark, raw):
    from pyspark import StorageLevel

    from forgepulse.streaming import jobs as L

    once = L.archived_events(raw)
    assert dict(once.dtypes)["event"] == "variant"
    told = plan(once)
    assert told.count("parseJson") == 1
    once = once.persist(StorageLevel.DISK_ONLY)
    try:
        for mentions in (N.user_mentions, N.repo_mentions):
            assert "parseJson" not in plan(mentions(once)).split("InMemoryRelation")[0]
    finally:
        once.unpersist()


def test_mentions_and_fields_run_as_compiled_code(spark):
    raw = spark.createDataFrame([('{"id":"1"}',)], "raw string")  # no exchange: the plan is final
    events = X.sequenced(X.decode(raw))
    for rows in (N.user_mentions(events), N.repo_mentions(events), X.typed(X.decode(raw))):
        told = rows._jdf.queryExecution().executedPlan().toString()
        generated = [x for x in told.splitlines() if "Generate" in x]
        assert generated and all("*(" in x for x in generated)  # an operator of over 100 fields is interpreted
        stages = rows._jdf.queryExecution().debug().codegenToSeq().iterator()
        while stages.hasNext():
            assert stages.next()._3().maxMethodCodeSize() < 8000  # the virtual machine compiles no longer method


def test_texts_that_are_none_are_told_apart(spark):
    texts = [
        '{"seq_num":1,"actor":{"id":1,"login":"{x}","avatar_url":{"a":1},"html_url":null,"type":[1]},"repo":{"id":2,"name":null,"full_name":7,"html_url":"null","description":5,"language":"[c","topics":["a",null,{"b":1},2]}}',
        '{"seq_num":2,"repo":{"id":4,"name":"{a}/b","topics":["x",null,"y"],"language":{"n":1}}}',
        '{"seq_num":null,"id":"7","type":["PushEvent"],"payload":{"ref":null}}',
    ]
    decoded = X.decode(spark.createDataFrame([(t,) for t in texts], "raw string"))
    events = X.sequenced(decoded)
    assert [tuple(r) for r in N.user_mentions(events).collect()] == [(1, "{x}", "", "null", "", 1)]
    one, two = sorted(N.repo_mentions(events).collect(), key=lambda r: r.id)
    assert (one.reponame, one.fullname, one.html_url, one.descr, one.lang, one.topics) == ("null", "7", None, None, "[c", "a null  2")
    assert (two.reponame, two.fullname, two.lang, two.topics) == ("b", "{a}/b", None, "x null y")
    from forgepulse.functions import events as E

    parts = E.with_parts(decoded, ("type", "payload.ref", "payload.none"), ("id",), ("seq_num", "payload.ref", "payload.none"), ("type", "payload.ref"))
    assert [tuple(r.p) for r in parts.where("raw LIKE '%PushEvent%'").select(parts["_parts"].alias("p")).collect()] == [("", "null", "", 7, True, True, False, False, False)]


def test_a_table_of_one_partition_is_written_from_one_reading(spark, tmp_path, monkeypatch):
    from forgepulse.schema import TABLES
    from forgepulse.sources.tables import Store

    store = Store(spark, str(tmp_path))
    batch = spark.createDataFrame([(1, "a", None, None, None, 5)], "id long, username string, avatar_url string, html_url string, user_type string, seq_num long")
    kept, persist = [], type(batch).persist
    monkeypatch.setattr(type(batch), "persist", lambda self, *a, **k: (kept.append(self), persist(self, *a, **k))[1])
    assert store.upsert(batch, TABLES["users"]) is None
    store.upsert(batch.limit(0), TABLES["users"])
    assert [(r.id, r.username) for r in store.read("users").collect()] == [(1, "a")] and not kept


def test_raw_events_are_joined_not_formatted(spark, tmp_path):
    from forgepulse.queries import raw_events

    spark.sql("SELECT 11L AS event_id, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS ts, CAST(NULL AS BIGINT) AS user_id, 'view' AS event_type, '{\"k\": 3}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    rows = raw_events(spark, str(tmp_path))
    assert "format_string" not in plan(rows)
    start = '{"id":"11","seq_num":11,"type":"%s","created_at":"2024-01-01T00:00:00Z","actor":{"id":null,"login":"unull","avatar_url":"a11"},"repo":{"id":3,"name":"onull/r3","stargazers_count":1,"watchers":11,"topics":["x","y"]},"payload":{'
    (row,) = rows.collect()
    assert row.raw.startswith(start % row.raw.split('"type":"')[1].split('"')[0]) and row.raw.endswith("}}")
