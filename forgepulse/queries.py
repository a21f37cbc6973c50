"""Queries of the activity operators over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import events as E
from .operators import entities as N
from .operators import history as H
from .operators import profile as P
from .operators import ranking as R
from .operators import sliding as S
from .operators import versioning as V
from .plans import enrich as J
from .plans.query import Filter, Query, matched, snapshot_plus_changes
from .schema import KINDS, TABLES, WINDOW_SIZES
from .sources import events as X
from .sources import tables as T

#: The moment of the snapshots.
AS_OF = "2024-01-20 12:00:00"
EARLIER = "2024-01-20 06:00:00"

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    _queries[name], _sql[name] = run, sql


def _ev(spark: SparkSession, d: str) -> DataFrame:
    return X.from_table(spark, d)


EV = """WITH ev AS (SELECT event_id AS id, ts AS created_at, CASE event_type WHEN 'click' THEN 'push' WHEN 'purchase' THEN 'watch' WHEN 'signup' THEN 'create_repo'
 WHEN 'view' THEN 'fork' WHEN 'error' THEN 'issue_open' ELSE 'other' END AS kind, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS repo_id, event_id AS seq_num FROM events),
 fan AS (SELECT * FROM ev UNION ALL SELECT id, created_at, 'all', user_id, repo_id, seq_num FROM ev),
 sizes AS (SELECT * FROM (VALUES ('5m', 300), ('1h', 3600), ('6h', 21600), ('24h', 86400)) t(window_size, s))"""
ORDER = "list_position([" + ", ".join(f"'{k}'" for k in KINDS) + "], kind)"
#: name: key, metric, Spark rows, SQL rows.
ENTITIES: dict[str, tuple[str, str, Callable[[DataFrame], DataFrame], str]] = {
    "counts": ("kind", "num_events", lambda e: e, "fan"),
    "users": ("user_id", "num_events", lambda e: e, "ev"),
    "repos": ("repo_id", "num_events", lambda e: e, "ev"),
    "stars": ("repo_id", "num_stars", H.stars, "(SELECT * FROM ev WHERE kind = 'watch')"),
}


def _live(name: str, as_of: str = AS_OF) -> Callable[[SparkSession, str], DataFrame]:
    key, metric, rows, _ = ENTITIES[name]
    return lambda s, d: S.snapshot(rows(_ev(s, d)), key, as_of, metric)


def _live_sql(name: str, as_of: str = AS_OF) -> str:
    key, metric, _, rows = ENTITIES[name]
    return f"SELECT window_size, {key}, count(*) AS {metric}, max(seq_num) AS seq_num FROM {rows} e, sizes WHERE created_at < TIMESTAMP '{as_of}' AND created_at >= TIMESTAMP '{as_of}' - s * INTERVAL 1 SECOND GROUP BY window_size, {key}"


def _trend_sql(as_of: str = AS_OF) -> str:
    return f"SELECT repo_id, CAST(sum(num_stars * CASE window_size WHEN '5m' THEN 10 WHEN '1h' THEN 5 WHEN '6h' THEN 2 ELSE 1 END) AS BIGINT) AS trending_score, max(seq_num) AS seq_num FROM ({_live_sql('stars', as_of)}) GROUP BY repo_id"


def _rank_sql(live: str, key: str, metric: str, by: str | None) -> str:
    part, tie = (f"PARTITION BY {by}" if by else ""), ORDER if key == "kind" else key
    return f"""SELECT {by + ', ' if by else ''}{key}, {metric}, row_number() OVER ({part} ORDER BY {metric} DESC, {tie}) - 1 AS row_number, rank() OVER ({part} ORDER BY {metric} DESC) - 1 AS rank,
 count(*) OVER ({part} ORDER BY {metric} DESC RANGE UNBOUNDED PRECEDING) AS max_rank, max(seq_num) OVER ({part}) AS seq_num FROM ({live}) WHERE {metric} > 0"""


def _trending(s: SparkSession, d: str, as_of: str = AS_OF) -> DataFrame:
    return S.trending(_live("stars", as_of)(s, d))


def _ranking(name: str, as_of: str = AS_OF) -> Callable[[SparkSession, str], DataFrame]:
    if name == "trending":
        return lambda s, d: R.snapshot(_trending(s, d, as_of), "repo_id", "trending_score", None)
    key, metric, _, _ = ENTITIES[name]
    return lambda s, d: R.snapshot(_live(name, as_of)(s, d), key, metric, all_versions=name != "counts")


def _ranking_sql(name: str, as_of: str = AS_OF) -> str:
    if name == "trending":
        return _rank_sql(_trend_sql(as_of), "repo_id", "trending_score", None)
    return _rank_sql(_live_sql(name, as_of), ENTITIES[name][0], ENTITIES[name][1], "window_size")


def _doubled(s: SparkSession, d: str) -> DataFrame:
    """Events met again under later versions, as an overlapping poll gives them."""
    e = _ev(s, d)
    return e.unionByName(e.where("id % 3 = 0").withColumn("seq_num", F.col("seq_num") + 1_000_000).withColumn("kind", F.lit("other")))


_add("dedup_events", lambda s, d: V.dedup(_doubled(s, d)), f"{EV} SELECT * FROM ev")
for _name, (_key, _metric, _rows, _from) in ENTITIES.items():
    for _suffix, _seconds in (("", 300), ("_fine", 10)):
        _add(
            f"{_name}_history{_suffix}", lambda s, d, k=_key, m=_metric, r=_rows, n=_seconds: H.tumbling(r(_ev(s, d)), k, n, m),
            f"{EV} SELECT {_key}, time_bucket(INTERVAL {_seconds} SECOND, created_at, TIMESTAMP '1970-01-01') AS ts_start, time_bucket(INTERVAL {_seconds} SECOND, created_at, TIMESTAMP '1970-01-01') + INTERVAL {_seconds} SECOND AS ts_end, count(*) AS {_metric} FROM {_from} e GROUP BY ALL",
        )
    _add(f"{_name}_live", _live(_name), f"{EV} {_live_sql(_name)}")
    _add(f"{_name}_ranking", _ranking(_name), f"{EV} {_ranking_sql(_name)}")
    _add(
        f"{_name}_changelog", lambda s, d, k=_key, m=_metric, r=_rows: S.changes(r(_ev(s, d)), k, m),
        f"""{EV}, b AS (SELECT {_key}, date_trunc('second', created_at) + INTERVAL 1 SECOND AS e, count(*) AS c FROM {_from} x GROUP BY ALL),
 dl AS (SELECT window_size, {_key}, changed_at, sum(c) AS delta FROM (SELECT window_size, {_key}, e AS changed_at, c FROM b, sizes UNION ALL SELECT window_size, {_key}, e + s * INTERVAL 1 SECOND, -c FROM b, sizes) GROUP BY ALL HAVING sum(c) <> 0)
 SELECT window_size, {_key}, changed_at, CAST(sum(delta) OVER (PARTITION BY window_size, {_key} ORDER BY changed_at) AS BIGINT) AS {_metric} FROM dl""",
    )
_add("trending_live", _trending, f"{EV} {_trend_sql()}")
_add("trending_ranking", _ranking("trending"), f"{EV} {_ranking_sql('trending')}")
_add(
    "trending_changelog", lambda s, d: S.trending_changes(S.changes(H.stars(_ev(s, d)), "repo_id", "num_stars")),
    f"""{EV}, b AS (SELECT repo_id, date_trunc('second', created_at) + INTERVAL 1 SECOND AS e, count(*) AS c FROM ev WHERE kind = 'watch' GROUP BY ALL),
 dl AS (SELECT repo_id, changed_at, sum(c * w) AS delta, bool_or(n <> 0) AS moved FROM (SELECT window_size, repo_id, changed_at, sum(c) AS c, sum(c) AS n, any_value(CASE window_size WHEN '5m' THEN 10 WHEN '1h' THEN 5 WHEN '6h' THEN 2 ELSE 1 END) AS w
 FROM (SELECT window_size, repo_id, e AS changed_at, c FROM b, sizes UNION ALL SELECT window_size, repo_id, e + s * INTERVAL 1 SECOND, -c FROM b, sizes) GROUP BY window_size, repo_id, changed_at) GROUP BY repo_id, changed_at)
 SELECT repo_id, changed_at, CAST(sum(delta) OVER (PARTITION BY repo_id ORDER BY changed_at) AS BIGINT) AS trending_score FROM dl WHERE moved QUALIFY true""",
)
_add("ranking_page", lambda s, d: R.page(_ranking("users")(s, d), 10, 20, 5), f"{EV} SELECT * FROM ({_ranking_sql('users')}) WHERE row_number >= 5 AND row_number < 25")
_add(
    "ranking_point", lambda s, d: R.points(_live("repos")(s, d), s.createDataFrame([(k,) for k in (3, 7, 42)], "repo_id long"), "repo_id", "num_events"),
    f"{EV} SELECT window_size, repo_id, num_events, row_number, rank, max_rank FROM ({_ranking_sql('repos')}) WHERE repo_id IN (3, 7, 42)",
)
_add("ranking_max_rank", lambda s, d: _ranking("stars")(s, d).groupBy("window_size", "rank").agg(F.min("row_number").alias("low"), F.max("row_number").alias("high"), F.max("max_rank").alias("max_rank")), f"{EV} SELECT window_size, rank, min(row_number) AS low, max(row_number) AS high, max(max_rank) AS max_rank FROM ({_ranking_sql('stars')}) GROUP BY window_size, rank")
_DIFF = ", ".join(f"n.{p}, o.{p} AS old_{p}" for p in R.PLACES)
_add(
    "ranking_batch_diff", lambda s, d: R.diff(_ranking("users", EARLIER)(s, d), _ranking("users")(s, d), "user_id", "num_events"),
    f"{EV}, o AS ({_ranking_sql('users', EARLIER)}), n AS ({_ranking_sql('users')}) SELECT coalesce(n.window_size, o.window_size) AS window_size, coalesce(n.user_id, o.user_id) AS user_id, n.num_events, {_DIFF} FROM o FULL JOIN n ON o.window_size = n.window_size AND o.user_id = n.user_id WHERE n.num_events IS DISTINCT FROM o.num_events",
)


def _updates(s: SparkSession, d: str) -> DataFrame:
    """Star counts as a stream of versioned updates: the change log, by time, then key."""
    rows = S.changes(H.stars(_ev(s, d)), "repo_id", "num_stars")
    return rows.select("window_size", "repo_id", F.unix_seconds(F.col("changed_at").cast("timestamp")).alias("seq_num"), "num_stars")


_UPDATES = f"""{EV}, b AS (SELECT repo_id, date_trunc('second', created_at) + INTERVAL 1 SECOND AS e, count(*) AS c FROM ev WHERE kind = 'watch' GROUP BY ALL),
 dl AS (SELECT window_size, repo_id, changed_at, sum(c) AS delta FROM (SELECT window_size, repo_id, e AS changed_at, c FROM b, sizes UNION ALL SELECT window_size, repo_id, e + s * INTERVAL 1 SECOND, -c FROM b, sizes) GROUP BY ALL HAVING sum(c) <> 0),
 up AS (SELECT window_size, repo_id, CAST(epoch(changed_at) AS BIGINT) AS seq_num, CAST(sum(delta) OVER (PARTITION BY window_size, repo_id ORDER BY changed_at) AS BIGINT) AS num_stars, changed_at FROM dl)"""


def _log(s: SparkSession, d: str, until: str | None = None) -> DataFrame:
    rows = _updates(s, d)
    return R.exact_changes(rows if until is None else rows.where(F.col("seq_num") <= F.unix_seconds(F.lit(until).cast("timestamp"))), "repo_id", "num_stars")


# the log up to a moment leads to the ranking of that moment
_add("ranking_replay", lambda s, d: R.replay(_log(s, d, AS_OF), "repo_id", "num_stars").drop("seq_num"), f"{EV} SELECT window_size, repo_id, num_stars, row_number, rank, max_rank FROM ({_ranking_sql('stars')})")
_add(
    "ranking_changelog", lambda s, d: _log(s, d).select("window_size", "seq_num", "repo_id", "num_stars", "row_number", "rank", "old_row_number", "old_rank"),
    f"""{_UPDATES}, u AS (SELECT * FROM up), iv AS (SELECT *, lead(seq_num) OVER (PARTITION BY window_size, repo_id ORDER BY seq_num) AS until, lag(num_stars) OVER (PARTITION BY window_size, repo_id ORDER BY seq_num) AS old FROM u),
 pl AS (SELECT a.window_size, a.seq_num, a.repo_id, a.num_stars, coalesce(a.old, 0) AS old,
 count(*) FILTER (WHERE b.num_stars > a.num_stars OR b.num_stars = a.num_stars AND b.repo_id < a.repo_id) AS row_number, count(*) FILTER (WHERE b.num_stars > a.num_stars) AS rank,
 count(*) FILTER (WHERE b.num_stars > coalesce(a.old, 0) OR b.num_stars = coalesce(a.old, 0) AND b.repo_id < a.repo_id) AS old_row_number, count(*) FILTER (WHERE b.num_stars > coalesce(a.old, 0)) AS old_rank
 FROM iv a LEFT JOIN iv b ON a.window_size = b.window_size AND b.repo_id <> a.repo_id AND (b.seq_num, b.repo_id) < (a.seq_num, a.repo_id) AND (b.until IS NULL OR (b.until, b.repo_id) > (a.seq_num, a.repo_id)) AND b.num_stars > 0 GROUP BY ALL)
 SELECT window_size, seq_num, repo_id, num_stars, CASE WHEN num_stars > 0 THEN row_number END AS row_number, CASE WHEN num_stars > 0 THEN rank END AS rank, CASE WHEN old > 0 THEN old_row_number END AS old_row_number, CASE WHEN old > 0 THEN old_rank END AS old_rank FROM pl WHERE num_stars > 0 OR old > 0""",
)

#: Raw events made of the rows of the events table: event_id modulo the number of rows here chooses type, payload, kind, and the description after the user (SQL).
_REPO, _U = "'<repo{o' || user_id || '/r' || repo_id || '}{' || repo_id || '}>'", "'<user{u' || user_id || '}{' || user_id || '}>'"
_IN = f"' in repository ' || {_REPO} || '.'"
RAW: tuple[tuple[str, str, str, str | None], ...] = (
    ("PushEvent", '{"ref":"refs/heads/b%d","size":2}', "push", f"' pushed 2 commits to repository ' || {_REPO} || ' branch <code{{b' || id || '}}>'"),
    ("WatchEvent", '{"action":"started","n":%d}', "watch", f"' starred the repository ' || {_REPO}"),
    ("CreateEvent", '{"ref_type":"repository","ref":null,"description":"d%d"}', "create_repo", f"' created the repository ' || {_REPO} || '.<quote{{d' || id || '}}>'"),
    ("CreateEvent", '{"ref_type":"branch","ref":"b%d","master_branch":"main","description":null}', "create_branch", f"' created the branch <code{{b' || id || '}}>' || {_IN}"),
    ("CreateEvent", '{"ref_type":"tag","ref":"t%d"}', "other", f"' created the tag <code{{t' || id || '}}> in repository ' || {_REPO} || '.'"),
    ("DeleteEvent", '{"ref_type":"branch","ref":"b%d"}', "delete_branch", f"' deleted the branch <code{{b' || id || '}}>' || {_IN}"),
    ("ForkEvent", '{"forkee":{"id":%d,"full_name":"x/y"}}', "fork", f"' created a fork of ' || {_REPO} || ' at <repo{{x/y}}{{' || id || '}}>.'"),
    ("GollumEvent", '{"n":%d}', "wiki", f"' modified wiki pages for repository ' || {_REPO}"),
    ("IssuesEvent", '{"action":"opened","issue":{"html_url":"h%d","title":"t","body":"b"}}', "issue_open", f"' opened an <link{{issue}}{{h' || id || '}}>' || {_IN} || '<quote{{t' || chr(10) || chr(10) || 'b}}>'"),
    ("IssuesEvent", '{"action":"closed","issue":{"html_url":"h%d","title":"t"}}', "issue_close", f"' closed an <link{{issue}}{{h' || id || '}}>' || {_IN} || '<quote{{t}}>'"),
    ("IssueCommentEvent", '{"issue":{"html_url":"h%d"},"comment":{"html_url":"c","body":"b"}}', "issue_comment", f"' <link{{commented}}{{c}} on an <link{{issue}}{{h' || id || '}}>' || {_IN} || '<quote{{b}}>'"),
    ("IssueCommentEvent", '{"issue":{"html_url":"h%d","pull_request":{}},"comment":{"html_url":"c","body":null}}', "pull_comment", f"' <link{{commented}}{{c}}> on a <link{{pull request}}{{h' || id || '}}>' || {_IN}"),
    ("PullRequestEvent", '{"action":"opened","pull_request":{"url":"https://api.github.com/repos/a/b/pulls/%d","title":"t"}}', "pull_open", f"' opened a <link{{pull request}}{{https://github.com/a/b/pull/' || id || '}}>' || {_IN} || '<quote{{t}}>'"),
    ("PullRequestEvent", '{"action":"merged","pull_request":{"html_url":"h%d","title":"t"}}', "pull_close", f"' merged a <link{{pull request}}{{h' || id || '}}>' || {_IN} || '<quote{{t}}>'"),
    ("CommitCommentEvent", '{"comment":{"html_url":"h%d#c","commit_id":"0123456789abcdef","body":"b"}}', "commit_comment", "' <link{commented}{h' || id || '#c}> on commit <link{#0123456789}{h' || id || '}>.' || chr(10) || '<quote{b}>'"),
    ("PublicEvent", '{"n":%d}', "other", f"'  made the repository ' || {_REPO} || ' public.'"),
    ("ReleaseEvent", '{"action":"published","release":{"html_url":"h%d","author":{"id":7,"login":"rel"}}}', "other", f"' published a <link{{release}}{{h' || id || '}}> for repository ' || {_REPO} || '.'"),
    ("PullRequestReviewEvent", '{"action":"created","review":{"html_url":"h%d","body":"b"},"pull_request":{"html_url":"p"}}', "other", f"' created a <link{{pull request review}}{{h' || id || '}}>' || {_IN} || '<quote{{b}}>'"),
    ("MemberEvent", '{"action":"added","member":{"id":%d}}', "other", f"' added member <user{{}}{{' || id || '}}> for repository ' || {_REPO} || '.'"),
    ("DiscussionEvent", '{"action":"created","discussion":{"html_url":"h%d","body":null}}', "other", f"' created a <link{{discussion}}{{h' || id || '}}>' || {_IN}"),
    ("PullRequestReviewCommentEvent", '{"action":"created","comment":{"html_url":"c","body":"b"},"pull_request":{"html_url":"h%d"}}', "pull_comment", f"' <link{{commented}}{{c}}> on a <link{{pull request}}{{h' || id || '}}>' || {_IN} || '<quote{{b}}>'"),
    ("PushEvent", '{"ref":"refs/heads/b%d","size":1}', "push", f"' pushed a commit to repository ' || {_REPO} || ' branch <code{{b' || id || '}}>'"),
    ("PushEvent", '{"ref":"b%d"}', "push", f"' pushed to repository ' || {_REPO} || ' branch <code{{b' || id || '}}>'"),
    ("IssuesEvent", '{"action":"reopened","issue":{"html_url":"h%d","title":"t","body":null}}', "issue_open", f"' reopened an <link{{issue}}{{h' || id || '}}>' || {_IN} || '<quote{{t}}>'"),
    ("PullRequestEvent", '{"action":"closed","pull_request":{"html_url":"h%d","title":"t"}}', "pull_close", f"' closed a <link{{pull request}}{{h' || id || '}}>' || {_IN} || '<quote{{t}}>'"),
    ("PullRequestEvent", '{"action":"synchronize","pull_request":{"html_url":"h%d","title":"t","body":"b"}}', "other", f"' synchronize a <link{{pull request}}{{h' || id || '}}>' || {_IN} || '<quote{{t' || chr(10) || chr(10) || 'b}}>'"),
    ("StrangeEvent", '{"n":%d}', "other", None),
    ("IssuesEvent", '{"action":"labeled","issue":{"html_url":"h%d","title":"t","user":{"id":8,"html_url":"w8","type":"Bot","login":"iss"},"assignees":[{"id":9,"login":"as1"},{"login":"noid"}]}}', "other", f"' labeled an <link{{issue}}{{h' || id || '}}>' || {_IN} || '<quote{{t}}>'"),
)


def _plain(sql: str) -> str:
    return sql.replace("{{", "{").replace("}}", "}")


def raw_events(s: SparkSession, d: str) -> DataFrame:
    e = _ev(s, d).repartition(s.sparkContext.defaultParallelism * 4)  # a few MB of the table are hundreds of thousands of events to take apart, in one task else
    which = F.col("id") % len(RAW)
    type_ = F.element_at(F.array(*(F.lit(r[0]) for r in RAW)), (which + 1).cast("int"))
    payload = F.element_at(F.array(*(F.lit(r[1]) for r in RAW)), (which + 1).cast("int"))
    payload = F.replace(payload, F.lit("%d"), F.col("id").cast("string"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    at = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    # parts are joined: format_string takes longer for an event than a parse of it
    raw = F.concat(
        F.lit('{"id":"'), text("id"), F.lit('","seq_num":'), text("seq_num"), F.lit(',"type":"'), F.coalesce(type_, F.lit("null")), F.lit('","created_at":"'), F.coalesce(at, F.lit("null")),
        F.lit('","actor":{"id":'), text("user_id"), F.lit(',"login":"u'), text("user_id"), F.lit('","avatar_url":"a'), text("id"), F.lit('"},"repo":{"id":'), text("repo_id"),
        F.lit(',"name":"o'), text("user_id"), F.lit("/r"), text("repo_id"), F.lit('","stargazers_count":1,"watchers":'), text("id"), F.lit(',"topics":["x","y"]},"payload":'), F.coalesce(payload, F.lit("null")), F.lit("}"),
    )
    return e.select(raw.alias("raw"))


def _typed(s: SparkSession, d: str) -> DataFrame:
    return X.typed(X.decode(raw_events(s, d)))


_CASE = "CASE id % " + str(len(RAW)) + " " + " ".join(f"WHEN {i} THEN '{r[2]}'" for i, r in enumerate(RAW)) + " END"
_TEXT = "CASE id % " + str(len(RAW)) + " " + " ".join(f"WHEN {i} THEN {_U} || {_plain(r[3])}" if r[3] else f"WHEN {i} THEN 'This is an unknown event type <code{{{r[0]}}}>.'" for i, r in enumerate(RAW)) + " END"
_add("kind_classify", lambda s, d: _typed(s, d).select("id", F.col("created_at").cast("timestamp_ntz").alias("created_at"), "kind", "user_id", "repo_id", "seq_num"), f"{EV} SELECT id, date_trunc('second', created_at) AS created_at, {_CASE} AS kind, user_id, repo_id, seq_num FROM ev")
_add("event_details", lambda s, d: X.detailed(_typed(s, d)).select("id", "kind", "details"), f"{EV} SELECT id, {_CASE} AS kind, {_TEXT} AS details FROM ev")
_add(
    "description_parts", lambda s, d: E.each_part(X.detailed(_typed(s, d)).select("id", "details")).groupBy("p.name").agg(F.count("*").alias("n")),
    f"{EV} SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all({_TEXT}, '<(user|repo|link|code|quote)\\{{[^}}]*\\}}(?:\\{{[^}}]*\\}})?>', 1)) AS name FROM ev) GROUP BY name",
)
_add("url_rewrite", lambda s, d: _ev(s, d).select("id", E.page_url(F.concat(F.lit("https://api.github.com/repos/a/"), "repo_id", F.lit("/pulls/"), "id")).alias("url")), f"{EV} SELECT id, 'https://github.com/a/' || repo_id || '/pull/' || id AS url FROM ev")
_AT = {r[0]: i for i, r in enumerate(RAW)} | {"labeled": len(RAW) - 1}
_MENTIONS = f"""{EV}, ue AS (SELECT user_id AS id, 'u' || user_id AS username, 'a' || id AS avatar_url, NULL AS html_url, NULL AS user_type, seq_num FROM ev UNION ALL SELECT 7, 'rel', NULL, NULL, NULL, seq_num FROM ev WHERE id % {len(RAW)} = {_AT["ReleaseEvent"]}
 UNION ALL SELECT 8, 'iss', NULL, 'w8', 'Bot', seq_num FROM ev WHERE id % {len(RAW)} = {_AT["labeled"]} UNION ALL SELECT 9, 'as1', NULL, NULL, NULL, seq_num FROM ev WHERE id % {len(RAW)} = {_AT["labeled"]}
 UNION ALL SELECT id, NULL, NULL, NULL, NULL, seq_num FROM ev WHERE id % {len(RAW)} = {_AT["MemberEvent"]})"""
_add("user_mentions", lambda s, d: N.user_mentions(X.sequenced(X.decode(raw_events(s, d)))), f"{_MENTIONS} SELECT * FROM ue")
_REPO_NULLS = ", ".join(f"NULL AS {n}" for n in ("owner_id", "html_url", "homepage", "descr", "lang", "license", "is_fork", "is_archived", "fork_count", "issue_count"))
_REPOS = f"""{EV}, re AS (SELECT repo_id AS id, 'r' || repo_id AS reponame, 'o' || user_id || '/r' || repo_id AS fullname, 'x y' AS topics, id AS star_count, seq_num, {_REPO_NULLS} FROM ev
 UNION ALL SELECT id, NULL, 'x/y', NULL, NULL, seq_num, {_REPO_NULLS} FROM ev WHERE id % {len(RAW)} = {_AT["ForkEvent"]})"""
_add("repo_mentions", lambda s, d: N.repo_mentions(X.sequenced(X.decode(raw_events(s, d)))), f"{_REPOS} SELECT * FROM re")


def _merged(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    return V.merge_fields(V.with_versions(rows, list(fields)), ["id"], list(fields))


def _merged_sql(rows: str, fields: tuple[str, ...]) -> str:
    last = [f"arg_max({f}, seq_num) FILTER (WHERE {f} IS NOT NULL) AS {f}, coalesce(max(seq_num) FILTER (WHERE {f} IS NOT NULL), 0) AS {f}_seq_num" for f in fields]
    return f"SELECT id, {', '.join(last)}, max(seq_num) AS seq_num FROM {rows} GROUP BY id"


_add("users_merge", lambda s, d: _merged(N.user_mentions(X.sequenced(X.decode(raw_events(s, d)))), N.USER_FIELDS), f"{_MENTIONS} {_merged_sql('ue', N.USER_FIELDS)}")
_add("repos_merge", lambda s, d: _merged(N.repo_mentions(X.sequenced(X.decode(raw_events(s, d)))), N.REPO_FIELDS), f"{_REPOS} {_merged_sql('re', N.REPO_FIELDS)}")
_add("row_merge", lambda s, d: V.merge_rows(_ev(s, d).select("user_id", "repo_id", "kind", "seq_num"), ["user_id"]), f"{EV} SELECT user_id, arg_max(repo_id, seq_num) AS repo_id, arg_max(kind, seq_num) AS kind, max(seq_num) AS seq_num FROM ev GROUP BY user_id")
_add(
    "update_filter", lambda s, d: V.drop_redundant(_ev(s, d).select("user_id", "kind", "seq_num"), ["user_id"], ["kind"], ignore_version=True),
    f"{EV} SELECT user_id, kind, seq_num FROM (SELECT user_id, kind, seq_num, lag(kind) OVER (PARTITION BY user_id ORDER BY seq_num) AS p FROM ev) WHERE p IS DISTINCT FROM kind",
)
_add(
    "seq_assign", lambda s, d: V.assign_sequence(_ev(s, d).select("user_id", "id").withColumn("seq_num", F.lit(None).cast("long")), ["user_id"], ["id"], 5000, _ev(s, d).where("user_id % 2 = 0").groupBy("user_id").agg(F.max("id").alias("last_seq"))),
    f"{EV} SELECT e.user_id, id, greatest(5000, coalesce(last_seq + 1, 0)) + row_number() OVER (PARTITION BY e.user_id ORDER BY id) - 1 AS seq_num FROM ev e LEFT JOIN (SELECT user_id, max(id) AS last_seq FROM ev WHERE user_id % 2 = 0 GROUP BY user_id) l ON e.user_id = l.user_id",
)
_add(
    "poll_order", lambda s, d: X.number_polls(_ev(s, d).select((F.floor(F.col("id") / 200)).alias("poll"), (F.floor(F.col("id") % 200 / 100) + 1).alias("page"), (F.col("id") % 100).alias("pos"), (F.col("id") % 5000).alias("id"))),
    f"{EV}, p AS (SELECT id // 200 AS poll, id % 200 // 100 + 1 AS page, id % 100 AS pos, id % 5000 AS id FROM ev), o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY poll, page DESC, pos DESC) AS n FROM p) SELECT poll, page, pos, id, poll * 1000 + row_number() OVER (PARTITION BY poll ORDER BY page DESC, pos DESC) - 1 AS seq_num FROM o WHERE n = 1",
)
_add("stale_filter", lambda s, d: X.recent(_ev(s, d), AS_OF, 7), f"{EV} SELECT * FROM ev WHERE created_at > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY")
_add("retention", lambda s, d: T.retained(H.tumbling(_ev(s, d), "user_id", 10), "ts_start", AS_OF, 7), f"{EV} SELECT user_id, time_bucket(INTERVAL 10 SECOND, created_at, TIMESTAMP '1970-01-01') AS ts_start, time_bucket(INTERVAL 10 SECOND, created_at, TIMESTAMP '1970-01-01') + INTERVAL 10 SECOND AS ts_end, count(*) AS num_events FROM ev WHERE time_bucket(INTERVAL 10 SECOND, created_at, TIMESTAMP '1970-01-01') >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY GROUP BY 1, 2, 3")


def _zeroed(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    old = _live("users", EARLIER)(s, d)
    new = _live("users")(s, d)
    gone = old.join(new, ["window_size", "user_id"], "left_anti").select("window_size", "user_id", F.lit(0).cast("long").alias("num_events"), F.lit(10**9).cast("long").alias("seq_num"))
    return old, new.unionByName(gone)


_OLDNEW = f"{EV}, o AS ({_live_sql('users', EARLIER)}), n AS ({_live_sql('users')})"
_add("zero_delete", lambda s, d: T.upserted(*_zeroed(s, d), TABLES["users_live"]), f"{_OLDNEW} SELECT n.window_size, n.user_id, CASE WHEN o.seq_num IS NULL OR n.seq_num > o.seq_num THEN n.num_events ELSE o.num_events END AS num_events, n.seq_num FROM n LEFT JOIN o ON n.window_size = o.window_size AND n.user_id = o.user_id")
_add(
    "upsert_merge", lambda s, d: T.upserted(_live("counts", EARLIER)(s, d), _live("counts")(s, d), TABLES["counts_live"]),
    f"{EV}, o AS ({_live_sql('counts', EARLIER)}), n AS ({_live_sql('counts')}) SELECT coalesce(n.window_size, o.window_size) AS window_size, coalesce(n.kind, o.kind) AS kind, CASE WHEN o.seq_num IS NULL OR n.seq_num > o.seq_num THEN n.num_events ELSE o.num_events END AS num_events, greatest(n.seq_num, o.seq_num) AS seq_num FROM o FULL JOIN n ON n.window_size = o.window_size AND n.kind = o.kind",
)
_add("change_topic", lambda s, d: T.topic_rows(_live("users")(s, d), TABLES["users_live"]), f"""{EV} SELECT '["' || window_size || '",' || user_id || ']' AS key, '{{"window_size":"' || window_size || '","user_id":' || user_id || ',"num_events":' || num_events || ',"seq_num":' || seq_num || '}}' AS value FROM ({_live_sql('users')})""")

_events = lambda: Query(TABLES["events"])
_add("filter_in", lambda s, d: _events().where("kind", "watch", "fork").live(_ev(s, d)), f"{EV} SELECT * FROM ev WHERE kind IN ('watch', 'fork')")
_add("filter_range", lambda s, d: _events().where("repo_id", start=10, end=20).where("user_id", start=5, end=50, inclusive=True).live(_ev(s, d)), f"{EV} SELECT * FROM ev WHERE repo_id >= 10 AND repo_id < 20 AND user_id >= 5 AND user_id <= 50")
_add("filter_substr", lambda s, d: _events().where("kind", contains="ReP").live(_ev(s, d)), f"{EV} SELECT * FROM ev WHERE contains(kind, 'rep')")
_add("filter_or", lambda s, d: _events().where("kind", "watch").where("repo_id", 1, 2, 3).or_().where("user_id", 7).live(_ev(s, d)), f"{EV} SELECT * FROM ev WHERE kind = 'watch' AND repo_id IN (1, 2, 3) OR user_id = 7")
_add("feed_latest", lambda s, d: _events().where("kind", "watch", "push").limit(20).read(_ev(s, d)), f"{EV} SELECT created_at, id, kind, repo_id, user_id, seq_num FROM ev WHERE kind IN ('watch', 'push') ORDER BY created_at DESC, id DESC LIMIT 20")
_add(
    "subscription_match", lambda s, d: matched(_ev(s, d), [("stars", _events().where("kind", "watch")), ("one", _events().where("user_id", 7)), ("none", _events().none())]).select("id", F.array_join("subscriptions", ",").alias("names")),
    f"{EV} SELECT id, concat_ws(',', CASE WHEN kind = 'watch' THEN 'stars' END, CASE WHEN user_id = 7 THEN 'one' END) AS names FROM ev WHERE kind = 'watch' OR user_id = 7",
)
_add(
    "snapshot_plus_changes", lambda s, d: snapshot_plus_changes(_live("users", EARLIER)(s, d), _live("users")(s, d), ["window_size", "user_id"]),
    f"{_OLDNEW}, f AS (SELECT * FROM n WHERE seq_num > (SELECT max(seq_num) FROM o)) SELECT coalesce(f.window_size, o.window_size) AS window_size, coalesce(f.user_id, o.user_id) AS user_id, coalesce(f.num_events, o.num_events) AS num_events, coalesce(f.seq_num, o.seq_num) AS seq_num FROM o FULL JOIN f ON f.window_size = o.window_size AND f.user_id = o.user_id",
)


def _literal(t: str) -> Column:
    return F.lit(t).cast("timestamp_ntz")


def _series(s: SparkSession, d: str) -> DataFrame:
    return H.gap_filled(H.tumbling(_ev(s, d), "user_id"), "user_id", "num_events", _literal(AS_OF), 288, 300)


_SERIES = f"""{EV}, h AS (SELECT user_id, time_bucket(INTERVAL 300 SECOND, created_at, TIMESTAMP '1970-01-01') AS x, count(*) AS y FROM ev GROUP BY 1, 2),
 g AS (SELECT user_id, p AS place, TIMESTAMP '{AS_OF}' + (p - 287) * INTERVAL 300 SECOND AS x FROM (SELECT DISTINCT user_id FROM h WHERE x <= TIMESTAMP '{AS_OF}' AND x > TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY), range(288) r(p)),
 se AS (SELECT g.user_id, CAST(place AS INTEGER) AS place, g.x, coalesce(y, CASE WHEN place < 287 THEN 0 END) AS y FROM g LEFT JOIN h ON g.user_id = h.user_id AND g.x = h.x)"""
_add("series_gap_fill", _series, f"{_SERIES} SELECT * FROM se")
_add("series_downsample", lambda s, d: H.downsampled(_series(s, d), "user_id", 288, 4), f"{_SERIES} SELECT user_id, CAST((287 - place) // 4 AS INTEGER) AS back, min(x) AS x, CASE WHEN count(*) FILTER (WHERE y IS NULL) = 0 THEN CAST(sum(y) AS BIGINT) END AS y FROM se GROUP BY ALL")
_add(
    "series_long", lambda s, d: H.gap_filled(H.tumbling(_ev(s, d), "kind"), "kind", "num_events", _literal("2024-01-30 23:55:00"), 30 * 288, 300, False).groupBy("kind", F.to_date("x").alias("day")).agg(F.sum("y").alias("y"), F.count("*").alias("n")),
    f"{EV}, f AS (SELECT * FROM fan), g AS (SELECT k.kind, TIMESTAMP '2024-01-01' + p * INTERVAL 300 SECOND AS x FROM (SELECT DISTINCT kind FROM f) k, range(8640) r(p)), h AS (SELECT kind, time_bucket(INTERVAL 300 SECOND, created_at, TIMESTAMP '1970-01-01') AS x, count(*) AS y FROM f GROUP BY ALL) SELECT g.kind, CAST(g.x AS DATE) AS day, CAST(sum(coalesce(y, 0)) AS BIGINT) AS y, count(*) AS n FROM g LEFT JOIN h ON g.kind = h.kind AND g.x = h.x GROUP BY ALL",
)
_PIVOT = [k for k in KINDS if k != "all"]
_add(
    "series_pivot", lambda s, d: H.pivoted(H.tumbling(_ev(s, d), "kind"), _PIVOT),
    f"{EV} SELECT time_bucket(INTERVAL 300 SECOND, created_at, TIMESTAMP '1970-01-01') AS ts_start, {', '.join(f'count(*) FILTER (WHERE kind = {chr(39)}{k}{chr(39)}) AS {chr(34)}{k}{chr(34)}' for k in _PIVOT)}, count(*) AS y FROM ev GROUP BY 1",
)
_add("proportions", lambda s, d: H.proportions(_live("counts")(s, d), "24h"), f"{EV}, l AS (SELECT * FROM ({_live_sql('counts')}) WHERE window_size = '24h' AND kind <> 'all') SELECT kind, num_events, num_events / (SELECT sum(num_events) FROM l) AS share FROM l")
_add("proportions_hour", lambda s, d: H.proportions(_live("counts")(s, d), "1h"), _sql["proportions"].replace("'24h' AND", "'1h' AND"))
_add("latest_time", lambda s, d: H.latest(H.tumbling(_ev(s, d), "kind")), f"{EV} SELECT max(time_bucket(INTERVAL 300 SECOND, created_at, TIMESTAMP '1970-01-01')) AS ts_start FROM ev")


def _customers(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"))


def _parts(s: SparkSession, d: str) -> DataFrame:
    p = s.read.parquet(f"{d}/part.parquet")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("reponame"), F.concat("p_brand", F.lit("/"), "p_name").alias("fullname"), (F.col("p_partkey") % 50).alias("owner_id"))


_PARTS = "pa AS (SELECT p_partkey AS id, p_name AS reponame, p_brand || '/' || p_name AS fullname, p_partkey % 50 AS owner_id FROM part)"
_add("enrich_ranking", lambda s, d: J.named(_ranking("users")(s, d), _customers(s, d), "user_id"), f"{EV} SELECT r.*, c_name AS username FROM ({_ranking_sql('users')}) r LEFT JOIN customer ON user_id = c_custkey")
_add("repo_owner", lambda s, d: J.with_owner(_parts(s, d), _customers(s, d)), f"WITH {_PARTS} SELECT pa.*, coalesce(c.c_name, n.c_name) AS owner_name FROM pa LEFT JOIN customer c ON c.c_custkey = owner_id LEFT JOIN (SELECT DISTINCT c_name FROM customer) n ON c.c_custkey IS NULL AND n.c_name = split_part(fullname, '/', 1)")
_add(
    "ranking_history", lambda s, d: J.with_history(R.page(_ranking("users")(s, d).where("window_size = '24h'"), 0, 5, 0), H.tumbling(_ev(s, d), "user_id"), "user_id"),
    f"{EV} SELECT user_id, time_bucket(INTERVAL 300 SECOND, created_at, TIMESTAMP '1970-01-01') AS ts_start, time_bucket(INTERVAL 300 SECOND, created_at, TIMESTAMP '1970-01-01') + INTERVAL 300 SECOND AS ts_end, count(*) AS num_events FROM ev WHERE user_id IN (SELECT user_id FROM ({_ranking_sql('users')}) WHERE window_size = '24h' AND row_number < 5) GROUP BY ALL",
)
_add(
    "entity_page", lambda s, d: J.entity_page(_parts(s, d), {"repos": _ranking("repos")(s, d), "stars": _ranking("stars")(s, d), "trending": _ranking("trending")(s, d)}, "repo_id").select("id", "reponame", F.array_join(F.transform("places", lambda p: F.concat_ws(":", p["ranking"], p["window_size"], p["row_number"], p["rank"])), ",").alias("places")),
    f"""{EV}, {_PARTS}, pl AS (SELECT 'repos' AS n, window_size AS w, repo_id, row_number, rank FROM ({_ranking_sql('repos')}) UNION ALL SELECT 'stars', window_size, repo_id, row_number, rank FROM ({_ranking_sql('stars')}) UNION ALL SELECT 'trending', '', repo_id, row_number, rank FROM ({_ranking_sql('trending')})),
 ag AS (SELECT repo_id, string_agg(n || ':' || w || ':' || row_number || ':' || rank, ',' ORDER BY n, w) AS places FROM pl GROUP BY repo_id) SELECT id, reponame, places FROM pa LEFT JOIN ag ON id = repo_id""",
)
_add(
    "global_search", lambda s, d: J.global_search(_customers(s, d), _parts(s, d), "1", 10),
    f"WITH {_PARTS} SELECT type, id, name FROM (SELECT 'user' AS type, c_custkey AS id, c_name AS name FROM customer WHERE contains(lower(c_name), '1') UNION ALL SELECT 'repo', id, fullname FROM pa WHERE contains(lower(reponame), '1') OR contains(lower(fullname), '1')) ORDER BY length(name), name, type, id LIMIT 10",
)
_add("name_score", lambda s, d: J.best_names(_parts(s, d).select("id", "reponame"), "reponame", "ring", 15), f"WITH {_PARTS} SELECT id, reponame, 1 / (1 + abs(length(reponame) - 4)) AS score FROM pa WHERE contains(lower(reponame), 'ring') ORDER BY score DESC, reponame, id LIMIT 15")
_add(
    "out_of_orderness", lambda s, d: P.out_of_orderness(_ev(s, d).withColumn("created_at", F.col("created_at") - F.make_interval(secs=(F.col("id") * 7919 % 13)))),
    f"{EV}, t AS (SELECT seq_num, epoch_us(created_at - (id * 7919 % 13) * INTERVAL 1 SECOND) / 1000000.0 AS t FROM ev), de AS (SELECT max(t) OVER (ORDER BY seq_num) - t AS delay FROM t) SELECT quantile_cont(delay, 0.9) AS p90, quantile_cont(delay, 0.99) AS p99, quantile_cont(delay, 0.9975) AS p9975, quantile_cont(delay, 0.999) AS p999, max(delay) AS longest, count(*) FILTER (WHERE delay < 1) / count(*) AS under_1s, count(*) FILTER (WHERE delay < 5) / count(*) AS under_5s, count(*) FILTER (WHERE delay < 10) / count(*) AS under_10s, count(*) AS n FROM de",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import live_queries  # it adds its own to the list

    return dict(live_queries.BASE._queries)


def oracle_sql() -> dict[str, str]:
    from . import live_queries

    return dict(live_queries.BASE._sql)
