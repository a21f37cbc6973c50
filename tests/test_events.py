import json

import pytest
from pyspark.sql import functions as F

from forgepulse.operators import entities as N
from forgepulse.sources import events as X

#: type, payload, kind
CASES = [
    ("CommitCommentEvent", None, "commit_comment"), ("CreateEvent", {"ref_type": "repository"}, "create_repo"), ("CreateEvent", {"ref_type": "branch", "ref": "master", "master_branch": "master"}, "create_repo"),
    ("CreateEvent", {"ref_type": "branch", "ref": "feature", "master_branch": "master"}, "create_branch"), ("CreateEvent", {"ref_type": "tag", "ref": "v1"}, "other"), ("DeleteEvent", {"ref_type": "branch"}, "delete_branch"),
    ("DeleteEvent", {"ref_type": "tag"}, "other"), ("ForkEvent", None, "fork"), ("GollumEvent", None, "wiki"), ("IssueCommentEvent", {"issue": {"pull_request": {}}}, "pull_comment"),
    ("IssueCommentEvent", {"issue": {"pull_request": None}}, "pull_comment"), ("IssueCommentEvent", {"issue": {}}, "issue_comment"), ("IssuesEvent", {"action": "opened"}, "issue_open"), ("IssuesEvent", {"action": "reopened"}, "issue_open"),
    ("IssuesEvent", {"action": "closed"}, "issue_close"), ("IssuesEvent", {"action": "labeled"}, "other"), ("PullRequestEvent", {"action": "opened"}, "pull_open"), ("PullRequestEvent", {"action": "closed"}, "pull_close"),
    ("PullRequestEvent", {"action": "merged"}, "pull_close"), ("PullRequestReviewCommentEvent", {"action": "created"}, "pull_comment"), ("PushEvent", None, "push"), ("WatchEvent", None, "watch"), ("SomeOtherEvent", None, "other"),
]


def raw(type_, payload, **more):
    return json.dumps({"seq_num": 1, "id": "7", "type": type_, "created_at": "2023-01-01T10:00:00Z", "actor": {"id": 123, "login": "al"}, "repo": {"id": 456, "name": "a/b"}, **({"payload": payload} if payload is not None else {}), **more})


def frame(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "raw string")


def test_kinds(spark):
    rows = X.typed(X.decode(frame(spark, [raw(t, p, seq_num=i) for i, (t, p, _) in enumerate(CASES)]))).orderBy("seq_num").collect()
    assert [r.kind for r in rows] == [k for _, _, k in CASES]
    assert {(r.user_id, r.repo_id, str(r.created_at)) for r in rows} == {(123, 456, "2023-01-01 10:00:00")}


def test_rejects_and_missing_numbers(spark):
    df = X.decode(frame(spark, ["{broken", raw("PushEvent", None), '{"type":"PushEvent","created_at":"2023-01-01T10:00:00Z"}']))
    assert [r.raw for r in X.rejects(df).collect()] == ["{broken"]
    assert sorted(r.seq_num for r in X.typed(df).collect()) == [1, 1672567200000000]
    assert sorted(r.seq_num for r in X.typed(df, archive_seq="zero").collect()) == [0, 1]


WHO, REPO = "<user{al}{123}>", "<repo{a/b}{456}>"


@pytest.mark.parametrize(
    ("type_", "payload", "text"),
    [
        ("PushEvent", {"ref": "refs/heads/x", "size": 1}, f"{WHO} pushed a commit to repository {REPO} branch <code{{x}}>"),
        ("PushEvent", {"ref": "refs/tags/x"}, f"{WHO} pushed to repository {REPO} branch <code{{refs/tags/x}}>"),
        ("PullRequestReviewEvent", {"action": "created", "review": {"body": "ok"}, "pull_request": {"url": "https://api.github.com/repos/a/b/pulls/3"}}, f"{WHO} created a <link{{pull request review}}{{https://github.com/a/b/pull/3}}> in repository {REPO}.<quote{{ok}}>"),
        ("MemberEvent", {"action": "added", "member": {"id": 9, "login": "bo"}}, f"{WHO} added member <user{{}}{{9}}> for repository {REPO}."),
        ("DiscussionEvent", {"action": "created", "discussion": {"html_url": "u", "body": None}}, f"{WHO} created a <link{{discussion}}{{u}}> in repository {REPO}."),
        ("DeleteEvent", {"ref_type": "tag", "ref": "v1"}, f"{WHO} deleted the tag <code{{v1}}> in repository {REPO}."),
        ("CommitCommentEvent", {"comment": {"html_url": "u", "commit_id": "abc"}}, f"{WHO} <link{{commented}}{{u}}> on commit <link{{#abc}}{{u}}>.\n"),
        ("StrangeEvent", {}, "This is an unknown event type <code{StrangeEvent}>."),
    ],
)
def test_descriptions(spark, type_, payload, text):
    assert X.detailed(X.typed(X.decode(frame(spark, [raw(type_, payload)])))).first().details == text


def test_flaws_can_be_mended(spark):
    df = X.typed(X.decode(frame(spark, [raw("MemberEvent", {"action": "added", "member": {"id": 9, "login": "bo"}}), raw("IssueCommentEvent", {"issue": {"html_url": "h"}, "comment": {"html_url": "c"}})])))
    texts = [r.details for r in X.detailed(df, strict=False).collect()]
    assert "<user{bo}{9}>" in texts[0] and "<link{commented}{c}> on an" in texts[1]


def user(i, **more):
    return {"id": i, "login": f"u{i}", **more}


def test_every_place_of_a_user(spark):
    issue = {"user": user(1), "assignee": user(2), "assignees": [user(3), {"login": "x"}], "requested_reviewers": [user(4)], "head": {"user": user(5), "repo": {"owner": user(6)}}, "base": {"user": user(7), "repo": {"owner": user(8)}}, "merged_by": user(9)}
    payload = {"comment": {"user": user(20)}, "performed_via_github_app": {"owner": user(21)}, "review": {"user": user(22)}, "release": {"author": user(23)}, "issue": issue, "pull_request": issue, "forkee": {"owner": user(24)}, "member": {"id": 25, "display_login": "d25", "type": "Bot", "avatar_url": None}}
    rows = N.user_mentions(X.typed(X.decode(frame(spark, [raw("X", payload, org=user(30))])))).collect()
    assert sorted(r.id for r in rows) == sorted([123, 30, *range(20, 26), *list(range(1, 10)) * 2])
    bot = next(r for r in rows if r.id == 25)
    assert (bot.username, bot.user_type, bot.avatar_url, bot.html_url) == ("d25", "Bot", "null", None)
    gated = N.user_mentions(X.typed(X.decode(frame(spark, [raw("X", {"performed_via_github_app": {"owner": user(21)}})])))).collect()
    assert [r.id for r in gated] == [123]


def test_repositories(spark):
    full = {"id": 5, "name": "x/y/z", "full_name": "f/n", "owner": {"login": "o"}, "html_url": "null", "homepage": "", "description": "d", "language": None, "license": {"name": "MIT"}, "topics": ["p", "q"], "fork": True, "archived": False, "forks_count": 1, "forks": 2, "open_issues_count": 3, "stargazers_count": 4, "watchers_count": 5}
    rows = {r.id: r for r in N.repo_mentions(X.typed(X.decode(frame(spark, [raw("X", {"forkee": full, "pull_request": {"head": {"repo": {"id": 6, "name": "plain"}}, "base": {"repo": {"name": "noid"}}}})])))).collect()}
    assert sorted(rows) == [5, 6, 456]
    r = rows[5]
    assert (r.reponame, r.fullname, r.owner_id, r.html_url, r.homepage, r.descr, r.lang, r.license, r.topics, r.is_fork, r.is_archived, r.fork_count, r.issue_count, r.star_count) == ("y/z", "f/n", 0, None, None, "d", None, "MIT", "p q", True, False, 2, 3, 5)
    assert (rows[6].reponame, rows[6].fullname, rows[6].is_fork) == ("plain", None, None) and (rows[456].reponame, rows[456].fullname) == ("b", "a/b")


def test_pages_and_archives(spark, tmp_path):
    from datetime import datetime

    (tmp_path / "1-1.json").write_text(json.dumps([{"id": "5"}, {"id": "4"}]))
    (tmp_path / "1-2.json").write_text(json.dumps([{"id": "3"}, {"id": "2"}]))
    (tmp_path / "2-1.json").write_text(json.dumps([{"id": "6"}, {"id": "5"}]))
    rows = X.pages(spark, str(tmp_path)).orderBy("seq_num").collect()
    assert [(r.id, r.seq_num) for r in rows] == [(2, 1000), (3, 1001), (4, 1002), (5, 1003), (6, 2000)]
    paths = X.archive_paths("b/", datetime(2024, 1, 1, 23, 30), datetime(2024, 1, 2, 1, 0))
    assert paths == ["b/2024-01-01-23.json.gz", "b/2024-01-02-0.json.gz", "b/2024-01-02-1.json.gz"]
    import gzip

    for i, p in enumerate(paths[:2]):
        with gzip.open(tmp_path / p[2:], "wt") as f:
            f.write(raw("PushEvent", None, id=str(i)) + "\n")
    got = X.typed(X.decode(X.archive(spark, str(tmp_path), datetime(2024, 1, 1, 23), datetime(2024, 1, 2, 0))))
    assert sorted(r.id for r in got.collect()) == [0, 1]
