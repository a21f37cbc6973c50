"""Users and repositories that raw events mention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import json as J

USER_FIELDS = ("username", "avatar_url", "html_url", "user_type")
REPO_FIELDS = ("reponame", "fullname", "owner_id", "html_url", "homepage", "descr", "topics", "lang", "license", "is_fork", "is_archived", "fork_count", "issue_count", "star_count")

#: Places of a user object under an issue or pull request, and of lists of them.
ISSUE_USERS = ("user", "assignee", "head.user", "head.repo.owner", "base.user", "base.repo.owner", "merged_by")
ISSUE_LISTS = ("assignees", "requested_reviewers")
#: Places elsewhere: path, and the object without which it doesn't count.
USERS = (
    ("$.actor", None), ("$.org", None), ("$.payload.comment.user", None), ("$.payload.performed_via_github_app.owner", "$.payload.comment"),
    ("$.payload.review.user", None), ("$.payload.release.author", None), ("$.payload.forkee.owner", None), ("$.payload.member", None),
)
REPOS = ("$.repo", *(f"$.payload.{i}.{b}.repo" for i in ("issue", "pull_request") for b in ("head", "base")), "$.payload.forkee")


def _type(leaf: str, singles: list[str], lists: list[str]) -> str:
    """The type of a struct with `leaf` at each path of singles, and an array of them at each of lists."""
    tree: dict = {}
    for p in (*singles, *lists):
        *above, last = p.removeprefix("$.").split(".")
        at = tree
        for name in above:
            at = at.setdefault(name, {})
        at[last] = leaf if p in singles else f"array<{leaf}>"
    told = lambda t: t if isinstance(t, str) else f"struct<{', '.join(f'{n}: {told(x)}' for n, x in t.items())}>"
    return told(tree)


def _mentioned(events: DataFrame, fields: dict[str, str], singles: list[tuple[str, str | None]], lists: list[str] = ()) -> DataFrame:
    """seq_num, v and m for each object with an id at one of the paths: the object, and a struct of these fields (null where missing).

    One cast takes the event apart and one each object, so no row has more fields than whole-stage code takes (an operator is interpreted beyond 100).
    Generators keep the optimizer from casting wherever a field is read.
    """
    gates = [g for _, g in singles if g]
    paths = [p for p, _ in singles]
    assert all(any(p.startswith(f"{g}.") for p in paths) for g in gates)  # else the cast has no struct there
    assert not any(q.startswith(f"{p}.") for p in paths for q in (*paths, *lists))  # else the cast has a struct there
    rows = events.select("seq_num", F.explode(F.array(F.try_variant_get("event", "$", _type("variant", paths, lists)))).alias("e"))
    at = lambda p: F.col(f"e.{p.removeprefix('$.')}")
    told = F.array(*(F.when(at(g).isNotNull(), at(p)) if g else at(p) for p, g in singles))
    found = F.concat(told, *(F.coalesce(at(p), F.array().cast("array<variant>")) for p in lists)) if lists else told
    rows = rows.select("seq_num", F.explode(found).alias("v")).where("v IS NOT NULL")
    struct = f"struct<{', '.join(f'{n}: {t}' for n, t in fields.items())}>"
    return rows.select("seq_num", "v", F.explode(F.array(F.try_variant_get("v", "$", struct))).alias("m")).where("m.id IS NOT NULL")


def _has_text(name: str) -> Column:
    """A text field of a mention."""
    return J.shown(F.col(f"m.{name}"), F.col("v"), f"$.{name}")


def user_mentions(events: DataFrame) -> DataFrame:
    """id, username, avatar_url, html_url, user_type, seq_num: one row for each user object with an id, from event (VARIANT) and seq_num."""
    inside = ("issue", "pull_request")
    singles = [*USERS, *((f"$.payload.{i}.{u}", None) for i in inside for u in ISSUE_USERS)]
    texts = ("login", "display_login", "avatar_url", "html_url", "type")
    rows = _mentioned(events, {"id": "variant"} | dict.fromkeys(texts, "string"), singles, [f"$.payload.{i}.{u}" for i in inside for u in ISSUE_LISTS])
    return rows.select(
        J.number(F.col("m.id"), "$").alias("id"), F.coalesce(_has_text("login"), _has_text("display_login")).alias("username"),
        *(_has_text(n).alias(a) for n, a in (("avatar_url", "avatar_url"), ("html_url", "html_url"), ("type", "user_type"))), "seq_num",
    )


#: Fields of a repository object that are read.
REPO_PARTS = {
    **dict.fromkeys(("id", "owner", "license", "fork", "archived"), "variant"), "topics": "array<string>",
    **dict.fromkeys(("name", "full_name", "html_url", "homepage", "description", "language"), "string"),
    **dict.fromkeys(("forks", "forks_count", "open_issues", "open_issues_count", "watchers", "watchers_count", "stargazers_count"), "variant"),
}


def repo_mentions(events: DataFrame) -> DataFrame:
    """id, the fields of a repository, and seq_num: one row for each repository object with an id."""
    rows = _mentioned(events, REPO_PARTS, [(p, None) for p in REPOS])
    r, v = F.col("m"), F.col("v")
    # most fields of most objects are missing: only those that are there are looked at
    there = lambda n, x: F.when(r[n].isNotNull(), x)
    real = lambda n: there(n, F.when(J.is_text(v, f"$.{n}") & ~r[n].isin("", "null"), r[n]))
    count = lambda *names: F.coalesce(*(there(n, J.number(r[n], "$")) for n in names))
    flag = lambda n: there(n, J.flag(r[n], "$"))
    name = _has_text("name")
    slash = F.instr(name, "/")
    topics = F.array_join(r["topics"], " ", "null")
    each = F.transform(F.try_variant_get(v, "$.topics", "array<variant>"), lambda t: J.text(t, "$"))  # a brace may begin an object
    return rows.select(
        J.number(r["id"], "$").alias("id"), F.regexp_replace(name, "^[^/]*/", "").alias("reponame"),
        F.coalesce(_has_text("full_name"), F.when(slash > 0, name)).alias("fullname"), there("owner", J.number(r["owner"], "$.id")).alias("owner_id"),
        real("html_url").alias("html_url"), real("homepage").alias("homepage"), real("description").alias("descr"),
        there("topics", F.when(topics.rlike(r"[{\[]"), F.array_join(each, " ")).otherwise(topics)).alias("topics"), real("language").alias("lang"), there("license", F.when(J.is_object(r["license"], "$"), J.text(r["license"], "$.name"))).alias("license"),
        flag("fork").alias("is_fork"), flag("archived").alias("is_archived"), count("forks", "forks_count").alias("fork_count"), count("open_issues", "open_issues_count").alias("issue_count"),
        count("watchers", "watchers_count", "stargazers_count").alias("star_count"), "seq_num",
    )
