"""Classification and description of raw events, as column expressions over fields that are read once from a VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import json as J

#: Event types that are one kind whatever their payload says.
PLAIN_KINDS = {
    "CommitCommentEvent": "commit_comment", "ForkEvent": "fork", "GollumEvent": "wiki", "PullRequestReviewCommentEvent": "pull_comment",
    "PushEvent": "push", "WatchEvent": "watch",
}


#: Paths that classification and description read: as text, as whole numbers, and those whose presence or kind counts.
KIND_TEXTS = ("type", "payload.ref_type", "payload.action", "payload.ref", "payload.master_branch")
TEXTS = (
    *KIND_TEXTS, "actor.login", "repo.name", "login", "payload.description", "payload.forkee.full_name", "payload.member.login", "payload.member.id",
    *(f"payload.comment.{n}" for n in ("html_url", "commit_id", "body")), *(f"payload.issue.{n}" for n in ("html_url", "title", "body")),
    *(f"payload.pull_request.{n}" for n in ("html_url", "url", "title", "body")), *(f"payload.{t}.{n}" for t in ("review", "release", "discussion") for n in ("html_url", "body")),
)
NUMBERS = ("actor.id", "repo.id", "payload.size", "payload.forkee.id")
KIND_PRESENT = ("payload.issue.pull_request",)
PRESENT = ("payload.pull_request.html_url", "payload.review.html_url", "payload.issue")
QUOTED = ("payload.description", *(f"payload.{t}.body" for t in ("comment", "issue", "pull_request", "review", "release", "discussion")), "payload.issue.title", "payload.pull_request.title")


def _named(letter: str, path: str) -> str:
    return f"{letter}_{path.replace('.', '_')}"


class Parts:
    """Fields of an event that were read once, by path."""

    def __init__(self, of: Column):
        self.of = of

    def text(self, path: str) -> Column:
        return self.of[_named("t", path)]

    def number(self, path: str) -> Column:
        return self.of[_named("n", path)]

    def has(self, path: str) -> Column:
        return self.of[_named("h", path)]

    def is_text(self, path: str) -> Column:
        return self.of[_named("s", path)]


def _leaves(types: dict[str, str]) -> str:
    """The type of a struct with these types at their paths."""
    tree: dict = {}
    for p in sorted(types):
        *above, last = p.split(".")
        at = tree
        for name in above:
            at = at.setdefault(name, {})
        at[last] = types[p]
    told = lambda t: t if isinstance(t, str) else f"struct<{', '.join(f'{n}: {told(x)}' for n, x in t.items())}>"
    return told(tree)


def with_parts(events: DataFrame, texts=TEXTS, numbers=NUMBERS, present=PRESENT, quoted=QUOTED, name: str = "_parts") -> DataFrame:
    """events (with event, a VARIANT) and a struct of the fields at these paths.

    One cast takes the event apart, each text and number cast once; the event itself is asked where that leaves something open: no text may be a JSON
    null, and a brace may begin an object.  Generators keep the optimizer from casting, or reading a field, wherever one is used.
    """
    paths = {*texts, *numbers, *present, *quoted}
    inner = {p for p in paths if any(q.startswith(f"{p}.") for q in paths)}
    types = {p: "variant" if p in texts and p in numbers else "string" if p in texts else "long" if p in numbers else "variant" for p in paths - inner}
    rows = events.select("*", F.explode(F.array(F.try_variant_get("event", "$", _leaves(types)))).alias("_leaves"))
    event, at, leaf = F.col("event"), lambda p: f"$.{p}", lambda p: F.col(f"_leaves.{p}")
    text = lambda p: F.coalesce(J.shown(leaf(p), event, at(p)), F.lit("")) if types.get(p) == "string" else J.text(event, at(p))
    number = lambda p: F.coalesce(leaf(p), F.lit(0).cast("long")) if types.get(p) == "long" else J.number(event, at(p))
    has = lambda p: J.has(event, at(p)) if p in inner else leaf(p).isNotNull() if types[p] == "variant" else leaf(p).isNotNull() | J.has(event, at(p))
    is_text = lambda p: J.is_text(event, at(p)) if p in inner else F.when(leaf(p).isNotNull(), J.is_text(event, at(p))).otherwise(False)
    fields = [text(p).alias(_named("t", p)) for p in texts] + [number(p).alias(_named("n", p)) for p in numbers]
    fields += [has(p).alias(_named("h", p)) for p in present] + [is_text(p).alias(_named("s", p)) for p in quoted]
    return rows.select("*", F.explode(F.array(F.struct(*fields))).alias(name)).drop("_leaves")


def classify(f: Parts) -> Column:
    """The kind of a raw event, by its type and payload (KIND_TEXTS and KIND_PRESENT)."""
    type_, ref_type, action = f.text("type"), f.text("payload.ref_type"), f.text("payload.action")
    create = F.when(ref_type == "branch", F.when(f.text("payload.ref") == f.text("payload.master_branch"), "create_repo").otherwise("create_branch")).when(ref_type == "repository", "create_repo").otherwise("other")
    out = F.when(type_ == "CreateEvent", create)
    out = out.when(type_ == "DeleteEvent", F.when(ref_type == "branch", "delete_branch").otherwise("other"))
    out = out.when(type_ == "IssueCommentEvent", F.when(f.has("payload.issue.pull_request"), "pull_comment").otherwise("issue_comment"))
    out = out.when(type_ == "IssuesEvent", F.when(action.isin("opened", "reopened"), "issue_open").when(action == "closed", "issue_close").otherwise("other"))
    out = out.when(type_ == "PullRequestEvent", F.when(action.isin("opened", "reopened"), "pull_open").when(action.isin("closed", "merged"), "pull_close").otherwise("other"))
    for name, kind in PLAIN_KINDS.items():
        out = out.when(type_ == name, kind)
    return out.otherwise("other")


def page_url(url: Column) -> Column:
    """The web page of an address of the programming interface."""
    return F.replace(F.replace(url, F.lit("https://api.github.com/repos"), F.lit("https://github.com")), F.lit("/pulls/"), F.lit("/pull/"))


def _markup(name: str, text: Column, target: Column | None = None) -> Column:
    parts = [F.lit(f"<{name}{{"), text, *([F.lit("}{"), target.cast("string")] if target is not None else []), F.lit("}>")]
    return F.concat(*parts)


def describe(f: Parts, kind: Column, strict: bool = True) -> Column:
    """A sentence on the event, in markup.  strict keeps the known flaws of the format byte for byte: an open link in issue
    comments, an empty member name."""
    at = lambda p: f.text(f"payload.{p}")
    who = _markup("user", f.text("actor.login"), f.number("actor.id"))
    repo = _markup("repo", f.text("repo.name"), f.number("repo.id"))
    link = lambda t, u: _markup("link", F.lit(t), u)
    quote = lambda p: F.when(f.is_text(f"payload.{p}"), _markup("quote", at(p))).otherwise("")
    body = lambda title, p: F.concat(F.lit("<quote{"), at(title), F.when(f.is_text(f"payload.{p}"), F.concat(F.lit("\n\n"), at(p))).otherwise(""), F.lit("}>"))
    pull_url = F.when(f.has("payload.pull_request.html_url"), at("pull_request.html_url")).otherwise(page_url(at("pull_request.url")))
    in_repo = lambda *parts: F.concat(who, *parts, F.lit(" in repository "), repo, F.lit("."))
    action = at("action")

    def done(verb: str, article: str, thing: str, url: Column) -> Column:
        return in_repo(F.lit(" "), F.lit(verb) if verb else action, F.lit(f" {article} "), link(thing, url))

    comment_url = at("comment.html_url")
    issue = F.concat(done("", "an", "issue", at("issue.html_url")), body("issue.title", "issue.body"))
    pull = F.concat(done("", "a", "pull request", pull_url), body("pull_request.title", "pull_request.body"))
    commit_page = F.when(F.instr(comment_url, "#") > 0, F.substring_index(comment_url, "#", 1)).otherwise(comment_url)
    opened = _markup("link", F.lit("commented"), comment_url) if not strict else F.concat(F.lit("<link{commented}{"), comment_url, F.lit("}"))
    size = f.number("payload.size")
    branch = F.regexp_replace(at("ref"), "^refs/heads/", "")
    thing = F.when(at("ref_type") != "repository", F.concat(at("ref_type"), F.lit(" "), _markup("code", at("ref")), F.lit(" in"))).otherwise("")
    named = lambda verb: F.concat(who, F.lit(f" {verb} the "), thing, F.lit(" repository "), repo, F.lit("."), quote("description"))
    review_url = F.when(f.has("payload.review.html_url"), at("review.html_url")).otherwise(pull_url)
    member = _markup("user", f.text("login" if strict else "payload.member.login"), at("member.id"))
    # fixed values: the wording of the sentences, by kind, then by type for the kind other
    by_kind = {
        "commit_comment": F.concat(who, F.lit(" "), link("commented", comment_url), F.lit(" on commit "), _markup("link", F.concat(F.lit("#"), F.left(at("comment.commit_id"), F.lit(10))), commit_page), F.lit(".\n"), quote("comment.body")),
        "create_branch": F.concat(in_repo(F.lit(" created the branch "), _markup("code", at("ref"))), quote("description")),
        "create_repo": F.concat(who, F.lit(" created the repository "), repo, F.lit("."), quote("description")),
        "delete_branch": in_repo(F.lit(" deleted the branch "), _markup("code", at("ref"))),
        "fork": F.concat(who, F.lit(" created a fork of "), repo, F.lit(" at "), _markup("repo", at("forkee.full_name"), f.number("payload.forkee.id")), F.lit(".")),
        "issue_close": F.concat(done("closed", "an", "issue", at("issue.html_url")), _markup("quote", at("issue.title"))),
        "issue_comment": F.concat(in_repo(F.lit(" "), opened, F.lit(" on an "), link("issue", at("issue.html_url"))), quote("comment.body")),
        "issue_open": issue,
        "pull_close": F.concat(done("", "a", "pull request", pull_url), _markup("quote", at("pull_request.title"))),
        "pull_comment": F.concat(in_repo(F.lit(" "), link("commented", comment_url), F.lit(" on a "), link("pull request", F.when(f.has("payload.issue"), at("issue.html_url")).otherwise(pull_url))), quote("comment.body")),
        "pull_open": pull,
        "push": F.concat(who, F.lit(" pushed "), F.when(size == 1, "a commit ").when(size != 0, F.concat(size.cast("string"), F.lit(" commits "))).otherwise(""), F.lit("to repository "), repo, F.lit(" branch "), _markup("code", branch)),
        "watch": F.concat(who, F.lit(" starred the repository "), repo),
        "wiki": F.concat(who, F.lit(" modified wiki pages for repository "), repo),
    }
    by_type = {
        "CreateEvent": named("created"), "DeleteEvent": named("deleted"), "IssuesEvent": issue, "PullRequestEvent": pull,
        "PullRequestReviewEvent": F.concat(done("", "a", "pull request review", review_url), quote("review.body")),
        "ReleaseEvent": F.concat(who, F.lit(" "), action, F.lit(" a "), link("release", at("release.html_url")), F.lit(" for repository "), repo, F.lit("."), quote("release.body")),
        "MemberEvent": F.concat(who, F.lit(" "), action, F.lit(" member "), member, F.lit(" for repository "), repo, F.lit(".")),
        "DiscussionEvent": F.concat(done("", "a", "discussion", at("discussion.html_url")), quote("discussion.body")),
        "PublicEvent": F.concat(who, F.lit("  made the repository "), repo, F.lit(" public.")),
    }
    type_ = f.text("type")
    out = None
    for name, sentence in by_kind.items():
        out = F.when(kind == name, sentence) if out is None else out.when(kind == name, sentence)
    for name, sentence in by_type.items():
        out = out.when(type_ == name, sentence)
    return out.otherwise(F.concat(F.lit("This is an unknown event type "), _markup("code", type_), F.lit(".")))


PARTS = r"<(user|repo|link|code|quote)\{([^}]*)\}(?:\{([^}]*)\})?>"


def markup_parts(details: Column) -> Column:
    """The marked parts of a description, in order: structs of name, text and target."""
    return F.transform(_marked(details), _part)


def _marked(details: Column) -> Column:
    return F.regexp_extract_all(details, F.lit(PARTS), F.lit(0))


def _part(marked: Column) -> Column:
    return F.struct(*(F.regexp_extract(marked, PARTS, i).alias(n) for i, n in enumerate(("name", "text", "target"), 1)))


def each_part(rows: DataFrame, name: str = "p") -> DataFrame:
    """rows of descriptions (details), one for each marked part, in its place; of a part only the fields that are read are worked out."""
    return rows.select(*(c for c in rows.columns if c != "details"), F.explode(_marked(F.col("details"))).alias(name)).withColumn(name, _part(F.col(name)))
