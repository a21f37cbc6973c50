"""Event kinds, window sizes and the catalogue of tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Event kinds; their order is the sort order.
KINDS = (
    "all", "push", "watch", "create_repo", "create_branch", "delete_branch", "fork", "wiki", "issue_open", "issue_close",
    "pull_open", "pull_close", "commit_comment", "issue_comment", "pull_comment", "other",
)
#: Sliding windows in seconds, and their weights in the trending score.
WINDOW_SIZES = {"5m": 300, "1h": 3600, "6h": 21600, "24h": 86400}
TREND_WEIGHTS = {"5m": 10, "1h": 5, "6h": 2, "24h": 1}


def kind_order(kind: str = "kind") -> Column:
    """Place of a kind in the order of kinds."""
    return F.array_position(F.array(*map(F.lit, KINDS)), F.col(kind))


@dataclass(frozen=True)
class Field:
    """A field of a stored table.  role: normal, indexed, key or sorted (a key that orders reads); rows: expected rows for one value."""

    name: str
    kind: type
    role: str = "normal"
    rows: int | None = None
    read: bool = True


@dataclass(frozen=True)
class TableSpec:
    name: str
    fields: tuple[Field, ...]
    max_limit: int | None = None
    #: Rows whose metric is zero are deleted on upsert.
    drop_zero: str | None = None
    #: Fields have versions of their own.
    per_field: bool = False
    ranking: bool = False
    point: bool = field(default=False)

    @property
    def keys(self) -> list[str]:
        return [f.name for f in self.fields if f.role in ("key", "sorted")]

    @property
    def sorted_keys(self) -> list[str]:
        return [f.name for f in self.fields if f.role == "sorted"]

    @property
    def values(self) -> list[str]:
        return [f.name for f in self.fields if f.role not in ("key", "sorted") and f.name != "seq_num"]

    def field(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise ValueError(f"{self.name} has no field {name}")


SEQ = Field("seq_num", int)


def _live(name: str, key: str, metric: str, kind: type, size_rows: int | None, key_rows: int, limit: int | None, drop: bool) -> list[TableSpec]:
    keys = (Field("window_size", str, "key", size_rows), Field(key, kind, "key", key_rows), Field(metric, int))
    places = tuple(Field(n, int, "indexed", 4) for n in ("row_number", "rank", "max_rank"))
    return [
        TableSpec(f"{name}_live", (*keys, SEQ), limit, drop_zero=metric if drop else None),
        TableSpec(f"{name}_ranking", (*keys, *places, SEQ), limit, ranking=True),
    ]


def _history(name: str, key: str, metric: str, kind: type) -> list[TableSpec]:
    rows = None if kind is str else 5000
    at = 16 if kind is str else None
    fields = (Field(key, kind, "key", rows), Field("ts_start", str, "sorted", at), Field("ts_end", str, "sorted", at), Field(metric, int), SEQ)
    return [TableSpec(f"{name}_history", fields, None if kind is str else 5000), TableSpec(f"{name}_history_fine", fields, 5000)]


#: Names, fields, key roles, expected rows for a value and read limits of the stored tables.
_score = (Field("repo_id", int, "key", 1), Field("trending_score", int))
TABLES: dict[str, TableSpec] = {
    t.name: t
    for t in (
        TableSpec("events", (Field("created_at", str, "sorted", 50), Field("id", int, "sorted", 1), Field("kind", str, "indexed"), Field("repo_id", int, "indexed"), Field("user_id", int, "indexed"), Field("details", str), SEQ), 1000),
        TableSpec("users", (Field("id", int, "key", 1), Field("username", str, "indexed", 1), *(Field(n, str) for n in ("avatar_url", "html_url", "user_type")), SEQ), 1000, per_field=True),
        TableSpec(
            "repos",
            (
                Field("id", int, "key", 1), Field("reponame", str, "indexed", 100), Field("fullname", str, "indexed", 1), Field("owner_id", int), *(Field(n, str) for n in ("html_url", "homepage", "descr", "topics", "lang", "license")),
                Field("is_fork", bool), Field("is_archived", bool), *(Field(n, int) for n in ("fork_count", "issue_count", "star_count")), SEQ,
            ),
            1000, per_field=True,
        ),
        *_live("counts", "kind", "num_events", str, 16, 4, None, False),
        *_live("users", "user_id", "num_events", int, None, 4, 1000, True),
        *_live("repos", "repo_id", "num_events", int, None, 4, 1000, True),
        *_live("stars", "repo_id", "num_stars", int, None, 4, 1000, True),
        *_history("counts", "kind", "num_events", str), *_history("users", "user_id", "num_events", int),
        *_history("repos", "repo_id", "num_events", int), *_history("stars", "repo_id", "num_stars", int),
        TableSpec("trending_live", (*_score, SEQ), 1000, drop_zero="trending_score"),
        TableSpec("trending_ranking", (*_score, *(Field(n, int, "indexed", 1) for n in ("row_number", "rank", "max_rank")), SEQ), 1000, ranking=True),
    )
}
