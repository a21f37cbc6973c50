"""Reads of a table: filters joined by and and or, order and limit, with a guard against reads that cost too much."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import shared_folder
from ..schema import Field, TableSpec


@dataclass(frozen=True)
class Filter:
    """On one field: a list of values, a range, or a part of a text (lower case both)."""

    options: tuple | None = None
    start: Any = None
    end: Any = None
    inclusive: bool = False
    contains: str | None = None

    def column(self, name: str) -> Column:
        c, out = F.col(name), []
        if self.options is not None:
            values = [v for v in self.options if v is not None]
            tests = [c.isin(values)] if values else []
            tests += [c.isNull()] if None in self.options else []
            out.append(reduce(lambda a, b: a | b, tests, F.lit(False)))
        if self.start is not None:
            out.append(c >= F.lit(self.start))
        if self.end is not None:
            out.append(c <= F.lit(self.end) if self.inclusive else c < F.lit(self.end))
        if self.contains is not None:
            out.append(F.lower(c).contains(self.contains.lower()))
        return F.coalesce(reduce(lambda a, b: a & b, out, F.lit(True)), F.lit(False))

    def check(self, f: Field) -> None:
        values = [*(self.options or ()), self.start, self.end]
        for v in values:
            if v is not None and not isinstance(v, f.kind) or isinstance(v, bool) and f.kind is not bool:
                raise ValueError(f"{f.name} is {f.kind.__name__}, {v!r} is not")
        if self.contains is not None and f.kind is not str:
            raise ValueError(f"{f.name} is no text")

    def estimate(self, f: Field) -> int | None:
        """Rows that pass, as far as is known."""
        if f.rows is None:
            return None
        if self.options is not None:
            return len(self.options) * f.rows
        if isinstance(self.start, int) and isinstance(self.end, int):
            return max(0, self.end - self.start + self.inclusive) * f.rows
        return None


@dataclass(frozen=True)
class Query:
    """A read of a table: rows that pass all filters of any branch; no branch: all rows; an empty list of branches: none."""

    spec: TableSpec
    branches: tuple[dict[str, Filter], ...] | None = None
    most: int | None = None
    fields: tuple[str, ...] = field(default=())

    def where(self, name: str, *options: Any, start: Any = None, end: Any = None, inclusive: bool = False, contains: str | None = None) -> Query:
        """One more filter on the last branch."""
        f = Filter(tuple(options) if options or (start is None and end is None and contains is None) else None, start, end, inclusive, contains)
        f.check(self.spec.field(name))
        branches = self.branches or ({},)
        return replace(self, branches=(*branches[:-1], {**branches[-1], name: f}))

    def or_(self) -> Query:
        return replace(self, branches=(*(self.branches or ({},)), {}))

    def limit(self, n: int) -> Query:
        return replace(self, most=n)

    def none(self) -> Query:
        return replace(self, branches=())

    @property
    def predicate(self) -> Column:
        if self.branches is None:
            return F.lit(True)
        rows = [reduce(lambda a, b: a & b, (f.column(n) for n, f in b.items()), F.lit(True)) for b in self.branches]
        return reduce(lambda a, b: a | b, rows, F.lit(False))

    def estimate(self) -> int | None:
        """The least known estimate within a branch, summed over branches; None where a branch has none."""
        if self.branches is None:
            return None
        total = 0
        for b in self.branches:
            known = [e for n, f in b.items() if (e := f.estimate(self.spec.field(n))) is not None]
            if not known:
                return None
            total += min(known)
        return total

    def only_keys(self) -> bool:
        return all(n in self.spec.keys for b in self.branches or () for n in b)

    def check_read(self) -> None:
        """A stored table is read by keys and indexed fields, and at most max_limit rows of it."""
        for b in self.branches or ():
            for n in b:
                if self.spec.field(n).role == "normal":
                    raise ValueError(f"{n} is not indexed")
        if self.spec.max_limit is not None:
            rows = [e for e in (self.most, self.estimate()) if e is not None]
            if not rows or min(rows) > self.spec.max_limit:
                raise ValueError(f"more than {self.spec.max_limit} rows of {self.spec.name}")

    def point(self) -> bool:
        """A ranking is read by the point form if few rows are asked for, by keys."""
        e = self.estimate()
        return self.spec.ranking and e is not None and e < 5 and self.only_keys()

    def read(self, table: DataFrame, guard: bool = True) -> DataFrame:
        """Rows of a stored table: filtered, projected, and, with a limit only, ordered by the sorted keys, newest first."""
        if guard:
            self.check_read()
        names = list(self.fields) or [f.name for f in self.spec.fields if f.read and f.name in table.columns]
        out = table.where(self.predicate).select(*names)
        if self.most is not None:
            out = out.orderBy(*(F.desc(k) for k in self.spec.sorted_keys or self.spec.keys)).limit(self.most)
        return out

    def read_ranking(self, live: DataFrame, key: str, metric: str, by: str | None = "window_size") -> DataFrame:
        """Rows of a ranking that is made from live counts: places of the asked keys only where the point form serves, else the whole ranking, filtered."""
        from ..operators import ranking as R

        self.check_read()
        if not self.point():
            return self.read(R.snapshot(live, key, metric, by).drop("seq_num"), guard=False)
        wanted = live.where(self.predicate).select(*([by] if by else []), key)
        return self.read(R.points(live, wanted, key, metric, by), guard=False)

    def live(self, changes: DataFrame) -> DataFrame:
        """Change rows, of a batch or a stream, that match."""
        return changes.where(self.predicate)


def matched(changes: DataFrame, queries: Sequence[tuple[str, Query]]) -> DataFrame:
    """Change rows with the names of the subscriptions that they match."""
    names = F.filter(F.array(*(F.when(q.predicate, F.lit(n)) for n, q in queries)), lambda x: x.isNotNull())
    return changes.withColumn("subscriptions", names).where(F.size("subscriptions") > 0)


#: Ranges are told apart as far as this; what lies beyond meets at its edge and is compared there.
EDGE = 2**62


def intervals(least: Column, below: Column) -> Column:
    """The dyadic intervals (level, prefix) that a range of whole numbers [least, below) is made of, two a level at most; a null side is open.

    A number v is in the range if, for one of them, v shifted right by the level is the prefix.
    """
    low = F.least(F.greatest(F.coalesce(least, F.lit(-EDGE)), F.lit(-EDGE)), F.lit(EDGE))
    high = F.least(F.greatest(F.coalesce(below, F.lit(EDGE + 1)), F.lit(-EDGE + 1)), F.lit(EDGE + 1))
    start = lambda x: F.call_function("shiftright", low - 1, x) + 1  # noqa: E731  rounded up
    end = lambda x: F.call_function("shiftright", high, x)
    at = lambda x, p, there: F.when((start(x) < end(x)) & there, F.struct(x.alias("level"), p.alias("prefix")))
    odd = lambda c: c.bitwiseAND(F.lit(1)) == 1
    levels = F.sequence(F.lit(0), F.lit(62))
    both = F.transform(levels, lambda x: F.array(at(x, start(x), odd(start(x))), at(x, end(x) - 1, odd(end(x)))))
    return F.filter(F.flatten(both), lambda x: x.isNotNull())


def _branches(subscriptions: DataFrame) -> DataFrame:
    """name, branch and the branch's filters, _f."""
    return subscriptions.groupBy("name", "branch").agg(F.sort_array(F.collect_list(F.struct("field", "options", "least", "below"))).alias("_f"))


def _met(changes: DataFrame, branches: DataFrame, key: str) -> DataFrame:
    """key and name, once for each branch that a change row matches; see `subscribed`."""
    subs = branches.select(F.struct("name", "branch").alias("_b"), "_f", F.posexplode("_f").alias("_at", "_o"))
    subs = subs.select("_b", "_at", F.filter("_f", lambda f, i: i != F.col("_at")).alias("_rest"), "_o.*")
    one = subs.where("options IS NOT NULL").select("_b", "_at", "_rest", "field", F.explode(F.array_distinct("options")).alias("value"))
    spans = subs.where("options IS NULL").select("_b", "_at", "_rest", "field", "least", "below", F.explode(intervals(F.col("least"), F.col("below"))).alias("_i"))
    spans = spans.select("_b", "_at", "_rest", "field", "least", "below", "_i.level", "_i.prefix")

    # a few names and numbers, as many as there are columns and levels
    said = [r["field"] for r in one.select("field").distinct().collect()]
    steps: dict[str, list[int]] = {}
    for r in spans.select("field", "level").distinct().collect():
        steps.setdefault(r["field"], []).append(r["level"])
    known = [c for c in changes.columns if c != key and (c in said or c in steps)]
    if not known:
        return changes.limit(0).select(key, F.lit("").alias("name"))
    number = lambda c: F.try_to_number(c, F.lit("S999999999999999999999")).cast("decimal(21,0)")
    text = {c: F.col(c).cast("string") for c in known}
    rows = changes.select(key, F.create_map(*(x for c, t in text.items() for x in (F.lit(c), F.struct(t.alias("value"), number(t).alias("n"))))).alias("_row"))

    def cells(fields: list[str]) -> DataFrame:
        return rows.select(key, "_row", F.explode(F.map_filter("_row", lambda c, _: c.isin(fields))).alias("field", "_v")).select(key, "_row", "field", "_v.value", F.col("_v.n").alias("_n"))

    within = lambda n, least, below: F.coalesce(n.isNotNull() & (least.isNull() | (n >= least)) & (below.isNull() | (n < below)), F.lit(False))
    at = lambda f: F.col("_row")[f["field"]]
    holds = lambda f: F.when(f["options"].isNotNull(), F.coalesce(F.array_contains(f["options"], at(f)["value"]), F.lit(False))).otherwise(within(at(f)["n"], f["least"], f["below"]))
    rest = F.forall("_rest", holds)
    named = cells(said).where("value IS NOT NULL")
    ways = [(named, one, ["field", "value"], F.lit(True))]
    if steps:
        edge = F.lit(EDGE).cast("decimal(21,0)")
        levels = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, sorted(x))) for p in steps.items() for x in p))[F.col("field")]
        ranged = cells(list(steps)).where("_n IS NOT NULL").withColumn("_v", F.greatest(F.least("_n", edge), -edge).cast("long"))
        ranged = ranged.withColumn("level", F.explode(levels)).withColumn("prefix", F.expr("shiftright(_v, level)"))
        ways.append((ranged, spans, ["field", "level", "prefix"], within(F.col("_n"), F.col("least"), F.col("below"))))
    counted = [w.select("_b", "_at", *on).join(c.groupBy(*on).agg(F.count("*").alias("n")), on, "left").select("_b", "_at", F.coalesce("n", F.lit(0)).alias("n")) for c, w, on, _ in ways]
    best = reduce(DataFrame.unionByName, counted).groupBy("_b", "_at").agg(F.sum("n").alias("n")).groupBy("_b").agg(F.min_by("_at", F.struct("n", "_at")).alias("_at"))
    met = [c.join(w.join(best, ["_b", "_at"]).hint("merge"), on).where(own & rest).select(key, "_b.name") for c, w, on, own in ways]
    return reduce(DataFrame.unionByName, met)


def subscribed(changes: DataFrame, subscriptions: DataFrame, key: str) -> DataFrame:
    """Change rows (their key and the subscription) that match subscriptions in a table: name, branch, field, options (texts) or least and below.

    A row matches a subscription if all filters of one branch do.  A branch joins by that one of its filters that the fewest rows meet, which is counted first;
    its others are looked at on the joined row, so a filter that most rows meet makes no pairs of its own.  Filters with options join by field and value; ranges are
    cut into dyadic intervals, some sixty at most, and join by field, level and prefix, so a value meets the ranges that hold it and no others.  Only fields and
    levels that subscriptions name are taken apart.  A filter without any bound holds for each value that is a whole number.
    """
    return _met(changes, _branches(subscriptions), key).distinct()


def _never_both(x: Column, y: Column) -> Column:
    """Two filters that no row meets both: on one field, with other options or with ranges that lie apart."""
    other = F.when(x["options"].isNotNull() & y["options"].isNotNull(), ~F.coalesce(F.arrays_overlap(x["options"], y["options"]), F.lit(False)))
    other = other.when(x["options"].isNull() & y["options"].isNull(), F.greatest(x["least"], y["least"]) >= F.least(x["below"], y["below"]))
    return F.coalesce((x["field"] == y["field"]) & other, F.lit(False))


def subscribed_totals(changes: DataFrame, subscriptions: DataFrame, sums: Sequence[str]) -> DataFrame:
    """Of each subscription (see `subscribed`) that matches any change row: name, n of these rows, and the sums of the named columns over them.

    Rows are grouped by the fields that a branch looks at, and branches meet groups: where many subscriptions follow the same rows, pairs are subscriptions times
    groups, not times rows.  A row counts once for a subscription: branches of which no row meets two are counted each by its own fields; has a subscription
    others, all its branches meet groups by all its fields, and a group that several meet counts once.
    """
    shared_folder(changes.sparkSession)
    fields = lambda b: F.transform(b["_f"], lambda f: f["field"])
    apart = lambda a, b: F.exists(a["_f"], lambda x: F.exists(b["_f"], lambda y: _never_both(x, y)))
    known = lambda names: F.array_sort(F.array_distinct(F.filter(names, lambda c: c.isin(changes.columns))))
    names = _branches(subscriptions).groupBy("name").agg(F.collect_list(F.struct("branch", "_f")).alias("_bs"))
    names = names.withColumn("_bs", F.transform("_bs", lambda b, i: F.struct(i.alias("at"), b["branch"].alias("branch"), b["_f"].alias("_f"))))
    names = names.withColumn("_meet", F.exists("_bs", lambda a: F.exists("_bs", lambda b: (a["at"] < b["at"]) & ~apart(a, b))))
    units = names.select("name", "_meet", F.flatten(F.transform("_bs", fields)).alias("_all"), F.explode("_bs").alias("_b"))
    units = units.select("name", "_b.branch", "_b._f", "_meet", known(F.when(F.col("_meet"), F.col("_all")).otherwise(fields(F.col("_b")))).alias("_by")).checkpoint()

    found, totals = [], ["_n", *(f"_sum{i}" for i in range(len(sums)))]
    for by, meet in units.where(F.size("_by") > 0).groupBy("_by").agg(F.max("_meet")).collect():  # a few combinations of columns
        text = [F.col(c).cast("string").alias(c) for c in by]
        groups = changes.groupBy(*text).agg(F.count("*").alias("_n"), *(F.sum(c).alias(t) for c, t in zip(sums, totals[1:], strict=True)))
        groups = groups.select(F.struct(F.struct(*by).alias("by"), *totals).alias("_group"), *by)
        pairs = _met(groups, units.where(F.col("_by") == F.array(*map(F.lit, by))), "_group")
        found.append((pairs.distinct() if meet else pairs).select("name", *(F.col(f"_group.{t}") for t in totals)))
    if not found:
        return changes.limit(0).select(F.lit("").alias("name"), F.lit(0).cast("long").alias("n"), *sums)
    return reduce(DataFrame.unionByName, found).groupBy("name").agg(*(F.sum(t).alias(c) for t, c in zip(totals, ["n", *sums], strict=True)))


def snapshot_plus_changes(snapshot: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a snapshot brought up to date: changes no newer than the snapshot are dropped, then the newest of a key counts."""
    from ..operators.versioning import merge_rows

    newest = snapshot.agg(F.max("seq_num").alias("_newest"))
    fresh = changes.crossJoin(F.broadcast(newest)).where(F.col("_newest").isNull() | (F.col("seq_num") > F.col("_newest"))).drop("_newest")
    return merge_rows(snapshot.unionByName(fresh), keys)
