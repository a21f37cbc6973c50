"""Rankings: snapshots, points, pages, and the log of how places change."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import dealt_anew, shared_folder, ship
from ..schema import kind_order

PLACES = ("row_number", "rank", "max_rank")


def _tie(key: str) -> Column:
    return kind_order(key) if key == "kind" else F.col(key)


def snapshot(live: DataFrame, key: str, metric: str, by: str | None = "window_size", all_versions: bool = True) -> DataFrame:
    """Zero-based row_number and rank, and max_rank (the end of the tie group), by metric descending, key ascending; metric > 0.

    All rankings are one order, cut by range into tasks of equal size, however many rows a ranking or a tie group has: places are counted
    along it, and a tie group starts at its least place.  seq_num is the ranking's version: the greatest of all rows, or of the ranked ones.
    """
    part = [by] if by else []
    ranked = live.where(F.col(metric) > 0)
    placed = numbered(ranked.select(*part, key, metric), [*part, F.desc(metric), _tie(key)])
    ties = placed.groupBy(*part, metric).agg(F.min("_i").alias("rank"), F.count("*").alias("_ties")).select(*part, dealt_anew(metric), "rank", (F.col("rank") + F.col("_ties")).alias("max_rank"))
    # one row for each ranking
    starts = placed.groupBy(*part).agg(F.min("_i").alias("_start"))
    version = (live if all_versions else ranked).groupBy(*part).agg(F.max("seq_num").alias("seq_num"))
    heads = starts.join(version, part) if part else starts.crossJoin(version)
    rows = placed.join(ties.hint("merge"), [*part, metric])
    rows = rows.join(F.broadcast(heads), part) if part else rows.crossJoin(F.broadcast(heads))
    return rows.select(*part, key, metric, *((F.col(c) - F.col("_start")).alias(n) for c, n in (("_i", "row_number"), ("rank", "rank"), ("max_rank", "max_rank"))), "seq_num")


def points(live: DataFrame, wanted: DataFrame, key: str, metric: str, by: str | None = "window_size", limit: int = 1000) -> DataFrame:
    """row_number, rank and max_rank of the wanted keys only, without ranking the rest.

    At most `limit` wanted rows meet every row as a broadcast, behind that check; more take the ranking itself.
    """
    part = [by] if by else []
    asked = live.where(F.col(metric) > 0).join(wanted, [c for c in (*part, key) if c in wanted.columns], "left_semi").select(*part, key, metric)
    if len(asked.take(limit + 1)) > limit:
        return snapshot(live, key, metric, by).join(asked.select(*part, key), [*part, key], "left_semi").select(*part, key, metric, *PLACES)
    o = asked.select(*(F.col(c).alias(f"o_{c}") for c in (*part, key, metric)))
    i = live.where(F.col(metric) > 0)
    same = F.col(f"o_{by}") == F.col(by) if by else F.lit(True)
    above = F.col(metric) > F.col(f"o_{metric}")
    tied = F.col(metric) == F.col(f"o_{metric}")
    less = _tie(key) < (kind_order(f"o_{key}") if key == "kind" else F.col(f"o_{key}"))
    out = i.join(F.broadcast(o), same & (above | tied)).groupBy(*(f"o_{c}" for c in (*part, key, metric))).agg(
        F.count_if(above | (tied & less)).alias("row_number"), F.count_if(above).alias("rank"), F.count("*").alias("max_rank")
    )
    return out.select(*(F.col(f"o_{c}").alias(c) for c in (*part, key, metric)), *PLACES)


def page(ranking: DataFrame, start: int, end: int, margin: int = 50) -> DataFrame:
    """Rows [start - margin, end + margin) of the ranking."""
    return ranking.where((F.col("row_number") >= max(0, start - margin)) & (F.col("row_number") < end + margin))


def diff(before: DataFrame, after: DataFrame, key: str, metric: str, by: str | None = "window_size") -> DataFrame:
    """Changes between two snapshots of rankings: a row for each key whose metric changed, with new and old places; null where unranked."""
    part = [by] if by else []
    old = before.select(*part, key, F.col(metric).alias("old_metric"), *(F.col(p).alias(f"old_{p}") for p in PLACES))
    out = after.drop("seq_num").join(old, [*part, key], "full")
    return out.where(~F.col(metric).eqNullSafe(F.col("old_metric"))).select(*part, key, metric, *PLACES, *(f"old_{p}" for p in PLACES))


def _in_order(rows: DataFrame, order: list) -> DataFrame:
    """rows sorted in tasks of a range each, with _part and _id, which grow along the order; stored, so that the cuts stay."""
    shared_folder(rows.sparkSession)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return placed.checkpoint().withColumn("_part", F.shiftright("_id", 33))


def numbered(rows: DataFrame, order: list) -> DataFrame:
    """rows with _i, their place in the order, from 0: sorted partitions are counted, and each starts where those before it end."""
    placed = _in_order(rows, order)
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    placed = placed.join(F.broadcast(starts), "_part")  # a row a partition
    return placed.withColumn("_i", F.col("_start") + F.col("_id").bitwiseAND(F.lit(2**33 - 1))).drop("_id", "_part", "_start")


#: Rows of a slab, as bits: what a task counts at once.
SMALL = 16


def _before(times: np.ndarray, d: np.ndarray) -> np.ndarray:
    """For each row, in order: the sum of d over the rows ahead of it with a lesser time.  times: whole numbers from 0.

    Times are told apart bit by bit, the highest first: of rows that agree in all higher bits, one with the bit set counts those ahead without it.
    """
    out, at = np.zeros(len(d), np.int64), np.arange(len(d))
    times = times.astype(np.uint16 if len(times) and times.max() < 2**16 else np.int64)  # short numbers are sorted by radix
    for bit in reversed(range(int(times.max()).bit_length() if len(times) else 0)):
        own = times[at]
        group, one = own >> bit >> 1, (own >> bit & 1).astype(bool)
        sums = np.concatenate([[0], np.cumsum(np.where(one, 0, d[at]))])
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        first = np.repeat(starts, np.diff(np.concatenate([starts, [len(at)]])))
        out[at] += np.where(one, sums[:-1] - sums[first], 0)
        at = at[np.argsort(own >> bit, kind="stable")]
    return out


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]


def _in_place_slab(bits: int, rows: pa.Table, grid: pa.Table) -> pa.Table:
    """Adds n to rows of one slab of places: d of the rows before in place and in an earlier slab of times, in this slab and (grid) in those before."""
    place, t, d = _columns(rows, "_i", "_t", "d")
    slab, by_place = t >> bits, np.argsort(place)
    known = dict(zip(*(c.tolist() for c in _columns(grid, "_a", "n")), strict=True))
    slabs, dense = np.unique(slab, return_inverse=True)
    n = np.array([known[a] for a in slabs.tolist()], np.int64)[dense]
    n[by_place] += _before(dense[by_place], d[by_place])
    return rows.append_column("n", pa.array(n)).select(["which", "_i", "_t", "new", "d", "n"])


def _in_time_slab(bits: int, rows: pa.Table) -> pa.Table:
    """The counts of one slab of times, a row for each update: n, and d of the slab's own rows before in both."""
    which, place, t, new, d, n = _columns(rows, "which", "_i", "_t", "new", "d", "n")
    first = (t[0] >> bits) << bits
    told = {(side, w): np.zeros(1 << bits, np.int64) for side in (True, False) for w in range(3)}
    for w in range(3):
        mine = np.flatnonzero(which == w)
        mine = mine[np.argsort(place[mine])]
        own = t[mine] - first
        sums = n[mine] + _before(own, d[mine])
        for side in (True, False):
            here = new[mine] == side
            told[side, w][own[here]] = sums[here]
    at = np.unique(t - first)
    names = {"_i": at + first}
    for name, side in (("new", True), ("old", False)):
        g, gt, gb = (told[side, w][at] for w in range(3))
        names |= {f"{name}_g": g, f"{name}_b": gb - g, f"{name}_t": gt - g}
    return pa.table(names)


def _counted_above(points: DataFrame, by: str, key: str, last: int) -> DataFrame:
    """_i, and for its new and its old point, of the earlier points of its ranking: g of greater values, t of that value, b of that value with a key not greater.

    points: by, key, _i (times, up to `last`), new, v, d.  An earlier point that comes before in some order of places counts, so three orders tell all:
    by value with the latest first (g), with the earliest first (g and t), and by value, then key (g and b).  Rankings are in falling order, as times have
    them rising: of another ranking nothing counts.  Places and times are cut into slabs of one size, whatever rankings, values or keys are in them: a point gets what lies in earlier
    slabs of both from sums over their grid, and the rest from the points of its own slab of places and of its own slab of times.  So the work is a few
    sorts and groupings; the grid has (rows / 2**SMALL)**2 cells of two numbers, twice for the two sides of an update.
    """
    spark, bits = points.sparkSession, SMALL
    ship(spark)
    points = points.withColumnRenamed("_i", "_t")
    value = [F.desc(by), F.desc("v")]
    parts = []
    for which, order in enumerate(([F.desc("_t")], [F.asc("_t")], [_tie(key), F.asc("_t")])):
        rows = numbered(points, [*value, *order, "new"]).select(F.lit(which).alias("which"), "_i", "_t", "new", "d", F.shiftright("_i", bits).alias("_c"))
        high, wide = (last >> bits) + 1, (2 * last + 1 >> bits) + 1
        none = spark.range(high * wide).select(F.floor(F.col("id") / wide).alias("_a"), (F.col("id") % wide).alias("_c"), F.lit(0).cast("long").alias("d"))
        cells = rows.groupBy(F.shiftright("_t", bits).alias("_a"), "_c").agg(F.sum("d").alias("d")).unionByName(none).groupBy("_a", "_c").agg(F.sum("d").alias("d"))
        ahead = lambda part, order: Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumn("d", F.coalesce(F.sum("d").over(ahead("_a", "_c")), F.lit(0)))
        cells = cells.select(F.col("_c").alias("_slab"), "_a", F.coalesce(F.sum("d").over(ahead("_c", "_a")), F.lit(0)).alias("n"))
        parts.append(rows.groupBy("_c").cogroup(cells.groupBy("_slab")).applyInArrow(lambda rows, grid: _in_place_slab(bits, rows, grid), "which int, _i long, _t long, new boolean, d long, n long"))
    return reduce(DataFrame.unionByName, parts).groupBy(F.shiftright("_t", bits)).applyInArrow(lambda rows: _in_time_slab(bits, rows), "_i long, new_g long, new_b long, new_t long, old_g long, old_b long, old_t long")


def exact_changes(
    updates: DataFrame, key: str, metric: str, by: str = "window_size", version: str = "seq_num", cutoff: int = 0, state: RankingState | None = None
) -> DataFrame:
    """The log of one update at a time, by version, then key: new places and, as old_*, those before; null where unranked.

    An update adds a point (value, key) and takes the key's last one away; its place is what earlier updates added, less what
    they took, above it: _counted_above().
    state: the rankings that earlier updates led to, from which places start.  Rows without a ranking or a key go.
    """
    own = Window.partitionBy(by, key).orderBy(version)
    value = F.when(F.col(metric) > cutoff, F.col(metric))
    rows = updates.where(F.col(by).isNotNull() & F.col(key).isNotNull()).select(by, version, key, metric, value.alias("_new"), F.lag(value).over(own).alias("_old"), F.row_number().over(own).alias("_nth"))
    if state is not None:
        was = state.points.select(by, key, F.col("value").alias("_was"))
        rows = rows.join(was.hint("merge"), [by, key], "left").withColumn("_old", F.when(F.col("_nth") == 1, F.col("_was")).otherwise(F.col("_old")))
    else:
        rows = rows.withColumn("_was", F.lit(None).cast(dict(rows.dtypes)[metric]))
    rows = numbered(rows.drop("_nth").where("_new IS NOT NULL OR _old IS NOT NULL"), [by, version, key])
    sides = F.explode(F.array(F.struct(F.lit(True).alias("new"), F.col("_new").alias("v"), F.lit(1).cast("long").alias("d")), F.struct(F.lit(False).alias("new"), F.col("_old").alias("v"), F.lit(-1).cast("long").alias("d"))))
    points = rows.select(by, key, "_i", sides.alias("_p")).select(by, key, "_i", "_p.*").where("v IS NOT NULL")
    told = _counted_above(points, by, key, rows.agg(F.max("_i").alias("n")).first()["n"] or 0)
    rows = rows.join(told.hint("merge"), "_i")
    # the key's own points of a value came before its new one in the order of keys: what the batch has left of them so far is one, none or, of a state's, minus one
    alike = lambda a, b: F.coalesce(a == b, F.lit(False)).cast("int")
    own_left = lambda side: alike(F.col("_old"), F.col(side)) - alike(F.col("_was"), F.col(side))
    rows = rows.withColumns({f"{side}_b": F.col(f"{side}_b") - own_left(f"_{side}") for side in ("new", "old")})
    if state is not None:
        known = state.counts_at(points.select(by, "v", key).distinct())
        for side in ("new", "old"):
            mine = known.select(by, F.col("v").alias(f"_{side}"), key, *(F.col(c).alias(f"_s{c}") for c in "gbt"))
            rows = rows.join(mine.hint("merge"), [by, f"_{side}", key], "left")
            rows = rows.withColumns({f"{side}_{c}": F.col(f"{side}_{c}") + F.coalesce(f"_s{c}", F.lit(0)) for c in "gbt"}).drop(*(f"_s{c}" for c in "gbt"))
    # a key's own last point counts for nothing in its new place
    passed, stayed = (F.coalesce(t, F.lit(False)).cast("int") for t in (F.col("_old") > F.col("_new"), F.col("_old") >= F.col("_new")))
    ranked, was = F.col("_new").isNotNull(), F.col("_old").isNotNull()
    rank = F.col("new_g") - passed
    places = (rank + F.col("new_b"), rank, F.col("new_g") + F.col("new_t") - stayed + 1)
    old = (F.col("old_g") + F.col("old_b"), F.col("old_g"), F.col("old_g") + F.col("old_t"))
    return rows.select(by, version, key, metric, *(F.when(ranked, p).alias(n) for n, p in zip(PLACES, places, strict=True)), *(F.when(was, p).alias(f"old_{n}") for n, p in zip(PLACES, old, strict=True)))


#: Keys of a block, as bits: a ranking has a key once, so a block of one value has at most this many points.
KEYS = 12


@dataclass(frozen=True)
class RankingState:
    """Rankings between batches: points (by, key, value), and how many points each value has in each block of keys (by, v, block, n).

    Places of a batch's points come from the counts, and from the points of their own blocks.
    """

    points: DataFrame
    counts: DataFrame
    key: str
    by: str = "window_size"

    def _block(self) -> Column:
        """Blocks in the order of keys: of whole numbers 2**KEYS each, of texts those with one beginning."""
        if self.key == "kind":
            return F.lit(0).cast("long")
        whole = dict(self.points.dtypes)[self.key] in ("tinyint", "smallint", "int", "bigint")
        return F.shiftright(F.col(self.key).cast("long"), KEYS) if whole else F.substring(self.key, 1, 3)

    @staticmethod
    def of(points: DataFrame, key: str, metric: str, by: str = "window_size") -> RankingState:
        """The state of a ranking's rows, or of none; counts are made from the points."""
        state = RankingState(points.select(by, key, F.col(metric).alias("value")), points, key, by)
        counts = state.points.select(by, F.col("value").alias("v"), state._block().alias("block")).groupBy(by, "v", "block").agg(F.count("*").alias("n"))
        return RankingState(state.points, counts, key, by)

    def counts_at(self, asked: DataFrame) -> DataFrame:
        """asked (by, v, key, each once) with g, t and b: points of greater values, of that value, and of that value with a lesser key."""
        by, key = self.by, self.key
        asked = asked.withColumn("block", self._block()).checkpoint()
        zero = F.lit(0).cast("long").alias("n")
        values = self.counts.groupBy(by, "v").agg(F.sum("n").alias("n")).unionByName(asked.select(by, "v", zero).distinct()).groupBy(by, "v").agg(F.sum("n").alias("t"))
        greater = Window.partitionBy(by).orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, -1)
        values = values.withColumn("g", F.coalesce(F.sum("t").over(greater), F.lit(0)))
        met = asked.select(by, "v").distinct()
        blocks = self.counts.join(met.hint("merge"), [by, "v"], "left_semi").select(by, "v", "block", "n").unionByName(asked.select(by, "v", "block", zero).distinct()).groupBy(by, "v", "block").agg(F.sum("n").alias("n"))
        lesser = Window.partitionBy(by, "v").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        blocks = blocks.select(by, "v", "block", F.coalesce(F.sum("n").over(lesser), F.lit(0)).alias("ahead"))
        near = self.points.select(by, F.col("value").alias("v"), key, self._block().alias("block")).join(asked.select(by, "v", "block").distinct().hint("merge"), [by, "v", "block"], "left_semi")
        near = near.withColumn("n", F.lit(1).cast("long")).withColumn("asked", F.lit(0)).unionByName(asked.select(by, "v", key, "block", zero, F.lit(1).alias("asked")))
        near = near.groupBy(by, "v", "block", key).agg(F.sum("n").alias("n"), F.max("asked").alias("asked"))
        inside = Window.partitionBy(by, "v", "block").orderBy(_tie(key)).rowsBetween(Window.unboundedPreceding, -1)
        near = near.withColumn("here", F.coalesce(F.sum("n").over(inside), F.lit(0))).where("asked = 1")
        return near.join(blocks.hint("merge"), [by, "v", "block"]).join(values.hint("merge"), [by, "v"]).select(by, "v", key, "g", "t", (F.col("ahead") + F.col("here")).alias("b"))

    def after(self, updates: DataFrame, metric: str, version: str = "seq_num", cutoff: int = 0) -> RankingState:
        """The state behind the updates; counts change by what they add and take."""
        by, key = self.by, self.key
        last = updates.where(F.col(by).isNotNull() & F.col(key).isNotNull()).groupBy(by, key).agg(F.max_by(F.struct(F.when(F.col(metric) > cutoff, F.col(metric)).alias("value")), version).alias("_last"))
        both = self.points.join(last.hint("merge"), [by, key], "full").select(by, key, F.col("value").alias("_old"), F.when(F.col("_last").isNotNull(), F.col("_last.value")).otherwise(F.col("value")).alias("value"), F.col("_last").isNotNull().alias("_moved"))
        both = both.checkpoint()
        sides = F.explode(F.array(F.struct(F.col("value").alias("v"), F.lit(1).cast("long").alias("n")), F.struct(F.col("_old").alias("v"), F.lit(-1).cast("long").alias("n"))))
        moves = both.where("_moved").select(by, self._block().alias("block"), sides.alias("s")).select(by, "s.v", "block", "s.n").where("v IS NOT NULL")
        counts = self.counts.select(by, "v", "block", "n").unionByName(moves).groupBy(by, "v", "block").agg(F.sum("n").alias("n")).where("n <> 0")
        return RankingState(both.where("value IS NOT NULL").select(by, key, "value"), counts, key, by)


def replay(changes: DataFrame, key: str, metric: str, by: str | None = "window_size", version: str = "seq_num") -> DataFrame:
    """The ranking that a log of changes leads to: the last metric of each key, ranked."""
    part = [by] if by else []
    last = changes.groupBy(*part, key).agg(F.max_by(metric, version).alias(metric), F.max(version).alias("seq_num"))
    return snapshot(last.where(F.col(metric) > 0), key, metric, by)


def broken(changes: DataFrame, key: str, metric: str, by: str = "window_size", version: str = "seq_num", cutoff: int = 0) -> DataFrame:
    """The rows of a log that can't stand where they are, with `problem`: why.

    A change's old places must be where the changes before it left its key, and its new ones those of its metric.  Both are counted from the
    log's metrics alone; a key that comes or goes has no places on that side, and a row_number lies in its tie group.
    """
    old = [f"old_{p}" for p in PLACES]
    value = F.when(F.col(metric) > cutoff, F.col(metric))
    had = F.lag(value).over(Window.partitionBy(by, key).orderBy(version))
    right = exact_changes(changes.select(by, version, key, metric), key, metric, by, version, cutoff).select(by, version, key, *(F.col(c).alias(f"_{c}") for c in (*PLACES, *old)))
    rows = changes.select(by, version, key, metric, *PLACES, *old, had.alias("_had")).join(right.hint("merge"), [by, version, key], "left")
    every = lambda tests: reduce(lambda a, b: a & b, tests)
    none = lambda names: every(F.col(n).isNull() for n in names)
    same = lambda names: every(F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names)
    inside = lambda pre: F.coalesce((F.col(f"{pre}rank") <= F.col(f"{pre}row_number")) & (F.col(f"{pre}row_number") < F.col(f"{pre}max_rank")), F.lit(True))
    problem = (
        F.when(F.col("_had").isNull() & ~none(old), "a new key has old places")
        .when(F.col("_had").isNotNull() & none(old), "a ranked key has no old places")
        .when(value.isNull() & ~none(PLACES), "a key that goes has new places")
        .when(value.isNotNull() & none(PLACES), "a ranked key has no new places")
        .when(~inside("") | ~inside("old_"), "row_number is outside its tie group")
        .when(~same(old), "old places aren't where the log had left the key")
        .when(~same(PLACES), "new places aren't those of the metric")
    )
    return rows.withColumn("problem", problem).where("problem IS NOT NULL").select(by, version, key, metric, *PLACES, *old, "problem")
