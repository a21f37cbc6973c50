"""The live jobs: raw events to typed events without duplicates, then counts, rankings and tables.

Two queries, as deduplication and windows want different watermarks and Spark keeps one for a query.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..operators import history as H
from ..operators import ranking as R
from ..operators import sliding as S
from ..runtime import ship
from ..schema import TABLES, WINDOW_SIZES, Field, TableSpec
from ..sources import events as E
from ..sources.tables import Store, merged, ordered_topic_rows, topic_rows

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT_OF_ORDER = 10


def deduplicated(stream: DataFrame, delay: str = "30 minutes") -> DataFrame:
    """Each id once; an id is remembered for `delay` of event time."""
    return stream.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["id"])


class Seen(StatefulProcessor):
    """Rows of ids not seen before, or not for `ms` of the stream's time; each sight, of a repeat too, starts that time anew.

    A key is a bucket of ids, which keeps until when each of its ids is remembered in one value: a call, a frame and a read of state for each id would
    cost far more than the look.  A repeat has the time of its first event, so the time of a sight is the stream's clock, or the event's own where that
    is later.  The watermark runs `behind` that clock, so that the engine takes no first event for late; timers are set as much earlier.
    """

    def __init__(self, id_type, columns: list[str], ms: int, behind: int):
        self.id_type, self.columns, self.ms, self.behind = id_type, columns, ms, behind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", StructType([StructField("ids", ArrayType(self.id_type)), StructField("ms", ArrayType(LongType()))]))

    def _load(self) -> dict:
        return dict(zip(*self.until.get(), strict=True)) if self.until.exists() else {}

    def _store(self, known: dict) -> None:
        """Writes what is known of the bucket, and one timer, at which the first of its ids is to go."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if known:
            self.until.update((list(known), list(known.values())))
            self.handle.registerTimer(min(known.values()) - self.behind)
        else:
            self.until.clear()

    def handleInputRows(self, key, rows, timerValues):
        now, known = timerValues.getCurrentWatermarkInMs() + self.behind, self._load()
        frame = pd.concat(list(rows), ignore_index=True).sort_values("seq_num", kind="stable")
        sights = pd.DataFrame({"id": frame["id"], "ms": frame["created_at"].astype("datetime64[ns]").astype("int64") // 1_000_000})
        latest = sights.groupby("id", dropna=False)["ms"].max()
        first = frame.drop_duplicates("id")
        ids = [None if pd.isna(i) else i for i in first["id"].tolist()]
        fresh = [i not in known for i in ids]
        for i, at in zip((None if pd.isna(i) else i for i in latest.index.tolist()), latest.tolist(), strict=True):
            known[i] = max(known.get(i, 0), max(now, at) + self.ms)
        self._store(known)
        if any(fresh):
            yield first[fresh][self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs() + self.behind
        self._store({i: until for i, until in self._load().items() if until >= now})  # as the engine tells timers: those before the watermark
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def seen_once(stream: DataFrame, minutes: int = 30, late_days: int = 31, buckets: int = 4096) -> DataFrame:
    """Each id once, of the rows of a micro-batch that of the least seq_num; an id is remembered until `minutes` after its last sight.

    The clock is the newest created_at, less OUT_OF_ORDER; only rows `late_days` behind it are dropped.  deduplicated() is cheaper, and forgets an id
    that long after its first sight.  buckets: of ids, each read and written as a whole; a checkpoint belongs to one number of them.  Needs the RocksDB state store.
    """
    ship(stream.sparkSession)
    schema = ", ".join(f"{c} {t}" for c, t in stream.dtypes)
    # ids that are null have a bucket of their own, as one among whole numbers would make them floating
    bucket = F.when(F.col("id").isNull(), -1).otherwise(F.pmod(F.xxhash64("id"), F.lit(buckets))).cast("int")
    keyed = stream.withWatermark("created_at", f"{OUT_OF_ORDER + late_days * 86400} seconds").withColumn("_bucket", bucket).groupBy("_bucket")
    job = Seen(stream.schema["id"].dataType, stream.columns, minutes * 60_000, late_days * 86_400_000)
    return keyed.transformWithStateInPandas(job, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def silver(raw: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Typed events of a raw stream, deduplicated, into parquet."""
    rows = deduplicated(E.typed(E.decode(raw)).withColumn("event", F.to_json("event")))
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(**trigger) if trigger else writer).start()


def tumbling_stream(events: DataFrame, key: str, seconds: int = 300, metric: str = "num_events") -> DataFrame:
    """Tumbling counts that late events update for ten more windows; run it in update mode."""
    return H.tumbling(events.withWatermark("created_at", f"{OUT_OF_ORDER + 10 * seconds} seconds"), key, seconds, metric)


class SlidingCounts(StatefulProcessor):
    """Counts of one key in windows that end each second, for several sizes.

    State: the counts of all sizes at the last second told, and the events by the second in which they end, in chunks of a minute that are linked in
    order of time.  A bucket moves the counts when it comes in and once for each size when it goes out; each of these fronts has a cursor to the
    chunk where it stands, so that a call reads the chunks that move and no others, however many the windows hold.  A timer at the
    next second that matters tells the windows that changed.  behind: seconds by which the watermark runs behind the time that windows close at, so that
    the engine drops no row that a window still holds; timers are set as much earlier.  Late events count while the widest window
    still has their second, and are told at the last told second; those of a key without state count at any age.  A chunk goes when the last front has
    passed it, and with the last one all that is known of the key: a key's state ends `widest` after its last event, by event time.
    """

    CHUNK = 60
    FRAME = 50_000
    NEVER = -(2**62)

    def __init__(self, key: str, key_type, sizes: dict[str, int], behind: int = 0):
        self.key, self.sizes, self.key_type, self.behind = key, sizes, key_type, behind
        #: How far behind its second a bucket meets each front: it comes in at once, and goes out after each size.
        self.fronts = [0, *sizes.values()]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        longs = ArrayType(LongType())
        self.chunks = handle.getMapState("chunks", StructType([StructField("chunk", LongType())]), StructType([StructField(n, t) for n, t in (("before", LongType()), ("after", LongType()), ("ends", longs), ("counts", longs))]))
        self.head = handle.getValueState("head", StructType([StructField(n, t) for n, t in (("told", LongType()), ("first", LongType()), ("last", LongType()), ("totals", longs), ("cursors", longs), ("next", longs))]))

    def _load(self) -> None:
        self.held: dict[int, list] = {}
        self.dirty: set[int] = set()
        self.near: int | None = None
        if self.head.exists():
            told, first, last, totals, cursors, nexts = self.head.get()
            self.told, self.first, self.last, self.totals, self.cursors, self.next = told, first, last, list(totals), list(cursors), list(nexts)
        else:
            self.told, self.first, self.last = self.NEVER, None, None
            self.totals, self.cursors, self.next = [0] * len(self.sizes), [None] * len(self.fronts), [None] * len(self.fronts)

    def _chunk(self, at: int) -> list:
        """before, after, ends and counts of a chunk."""
        if at not in self.held:
            before, after, ends, counts = self.chunks.getValue((at,))
            self.held[at] = [before, after, list(ends), list(counts)]
        return self.held[at]

    def _store(self) -> None:
        """Writes what has changed, and sets one timer."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if self.first is None:
            self.head.clear()
            return
        for at in self.dirty:
            self.chunks.updateValue((at,), tuple(self.held[at]))
        self.head.update((self.told, self.first, self.last, self.totals, self.cursors, self.next))
        self.handle.registerTimer((min(t for t in self.next if t is not None) - self.behind) * 1000)

    def _place(self, at: int) -> list:
        """The chunk, put in order between the others if it is new; looked for from the one asked for before it, or from the last one."""
        before, after = self.last if self.near is None else self.near, None
        while before is not None and before > at:
            before, after = self._chunk(before)[0], before
        if before is not None and after is None:
            after = self._chunk(before)[1]
            while after is not None and after <= at:
                before, after = after, self._chunk(after)[1]
        self.near = at
        if before == at:
            return self._chunk(at)
        self.held[at] = [before, after, [], []]
        for other, side in ((before, 1), (after, 0)):
            if other is not None:
                self._chunk(other)[side] = at
                self.dirty.add(other)
        self.first = at if before is None else self.first
        self.last = at if after is None else self.last
        return self.held[at]

    def _rows(self, key, told: list[tuple[int, str, int]]) -> pd.DataFrame:
        """One frame of (second, size, count): a frame a second would cost more than the counting."""
        at, names, counts = zip(*told, strict=True)
        return pd.DataFrame({self.key: [key] * len(told), "window_size": names, "changed_at": np.array(at, "datetime64[s]").astype("datetime64[us]"), "n": np.array(counts, "int64")})

    def handleInputRows(self, key, rows, timerValues):
        self._load()
        # seconds in order, whatever the order of the rows, so that one walk along the chunks places all
        seconds = pd.concat([(frame["created_at"].astype("datetime64[ns]").astype("int64") // 1_000_000_000 + 1).value_counts() for frame in rows]).groupby(level=0).sum()
        seconds = seconds[seconds.index > self.told - max(self.sizes.values())]
        ends, counts = seconds.index.to_numpy(), seconds.to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(ends // self.CHUNK)) + 1).tolist(), len(ends)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            at = int(ends[a]) // self.CHUNK
            chunk = self._place(at)
            self.dirty.add(at)
            known = dict(zip(chunk[2], chunk[3], strict=True))
            for e, n in zip(ends[a:b].tolist(), counts[a:b].tolist(), strict=True):
                known[e] = known.get(e, 0) + n
            chunk[2], chunk[3] = list(known), list(known.values())
        late: dict[str, int] = {}
        for i, (name, size) in enumerate(self.sizes.items()):
            inside = (ends > self.told - size) & (ends <= self.told)
            if inside.any():
                self.totals[i] += int(counts[inside].sum())
                late[name] = self.totals[i]
        for f, off in enumerate(self.fronts):
            yet = int(np.searchsorted(ends, self.told - off, side="right"))
            if yet < len(ends):  # the front has yet to meet it
                e = int(ends[yet])
                self.next[f] = e + off if self.next[f] is None else min(self.next[f], e + off)
                self.cursors[f] = e // self.CHUNK if self.cursors[f] is None else min(self.cursors[f], e // self.CHUNK)
        if self.first is not None:
            self._store()
        if late:
            yield self._rows(key[0], [(self.told, name, n) for name, n in late.items()])

    def _advance(self, f: int, upto: int, moves: dict[int, list[int]]) -> None:
        """Takes a front on to `upto`: what it meets goes to moves; the cursor stays at the chunk of what it meets next."""
        off, at = self.fronts[f], self.cursors[f]
        self.next[f] = None
        while at is not None:
            _, after, ends, counts = self._chunk(at)
            for e, n in zip(ends, counts, strict=True):
                t = e + off
                if self.told < t <= upto:
                    move = moves.setdefault(t, [0] * len(self.sizes))
                    for i in range(len(self.sizes)) if f == 0 else (f - 1,):
                        move[i] += n if f == 0 else -n
                elif t > upto:
                    self.next[f] = t if self.next[f] is None else min(self.next[f], t)
            if self.next[f] is not None:
                break
            at = after
        self.cursors[f] = at

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self._load()
        upto = timerValues.getCurrentWatermarkInMs() // 1000 + self.behind
        moves: dict[int, list[int]] = {}
        for f in range(len(self.fronts)):
            if self.next[f] is not None and self.next[f] <= upto:
                self._advance(f, upto, moves)
        out = []
        for t in sorted(moves):
            for i, name in enumerate(self.sizes):
                if moves[t][i]:
                    self.totals[i] += moves[t][i]
                    out.append((t, name, self.totals[i]))
            self.told = t
        left = [c for c in self.cursors if c is not None]
        while self.first is not None and (not left or self.first < min(left)):
            after = self._chunk(self.first)[1]
            self.chunks.removeKey((self.first,))
            self.dirty.discard(self.first)
            del self.held[self.first]
            self.first = after
            if after is not None:
                self._chunk(after)[0] = None
                self.dirty.add(after)
            else:
                self.last = None
        self._store()
        for i in range(0, len(out), self.FRAME):
            yield self._rows(key[0], out[i : i + self.FRAME])

    def close(self) -> None:
        pass


def sliding_stream(events: DataFrame, key: str, sizes: dict[str, int] = WINDOW_SIZES) -> DataFrame:
    """key, window_size, changed_at, n: changes of sliding counts, by a clock that runs OUT_OF_ORDER behind; rows late by more than the widest window are gone.  Needs the RocksDB state store."""
    ship(events.sparkSession)
    rows = H.fan_out(events) if key == "kind" else events
    kind = dict(rows.dtypes)[key]
    widest = max(sizes.values())
    keyed = rows.withWatermark("created_at", f"{OUT_OF_ORDER + widest} seconds").groupBy(key)
    schema = f"{key} {kind}, window_size string, changed_at timestamp, n long"
    return keyed.transformWithStateInPandas(SlidingCounts(key, kind, sizes, widest), outputStructType=schema, outputMode="Update", timeMode="EventTime")


def numbered(batch: DataFrame, batch_id: int, key: list[str], trigger_ms: int = 0) -> DataFrame:
    """seq_num of a batch's rows: the same when the batch is tried again."""
    from ..operators.versioning import assign_sequence

    rows = batch if "seq_num" in batch.columns else batch.withColumn("seq_num", F.lit(None).cast("long"))
    return assign_sequence(rows, key, [F.col(c) for c in sorted(c for c in rows.columns if c != "seq_num")], trigger_ms * 1000 + batch_id * 1_000_000)


def table_writer(store: Store, spec: TableSpec, publish=None, since_ms: int | None = None, partition_by: str | None = None, job: str = "job"):
    """A foreachBatch function: the batch is merged in itself and into the table; then the rows that the table took are published (key, value).

    partition_by: an expression of keys; only the partitions of a batch's rows are read and written.  A batch that is tried again stores and
    publishes the same; a job that starts over with a new checkpoint needs a new name.  since_ms: when the job was first started, below which no number
    lies; the store keeps it where it isn't given.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        since = store.since(spec.name) if since_ms is None else since_ms
        rows = merged(numbered(batch, batch_id, spec.keys, since), spec).persist()
        before = store.upsert(rows, spec, partition_by, f"{job}:{batch_id}")
        if publish is not None:  # after the table, so that no one hears of what isn't stored
            newer = rows
            if before is not None:
                old = before.select(*spec.keys, F.col("seq_num").alias("_stored"))
                newer = rows.join(old, spec.keys, "left").where(F.col("_stored").isNull() | (F.col("seq_num") > F.col("_stored"))).drop("_stored")
            publish(topic_rows(newer, spec), batch_id)
        rows.unpersist()

    return write


def days_writer(store: Store, name: str = "events", days: int = 30, time: str = "created_at"):
    """A foreachBatch function: rows are appended by day, and days older than `days` before the newest one go, in the same step.

    Nothing is rewritten, and a batch that is tried again takes the place of its first try, so a restart neither loses nor doubles rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        newest = rows.agg(F.date_format(F.max(time), "yyyy-MM-dd").alias("d")).first()["d"]
        known = max((p.split(".b")[0] for p in store.partitions(name)), default=newest)
        if newest is not None:
            last = max(newest, known)
            oldest = (date.fromisoformat(last) - timedelta(days=days)).isoformat()
            store.append(name, rows, batch_id, f"date_format({time}, 'yyyy-MM-dd')", oldest)
        rows.unpersist()

    return write


def ranking_writer(store: Store, name: str, key: str, metric: str, by: str = "window_size", publish=None):
    """A foreachBatch function over metric updates (ranking, key, metric, seq_num): the exact log of a ranking's changes, one update at a time.

    A batch's places start from the state that the batches before it led to: points, and counts by value and block of keys, each a version of its
    batch.  So a batch costs what it touches and a pass over the points, not the log; one that is tried again gives the same rows.
    The log is appended to by batch; publish(rows, batch_id) gets the batch's rows, numbered in order.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(by, key, metric, "seq_num").persist()
        points, counts = (store.read(f"{name}_{t}", before=batch_id) for t in ("points", "counts"))
        state = R.RankingState.of(rows.limit(0), key, metric, by) if points is None else R.RankingState(points, counts, key, by)
        log = R.exact_changes(rows, key, metric, by, state=state)
        store.append(f"{name}_log", log, batch_id)
        after = state.after(rows, metric)
        store.put(f"{name}_points", after.points, batch_id)
        store.put(f"{name}_counts", after.counts, batch_id)
        if publish is not None:
            spec = TABLES[f"{name}_ranking"]
            publish(ordered_topic_rows(log, spec, by), batch_id)
        rows.unpersist()

    return write


class Numbers(StatefulProcessor):
    """Sequence numbers of one key's rows: from the greater of `base` and its last number + 1; a key unheard of for `ttl_ms` is forgotten."""

    def __init__(self, key: str, order: str, base: int, ttl_ms: int):
        self.key, self.order, self.base, self.ttl_ms = key, order, base, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", StructType([StructField("seq", LongType())]), self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        frame = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        start = max(self.base, self.last.get()[0] + 1 if self.last.exists() else 0)
        self.last.update((start + len(frame) - 1,))
        yield frame.assign(seq_num=range(start, start + len(frame)))

    def close(self) -> None:
        pass


class Updates(StatefulProcessor):
    """The updates of one key that bring a field something newer; what is known of a key is forgotten after `ttl_ms`."""

    def __init__(self, key: str, fields: list[str], version: str, ttl_ms: int):
        self.key, self.fields, self.version, self.ttl_ms = key, fields, version, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", StructType([StructField(f, StringType()) for f in self.fields]), self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        frame = pd.concat(list(rows)).sort_values([self.version, *self.fields], kind="stable", na_position="first")
        said = frame[self.fields].astype(object).where(frame[self.fields].notna(), None).map(lambda x: None if x is None else str(x))
        known = pd.DataFrame([list(self.known.get()) if self.known.exists() else [None] * len(self.fields)], columns=self.fields, dtype=object)
        last = pd.concat([known, said]).ffill()  # what is known before each row, and at the end
        told = last.iloc[-1]
        self.known.update(tuple(None if pd.isna(x) else x for x in told))
        yield frame[(said.notna().to_numpy() & (said.to_numpy() != last.iloc[:-1].to_numpy())).any(axis=1)]

    def close(self) -> None:
        pass


class Trending(StatefulProcessor):
    """The weighted sum of a repository's star counts, told after each second at which one of them changed; counts are forgotten `ttl_ms` after they were last met."""

    def __init__(self, weights: dict[str, int], ttl_ms: int):
        self.weights, self.ttl_ms = weights, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", StructType([StructField("size", StringType())]), StructType([StructField("n", LongType())]), self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        frame = pd.concat(list(rows)).sort_values(["changed_at", "num_stars"], kind="stable")
        known = {k[0]: v[0] for k, v in self.counts.iterator()}
        wide = frame.pivot_table(index="changed_at", columns="window_size", values="num_stars", aggfunc="last").reindex(columns=list(self.weights))
        wide = pd.concat([pd.DataFrame([[known.get(w) for w in self.weights]], columns=wide.columns, dtype="float64"), wide]).ffill().fillna(0)
        for w, n in wide.iloc[-1].items():  # written anew, so that the time of all starts again
            if n:
                self.counts.updateValue((w,), (int(n),))
            elif w in known:
                self.counts.removeKey((w,))
        score = (wide.iloc[1:] * pd.Series(self.weights)).sum(axis=1).astype("int64")
        yield pd.DataFrame({"repo_id": key[0], "changed_at": score.index, "trending_score": score.to_numpy()})

    def close(self) -> None:
        pass


def trending_stream(star_changes: DataFrame, weights: dict[str, int] = S.TREND_WEIGHTS, ttl_ms: int = 48 * 3_600_000) -> DataFrame:
    """repo_id, changed_at, trending_score from a stream of star counts (repo_id, window_size, changed_at, num_stars).  Needs the RocksDB state store."""
    return _by_key(star_changes, "repo_id", Trending(dict(weights), ttl_ms), "repo_id long, changed_at timestamp, trending_score long")


def _by_key(rows: DataFrame, key: str, job: StatefulProcessor, schema: str) -> DataFrame:
    ship(rows.sparkSession)
    return rows.groupBy(key).transformWithStateInPandas(job, outputStructType=schema, outputMode="Append", timeMode="ProcessingTime")


def numbered_stream(rows: DataFrame, key: str, order: str, base: int = 0, ttl_ms: int = 3_600_000) -> DataFrame:
    """rows with seq_num, counted by key.  Needs the RocksDB state store."""
    return _by_key(rows, key, Numbers(key, order, base, ttl_ms), ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", seq_num long")


def update_stream(rows: DataFrame, key: str, fields: list[str], version: str = "seq_num", ttl_ms: int = 3_600_000) -> DataFrame:
    """rows that differ in some field from what is known of their key.  Needs the RocksDB state store."""
    return _by_key(rows, key, Updates(key, fields, version, ttl_ms), ", ".join(f"{c} {t}" for c, t in rows.dtypes))


def publish_to_topic(servers: str, topic: str):
    """A publish function that sends key and value to a topic."""

    def publish(rows: DataFrame, batch_id: int) -> None:
        rows.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()

    return publish


def publish_to_files(folder: str):
    """A publish function that writes a folder a batch; a batch that is tried again writes its own once more."""

    def publish(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return publish


#: The events of the widest window; a row with an id that is there already is the same event.
RECENT = TableSpec("recent", (Field("created_at", str, "sorted"), Field("id", int, "sorted"), Field("seq_num", int)))


def live_tables(store: Store, as_of=None, publish=None, only: tuple[str, ...] = ("counts", "users", "repos", "stars", "trending")):
    """A foreachBatch function over typed events: live counts, trending scores and the diffs of their rankings for each micro-batch.

    The batch's events join those of the widest window, which are kept by hour: only the hours of a batch are written anew, and hours that no
    window reaches go.  A micro-batch is a block of changes.  Every table is the version of its batch, made from those before it, so a batch that is
    tried again gives the same tables and the same changes; versions that no batch can need any more go.  publish(name, rows, batch_id) gets the ranking changes, in order.  `only` names the rankings.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        events = batch.withColumn("created_at", F.col("created_at").cast("timestamp_ntz")).persist()
        newest = as_of if as_of is not None else events.agg(F.date_format(F.max("created_at"), "yyyy-MM-dd HH:mm:ss").alias("m")).first()["m"]
        if newest is None and store.read("recent") is None:
            events.unpersist()
            return
        if newest is not None:
            oldest = datetime.fromisoformat(str(newest)) - timedelta(seconds=max(WINDOW_SIZES.values()), hours=1)
            store.upsert(events, RECENT, "date_format(created_at, 'yyyy-MM-dd-HH')", f"live:{batch_id}", oldest.strftime("%Y-%m-%d-%H"))
        kept = store.read("recent")
        if as_of is None:
            end = kept.agg(F.date_trunc("second", F.max("created_at")).alias("m")).first()["m"]
            end = F.lit(str(end)).cast("timestamp_ntz") + F.make_interval(secs=F.lit(1))
        else:
            end = F.lit(as_of).cast("timestamp_ntz")
        recent = kept.where(F.col("created_at") >= end - F.make_interval(secs=F.lit(max(WINDOW_SIZES.values()))))

        def ranked(name: str, live: DataFrame, ranking: DataFrame, key: str, metric: str, by: str | None) -> None:
            before = store.read(f"{name}_ranking", before=batch_id)
            store.put(f"{name}_live", live, batch_id)
            store.put(f"{name}_ranking", ranking, batch_id)
            changes = R.diff(ranking.limit(0) if before is None else before, ranking, key, metric, by)
            store.put(f"{name}_ranking_changes", changes, batch_id)
            if publish is not None:
                spec = TABLES[f"{name}_ranking"]
                publish(name, ordered_topic_rows(store.read(f"{name}_ranking_changes").withColumn("seq_num", F.lit(batch_id).cast("long")), spec), batch_id)

        for name, key, metric, rows in (("counts", "kind", "num_events", recent), ("users", "user_id", "num_events", recent), ("repos", "repo_id", "num_events", recent), ("stars", "repo_id", "num_stars", H.stars(recent))):
            if name not in only:
                continue
            live = S.snapshot(rows, key, end, metric)
            ranked(name, live, R.snapshot(live, key, metric, all_versions=name != "counts"), key, metric, "window_size")
        if "trending" in only:
            scores = S.trending(S.snapshot(H.stars(recent), "repo_id", end, "num_stars"))
            ranked("trending", scores, R.snapshot(scores, "repo_id", "trending_score", None), "repo_id", "trending_score", None)
        events.unpersist()

    return write


def archived_events(raw: DataFrame) -> DataFrame:
    """Typed events of an archive, each id once; event is a VARIANT, so that it isn't parsed again for its mentions."""
    from ..operators.versioning import dedup

    return dedup(E.typed(E.decode(raw)))


def backfill_entities(once: DataFrame, store: Store) -> None:
    """Users and repositories of archived events."""
    from ..operators import entities as N

    store.upsert(N.user_mentions(once), TABLES["users"])
    store.upsert(N.repo_mentions(once), TABLES["repos"])


def backfill(raw: DataFrame, store: Store) -> None:
    """The batch job over an archive: users, repositories and the four coarse histories, by the functions of the live jobs."""
    once = archived_events(raw).persist(StorageLevel.DISK_ONLY)  # the archive is read and parsed once for all six tables
    backfill_entities(once, store)
    for name, key, metric in (("counts", "kind", "num_events"), ("users", "user_id", "num_events"), ("repos", "repo_id", "num_events"), ("stars", "repo_id", "num_stars")):
        rows = H.tumbling(H.stars(once) if name == "stars" else once, key, 300, metric)
        store.upsert(rows.withColumn("seq_num", F.unix_micros("ts_end")), TABLES[f"{name}_history"])
    once.unpersist()
