"""Stored tables: upserts into versioned parquet snapshots, change topics, and retention.

An upsert reads the partitions that it touches and writes them anew beside the old ones, in one job; a manifest, written last, makes all of them
visible at once.  So no path is read and overwritten at once, a crash shows nothing half done, and a batch that is applied again changes nothing.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import versioning as V
from ..operators.ranking import numbered
from ..runtime import delete
from ..schema import TableSpec


def clean_text(rows: DataFrame) -> DataFrame:
    """Strings without the null character and lone surrogates, which text columns can't hold."""
    return rows.withColumns({c: F.regexp_replace(c, r"[\x00\uD800-\uDFFF]", "") for c, t in rows.dtypes if t == "string"})


def upserted(target: DataFrame | None, batch: DataFrame, spec: TableSpec) -> DataFrame:
    """The table after the batch: a newer row wins, a tie keeps the old one; per field, if the table is so; zero metrics go."""
    keys = spec.keys
    if spec.per_field:
        fields = spec.values
        rows = batch if f"{fields[0]}_seq_num" in batch.columns else V.with_versions(batch, fields)
        both = rows if target is None else target.unionByName(rows)
        return V.merge_fields(both, keys, fields)
    rows = batch.withColumn("_old", F.lit(0))
    both = rows if target is None else target.withColumn("_old", F.lit(1)).unionByName(rows)
    names = [c for c in batch.columns if c not in keys]
    out = both.groupBy(*keys).agg(F.max_by(F.struct(*names), F.struct("seq_num", "_old")).alias("_row")).select(*keys, *(F.col(f"_row.{c}").alias(c) for c in names)).select(*batch.columns)
    return out.where(F.col(spec.drop_zero) != 0) if spec.drop_zero else out


def merged(batch: DataFrame, spec: TableSpec) -> DataFrame:
    """A batch with one row a key: the newest, or field by field; rows of metric zero stay, as they are news."""
    if spec.per_field:
        fields = spec.values
        return V.merge_fields(batch if f"{fields[0]}_seq_num" in batch.columns else V.with_versions(batch, fields), spec.keys, fields)
    return V.merge_rows(batch, spec.keys)


class Store:
    """Tables under one folder, on any file system that Spark reads.

    A table that is put whole is a folder of versions v=<n>, of which the highest complete one counts.  A table that is upserted or appended to has
    manifests m=<n>.json, of which the highest counts: the folder of each partition, and the mark of the batch that made it.  A batch comes again
    with its mark, and then starts from the manifest before its own.  The last version but one stays for readers that have begun.
    """

    KEEP = 2

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _children(self, path: str, prefix: str) -> list[str]:
        p = self._path(path)
        fs = self._fs(p)
        if not fs.exists(p):
            return []
        return [n[len(prefix) :] for n in (x.getPath().getName() for x in fs.listStatus(p)) if n.startswith(prefix)]

    def _write_text(self, path: str, text: str) -> None:
        """A file that is there as a whole or not at all."""
        end, part = self._path(path), self._path(f"{path}.{uuid.uuid4().hex}.part")
        fs = self._fs(end)
        out = fs.create(part, True)
        out.write(text.encode())
        out.close()
        if not fs.rename(part, end):
            raise OSError(f"{path} is there already")

    def _read_text(self, path: str) -> str:
        stream = self._fs(self._path(path)).open(self._path(path))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _versions(self, name: str) -> list[int]:
        root = f"{self.folder}/{name}"
        fs = self._fs(self._path(root))
        return sorted(int(v) for v in self._children(root, "v=") if fs.exists(self._path(f"{root}/v={v}/_SUCCESS")))

    def _manifests(self, name: str) -> list[int]:
        return sorted(int(m[: -len(".json")]) for m in self._children(f"{self.folder}/{name}", "m=") if m.endswith(".json"))

    def _manifest(self, name: str, n: int) -> dict:
        return json.loads(self._read_text(f"{self.folder}/{name}/m={n}.json"))

    def _base(self, name: str, mark: str | None) -> tuple[int, dict]:
        """The number of the next manifest, and the manifest that a batch of this mark starts from."""
        have = self._manifests(name)
        none = {"mark": None, "schema": None, "parts": {}}
        if not have:
            return 0, none
        last = self._manifest(name, have[-1])
        if mark is not None and last["mark"] == mark:
            last = self._manifest(name, have[-2]) if len(have) > 1 else none
        return have[-1] + 1, last

    def _frame(self, name: str, manifest: dict, parts=None) -> DataFrame | None:
        if manifest["schema"] is None:
            return None
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        paths = [f"{self.folder}/{name}/{d}/p={p}" for p, d in manifest["parts"].items() if parts is None or p in parts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _commit(self, name: str, n: int, base: dict, rows: DataFrame, gone: set[str], mark: str | None) -> None:
        """Writes rows (with p, their partition) as one job, then the manifest: the base's partitions but `gone`, and those written."""
        root, own = f"{self.folder}/{name}", f"d={n}-{uuid.uuid4().hex[:8]}"
        rows.hint("rebalance", "p").write.partitionBy("p").parquet(f"{root}/{own}")
        parts = {p: d for p, d in base["parts"].items() if p not in gone} | dict.fromkeys(self._children(f"{root}/{own}", "p="), own)
        self._publish(name, n, {"mark": mark, "schema": rows.drop("p").schema.json(), "parts": parts})

    def _publish(self, name: str, n: int, manifest: dict) -> None:
        root = f"{self.folder}/{name}"
        self._write_text(f"{root}/m={n}.json", json.dumps(manifest))
        have = self._manifests(name)
        if manifest["mark"] is not None and len(have) > 1 and self._manifest(name, have[-2])["mark"] == manifest["mark"]:
            delete(self.spark, f"{root}/m={have.pop(-2)}.json")  # the first try of this batch
        kept = {(d, p) for m in have[-self.KEEP :] for p, d in self._manifest(name, m)["parts"].items()}
        folders = {d for d, _ in kept}
        for m in have[: -self.KEEP]:
            for p, d in self._manifest(name, m)["parts"].items():
                if d in folders and (d, p) not in kept:
                    delete(self.spark, f"{root}/{d}/p={p}")
            delete(self.spark, f"{root}/m={m}.json")
        for d in self._children(root, "d="):  # also what a crash has left
            if f"d={d}" not in folders:
                delete(self.spark, f"{root}/d={d}")

    def partitions(self, name: str) -> list[str]:
        have = self._manifests(name)
        return sorted(self._manifest(name, have[-1])["parts"]) if have else []

    def since(self, name: str) -> int:
        """Milliseconds at which the table was first asked for."""
        path = f"{self.folder}/{name}/since.txt"
        if not self._fs(self._path(path)).exists(self._path(path)):
            self._write_text(path, str(time.time_ns() // 1_000_000))
        return int(self._read_text(path))

    def read(self, name: str, before: int | None = None) -> DataFrame | None:
        """The newest version, or the newest before one."""
        have = [m for m in self._manifests(name) if before is None or m < before]
        if have:
            return self._frame(name, self._manifest(name, have[-1]))
        versions = [v for v in self._versions(name) if before is None or v < before]
        return self.spark.read.parquet(f"{self.folder}/{name}/v={versions[-1]}") if versions else None

    def put(self, name: str, rows: DataFrame, version: int | None = None) -> None:
        """Writes a version, by default the next one, then drops versions that no reader needs."""
        have = self._versions(name)
        version = version if version is not None else (have[-1] + 1 if have else 0)
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/v={version}")
        for old in [v for v in have if v < version][: 1 - self.KEEP or None]:
            delete(self.spark, f"{self.folder}/{name}/v={old}")

    def upsert(self, batch: DataFrame, spec: TableSpec, partition_by: str | None = None, mark: str | None = None, keep_from: str | None = None) -> DataFrame | None:
        """Merges a batch into a table; returns what the touched partitions held before, or None if there was no table.

        partition_by: an expression of keys that splits the table; partitions without rows of the batch keep their files.  keep_from: partitions
        whose name sorts before it go.
        """
        rows = clean_text(batch).withColumn("p", part_name(F.expr(partition_by) if partition_by else F.lit("all")))
        if partition_by:
            rows = rows.persist()  # read for its partitions, then for the merge
        try:
            n, base = self._base(spec.name, mark)
            touched = {r["p"] for r in rows.select("p").distinct().collect()} if partition_by else {"all"}  # the partitions that a batch touches are few
            before = self._frame(spec.name, base, touched)
            after = upserted(before, rows.drop("p"), spec).withColumn("p", part_name(F.expr(partition_by) if partition_by else F.lit("all")))
            old = {p for p in (*base["parts"], *touched) if keep_from is not None and p < keep_from}
            self._commit(spec.name, n, base, after.where(~F.col("p").isin(sorted(old))) if old else after, touched | old, mark)
            return before
        finally:
            if partition_by:
                rows.unpersist()

    def append(self, name: str, rows: DataFrame, batch_id: int, partition_by: str | None = None, keep_from: str | None = None) -> None:
        """Adds rows as partitions of their own, <partition>.b<batch_id>, so nothing is rewritten; a batch that comes again takes the place of its first try."""
        part = part_name(F.expr(partition_by) if partition_by else F.lit("all"))
        n, base = self._base(name, None)
        own = f".b{batch_id:012}"
        gone = {p for p in base["parts"] if p.endswith(own) or keep_from is not None and p < keep_from}
        rows = rows.where(part >= keep_from) if keep_from is not None else rows
        self._commit(name, n, base, rows.withColumn("p", F.concat(part, F.lit(own))), gone, None)

    def compact(self, name: str, below: str) -> list[str]:
        """Joins the appended parts of each partition whose name sorts before `below` into one; returns those partitions.

        A part that comes again later would double its rows, so only partitions that no batch can come again for are named.
        """
        n, base = self._base(name, None)
        many: dict[str, list[str]] = {}
        for p in base["parts"]:
            if p.split(".b")[0] < below:
                many.setdefault(p.split(".b")[0], []).append(p)
        many = {k: v for k, v in many.items() if len(v) > 1}
        rows = None
        for k, parts in many.items():
            own = self._frame(name, base, set(parts)).withColumn("p", F.lit(k))
            rows = own if rows is None else rows.unionByName(own)
        if rows is not None:
            self._commit(name, n, base, rows, {p for v in many.values() for p in v}, None)
        return sorted(many)

    def retain(self, spec: TableSpec, time: str, as_of, days: int) -> None:
        """Drops rows older than `days` before as_of, of a table that is put whole."""
        self.put(spec.name, retained(self.read(spec.name), time, as_of, days))

    def drop_partitions(self, name: str, below: str) -> list[str]:
        """Removes the partitions whose name sorts before `below`, without reading them."""
        n, base = self._base(name, None)
        old = sorted(p for p in base["parts"] if p < below)
        if old:
            self._publish(name, n, base | {"mark": None, "parts": {p: d for p, d in base["parts"].items() if p not in old}})
        return old


def part_name(value: Column) -> Column:
    """A partition's name: letters, digits and . _ + - only; partitions that this makes one are one."""
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("null")), r"[^A-Za-z0-9._+-]", "_")


def retained(rows: DataFrame, time: str, as_of, days: int) -> DataFrame:
    limit = F.lit(as_of).cast("timestamp_ntz") if isinstance(as_of, str) else as_of
    return rows.where(F.col(time) >= limit - F.make_interval(days=F.lit(days)))


def topic_rows(rows: DataFrame, spec: TableSpec, place: Column | None = None) -> DataFrame:
    """key, a JSON array of the keys, and value, a JSON object of the row with ISO times; a null seq_num is an error.  place: a third column."""
    when = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    names = [c for c in rows.columns if c not in ("_i", "_start")]
    typed = rows.select(*(when(c).alias(c) if t.startswith("timestamp") else F.col(c) for c, t in rows.dtypes))
    value = F.when(F.col("seq_num").isNull(), F.raise_error(F.lit("seq_num is null"))).otherwise(F.to_json(F.struct(*names)))
    parts = F.array(*(F.to_json(F.array(k)) for k in spec.keys))
    key = F.concat(F.lit("["), F.array_join(F.transform(parts, lambda x: F.substring(x, F.lit(2), F.length(x) - 2)), ","), F.lit("]"))
    return typed.select(key.alias("key"), value.alias("value"), *([] if place is None else [place.alias("place")]))


def ordered_topic_rows(rows: DataFrame, spec: TableSpec, by: str = "window_size", order: tuple[str, ...] = ("seq_num",)) -> DataFrame:
    """Changes of rankings as key, value and place: a ranking's rows count from 0 in their order, then by key.

    The order is kept by the places, not by where rows lie, so a ranking may fill any number of partitions, each sorted; a reader sorts what it gets by
    ranking and place, and sees by a missing place that something is still to come.
    """
    part = [by] if by in rows.columns else []
    placed = numbered(rows, [*part, *order, *(k for k in spec.keys if k not in (*part, *order))])
    starts = placed.groupBy(*part).agg(F.min("_i").alias("_start"))  # a row for each ranking
    placed = placed.join(F.broadcast(starts), part) if part else placed.crossJoin(F.broadcast(starts))
    return topic_rows(placed, spec, F.col("_i") - F.col("_start"))


def in_order(told: DataFrame) -> DataFrame:
    """What a reader of ordered rows does: the rows of each ranking by place."""
    return told.orderBy(F.get_json_object("key", "$[0]"), "place")
