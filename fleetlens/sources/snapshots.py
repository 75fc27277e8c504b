"""Versioned Parquet snapshots of the base relations.

A batch writes only what it changes.  Relations that documents replace are kept in
buckets of nodes, of which the touched ones are written anew; how many buckets a
relation has is part of the manifest and grows with it.  Histories get further folders, one
a day, so that old days go by forgetting their folders and time filters skip files.  Small
relations are written whole.  One small manifest then names the folders of the new
version, and readers take the newest manifest.  A batch that is repeated after a failure
finds that its number is applied and does nothing.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import EXTRA, SCHEMAS, Store, deepest

#: Buckets that a relation begins with, and the rows a bucket from which compaction doubles them.
BUCKETS, PER_BUCKET = 64, 500_000
#: Histories, and the column that orders them.
HISTORIES = {"reports": "producer_timestamp", "resource_events": "timestamp", "rejected": "producer_timestamp"}
#: What is kept; which report is a node's newest is kept apart, so that reports are only ever added to.
KEPT = {**SCHEMAS, **EXTRA, "reports": SCHEMAS["reports"].removesuffix(", latest boolean")}


def columns(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


@dataclass(frozen=True)
class Change:
    """New rows of a relation.  With ``nodes`` (certname) they replace all rows of these nodes; without, histories grow by them and other relations are them."""

    rows: DataFrame
    nodes: DataFrame | None = None


@dataclass
class Manifest:
    """``relations`` has the folders of each: by bucket, or a list; ``buckets`` their number; ``depth`` the levels of the facts."""

    version: int = -1
    batch: int = -1
    relations: dict = field(default_factory=dict)
    buckets: dict = field(default_factory=dict)
    depth: int = 0


def with_latest(reports: DataFrame, latest: DataFrame) -> DataFrame:
    """Reports with the flag of each node's newest, which is no plan.  As ids are distinct, the join vanishes where the flag is not asked for."""
    mine = latest.select(F.col("id").alias("l_id")).distinct()
    return reports.join(mine, (F.col("id") == F.col("l_id")) & F.coalesce(F.col("type") != "plan", F.lit(True)), "left").withColumn("latest", F.col("l_id").isNotNull()).drop("l_id")


def changed(store: Store, changes: Mapping[str, Change]) -> Store:
    """The store after the changes, without writing anything; a relation is made when it is asked for."""

    def after(name: str) -> DataFrame:
        old = store[name]
        if name == "reports":
            old = old.drop("latest") if "latest" in old.columns else old
        if change := changes.get(name):
            rows = change.rows.select(old.columns)
            if change.nodes is not None:
                old = old.join(change.nodes.select("certname"), "certname", "left_anti").unionByName(rows)
            else:
                old = old.unionByName(rows) if name in HISTORIES else rows
        return old

    tables = {name: lambda name=name: after(name) for name in KEPT}
    return Store(store.spark, tables | {"reports": lambda: with_latest(after("reports"), after("latest_reports")).select(columns(SCHEMAS["reports"]))})


def day_of(folder: str) -> date | None:
    """The day of a history's folder; None where its rows have no time."""
    text = folder.rstrip("/").rpartition("day=")[2]
    return None if text.startswith("__") else date.fromisoformat(text)


class Snapshots:
    def __init__(self, spark: SparkSession, folder: str, per_bucket: int = PER_BUCKET):
        self.spark, self.folder, self.per_bucket = spark, folder.rstrip("/"), per_bucket

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name if name.startswith(self.folder) else f"{self.folder}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, name: str) -> list[str]:
        fs, at = self._files(), self._path(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _versions(self) -> list[int]:
        return sorted(int(n) for n in self._listed("manifests") if n.isdigit() and "_SUCCESS" in self._listed(f"manifests/{n}"))

    def manifest(self, version: int | None = None) -> Manifest:
        """That of a version, or the newest; an empty one before the first."""
        versions = self._versions()
        if not versions:
            return Manifest()
        return Manifest(**json.loads(self.spark.read.text(f"{self.folder}/manifests/{versions[-1] if version is None else version:012d}").first()[0]))

    def _publish(self, manifest: Manifest) -> None:
        text = json.dumps(manifest.__dict__)
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/manifests/{manifest.version:012d}")

    def _read(self, name: str, folders) -> DataFrame:
        paths = sorted(set(folders.values() if isinstance(folders, dict) else folders))
        return self.spark.read.schema(KEPT[name]).parquet(*paths) if paths else self.spark.createDataFrame([], KEPT[name]).limit(0)

    def store(self) -> Store:
        now = self.manifest()
        reader = lambda name: lambda: self._read(name, now.relations.get(name, []))
        tables = {name: reader(name) for name in KEPT}
        return Store(self.spark, tables | {"reports": lambda: with_latest(tables["reports"](), tables["latest_reports"]())}, now.depth)

    def commit(self, changes: Mapping[str, Change], batch: int | None = None, since: dict[str, date] | None = None) -> None:
        """Applies the changes, unless ``batch`` was applied before, and forgets days of histories before ``since``."""
        now = self.manifest()
        if batch is not None and now.batch >= batch:
            return
        new = Manifest(now.version + 1, now.batch if batch is None else batch, dict(now.relations), dict(now.buckets), now.depth)
        for name, first in (since or {}).items():
            new.relations[name] = [p for p in new.relations.get(name, []) if (d := day_of(p)) is None or d >= first]
        for name, change in changes.items():
            folder, rows = f"{self.folder}/{name}/{new.version:012d}", change.rows.select(columns(KEPT[name]))
            if name in HISTORIES:
                there = new.relations.get(name, [])
                if change.nodes is not None:
                    there = self._without(name, there, change.nodes, f"{folder}-kept")
                new.relations[name] = there + self._by_day(name, rows, folder)
            elif change.nodes is None:
                rows.write.mode("overwrite").parquet(folder)
                new.relations[name] = [folder]
            else:
                new.buckets.setdefault(name, BUCKETS)
                new.relations[name] = self._replace(name, rows, change.nodes, new.relations.get(name, {}), folder, new.buckets[name])
            if name == "factsets":
                new.depth = max(new.depth, deepest(rows))
        self._publish(new)

    def _by_day(self, name: str, rows: DataFrame, folder: str) -> list[str]:
        """Writes rows into a folder a day, large days by several tasks, and names the folders."""
        stamp = HISTORIES[name]
        dealt = rows.withColumn("day", F.to_date(stamp)).hint("rebalance", F.col("day")).sortWithinPartitions("day", stamp)
        dealt.write.mode("overwrite").partitionBy("day").parquet(folder)
        return [f"{folder}/{d}" for d in self._listed(folder) if d.startswith("day=")]

    def _without(self, name: str, there: list[str], nodes: DataFrame, folder: str) -> list[str]:
        """The folders, those that hold rows of the nodes written anew without them."""
        if not there:
            return there
        rows = self._read(name, there).select("certname", F.regexp_extract("_metadata.file_path", r"([^/]+/day=[^/]+)/[^/]*$", 1).alias("f"))
        hit = {r.f for r in rows.join(nodes.select("certname"), "certname", "left_semi").select("f").distinct().collect()}  # at most the folders
        touched = [p for p in there if "/".join(p.split("/")[-2:]) in hit]
        if not touched:
            return there
        left = self._read(name, touched).join(nodes.select("certname"), "certname", "left_anti")
        return [p for p in there if p not in touched] + self._by_day(name, left, folder)

    def _replace(self, name: str, rows: DataFrame, nodes: DataFrame, there: dict[str, str], folder: str, buckets: int) -> dict[str, str]:
        """Writes the touched buckets anew: their old rows but for the nodes', and the new rows."""
        bucket = F.pmod(F.hash("certname"), F.lit(buckets))
        touched = sorted(str(r[0]) for r in nodes.select(bucket.alias("b")).distinct().collect())  # at most the buckets
        if not touched:
            return there
        old = self._read(name, {b: there[b] for b in touched if b in there})
        new = old.join(nodes.select("certname"), "certname", "left_anti").unionByName(rows.select(old.columns))
        return {k: v for k, v in there.items() if k not in touched} | self._in_buckets(new, folder, buckets)

    def _in_buckets(self, rows: DataFrame, folder: str, buckets: int) -> dict[str, str]:
        rows.withColumn("bucket", F.pmod(F.hash("certname"), F.lit(buckets))).hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(folder)
        return {d.removeprefix("bucket="): f"{folder}/{d}" for d in self._listed(folder) if d.startswith("bucket=")}

    def failures(self, batch: int) -> int:
        """Notes that a batch has failed; how often it has by now."""
        n = len(self._listed(f"failures/{batch:012d}")) + 1
        self._files().mkdirs(self._path(f"failures/{batch:012d}/{n:06d}"))
        return n

    def compact(self) -> None:
        """Days of several folders become one; relations that have outgrown their buckets get more."""
        now = self.manifest()
        new = Manifest(now.version + 1, now.batch, dict(now.relations), dict(now.buckets), now.depth)
        for name in HISTORIES:
            by_day: dict[str, list[str]] = {}
            for p in new.relations.get(name, []):
                by_day.setdefault(p.rpartition("/")[2], []).append(p)
            many = [p for ps in by_day.values() if len(ps) > 1 for p in ps]
            if many:
                new.relations[name] = [ps[0] for ps in by_day.values() if len(ps) == 1] + self._by_day(name, self._read(name, many), f"{self.folder}/{name}/{new.version:012d}")
        for name, buckets in now.buckets.items():
            rows = self._read(name, now.relations.get(name, {}))
            want, n = buckets, rows.count()
            while n > want * self.per_bucket:
                want *= 2
            if want > buckets:
                new.relations[name], new.buckets[name] = self._in_buckets(rows, f"{self.folder}/{name}/{new.version:012d}", want), want
        self._publish(new)

    def vacuum(self, keep: int = 2) -> None:
        """Removes folders that none of the newest ``keep`` versions names."""
        versions, fs = self._versions(), self._files()
        named = set()
        for v in versions[-keep:]:
            for folders in self.manifest(v).relations.values():
                named |= {"/".join(p.removeprefix(f"{self.folder}/").split("/")[:2]) for p in (folders.values() if isinstance(folders, dict) else folders)}
        for name in KEPT:
            for part in self._listed(name):
                if f"{name}/{part}" not in named:
                    fs.delete(self._path(f"{name}/{part}"), True)
        for v in versions[:-keep]:
            fs.delete(self._path(f"manifests/{v:012d}"), True)
