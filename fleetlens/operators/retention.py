"""Scheduled upkeep: expiring and purging nodes, dropping old history, collecting what nothing refers to.

The functions of a store give new relations; ``upkeep`` does all of it to snapshots and
commits what changes.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.snapshots import Change, Snapshots
from ..sources.store import Store

NODE_TABLES = ("factsets", "reports", "resource_events", "catalogs", "catalog_resources", "edges", "certname_packages", "catalog_inputs", "catalog_inputs_meta", "latest_reports", "certnames")


def before(now: str, days: float) -> Column:
    return F.timestamp_micros(F.unix_micros(F.lit(now).cast("timestamp")) - int(days * 86_400_000_000))


def last_seen(store: Store) -> DataFrame:
    """certname and the newest time of its facts, catalog, latest report, inputs and expiration setting."""
    parts = [
        store["factsets"].select("certname", "producer_timestamp"), store["catalogs"].select("certname", "producer_timestamp"),
        store["reports"].filter("latest").select("certname", "producer_timestamp"), store["catalog_inputs_meta"].select("certname", "producer_timestamp"),
        store["certnames"].filter("facts_expire_updated is not null").select("certname", F.col("facts_expire_updated").alias("producer_timestamp")),
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("certname").agg(F.max("producer_timestamp").alias("seen"))


def expire_nodes(store: Store, now: str, ttl_days: float = 7) -> DataFrame:
    """certnames, with active nodes expired at ``now`` that nothing has been heard of within the time; nodes whose facts don't expire stay."""
    rows = store["certnames"].join(last_seen(store), "certname", "left")
    stale = F.col("deactivated").isNull() & F.col("expired").isNull() & F.coalesce("facts_expire", F.lit(True)) & (F.coalesce("seen", F.lit("0001-01-01").cast("timestamp")) < before(now, ttl_days))
    return rows.withColumn("expired", F.when(stale, F.lit(now).cast("timestamp")).otherwise(F.col("expired"))).drop("seen")


def purged(store: Store, now: str, ttl_days: float = 14) -> DataFrame:
    """Nodes deactivated or expired before the purge time."""
    horizon = before(now, ttl_days)
    return store["certnames"].filter((F.col("deactivated") < horizon) | (F.col("expired") < horizon)).select("certname")


def purge_nodes(store: Store, now: str, ttl_days: float = 14) -> dict[str, DataFrame]:
    """Every relation without the purged nodes' rows."""
    gone = purged(store, now, ttl_days)
    return {name: store[name].join(gone, "certname", "left_anti") for name in NODE_TABLES}


def delete_node(store: Store, certname: str) -> dict[str, DataFrame]:
    return {name: store[name].filter(~F.col("certname").eqNullSafe(F.lit(certname))) for name in NODE_TABLES}


def drop_old(store: Store, now: str, report_ttl_days: float = 14, event_ttl_days: float = 14) -> dict[str, DataFrame]:
    """History by whole days: a day goes when all of it is older than the time to live.  On Parquet laid out by day the filter prunes folders."""
    day = lambda days: F.date_trunc("day", before(now, days))
    reports = store["reports"].filter(F.col("producer_timestamp") >= day(report_ttl_days))
    events = store["resource_events"].filter(F.col("timestamp") >= day(event_ttl_days)).join(reports.select(F.col("id").alias("report_id")), "report_id", "left_semi")
    return {"reports": reports, "resource_events": events}


def collect_garbage(store: Store) -> dict[str, DataFrame]:
    """Environments, producers and packages that something still refers to."""
    used = lambda c: reduce(DataFrame.unionByName, [store[t].select(F.col(c).alias("name")) for t in ("factsets", "catalogs", "reports")]).distinct()
    package = ["package_name", "version", "provider"]
    return {
        "environments": store["environments"].join(used("environment"), "name", "left_semi"), "producers": store["producers"].join(used("producer"), "name", "left_semi"),
        "packages": store["packages"].join(store["certname_packages"].select(*package).distinct(), package, "left_semi"),
    }


def upkeep(snapshots: Snapshots, now: str, node_ttl_days: float = 7, purge_ttl_days: float = 14, report_ttl_days: float = 14, event_ttl_days: float = 14) -> None:
    """All of the above on snapshots, in three commits: nodes expire and go, days of history go, and then what nothing refers to any more.

    Old days are forgotten without reading them; of a purged node only the folders that hold its rows are written anew.
    """
    store = snapshots.store()
    gone = purged(store, now, purge_ttl_days).persist()
    late = expire_nodes(store, now, node_ttl_days).filter(F.col("expired") == F.lit(now).cast("timestamp")).join(gone, "certname", "left_anti").persist()
    touched = late.select("certname").unionByName(gone)
    changes = {name: Change(store[name].limit(0), gone) for name in NODE_TABLES if name != "certnames"} if not gone.isEmpty() else {}
    if changes or not late.isEmpty():
        snapshots.commit(changes | {"certnames": Change(late, touched)})
    gone.unpersist()
    late.unpersist()

    day = lambda days: (datetime.fromisoformat(now) - timedelta(days=days)).date()
    reports, events = day(report_ttl_days), max(day(event_ttl_days), day(report_ttl_days))
    latest = snapshots.store()["latest_reports"]
    old = latest.filter(F.col("producer_timestamp") < F.lit(reports.isoformat()).cast("timestamp")).select("certname").persist()
    snapshots.commit({"latest_reports": Change(latest.limit(0), old)} if not old.isEmpty() else {}, since={"reports": reports, "resource_events": events})
    old.unpersist()
    snapshots.commit({name: Change(rows) for name, rows in collect_garbage(snapshots.store()).items()})
