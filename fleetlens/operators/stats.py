"""Population metrics and distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import Store

#: Fixed value: the points at which distributions are given.
POINTS = [i / 20 for i in range(21)]


def distribution(rows: DataFrame, key: str) -> DataFrame:
    """Interpolated quantiles of the number of rows a key, one row a point."""
    found = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.percentile("n", F.array(*map(F.lit, POINTS))).alias("q"))
    return found.select(F.posexplode("q").alias("i", "value")).select((F.col("i") / 20).alias("point"), "value")


def duplication(rows: DataFrame, column: str) -> DataFrame:
    """Share of rows that repeat another row's value; 0 without rows."""
    n, distinct = F.count(F.lit(1)), F.count_distinct(column)
    return rows.agg(F.when(n > 0, (n - distinct) / n).otherwise(0.0).alias("duplication"))


def population(store: Store) -> DataFrame:
    """Active and inactive nodes, resources, resources an active node and the share of repeated resources."""
    off = F.col("deactivated").isNotNull() | F.col("expired").isNotNull()
    nodes = store["certnames"].agg(F.count_if(~off).alias("active_nodes"), F.count_if(off).alias("inactive_nodes"))
    live = store["certnames"].filter(~off).select("certname")
    r = store["catalog_resources"].join(live, "certname", "left_semi").agg(F.count(F.lit(1)).alias("resources"), F.count_distinct("resource").alias("distinct_resources"))
    per = F.when(F.col("active_nodes") > 0, F.col("resources") / F.col("active_nodes")).otherwise(0.0)
    repeated = F.when(F.col("resources") > 0, (F.col("resources") - F.col("distinct_resources")) / F.col("resources")).otherwise(0.0)
    return nodes.crossJoin(F.broadcast(r)).select("active_nodes", "inactive_nodes", "resources", per.alias("resources_per_node"), repeated.alias("duplication"))  # one row each


def summary(store: Store) -> DataFrame:
    """Counts of the main relations, and of distinct edges."""
    edges = F.count_distinct("source_type", "source_title", "target_type", "target_title")
    out = store["edges"].agg(edges.alias("n")).select(F.lit("distinct_edges").alias("measure"), "n")
    for name in ("certnames", "factsets", "reports", "resource_events", "catalog_resources", "packages"):
        out = out.unionByName(store[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("measure"), "n"))
    return out
