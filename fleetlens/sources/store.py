"""Base relations, by name.  Everything else is derived from these.

Names of environments and producers are kept in the rows (Parquet's dictionaries make
that cheap), so no entity joins dimensions.  Facts are a map from name to VARIANT.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jsonv import depth

#: Columns of each base relation.
SCHEMAS = {
    "certnames": "certname string, deactivated timestamp, expired timestamp, facts_expire boolean, facts_expire_updated timestamp",
    "factsets": "certname string, environment string, timestamp timestamp, producer_timestamp timestamp, producer string, hash string, facts map<string,variant>",
    "reports": (
        "id bigint, hash string, certname string, environment string, agent_version string, report_format int, configuration_version string, start_time timestamp, end_time timestamp, "
        "producer_timestamp timestamp, receive_time timestamp, producer string, transaction_uuid string, catalog_uuid string, code_id string, job_id string, cached_catalog_status string, "
        "status string, type string, noop boolean, noop_pending boolean, corrective_change boolean, metrics string, logs string, latest boolean"
    ),
    "resource_events": (
        "report_id bigint, certname string, status string, timestamp timestamp, resource_type string, resource_title string, property string, new_value string, old_value string, message string, "
        "file string, line int, containment_path array<string>, containing_class string, corrective_change boolean, name string"
    ),
    "catalogs": "certname string, hash string, version string, transaction_uuid string, catalog_uuid string, code_id string, job_id string, environment string, producer_timestamp timestamp, producer string",
    "catalog_resources": "certname string, resource string, type string, title string, tags array<string>, exported boolean, file string, line int, parameters map<string,variant>",
    "edges": "certname string, source_type string, source_title string, target_type string, target_title string, relationship string",
    "packages": "package_name string, version string, provider string",
    "certname_packages": "certname string, package_name string, version string, provider string",
    "catalog_inputs": "certname string, type string, name string",
    "catalog_inputs_meta": "certname string, producer_timestamp timestamp, catalog_uuid string",
    "environments": "name string",
    "producers": "name string",
}
#: Kept beside them by snapshots: each node's newest report, and refused commands.
EXTRA = {
    "latest_reports": "certname string, id bigint, producer_timestamp timestamp",
    "rejected": "certname string, producer_timestamp timestamp, reason string, command string, version int, received timestamp, payload string, attempts int",
}


def deepest(factsets: DataFrame) -> int:
    """Levels of containers in the facts' values; 0 without any."""
    values = F.array_max(F.transform(F.map_values("facts"), depth))
    return factsets.agg(F.max(values)).first()[0] or 0


class Store:
    """Base relations made on demand: tables that a query does not touch are never read."""

    def __init__(self, spark: SparkSession, tables: dict[str, Callable[[], DataFrame]], depth: int | None = None):
        self.spark, self._tables, self._made, self._depth = spark, tables, {}, depth

    def depth(self) -> int:
        """Levels of nesting of the facts; measured by one scan where the store was not told, and then kept."""
        if self._depth is None:
            self._depth = deepest(self["factsets"])
        return self._depth

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._tables[name]() if name in self._tables else self.spark.createDataFrame([], SCHEMAS.get(name) or EXTRA[name]).limit(0)  # seen to be empty, joins with it vanish
        return self._made[name]

    @classmethod
    def of(cls, spark: SparkSession, frames: dict[str, DataFrame], depth: int | None = None) -> Store:
        return cls(spark, {name: (lambda df=df: df) for name, df in frames.items()}, depth)

    @classmethod
    def parquet(cls, spark: SparkSession, folder: str) -> Store:
        """Relations kept as Parquet folders, one a relation; those that are missing are empty."""

        def reader(name: str) -> Callable[[], DataFrame]:
            path = str(PurePosixPath(folder) / name) if "://" not in folder else f"{folder}/{name}"

            def read() -> DataFrame:
                jvm = spark._jvm
                p = jvm.org.apache.hadoop.fs.Path(path)
                there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
                return spark.read.schema(SCHEMAS[name]).parquet(path) if there else spark.createDataFrame([], SCHEMAS[name])

            return read

        return cls(spark, {name: reader(name) for name in SCHEMAS})

    def write_parquet(self, folder: str, period: str = "day") -> None:
        """Every relation; reports and events by day, or by a longer period where days are small, so that retention and time filters prune."""
        for name in SCHEMAS:
            df = self[name]
            if name in ("reports", "resource_events"):
                stamp = "producer_timestamp" if name == "reports" else "timestamp"
                df = df.withColumn("day", F.to_date(F.date_trunc(period, stamp)))
                df.repartition("day").write.partitionBy("day").mode("overwrite").parquet(f"{folder}/{name}")
            else:
                df.write.mode("overwrite").parquet(f"{folder}/{name}")
