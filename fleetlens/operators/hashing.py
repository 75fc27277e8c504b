"""Identity hashes: SHA-1 of canonical JSON, keys in order.

Which fields tell two things apart is fixed: a resource by type, title and parameters; a
catalog by its node, its resources with their metadata, and its edges; a report by who
ran what and when; an event by its report and what it did; a set of facts by node,
environment, values and packages, but not by when or by whom it was sent; packages by
their own hashes in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsonv import canonical_map

#: The fields that tell reports and events apart.
REPORT = ("agent_version", "certname", "configuration_version", "end_time", "producer_timestamp", "report_format", "start_time", "transaction_uuid")
EVENT = ("file", "line", "message", "name", "new_value", "old_value", "property", "report_id", "resource_title", "resource_type", "status", "timestamp")


def canonical_hash(*scalars: Column | str, document: Column | str | None = None) -> Column:
    """Equal for equal values, whatever the order of the keys of ``document`` (a map of JSON values); null counts as null."""
    parts = [F.to_json(F.struct((F.col(s) if isinstance(s, str) else s).alias("v"))) for s in scalars]
    if document is not None:
        parts.append(F.coalesce(canonical_map(F.col(document) if isinstance(document, str) else document), F.lit("null")))
    return F.sha1(F.concat_ws(",", *parts))


def _identity(fields: dict[str, Column]) -> Column:
    """SHA-1 of one JSON object, keys in order, nulls written."""
    return F.sha1(F.to_json(F.struct(*[fields[n].alias(n) for n in sorted(fields)]), {"ignoreNullFields": "false"}))


def package_hash(name: Column, version: Column, provider: Column) -> Column:
    return F.sha1(F.to_json(F.array(name, version, provider), {"ignoreNullFields": "false"}))


def packages_hash(packages: Column) -> Column:
    """Of an array of arrays of name, version and provider, whatever their order."""
    return F.sha1(F.to_json(F.array_sort(F.transform(packages, lambda p: package_hash(p[0], p[1], p[2])))))


def report_hash() -> Column:
    return _identity({n: F.col(n) for n in REPORT})


def event_hash() -> Column:
    return _identity({n: F.col(n) for n in EVENT})


def factset_hash(certname: Column, environment: Column, facts: Column, packages: Column | None = None) -> Column:
    """No packages and none known are the same."""
    none = F.lit(None).cast("array<array<string>>")
    listed = none if packages is None else F.when(F.size(packages) > 0, F.array_sort(packages))
    body = F.to_json(F.struct(certname.alias("certname"), environment.alias("environment"), listed.alias("package_inventory")))
    return F.sha1(F.concat_ws(",", body, F.coalesce(canonical_map(facts), F.lit("null"))))


def catalog_hashes(catalogs: DataFrame, resources: DataFrame, edges: DataFrame) -> DataFrame:
    """certname and hash of every catalog, whatever the order of its resources, edges and tags.

    Resources and edges are hashed one by one where they are; a node's hashes are then put in order.
    """
    tags = F.array_sort(F.coalesce("tags", F.array().cast("array<string>")))
    body = F.to_json(F.struct("exported", "file", "line", tags.alias("tags"), "title", "type"), {"ignoreNullFields": "false"})
    r = resources.select("certname", F.lit("r").alias("kind"), F.sha1(F.concat_ws(",", body, F.coalesce(canonical_map(F.col("parameters")), F.lit("null")))).alias("h"))
    names = ("relationship", "source_title", "source_type", "target_title", "target_type")
    e = edges.select("certname", F.lit("e").alias("kind"), _identity({n: F.col(n) for n in names}).alias("h"))
    held = r.unionByName(e).groupBy("certname").agg(F.array_sort(F.collect_list(F.concat("kind", "h"))).alias("parts"))
    parts = F.coalesce("parts", F.array().cast("array<string>"))
    return catalogs.select("certname").join(held, "certname", "left").select("certname", F.sha1(F.concat_ws(",", F.col("certname"), parts)).alias("hash"))
