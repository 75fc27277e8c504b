"""Older wire formats brought to the current one, before their documents are parsed.

Only names that the formats define are touched, and only in commands of versions that
spelled them otherwise, so that users' own keys stay as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names that old formats wrote with dashes, and the last version of each command that did.
DASHED = (
    "transaction-uuid", "producer-timestamp", "start-time", "end-time", "report-format", "configuration-version", "resource-events", "resource-type", "resource-title", "new-value", "old-value", "containment-path",
    "corrective-change", "api-version",
)
LAST_DASHED = {"replace catalog": 5, "replace facts": 3, "store report": 4}
#: Fixed value: catalogs up to this version have no id of their own but their transaction's.
LAST_WITHOUT_CATALOG_ID = 7


def underscored(payload: Column) -> Column:
    return reduce(lambda p, name: F.regexp_replace(p, rf'"{name}"(\s*:)', f'"{name.replace("-", "_")}"$1'), DASHED, payload)


def agent_version(payload: Column) -> Column:
    """The version of the reporting tool, under whatever tool's name the document has it (``mytool_version``); only its own keys count, not nested ones."""
    own = F.map_filter(F.from_json(payload, "map<string,variant>"), lambda k, _: k.rlike(r"\A(?!configuration[-_]|api[-_])[a-z]+[-_]version\z"))
    return F.try_variant_get(F.try_element_at(F.map_values(own), F.lit(1)), "$", "string")


def may_have_version(payload: Column) -> Column:
    """Whether ``agent_version`` can find something: a key that ends so, or an escaped one that may; cheaper than parsing.

    Most documents have no such word but in the one key that reports have, which is seen without a regular expression.
    """
    worded = F.contains(F.replace(payload, F.lit('"configuration_version"'), F.lit("")), F.lit("version"))
    return F.contains(payload, F.lit("\\u")) | worded & payload.rlike(r"""[-_]version["'](?<!["'](?:configuration|api)[-_]version["'])""")


def upgraded(commands: DataFrame) -> DataFrame:
    """Commands in the current format: names with underscores, times of old commands that lack one taken from their receipt."""
    old = reduce(lambda a, b: a | b, [(F.col("command") == c) & (F.col("version") <= v) for c, v in LAST_DASHED.items()])
    payload = F.when(F.coalesce(old, F.lit(False)), underscored(F.col("payload"))).otherwise(F.col("payload"))
    return commands.withColumns({"payload": payload, "producer_timestamp": F.coalesce("producer_timestamp", "received")})
