"""The last step before a service's output: values in the form in which users get them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import UNESCAPE, java_replacement


def present(df: DataFrame, entity: str) -> DataFrame:
    """JSON texts as JSON, encoded paths as arrays, missing parameters as an empty object."""
    has = set(df.columns)
    if entity == "resources" and "parameters" in has:
        df = df.withColumn("parameters", F.coalesce("parameters", F.create_map().cast("map<string,variant>")))
    if entity == "events":
        df = df.withColumns({c: F.try_parse_json(c) for c in ("old_value", "new_value") if c in has})
    if entity in ("reports", "report_metrics", "report_logs", "catalogs", "factsets"):
        df = df.withColumns({c: F.try_parse_json(c) for c in ("metrics", "logs", "resource_events", "resources", "edges", "facts") if c in has and dict(df.dtypes)[c] == "string"})
    if entity == "fact_paths" and "path" in has:  # places as numbers, quoted digits as text
        text = lambda x: F.to_json(F.array(F.regexp_replace(x, UNESCAPE[0], java_replacement(UNESCAPE[1]))))
        part = lambda x: F.when(x.rlike('^([0-9]+|"[0-9]+")$'), x).otherwise(F.substring(text(x), F.lit(2), F.length(text(x)) - 2))
        parts = F.split("path", "#~")
        df = df.withColumn("path", F.parse_json(F.concat(F.lit("["), F.array_join(F.transform(parts, part), ","), F.lit("]"))))
    return df
