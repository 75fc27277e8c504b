"""Event summaries: newest events of resources, counts by subject, and counts of subjects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BadQuery
from ..plans import rewrite
from ..plans.compiler import Compiler, parse_time

#: Subjects, and what each status is counted as.
SUBJECTS = {"certname": ("certname",), "containing_class": ("containing_class",), "resource": ("resource_type", "resource_title")}
COUNTS = {"failures": "failure", "skips": "skipped", "successes": "success", "noops": "noop"}
SPLIT = {"failures": "failure", "skips": "skipped", "intentional_successes": "success", "corrective_successes": "success", "intentional_noops": "noop", "corrective_noops": "noop"}


def distinct_events(engine, query: list, **summary) -> DataFrame:
    """Events, of which only the newest of each resource, property and name count if ``distinct_resources`` is set."""
    unknown = set(summary) - {"distinct_resources", "distinct_start_time", "distinct_end_time"}
    if unknown:
        raise BadQuery(f"Unsupported query parameters {sorted(unknown)}")
    options = engine.options | _distinct(query, summary)
    return Compiler(engine.store, options, engine.active("events")).query(["from", "events", *query[2:]])


def _distinct(query: list, summary: dict) -> dict:
    wanted = [summary.get(k) for k in ("distinct_resources", "distinct_start_time", "distinct_end_time")]
    if not any(x is not None and x is not False for x in wanted):
        return {}
    if wanted[0] is not True or wanted[1] is None or wanted[2] is None:
        raise BadQuery("distinct_resources, distinct_start_time and distinct_end_time go together")
    where = rewrite.split_query(["from", "events", *query[2:]])[2]
    inside = where[2] if where and where[:2] == ["=", "latest_report?"] else None  # only as the whole filter does it go inside
    return {"distinct": {"start": parse_time(wanted[1]), "end": parse_time(wanted[2]), "latest": inside}}


def _counted(engine, query: list, key: str, count_by: str, split: bool, distinct: dict) -> DataFrame:
    if key not in SUBJECTS:
        raise BadQuery(f"summarize_by is one of {', '.join(SUBJECTS)}, not {key!r}")
    if count_by not in ("resource", "certname"):
        raise BadQuery(f"count_by is resource or certname, not {count_by!r}")
    columns = list(SUBJECTS[key])
    listed = list(dict.fromkeys(["certname", *columns, "status", "corrective_change"]))
    inner = ["from", "events", ["extract", listed, *query[2:3]]]
    events = Compiler(engine.store, engine.options | distinct, engine.active("events")).query(inner)
    if count_by == "certname":
        events = events.distinct()
    status, corrective = F.col("status"), F.coalesce("corrective_change", F.lit(False))

    def hit(name: str, value: str) -> Column:
        test = status == value
        return test & corrective if name.startswith("corrective") else test & ~corrective if name.startswith("intentional") else test

    return events.groupBy(*columns).agg(*[F.count_if(hit(n, v)).alias(n) for n, v in (SPLIT if split else COUNTS).items()])


def _having(expr: list, names) -> Column:
    op = expr[0]
    if op in ("and", "or"):
        return reduce(lambda a, b: a & b if op == "and" else a | b, [_having(e, names) for e in expr[1:]])
    if op == "not":
        return ~_having(expr[1], names)
    if op not in ("=", ">", "<", ">=", "<=") or len(expr) != 3 or expr[1] not in names:
        raise BadQuery(f"Unsupported counts_filter {expr}; fields are {', '.join(names)}")
    c, n = F.col(expr[1]), F.lit(expr[2])
    return {"=": c == n, ">": c > n, "<": c < n, ">=": c >= n, "<=": c <= n}[op]


def summarise(engine, query: list, summarize_by: str | None = None, count_by: str = "resource", counts_filter: list | None = None, corrective: bool = False, **distinct) -> DataFrame:
    """Rows of ``event_counts`` or ``aggregate_event_counts``."""
    if not summarize_by:
        raise BadQuery("event summaries need summarize_by")
    if len(query) > 3:
        raise BadQuery("event summaries take one expression")
    options, names = _distinct(query, distinct), list(SPLIT if corrective else COUNTS)

    def counts(key: str) -> DataFrame:
        found = _counted(engine, query, key, count_by, corrective, options)
        return found.filter(_having(counts_filter, names)) if counts_filter else found

    if query[1] == "event_counts":
        found, columns = counts(summarize_by), SUBJECTS.get(summarize_by, ())
        parts = [F.col(columns[-1]).alias("title"), *([F.col("resource_type").alias("type")] if len(columns) > 1 else [])]
        return found.select(F.lit(summarize_by).alias("subject_type"), F.struct(*parts).alias("subject"), *names)
    each = [
        counts(key).agg(*[F.coalesce(F.count_if(F.col(n) > 0), F.lit(0)).alias(n) for n in names], F.count(F.lit(1)).alias("total")).select(F.lit(key).alias("summarize_by"), *names, "total")
        for key in dict.fromkeys(summarize_by.split(","))
    ]
    return reduce(DataFrame.unionByName, each)
