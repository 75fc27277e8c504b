"""The engine: queries in, DataFrames out."""

from __future__ import annotations

import json
import threading
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import BadQuery, NotFound, Timeout
from .functions.jsonv import canonical, canonical_map
from .operators import events
from .plans import endpoints, rewrite
from .plans.compiler import Compiler
from .plans.pql import parse_query
from .plans.present import present
from .sources.store import Store

SUMMARIES = ("event_counts", "aggregate_event_counts")


class Engine:
    """Compiles queries over a store.

    ``now`` and ``node_purge_ttl_days`` say which nodes count as inactive.  ``surface`` root adds
    the filter for active nodes to every entity that has them, endpoint to those alone
    whose own endpoint does, none to none.  ``version_field`` is another name by which
    queries may call the agent_version of reports.  With ``links``, the root of a service's
    paths, nested children come as an object of data and href instead of an array.
    """

    def __init__(self, store: Store, now: str, node_purge_ttl_days: float = 14, surface: str = "root", version_field: str | None = None, links: str | None = None):
        if surface not in ("root", "endpoint", "none"):
            raise BadQuery(f"surface is root, endpoint or none, not {surface!r}")
        self.store, self.surface = store, surface
        self.options = {"now": now, "node_purge_ttl_days": node_purge_ttl_days, "version_field": version_field, "links": links}

    def ast(self, query: str | list) -> list:
        """The query's prefix form, checked."""
        found = parse_query(query)
        entity, _, where, _ = rewrite.split_query(found)
        rewrite.expand(entity, where)
        return found

    def query(
        self, query: str | list, *, limit: int | None = None, offset: int | None = None, order_by: list | None = None,
        include_facts_expiration: bool = False, include_package_inventory: bool = False, presented: bool = False, **summary,
    ) -> DataFrame:
        """Rows of a query; paging given here holds where the query has none of its own.

        ``presented`` gives paths of facts with their places as numbers.  Event summaries take ``summarize_by``, ``count_by``, ``counts_filter`` and
        ``distinct_resources`` with ``distinct_start_time`` and ``distinct_end_time``.
        """
        found = parse_query(query)
        if isinstance(found, list) and len(found) > 1 and found[1] in SUMMARIES:
            return self.page(events.summarise(self, found, **summary), limit, offset, order_by)
        if summary and isinstance(found, list) and found[1] == "events":
            return self.page(events.distinct_events(self, found, **summary), limit, offset, order_by)
        if summary:
            raise BadQuery(f"Unsupported query parameters {sorted(summary)}")
        there = rewrite.split_query(found)[3]
        extra = [[k, v] for k, v in (("order_by", order_by), ("offset", offset), ("limit", limit)) if v is not None and k not in there]
        options = self.options | {"include_facts_expiration": include_facts_expiration, "include_package_inventory": include_package_inventory, "presented": presented}
        return Compiler(self.store, options, self.active(found[1])).query(found + extra)

    def active(self, entity: str) -> bool:
        return self.surface == "root" or self.surface == "endpoint" and rewrite.ENTITIES[entity].active_only

    @staticmethod
    def page(df: DataFrame, limit, offset, order_by) -> DataFrame:
        """Paging of a summary, whose fields are its columns."""

        def ordering(item) -> Column:
            name, way = (item, "asc") if isinstance(item, str) else item if len(item) == 2 else (item[0], "asc")
            if name not in df.columns or way not in ("asc", "desc"):
                raise BadQuery(f"order_by takes {', '.join(df.columns)}, asc or desc, not {item!r}")
            return F.col(name).asc_nulls_last() if way == "asc" else F.col(name).desc_nulls_first()

        for name, value, least in (("limit", limit, 1), ("offset", offset, 0)):
            if value is not None and (isinstance(value, bool) or not isinstance(value, int) or value < least):
                raise BadQuery(f"{name} is a whole number from {least} on, not {value!r}")
        df = df.orderBy(*map(ordering, order_by)) if order_by is not None else df
        df = df.offset(offset) if offset is not None else df
        return df.limit(limit) if limit is not None else df

    def total(self, query: str | list) -> int:
        """Rows of a query without its paging."""
        found = parse_query(query)
        return self.query([x for x in found if not (isinstance(x, list) and x and x[0] in rewrite.PAGING)]).count()

    def explain(self, query: str | list) -> str:
        df = self.query(query)
        return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")

    def endpoint(self, path: str, query: str | list | None = None, **params) -> DataFrame:
        """Rows of a service path such as ``/nodes/web1/facts``; ``query`` is a condition or a ``from`` query on its entity.  A parent that does not exist is an error."""
        entity, conditions, parent = endpoints.resolve(path)
        if parent and not self.exists(*parent):
            raise NotFound(f"nothing is known of {parent[1]!r} among {parent[0]}")
        found = parse_query(query) if query is not None else None
        if found and found[0] == "from":
            if found[1] != entity:
                raise BadQuery(f"The endpoint {path} is for {entity}, not {found[1]}")
            _, extract, where, paging = rewrite.split_query(found)
        else:
            extract, where, paging = None, found, {}
        whole = [*conditions, *([where] if where else [])]
        test = ["and", *whole] if len(whole) > 1 else whole[0] if whole else None
        body = ["extract", extract[1], *([test] if test else []), *([extract[2]] if extract[2] else [])] if extract else test
        if entity == "fact_names":
            paging = {"order_by": ["name"]} | paging
        asked = ["from", entity, *([body] if body else []), *([k, v] for k, v in paging.items())]
        return Engine(self.store, self.options["now"], self.options["node_purge_ttl_days"], "endpoint", self.options["version_field"], self.options["links"]).query(asked, **params)

    def exists(self, kind: str, key: str) -> bool:
        """Whether a node, catalog, factset, report, environment or producer is known."""
        column = "hash" if kind == "reports" else "name" if kind in ("environments", "producers") else "certname"
        return not self.store["certnames" if kind == "nodes" else kind].filter(F.col(column) == key).limit(1).isEmpty()

    def rows(self, query: str | list, timeout: float = 600) -> list:
        """The query's rows, or Timeout after as many seconds; its jobs are then cancelled."""
        spark, tag = self.store.spark, f"query-{uuid.uuid4()}"
        done, late = threading.Event(), threading.Event()

        def watch() -> None:
            if not done.wait(timeout):
                late.set()
                while not done.is_set():  # a query may start further jobs
                    spark.interruptTag(tag)
                    done.wait(0.2)

        spark.addTag(tag)
        threading.Thread(target=watch, daemon=True).start()
        try:
            out = self.query(query).collect()
        except Exception as e:
            if late.is_set():
                raise Timeout(f"the query took more than {timeout} s") from e
            raise
        finally:
            done.set()
            spark.removeTag(tag)
        if late.is_set():
            raise Timeout(f"the query took more than {timeout} s")
        return out

    def to_json(self, query: str | list) -> DataFrame:
        """One JSON document a row, as a service would stream them; names of facts are bare strings."""
        entity = parse_query(query)[1]
        df = present(self.query(query, presented=True) if entity == "fact_contents" else self.query(query), entity)
        if entity == "fact_names" and df.columns == ["name"]:
            return df.select(F.to_json(F.array("name")).alias("j")).select(F.expr("substring(j, 2, length(j) - 2)").alias("document"))
        return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("document"))


def flat(df: DataFrame) -> DataFrame:
    """Rows of plain types: JSON as canonical text, times as text to the second, arrays of strings joined by commas, arrays of arrays as JSON."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "variant" or kind.startswith("map<"):
            c = canonical(c) if kind == "variant" else canonical_map(c)
        elif kind == "array<string>":
            c = F.array_join(c, ",")
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind.startswith(("array", "struct")):
            c = F.to_json(c)
        out.append(c.alias(name))
    return df.select(*out)


def facts_search(conditions: dict) -> list:
    """Prefix form of a search by facts: ``{"kernel.eq": "linux", "uptime.gt": 3}``; ne is not eq."""
    ops = {"eq": "=", "gt": ">", "lt": "<", "ge": ">=", "le": "<="}
    out = []
    for key, value in conditions.items():
        name, _, op = key.rpartition(".")
        name, op = (name, op) if op in ops or op == "ne" else (key, "eq")
        out.append(["not", ["=", ["fact", name], value]] if op == "ne" else [ops[op], ["fact", name], value])
    return ["from", "nodes", ["and", *out]] if out else ["from", "nodes"]


def collect_resources(kind: str, own_certname: str, where: list | None = None) -> list:
    """Prefix form that collects other nodes' exported resources; ``where`` is a tree of ==, !=, and, or over tags, titles and parameters."""

    def tree(x):
        op, a, b = x
        if op in ("and", "or"):
            return [op, tree(a), tree(b)]
        field = a if a in ("tag", "title") else ["parameter", a]
        return ["=", field, b] if op == "==" else ["not", ["=", field, b]]

    parts = [["=", "type", kind], ["=", "exported", True], ["not", ["=", "certname", own_certname]]]
    return ["from", "resources", ["and", *parts, *([tree(where)] if where else [])]]


def ast_text(query: list) -> str:
    return json.dumps(query, separators=(",", ":"))
