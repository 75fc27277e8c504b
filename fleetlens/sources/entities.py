"""The entities that queries name: their fields, how they hang together, and their rows.

An entity's rows are made for the fields that a query needs, so a join that no field
asks for is never planned.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jsonv
from ..functions.paths import ESCAPE, java_replacement
from .store import Store

@dataclass(frozen=True)
class Field:
    """``kind`` is string, boolean, numeric, timestamp, array, value (any JSON), doc (a JSON document with dotted access), json (for output only), path, encoded or hidden."""

    name: str
    kind: str = "string"
    queryable: bool = True
    projectable: bool = True


@dataclass(frozen=True)
class Entity:
    name: str
    fields: tuple[Field, ...]
    rows: Callable[[Store, set[str], dict], DataFrame]
    #: Columns shared with entities that an implicit subquery may name.
    relations: dict[str, tuple[str, ...]] = field(default_factory=dict)
    dotted: tuple[str, ...] = ()
    #: Nodes that aren't active are left out of the entity's own endpoint.
    active_only: bool = False
    #: A field by another name, if any matches.
    alias: Callable[[str], str | None] = lambda _: None

    def find(self, name: str) -> Field | None:
        name = self.alias(name) or name
        return next((f for f in self.fields if f.name == name), None)


def fields(text: str) -> tuple[Field, ...]:
    """``name:kind`` by spaces; kind defaults to string; ``-`` after it: not projectable, ``+``: not queryable."""
    out = []
    for item in text.split():
        name, _, kind = item.partition(":")
        out.append(Field(name, kind.rstrip("+-") or "string", "+" not in kind, "-" not in kind))
    return tuple(out)


BY_NODE = ("certname",)
NODE_ENTITIES = ("inventory", "nodes", "facts", "fact_contents", "factsets", "reports", "events", "catalogs", "resources", "edges", "catalog_inputs", "catalog_input_contents", "package_inventory")


def _related(*more: tuple[str, tuple[str, ...]]) -> dict[str, tuple[str, ...]]:
    return {e: BY_NODE for e in NODE_ENTITIES} | dict(more)


def _nodes(s: Store, need: set[str], options: dict) -> DataFrame:
    out = s["certnames"].select("certname", F.col("deactivated").cast("string").alias("deactivated"), "expired", F.coalesce("facts_expire", F.lit(True)).alias("expires_facts"), F.col("facts_expire_updated").alias("expires_facts_updated"))
    if need & {"facts_environment", "facts_timestamp"}:
        out = out.join(s["factsets"].select("certname", F.col("environment").alias("facts_environment"), F.col("timestamp").alias("facts_timestamp")), "certname", "left")
    if need & {"catalog_timestamp", "catalog_environment"}:
        out = out.join(s["catalogs"].select("certname", F.col("producer_timestamp").alias("catalog_timestamp"), F.col("environment").alias("catalog_environment")), "certname", "left")
    latest = {f"latest_report_{x}": x for x in ("hash", "noop", "noop_pending", "status", "corrective_change", "job_id")} | {"report_timestamp": "end_time", "report_environment": "environment", "cached_catalog_status": "cached_catalog_status"}
    if need & latest.keys():
        out = out.join(s["reports"].filter("latest").select("certname", *[F.col(x).alias(n) for n, x in latest.items()]), "certname", "left")
    return out


def _fact_rows(s: Store, need: set[str], options: dict) -> DataFrame:
    base = s["factsets"]
    if name := options.get("fact_name"):  # one key is looked up instead of all being unnested
        value = F.try_element_at("facts", F.lit(name))
        return base.filter(F.map_contains_key("facts", F.lit(name))).select("certname", "environment", F.lit(name).alias("name"), value.alias("value"))
    return base.select("certname", "environment", F.explode("facts").alias("name", "value"))


def flatten(rows: DataFrame, depth: int) -> DataFrame:
    """The JSON leaves below each row's ``value``: ``path`` (array, from ``name`` on), ``path_types`` (s for a key, i for a place) and the leaf as ``value``.

    Each of ``depth`` levels, as many as the values have, unnests what is still a container
    and passes leaves on, so the plan is one chain over one scan; containers without
    anything in them vanish.  A value nested deeper is an error, not a loss.
    """
    out = rows.withColumns({"f_path": F.array("name"), "f_types": F.lit("s"), "f_leaf": F.col("value")}).drop("value")
    for _ in range(depth):
        out = out.lateralJoin(rows.sparkSession.tvf.variant_explode_outer(F.col("f_leaf").outer()))
        inside = F.col("pos").isNotNull()
        out = out.select(
            *[c for c in rows.columns if c != "value"],
            F.when(inside, F.concat("f_path", F.array(F.coalesce("key", F.col("pos").cast("string"))))).otherwise(F.col("f_path")).alias("f_path"),
            F.when(inside, F.concat("f_types", F.when(F.col("key").isNull(), "i").otherwise("s"))).otherwise(F.col("f_types")).alias("f_types"),
            F.when(inside, F.col("value")).otherwise(F.col("f_leaf")).alias("f_leaf"),
        )
    kind, text = jsonv.type_name(F.col("f_leaf")), jsonv.canonical(F.col("f_leaf"))
    deep = kind.isin("array", "object") & ~text.isin("[]", "{}")
    out = out.filter(F.when(deep, F.raise_error(F.lit(f"a value is nested deeper than {depth} levels")).cast("boolean")).otherwise(~kind.isin("array", "object")))
    return out.withColumnsRenamed({"f_path": "path", "f_types": "path_types", "f_leaf": "value"})


def _fact_contents(s: Store, need: set[str], options: dict) -> DataFrame:
    return flatten(_fact_rows(s, need, options), s.depth())


def typed_path() -> Column:
    """path and path_types as one JSON array: keys as strings, places as numbers."""
    part = lambda x, i: F.when(F.substring("path_types", i + 1, F.lit(1)) == "i", x).otherwise(_json_string(x))
    return F.parse_json(F.concat(F.lit("["), F.array_join(F.transform("path", part), ","), F.lit("]")))


def _json_string(x: Column) -> Column:
    listed = F.to_json(F.array(x))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def encoded_path() -> Column:
    """The encoded form of path and path_types: keys of digits quoted, the delimiter escaped, places as they are."""

    def part(x: Column, i: Column) -> Column:
        quoted = F.when(x.rlike("^[0-9]+$"), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(x)
        escaped = F.regexp_replace(quoted, ESCAPE[0], java_replacement(ESCAPE[1]))
        return F.when(F.substring("path_types", i + 1, F.lit(1)) == "i", x).otherwise(escaped)

    return F.array_join(F.transform("path", part), "#~")


def _fact_paths(s: Store, need: set[str], options: dict) -> DataFrame:
    kind = jsonv.type_name(F.col("value"))
    whole = F.schema_of_variant("value").rlike(r"^(BIGINT|DECIMAL\((19|2\d|3\d),0\))$")  # shorter decimals were written with a point
    named = F.when(kind == "number", F.when(whole, "integer").otherwise("float")).otherwise(kind)
    return flatten(_fact_rows(s, need, options), s.depth()).select("name", encoded_path().alias("path"), (F.size("path") - 1).alias("depth"), named.alias("type")).distinct()


def _inventory(s: Store, need: set[str], options: dict) -> DataFrame:
    return s["factsets"].select("certname", "timestamp", "environment", "facts", F.try_element_at("facts", F.lit("trusted")).alias("trusted"))


def _child(listed: Column, options: dict, kind: str, key: str, below: str) -> Column:
    """A nested child: its JSON array, or with ``links`` an object of it and the path at which a service has it."""
    root = options.get("links")
    if root is None:
        return listed
    return F.concat(F.lit('{"data":'), F.coalesce(listed, F.lit("[]")), F.lit(f',"href":"{root}/{kind}/'), F.col(key), F.lit(f'/{below}"}}'))


def _factsets(s: Store, need: set[str], options: dict) -> DataFrame:
    out = s["factsets"]
    if "facts" in need:
        listed = F.to_json(F.transform(F.array_sort(F.map_keys("facts")), lambda k: F.struct(k.alias("name"), F.element_at("facts", k).alias("value"))))
        out = out.withColumn("facts", _child(listed, options, "factsets", "certname", "facts"))
    if "package_inventory" in need:
        listed = s["certname_packages"].groupBy("certname").agg(F.array_sort(F.collect_list(F.array("package_name", "version", "provider"))).alias("package_inventory"))
        out = out.join(listed, "certname", "left")
    return out


def _reports(s: Store, need: set[str], options: dict) -> DataFrame:
    out = s["reports"].withColumnRenamed("latest", "latest_report?").withColumn("corrective_change", F.col("corrective_change").cast("string"))
    if "resource_events" in need:
        names = ("status", "timestamp", "resource_type", "resource_title", "property", "new_value", "old_value", "message", "file", "line", "containment_path", "containing_class", "corrective_change", "name")
        as_json = lambda e: F.struct(*[(F.try_parse_json(e[n]) if n in ("new_value", "old_value") else e[n]).alias(n) for n in names])
        ordered = F.transform(F.array_sort(F.collect_list(F.struct(*names))), as_json)
        held = s["resource_events"].groupBy(F.col("report_id").alias("id")).agg(F.to_json(ordered).alias("resource_events"))
        out = out.join(held, "id", "left").withColumn("resource_events", _child(F.col("resource_events"), options, "reports", "hash", "events"))
    return out


def _events(s: Store, need: set[str], options: dict) -> DataFrame:
    out, distinct = s["resource_events"], options.get("distinct")
    of_report = {"configuration_version", "run_start_time", "run_end_time", "report_receive_time", "report", "environment", "latest_report?"}
    latest = distinct and distinct["latest"]
    if need & of_report or latest is not None and distinct:  # else every event has its report, and nothing is lost without the join
        r = s["reports"].select(
            F.col("id").alias("report_id"), "configuration_version", F.col("start_time").alias("run_start_time"), F.col("end_time").alias("run_end_time"),
            F.col("receive_time").alias("report_receive_time"), F.col("hash").alias("report"), "environment", F.col("latest").alias("latest_report?"),
        )
        out = out.join(r, "report_id")
    if not distinct:
        return out
    out = out.filter(F.col("timestamp").between(distinct["start"], distinct["end"]))
    if latest is not None:
        out = out.filter(F.col("latest_report?") == latest)
    newest = Window.partitionBy("certname", "resource_type", "resource_title", "property", "name").orderBy(F.desc("timestamp"))
    return out.withColumn("e_rank", F.rank().over(newest)).filter("e_rank = 1").drop("e_rank")  # ties all stay


def _catalogs(s: Store, need: set[str], options: dict) -> DataFrame:
    out = s["catalogs"]
    if "resources" in need:
        keys = F.array_sort(F.map_keys("parameters"))
        ordered = F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at("parameters", k)))
        item = F.struct("resource", "type", "title", "tags", "exported", "file", "line", ordered.alias("parameters"))
        ordered = F.array_sort(F.collect_list(F.struct("type", "title", F.to_json(item).alias("j"))))
        out = out.join(s["catalog_resources"].groupBy("certname").agg(F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda x: x["j"]), ","), F.lit("]")).alias("resources")), "certname", "left")
        out = out.withColumn("resources", _child(F.col("resources"), options, "catalogs", "certname", "resources"))
    if "edges" in need:
        item = F.struct("relationship", "source_type", "source_title", "target_type", "target_title")
        out = out.join(s["edges"].groupBy("certname").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("edges")), "certname", "left")
        out = out.withColumn("edges", _child(F.col("edges"), options, "catalogs", "certname", "edges"))
    return out


def _resources(s: Store, need: set[str], options: dict) -> DataFrame:
    out = s["catalog_resources"].withColumn("exported", F.col("exported").cast("string"))
    return out.join(s["catalogs"].select("certname", "environment"), "certname") if "environment" in need else out


def _params(s: Store, need: set[str], options: dict) -> DataFrame:
    rows = s["catalog_resources"].select("resource", F.explode("parameters").alias("name", "value")).select(F.col("resource").alias("res_param_resource"), F.col("name").alias("res_param_name"), jsonv.canonical(F.col("value")).alias("res_param_value"))
    return rows.distinct()


def _catalog_inputs(s: Store, need: set[str], options: dict) -> DataFrame:
    meta = s["catalog_inputs_meta"].filter("producer_timestamp is not null")
    listed = s["catalog_inputs"].groupBy("certname").agg(F.array_sort(F.collect_list(F.array("type", "name"))).alias("inputs"))
    return meta.join(listed, "certname")


def _table(name: str):
    return lambda s, need, options: s[name]


def _not_active(s: Store, need: set[str], options: dict) -> DataFrame:
    return s["certnames"].filter("deactivated is not null or expired is not null").select("certname")


def _inactive(s: Store, need: set[str], options: dict) -> DataFrame:
    """Nodes deactivated or expired within the purge time; not the complement of the active ones."""
    horizon = F.timestamp_micros(F.unix_micros(F.lit(options["now"]).cast("timestamp")) - int(options["node_purge_ttl_days"] * 86_400_000_000))
    return s["certnames"].filter((F.col("deactivated") > horizon) | (F.col("expired") > horizon)).select("certname")


_LATEST = "latest_report_hash latest_report_noop:boolean latest_report_noop_pending:boolean latest_report_status latest_report_corrective_change:boolean latest_report_job_id"

ENTITIES: dict[str, Entity] = {
    e.name: e
    for e in (
        Entity("inventory", fields("certname timestamp:timestamp environment facts:doc trusted:doc"), _inventory, _related(), ("facts", "trusted"), True),
        Entity("nodes", fields(f"certname deactivated expired:timestamp facts_environment catalog_timestamp:timestamp facts_timestamp:timestamp report_timestamp:timestamp {_LATEST} cached_catalog_status catalog_environment report_environment expires_facts:boolean expires_facts_updated:timestamp"), _nodes, _related(), (), True),
        Entity("params", fields("res_param_resource res_param_name res_param_value"), _params),
        Entity("fact_paths", fields("type path:encoded name depth:numeric-"), _fact_paths, {"facts": ("name",), "fact_contents": ("name",)}),
        Entity("fact_names", fields("name"), lambda s, n, o: s["factsets"].select(F.explode(F.map_keys("facts")).alias("name")).distinct()),
        Entity("facts", fields("certname environment name value:value"), _fact_rows, _related(("fact_contents", ("certname", "name")), ("environments", ("environment",)), ("producers", ("producer",))), (), True),
        Entity("fact_contents", fields("certname environment path:path path_types:hidden-+ name value:value"), _fact_contents, _related(("facts", ("certname", "name")), ("environments", ("environment",))), (), True),
        Entity("factsets", fields("timestamp:timestamp facts:json+ certname hash producer_timestamp:timestamp producer environment package_inventory:json+-"), _factsets, _related(("environments", ("environment",)), ("producers", ("producer",))), (), True),
        Entity(
            "reports",
            fields(
                "hash certname noop_pending:boolean agent_version report_format:numeric configuration_version start_time:timestamp end_time:timestamp producer_timestamp:timestamp producer corrective_change "
                "metrics:json+ logs:json+ receive_time:timestamp transaction_uuid catalog_uuid noop:boolean code_id job_id cached_catalog_status environment status type latest_report?:boolean- resource_events:json+"
            ),
            _reports, _related(("environments", ("environment",)), ("producers", ("producer",)), ("events", ("hash", "report"))),
        ),
        Entity("report_metrics", fields("metrics:json+ hash:string- type:string-"), lambda s, n, o: s["reports"]),
        Entity("report_logs", fields("logs:json+ hash:string- type:string-"), lambda s, n, o: s["reports"]),
        Entity(
            "events",
            fields(
                "certname configuration_version run_start_time:timestamp run_end_time:timestamp report_receive_time:timestamp report status corrective_change:boolean timestamp:timestamp resource_type resource_title property "
                "new_value old_value message file line:numeric containment_path:array containing_class environment latest_report?:boolean- report_id:numeric-+ name"
            ),
            _events, _related(("reports", ("report", "hash")), ("environments", ("environment",))),
        ),
        Entity("catalogs", fields("version certname hash transaction_uuid catalog_uuid code_id job_id environment producer_timestamp:timestamp producer resources:json+ edges:json+"), _catalogs, _related(("environments", ("environment",)), ("producers", ("producer",)))),
        Entity("resources", fields("certname environment resource type title tag:hidden- tags:array exported file line:numeric parameters:doc"), _resources, _related(("environments", ("environment",))), ("parameters",), True),
        Entity("edges", fields("certname relationship source_title source_type target_title target_type"), _table("edges"), _related(), (), True),
        Entity("catalog_input_contents", fields("certname producer_timestamp:timestamp catalog_uuid name type"), lambda s, n, o: s["catalog_inputs"].join(s["catalog_inputs_meta"], "certname", "left") if n & {"producer_timestamp", "catalog_uuid"} else s["catalog_inputs"], _related(), (), True),
        Entity("catalog_inputs", fields("certname producer_timestamp:timestamp catalog_uuid inputs:json"), _catalog_inputs, _related(), (), True),
        Entity("environments", fields("name"), _table("environments"), {e: ("name", "environment") for e in ("inventory", "facts", "fact_contents", "factsets", "reports", "events", "catalogs", "resources")}),
        Entity("producers", fields("name"), _table("producers"), {e: ("name", "producer") for e in ("factsets", "reports", "catalogs")}),
        Entity("packages", fields("package_name version provider"), _table("packages"), {"package_inventory": ("package_name", "version", "provider")}),
        Entity("package_inventory", fields("certname package_name version provider"), _table("certname_packages"), _related(("packages", ("package_name", "version", "provider"))), (), True),
        Entity("not_active_nodes", fields("certname"), _not_active),
        Entity("inactive_nodes", fields("certname"), _inactive),
        Entity("latest_report", fields("latest_report_hash"), lambda s, n, o: s["reports"].filter("latest").select(F.col("hash").alias("latest_report_hash"))),
        Entity("latest_report_id", fields("latest_report_id:numeric"), lambda s, n, o: s["reports"].filter("latest").select(F.col("id").alias("latest_report_id"))),
    )
}


def columns_between(outer: str, inner: str) -> tuple[tuple[str, ...], tuple[str, ...]] | None:
    """Outer and inner columns of an implicit subquery."""
    shared = ENTITIES[outer].relations.get(inner)
    if shared is None:
        return None
    special = {("reports", "events"): (("hash",), ("report",)), ("events", "reports"): (("report",), ("hash",))}
    if (outer, inner) in special:
        return special[outer, inner]
    if inner in ("environments", "producers"):
        return shared, ("name",)
    if outer in ("environments", "producers"):
        return ("name",), (shared[1],)
    return shared, shared

