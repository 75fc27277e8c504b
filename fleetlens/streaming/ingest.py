"""Commands into relations: latest document wins, histories only grow.

Pure functions take a store and a batch of commands and give new relations; the
stream applies them batch by batch.  Within a batch only the newest document of a node
counts (catalogs, facts), as older ones would be overwritten at once.  A command whose
payload is not what its kind asks for changes nothing: it goes to ``rejected`` as it came,
with the reason, from where ``dead_letters`` gives it back.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.hashing import EVENT, canonical_hash, catalog_hashes, factset_hash, report_hash
from ..sources.snapshots import Change, Snapshots, changed
from ..sources.store import EXTRA, Store
from .wire import LAST_WITHOUT_CATALOG_ID, agent_version, may_have_version, upgraded

COMMANDS = "command string, version int, received timestamp, certname string, producer_timestamp timestamp, payload string"
#: Commands, and the relationships that edges may have.
KINDS = ("replace catalog", "replace facts", "store report", "deactivate node", "configure expiration", "replace catalog inputs")
RELATIONSHIPS = ("contains", "required-by", "notifies", "before", "subscription-of")
#: Fixed value: what a tag may look like.
TAG = r"\A[\p{L}\p{N}_][\p{L}\p{N}_:.\-]*\z"

_RESOURCE = "struct<type:string,title:string,exported:boolean,file:string,line:int,tags:array<string>,parameters:map<string,variant>>"
_EDGE = "struct<source:struct<type:string,title:string>,target:struct<type:string,title:string>,relationship:string>"
CATALOG = f"struct<environment:string,version:string,transaction_uuid:string,catalog_uuid:string,code_id:string,job_id:string,producer:string,resources:array<{_RESOURCE}>,edges:array<{_EDGE}>>"
FACTS = "struct<environment:string,timestamp:timestamp,producer:string,values:map<string,variant>,package_inventory:array<array<string>>>"
_EVENT = "struct<status:string,corrective_change:boolean,timestamp:timestamp,property:string,new_value:variant,old_value:variant,message:string,name:string>"
_REPORTED = f"struct<skipped:boolean,timestamp:timestamp,resource_type:string,resource_title:string,file:string,line:int,containment_path:array<string>,corrective_change:boolean,events:array<{_EVENT}>>"
#: Older reports list events with their resource's data in each.
_FLAT = "struct<status:string,corrective_change:boolean,timestamp:timestamp,property:string,new_value:variant,old_value:variant,message:string,name:string,resource_type:string,resource_title:string,file:string,line:int,containment_path:array<string>>"
REPORT = (
    "struct<environment:string,agent_version:string,report_format:int,configuration_version:string,start_time:timestamp,end_time:timestamp,producer:string,transaction_uuid:string,catalog_uuid:string,code_id:string,"
    f"job_id:string,cached_catalog_status:string,status:string,type:string,noop:boolean,noop_pending:boolean,corrective_change:boolean,metrics:variant,logs:variant,resources:array<{_REPORTED}>,resource_events:array<{_FLAT}>>"
)
INPUTS = "struct<catalog_uuid:string,inputs:array<array<string>>>"
EXPIRATION = "struct<expire:struct<facts:boolean>>"
REJECTED = [f.split()[0] for f in EXTRA["rejected"].split(", ")]


@dataclass(frozen=True)
class Options:
    """``blocklist`` names facts that are not stored, ``as_regex`` as patterns of whole names; events before ``event_horizon`` are not stored."""

    blocklist: tuple[str, ...] = ()
    as_regex: bool = False
    event_horizon: str | None = None


def refused(commands: DataFrame, reason: Column | str, attempts: int = 1) -> DataFrame:
    """Commands as they came, with the reason."""
    return commands.withColumns({"reason": F.lit(reason) if isinstance(reason, str) else reason, "attempts": F.lit(attempts)}).select(REJECTED)


def once(value: Column) -> Column:
    """The value, computed once a row: the optimizer copies no such column into the filters and projections that use it."""
    return F.when(F.spark_partition_id() >= 0, value)


def parsed(commands: DataFrame, kind: str, schema: str, required: Mapping[str, Callable[[Column], Column]], valid: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Commands of a kind with their document as ``d``, and those refused: no JSON of this form, without what is ``required`` (tests of the document, by what the reason says), or not ``valid``."""
    plain = F.when(F.contains("payload", F.lit("\0")), F.translate("payload", "\0", "\ufffd")).otherwise(F.col("payload"))
    text = F.when(F.contains("payload", F.lit("\\u0000")), F.regexp_replace(plain, r"(?<!\\)((?:\\\\)*)\\u0000", "$1\ufffd")).otherwise(plain)
    body = F.from_json(text, schema[:-1] + ",_corrupt:string>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})

    def reason(d: Column) -> Column:
        why = F.when(F.col("payload").isNull() | d.isNull() | d["_corrupt"].isNotNull(), "malformed payload").when(F.col("certname").isNull() | F.col("producer_timestamp").isNull(), "no certname or time")
        for r, test in required.items():
            why = why.when(~F.coalesce(test(d), F.lit(False)), f"invalid {kind.split()[-1]}: not {r}")
        return why if valid is None else why.when(~valid(d), f"invalid {kind.split()[-1]}")

    rows = commands.filter(F.col("command") == kind)
    good = rows.withColumn("d", once(body)).withColumn("i_reason", once(reason(F.col("d")))).filter("i_reason is null").drop("i_reason")
    told = F.element_at(F.transform(F.array(body), reason), 1)  # the document is looked at where it is parsed, never copied into a row
    return good, refused(rows.withColumn("i_reason", once(told)).filter("i_reason is not null"), F.col("i_reason"))


def latest_wins(rows: DataFrame, key: str, order: list[str | Column]) -> DataFrame:
    """The last row of each key by ``order``: the fold that every replacing command comes to."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) if isinstance(c, str) else c for c in order])
    return rows.withColumn("i_turn", F.row_number().over(w)).filter("i_turn = 1").drop("i_turn")


def newest(rows: DataFrame, first_on_ties: bool = False) -> DataFrame:
    """One row a node, the newest; of equally new ones the last received, or the first."""
    return latest_wins(rows, "certname", ["producer_timestamp", F.asc("received") if first_on_ties else F.desc("received")])


def fresh(rows: DataFrame, stored: DataFrame, strictly: bool) -> DataFrame:
    """Rows not older than what is stored for their node; with ``strictly`` ties are stale too."""
    have = stored.select(F.col("certname").alias("i_node"), F.col("producer_timestamp").alias("i_stored"))
    joined = rows.join(have, F.col("certname") == F.col("i_node"), "left")
    newer = F.col("producer_timestamp") > F.col("i_stored") if strictly else F.col("producer_timestamp") >= F.col("i_stored")
    return joined.filter(F.col("i_stored").isNull() | newer).drop("i_node", "i_stored")


def valid_catalog(d: Column) -> Column:
    """Whether a catalog's edges join its own resources by a known relationship and its tags are well-formed."""
    key = lambda r: F.concat_ws("\0", r["type"], r["title"])
    ends = F.concat(F.transform(d["edges"], lambda e: key(e["source"])), F.transform(d["edges"], lambda e: key(e["target"])))
    known = F.forall(d["edges"], lambda e: F.coalesce(e["relationship"].isin(*RELATIONSHIPS), F.lit(False)))
    edges = known & (F.size(F.array_except(ends, F.transform(d["resources"], key))) == 0)  # by hash sets
    tags = F.forall(F.flatten(F.transform(d["resources"], lambda r: F.coalesce(r["tags"], F.array().cast("array<string>")))), lambda t: t.rlike(TAG))
    return F.coalesce(edges, F.lit(True)) & F.coalesce(tags, F.lit(True))


def _kept(rows: DataFrame, hold: list | None) -> DataFrame:
    """The rows, held in memory and on disk while a batch writes several relations of them."""
    if hold is None:
        return rows
    hold.append(rows.persist())
    return hold[-1]


class Lazy(Mapping):
    """Values by name, each made when it is first asked for: analyzing the plans of all relations takes longer than many a query."""

    def __init__(self, makers: dict[str, Callable]):
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str):
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def _each(whole: Callable[[], dict], *names: str) -> dict[str, Callable]:
    """Makers of the values of these names, which are made together."""
    whole = cache(whole)
    return {n: lambda n=n: whole()[n] for n in names}


def documents(commands: DataFrame, hold: list | None = None) -> tuple[Lazy, Callable[[], DataFrame]]:
    """By kind the commands that are what it asks for, their document as ``d``; and those refused.  Each is made when asked for."""
    asked: dict[str, tuple[str, dict[str, Callable[[Column], Column]]]] = {
        "replace catalog": (CATALOG, {"forall(d.resources, r -> r.type is not null and r.title is not null)": lambda d: F.forall(d["resources"], lambda r: r["type"].isNotNull() & r["title"].isNotNull())}),
        "replace facts": (FACTS, {
            "d.values is not null": lambda d: d["values"].isNotNull(),
            "coalesce(forall(d.package_inventory, p -> size(p) = 3), true)": lambda d: F.coalesce(F.forall(d["package_inventory"], lambda p: F.size(p) == 3), F.lit(True)),
        }),
        "replace catalog inputs": (INPUTS, {"forall(d.inputs, i -> size(i) = 2)": lambda d: F.forall(d["inputs"], lambda i: F.size(i) == 2)}),
        "store report": (REPORT, {"d.resources is not null or d.resource_events is not null": lambda d: d["resources"].isNotNull() | d["resource_events"].isNotNull()}),
        "configure expiration": (EXPIRATION, {"d.expire.facts is not null": lambda d: d["expire"]["facts"].isNotNull()}),
    }
    valid = {"replace catalog": valid_catalog}
    read = cache(lambda kind: parsed(commands, kind, *asked[kind], valid=valid.get(kind)))
    known, whom = F.coalesce(F.col("command").isin(*KINDS), F.lit(False)), F.col("certname").isNotNull() & F.col("producer_timestamp").isNotNull()
    made = {kind: lambda kind=kind: _kept(read(kind)[0], hold) for kind in asked}
    made["deactivate node"] = lambda: _kept(commands.filter((F.col("command") == "deactivate node") & whom), hold)

    def bad() -> DataFrame:
        others = commands.filter(~known | (F.col("command") == "deactivate node") & ~whom)
        return reduce(DataFrame.unionByName, [*[read(kind)[1] for kind in asked], refused(others, F.when(known, "no certname or time").otherwise("unknown command"))])

    return Lazy(made), bad


def replace_catalogs(store: Store, documents: DataFrame) -> dict[str, Change]:
    rows = fresh(newest(documents), store["catalogs"], strictly=False)
    r, e = F.col("r"), F.col("e")
    resources = rows.select("certname", F.explode("d.resources").alias("r")).select(
        "certname", canonical_hash(r["type"], r["title"], document=r["parameters"]).alias("resource"), r["type"].alias("type"), r["title"].alias("title"),
        F.transform(r["tags"], lambda t: F.lower(t)).alias("tags"), F.coalesce(r["exported"], F.lit(False)).alias("exported"), r["file"].alias("file"), r["line"].alias("line"), r["parameters"].alias("parameters"),
    )
    edges = rows.select("certname", F.explode("d.edges").alias("e")).select(
        "certname", e["source"]["type"].alias("source_type"), e["source"]["title"].alias("source_title"), e["target"]["type"].alias("target_type"), e["target"]["title"].alias("target_title"), e["relationship"].alias("relationship"),
    ).distinct()
    catalogs = rows.join(catalog_hashes(rows, resources, edges), "certname").select("certname", "hash", "d.version", "d.transaction_uuid", F.when(F.col("version") <= LAST_WITHOUT_CATALOG_ID, F.col("d.transaction_uuid")).otherwise(F.col("d.catalog_uuid")).alias("catalog_uuid"), *[f"d.{c}" for c in ("code_id", "job_id", "environment")], "producer_timestamp", "d.producer")
    return {"catalogs": Change(catalogs, rows), "catalog_resources": Change(resources, rows), "edges": Change(edges, rows)}


def allowed_facts(values: Column, blocklist: tuple[str, ...], as_regex: bool) -> Column:
    if not blocklist:
        return values
    pattern = "|".join(f"(?:{b if as_regex else re.escape(b)})" for b in blocklist)
    return F.map_filter(values, lambda k, _: ~k.rlike(rf"\A(?:{pattern})\z"))


def replace_facts(store: Store, documents: DataFrame, options: Options = Options()) -> dict[str, Change]:  # noqa: B008
    rows = fresh(newest(documents), store["factsets"], strictly=False)
    values = allowed_facts(F.col("d.values"), options.blocklist, options.as_regex)
    sets = rows.select("certname", "d.environment", F.coalesce("d.timestamp", "producer_timestamp").alias("timestamp"), "producer_timestamp", "d.producer", values.alias("facts"), "d.package_inventory")
    sets = sets.withColumn("hash", factset_hash(F.col("certname"), F.col("environment"), F.col("facts"), F.col("package_inventory"))).drop("package_inventory")
    p = F.col("p")
    listed = rows.filter("d.package_inventory is not null")
    packages = listed.select("certname", F.explode("d.package_inventory").alias("p")).select("certname", p[0].alias("package_name"), p[1].alias("version"), p[2].alias("provider")).distinct()
    return {"factsets": Change(sets, rows), "certname_packages": Change(packages, listed), "packages": Change(store["packages"].unionByName(packages.drop("certname")).distinct())}


def replace_inputs(store: Store, documents: DataFrame) -> dict[str, Change]:
    rows = fresh(newest(documents, first_on_ties=True), store["catalog_inputs_meta"], strictly=True)
    i = F.col("i")
    inputs = rows.select("certname", F.explode("d.inputs").alias("i")).select("certname", i[0].alias("type"), i[1].alias("name"))
    return {"catalog_inputs": Change(inputs, rows), "catalog_inputs_meta": Change(rows.select("certname", "producer_timestamp", "d.catalog_uuid"), rows)}


def containing_class(path: Column) -> Column:
    """The innermost element of a containment path that is a class: not empty and without brackets."""
    return F.try_element_at(F.filter(path, lambda x: (x != "") & ~F.contains(x, F.lit("["))), F.lit(-1))


def report_events(reported: DataFrame) -> DataFrame:
    """Events of rows (id, certname, r: a resource of a report): one synthetic event for a skipped resource, none for one without events."""
    r, v = F.col("r"), F.col("v")
    n = lambda kind: F.lit(None).cast(kind)
    skipped = F.array(F.struct(
        F.lit("skipped").alias("status"), n("boolean").alias("corrective_change"), r["timestamp"].alias("timestamp"), n("string").alias("property"), n("variant").alias("new_value"), n("variant").alias("old_value"),
        n("string").alias("message"), n("string").alias("name"),
    ))
    rows = reported.withColumn("v", F.explode(F.when(r["skipped"], skipped).otherwise(r["events"])))
    return rows.select(
        F.col("id").alias("report_id"), "certname", v["status"].alias("status"), v["timestamp"].alias("timestamp"), r["resource_type"].alias("resource_type"), r["resource_title"].alias("resource_title"),
        v["property"].alias("property"), F.to_json(v["new_value"]).alias("new_value"), F.to_json(v["old_value"]).alias("old_value"), v["message"].alias("message"), r["file"].alias("file"), r["line"].alias("line"),
        r["containment_path"].alias("containment_path"), containing_class(r["containment_path"]).alias("containing_class"), v["corrective_change"].alias("corrective_change"), v["name"].alias("name"),
    )


def store_reports(store: Store, documents: DataFrame, options: Options = Options()) -> dict[str, Change]:  # noqa: B008
    """Reports not stored yet, by their hash, and their events, each once and none before the horizon."""
    rows = documents.withColumns({f.strip(): F.col(f"d.{f.strip()}") for f in ("report_format", "configuration_version", "start_time", "end_time", "transaction_uuid")})
    rows = rows.withColumn("agent_version", F.coalesce("d.agent_version", F.when(may_have_version(F.col("payload")), agent_version(F.col("payload")))))
    stored, first = store["reports"].select("hash", "producer_timestamp"), None
    if not stored.isEmpty():  # else the documents need not be read for it
        first, last = documents.agg(F.min("producer_timestamp"), F.max("producer_timestamp")).first()
    stored = stored.filter(F.col("producer_timestamp").between(F.lit(first), F.lit(last))) if first is not None else stored.limit(0)  # a copy has the same time
    own = ("agent_version", "report_format", "configuration_version", "start_time", "end_time", "transaction_uuid")
    flat = ("producer", "catalog_uuid", "code_id", "job_id", "cached_catalog_status", "environment", "status", "noop", "noop_pending", "corrective_change")
    as_resource = F.transform("d.resource_events", lambda e: F.struct(
        F.lit(False).alias("skipped"), *[e[c].alias(c) for c in ("timestamp", "resource_type", "resource_title", "file", "line", "containment_path", "corrective_change")],
        F.array(F.struct(*[e[c].alias(c) for c in ("status", "corrective_change", "timestamp", "property", "new_value", "old_value", "message", "name")])).alias("events"),
    ))
    none = F.array().cast(f"array<{_REPORTED}>")
    every = F.concat(F.coalesce("d.resources", none), F.coalesce(as_resource.cast(f"array<{_REPORTED}>"), none))
    # column by column, so that only those asked for are shuffled
    rows = rows.withColumn("hash", report_hash()).select("hash", "certname", "producer_timestamp", F.col("received").alias("receive_time"), *own, *[f"d.{c}" for c in flat], F.coalesce("d.type", F.lit("agent")).alias("type"), F.to_json("d.metrics").alias("metrics"), F.to_json("d.logs").alias("logs"), every.alias("every"))
    rows = rows.dropDuplicates(["hash"]).join(stored.select("hash"), "hash", "left_anti").withColumn("id", F.xxhash64("hash"))
    reports = rows.drop("every")
    events = report_events(rows.select("id", "certname", F.explode("every").alias("r"))).dropDuplicates(list(EVENT))
    if options.event_horizon:
        events = events.filter(F.col("timestamp") >= F.lit(options.event_horizon).cast("timestamp"))
    agent = reports.filter("type != 'plan'").select("certname", "id", "producer_timestamp")
    touched = agent.select("certname").distinct()
    newest_ = agent.unionByName(store["latest_reports"].join(touched, "certname", "left_semi")).groupBy("certname").agg(F.max(F.struct("producer_timestamp", "id")).alias("m"))
    return {"reports": Change(reports), "resource_events": Change(events), "latest_reports": Change(newest_.select("certname", "m.id", "m.producer_timestamp"), touched)}


def node_states(store: Store, commands: DataFrame) -> dict[str, Change]:
    """The batch's nodes after it (``store`` is as the batch leaves the rest): any document makes a node known and, if newer, active again; a deactivation counts unless something newer is stored; the newest expiration setting holds.  ``commands`` are those that were not refused."""
    seen = commands.filter(F.col("command").isin(KINDS[0], KINDS[1], KINDS[2], KINDS[5])).groupBy("certname").agg(F.max("producer_timestamp").alias("seen"))
    off = commands.filter(F.col("command") == "deactivate node").groupBy("certname").agg(F.max("producer_timestamp").alias("off"))
    body = F.from_json("payload", EXPIRATION)
    expire = commands.filter(F.col("command") == "configure expiration").groupBy("certname").agg(F.max(F.struct("producer_timestamp", body["expire"]["facts"].alias("facts"))).alias("x"))
    activity = None
    all_ = commands.select("certname").filter("certname is not null").distinct()
    for name in ("catalogs", "factsets", "latest_reports"):
        part = store[name].select("certname", F.col("producer_timestamp").alias("stored")).join(all_, "certname", "left_semi")
        activity = part if activity is None else activity.unionByName(part)
    stored = activity.groupBy("certname").agg(F.max("stored").alias("stored"))
    rows = all_.join(store["certnames"], "certname", "left").join(seen, "certname", "left").join(off, "certname", "left").join(expire, "certname", "left").join(stored, "certname", "left")
    last = F.greatest("seen", "stored")
    applied = F.col("off").isNotNull() & (last.isNull() | (F.col("off") >= last)) & (F.col("deactivated").isNull() | (F.col("off") >= F.col("deactivated")))
    revived = F.col("seen").isNotNull() & (F.col("seen") > F.coalesce(F.greatest("deactivated", "expired"), F.lit("0001-01-01").cast("timestamp")))
    newer = F.col("x").isNotNull() & (F.col("facts_expire_updated").isNull() | (F.col("x.producer_timestamp") > F.col("facts_expire_updated")))
    kept = lambda c: F.when(~revived, F.col(c))
    states = rows.select(
        "certname", F.when(applied, F.col("off")).otherwise(kept("deactivated")).alias("deactivated"), kept("expired").alias("expired"),
        F.when(newer, F.col("x.facts")).otherwise(F.col("facts_expire")).alias("facts_expire"), F.when(newer, F.col("x.producer_timestamp")).otherwise(F.col("facts_expire_updated")).alias("facts_expire_updated"),
    )
    return {"certnames": Change(states, all_)}


def apply_commands(store: Store, commands: DataFrame, options: Options = Options(), hold: list | None = None) -> Mapping[str, Change]:  # noqa: B008
    """What the batch changes, relation by relation, made when asked for; with ``hold`` what several relations share is persisted and listed there."""
    good, bad = documents(_kept(upgraded(commands), hold), hold)
    makers = _each(lambda: replace_catalogs(store, good["replace catalog"]), "catalogs", "catalog_resources", "edges")
    makers |= _each(lambda: replace_facts(store, good["replace facts"], options), "factsets", "certname_packages", "packages")
    makers |= _each(lambda: replace_inputs(store, good["replace catalog inputs"]), "catalog_inputs", "catalog_inputs_meta")
    makers |= _each(lambda: store_reports(store, good["store report"], options), "reports", "resource_events", "latest_reports")
    documented = Lazy(makers)

    def states() -> dict[str, Change]:
        accepted = reduce(DataFrame.unionByName, [rows.select("command", "certname", "producer_timestamp", "payload") for rows in good.values()])
        return node_states(changed(store, documented), accepted)

    def names(column: str) -> Change:
        new = reduce(DataFrame.unionByName, [documented[t].rows.select(F.col(column).alias("name")) for t in ("catalogs", "factsets", "reports")])
        return Change(store[f"{column}s"].unionByName(new.filter("name is not null")).distinct())

    others = {"environments": lambda: names("environment"), "producers": lambda: names("producer"), "rejected": lambda: Change(bad())}
    return Lazy({n: lambda n=n: documented[n] for n in documented} | _each(states, "certnames") | others)


def dead_letters(store: Store) -> DataFrame:
    """The refused commands as they came, to be mended and submitted again."""
    return store["rejected"].select([f.split()[0] for f in COMMANDS.split(", ")])


@dataclass(frozen=True)
class Retries:
    """A batch that fails is tried ``quick`` times more at once, ``wait`` seconds apart; then the stream stops, and after ``starts`` starts that ended so its commands go to the dead letters."""

    quick: int = 4
    wait: float = 1.0
    starts: int = 5


def persistently(work: Callable[[], None], retries: Retries) -> None:
    for turn in range(retries.quick + 1):
        try:
            return work()
        except Exception:
            if turn == retries.quick:
                raise
            time.sleep(retries.wait)


def stream(
    spark: SparkSession, source: str, snapshots: Snapshots, checkpoint: str, options: Options = Options(), event_ttl_days: float | None = None, retries: Retries = Retries(),  # noqa: B008
) -> StreamingQuery:
    """Applies the JSON command files under ``source`` to the snapshots and stops when all are read; the checkpoint remembers which were.

    ``event_ttl_days`` before now lies the horizon of events, where ``options`` names none.
    """

    def horizon() -> str | None:
        if options.event_horizon or event_ttl_days is None:
            return options.event_horizon
        return (datetime.now(UTC) - timedelta(days=event_ttl_days)).strftime("%Y-%m-%d %H:%M:%S")

    def apply(commands: DataFrame, number: int) -> None:
        hold: list[DataFrame] = []
        try:
            snapshots.commit(apply_commands(snapshots.store(), commands, Options(options.blocklist, options.as_regex, horizon()), hold), number)
        finally:
            for df in hold:
                df.unpersist()

    def batch(commands: DataFrame, number: int) -> None:
        if commands.isEmpty():
            return
        try:
            persistently(lambda: apply(commands, number), retries)
        except Exception as e:
            if snapshots.failures(number) < retries.starts:
                raise
            snapshots.commit({"rejected": Change(refused(commands, f"failed: {str(e)[:500]}", retries.starts))}, number)

    return spark.readStream.schema(COMMANDS).json(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
