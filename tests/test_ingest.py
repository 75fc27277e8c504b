"""Commands: the same ones give the same store, and those of different nodes and times commute."""

import datetime as dt
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from fleetlens import queries
from fleetlens.engine import Engine, flat
from fleetlens.operators import retention, stats
from fleetlens.queries import QUERIES
from fleetlens.sources.binding import bind
from fleetlens.sources.snapshots import HISTORIES, KEPT, Change, Snapshots, changed
from fleetlens.sources.store import SCHEMAS, Store
from fleetlens.streaming import ingest
from fleetlens.streaming.ingest import COMMANDS, Options, Retries, apply_commands, containing_class, dead_letters, stream
from fleetlens.streaming.wire import may_have_version

T0 = dt.datetime(2020, 1, 1)


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    """A handful of rows a table: most of the time would go into starting tasks."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def at(minute):
    return T0 + dt.timedelta(minutes=minute)


def command(kind, node, minute, body, received=None):
    return (kind, 9, at(minute if received is None else received), node, at(minute), json.dumps(body))


def facts(node, minute, value, received=None):
    return command("replace facts", node, minute, {"environment": f"e{value}", "producer": "p", "values": {"v": value, "blocked": 1}, "package_inventory": [["a", str(value), "apt"]]}, received)


def catalog(node, minute, title, bad=False):
    resource = {"type": "File", "title": title, "exported": False, "tags": ["File"], "parameters": {"x": 1}}
    edge = {"source": {"type": "File", "title": "other" if bad else title}, "target": {"type": "File", "title": title}, "relationship": "contains"}
    return command("replace catalog", node, minute, {"environment": "e", "version": title, "producer": "p", "resources": [resource], "edges": [edge]})


def report(node, minute, status="changed", kind="agent"):
    time = at(minute).isoformat()
    event = {"status": "success", "timestamp": time, "property": "p", "new_value": {"b": 1}, "old_value": None, "message": "m"}
    resources = [
        {"skipped": False, "timestamp": time, "resource_type": "File", "resource_title": "a", "containment_path": ["Stage[main]", "Foo", "File[a]"], "events": [event]},
        {"skipped": True, "timestamp": time, "resource_type": "File", "resource_title": "b", "containment_path": ["Foo", "", "Bar[Baz]"], "events": []},
        {"skipped": False, "timestamp": time, "resource_type": "File", "resource_title": "c", "containment_path": [], "events": []},
    ]
    return command("store report", node, minute, {"environment": "e", "producer": "p", "status": status, "type": kind, "end_time": time, "resources": resources})


def inputs(node, minute, name, received=None):
    return command("replace catalog inputs", node, minute, {"catalog_uuid": name, "inputs": [["hiera", name]]}, received)


def empty(spark):
    return Store.of(spark, {n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()})


def applied(spark, store, rows, cut=False, **how):
    """The store after the commands, and what was refused; ``cut`` stores it, where more is to follow."""
    hold = []
    after = changed(store, apply_commands(store, spark.createDataFrame(rows, COMMANDS).coalesce(1), hold=hold, **how))
    if not cut:
        return after, after["rejected"]
    kept = Store.of(spark, {n: after[n].checkpoint() for n in KEPT})
    for df in hold:
        df.unpersist()
    return kept, kept["rejected"]


def content(store, names=tuple(SCHEMAS)):
    skip = ("id", "report_id", "receive_time")
    return {n: sorted(map(str, flat(store[n].drop(*skip)).collect())) for n in names}


def test_newest_wins(spark):
    store, _ = applied(spark, empty(spark), [facts("a", 2, 5), facts("a", 1, 4), facts("b", 1, 1), facts("b", 1, 2, received=9)], cut=True)
    assert [tuple(r) for r in Engine(store, "2020-01-02").query("facts[certname, value] { name = 'v' order by certname }").select("certname", F.to_json("value")).collect()] == [("a", "5"), ("b", "2")]
    stale, _ = applied(spark, store, [facts("a", 1, 9), facts("b", 1, 3)])
    found = dict(stale["factsets"].select("certname", "environment").collect())
    assert found == {"a": "e5", "b": "e3"}  # older is stale, equally old replaces
    assert sorted(r.version for r in stale["certname_packages"].collect()) == ["3", "5"]


def test_inputs_keep_the_first_of_equal_times(spark):
    store, _ = applied(spark, empty(spark), [inputs("a", 3, "first", 1), inputs("a", 3, "second", 2)], cut=True)
    store, _ = applied(spark, store, [inputs("a", 3, "third")])
    assert [r.name for r in store["catalog_inputs"].collect()] == ["first"]


def test_catalogs_are_validated(spark):
    store, rejected = applied(spark, empty(spark), [catalog("a", 1, "good"), catalog("b", 1, "bad", bad=True), ("no such command", 1, at(1), "c", at(1), "{}")])
    assert [r.title for r in store["catalog_resources"].collect()] == ["good"] and store["edges"].count() == 1
    assert sorted((r.certname, r.reason) for r in rejected.collect()) == [("b", "invalid catalog"), ("c", "unknown command")]
    assert store["catalog_resources"].first().tags == ["file"]


def test_reports(spark):
    rows = [report("a", 1), report("a", 5, "failed"), report("a", 9, kind="plan"), report("a", 1)]
    store, _ = applied(spark, empty(spark), rows, cut=True)
    assert sorted((r.status, r.type, r.latest) for r in store["reports"].collect()) == [("changed", "agent", False), ("changed", "plan", False), ("failed", "agent", True)]
    events = store["resource_events"].collect()
    assert sorted((r.status, r.resource_title, r.containing_class, r.new_value) for r in events) == [("skipped", "b", "Foo", None)] * 3 + [("success", "a", "Foo", '{"b":1}')] * 3
    again, _ = applied(spark, store, rows)
    assert again["reports"].count() == 3 and again["resource_events"].count() == 6


def test_old_formats(spark):
    time = at(1).isoformat()
    old_event = {"status": "success", "timestamp": time, "property": "p", "new-value": 1, "old-value": 0, "message": "m", "resource-type": "File", "resource-title": "a", "containment-path": ["Foo"]}
    old_report = {"start-time": time, "end-time": time, "mytool-version": "3.1", "configuration-version": "c1", "report-format": 3, "transaction-uuid": "t", "status": "changed", "resource-events": [old_event]}
    old_catalog = {"name": "a", "version": "1", "transaction-uuid": "t9", "edges": [], "resources": [{"type": "File", "title": "a", "tags": [], "parameters": {"my-own-key": 1}}]}
    new_report = {"mytool_version": "8", "status": "unchanged", "end_time": time, "resources": []}
    rows = [("store report", 3, at(2), "a", None, json.dumps(old_report)), ("replace catalog", 5, at(2), "a", at(1), json.dumps(old_catalog)), ("store report", 8, at(3), "b", at(3), json.dumps(new_report))]
    store, _ = applied(spark, empty(spark), rows)
    found = {r.certname: r for r in store["reports"].collect()}
    assert (found["a"].agent_version, found["a"].configuration_version, found["a"].producer_timestamp, found["b"].agent_version) == ("3.1", "c1", at(2), "8")
    assert [(r.resource_title, r.new_value, r.containing_class) for r in store["resource_events"].collect()] == [("a", "1", "Foo")]
    assert store["catalogs"].first().catalog_uuid == "t9"
    assert Engine(store, "2020-01-02").query("resources[title, parameters.my-own-key] {}").select(F.to_json("`parameters.my-own-key`")).first()[0] == "1"


def test_node_states(spark):
    off = lambda node, m: command("deactivate node", node, m, {})
    store, _ = applied(spark, empty(spark), [facts("a", 1, 1), off("a", 5), facts("b", 9, 1), off("b", 5), command("configure expiration", "c", 3, {"expire": {"facts": False}})], cut=True)
    found = {r.certname: (r.deactivated, r.facts_expire) for r in store["certnames"].collect()}
    assert found == {"a": (at(5), None), "b": (None, None), "c": (None, False)}
    store, _ = applied(spark, store, [facts("a", 6, 2)])
    assert {r.certname: r.deactivated for r in store["certnames"].collect()}["a"] is None


@pytest.mark.parametrize("seed", [1, 2])
def test_order_does_not_matter(spark, seed):
    rng = random.Random(seed)
    minutes = rng.sample(range(60), 12)
    makers = [lambda n, m: facts(n, m, m), lambda n, m: catalog(n, m, f"t{m}"), lambda n, m: report(n, m), lambda n, m: inputs(n, m, f"i{m}"), lambda n, m: command("deactivate node", n, m, {}), lambda n, m: command("configure expiration", n, m, {"expire": {"facts": bool(m % 2)}})]
    commands = [makers[i % 6](rng.choice("xyz"), m) for i, m in enumerate(minutes)]
    whole, _ = applied(spark, empty(spark), commands, cut=True)
    rng.shuffle(commands)
    split, _ = applied(spark, applied(spark, empty(spark), commands[:6], cut=True)[0], commands[6:])
    names = ("factsets", "catalogs", "catalog_resources", "edges", "catalog_inputs", "reports", "resource_events", "certnames")
    a, b = content(whole, names), content(split, names)
    for name in names:
        assert a[name] == b[name], name
    twice, _ = applied(spark, whole, commands)
    assert content(twice, names[:-1]) == {n: a[n] for n in names[:-1]}


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    snapshots = Snapshots(spark, str(tmp_path / "store"))

    def submit(name, rows):
        spark.createDataFrame(rows, COMMANDS).coalesce(1).write.mode("append").json(str(source))

    submit("1", [facts("a", 1, 1), catalog("a", 1, "t"), report("a", 2)])
    run = lambda: stream(spark, str(source), snapshots, str(tmp_path / "cp")).awaitTermination()
    run()
    submit("2", [facts("a", 5, 7), facts("b", 5, 8)])
    run()
    run()
    store = snapshots.store()
    assert sorted(r.environment for r in store["factsets"].collect()) == ["e7", "e8"] and store["reports"].count() == 1
    version = snapshots.manifest().version
    snapshots.commit({"factsets": Change(store["factsets"].limit(0))}, batch=0)  # a batch that was applied is not applied again
    assert snapshots.manifest().version == version and snapshots.store()["factsets"].count() == 2
    submit("3", [report("b", 9), report("a", 1)])
    run()
    snapshots.compact()
    snapshots.vacuum(keep=1)
    assert sorted((r.certname, r.latest) for r in snapshots.store()["reports"].collect()) == [("a", False), ("a", True), ("b", True)]
    assert snapshots.store()["factsets"].count() == 2


def test_upkeep(spark):
    store, _ = applied(spark, empty(spark), [facts("old", 1, 1), facts("new", 60 * 24 * 20, 2), command("deactivate node", "gone", 3, {}), report("old", 1), catalog("new", 60 * 24 * 20, "t"), command("configure expiration", "kept", 1, {"expire": {"facts": False}})])
    now = "2020-01-22 00:00:00"
    expired = {r.certname: r.expired is not None for r in retention.expire_nodes(store, now).collect()}
    assert expired == {"old": True, "new": False, "gone": False, "kept": False}
    assert retention.purged(store, now).collect()[0].certname == "gone"
    assert retention.purge_nodes(store, now)["certnames"].filter("certname = 'gone'").isEmpty()
    assert retention.delete_node(store, "old")["factsets"].count() == 1
    dropped = retention.drop_old(store, now)
    assert dropped["reports"].isEmpty() and dropped["resource_events"].isEmpty()
    assert sorted(r.name for r in retention.collect_garbage(store)["environments"].collect()) == ["e", "e1", "e2"]
    assert stats.population(store).first().active_nodes == 3


def test_containing_class(spark):
    paths = [["Foo", "", "Bar[Baz]"], ["Stage[main]", "A", "B", "C[d]"], ["X[y]"], [], None]
    df = spark.createDataFrame([(p,) for p in paths], "p array<string>")
    assert [r[0] for r in df.select(containing_class(F.col("p"))).collect()] == ["Foo", "B", None, None, None]


def test_permutations_of_equal_kind_commute(spark):
    rows = [facts("a", m, m) for m in (1, 2, 3)]
    after = lambda p: changed(empty(spark), apply_commands(empty(spark), spark.createDataFrame(list(p), COMMANDS).coalesce(1)))["factsets"]
    results = {json.dumps(sorted(map(str, flat(after(p)).collect()))) for p in itertools.permutations(rows)}
    assert len(results) == 1


BROKEN = [
    ("replace facts", "{broken json"), ("replace facts", '{"values": 5}'), ("replace facts", "[]"), ("replace facts", None), ("replace facts", '{"values": {"v": 1}, "package_inventory": [["a"]]}'),
    ("replace catalog", "{broken json"), ("replace catalog", "{}"), ("replace catalog", '{"resources": [{"type": "File"}], "edges": []}'), ("replace catalog inputs", '{"inputs": "x"}'), ("replace catalog inputs", '{"inputs": [["one"]]}'),
    ("store report", "{broken"), ("store report", '{"status": "changed"}'), ("configure expiration", '{"expire": true}'), ("configure expiration", '{"expire": {}}'), ("configure expiration", "nothing"), ("no such command", "{}"),
]


def test_malformed_payloads_change_nothing(spark):
    before, _ = applied(spark, empty(spark), [facts("a", 1, 5), catalog("a", 1, "t"), report("a", 1), inputs("a", 1, "i"), command("configure expiration", "a", 1, {"expire": {"facts": False}})], cut=True)
    rows = [(kind, 9, at(m), "a", at(m), payload) for m, (kind, payload) in enumerate(BROKEN, 10)] + [("deactivate node", 3, at(40), None, at(40), "{}"), ("replace facts", 5, at(41), None, at(41), '{"values": {}}')]
    after, rejected = applied(spark, before, rows, cut=True)
    assert content(after) == content(before)
    found = rejected.collect()
    assert sorted((r.command, str(r.payload)) for r in found) == sorted((r[0], str(r[5])) for r in rows)  # as they came
    assert {r.reason.split(":")[0] for r in found} == {"malformed payload", "invalid facts", "invalid catalog", "invalid inputs", "invalid report", "invalid expiration", "unknown command", "no certname or time"}
    assert sorted(map(str, dead_letters(after).collect())) == sorted(map(str, spark.createDataFrame(rows, COMMANDS).collect()))
    mended = [(*r[:5], '{"values": {"v": 7}}') for r in rows[:1]]
    again, _ = applied(spark, after, mended)
    assert Engine(again, "2020-01-02").query("facts { value = 7 }").count() == 1


def test_big_catalogs_are_validated_by_sets(spark):
    n = 20_000
    resources = [{"type": "File", "title": f"t{i}", "tags": [], "parameters": {}} for i in range(n)]
    edges = [{"source": {"type": "File", "title": f"t{i}"}, "target": {"type": "File", "title": f"t{i + 1}"}, "relationship": "before"} for i in range(n - 1)]
    good = command("replace catalog", "a", 1, {"environment": "e", "version": "1", "resources": resources, "edges": edges})
    dangling = command("replace catalog", "b", 1, {"environment": "e", "version": "1", "resources": resources, "edges": [*edges, {"source": {"type": "File", "title": "t0"}, "target": {"type": "User", "title": "t0"}, "relationship": "before"}]})
    strange = command("replace catalog", "c", 1, {"environment": "e", "version": "1", "resources": resources[:1], "edges": [{"source": {"type": "File", "title": "t0"}, "target": {"type": "File", "title": "t0"}, "relationship": "likes"}]})
    store, rejected = applied(spark, empty(spark), [good, dangling, strange])
    assert [r.certname for r in store["catalogs"].collect()] == ["a"] and store["edges"].count() == n - 1
    assert sorted((r.certname, r.reason) for r in rejected.collect()) == [("b", "invalid catalog"), ("c", "invalid catalog")]


def test_blocklists_horizons_and_own_keys(spark):
    event = {"status": "success", "timestamp": at(5).isoformat(), "property": "p", "new_value": {"kernel_version": "5"}, "old_value": None, "message": "m"}
    late = event | {"timestamp": at(90).isoformat()}
    body = {"status": "changed", "mytool_version": "8.1", "configuration_version": "c", "resources": [{"skipped": False, "timestamp": at(5).isoformat(), "resource_type": "File", "resource_title": "a", "containment_path": [], "events": [event, event, late]}]}
    rows = [facts("a", 1, 5), command("store report", "a", 100, body)]
    store, _ = applied(spark, empty(spark), rows, options=Options(("blocked",), event_horizon="2020-01-01 01:00:00"))
    assert store["factsets"].select(F.map_keys("facts")).first()[0] == ["v"]
    assert [(r.timestamp, r.new_value) for r in store["resource_events"].collect()] == [(at(90), '{"kernel_version":"5"}')]
    assert [(r.agent_version, r.configuration_version) for r in store["reports"].collect()] == [("8.1", "c")]
    store, _ = applied(spark, empty(spark), rows, options=Options(("b.*d",), as_regex=True))
    assert store["factsets"].select(F.map_keys("facts")).first()[0] == ["v"] and store["resource_events"].count() == 2  # an event counts once


def test_hashes_tell_what_they_should(spark):
    a, _ = applied(spark, empty(spark), [facts("a", 1, 5), catalog("a", 1, "t"), report("a", 1)])
    b, _ = applied(spark, empty(spark), [facts("a", 9, 5, received=11), catalog("a", 9, "t"), report("a", 9)])
    c, _ = applied(spark, empty(spark), [facts("a", 1, 6), catalog("a", 1, "u"), report("a", 1, "failed")])
    one = lambda s, name: s[name].first().hash
    assert one(a, "factsets") == one(b, "factsets") != one(c, "factsets")  # not when it was sent
    assert one(a, "catalogs") == one(b, "catalogs") != one(c, "catalogs")
    assert one(a, "reports") == one(c, "reports") != one(b, "reports")  # who ran what and when


def test_upkeep_is_committed(spark, tmp_path):
    snapshots = Snapshots(spark, str(tmp_path / "store"), per_bucket=3)
    submit = lambda rows, n: snapshots.commit(apply_commands(snapshots.store(), spark.createDataFrame(rows, COMMANDS)), n)
    day = 60 * 24
    submit([facts("old", 1, 1), report("old", 1), report("gone", day), catalog("gone", 2, "t"), facts("new", 30 * day, 2), report("new", 2 * day), report("new", 30 * day), command("deactivate node", "gone", 2 * day, {})], 0)
    submit([report("new", 30 * day + 5), *[facts(f"n{i}", 30 * day, i) for i in range(250)]], 1)
    assert snapshots.manifest().depth == 0 and len(snapshots.manifest().relations["reports"]) == 5
    retention.upkeep(snapshots, "2020-02-01 00:00:00")
    store = snapshots.store()
    states = {r.certname: r.expired is not None for r in store["certnames"].collect()}
    assert states["old"] and not states["new"] and "gone" not in states
    for name in ("reports", "resource_events", "catalogs", "catalog_resources", "edges", "latest_reports", "factsets"):
        assert store[name].filter("certname = 'gone'").isEmpty(), name
    assert {r.certname for r in store["reports"].collect()} == {"new"} and store["reports"].count() == 2 and store["reports"].filter("latest").count() == 1
    assert {r.certname for r in store["latest_reports"].collect()} == {"new"} and {p.rpartition("=")[2] for p in snapshots.manifest().relations["reports"]} == {"2020-01-31"}
    assert "e" in {r.name for r in store["environments"].collect()}
    whole = content(store)
    snapshots.compact()
    assert snapshots.manifest().buckets["factsets"] > 64 and len(snapshots.manifest().relations["reports"]) == 1
    snapshots.vacuum(keep=1)
    assert content(snapshots.store()) == whole and set(HISTORIES) <= set(KEPT)
    submit([facts("n7", 31 * day, 99)], 2)
    assert snapshots.store()["factsets"].filter("certname = 'n7'").first().environment == "e99" and snapshots.store()["factsets"].count() == 252


def test_a_failing_batch_is_tried_again_and_then_set_aside(spark, tmp_path, monkeypatch):
    source, snapshots = tmp_path / "in", Snapshots(spark, str(tmp_path / "store"))
    spark.createDataFrame([facts("a", 1, 1)], COMMANDS).coalesce(1).write.json(str(source))
    commit, calls = Snapshots.commit, []

    def fails(self, changes, *args, **how):
        if set(changes) != {"rejected"}:
            calls.append(1)
            raise RuntimeError("no room")
        return commit(self, changes, *args, **how)

    monkeypatch.setattr(Snapshots, "commit", fails)
    run = lambda: stream(spark, str(source), snapshots, str(tmp_path / "cp"), retries=Retries(quick=1, wait=0, starts=2)).awaitTermination()
    with pytest.raises(Exception, match="no room"):
        run()
    run()
    assert len(calls) == 4
    found = snapshots.store()["rejected"].collect()
    assert [(r.certname, r.attempts) for r in found] == [("a", 2)] and "no room" in found[0].reason and json.loads(found[0].payload)["values"]["v"] == 1


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_edges_parse_a_catalog_once_and_join_nothing_that_is_empty(spark):
    nothing = Store(spark, {})
    after = changed(nothing, apply_commands(nothing, spark.createDataFrame([catalog("n", 1, "a")], COMMANDS)))
    plan = optimized(after["edges"])
    assert plan.count("from_json(") == 1 and "Join" not in plan


def test_a_refused_catalog_is_parsed_once(spark):
    nothing = Store(spark, {})
    rows = spark.createDataFrame([catalog("n", 1, "a", bad=True)], COMMANDS).withColumn("command", F.lit("replace catalog"))
    rejected = changed(nothing, apply_commands(nothing, rows))["rejected"]
    assert [r.reason for r in rejected.collect()] == ["invalid catalog"] and optimized(rejected).count("from_json(") == 1


def test_plans_are_not_latest_and_reports_are_dealt_alike_for_the_flag(spark):
    nothing = Store(spark, {})
    rows = [report("n", 1), report("n", 2), report("n", 3, kind="plan"), report("m", 1, kind="plan")]
    latest = changed(nothing, apply_commands(nothing, spark.createDataFrame(rows, COMMANDS)))["reports"].filter("latest").select("certname", "producer_timestamp")
    assert [tuple(r) for r in latest.collect()] == [("n", at(2))]
    assert "ReusedExchange" in latest._jdf.queryExecution().executedPlan().toString()


def test_reports_without_their_flag_join_nothing_and_parse_once(spark):
    nothing = Store(spark, {})
    reports = changed(nothing, apply_commands(nothing, spark.createDataFrame([report("n", 1)], COMMANDS)))["reports"].select("certname", "status")
    plan = optimized(reports)
    assert "Join" not in plan and plan.count("from_json(") == 2  # the document, and where it may name one its tool's version


@pytest.mark.parametrize("key, found", [("mytool_version", "3.1"), ("mytool-version", "3.1"), ("my\\u0074ool_version", "3.1"), ("configuration_version", None), ("api_version", None)])
def test_a_tools_version_is_found_wherever_a_key_may_be_one(spark, key, found):
    payload = f'{{"{key}": "3.1", "resources": []}}'
    nothing = Store(spark, {})
    for text in (payload, payload.replace(f'"{key}"', f"'{key}'")):
        rows = spark.createDataFrame([("store report", 8, at(1), "n", at(1), text)], COMMANDS)
        assert [r.agent_version for r in apply_commands(nothing, rows)["reports"].rows.collect()] == [found]


def test_only_the_relations_asked_for_are_made(spark, monkeypatch):
    for name in ("store_reports", "replace_facts", "replace_inputs", "node_states"):
        monkeypatch.setattr(ingest, name, None)
    nothing = Store(spark, {})
    after = changed(nothing, apply_commands(nothing, spark.createDataFrame([catalog("n", 1, "a")], COMMANDS)))
    assert [r.certname for r in after["catalogs"].select("certname").collect()] == ["n"]


def test_catalogs_are_gathered_as_text_and_their_parameters_need_no_json(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    part = spark.read.parquet(f"{folder}/part.parquet").withColumn("p_brand", F.expr("if(p_partkey % 5 = 0, null, p_brand)")).withColumn("p_retailprice", F.expr("case p_partkey % 7 when 0 then double('NaN') when 1 then 1e9D else p_retailprice end"))
    part.write.parquet(f"{tmp_path}/part.parquet")
    for t in ("customer", "orders", "lineitem"):
        spark.read.parquet(f"{folder}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    doc = F.to_json(F.struct(F.col("p_size").alias("size"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"), F.struct(F.col("p_type").alias("kind")).alias("options")))
    typed = lambda m: F.transform(F.map_entries(m), lambda e: F.concat_ws(" ", e["key"], F.schema_of_variant(e["value"]), F.to_json(e["value"]))).alias("t")
    want = part.select(F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")).alias("title"), typed(F.from_json(doc, "map<string,variant>")))
    found = bind(spark, str(tmp_path))["catalog_resources"].select("title", typed(F.col("parameters"))).distinct()
    titles = {r.title: r.t for r in want.collect()}
    rows = found.collect()
    assert len(rows) > 100 and all(r.t == titles[r.title] for r in rows)


def test_documents_of_reports_are_joined_unsorted_and_joined_json_is_that_of_lists(spark):
    plan = QUERIES["ingest_reports"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    rows = spark.createDataFrame([("a", "x", 'q"1'), ("a", "x", None), ("b", None, "2")], "g string, head string, item string")
    held = rows.groupBy("g", "head").agg(queries._joined("item").alias("text"), F.collect_list(F.struct("item")).alias("list"))
    text = queries._document(F.to_json(F.struct("head")), items=F.col("text"), more=F.lit(""))
    whole = F.to_json(F.struct("head", F.col("list").alias("items"), F.slice("list", 1, 0).alias("more")))
    assert all(r.t == r.w for r in held.select(text.alias("t"), whole.alias("w")).collect())


def test_the_word_version_in_a_report_calls_for_a_look_and_nothing_else_does(spark):
    texts = ['{"configuration_version":"1"}', '{"configuration_version":"1","a":"version"}', '{"configuration_version":"1","x_version":"2"}', '{"configuration_version":"1","x\\u005fversion":"2"}']
    plain = spark.createDataFrame([(t,) for t in texts], "payload string").select(may_have_version(F.col("payload")).alias("m"))
    assert [r.m for r in plain.collect()] == [False, False, True, True] and "Contains(replace(" in optimized(plain)


def test_catalogs_come_from_one_pass_over_the_lines_and_hold_the_rows_of_their_relations(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    read = lambda t: spark.read.parquet(f"{folder}/{t}.parquet")
    part = read("part").withColumn("p_brand", F.expr("if(p_partkey % 5 = 0, null, p_brand)")).withColumn("p_retailprice", F.expr("case p_partkey % 7 when 0 then double('NaN') when 1 then 1e9D else p_retailprice end"))
    part = part.unionByName(part.filter("p_partkey % 11 = 0"))
    orders = read("orders").unionByName(read("orders").filter("o_orderkey % 6 = 0"))
    lineitem = read("lineitem").unionByName(read("lineitem").filter("l_orderkey % 4 = 0")).unionByName(read("lineitem").limit(50).withColumn("l_partkey", F.lit(None).cast("bigint")))
    made = {"part": part, "orders": orders, "lineitem": lineitem, "customer": read("customer"), "nation": read("nation"), "region": read("region")}
    for t, rows in made.items():
        rows.write.parquet(f"{tmp_path}/{t}.parquet")
    store = bind(spark, str(tmp_path))
    commands = queries._catalog_commands(store)
    assert optimized(commands).count("Relation [l_orderkey") == 1 and "SortMergeJoin" not in commands.filter("certname is not null")._jdf.queryExecution().executedPlan().toString()
    docs = commands.select("certname", F.from_json("payload", ingest.CATALOG).alias("d")).persist()
    fields = ["certname", "type", "title", "exported", "file", "line", "tags", F.to_json("parameters").alias("parameters")]
    listed = docs.select("certname", F.explode("d.resources").alias("r")).select("certname", "r.*").select(fields)
    stored = store["catalog_resources"].withColumn("tags", F.transform("tags", lambda x: F.replace(x, F.lit("#"), F.lit("_")))).select(fields)
    ends = docs.filter("certname not like '%7'").select("certname", F.explode("d.edges").alias("e")).select("certname", "e.source.type", "e.source.title", F.col("e.target.type").alias("t"), F.col("e.target.title").alias("n"), "e.relationship")
    in_order = lambda df: sorted(map(repr, df.collect()))
    rows, edges = in_order(listed), in_order(ends.toDF(*store["edges"].columns))
    assert len(rows) > 1000 and rows == in_order(stored)
    assert len(edges) > 1000 and edges == in_order(store["edges"].filter("certname not like '%7'"))
    docs.unpersist()
