"""Queries over small hand-made inventories with known answers."""

import json

import pytest
from pyspark.sql import functions as F

from fleetlens.engine import Engine, ast_text, collect_resources, facts_search, flat
from fleetlens.errors import BadQuery, NotFound, Timeout
from fleetlens.functions.tochar import date_text, number_text
from fleetlens.operators.anonymize import anonymize
from fleetlens.sources.archive import export, read_folder, time_shift, unpack, write_folder
from fleetlens.sources.store import SCHEMAS, Store

NOW = "2020-02-01 00:00:00"
STRUCTURED = {"a": 1, "b": 3.14, "c": ["a", "b", "c"], "d": {"n": ""}, "e": "1", "f": None}
FACTS = {
    "foo1": ("DEV", {"uptime_seconds": 4000, "my_structured_fact": STRUCTURED, "domain": "testing.com", "test#~delimiter": "foo", "empty": {}, "dotted.thing": {"x": "quoted"}}),
    "foo2": ("DEV", {"uptime_seconds": 6000, "my_structured_fact": STRUCTURED, "domain": "testing.com"}),
    "foo3": ("PROD", {"my_structured_fact": STRUCTURED, "domain": "testing.com", "operatingsystem": "Darwin", "uptime_text": "12"}),
    "foo4": ("PROD", {"uptime_seconds": 6000, "my_structured_fact": {**STRUCTURED, "b": 2.71}, "hostname": "bar"}),
}


@pytest.fixture(scope="module")
def store(spark):
    def rows(name, values):
        plain = SCHEMAS[name].replace("map<string,variant>", "string")
        df = spark.createDataFrame(values, plain)
        return df.withColumns({c: F.from_json(c, "map<string,variant>") for c in ("facts", "parameters") if c in df.columns})

    import datetime as dt

    t = lambda d, h=0: dt.datetime(2020, 1, d, h)
    report = lambda i, node, day, status, kind="agent", latest=False: (i, f"h{i}", node, "DEV", "1", 12, "v", t(day), t(day, 1), t(day, 2), t(day, 3), "p1", None, None, None, None if i % 2 else "job", None, status, kind, False, None, i == 1, '[{"a":1}]', "[]", latest)
    event = lambda r, node, status, day, title, prop, cls, name=None: (r, node, status, t(day), "Notify", title, prop, '"new"', "1", None, None, r, ["Stage[main]", cls or "", f"Notify[{title}]"], cls, r == 1, name)
    made = {
        "certnames": [("foo1", None, None, None, None), ("foo2", None, None, False, t(2)), ("foo3", None, None, None, None), ("foo4", t(30), None, None, None), ("foo5", None, t(1), None, None)],
        "factsets": [(n, e, t(3), t(3), "p1", f"f{n}", json.dumps(d)) for n, (e, d) in FACTS.items()],
        "reports": [report(1, "foo1", 5, "changed"), report(2, "foo1", 6, "failed", latest=True), report(3, "foo2", 5, "unchanged", latest=True), report(4, "foo2", 9, "changed", "plan")],
        "resource_events": [event(1, "foo1", "success", 5, "notify, foo", "message", None), event(1, "foo1", "failure", 5, "notify, bar", "message", None), event(1, "foo1", "skipped", 5, "hi", None, "Foo"),
                            event(2, "foo1", "success", 6, "notify, bar", "message", None), event(2, "foo1", "failure", 6, "notify, bar", "message", "Foo"), event(3, "foo2", "noop", 5, "hi", None, "Foo")],
        "catalogs": [("foo1", "c1", "7", None, None, None, None, "DEV", t(4), "p1"), ("foo2", "c2", "8", None, None, None, None, "PROD", t(4), "p2")],
        "catalog_resources": [("foo1", "r1", "File", "/etc/a", ["file", "one"], True, "/x.m", 3, '{"ensure":"file","owner":{"name":"root"}}'), ("foo2", "r2", "File", "/etc/b", ["file"], False, None, None, None), ("foo2", "r3", "User", "root", [], True, None, 9, '{"uid":0}')],
        "edges": [("foo1", "Class", "Main", "File", "/etc/a", "contains")],
        "packages": [("bash", "5", "apt"), ("zsh", "1", "apt")], "certname_packages": [("foo1", "bash", "5", "apt"), ("foo2", "bash", "5", "apt"), ("foo1", "zsh", "1", "apt")],
        "environments": [("DEV",), ("PROD",)], "producers": [("p1",), ("p2",)],
    }
    return Store.of(spark, {n: rows(n, v).cache() for n, v in made.items()} | {n: spark.createDataFrame([], SCHEMAS[n]) for n in SCHEMAS if n not in made})


@pytest.fixture(scope="module")
def ask(store):
    def run(query, surface="root", **params):
        df = flat(Engine(store, NOW, surface=surface).query(query, **params))
        out = [tuple(r) for r in df.collect()]
        return sorted((r[0] if len(r) == 1 else r for r in out), key=str)

    return run


def test_facts(ask):
    assert ask("facts[avg(value)] { name = 'uptime_seconds' }") == [5000.0]
    assert ask("facts[max(value)] { name = 'uptime_seconds' }") == [6000.0]
    assert ask("facts[certname] { name = 'uptime_seconds' and value > 4500 }") == ["foo2"]
    assert ask("facts[certname] { name = 'uptime_text' and value < 100 }") == []  # text is no number
    assert ask("facts[certname] { name ~ '^up' and value = 4000 }") == ["foo1"]
    assert ask("facts[certname, value] { name = 'operatingsystem' }") == [("foo3", '"Darwin"')]
    assert ask("facts[certname] { name = 'domain' and value ~ 'test.*' }") == ["foo1", "foo2", "foo3"]
    assert ask(["from", "facts", ["extract", ["name"], ["=", "value", {}]]]) == ["empty"]
    assert ask("facts[value, count()] { name = 'uptime_seconds' group by value }", surface="none") == [("4000", 1), ("6000", 2)]
    assert ask("facts[name] { certname = 'foo4' and name = 'hostname' }") == [] and ask("facts[name] { certname = 'foo4' and name = 'hostname' }", surface="none") == ["hostname"]


def test_paths(ask):
    under = lambda p: ["from", "fact_contents", ["extract", ["certname", "value"], ["and", ["=", "certname", "foo1"], p]]]
    assert ask(under(["=", "path", ["my_structured_fact", "c", 1]])) == [("foo1", '"b"')]
    assert ask(under(["=", "path", ["my_structured_fact", "c", "1"]])) == []
    assert ask(under(["=", "path", ["my_structured_fact", "f"]])) == [("foo1", "null")]
    assert ask(under(["~>", "path", ["my_.*", "c", ".*"]])) == [("foo1", '"a"'), ("foo1", '"b"'), ("foo1", '"c"')]
    assert ask(under(["~>", "path", ["my_.*", "c", 2]])) == [("foo1", '"c"')]
    assert ask(under(["null?", "value", True])) == [("foo1", "null")]
    assert ask(under(["in", "path", ["array", [["domain"], ["my_structured_fact", "d", "n"]]]])) == [("foo1", '""'), ("foo1", '"testing.com"')]
    assert ask("fact_contents[path] { certname = 'foo1' and name ~ 'empty' }") == []  # an empty container has no leaf
    assert "test\\#\\~delimiter" in ask("fact_paths[path] {}") and 'my_structured_fact#~c#~0' in ask("fact_paths[path] { name = 'my_structured_fact' }")
    assert ask("fact_paths[path, type] { path ~> ['.*', '[ab]'] }") == [("my_structured_fact#~a", "integer"), ("my_structured_fact#~b", "float")]
    assert ask(["from", "fact_names", ["limit", 2], ["order_by", ["name"]]]) == ["domain", "dotted.thing"]


def test_inventory(ask):
    assert ask("inventory[certname] { facts.my_structured_fact.d.n = '' }") == ["foo1", "foo2", "foo3"]
    assert ask('inventory[certname] { facts."dotted.thing".x = "quoted" }') == ["foo1"]
    assert ask("inventory[certname] { facts.my_structured_fact.c[2] = 'c' and facts.uptime_seconds >= 5000 }") == ["foo2"]
    assert ask("inventory[certname] { facts.my_structured_fact.f is null }") == ["foo1", "foo2", "foo3"]
    assert ask("inventory[certname] { facts.nothing is null or facts.nothing is not null }") == []  # absent is neither
    assert ask("inventory[certname] { !(facts.operatingsystem = 'Darwin') }") == ["foo1", "foo2"]
    assert ask('inventory[certname] { facts.match("up.*") > 5000 }') == ["foo2"]
    assert ask("inventory[certname, facts.my_structured_fact.d] { certname = 'foo1' }") == [("foo1", '{"n":""}')]


def test_nodes_and_subqueries(ask):
    assert ask("nodes[certname] {}") == ["foo1", "foo2", "foo3"]
    assert ask("nodes[certname] { node_state = 'inactive' }") == ["foo4"]  # foo5 expired too long ago
    assert ask("nodes[certname] { node_state = 'any' }") == ["foo1", "foo2", "foo3", "foo4", "foo5"]
    assert ask(["from", "nodes", ["extract", ["certname"], ["=", ["node", "active"], True]]]) == ["foo1", "foo2", "foo3"]
    assert ask("nodes[certname, latest_report_status, report_timestamp] {}") == [("foo1", "failed", "2020-01-06 01:00:00"), ("foo2", "unchanged", "2020-01-05 01:00:00"), ("foo3", None, None)]
    assert ask("nodes[certname] { reports { status = 'changed' } }") == ["foo1"]  # a plan is not the agent's report
    assert ask("nodes[certname] { !(reports { status = 'changed' }) or certname = 'foo1' }") == ["foo1", "foo2", "foo3"]
    assert ask("reports[hash] { !(job_id in reports[job_id] { hash = 'h3' }) }", surface="none") == []  # a null among them: unknown
    assert ask("reports[hash] { !(job_id in reports[job_id] { hash = 'none' }) }", surface="none") == ["h1", "h2", "h3"]
    assert ask("nodes[certname, expires_facts] { expires_facts = false }", include_facts_expiration=True) == [("foo2", False)]
    assert ask("environments { resources { type = 'User' } }") == ["PROD"]
    assert ask(["from", "producers", ["subquery", "catalogs", ["=", "certname", "foo2"]]]) == ["p2"]
    assert ask("package_inventory[certname] { packages { package_name = 'zsh' } }") == ["foo1"]
    assert ask("factsets[certname, package_inventory] { certname ~ '[12]' }", include_package_inventory=True) == [("foo1", '[["bash","5","apt"],["zsh","1","apt"]]'), ("foo2", '[["bash","5","apt"]]')]


def test_resources_and_catalogs(ask, store):
    assert ask("resources[title, parameters.owner.name] { parameters.owner.name = 'root' }") == [("/etc/a", '"root"')]
    assert ask(["from", "resources", ["extract", "title", ["=", ["parameter", "ensure"], "file"]]]) == ["/etc/a"]
    assert ask("resources[title] { tag = 'FILE' }") == ["/etc/a", "/etc/b"] and ask("resources[title] { tags ~ '^o' }") == ["/etc/a"]
    assert ask(collect_resources("User", "foo1")[:2] + [["extract", ["title"], collect_resources("User", "foo1")[2]]]) == ["root"]
    found = ask("catalogs[certname, edges, resources] { certname = 'foo1' }")
    assert json.loads(found[0][1]) == [{"relationship": "contains", "source_type": "Class", "source_title": "Main", "target_type": "File", "target_title": "/etc/a"}]
    assert json.loads(found[0][2])[0]["parameters"] == {"ensure": "file", "owner": {"name": "root"}}
    assert ask(facts_search({"domain": "testing.com", "uptime_seconds.gt": 5000})[:2] + [["extract", "certname", facts_search({"domain": "testing.com", "uptime_seconds.gt": 5000})[2]]]) == ["foo2"]
    named = Engine(store, NOW, version_field="mytool_version")
    assert named.query("reports[mytool_version, hash] { mytool_version = '1' and hash = 'h1' }").collect() == [("1", "h1")]
    for unknown in ("mytool_version", "kernel_version"):
        with pytest.raises(BadQuery):
            ask(f"reports[hash] {{ {unknown} = '1' }}")
    assert json.loads(ask("reports[resource_events] { hash = 'h2' }")[0])[0]["resource_title"] == "notify, bar"
    assert ask("edges[target_title] {}") == ["/etc/a"] and ast_text(["from", "nodes"]) == '["from","nodes"]'


def test_event_summaries(store):
    e = Engine(store, NOW, surface="none")
    rows = e.query(["from", "event_counts", ["=", "report", "h1"]], summarize_by="containing_class").collect()
    assert sorted((r.subject.title, r.failures, r.skips, r.successes, r.noops) for r in rows if r.subject.title) == [("Foo", 0, 1, 0, 0)]
    assert [(r.failures, r.skips, r.successes, r.noops) for r in rows if r.subject.title is None] == [(1, 0, 1, 0)]
    newest = {"distinct_resources": True, "distinct_start_time": "2020-01-01", "distinct_end_time": "2020-02-01"}
    got = e.query(["from", "events", ["extract", ["resource_title", "status"], ["=", "certname", "foo1"]]], **newest).collect()
    assert sorted(map(tuple, got)) == [("hi", "skipped"), ("notify, bar", "failure"), ("notify, bar", "success"), ("notify, foo", "success")]  # equally new ones all stay
    outside = e.query(["from", "events", ["extract", ["resource_title"], ["and", ["=", "latest_report?", False], ["=", "certname", "foo1"]]]], **newest).collect()
    assert sorted(r[0] for r in outside) == ["hi", "notify, foo"]
    total = e.query(["from", "aggregate_event_counts"], summarize_by="certname,resource", count_by="certname").collect()
    assert [tuple(r) for r in total] == [("certname", 1, 1, 1, 1, 2), ("resource", 1, 1, 2, 1, 3)]
    having = e.query(["from", "event_counts"], summarize_by="certname", counts_filter=["or", [">=", "failures", 2], ["=", "noops", 1]]).collect()
    assert sorted(r.subject.title for r in having) == ["foo1", "foo2"]
    split = e.query(["from", "event_counts"], summarize_by="certname", corrective=True).collect()
    assert {(r.subject.title, r.corrective_successes, r.intentional_successes) for r in split} == {("foo1", 1, 1), ("foo2", 0, 0)}
    for bad in ({}, {"summarize_by": "x"}, {"summarize_by": "certname", "count_by": "x"}, {"summarize_by": "certname", "counts_filter": ["=", "x", 1]}, {"summarize_by": "certname", "distinct_resources": True}):
        with pytest.raises(BadQuery):
            e.query(["from", "event_counts"], **bad)


def test_paging_and_totals(ask, store):
    e = Engine(store, NOW, surface="none")
    assert [r[0] for r in e.query("reports[job_id] { order by job_id, hash }").collect()] == ["job", None, None]
    assert [r[0] for r in e.query("reports[job_id] { order by job_id desc, hash }").collect()] == [None, None, "job"]
    assert [r[0] for r in e.query("reports[hash] { order by hash limit 1 offset 1 }").collect()] == ["h2"]
    assert [r[0] for r in e.query("reports[hash] {}", order_by=["hash"], limit=1).collect()] == ["h1"]
    assert e.total("reports[hash] { limit 1 }") == 3
    assert "Scan" in e.explain("nodes {}") and json.loads(e.to_json("reports[hash, job_id] { hash = 'h1' }").first()[0]) == {"hash": "h1", "job_id": None}


@pytest.mark.parametrize(
    "query",
    [
        "nodes { nope = 1 }", "nodes[nope] {}", "nodes { deactivated > '2020-01-01' }", "facts { value > 'a' }", "resources { line = 'x' }", "reports { noop = 'x' }", "reports { start_time = 'yesterday' }", "nodes { certname ~> ['a'] }",
        "resources { tags in ['a'] }", "facts[sum(name)] {}", "facts[name, count()] {}", "nodes[certname, certname, count()] { group by certname }", "nodes { certname ~ '(' }", ["from", "nodes", ["limit", 0]], ["from", "nodes", ["offset", -1]],
        ["from", "nodes", ["order_by", [["certname", "up"]]]], "nodes { [certname, expired] in reports[certname] {} }", "reports[to_string(start_time, 'Z')] {}", "inventory[facts." + "x" * 60 + "] {}", "reports { metrics = 1 }", "events[report_id] {}", "inventory[facts.my_structured_fact.c[1]] {}", ["from", "reports", ["extract", [["function", "count"], ["function", "count"]]]],
    ],
)
def test_refusals(ask, query):
    with pytest.raises(BadQuery):
        ask(query)


def test_row_values_not_in(spark):
    """Against the three values of SQL: one column that differs decides, whatever nulls the others hold."""
    values = [(a, b) for a in ("x", "y", None) for b in ("1", "2", None)]
    nodes = [(f"n{i}", "e", *v) for i, v in enumerate(values)] * 2

    def differ(p, q):
        pairs = [None if a is None or b is None else a == b for a, b in zip(p, q, strict=True)]
        return False if False in pairs else None if None in pairs else True

    for listed in ([("x", "1")], [("x", None)], [(None, "2")], [(None, None)], [("x", "1"), (None, "2")], [], [("y", "2"), ("x", None)]):
        rows = [("r", n, e, a, b) for n, e, a, b in nodes] + [("s", "q", "e", a, b) for a, b in listed]
        reports = spark.createDataFrame([(i, f"h{i}", n, e, a, b, t == "r" and "agent" or "plan") for i, (t, n, e, a, b) in enumerate(rows)], "id bigint, hash string, certname string, environment string, job_id string, code_id string, type string")
        store = Store(spark, {"reports": lambda r=reports: r.selectExpr("*", "true as latest", "false as corrective_change")})
        got = Engine(store, NOW, surface="none").query("reports[job_id, code_id] { !([job_id, code_id] in reports[job_id, code_id] { type = 'plan' }) }").collect()
        want = [v for v in values * 2 if not any(differ(v, q) in (True, None) for q in listed)]
        assert sorted(map(str, got)) == sorted(str(spark.createDataFrame([v], "job_id string, code_id string").first()) for v in want), listed


def test_deep_values(spark):
    deep = "1"
    for i in range(14):
        deep = f'{{"k{i}":[{deep}, "a [b] {{c}} \\" ["]}}'
    rows = spark.createDataFrame([("n", deep), ("m", "3")], "certname string, v string").select("certname", F.lit("e").alias("environment"), F.create_map(F.lit("d"), F.parse_json("v")).alias("facts"))
    store = Store(spark, {"factsets": lambda: rows})
    assert store.depth() == 28
    got = Engine(store, NOW, surface="none").query("fact_contents[path, value] { certname = 'n' }").select(F.size("path").alias("n"), F.to_json("value").alias("v")).collect()
    assert len(got) == 15 and max(r.n for r in got) == 29 and [r.v for r in got if r.n == 29] == ["1", '"a [b] {c} \\" ["'.replace("\\\\", "\\")]


def test_links_and_typed_paths(store):
    e = Engine(store, NOW, surface="none", links="/api")
    one = lambda q: json.loads(e.query(q).first()[0])
    assert one("reports[resource_events] { hash = 'h2' }")["href"] == "/api/reports/h2/events" and len(one("reports[resource_events] { hash = 'h2' }")["data"]) == 2
    assert one("reports[resource_events] { hash = 'h4' and type = 'any' }") == {"data": [], "href": "/api/reports/h4/events"}
    assert one("catalogs[edges] { certname = 'foo1' }")["href"] == "/api/catalogs/foo1/edges" and one("catalogs[resources] { certname = 'foo2' }")["href"] == "/api/catalogs/foo2/resources"
    assert {"name": "domain", "value": "testing.com"} in one("factsets[facts] { certname = 'foo1' }")["data"]
    paths = {r[0] for r in e.to_json("fact_contents[path] { certname = 'foo1' and name = 'my_structured_fact' }").collect()}
    assert '{"path":["my_structured_fact","c",0]}' in paths and '{"path":["my_structured_fact","d","n"]}' in paths
    assert "domain" in {json.loads(r[0]) for r in e.to_json(["from", "fact_names"]).collect()}


def test_summary_paging(store):
    e = Engine(store, NOW, surface="none")
    rows = e.query(["from", "event_counts"], summarize_by="certname", order_by=[["failures", "desc"]], limit=1).collect()
    assert [r.subject.title for r in rows] == ["foo1"]
    for bad in ({"order_by": [["nope", "asc"]]}, {"order_by": [["failures", "up"]]}, {"limit": 0}, {"offset": -1}, {"limit": True}):
        with pytest.raises(BadQuery):
            e.query(["from", "event_counts"], summarize_by="certname", **bad)


def test_containment(ask):
    inventory = lambda *c: ask(["from", "inventory", ["extract", "certname", list(c)]])
    assert inventory("=", "facts.my_structured_fact", {"a": 1, "d": {}}) == ["foo1", "foo2", "foo3"]
    assert inventory("=", "facts.my_structured_fact.c", ["c", "a"]) == ["foo1", "foo2", "foo3"]
    assert inventory("=", "facts.my_structured_fact.c", ["z"]) == [] and inventory("=", "facts.my_structured_fact.d", {"n": "x"}) == []
    assert inventory("=", "facts", {"domain": "testing.com", "operatingsystem": "Darwin"}) == ["foo3"]
    assert inventory("not", ["=", "facts.my_structured_fact", {"zz": 1}]) == ["foo1", "foo2", "foo3"]


def test_endpoints(store):
    e = Engine(store, NOW)
    rows = lambda path, query=None: sorted((r[0] for r in e.endpoint(path, query).collect()), key=str)
    only = lambda entity, column: ["from", entity, ["extract", [column]]]
    assert rows("/nodes", only("nodes", "certname")) == ["foo1", "foo2", "foo3"] and rows("/nodes/foo1", only("nodes", "certname")) == ["foo1"]
    assert rows("/nodes/foo1/facts/domain", only("facts", "name")) == ["domain"] and rows("/facts/domain/testing.com", only("facts", "certname")) == ["foo1", "foo2", "foo3"]
    assert rows("/environments/PROD/resources/File", only("resources", "title")) == ["/etc/b"] and rows("/catalogs/foo1/edges", only("edges", "target_title")) == ["/etc/a"]
    assert rows("/reports/h2/events", only("events", "status")) == ["failure", "success"] and rows("/reports/h1/metrics") == ['[{"a":1}]']
    assert rows("/producers/p2/catalogs", only("catalogs", "certname")) == ["foo2"] and rows("/fact-names")[:2] == ["domain", "dotted.thing"]
    assert rows("/reports", ["=", "status", "failed"]) == ["h2"] and rows("/package-inventory/foo2", only("package_inventory", "package_name")) == ["bash"]
    with pytest.raises(NotFound):
        e.endpoint("/nodes/nobody/facts")
    for bad in ("/nope", "/nodes/foo1/nope", "/facts/a/b/c", "/reports/h1"):
        with pytest.raises(BadQuery):
            e.endpoint(bad)


def test_presentation_and_time_limits(store):
    e = Engine(store, NOW, surface="none")
    paths = {json.dumps(json.loads(r[0])["path"]) for r in e.to_json("fact_paths[path] {}").collect()}
    assert {'["my_structured_fact", "c", 0]', '["test#~delimiter"]', '["dotted.thing", "x"]'} <= paths
    assert json.loads(e.to_json("resources[parameters] { title = '/etc/b' }").first()[0]) == {"parameters": {}}
    assert json.loads(e.to_json("events[old_value, new_value] { report = 'h3' }").first()[0]) == {"old_value": 1, "new_value": "new"}
    assert json.loads(e.to_json("reports[metrics] { hash = 'h1' }").first()[0]) == {"metrics": [{"a": 1}]}
    assert len(e.rows("reports[hash] {}")) == 3
    with pytest.raises(Timeout):
        e.rows("fact_contents { path ~> ['.*', '.*'] }", timeout=0.001)


def test_masks(spark):
    df = spark.sql("select timestamp'2016-01-05 15:04:05.120340' as t, timestamp'2021-01-03 00:30:00' as s, 7 as n, -12.5 as d, 1234567.891 as m")
    cases = {
        "month": "january  ", "FMMonth": "January", "DAY": "TUESDAY  ", "YYYY-MM-DD HH24:MI:SS": "2016-01-05 15:04:05", 'YY"y" Dy': "16y Tue", "HH12:MI AM": "03:04 PM", "HH:MI p.m.": "03:04 p.m.", "MS US": "120 120340", "FF2": "12",
        "DDD FMDDD": "005 5", "D ID": "3 2", "WW W IW": "01 1 01", "IYYY IDDD": "2016 002", "CC Q J": "21 1 2457393", "RM": "I   ", "FMrm": "i", "Y,YYY YYY Y": "2,016 016 6", "SSSS": "54245", "FMDDth FMMMTH": "5th 1ST", "YYYY BC": "2016 AD", "TZ OF": "UTC +00",
    }
    for mask, text in cases.items():
        assert df.select(date_text(F.col("t"), mask)).first()[0] == text, mask
    assert df.select(date_text(F.col("s"), "IYYY-IW-ID HH12 AM")).first()[0] == "2020-53-7 12 AM"
    numbers = {
        ("n", "FM9999"): "7", ("n", "FM000"): "007", ("n", "999"): "   7", ("n", "S99"): " +7", ("n", "99MI"): " 7 ", ("n", "99PR"): "  7 ", ("n", "FM99TH"): "7th", ("n", "FMRN"): "VII", ("n", "99V99"): "  700",
        ("d", "999.9"): " -12.5", ("d", "FM999.99"): "-12.5", ("d", "FM99.9MI"): "12.5-", ("d", "FM99.9PR"): "<12.5>", ("d", "99.9S"): "12.5-", ("m", "FM9,999,999.90"): "1,234,567.89", ("m", "FM9.99EEEE"): "1.23e+06", ("m", "9G999G999"): " 1,234,568",
    }
    for (column, mask), text in numbers.items():
        assert df.select(number_text(F.col(column), mask)).first()[0] == text, (mask, df.select(number_text(F.col(column), mask)).first()[0])
    for mask in ("QQx", "9x", "S9S", "99L"):
        with pytest.raises(BadQuery):
            date_text(F.col("t"), mask) if "x" in mask and "9" not in mask else number_text(F.col("n"), mask)


def test_joins_that_no_field_needs_are_not_planned(store):
    e = Engine(store, NOW, surface="none")
    assert "Join" not in e.explain("nodes[certname] { certname = 'a' }") and "Join" not in e.explain("events[certname, status] { line = 1 }")
    assert e.explain("nodes[certname, latest_report_status] {}").count("Join LeftOuter") <= 2
    assert "Generate" not in e.explain("facts { name = 'domain' }")


def test_archives_and_shifts(spark, store, tmp_path):
    write_folder(store, str(tmp_path / "out"), ("factsets", "edges"))
    back = read_folder(spark, str(tmp_path / "out"), ("factsets", "edges"))
    assert flat(back["factsets"]).exceptAll(flat(store["factsets"])).isEmpty() and back["edges"].collect() == store["edges"].collect()
    export(store, str(tmp_path / "a.tgz"), ("edges",))
    assert [d["target_title"] for _, d in unpack(str(tmp_path / "a.tgz"))] == ["/etc/a"]
    store.write_parquet(str(tmp_path / "pq"))
    again = Store.parquet(spark, str(tmp_path / "pq"))
    assert again["reports"].count() == 4 and Engine(again, NOW).query("nodes[certname] {}").count() == 3
    moved = time_shift(store["reports"].select("start_time", "end_time"), "2021-01-01 00:00:00")
    assert str(moved.agg(F.max("end_time")).first()[0]).startswith("2021-01-01 00:00:00")


def test_masks_keep_equality(store):
    rows = anonymize(store["resource_events"].select("certname", F.col("resource_title").alias("title"), "message"), "full", "s").collect()
    assert len({r.certname for r in rows}) == 2 and len({r.title for r in rows}) == 3 and "foo1" not in {r.certname for r in rows}
    low = anonymize(store["catalog_resources"].select("title", "parameters"), "low", "s")
    assert {r.title for r in low.collect()} == {"/etc/a", "/etc/b", "root"}
    assert anonymize(store["edges"], "none", "s").collect() == store["edges"].collect()
