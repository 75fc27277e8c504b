"""Registered queries over the bound benchmark tables, each with the same result in DuckDB's SQL."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine, collect_resources, facts_search, flat
from .functions.tochar import number_text
from .operators import retention, stats
from .operators.anonymize import anonymize
from .operators.hashing import canonical_hash
from .sources.archive import read_folder, time_shift, write_folder
from .sources.binding import NOW, bind
from .sources.snapshots import changed
from .sources.store import Store
from .streaming.ingest import Options, apply_commands, containing_class, latest_wins

BASE = """
WITH place AS (SELECT c.*, n_name, r_name FROM customer c JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
cn AS (
  SELECT c_name AS certname, c_custkey, CASE WHEN c_custkey % 20 = 0 THEN TIMESTAMP '2001-07-25' END AS deactivated, CASE WHEN c_custkey % 20 = 1 THEN TIMESTAMP '2001-06-01' END AS expired,
    CASE WHEN c_custkey % 9 = 0 THEN false END AS facts_expire, CASE WHEN c_custkey % 9 = 0 THEN TIMESTAMP '2001-01-01' END AS facts_expire_updated FROM customer),
act AS (SELECT certname FROM cn WHERE deactivated IS NULL AND expired IS NULL),
inact AS (SELECT certname FROM cn WHERE deactivated > TIMESTAMP '2001-07-18' OR expired > TIMESTAMP '2001-07-18'),
fs AS (
  SELECT c_name AS certname, n_name AS environment, TIMESTAMP '2001-07-01' + to_days((c_custkey % 30)::INTEGER) AS ts, 'producer-' || (c_custkey % 5) AS producer, md5(c_name) AS hash,
    c_mktsegment AS mktsegment, c_acctbal AS acctbal, CASE WHEN c_acctbal = floor(c_acctbal) THEN c_acctbal::BIGINT::VARCHAR ELSE c_acctbal::VARCHAR END AS bal, c_custkey * 10 AS uptime, c_custkey % 2 = 0 AS is_virtual, n_name AS nation, r_name AS region FROM place),
fac AS (
  SELECT certname, environment, 'mktsegment' AS name, '"' || mktsegment || '"' AS value FROM fs UNION ALL SELECT certname, environment, 'uptime_seconds', uptime::VARCHAR FROM fs
  UNION ALL SELECT certname, environment, 'is_virtual', is_virtual::VARCHAR FROM fs UNION ALL SELECT certname, environment, 'labels', '["' || mktsegment || '","' || region || '"]' FROM fs
  UNION ALL SELECT certname, environment, 'acctbal', bal FROM fs UNION ALL SELECT certname, environment, 'nation', '{"name":"' || nation || '","region":"' || region || '"}' FROM fs
  UNION ALL SELECT certname, environment, 'trusted', '{"certname":"' || certname || '","extensions":{"region":"' || region || '"}}' FROM fs),
leaf AS (
  SELECT certname, environment, 'mktsegment' AS name, 'mktsegment' AS path, '"' || mktsegment || '"' AS value FROM fs UNION ALL SELECT certname, environment, 'uptime_seconds', 'uptime_seconds', uptime::VARCHAR FROM fs
  UNION ALL SELECT certname, environment, 'is_virtual', 'is_virtual', is_virtual::VARCHAR FROM fs UNION ALL SELECT certname, environment, 'nation', 'nation,name', '"' || nation || '"' FROM fs
  UNION ALL SELECT certname, environment, 'nation', 'nation,region', '"' || region || '"' FROM fs UNION ALL SELECT certname, environment, 'labels', 'labels,0', '"' || mktsegment || '"' FROM fs
  UNION ALL SELECT certname, environment, 'labels', 'labels,1', '"' || region || '"' FROM fs UNION ALL SELECT certname, environment, 'trusted', 'trusted,certname', '"' || certname || '"' FROM fs
  UNION ALL SELECT certname, environment, 'trusted', 'trusted,extensions,region', '"' || region || '"' FROM fs UNION ALL SELECT certname, environment, 'acctbal', 'acctbal', bal FROM fs),
rep AS (
  SELECT o_orderkey AS id, md5(o_orderkey::VARCHAR) AS hash, c_name AS certname, n_name AS environment, 'v' || (o_orderkey % 7) AS configuration_version, o_orderdate AS producer_timestamp,
    o_orderdate - INTERVAL 300 SECOND AS start_time, o_orderdate + INTERVAL 60 SECOND AS receive_time, 'producer-' || (o_orderkey % 5) AS producer,
    CASE WHEN o_orderkey % 3 = 0 THEN 'job-' || (o_orderkey % 100) END AS job_id, CASE WHEN o_orderkey % 2 = 0 THEN 'not_used' ELSE 'on_failure' END AS cached_catalog_status,
    CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'changed' ELSE 'unchanged' END AS status, CASE WHEN o_orderkey % 10 <> 0 THEN 'agent' ELSE 'plan' END AS type,
    o_orderpriority = '5-LOW' AS noop, o_orderkey % 4 = 0 AS noop_pending, o_orderstatus = 'F' AS corrective_change,
    o_orderkey % 10 <> 0 AND row_number() OVER (PARTITION BY o_custkey, o_orderkey % 10 <> 0 ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS latest
  FROM orders JOIN place ON o_custkey = c_custkey),
lines AS (SELECT *, upper(p_type[1]) || lower(p_type[2:]) AS kind, p_name || '#' || p_partkey AS title FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey),
ev AS (
  SELECT c_name AS certname, l_orderkey AS report_id, CASE l_returnflag WHEN 'R' THEN 'failure' WHEN 'A' THEN 'noop' ELSE CASE WHEN l_linenumber % 3 = 0 THEN 'skipped' ELSE 'success' END END AS status,
    l_shipdate AS ts, kind AS resource_type, title AS resource_title, CASE WHEN NOT (l_returnflag = 'N' AND l_linenumber % 3 = 0) THEN p_brand END AS property, l_quantity::BIGINT::VARCHAR AS new_value,
    'changed ' || p_name AS message, '/etc/' || p_brand AS file, l_linenumber AS line, p_brand AS containing_class, l_linestatus = 'F' AS corrective_change,
    CASE WHEN l_linenumber % 2 = 0 THEN 'restart' END AS name, 'Stage[main],' || p_brand || ',' || kind || '[' || title || ']' AS containment_path
  FROM lines),
evr AS (SELECT ev.*, rep.hash AS report, rep.environment, rep.latest, rep.configuration_version, rep.producer_timestamp AS run_end_time FROM ev JOIN rep ON report_id = rep.id),
res AS (
  SELECT DISTINCT c_name AS certname, md5(kind || title) AS resource, kind AS type, title, lower(p_type) AS tag1, lower(p_brand) AS tag2, p_size % 2 = 0 AS exported, '/etc/' || p_brand AS file, p_size AS line,
    p_brand AS brand, p_retailprice AS price, p_type AS option FROM lines),
edg AS (
  SELECT DISTINCT certname, source_type, source_title, target_type, target_title FROM (
    SELECT certname, kind AS source_type, title AS source_title, lead(kind) OVER w AS target_type, lead(title) OVER w AS target_title
    FROM (SELECT DISTINCT o_orderkey, c_name AS certname, p_partkey, kind, title FROM lines) WINDOW w AS (PARTITION BY o_orderkey ORDER BY p_partkey)) WHERE target_type IS NOT NULL),
pkg AS (SELECT DISTINCT p_name AS package_name, p_brand AS version, p_type AS provider FROM part),
cpkg AS (SELECT DISTINCT c_name AS certname, p_name AS package_name, p_brand AS version, p_type AS provider FROM lines),
inp AS (SELECT DISTINCT c_name AS certname, event_type AS type, props AS name FROM events JOIN customer ON user_id = c_custkey),
inpm AS (SELECT c_name AS certname, max(ts) AS ts, md5(c_name) AS catalog_uuid FROM events JOIN customer ON user_id = c_custkey GROUP BY c_name)
"""
TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"


@dataclass(frozen=True)
class Registered:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Registered] = {}


def _plain(df: DataFrame) -> DataFrame:
    df = flat(df)
    return df.toDF(*[c.replace(".", "_").replace("?", "").replace('"', "").replace("[", "_").replace("]", "") for c in df.columns])


def ask(name: str, query: str | list, sql: str, surface: str = "none", **params) -> None:
    """Registers a query of either language."""
    REGISTRY[name] = Registered(lambda spark, sf_dir: _plain(Engine(bind(spark, sf_dir), NOW, surface=surface).query(query, **params)), f"{BASE}{sql}")


def do(name: str, run: Callable, sql: str | None) -> None:
    """Registers a function of the bound store."""
    REGISTRY[name] = Registered(lambda spark, sf_dir: _plain(run(bind(spark, sf_dir))), f"{BASE}{sql}" if sql else None)


# scans and projections
ask("scan_environments", "environments {}", "SELECT n_name AS name FROM nation")
ask("scan_producers", ["from", "producers"], "SELECT 'producer-' || i AS name FROM generate_series(0, 4) t(i)")
ask("nodes_default", "nodes {}", f"""
SELECT cn.certname, {TS.format('deactivated')} AS deactivated, {TS.format('expired')} AS expired, fs.environment AS facts_environment, {TS.format("TIMESTAMP '2001-07-01' + to_days((c_custkey % 28)::INTEGER)")} AS catalog_timestamp,
  {TS.format('fs.ts')} AS facts_timestamp, {TS.format('rep.producer_timestamp')} AS report_timestamp, rep.hash AS latest_report_hash, noop AS latest_report_noop, noop_pending AS latest_report_noop_pending, status AS latest_report_status,
  corrective_change AS latest_report_corrective_change, job_id AS latest_report_job_id, cached_catalog_status, fs.environment AS catalog_environment, rep.environment AS report_environment
FROM cn JOIN fs USING (certname) LEFT JOIN rep ON rep.certname = cn.certname AND rep.latest WHERE cn.certname IN (FROM act)""", surface="root")
ask("nodes_fact_expiration", "nodes[certname, expires_facts, expires_facts_updated] {}", f"SELECT certname, coalesce(facts_expire, true) AS expires_facts, {TS.format('facts_expire_updated')} AS expires_facts_updated FROM cn", include_facts_expiration=True)
ask("extract_fields", "reports[certname, status, producer_timestamp] { type = 'any' }", f"SELECT certname, status, {TS.format('producer_timestamp')} AS producer_timestamp FROM rep")
ask("extract_single_field", ["from", "reports", ["extract", "hash", ["=", "status", "failed"]]], "SELECT hash FROM rep WHERE status = 'failed' AND type = 'agent'")
ask("endpoint_surface", "package_inventory[certname, package_name] { provider = 'SMALL' }", "SELECT certname, package_name FROM cpkg WHERE provider = 'SMALL' AND certname IN (FROM act)", surface="endpoint")

# predicates
ask("eq_string", "reports[hash] { status = 'changed' }", "SELECT hash FROM rep WHERE status = 'changed' AND type = 'agent'")
ask("eq_numeric", "resources[certname, title] { line = 7 }", "SELECT certname, title FROM res WHERE line = 7")
ask("eq_boolean", "reports[hash] { noop = true }", "SELECT hash FROM rep WHERE noop AND type = 'agent'")
ask("eq_timestamp", "factsets[certname] { producer_timestamp = '2001-07-04T00:00:00' }", "SELECT certname FROM fs WHERE ts = TIMESTAMP '2001-07-04'")
ask("ineq_numeric", "events[report, line] { line >= 6 }", "SELECT report, line FROM evr WHERE line >= 6")
ask("ineq_timestamp", "reports[hash] { producer_timestamp < '1996-01-01' and receive_time > '1995-06-01T00:00:00' }", "SELECT hash FROM rep WHERE type = 'agent' AND producer_timestamp < TIMESTAMP '1996-01-01' AND receive_time > TIMESTAMP '1995-06-01'")
ask("regex_string", "nodes[certname] { certname ~ '[[:digit:]]*7$' }", "SELECT certname FROM cn WHERE regexp_matches(certname, '[0-9]*7$')")
ask("not_regex_nulls", "reports[hash, job_id] { job_id !~ '^job-1' }", "SELECT hash, job_id FROM rep WHERE type = 'agent' AND NOT coalesce(regexp_matches(job_id, '^job-1'), false)")
ask("not_eq_nulls", "reports[hash, job_id] { job_id != 'job-12' }", "SELECT hash, job_id FROM rep WHERE type = 'agent' AND NOT (job_id = 'job-12')")
ask("array_contains_tag", "resources[certname, title] { tag = 'Brand#12' }", "SELECT certname, title FROM res WHERE tag1 = 'brand#12' OR tag2 = 'brand#12'")
ask("array_regex", "resources[certname, title] { tags ~ '^eco' }", "SELECT certname, title FROM res WHERE tag1 LIKE 'eco%' OR tag2 LIKE 'eco%'")
ask("in_array", "reports[hash] { status in ['failed', 'unchanged'] }", "SELECT hash FROM rep WHERE type = 'agent' AND status IN ('failed', 'unchanged')")
ask("null_check", "events[report, resource_title] { property is null }", "SELECT report, resource_title FROM evr WHERE property IS NULL")
ask("not_null_check", "reports[hash] { job_id is not null }", "SELECT hash FROM rep WHERE type = 'agent' AND job_id IS NOT NULL")
ask("eq_null", ["from", "reports", ["extract", ["hash"], ["=", "job_id", None]]], "SELECT hash FROM rep WHERE type = 'agent' AND job_id IS NULL")
ask("bool_nested", "reports[hash] { status = 'failed' or noop = true and !(producer = 'producer-1' or environment ~ '1') }", "SELECT hash FROM rep WHERE type = 'agent' AND (status = 'failed' OR noop AND NOT (producer = 'producer-1' OR environment LIKE '%1%'))")
ask("node_state_active", "nodes[certname] { node_state = 'active' }", "SELECT certname FROM act")
ask("node_state_inactive", "nodes[certname] { node_state = 'inactive' }", "SELECT certname FROM inact")
ask("node_state_any", "nodes[certname] { node_state = 'any' }", "SELECT certname FROM cn", surface="root")
ask("node_active_legacy", ["from", "nodes", ["extract", ["certname"], ["or", ["=", ["node", "active"], False], ["=", "expired", "2001-06-01"]]]], "SELECT certname FROM cn WHERE certname IN (FROM inact) OR expired = TIMESTAMP '2001-06-01'")
ask("fact_eq", ["from", "nodes", ["extract", ["certname"], ["=", ["fact", "mktsegment"], "BUILDING"]]], "SELECT certname FROM fs WHERE mktsegment = 'BUILDING'")
ask("fact_ineq", ["from", "nodes", ["extract", ["certname"], [">", ["fact", "uptime_seconds"], 900]]], "SELECT certname FROM fs WHERE uptime > 900")
ask("fact_in_array", ["from", "nodes", ["extract", ["certname"], ["in", ["fact", "uptime_seconds"], ["array", [10, 20, 30]]]]], "SELECT certname FROM fs WHERE uptime IN (10, 20, 30)")
ask("parameter_eq", ["from", "resources", ["extract", ["certname", "title"], ["=", ["parameter", "brand"], "Brand#13"]]], "SELECT certname, title FROM res WHERE brand = 'Brand#13'")
ask("parameter_regex", ["from", "resources", ["extract", ["certname", "title"], ["~", ["parameter", "brand"], "#2[12]"]]], "SELECT certname, title FROM res WHERE regexp_matches(brand, '#2[12]')")
ask("latest_report_true", "reports[certname, hash] { latest_report? = true }", "SELECT certname, hash FROM rep WHERE latest")
ask("latest_report_false", "events[certname, resource_title, line] { latest_report? = false and line = 5 }", "SELECT certname, resource_title, line FROM evr WHERE NOT latest AND line = 5")
ask("agent_filter_default", "reports[count()] {}", "SELECT count(*) AS count FROM rep WHERE type = 'agent'")
ask("agent_filter_any", "reports[type, count()] { type = 'any' group by type }", "SELECT type, count(*) AS count FROM rep GROUP BY type")

# subqueries
ask("in_subquery_select", ["from", "nodes", ["extract", ["certname"], ["in", "certname", ["extract", "certname", ["select_reports", ["=", "status", "failed"]]]]]], "SELECT certname FROM cn WHERE certname IN (SELECT certname FROM rep WHERE status = 'failed' AND type = 'agent')")
ask("in_subquery_from_paged", "nodes[certname, deactivated] { certname in reports[certname] { order by producer_timestamp desc, hash limit 25 } }", f"SELECT certname, {TS.format('deactivated')} AS deactivated FROM cn WHERE certname IN (SELECT certname FROM rep WHERE type = 'agent' ORDER BY producer_timestamp DESC, hash LIMIT 25)")
ask("in_subquery_multi_column", "events[report, resource_title] { [certname, resource_title] in resources[certname, title] { line = 9 } }", "SELECT report, resource_title FROM evr WHERE (certname, resource_title) IN (SELECT certname, title FROM res WHERE line = 9)")
ask("in_subquery_json", "facts[certname, name] { [certname, value] in fact_contents[certname, value] { path = ['nation', 'region'] } or name = 'is_virtual' and value = true }", "SELECT certname, name FROM fac WHERE name = 'is_virtual' AND value = 'true'")
ask("not_in_subquery", "nodes[certname] { !(certname in reports[certname] { status = 'failed' }) }", "SELECT certname FROM cn WHERE certname NOT IN (SELECT certname FROM rep WHERE status = 'failed' AND type = 'agent')")
ask("not_in_subquery_null", "reports[hash] { !(job_id in reports[job_id] { status = 'failed' }) }", "SELECT hash FROM rep WHERE type = 'agent' AND job_id NOT IN (SELECT job_id FROM rep WHERE status = 'failed' AND type = 'agent')")
ask("not_in_multi_column_null", "reports[hash] { !([certname, job_id] in reports[certname, job_id] { status = 'failed' }) }", """
SELECT hash FROM rep r WHERE type = 'agent' AND NOT EXISTS (SELECT 1 FROM rep s WHERE s.type = 'agent' AND s.status = 'failed' AND s.certname = r.certname AND (s.job_id = r.job_id OR s.job_id IS NULL OR r.job_id IS NULL))""")
ask("not_in_multi_column", "events[report, line] { !([certname, resource_title] in resources[certname, title] { line > 9 }) }", "SELECT report, line FROM evr WHERE NOT EXISTS (SELECT 1 FROM res WHERE res.line > 9 AND res.certname = evr.certname AND title = resource_title)")
ask("in_repeated_columns", ["from", "edges", ["extract", ["certname", "source_title"], ["in", ["certname", "certname"], ["extract", ["certname", "certname"], ["select_reports", ["=", "status", "unchanged"]]]]]], "SELECT certname, source_title FROM edg WHERE certname IN (SELECT certname FROM rep WHERE status = 'unchanged' AND type = 'agent')")
ask("in_reordered_columns", ["from", "events", ["extract", ["report", "line"], ["in", ["resource_title", "certname"], ["extract", ["title", "certname"], ["select_resources", ["=", "line", 9]]]]]], "SELECT report, line FROM evr WHERE (certname, resource_title) IN (SELECT certname, title FROM res WHERE line = 9)")
ask("implicit_subquery", "nodes[certname] { reports { status = 'unchanged' and noop = true } }", "SELECT certname FROM cn WHERE certname IN (SELECT certname FROM rep WHERE status = 'unchanged' AND noop AND type = 'agent')")
ask("implicit_subquery_environment", "environments[name] { reports { status = 'failed' } }", "SELECT n_name AS name FROM nation WHERE n_name IN (SELECT environment FROM rep WHERE status = 'failed' AND type = 'agent')")
ask("implicit_subquery_report", "reports[hash] { events { status = 'failure' and line = 7 } }", "SELECT hash FROM rep WHERE type = 'agent' AND hash IN (SELECT report FROM evr WHERE status = 'failure' AND line = 7)")
ask("nested_subquery", "inventory[certname] { certname in nodes[certname] { resources { exported = true and line in [2, 4] } and node_state = 'active' } }", "SELECT certname FROM fs WHERE certname IN (FROM act) AND certname IN (SELECT certname FROM res WHERE exported AND line IN (2, 4))")
ask("or_subquery", "nodes[certname] { certname ~ '3$' or reports { status = 'failed' and noop_pending = true } or package_inventory { provider = 'PROMO' } }", "SELECT certname FROM cn WHERE certname LIKE '%3' OR certname IN (SELECT certname FROM rep WHERE status = 'failed' AND noop_pending AND type = 'agent') OR certname IN (SELECT certname FROM cpkg WHERE provider = 'PROMO')")

# facts, paths and documents
ask("facts_all", "facts[certname, name, value] {}", "SELECT certname, name, value FROM fac")
ask("facts_by_name", "facts { name = 'uptime_seconds' }", "SELECT certname, environment, name, value FROM fac WHERE name = 'uptime_seconds'")
ask("facts_value_eq", "facts[certname, name] { value = 'BUILDING' }", "SELECT certname, name FROM fac WHERE value = '\"BUILDING\"'")
ask("facts_value_ineq", "facts[certname] { name = 'uptime_seconds' and value <= 500 }", "SELECT certname FROM fs WHERE uptime <= 500")
ask("facts_value_regex", "facts[certname, name] { name in ['mktsegment', 'uptime_seconds'] and value ~ '^(M|12)' }", "SELECT certname, name FROM fac WHERE name = 'mktsegment' AND value LIKE '\"M%' OR name = 'uptime_seconds' AND value LIKE '12%'")
ask("facts_value_array", "facts[certname] { value = ['BUILDING', 'ASIA'] }", "SELECT certname FROM fs WHERE mktsegment = 'BUILDING' AND region = 'ASIA'")
ask("fact_contents_flatten", "fact_contents[certname, environment, path, name, value] {}", "SELECT certname, environment, path, name, value FROM leaf")
ask("path_eq", ["from", "fact_contents", ["extract", ["certname", "value"], ["=", "path", ["labels", 1]]]], "SELECT certname, value FROM leaf WHERE path = 'labels,1'")
ask("path_eq_key_not_place", ["from", "fact_contents", ["extract", ["certname", "value"], ["=", "path", ["labels", "1"]]]], "SELECT certname, value FROM leaf WHERE false")
ask("path_regex", "fact_contents[certname, path, value] { path ~> ['na.*', '^reg'] }", "SELECT certname, path, value FROM leaf WHERE path = 'nation,region'")
ask("path_in_array", ["from", "fact_contents", ["extract", ["certname", "path"], ["in", "path", ["array", [["nation", "name"], ["labels", 0]]]]]], "SELECT certname, path FROM leaf WHERE path IN ('nation,name', 'labels,0')")
ask("fact_paths", "fact_paths {}", """SELECT DISTINCT replace(path, ',', '#~') AS path, name, CASE WHEN name = 'acctbal' THEN 'float' WHEN name = 'uptime_seconds' THEN 'integer' WHEN name = 'is_virtual' THEN 'boolean' ELSE 'string' END AS type FROM leaf""")
ask("fact_paths_regex", "fact_paths[path] { path ~> ['.*', 'region'] }", "SELECT 'nation#~region' AS path")
ask("fact_names", ["from", "fact_names", ["order_by", ["name"]]], "SELECT unnest(['acctbal', 'is_virtual', 'labels', 'mktsegment', 'nation', 'trusted', 'uptime_seconds']) AS name")
ask("inventory_dotted_eq", "inventory[certname] { facts.nation.region = 'ASIA' }", "SELECT certname FROM fs WHERE region = 'ASIA'")
ask("inventory_dotted_ineq", "inventory[certname] { facts.uptime_seconds > 700 and facts.acctbal < 0.5 }", "SELECT certname FROM fs WHERE uptime > 700 AND acctbal < 0.5")
ask("inventory_dotted_regex", "inventory[certname] { facts.nation.name ~ '_1' }", "SELECT certname FROM fs WHERE nation LIKE '%\\_1%' ESCAPE '\\'")
ask("inventory_dotted_index", "inventory[certname] { facts.labels[1] = 'EUROPE' }", "SELECT certname FROM fs WHERE region = 'EUROPE'")
ask("inventory_dotted_null", "inventory[certname] { facts.nation.name is not null and facts.is_virtual = true }", "SELECT certname FROM fs WHERE is_virtual")
ask("inventory_dotted_absent", "inventory[certname] { facts.nation.nothing is null or facts.nothing is not null }", "SELECT certname FROM fs WHERE false")
ask("inventory_not_dotted", "inventory[certname] { facts.nation.nothing != 'x' and facts.mktsegment != 'BUILDING' }", "SELECT certname FROM fs WHERE mktsegment <> 'BUILDING'")
ask("inventory_extract_subtree", "inventory[certname, facts.nation, facts.uptime_seconds] {}", """SELECT certname, '{"name":"' || nation || '","region":"' || region || '"}' AS facts_nation, uptime::VARCHAR AS facts_uptime_seconds FROM fs""")
ask("contains_object", ["from", "inventory", ["extract", ["certname"], ["=", "facts.nation", {"region": "ASIA"}]]], "SELECT certname FROM fs WHERE region = 'ASIA'")
ask("contains_nested_object", ["from", "inventory", ["extract", ["certname"], ["=", "facts", {"is_virtual": True, "trusted": {"extensions": {"region": "EUROPE"}}}]]], "SELECT certname FROM fs WHERE is_virtual AND region = 'EUROPE'")
ask("contains_array", ["from", "inventory", ["extract", ["certname"], ["not", ["=", "facts.labels", ["BUILDING"]]]]], "SELECT certname FROM fs WHERE mktsegment <> 'BUILDING'")
ask("decimal_facts", "facts[certname, value] { name = 'acctbal' and value < 100.5 }", "SELECT certname, bal AS value FROM fs WHERE acctbal < 100.5")
ask("encoded_path_eq", ["from", "fact_paths", ["extract", ["path", "type"], ["or", ["=", "path", ["nation", "region"]], ["=", "path", ["labels", 1]], ["=", "path", ["labels", "1"]]]]], "SELECT unnest(['nation#~region', 'labels#~1']) AS path, 'string' AS type")
ask("trusted_eq", "inventory[certname, trusted.extensions.region] { trusted.extensions.region in ['ASIA', 'AFRICA'] }", "SELECT certname, '\"' || region || '\"' AS trusted_extensions_region FROM fs WHERE region IN ('ASIA', 'AFRICA')")
ask("match_path", 'inventory[certname] { facts.match("^na.*").match("reg|nam") ~ "^(ASIA|NATION_3)$" }', "SELECT certname FROM fs WHERE region = 'ASIA' OR nation = 'NATION_3'")

# aggregation
ask("count_star", "events[count()] {}", "SELECT count(*) AS count FROM ev")
ask("count_col", "events[count(property)] {}", "SELECT count(property) AS count FROM ev")
ask("sum_avg_min_max", "events[sum(line), avg(line), min(line), max(line)] { status = 'failure' }", "SELECT sum(line)::BIGINT AS sum, avg(line) AS avg, min(line) AS min, max(line) AS max FROM ev WHERE status = 'failure'")
ask("avg_fact_value", "facts[avg(value), max(value), min(value), sum(value)] { name = 'uptime_seconds' }", "SELECT avg(uptime)::DOUBLE AS avg, max(uptime)::DOUBLE AS max, min(uptime)::DOUBLE AS min, sum(uptime)::DOUBLE AS sum FROM fs")
ask("group_by", "events[status, certname, count()] { line > 3 group by status, certname }", "SELECT status, certname, count(*) AS count FROM ev WHERE line > 3 GROUP BY ALL")
ask("group_by_value", "facts[name, value, count()] { name in ['mktsegment', 'is_virtual', 'labels'] group by name, value }", "SELECT name, value, count(*) AS count FROM fac WHERE name IN ('mktsegment', 'is_virtual', 'labels') GROUP BY ALL")
ask("group_by_dotted", "inventory[facts.nation.region, count()] { group by facts.nation.region }", "SELECT '\"' || region || '\"' AS facts_nation_region, count(*) AS count FROM fs GROUP BY ALL")
ask("group_by_to_string", "reports[to_string(producer_timestamp, 'YYYY-MM FMDAY month'), count()] { group by to_string(producer_timestamp, 'YYYY-MM FMDAY month') }", "SELECT strftime(producer_timestamp, '%Y-%m ') || upper(dayname(producer_timestamp)) || ' ' || rpad(lower(monthname(producer_timestamp)), 9, ' ') AS to_string, count(*) AS count FROM rep WHERE type = 'agent' GROUP BY ALL")
ask("to_string_number", "resources[title, to_string(line, 'FM9999')] { line = 9 }", "SELECT title, line::VARCHAR AS to_string FROM res WHERE line = 9")
ask("jsonb_typeof_filter", ["from", "facts", ["extract", ["certname", "name"], ["and", ["=", ["function", "jsonb_typeof", "value"], "string"], ["~", "name", "m"]]]], "SELECT certname, name FROM fac WHERE name = 'mktsegment'")
ask("jsonb_typeof_group", ["from", "facts", ["extract", [["function", "jsonb_typeof", "value"], ["function", "count"]], ["group_by", ["function", "jsonb_typeof", "value"]]]], "SELECT t AS jsonb_typeof, k * (SELECT count(*) FROM fs) AS count FROM (VALUES ('string', 1), ('number', 2), ('boolean', 1), ('object', 2), ('array', 1)) x(t, k)")
ask("count_null_group", "reports[job_id, count(), min(hash)] { group by job_id }", "SELECT job_id, count(*) AS count, min(hash) AS min FROM rep WHERE type = 'agent' GROUP BY job_id")

# paging
ask("order_limit_offset", "reports[certname, producer_timestamp, hash] { order by producer_timestamp desc, hash limit 20 offset 5 }", f"SELECT certname, {TS.format('producer_timestamp')} AS producer_timestamp, hash FROM (SELECT * FROM rep WHERE type = 'agent' ORDER BY rep.producer_timestamp DESC, hash LIMIT 20 OFFSET 5)")
ask("order_nulls", "reports[job_id, hash] { order by job_id desc, hash limit 40 }", "SELECT job_id, hash FROM rep WHERE type = 'agent' ORDER BY job_id DESC NULLS FIRST, hash LIMIT 40")
ask("order_nulls_asc", "reports[job_id, hash] { status = 'unchanged' order by job_id, hash limit 40 }", "SELECT job_id, hash FROM rep WHERE type = 'agent' AND status = 'unchanged' ORDER BY job_id ASC NULLS LAST, hash LIMIT 40")
ask("order_grouped", ["from", "events", ["extract", ["certname", ["function", "count"]], ["group_by", "certname"]], ["order_by", [["count", "desc"], "certname"]], ["limit", 30]], "SELECT certname, count(*) AS count FROM ev GROUP BY certname ORDER BY count DESC, certname LIMIT 30")
ask("url_paging", "nodes[certname] {}", "SELECT certname FROM cn ORDER BY certname DESC LIMIT 7 OFFSET 3", order_by=[["certname", "desc"]], limit=7, offset=3)

# relations between entities
ask("events_join", "events[certname, report, status, timestamp, resource_type, resource_title, property, new_value, message, file, line, containing_class, containment_path, environment, corrective_change, name, configuration_version, run_end_time] { line <= 2 }", f"""
SELECT certname, report, status, {TS.format('ts')} AS timestamp, resource_type, resource_title, property, new_value, message, file, line, containing_class, containment_path, environment, corrective_change, name, configuration_version, {TS.format('run_end_time')} AS run_end_time FROM evr WHERE line <= 2""")
ask("events_new_value", ["from", "events", ["extract", ["report", "line"], ["=", "new_value", 17]]], "SELECT report, line FROM evr WHERE new_value = '17'")
ask("resources_join", "resources[certname, environment, resource, type, title, tags, exported, file, line] { exported = true }", "SELECT certname, n_name AS environment, resource, type, title, tag1 || ',' || tag2 AS tags, 'true' AS exported, file, line FROM res JOIN place ON c_name = certname WHERE exported")
ask("resources_param_dotted", "resources[certname, title, parameters.options.kind] { parameters.size > 45 and parameters.brand ~ '#1' }", "SELECT certname, title, '\"' || option || '\"' AS parameters_options_kind FROM res WHERE line > 45 AND brand LIKE '%#1%'")
ask("edges_join", "edges[certname, source_type, source_title, target_type, target_title, relationship] { source_type = 'Small' }", "SELECT *, 'contains' AS relationship FROM edg WHERE source_type = 'Small'")
ask("catalogs", "catalogs[certname, version, hash, environment, producer, producer_timestamp] {}", f"SELECT c_name AS certname, c_custkey::VARCHAR AS version, md5(c_name) AS hash, n_name AS environment, 'producer-' || (c_custkey % 5) AS producer, {TS.format("TIMESTAMP '2001-07-01' + to_days((c_custkey % 28)::INTEGER)")} AS producer_timestamp FROM place")
ask("catalog_edges_nested", "catalogs[certname, edges] {}", """
SELECT c_name AS certname, '[' || string_agg('{"relationship":"contains","source_type":"' || source_type || '","source_title":"' || source_title || '","target_type":"' || target_type || '","target_title":"' || target_title || '"}', ',' ORDER BY source_type, source_title, target_type, target_title) || ']' AS edges
FROM customer LEFT JOIN edg ON c_name = certname GROUP BY c_name""")
ask("catalog_resources_nested", "catalogs[certname, resources] {}", """
SELECT c_name AS certname, '[' || string_agg('{"resource":"' || resource || '","type":"' || type || '","title":"' || title || '","tags":["' || tag1 || '","' || tag2 || '"],"exported":' || exported::VARCHAR || ',"file":"' || file || '","line":' || line::VARCHAR
  || ',"parameters":{"brand":"' || brand || '","options":{"kind":"' || option || '"},"price":' || CASE WHEN price = floor(price) THEN price::BIGINT::VARCHAR ELSE price::VARCHAR END || ',"size":' || line::VARCHAR || '}}', ',' ORDER BY type, title) || ']' AS resources
FROM customer LEFT JOIN res ON c_name = certname GROUP BY c_name""")
ask("catalog_input_contents", ["from", "catalog_input_contents", ["extract", ["certname", "type", "name", "catalog_uuid"], ["=", "type", "click"]]], "SELECT inp.certname, type, name, catalog_uuid FROM inp JOIN inpm USING (certname) WHERE type = 'click'")
ask("catalog_inputs_agg", ["from", "catalog_inputs"], f"""
SELECT certname, {TS.format('ts')} AS producer_timestamp, catalog_uuid, '[' || string_agg('["' || type || '",' || to_json(name)::VARCHAR || ']', ',' ORDER BY type, name) || ']' AS inputs FROM inpm JOIN inp USING (certname) GROUP BY ALL""")
ask("packages", "packages { provider = 'PROMO' }", "SELECT * FROM pkg WHERE provider = 'PROMO'")
ask("package_inventory", "package_inventory { package_name ~ '^hot' }", "SELECT * FROM cpkg WHERE package_name LIKE 'hot%'")
ask("factsets_nested", "factsets[certname, hash, environment, producer, producer_timestamp, package_inventory] {}", f"""
SELECT certname, hash, environment, producer, {TS.format('ts')} AS producer_timestamp, '[' || string_agg('["' || package_name || '","' || version || '","' || provider || '"]', ',' ORDER BY package_name, version, provider) || ']' AS package_inventory
FROM fs LEFT JOIN cpkg USING (certname) GROUP BY ALL""", include_package_inventory=True)
ask("factsets_facts", "factsets[certname, facts] {}", """SELECT certname, '[' || string_agg('{"name":"' || name || '","value":' || value || '}', ',' ORDER BY name) || ']' AS facts FROM fac GROUP BY certname""")
EVENT_JSON = """'{"status":"' || ev.status || '","timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z') || '","resource_type":"' || resource_type || '","resource_title":"' || resource_title || '"' || coalesce(',"property":"' || property || '"', '')
  || ',"new_value":' || new_value || ',"old_value":"absent","message":"' || message || '","file":"' || file || '","line":' || line::VARCHAR || ',"containment_path":["' || replace(containment_path, ',', '","') || '"],"containing_class":"' || containing_class
  || '","corrective_change":' || ev.corrective_change::VARCHAR || coalesce(',"name":"' || name || '"', '') || '}'"""
ask("report_events_nested", "reports[hash, resource_events] {}", f"""
SELECT hash, '[' || string_agg({EVENT_JSON}, ',' ORDER BY ev.status, ts, resource_type, resource_title, property NULLS FIRST, new_value, message, file, line, containment_path, containing_class, ev.corrective_change, name NULLS FIRST) || ']' AS resource_events
FROM rep LEFT JOIN ev ON report_id = rep.id WHERE type = 'agent' GROUP BY hash""")
ask("report_metrics", ["from", "report_metrics", ["extract", ["metrics"]]], """SELECT '[{"category":"time","name":"total","value":' || o_totalprice::VARCHAR || '}]' AS metrics FROM orders JOIN customer ON o_custkey = c_custkey""")
ask("report_logs", ["from", "report_logs", ["extract", ["logs"], ["=", "type", "plan"]]], "SELECT '[{\"level\":\"notice\",\"message\":\"' || o_orderpriority || '\"}]' AS logs FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 10 = 0")
ask("latest_report_id", ["from", "latest_report_id"], "SELECT id AS latest_report_id FROM rep WHERE latest")
ask("latest_report_entity", ["from", "events", ["extract", ["report", "line"], ["in", "report", ["extract", "latest_report_hash", ["select_latest_report"]]]]], "SELECT report, line FROM evr WHERE latest")

# event summaries
DISTINCT = {"distinct_resources": True, "distinct_start_time": "1993-01-01", "distinct_end_time": "1997-12-31"}
NEWEST = "SELECT * FROM (SELECT *, rank() OVER (PARTITION BY certname, resource_type, resource_title, property, name ORDER BY ts DESC) AS r FROM {} WHERE ts BETWEEN TIMESTAMP '1993-01-01' AND TIMESTAMP '1997-12-31'{}) WHERE r = 1"
COUNTS = "count(*) FILTER (status = 'failure') AS failures, count(*) FILTER (status = 'skipped') AS skips, count(*) FILTER (status = 'success') AS successes, count(*) FILTER (status = 'noop') AS noops"
ask("events_distinct_resources", "events[certname, resource_title, property, status, timestamp, line] { status != 'noop' }", f"SELECT certname, resource_title, property, status, {TS.format('ts')} AS timestamp, line FROM ({NEWEST.format('ev', '')}) WHERE status <> 'noop'", **DISTINCT)
ask("events_distinct_not_null", "events[certname, resource_title, status] { property != 'Brand#12' }", f"SELECT certname, resource_title, status FROM ({NEWEST.format('ev', '')}) WHERE property IS DISTINCT FROM 'Brand#12'", **DISTINCT)
ask("events_distinct_latest", "events[certname, resource_title, status] { latest_report? = true }", f"SELECT certname, resource_title, status FROM ({NEWEST.format('evr', ' AND latest')})", **DISTINCT)
ask("events_distinct_in", ["from", "events", ["extract", ["certname", "resource_title", "line"], ["and", ["in", "certname", ["extract", "certname", ["select_facts", ["and", ["=", "name", "is_virtual"], ["=", "value", True]]]]], ["=", "status", "failure"]]]], f"SELECT certname, resource_title, line FROM ({NEWEST.format('ev', '')}) WHERE status = 'failure' AND certname IN (SELECT certname FROM fs WHERE is_virtual)", **DISTINCT)


def _summary(name: str, query: list, sql: str, **params) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = Engine(bind(spark, sf_dir), NOW, surface="none").query(query, **params)
        if "subject" in df.columns:
            df = df.select("subject_type", *[F.col(f"subject.{f.name}").alias("subject_kind" if f.name == "type" else f"subject_{f.name}") for f in df.schema["subject"].dataType], *df.columns[2:])
        return _plain(df)

    REGISTRY[name] = Registered(run, f"{BASE}{sql}")


_summary("event_counts_certname", ["from", "event_counts"], f"SELECT 'certname' AS subject_type, certname AS subject_title, {COUNTS} FROM ev GROUP BY certname", summarize_by="certname")
_summary("event_counts_class", ["from", "event_counts", ["=", "corrective_change", True]], f"SELECT 'containing_class' AS subject_type, containing_class AS subject_title, {COUNTS} FROM ev WHERE corrective_change GROUP BY containing_class", summarize_by="containing_class")
_summary("event_counts_resource", ["from", "event_counts", [">", "line", 4]], f"SELECT 'resource' AS subject_type, resource_title AS subject_title, resource_type AS subject_kind, {COUNTS} FROM ev WHERE line > 4 GROUP BY resource_type, resource_title", summarize_by="resource")
_summary("event_counts_count_by_certname", ["from", "event_counts"], f"SELECT 'containing_class' AS subject_type, containing_class AS subject_title, {COUNTS} FROM (SELECT DISTINCT certname, status, corrective_change, containing_class FROM ev) GROUP BY containing_class", summarize_by="containing_class", count_by="certname")
_summary("event_counts_filter", ["from", "event_counts"], f"SELECT * FROM (SELECT 'certname' AS subject_type, certname AS subject_title, {COUNTS} FROM ev GROUP BY certname) WHERE failures > 8 AND NOT skips = 0", summarize_by="certname", counts_filter=["and", [">", "failures", 8], ["not", ["=", "skips", 0]]])
_summary("event_counts_corrective", ["from", "event_counts"], """SELECT 'certname' AS subject_type, certname AS subject_title, count(*) FILTER (status = 'failure') AS failures, count(*) FILTER (status = 'skipped') AS skips,
  count(*) FILTER (status = 'success' AND NOT corrective_change) AS intentional_successes, count(*) FILTER (status = 'success' AND corrective_change) AS corrective_successes,
  count(*) FILTER (status = 'noop' AND NOT corrective_change) AS intentional_noops, count(*) FILTER (status = 'noop' AND corrective_change) AS corrective_noops FROM ev GROUP BY certname""", summarize_by="certname", corrective=True)
_summary("event_counts_distinct", ["from", "event_counts", ["=", "latest_report?", True]], f"SELECT 'containing_class' AS subject_type, containing_class AS subject_title, {COUNTS} FROM ({NEWEST.format('evr', ' AND latest')}) GROUP BY containing_class", summarize_by="containing_class", **DISTINCT)
_AGG = "count(*) FILTER (failures > 0) AS failures, count(*) FILTER (skips > 0) AS skips, count(*) FILTER (successes > 0) AS successes, count(*) FILTER (noops > 0) AS noops, count(*) AS total"
_summary("aggregate_event_counts_multi", ["from", "aggregate_event_counts", ["=", "line", 3]], " UNION ALL ".join(f"SELECT '{n}' AS summarize_by, {_AGG} FROM (SELECT {COUNTS} FROM ev WHERE line = 3 GROUP BY {k})" for n, k in (("certname", "certname"), ("containing_class", "containing_class"), ("resource", "resource_type, resource_title"))), summarize_by="certname,containing_class,resource")
_summary("aggregate_event_counts_empty", ["from", "aggregate_event_counts", ["=", "line", 99]], "SELECT 'certname' AS summarize_by, 0::BIGINT AS failures, 0::BIGINT AS skips, 0::BIGINT AS successes, 0::BIGINT AS noops, 0::BIGINT AS total", summarize_by="certname")

# client helpers
ask("facts_search", ["from", "nodes", ["extract", ["certname"], facts_search({"mktsegment.ne": "BUILDING", "uptime_seconds.ge": 600})[2]]], "SELECT certname FROM fs WHERE mktsegment <> 'BUILDING' AND uptime >= 600")
ask("collect_resources", ["from", "resources", ["extract", ["certname", "title"], collect_resources("Small", "Customer#000000003", ["or", ["==", "brand", "Brand#11"], ["!=", "tag", "brand#22"]])[2]]], "SELECT certname, title FROM res WHERE type = 'Small' AND exported AND certname <> 'Customer#000000003' AND (brand = 'Brand#11' OR NOT (tag1 = 'brand#22' OR tag2 = 'brand#22'))")

# upkeep, statistics, hashes
do("include_total", lambda s: s.spark.createDataFrame([(Engine(s, NOW, surface="none").total("reports[hash] { status = 'failed' limit 3 }"),)], "total bigint"), "SELECT count(*) AS total FROM rep WHERE status = 'failed' AND type = 'agent'")
do("ast_only", lambda s: s.spark.createDataFrame([(json.dumps(Engine(s, NOW).ast("nodes[certname] { certname = 'a' and !(facts_environment ~ 'b') limit 2 }")),)], "ast string"), """SELECT '["from", "nodes", ["extract", ["certname"], ["and", ["=", "certname", "a"], ["not", ["~", "facts_environment", "b"]]]], ["limit", 2]]' AS ast""")
do("stats_percentiles", lambda s: stats.distribution(s["reports"], "certname"), """
SELECT i / 20 AS point, list_extract((SELECT quantile_cont(n, [0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1]) FROM (SELECT count(*)::DOUBLE AS n FROM rep GROUP BY certname)), (i + 1)::INTEGER) AS value
FROM generate_series(0, 20) t(i)""")
do("stats_edges_distinct", lambda s: stats.summary(s).filter("measure in ('distinct_edges', 'certnames', 'packages')"), "SELECT 'distinct_edges' AS measure, count(*) AS n FROM (SELECT DISTINCT source_type, source_title, target_type, target_title FROM edg) UNION ALL SELECT 'certnames', count(*) FROM cn UNION ALL SELECT 'packages', count(*) FROM pkg")
do("population_metrics", lambda s: stats.population(s).select("active_nodes", "inactive_nodes", "resources", F.round("resources_per_node", 6).alias("resources_per_node"), F.round("duplication", 6).alias("duplication")), """
SELECT (SELECT count(*) FROM act) AS active_nodes, (SELECT count(*) FROM cn) - (SELECT count(*) FROM act) AS inactive_nodes, count(*) AS resources, round(count(*) / (SELECT count(*) FROM act), 6) AS resources_per_node,
  round((count(*) - count(DISTINCT resource)) / count(*), 6) AS duplication FROM res WHERE certname IN (FROM act)""")
do("expire_stale_nodes", lambda s: retention.expire_nodes(s, "2001-08-05 00:00:00", 7).filter("deactivated is null").select("certname", F.col("expired").isNotNull().alias("expired")), """
SELECT cn.certname, cn.expired IS NOT NULL OR (coalesce(facts_expire, true) AND greatest(TIMESTAMP '2001-07-01' + to_days((c_custkey % 30)::INTEGER), TIMESTAMP '2001-07-01' + to_days((c_custkey % 28)::INTEGER),
  coalesce((SELECT max(producer_timestamp) FROM rep WHERE rep.certname = cn.certname AND latest), TIMESTAMP '1900-01-01'), coalesce((SELECT max(ts) FROM inpm WHERE inpm.certname = cn.certname), TIMESTAMP '1900-01-01')) < TIMESTAMP '2001-07-29') AS expired
FROM cn WHERE deactivated IS NULL""")
do("purge_nodes", lambda s: retention.purge_nodes(s, NOW)["certnames"].select("certname"), "SELECT certname FROM cn WHERE NOT coalesce(deactivated < TIMESTAMP '2001-07-18', false) AND NOT coalesce(expired < TIMESTAMP '2001-07-18', false)")
do("drop_old_history", lambda s: retention.drop_old(s, "1998-01-01 00:00:00", 100, 50)["resource_events"].groupBy("status").agg(F.count(F.lit(1)).alias("n")), "SELECT ev.status, count(*) AS n FROM ev JOIN rep ON report_id = rep.id WHERE rep.producer_timestamp >= TIMESTAMP '1997-09-23' AND ts >= TIMESTAMP '1997-11-12' GROUP BY ev.status")
do("orphan_gc", lambda s: retention.collect_garbage(s)["packages"], "SELECT * FROM pkg SEMI JOIN cpkg USING (package_name, version, provider)")
do("containing_class", lambda s: s["resource_events"].select("certname", "line", containing_class(F.col("containment_path")).alias("found"), F.col("resource_title").alias("title")), "SELECT certname, line, containing_class AS found, resource_title AS title FROM ev")
do("canonical_hash", lambda s: s["catalog_resources"].select("title", canonical_hash("type", "title").alias("hash")).distinct(), """SELECT DISTINCT title, sha1('{"v":"' || type || '"},{"v":"' || title || '"}') AS hash FROM res""")
do("anonymize_masks", lambda s: anonymize(s["edges"], "full", "salt").select("certname", "source_title", "source_type").distinct(), "SELECT DISTINCT substr(sha256('salt' || certname), 1, 30) AS certname, substr(sha256('salt' || source_title), 1, 30) AS source_title, source_type FROM edg")
do("time_shift", lambda s: time_shift(s["reports"].select("hash", "producer_timestamp"), "2020-01-01 00:00:00"), f"SELECT hash, {TS.format('producer_timestamp + (TIMESTAMP \'2020-01-01\' - (SELECT max(producer_timestamp) FROM rep))')} AS producer_timestamp FROM rep")
do("number_text", lambda s: s["catalog_resources"].select("title", number_text(F.col("line"), "FM0000").alias("text")).distinct(), "SELECT DISTINCT title, lpad(line::VARCHAR, 4, '0') AS text FROM res")
REGISTRY["ingest_latest_wins"] = Registered(
    lambda spark, sf_dir: _plain(latest_wins(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "props")),
    "SELECT user_id, event_id, event_type, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
)


# service paths

NODE, REPORT_HASH = "Customer#000000003", "(SELECT min(hash) FROM rep WHERE type = 'agent')"


def path(name: str, at: str, query: list | None, sql: str) -> None:
    """Registers a service path; ``{report}`` in it stands for the first report's hash."""

    def run(s: Store) -> DataFrame:
        where = at.format(report=s["reports"].filter("type = 'agent'").agg(F.min("hash")).first()[0]) if "{report}" in at else at
        return Engine(s, NOW).endpoint(where, query)

    do(f"path_{name}", run, sql)


def _only(entity: str, *columns: str) -> list:
    return ["from", entity, ["extract", list(columns)]]


path("nodes", "/nodes", _only("nodes", "certname"), "SELECT certname FROM act")
path("node", f"/nodes/{NODE.replace('#', '%23')}", _only("nodes", "certname", "facts_environment"), f"SELECT certname, environment AS facts_environment FROM fs WHERE certname = '{NODE}'")
path("node_facts", f"/nodes/{NODE.replace('#', '%23')}/facts", None, f"SELECT certname, environment, name, value FROM fac WHERE certname = '{NODE}'")
path("node_fact", f"/nodes/{NODE.replace('#', '%23')}/facts/nation", None, f"SELECT certname, environment, name, value FROM fac WHERE certname = '{NODE}' AND name = 'nation'")
path("node_resources", f"/nodes/{NODE.replace('#', '%23')}/resources/Small", _only("resources", "title", "line"), f"SELECT title, line FROM res WHERE certname = '{NODE}' AND type = 'Small'")
path("facts_value", "/facts/mktsegment/BUILDING", _only("facts", "certname"), "SELECT certname FROM fs WHERE mktsegment = 'BUILDING' AND certname IN (FROM act)")
path("fact_names", "/fact-names", None, "SELECT DISTINCT name FROM fac")
path("fact_contents", "/fact-contents", ["=", "path", ["labels", 0]], "SELECT certname, environment, path, name, value FROM leaf WHERE path = 'labels,0' AND certname IN (FROM act)")
path("resources_title", "/resources/Small", _only("resources", "certname", "title"), "SELECT certname, title FROM res WHERE type = 'Small' AND certname IN (FROM act)")
path("catalog_edges", f"/catalogs/{NODE.replace('#', '%23')}/edges", _only("edges", "source_title", "target_title"), f"SELECT source_title, target_title FROM edg WHERE certname = '{NODE}'")
path("catalog_resources", f"/catalogs/{NODE.replace('#', '%23')}/resources", _only("resources", "title"), f"SELECT title FROM res WHERE certname = '{NODE}'")
path("factset_facts", f"/factsets/{NODE.replace('#', '%23')}/facts", _only("factsets", "certname", "hash"), f"SELECT certname, hash FROM fs WHERE certname = '{NODE}'")
path("environment", "/environments/NATION_3", None, "SELECT n_name AS name FROM nation WHERE n_name = 'NATION_3'")
path("environment_reports", "/environments/NATION_3/reports", _only("reports", "hash"), "SELECT hash FROM rep WHERE environment = 'NATION_3' AND type = 'agent'")
path("environment_events", "/environments/NATION_3/events", _only("events", "report", "line"), "SELECT report, line FROM evr WHERE environment = 'NATION_3'")
path("producer_catalogs", "/producers/producer-2/catalogs", _only("catalogs", "certname"), "SELECT certname FROM cn WHERE c_custkey % 5 = 2")
path("producer_reports", "/producers/producer-2/reports", _only("reports", "hash"), "SELECT hash FROM rep WHERE producer = 'producer-2' AND type = 'agent'")
path("report_events", "/reports/{report}/events", _only("events", "line", "resource_title"), f"SELECT line, resource_title FROM evr WHERE report = {REPORT_HASH}")
path("report_metrics", "/reports/{report}/metrics", None, f"""SELECT '[{{"category":"time","name":"total","value":' || o_totalprice::VARCHAR || '}}]' AS metrics FROM orders JOIN rep ON o_orderkey = id WHERE hash = {REPORT_HASH}""")
path("report_logs", "/reports/{report}/logs", None, f"""SELECT '[{{"level":"notice","message":"' || o_orderpriority || '"}}]' AS logs FROM orders JOIN rep ON o_orderkey = id WHERE hash = {REPORT_HASH}""")
path("package_inventory", f"/package-inventory/{NODE.replace('#', '%23')}", _only("package_inventory", "package_name"), f"SELECT package_name FROM cpkg WHERE certname = '{NODE}'")
path("events", "/events", ["from", "events", ["extract", ["report", "line"], ["=", "status", "noop"]]], "SELECT report, line FROM evr WHERE status = 'noop'")
path("inventory", "/inventory", _only("inventory", "certname", "facts.nation.name"), "SELECT certname, '\"' || nation || '\"' AS facts_nation_name FROM fs WHERE certname IN (FROM act)")

# output

do("json_documents", lambda s: Engine(s, NOW, surface="none").to_json("facts[certname, name, value] { name in ['labels', 'acctbal'] }"), """SELECT '{"certname":"' || certname || '","name":"' || name || '","value":' || value || '}' AS document FROM fac WHERE name IN ('labels', 'acctbal')""")
do("typed_path_documents", lambda s: Engine(s, NOW, surface="none").to_json("fact_contents[certname, path] { name = 'labels' }"), """SELECT '{"certname":"' || certname || '","path":["labels",' || i || ']}' AS document FROM fs, generate_series(0, 1) t(i)""")
do("linked_documents", lambda s: Engine(s, NOW, surface="none", links="/api").to_json("catalogs[certname, edges] { producer = 'producer-2' }"), """
SELECT '{"certname":"' || certname || '","edges":{"data":[' || coalesce(string_agg('{"relationship":"contains","source_title":"' || source_title || '","source_type":"' || source_type || '","target_title":"' || target_title || '","target_type":"' || target_type || '"}', ',' ORDER BY source_type, source_title, target_type, target_title), '')
  || '],"href":"/api/catalogs/' || certname || '/edges"}}' AS document FROM cn LEFT JOIN edg USING (certname) WHERE c_custkey % 5 = 2 GROUP BY certname""")
do("explained_plan", lambda s: s.spark.createDataFrame([("Scan parquet" in Engine(s, NOW).explain("nodes {}"),)], "planned boolean"), "SELECT true AS planned")
do("rows_in_time", lambda s: s.spark.createDataFrame([(len(Engine(s, NOW).rows("environments {}", timeout=300)),)], "n int"), "SELECT count(*)::INTEGER AS n FROM nation")


def _round_trip(s: Store) -> DataFrame:
    folder = f"{s.spark.conf.get('spark.sql.warehouse.dir')}/archive-{uuid.uuid4()}"
    write_folder(s, folder, ("factsets", "edges"))
    back = read_folder(s.spark, folder, ("factsets", "edges"))
    return Engine(back, NOW, surface="none").query("facts[certname, name, value] {}").unionByName(back["edges"].select("certname", F.col("source_title").alias("name"), F.to_variant_object(F.array("target_title")).alias("value")))


do("archive_round_trip", _round_trip, """SELECT certname, name, value FROM fac UNION ALL SELECT certname, source_title, '["' || target_title || '"]' FROM edg""")
do("anonymize_moderate", lambda s: anonymize(s["catalog_resources"].select("certname", "type", "title", "file"), "moderate", "salt"), "SELECT substr(sha256('salt' || certname), 1, 30) AS certname, type, substr(sha256('salt' || title), 1, 30) AS title, substr(sha256('salt' || file), 1, 30) AS file FROM res")
do("anonymize_low", lambda s: anonymize(s["resource_events"].select("certname", "resource_title", "message"), "low", "salt"), "SELECT substr(sha256('salt' || certname), 1, 30) AS certname, resource_title, substr(sha256('salt' || message), 1, 30) AS message FROM ev")


# commands, made of the bound relations


def _commands(rows: DataFrame, kind: str, body: F.Column, at: F.Column, received: F.Column | None = None, version: int = 9) -> DataFrame:
    received = at if received is None else received
    return rows.select(F.lit(kind).alias("command"), F.lit(version).alias("version"), received.alias("received"), "certname", at.alias("producer_timestamp"), body.alias("payload"))


def _document(head: F.Column, **lists: F.Column) -> F.Column:
    """JSON of an object, from that of its plain fields and from the joined JSON of each list's items: rows gathered as text are much cheaper than nested ones."""
    begun = F.when(head == "{}", "{").otherwise(F.concat(F.left(head, F.length(head) - 1), F.lit(",")))
    body = [x for i, (name, items) in enumerate(lists.items()) for x in (F.lit(f'{"," * (i > 0)}"{name}":['), items, F.lit("]"))]
    return F.concat(begun, *body, F.lit("}"))


def _joined(*fields: F.Column | str) -> F.Column:
    """JSON of the objects of a group's rows, without the list's brackets."""
    return F.array_join(F.collect_list(F.to_json(F.struct(*fields))), ",")


def _after(s: Store, commands: DataFrame, **how) -> Store:
    nothing = Store(s.spark, {})
    return changed(nothing, apply_commands(nothing, commands, **how))


def ingest(name: str, commands: Callable[[Store], DataFrame], result: Callable[[Store], DataFrame], sql: str, **how) -> None:
    """Registers what a store has after a batch of commands."""
    do(f"ingest_{name}", lambda s: result(_after(s, commands(s), **how)), sql)


def _event_facts(s: Store) -> DataFrame:
    """Each user's events as facts about one node, of which the last counts."""
    e = s["driver_events"].withColumn("certname", F.concat(F.lit("user-"), F.col("user_id").cast("string")))
    body = F.to_json(F.struct(F.col("event_type").alias("environment"), F.struct("event_id", "props", F.lit("a\0b").alias("nul")).alias("values"), F.array(F.array(F.col("event_type"), F.lit("1"), F.lit("apt"))).alias("package_inventory")))
    return _commands(e, "replace facts", body, F.col("ts"), F.timestamp_seconds("event_id"), 5)


LAST_EVENT = "SELECT *, 'user-' || user_id AS certname FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1"
ingest("facts", _event_facts, lambda s: Engine(s, NOW, surface="none").query("facts[certname, environment, name, value] { name != 'nul' }"), f"""
WITH last AS ({LAST_EVENT}) SELECT certname, event_type AS environment, 'event_id' AS name, event_id::VARCHAR AS value FROM last UNION ALL SELECT certname, event_type, 'props', to_json(props)::VARCHAR FROM last""".replace("WITH last", ", last"))
ingest("nul", _event_facts, lambda s: Engine(s, NOW, surface="none").query("facts[certname, value] { name = 'nul' }"), f"SELECT certname, '\"a\ufffdb\"' AS value FROM ({LAST_EVENT})")
ingest("blocklist", _event_facts, lambda s: Engine(s, NOW, surface="none").query("facts[certname, name] {}"), f"SELECT certname, 'event_id' AS name FROM ({LAST_EVENT})", options=Options(("pro.*", "n.l"), as_regex=True))
ingest("packages", _event_facts, lambda s: s["certname_packages"], f"SELECT certname, event_type AS package_name, '1' AS version, 'apt' AS provider FROM ({LAST_EVENT})")


def _malformed(s: Store) -> DataFrame:
    good = _event_facts(s)
    return good.withColumn("payload", F.when(F.unix_seconds("received") % 3 == 0, F.substring("payload", 1, 9)).otherwise(F.col("payload"))).withColumn("command", F.when(F.unix_seconds("received") % 7 == 0, "no such command").otherwise(F.col("command")))


ingest("malformed", _malformed, lambda s: s["rejected"].select("certname", "reason", F.unix_seconds("received").alias("event_id"), (F.length("payload") < 10).alias("cut")), """
SELECT 'user-' || user_id AS certname, CASE WHEN event_id % 7 = 0 THEN 'unknown command' ELSE 'malformed payload' END AS reason, event_id, event_id % 3 = 0 AS cut FROM events WHERE event_id % 3 = 0 OR event_id % 7 = 0""")


def _catalog_commands(s: Store) -> DataFrame:
    c = s["catalog_texts"].join(s["catalogs"].hint("shuffle_hash"), "certname")  # else the texts are sorted for the join
    bad = F.col("certname").endswith("7")  # an edge that leads nowhere
    nowhere = '{"source":{"type":"A","title":"b"},"target":{"type":"A","title":"b"},"relationship":"before"}'
    body = _document(F.to_json(F.struct("environment", "version", "producer")), resources=F.col("resources"), edges=F.when(bad, nowhere).otherwise(F.col("edges")))
    return _commands(c, "replace catalog", body, F.col("producer_timestamp"))


ingest("catalogs", _catalog_commands, lambda s: s["catalog_resources"].select("certname", "type", "title", F.array_join("tags", ",").alias("tags"), "exported", "file", "line", F.col("parameters")["brand"].alias("brand")), "SELECT certname, type, title, tag1 || ',' || replace(tag2, '#', '_') AS tags, exported, file, line, '\"' || brand || '\"' AS brand FROM res WHERE certname NOT LIKE '%7'")
ingest("edges", _catalog_commands, lambda s: s["edges"].drop("relationship"), "SELECT * FROM edg WHERE certname NOT LIKE '%7'")
ingest("invalid_catalogs", _catalog_commands, lambda s: s["rejected"].select("certname", "reason"), "SELECT DISTINCT certname, 'invalid catalog' AS reason FROM res WHERE certname LIKE '%7'")


def _report_commands(s: Store, version: int = 8) -> DataFrame:
    e = s["resource_events"]
    item = F.struct("status", "corrective_change", "timestamp", "property", F.try_parse_json("new_value").alias("new_value"), F.try_parse_json("old_value").alias("old_value"), "message", "name")
    skipped = F.col("status") == "skipped"
    r = (skipped.alias("skipped"), "timestamp", "resource_type", "resource_title", "file", "line", "containment_path", F.when(skipped, F.slice(F.array(item), 1, 0)).otherwise(F.array(item)).alias("events"))
    held = e.groupBy(F.col("report_id").alias("id")).agg(_joined(*r).alias("resources"))
    rows = s["reports"].hint("shuffle_hash").join(held, "id", "left")  # else all documents are sorted for the join
    none = F.slice(F.array(F.lit("x")), 1, 0)
    old = F.regexp_replace(F.to_json(F.struct("environment", F.col("configuration_version").alias("configuration-version"), F.col("start_time").alias("start-time"), F.lit("3.1").alias("mytool-version"), "status", "type", none.alias("resource-events"))), " ", " ")
    new = _document(F.to_json(F.struct("environment", "configuration_version", "start_time", "end_time", "transaction_uuid", "producer", "status", "type", "noop")), resources=F.coalesce("resources", F.lit("")))
    return _commands(rows, "store report", old if version < 5 else new, F.col("producer_timestamp"), version=version)


SKIPPED = "CASE WHEN status = 'skipped' THEN NULL ELSE {} END"
ingest("reports", _report_commands, lambda s: s["reports"].select("certname", "status", "type", "configuration_version", "producer_timestamp"), f"""
SELECT certname, status, type, configuration_version, {TS.format('producer_timestamp')} AS producer_timestamp FROM rep""")
ingest("latest_reports", _report_commands, lambda s: s["reports"].filter("latest").select("certname", "producer_timestamp"), f"SELECT certname, {TS.format('producer_timestamp')} AS producer_timestamp FROM rep WHERE latest")
ingest("events", _report_commands, lambda s: s["resource_events"].select("certname", "status", "timestamp", "resource_title", "property", "new_value", "line", "containing_class"), f"""
SELECT certname, status, {TS.format('ts')} AS timestamp, resource_title, property, new_value, line, containing_class FROM (
  SELECT DISTINCT report_id, certname, status, ts, resource_type, resource_title, {SKIPPED.format('property')} AS property, {SKIPPED.format('new_value')} AS new_value, {SKIPPED.format('message')} AS message, file, line, containing_class, {SKIPPED.format('name')} AS name FROM ev WHERE ts >= TIMESTAMP '1995-01-01')""", options=Options(event_horizon="1995-01-01 00:00:00"))
ingest("old_reports", lambda s: _report_commands(s, 4), lambda s: s["reports"].select("certname", "agent_version", "configuration_version", "start_time"), f"""
SELECT DISTINCT certname, '3.1' AS agent_version, configuration_version, {TS.format('start_time')} AS start_time FROM rep""")  # reports equal in all that tells them apart are one


def _state_commands(s: Store) -> DataFrame:
    c = s["certnames"]
    facts = _commands(s["factsets"], "replace facts", F.to_json(F.struct("environment", F.struct(F.lit(1).alias("v")).alias("values"))), F.col("producer_timestamp"))
    off = _commands(c.filter("deactivated is not null"), "deactivate node", F.lit("{}"), F.col("deactivated"))
    keep = _commands(c.filter("facts_expire is not null"), "configure expiration", F.lit('{"expire":{"facts":false}}'), F.col("facts_expire_updated"))
    return facts.unionByName(off).unionByName(keep)


ingest("node_states", _state_commands, lambda s: s["certnames"], f"""
SELECT certname, {TS.format("CASE WHEN cn.deactivated >= fs.ts THEN cn.deactivated END")} AS deactivated, NULL::VARCHAR AS expired, facts_expire, {TS.format('facts_expire_updated')} AS facts_expire_updated FROM cn JOIN fs USING (certname)""")


def _input_commands(s: Store) -> DataFrame:
    held = s["catalog_inputs"].groupBy("certname").agg(F.collect_list(F.array("type", "name")).alias("inputs"))
    rows = s["catalog_inputs_meta"].join(held, "certname")
    late = _commands(rows, "replace catalog inputs", F.lit('{"catalog_uuid":"late","inputs":[["a","b"]]}'), F.col("producer_timestamp"), F.timestamp_micros(F.unix_micros("producer_timestamp") + 1))
    return _commands(rows, "replace catalog inputs", F.to_json(F.struct("catalog_uuid", "inputs")), F.col("producer_timestamp")).unionByName(late)  # of equally new ones the first counts


ingest("inputs", _input_commands, lambda s: s["catalog_inputs"].join(s["catalog_inputs_meta"].select("certname", "catalog_uuid"), "certname"), "SELECT certname, type, name, catalog_uuid FROM inp JOIN inpm USING (certname)")
do("purged_histories", lambda s: retention.purge_nodes(Store.of(s.spark, {n: s[n] for n in retention.NODE_TABLES if n != "latest_reports"} | {"latest_reports": s["reports"].filter("latest").select("certname", "id", "producer_timestamp")}), NOW)["latest_reports"].select("certname", "id"), "SELECT certname, id FROM rep WHERE latest AND certname NOT IN (SELECT certname FROM cn WHERE deactivated < TIMESTAMP '2001-07-18' OR expired < TIMESTAMP '2001-07-18')")

QUERIES = {name: r.run for name, r in REGISTRY.items()}
ORACLE_SQL = {name: r.sql for name, r in REGISTRY.items() if r.sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest report status of active nodes: parser, expansion, join pruning, anti join and aggregation in one."""
    return Engine(bind(spark, sf_dir), NOW).query('nodes[latest_report_status, count()] { node_state = "active" group by latest_report_status }')
