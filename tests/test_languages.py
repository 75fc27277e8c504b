import json
import time

import pytest
from hypothesis import given
from hypothesis import strategies as st

from fleetlens.errors import BadQuery
from fleetlens.functions.paths import Part, decode_path, encode_path, format_field, parse_field, path_regex
from fleetlens.functions.regex import java_regex
from fleetlens.plans.pql import parse_query
from fleetlens.plans.rewrite import expand, split_query, with_defaults

GOLDEN = [
    ("nodes { certname = 'web' }", ["from", "nodes", ["=", "certname", "web"]]),
    ("resources{line=9 or line>20 and exported=true or file~'x'}", ["from", "resources", ["or", ["=", "line", 9], ["and", [">", "line", 20], ["=", "exported", True]], ["~", "file", "x"]]]),
    ("resources { line = 9 and !(line = 8 or exported = false) }", ["from", "resources", ["and", ["=", "line", 9], ["not", ["or", ["=", "line", 8], ["=", "exported", False]]]]]),
    (f"facts {{ value > {2**63 - 1} or value < {-(2**63)} }}", ["from", "facts", ["or", [">", "value", 2**63 - 1], ["<", "value", -(2**63)]]]),
    ("fact_contents {path = [ \"disks\",0 , 'size' ]}", ["from", "fact_contents", ["=", "path", ["disks", 0, "size"]]]),
    ("reports { job_id is null }", ["from", "reports", ["null?", "job_id", True]]),
    ("reports { job_id is not null }", ["from", "reports", ["null?", "job_id", False]]),
    (r"events { message = 'can\'t' }", ["from", "events", ["=", "message", "can't"]]),
    (r"events { message = 'tab\tle' }", ["from", "events", ["=", "message", r"tab\tle"]]),
    (r'events { message = "tab\tle \"x\"" }', ["from", "events", ["=", "message", 'tab\tle "x"']]),
    ("nodes { certname != 'db' and facts_environment !~ 'test' }", ["from", "nodes", ["and", ["not", ["=", "certname", "db"]], ["not", ["~", "facts_environment", "test"]]]]),
    ("facts { !value = 2.5e-1 }", ["from", "facts", ["not", ["=", "value", 0.25]]]),
    ("packages[] {}", ["from", "packages", ["extract", []]]),
    ("packages[count(version), provider] { group by provider }", ["from", "packages", ["extract", [["function", "count", "version"], "provider"], ["group_by", "provider"]]]),
    ("edges [source_title] { source_title in resources [title] { line = 4 } }", ["from", "edges", ["extract", ["source_title"], ["in", "source_title", ["from", "resources", ["extract", ["title"], ["=", "line", 4]]]]]]),
    ("facts { value in [3, 'x', false] }", ["from", "facts", ["in", "value", ["array", [3, "x", False]]]]),
    ("nodes { package_inventory { version ~ '^5' } }", ["from", "nodes", ["subquery", "package_inventory", ["~", "version", "^5"]]]),
    ("catalogs { offset 7 limit 2 }", ["from", "catalogs", ["offset", 7], ["limit", 2]]),
    ("edges[relationship]{ relationship = 'before' order by relationship desc, certname limit 3 }", ["from", "edges", ["extract", ["relationship"], ["=", "relationship", "before"]], ["order_by", [["relationship", "desc"], "certname"]], ["limit", 3]]),
    ('inventory { facts."eth.0".ips[1] ~ "^10" }', ["from", "inventory", ["~", 'facts."eth.0".ips[1]', "^10"]]),
    ('inventory { facts.match("eth.*").mtu >= 1500 }', ["from", "inventory", [">=", 'facts.match("eth.*").mtu', 1500]]),
    (' \t ["from", "edges"]', ["from", "edges"]),
]


@pytest.mark.parametrize(("text", "form"), GOLDEN)
def test_text_to_prefix_form(text, form):
    assert parse_query(text) == form


@pytest.mark.parametrize("text", ["nodes", "nodes {", "wrong {}", "nodes { a = }", "nodes { a = 1 b = 2 }", "nodes { a > true }", "nodes { a=1and b=2 }", "nodes {} x", "nodes { a = 9223372036854775808 }", "nodes[a]{ group by a limit 1 }", "[1", "nodes { a ~ 1 }"])
def test_malformed_text(text):
    with pytest.raises(BadQuery):
        parse_query(text)


def test_long_disjunctions_parse_fast():
    began = time.perf_counter()
    parse_query("nodes { " + " or ".join(f"(a = {i} and !(b ~ 'x{i}'))" for i in range(22)) + " }")
    assert time.perf_counter() - began < 0.5


def test_field_paths():
    cases = {
        "a": [Part("name", "a")], "latest?": [Part("name", "latest?")], "facts.os.family": [Part("name", "facts"), Part("name", "os"), Part("name", "family")], 'facts."a.b".c': [Part("name", "facts"), Part("name", "a.b"), Part("name", "c")],
        "facts.a[3].b": [Part("name", "facts"), Part("index", "a", 3), Part("name", "b")], 'facts.match("x.y")': [Part("name", "facts"), Part("match", "x.y")],
    }
    for text, parts in cases.items():
        assert parse_field(text) == parts and format_field(parts) == text
    for bad in ("", ".a", "a..b", "a.", "1a"):
        with pytest.raises(BadQuery):
            parse_field(bad)


def test_encoded_paths():
    for parts, text in ((["a", 0, "b"], "a#~0#~b"), (["a", "0"], 'a#~"0"'), (["x#~y"], r"x\#\~y"), (["a\\b", "c\\"], "a\\b#~c\\"), ([r"x\#\~y"], r"x\\#\\~y")):
        assert encode_path(parts) == text and decode_path(text) == parts
    with pytest.raises(BadQuery):
        encode_path([1.5])
    import re

    assert re.search(path_regex(["net.*", "eth0"]), "networking#~eth0") and not re.search(path_regex([".*"]), "a#~b")


@given(st.lists(st.one_of(st.integers(0, 10**9), st.text(st.sampled_from("ab#~\\0"), min_size=1)), min_size=1))
def test_paths_survive_encoding(parts):
    if not any(isinstance(p, str) and (p.endswith("#") or p.startswith("~") or p[-1:] == "\\" or p[:1] == "\\") for p in parts):  # such keys are ambiguous in the format
        assert decode_path(encode_path(parts)) == parts


def test_regular_expressions():
    assert java_regex("[[:digit:]]+x") == r"[\p{Digit}]+x"
    assert java_regex(r"\mword\M") == r"\bword\b"
    for bad in ("(", "a)", "[a", "*a", "a\\", "[[:nope:]]"):
        with pytest.raises(BadQuery):
            java_regex(bad)


def test_rewrites():
    assert expand("reports", ["=", "type", "any"]) is None
    assert expand("resources", ["=", "tag", "ABC"]) == ["=", "tags", "abc"]
    assert expand("events", ["=", "new_value", {"b": 1, "a": 2}]) == ["=", "new_value", '{"a":2,"b":1}']
    assert expand("nodes", ["=", ["node", "active"], True]) == ["node_state", "active"]
    assert expand("nodes", ["and", ["=", "node_state", "any"], ["=", "a", None]]) == ["null?", "a", True]
    assert expand("reports", ["subquery", "events", ["=", "line", 1]]) == ["in", ["hash"], ["from", "events", ["extract", ["report"], ["=", "line", 1]]]]
    assert expand("package_inventory", ["subquery", "packages"])[1] == ["package_name", "version", "provider"]
    assert with_defaults("reports", ["=", "status", "x"], False) == ["and", ["=", "type", "agent"], ["=", "status", "x"]]
    assert with_defaults("reports", ["or", ["=", "type", "plan"], ["=", "status", "x"]], False)[0] == "or"
    assert with_defaults("nodes", None, True) == ["and", ["=", "node_state", "active"]]
    assert with_defaults("environments", None, True) is None


@pytest.mark.parametrize(
    "query",
    [["nodes"], ["from", "nope"], ["from", "nodes", []], ["from", "nodes", ["=", "a", 1], ["=", "b", 2]], ["from", "nodes", ["limit", 1], ["limit", 2]], ["from", "nodes", ["extract", ["a"], ["=", "b", 1], ["=", "c", 1]]]],
)
def test_malformed_queries(query):
    with pytest.raises(BadQuery):
        entity, _, where, _ = split_query(query)
        expand(entity, where)


@pytest.mark.parametrize(
    ("entity", "expr"),
    [
        ("nodes", ["and"]), ("nodes", ["not", ["=", "a", 1], ["=", "b", 1]]), ("nodes", ["=", "a"]), ("nodes", ["?", "a", 1]), ("nodes", ["=", "node_state", "odd"]), ("nodes", ["=", "latest_report?", True]), ("facts", [">", ["fact", "x"], "1"]),
        ("nodes", ["in", "certname", ["extract", "certname", ["select-facts"]]]), ("nodes", ["in", "certname", ["extract", "certname", ["select_fact-contents"]]]), ("packages", ["subquery", "facts"]), ("facts", ["in", ["fact", "x"], ["array", [1, "a"]]]),
    ],
)
def test_bad_conditions(entity, expr):
    with pytest.raises(BadQuery):
        expand(entity, expr)


def test_forms_are_json():
    for text, _ in GOLDEN:
        assert json.loads(json.dumps(parse_query(text))) == parse_query(text)
