"""Rewrites of a query's prefix form before it is compiled: shorthands, implicit subqueries, default filters."""

from __future__ import annotations

import json

from ..errors import BadQuery
from ..functions.paths import LONGEST_NAME
from ..sources.entities import ENTITIES, columns_between

PAGING = ("limit", "offset", "order_by")
BOOLEAN = ("and", "or", "not")
COMPARISONS = ("=", "~", ">", "<", ">=", "<=", "~>")
SURFACES_WITHOUT_NODES = ("fact_paths", "environments", "packages", "producers", "fact_names")


def mentions(expr, wanted) -> bool:
    """Whether any comparison outside subqueries is on something that ``wanted`` accepts."""
    if not isinstance(expr, list) or not expr:
        return False
    if expr[0] in BOOLEAN:
        return any(mentions(e, wanted) for e in expr[1:])
    return len(expr) > 1 and wanted(expr[1])


def split_query(query) -> tuple[str, list | None, list | None, dict]:
    """Entity, extract clause, filter and paging of a ``from`` query."""
    if not isinstance(query, list) or len(query) < 2 or query[0] != "from" or not isinstance(query[1], str):
        raise BadQuery(f"A query has the form [\"from\", entity, ...], not {json.dumps(query)}")
    entity, extract, where, paging = query[1], None, None, {}
    if entity not in ENTITIES:
        raise BadQuery(f"Invalid entity '{entity}'; entities are {', '.join(sorted(ENTITIES))}")
    for clause in query[2:]:
        if not isinstance(clause, list) or not clause:
            raise BadQuery(f"A clause is a list that begins with an operator, not {json.dumps(clause)}")
        if clause[0] in PAGING:
            if clause[0] in paging or len(clause) != 2:
                raise BadQuery(f"'{clause[0]}' takes one argument and may be given once")
            paging[clause[0]] = clause[1]
        elif clause[0] == "extract" and extract is None:
            extract = clause
        elif where is None and extract is None:
            where = clause
        else:
            raise BadQuery(f"'from' takes one expression and paging clauses, not also {json.dumps(clause)}")
    if extract is not None:
        rest = extract[2:]
        group = [c for c in rest if isinstance(c, list) and c and c[0] == "group_by"]
        filters = [c for c in rest if not (isinstance(c, list) and c and c[0] == "group_by")]
        if len(filters) > 1 or len(group) > 1:
            raise BadQuery("'extract' takes fields, one expression and one group_by")
        where = filters[0] if filters else where
        extract = ["extract", extract[1] if isinstance(extract[1], list) and not (extract[1] and extract[1][0] == "function") else [extract[1]], group[0] if group else None]
    return entity, extract, where, paging


def with_defaults(entity: str, where, active: bool):
    """Reports are the agent's unless a type is asked for; nodes are active ones unless a state is."""
    extra = []
    if entity == "reports" and not mentions(where, lambda f: f == "type"):
        extra.append(["=", "type", "agent"])
    if active and entity not in SURFACES_WITHOUT_NODES and ENTITIES[entity].find("certname") and not mentions(where, lambda f: f in ("node_state", ["node", "active"])):
        extra.append(["=", "node_state", "active"])
    return ["and", *extra, *([where] if where is not None else [])] if extra else where


def expand(entity: str, expr):
    """The filter without shorthands; None where a clause says nothing."""
    if expr is None:
        return None
    if not isinstance(expr, list) or not expr:
        raise BadQuery(f"A condition is a list that begins with an operator, not {json.dumps(expr)}")
    op, args = expr[0], expr[1:]
    if op in ("and", "or"):
        if not args:
            raise BadQuery(f"'{op}' without conditions says nothing")
        parts = [x for x in (expand(entity, a) for a in args) if x is not None]
        return None if not parts else parts[0] if len(parts) == 1 else [op, *parts]
    if op == "not":
        if len(args) != 1:
            raise BadQuery(f"'not' takes one condition, not {len(args)}")
        inner = expand(entity, args[0])
        return None if inner is None else ["not", inner]
    if op == "subquery":
        return _implicit(entity, args)
    if op == "null?":
        if len(args) != 2 or not isinstance(args[1], bool):
            raise BadQuery("null? takes a field and a boolean")
        return expr
    if op == "in":
        return _membership(entity, args)
    if op not in COMPARISONS:
        raise BadQuery(f"Unknown operator '{op}'")
    if len(args) != 2:
        raise BadQuery(f"'{op}' takes a field and a value")
    return _comparison(entity, op, *args)


def _comparison(entity: str, op: str, field, value):
    if field == ["node", "active"]:
        if not isinstance(value, bool):
            raise BadQuery("['node', 'active'] takes a boolean")
        return ["node_state", "active" if value else "inactive"]
    if field == "node_state":
        if value not in ("active", "inactive", "any"):
            raise BadQuery(f"node_state is active, inactive or any, not {value!r}")
        return None if value == "any" else ["node_state", value]
    if isinstance(field, list) and field[:1] == ["parameter"] and len(field) == 2:
        test = ["=", "res_param_value", json.dumps(value, separators=(",", ":"), sort_keys=True)] if op == "=" else [op, "res_param_value", value]
        return ["in", ["resource"], ["from", "params", ["extract", ["res_param_resource"], ["and", ["=", "res_param_name", field[1]], test]]]]
    if isinstance(field, list) and field[:1] == ["fact"] and len(field) == 2:
        if op in (">", "<", ">=", "<=") and (isinstance(value, bool) or not isinstance(value, (int, float))):
            raise BadQuery(f"Argument {value!r} of {op} must be a number")
        return ["in", ["certname"], ["from", "facts", ["extract", ["certname"], ["and", ["=", "name", field[1]], [op, "value", value]]]]]
    if op == "=" and value is None:
        return ["null?", field, True]
    if field == "latest_report?" and entity not in ("reports", "events"):
        raise BadQuery(f"latest_report? is of reports and events, not of {entity}")
    if entity == "reports" and op == "=" and field == "type" and value == "any":
        return None
    if entity == "resources" and field == "tag":
        return [op, "tags", value.lower() if op == "=" else value]
    if entity == "events" and field in ("new_value", "old_value") and op == "=":
        return [op, field, json.dumps(value, sort_keys=True, separators=(",", ":"))]
    return [op, field, value]


def _implicit(entity: str, args):
    if not args or args[0] not in ENTITIES:
        raise BadQuery(f"Unsupported subquery {args[:1]}")
    columns = columns_between(entity, args[0])
    if columns is None:
        raise BadQuery(f"{entity} and {args[0]} share no columns by which a subquery could be meant")
    outer, inner = columns
    return ["in", list(outer), ["from", args[0], ["extract", list(inner), *args[1:2]], *args[2:]]]


def _membership(entity: str, args):
    if len(args) != 2:
        raise BadQuery("in takes a field or fields and one operand")
    fields, operand = args
    if not isinstance(operand, list) or not operand:
        raise BadQuery("The operator 'in' takes an array or a subquery")
    if isinstance(fields, list) and fields[:1] == ["fact"]:
        if operand[0] != "array" or len({type(x) for x in operand[1]}) > 1:
            raise BadQuery("['fact', name] in takes an array of values of one type")
        return ["in", ["certname"], ["from", "facts", ["extract", ["certname"], ["and", ["=", "name", fields[1]], ["in", "value", operand]]]]]
    names = fields if isinstance(fields, list) else [fields]
    if operand[0] == "array":
        if not isinstance(operand[1], list):
            raise BadQuery("The operator 'in' takes an array of literals")
        return ["in", names, operand]
    if operand[0] == "from":
        return ["in", names, operand]
    if operand[0] == "extract" and len(operand) == 3 and isinstance(operand[2], list) and str(operand[2][0]).startswith("select_"):
        inner = operand[2][0].removeprefix("select_")
        if inner.replace("-", "_") != inner and inner.replace("-", "_") in ENTITIES:
            raise BadQuery(f"Unsupported subquery 'select_{inner}'; did you mean 'select_{inner.replace('-', '_')}'?")
        if inner not in ENTITIES:
            raise BadQuery(f"Unsupported subquery 'select_{inner}'")
        listed = operand[1] if isinstance(operand[1], list) else [operand[1]]
        return ["in", names, ["from", inner, ["extract", listed, *operand[2][1:2]]]]
    raise BadQuery(f"Unsupported operand of in: {json.dumps(operand)}")


def checked_name(name: str) -> str:
    if len(name.encode()) > LONGEST_NAME:
        raise BadQuery(f"Projected field name '{name}' exceeds {LONGEST_NAME} characters")
    return name
