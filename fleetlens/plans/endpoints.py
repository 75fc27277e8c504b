"""Paths of the query service as queries: what their segments restrict, and which parent must exist."""

from __future__ import annotations

from urllib.parse import unquote

from ..errors import BadQuery

#: First segment to entity, and what a parent's id restricts in the entities below it.
ENTITY = {
    "nodes": "nodes", "facts": "facts", "fact-names": "fact_names", "fact-paths": "fact_paths", "fact-contents": "fact_contents", "factsets": "factsets", "resources": "resources", "catalogs": "catalogs", "edges": "edges",
    "reports": "reports", "events": "events", "event-counts": "event_counts", "aggregate-event-counts": "aggregate_event_counts", "environments": "environments", "producers": "producers", "inventory": "inventory",
    "packages": "packages", "package-inventory": "package_inventory", "catalog-inputs": "catalog_inputs", "catalog-input-contents": "catalog_input_contents",
}
BELOW = {
    "nodes": ("certname", ("facts", "resources")), "catalogs": ("certname", ("edges", "resources")), "factsets": ("certname", ("facts",)), "environments": ("environment", ("facts", "resources", "reports", "events")),
    "producers": ("producer", ("factsets", "catalogs", "reports")), "reports": ("report", ("events", "metrics", "logs")),
}
STATUS = {"nodes": "certname", "catalogs": "certname", "factsets": "certname", "environments": "name", "producers": "name", "package-inventory": "certname"}
NARROWING = {"facts": ("name", "value"), "resources": ("type", "title")}


def resolve(path: str) -> tuple[str, list, tuple[str, str] | None]:
    """Entity, conditions and the parent (its first segment and id) of a path such as ``/nodes/web1/facts/kernel``."""
    parts = [unquote(p) for p in path.strip("/").split("/") if p]
    if not parts or parts[0] not in ENTITY:
        raise BadQuery(f"No such endpoint: {path}")
    first, conditions, parent = parts[0], [], None
    rest = parts[1:]
    if first in BELOW and len(rest) >= 2:
        column, below = BELOW[first]
        if rest[1] not in below:
            raise BadQuery(f"No such endpoint: {path}")
        parent = (first, rest[0])
        if first == "catalogs" and rest[1] == "edges" or column != "report" or rest[1] == "events":
            conditions.append(["=", column, rest[0]])
        else:
            conditions.append(["=", "hash", rest[0]])
        below_name, rest = rest[1], rest[2:]
        if first == "factsets":
            return "factsets", conditions, parent
        if below_name in ("metrics", "logs"):
            return f"report_{below_name}", conditions, parent
        first = below_name
    elif first in STATUS and len(rest) == 1:
        return ENTITY[first], [["=", STATUS[first], rest[0]]], (None if first == "package-inventory" else (first, rest[0]))
    elif first == "reports" and rest:
        raise BadQuery(f"No such endpoint: {path}")
    names = NARROWING.get(first, ())
    if len(rest) > len(names):
        raise BadQuery(f"No such endpoint: {path}")
    conditions += [["=", name, value] for name, value in zip(names, rest, strict=False)]
    return ENTITY[first], conditions, parent
