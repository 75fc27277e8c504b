"""From prefix form to a DataFrame.

A filter's conjuncts become filters and semi or anti joins; a subquery under ``or`` or
``not`` becomes a mark: a left join with its distinct keys whose flag the condition
reads, with SQL's three values where ``not`` makes them matter.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BadQuery
from ..functions import jsonv
from ..functions.paths import Part, encode_path, parse_field, path_regex
from ..functions.regex import java_regex
from ..functions.tochar import date_text, number_text
from ..sources.entities import ENTITIES, Entity, typed_path
from ..sources.store import Store
from . import rewrite

AGGREGATES = ("count", "sum", "avg", "min", "max")
SCALARS = ("to_string", "jsonb_typeof")
INEQUALITIES = {">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}
#: Forms of a timestamp, tried in turn.
TIMES = ("%Y-%m-%dT%H:%M:%S.%f%z", "%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M%z", "%Y-%m-%dT%H:%M", "%Y-%m-%d %H:%M:%S.%f%z", "%Y-%m-%d %H:%M:%S%z", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d", "%Y-%m", "%Y", "%a, %d %b %Y %H:%M:%S %z", "%Y/%m/%d")


def parse_time(text) -> Column:
    """The moment that a text names; without an offset, in the session's time zone (which should be UTC)."""
    if not isinstance(text, str):
        raise BadQuery(f"{text!r} does not name a moment")
    tidy = text.strip().replace("Z", "+0000") if text.strip().endswith("Z") else text.strip()
    if "." in tidy:  # microseconds at most
        head, _, tail = tidy.partition(".")
        digits = tail[: next((i for i, c in enumerate(tail) if not c.isdigit()), len(tail))]
        tidy = f"{head}.{digits[:6]}{tail[len(digits):]}"
    for form in TIMES:
        try:
            found = datetime.strptime(tidy, form)
        except ValueError:
            continue
        return F.lit(found.isoformat(sep=" ")).cast("timestamp")
    raise BadQuery(f"{text!r} does not name a moment")


@dataclass
class Compiler:
    store: Store
    options: dict
    active: bool = False
    marks: int = field(default=0)

    def query(self, query: list, top: bool = True) -> DataFrame:
        entity, extract, where, paging = rewrite.split_query(query)
        where = rewrite.expand(entity, rewrite.with_defaults(entity, where, self.active and top))
        return Scope(self, self.entity(entity), extract, where, paging).frame()

    def entity(self, name: str) -> Entity:
        """The entity; the agent's version of reports is found by the engine's name for it too."""
        own = self.options.get("version_field")
        if name == "reports" and own:
            return replace(ENTITIES[name], alias=lambda n: "agent_version" if n == own else None)
        return ENTITIES[name]

    def flag(self) -> str:
        self.marks += 1
        return f"mark_{self.marks}"


class Scope:
    """One ``from`` query being compiled."""

    def __init__(self, compiler: Compiler, entity: Entity, extract, where, paging: dict):
        self.compiler, self.entity, self.extract, self.conditions, self.paging = compiler, entity, extract, where, paging
        options = dict(compiler.options)
        if entity.name in ("facts", "fact_contents") and (name := self.fixed_name(where)):
            options["fact_name"] = name
        self.df = entity.rows(compiler.store, self.needed(), options)

    def fixed_name(self, where) -> str | None:
        """The fact's name if the filter's conjuncts demand one."""
        for c in (where[1:] if where and where[0] == "and" else [where] if where else []):
            if c[0] == "=" and c[1] == "name" and isinstance(c[2], str):
                return c[2]
            if c[0] == "=" and c[1] == "path" and isinstance(c[2], list) and c[2] and isinstance(c[2][0], str):
                return c[2][0]  # a path begins with the fact's name
        return None

    def needed(self) -> set[str]:
        """Fields that the query touches; all that can be projected where it extracts none."""
        found: set[str] = set()

        def walk(x):
            if isinstance(x, str):
                found.add(self.entity.alias(x) or x)
                if "." in x and (m := x.partition(".")[0]):
                    found.add(m)
            elif isinstance(x, list):
                if x[:1] == ["in"] and len(x) == 3 and isinstance(x[2], list) and x[2][:1] == ["from"]:
                    walk(x[1])
                else:
                    for y in x:
                        walk(y)

        walk(self.conditions)
        walk(list(self.paging.values()))
        if self.extract and self.extract[1]:
            walk(self.extract[1:])
        else:
            found |= {f.name for f in self.output_fields()}
        return found

    def output_fields(self):
        options = self.compiler.options
        hidden = set()
        if self.entity.name == "nodes" and not options.get("include_facts_expiration"):
            hidden = {"expires_facts", "expires_facts_updated"}
        shown = {"package_inventory"} if options.get("include_package_inventory") else set()
        return [f for f in self.entity.fields if (f.projectable or f.name in shown) and f.name not in hidden]

    # fields

    def lookup(self, name, use: str = "queryable") -> tuple[Column, str]:
        """Column and kind of a field or dotted path."""
        if not isinstance(name, str):
            raise BadQuery(f"{name!r} is not a field")
        known = self.entity.find(name)
        if known is not None:
            if use == "queryable" and not known.queryable or use == "projectable" and not known.projectable and known.name not in {f.name for f in self.output_fields()}:
                raise BadQuery(f"Can't use field '{name}' of {self.entity.name} here")
            return F.col(f"`{known.name}`"), known.kind
        top = name.partition(".")[0]
        if "." in name and top in self.entity.dotted:
            parts = parse_field(name)
            if any(p.kind == "match" for p in parts):
                raise BadQuery(f"match() can't be used here: {name}")
            if use == "projectable" and any(p.index is not None for p in parts):
                raise BadQuery(f"a place of an array can be asked for in conditions only: {name}")
            return self.dotted(parts), "dotted"
        raise BadQuery(f"{self.entity.name} has no field {name!r} to ask for; it has {', '.join(sorted(f.name for f in self.entity.fields if f.queryable))}")

    def dotted(self, parts: list[Part]) -> Column:
        top, rest = parts[0].name, parts[1:]
        if top == "trusted":
            return jsonv.at_path(F.col("facts"), [Part("name", "trusted"), *rest], True)
        return jsonv.at_path(F.col(top), rest, True)

    # conditions

    def where(self, expr) -> None:
        if expr is None:
            return
        if expr[0] == "and":
            for e in expr[1:]:
                self.where(e)
        elif expr[0] == "in" and expr[2][0] == "from":
            keys, sub = self.keys(expr[1], expr[2])
            self.df = self.df.join(sub, reduce(lambda a, b: a & b, [k == sub[c] for k, c in zip(keys, sub.columns, strict=True)]), "left_semi")
        elif expr[0] == "node_state":
            nodes, how = self.state(expr[1])
            self.df = self.df.join(nodes, "certname", how)
        else:
            test = self.condition(expr, False)  # may join marks to self.df
            self.df = self.df.filter(test)

    def state(self, which: str) -> tuple[DataFrame, str]:
        name, how = ("not_active_nodes", "left_anti") if which == "active" else ("inactive_nodes", "left_semi")
        return ENTITIES[name].rows(self.compiler.store, {"certname"}, self.compiler.options), how

    def condition(self, expr, negated: bool) -> Column:
        op = expr[0]
        if op in ("and", "or"):
            return reduce(lambda a, b: a & b if op == "and" else a | b, [self.condition(e, negated) for e in expr[1:]])
        if op == "not":
            return ~self.condition(expr[1], True)
        if op == "node_state":
            nodes, how = self.state(expr[1])
            found = self.mark([F.col("certname")], nodes.toDF(self.compiler.flag()), False)
            return ~found if how == "left_anti" else found
        if op == "in":
            if expr[2][0] == "from":
                keys, sub = self.keys(expr[1], expr[2])
                return self.mark(keys, sub, negated)
            return self.in_array(expr[1], expr[2][1])
        if op == "null?":
            return self.null(expr[1], expr[2])
        if isinstance(expr[1], list) and expr[1][:1] == ["function"]:
            return self.function_test(op, expr[1], expr[2])
        if isinstance(expr[1], str) and "match(" in expr[1] and expr[1].partition(".")[0] in self.entity.dotted:
            return self.matched(op, parse_field(expr[1]), expr[2], negated)
        c, kind = self.lookup(expr[1])
        test = self.compare(op, c, kind, expr[2], expr[1])
        return F.coalesce(test, F.lit(False)) if self.compiler.options.get("distinct") else test  # there a null differs from any value, also under not

    def compare(self, op: str, c: Column, kind: str, value, name: str) -> Column:
        if op == "=":
            return self.equal(c, kind, value, name)
        if op in INEQUALITIES:
            return self.inequality(op, c, kind, value, name)
        if op == "~":
            return self.regex(c, kind, value)
        return self.path_match(c, kind, value, name)

    def equal(self, c: Column, kind: str, value, name: str) -> Column:
        if kind == "doc":
            if not isinstance(value, dict):
                return F.lit(False)
            keys = [jsonv.contains(F.try_element_at(c, F.lit(k)) if name != "trusted" else F.try_variant_get(c, jsonv.json_path([Part("name", k)]), "variant"), x) for k, x in value.items()]
            return reduce(lambda a, b: a & b, keys, c.isNotNull())
        if kind == "dotted":  # containment, but equality for a path with an index
            return F.coalesce(jsonv.equals(c, value), F.lit(False)) if "[" in name else jsonv.contains(c, value)
        if kind == "value":
            return jsonv.equals(c, value)
        if kind == "timestamp":
            return c == parse_time(value)
        if kind == "array":
            return F.array_contains(c, value)
        if kind == "path":
            return self.path_equal(c, value)
        if kind == "encoded":
            return c == encode_path(value if isinstance(value, list) else [value])
        if kind == "numeric":
            if isinstance(value, bool) or not isinstance(value, (int, float)):
                raise BadQuery(f"Argument \"{value}\" is incompatible with numeric field {name}")
            return c == F.lit(value)
        if kind == "boolean":
            if not isinstance(value, bool):
                raise BadQuery(f"Argument \"{value}\" is incompatible with boolean field {name}")
            return c == F.lit(value)
        if isinstance(value, (list, dict)):
            raise BadQuery(f"Argument {value} is incompatible with field {name}")
        return c == F.lit(str(value).lower() if isinstance(value, bool) else str(value))

    @staticmethod
    def path_equal(c: Column, value) -> Column:
        if not isinstance(value, list):
            raise BadQuery("A path is compared with an array")
        encode_path(value)
        return (c == F.array(*[F.lit(str(p)) for p in value])) & (F.col("path_types") == "".join("i" if isinstance(p, int) else "s" for p in value))

    def inequality(self, op: str, c: Column, kind: str, value, name: str) -> Column:
        if kind == "timestamp":
            return INEQUALITIES[op](c, parse_time(value))
        if isinstance(value, bool) or not isinstance(value, (int, float)) or kind not in ("numeric", "value", "dotted"):
            raise BadQuery(f"Argument \"{value}\" and operator \"{op}\" have incompatible types for field {name}")
        if kind == "numeric":
            return INEQUALITIES[op](c, F.lit(value))
        return F.coalesce(INEQUALITIES[op](jsonv.number(c), F.lit(float(value))), F.lit(False))

    @staticmethod
    def regex(c: Column, kind: str, value) -> Column:
        if not isinstance(value, str):
            raise BadQuery(f"'{value}' is not a regular expression")
        pattern = java_regex(value)
        if kind == "array":
            return F.coalesce(F.exists(c, lambda x: x.rlike(pattern)), F.lit(False))
        if kind in ("value", "dotted"):
            c = jsonv.text(c)
        elif kind in ("timestamp", "numeric", "boolean", "path", "doc", "json"):
            raise BadQuery(f"'~' can't be used on a field of type {kind}")
        return F.coalesce(c.rlike(pattern), F.lit(False))

    @staticmethod
    def path_match(c: Column, kind: str, value, name: str) -> Column:
        if not isinstance(value, list) or kind not in ("path", "encoded"):
            raise BadQuery(f"'~>' can only be used with an array on a path, not on {name}")
        if kind == "encoded":
            return c.rlike(java_regex(path_regex(value)))
        tests = []
        for i, p in enumerate(value):
            at = F.substring("path_types", i + 1, 1)
            if isinstance(p, int):
                tests.append((at == "i") & (F.get(c, F.lit(i)) == str(p)))
            else:
                hit = F.get(c, F.lit(i)).rlike(java_regex(p))
                tests.append((at == "s") & hit if p.isdigit() else hit)
        return F.when(F.size(c) == len(value), reduce(lambda a, b: a & b, tests, F.lit(True))).otherwise(False)

    def in_array(self, names: list, values: list) -> Column:
        if len(names) > 1:
            if not all(isinstance(v, list) and len(v) == len(names) for v in values):
                raise BadQuery("in over several fields takes an array of arrays of as many values")
            return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [self.compare("=", *self.lookup(n), x, n) for n, x in zip(names, v, strict=True)]) for v in values], F.lit(False))
        c, kind = self.lookup(names[0])
        if kind == "array":
            raise BadQuery(f"Operator 'in' ['array'] is not supported on array field {names[0]}")
        if kind in ("value", "dotted", "path", "encoded", "doc"):
            return reduce(lambda a, b: a | b, [self.equal(c, kind, v, names[0]) for v in values], F.lit(False))
        if kind == "timestamp":
            return reduce(lambda a, b: a | b, [c == parse_time(v) for v in values], F.lit(False))
        if kind == "numeric":
            if any(isinstance(v, bool) or not isinstance(v, (int, float)) for v in values):
                raise BadQuery(f"Argument {values} is incompatible with numeric field {names[0]}")
            return c.isin(values)
        return c.isin([v if kind == "boolean" else str(v) for v in values])

    def null(self, name: str, wanted: bool) -> Column:
        c, kind = self.lookup(name)
        if kind in ("value", "dotted"):  # an absent path is neither null nor not null
            test = F.when(c.isNotNull(), jsonv.type_name(c) == "null")
            return test if wanted else ~test
        return c.isNull() if wanted else c.isNotNull()

    def function_test(self, op: str, call: list, value) -> Column:
        c, kind = self.scalar(call), "string"
        if op == "=":
            return c == F.lit(value)
        if op == "~":
            return self.regex(c, kind, value)
        if op in INEQUALITIES:
            return INEQUALITIES[op](c, F.lit(value))
        raise BadQuery(f"'{op}' can't be used on a function")

    def matched(self, op: str, parts: list[Part], value, negated: bool) -> Column:
        """A dotted path with patterns holds if any leaf whose path fits them does."""
        if parts[0].name == "trusted":
            parts = [parts[0], *parts[1:]]
        elif parts[0].name != "facts":
            raise BadQuery("match() is for facts and trusted")
        else:
            parts = parts[1:]
        name = ["=", "name", parts[0].name] if parts[0].kind != "match" else None
        inner = Scope(self.compiler, ENTITIES["fact_contents"], ["extract", ["certname", "path"], None], name, {})
        steps = []
        for p in parts:
            steps.append((p.kind == "match", p.name))
            if p.index is not None:
                steps.append((False, p.index))
        path, types = F.col("path"), F.col("path_types")
        fits = F.size(path) == len(steps)
        for i, (pattern, name) in enumerate(steps):
            here = F.get(path, F.lit(i))
            test = here.rlike(java_regex(name)) if pattern else (here == str(name)) & (F.substring(types, i + 1, 1) == ("i" if isinstance(name, int) else "s"))
            fits = fits & test
        flag = self.compiler.flag()
        leaves = inner.df.filter(F.when(F.size(path) == len(steps), fits).otherwise(False)).filter(inner.compare(op, F.col("value"), "value", value, "value")).select(F.col("certname").alias(flag))
        return self.mark([F.col("certname")], leaves, False)

    # subqueries

    def keys(self, names: list, query: list) -> tuple[list[Column], DataFrame]:
        """Outer keys and a DataFrame of the subquery's columns, brought to comparable forms."""
        outer = [self.lookup(n) for n in names]
        entity, extract, _, _ = rewrite.split_query(query)
        if extract is None or len(extract[1]) != len(names):
            raise BadQuery(f"in compares {len(names)} field(s) with a subquery that extracts as many")
        sub = self.compiler.query(query, top=False)
        kinds = [(f.kind if (f := self.compiler.entity(entity).find(n)) else "dotted") if isinstance(n, str) else "numeric" for n in extract[1]]
        flags = [self.compiler.flag() for _ in names]
        sub = sub.toDF(*flags)
        left, right = [], []
        for (c, kind), inner, name in zip(outer, kinds, flags, strict=True):
            a, b = self.comparable(c, kind, inner), self.comparable(F.col(name), inner, kind)
            left.append(a)
            right.append(b.alias(name))
        return left, sub.select(*right)

    @staticmethod
    def comparable(c: Column, kind: str, other: str) -> Column:
        json_kinds = ("value", "dotted")
        if kind in json_kinds:
            return jsonv.canonical(c) if other in json_kinds else jsonv.number(c) if other == "numeric" else jsonv.text(c)
        if kind == "path":
            return F.array_join(c, "\0")
        if other in json_kinds:
            return c.cast("double") if kind == "numeric" else c.cast("string")
        return c

    def mark(self, keys: list[Column], sub: DataFrame, negated: bool) -> Column:
        """Whether the keys are among the subquery's rows; NULL as SQL has it where ``not`` may see it."""
        names, flag = sub.columns, self.compiler.flag()
        null = reduce(lambda a, b: a | b, [F.col(n).isNull() for n in names])
        on = reduce(lambda a, b: a & b, [k == F.col(n) for k, n in zip(keys, names, strict=True)])
        df = self.df.join(sub.filter(~null).distinct().withColumn(flag, F.lit(True)), on, "left")
        found = F.coalesce(F.col(flag), F.lit(False))
        if negated and len(keys) > 1:
            df, unknown = self.undecided(df, keys, sub)
            found = F.when(found, True).when(unknown, F.lit(None).cast("boolean")).otherwise(False)
        elif negated:
            rows, nulls = self.compiler.flag(), self.compiler.flag()
            df = df.crossJoin(F.broadcast(sub.agg(F.count(F.lit(1)).alias(rows), F.coalesce(F.bool_or(null), F.lit(False)).alias(nulls))))  # one row
            unknown = (F.col(rows) > 0) & (reduce(lambda a, b: a | b, [k.isNull() for k in keys]) | F.col(nulls))
            found = F.when(found, True).when(unknown, F.lit(None).cast("boolean")).otherwise(False)
        self.df = df
        return found

    def undecided(self, df: DataFrame, keys: list[Column], sub: DataFrame) -> tuple[DataFrame, Column]:
        """Whether some row of the subquery differs from the keys in no column, but for nulls on either side.

        A pair of rows is compared where neither side is null.  Distinct keys are copied for
        each pattern of nulls that the other side may have, with the columns blanked that
        either pattern leaves out, so that one equi-join finds all such pairs.
        """
        n, patterns = len(keys), F.array(*[F.lit(p) for p in range(1 << len(keys))])
        outer, inner, theirs = [self.compiler.flag() for _ in keys], sub.columns, [self.compiler.flag() for _ in keys]
        mask = lambda names: reduce(lambda a, b: a + b, [F.when(F.col(c).isNull(), 1 << i).otherwise(0) for i, c in enumerate(names)])

        def blanked(rows: DataFrame, names: list[str], mine: str, other: str) -> DataFrame:
            rows = rows.withColumn(mine, mask(names)).withColumn(other, F.explode(patterns))
            both = F.col("k_outer").bitwiseOR(F.col("k_inner"))
            return rows.withColumns({f"k_{i}": F.when(both.bitwiseAND(1 << i) == 0, F.col(c)) for i, c in enumerate(names)}).filter(both != 0)

        asked = blanked(df.select(*[k.alias(c) for k, c in zip(keys, outer, strict=True)]).distinct(), outer, "k_outer", "k_inner")
        there = blanked(sub.distinct(), inner, "k_inner", "k_outer").select("k_outer", "k_inner", *[F.col(f"k_{i}").alias(theirs[i]) for i in range(n)]).distinct()
        there = there.withColumnsRenamed({"k_outer": "t_outer", "k_inner": "t_inner"})
        same = [F.col(f"k_{i}").eqNullSafe(F.col(theirs[i])) for i in range(n)] + [F.col("k_outer") == F.col("t_outer"), F.col("k_inner") == F.col("t_inner")]
        flag = self.compiler.flag()
        found = asked.join(there, reduce(lambda a, b: a & b, same), "left_semi").select(*outer).distinct().withColumn(flag, F.lit(True))
        on = reduce(lambda a, b: a & b, [k.eqNullSafe(F.col(c)) for k, c in zip(keys, outer, strict=True)])
        return df.join(found, on, "left"), F.coalesce(F.col(flag), F.lit(False))

    # projection

    def scalar(self, call: list) -> Column:
        name, args = call[1], call[2:]
        if name == "jsonb_typeof" and len(args) == 1:
            return jsonv.type_name(self.lookup(args[0])[0])
        if name == "to_string" and len(args) == 2:
            c, kind = self.lookup(args[0])
            if kind == "timestamp":
                return date_text(c, args[1])
            return number_text(jsonv.number(c) if kind in ("value", "dotted") else c, args[1])
        raise BadQuery(f"Function {name} takes other arguments than {args} or can't be used here")

    def aggregate(self, call: list) -> Column:
        name, args = call[1], call[2:]
        if name == "count":
            if len(args) > 1:
                raise BadQuery("count takes one argument at most")
            return F.count(F.lit(1)) if not args else F.count(self.lookup(args[0])[0])
        if len(args) != 1:
            raise BadQuery(f"{name} takes one argument")
        c, kind = self.lookup(args[0])
        if kind in ("value", "dotted"):
            c = jsonv.number(c)
        elif kind != "numeric" and (name in ("sum", "avg") or kind in ("array", "doc", "json", "path")):
            raise BadQuery(f"{name} takes a numeric field, not {args[0]}")
        return getattr(F, name)(c)

    def frame(self) -> DataFrame:
        self.where(self.conditions)
        listed = self.extract[1] if self.extract else []
        group = self.extract[2] if self.extract else None
        calls = [x for x in listed if isinstance(x, list)]
        for call in calls:
            if call[:1] != ["function"] or len(call) < 2 or call[1] not in AGGREGATES + SCALARS:
                raise BadQuery(f"Invalid function {call}")
        if any(c[1] in AGGREGATES for c in calls) or group:
            return self.page(self.grouped(listed, group))
        if not listed:
            listed = [f.name for f in self.output_fields()]
        out = []
        for x in listed:
            if isinstance(x, list):
                out.append(self.scalar(x).alias(x[1]))
            elif x == "path" and self.entity.name == "fact_contents" and self.compiler.options.get("presented"):
                out.append(typed_path().alias(x))
            else:
                out.append(self.lookup(x, "projectable")[0].alias(rewrite.checked_name(x)))
        self.df = self.page(self.df)
        return self.df.select(*out)

    def grouped(self, listed: list, group: list | None) -> DataFrame:
        keys: dict[str, tuple[Column, bool]] = {}
        for g in (group or ["group_by"])[1:]:
            if isinstance(g, list):
                keys[g[1]] = (self.scalar(g), False)
            elif g in SCALARS and (call := next((x for x in listed if isinstance(x, list) and x[1] == g), None)):
                keys[g] = (self.scalar(call), False)
            else:
                c, kind = self.lookup(g, "projectable")
                json_kind = kind in ("value", "dotted")
                keys[g] = (jsonv.canonical(c) if json_kind else c, json_kind)
        aggregates, order = [], []
        for x in listed:
            name = x[1] if isinstance(x, list) else x
            if name in order:
                raise BadQuery(f"'{name}' is extracted twice")
            order.append(name)
            if isinstance(x, list) and x[1] in AGGREGATES:
                aggregates.append(self.aggregate(x).alias(x[1]))
            elif name not in keys:
                raise BadQuery(f"'{name}' must be in group_by or inside a function")
        named = self.df.groupBy(*[c.alias(f"key {n}") for n, (c, _) in keys.items()])
        out = named.agg(*aggregates) if aggregates else named.agg(F.count(F.lit(1)).alias("rows of a group"))
        back = {n: (F.try_parse_json(F.col(f"`key {n}`")) if json_kind else F.col(f"`key {n}`")).alias(rewrite.checked_name(n)) for n, (_, json_kind) in keys.items()}
        return out.select(*[back[n] if n in keys else F.col(n) for n in order])

    def page(self, df: DataFrame) -> DataFrame:
        order, limit, offset = self.paging.get("order_by"), self.paging.get("limit"), self.paging.get("offset")
        if order is not None:
            df = df.orderBy(*[self.ordering(x, df) for x in (order if isinstance(order, list) else [order])])
        if offset is not None:
            if isinstance(offset, bool) or not isinstance(offset, int) or offset < 0:
                raise BadQuery(f"offset is a whole number from 0 on, not {offset!r}")
            df = df.offset(offset)
        if limit is not None:
            if isinstance(limit, bool) or not isinstance(limit, int) or limit <= 0:
                raise BadQuery(f"limit is a whole number from 1 on, not {limit!r}")
            df = df.limit(limit)
        return df

    def ordering(self, item, df: DataFrame) -> Column:
        """PostgreSQL's order: nulls are largest."""
        name, way = item if isinstance(item, list) and len(item) == 2 else (item[0] if isinstance(item, list) else item, "asc")
        if way not in ("asc", "desc"):
            raise BadQuery(f"order_by goes asc or desc, not {way!r}")
        if name in df.columns and not self.entity.find(name):
            c, kind = F.col(f"`{name}`"), "string"
        else:
            c, kind = self.lookup(name)
        if kind in ("value", "dotted"):
            c = jsonv.canonical(c)
        return c.asc_nulls_last() if way == "asc" else c.desc_nulls_first()
