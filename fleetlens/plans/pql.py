"""The text query language, parsed by recursive descent into the JSON prefix form.

``entity[projection]{ filter modifiers }``; ``!`` binds tighter than ``and``, and ``and``
tighter than ``or``.  Each clause of a filter, each subquery and each modifier has one
method here; the results are plain lists.
"""

from __future__ import annotations

import json
import re

from ..errors import BadQuery

#: Fixed values of the language.
ENTITIES = ("facts", "reports", "catalogs", "packages", "package_inventory", "resources", "nodes", "environments", "factsets", "fact_paths", "fact_contents", "inventory", "edges", "events")
FUNCTIONS = ("count", "avg", "sum", "min", "max", "to_string")
DOTTED = ("facts", "trusted", "parameters")

_ENTITY = re.compile("(" + "|".join(sorted(ENTITIES, key=len, reverse=True)) + r")(?=[\s\[{])")
_FUNCTION = re.compile("(" + "|".join(FUNCTIONS) + r")\s*\(")
_STEP = re.compile(r'\.(?:"(?:.*?)"(?=\.|\s)|match\(.*?\)|[^\s."\[\]!<=>~,(){}]+(?:\[\d+\])?)')
_FIELD = re.compile(r"[a-zA-Z0-9_]+\??")
_OPERATOR = re.compile(r"~>|!~|!=|>=|<=|[~<>=]|in(?=[\s\[])|is not null\b|is null\b")
_NUMBER = re.compile(r"-?\d+(?:\.\d+(?:[eE][-+]?\d+)?)?")


class Parser:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def fail(self, wanted: str):
        line = self.text.count("\n", 0, self.at) + 1
        column = self.at - (self.text.rfind("\n", 0, self.at) + 1) + 1
        raise BadQuery(f"PQL parse error at line {line}, column {column}: expected {wanted}")

    def space(self) -> bool:
        start = self.at
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1
        return self.at > start

    def peek(self, literal: str) -> bool:
        return self.text.startswith(literal, self.at)

    def take(self, literal: str) -> bool:
        if self.peek(literal):
            self.at += len(literal)
            return True
        return False

    def need(self, literal: str) -> None:
        if not self.take(literal):
            self.fail(repr(literal))

    def match(self, pattern: re.Pattern) -> re.Match | None:
        found = pattern.match(self.text, self.at)
        if found:
            self.at = found.end()
        return found

    def word(self, word: str) -> bool:
        """A keyword with white space on both sides (the one before was skipped)."""
        found = re.compile(word + r"(?=\s)").match(self.text, self.at)
        if not found or not self.text[self.at - 1].isspace():
            return False
        self.at = found.end()
        return True

    def query(self) -> list:
        self.space()
        out = self.source()
        self.space()
        if self.at < len(self.text):
            self.fail("end of query")
        return out

    def source(self) -> list:
        name = self.match(_ENTITY)
        if not name:
            self.fail("an entity")
        self.space()
        fields = self.projection() if self.peek("[") else None
        self.space()
        expression, modifiers = self.braces()
        grouped = [m for m in modifiers if m[0] == "group_by"]
        paging = [m for m in modifiers if m[0] != "group_by"]
        if grouped and paging:
            self.fail("either group by or paging clauses")
        body = [expression] if expression is not None else []
        if fields is not None:
            return ["from", name[1], ["extract", fields, *body, *grouped], *paging]
        return ["from", name[1], *body, *grouped, *paging]

    def projection(self) -> list:
        self.need("[")
        self.space()
        out = [] if self.peek("]") else self.fields(functions=True)
        self.space()
        self.need("]")
        return out

    def listed(self, item) -> list:
        out = [item()]
        while True:
            start = self.at
            self.space()
            if not self.take(","):
                self.at = start
                return out
            self.space()
            out.append(item())

    def fields(self, functions: bool) -> list:
        return self.listed(lambda: self.function() if functions and _FUNCTION.match(self.text, self.at) else self.field())

    def function(self) -> list:
        name = self.match(_FUNCTION)[1]
        self.space()
        out = ["function", name]
        if not self.peek(")"):
            out += self.listed(lambda: self.string() if self.text[self.at : self.at + 1] in ("'", '"') else self.field())
        self.space()
        self.need(")")
        return out

    def field(self) -> str:
        found = self.match(_FIELD)
        if not found:
            self.fail("a field")
        out = found[0]
        if out in DOTTED:
            while step := self.match(_STEP):
                out += step[0]
        return out

    def braces(self) -> tuple[list | None, list]:
        self.need("{")
        self.space()
        expression = None
        if not self.peek("}") and not self.modifier_ahead():
            expression = self.any_of()
        self.space()
        modifiers = []
        while not self.peek("}"):
            modifiers.append(self.modifier())
            self.space()
        self.need("}")
        return expression, modifiers

    def modifier_ahead(self) -> bool:
        return re.compile(r"(limit|offset)\s+\d|(order|group) by\s").match(self.text, self.at) is not None

    def modifier(self) -> list:
        for name in ("limit", "offset"):
            if found := self.match(re.compile(name + r"\s+(\d+)")):
                return [name, int(found[1])]
        if self.match(re.compile(r"order by\s+")):
            return ["order_by", self.listed(self.ordered)]
        if self.match(re.compile(r"group by\s+")):
            return ["group_by", *self.fields(functions=True)]
        return self.fail("'}' or a modifier")

    def ordered(self):
        field = self.field()
        found = self.match(re.compile(r"\s+(asc|desc)\b"))
        return [field, found[1]] if found else field

    def any_of(self):
        return self.chain("or", self.all_of)

    def all_of(self):
        return self.chain("and", self.negated)

    def chain(self, word: str, part) -> list:
        out = [part()]
        while True:
            start = self.at
            self.space()
            if not self.word(word):
                self.at = start
                return out[0] if len(out) == 1 else [word, *out]
            self.space()
            out.append(part())

    def negated(self):
        if self.peek("!") and not self.peek("!=") and not self.peek("!~"):
            self.at += 1
            self.space()
            return ["not", self.negated()]
        if self.take("("):
            self.space()
            out = self.any_of()
            self.space()
            self.need(")")
            return out
        if found := re.compile(_ENTITY.pattern[: _ENTITY.pattern.index("(?=")] + r"(?=\s*\{)").match(self.text, self.at):
            self.at = found.end()
            self.space()
            expression, modifiers = self.braces()
            return ["subquery", found[0], *([expression] if expression is not None else []), *modifiers]
        return self.condition()

    def condition(self) -> list:
        if self.peek("["):
            self.need("[")
            self.space()
            field = self.fields(functions=True)
            self.space()
            self.need("]")
            only_in = True
        else:
            field, only_in = self.field(), False
        self.space()
        found = self.match(_OPERATOR)
        if not found or (only_in and found[0] != "in"):
            self.fail("an operator")
        operator = found[0]
        if operator.startswith("is"):
            return ["null?", field, operator == "is null"]
        self.space()
        if operator == "in":
            if self.peek("["):
                return ["in", field, ["array", self.array()]]
            return ["in", field, self.source()]
        if operator == "~":
            return ["~", field, self.string()]
        if operator == "~>":
            self.need("[")
            self.space()
            out = self.listed(self.string)
            self.space()
            self.need("]")
            return ["~>", field, out]
        if operator in (">", "<", ">=", "<="):
            value = self.literal()
            if isinstance(value, (bool, list)):
                self.fail("a number or a string")
            return [operator, field, value]
        value = self.literal()
        return {"=": ["=", field, value], "!=": ["not", ["=", field, value]], "!~": ["not", ["~", field, value]]}[operator]

    def array(self) -> list:
        self.need("[")
        self.space()
        out = self.listed(self.literal)
        self.space()
        self.need("]")
        return out

    def string(self) -> str:
        if found := self.match(re.compile(r'"((?:[^"\\]|\\.)*)"', re.DOTALL)):
            return json.loads(f'"{found[1]}"', strict=False)
        if found := self.match(re.compile(r"'((?:[^'\\]|\\.)*)'", re.DOTALL)):
            return found[1].replace("\\'", "'")
        return self.fail("a string")

    def literal(self):
        if self.text[self.at : self.at + 1] in ("'", '"'):
            return self.string()
        if self.peek("["):
            return self.array()
        if found := self.match(re.compile(r"(true|false)\b")):
            return found[0] == "true"
        if found := self.match(_NUMBER):
            if "." in found[0]:
                return float(found[0])
            value = int(found[0])
            if not -(2**63) <= value < 2**63:
                self.fail("a 64-bit integer")
            return value
        return self.fail("a literal")


def parse_pql(text: str) -> list:
    return Parser(text).query()


def parse_query(text: str | list) -> list:
    """A query as prefix form; text that begins with ``[`` is JSON, other text the text language."""
    if not isinstance(text, str):
        return text
    if re.match(r"\s*\[", text):
        try:
            return json.loads(text)
        except ValueError as e:
            raise BadQuery(f"Malformed JSON for query: {e}") from e
    return parse_pql(text)
