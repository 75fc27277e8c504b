"""Field paths (``facts.os."a.b".c[1].match("x")``) and encoded fact paths (``a#~b#~0``)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import BadQuery

#: What joins the parts of an encoded path, and the longest projected name.
DELIMITER, LONGEST_NAME = "#~", 63

_TOP = re.compile(r"[a-zA-Z][_0-9a-zA-Z]*\??(?=\.|$)")
_QUOTED = re.compile(r'"(.*?[^\\])"(?=\.|$)', re.DOTALL)
_MATCH = re.compile(r'match\("(.*?[^\\])"\)(?=\.|$)', re.DOTALL)
_PLAIN = re.compile(r"[^.]+(?=\.|$)")
_INDEXED = re.compile(r"(.+)\[(\d+)\]", re.DOTALL)


@dataclass(frozen=True)
class Part:
    """``kind`` is name, index (a name and a place in its array) or match (a regular expression)."""

    kind: str
    name: str
    index: int | None = None


def _named(text: str) -> Part:
    if found := _INDEXED.fullmatch(text):
        return Part("index", found[1], int(found[2]))
    return Part("name", text)


def parse_field(text: str) -> list[Part]:
    top = _TOP.match(text)
    if not top:
        raise BadQuery(f"Invalid field path: {text}")
    parts, at = [Part("name", top[0])], top.end()
    while at < len(text):
        at += 1  # the dot
        if found := _MATCH.match(text, at):
            parts.append(Part("match", found[1]))
        elif found := _QUOTED.match(text, at):
            parts.append(_named(found[1]))
        elif found := _PLAIN.match(text, at):
            parts.append(_named(found[0]))
        else:
            raise BadQuery(f"Invalid field path: {text}")
        at = found.end()
    return parts


def format_field(parts: list[Part]) -> str:
    out = []
    for i, p in enumerate(parts):
        name = f'match("{p.name}")' if p.kind == "match" else f'"{p.name}"' if i and "." in p.name else p.name
        out.append(name if p.index is None else f"{name}[{p.index}]")
    return ".".join(out)


#: How a delimiter inside a key is written, and how it is read back; both halves get one more backslash.
ESCAPE = (r"(\\?#)(\\*~)", r"\\\1\\\2")
UNESCAPE = (r"(\\*)\\#(\\*)\\~", r"\1#\2~")


def encode_path(parts: list) -> str:
    """An encoded path: array places as they are, keys of digits quoted, the delimiter escaped."""
    out = []
    for p in parts:
        if isinstance(p, bool) or not isinstance(p, (int, str)):
            raise BadQuery(f"Path elements are strings or integers, not {p!r}")
        quoted = f'"{p}"' if isinstance(p, str) and re.fullmatch(r"[0-9]+", p) else str(p)
        out.append(re.sub(*ESCAPE, quoted))
    return DELIMITER.join(out)


def decode_path(text: str) -> list:
    def part(x: str):
        if re.fullmatch(r"[0-9]+", x):
            return int(x)
        return x[1:-1] if re.fullmatch(r'"[0-9]+"', x) else re.sub(*UNESCAPE, x)

    return [part(x) for x in text.split(DELIMITER)]


def java_replacement(text: str) -> str:
    """A replacement with Python's group numbers as Java writes it."""
    return re.sub(r"\\(\d)", r"$\1", text)


def path_regex(parts: list) -> str:
    """An anchored expression over encoded paths; a part's dots do not cross the delimiter."""
    one = [re.sub(r"(?<!\\)\.([*+])", r"(?:(?!#~).)\1", str(p)) for p in parts]
    return "^" + "#~".join(one) + "$"
