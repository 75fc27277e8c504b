"""Regular expressions as the query languages write them, in Java's dialect."""

from __future__ import annotations

import re

from ..errors import BadQuery

#: POSIX classes and Java's names for them.
POSIX = {
    "alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "space": r"\s",
    "blank": r"\p{Blank}", "punct": r"\p{Punct}", "cntrl": r"\p{Cntrl}", "graph": r"\p{Graph}", "print": r"\p{Print}", "xdigit": r"\p{XDigit}",
}


def java_regex(pattern: str) -> str:
    """``[[:digit:]]`` becomes ``[\\p{Digit}]``, ``\\m \\M \\y`` become word boundaries; patterns that cannot compile are refused now rather than on executors."""

    def posix(found: re.Match) -> str:
        if found[1] not in POSIX:
            raise BadQuery(f"Invalid regular expression: unknown class {found[0]}")
        return POSIX[found[1]]

    out = re.sub(r"\[:(\w+):\]", posix, pattern)
    out = re.sub(r"(?<!\\)((?:\\\\)*)\\([mMy])", r"\1\\b", out)
    depth, escaped, in_class = 0, False, False
    for c in out:
        if escaped:
            escaped = False
        elif c == "\\":
            escaped = True
        elif c == "[":
            in_class = True
        elif c == "]":
            in_class = False
        elif not in_class:
            depth += (c == "(") - (c == ")")
            if depth < 0:
                break
    if depth or escaped or in_class or re.match(r"[*+?]", out):
        raise BadQuery(f"Invalid regular expression: {pattern}")
    return out
