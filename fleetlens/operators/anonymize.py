"""Masking that keeps equality: the same value always gets the same mask."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import java_regex


@dataclass(frozen=True)
class Rule:
    """Says whether values of ``column`` are masked where ``when`` (column to pattern) fits; the first rule that fits decides."""

    column: str
    masked: bool
    when: tuple[tuple[str, str], ...] = ()


#: Profiles: what is masked without a rule that says otherwise.
PROFILES: dict[str, tuple[Rule, ...]] = {
    "full": tuple(Rule(c, True) for c in ("certname", "title", "type", "value", "name", "message", "file", "source_title", "target_title", "parameters")),
    "moderate": (
        Rule("name", True, (("name", "(?i)password|secret|key"),)), Rule("name", False), Rule("type", False),
        *(Rule(c, True) for c in ("certname", "title", "value", "message", "file", "source_title", "target_title", "parameters")),
    ),
    "low": (Rule("value", True, (("name", "(?i)password|secret|key"),)), Rule("value", False), Rule("certname", True), Rule("message", True), Rule("parameters", True, (("title", "(?i)password|secret|key"),))),
    "none": (),
}


def mask(c: Column, salt: str) -> Column:
    return F.when(c.isNotNull(), F.substring(F.sha2(F.concat(F.lit(salt), c.cast("string")), 256), 1, 30))


def anonymize(rows: DataFrame, rules: tuple[Rule, ...] | str, salt: str) -> DataFrame:
    """``rows`` with masked string columns; JSON columns lose their values but not their keys' number."""
    rules = PROFILES[rules] if isinstance(rules, str) else rules
    out = {}
    for name, kind in rows.dtypes:
        mine = [r for r in rules if r.column == name]
        if not mine or kind not in ("string", "variant", "map<string,variant>"):
            continue
        c = F.col(f"`{name}`")
        if kind == "string":
            hidden = mask(c, salt)
        elif kind == "variant":
            hidden = F.parse_json(F.to_json(F.struct(mask(F.to_json(c), salt).alias("masked"))))
        else:
            hidden = F.transform_values(c, lambda k, v: F.parse_json(F.concat(F.lit('"'), mask(F.to_json(v), salt), F.lit('"'))))
        choice = c
        for r in reversed(mine):
            fits = F.lit(True)
            for other, pattern in r.when:
                fits = fits & (F.coalesce(F.col(f"`{other}`").rlike(java_regex(pattern)), F.lit(False)) if other in rows.columns else F.lit(False))
            choice = F.when(fits, hidden if r.masked else c).otherwise(choice)
        out[name] = choice
    return rows.withColumns(out) if out else rows
