"""Masks of ``to_string`` for timestamps and numbers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import BadQuery

#: Months as Roman numerals, and the parts of which Roman numerals are made.
ROMAN_MONTHS = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII")
ROMAN = (("M", 1000), ("CM", 900), ("D", 500), ("CD", 400), ("C", 100), ("XC", 90), ("L", 50), ("XL", 40), ("X", 10), ("IX", 9), ("V", 5), ("IV", 4), ("I", 1))
#: Names of months and days, by Spark's pattern and the width to which they are padded.
NAMES = {"MONTH": ("MMMM", 9), "DAY": ("EEEE", 9), "MON": ("MMM", 3), "DY": ("EEE", 3)}


def _ordinal(n: Column) -> Column:
    """st, nd, rd or th."""
    teen, last = (F.abs(n) % 100).between(11, 13), F.abs(n) % 10
    return F.when(teen, "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th")


def _iso_year(ts: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), ts)


def _seconds(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def _micros(ts: Column) -> Column:
    return F.pmod(F.unix_micros(ts), F.lit(1_000_000))


#: Numeric parts of a mask, by name, with their value and number of digits.
NUMBERS = {
    "YYYY": (F.year, 4), "YYY": (lambda t: F.year(t) % 1000, 3), "YY": (lambda t: F.year(t) % 100, 2), "Y": (lambda t: F.year(t) % 10, 1),
    "IYYY": (_iso_year, 4), "IYY": (lambda t: _iso_year(t) % 1000, 3), "IY": (lambda t: _iso_year(t) % 100, 2), "I": (lambda t: _iso_year(t) % 10, 1),
    "MM": (F.month, 2), "DDD": (F.dayofyear, 3), "DD": (F.day, 2), "D": (F.dayofweek, 1), "ID": (lambda t: F.weekday(t) + 1, 1),
    "IDDD": (lambda t: (F.weekofyear(t) - 1) * 7 + F.weekday(t) + 1, 3), "WW": (lambda t: F.floor((F.dayofyear(t) - 1) / 7) + 1, 2), "W": (lambda t: F.floor((F.day(t) - 1) / 7) + 1, 1), "IW": (F.weekofyear, 2),
    "CC": (lambda t: F.floor((F.year(t) - 1) / 100) + 1, 2), "J": (lambda t: F.datediff(t, F.lit("1970-01-01").cast("date")) + 2440588, 7), "Q": (F.quarter, 1),
    "HH24": (F.hour, 2), "HH12": (lambda t: F.pmod(F.hour(t) - 1, F.lit(12)) + 1, 2), "HH": (lambda t: F.pmod(F.hour(t) - 1, F.lit(12)) + 1, 2), "MI": (F.minute, 2), "SSSSS": (_seconds, 1), "SSSS": (_seconds, 1), "SS": (F.second, 2),
    "MS": (lambda t: F.floor(_micros(t) / 1000), 3), "US": (_micros, 6), "TZM": (lambda t: F.lit(0), 2),
    **{f"FF{i}": ((lambda t, i=i: F.floor(_micros(t) / 10 ** (6 - i))), i) for i in range(1, 7)},
}
#: Parts that are words, upper case; their own case decides that of the text.  Sessions are in UTC.
WORDS = {
    "A.D.": lambda t: F.lit("A.D."), "B.C.": lambda t: F.lit("A.D."), "AD": lambda t: F.lit("AD"), "BC": lambda t: F.lit("AD"),
    "A.M.": lambda t: F.when(F.hour(t) < 12, "A.M.").otherwise("P.M."), "P.M.": lambda t: F.when(F.hour(t) < 12, "A.M.").otherwise("P.M."),
    "AM": lambda t: F.when(F.hour(t) < 12, "AM").otherwise("PM"), "PM": lambda t: F.when(F.hour(t) < 12, "AM").otherwise("PM"),
    "TZH": lambda t: F.lit("+00"), "TZ": lambda t: F.lit("UTC"), "OF": lambda t: F.lit("+00"), "Y,YYY": lambda t: F.format_number(F.year(t), 0),
}
PARTS = sorted([*NUMBERS, *WORDS, *NAMES, "RM"], key=len, reverse=True)


def date_text(ts: Column, mask: str) -> Column:
    """Names follow the case of their mask; names are blank-padded and numbers zero-padded unless FM stands before them; TH after a number makes it an ordinal; quoted text stays."""
    out, at = [], 0
    while at < len(mask):
        if found := re.compile(r'"([^"]*)"').match(mask, at):
            out.append(F.lit(found[1]))
            at = found.end()
            continue
        bare = mask[at : at + 2].upper() == "FM"
        start = at + 2 * bare
        part = next((p for p in PARTS if mask[start : start + len(p)].upper() == p), None)
        if part is None:
            if mask[at].isalpha():
                raise BadQuery(f"to_string: mask {mask!r} is not supported at {mask[at:]!r}")
            out.append(F.lit(mask[at]))
            at += 1
            continue
        written, at = mask[start : start + len(part)], start + len(part)
        cased = lambda c, w=written: F.upper(c) if w.isupper() else F.lower(c) if w.islower() else c
        if part in NAMES:
            pattern, width = NAMES[part]
            text = cased(F.date_format(ts, pattern))
            out.append(text if bare else F.rpad(text, width, " "))
        elif part == "RM":
            text = cased(F.get(F.array(*map(F.lit, ROMAN_MONTHS)), F.month(ts) - 1))
            out.append(text if bare else F.rpad(text, 4, " "))
        elif part in WORDS:
            out.append(cased(WORDS[part](ts)) if written.islower() else WORDS[part](ts))
        else:
            value, digits = NUMBERS[part][0](ts).cast("bigint"), NUMBERS[part][1]
            text = value.cast("string")
            out.append(text if bare or digits == 1 else F.lpad(text, digits, "0"))
            if mask[at : at + 2].upper() == "TH":
                suffix = _ordinal(value)
                out.append(F.upper(suffix) if mask[at : at + 2].isupper() else suffix)
                at += 2
    return F.concat(*out) if out else F.lit("")


def _roman(n: Column) -> Column:
    out, rest = [], n.cast("int")
    for letters, value in ROMAN:
        out.append(F.repeat(F.lit(letters), F.floor(rest / value).cast("int")))
        rest = rest % value
    return F.when(n.between(1, 3999), F.concat(*out)).otherwise(F.lit("#" * 15))


def number_text(number: Column, mask: str) -> Column:
    """Masks of 9 and 0 with a point (``.`` or D) and groups (``,`` or G), with one of S, SG, PL, MI and PR for the sign, V, EEEE, TH or RN; FM leaves the padding out."""
    bare, body = mask.upper().startswith("FM"), mask[2:] if mask.upper().startswith("FM") else mask
    if body.upper() == "RN":
        text = F.upper(_roman(number)) if body.isupper() else F.lower(_roman(number))
        return text if bare else F.lpad(text, 15, " ")
    found = re.fullmatch(r"(S|SG|PL|MI)?([09,G]+(?:[.D][09]*)?)(?:V(9+))?(EEEE)?(TH)?(S|SG|PL|MI|PR)?", body, re.IGNORECASE)
    if not found or found[1] and found[6] or found[4] and (found[3] or found[5]):
        raise BadQuery(f"to_string: mask {mask!r} is not supported for numbers")
    digits, places = found[2].upper().replace("G", ",").replace("D", "."), len(re.split("[.D]", found[2].upper() + ".")[1])
    sign, after = (found[1] or found[6] or "").upper(), bool(found[6])
    n = number.cast("decimal(38,10)")
    if found[3]:
        n, digits = (n * 10 ** len(found[3])).cast("decimal(38,10)"), digits + found[3]
    low = n < 0
    if found[4]:
        text = F.format_string(f"%.{places}e", F.abs(number.cast("double")))
    else:
        text = F.ltrim(F.to_char(F.round(F.abs(n), places).cast(f"decimal(38,{places})"), F.lit(digits)))
    if bare and "." in digits and digits.rstrip()[-1] == "9":  # what 9 stands for is left out where it is nothing
        text = F.regexp_replace(text, "0+$", "")
    if found[5]:
        text = F.concat(text, F.when(low, "").otherwise(_ordinal(n.cast("bigint"))))
    mark = {"": F.when(low, "-").otherwise(""), "S": F.when(low, "-").otherwise("+"), "SG": F.when(low, "-").otherwise("+"), "PL": F.when(low, "-").otherwise("+"), "MI": F.when(low, "-").otherwise("" if bare else " ")}
    if sign == "PR":
        text = F.when(low, F.concat(F.lit("<"), text, F.lit(">"))).otherwise(text if bare else F.concat(F.lit(" "), text, F.lit(" ")))
        width = len(digits) + 2
    else:
        text = F.concat(text, mark[sign]) if after else F.concat(mark[sign], text)
        width = len(digits) + 1
    return text if bare or found[4] else F.when(F.length(text) < width, F.lpad(text, width, " ")).otherwise(text)
