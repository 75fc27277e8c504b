"""URL filter with pattern rules indexed by their rarest literal token.

A rule is a host and a path (it fits the host and its subdomains, if the path starts
with the rule's) or a wildcard pattern over ``host + path``.  Each rule becomes one
regular expression and the set of literal tokens any URL it fits must hold; it is
filed under the one of them that is rarest in the URLs.  A URL looks up its own
tokens, each in one slot of a hash table or in a joined table, and runs only the regular
expressions filed there.  All of it is column expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, LOWER

#: Rules up to this number are looked up in a hash table inside the expression; more are joined by token.
INLINE_RULES = 500
_ROW = "struct<first:boolean,size:int,turn:int,name:string,action:string,regex:string>"
ALNUM = frozenset(f"{UPPER}{LOWER}0123456789")


@dataclass(frozen=True)
class Rule:
    """``action`` is allow or block; ``name`` tells the rule in results; the longest ``name`` that fits wins."""

    action: str
    name: str
    regex: str
    tokens: tuple[str, ...]


def host_rule(action: str, host: str, path: str = "/") -> Rule:
    tokens = re.findall("[a-z0-9]+", _folded(host)) + _whole(path)
    return Rule(action, host + path, rf"(?s)\A(?:[^\x00]*\.)?{_quoted(_folded(host))}\x00{_quoted(path)}", tuple(tokens))


def pattern_rule(action: str, pattern: str) -> Rule:
    """``*`` stands for anything; the rest is literal and may be anywhere in ``host + path``, A-Z folded."""
    parts = pattern.split("*")
    tokens = [t for x in parts for t in _whole(x)]
    return Rule(action, pattern, "(?is)" + ".*".join(map(_quoted, parts)), tuple(tokens))


def _quoted(text: str) -> str:
    return "".join(c if c in ALNUM else f"\\x{{{ord(c):x}}}" for c in text)


def _whole(literal: str) -> list[str]:
    """The runs of letters and digits with a separator on both sides inside the literal: a URL holds them as whole tokens."""
    return [m[0] for m in re.finditer("[a-z0-9]+", _folded(literal)) if m.start() > 0 and m.end() < len(literal)]


def _folded(text: str) -> str:
    return text.translate(str.maketrans(UPPER, LOWER))


#: What judges a URL that no host rule fits: signs of advertising, tracking and downloads.
DEFAULT_PATTERNS = tuple(pattern_rule("block", p) for p in ("/ads/", "/adserver/", "/banner/", "/track/", "/tracking/", "/casino/", "/porn/", "/xxx/", "-casino-", "-porn-", "/spam-farm.", ".spam-farm.", "/login/", "/logout/", "/cart/"))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z folded) and path; both empty without ``://``."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)


def tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.translate(F.concat_ws("/", host, path), UPPER, LOWER), "[^a-z0-9]+"), lambda t: t != ""))


def _index(seen: DataFrame, rules: tuple[Rule, ...]) -> dict[str, list[int]]:
    """Rule numbers by token; a rule without a literal token is filed under the empty token and always runs."""
    wanted = sorted({t for r in rules for t in r.tokens})
    often = dict(seen.select(F.explode(F.array_intersect("tokens", F.array(*map(F.lit, wanted)))).alias("t")).groupBy("t").count().collect()) if wanted else {}
    index: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        index.setdefault(min(r.tokens, key=lambda t: (often.get(t, 0), t), default=""), []).append(i)
    return index


def _slot(token: Column, slots: int) -> Column:
    """Spark's xxhash64 is XXH64 with seed 42; ``slots`` is a power of two."""
    return F.pmod(F.xxhash64(token), F.lit(slots)).cast("int")


def _fetched(tokens: Column, index: dict[str, list[int]], every: tuple[Rule, ...], rules: int) -> Column:
    """The rules filed under a URL's tokens: each token reads one slot of an array and a map of the few tokens that share it."""
    row = lambda i: (i < rules, len(every[i].name), -i, every[i].name, every[i].action, every[i].regex)
    struct = lambda x: F.struct(*[F.lit(v).alias(n) for v, n in zip(x, ("first", "size", "turn", "name", "action", "regex"), strict=True)])
    listed = lambda at: F.array(*[struct(row(i)) for i in at]).cast(f"array<{_ROW}>")
    always, filed = listed(index.get("", [])), sorted(t for t in index if t)
    if not filed:
        return always
    slots = 1 << len(filed).bit_length()
    shared: list[list[Column]] = [[] for _ in range(slots)]
    for t in filed:
        shared[xxhash.xxh64_intdigest(t.encode(), 42) % slots] += [F.lit(t), listed(index[t])]
    table = F.array(*[F.create_map(*x) if x else F.create_map().cast(f"map<string,array<{_ROW}>>") for x in shared])
    found = F.transform(tokens, lambda t: F.try_element_at(F.get(table, _slot(t, slots)), t))
    return F.concat(always, F.flatten(F.filter(found, lambda x: x.isNotNull())))


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...], patterns: tuple[Rule, ...] = DEFAULT_PATTERNS, url: str = "url", inline: int = INLINE_RULES) -> DataFrame:
    """``pages`` with host, path, rule, verdict and pattern (they replace such columns of the input, others stay whatever their names).

    ``rule`` is the longest of ``rules`` that fits, else null; without one ``verdict`` is
    the action of the longest fitting one of ``patterns`` (named in ``pattern``), else
    allow.  Null, empty and schemeless URLs have an empty host and path, which no host
    rule fits.  Of rules equally long the first listed wins; repeated rows are judged
    alike; an empty table or no rules work.
    """
    every = (*rules, *patterns)
    host, path = split_url(F.col(url))
    out = pages.select(F.struct("*").alias("row"), host.alias("host"), path.alias("path")).withColumn("tokens", tokens(F.col("host"), F.col("path")))
    mine = [F.col("row")[c].alias(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict", "pattern")]
    if not every:
        return out.select(*mine, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"), F.lit(None).cast("string").alias("pattern"))
    index = _index(out, every)
    plain = F.concat(F.lit("/"), "host", "path")  # patterns see the host's start as a separator
    strict = F.concat("host", F.lit("\0"), "path")
    if len(every) <= inline:
        asked = _fetched(F.col("tokens"), index, every, len(rules))
        out = out.withColumn("fit", F.array_max(F.filter(asked, lambda r: F.when(r["first"], F.rlike(strict, r["regex"])).otherwise(F.rlike(plain, r["regex"])))))
    else:
        table = pages.sparkSession.createDataFrame(
            [(t, i < len(rules), len(every[i].name), -i, every[i].name, every[i].action, every[i].regex) for t, at in index.items() for i in at],
            "token string, first boolean, size int, turn int, name string, action string, regex string",
        )
        urls = out.select("host", "path", "tokens").distinct()
        found = (
            urls.withColumn("token", F.explode(F.concat("tokens", F.array(F.lit(""))))).join(table, "token")
            .filter(F.when(F.col("first"), F.rlike(strict, F.col("regex"))).otherwise(F.rlike(plain, F.col("regex"))))
            .groupBy(F.col("host").alias("f_host"), F.col("path").alias("f_path")).agg(F.max(F.struct("first", "size", "turn", "name", "action", "regex")).alias("fit"))
        )
        out = out.join(found, (F.col("host") == F.col("f_host")) & (F.col("path") == F.col("f_path")), "left")
    fit = F.col("fit")
    name = lambda first: F.when(fit["first"] == first, fit["name"])
    return out.select(*mine, "host", "path", name(True).alias("rule"), F.coalesce(fit["action"], F.lit("allow")).alias("verdict"), name(False).alias("pattern"))
