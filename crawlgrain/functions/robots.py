"""robots.txt: parsing (one small Arrow function per host) and decisions (columns)."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlgrain.schemas import PARSED_ROBOTS

_TYPE = pa.struct([
    ("groups", pa.list_(pa.struct([("user_agents", pa.list_(pa.string())), ("rules", pa.list_(pa.struct([("allow", pa.bool_()), ("path", pa.string())])))]))),
    ("sitemaps", pa.list_(pa.string())),
    ("crawl_delay", pa.float64()),
])


_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")
# Kinds of lines, a letter each: U names an agent, R is a rule, B is blank.
_KINDS = {"user-agent": "U", "allow": "R", "disallow": "R"}
#: A group: rules that stand before any agent and the agent after them, or some agents; then rules up to a blank line.
_GROUP = re.compile(r"(?:B*R)+B*UR*|U+R*")


def parse_text(text: str | None) -> dict:
    """Groups, sitemaps and the smallest crawl delay of a file.

    Lines become (name, value) pairs; groups are found in the sequence of their kinds.
    Blank and comment-only lines end a group, fields that nobody knows don't.
    """
    lines = [line.partition("#")[0].strip() for line in (text or "").splitlines()]
    cut = [line.partition(":") for line in lines]
    pairs = [(name.strip().lower(), value.strip()) if colon else ("", "") for name, colon, value in cut if colon or not name]
    told = [p for p in pairs if p[0] in _KINDS or p == ("", "")]
    kinds = "".join(_KINDS.get(name, "B") for name, _ in told)

    def group(fields: list[tuple[str, str]]) -> dict:
        return {"user_agents": [v.lower() for n, v in fields if n == "user-agent"], "rules": [{"allow": n == "allow", "path": v} for n, v in fields if _KINDS.get(n) == "R"]}

    return {
        "groups": [group(told[m.start() : m.end()]) for m in _GROUP.finditer(kinds)],
        "sitemaps": [v for n, v in pairs if n == "sitemap"],
        "crawl_delay": min((float(v) for n, v in pairs if n == "crawl-delay" and _NUMBER.fullmatch(v)), default=None),
    }


def _parse(body: pa.Array) -> pa.Array:
    return pa.array([parse_text(x) for x in body.to_pylist()], _TYPE)


def parse(body: Column) -> Column:
    """Parsed robots of a column of texts, in one Arrow function."""
    return F.arrow_udf(_parse, PARSED_ROBOTS)(body)


def for_status(status: Column, body: Column) -> Column:
    """The file that holds for a response: 200 its text, 401 and 403 everything blocked, else nothing."""
    return parse(F.when(status == 200, body).when(status.isin(401, 403), F.lit("User-agent: *\nDisallow: /")).otherwise(F.lit("")))


def pattern(rule: Column) -> Column:
    """A rule's path as an anchored regular expression: * is any run, a last $ the end."""
    end = rule.endswith("$")
    body = F.when(end, F.substring(rule, F.lit(1), F.length(rule) - 1)).otherwise(rule)
    quoted = F.transform(F.split(body, r"\*"), lambda x: F.regexp_replace(x, r"([\\.\[\]{}()+?^$|*])", r"\\$1"))
    return F.concat(F.lit("^"), F.array_join(quoted, ".*"), F.when(end, "$").otherwise(""))


def decoded(p: Column) -> Column:
    """Percent-decoded, or as it is where that fails; a plus stays a plus."""
    return F.coalesce(F.try_url_decode(F.replace(p, F.lit('+'), F.lit('%2B'))), p)


def allowed(robots: Column, url_path: Column, agent: Column, reference: bool = False) -> Column:
    """Whether an agent may fetch a path: the longest matching rule holds, allow wins ties, none allows.

    RFC 9309: `*` groups hold only where no group names the agent, and an empty path
    restricts nothing. reference: `*` groups always join, an empty path matches all.
    """
    ua = F.lower(agent)
    named = lambda g: F.exists(g["user_agents"], lambda p: (p != "*") & (p != "") & ua.startswith(p))
    star = lambda g: F.array_contains(g["user_agents"], F.lit("*"))
    groups = robots["groups"]
    if reference:
        mine = F.filter(groups, lambda g: star(g) | named(g))
    else:
        own = F.filter(groups, named)
        mine = F.when(F.size(own) > 0, own).otherwise(F.filter(groups, star))
    rules = F.flatten(F.transform(mine, lambda g: g["rules"]))
    p = decoded(url_path)
    hit = F.filter(rules, lambda r: F.rlike(p, pattern(decoded(r["path"]))) & (F.lit(reference) | (r["path"] != "")))
    ranked = F.transform(hit, lambda r: F.struct(F.length(F.replace(decoded(r["path"]), F.lit("*"), F.lit(""))).alias("n"), r["allow"].alias("allow")))
    return F.coalesce(F.array_max(ranked)["allow"], F.lit(True))
