"""URL filter: pattern rules indexed by their rarest literal token, in native Spark expressions.

Each rule is a regular expression over host and path joined. The literal tokens that every match
must contain whole are read from the rule; the one that is rarest in the urls' own token counts
becomes its index key. A url's tokens fetch candidate rules from the index and only those run.

The index is a hash table in one literal: an array of BUCKETS_PER_RULE buckets a rule, in which a rule
lies in the bucket of its token's CRC-32. A url's token reads one bucket, whatever the number of rules.

Edge cases: a null url, or one without ``://``, has empty host and path, fits no rule and gets the
default verdict; empty tables give empty results; repeated rows are judged one by one; ties between
fitting rules go to the longer rule, then the larger name; extra columns pass through untouched, and
those that are called like a result (host, path, rule, verdict) get the ending _given.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

BUCKETS_PER_RULE = 2
RESULTS = ("host", "path", "rule", "verdict")
RULE = "struct<token:string,listed:int,length:int,name:string,verdict:string,regex:string>"
TOKEN_BREAK = r"[^A-Za-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """name and verdict of a rule; tokens: literals that every matching url holds as whole tokens."""

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    listed: bool = True


def host_path_rule(verdict: str, text: str) -> Rule:
    """A rule such as ``example.com/en/``: that host or a subdomain, and a path that starts so."""
    host, slash, path = text.partition("/")
    path = slash + path
    whole = re.split(TOKEN_BREAK, host + path)
    if re.fullmatch(r".*[A-Za-z0-9]", path) or not path:  # the last token may go on in the url
        whole = whole[:-1]
    regex = rf"^(?:[^/]*\.)?{re.escape(host)}" + (re.escape(path) if path else r"(?:/|$)")
    return Rule(text, verdict, regex, tuple(dict.fromkeys(t for t in whole if t)))


def pattern_rule(name: str, verdict: str, regex: str, tokens: Sequence[str]) -> Rule:
    """A free regular expression of the method itself; it decides only where no listed rule fits."""
    return Rule(name, verdict, regex, tuple(tokens), listed=False)


#: The method's own patterns: hosts or path parts of link farms and adult or gambling sites.
DEFAULT_PATTERNS = tuple(
    pattern_rule(f"pattern:{word}", "block", rf"(?:^|[./_-]){word}(?:[./_-]|$)", re.split(TOKEN_BREAK, word))
    for word in ("spam-farm", "casino", "porn", "xxx", "viagra", "warez")
)


def host_of(url: Column) -> Column:
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    return F.coalesce(lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def token_counts(pages: DataFrame, url: str, words: Sequence[str]) -> dict[str, int]:
    """How many urls hold each of the rules' tokens: at most one row a token comes to the driver."""
    if not words:
        return {}
    tokens = F.array_distinct(F.split(F.concat(host_of(F.col(url)), path_of(F.col(url))), TOKEN_BREAK))
    wanted = pages.sparkSession.createDataFrame([(w,) for w in words], "token string")  # as many as the rules hold
    found = pages.select(F.explode(tokens).alias("token")).join(F.broadcast(wanted), "token", "left_semi")
    counts = {r["token"]: r["count"] for r in found.groupBy("token").count().collect()}
    return {w: counts.get(w, 0) for w in words}


def _entry(token: str, r: Rule) -> dict:
    return {"token": token, "listed": int(r.listed), "length": len(r.name), "name": r.name, "verdict": r.verdict, "regex": r.regex}


def _literal(value: list, kind: str) -> Column:
    """A constant of any type; the optimiser reads the text once, before the query runs."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def judge_urls(pages: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to every row of pages; no shuffle but for the token counts.

    rule is the longest listed rule that fits, else null; verdict is that rule's, else block where
    one of the method's own patterns matches, else default.
    """
    clash = {c: f"{c}_given" for c in pages.columns if c.lower() in RESULTS}
    pages, url = pages.withColumnsRenamed(clash), clash.get(url, url)
    choices = sorted({t for r in rules for t in r.tokens if len(r.tokens) > 1})
    counts = token_counts(pages, url, choices)
    n = max(1, BUCKETS_PER_RULE * len(rules))
    buckets: list[list[dict]] = [[] for _ in range(n)]
    always: list[dict] = []
    for r in rules:
        if r.tokens:
            token = min(r.tokens, key=lambda t: (counts.get(t, 0), t))
            buckets[zlib.crc32(token.encode()) % n].append(_entry(token, r))
        else:
            always.append(_entry("", r))
    target = F.concat(F.col("host"), F.col("path"))
    index = _literal(buckets, f"array<array<{RULE}>>")

    def fetch(token: Column) -> Column:
        bucket = F.element_at(index, (F.crc32(token.cast("binary")) % n + 1).cast("int"))
        return F.filter(bucket, lambda r: r["token"] == token)

    fetched = F.flatten(F.transform(F.array_distinct(F.split(target, TOKEN_BREAK)), fetch))
    if always:
        fetched = F.concat(fetched, _literal(always, f"array<{RULE}>"))
    fits = F.filter(fetched, lambda r: F.rlike(target, r["regex"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(*[r[c].alias(c) for c in ("listed", "length", "name", "verdict")])))
    return (
        pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
        .withColumn("_best", best)
        .withColumn("rule", F.when(F.col("_best.listed") == 1, F.col("_best.name")))
        .withColumn("verdict", F.coalesce(F.col("_best.verdict"), F.lit(default)))
        .drop("_best")
    )


def keep_allowed(pages: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """The filter itself: rows whose verdict is allow, with their columns as they were."""
    columns = pages.columns
    renamed = pages.toDF(*[f"_{i}" for i in range(len(columns))])
    judged = judge_urls(renamed, rules, f"_{columns.index(url)}")
    return judged.where("verdict = 'allow'").select(*[f"_{i}" for i in range(len(columns))]).toDF(*columns)


LISTED = (
    host_path_rule("allow", "com/"),
    host_path_rule("block", "example.com/en/"),
    host_path_rule("allow", "www.example.com/en/"),
    host_path_rule("block", "net/es/"),
    host_path_rule("block", "net/fr/"),
)
