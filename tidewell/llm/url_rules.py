"""URL filters: pattern rules indexed by their rarest literal token.

A pattern rule is a regular expression with the literal tokens (runs of letters and digits) that any match must hold
as whole tokens of the URL. Each rule is filed under the one of its tokens that fewest URLs hold, counted over all
URLs. A URL's tokens fetch the rules filed under them, and only those rules' expressions run.

Site rules (host, path, verdict) come first: a rule fits its host and all subdomains where the URL's path starts with
the rule's; the longest one that fits decides, and pattern rules judge the rest.

Plan: one pass counts the rules' tokens (a partial aggregate with a row for each token of a rule); the second pass is
a projection without any shuffle. Both indexes are constant arrays of buckets in the plan, addressed by hash, so a token
costs one array access however many rules there are. The rules are parameters of the query, at most ``MAX_RULES``.

Defined results: host and path of a null URL or of one without ``://`` are empty, and no site rule fits it; pattern
rules see a null URL as empty; equal URLs get equal verdicts; very long URLs are judged
whole; a page's own columns come inside ``row``, so no name clashes; an empty table gives no row.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

MAX_RULES = 100_000


@dataclass(frozen=True)
class SiteRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    pattern: str
    tokens: tuple[str, ...]
    verdict: str = "block"


SITE_RULES = (SiteRule("net", "/", "block"), SiteRule("example.net", "/en/", "allow"), SiteRule("example.com", "/de/", "block"), SiteRule("org", "/fr/", "allow"))

PATTERN_RULES = (
    PatternRule(r"^[a-z]+://([^/?#]*\.)?spam-farm\.", ("spam", "farm")),
    PatternRule(r"://[^/?#]*\bcasino\b", ("casino",)),
    PatternRule(r"[?&]utm_source=feed(&|#|$)", ("utm", "source", "feed")),
    PatternRule(r"/ads?/banner\b", ("banner",)),
    PatternRule(r"://[^/?#]*\bbuy-(pills|followers)\b", ("buy",)),
    PatternRule(r"/(trackback|xmlrpc)\.php(\?|#|$)", ("php",)),
    PatternRule(r"[?&]sessionid=[0-9a-f]{16,}", ("sessionid",)),
    PatternRule(r"/free-download/.*\.exe(\?|#|$)", ("free", "download", "exe")),
)


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    return F.array_distinct(F.filter(F.split(lower_ascii(F.coalesce(url, F.lit(""))), "[^a-z0-9]+"), lambda t: t != ""))


def _index(spark, entries: Sequence[tuple[str, dict]], kind: str) -> tuple[Column, int]:
    """A constant array of buckets, each with the entries whose key's hash names it."""
    n = 1 << max(4, len(entries).bit_length() + 1)
    keys = sorted({k for k, _ in entries})
    listed = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(keys)), "array<string>")).alias("k"))
    slots = {r["k"]: r["b"] for r in listed.select("k", _bucket(F.col("k"), n).alias("b")).collect()}
    buckets: list[list[dict]] = [[] for _ in range(n)]
    for key, entry in entries:
        buckets[slots[key] - 1].append({"key": key} | entry)
    return F.from_json(F.lit(json.dumps(buckets)), f"array<array<struct<key string, {kind}>>>"), n


def _bucket(c: Column, n: int) -> Column:
    return (F.pmod(F.xxhash64(c), F.lit(n)) + 1).cast("int")


def _fetch(keys: Column, index: Column, n: int) -> Column:
    """All entries filed under any of the keys."""
    return F.flatten(F.transform(keys, lambda k: F.filter(F.element_at(index, _bucket(k, n)), lambda e: e["key"] == k)))


def rarest_tokens(urls: DataFrame, url: str, rules: Sequence[PatternRule]) -> dict[str, int]:
    """How many URLs hold each of the rules' tokens."""
    wanted = sorted({t for r in rules for t in r.tokens})
    index, n = _index(urls.sparkSession, [(t, {"v": 0}) for t in wanted], "v int")
    held = urls.select(F.explode(_fetch(tokens_of(F.col(url)), index, n)).alias("e")).groupBy("e.key").count()
    return dict.fromkeys(wanted, 0) | {r["key"]: r["count"] for r in held.collect()}


def judge(urls: DataFrame, url: str = "url", sites: Sequence[SiteRule] = SITE_RULES, patterns: Sequence[PatternRule] = PATTERN_RULES, otherwise: str = "allow") -> DataFrame:
    """``(row, host, path, rule, pattern, verdict)``: each URL's row as a struct, the site rule and the pattern that decided."""
    if len(sites) + len(patterns) > MAX_RULES or not all(r.tokens for r in patterns):
        raise ValueError(f"at most {MAX_RULES} rules, each pattern with a literal token")
    spark = urls.sparkSession
    counts = rarest_tokens(urls, url, patterns)
    by_token, n = _index(spark, [(min(r.tokens, key=lambda t: (counts[t], t)), {"pos": i, "pattern": r.pattern, "verdict": r.verdict}) for i, r in enumerate(patterns)], "pos int, pattern string, verdict string")
    by_host, m = _index(spark, [(r.host, {"len": len(r.name), "path": r.path, "name": r.name, "verdict": r.verdict}) for r in sites], "len int, path string, name string, verdict string")

    own = urls.select(F.struct("*").alias("row"), F.coalesce(F.col(url), F.lit("")).alias("u"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    labels = F.split("host", "\\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = F.filter(_fetch(parents, by_host, m), lambda e: F.startswith(F.col("path"), e["path"]))
    longest = F.array_max(F.transform(fits, lambda e: F.struct(e["len"].alias("len"), e["name"].alias("name"), e["verdict"].alias("verdict"))))
    hits = F.filter(_fetch(tokens_of(F.col("u")), by_token, n), lambda e: F.regexp(F.col("u"), e["pattern"]))
    first = F.array_min(F.transform(hits, lambda e: F.struct(e["pos"].alias("pos"), e["pattern"].alias("pattern"), e["verdict"].alias("verdict"))))
    own = own.withColumn("site", longest).withColumn("hit", F.when(F.col("site").isNull(), first))
    verdict = F.coalesce("site.verdict", "hit.verdict", F.lit(otherwise))
    return own.select("row", "host", "path", F.col("site.name").alias("rule"), F.col("hit.pattern").alias("pattern"), verdict.alias("verdict"))
