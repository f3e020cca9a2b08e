"""URL filter: pattern rules found by their rarest literal token, then checked by regular expression."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from motorlot.llm.store import ascii_lower, saved

BROADCAST_RULES = 100_000
TOKEN = r"[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """`pattern` is searched in host + path + rest of the url; every match contains each of `tokens` as a whole token.

    Rank 1 rules (host rules) decide before rank 0 rules; within a rank the longest name wins, then the larger one.
    """

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int = 0


def host_rule(verdict: str, name: str) -> Rule:
    """Rule `host/path`: the host and its subdomains, where the path starts with `/path`."""
    host, _, path = name.partition("/")
    # A token at the very end of the rule may go on in the url, so it is no token to look up.
    tokens = tuple(t.group().lower() for t in re.finditer(TOKEN, name, re.I) if t.end() < len(name))
    quoted = "\\Q" + f"{host}/{path}".replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return Rule(name, verdict, f"^(?:[^/?#]*[.])?{quoted}", tokens, 1)


def word_rule(verdict: str, word: str) -> Rule:
    """Rule for a word that stands alone anywhere in the url."""
    return Rule(word, verdict, f"(?i)(?<![a-z0-9]){word}(?![a-z0-9])", (word,))


# Fixed values of the query: host rules as given.
HOST_RULES = tuple(host_rule(v, n) for v, n in (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")))
# What the filter does by itself: words of adult, gambling and login pages, and links that only track or page.
OWN_RULES = tuple(word_rule("block", w) for w in ("casino", "poker", "porn", "xxx", "viagra", "login", "signup", "cart")) + (
    Rule("utm_source", "block", "(?i)[?&]utm_source=", ("utm", "source")),
    Rule("sessionid", "block", "(?i)[?&](?:php)?sessionid=[0-9a-f]{8}", ("sessionid",)),
)


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and what follows it; all empty for null or without `://`."""
    start = F.instr(url, "://")
    after = F.when(start > 0, F.substr(url, start + 3))
    part = lambda group: F.coalesce(F.regexp_extract(after, r"(?s)^([^/?#]*)([^?#]*)(.*)$", group), F.lit(""))
    return ascii_lower(part(1)), part(2), part(3)


def judged(spark: SparkSession, pages: DataFrame, rules: tuple[Rule, ...] = HOST_RULES + OWN_RULES, default: str = "allow") -> DataFrame:
    """pages plus host, path, rule (name of the deciding host rule, else null) and verdict.

    Each distinct address is tokenised once; its tokens fetch the rules that are filed under them, each rule under the one
    of its tokens that fewest distinct addresses hold, and only fetched rules run their expression. Without a host rule
    the verdict is `block` if a rank 0 block rule fits, else `default`. Null, empty or odd urls have empty parts and the
    default verdict. Columns of pages named like the new ones give way. The rule table is broadcast up to
    BROADCAST_RULES rules and otherwise joined by token. A very common address is one row until the last join, whose
    large keys Spark splits.
    """
    if any(not r.tokens for r in rules):
        raise ValueError("each rule needs a literal token")
    pages = pages.drop("host", "path", "rule", "verdict")
    host, path, rest = url_parts(F.col("url"))
    parts = pages.withColumn("host", host).withColumn("path", path).withColumn("_at", F.concat(host, path, rest))
    addresses = saved(parts.where("_at != ''").select("_at").distinct(), "addresses")
    tokens = addresses.select("_at", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("_at"), F.lit(TOKEN), F.lit(0)))).alias("token"))

    rows = [(i, r.name, r.verdict, r.pattern, r.rank, list(r.tokens)) for i, r in enumerate(rules)]
    listed = spark.createDataFrame(rows, "id int, name string, verdict string, pattern string, rank int, tokens array<string>")
    hint = F.broadcast if len(rules) <= BROADCAST_RULES else lambda df: df
    terms = listed.select("id", F.explode("tokens").alias("token"))
    held = tokens.join(hint(terms.select("token").distinct()), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = terms.join(held, "token", "left").groupBy("id").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    index = listed.join(rarest, "id").select("token", "name", "verdict", "pattern", "rank")

    fits = tokens.join(hint(index), "token").where(F.expr("_at rlike pattern"))
    best = fits.groupBy("_at").agg(
        F.max(F.when(F.col("rank") == 1, F.struct(F.length("name").alias("n"), F.col("name"), F.col("verdict")))).alias("by_host"),
        F.max((F.col("rank") == 0) & (F.col("verdict") == "block")).alias("own"),
    )
    verdict = F.coalesce("by_host.verdict", F.when(F.col("own"), F.lit("block")), F.lit(default))
    return parts.join(best, "_at", "left").select(*[f"`{c}`" for c in pages.columns], "host", "path", F.col("by_host.name").alias("rule"), verdict.alias("verdict"))


# Check text of the query: one expression for each rule, no index.
SQL = r"""
WITH a AS (SELECT page_id, url, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS x FROM pages),
b AS (SELECT page_id, coalesce(translate(regexp_extract(x, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(x, '^[^/?#]*([^?#]*)', 1), '') AS path, coalesce(regexp_extract(x, '[?#].*$', 0, 's'), '') AS rest FROM a),
c AS (SELECT *, host || path || rest AS adr, CASE
        WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
        WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
        WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
        WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM b)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(adr, '(?i)(^|[^a-z0-9])(casino|poker|porn|xxx|viagra|login|signup|cart)([^a-z0-9]|$)') THEN 'block'
    WHEN regexp_matches(adr, '(?i)[?&]utm_source=') OR regexp_matches(adr, '(?i)[?&](php)?sessionid=[0-9a-f]{8}') THEN 'block'
    ELSE 'allow' END AS verdict
FROM c
"""
