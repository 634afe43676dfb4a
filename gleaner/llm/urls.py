"""URL filter: pattern rules indexed by their rarest literal token.

Every rule is a regular expression with the literal tokens it needs. A rule is filed under the
token that fewest URLs hold (counted over all URLs); a URL's own tokens fetch candidate rules,
and only those candidates run their expression.

Cases: a null URL, or one without ``://``, has an empty host and path and gets no rule; an empty
table gives an empty result; equal (id, url) rows count once; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the contract: domain rules as (verdict, host, path).
DOMAIN_RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
# Method rules for what no domain rule covers: (name, pattern over host and path, literal tokens).
PATTERN_RULES = (
    ("spam-host", r"^(?:[^/]*[.-])?spam-", ("spam",)),
    ("cheap-goods", r"^[^/]*\bcheap-", ("cheap",)),
    ("casino", r"\bcasino\b", ("casino",)),
    ("adult", r"\badult\b", ("adult",)),
    ("tracker", r"^(?:track|tracker|ads)\.", ("track", "tracker", "ads")),
)
TOKEN = r"[A-Za-z0-9]+"
RULE_BROADCAST_LIMIT = 100_000


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_table(spark, domain_rules=DOMAIN_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """Rules as rows: rule, verdict, priority, pattern, literals (all needed), any (one of them)."""
    rows = []
    for verdict, host, path in domain_rules:
        pattern = rf"^(?:[^/]*\.)?{_quoted(host)}{_quoted(path)}"
        rows.append((host + path, verdict, 1_000_000 + len(host + path), pattern,
                     [t for t in _tokens(host + path)], True))
    for name, pattern, literals in pattern_rules:
        # A rule with alternatives is filed under each of them; otherwise under its rarest token.
        rows.append((None, "block", len(pattern), pattern, list(literals), len(literals) == 1))
    return spark.createDataFrame(
        rows, "rule string, verdict string, priority long, pattern string, literals array<string>, needs_all boolean")


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c == "/" else "\\" + c for c in text)


def _tokens(text: str) -> list[str]:
    import re

    return re.findall(TOKEN, text.lower())


def indexed_rules(rules: DataFrame, token_counts: DataFrame) -> DataFrame:
    """One row per (rule, index token); the token is the literal in fewest URLs, ties by name."""
    flat = rules.withColumn("token", F.explode("literals"))
    # Only the literals' counts matter, a handful of rows.
    counted = flat.join(token_counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    keys = ["rule", "verdict", "priority", "pattern"]
    rare = (counted.where("needs_all").groupBy(*keys)
            .agg(F.min(F.struct("n", "token"))["token"].alias("token")))
    return rare.unionByName(counted.where("not needs_all").select(*keys, "token")).distinct()


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, url, host, path, rule, verdict) per distinct (id, url); default verdict is allow."""
    urls = (pages.select(F.col(id_col).alias(id_col), F.col(url_col).alias("url")).distinct()
            .withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))))
    # Regular expressions run on host and path; the host is lower case, the path as it stands.
    urls = urls.withColumn("target", F.concat("host", "path"))
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("target"), F.lit(TOKEN), 0))
    literals = rules.select(F.explode("literals").alias("token")).distinct()
    counts = (urls.select(F.explode(tokens).alias("token"))
              .join(F.broadcast(literals), "token").groupBy("token").agg(F.count("*").alias("n")))
    index = indexed_rules(rules, counts)
    if rules.limit(RULE_BROADCAST_LIMIT + 1).count() <= RULE_BROADCAST_LIMIT:
        index = F.broadcast(index)
    looked = urls.withColumn("token", F.explode_outer(tokens)).join(index, "token", "left")
    hit = F.when(F.expr("rlike(target, pattern)"), F.struct(
        F.col("priority"), F.coalesce("rule", F.lit("")).alias("key"), "rule", "verdict"))
    best = looked.groupBy(id_col, "url", "host", "path").agg(F.max(hit).alias("best"))
    return best.select(id_col, "url", "host", "path", F.col("best.rule").alias("rule"),
                       F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))
