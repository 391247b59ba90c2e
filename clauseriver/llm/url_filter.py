"""URL filters: host-suffix and path-prefix expressions, matched by hashed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseriver.llm.common import read

#: The rules that the query applies: action, host, path.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
RULE_SCHEMA = "action string, host string, path string"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url):
    """After the first :// up to /, ?, # or the end; A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url):
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("digest", F.sha2("expr", 256)).withColumn("short", F.substring("digest", 1, 8))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Judges every row of pages (page_id, url) by the longest rule that fits it.

    A rule (action, host, path) fits its host and all subdomains where the url's path starts with the
    rule's path. Each distinct (host, path) is expanded into host suffixes x path prefixes that end in
    a slash, no deeper than the deepest rule; they meet the rules on the first 8 hex digits of their
    SHA-256, and the full digest and the rest of the rule's path are checked after that. A hot
    expression is split by Spark's skew join, as nothing above the join needs its rows together.

    The longest host + path wins; among equally long ones the longer host, then block.
    Null urls and urls without :// have an empty host, fit no rule and get `default`, as do all where
    there are no rules. Rules with a null host or action are ignored, a null path is an empty one.
    Repeated pages keep one row each. Other columns of pages are dropped.
    """
    rules = rules.where("host IS NOT NULL AND host <> '' AND action IS NOT NULL").select(
        "action",
        F.translate("host", UPPER, LOWER).alias("rule_host"),
        F.coalesce("path", F.lit("")).alias("rule_path"),
    )
    rules = rules.distinct()
    deepest = rules.agg(
        F.max(F.size(F.split("rule_host", r"\."))).alias("labels"),
        F.max(F.length(F.regexp_replace("rule_path", "[^/]", ""))).alias("slashes"),
    ).first()
    labels, slashes = deepest["labels"] or 0, deepest["slashes"] or 0
    rules = _keyed(rules.withColumn("expr", F.concat("rule_host", F.regexp_extract("rule_path", r"(?s)^.*/", 0))))

    seen = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = seen.where("host <> ''").select("host", "path").distinct()
    parts = F.split("host", r"\.")
    size = F.size(parts)
    suffixes = F.transform(
        F.sequence(F.greatest(F.lit(1), size - labels + 1), size),
        lambda i: F.array_join(F.slice(parts, i, size), "."),
    )
    depth = F.least(F.lit(slashes), F.length(F.regexp_replace("path", "[^/]", "")))
    urls = urls.select("host", "path", F.explode(suffixes).alias("suffix"), F.sequence(F.lit(0), depth).alias("depths"))
    prefixes = F.expr("transform(depths, k -> IF(k = 0, '', concat(substring_index(path, '/', k), '/')))")
    exprs = urls.select("host", "path", "suffix", F.explode(prefixes).alias("prefix"))
    exprs = _keyed(exprs.withColumn("expr", F.concat("suffix", "prefix")))
    hits = (
        exprs.alias("e")
        .join(rules.alias("r"), F.col("e.short") == F.col("r.short"))
        .where("e.digest = r.digest AND e.suffix = r.rule_host AND startswith(e.path, r.rule_path)")
    )
    rule = F.concat("rule_host", "rule_path")
    best = hits.groupBy("host", "path").agg(
        F.max(
            F.struct(
                F.length(rule).alias("size"),
                F.length("rule_host").alias("host_size"),
                (F.col("action") == "block").alias("blocks"),
                rule.alias("rule"),
                F.col("action"),
            )
        ).alias("best")
    )
    return seen.join(best, ["host", "path"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"),
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"), spark.createDataFrame(RULES, RULE_SCHEMA))


OP10_SQL = """
WITH u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages)
, r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
  END AS rule FROM u)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
