"""URL rules by hashed expressions, in DataFrame functions alone.

A URL is expanded into expressions: each suffix of its host (by label) with each prefix of its
path.  Only counts of labels and lengths of paths that occur among the rules are made, so the
expansion is exact and bounded by the rules.  Expressions meet the rules in an equi-join on the
first 8 digits of a SHA-256, the full digest confirms, and the longest rule that fits wins
(ties: more labels, then block before allow, then the lesser text).

The rules are broadcast while their texts have at most BROADCAST_BYTES; beyond, the join shuffles.  Only expressions
that meet a rule are aggregated, by host and path, of which any number of pages may share one.  Null urls and
urls without "://" have empty host and path, which no rule fits: the verdict is the default.  Repeated rows stay
repeated; without rules every page gets the default; an empty table gives an empty one.  Long urls cost their
prefixes of the rules' lengths only.  Columns other than key and url are not kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

DEFAULT = "allow"
BROADCAST_BYTES = 8 << 20
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict of every row of pages.  rules: host, path, verdict."""
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).distinct()
    rules = rules.withColumn("expression", F.concat("r_host", F.lit("\n"), "r_path"))
    rules = rules.withColumn("digest", F.sha2("expression", 256)).withColumn("short", F.substring("digest", 1, 8)).drop("r_host").withColumn("labels", F.size(F.split(F.substring_index("expression", "\n", 1), r"\.")))
    shapes = rules.agg(F.coalesce(F.sum(F.length("expression") + 200), F.lit(0)), F.collect_set("labels"), F.collect_set(F.length("r_path"))).first()
    size, labels, lengths = shapes[0], sorted(shapes[1]), sorted(shapes[2])
    base = pages.select(F.col(key).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    parts = F.split("host", r"\.", -1)
    hosts = F.array_distinct(F.filter(F.array(*[F.when(F.size(parts) >= n, F.array_join(F.slice(parts, F.size(parts) - n + 1, n), ".")) for n in labels]).cast("array<string>"), lambda x: x.isNotNull()))
    paths = F.array_distinct(F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]).cast("array<string>"), lambda x: x.isNotNull()))
    made = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.struct(F.sha2(F.concat(h, F.lit("\n"), p), 256).alias("a_digest")))))
    expanded = base.select("host", "path", F.explode(made).alias("e")).select("host", "path", "e.a_digest", F.substring("e.a_digest", 1, 8).alias("short"))
    side = F.broadcast(rules) if size <= BROADCAST_BYTES else rules
    rule = F.concat(F.substring_index("expression", "\n", 1), "r_path")
    rank = F.struct((-F.length(rule)).alias("longest"), (-F.col("labels")).alias("labels"), F.when(F.col("r_verdict") == "block", 0).otherwise(1).alias("strict"), rule.alias("rule"), F.col("r_verdict").alias("verdict"))
    best = expanded.join(side, "short").where("digest = a_digest").groupBy("host", "path").agg(F.min(rank).alias("best"))
    judged = base.join(best, ["host", "path"], "left")
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


OP8_SQL = r"""
WITH rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
cut AS (
  SELECT page_id, row_number() OVER () AS rid,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
fit AS (
  SELECT rid, h || p AS rule, v, row_number() OVER (PARTITION BY rid ORDER BY length(h || p) DESC) AS n
  FROM cut JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM cut LEFT JOIN (SELECT * FROM fit WHERE n = 1) USING (rid)
"""
