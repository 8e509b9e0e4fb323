"""URL filtering by host-suffix and path-prefix rules, joined on short hash prefixes and confirmed on full digests.

Every URL is expanded into the suffixes of its host, which meet the hosts of the rules and learn how long their paths are,
and then into expressions of a host suffix and the first characters of its path, one for each of those lengths. Both meet
the rules on the first PREFIX hexadecimal digits of a SHA-256 and are confirmed on the whole digest. Spark chooses by size
in bytes how each join is made; rules are never gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import materialize, read_table

PREFIX = 8
DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _keyed(df: DataFrame, name: str, *parts: Column) -> DataFrame:
    """Adds name_digest, of parts that are told apart by the length of the first, and name_key, its first digits."""
    digest = F.sha2(F.concat_ws(":", F.length(parts[0]), *parts), 256)
    return df.withColumn(f"{name}_digest", digest).withColumn(f"{name}_key", F.substring(f"{name}_digest", 1, PREFIX))


def filter_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages(page_id, url, ...) under rules(host, path, verdict).

    A rule fits its host and all subdomains when the URL's path starts with the rule's path. The rule with the longest
    host and path together wins, then the one with more of it in the host, then block before allow. Without a rule the
    verdict is allow. Defined cases: a null URL or one without :// has an empty host and path and fits no rule; repeated
    rows stay repeated; a null page_id stays null; rules with a null or empty host or a null verdict are ignored, a null
    rule path is an empty one; no pages give no rows; other columns are ignored.
    """
    host = F.translate("host", UPPER, LOWER)
    rules = rules.where("host <> '' and verdict is not null").select(host.alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict")
    # several verdicts for one rule: block, the greater string, wins
    rules = materialize(rules.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict")), "rules")
    lengths = rules.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths"))
    hosts = _keyed(lengths, "host", F.col("rule_host")).select("lengths", "host_key", F.col("host_digest").alias("of_host"))
    rule = F.concat("rule_host", "rule_path")
    keyed = _keyed(rules, "rule", F.col("rule_host"), F.col("rule_path")).withColumn("fit", F.struct(F.length(rule).alias("l"), (-F.length("rule_path")).alias("p"), "verdict", rule.alias("rule")))
    keyed = keyed.select("rule_key", F.col("rule_digest").alias("of_rule"), "fit")
    # equal rows of one input partition become one row with a count
    same = pages.groupBy("page_id", "url", F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"))
    host, path = url_parts(F.col("url"))
    same = same.withColumns({"host": host, "path": path})
    # a host meets rules only with as many of its last labels as some rule has
    most = rules.agg(F.max(F.size(F.split("rule_host", "\\.")))).first()[0] or 0
    labels = F.split("host", "\\.")
    number = F.least(F.size(labels), F.lit(most))
    same = same.withColumn("labels", F.slice(labels, -F.greatest(number, F.lit(1)), F.greatest(number, F.lit(1)))).withColumn("number", number)
    suffixes = F.when((F.col("host") != "") & (F.col("number") > 0), F.transform(F.sequence(F.lit(1), F.greatest("number", F.lit(1))), lambda n: F.array_join(F.slice("labels", -n, n), ".")))
    open_ = _keyed(same.withColumn("suffix", F.explode_outer(suffixes)), "host", F.col("suffix")).join(hosts, "host_key", "left")
    fits = F.when(F.col("host_digest") == F.col("of_host"), F.filter("lengths", lambda n: n <= F.length("path")))
    open_ = open_.withColumn("length", F.explode_outer(fits)).withColumn("prefix", F.expr("substring(path, 1, length)"))
    met = _keyed(open_, "rule", F.col("suffix"), F.col("prefix")).join(keyed, "rule_key", "left")
    best = met.groupBy("page_id", "url", "part", "host", "path", "n").agg(F.max(F.when(F.col("length").isNotNull() & (F.col("rule_digest") == F.col("of_rule")), F.col("fit"))).alias("best"))
    out = best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(DEFAULT)).alias("verdict"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [spark.range(1).select(*(F.lit(v).alias(k) for k, v in zip(("host", "path", "verdict"), r, strict=True))) for r in RULES]
    return filter_urls(read_table(spark, sf_dir, "pages"), reduce(DataFrame.union, rules))


OP10_SQL = r"""
WITH rules(host, path, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
p AS (SELECT page_id, row_number() OVER () AS rn, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, rn, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
m AS (SELECT q.rn, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY q.rn ORDER BY length(r.host || r.path) DESC, length(r.path), r.verdict DESC) AS k
  FROM q JOIN rules r ON (q.host = r.host OR suffix(q.host, '.' || r.host)) AND prefix(q.path, r.path))
SELECT q.page_id, q.host, q.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM q LEFT JOIN m ON m.rn = q.rn AND m.k = 1
"""
