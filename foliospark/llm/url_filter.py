"""URL filters by host-suffix and path-prefix expressions, with DataFrame functions only.

A URL's host is cut after every dot into suffixes and its path to every length that a rule's path has; each pair is an
expression like 'example.com/en/'.  Expressions meet rules in an equi-join on the first 32 bits of a SHA-256 digest;
the full digest confirms a pair, and the longest confirmed rule wins.  Distinct (host, path) pairs are judged once, and
pages take the verdict of their pair; pages without a host or path, however many, are in no join.

A null url, or one without '://', has an empty host and path and meets no rule.  No rows: no rows.  No rules: the
default verdict everywhere.  Repeated pages and rules change nothing; of rules alike but for the verdict, block wins.
Other columns of pages pass; those named host, path, rule or verdict are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The contract's rules: verdict, host, path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    values = [F.struct(F.lit(v).alias("rule_verdict"), F.lit(h).alias("rule_host"), F.lit(p).alias("rule_path")) for v, h, p in rules]
    one = spark.range(1)
    if not values:
        return one.select(F.lit("").alias("rule_verdict"), F.lit("").alias("rule_host"), F.lit("").alias("rule_path")).where("false")
    return one.select(F.inline(F.array(*values)))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """pages with host, path, rule (null if none fits) and verdict; rules: rule_verdict, rule_host, rule_path."""
    passed = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    parted = pages.select(F.struct(*passed).alias("row"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rules = rules.withColumn("rule", F.concat("rule_host", "rule_path"))
    lengths = sorted(r[0] for r in rules.select(F.length("rule_path")).distinct().collect())  # not more than a path has characters
    rules = rules.groupBy("rule").agg(F.max("rule_verdict").alias("rule_verdict"))
    rules = rules.withColumn("digest", F.sha2(F.col("rule").cast("binary"), 256)).withColumn("short", F.substring("digest", 1, 8))
    judged = parted.where((F.col("host") != "") & (F.col("path") != ""))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    cuts = F.array(*[F.lit(n) for n in lengths]) if lengths else F.expr("cast(array() as array<int>)")
    prefixes = F.transform(F.filter(cuts, lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    asked = judged.select("host", "path").distinct().select("host", "path", F.explode(F.array_distinct(expressions)).alias("expression"))
    asked = asked.withColumn("asked_digest", F.sha2(F.col("expression").cast("binary"), 256)).withColumn("short", F.substring("asked_digest", 1, 8))
    confirmed = asked.join(rules, "short").where(F.col("asked_digest") == F.col("digest"))
    best = confirmed.groupBy("host", "path").agg(F.max_by(F.struct("rule", "rule_verdict"), F.struct(F.length("rule"), F.col("rule"))).alias("best"))
    out = lambda df, rule, verdict: df.select("row.*", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.lit(default)).alias("verdict"))
    none = F.lit(None).cast("string")
    bare = out(parted.where((F.col("host") == "") | (F.col("path") == "")), none, none)
    # a pair that very many pages share is a skewed key of this join, whose pages Spark deals out anew (AQE)
    met = judged.join(best, ["host", "path"], "left")
    return out(met, F.col("best.rule"), F.col("best.rule_verdict")).unionByName(bare)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = r"""
with p as (
  select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*(/[^?#]*)', 1), '') as path, row_number() over () as rid from pages),
r(v, h, q) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m as (
  select rid, max_by(h || q, length(h || q)) as rule, max_by(v, length(h || q)) as v
  from p join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, q) group by rid)
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from p left join m using (rid)
"""
