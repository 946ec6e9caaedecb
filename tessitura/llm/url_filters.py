"""URL filtering by hashed host-suffix and path-prefix expressions.

Every distinct (host, path) is expanded into the expressions host-suffix + path-prefix
that a rule could have, each is hashed, and the expressions meet the rules in an
equi-join on the first 32 bits of the hash; the full digests then confirm the hit and the
longest rule wins. Only built-in functions run.

Defined cases: a null URL or one without ``://`` has empty host and path and meets no
rule; of rules of equal length the one with the longer host wins, of equal rules with
different actions ``block``; repeated pages each keep their row; an empty table gives an
empty result. The result adds host, path, rule and verdict, replacing columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hexadecimal digits of a digest's short prefix.
SHORT = 8
SALTS = 16
#: The rules of the query: action, host and path.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "action string, rule_host string, rule_path string")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, the rule that decides (null: none) and the verdict (without a rule: ``default``).

    rules: action (allow or block), rule_host and rule_path. Its distinct path lengths
    and label counts, which URLs bound, are the only values that reach the driver.
    """
    pages = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    rules = rules.where("rule_host is not null and rule_path is not null and action in ('allow', 'block')")
    shape = rules.agg(F.collect_set(F.length("rule_path")), F.collect_set(F.size(F.split("rule_host", r"\.")))).first()
    lengths, counts = (F.array(*map(F.lit, sorted(x))) if x else F.array().cast("array<int>") for x in shape)
    digest = F.sha2(F.concat_ws("\n", "rule_host", "rule_path"), 256)
    rules = rules.select(
        F.substring(digest, 1, SHORT).alias("short"),
        digest.alias("rule_digest"),
        F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), (F.col("action") == "block").cast("int")).alias("rank"),
        F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("action").alias("verdict")).alias("decision"),
    )
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.filter(counts, lambda k: k <= F.size(labels)), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    prefixes = F.transform(F.filter(lengths, lambda k: k <= F.length("path")), lambda k: F.substring(F.col("path"), F.lit(1), k))
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat_ws("\n", s, p))))
    tried = pages.where("host <> ''").select("host", "path").distinct().select("host", "path", F.explode(expressions).alias("expression"))
    tried = tried.select("host", "path", F.sha2("expression", 256).alias("digest")).withColumn("short", F.substring("digest", 1, SHORT))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")  # an expression that many paths share is SALTS groups
    tried = tried.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int"))
    hits = tried.join(rules.select("*", salts), ["short", "salt"]).where("digest = rule_digest").groupBy("host", "path").agg(F.max_by("decision", "rank").alias("decision"))
    known = pages.where("host <> ''").join(hits, ["host", "path"], "left").select(*[F.col(f"`{c}`") for c in pages.columns], "decision")
    found = known.unionByName(pages.where("host = ''").withColumn("decision", F.lit(None)))
    return found.select(*[F.col(f"`{c}`") for c in pages.columns], F.col("decision.rule").alias("rule"), F.coalesce("decision.verdict", F.lit(default)).alias("verdict"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, rules_table(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH rules(action, h, p) AS (VALUES ('block','com','/en/'),('allow','example.com','/en/7'),('allow','net','/de/'),('block','example.net','/de/8'),('block','org','/es/')),
u AS (SELECT row_number() OVER () AS id, page_id,
  coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
hit AS (SELECT id, h || p AS rule, action, row_number() OVER (PARTITION BY id ORDER BY length(h) + length(p) DESC, length(h) DESC, action DESC) AS k
  FROM u JOIN rules ON (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM u LEFT JOIN (SELECT * FROM hit WHERE k = 1) USING (id)
"""
