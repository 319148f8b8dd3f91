"""URL rules looked up by digests of host suffixes and path prefixes, with built-in functions only.

A URL is expanded into expressions: every suffix of its host (whole labels) with every prefix of
its path that ends in a slash. A rule is stored under one such expression, its host and its path
up to the last slash. Both sides meet on the first eight hex digits of the expression's SHA-256;
then the full digests and the rest of the rule's path are compared, and of the rules that fit the
longest wins (more characters, then the longer host, then block before allow).

Rules are a table of any size: the planner broadcasts it if it is measured to be small and else
shuffles, and a very frequent expression (a hot host) is then split at run time. The matches are
folded per (key, url) after a map-side combine; the expressions of a row are made in one task, so
a hot host does not gather.

Edge cases: a null URL or one without ``://`` has an empty host and path and fits no rule; an
empty path fits no rule (rule paths start with a slash); repeated rows come back as often as
they went in; a null key stays; ties between equal rules are one rule; an empty page or rule table
gives no page, or the default verdict everywhere. A rule's host has at most 253 characters (the
limit of DNS) and its path at most 2,048, else the query fails with a message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from votecount.functions.steps import once
from votecount.llm.common import ascii_lower

LONGEST_HOST, LONGEST_PATH = 253, 2048
PREFIX_DIGITS = 8
DEFAULT = "allow"
#: The rules of the query: host, path, verdict.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    rows = [F.struct(*[F.lit(v).alias(n) for n, v in zip(("host", "path", "verdict"), r, strict=True)]) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, prefix: Column) -> Column:
    return F.sha2(F.concat(host, prefix), 256)


def _tails(host: Column) -> Column:
    """Every suffix of whole labels that is no longer than a rule's host can be."""
    # One character more than the limit shows whether the first label is cut.
    end = F.when(F.length(host) > LONGEST_HOST, F.right(host, F.lit(LONGEST_HOST + 1))).otherwise(host)
    labels = F.split(end, r"\.")
    n = F.size(labels)
    tails = F.transform(
        F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), ".")
    )
    return F.filter(tails, lambda t: (F.length(t) <= LONGEST_HOST) & (F.length(t) > 0))


def _heads(path: Column) -> Column:
    """Every prefix that ends in a slash and is no longer than a rule's path can be."""
    parts = F.split(F.left(path, F.lit(LONGEST_PATH)), "/")
    n = F.size(parts) - 1
    heads = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    return F.when(n > 0, heads).otherwise(F.array().cast("array<string>"))


def stored_rules(rules: DataFrame) -> DataFrame:
    """Each rule once, with the digest of the expression it is found by."""
    host, path = ascii_lower(F.col("host")), F.col("path")
    fits = (F.length(host) <= LONGEST_HOST) & (F.length(host) > 0) & (F.length(path) <= LONGEST_PATH)
    fits = F.coalesce(fits & path.startswith("/") & F.col("verdict").isin("allow", "block"), F.lit(False))
    checked = F.when(fits, host).otherwise(F.raise_error(F.lit("a rule needs a host, a path from /, allow or block")))
    key = _digest(checked, F.concat(F.regexp_extract(path, r"(?s)^(.*)/", 1), F.lit("/")))
    # One number: of the rules that fit a URL it names the longest, its verdict, and its text too,
    # which is the end of the host and the start of the path.
    rank = (F.length(host) + F.length(path)).cast("bigint") * 512 + F.length(host) * 2
    rank = rank + (F.col("verdict") == "block").cast("int")
    return rules.select(
        F.left(key, F.lit(PREFIX_DIGITS)).alias("_short"), key.alias("_full"), path.alias("_rest"), rank.alias("_rank")
    ).distinct()


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """Per page: key, host, path, rule (null where none fits) and verdict."""
    plain = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"))
    parsed = once(plain, {"_host": host_of(F.col("_url")), "_path": path_of(F.col("_url"))})
    pairs = F.flatten(
        F.transform(
            _tails(F.col("_host")),
            lambda t: F.transform(_heads(F.col("_path")), lambda h: _digest(t, h)),
        )
    )
    # The null expression stands for the page itself, so that every page leaves a row.
    expressions = parsed.withColumn("_full", F.explode(F.concat(F.array(F.lit(None).cast("string")), pairs)))
    expressions = expressions.withColumn("_short", F.left("_full", F.lit(PREFIX_DIGITS)))
    stored = stored_rules(rules).withColumnRenamed("_full", "_rule_full")
    met = expressions.join(stored, "_short", "left")
    fits = (F.col("_full") == F.col("_rule_full")) & F.col("_path").startswith(F.col("_rest"))
    best = met.groupBy("_key", "_url").agg(
        F.max(F.when(fits, F.col("_rank"))).alias("_best"),
        F.count(F.when(F.col("_full").isNull(), 1)).alias("_times"),
    )
    again = once(best, {"_host": host_of(F.col("_url")), "_path": path_of(F.col("_url"))})
    again = again.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_times"))))
    n_host = F.expr("int(_best div 2 % 256)")
    rule = F.concat(F.right("_host", n_host), F.left("_path", F.expr("int(_best div 512)") - n_host))
    return again.select(
        F.col("_key").alias(key),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        rule.alias("rule"),
        F.when(F.col("_best") % 2 == 1, "block").when(F.col("_best") % 2 == 0, "allow").otherwise(DEFAULT).alias("verdict"),
    )


SQL = r"""
WITH p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r AS (
  SELECT *,
    CASE WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
         WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
         WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
         WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule
  FROM p
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
