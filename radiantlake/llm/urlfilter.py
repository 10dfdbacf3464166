"""URL filters by hashed host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded
from .urls import url_host_path

#: Hexadecimal digits of a digest that the join compares first.
SHORT = 8
#: Rules (about 200 bytes each) that are broadcast at most; more are joined by shuffle.
BROADCAST_RULES = 200_000


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """host, path, action of literal rules."""
    if not rules:
        return spark.range(0).select(*(F.lit("").alias(c) for c in ("host", "path", "action")))
    rows = [F.struct(*(F.lit(v).alias(c) for c, v in zip(("host", "path", "action"), rule, strict=True))) for rule in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages (page_id, url).

    A rule (host, path, action) fits its host and all subdomains where the path
    starts with the rule's. Each distinct (host, path) is expanded into its host
    suffixes (at label bounds, only of label counts that rules have) with its path
    prefixes (only of lengths that rules have); the expressions are joined with the
    rules on a short digest prefix, full digests confirm, and the longest rule wins
    (equal: the longer host, then block). Pages get their verdict back by
    (host, path), so copies of a URL are judged once; rules are broadcast only up to
    BROADCAST_RULES.

    Null or odd urls have empty host and path, fit no rule and get the default;
    repeated rows stay; no rules or no pages are fine; other columns are ignored."""
    rules = rules.select(F.lower("host").alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), "action").where("r_host <> ''").distinct()
    shape = rules.agg(F.collect_set(F.size(F.split("r_host", r"\."))).alias("labels"), F.collect_set(F.char_length("r_path")).alias("lengths")).first()
    expression = F.concat("r_host", "r_path")
    known = rules.select(F.sha2(expression, 256).alias("r_digest"), expression.alias("r_rule"), "action", (F.char_length("r_host") + F.char_length("r_path")).alias("r_long"), F.char_length("r_host").alias("r_host_long"))
    known = known.withColumn("r_short", F.substring("r_digest", 1, SHORT))
    if bounded(rules, BROADCAST_RULES):
        known = F.broadcast(known)

    host, path = url_host_path()
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffixes = [F.when((F.size(labels) >= n), F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), F.lit(n)), ".")) for n in sorted(shape.labels)]
    prefixes = [F.when(F.char_length("path") >= n, F.substring("path", 1, n) if n else F.lit("")) for n in sorted(shape.lengths)]
    distinct = urls.select("host", "path").where("host <> ''").distinct()
    if suffixes:
        spread = distinct.select("host", "path", F.explode(F.array_compact(F.array(*suffixes))).alias("suffix"), F.array_compact(F.array(*prefixes)).alias("prefixes"))
        spread = spread.select("host", "path", F.explode("prefixes").alias("prefix"), "suffix").select("host", "path", F.sha2(F.concat("suffix", "prefix"), 256).alias("digest"))
    else:
        spread = distinct.select("host", "path", F.lit("").alias("digest"))
    hits = spread.join(known, F.substring("digest", 1, SHORT) == F.col("r_short")).where("digest = r_digest")
    rank = F.struct("r_long", "r_host_long", (F.col("action") == "block").alias("blocks"), "r_rule", "action")
    best = hits.groupBy(F.col("host").alias("b_host"), F.col("path").alias("b_path")).agg(F.max(rank).alias("best"))
    joined = urls.join(best, (urls.host == best.b_host) & (urls.path == best.b_path), "left")
    return joined.select("page_id", "host", "path", F.col("best.r_rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
