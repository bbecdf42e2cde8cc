"""URL filter: host-suffix and path-prefix expressions against a rule table.

Only DataFrame functions run here. Every URL is expanded into the expressions that a rule could
have (host suffixes at label borders, path prefixes up to the longest rule path), the expressions
meet the rules on the first 32 bits of their SHA-256, and a meeting counts when the whole digests
are equal. Of the rules that fit, the longest one (host and path together, then the longer host,
then block before allow) decides.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule and gets
the default verdict; repeated pages are judged one by one; no pages or no rules give no rows or
default verdicts; other columns of the page table are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the query's contract.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)

#: Rules up to which they are sent to all tasks; beyond it the join is left to Spark.
BROADCAST_RULES = 100_000


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    widest = rules.agg(
        F.coalesce(F.max(F.length("path")), F.lit(0)).alias("chars"),
        F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(1)).alias("labels"),
        F.count(F.lit(1)).alias("rules"),
    ).first()
    rest = F.expr("CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END")
    located = (
        pages.select("page_id", "url")
        .select(F.monotonically_increasing_id().alias("row"), "page_id", rest.alias("rest"))
        .select(
            "row",
            "page_id",
            F.translate(F.regexp_extract("rest", r"^[^/?#]*", 0), UPPER, LOWER).alias("host"),
            F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"),
        )
    )
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(widest["labels"]))),
        lambda n: F.array_join(F.slice(labels, -n, n), "."),
    )
    prefixes = F.transform(
        F.sequence(F.lit(0), F.least(F.length("path"), F.lit(widest["chars"]))),
        lambda n: F.substring(F.col("path"), F.lit(1), n),
    )
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, F.lit("\n"), p))))
    digest = F.sha2(F.col("expression"), 256)
    expanded = (
        located.withColumn("expression", F.explode(expressions))
        .withColumn("digest", digest)
        .drop("expression")
        .withColumn("short", F.substring("digest", 1, 8))
    )
    known = (
        rules.select(
            F.sha2(F.concat(F.translate("host", UPPER, LOWER), F.lit("\n"), F.col("path")), 256).alias("rule_digest"),
            F.struct(
                F.length(F.concat("host", "path")).alias("size"),
                F.length("host").alias("host_size"),
                (F.col("verdict") == "block").alias("blocks"),
                F.concat("host", "path").alias("rule"),
                "verdict",
            ).alias("found"),
        )
        .withColumn("rule_short", F.substring("rule_digest", 1, 8))
    )
    if widest["rules"] <= BROADCAST_RULES:
        known = F.broadcast(known)
    met = expanded.join(known, F.col("short") == F.col("rule_short"), "left")
    confirmed = F.when(F.col("digest") == F.col("rule_digest"), F.col("found"))
    best = met.groupBy("row", "page_id", "host", "path").agg(F.max(confirmed).alias("best"))
    return best.select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
