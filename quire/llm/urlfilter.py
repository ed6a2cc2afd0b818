"""URL filtering by hashed host-suffix and path-prefix expressions.

Every URL is expanded into the expressions that a rule could equal: a suffix of its host, by
labels, followed by a prefix of its path. Both the rules and the expressions are hashed; they
meet in an equi-join on a short prefix of the digest, the full digests then confirm the hit,
and the longest rule among the hits decides. Only the label counts and path lengths that
occur among the rules are expanded, which loses nothing and bounds the expansion. DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import bounded

#: Hexadecimal digits of the digest that the join uses.
PREFIX = 8
#: Rules up to which the rule table is broadcast; beyond, the join shuffles.
MOST_BROADCAST = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """From behind the first :// up to /, ?, # or the end, A-Z in lower case; "" without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From behind the host up to ?, # or the end; "" without ://."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, action) as a DataFrame."""
    if not rules:
        return spark.sql("SELECT '' AS host, '' AS path, '' AS action WHERE false")
    text = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"({', '.join(map(text, r))})" for r in rules) + " AS t(host, path, action)")


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The host, path, deciding rule and verdict of every URL.

    A rule (host, path, action) fits its host and all subdomains of it if the URL's path
    starts with the rule's path; the longest rule wins (host and path together, then the
    longer host), and ``default`` holds where none fits. Ids may be null or repeat; equal rows
    are kept as often as they occur; a null URL, or one without ://, has an empty host and path.
    A rule may not be repeated with another action: of two such, block wins. Empty tables of
    pages or rules are fine. Other columns are not read. Rows move once, by (id, URL); copies of
    a row are counted before they move, so a row that fills a third of the table costs nothing extra.

    Returns (id, host, path, rule, verdict).
    """
    lowered = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "action")
    shapes = lowered.select(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("letters")).distinct().collect()
    hashed = lowered.select(
        F.sha2(F.concat("host", "path"), 256).alias("rule_digest"),
        F.struct(
            F.length(F.concat("host", "path")).alias("weight"),
            F.length("host").alias("host_weight"),
            F.col("action").alias("verdict"),
            F.concat("host", "path").alias("rule"),
        ).alias("hit"),
    ).withColumn("prefix", F.left("rule_digest", F.lit(PREFIX)))
    once = (
        pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
        .groupBy("id", "url")
        .agg(F.count("*").alias("copies"))
        .withColumn("host", host_of(F.col("url")))
        .withColumn("path", path_of(F.col("url")))
    )
    forms = [
        F.when(F.length("path") >= r["letters"], F.sha2(F.concat(F.substring_index("host", ".", -r["labels"]), F.left("path", F.lit(r["letters"]))), 256))
        for r in sorted(shapes)
    ]
    expanded = once.withColumn("digest", F.explode_outer(F.array_compact(F.array(*forms)) if forms else F.array().cast("array<string>")))
    met = expanded.withColumn("prefix", F.left("digest", F.lit(PREFIX))).join(bounded(hashed, MOST_BROADCAST), "prefix", "left")
    confirmed = F.when(F.col("digest") == F.col("rule_digest"), F.col("hit"))
    best = met.groupBy("id", "url", "host", "path", "copies").agg(F.max(confirmed).alias("best"))
    return best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
    )
