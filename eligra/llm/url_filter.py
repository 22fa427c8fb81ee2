"""URL rules by hashed host-suffix and path-prefix expressions, joined on short hash prefixes and confirmed by full digest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Rules up to this number travel to every task; more are joined by shuffle.
SMALL = 100_000
PREFIX = 8  #: hex digits of a digest that form the join key


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, in lower case; then up to ``?``, ``#`` or the end."""
    rest = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) rows as a table."""
    return spark.createDataFrame([(v, h, p) for v, h, p in rules], StructType([StructField(c, StringType()) for c in ("verdict", "host", "path")]))


def _prepared(rules: DataFrame) -> DataFrame:
    """Distinct rules with their join expression: the host and the path up to its last slash. The rest of a path is confirmed later."""
    clean = rules.where("host is not null and path is not null and verdict in ('allow', 'block')").select(
        "verdict", lower_ascii(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"))
    # Of two verdicts for one rule, block stands.
    clean = clean.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))
    key = F.concat("rule_host", F.regexp_extract("rule_path", "(?s)^(.*/)?", 1))
    digest = F.sha2(key, 256)
    return clean.select("rule_host", "rule_path", "verdict", F.substring(digest, 1, PREFIX).alias("short"), digest.alias("digest"),
                        F.size(F.split("rule_host", r"\.")).alias("labels"), (F.size(F.split("rule_path", "/")) - 1).alias("slashes"))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row for each row of ``pages``: page_id, host, path, rule (host and path of the longest that fits, else null), verdict.

    Each distinct page is expanded into its host's suffixes times its path's prefixes that end in a slash, no longer than any
    rule's: others can meet none. They meet the rules on the first 32 bits of their SHA-256; the whole digest and then the rule
    itself (host or subdomain, start of the path) confirm. Of equally long rules the blocking one wins, then the smaller.

    A null url, or one without ``://``, has an empty host and path, which no rule with a host fits. A rule with a null or a verdict
    other than allow and block is left out. Null ids are kept, repeated rows give repeated rows, other columns are not read. An
    empty table gives no rows, empty rules give ``default`` everywhere. A host that a third of all pages share is no hot key while the
    rules are few enough to be broadcast; beyond that, the join splits its large partitions.
    """
    rules = _prepared(rules)
    bound = rules.agg(F.count("*").alias("n"), F.max("labels").alias("labels"), F.max("slashes").alias("slashes")).first()
    host, path = host_and_path(pages[url_col])
    rows = pages.select(pages[id_col].alias("page_id"), host.alias("host"), path.alias("path"))
    # Copies of a page are one row with their number, combined before the shuffle.
    rows = rows.groupBy("page_id", "host", "path").agg(F.count("*").alias("n"))
    most_labels, most_slashes = bound.labels or 0, bound.slashes or 0
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(1, most_labels)))),
                           lambda k: F.concat_ws(".", F.slice(labels, -k, k)))
    # substring_index keeps what stands before the k-th slash.
    slashes = F.least(F.length("path") - F.length(F.replace(F.col("path"), F.lit("/"), F.lit(""))), F.lit(most_slashes))
    prefixes = F.transform(F.sequence(F.lit(0), slashes), lambda k: F.when(k == 0, F.lit("")).otherwise(
        F.concat(F.call_function("substring_index", F.col("path"), F.lit("/"), k), F.lit("/"))))
    each = rows.withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes))
    each = each.withColumn("page_digest", F.sha2(F.concat("suffix", "prefix"), 256))
    small = rules.drop("labels", "slashes")
    met = each.join(F.broadcast(small) if bound.n <= SMALL else small, F.substring("page_digest", 1, PREFIX) == F.col("short"), "left")
    fits = ((F.col("digest") == F.col("page_digest")) & (F.col("suffix") == F.col("rule_host")) & F.startswith("path", "rule_path"))
    rule = F.concat("rule_host", "rule_path")
    best = F.min(F.when(fits, F.struct((-F.length(rule)).alias("a"), (F.col("verdict") != "block").alias("b"), rule.alias("rule"), F.col("verdict").alias("verdict")))).alias("best")
    judged = met.groupBy("page_id", "host", "path").agg(F.first("n").alias("n"), best)
    return judged.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
