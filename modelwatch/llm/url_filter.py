"""URL rules by a blocked Bloom filter and an exact hash join.

A rule is a host and a path prefix; it fits its host and all subdomains. For a url, the canonical
keys that could be listed are (last labels of the host, start of the path), one for each pair of
label count and path length that occurs in the list. A blocked Bloom filter of the listed keys,
one 64-bit word for each block, passes the possible hits inside the scan; only they are joined
with the list, which removes false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwatch.llm.bloom import bloom_filter
from modelwatch.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col="page_id", url_col="url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row.

    rules: (host, path, verdict); the longest that fits decides (of equal host and path, the verdict
    last in the alphabet), else `default`. A null or malformed url has empty host and path, and no
    rule. Rows with the same page_id are judged each for itself. An empty list allows everything.
    """
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("rule_verdict"))
    listed = bloom_filter(rules.select("host", "path"))
    shape = F.struct(F.size(F.split("host", "\\.")).alias("labels"), F.length("path").alias("chars"))
    shapes = rules.agg(F.sort_array(F.collect_set(shape)).alias("shapes"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"))
    rows = materialise(
        rows.select(
            F.monotonically_increasing_id().alias("row"),
            "page_id",
            url_host(F.col("url")).alias("host"),
            url_path(F.col("url")).alias("path"),
        )
    )
    labels = F.size(F.split("host", "\\."))
    keys = (
        rows.withColumn("s", F.explode(shapes.scalar()))
        .filter((labels >= F.col("s.labels")) & (F.length("path") >= F.col("s.chars")))
        .select(
            "row",
            # A negative count keeps the last labels.
            F.call_function("substring_index", "host", F.lit("."), -F.col("s.labels")).alias("host"),
            F.substr("path", F.lit(1), F.col("s.chars")).alias("path"),
        )
    )
    rule = F.struct(
        (F.length("host") + F.length("path")).alias("chars"),
        F.concat("host", "path").alias("rule"),
        F.col("rule_verdict").alias("verdict"),
    )
    possible = keys.filter(listed(F.col("host"), F.col("path")))
    best = possible.join(rules, ["host", "path"]).groupBy("row").agg(F.max(rule).alias("best"))
    return rows.join(best, "row", "left").select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
