"""URL filters by host suffix and path prefix (operator 9), in DataFrame functions only.

Each URL is expanded into host-suffix / path-prefix expressions. An expression and a rule
meet on the first hex digits of their SHA-256 digests, as in published block-list
protocols, then the full digests must agree; of the rules that fit, the longest wins
(ties: the later in the order of the rule's text, then block before allow).

Host: after the first :// up to / ? # or the end, A-Z lower-cased. Path: then up to ? #
or the end. A null url or one without :// has an empty host and path and fits no rule.
Without a rule the verdict is the default. Hosts and paths are cut only at the numbers of
labels and the lengths that rules have, so long ones make no more rows than others. Repeated rows get the same verdict each; a null page_id stays. Extra columns of
pages are ignored. An empty table or an empty list of rules is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import cut

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
PREFIX = 8  # hex digits, 32 bits
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules_frame(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: str) -> Column:
    """How many labels a host has."""
    return F.length(host) - F.length(F.translate(host, ".", "")) + 1


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, url, host, path, rule, verdict) for each row of pages."""
    digest = F.sha2(F.concat_ws("\n", "host", "path"), 256)
    listed = rules.where("host <> '' and path is not null").select("verdict", "host", "path", digest.alias("digest"))
    listed = listed.select(F.substring("digest", 1, PREFIX).alias("prefix"), "digest", "verdict", F.concat("host", "path").alias("rule"))
    # The lengths that rules' paths have, and their hosts' labels: small sets, found once.
    lengths = rules.select(F.array_sort(F.collect_set(F.length("path")))).scalar()
    depths = rules.select(F.array_sort(F.collect_set(_labels("host")))).scalar()

    urls = pages.select("url").distinct().select("url", host_of(F.col("url")).alias("full"), path_of(F.col("url")).alias("whole"))
    urls = urls.where("full <> ''").withColumn("_labels", _labels("full"))
    urls = urls.select("url", "full", "whole", "_labels", F.explode(depths).alias("_depth")).where("_depth <= _labels")
    urls = urls.select("url", "whole", F.expr("substring_index(full, '.', -_depth)").alias("host")).where("host <> ''")
    urls = urls.select("url", "whole", "host", F.explode(lengths).alias("_n")).where("_n <= length(whole)")
    urls = urls.select("url", "host", F.expr("substring(whole, 1, _n)").alias("path")).select("url", digest.alias("full_digest"))
    met = urls.join(listed, F.substring("full_digest", 1, PREFIX) == F.col("prefix")).where("full_digest = digest")
    best = F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best")
    won = met.groupBy("url").agg(best).select(F.col("url").alias("_url"), "best")

    own = pages.select("page_id", "url")
    # written first: an aggregate under the join would keep Spark from splitting a hot url
    won = cut(won, "verdicts")
    out = own.join(won, own.url == won._url, "left")
    return out.select(
        "page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
