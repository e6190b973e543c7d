"""Allow and block rules on hosts and paths, matched to urls by a sort-merge range join.

A rule (host, path) becomes the prefix ``reversed host # path``; all keys with that prefix form
one interval of the sorted key line, and the intervals of all rules nest or are disjoint.  A url
puts one key on the line for each of its host's ends (``com``, ``example.com`` ...), so that a
rule on a host covers its subdomains.  One sweep over starts, keys and ends keeps the stack of
open rules: the running sum of starts and ends is the stack's height, and the entry at height h
is the last rule that started at height h.  The top of the stack is the longest open rule.

The sweep runs in range partitions; heights and open rules of the earlier partitions are carried
over as one small row for each partition (and height).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depgraph.llm.common import lower_ascii
from depgraph.session import materialize

_MARK = "#"  # neither a host nor a path holds it


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty where the url is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _usable(rules: DataFrame) -> DataFrame:
    """One row for each (host, path); a block rule beats an allow rule for the same prefix."""
    return (
        rules.filter(F.col("host").isNotNull())
        .select(
            lower_ascii(F.col("host")).alias("rule_host"),
            F.coalesce("path", F.lit("")).alias("rule_path"), "verdict",
        )
        .filter(~F.concat("rule_host", "rule_path").rlike("[?#]") & ~F.col("rule_host").contains("/"))
        .groupBy("rule_host", "rule_path")
        .agg(F.max("verdict").alias("rule_verdict"))
    )


def _key(host: Column, labels: Column, path: Column) -> Column:
    """Canonical key of the last ``labels`` labels of a host, and a path."""
    parts = F.split(host, "[.]")
    tail = F.slice(parts, F.size(parts) - labels + 1, labels)
    return F.concat(F.array_join(F.reverse(tail), "."), F.lit(_MARK), path).cast("binary")


def _sweep(events: DataFrame) -> DataFrame:
    """Rows of kind 1 that have an open rule, with the innermost one.

    ``events``: key, kind (0 start, 1 url, 2 end), host, path, rule.
    """
    order = ["key", "kind", "host", "path"]
    cells = materialize(
        events.repartitionByRange(*order).withColumn("cell", F.spark_partition_id()), "sweep"
    )
    step = F.when(F.col("kind") == 0, 1).when(F.col("kind") == 2, -1).otherwise(0)
    earlier = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        cells.groupBy("cell").agg(F.sum(step).alias("steps"))
        .select("cell", F.coalesce(F.sum("steps").over(earlier), F.lit(0)).alias("base"))
    )
    inside = Window.partitionBy("cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    started = F.when(F.col("kind") == 0, F.col("rule"))
    deep = (
        cells.join(base, "cell")
        .withColumn("height", F.sum(step).over(inside) + F.col("base"))
    )
    level = Window.partitionBy("cell", "height").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    deep = deep.withColumn("open", F.last(started, ignorenulls=True).over(level))
    before = Window.partitionBy("height").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        deep.groupBy("cell", "height")
        .agg(F.max_by("rule", F.when(F.col("kind") == 0, F.col("key"))).alias("newest"))
        .select("cell", "height", F.last("newest", ignorenulls=True).over(before).alias("carried"))
    )
    return (
        deep.filter((F.col("kind") == 1) & (F.col("height") > 0))
        .join(carried, ["cell", "height"])
        .select("host", "path", F.coalesce("open", "carried").alias("rule"))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """Every row of ``pages`` with host, path, rule and verdict.

    ``rules``: host, path, verdict ('allow' or 'block').  A rule fits its host and all subdomains
    where the url's path starts with the rule's path.  The longest rule (characters of host and
    path, then of the host) wins; without one ``rule`` is null and ``verdict`` is ``default``.

    Null urls and urls without ``://`` have an empty host and path and get the default.  Columns of
    ``pages`` named host, path, rule or verdict are replaced.  Repeated rows stay repeated.  Rules
    without a host, or with a character that no host or path can have, fit nothing.  Empty tables
    give an empty result (pages) or the default everywhere (rules).
    """
    usable = materialize(_usable(rules), "rules")
    labels = usable.select(F.max(F.size(F.split("rule_host", "[.]")))).first()[0] or 0
    host, path = url_parts(F.col(url))
    judged = pages.withColumns({"host": host, "path": path}).drop("rule", "verdict")
    found = ["host", "path", "rule", "verdict"]
    columns = [*(c for c in pages.columns if c not in found), *found]
    if labels == 0:
        return judged.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)}).select(*columns)
    rule = F.struct(
        F.length(F.concat("rule_host", "rule_path")).alias("length"),
        F.length("rule_host").alias("host_length"),
        F.concat("rule_host", "rule_path").alias("name"), F.col("rule_verdict").alias("verdict"),
    )
    prefix = _key(F.col("rule_host"), F.size(F.split("rule_host", "[.]")), F.col("rule_path"))
    bounds = usable.select(rule.alias("rule"), prefix.alias("prefix"))
    none = F.lit("").alias("host"), F.lit("").alias("path")
    starts = bounds.select(F.col("prefix").alias("key"), F.lit(0).alias("kind"), *none, "rule")
    ends = bounds.select(
        F.concat("prefix", F.lit(b"\xff")).alias("key"), F.lit(2).alias("kind"), *none, "rule"
    )
    ends_of_host = F.explode(F.sequence(F.lit(1), F.least(F.size(F.split("host", "[.]")), F.lit(labels))))
    points = (
        judged.select("host", "path").filter("host != ''").distinct()
        .select("host", "path", ends_of_host.alias("labels"))
        .select(
            _key(F.col("host"), F.col("labels"), F.col("path")).alias("key"), F.lit(1).alias("kind"),
            "host", "path", F.lit(None).cast(bounds.schema["rule"].dataType).alias("rule"),
        )
    )
    best = (
        _sweep(points.unionByName(starts).unionByName(ends))
        .groupBy("host", "path").agg(F.max("rule").alias("best"))
    )
    return (
        judged.join(best, ["host", "path"], "left")
        .withColumn("rule", F.col("best.name"))
        .withColumn("verdict", F.coalesce("best.verdict", F.lit(default)))
        .select(*columns)
    )
