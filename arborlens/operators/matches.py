"""Combining rule hits into results: confirmed results, and uncertain ones that a confirmed one doesn't suppress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sorted_set(c: str | Column) -> Column:
    """Aggregate: the distinct non-null values, in order."""
    return F.array_sort(F.collect_set(c))


def suppressed_results(maybe: DataFrame, confirmed: DataFrame, keys: list[str]) -> DataFrame:
    """`maybe` rows (keys, result, ...) whose very result is not confirmed."""
    return maybe.join(confirmed.select(*keys, "result").distinct(), [*keys, "result"], "left_anti")


def suppressed_groups(maybe: DataFrame, confirmed: DataFrame, keys: list[str]) -> DataFrame:
    """`maybe` rows (keys, result, groups array, ...) of the results none of whose rules shares a group with a confirming rule: one shared group
    of one rule suppresses the whole result."""
    taken = confirmed.select(*keys, F.explode("groups").alias("group")).distinct()
    dead = maybe.select(*keys, "result", F.explode("groups").alias("group")).join(taken, [*keys, "group"], "left_semi").select(*keys, "result").distinct()
    return maybe.join(dead, [*keys, "result"], "left_anti")


def combine_matches(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, result, maybe, rules, groups) from hits (keys, rule, then array, maybe array, groups array): per key and result, the sorted rules
    and groups. A confirmed result suppresses the same uncertain one, and by a shared group also others. Null arrays are empty; repeated hits change
    nothing; hits that promise nothing give no row."""
    null = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    base = hits.select(*keys, "rule", null("then").alias("then"), null("maybe").alias("perhaps"), null("groups").alias("groups"))
    confirmed = base.select(*keys, "rule", "groups", F.explode("then").alias("result"))
    maybe = base.select(*keys, "rule", "groups", F.explode("perhaps").alias("result"))
    left = suppressed_groups(suppressed_results(maybe, confirmed, keys), confirmed, keys)
    both = confirmed.withColumn("maybe", F.lit(False)).unionByName(left.withColumn("maybe", F.lit(True)))
    return both.groupBy(*keys, "result", "maybe").agg(sorted_set("rule").alias("rules"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("groups")))).alias("groups"))
