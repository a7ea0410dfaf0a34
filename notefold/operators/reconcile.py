"""Several sources of one set of keys: union, differences, gaps, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_of(c: Column, priority: list[str]) -> Column:
    """Position in a list of names, after its end for others."""
    return F.coalesce(*(F.when(c == p, F.lit(i)) for i, p in enumerate(priority)), F.lit(len(priority)))


def union_by_priority(df: DataFrame, key: list[str], source: str, priority: list[str], value: list[str]) -> DataFrame:
    """One row a key from its first source; ties by the values themselves."""
    first = F.min(F.struct(rank_of(F.col(source), priority).alias("r"), source, *value))
    return df.groupBy(*key).agg(first.alias("_f")).select(*key, *(F.col(f"_f.{c}").alias(c) for c in [source, *value]))


def presence(df: DataFrame, key: list[str], source: str, sources: list[str]) -> DataFrame:
    """One row a key with a flag for each source; one aggregation serves all set operations."""
    return df.groupBy(*key).agg(*(F.bool_or(F.col(source) == s).alias(s) for s in sources))


def differences(flags: DataFrame, key: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """(difference, key) rows of each 'a not b'."""
    named = F.array(*(F.when(F.col(a) & ~F.col(b), F.lit(f"{a}_not_{b}")) for a, b in pairs))
    return flags.select(F.explode(F.array_compact(named)).alias("difference"), *key)


def source_counts(flags: DataFrame, sources: list[str]) -> DataFrame:
    """(source, n): distinct keys of each source and of the union, zeros included."""
    one = flags.agg(*(F.count_if(F.col(s)).alias(s) for s in sources), F.count("*").alias("union"))
    return one.unpivot([], one.columns, "source", "n")


def count_status(expected: Column, found: Column, has_more: Column) -> Column:
    known = expected.isNotNull() & (expected > 0)
    return (
        F.when(~F.coalesce(known, F.lit(False)), "discovery_completed_without_expected_count").when(found >= expected, "complete").when(has_more == F.lit(False), "sources_exhausted_but_count_mismatch")
        .when(has_more == F.lit(True), "sources_not_exhausted_count_mismatch").otherwise("count_mismatch_unresolved")
    )


def gap(expected: Column, found: Column) -> Column:
    """Missing keys; an expected 0 means unknown and gives null."""
    return F.when(expected > 0, F.greatest(F.lit(0), expected - found))


def running_distinct(df: DataFrame, group: list[str], round_: str, key: str) -> DataFrame:
    """(group, round, new, total): keys first seen in each round and all so far."""
    first = df.groupBy(*group, key).agg(F.min(round_).alias(round_)).groupBy(*group, round_).agg(F.count("*").alias("new"))
    rounds = df.select(*group, round_).distinct().join(first, [*group, round_], "left").withColumn("new", F.coalesce("new", F.lit(0)))
    w = Window.partitionBy(*group).orderBy(round_).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rounds.withColumn("total", F.sum("new").over(w))


def delta(runs: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """Each run beside the run before it."""
    w = Window.partitionBy(*group).orderBy(order)
    return runs.withColumn("previous", F.lag(value).over(w)).withColumn("delta", F.col(value) - F.col("previous"))
