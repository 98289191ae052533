"""Operational reports: usage, shadow runs, consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usage(runs: DataFrame, since: Column) -> DataFrame:
    """By operation and client since a cut-off: runs, failures, results, mean latency."""
    return runs.where(F.col("created_at") >= since).groupBy("operation", "client").agg(F.count("*").alias("runs"), F.count_if(~F.col("success")).alias("failures"), F.sum("result_count").alias("results"), F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms"))


def usage_daily(runs: DataFrame) -> DataFrame:
    return runs.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day"), "operation").agg(F.count("*").alias("runs"))


def overlap(a: Column, b: Column) -> Column:
    """Common references over the shorter list."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.least(F.size(a), F.size(b)))


def shadow(runs: DataFrame, *by: str) -> DataFrame:
    out = runs.groupBy(*by) if by else runs.groupBy()
    return out.agg(F.count("*").alias("runs"), F.round(F.coalesce(F.avg("overlap"), F.lit(0.0)), 6).alias("avg_overlap"), F.max("latency_ms").alias("max_latency_ms"))


def collisions(notes: DataFrame) -> DataFrame:
    """Notes by bucket and root; a bucket of more than one root collides."""
    each = notes.groupBy("bucket", "root").agg(F.count("*").alias("notes"))
    return each.groupBy("bucket").agg(F.count("*").alias("roots"), F.sum("notes").alias("notes"), (F.count("*") > 1).alias("collides"))


def differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of one side only, with the side."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).union(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def keyword_counts(notes: DataFrame, words: list[str], chars: int = 20_000) -> DataFrame:
    """Occurrences of keywords in the first characters of each note, summed; notes without any are left out."""
    low = F.lower(F.substring("body", 1, chars))
    score = sum(((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w) for w in words), F.lit(0))
    return notes.withColumn("score", score.cast("long")).where("score > 0")
