"""The driver's tables as the engine's domain: records, messages, queries, facts, usage runs, entity links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table

NOW = "2024-02-01T00:00:00Z"


def records(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.lit("event").alias("record_type"), F.col("doc_id").cast("string").alias("ref_id"), F.col("source").alias("title"), F.array("lang").alias("tags"), F.col("text").alias("body"), F.lit("episode").alias("kind"), F.col("lang").alias("project_id"), F.col("source").alias("session")
    )


def queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("position"), F.concat_ws("-", "conv_id", "turn").alias("ref_id"), "role", F.col("text").alias("body"))


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """A version of fact (user/type) per event; the next one closes it; errors expire after a day."""
    e = table(spark, sf, "events")
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    nxt = F.lead("ts").over(w)
    return e.select(
        F.lit("p").alias("project_id"), F.concat_ws("/", "user_id", "event_type").alias("fact_key"), F.col("event_id").alias("fact_id"), F.col("value"), F.col("ts").alias("valid_from"), nxt.alias("valid_to"),
        F.when(nxt.isNull(), F.lit("active")).otherwise(F.lit("superseded")).alias("status"), F.col("ts").alias("recorded_at"), F.when(F.col("event_type") == "error", F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("expires_at"),
    )


FACTS_SQL = """SELECT concat(user_id,'/',event_type) fact_key, event_id fact_id, value, ts valid_from, lead(ts) OVER w valid_to,
 CASE WHEN lead(ts) OVER w IS NULL THEN 'active' ELSE 'superseded' END status, ts recorded_at,
 CASE WHEN event_type='error' THEN ts + INTERVAL 1 DAY END expires_at
 FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)"""


def usage_runs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_type").alias("operation"), (F.col("user_id") % 5).alias("client"), F.col("ts").alias("created_at"), (F.col("event_type") != "error").alias("success"), (F.col("event_id") % 7).alias("result_count"), F.col("value").alias("latency_ms"), F.col("user_id").alias("project")
    )


def links(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as records, parts as entities."""
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("ref_id"), F.col("l_partkey").alias("entity_id")).distinct()
