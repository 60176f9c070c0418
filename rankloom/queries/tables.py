"""The test tables in the shape of the ranking job's inputs, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import earlier_values
from ..session import spread_scan

MODELS = ("lr", "xgb", "cat", "lgbm")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str, *keys: str) -> DataFrame:
    """A table of texts, wide enough to clean and cut them in parallel."""
    return spread_scan(table(spark, sf, name).select(*keys, "text"), *keys)


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as labelled candidates of their source."""
    docs = spread_scan(table(spark, sf, "documents").drop("lang"), "doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    label = (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "good")
        .when((F.col("quality") == 1) & (F.col("toxic") == 1), "neutral")
        .otherwise("bad")
    )
    return docs.select(
        F.regexp_extract("source", "[0-9]+", 0).cast("long").alias("context_id"),
        F.col("doc_id").alias("reply_id"),
        F.col("text").alias("reply"),
        label.alias("label"),
        (F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("confidence"),
    )


PAIRS = """pairs AS (
  SELECT CAST(regexp_extract(source, '[0-9]+') AS BIGINT) AS context_id, d.doc_id AS reply_id, d.text AS reply,
         CASE WHEN quality = 1 AND toxic = 0 THEN 'good' WHEN quality = 1 AND toxic = 1 THEN 'neutral' ELSE 'bad' END AS label,
         n_chars / (n_chars + CAST(1000 AS DOUBLE)) AS confidence
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def dialogues(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant turns as candidates, with the three lines before them."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    with_context = earlier_values(
        turns, ["conv_id"], ["turn"], "text", {3: "context_2", 2: "context_1", 1: "context_0"}
    )
    return with_context.where(F.col("role") == "assistant").select(
        F.col("conv_id").alias("context_id"),
        "context_2",
        "context_1",
        "context_0",
        F.col("turn").alias("reply_id"),
        F.col("text").alias("reply"),
    )


DIALOGUES = """dialogues AS (
  SELECT conv_id AS context_id, context_2, context_1, context_0, turn AS reply_id, text AS reply
  FROM (SELECT *, lag(text, 3, '') OVER w AS context_2, lag(text, 2, '') OVER w AS context_1, lag(text, 1, '') OVER w AS context_0
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'assistant')"""


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Events as scored candidates of their user."""
    gain = F.when(F.col("event_type") == "purchase", 3.0).when(F.col("event_type") == "signup", 2.0)
    return table(spark, sf, "events").select(
        F.col("user_id").alias("context_id"),
        F.col("event_id").alias("reply_id"),
        gain.when(F.col("event_type") == "click", 1.0).otherwise(0.0).alias("gain"),
        F.col("value").alias("score"),
    )


CANDIDATES = """candidates AS (
  SELECT user_id AS context_id, event_id AS reply_id, value AS score,
         CAST(CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS DOUBLE) AS gain
  FROM events)"""


def order_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as candidates of their customer; the urgent ones gain most."""
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("context_id"),
        F.col("o_orderkey").alias("reply_id"),
        (5 - F.substring("o_orderpriority", 1, 1).cast("int")).cast("double").alias("gain"),
        F.col("o_totalprice").alias("score"),
    )


ORDER_CANDIDATES = """order_candidates AS (
  SELECT o_custkey AS context_id, o_orderkey AS reply_id, o_totalprice AS score,
         CAST(5 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS DOUBLE) AS gain
  FROM orders)"""


def model_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Events with four fixed scoring rules in place of four models."""
    return candidates(spark, sf).select(
        "context_id",
        "reply_id",
        F.col("gain").alias("target"),
        F.col("score").alias("lr"),
        (F.col("score") * 0.5 + 1).alias("xgb"),
        (F.lit(10.0) + F.col("reply_id") % 7).alias("cat"),
        F.sqrt("score").alias("lgbm"),
    )


MODEL_SCORES = f"""{CANDIDATES}, model_scores AS (
  SELECT context_id, reply_id, gain AS target, score AS lr, score * CAST(0.5 AS DOUBLE) + 1 AS xgb,
         CAST(10 + reply_id % 7 AS DOUBLE) AS cat, sqrt(score) AS lgbm
  FROM candidates)"""


def fold_sql(source: str, key: str, k: int, name: str = "folded") -> str:
    """CTE that adds ``fold`` to ``source``."""
    return f"""{name} AS (
  SELECT *, CAST(ntile({k}) OVER (ORDER BY md5(concat_ws('|', {key}, '42')), {key}) - 1 AS INTEGER) AS fold FROM {source})"""
