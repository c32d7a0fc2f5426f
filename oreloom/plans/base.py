"""Base relations over the domain tables, shared by the registered queries, and the same relations in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreloom.functions.keys import norm_key
from oreloom.session import table

_WS = r"E' \t\n\r'"


def sql_norm(col: str) -> str:
    return f"nullif(lower(trim({col}, {_WS})), '')"


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    """(doc, stage, pos): live named stages of each flowsheet in order; delivered twice counts once."""
    rows = table(spark, sf, "flow_stages").filter("deleted_at IS NULL").select(
        F.col("image_id").alias("doc"), norm_key(F.col("stage_name")).alias("stage"), "stage_order", "stage_rid"
    )
    rows = rows.filter("stage IS NOT NULL AND stage_order IS NOT NULL").distinct()
    return rows.select("doc", "stage", (F.col("stage_order").cast("bigint") * 1000000000 + F.col("stage_rid")).alias("pos"))


SEQ = f"""seq AS (
  SELECT image_id AS doc, stage, stage_order::BIGINT * 1000000000 + stage_rid AS pos FROM (
    SELECT DISTINCT image_id, {sql_norm('stage_name')} AS stage, stage_order, stage_rid FROM flow_stages WHERE deleted_at IS NULL)
  WHERE stage IS NOT NULL AND stage_order IS NOT NULL)"""


def truth(spark: SparkSession, sf: str) -> DataFrame:
    """(doc, item): ground-truth names of the latest record of each document."""
    return _lists(spark, sf, "ground_truth")


def predicted(spark: SparkSession, sf: str) -> DataFrame:
    """(doc, item): predicted names of the latest record of each document."""
    return _lists(spark, sf, "xgb_stages")


def latest_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """The latest record of each document."""
    rows = table(spark, sf, "test_predictions")
    latest = rows.groupBy("doc_id").agg(F.max(F.struct("produced_at", "ground_truth", "xgb_stages", "commodity", "split", "doc_f1")).alias("r"))
    return latest.select(F.col("doc_id").alias("doc"), "r.*")


def _lists(spark: SparkSession, sf: str, column: str) -> DataFrame:
    named = latest_predictions(spark, sf).select("doc", F.explode(column).alias("raw"))
    return named.select("doc", norm_key(F.col("raw")).alias("item")).filter("item IS NOT NULL").distinct()


LATEST = """latest AS (
  SELECT doc_id AS doc, * EXCLUDE (doc_id, rn) FROM (
    SELECT doc_id, produced_at, ground_truth, xgb_stages, commodity, split, doc_f1, row_number() OVER (PARTITION BY doc_id
      ORDER BY produced_at DESC NULLS LAST, ground_truth DESC NULLS LAST, xgb_stages DESC NULLS LAST, commodity DESC NULLS LAST, split DESC NULLS LAST, doc_f1 DESC NULLS LAST) AS rn
    FROM test_predictions) WHERE rn = 1)"""
TRUTH = f"{LATEST}, truth AS (SELECT DISTINCT doc, item FROM (SELECT doc, {sql_norm('s')} AS item FROM latest, unnest(ground_truth) AS u(s)) WHERE item IS NOT NULL)"
BOTH = f"{TRUTH}, pred AS (SELECT DISTINCT doc, item FROM (SELECT doc, {sql_norm('s')} AS item FROM latest, unnest(xgb_stages) AS u(s)) WHERE item IS NOT NULL)"


def links(spark: SparkSession, sf: str) -> DataFrame:
    """(doc, src, dst): distinct connections with both ends."""
    rows = table(spark, sf, "flow_connections").select(
        F.col("image_id").alias("doc"), norm_key(F.col("parent_id")).alias("src"), norm_key(F.col("child_id")).alias("dst")
    )
    return rows.filter("src IS NOT NULL AND dst IS NOT NULL").distinct()


LINKS = f"""links AS (
  SELECT DISTINCT image_id AS doc, {sql_norm('parent_id')} AS src, {sql_norm('child_id')} AS dst FROM flow_connections
  WHERE {sql_norm('parent_id')} IS NOT NULL AND {sql_norm('child_id')} IS NOT NULL)"""
