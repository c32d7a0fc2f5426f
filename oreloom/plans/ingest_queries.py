"""Queries of sources, write semantics and streaming (S*, K*, 2.15), each run as a batch over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreloom.plans.base import sql_norm
from oreloom.plans.registry import query
from oreloom.plans.table_queries import clean_sql
from oreloom.session import ensure_checkpoint_dir, table
from oreloom.sources import results, sinks
from oreloom.streaming.ingest import sessions, windowed_counts


_STOPS = ("the", "of", "a", "and")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_valid(props)")
def s1_permissive_json(spark: SparkSession, sf: str) -> DataFrame:
    """JSON with a stated schema; what cannot be parsed is rejected, not fatal."""
    rows = table(spark, sf, "events").select("event_id", F.from_json("props", "k string, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("j"))
    return rows.filter("j._corrupt IS NULL").select("event_id", "j.k")


@query("SELECT i AS id, 'filing_' || i || '.pdf' AS name, 'EX-96' AS kind FROM range(60) t(i) WHERE i % 3 <> 0")
def s11_paged_listing(spark: SparkSession, sf: str) -> DataFrame:
    return results.filings(spark, 6, 10)


@query("SELECT doc_id, split FROM (SELECT doc_id, split, row_number() OVER (PARTITION BY doc_id ORDER BY CASE split WHEN 'test' THEN 3 WHEN 'oof' THEN 2 ELSE 1 END DESC) AS rn FROM test_predictions WHERE split IN ('val', 'oof', 'test')) WHERE rn = 1")
def s14_prediction_splits(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "test_predictions")
    files = {s: rows.filter(F.col("split") == s).select("doc_id") for s in ("val", "oof", "test")}
    return results.prediction_splits(files).select("doc_id", "split")


@query(
    """WITH e AS (SELECT DISTINCT edges, edges::JSON AS j FROM xgb_traces WHERE edges LIKE '{%|%' AND json_valid(edges)), k AS (SELECT edges, j, unnest(json_keys(j)) AS k FROM e WHERE len(list_filter(json_keys(j), lambda x: json_type(j->('$."' || x || '"')) NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE'))) = 0)
    SELECT DISTINCT split_part(k, '|', 1) AS src, substr(k, instr(k, '|') + 1) AS dst, (j->>('$."' || k || '"'))::DOUBLE AS n FROM k WHERE instr(k, '|') > 1"""
)
def s15_key_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return results.key_pairs(table(spark, sf, "xgb_traces").filter("edges LIKE '{%|%'"), "edges").filter("n IS NOT NULL").distinct()


@query(f"SELECT k AS norm, array_to_string(list_sort(list(DISTINCT u)), '~') AS originals FROM (SELECT {sql_norm('unit_type')} AS k, unit_type AS u FROM flow_units) WHERE k IS NOT NULL GROUP BY 1")
def s17_normalisation_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    from oreloom.functions.keys import norm_key

    rows = table(spark, sf, "flow_units").select(norm_key(F.col("unit_type")).alias("norm"), "unit_type").filter("norm IS NOT NULL").distinct()
    return rows.groupBy("norm").agg(F.array_join(F.array_sort(F.collect_list("unit_type")), "~").alias("originals"))


@query("SELECT doc_id, count(DISTINCT produced_at) AS version, min(produced_at) AS created, max(produced_at) AS updated FROM test_predictions GROUP BY 1")
def k2_versioned(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.versioned(table(spark, sf, "test_predictions"), "doc_id", "produced_at", []).select("doc_id", "version", "created", "updated")


@query("SELECT image_id, unit_id, unit_rid FROM (SELECT *, row_number() OVER (PARTITION BY image_id, unit_id ORDER BY created_at DESC NULLS LAST, unit_rid DESC) AS rn FROM flow_units) WHERE rn = 1")
def k3_last_writer_wins(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "flow_units").select("image_id", "unit_id", "unit_rid", "created_at")
    return sinks.last_writer_wins(rows, ["image_id", "unit_id"], [F.col("created_at"), F.col("unit_rid")]).drop("created_at")


@query("WITH e AS (SELECT DISTINCT unit_type AS k, 0 AS run FROM flow_units WHERE created_at < TIMESTAMP '2021-01-01'), n AS (SELECT unit_type AS k, min(unit_rid) AS run FROM flow_units WHERE created_at >= TIMESTAMP '2021-01-01' GROUP BY 1) SELECT k, run FROM e WHERE k IS NOT NULL UNION ALL SELECT k, run FROM n WHERE k IS NOT NULL AND k NOT IN (SELECT k FROM e WHERE k IS NOT NULL)")
def k4_first_writer_wins(spark: SparkSession, sf: str) -> DataFrame:
    units = table(spark, sf, "flow_units").filter("unit_type IS NOT NULL")
    old = units.filter("created_at < TIMESTAMP_NTZ '2021-01-01'").select(F.col("unit_type").alias("k"), F.lit(0).cast("bigint").alias("run")).distinct()
    new = units.filter("created_at >= TIMESTAMP_NTZ '2021-01-01'").select(F.col("unit_type").alias("k"), F.col("unit_rid").alias("run"))
    return sinks.first_writer_wins(old, new, ["k"], [F.col("run")])


@query("SELECT user_id, array_to_string(CASE WHEN list_contains(s, 'done') THEN s ELSE list_append(s, 'done') END, ',') AS steps FROM (SELECT user_id, list_sort(list(DISTINCT event_type)) AS s FROM events GROUP BY 1)")
def k5_append_step(spark: SparkSession, sf: str) -> DataFrame:
    steps = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("s"))
    return steps.select("user_id", F.array_join(sinks.append_step(F.col("s"), F.lit("done")), ",").alias("steps"))


@query("SELECT document_id AS run_id, unit_rid, (row_number() OVER (PARTITION BY document_id ORDER BY unit_rid))::INT AS id FROM (SELECT DISTINCT document_id, unit_rid FROM flow_units WHERE unit_type IS NULL)")
def k6_error_log(spark: SparkSession, sf: str) -> DataFrame:
    errors = table(spark, sf, "flow_units").filter("unit_type IS NULL").select(F.col("document_id").alias("run_id"), "unit_rid").distinct()
    return sinks.error_log(errors, [F.col("unit_rid")])


@query("SELECT document_id, image_id, count(*) AS n_units FROM (SELECT DISTINCT * FROM flow_units) GROUP BY 1, 2")
def k7_import_nested(spark: SparkSession, sf: str) -> DataFrame:
    """Flowsheets packed into result documents and imported back as rows: units per image."""
    units = table(spark, sf, "flow_units").distinct().select(
        "document_id", "image_id", F.struct(F.col("unit_id").alias("id"), "label", F.col("unit_type").alias("type"), "stage_id", "cells").alias("u")
    )
    sheet = "struct<type:string,stages:array<struct<id:string,name:string,order:int>>,units:array<struct<id:string,label:string,type:string,stage_id:string,cells:int>>,connections:array<struct<parent_id:string,child_id:string,from_type:string,to_type:string>>,text_before:string,text_after:string,caption:string,page:int,error:string,raw:string>"
    sheets = units.groupBy("document_id", "image_id").agg(F.to_json(F.struct(F.lit("flowsheet").alias("type"), F.collect_list("u").alias("units"))).alias("j"))
    docs = sheets.groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct("image_id", F.from_json("j", sheet)))).alias("flowsheets"))
    back = sinks.import_result(docs.withColumns({"tables": F.lit(None).cast("array<struct<table_id:string,page_number:int,table_index:int,section_number:string,section_title:string,caption:string,headers:array<string>,rows:array<array<string>>,text_before:string,text_after:string>>"), "page_text": F.lit(None).cast("array<struct<page_number:int,page:int,text:string,section_number:string>>"), "filename": F.lit("x"), "status": F.lit("done"), "errors": F.lit(None).cast("array<string>")}))
    return back["units"].groupBy("document_id", "image_id").agg(F.count("*").alias("n_units"))


@query("SELECT n_regionkey AS region, '[' || string_agg('{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}', ',' ORDER BY n_nationkey) || ']' AS json FROM nation GROUP BY 1")
def k8_export_nested(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.export_nested(table(spark, sf, "nation"), "n_regionkey", ["n_nationkey", "n_name"], "n_nationkey").withColumnRenamed("n_regionkey", "region")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def k10_resume(spark: SparkSession, sf: str) -> DataFrame:
    """Work that is left: keys without a completed record."""
    done = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


@query("SELECT doc_id, max(produced_at) AS produced_at FROM test_predictions GROUP BY 1")
def k12_consolidate(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "test_predictions").groupBy("doc_id").agg(F.max_by(F.struct("produced_at", "split"), "produced_at").alias("r"))
    return rows.select("doc_id", "r.produced_at")


def _scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own beside the checkpoints, where a sink may write."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query("SELECT c_custkey, c_name, c_acctbal, c_nationkey FROM customer")
def k1_parquet_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Written by Spark's committer, cut by a column, and read back."""
    path = _scratch(spark, "k1")
    sinks.write_table(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_nationkey"), path, ["c_nationkey"])
    return spark.read.parquet(path)


@query("SELECT table_id, to_json(headers)::VARCHAR AS headers, caption FROM extracted_tables")
def k11_csv_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Written as CSV, lists as JSON text, and read back."""
    path = _scratch(spark, "k11")
    sinks.write_csv(table(spark, sf, "extracted_tables").select("table_id", "headers", "caption"), path)
    return spark.read.schema("table_id string, headers string, caption string").option("header", True).option("escape", '"').option("multiLine", True).option("nullValue", sinks.CSV_NULL).csv(path)


@query("SELECT o_orderkey::VARCHAR AS file, o_totalprice AS score FROM orders WHERE o_orderkey < 100")
def k9_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """A small manifest put in place by one rename and read back."""
    path = _scratch(spark, "k9")
    entries = table(spark, sf, "orders").filter("o_orderkey < 100").select(F.col("o_orderkey").cast("string").alias("file"), F.col("o_totalprice").cast("double").alias("score")).collect()
    sinks.write_manifest(spark, [r.asDict() for r in entries], path)
    return sinks.read_manifest(spark, path, "file string, score double")


@query('SELECT time_bucket(INTERVAL 1 HOUR, ts) AS "start", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2')
def stream_windowed_counts(spark: SparkSession, sf: str) -> DataFrame:
    return windowed_counts(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts")


@query(
    "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)"
    ' SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k'
)
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return sessions(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts")


@query("SELECT image_id, unit_id, count(*) AS n FROM (SELECT DISTINCT * FROM flow_units) GROUP BY 1, 2 HAVING count(*) > 1")
def s6_key_violations(spark: SparkSession, sf: str) -> DataFrame:
    from oreloom.sources.store import key_violations

    return key_violations(table(spark, sf, "flow_units").distinct(), ["image_id", "unit_id"])


@query("SELECT table_id, count(*) AS n FROM doc_features WHERE table_id IS NOT NULL AND table_id NOT IN (SELECT table_id FROM extracted_tables WHERE table_id IS NOT NULL) GROUP BY 1")
def s6_dangling(spark: SparkSession, sf: str) -> DataFrame:
    from oreloom.sources.store import dangling

    return dangling(table(spark, sf, "doc_features"), "table_id", table(spark, sf, "extracted_tables"), "table_id")


@query(f"SELECT {clean_sql('table_id', _STOPS)} AS table_id, {clean_sql('caption', _STOPS)} AS caption, page_number FROM extracted_tables")
def s7_rewrite_text(spark: SparkSession, sf: str) -> DataFrame:
    from oreloom.sources.store import rewrite_text

    return rewrite_text(table(spark, sf, "extracted_tables").select("table_id", "caption", "page_number"), list(_STOPS))
