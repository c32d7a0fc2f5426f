"""Sinks and write semantics on plain Parquet: replace, ignore, versioned upsert, nested import and export."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> bool:
    """K1, K9: atomic overwrite through Spark's committer; an empty frame writes nothing. Returns whether it wrote."""
    if df.isEmpty():
        return False
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return True


def write_manifest(spark: SparkSession, entries: list[dict], path: str) -> None:
    """K9: a small JSON file (one object per line) put in place by one rename, so that readers see the old or the new one, never a part."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    stream = target.getFileSystem(conf).create(draft, True)
    stream.write(bytearray("".join(json.dumps(e, ensure_ascii=False, sort_keys=True) + "\n" for e in entries).encode()))
    stream.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else jvm.java.net.URI("file:///"), conf)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(draft, target, options)


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """K9: the manifest's entries as rows."""
    return spark.read.schema(schema).json(path)


#: How a null is written to CSV, so that it is not taken for an empty text.
CSV_NULL = "\\N"


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header; nested columns as JSON text, quotes doubled, nulls as CSV_NULL."""
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name) for f in df.schema]
    df.select(*flat).write.mode("overwrite").options(header=True, escape='"', nullValue=CSV_NULL, emptyValue="").csv(path)


def last_writer_wins(rows: DataFrame, keys: list[str], sequence: list[Column]) -> DataFrame:
    """INSERT OR REPLACE: the latest row of each key; give a total order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[c.desc_nulls_last() for c in sequence]))
    return rows.withColumn("__rn", rank).filter("__rn = 1").drop("__rn")


def first_writer_wins(existing: DataFrame, new: DataFrame, keys: list[str], sequence: list[Column]) -> DataFrame:
    """K4: INSERT OR IGNORE: new keys only, the first of several new rows of a key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*sequence))
    fresh = new.join(existing.select(*keys), keys, "left_anti").withColumn("__rn", rank).filter("__rn = 1").drop("__rn")
    return existing.unionByName(fresh)


def versioned(rows: DataFrame, key: str, sequence: str, payload: list[str]) -> DataFrame:
    """K2: versioned upsert: per key the number of distinct writes, the first and last time and the last payload."""
    latest = F.max(F.struct(sequence, *payload)).alias("last")
    out = rows.groupBy(key).agg(F.count_distinct(sequence).alias("version"), F.min(sequence).alias("created"), F.max(sequence).alias("updated"), latest)
    return out.select(key, "version", "created", "updated", *[F.col(f"last.{p}").alias(p) for p in payload])


def append_step(steps: Column, step: Column) -> Column:
    """K5: the step appended unless present; a null list starts empty."""
    return F.array_union(F.coalesce(steps, F.array().cast("array<string>")), F.array(step))


def error_log(errors: DataFrame, order: list[Column], start: int = 0) -> DataFrame:
    """K6: errors with consecutive ids per run, in a stated order, numbered after ``start``."""
    return errors.withColumn("id", F.row_number().over(Window.partitionBy("run_id").orderBy(*order)) + F.lit(start))


def import_result(results: DataFrame) -> dict[str, DataFrame]:
    """Nested result documents -> flowsheets, stages, units, connections, tables, page_text, documents.

    Missing table ids become document id and position; legacy connection ends fill in; rows of error flowsheets keep
    their context only.
    """
    sheets = results.select("document_id", F.explode("flowsheets").alias("image_id", "f"))
    good = sheets.filter("f.error IS NULL")
    tables = results.select("document_id", F.posexplode("tables").alias("pos", "t"))
    ends = lambda new, old: F.coalesce(F.col(f"c.{new}"), F.nullif(F.col(f"c.{old}"), F.lit(""))).alias(new)
    return {
        "flowsheets": sheets.select("document_id", "image_id", "f.type", "f.caption", "f.page", "f.text_before", "f.text_after", "f.error"),
        "stages": good.select("document_id", "image_id", F.inline("f.stages")),
        "units": good.select("document_id", "image_id", F.inline("f.units")).fillna(1, ["cells"]),
        "connections": good.select("document_id", "image_id", F.explode("f.connections").alias("c")).select(
            "document_id", "image_id", ends("parent_id", "from_type"), ends("child_id", "to_type")
        ),
        "tables": tables.select(
            F.coalesce("t.table_id", F.concat("document_id", F.lit("_table_"), "pos")).alias("table_id"), "document_id",
            *[F.col(f"t.{c}") for c in ("page_number", "table_index", "section_number", "section_title", "caption", "headers", "rows", "text_before", "text_after")],
        ),
        "page_text": results.select("document_id", F.explode("page_text").alias("p")).select(
            "document_id", F.coalesce("p.page_number", "p.page").alias("page_number"), "p.text", "p.section_number"
        ),
        "documents": results.select(
            "document_id", "filename", "status", F.coalesce(F.size(F.map_keys("flowsheets")), F.lit(0)).alias("n_flowsheets"),
            F.coalesce(F.array_size("tables"), F.lit(0)).alias("n_tables"), F.coalesce(F.array_size("page_text"), F.lit(0)).alias("n_pages"),
            F.coalesce(F.array_size("errors"), F.lit(0)).alias("n_errors"),
        ),
    }


def export_nested(units: DataFrame, group: str, fields: list[str], order: str) -> DataFrame:
    """Rows -> one JSON array per group, in a stated order. A group is one flowsheet, hence bounded."""
    packed = F.array_sort(F.collect_list(F.struct(order, *[f for f in fields if f != order])))
    return units.groupBy(group).agg(F.to_json(packed).alias("json"))
