"""The seven-table result store as schemas with the checks that Parquet does not enforce."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The tables of the store, their columns and primary keys.
STORE = {
    "documents": ("document_id string, filename string, file_path string, file_size_bytes bigint, document_version int, created_at timestamp, updated_at timestamp", ("document_id",)),
    "pipeline_runs": ("run_id string, document_id string, started_at timestamp, finished_at timestamp, status string, steps_completed array<string>", ("run_id",)),
    "images": ("image_id string, document_id string, run_id string, image_type string, page_number int, file_path string, caption string, text_before string, text_after string, embedding array<float>", ("image_id",)),
    "flowsheets": ("image_id string, run_id string, stages string, units string, connections string, llm_model string, llm_tokens int, error string, raw_response string", ("image_id",)),
    "extracted_tables": ("table_id string, document_id string, page_number int, table_index int, section_number string, section_title string, caption string, headers array<string>, rows array<array<string>>, text_before string, text_after string", ("table_id",)),
    "normalization_dict": ("normalized_id string, original_id string, first_seen_run string", ("normalized_id", "original_id")),
    "step_errors": ("id bigint, run_id string, step_name string, image_id string, page_number int, error_type string, error_message string, traceback string", ("id",)),
}
REFERENCES = (
    ("pipeline_runs", "document_id", "documents", "document_id"), ("images", "document_id", "documents", "document_id"), ("flowsheets", "image_id", "images", "image_id"),
    ("extracted_tables", "document_id", "documents", "document_id"), ("step_errors", "run_id", "pipeline_runs", "run_id"),
)


def create_store(spark: SparkSession, path: str) -> None:
    """CREATE TABLE IF NOT EXISTS: an empty Parquet table of each schema where none is."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name, (schema, _) in STORE.items():
        if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")):
            spark.createDataFrame([], schema).write.parquet(f"{path}/{name}")


def open_store(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All tables of a store with their stated schemas, registered as temporary views for SQL."""
    tables = {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, (schema, _) in STORE.items()}
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return tables


def key_violations(rows: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Primary keys that are null in part or occur more than once among distinct rows, with their number."""
    keys = list(keys)
    broken = F.lit(False)
    for k in keys:
        broken = broken | F.col(k).isNull()
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | broken)


def dangling(rows: DataFrame, column: str, parents: DataFrame, parent_column: str) -> DataFrame:
    """Foreign keys without a parent, with their number; null refers to nothing."""
    keys = parents.select(F.col(parent_column).alias(column))
    return rows.filter(F.col(column).isNotNull()).select(column).join(keys, column, "left_anti").groupBy(column).agg(F.count("*").alias("n"))


def check_store(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per broken rule: kind ('key' or 'reference'), table, column and number of offending keys."""
    parts = [key_violations(tables[t], keys).agg(F.count("*").alias("n")).select(F.lit("key").alias("kind"), F.lit(t).alias("table"), F.lit(",".join(keys)).alias("column"), "n") for t, (_, keys) in STORE.items()]
    parts += [dangling(tables[t], c, tables[p], pc).agg(F.count("*").alias("n")).select(F.lit("reference").alias("kind"), F.lit(t).alias("table"), F.lit(c).alias("column"), "n") for t, c, p, pc in REFERENCES]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.filter("n > 0")


def rewrite_text(df: DataFrame, stop_words: list[str]) -> DataFrame:
    """Every text column cleaned, all others as they are: a projection from Parquet to Parquet."""
    from oreloom.operators.tables import clean_text

    return df.select(*[clean_text(F.col(f.name), stop_words).alias(f.name) if f.dataType.typeName() == "string" else F.col(f.name) for f in df.schema])
