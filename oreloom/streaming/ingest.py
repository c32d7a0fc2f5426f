"""Streaming ingest: files arriving one by one, processed once, merged by key; windowed event counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from oreloom.sources.sinks import last_writer_wins


#: Parts of a merged table by hash of its keys; a micro-batch rewrites only the parts that it touches.
PARTS = 64


def ingest_files(
    spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, keys: list[str], sequence: str, files_per_batch: int = 100, parts: int = PARTS
) -> StreamingQuery:
    """All files not yet seen, in micro-batches, merged into a Parquet table by key (the latest sequence wins).

    The table is cut into ``parts`` by hash of the keys. A batch reads the current version of the parts that it touches,
    merges and writes them under version=<batch id>/part=<n>; the others stay where they are. A batch that runs again after a
    failure replaces its own output only. Versions of a part that a committed one has superseded are deleted.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
        touched = sorted(r.part for r in fresh.select("part").distinct().collect())  # at most ``parts`` numbers
        if not touched:
            return
        current = _part_paths(spark, target, batch_id, clean=True)
        paths = [current[n] for n in touched if n in current]
        if paths:
            old = spark.read.schema(batch.schema).option("basePath", target).parquet(*paths).select(*batch.columns)
            fresh = fresh.unionByName(old.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")))
        merged = last_writer_wins(fresh, keys, [F.col(sequence)])
        merged.write.mode("overwrite").partitionBy("part").parquet(f"{target}/version={batch_id}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _part_paths(spark: SparkSession, target: str, before: int | None = None, clean: bool = False) -> dict[int, str]:
    """The newest completed version of each part, optionally only those of earlier batches; older ones may be deleted."""
    named = spark._jvm.org.apache.hadoop.fs.Path
    fs = named(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(named(target)):
        return {}
    number = lambda status, mark: int(status.getPath().getName().split("=")[1]) if status.getPath().getName().startswith(mark) else None
    versions = sorted(v for v in (number(x, "version=") for x in fs.listStatus(named(target))) if v is not None and (before is None or v < before))
    newest: dict[int, str] = {}
    for v in versions:
        if not fs.exists(named(f"{target}/version={v}/_SUCCESS")):
            continue
        for n in (number(x, "part=") for x in fs.listStatus(named(f"{target}/version={v}"))):
            if n is not None:
                if clean and n in newest:
                    fs.delete(named(newest[n]), True)
                newest[n] = f"{target}/version={v}/part={n}"
    return newest


def latest_version(spark: SparkSession, target: str) -> DataFrame | None:
    """The merged table: the newest completed version of each part; None where nothing was written."""
    paths = list(_part_paths(spark, target).values())
    return spark.read.option("basePath", target).parquet(*paths).drop("version", "part") if paths else None


def windowed_counts(events: DataFrame, at: str, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events per tumbling window and type; on a stream, events later than the watermark are left out."""
    timed = events.withWatermark(at, late) if events.isStreaming else events
    out = timed.groupBy(F.window(at, window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, at: str, gap: str = "30 minutes") -> DataFrame:
    """Sessions per user, closed by a gap."""
    timed = events.withWatermark(at, "1 hour") if events.isStreaming else events
    out = timed.groupBy(F.session_window(at, gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
