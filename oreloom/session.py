"""Session construction and the two facilities every operator shares: table access and lineage cutting."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: White space in the sense of str.strip(); a fixed value handed to btrim().
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings the engine is designed for (UTC, ANSI, AQE with skew handling)."""
    builder = (
        SparkSession.builder.master(master)
        .appName("oreloom")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table by name; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str) -> list[str]:
    """Register every Parquet table of a folder as a temporary view for SQL; returns their names."""
    root = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName().removesuffix(".parquet") for s in fs.listStatus(root) if s.getPath().getName().endswith(".parquet"))
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return names


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use spark.checkpoint.dir where the session names one. Where it is unset, a local master gets a scratch folder of this
    machine, which is all the cluster there is; any other master is refused, since executors would not share the folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {sc.master} share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="oreloom-checkpoint-"))


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores before long work in Python, where a small file in few splits would leave half of them idle.

    Tables in splits enough, which large ones are, stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df._jdf.queryExecution().toRdd().getNumPartitions() <= cores else df


def release(*done: DataFrame | None) -> None:
    """Delete the files of checkpoints that cut() made and nothing reads any more; other DataFrames are left alone."""
    for df in done:
        plan = df._jdf.queryExecution().logical() if df is not None else None
        if plan is None or plan.getClass().getSimpleName() != "LogicalRDD":
            continue
        at = plan.rdd().getCheckpointFile()
        if at.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at.get())
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
