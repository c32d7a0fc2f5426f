"""Sources: explicit schemas, permissive scans with rejects, prediction files, key-pair maps."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_S = T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


STAGE = _struct(id=_S, name=_S, order=T.IntegerType())
UNIT = _struct(id=_S, label=_S, type=_S, stage_id=_S, cells=T.IntegerType())
CONNECTION = _struct(parent_id=_S, child_id=_S, from_type=_S, to_type=_S)
FLOWSHEET = _struct(
    type=_S, stages=T.ArrayType(STAGE), units=T.ArrayType(UNIT), connections=T.ArrayType(CONNECTION),
    text_before=_S, text_after=_S, caption=_S, page=T.IntegerType(), error=_S, raw=_S,
)
TABLE = _struct(
    table_id=_S, page_number=T.IntegerType(), table_index=T.IntegerType(), section_number=_S, section_title=_S, caption=_S,
    headers=T.ArrayType(_S), rows=T.ArrayType(T.ArrayType(_S)), text_before=_S, text_after=_S,
)
PAGE = _struct(page_number=T.IntegerType(), page=T.IntegerType(), text=_S, char_count=T.LongType(), section_number=_S)
#: One result document per PDF.
RESULT = _struct(
    document_id=_S, filename=_S, target_mineral=_S, flowsheets=T.MapType(_S, FLOWSHEET), tables=T.ArrayType(TABLE), page_text=T.ArrayType(PAGE),
    cu_grade_avg=T.DoubleType(), retry_count=T.IntegerType(), steps_completed=T.ArrayType(_S), status=_S, errors=T.ArrayType(_S),
)
PREDICTION = _struct(
    doc_id=_S, ground_truth=T.ArrayType(_S), xgb_predicted=T.MapType(_S, T.DoubleType()), xgb_stages=T.ArrayType(_S), doc_f1=T.DoubleType()
)
CORRUPT = "_corrupt"


def read_json_documents(spark: SparkSession, path: str, schema: T.StructType, required: str) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) multi-line JSON documents under any Hadoop path, with ``stem`` of the file name.

    Never infers; a corrupt file or one without the required field is rejected, never fatal; unknown fields are ignored.
    """
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, _S)])
    rows = spark.read.schema(full).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    rows = rows.withColumn("stem", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.json)?$", 1))
    bad = F.col(CORRUPT).isNotNull() | F.col(required).isNull()
    return rows.filter(~bad).drop(CORRUPT), rows.filter(bad).select("stem", CORRUPT)


def scan_graphs(spark: SparkSession, path: str, schema: T.StructType, skip: list[str], min_context: int = 4) -> DataFrame:
    """S3: graph documents except metadata files and those with fewer context nodes than asked."""
    good, _ = read_json_documents(spark, path, schema, "document_id")
    context = F.size(F.filter("nodes", lambda n: n["type"] == "context"))
    return good.filter(~F.col("stem").isin(*skip) & (context >= min_context))


#: Bytes of a file's head in which its document_id is looked for.
HEAD_BYTES = 512


def document_index(spark: SparkSession, path: str, head: int = HEAD_BYTES) -> DataFrame:
    """(document_id, file) from the first bytes of each file; the rest is never read. Files whose head names no id are left out.

    The listing comes from Spark with the content column pruned; each task opens its files through Arrow's file systems (local
    paths, HDFS and object stores) and reads one short range.
    """
    pattern = re.compile(r'"document_id"\s*:\s*"((?:[^"\\]|\\.)*)"')

    def peek(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in batches:
            rows = []
            for uri in pdf["file"]:
                system, at = fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))
                with system.open_input_stream(at) as stream:
                    text = stream.read(head).decode("utf-8", "replace")
                if found := pattern.search(text):
                    rows.append((json.loads(f'"{found[1]}"'), uri))
            yield pd.DataFrame(rows, columns=["document_id", "file"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).select(F.col("path").alias("file"))
    return files.mapInPandas(peek, "document_id string, file string")


def prediction_splits(files: dict[str, DataFrame]) -> DataFrame:
    """Predictions of several splits tagged with their split; the later split wins a doc_id."""
    union = None
    for priority, (split, df) in enumerate(files.items()):
        tagged = df.withColumns({"split": F.lit(split), "__p": F.lit(priority)})
        union = tagged if union is None else union.unionByName(tagged, allowMissingColumns=True)
    from oreloom.operators.corpus import first_by_key

    return first_by_key(union, ["doc_id"], [F.desc("__p")]).drop("__p")


def key_pairs(df: DataFrame, json: str, mark: str = "|") -> DataFrame:
    """{"src|dst": n} maps as rows, keys cut at the first mark; broken JSON and keys without a mark give none."""
    pairs = df.select(F.explode(F.from_json(json, "map<string,double>")).alias("key", "n"))
    at = F.instr("key", mark)
    return pairs.filter(at > 0).select(F.substring("key", F.lit(1), at - 1).alias("src"), F.expr(f"substring(key, instr(key, '{mark}') + {len(mark)})").alias("dst"), "n")


class PagedSource(DataSource):
    """A paged remote listing as a Spark source; one partition per page offset, so pages are read in parallel.

    options: pages, page_size, and fetch, the dotted path of a function (offset, size) -> rows (id, name, kind). The
    default function makes rows up, since nothing may be fetched here.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return "id bigint, name string, kind string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.pages, self.size, self.fetch = int(options.get("pages", 4)), int(options.get("page_size", 10)), options.get("fetch")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in range(self.pages)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fetch = sample_page
        if self.fetch:
            import importlib

            module, _, name = self.fetch.rpartition(".")
            fetch = getattr(importlib.import_module(module), name)
        yield from fetch(partition.value * self.size, self.size)


def sample_page(offset: int, size: int) -> Iterator[tuple]:
    """Rows of one page of a made-up listing."""
    for i in range(offset, offset + size):
        yield i, f"filing_{i}.pdf", "EX-96" if i % 3 else "EX-99"


def filings(spark: SparkSession, pages: int, page_size: int) -> DataFrame:
    """Listed files of the wanted kind, one per id."""
    spark.dataSource.register(PagedSource)
    rows = spark.read.format("paged_listing").option("pages", pages).option("page_size", page_size).load()
    return rows.filter(F.col("kind").startswith("EX-96") & F.col("name").endswith(".pdf")).dropDuplicates(["id"])
