"""Keyword-class counts over texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreloom.functions.text import DOMAIN_KEYWORDS, MINERAL_PATTERNS, mineral_pattern
from oreloom.session import spread


def keyword_classes(texts: DataFrame, key: str, text: str, patterns: dict[str, tuple[str, ...]] = MINERAL_PATTERNS) -> DataFrame:
    """(key, class, n) of the classes mentioned in each text, every pattern counted by itself; absent classes give no row.

    One-word names are found by looking the text's words up in the (small, fixed) name table, a broadcast hash join
    instead of a scan per name; names of several words may overlap and are counted by their own expression.
    Keys must be unique; a null text mentions nothing.
    """
    spark = texts.sparkSession
    names = [(n.lower(), n, m, any(c.isupper() for c in n)) for m, ns in patterns.items() for n in ns if n.isalnum()]
    dim = F.broadcast(spark.createDataFrame(names, "folded string, name string, class string, exact boolean"))
    words = texts.select(key, F.explode(F.split(text, "[^A-Za-z0-9_]+")).alias("word"))
    single = words.join(dim, (F.lower("word") == F.col("folded")) & (~F.col("exact") | (F.col("word") == F.col("name"))))
    single = single.groupBy(key, "class").agg(F.count("*").alias("n"))
    counted = F.array(*[
        F.struct(F.lit(m).alias("class"), F.regexp_count(text, F.lit(mineral_pattern(n))).cast("bigint").alias("n")) for m, ns in patterns.items() for n in ns if not n.isalnum()
    ])
    several = texts.select(key, F.inline(counted)).filter("n > 0")
    return single.unionByName(several).groupBy(key, "class").agg(F.sum("n").alias("n"))


def domain_keyword_counts(texts: DataFrame, key: str, text: str, keywords: dict[str, tuple[str, ...]] = DOMAIN_KEYWORDS) -> DataFrame:
    """(key, grp, keyword, n) of the keywords that each lower-cased text holds, anywhere in it; '_' stands for '_' or a blank.

    Arrow's substring kernel counts one keyword over a whole batch at a time; texts without any keyword, and null ones, give no row.
    """
    listed = [(g, k, k.replace("_", " ")) for g, ks in keywords.items() for k in ks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, flat = batch.column(0), batch.column(1)
            for g, k, word in listed:
                n = pc.count_substring(flat, word).to_numpy(zero_copy_only=False)
                at = np.flatnonzero(n)
                if len(at):
                    same = lambda x: pa.array([x] * len(at), pa.string())  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(at)), same(g), same(k), pa.array(n[at].astype(np.int32))], names=[key, "grp", "keyword", "n"])

    kind = texts.schema[key].dataType.simpleString()
    flat = F.translate(F.lower(text), "_", " ").alias("__flat")
    return spread(texts.filter(F.col(text).isNotNull()).select(key, flat)).mapInArrow(run, f"{key} {kind}, grp string, keyword string, n int")
