"""References to records that do not exist (problem 4).

A Bloom filter of the parent keys, built with partial aggregation as one row of four 64-bit words per slot, proves
definite orphans; only the filter-positive references are verified by an exact join against the parents' life spans.
The filter is broadcast while it is small, which spares the references a shuffle; a larger one is joined by slot.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of a slot; a key sets one bit in each.
WORDS = 4
#: Bits spent per parent row at any size (about 2 % false positives).
BITS_PER_KEY = 10
#: Slots that may be broadcast, about 25 MB as a hash table (10 million parents); a larger filter keeps its bits a key and is
#: joined by slot in a shuffle instead.
BROADCAST_SLOTS = 400_000
#: Life spans per chunk of one parent key; a key made again more often than this is split into several chunks.
SPANS_PER_CHUNK = 256


def _slot(h: Column, slots: int) -> Column:
    return F.pmod(h, F.lit(slots)).cast("bigint")


def _masks(h: Column) -> list[Column]:
    """One bit in each word, from the hash of the hash, so that they do not follow from the slot."""
    again = F.xxhash64(h)
    return [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(again, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def bloom_slots(keys: DataFrame, hash_col: str, n_rows: int) -> tuple[DataFrame, int]:
    """Blocked Bloom filter of ``hash_col`` (bigint): rows (slot, w0..w3 bigint), and the number of slots."""
    slots = max(1, math.ceil(n_rows * BITS_PER_KEY / (64 * WORDS)))
    h = F.col(hash_col)
    bits = keys.select(_slot(h, slots).alias("slot"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(h))])
    return bits.groupBy("slot").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]), slots


def might_contain(refs: DataFrame, hash_col: str, filter_: DataFrame, slots: int, flag: str = "maybe") -> DataFrame:
    """Adds a boolean: false proves that the key is not among the parents."""
    h = F.col(hash_col)
    named = filter_.select(F.col("slot").alias("__slot"), *[F.col(f"w{i}").alias(f"__w{i}") for i in range(WORDS)])
    near = F.broadcast(named) if slots <= BROADCAST_SLOTS else named
    hit = F.lit(True)
    for i, mask in enumerate(_masks(h)):
        hit = hit & (F.col(f"__w{i}").bitwiseAND(mask) != 0)
    marked = refs.withColumn("__slot", _slot(h, slots)).join(near, "__slot", "left")
    return marked.withColumn(flag, F.coalesce(hit, F.lit(False))).drop("__slot", *[f"__w{i}" for i in range(WORDS)])


def life_spans(parents: DataFrame, keys: list[str], created: str = "created", deleted: str = "deleted") -> DataFrame:
    """Disjoint life spans of each parent key in chunks: (keys, born, from_t, to_t, spans array<struct<lo,hi>>).

    Overlapping spans of a key merge while streaming through a sorted window, hence a key with very
    many rows never sits in memory; its chunks partition the time axis, so each reference meets one chunk.
    """
    lo = F.coalesce(F.col(created), F.lit("9999-12-31").cast("timestamp"))
    hi = F.coalesce(F.col(deleted), F.lit("9999-12-31").cast("timestamp"))
    rows = parents.select(*keys, lo.alias("lo"), F.greatest(lo, hi).alias("hi"))
    by_key = Window.partitionBy(*keys).orderBy("lo", "hi")
    before = by_key.rowsBetween(Window.unboundedPreceding, -1)
    upto = by_key.rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max("hi").over(before)
    marked = rows.withColumn("__new", F.when(reach.isNull() | (F.col("lo") > reach), 1).otherwise(0))
    numbered = marked.withColumn("__span", F.sum("__new").over(upto) - 1)
    merged = numbered.groupBy(*keys, "__span").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    chunked = (
        merged.withColumn("__chunk", F.floor(F.col("__span") / SPANS_PER_CHUNK))
        .groupBy(*keys, "__chunk")
        .agg(F.min("lo").alias("from_t"), F.collect_list(F.struct("lo", "hi")).alias("spans"))
    )
    order = Window.partitionBy(*keys).orderBy("__chunk")
    return chunked.select(
        *keys,
        F.first("from_t").over(order).alias("born"),
        F.when(F.col("__chunk") == 0, F.lit("0001-01-01").cast("timestamp")).otherwise(F.col("from_t")).alias("from_t"),
        F.lead("from_t").over(order).alias("to_t"),
        "spans",
    )


def find_orphans(refs: DataFrame, parents: DataFrame, keys: list[str], n_parents: int) -> DataFrame:
    """Orphan references with their reason.

    refs: ref_field, row_id, ``keys``, at (timestamp); rows with a null key refer to nothing and must be filtered out.
    parents: ``keys``, created, deleted. Result: ref_field, row_id, ref_month, reason, distinct.

    A reference without a time is never sound ('missing' or 'late'); a parent without a creation time exists
    but is never born ('late'); a parent deleted no later than it was created never lives.
    """
    # The hash leads the keys wherever rows are sorted by them: most comparisons then end at one number.
    hashed = F.xxhash64(*[F.col(k) for k in keys])
    parents, led = parents.withColumn("__h", hashed), ["__h", *keys]
    filter_, slots = bloom_slots(parents.select("__h"), "__h", n_parents)
    flagged = might_contain(refs.withColumn("__h", hashed), "__h", filter_, slots, "__maybe")
    month = F.date_format("at", "yyyy-MM").alias("ref_month")

    proven = flagged.filter(~F.col("__maybe")).select("ref_field", "row_id", month, F.lit("missing").alias("reason"))

    spans = life_spans(parents, led)
    asked = flagged.filter("__maybe").withColumn("__t", F.coalesce("at", F.lit("0001-01-01").cast("timestamp")))
    on = [F.col(f"r.{k}") == F.col(f"p.{k}") for k in led]
    on += [F.col("__t") >= F.col("from_t"), F.col("to_t").isNull() | (F.col("__t") < F.col("to_t"))]
    joined = asked.alias("r").join(spans.alias("p"), on, "left")
    lives = F.exists("spans", lambda s: (s["lo"] <= F.col("at")) & (F.col("at") < s["hi"]))
    reason = (
        F.when(F.col("spans").isNull(), "missing")
        .when(F.coalesce(F.col("born") <= F.col("at"), F.lit(False)), "deleted")
        .otherwise("late")
    )
    verified = joined.filter(F.col("spans").isNull() | ~F.coalesce(lives, F.lit(False))).select(
        "ref_field", "row_id", month, reason.alias("reason")
    )
    return proven.unionByName(verified).distinct()


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per referring field, period and reason."""
    return orphans.groupBy("ref_field", "ref_month", "reason").agg(F.count("*").alias("n_orphans"))
