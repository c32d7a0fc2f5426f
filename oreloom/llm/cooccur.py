"""Items that appear together far more often than chance (problem 2).

Ordinary baskets give their pairs directly. A large basket is split into item chunks by hash; every pair of its chunks,
and every chunk with itself, is a block of its own, and blocks are spread over tasks and counted together with the
ordinary pairs. Items that cannot belong to any qualifying pair leave before pairs are formed, which changes no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreloom.functions.keys import norm_key
from oreloom.session import cut

#: A basket of more items than this is split into chunks of so many, or of the root of its size if that is more, but at
#: most WIDEST; no block forms more than about WIDEST x WIDEST pairs.
CHUNK, WIDEST = 8, 256
#: Items that can be in a qualifying pair, over all lists, up to which they are broadcast (about 15 MB); more are joined by a shuffle.
BROADCAST_ITEMS = 150_000
MIN_SUPPORT = 5
MIN_LIFT = 3.0


def latest_records(predictions: DataFrame) -> DataFrame:
    """The latest row of each doc_id; equal times are told apart by the lists themselves. Null ids are one record."""
    return (
        predictions.groupBy("doc_id")
        .agg(F.max(F.struct("produced_at", "ground_truth", "xgb_stages")).alias("r"))
        .select("doc_id", "r.ground_truth", "r.xgb_stages")
    )


def stage_baskets(predictions: DataFrame) -> DataFrame:
    """basket, list_name, items: distinct normalised names; lists without a name are no record."""
    clean = lambda c: F.array_distinct(F.filter(F.transform(c, norm_key), lambda x: x.isNotNull()))
    lists = F.array(
        *[F.struct(F.lit(n).alias("list_name"), clean(F.col(n)).alias("items")) for n in ("ground_truth", "xgb_stages")]
    )
    return (
        latest_records(predictions)
        .select(F.col("doc_id").alias("basket"), F.inline(lists))
        .filter(F.size("items") > 0)
    )


def chunk_count(size: Column, chunk: int = CHUNK) -> Column:
    """Chunks of a basket of so many items; 1 for an ordinary basket."""
    side = F.least(F.greatest(F.sqrt(size), F.lit(float(chunk))), F.lit(float(max(chunk, WIDEST))))
    return F.ceil(size / side).cast("int")


def _pairs_within(blocks: DataFrame) -> DataFrame:
    """list_name, a, b of all pairs of each sorted array ``items``."""
    firsts = blocks.filter(F.size("items") > 1).select("list_name", "items", F.posexplode("items").alias("i", "a"))
    rest = F.slice("items", F.col("i") + 2, F.greatest(F.size("items") - F.col("i") - 1, F.lit(0)))
    return firsts.select("list_name", "a", F.explode(rest).alias("b"))


def _pairs_between(blocks: DataFrame) -> DataFrame:
    """list_name, a, b of all pairs of an item of ``l`` and one of ``r``."""
    pairs = blocks.select("list_name", "r", F.explode("l").alias("x")).select("list_name", "x", F.explode("r").alias("y"))
    return pairs.select("list_name", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def large_blocks(chunks: DataFrame) -> DataFrame:
    """Blocks (list_name, basket, lo, hi, l, r) of large baskets from their chunks (list_name, basket, chunks, i, items): every
    chunk goes to the blocks of all pairs (lo <= hi) that it takes part in, each a group of its own.
    """
    to = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(F.least("i", j).alias("lo"), F.greatest("i", j).alias("hi")))
    spread = chunks.select("list_name", "basket", "i", "items", F.inline(to))
    side = lambda end: F.max(F.when(F.col("i") == F.col(end), F.col("items")))
    return spread.groupBy("list_name", "basket", "lo", "hi").agg(side("lo").alias("l"), side("hi").alias("r")).filter("l IS NOT NULL AND r IS NOT NULL")


def cooccurrences(baskets: DataFrame, min_support: int = MIN_SUPPORT, min_lift: float = MIN_LIFT, chunk: int = CHUNK) -> DataFrame:
    """Pairs a < b per list_name with n_a, n_b, n_ab, n, lift and pmi, where n_ab >= min_support and lift >= min_lift.

    baskets: list_name, items (distinct non-null strings), one row per record. A pair has n_ab <= min(n_a, n_b), so an item
    with fewer than min_support baskets, or with n_item * min_lift > n, can be in no such pair.
    """
    baskets = cut(baskets.select("list_name", "items")).withColumns({"basket": F.monotonically_increasing_id(), "chunks": chunk_count(F.size("items"), chunk)})
    rows = baskets.select("basket", "list_name", "chunks", F.explode("items").alias("item"))
    sizes = baskets.groupBy("list_name").agg(F.count("*").alias("n"))
    counts = baskets.select("list_name", F.explode("items").alias("item")).groupBy("list_name", "item").agg(F.count("*").alias("n_item"))
    able = counts.filter(F.col("n_item") >= min_support).join(sizes, "list_name").filter(F.col("n_item") * min_lift <= F.col("n"))
    able = cut(able)
    if able.count() <= BROADCAST_ITEMS:
        able = F.broadcast(able)
    spot = F.pmod(F.xxhash64("item"), F.col("chunks")).cast("int")
    items = (
        rows.join(able, ["list_name", "item"], "left_semi")
        .groupBy("list_name", "basket", "chunks", spot.alias("i"))
        .agg(F.array_sort(F.collect_list("item")).alias("items"))
    )
    ordinary = _pairs_within(items.filter("chunks = 1"))
    blocks = large_blocks(items.filter("chunks > 1"))
    same = _pairs_within(blocks.filter("lo = hi").select("list_name", F.col("l").alias("items")))
    pairs = ordinary.unionByName(same).unionByName(_pairs_between(blocks.filter("lo < hi")))
    pairs = pairs.groupBy("list_name", "a", "b").agg(F.count("*").alias("n_ab")).filter(F.col("n_ab") >= min_support)
    of = lambda side, *more: able.select("list_name", F.col("item").alias(side), F.col("n_item").alias(f"n_{side}"), *more)
    scored = pairs.join(of("a", "n"), ["list_name", "a"]).join(of("b"), ["list_name", "b"])
    together, apart = (F.col(x).cast("double") * F.col(y) for x, y in (("n_ab", "n"), ("n_a", "n_b")))
    return scored.filter(together >= F.lit(min_lift) * apart).select(
        "list_name", "a", "b", "n_a", "n_b", "n_ab", "n", (together / apart).alias("lift"), F.log2(together / apart).alias("pmi")
    )


def blocked_baskets(baskets: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Per list_name: baskets, those that are split, and the blocks that their chunks form."""
    k = chunk_count(F.size("items"), chunk).cast("bigint")
    large = k > 1
    return baskets.groupBy("list_name").agg(
        F.count("*").alias("n_baskets"), F.count_if(large).alias("n_large"), F.coalesce(F.sum(F.when(large, k * (k + 1) / 2)), F.lit(0)).cast("bigint").alias("n_blocks")
    )
