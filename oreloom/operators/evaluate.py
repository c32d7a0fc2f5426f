"""Evaluation of predictions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def f1_columns(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall, f1 with 0 on empty denominators."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    p, r = zero(F.try_divide(tp, tp + fp)), zero(F.try_divide(tp, tp + fn))
    return [p.alias("precision"), r.alias("recall"), zero(F.try_divide(2 * tp, 2 * tp + fp + fn)).alias("f1")]


def outcomes(pred: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """One row per cell of either side: keys, is_pred, is_true. Duplicates count once."""
    p = pred.select(*keys).distinct().withColumn("is_pred", F.lit(1))
    t = truth.select(*keys).distinct().withColumn("is_true", F.lit(1))
    return p.join(t, keys, "full_outer").select(*keys, F.coalesce("is_pred", F.lit(0)).alias("is_pred"), F.coalesce("is_true", F.lit(0)).alias("is_true"))


def _counts() -> list[Column]:
    p, t = F.col("is_pred"), F.col("is_true")
    return [F.sum(p * t).alias("tp"), F.sum(p * (1 - t)).alias("fp"), F.sum((1 - p) * t).alias("fn")]


def micro_f1(cells: DataFrame) -> DataFrame:
    """Global counts and P/R/F1."""
    return cells.agg(*_counts()).select("tp", "fp", "fn", *f1_columns(F.col("tp"), F.col("fp"), F.col("fn")))


def per_class_f1(cells: DataFrame, label: str, min_support: int = 2) -> DataFrame:
    """P/R/F1 per class; classes with fewer true cells than min_support are unscored (null f1)."""
    out = cells.groupBy(label).agg(*_counts(), F.sum("is_true").alias("support"))
    p, r, f = f1_columns(F.col("tp"), F.col("fp"), F.col("fn"))
    scored = F.col("support") >= min_support
    return out.select(label, "support", "tp", "fp", "fn", F.when(scored, p).alias("precision"), F.when(scored, r).alias("recall"), F.when(scored, f).alias("f1"))


def macro_f1(per_class: DataFrame) -> DataFrame:
    """Mean F1 of the scored classes and micro F1 over all their cells."""
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    scored = per_class.filter("f1 IS NOT NULL")
    return scored.agg(F.count("*").alias("n_classes"), F.avg("f1").alias("macro_f1"), f1_columns(tp, fp, fn)[2].alias("micro_f1"))


def per_document_f1(cells: DataFrame, doc: str = "doc") -> DataFrame:
    """P/R/F1 per document; documents empty on both sides have no cells and thus no row."""
    return cells.groupBy(doc).agg(*_counts()).select(doc, "tp", "fp", "fn", *f1_columns(F.col("tp"), F.col("fp"), F.col("fn")))


def banded(rows: DataFrame, value: str, bands: list[tuple[str, float, float]], group: str, metric: str) -> DataFrame:
    """Mean metric by band [lo, hi) and group, with subtotals over all groups and all bands (grouping sets)."""
    band = F.lit(None).cast("string")
    for name, lo, hi in reversed(bands):
        band = F.when((F.col(value) >= lo) & (F.col(value) < hi), name).otherwise(band)
    cube = rows.withColumn("band", band).cube("band", group)
    return cube.agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.avg(metric).alias("mean"))


def top_k_recall(scores: DataFrame, truth: DataFrame, doc: str, item: str, score: str, ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Per document |true and in the top k| / |true| for each k; ties by item name."""
    rank = F.row_number().over(Window.partitionBy(doc).orderBy(F.desc(score), item))
    ranked = scores.select(doc, item, rank.alias("rank"))
    joined = truth.select(doc, item).distinct().join(ranked, [doc, item], "left")
    return joined.groupBy(doc).agg(F.count("*").alias("n_true"), *[(F.count_if(F.col("rank") <= k) / F.count("*")).alias(f"recall_{k}") for k in ks])


def threshold_sweep(scored: DataFrame, label: str, prob: str, truth: str, lo: float = 0.15, hi: float = 0.85, step: float = 0.05, beta: float | Column = 1.0) -> DataFrame:
    """F-beta of every label and threshold from one pass: counts per score bucket, then suffix sums. beta may depend on all_pos.

    No grid is crossed with the rows; the shuffle carries one row per label and bucket.
    """
    steps = round((hi - lo) / step)
    bucket = F.least(F.floor((F.col(prob) - lo) / step + 1e-9), F.lit(steps)).cast("int")  # passes thresholds 0..bucket
    per = scored.groupBy(label, bucket.alias("b")).agg(F.count("*").alias("n"), F.sum(F.col(truth).cast("int")).alias("pos"))
    total = per.groupBy(label).agg(F.sum("pos").alias("all_pos"), F.collect_list(F.struct("b", "n", "pos")).alias("hist"))
    grid = total.select(label, "all_pos", "hist", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("i"))
    passed = F.filter("hist", lambda h: h["b"] >= F.col("i"))
    n = F.aggregate(passed, F.lit(0).cast("bigint"), lambda a, h: a + h["n"])
    tp = F.aggregate(passed, F.lit(0).cast("bigint"), lambda a, h: a + h["pos"])
    counted = grid.select(label, F.round(lo + F.col("i") * step, 4).alias("threshold"), "all_pos", n.alias("n"), tp.alias("tp"))
    b2 = beta * beta
    score = F.coalesce(F.try_divide((1 + b2) * F.col("tp"), b2 * F.col("all_pos") + F.col("n")), F.lit(0.0))
    return counted.select(label, "threshold", score.alias("f_beta"))


def best_threshold(sweep: DataFrame, label: str) -> DataFrame:
    """The threshold of the best score, the lowest on ties."""
    best = F.max_by(F.struct("threshold", "f_beta"), F.struct(F.round("f_beta", 12), -F.col("threshold")))
    return sweep.groupBy(label).agg(best.alias("b")).select(label, "b.threshold", "b.f_beta")


def tuned_threshold(scored: DataFrame, label: str, prob: str, truth: str, rare: int = 25, rare_beta: float = 1.5) -> DataFrame:
    """Threshold of each label in two passes: the best of 0.15 to 0.85 by 0.05, then by 0.01 up to 0.05 around it.

    F1, or F-beta for labels with fewer than ``rare`` positives; on ties the coarse one, then the lowest; 0.5 where
    no threshold scores. Both passes read one sweep by 0.01, at most 81 rows per label.
    """
    beta = F.when(F.col("all_pos") < rare, rare_beta).otherwise(1.0)
    sweep = threshold_sweep(scored, label, prob, truth, 0.10, 0.90, 0.01, beta)
    sweep = sweep.withColumn("__t", F.round(F.col("threshold") * 100).cast("int")).withColumn("__f", F.round("f_beta", 12))
    coarse = F.when((F.col("__t") % 5 == 0) & F.col("__t").between(15, 85) & (F.col("__f") > 0), F.struct("__f", (-F.col("__t")).alias("t")))
    at = F.coalesce(-F.max(coarse).over(Window.partitionBy(label))["t"], F.lit(50))
    near = sweep.withColumn("__at", at).filter(F.abs(F.col("__t") - F.col("__at")) <= 5)
    order = F.struct("__f", (F.col("__t") == F.col("__at")).cast("int").alias("same"), (-F.col("__t")).alias("t"))
    return near.groupBy(label).agg(F.max_by(F.struct("threshold", "f_beta"), order).alias("b")).select(label, "b.threshold", "b.f_beta")


def worst(rows: DataFrame, metric: str, name: str, k: int = 5) -> DataFrame:
    """The k rows with the lowest metric (a report), ties by name."""
    return rows.orderBy(F.col(metric).asc_nulls_last(), name).limit(k)


def kendall_tau(left: DataFrame, right: DataFrame) -> DataFrame:
    """H4: tau over the items that both orders of a doc hold; 0 if fewer than two. (doc, item, pos) each."""
    both = left.select("doc", "item", F.col("pos").alias("a")).join(right.select("doc", "item", F.col("pos").alias("b")), ["doc", "item"])
    lists = both.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("xs"))
    sign = lambda x, y: F.when(y["b"] > x["b"], 1).when(y["b"] < x["b"], -1).otherwise(0)
    inner = lambda x, i: F.aggregate(F.slice("xs", i + 2, F.size("xs")), F.lit(0), lambda acc, y: acc + sign(x, y))
    total = F.aggregate(F.transform("xs", inner), F.lit(0), lambda acc, v: acc + v)
    n = F.size("xs")
    return lists.select("doc", n.alias("n_common"), F.when(n < 2, 0.0).otherwise(2.0 * total / (n * (n - 1))).alias("tau"))


def lcs_ratio(left: DataFrame, right: DataFrame) -> DataFrame:
    """H5: length of the longest common subsequence of the common items over their number; 0 without any.

    Both orders are permutations of the same items, hence it is a longest increasing run, found in O(n log n).
    """
    import bisect

    both = left.select("doc", "item", F.col("pos").alias("a")).join(right.select("doc", "item", F.col("pos").alias("b")), ["doc", "item"])
    lists = both.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("a", "b"))), lambda x: x["b"]).alias("bs"))

    @F.pandas_udf("double")
    def ratio(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for bs in batch:
                tails: list = []
                for b in bs:
                    at = bisect.bisect_left(tails, b)
                    tails[at : at + 1] = [b]
                out.append(len(tails) / len(bs) if len(bs) else 0.0)
            yield pd.Series(out)

    return lists.select("doc", F.size("bs").alias("n_common"), ratio("bs").alias("lcs"))
