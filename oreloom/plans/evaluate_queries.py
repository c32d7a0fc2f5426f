"""Queries of the evaluation family over test_predictions and flow tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreloom.operators import evaluate as E
from oreloom.plans.base import BOTH, LATEST, SEQ, latest_predictions, predicted, sequences, truth
from oreloom.plans.registry import query
from oreloom.session import table

_CELLS = f"WITH {BOTH}, cells AS (SELECT coalesce(p.doc, t.doc) AS doc, coalesce(p.item, t.item) AS item, (p.doc IS NOT NULL)::INT AS ip, (t.doc IS NOT NULL)::INT AS it FROM pred p FULL JOIN truth t ON p.doc = t.doc AND p.item = t.item)"
_PRF = """round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"""
_SUMS = "sum(ip * it)::BIGINT AS tp, sum(ip * (1 - it))::BIGINT AS fp, sum((1 - ip) * it)::BIGINT AS fn"
_R = lambda c, d=6: F.round(c, d).alias(c)
_prf = lambda: [_R(c) for c in ("precision", "recall", "f1")]


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    return E.outcomes(predicted(spark, sf), truth(spark, sf), ["doc", "item"])


@query(f"{_CELLS}, s AS (SELECT {_SUMS} FROM cells) SELECT tp, fp, fn, {_PRF} FROM s")
def a21_micro_f1(spark: SparkSession, sf: str) -> DataFrame:
    return E.micro_f1(_cells(spark, sf)).select("tp", "fp", "fn", *_prf())


_PER = f"{_CELLS}, s AS (SELECT item, {_SUMS}, sum(it)::BIGINT AS support FROM cells GROUP BY 1), c AS (SELECT item, support, tp, fp, fn, {_PRF} FROM s)"


@query(_PER + ' SELECT item, support, tp, fp, fn, CASE WHEN support >= 2 THEN "precision" END AS "precision", CASE WHEN support >= 2 THEN recall END AS recall, CASE WHEN support >= 2 THEN f1 END AS f1 FROM c')
def a22_per_class_f1(spark: SparkSession, sf: str) -> DataFrame:
    return E.per_class_f1(_cells(spark, sf), "item").select("item", "support", "tp", "fp", "fn", *_prf())


@query(
    f"{_CELLS}, s AS (SELECT item, {_SUMS}, sum(it) AS support FROM cells GROUP BY 1 HAVING sum(it) >= 2) SELECT count(*) AS n_classes, round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)), 6) AS macro_f1,"
    " round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1 FROM s"
)
def a22_macro_f1(spark: SparkSession, sf: str) -> DataFrame:
    return E.macro_f1(E.per_class_f1(_cells(spark, sf), "item")).select("n_classes", _R("macro_f1"), _R("micro_f1"))


@query(f"{_CELLS}, s AS (SELECT doc, {_SUMS} FROM cells GROUP BY 1) SELECT doc, tp, fp, fn, {_PRF} FROM s")
def a23_per_document_f1(spark: SparkSession, sf: str) -> DataFrame:
    return E.per_document_f1(_cells(spark, sf)).select("doc", "tp", "fp", "fn", *_prf())


@query(
    f"WITH {LATEST}, b AS (SELECT *, CASE WHEN doc_f1 >= 0 AND doc_f1 < 0.5 THEN 'low' WHEN doc_f1 >= 0.5 AND doc_f1 < 0.8 THEN 'mid' WHEN doc_f1 >= 0.8 AND doc_f1 < 1.01 THEN 'high' END AS band FROM latest)"
    " SELECT band, split, grouping_id(band, split) AS level, count(*) AS n, round(avg(doc_f1), 6) AS mean FROM b GROUP BY CUBE (band, split)"
)
def a24_banded(spark: SparkSession, sf: str) -> DataFrame:
    bands = [("low", 0.0, 0.5), ("mid", 0.5, 0.8), ("high", 0.8, 1.01)]
    return E.banded(latest_predictions(spark, sf), "doc_f1", bands, "split", "doc_f1").select("band", "split", "level", "n", _R("mean"))


_SCORES = "x AS (SELECT doc_id AS doc, k AS item, max(v) AS p FROM (SELECT doc_id, unnest(map_keys(xgb_predicted)) AS k, unnest(map_values(xgb_predicted)) AS v FROM test_predictions) GROUP BY 1, 2)"


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "test_predictions").select(F.col("doc_id").alias("doc"), F.explode("xgb_predicted").alias("item", "p"))
    return rows.groupBy("doc", "item").agg(F.max("p").alias("p"))


@query(
    f"WITH {BOTH}, {_SCORES}, r AS (SELECT doc, item, row_number() OVER (PARTITION BY doc ORDER BY p DESC, item) AS rank FROM x)"
    " SELECT t.doc, count(*) AS n_true, round(count(*) FILTER (rank <= 5) / count(*), 6) AS recall_5, round(count(*) FILTER (rank <= 10) / count(*), 6) AS recall_10, round(count(*) FILTER (rank <= 20) / count(*), 6) AS recall_20"
    " FROM truth t LEFT JOIN r ON r.doc = t.doc AND r.item = t.item GROUP BY 1"
)
def a25_top_k_recall(spark: SparkSession, sf: str) -> DataFrame:
    out = E.top_k_recall(_scores(spark, sf), truth(spark, sf), "doc", "item", "p")
    return out.select("doc", "n_true", _R("recall_5"), _R("recall_10"), _R("recall_20"))


_SWEEP = (
    f"WITH {BOTH}, {_SCORES}, s AS (SELECT x.item, x.p, (t.doc IS NOT NULL)::INT AS y FROM x LEFT JOIN truth t ON t.doc = x.doc AND t.item = x.item),"
    " g AS (SELECT i, round(0.15::DOUBLE + i * 0.05::DOUBLE, 4) AS threshold FROM range(15) AS r(i)),"
    " f AS (SELECT item, i, threshold, sum(y) AS all_pos, count(*) FILTER (least(floor((p - 0.15) / 0.05 + 1e-9), 14) >= i) AS n, coalesce(sum(y) FILTER (least(floor((p - 0.15) / 0.05 + 1e-9), 14) >= i), 0) AS tp FROM s, g GROUP BY 1, 2, 3),"
    " sweep AS (SELECT item, threshold, coalesce(2 * tp / nullif(all_pos + n, 0), 0) AS f FROM f)"
)


_SCORED = f"WITH {BOTH}, {_SCORES}, scored AS (SELECT x.item, x.p, (t.doc IS NOT NULL)::INT AS y FROM x LEFT JOIN truth t ON t.doc = x.doc AND t.item = x.item)"


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf).join(truth(spark, sf).withColumn("y", F.lit(1)), ["doc", "item"], "left").withColumn("y", F.coalesce("y", F.lit(0)))


def _sweep(spark: SparkSession, sf: str) -> DataFrame:
    return E.threshold_sweep(_scored(spark, sf), "item", "p", "y")


@query(_SWEEP + " SELECT item, threshold, round(f, 6) AS f_beta FROM sweep")
def l8_threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return _sweep(spark, sf).select("item", "threshold", _R("f_beta"))


@query(
    _SCORED
    + ", pos AS (SELECT item, sum(y) AS pos FROM scored GROUP BY 1), g AS (SELECT item, pos, t FROM pos, (SELECT unnest(generate_series(10, 90)) AS t)),"
    " c AS (SELECT g.item, pos, t, CASE WHEN pos < 25 THEN 2.25 ELSE 1 END AS b2, count(*) FILTER (least(floor((p - 0.1) / 0.01 + 1e-9), 80) >= t - 10) AS n, coalesce(sum(y) FILTER (least(floor((p - 0.1) / 0.01 + 1e-9), 80) >= t - 10), 0) AS tp FROM g JOIN scored s ON s.item = g.item GROUP BY 1, 2, 3),"
    " f AS (SELECT item, t, round(coalesce((1 + b2) * tp / nullif(b2 * pos + n, 0), 0), 12) AS f FROM c),"
    " o AS (SELECT item, t FROM f WHERE t % 5 = 0 AND t BETWEEN 15 AND 85 AND f > 0 QUALIFY row_number() OVER (PARTITION BY item ORDER BY f DESC, t) = 1),"
    " a AS (SELECT pos.item, coalesce(o.t, 50) AS mid FROM pos LEFT JOIN o ON o.item = pos.item),"
    " r AS (SELECT f.item, t, f, row_number() OVER (PARTITION BY f.item ORDER BY f DESC, (t = mid) DESC, t) AS rn FROM f JOIN a ON a.item = f.item AND abs(t - mid) <= 5)"
    " SELECT item, t / 100.0 AS threshold, round(f, 6) AS f_beta FROM r WHERE rn = 1"
)
def l8_tuned_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return E.tuned_threshold(_scored(spark, sf), "item", "p", "y").select("item", "threshold", _R("f_beta"))


@query(_SWEEP + ", r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY round(f, 12) DESC, threshold) AS rn FROM sweep) SELECT item, threshold, round(f, 6) AS f_beta FROM r WHERE rn = 1")
def w14_best_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return E.best_threshold(_sweep(spark, sf), "item").select("item", "threshold", _R("f_beta"))


@query(f"WITH {LATEST} SELECT doc, doc_f1 FROM latest ORDER BY doc_f1 ASC NULLS LAST, doc LIMIT 5")
def w15_worst(spark: SparkSession, sf: str) -> DataFrame:
    return E.worst(latest_predictions(spark, sf).select("doc", "doc_f1"), "doc_f1", "doc")


_ORDERS = f"WITH {SEQ}, l AS (SELECT doc, stage AS item, min(pos) AS pos FROM seq GROUP BY 1, 2), r AS (SELECT image_id AS doc, lower(trim(stage_name, E' \\t\\n\\r')) AS item, min(epoch_us(created_at)) AS pos FROM flow_stages WHERE deleted_at IS NULL AND stage_name IS NOT NULL GROUP BY 1, 2), b AS (SELECT l.doc, l.item, l.pos AS a, r.pos AS b FROM l JOIN r ON l.doc = r.doc AND l.item = r.item)"


def _orders(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    from oreloom.functions.keys import norm_key

    left = sequences(spark, sf).groupBy("doc", F.col("stage").alias("item")).agg(F.min("pos").alias("pos"))
    rows = table(spark, sf, "flow_stages").filter("deleted_at IS NULL").select(F.col("image_id").alias("doc"), norm_key(F.col("stage_name")).alias("item"), "created_at")
    right = rows.filter("item IS NOT NULL").groupBy("doc", "item").agg(F.min(F.unix_micros(F.col("created_at").cast("timestamp"))).alias("pos"))
    return left, right


@query(
    _ORDERS
    + ", n AS (SELECT doc, count(*) AS n FROM b GROUP BY 1), c AS (SELECT x.doc, sum(sign(y.b - x.b)) AS s FROM b x JOIN b y ON x.doc = y.doc AND y.a > x.a GROUP BY 1)"
    + " SELECT n.doc, n.n::INT AS n_common, round(CASE WHEN n.n < 2 THEN 0.0 ELSE 2.0 * coalesce(s, 0) / (n.n * (n.n - 1)) END, 6) AS tau FROM n LEFT JOIN c ON c.doc = n.doc"
)
def h4_kendall_tau(spark: SparkSession, sf: str) -> DataFrame:
    return E.kendall_tau(*_orders(spark, sf)).select("doc", "n_common", _R("tau"))


@query(
    _ORDERS.replace("WITH ", "WITH RECURSIVE ", 1)
    + ", up AS (SELECT doc, a, b, 1 AS len FROM b UNION SELECT n.doc, n.a, n.b, len + 1 FROM up JOIN b n ON n.doc = up.doc AND n.a > up.a AND n.b > up.b),"
    + " m AS (SELECT doc, max(len) AS len FROM up GROUP BY 1) SELECT b.doc, count(*)::INT AS n_common, round(any_value(m.len) / count(*), 6) AS lcs FROM b JOIN m ON m.doc = b.doc GROUP BY 1"
)
def h5_lcs_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return E.lcs_ratio(*_orders(spark, sf)).select("doc", "n_common", _R("lcs"))


@query()
def h6_ordering(spark: SparkSession, sf: str) -> DataFrame:
    """Means of tau and LCS over flowsheets with at least two common stages."""
    left, right = _orders(spark, sf)
    both = E.kendall_tau(left, right).join(E.lcs_ratio(left, right).drop("n_common"), "doc").filter("n_common >= 2")
    return both.agg(F.count("*").alias("n_docs"), F.round(F.avg("tau"), 6).alias("tau"), F.round(F.avg("lcs"), 6).alias("lcs"))
