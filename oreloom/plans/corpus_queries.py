"""Queries of the corpus statistics (A1-A20, A26-A29, W1-W7, H10) over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreloom.operators import corpus as C
from oreloom.plans.base import LATEST, LINKS, SEQ, TRUTH, latest_predictions, links, sequences, truth
from oreloom.plans.registry import query
from oreloom.session import table

_TRANS = f"WITH {SEQ}, edges AS (SELECT * FROM (SELECT doc, stage AS src, lead(stage) OVER (PARTITION BY doc ORDER BY pos) AS dst FROM seq) WHERE dst IS NOT NULL)"
_R = lambda c, d=6: F.round(c, d).alias(c)


@query("SELECT document_id, count(*) AS n_units, count(DISTINCT image_id) AS n_images, count(*) FILTER (deleted_at IS NOT NULL) AS n_deleted FROM (SELECT DISTINCT * FROM flow_units) GROUP BY 1")
def a1_document_counts(spark: SparkSession, sf: str) -> DataFrame:
    units = table(spark, sf, "flow_units").distinct()
    return units.groupBy("document_id").agg(
        F.count("*").alias("n_units"), F.count_distinct("image_id").alias("n_images"), F.count_if(F.col("deleted_at").isNotNull()).alias("n_deleted")
    )


@query(_TRANS + " SELECT src, dst, count(*) AS n, count(DISTINCT doc) AS n_docs FROM edges WHERE src <> dst GROUP BY 1, 2")
def a2_network(spark: SparkSession, sf: str) -> DataFrame:
    return C.transition_counts(C.transitions(sequences(spark, sf)), self_loops=False)


@query(_TRANS + " SELECT src, dst, count(*) AS n, count(DISTINCT doc) AS n_docs FROM edges GROUP BY 1, 2")
def a3_transition_counts(spark: SparkSession, sf: str) -> DataFrame:
    return C.transition_counts(C.transitions(sequences(spark, sf)))


@query(f"WITH {TRUTH} SELECT item, count(DISTINCT doc) AS n_docs FROM truth GROUP BY 1 HAVING count(DISTINCT doc) >= 3")
def a4_support(spark: SparkSession, sf: str) -> DataFrame:
    return C.support(truth(spark, sf), 3)


_JOINT = f"WITH {SEQ}, m AS (SELECT DISTINCT doc, stage AS item FROM seq), joint AS (SELECT x.item AS a, y.item AS b, count(*) AS n_docs FROM m x JOIN m y USING (doc) GROUP BY 1, 2)"


def _members(spark: SparkSession, sf: str) -> DataFrame:
    return sequences(spark, sf).select("doc", F.col("stage").alias("item")).distinct()


@query(_JOINT + " SELECT * FROM joint")
def a5_joint_support(spark: SparkSession, sf: str) -> DataFrame:
    return C.joint_support(_members(spark, sf))


@query(_JOINT + " SELECT j.a, j.b, round(j.n_docs / d.n_docs, 6) AS p FROM joint j JOIN joint d ON d.a = j.a AND d.b = j.a")
def a6_conditional(spark: SparkSession, sf: str) -> DataFrame:
    return C.conditional_probability(C.joint_support(_members(spark, sf))).select("a", "b", _R("p"))


@query(
    _JOINT
    + ", prob AS (SELECT j.a, j.b, j.n_docs / d.n_docs AS p FROM joint j JOIN joint d ON d.a = j.a AND d.b = j.a), k AS (SELECT doc, count(*) AS k FROM m GROUP BY 1)"
    + " SELECT m.doc, prob.b, round(sum(p) / any_value(k.k), 5) AS score FROM m JOIN prob ON prob.a = m.item JOIN k ON k.doc = m.doc GROUP BY 1, 2"
)
def a7_cooccurrence_score(spark: SparkSession, sf: str) -> DataFrame:
    members = _members(spark, sf)
    prob = C.conditional_probability(C.joint_support(members))
    return C.mean_of_present(members, prob).select("doc", "b", _R("score", 5))


@query("SELECT c_mktsegment, count(c_acctbal) AS n, round(avg(c_acctbal), 4) AS mean, round(median(c_acctbal), 4) AS median, max(c_acctbal) AS max FROM customer GROUP BY 1")
def a8_numeric_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = C.numeric_summary(table(spark, sf, "customer"), ["c_mktsegment"], "c_acctbal")
    return out.select("c_mktsegment", "n", _R("mean", 4), _R("median", 4), "max")


@query(
    """SELECT user_id, """
    + ", ".join(
        f"coalesce(round({f}(value) FILTER (event_type = '{n}'), 6), 0) AS {n}_{a}" for n in ("click", "view", "purchase") for f, a in (("min", "min"), ("avg", "mean"), ("max", "max"))
    )
    + " FROM events GROUP BY 1"
)
def a9_named_summary(spark: SparkSession, sf: str) -> DataFrame:
    names = ["click", "view", "purchase"]
    out = C.summary_by_name(table(spark, sf, "events").select("user_id", F.col("event_type").alias("name"), "value"), "user_id", names)
    return out.select("user_id", *[_R(c) for c in out.columns[1:]])


@query("SELECT p_brand, round(avg(m), 5) AS mean_of_means FROM (SELECT p_brand, p_type, avg(p_retailprice) AS m FROM part GROUP BY 1, 2) GROUP BY 1")
def a10_mean_of_means(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select("p_brand", "p_type", F.col("p_retailprice").alias("value"))
    return C.mean_of_means(rows, "p_brand", "p_type").select("p_brand", _R("mean_of_means", 5))


@query("SELECT document_id, page_number, min(table_id) AS table_id FROM extracted_tables GROUP BY 1, 2")
def a11_first_by_key(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "extracted_tables").select("document_id", "page_number", "table_id")
    return C.first_by_key(rows, ["document_id", "page_number"], [F.col("table_id").asc_nulls_last()])


@query(
    "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, event_type, n, round(100.0 * n / sum(n) OVER (PARTITION BY user_id), 1) AS pct,"
    ' row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1 AS "primary" FROM c'
)
def a12_share_of_total(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return C.share_of_total(counts, "user_id", "event_type", "n")


@query(f"WITH {TRUTH} SELECT item, count(DISTINCT doc) AS n_docs, round(100.0 * count(DISTINCT doc) / (SELECT count(*) FROM latest), 6) AS pct FROM truth GROUP BY 1")
def a13_membership_frequency(spark: SparkSession, sf: str) -> DataFrame:
    total = table(spark, sf, "test_predictions").select("doc_id").distinct().count()
    return C.membership_frequency(truth(spark, sf), total).select("item", "n_docs", _R("pct"))


@query(
    "WITH v AS (SELECT o_custkey, o_orderpriority, sum(1 / (1 + o_totalprice)) AS w FROM orders GROUP BY 1, 2) SELECT o_custkey, o_orderpriority, round(w / sum(w) OVER (PARTITION BY o_custkey), 6) AS score FROM v"
)
def a14_weighted_vote(spark: SparkSession, sf: str) -> DataFrame:
    votes = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", (1 / (1 + F.col("o_totalprice"))).alias("w"))
    return C.weighted_vote(votes, "o_custkey", "o_orderpriority", "w").select("o_custkey", "o_orderpriority", _R("score"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS weighted FROM lineitem GROUP BY 1, 2")
def a15_weighted_average(spark: SparkSession, sf: str) -> DataFrame:
    return C.weighted_average(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_discount", "l_quantity").select(
        "l_returnflag", "l_linestatus", _R("weighted")
    )


@query(f"WITH {LATEST} SELECT commodity, split, max(doc_f1) AS best FROM latest WHERE doc_f1 >= 0.5 GROUP BY 1, 2")
def a16_max_where(spark: SparkSession, sf: str) -> DataFrame:
    return C.max_where(latest_predictions(spark, sf), ["commodity", "split"], "doc_f1", 0.5)


_DEG = f"WITH {LINKS}, n AS (SELECT doc, src AS node, 1 AS o, 0 AS i FROM links UNION ALL SELECT doc, dst, 0, 1 FROM links)"


@query(_DEG + " SELECT doc, node, sum(i)::BIGINT AS n_in, sum(o)::BIGINT AS n_out, sum(o) = 0 AS terminal FROM n GROUP BY 1, 2")
def a17_degrees(spark: SparkSession, sf: str) -> DataFrame:
    return C.degrees(links(spark, sf))


@query(f"WITH {SEQ}, f AS (SELECT stage, min((doc, pos)) AS first_at FROM seq GROUP BY 1) SELECT stage, (row_number() OVER (ORDER BY first_at, stage) - 1)::INT AS vocab_id FROM f")
def a18_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return C.vocabulary(sequences(spark, sf))


@query(
    _TRANS
    + """, o AS (SELECT doc, stage, CASE WHEN mx = mn THEN 0.0 ELSE (pos - mn)::DOUBLE / (mx - mn)::DOUBLE END AS ord FROM (
      SELECT *, max(pos) OVER (PARTITION BY doc) AS mx, min(pos) OVER (PARTITION BY doc) AS mn FROM seq)),
    per AS (SELECT stage, count(DISTINCT doc) AS n_docs, avg(ord) AS mo, avg((ord = 0)::INT) AS ss, avg((ord = 1)::INT) AS es FROM o GROUP BY 1),
    d AS (SELECT DISTINCT doc, src, dst FROM edges),
    deg AS (SELECT doc, node, sum(i) AS n_in, sum(o) AS n_out FROM (SELECT doc, src AS node, 0 AS i, 1 AS o FROM d UNION ALL SELECT doc, dst, 1, 0 FROM d) GROUP BY 1, 2),
    dm AS (SELECT node, avg(n_in) AS mi, avg(n_out) AS mo FROM deg GROUP BY 1),
    pa AS (SELECT dst, count(DISTINCT src) AS k FROM edges GROUP BY 1), ch AS (SELECT src, count(DISTINCT dst) AS k FROM edges GROUP BY 1)
    SELECT stage, n_docs, round(per.mo, 6) AS mean_order, round(ss, 6) AS start_share, round(es, 6) AS end_share, round(coalesce(dm.mi, 0), 6) AS mean_in,
      round(coalesce(dm.mo, 0), 6) AS mean_out, coalesce(pa.k, 0) AS n_parents, coalesce(ch.k, 0) AS n_children
    FROM per LEFT JOIN dm ON dm.node = stage LEFT JOIN pa ON pa.dst = stage LEFT JOIN ch ON ch.src = stage"""
)
def a19_stage_statistics(spark: SparkSession, sf: str) -> DataFrame:
    seq = sequences(spark, sf)
    out = C.stage_statistics(seq, C.transitions(seq))
    return out.select("stage", "n_docs", *[_R(c) for c in ("mean_order", "start_share", "end_share", "mean_in", "mean_out")], "n_parents", "n_children")


@query(
    f"WITH {TRUTH}, cond AS (SELECT DISTINCT doc, 'commodity=' || commodity AS condition FROM latest WHERE commodity IS NOT NULL), base AS (SELECT condition, count(*) AS support FROM cond GROUP BY 1 HAVING count(*) >= 5),"
    " b AS (SELECT condition, item, count(*) AS n_both FROM cond JOIN truth USING (doc) GROUP BY 1, 2)"
    " SELECT condition, item, n_both, support, round(n_both / support, 6) AS confidence FROM b JOIN base USING (condition) WHERE n_both / support >= 0.02"
)
def a20_association_rules(spark: SparkSession, sf: str) -> DataFrame:
    cond = latest_predictions(spark, sf).filter("commodity IS NOT NULL").select("doc", F.concat(F.lit("commodity="), "commodity").alias("condition"))
    out = C.association_rules(cond, truth(spark, sf), 5, 0.02)
    return out.select("condition", "item", "n_both", "support", _R("confidence"))


@query(
    "WITH s AS (SELECT p_brand AS section, p_type AS stage, sum(p_size) AS s FROM part GROUP BY 1, 2) SELECT section, stage, round(s / max(s) OVER (PARTITION BY stage), 6) AS influence FROM s"
)
def a26_influence_matrix(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("section"), F.col("p_type").alias("stage"), F.col("p_size").cast("double").alias("importance"))
    return C.influence_matrix(rows).select("section", "stage", _R("influence"))


@query(
    "WITH y AS (SELECT commodity, price_year FROM (SELECT DISTINCT * FROM doc_features) WHERE price_year IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY commodity ORDER BY price_year) - 1 AS i, count(*) OVER (PARTITION BY commodity) AS n FROM y)"
    " SELECT commodity, count(*) AS n, min(price_year) AS lo, max(price_year) AS hi, max(CASE WHEN i = n // 2 THEN price_year END) AS upper_median FROM r GROUP BY 1"
)
def a27_vintage(spark: SparkSession, sf: str) -> DataFrame:
    return C.upper_median(table(spark, sf, "doc_features").distinct(), "commodity", "price_year")


@query(
    "SELECT coalesce(event_type, 'all') AS event_type, coalesce(user_id, -1) AS user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ROLLUP (event_type, user_id)"
)
def a28_rollup(spark: SparkSession, sf: str) -> DataFrame:
    sums = table(spark, sf, "events").rollup("event_type", "user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return sums.fillna({"event_type": "all", "user_id": -1})


@query(
    "SELECT 'cells' AS \"column\", round(avg((coalesce(cells, 0) <> 0)::INT), 6) AS share FROM flow_units UNION ALL SELECT 'unit_rid', round(avg((coalesce(unit_rid, 0) <> 0)::INT), 6) FROM flow_units"
)
def a29_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return C.coverage(table(spark, sf, "flow_units"), ["cells", "unit_rid"]).select("column", _R("share"))


@query(
    f"WITH {LATEST} SELECT commodity, max(doc_f1) AS hi, round((max(doc_f1) - min(doc_f1)) / avg(doc_f1), 6) AS spread, median(doc_f1) AS med, count(*) FILTER (doc_f1 = 1) AS perfect, count(*) AS n FROM latest GROUP BY 1"
)
def a30_rollups(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("doc_f1")
    return latest_predictions(spark, sf).groupBy("commodity").agg(
        F.max(v).alias("hi"), F.round((F.max(v) - F.min(v)) / F.avg(v), 6).alias("spread"), F.median(v).alias("med"), F.count_if(v == 1).alias("perfect"), F.count("*").alias("n")
    )


@query(
    f"WITH {SEQ}, c AS (SELECT *, lag(stage) OVER (PARTITION BY doc ORDER BY pos) AS before FROM seq) SELECT doc, stage, (row_number() OVER (PARTITION BY doc ORDER BY pos))::INT AS pos FROM c WHERE before IS DISTINCT FROM stage"
)
def w1_collapse_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return C.collapse_repeats(sequences(spark, sf))


@query(_TRANS + " SELECT doc, src, dst FROM edges")
def w2_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return C.transitions(sequences(spark, sf))


_PRIOR = (
    _TRANS
    + ", m AS (SELECT DISTINCT doc, stage AS item FROM seq), joint AS (SELECT x.item AS a, y.item AS b, count(*) AS n_docs FROM m x JOIN m y USING (doc) GROUP BY 1, 2),"
    + " cnt AS (SELECT src, dst, count(*) AS n FROM edges GROUP BY 1, 2), prior AS (SELECT src, dst, least(1.0, n / n_docs) AS prior FROM cnt JOIN joint ON a = src AND b = dst)"
)


def _prior(spark: SparkSession, sf: str) -> DataFrame:
    return C.edge_prior(a3_transition_counts(spark, sf), C.joint_support(_members(spark, sf)))


@query(_PRIOR + " SELECT src, dst, round(prior, 6) AS prior FROM prior")
def h10_edge_prior(spark: SparkSession, sf: str) -> DataFrame:
    return _prior(spark, sf).select("src", "dst", _R("prior"))


@query(_PRIOR + " SELECT * EXCLUDE (pr), round(pr, 6) AS prior FROM (SELECT src, dst, prior AS pr, (row_number() OVER (PARTITION BY src ORDER BY round(prior, 9) DESC, dst))::INT AS rank FROM prior) WHERE rank <= 2")
def w4_out_degree_cap(spark: SparkSession, sf: str) -> DataFrame:
    top = C.top_per_group(_prior(spark, sf), ["src"], [F.round("prior", 9).desc(), F.col("dst")], 2)
    return top.select("src", "dst", "rank", _R("prior"))


_XGB = f"WITH {LATEST}, x AS (SELECT DISTINCT doc_id AS doc, k AS item, v AS p FROM (SELECT doc_id, unnest(map_keys(xgb_predicted)) AS k, unnest(map_values(xgb_predicted)) AS v FROM test_predictions))"


@query(
    _XGB
    + ", r AS (SELECT *, max((p >= 0.9)::INT) OVER (PARTITION BY doc) AS hit, row_number() OVER (PARTITION BY doc ORDER BY p DESC, item) AS rn FROM x) SELECT doc, item, p FROM r WHERE CASE WHEN hit = 1 THEN p >= 0.9 ELSE rn <= 5 END"
)
def w5_top_or_fallback(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "test_predictions").select(F.col("doc_id").alias("doc"), F.explode("xgb_predicted").alias("item", "p")).distinct()
    return C.top_or_fallback(rows, "doc", "p", "item", 0.9, 5)


@query("SELECT c_custkey, c_nationkey, round(coalesce((c_acctbal - mn) / CASE WHEN mx = mn THEN 1 ELSE mx - mn END, 0), 6) AS scaled FROM (SELECT *, min(c_acctbal) OVER (PARTITION BY c_nationkey) AS mn, max(c_acctbal) OVER (PARTITION BY c_nationkey) AS mx FROM customer)")
def w7_min_max_scale(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return C.min_max_scale(rows, "c_acctbal", ["c_nationkey"]).select("c_custkey", "c_nationkey", _R("scaled"))


