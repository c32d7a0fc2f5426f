"""Queries of the model operators (L*) and the plant functions (P*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreloom.functions import hydromet as HY
from oreloom.functions import plant as P
from oreloom.functions import separation as SP
from oreloom.functions.keys import norm_key
from oreloom.operators import chain as CH
from oreloom.operators import learn as L
from oreloom.operators import plantchain as PC
from oreloom.plans.base import LATEST, latest_predictions, sql_norm, truth
from oreloom.plans.plant_sql import CHAIN_ROWS, chain_sql, flotation_sql
from oreloom.plans.registry import query
from oreloom.session import cut, table

_R = lambda c, d=6: F.round(c, d).alias(c)


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    rows = latest_predictions(spark, sf).select("doc", F.explode("xgb_stages").alias("s")).filter("s IS NOT NULL")
    return rows.select("doc", F.explode(F.split(F.lower("s"), "[^a-z]+")).alias("term")).filter("term <> ''")


_TFIDF = (
    f"WITH {LATEST}, v AS (SELECT doc, unnest(xgb_stages) AS s FROM latest), tok AS (SELECT doc, unnest(string_split_regex(lower(s), '[^a-z]+')) AS term FROM v WHERE s IS NOT NULL),"
    " tf AS (SELECT doc, term, count(*) AS tf FROM tok WHERE term <> '' GROUP BY 1, 2), d AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200),"
    " w AS (SELECT doc, term, tf * (ln((1.0 + (SELECT count(*) FROM latest)) / (1.0 + df)) + 1) AS w FROM tf JOIN d USING (term))"
)


@query(_TFIDF + " SELECT doc, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc)), 6) AS weight FROM w")
def l1_tf_idf(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "test_predictions").select("doc_id").distinct().count()
    return L.tf_idf(_tokens(spark, sf), n, 200).select("doc", "term", _R("weight"))


def _section_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """(section, doc, term) of the documents' words of three letters or more."""
    rows = table(spark, sf, "documents").filter("text IS NOT NULL AND section_group IS NOT NULL").select("section_group", "doc_id", "text").distinct()
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w) >= 3)
    return rows.select(F.col("section_group").alias("section"), F.col("doc_id").alias("doc"), F.explode(words).alias("term"))


_QUOTED = ", ".join("'" + w.replace("'", "''") + "'" for w in L.ENGLISH_STOPS)


@query(
    "WITH d AS (SELECT DISTINCT section_group AS section, doc_id AS doc, text FROM documents WHERE text IS NOT NULL AND section_group IS NOT NULL),"
    " tok AS (SELECT section, doc, term FROM (SELECT section, doc, unnest(string_split_regex(lower(text), '[^\\p{L}]+')) AS term FROM d) WHERE length(term) >= 3),"
    f" tf AS (SELECT section, doc, term, count(*) AS tf FROM tok WHERE term NOT IN ({_QUOTED}) GROUP BY 1, 2, 3), n AS (SELECT section, count(DISTINCT doc) AS n FROM tok GROUP BY 1),"
    " df AS (SELECT section, term, count(*) AS df FROM tf GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY section ORDER BY count(*) DESC, term) <= 200),"
    " w AS (SELECT tf.section, doc, tf.term, tf * (ln((1.0 + n) / (1.0 + df)) + 1) AS w FROM tf JOIN df ON df.section = tf.section AND df.term = tf.term JOIN n ON n.section = tf.section)"
    " SELECT section, doc, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY section, doc)), 6) AS weight FROM w"
)
def l1_section_tf_idf(spark: SparkSession, sf: str) -> DataFrame:
    """Tf-idf by section of the documents: 200 features each, without the stop words of Spark's English list."""
    return L.section_tf_idf(_section_tokens(spark, sf), 200, list(L.ENGLISH_STOPS)).select("section", "doc", "term", _R("weight"))


@query()
def l2_svd(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty components per section of the section's 200 features: singular values, and the terms that weigh most."""
    weights = cut(L.section_tf_idf(_section_tokens(spark, sf), 200, list(L.ENGLISH_STOPS)))
    rows = [(s, i, float(round(v, 6)), t) for s, found in sorted(L.section_svd(weights, 20).items()) for i, (v, t) in enumerate(zip(found.values, found.top_terms(), strict=True))]
    return spark.createDataFrame(rows, "section string, k int, value double, term string")


def _sheets(spark: SparkSession, sf: str) -> DataFrame:
    """image_id, x = ln(1 + units), and the numbers of stages and cells of each flowsheet."""
    rows = table(spark, sf, "flow_units").filter("image_id IS NOT NULL AND deleted_at IS NULL").select("image_id", norm_key(F.col("unit_id")).alias("u"), norm_key(F.col("stage_id")).alias("s"), "cells").distinct()
    per = rows.groupBy("image_id").agg(F.count_distinct("u").alias("n"), F.count_distinct("s").cast("double").alias("stages"), F.coalesce(F.sum("cells"), F.lit(0)).cast("double").alias("cells"))
    return per.select("image_id", F.log1p(F.col("n").cast("double")).alias("x"), "stages", "cells")


_SHEETS = f"""rows AS (SELECT DISTINCT image_id, {sql_norm('unit_id')} AS u, {sql_norm('stage_id')} AS s, cells FROM flow_units WHERE image_id IS NOT NULL AND deleted_at IS NULL),
  sheets AS (SELECT image_id, ln(1 + count(DISTINCT u)) AS x, count(DISTINCT s)::DOUBLE AS stages, coalesce(sum(cells), 0)::DOUBLE AS cells FROM rows GROUP BY 1),
  long AS (SELECT image_id, x, 'stages' AS label, stages AS y FROM sheets UNION ALL SELECT image_id, x, 'cells', cells FROM sheets),
  m AS (SELECT label, count(*)::DOUBLE AS a, sum(x) AS b, sum(x * x) AS c, sum(x * x * x) AS d, sum(x * x * x * x) AS e, sum(y) AS p, sum(x * y) AS q, sum(x * x * y) AS r FROM long GROUP BY 1),
  det AS (SELECT label, a * (c * e - d * d) - b * (b * e - c * d) + c * (b * d - c * c) AS z, p * (c * e - d * d) - b * (q * e - d * r) + c * (q * d - c * r) AS z0,
    a * (q * e - d * r) - p * (b * e - c * d) + c * (b * r - q * c) AS z1, a * (c * r - q * d) - b * (b * r - q * c) + p * (b * d - c * c) AS z2 FROM m)"""


@query(f"WITH {_SHEETS} SELECT label, round(z0 / z, 4) AS c0, round(z1 / z, 4) AS c1, round(z2 / z, 4) AS c2 FROM det")
def l3_polynomial(spark: SparkSession, sf: str) -> DataFrame:
    """Degree 2, two targets, from one pass of power sums."""
    fit = L.polynomial_fit(_sheets(spark, sf), "x", ["stages", "cells"], 2)
    return spark.createDataFrame([(y, *[round(float(v), 4) for v in c]) for y, c in fit.items()], "label string, c0 double, c1 double, c2 double")


@query(
    f"WITH {_SHEETS} SELECT image_id, label, (CASE WHEN label = 'stages' THEN greatest(greatest(round_even(z0 / z + z1 / z * x + z2 / z * x * x, 0), 0), 1) ELSE greatest(round_even(z0 / z + z1 / z * x + z2 / z * x * x, 0), 0) END)::INT AS count FROM long JOIN det USING (label)"
)
def l3_predicted_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of every flowsheet from the fitted polynomials, rounded, clipped at 0, the mandatory label at least 1."""
    sheets = _sheets(spark, sf)
    fit = L.polynomial_fit(sheets, "x", ["stages", "cells"], 2)
    raw = F.array(*[F.struct(F.lit(y).alias("label"), L.predict_polynomial(F.col("x"), c).alias("raw")) for y, c in fit.items()])
    return L.postprocess_counts(sheets.select("image_id", F.inline(raw)), "label", "raw", ["stages"]).select("image_id", "label", "count")


_SPLIT = "('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0"


@query(f"SELECT doc_id, CASE WHEN {_SPLIT} < 0.7 THEN 'train' WHEN {_SPLIT} < 0.9 THEN 'val' ELSE 'test' END AS split, (('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 5)::INT AS fold FROM documents")
def l9_hash_split(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("doc_id")
    return table(spark, sf, "documents").select("doc_id", L.hash_split(key, [("train", 0.7), ("val", 0.2), ("test", 0.1)]).alias("split"), L.fold(key, 5).alias("fold"))


#: Labels of the chain: the commonest names of the planted truth are found by a count; so many of them are learnt.
_LABELS = 4


def _stage_model_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str], list[str]]:
    """One row per latest record: predicted probabilities of the commonest names as features, the truth as labels y0.."""
    truth_rows = truth(spark, sf)
    names = [r.item for r in truth_rows.groupBy("item").count().orderBy(F.desc("count"), "item").limit(_LABELS).collect()]
    latest = latest_predictions(spark, sf).select("doc", F.coalesce("doc_f1", F.lit(0.0)).alias("doc_f1"), F.size(F.coalesce("xgb_stages", F.array().cast("array<string>"))).cast("double").alias("n_stages"),
                                                  F.transform(F.coalesce("xgb_stages", F.array().cast("array<string>")), norm_key).alias("said"))
    held = truth_rows.filter(F.col("item").isin(*names)).groupBy("doc").agg(F.collect_set("item").alias("held"))
    rows = latest.join(held, "doc", "left")
    features = {f"f{i}": F.array_contains("said", n).cast("double") for i, n in enumerate(names)}
    labels = {f"y{i}": F.coalesce(F.array_contains("held", n), F.lit(False)).cast("int") for i, n in enumerate(names)}
    rows = rows.select("doc", "doc_f1", "n_stages", *[F.coalesce(c, F.lit(0.0)).alias(k) for k, c in features.items()], *[c.alias(k) for k, c in labels.items()])
    return cut(rows.withColumn("split", L.hash_split(F.col("doc"), [("train", 0.6), ("rest", 0.4)]))), ["doc_f1", "n_stages", *features], list(labels)


@query()
def l4_boosted_trees(spark: SparkSession, sf: str) -> DataFrame:
    """Every label by itself: fit on the training split, score the rest."""
    rows, features, labels = _stage_model_rows(spark, sf)
    out = rows.filter("split = 'rest'").select("doc", *features, *labels)
    for y in labels:
        model = L.boosted_trees(rows.filter("split = 'train'"), features, y, trees=6)
        out = L.score_trees(model, out, f"{y}_prob")
    return out.select("doc", *labels, *[F.round(f"{y}_prob", 6).alias(f"{y}_prob") for y in labels])


@query()
def l11_ablation(spark: SparkSession, sf: str) -> DataFrame:
    """Loss of F1 on held-out rows when a group of features is zeroed."""
    rows, features, labels = _stage_model_rows(spark, sf)
    model = L.boosted_trees(rows.filter("split = 'train'"), features, labels[0], trees=6)
    groups = {"record": ["doc_f1", "n_stages"], "own name": ["f0"], "other names": [f for f in features if f.startswith("f") and f != "f0"]}
    ranked = L.ablation(model, rows.filter("split = 'rest'").select(*features, labels[0]), groups, labels[0])
    return spark.createDataFrame([(g, round(float(d), 6)) for g, d in ranked], "left_out string, loss double")


@query()
def l5_classifier_chain(spark: SparkSession, sf: str) -> DataFrame:
    """The chain over all names of the truth (y0.. by descending frequency, ties by name) with a small grid, oversampled positives and
    tuned thresholds, all on out-of-fold scores; all predicted names are features. Scored on held-out rows; a name with fewer
    than two training rows can't be learnt and is 0.
    """
    truth_rows = truth(spark, sf)
    names = [r.item for r in truth_rows.groupBy("item").count().orderBy(F.desc("count"), "item").collect()]
    said = F.transform(F.coalesce("xgb_stages", F.array().cast("array<string>")), norm_key)
    rows = latest_predictions(spark, sf).select("doc", "doc_f1", F.size(said).alias("n_stages"), F.filter(said, lambda x: x.isNotNull()).alias("said"))
    rows = rows.join(truth_rows.groupBy("doc").agg(F.collect_set("item").alias("held")), "doc", "left").withColumn("held", F.coalesce("held", F.array().cast("array<string>")))
    rows = cut(rows.withColumn("split", L.hash_split(F.col("doc"), [("train", 0.6), ("rest", 0.4)])))
    plain, grid = ["doc_f1", "n_stages"], [{"depth": 2, "trees": 4}, {"depth": 3, "trees": 6}]
    chain, scheme = CH.all_labels_chain(rows.filter("split = 'train'"), "doc", plain, "said", "held", grid, folds=2)
    scored = CH.score_all_labels(chain, scheme, rows.filter("split = 'rest'"), "doc", plain, "said")
    place = {x: i for i, x in enumerate(scheme.labels)}
    return scored.select("doc", *[(F.array_contains("found", place[x]).cast("int") if x in place else F.lit(0)).alias(f"y{i}") for i, x in enumerate(names)])


@query()
def l6_pseudo_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Two rounds: confident predictions join the training rows of the next round; each row keeps the round that labelled it."""
    rows, features, labels = _stage_model_rows(spark, sf)
    known = rows.filter("split = 'train'").select("doc", *features, F.col(labels[0]).alias("label"))
    found = L.pseudo_label_rounds(known, rows.filter("split = 'rest'").select("doc", *features), features, "doc", rounds=2, trees=5)
    return found.select("doc", "label", "round")


@query(f"WITH {LATEST}, x AS (SELECT DISTINCT doc_id AS doc, k AS item, v AS p FROM (SELECT doc_id, unnest(map_keys(xgb_predicted)) AS k, unnest(map_values(xgb_predicted)) AS v FROM test_predictions)) SELECT doc, item, p FROM x WHERE p >= 0.8 OR item IN ('ball_mill', 'jaw_crusher')")
def l16_mandatory(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "test_predictions").select(F.col("doc_id").alias("doc"), F.explode("xgb_predicted").alias("item", "p")).distinct()
    return L.with_mandatory(rows, ["ball_mill", "jaw_crusher"], "item", "p", 0.8)


_SCEN = "SELECT p_partkey AS id, 8.0 + p_size % 12 AS wi, 100000.0 + 1000 * p_size AS f80, 150.0 + p_size AS p80, 1000.0 + p_size AS tph FROM part"


def _scenarios(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("p_size")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), (8.0 + s % 12).alias("wi"), (100000.0 + 1000 * s).alias("f80"), (150.0 + s).alias("p80"), (1000.0 + s).alias("tph")
    )


@query(f"WITH s AS ({_SCEN}) SELECT id, round(wi * 10 * (1 / sqrt(p80) - 1 / sqrt(f80)), 6) AS kwh, round(wi * 10 * (1 / sqrt(p80) - 1 / sqrt(f80)) / 0.95 * tph, 3) AS kw FROM s")
def p_01_crusher(spark: SparkSession, sf: str) -> DataFrame:
    s = _scenarios(spark, sf)
    c = [F.col(x) for x in ("wi", "f80", "p80")]
    return s.select("id", F.round(P.bond_energy(*c), 6).alias("kwh"), F.round(P.crusher_power(*c, F.col("tph")), 3).alias("kw"))


@query(f"WITH s AS ({_SCEN}) SELECT id, round(1 / pow(9.0 / (10 * wi) + 1 / sqrt(f80), 2), 4) AS p80, round(60 * (1 - exp(-0.5 * 9.0)), 6) AS t10 FROM s")
def p_02_sag(spark: SparkSession, sf: str) -> DataFrame:
    e = F.lit(9.0)
    return _scenarios(spark, sf).select("id", F.round(P.sag_product(F.col("wi"), F.col("f80"), e), 4).alias("p80"), F.round(P.breakage_t10(F.lit(60.0), F.lit(0.5), e), 6).alias("t10"))


@query(
    f"WITH s AS ({_SCEN}), d AS (SELECT id, p80, tph * 5 AS q, 0.0387 * 50.5 * pow(66, 0.46) * pow(20, 0.6) * pow(25, 1.21) * exp(0.063 * 30) / (pow(15, 0.71) * pow(150, 0.38) * pow(tph * 5, 0.45) * 1.7) AS d50,"
    " 0.1953 * 1.9 * pow(15 / 25.0, 3.31) * pow(150, 0.54) * pow(850, 0.36) * exp(0.0054 * 30) / (pow(10, 0.24) * pow(66, 1.11)) AS sp FROM s), m AS (SELECT *, 0.1762 * 1.94 * exp(-1.58 * (sp / (sp + 1)) * pow(625 / q, 0.15)) AS m FROM d)"
    " SELECT id, round(d50, 4) AS d50, round(sp, 6) AS split, round(1 - exp(-0.693 * pow(p80 / d50, m)), 6) AS to_underflow FROM m"
)
def p_03_cyclone(spark: SparkSession, sf: str) -> DataFrame:
    dc, di, do, du, h, cv = (F.lit(x) for x in (66.0, 20.0, 25.0, 15.0, 150.0, 30.0))
    q = F.col("tph") * 5.0
    d50, s = P.cyclone_cut(dc, di, do, du, h, q, cv), P.cyclone_split(dc, do, du, h, F.lit(10.0), cv)
    m = P.cyclone_sharpness(do, s, q)
    return _scenarios(spark, sf).select("id", F.round(d50, 4).alias("d50"), F.round(s, 6).alias("split"), F.round(P.to_underflow(F.col("p80"), d50, m), 6).alias("to_underflow"))


@query(f"WITH s AS ({_SCEN}) SELECT id, round(least(0.6 + 0.4 * (p80 % 10) / 20, 0.75), 6) AS bank, round(1 - pow(1 - 0.3, 1 + p80 % 5), 6) AS cells FROM s")
def p_04_flotation(spark: SparkSession, sf: str) -> DataFrame:
    return _scenarios(spark, sf).select(
        "id", F.round(P.bank_recovery(F.lit(0.6), F.col("p80") % 10 / 20, F.lit(0.75)), 6).alias("bank"), F.round(P.repeated_cells(F.lit(0.3), 1 + F.col("p80") % 5), 6).alias("cells")
    )


@query(f"WITH s AS ({_SCEN}) SELECT id, round(least(tph * (100.0 / 60 - 1), 700.0), 6) AS water FROM s")
def p_05_thickener(spark: SparkSession, sf: str) -> DataFrame:
    return _scenarios(spark, sf).select("id", F.round(P.underflow_water(F.col("tph"), F.lit(700.0), F.lit(60.0)), 6).alias("water"))


@query()
def p_07_grind(spark: SparkSession, sf: str) -> DataFrame:
    arr = lambda *xs: F.array(*[F.lit(float(x)) for x in xs])
    s = _scenarios(spark, sf).withColumn("cycles", (F.col("p80") % 7) / 2.0)
    return s.select("id", P.grind(arr(50, 30, 15, 5), arr(16, 8, 4, 2), arr(8, 4, 2, 1), arr(0.6, 0.5, 0.4, 0.0), F.col("cycles")).alias("tonnage"))


@query(f"WITH s AS ({_SCEN}), k AS (SELECT id, 0.05 * exp(-20.0 * 1000 / (8.314 * (60 + p80 / 10 + 273.15))) * pow(12.0, 0.7) AS k FROM s) SELECT id, round(least(0.96, 1 - pow(greatest(1 - k * 3600, 0), 3)), 6) AS extraction FROM k")
def p_08_leach(spark: SparkSession, sf: str) -> DataFrame:
    k = P.leach_rate(F.lit(0.05), F.lit(20.0), 60 + F.col("p80") / 10, F.lit(12.0), F.lit(0.7))
    return _scenarios(spark, sf).select("id", F.round(P.leach_extraction(k, F.lit(3600.0), F.lit(0.96)), 6).alias("extraction"))


_F = lambda name, digits: f"round({name}, {digits}) AS {name}"
_CHAIN = {"crusher_kw": 3, "mill_kw": 3, "mill_feed_um": 4, "cells": 0, "rougher_r": 6, "rougher_t": 4, "regrind_kw": 3, "conc_t": 4, "conc_grade": 6, "tails_t": 4, "tails_grade": 8,
          "thickener_m2": 4, "filter_m2": 3, "cake_mm": 4, "cake_water": 4, "cathode_t": 4, "acid_kg": 2, "recovery": 6}


def _chain_rows(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("p_size")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), (1000.0 + s).alias("tph"), (0.004 + (s % 10) / 2000.0).alias("grade"), (150.0 + s).alias("p80"), (1.4 + (s % 5) / 10.0).alias("gas")
    )


def _chain(spark: SparkSession, sf: str, **how: object) -> DataFrame:
    done = PC.simulate(_chain_rows(spark, sf), PC.Settings(**how))
    return done.select("id", *[F.round(c, d).alias(c) for c, d in _CHAIN.items()], (F.col("closure") < 1e-6).alias("closed"))


def _chain_oracle(leach: bool) -> str:
    return f"{chain_sql(leach)} SELECT id, {', '.join(_F(c, d) for c, d in _CHAIN.items())}, true AS closed FROM done"


@query(_chain_oracle(False))
def p_09_concentrator(spark: SparkSession, sf: str) -> DataFrame:
    """The whole chain with concentrate as product; closed tells whether the copper of all leaving streams adds up."""
    return _chain(spark, sf)


@query(_chain_oracle(True))
def p_09_hydromet(spark: SparkSession, sf: str) -> DataFrame:
    """The whole chain with cathode as product."""
    return _chain(spark, sf, leach=True)


@query(f"WITH src AS ({CHAIN_ROWS}), {flotation_sql('src', 'f', 0.90, 0.15, 'p80', 18.0, '6', 250.0)} SELECT id, round(r, 6) AS recovery FROM f")
def p_04_kinetics(spark: SparkSession, sf: str) -> DataFrame:
    """Recovery of a bank from surface tension, bubble size, collision, attachment, detachment and froth."""
    rows = PC.with_flotation(_chain_rows(spark, sf), "recovery", PC.Cell(), F.col("p80"), F.col("gas"), 18.0, F.lit(6.0), 250.0)
    return rows.select("id", F.round("recovery", 6).alias("recovery"))


@query(
    f"WITH s AS ({_SCEN}), t AS (SELECT *, 1.25 * tph / (2.7 * (4 * 8.0 / 0.4 * 4.6 * pow(3.6, 3.6) / pow(5.6, 5.6))) AS area, tph * 1000 / (tph * 0.5 + p80) AS w FROM s),"
    " c AS (SELECT *, w * (sqrt(pow(1e7 / 70000, 2) + 4 * (1e8 * w / 140000) * 60) - 1e7 / 70000) / (2 * 1e8 * w / 140000) AS l FROM t)"
    " SELECT id, round(area, 4) AS area, round(sqrt(4 * area / pi()), 4) AS diameter, round(l / 2, 4) AS cake_mm, round(tph / 3.6 * 200 / l, 4) AS belt, round(0.3 * tph * 1.10231 / 4.5 / 10.7639, 6) AS deck,"
    " round(0.7 * tph * 1.10231 * (2000 / (1.6 * 62.428)) / (5 * 75 * 2.4 * 3.28084), 6) AS depth, (0.7 * tph * 1.10231 * (2000 / (1.6 * 62.428)) / (5 * 75 * 2.4 * 3.28084)) <= 4 * 25 / 25.4 AS shallow FROM c"
)
def p_05_sizing(spark: SparkSession, sf: str) -> DataFrame:
    """Thickener area and diameter, belt area and cake, screen deck and bed depth."""
    t = F.col("tph")
    area, load, depth = SP.thickener_area(t), SP.cake_loading(t, t * 0.5 + F.col("p80")), SP.bed_depth_in(t * 0.7)
    return _scenarios(spark, sf).select(
        "id", F.round(area, 4).alias("area"), F.round(SP.diameter(area), 4).alias("diameter"), F.round(SP.cake_thickness_mm(load), 4).alias("cake_mm"),
        F.round(SP.filter_area(t, load), 4).alias("belt"), F.round(SP.deck_area(t * 0.3), 6).alias("deck"), F.round(depth, 6).alias("depth"), SP.bed_is_shallow(depth, 25.0).alias("shallow"),
    )


@query(
    f"WITH s AS ({_SCEN}), e AS (SELECT id, tph, tph / 100 AS cu, 0.4 * 18.6 * (30 + p80 / 10) AS i FROM s), g AS (SELECT *, i * 1.2 * 3600 * 63.5 * 0.92 / (2 * 96485.0) AS g, i * 1.2 * (0.5 * 5 / 12000) + 1.96 AS v FROM e),"
    " c AS (SELECT *, ceil(cu * 1e6 / (g * 60)) AS n FROM g)"
    " SELECT id, round(i, 4) AS current, round(v, 6) AS volts, n::BIGINT AS cells, round(n * 60 * i * 1.2 * v / 1000, 3) AS kw, round(cu * 6170, 4) AS acid, round(tph * 24 * 365 / (1.7 * 8), 3) AS pad, round(cu * 1000000 / 4 / 1000, 4) AS liquor FROM c"
)
def p_06_electrowinning(spark: SparkSession, sf: str) -> DataFrame:
    """Cathode plating by Faraday's law, with the acid, heap pad and liquor of the same copper."""
    cu = F.col("tph") / 100
    i = HY.operating_current(30 + F.col("p80") / 10)
    volts, cells = HY.cell_voltage(i), HY.cells_needed(cu, HY.cathode_grams(i))
    return _scenarios(spark, sf).select(
        "id", F.round(i, 4).alias("current"), F.round(volts, 6).alias("volts"), cells.cast("bigint").alias("cells"), F.round(HY.electrowinning_kw(cells, i, volts), 3).alias("kw"),
        F.round(HY.leach_acid(cu), 4).alias("acid"), F.round(HY.heap_pad_area(F.col("tph")), 3).alias("pad"), F.round(HY.heap_liquor(cu), 4).alias("liquor"),
    )


@query(
    f"WITH s AS ({_SCEN}), m AS (SELECT id, tph * 30 * 1000 / 98.08 AS a, tph * 1000 / 55.85 AS f, p80 * 2 * 1000 / 74.92 AS r, 150 * 1000 / 175.0 AS b FROM s)"
    " SELECT id, round((a + 6 * least(f, r) / 2 + b) * 74.09 / 1000 / 0.95, 3) AS lime, round((a + 7 * least(f, r) / 2 + b) * 172.17 / 1000, 3) AS gypsum, f / r < 3 AS short FROM m"
)
def p_06_neutralisation(spark: SparkSession, sf: str) -> DataFrame:
    lime, gypsum, short = HY.neutralisation(F.col("tph") * 30, F.col("tph"), F.col("p80") * 2, F.lit(150.0))
    return _scenarios(spark, sf).select("id", F.round(lime, 3).alias("lime"), F.round(gypsum, 3).alias("gypsum"), short.alias("short"))


# The steady state is checked by what defines it: both balances of the mixer vanish.
@query(f"WITH s AS ({_SCEN}) SELECT id, true AS aqueous, true AS organic, true AS inside FROM s")
def p_06_extraction(spark: SparkSession, sf: str) -> DataFrame:
    rows = _scenarios(spark, sf).withColumns({"x0": 2 + F.col("p80") / 50, "ph": F.lit(1.8), "y0": F.lit(1.5), "qa": F.col("tph"), "qo": F.col("tph") * 1.1})
    top, half = HY.isotherm(F.col("ph"), F.col("x0"), 0.5, 10.0)
    rows = rows.withColumns({"top": top, "half": half})
    x, y = HY.extraction_stage(F.col("x0"), F.col("y0"), F.col("qa"), F.col("qo"), F.col("top"), F.col("half"), 30.0, 0.9, 60.0, 60.0)
    rows = rows.withColumns({"x": x, "y": y})
    gain = 30.0 * (0.1 * F.col("y0") + 0.9 * F.col("top") * F.col("x") / (F.col("x") + F.col("half")) - F.col("y"))
    small = lambda c: F.abs(c) < 1e-6
    return rows.select(
        "id", small(F.col("qa") / 60 * (F.col("x0") - F.col("x")) - gain).alias("aqueous"), small(F.col("qo") / 60 * (F.col("y0") - F.col("y")) + gain).alias("organic"),
        ((F.col("x") > 0) & (F.col("x") < F.col("x0"))).alias("inside"),
    )


@query(f"WITH s AS ({_SCEN}), g AS (SELECT * FROM s, (SELECT unnest([100.0, 150.0, 200.0]::DOUBLE[]) AS target)) SELECT target, count(*) AS n, round(avg(wi * 10 * (1 / sqrt(target) - 1 / sqrt(f80))), 6) AS kwh FROM g GROUP BY 1")
def p_14_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Scenario sweep: a short list of settings exploded onto each row."""
    grid = _scenarios(spark, sf).withColumn("target", F.explode(F.array(*[F.lit(x) for x in (100.0, 150.0, 200.0)])))
    return grid.groupBy("target").agg(F.count("*").alias("n"), F.round(F.avg(P.bond_energy(F.col("wi"), F.col("f80"), F.col("target"))), 6).alias("kwh"))
