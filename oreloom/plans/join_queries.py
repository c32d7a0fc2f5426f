"""Queries of the joins (J1-J22) and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreloom.functions.keys import norm_key
from oreloom.operators import joins as J
from oreloom.operators import neighbors as N
from oreloom.plans.base import BOTH, LATEST, LINKS, SEQ, latest_predictions, links, predicted, sequences, sql_norm, truth
from oreloom.plans.registry import query
from oreloom.session import table

_R = lambda c, d=6: F.round(c, d).alias(c)


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'")
def j1_inner(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").filter("o_orderstatus = 'F'")
    return orders.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


_TABLES = "t AS (SELECT DISTINCT table_id, caption FROM extracted_tables), f AS (SELECT DISTINCT feature_id, table_id FROM doc_features)"


def _tables(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "extracted_tables").select("table_id", "caption").distinct()


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "doc_features").select("feature_id", "table_id").distinct()


@query(f"WITH {_TABLES} SELECT feature_id, f.table_id, caption FROM f LEFT JOIN t ON f.table_id = t.table_id")
def j2_left_enrich(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf).join(_tables(spark, sf), "table_id", "left").select("feature_id", "table_id", "caption")


@query(f"WITH {_TABLES} SELECT feature_id, table_id FROM f WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.table_id = f.table_id)")
def j3_anti(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf).join(_tables(spark, sf), "table_id", "left_anti").select("feature_id", "table_id")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def j4_semi(spark: SparkSession, sf: str) -> DataFrame:
    allowed = table(spark, sf, "orders").filter("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(allowed, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query(
    "SELECT count(*) FILTER (s_suppkey IS NULL) AS unmatched, count(*) FILTER (s_suppkey IS NOT NULL AND n.n_name IS NULL) AS half, count(*) FILTER (n.n_name IS NOT NULL) AS matched"
    " FROM (SELECT DISTINCT l_suppkey FROM lineitem) l LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0 LEFT JOIN nation n ON n.n_nationkey = s_nationkey AND n.n_regionkey < 3"
)
def j5_two_hop(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "lineitem").select("l_suppkey").distinct()
    first = table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    second = table(spark, sf, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    hops = keys.join(first, "l_suppkey", "left").join(second, "s_nationkey", "left")
    known, named = F.col("s_nationkey").isNotNull(), F.col("n_name").isNotNull()
    return hops.agg(F.count_if(~known).alias("unmatched"), F.count_if(known & ~named).alias("half"), F.count_if(named).alias("matched"))


@query("SELECT DISTINCT image_id FROM flow_units WHERE image_id IN (SELECT image_id FROM flow_connections) AND image_id IN (SELECT image_id FROM flow_stages)")
def j6_three_way(spark: SparkSession, sf: str) -> DataFrame:
    images = lambda t: table(spark, sf, t).select("image_id").distinct()
    return images("flow_units").join(images("flow_connections"), "image_id", "left_semi").join(images("flow_stages"), "image_id", "left_semi")


def _pages(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    left = table(spark, sf, "extracted_tables").select(F.col("document_id").alias("report_id"), "page_number", "table_id").distinct()
    return left.filter("page_number IS NOT NULL"), table(spark, sf, "documents").filter("section_group IS NOT NULL AND page_number IS NOT NULL").select("report_id", "page_number", "section_group")


_PAGES = "l AS (SELECT DISTINCT document_id AS report_id, page_number, table_id FROM extracted_tables WHERE page_number IS NOT NULL), m AS (SELECT report_id, page_number, {f}(section_group) AS s FROM documents WHERE section_group IS NOT NULL AND page_number IS NOT NULL GROUP BY 1, 2)"


@query(
    f"WITH {_PAGES.format(f='min')}, j AS (SELECT l.*, m.s, row_number() OVER (PARTITION BY l.report_id, l.page_number, l.table_id ORDER BY abs(m.page_number - l.page_number), m.page_number) AS rn"
    " FROM l LEFT JOIN m ON m.report_id = l.report_id AND abs(m.page_number - l.page_number) <= 3) SELECT report_id, page_number, table_id, s AS near FROM j WHERE rn = 1"
)
def j7_nearest_page(spark: SparkSession, sf: str) -> DataFrame:
    left, right = _pages(spark, sf)
    return J.nearest_within(left, right, "report_id", "page_number", 3, "section_group")


@query(f"WITH {_PAGES.format(f='max')} SELECT l.report_id, l.page_number, l.table_id, m.s AS last_value FROM l ASOF LEFT JOIN m ON l.report_id = m.report_id AND l.page_number >= m.page_number")
def j8_asof_backward(spark: SparkSession, sf: str) -> DataFrame:
    left, right = _pages(spark, sf)
    return J.asof_backward(left, right, "report_id", "page_number", "section_group", 50)


@query()
def j9_greedy_disjoint(spark: SparkSession, sf: str) -> DataFrame:
    """Flowsheet life spans in days per document, longest first."""
    rows = table(spark, sf, "flow_units").groupBy("document_id", "image_id").agg(
        F.min(F.datediff("created_at", F.lit("2000-01-01"))).alias("lo"), F.max(F.datediff(F.coalesce("deleted_at", "created_at"), F.lit("2000-01-01")) + 1).alias("hi")
    )
    return J.greedy_disjoint(rows, "document_id", "image_id", [("lo", "hi")])


@query(
    "WITH l AS (SELECT DISTINCT document_id AS report_id, page_number, table_id AS left_id FROM extracted_tables WHERE page_number IS NOT NULL),"
    " r AS (SELECT report_id, page_number AS p, doc_id AS right_id FROM documents WHERE length(text) >= 20 AND page_number IS NOT NULL)"
    " SELECT l.report_id, left_id, right_id, p - page_number AS gap FROM l JOIN r ON l.report_id = r.report_id AND abs(p - page_number) <= 5"
)
def j10_band(spark: SparkSession, sf: str) -> DataFrame:
    left = table(spark, sf, "extracted_tables").filter("page_number IS NOT NULL").select(F.col("document_id").alias("report_id"), "page_number", F.col("table_id").alias("left_id")).distinct()
    right = table(spark, sf, "documents").filter("length(text) >= 20 AND page_number IS NOT NULL").select("report_id", "page_number", F.col("doc_id").alias("right_id"))
    return J.band_join(left, right, "report_id", "page_number", 5)


_SEGMENTS = "v AS (SELECT c_nationkey AS n, c_mktsegment AS seg, o_orderpriority AS p, count(*)::DOUBLE AS x FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3)"


@query(
    f"WITH {_SEGMENTS}, d AS (SELECT a.n, a.seg AS a, b.seg AS b, sum(a.x * b.x) AS ab FROM v a JOIN v b ON a.n = b.n AND a.p = b.p AND a.seg < b.seg GROUP BY 1, 2, 3), q AS (SELECT n, seg, sqrt(sum(x * x)) AS q FROM v GROUP BY 1, 2)"
    " SELECT d.n, d.a, d.b, round(ab / (x.q * y.q), 6) AS cosine FROM d JOIN q x ON x.n = d.n AND x.seg = d.a JOIN q y ON y.n = d.n AND y.seg = d.b WHERE ab / (x.q * y.q) > 0.15"
)
def j11_pairs_in_group(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of one group (at most five segments) compared pairwise on their sparse vectors."""
    joined = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    v = joined.groupBy(F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("seg"), F.col("o_orderpriority").alias("p")).agg(F.count("*").cast("double").alias("x"))
    v = v.join(v.groupBy("n", "seg").agg(F.sqrt(F.sum(F.col("x") ** 2)).alias("q")), ["n", "seg"])
    a, b = (v.select("n", "p", F.col("seg").alias(s), F.col("x").alias(f"x{s}"), F.col("q").alias(f"q{s}")) for s in "ab")
    pairs = a.join(b, ["n", "p"]).filter("a < b").groupBy("n", "a", "b").agg((F.sum(F.col("xa") * F.col("xb")) / (F.first("qa") * F.first("qb"))).alias("cosine"))
    return pairs.filter("cosine > 0.15").select("n", "a", "b", _R("cosine"))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


_KNN = "WITH p AS (SELECT q.vec_id AS id, b.vec_id AS neighbor, round(list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS s FROM embeddings q JOIN embeddings b ON q.vec_id <> b.vec_id WHERE q.vec_id % 20 = 0), r AS (SELECT *, (row_number() OVER (PARTITION BY id ORDER BY s DESC, neighbor))::INT AS rank FROM p)"


@query(_KNN + " SELECT id, neighbor, rank, round(s, 5) AS score FROM r WHERE rank <= 20")
def j12_similar_documents(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    return N.knn(v.filter("id % 20 = 0"), v, 20, same=True).select("id", "neighbor", "rank", _R("score", 5))


@query(
    "WITH p AS (SELECT q.vec_id AS id, b.vec_id AS neighbor, round(list_distance(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS s FROM embeddings q JOIN embeddings b ON q.vec_id <> b.vec_id WHERE q.vec_id % 20 = 0), r AS (SELECT *, (row_number() OVER (PARTITION BY id ORDER BY s, neighbor))::INT AS rank FROM p)"
    " SELECT id, neighbor, rank, round(s, 4) AS distance FROM r WHERE rank <= 10"
)
def j13_knn_euclidean(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    return N.knn(v.filter("id % 20 = 0"), v, 10, "euclidean", same=True).select("id", "neighbor", "rank", F.round(-F.col("score"), 4).alias("distance"))


@query()
def j12_all_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    """The neighbours of every row, through the index: each row meets the cells it probes."""
    v = _vectors(spark, sf)
    return N.knn(v, v, 20, same=True, index=N.fit_cells(v, 20)).select("id", "neighbor", "rank", _R("score", 5))


@query("SELECT 'cosine' AS metric, count(*) FILTER (vec_id % 20 = 0) AS n_queries, true AS enough FROM embeddings UNION ALL SELECT 'euclidean', count(*) FILTER (vec_id % 20 = 0), true FROM embeddings")
def j13_index_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the index finds at least 0.9 of the exact neighbours, for the rows whose id is divisible by 20 against all."""
    v = _vectors(spark, sf)
    asked = v.filter("id % 20 = 0")
    rows = []
    for metric in ("cosine", "euclidean"):
        found = N.knn(asked, v, 10, metric, same=True, index=N.fit_cells(v, 10, metric))
        rows.append((metric, asked.count(), bool(N.recall(found, N.knn(asked, v, 10, metric, same=True)) >= 0.9)))
    return spark.createDataFrame(rows, "metric string, n_queries bigint, enough boolean")


_EDGES = f"WITH {SEQ}, m AS (SELECT DISTINCT doc, stage AS item FROM seq), e AS (SELECT DISTINCT doc, src, dst FROM (SELECT doc, stage AS src, lead(stage) OVER (PARTITION BY doc ORDER BY pos) AS dst FROM seq) WHERE dst IS NOT NULL)"


def _members_edges(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    from oreloom.operators.corpus import transitions

    seq = sequences(spark, sf)
    return seq.select("doc", F.col("stage").alias("item")).distinct(), transitions(seq)


@query(_EDGES + " SELECT a.doc, a.item AS src, b.item AS dst, (e.doc IS NOT NULL)::INT AS label FROM m a JOIN m b ON a.doc = b.doc AND a.item <> b.item LEFT JOIN e ON e.doc = a.doc AND e.src = a.item AND e.dst = b.item")
def j14_ordered_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return J.ordered_pairs(*_members_edges(spark, sf))


@query(
    f"WITH {LINKS}, u AS (SELECT DISTINCT image_id AS doc, {sql_norm('unit_id')} AS item FROM flow_units WHERE deleted_at IS NULL) SELECT doc, src, dst FROM links l WHERE EXISTS (SELECT 1 FROM u WHERE u.doc = l.doc AND u.item = l.src) AND EXISTS (SELECT 1 FROM u WHERE u.doc = l.doc AND u.item = l.dst)"
)
def j15_endpoint_gate(spark: SparkSession, sf: str) -> DataFrame:
    units = table(spark, sf, "flow_units").filter("deleted_at IS NULL").select(F.col("image_id").alias("doc"), norm_key(F.col("unit_id")).alias("item"))
    return J.endpoint_gate(links(spark, sf), units.filter("item IS NOT NULL"))


@query("SELECT canon_name, count(*) AS n_docs FROM documents JOIN unit_vocab ON contains(lower(text), canon_name) GROUP BY 1")
def j16_text_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Theta match 'text contains name': every text meets all names at once in one automaton."""
    names = table(spark, sf, "unit_vocab").select(F.col("canon_name").alias("name"))
    found = J.mentions(table(spark, sf, "documents").select(F.lower("text").alias("text")), names)
    return found.groupBy(F.col("name").alias("canon_name")).agg(F.count("*").alias("n_docs"))


@query()
def j17_negative_partner(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("report_id", "doc_id")
    return J.negative_partner(rows, "report_id", "doc_id", max(64, rows.count() // 100_000))


@query("SELECT count(*) AS n_rows, 0 AS n_same, 0 AS n_unknown, count(*) - count(DISTINCT doc_id) AS n_twice FROM documents")
def j17_partner_audit(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the partners: every row has one, of another document, that exists."""
    documents = table(spark, sf, "documents").select("report_id", "doc_id")
    known = documents.select(F.col("doc_id").alias("partner"), F.col("report_id").alias("of"), F.lit(1).alias("known"))
    met = j17_negative_partner(spark, sf).join(known, "partner", "left")
    return met.agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("report_id").eqNullSafe(F.col("partner_doc"))).alias("n_same"),
        F.count_if(F.col("known").isNull() | ~F.col("of").eqNullSafe(F.col("partner_doc"))).alias("n_unknown"), (F.count("*") - F.count_distinct("doc_id")).alias("n_twice"),
    )


@query(
    f"WITH t AS (SELECT DISTINCT unit_rid, unnest(string_split_regex({sql_norm('unit_type')}, '[^a-z]+')) AS token FROM flow_units), k AS (SELECT DISTINCT category, unnest(string_split_regex(canon_name, '[^a-z]+')) AS token FROM unit_vocab) SELECT category, token, count(*) AS n FROM t JOIN k USING (token) GROUP BY 1, 2"
)
def j18_keyword_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens looked up in the keyword dimension (fixed, small), counted per category."""
    tokens = table(spark, sf, "flow_units").select("unit_rid", F.explode(F.split(norm_key(F.col("unit_type")), "[^a-z]+")).alias("token")).distinct()
    words = table(spark, sf, "unit_vocab").select("category", F.explode(F.split("canon_name", "[^a-z]+")).alias("token")).distinct()
    return tokens.join(words, "token").groupBy("category", "token").agg(F.count("*").alias("n"))


@query(
    f"WITH {LATEST}, t AS (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS target), g AS (SELECT target, doc, round(abs(doc_f1 - target), 9) AS gap, split = 'val' AS pref FROM latest, t WHERE doc_f1 IS NOT NULL),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY (CASE WHEN pref AND gap <= 0.05 THEN 0 ELSE 1 END), gap, doc) AS rn FROM g) SELECT target, doc AS name, round(gap, 6) AS gap, coalesce(pref AND gap <= 0.05, false) AS preferred FROM r WHERE rn = 1"
)
def j19_nearest_number(spark: SparkSession, sf: str) -> DataFrame:
    rows = latest_predictions(spark, sf).select("doc", F.round("doc_f1", 9).alias("doc_f1"), "split")
    out = J.nearest_number(rows, [0.25, 0.5, 0.75], "doc_f1", "doc", F.col("split") == "val", 0.05)
    return out.select("target", "name", _R("gap"), "preferred")


@query(
    _KNN
    + ", n AS (SELECT r.id, sum(greatest(s, 0) * label) / sum(greatest(s, 0)) AS m FROM r JOIN embeddings e ON e.vec_id = r.neighbor WHERE rank <= 10 AND label IS NOT NULL GROUP BY 1) SELECT id, round(m, 5) AS neighbor_mean, round(e.label - m, 5) AS difference FROM n JOIN embeddings e ON e.vec_id = n.id"
)
def j20_neighbor_features(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity-weighted mean of the neighbours' value, and the row's own value less it."""
    v = _vectors(spark, sf)
    labels = table(spark, sf, "embeddings").select("vec_id", "label")
    near = N.knn(v.filter("id % 20 = 0"), v, 10, same=True).join(labels.withColumnRenamed("vec_id", "neighbor"), "neighbor").filter("label IS NOT NULL")
    w = F.greatest("score", F.lit(0.0))
    mean = near.groupBy("id").agg(F.try_divide(F.sum(w * F.col("label")), F.sum(w)).alias("m"))
    own = mean.join(labels.withColumnRenamed("vec_id", "id"), "id")
    return own.select("id", F.round("m", 5).alias("neighbor_mean"), F.round(F.col("label") - F.col("m"), 5).alias("difference"))


_RANK = "WITH h AS (SELECT DISTINCT table_id, document_id, lower(coalesce(caption, '') || ' ' || coalesce(array_to_string(headers, ' '), '')) AS t FROM extracted_tables), s AS (SELECT *, (contains(t, 'grade')::INT + contains(t, 'inventory')::INT + contains(t, 'mass')::INT) AS score FROM h)"


@query(_RANK + ", r AS (SELECT document_id, table_id, score, (row_number() OVER (PARTITION BY document_id ORDER BY score DESC, table_id))::INT AS rank FROM s WHERE score > 0) SELECT * FROM r WHERE rank <= 3")
def j21_ranked_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Tables of a document ranked by how many keywords their header text holds."""
    from oreloom.operators.corpus import top_per_group

    t = F.lower(F.concat_ws(" ", F.coalesce("caption", F.lit("")), F.coalesce(F.array_join("headers", " "), F.lit(""))))
    rows = table(spark, sf, "extracted_tables").select("document_id", "table_id", t.alias("t")).distinct()
    score = sum(F.contains(F.col("t"), F.lit(w)).cast("int") for w in ("grade", "inventory", "mass"))
    scored = rows.select("document_id", "table_id", score.alias("score")).filter("score > 0")
    return top_per_group(scored, ["document_id"], [F.desc("score"), F.col("table_id")], 3)


@query(
    "WITH f AS (SELECT DISTINCT feature_id, commodity, price_year, section_group FROM doc_features), s AS (SELECT *, round(2.0 / (1 + 5 * abs(price_year - 2015)), 9) + 1.5 * (section_group = 'economics')::INT AS score FROM f WHERE price_year IS NOT NULL AND section_group IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY commodity ORDER BY score DESC, feature_id) AS rn FROM s) SELECT commodity, feature_id, round(score, 6) AS score FROM r WHERE rn = 1"
)
def j22_best_match(spark: SparkSession, sf: str) -> DataFrame:
    """Best-scoring row per group: attribute score and max_by."""
    rows = table(spark, sf, "doc_features").select("feature_id", "commodity", "price_year", "section_group").distinct().filter("price_year IS NOT NULL AND section_group IS NOT NULL")
    score = F.round(2.0 / (1 + 5 * F.abs(F.col("price_year") - 2015)), 9) + 1.5 * (F.col("section_group") == "economics").cast("int")
    best = F.max_by("feature_id", F.struct("score", -F.col("feature_id")))
    return rows.withColumn("score", score).groupBy("commodity").agg(best.alias("feature_id"), F.round(F.max("score"), 6).alias("score"))


@query("WITH u AS (SELECT c_nationkey AS k, 1 AS pr FROM customer UNION ALL SELECT s_nationkey, 2 FROM supplier) SELECT k, min(pr) AS source FROM u GROUP BY 1")
def u1_union_priority(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.lit(1).alias("pr"))
    b = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.lit(2).alias("pr"))
    return a.unionByName(b).groupBy("k").agg(F.min("pr").alias("source"))


@query(
    f"WITH {LATEST}, l AS (SELECT doc, list_concat(coalesce(ground_truth, []), coalesce(xgb_stages, [])) AS l FROM latest) SELECT doc, array_to_string(list_filter(l, lambda x, i: x IS NOT NULL AND list_position(l, x) = i), '|') AS x FROM l"
)
def u2_ordered_union(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered distinct union of two lists: first positions are kept, nulls dropped."""
    none = F.array().cast("array<string>")
    both = F.array_distinct(F.concat(F.coalesce("ground_truth", none), F.coalesce("xgb_stages", none)))
    return latest_predictions(spark, sf).select("doc", F.array_join(F.array_compact(both), "|").alias("x"))


@query(f"WITH {BOTH} SELECT doc, item FROM truth INTERSECT SELECT doc, item FROM pred")
def u3_intersect(spark: SparkSession, sf: str) -> DataFrame:
    return truth(spark, sf).intersect(predicted(spark, sf))


@query(f"WITH {BOTH} SELECT doc, item FROM truth EXCEPT SELECT doc, item FROM pred")
def u3_except(spark: SparkSession, sf: str) -> DataFrame:
    return truth(spark, sf).exceptAll(predicted(spark, sf))


@query(
    "WITH a AS (SELECT l_partkey AS k, sum(l_quantity) AS x FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_partkey AS k, sum(l_quantity) AS x FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, round(0.7 * coalesce(a.x, 0) + 0.3 * coalesce(b.x, 0), 6) AS blend FROM a FULL JOIN b ON a.k = b.k"
)
def u4_blend(spark: SparkSession, sf: str) -> DataFrame:
    """Two score maps blended over the union of their keys, absent scores 0: one conditional aggregate instead of a full join."""
    li = table(spark, sf, "lineitem").filter("l_returnflag IN ('R', 'A')")
    w = F.when(F.col("l_returnflag") == "R", 0.7).otherwise(0.3)
    return li.groupBy(F.col("l_partkey").alias("k")).agg(F.round(F.sum(w * F.col("l_quantity")), 6).alias("blend"))


@query("SELECT p_partkey, p_size::DOUBLE AS f0, p_retailprice AS f1, length(p_name)::DOUBLE AS f2 FROM part")
def u5_concat_features(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.concat(F.array(F.col("p_size").cast("double"), F.col("p_retailprice")), F.array(F.length("p_name").cast("double")))
    return table(spark, sf, "part").select("p_partkey", parts.alias("f")).select("p_partkey", *[F.col("f")[i].alias(f"f{i}") for i in range(3)])


@query("SELECT a, b, c FROM range(4) x(a), range(3) y(b), range(3) z(c) WHERE NOT (a = 0 AND b = 2)")
def u6_enumeration(spark: SparkSession, sf: str) -> DataFrame:
    """Option grid as nested sequences (a fixed, small enumeration), then a validity predicate."""
    grid = spark.range(4).select(F.col("id").alias("a"))
    for name, n in (("b", 3), ("c", 3)):
        grid = grid.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias(name))
    return grid.filter("NOT (a = 0 AND b = 2)")
