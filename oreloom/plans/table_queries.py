"""Queries of table, page and document shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreloom.operators import corpus as C
from oreloom.operators import joins as J
from oreloom.operators import neighbors as N
from oreloom.operators import learn as L
from oreloom.operators import tables as S
from oreloom.plans.base import LATEST, SEQ, TRUTH, latest_predictions, predicted, sequences, truth
from oreloom.plans.registry import query
from oreloom.session import cut, table


@query()
def r4_parse_table(spark: SparkSession, sf: str) -> DataFrame:
    """Raw rows (headers put back on top) through header inference; the first header and the number of rows come back."""
    raw = table(spark, sf, "extracted_tables").filter("size(headers) > 0 AND size(cell_rows) > 0").select("table_id", F.concat(F.array("headers"), "cell_rows").alias("raw")).distinct()
    return raw.select("table_id", S.parse_table("raw").alias("t")).select("table_id", F.col("t.headers")[0].alias("h0"), F.size("t.rows").alias("n"))


_MAP = {"jaw_crusher": "crusher", "crusher": "crusher", "mill": "mill", "thickener": "thickener", "deck": "screen", "cell": "flotation", "drum": None}


@query(
    """WITH r AS (SELECT DISTINCT unnest(xgb_stages) AS raw FROM test_predictions), m(k, v) AS (VALUES ('jaw_crusher', 'crusher'), ('crusher', 'crusher'), ('mill', 'mill'), ('thickener', 'thickener'), ('deck', 'screen'), ('cell', 'flotation'), ('drum', NULL)),
    w AS (SELECT raw, lower(trim(raw)) AS p, list_filter(string_split(lower(trim(raw)), '_'), lambda x: x NOT IN ('copper', 'gold', 'zinc', 'pyrite')) AS ws FROM r WHERE raw IS NOT NULL),
    c AS (SELECT raw, p, array_to_string(ws, '_') AS j, list_filter(list_reverse(ws), lambda x: x IN ('jaw_crusher', 'crusher', 'mill', 'thickener', 'deck', 'cell', 'drum'))[1] AS l FROM w)
    SELECT raw, m.v AS stage FROM c LEFT JOIN m ON m.k = CASE WHEN p IN (SELECT k FROM m) THEN p WHEN j IN (SELECT k FROM m) THEN j ELSE l END"""
)
def t3_canonical_stage(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "test_predictions").select(F.explode("xgb_stages").alias("raw")).filter("raw IS NOT NULL").distinct()
    return raw.select("raw", S.canonical_stage(F.col("raw"), _MAP, ["copper", "gold", "zinc", "pyrite"]).alias("stage"))


@query(
    f"WITH {SEQ}, n AS (SELECT doc, stage, pos, lag(stage) OVER w AS before, lead(stage) OVER w AS after, (row_number() OVER w - 1) / count(*) OVER (PARTITION BY doc) AS o FROM seq WINDOW w AS (PARTITION BY doc ORDER BY pos))"
    " SELECT doc, pos, CASE WHEN stage = 'dewatering' AND o < 0.3 THEN 'early dewatering' WHEN stage = 'dewatering' AND before = 'leach train' THEN 'leach dewatering' ELSE stage END AS stage FROM n"
)
def t4_contextual_stage(spark: SparkSession, sf: str) -> DataFrame:
    parts = C.in_parts(sequences(spark, sf))
    sizes = parts.groupBy("doc").agg(F.count("*").alias("n"))
    seq = C.ranked(C.beside(C.beside(parts, "stage", "b", ahead=False), "stage", "a", ahead=True), "rank").join(sizes, "doc")
    seq = seq.withColumns({"before": F.array("b"), "after": F.array("a"), "o": (F.col("rank") - 1) / F.col("n")})
    rules = [{"of": "dewatering", "below": 0.3, "to": "early dewatering"}, {"of": "dewatering", "fed_by": "leach train", "to": "leach dewatering"}]
    return seq.select("doc", "pos", S.contextual_stage(F.col("stage"), F.col("o"), F.col("before"), F.col("after"), rules).alias("stage"))


def clean_sql(column: str, stops: tuple[str, ...]) -> str:
    """Stop words and plural endings removed, in SQL."""
    words = f"list_filter(string_split_regex(lower(trim({column})), '\\s+'), lambda w: w <> '' AND w NOT IN ({', '.join(repr(x) for x in stops)}))"
    single = "CASE WHEN regexp_matches(w, '[a-z]{3,}ies$') THEN regexp_replace(w, 'ies$', 'y') WHEN regexp_matches(w, '[a-z]{2,}[^s]s$') THEN regexp_replace(w, 's$', '') ELSE w END"
    return f"array_to_string(list_transform({words}, lambda w: {single}), ' ')"


@query(f"SELECT doc_id, length({clean_sql('text', ('the', 'a', 'of', 'and', 'to', 'in', 'is', 'was', 'for'))})::INT AS n FROM documents WHERE text IS NOT NULL")
def t5_clean_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", F.length(S.clean_text(F.col("text"), ["the", "a", "of", "and", "to", "in", "is", "was", "for"])).alias("n"))


@query("SELECT o_orderkey, round(CASE WHEN o_totalprice >= 50000 THEN o_totalprice / 1e6 WHEN o_totalprice >= 2000 THEN o_totalprice / 1e3 ELSE o_totalprice END, 9) AS mt, round(CASE WHEN o_totalprice > 10000 THEN o_totalprice / 1e3 WHEN o_totalprice < 10 THEN o_totalprice * 1e3 ELSE o_totalprice END, 9) AS money FROM orders")
def t15_common_scale(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("o_totalprice")
    return table(spark, sf, "orders").select("o_orderkey", F.round(S.to_common_scale(F.lit("tonnage"), v), 9).alias("mt"), F.round(S.to_common_scale(F.lit("capex"), v), 9).alias("money"))


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(F.col("report_id").alias("doc"), F.col("page_number").alias("page"), F.col("section_group").alias("section"))
    return rows.dropna().distinct()


_PAGES = "p AS (SELECT DISTINCT report_id AS doc, page_number AS page, section_group AS section FROM documents WHERE report_id IS NOT NULL AND page_number IS NOT NULL AND section_group IS NOT NULL), k AS (SELECT doc, page, count(DISTINCT section) AS k FROM p GROUP BY 1, 2), toc AS (SELECT doc, max(page) FILTER (k >= 3) AS toc FROM k GROUP BY 1), f AS (SELECT p.doc, section, min(page) AS first_page FROM p JOIN toc ON toc.doc = p.doc WHERE page > coalesce(toc, -1) GROUP BY 1, 2)"


@query(f"WITH {_PAGES} SELECT * FROM f")
def w8_first_pages(spark: SparkSession, sf: str) -> DataFrame:
    return S.first_pages(_pages(spark, sf))


@query(f"WITH {_PAGES} SELECT doc, section, first_page, coalesce(lead(first_page) OVER (PARTITION BY doc ORDER BY first_page, section), -1) AS end_page FROM f")
def w9_page_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return S.page_ranges(S.first_pages(_pages(spark, sf))).fillna(-1, ["end_page"])


@query(f"WITH {TRUTH}, c AS (SELECT item, count(*) AS n FROM truth GROUP BY 1 HAVING count(*) >= 2) SELECT item, n, (row_number() OVER (ORDER BY n DESC, item))::INT AS rank FROM c")
def w10_by_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return S.by_frequency(truth(spark, sf))


@query("SELECT c_custkey, c_mktsegment, c_acctbal, (rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC NULLS LAST))::INT AS rank FROM customer")
def w6_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    return S.leaderboard(table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), "c_mktsegment", "c_acctbal")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE ('0x' || substr(md5(o_orderkey::VARCHAR || ':42'), 1, 8))::BIGINT < 429496729")
def w13_seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The sampling operator: a tenth of the rows, the same at every run and engine."""
    return S.seeded_sample(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 0.1)


@query("SELECT DISTINCT table_id, array_to_string(list_transform(cell_rows[1:5], lambda r: coalesce(array_to_string(r, '~'), '')), '|') AS head FROM extracted_tables WHERE table_id IS NOT NULL AND cell_rows IS NOT NULL")
def w13_head_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The head limit: the first five rows of each table."""
    rows = table(spark, sf, "extracted_tables").filter("table_id IS NOT NULL AND cell_rows IS NOT NULL")
    head = F.transform(F.slice("cell_rows", 1, 5), lambda r: F.coalesce(F.array_join(r, "~"), F.lit("")))
    return rows.select("table_id", F.array_join(head, "|").alias("head")).distinct()


@query(
    "WITH p AS (SELECT q.vec_id AS id, b.vec_id AS neighbor, round(list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS s FROM embeddings q JOIN embeddings b ON q.vec_id <> b.vec_id WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, neighbor) AS k FROM p)"
    " SELECT id, neighbor, round(s, 5) AS score FROM r WHERE k <= 20 AND s >= 0.3"
)
def w3_neighbours_with_floor(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return N.knn(v.filter("id % 20 = 0"), v, 20, floor=0.3, same=True).select("id", "neighbor", F.round("score", 5).alias("score"))


def _graphs(spark: SparkSession, sf: str) -> DataFrame:
    """Document graphs: a context node per section with features, a stage node per unit type."""
    context = table(spark, sf, "doc_features").distinct().groupBy(F.col("document_id").alias("doc"), "section_group").agg(F.count("*").cast("double").alias("n"))
    context = context.filter("section_group IS NOT NULL").select("doc", F.struct(F.col("section_group").alias("id"), F.lit("context").alias("type"), F.create_map(F.lit("n"), "n").alias("features")).alias("node"))
    types = table(spark, sf, "flow_units").select("document_id", "unit_type").distinct()
    stage = types.select(F.col("document_id").alias("doc"), F.struct(F.col("unit_type").alias("id"), F.lit("stage").alias("type"), F.create_map(F.lit("n"), F.lit(1.0)).alias("features")).alias("node"))
    return context.unionByName(stage).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("node.type", "node.id", F.to_json("node.features").alias("f")))).alias("g")).select(
        "doc", F.transform("g", lambda n: F.struct(n["id"].alias("id"), n["type"].alias("type"), F.from_json(n["f"], "map<string,double>").alias("features"))).alias("nodes")
    )


@query("SELECT coalesce(c.doc, s.doc) AS doc, coalesce(c.k, 0) AS n_left FROM (SELECT document_id AS doc, count(DISTINCT section_group) AS k FROM doc_features WHERE section_group IS NOT NULL GROUP BY 1) c FULL JOIN (SELECT DISTINCT document_id AS doc FROM flow_units) s ON s.doc = c.doc")
def r12_strip_nodes(spark: SparkSession, sf: str) -> DataFrame:
    nodes, _ = S.without_nodes(F.col("nodes"), F.array().cast("array<struct<type:string>>"), "stage", "stage_transition")
    return _graphs(spark, sf).select("doc", F.size(nodes).cast("bigint").alias("n_left"))


@query("WITH c AS (SELECT document_id AS doc, section_group AS s, count(*)::DOUBLE AS n FROM (SELECT DISTINCT * FROM doc_features) WHERE section_group IS NOT NULL GROUP BY 1, 2) SELECT doc, arg_min(n, s) AS n FROM c GROUP BY 1")
def r13_profile(spark: SparkSession, sf: str) -> DataFrame:
    return _graphs(spark, sf).select("doc", S.profile_value(F.col("nodes"), "n").alias("n")).filter("n IS NOT NULL")


@query(
    f"WITH {SEQ}, e AS (SELECT * FROM (SELECT doc, stage AS src, lead(stage) OVER (PARTITION BY doc ORDER BY pos) AS dst FROM seq) WHERE dst IS NOT NULL), c AS (SELECT doc, src, dst, count(*) AS n FROM e GROUP BY 1, 2, 3)"
    " SELECT doc, string_agg(src || ' -> ' || dst || ' (' || n || ')', '; ' ORDER BY n DESC, src, dst) AS line FROM c GROUP BY 1"
)
def r14_serialise(spark: SparkSession, sf: str) -> DataFrame:
    return S.serialise_chain(C.transitions(sequences(spark, sf)))


@query()
def l7_edge_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Pair classifier with document-wise folds: each fold is scored by a model of the others, on features of the others."""
    seq = sequences(spark, sf)
    edges = cut(C.transitions(seq))
    members = seq.select("doc", F.col("stage").alias("item")).distinct()
    pairs = cut(J.ordered_pairs(members, edges).withColumn("fold", L.fold(F.col("doc"), 3)))
    out = None
    for k in range(3):
        apart = L.fold(F.col("doc"), 3) != k
        features = L.pair_features(pairs.filter(F.col("fold") != k), edges.filter(apart), members.filter(apart), own=True)
        model = L.boosted_trees(features, L.PAIR_FEATURES, "label", trees=8)
        held = L.pair_features(pairs.filter(F.col("fold") == k), edges.filter(apart), members.filter(apart), own=False)
        part = L.score_trees(model, held).select("doc", "src", "dst", "label", F.round("prob", 6).alias("prob"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    r"""WITH t AS (SELECT DISTINCT table_id, lower(coalesce(caption, '')) AS a, lower(coalesce(array_to_string(headers, ' '), '')) AS b FROM extracted_tables),
    w AS (SELECT table_id, list_distinct(list_filter(string_split_regex(a, '[\s\x0b\x1c-\x1f\x{85}\x{a0}]+'), lambda x: x <> '')) AS x, list_distinct(list_filter(string_split_regex(b, '[\s\x0b\x1c-\x1f\x{85}\x{a0}]+'), lambda x: x <> '')) AS y FROM t)
    SELECT table_id, round(coalesce(len(list_intersect(x, y)) / nullif(len(list_distinct(x || y)), 0), 0), 6) AS relevance FROM w"""
)
def l13_scored_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The hook of the relevance model, with its default scorer, over caption and header of each table."""
    rows = table(spark, sf, "extracted_tables").select("table_id", F.coalesce("caption", F.lit("")).alias("a"), F.coalesce(F.array_join("headers", " "), F.lit("")).alias("b")).distinct()
    return L.score_pairs(rows, "a", "b").select("table_id", F.round("relevance", 6).alias("relevance"))


@query()
def l13_lexical_relevance(spark: SparkSession, sf: str) -> DataFrame:
    """Relevance of each latest record to its own commodity's label texts: tf-idf cosine over shared terms."""
    rows = latest_predictions(spark, sf).filter("commodity IS NOT NULL")
    tokens = rows.select("doc", "commodity", F.explode(F.split(F.concat_ws(" ", "xgb_stages"), "[^a-z]+")).alias("term")).filter("term <> ''")
    whole = tokens.select("doc", "term").unionByName(tokens.select(F.col("commodity").alias("doc"), "term"))
    weights = L.tf_idf(whole, rows.count(), 50)
    out = L.lexical_relevance(rows.select(F.col("doc").alias("left_id"), F.col("commodity").alias("right_id")), weights)
    return out.select("left_id", "right_id", F.round("relevance", 6).alias("relevance"))


@query(
    f"WITH {LATEST}, d AS (SELECT doc, commodity, doc_f1, split FROM latest WHERE doc_f1 IS NOT NULL AND commodity IS NOT NULL), s AS (SELECT doc, commodity, round((2.0 / (1 + 5 * abs(doc_f1 - 0.8)) + 1.5 * (split = 'val')::INT) * CASE WHEN doc_f1 > 0.5 THEN 1.2 ELSE 1 END, 9) AS score FROM d), r AS (SELECT *, row_number() OVER (PARTITION BY commodity ORDER BY score DESC, doc) AS k FROM s) SELECT commodity, doc, round(score, 6) AS score FROM r WHERE k <= 3"
)
def l15_attribute_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    """Attribute scores: nearness of a number, equality of a class, a factor for labelled rows; the best three per group."""
    rows = latest_predictions(spark, sf).filter("doc_f1 IS NOT NULL AND commodity IS NOT NULL")
    score = (2.0 / (1 + 5 * F.abs(F.col("doc_f1") - 0.8)) + 1.5 * F.coalesce((F.col("split") == "val").cast("int"), F.lit(0))) * F.when(F.col("doc_f1") > 0.5, 1.2).otherwise(1.0)
    scored = rows.select("commodity", "doc", F.round(score, 9).alias("score"))
    return C.top_per_group(scored, ["commodity"], [F.desc("score"), F.col("doc")], 3).select("commodity", "doc", F.round("score", 6).alias("score"))
