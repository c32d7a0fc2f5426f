"""Queries of the graph analytics (H1-H12) over flow_connections and the corpus transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreloom.operators import corpus as C
from oreloom.operators import graphs as G
from oreloom.operators import joins as J
from oreloom.operators import neighbors as N
from oreloom.plans.base import SEQ, sequences
from oreloom.plans.registry import query
from oreloom.session import table

_EDGES = f"WITH RECURSIVE {SEQ}, edges AS (SELECT DISTINCT doc, src, dst FROM (SELECT doc, stage AS src, lead(stage) OVER (PARTITION BY doc ORDER BY pos) AS dst FROM seq) WHERE dst IS NOT NULL)"


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return C.transitions(sequences(spark, sf)).distinct()


@query()
def h1_topological_smallest(spark: SparkSession, sf: str) -> DataFrame:
    return G.topological_order(_edges(spark, sf))


@query()
def h2_topological_fifo(spark: SparkSession, sf: str) -> DataFrame:
    return G.topological_order(_edges(spark, sf), smallest_first=False)


@query(_EDGES + ", r AS (SELECT doc, src, dst FROM edges UNION SELECT r.doc, r.src, e.dst FROM r JOIN edges e ON e.doc = r.doc AND e.src = r.dst) SELECT doc, src, dst FROM r WHERE src <> dst")
def h3_reachability(spark: SparkSession, sf: str) -> DataFrame:
    return G.reachability(_edges(spark, sf))


@query()
def h7_back_edges(spark: SparkSession, sf: str) -> DataFrame:
    return G.back_edges_and_depth(_edges(spark, sf))


_ACYCLIC = (
    _EDGES
    + ", reach AS (SELECT doc, src, dst FROM edges UNION SELECT r.doc, r.src, e.dst FROM reach r JOIN edges e ON e.doc = r.doc AND e.src = r.dst), cyclic AS (SELECT DISTINCT doc FROM reach WHERE src = dst),"
    + " nodes AS (SELECT doc, src AS n FROM edges UNION SELECT doc, dst FROM edges) SELECT doc, count(*) AS n_nodes, 0 AS n_wrong FROM nodes WHERE doc NOT IN (SELECT doc FROM cyclic) GROUP BY 1"
)


def _order_audit(edges: DataFrame, smallest_first: bool) -> DataFrame:
    """doc, n_nodes, n_wrong of documents without back edges: nodes placed, and edges that point backwards or places held twice."""
    loops = G.back_edges_and_depth(edges).filter("is_back").select("doc").distinct()
    order = G.topological_order(edges, smallest_first=smallest_first).join(loops, "doc", "left_anti")
    name, place = order.columns[1:3]
    at = lambda end: order.select("doc", F.col(name).alias(end), F.col(place).alias(f"{end}_at"))
    placed = edges.join(loops, "doc", "left_anti").join(at("src"), ["doc", "src"], "left").join(at("dst"), ["doc", "dst"], "left")
    wrong = placed.groupBy("doc").agg(F.count_if(~F.coalesce(F.col("src_at") < F.col("dst_at"), F.lit(False))).alias("e"))
    nodes = order.groupBy("doc").agg(F.count("*").alias("n_nodes"), (F.count("*") - F.count_distinct(place)).alias("t"))
    return nodes.join(wrong, "doc").select("doc", "n_nodes", (F.col("e") + F.col("t")).alias("n_wrong"))


@query(_ACYCLIC)
def h1_order_audit(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the order with the smallest node first, where the graph allows one."""
    return _order_audit(_edges(spark, sf), True)


@query(_ACYCLIC)
def h2_order_audit(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the first-in, first-out order, where the graph allows one."""
    return _order_audit(_edges(spark, sf), False)


@query()
def h8_pathways(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus graph has as many rows as pairs of stage names (bounded by the vocabulary); only it is collected."""
    weighted = C.transition_counts(_edges(spark, sf), self_loops=False).orderBy(F.desc("n"), "src", "dst").toPandas()
    rows = [(i, p) for i, p in enumerate(G.pathways(weighted))]
    return spark.createDataFrame(rows, "rank int, path array<string>")


@query(
    _EDGES
    + ", o AS (SELECT stage, row_number() OVER (ORDER BY avg(pos % 1000000000) / 1e9, stage) AS k FROM seq GROUP BY 1), c AS (SELECT src, dst, count(*) AS n FROM edges GROUP BY 1, 2), s AS (SELECT src, dst, n * 1.0 / max(n) OVER () AS score FROM c)"
    + " SELECT src, dst, round(score, 6) AS score FROM s JOIN o a ON a.stage = src JOIN o b ON b.stage = dst WHERE score >= CASE WHEN a.k >= b.k THEN 0.5 ELSE 0.2 END"
)
def h9_recycle_gate(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    seq = sequences(spark, sf)
    order = seq.groupBy("stage").agg((F.avg(F.col("pos") % 1000000000) / 1e9).alias("m"))
    order = order.select("stage", F.row_number().over(Window.orderBy("m", "stage")).alias("k"))  # one row per stage name
    counts = C.transition_counts(_edges(spark, sf)).select("src", "dst", "n")
    top = counts.agg(F.max("n")).first()[0] or 1
    scored = counts.withColumn("score", F.col("n") / F.lit(top))
    a, b = (order.select(F.col("stage").alias(s), F.col("k").alias(f"k_{s}")) for s in ("src", "dst"))
    kept = scored.join(a, "src").join(b, "dst").filter(G.recycle_gate(F.col("score"), F.col("k_src"), F.col("k_dst"), 0.2, 0.5))
    return kept.select("src", "dst", F.round("score", 6).alias("score"))


@query()
def h11_drawn_edges(spark: SparkSession, sf: str) -> DataFrame:
    return G.drawn_edges(_edges(spark, sf))


@query(
    "WITH p AS (SELECT q.vec_id AS id, b.vec_id AS neighbor, b.label, round(list_distance(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS s FROM embeddings q JOIN embeddings b ON q.vec_id <> b.vec_id WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s, neighbor) AS k FROM p)"
    " SELECT id, neighbor, label, round(s, 5) AS distance, round((1 / (s + 1e-6)) / sum(1 / (s + 1e-6)) OVER (PARTITION BY id), 5) AS weight FROM r WHERE k <= 5"
)
def h12_vote_trace(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    near = N.knn(v.filter("id % 20 = 0"), v, 5, "euclidean", same=True).select("id", "neighbor", (-F.col("score")).alias("distance"))
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("neighbor"), "label")
    return G.vote_trace(near, labels).select("id", "neighbor", "label", F.round("distance", 5).alias("distance"), F.round("weight", 5).alias("weight"))


@query(
    "WITH p AS (SELECT q.vec_id AS id, b.vec_id AS neighbor, round(list_distance(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS s FROM embeddings q JOIN embeddings b ON q.vec_id <> b.vec_id WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s, neighbor) AS k FROM p),"
    " d AS (SELECT id, neighbor, s, unnest(generate_series(0, 63)) AS i FROM r WHERE k <= 5),"
    " c AS (SELECT d.id, d.neighbor, s, i, pow(q.embedding[i + 1]::DOUBLE - b.embedding[i + 1]::DOUBLE, 2) AS part FROM d JOIN embeddings q ON q.vec_id = d.id JOIN embeddings b ON b.vec_id = d.neighbor)"
    " SELECT id, neighbor, i::INT AS feature, round(part, 9) AS part, abs(sum(part) OVER (PARTITION BY id, neighbor) - s * s) < 1e-6 AS adds_up FROM c"
)
def h12_contributions(spark: SparkSession, sf: str) -> DataFrame:
    """How much each feature adds to the squared distance of a neighbour, and whether the parts add up to it."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    near = N.knn(v.filter("id % 20 = 0"), v, 5, "euclidean", same=True).select("id", "neighbor", (-F.col("score")).alias("distance"))
    return G.feature_contributions(near, v).select("id", "neighbor", "feature", F.round("part", 9).alias("part"), "adds_up")
