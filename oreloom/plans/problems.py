"""Registered queries of the general training-data problems (1, 3, 4, 5) and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oreloom.functions.keys import norm_key
from oreloom.operators import hierarchy, nested, orphans, units
from oreloom.plans.nested_sql import child_records_sql, flat_sql, rejects_sql
from oreloom.plans.units_sql import common_values_sql
from oreloom.session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return nested.child_records(table(spark, sf, "xgb_traces"))


def p1_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Every node of every trace with its interval labels and those of the nodes that hold it."""
    nodes = nested.trace_nodes(table(spark, sf, "xgb_traces"), with_attrs=False)
    return nodes.select("trace_id", "rec", "kind", "name", "name2", "pre", "post", "stage_pre", "section_pre").distinct()


def _numbers(*names: str) -> list[Column]:
    return [F.col("attrs")[n].try_cast("double").alias(n) for n in names]


def p1_stages(spark: SparkSession, sf: str) -> DataFrame:
    """Flat stage rows."""
    nodes = nested.trace_nodes(table(spark, sf, "xgb_traces")).filter("kind = 'stage'")
    flags = [F.col("attrs")[n].try_cast("boolean").alias(n) for n in ("selected", "in_ground_truth")]
    return nodes.select("trace_id", F.col("name").alias("stage"), *_numbers("probability", "threshold", "val_f1", "val_support"), *flags).distinct()


def p1_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Flat section rows that name their trace and stage."""
    nodes = nested.trace_nodes(table(spark, sf, "xgb_traces")).filter("kind = 'section'")
    return nodes.select("trace_id", F.col("stage_name").alias("stage"), F.col("name").alias("section"), *_numbers("weight")).distinct()


def p1_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Flat evidence rows that name their trace, stage and section."""
    nodes = nested.trace_nodes(table(spark, sf, "xgb_traces")).filter("kind = 'evidence'")
    return nodes.select(
        "trace_id", F.col("stage_name").alias("stage"), F.col("section_name").alias("section"), F.col("name").try_cast("bigint").alias("page"),
        F.col("attrs")["table_id"].alias("table_id"), F.col("attrs")["quote"].alias("quote"),
    ).distinct()


def p1_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Flat edge rows of each trace."""
    nodes = nested.trace_nodes(table(spark, sf, "xgb_traces")).filter("kind = 'edge'")
    return nodes.select("trace_id", F.col("name").alias("src"), F.col("name2").alias("dst"), *_numbers("support", "score")).distinct()


def p1_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Fields whose JSON is broken, which yield no rows elsewhere."""
    return nested.rejected_fields(table(spark, sf, "xgb_traces"), "trace_id", nested.TRACE_SHAPE)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return units.common_values(table(spark, sf, "doc_features"), table(spark, sf, "extracted_tables"), table(spark, sf, "fx_rates"))


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    flow_units, flow_stages = table(spark, sf, "flow_units"), table(spark, sf, "flow_stages")
    ends = F.array(
        F.struct(F.lit("connection.parent_id").alias("ref_field"), norm_key(F.col("parent_id")).alias("key")),
        F.struct(F.lit("connection.child_id").alias("ref_field"), norm_key(F.col("child_id")).alias("key")),
    )
    connections = table(spark, sf, "flow_connections").select(
        F.col("conn_rid").alias("row_id"), F.lit("unit").alias("target"), "image_id", F.col("created_at").alias("at"), F.inline(ends)
    )
    stages = flow_units.select(
        F.col("unit_rid").alias("row_id"), F.lit("stage").alias("target"), "image_id", F.col("created_at").alias("at"),
        F.lit("unit.stage_id").alias("ref_field"), norm_key(F.col("stage_id")).alias("key"),
    )
    image = norm_key(F.col("image_id")).alias("image_id")
    refs = connections.unionByName(stages).select("ref_field", "row_id", "target", image, "key", "at").filter(F.col("key").isNotNull())
    parents = flow_units.select(
        F.lit("unit").alias("target"), image, norm_key(F.col("unit_id")).alias("key"), F.col("created_at").alias("created"), F.col("deleted_at").alias("deleted")
    ).unionByName(
        flow_stages.select(
            F.lit("stage").alias("target"), image, norm_key(F.col("stage_id")).alias("key"), F.col("created_at").alias("created"), F.col("deleted_at").alias("deleted")
        )
    )
    n_parents = flow_units.count() + flow_stages.count()  # from the files' footers
    return orphans.find_orphans(refs, parents.filter(F.col("key").isNotNull()), ["target", "image_id", "key"], n_parents)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf)


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, sf))


def _hierarchies(spark: SparkSession, sf: str, steps: bool = False) -> DataFrame:
    return hierarchy.hierarchies(
        table(spark, sf, "flow_connections").select(
            F.col("image_id").alias("g"), norm_key(F.col("parent_id")).alias("parent"), norm_key(F.col("child_id")).alias("child")
        ),
        steps=steps,
    )


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _hierarchies(spark, sf).withColumnRenamed("g", "image_id")


def p5_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.descendants(_hierarchies(spark, sf, steps=True)).withColumnRenamed("g", "image_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_nodes, p1_stages, p1_sections, p1_evidence, p1_edges, p1_rejects, p3_found, p4_found, p4_report, p5_found, p5_descendants)}

_WS = r"E' \t\n\r'"
_NORM = lambda c: f"nullif(lower(trim({c}, {_WS})), '')"

_P4 = f"""
WITH refs AS (
  SELECT 'connection.parent_id' AS ref_field, 'unit' AS target, conn_rid AS row_id, image_id, {_NORM('parent_id')} AS k, created_at AS at FROM flow_connections
  UNION SELECT 'connection.child_id', 'unit', conn_rid, image_id, {_NORM('child_id')}, created_at FROM flow_connections
  UNION SELECT 'unit.stage_id', 'stage', unit_rid, image_id, {_NORM('stage_id')}, created_at FROM flow_units),
targets AS (
  SELECT 'unit' AS target, image_id, {_NORM('unit_id')} AS k, created_at AS c, deleted_at AS d FROM flow_units
  UNION SELECT 'stage', image_id, {_NORM('stage_id')}, created_at, deleted_at FROM flow_stages),
judged AS (
  SELECT r.ref_field, r.row_id, strftime(any_value(r.at), '%Y-%m') AS ref_month, count(t.k) AS n,
    count(*) FILTER (t.c <= r.at AND (t.d IS NULL OR t.d > r.at)) AS sound, count(*) FILTER (t.c <= r.at) AS born
  FROM refs r LEFT JOIN targets t ON r.target = t.target AND r.image_id = t.image_id AND r.k = t.k
  WHERE r.k IS NOT NULL GROUP BY r.ref_field, r.row_id, r.at, r.k),
found AS (
  SELECT DISTINCT ref_field, row_id, ref_month, CASE WHEN n = 0 THEN 'missing' WHEN born > 0 THEN 'deleted' ELSE 'late' END AS reason
  FROM judged WHERE sound = 0)
"""
_P5_TREES = f"""
WITH RECURSIVE links AS (SELECT DISTINCT image_id, {_NORM('parent_id')} AS p, {_NORM('child_id')} AS c FROM flow_connections),
nodes AS (SELECT image_id, p AS v FROM links WHERE p IS NOT NULL UNION SELECT image_id, c FROM links WHERE c IS NOT NULL),
par AS (SELECT image_id, c AS v, min(p) AS p FROM links WHERE p IS NOT NULL AND c IS NOT NULL GROUP BY 1, 2),
down AS (
  SELECT n.image_id, n.v, n.v AS root_id, 0 AS node_depth, n.v AS node_path FROM nodes n LEFT JOIN par USING (image_id, v) WHERE par.p IS NULL
  UNION ALL
  SELECT par.image_id, par.v, down.root_id, down.node_depth + 1, down.node_path || '>' || par.v
  FROM down JOIN par ON par.image_id = down.image_id AND par.p = down.v)
"""

_P5_ALL = (
    _P5_TREES
    + """,
rest AS (SELECT par.* FROM par WHERE NOT EXISTS (SELECT 1 FROM down WHERE down.image_id = par.image_id AND down.v = par.v)),
reach AS (SELECT image_id, v AS x, p AS anc FROM rest UNION SELECT r.image_id, r.x, rest.p FROM reach r JOIN rest ON rest.image_id = r.image_id AND rest.v = r.anc),
pairs AS (SELECT image_id, anc, x FROM reach WHERE anc <> x UNION SELECT image_id, a.anc, v FROM down, unnest(string_split(node_path, '>')[:-2]) AS a(anc) WHERE node_depth > 0),
n AS (SELECT image_id, anc AS v, count(*) AS n FROM pairs GROUP BY 1, 2),
placed AS (
  SELECT image_id, v, root_id, node_depth, node_path FROM down
  UNION ALL SELECT image_id, v, '', CASE WHEN EXISTS (SELECT 1 FROM reach r WHERE r.image_id = rest.image_id AND r.x = rest.v AND r.anc = rest.v) THEN -1 ELSE -2 END, '' FROM rest)
SELECT image_id, v AS node_id, root_id, node_depth, node_path, coalesce(n.n, 0) AS n_descendants FROM placed LEFT JOIN n USING (image_id, v)
"""
)

ORACLES = {
    "p1_found": child_records_sql(),
    "p1_rejects": rejects_sql(),
    **{f"p1_{kind}": flat_sql(kind) for kind in ("stages", "sections", "evidence", "edges")},
    "p3_found": common_values_sql(),
    "p5_found": _P5_ALL,
    "p4_found": _P4 + "SELECT * FROM found",
    "p4_report": _P4 + "SELECT ref_field, ref_month, reason, count(*) AS n_orphans FROM found GROUP BY 1, 2, 3",
    "p5_descendants": _P5_TREES
    + "SELECT DISTINCT image_id, a.node_id, v AS descendant_id FROM down, unnest(string_split(node_path, '>')[:-2]) AS a(node_id) WHERE node_depth > 0",
}
