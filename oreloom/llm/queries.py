"""Registered queries of the training-data problems of this subpackage and their SQL, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreloom.llm import canonical, cooccur, packing, pages, tokens
from oreloom.session import cut, table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = cooccur.cooccurrences(cooccur.stage_baskets(table(spark, sf, "test_predictions")))
    return pairs.select("list_name", F.col("a").alias("stage_a"), F.col("b").alias("stage_b"))


def p2_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs of p2_found with the counts behind them."""
    pairs = cooccur.cooccurrences(cooccur.stage_baskets(table(spark, sf, "test_predictions")))
    return pairs.select("list_name", F.col("a").alias("stage_a"), F.col("b").alias("stage_b"), "n_a", "n_b", "n_ab", "n", F.round("lift", 6).alias("lift"))


def p2_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """How many records of each list are split, and into how many blocks of chunk pairs."""
    return cooccur.blocked_baskets(cooccur.stage_baskets(table(spark, sf, "test_predictions")))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.canonical_units(table(spark, sf, "flow_units"), table(spark, sf, "unit_vocab"))


def p6_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.unmatched_values(table(spark, sf, "flow_units"), table(spark, sf, "unit_vocab"))


def p6_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.candidates(table(spark, sf, "flow_units"), table(spark, sf, "unit_vocab"))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf, "documents"))


def p8_pack(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"))


def p8_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Membership, splits and capacity of p8_pack."""
    documents = table(spark, sf, "documents")
    return packing.packing_audit(cut(packing.pack_documents(documents)), documents)


def p8_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of each window and how far its mixture of sources is from the corpus's."""
    mixture = packing.window_mixture(cut(packing.pack_documents(table(spark, sf, "documents"))))
    return mixture.select("window_id", "n_tokens", F.round("deviation", 6).alias("deviation"))


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.container_fill(packing.pack_documents(table(spark, sf, "documents")))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return pages.spam_pages(table(spark, sf, "documents"))


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Share of each page's text that is not prose."""
    return pages.page_shares(table(spark, sf, "documents")).select("doc_id", F.round("other_share", 6).alias("other_share"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p2_found, p2_scores, p2_blocks, p6_found, p6_unmatched, p6_candidates, p7_ids, p8_pack, p8_audit, p8_mixture, p8_fill, p9_found, p9_shares)}


_P2_NAMES = """
WITH latest AS (
  SELECT doc_id, ground_truth, xgb_stages FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY produced_at DESC NULLS LAST, ground_truth DESC, xgb_stages DESC) AS rn
    FROM test_predictions) WHERE rn = 1),
names AS (
  SELECT DISTINCT doc_id, 'ground_truth' AS list_name, nullif(lower(trim(s, E' \\t\\n\\r')), '') AS item FROM latest, unnest(ground_truth) AS u(s)
  UNION
  SELECT DISTINCT doc_id, 'xgb_stages', nullif(lower(trim(s, E' \\t\\n\\r')), '') FROM latest, unnest(xgb_stages) AS u(s)),
kept AS (SELECT * FROM names WHERE item IS NOT NULL)
"""
_P2 = (
    _P2_NAMES
    + """,
total AS (SELECT list_name, count(DISTINCT doc_id) AS n FROM kept GROUP BY 1),
single AS (SELECT list_name, item, count(*) AS n FROM kept GROUP BY 1, 2),
pairs AS (
  SELECT x.list_name, x.item AS a, y.item AS b, count(*) AS n_ab
  FROM kept x JOIN kept y ON x.doc_id = y.doc_id AND x.list_name = y.list_name AND x.item < y.item GROUP BY 1, 2, 3)
SELECT p.list_name, p.a AS stage_a, p.b AS stage_b{extra}
FROM pairs p JOIN total t USING (list_name)
JOIN single sa ON sa.list_name = p.list_name AND sa.item = p.a
JOIN single sb ON sb.list_name = p.list_name AND sb.item = p.b
WHERE p.n_ab >= 5 AND p.n_ab * t.n >= 3 * sa.n * sb.n
"""
)
_P2_BLOCKS = (
    _P2_NAMES
    + """,
sized AS (SELECT list_name, doc_id, count(*) AS m FROM kept GROUP BY 1, 2),
split AS (SELECT list_name, ceil(m / least(greatest(sqrt(m), 8.0), 256.0))::BIGINT AS k FROM sized)
SELECT list_name, count(*) AS n_baskets, count(*) FILTER (k > 1) AS n_large, coalesce(sum(k * (k + 1) // 2) FILTER (k > 1), 0)::BIGINT AS n_blocks FROM split GROUP BY 1
"""
)


def oracle_sql() -> dict[str, str]:
    return {
        "p8_audit": "SELECT count(DISTINCT doc_id) AS n_items, 0 AS n_lost, 0 AS n_torn, 0 AS n_over, 0 AS n_loose FROM documents",
        "p2_blocks": _P2_BLOCKS,
        "p2_found": _P2.format(extra=""),
        "p2_scores": _P2.format(
            extra=", sa.n AS n_a, sb.n AS n_b, p.n_ab, t.n, round(p.n_ab::DOUBLE * t.n / (sa.n::DOUBLE * sb.n), 6) AS lift"
        ),
    }
