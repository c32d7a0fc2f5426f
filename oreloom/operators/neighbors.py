"""Nearest neighbours by vector (J12, J13, J20, W3, H12): an exact search in blocks, and an index of cells for many queries.

The index is fitted on a bounded sample (k-means centres and the number of cells to probe that reaches a recall on the
sample); every row is indexed, and a query meets only the rows of the cells it probes. Hot cells are split into blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oreloom.session import cut

#: Rows of the sample that an index is fitted on, and queries among them that it is tuned on.
FIT_ROWS, FIT_QUERIES = 20_000, 400
#: Rows that a cell is meant to hold, and the most cells (a megabyte or so of centres, sent to every task).
CELL_ROWS, MAX_CELLS = 2_000, 4_096
#: Recall that the number of probed cells is chosen for, on the sample.
TARGET_RECALL = 0.97
BLOCK = 1024


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T


@dataclass(frozen=True)
class CellIndex:
    """Centres of the cells and how many nearest cells a query probes; cosine vectors are scaled to length 1 first."""

    centres: np.ndarray
    probes: int
    metric: str

    def nearest(self, vectors: np.ndarray, n: int) -> np.ndarray:
        x = _unit(vectors) if self.metric == "cosine" else vectors
        d = _distances(x, self.centres)
        return np.argsort(d, axis=1, kind="stable")[:, :n]


def fit_cells(base: DataFrame, k: int, metric: str = "cosine", fit_rows: int = FIT_ROWS, target: float = TARGET_RECALL) -> CellIndex:
    """Fit an index on about ``fit_rows`` rows of base (id, vec), chosen by hash of the id; at most twice as many reach the driver."""
    whole = base.count()
    part = base.filter(F.col("vec").isNotNull())
    if whole > fit_rows:
        part = part.filter(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1_000_000)) < max(1, fit_rows * 1_000_000 // whole)).limit(2 * fit_rows)
    rows = part.orderBy("id").collect()
    if not rows:
        return CellIndex(np.zeros((1, 1)), 1, metric)
    x = np.array([r["vec"] for r in rows], np.float64)
    x = _unit(x) if metric == "cosine" else x
    cells = int(max(1, min(MAX_CELLS, whole // CELL_ROWS, len(x) // 4) if whole >= 2 * CELL_ROWS else min(16, len(x) // 32)))
    rng = np.random.default_rng(3)
    centres = x[rng.choice(len(x), max(1, cells), replace=False)]
    for _ in range(12):
        at = np.argmin(_distances(x, centres), axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        n = np.bincount(at, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    at = np.argmin(_distances(x, centres), axis=1)
    asked = rng.choice(len(x), min(FIT_QUERIES, len(x)), replace=False)
    near = np.argsort(_distances(x[asked], x), axis=1)[:, 1 : k + 1]
    order = np.argsort(_distances(x[asked], centres), axis=1)
    place = np.argsort(order, axis=1)  # place[q, c]: which probe of q reaches cell c
    needed = np.take_along_axis(place, at[near], axis=1).ravel() if near.size else np.zeros(1)
    return CellIndex(centres, int(np.quantile(needed, target, method="higher")) + 1, metric)


def _best(k: int, metric: str, same: bool):  # noqa: ANN202
    """Function over pairs of blocks (q, b): one matrix product each, the k best base rows of each query."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for q, b in zip(pdf["q"], pdf["b"], strict=True):
                qid, bid = np.array([r["id"] for r in q]), np.array([r["id"] for r in b])
                x = np.array([r["vec"] for r in q], np.float64)
                y = np.array([r["vec"] for r in b], np.float64)
                s = _unit(x) @ _unit(y).T if metric == "cosine" else -np.sqrt(np.maximum(_distances(x, y), 0))
                s = np.round(s, 9)
                if same:
                    s[qid[:, None] == bid[None]] = -np.inf
                order = np.lexsort((np.broadcast_to(bid, s.shape), -s), axis=1)[:, :k]
                rows = pd.DataFrame({"id": np.repeat(qid, order.shape[1]), "neighbor": bid[order].ravel(), "score": np.take_along_axis(s, order, 1).ravel()})
                yield rows[np.isfinite(rows["score"])]

    return run


def _blocks(rows: DataFrame, name: str, size: int) -> DataFrame:
    """Rows (cell, id, vec) gathered into blocks of about ``size`` per cell; as many blocks as the cell needs."""
    counts = rows.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(size)).alias("__n"))  # at most MAX_CELLS rows
    spot = F.pmod(F.xxhash64("id"), F.col("__n"))
    return rows.join(F.broadcast(counts), "cell").groupBy("cell", spot.alias("__spot")).agg(F.collect_list(F.struct("id", "vec")).alias(name)).drop("__spot")


def _celled(rows: DataFrame, index: CellIndex | None, n: int) -> DataFrame:
    """(cell, id, vec): each row in the n nearest cells; without an index all in one."""
    plain = rows.select("id", "vec").filter("vec IS NOT NULL")
    if index is None:
        return plain.select(F.lit(0).alias("cell"), "id", "vec")

    @F.pandas_udf("array<int>")
    def cells(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        return pd.Series(list(index.nearest(np.array(vectors.tolist(), np.float64), n).astype(np.int32)))

    return plain.select(F.explode(cells("vec")).alias("cell"), "id", "vec")


def knn(
    queries: DataFrame, base: DataFrame, k: int, metric: str = "cosine", floor: float | None = None, block: int = BLOCK, same: bool = False,
    index: CellIndex | None = None,
) -> DataFrame:
    """k nearest base rows of each query; (id, vec) on both sides -> id, neighbor, score, rank.

    Without an index every query meets all rows, in blocks: exact, for a stated set of queries. With one, queries meet the
    rows of the cells they probe. Each pair of blocks is one matrix product that keeps its k best per query.
    same: a row is not its own neighbour. metric: cosine (higher is nearer) or euclidean (negative distance). Ties by id;
    rows without a vector take no part.
    """
    asked = _blocks(_celled(queries, index, index.probes if index else 1), "q", block)
    held = _blocks(_celled(base, index, 1), "b", block)
    found = asked.join(held, "cell").select("q", "b").mapInPandas(_best(k, metric, same), "id bigint, neighbor bigint, score double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "neighbor"))
    found = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return found if floor is None else found.filter(F.col("score") >= floor)


def nearest_others(points: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
    """k nearest other rows of every row of points (id, vec) -> id, vec, rank, neighbor, other (its vector); ties by id.

    As knn of points against themselves with same, but rows of equal vectors, which are at distance 0, are searched once: of
    a vector only the k + 1 smallest ids can be anybody's neighbours, and only the k nearest other vectors, ties by their
    smallest id, can hold one. The search is exact and grows with the square of the distinct vectors, not of the rows.
    """
    first = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    ids = points.filter("vec IS NOT NULL").withColumn("__rn", first).filter(F.col("__rn") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    shapes = cut(ids.select(F.col("ids")[0].alias("id"), "vec", "ids"))
    far = knn(shapes, shapes, k, metric, same=True).select("id", F.col("neighbor").alias("at"), (-F.col("score")).alias("distance"))
    held = shapes.select(F.col("id").alias("at"), F.col("vec").alias("other"), "ids")
    own = shapes.select("id", F.col("id").alias("at"), F.lit(0.0).alias("distance"))
    rows = far.unionByName(own).join(held, "at").select("id", "distance", F.explode("ids").alias("neighbor"), "other")
    best = rows.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("distance", "neighbor", "other"))), 1, k + 1).alias("near"))
    known = shapes.select(F.col("id").alias("at"), "vec").join(best.withColumnRenamed("id", "at"), "at").drop("at")
    mine = points.join(known, "vec").select("id", "vec", F.slice(F.filter("near", lambda x: x["neighbor"] != F.col("id")), 1, k).alias("near"))
    return mine.select("id", "vec", F.posexplode("near").alias("rank", "n")).select("id", "vec", (F.col("rank") + 1).alias("rank"), F.col("n.neighbor").alias("neighbor"), F.col("n.other").alias("other"))


def recall(found: DataFrame, exact: DataFrame) -> Column | float:
    """Share of the exact neighbours that were found."""
    both = exact.select("id", "neighbor").join(found.select("id", "neighbor", F.lit(1).alias("hit")), ["id", "neighbor"], "left")
    return both.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0]
