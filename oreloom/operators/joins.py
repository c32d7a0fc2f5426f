"""Joins that Spark has no single operator for: as-of, nearest, band, kNN, gates and sampling.

Each has an equi-key that splits the work: a group key plus a bucket of the ordered column, or a block number.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oreloom.operators.corpus import item_pairs


def nearest_within(left: DataFrame, right: DataFrame, key: str, at: str, tolerance: int, value: str) -> DataFrame:
    """For each left row the value of the right row of the same key with the nearest ``at`` within the tolerance.

    Ties go to the smaller ``at``, then the smaller value. ``at`` is whole. Left rows look into the three buckets of
    width tolerance + 1 around them, so a hot key is spread over its buckets. Result: left columns and ``near``.
    """
    width = tolerance + 1
    marks = right.filter(F.col(at).isNotNull()).groupBy(key, F.col(at).alias("__at")).agg(F.min(value).alias("__value"))
    marks = marks.withColumn("__bucket", F.floor(F.col("__at") / width))
    here = F.floor(F.col(at) / width)
    asked = left.withColumn("__id", F.monotonically_increasing_id())
    spread = asked.select(key, at, "__id", F.explode(F.array(here - 1, here, here + 1)).alias("__bucket"))
    gap = F.abs(F.col("__at") - F.col(at))
    found = spread.join(marks, [key, "__bucket"]).filter(gap <= tolerance)
    columns = [c for c in left.columns if c not in (key, at)]
    near = found.groupBy(key, at).agg(F.min_by("__value", F.struct(gap, "__at")).alias("near"))
    return left.join(near, [key, at], "left").select(key, at, *columns, "near")


def asof_backward(left: DataFrame, right: DataFrame, key: str, at: str, value: str, width: int) -> DataFrame:
    """For each left row the value of the last right row of its key with right.at <= left.at (null if none).

    Both sides are stacked and scanned in order inside (key, bucket of width); what a bucket inherits is the last mark
    of the buckets before it, found on one row per bucket. No join, and a hot key is spread over its buckets.
    """
    bucket = F.floor(F.col(at) / width)
    marks = right.groupBy(key, at).agg(F.max(value).alias("__mark"))
    sides = left.select(key, at, bucket.alias("__bucket"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(marks.schema["__mark"].dataType).alias("__mark"))
    stacked = sides.unionByName(marks.select(key, at, bucket.alias("__bucket"), F.lit(None).cast(sides.schema["__row"].dataType).alias("__row"), "__mark"))
    inside = Window.partitionBy(key, "__bucket").orderBy(F.col(at), F.col("__row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    own = stacked.withColumn("__own", F.last("__mark", ignorenulls=True).over(inside))
    last = stacked.groupBy(key, "__bucket").agg(F.max_by("__mark", F.when(F.col("__mark").isNotNull(), F.col(at))).alias("__last"))
    before = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(key, "__bucket", F.last("__last", ignorenulls=True).over(before).alias("__carried"))
    joined = own.filter("__row IS NOT NULL").join(carried, [key, "__bucket"])
    return joined.select("__row.*", F.coalesce("__own", "__carried").alias("last_value"))


def greedy_disjoint(rows: DataFrame, group: str, name: str, sides: list[tuple[str, str]], overlap: float = 0.5) -> DataFrame:
    """Per group keep boxes (one (lo, hi) pair of columns per dimension) largest first, dropping one whose common part
    with a kept one is at least ``overlap`` of the smaller. The order of decisions matters, so each group (the boxes of a
    page or document) is decided in one Arrow task; a box meets only the kept ones near it. Ties by name; boxes without extent
    take part but overlap nothing.
    """
    columns = [group, name, *[c for side in sides for c in side]]
    schema = rows.select(*columns).schema

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        lo = np.array([pdf[a] for a, _ in sides], float)
        hi = np.array([pdf[b] for _, b in sides], float)
        area = np.prod(np.maximum(hi - lo, 0.0), axis=0)
        order = sorted(range(len(pdf)), key=lambda i: (-area[i], str(pdf[name].iloc[i])))
        grid, chosen = BoxGrid(lo, hi), []
        for i in order:
            near = grid.near(i) if area[i] > 0 else ()
            if len(near):
                common = np.prod(np.maximum(np.minimum(hi[:, near], hi[:, [i]]) - np.maximum(lo[:, near], lo[:, [i]]), 0.0), axis=0)
                if (common >= overlap * np.minimum(area[near], area[i])).any():
                    continue
            chosen.append(i)
            if area[i] > 0:
                grid.add(i)
        return pdf.iloc[chosen][columns]

    return rows.select(*columns).groupBy(group).applyInPandas(keep, schema)


class BoxGrid:
    """Boxes by size class: those of a class lie in cells at least as wide as their longest side, so each touches few cells."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray) -> None:
        self.lo, self.hi = lo, hi
        self.cells: dict[int, dict[tuple, list[int]]] = {}
        self.all: dict[int, list[int]] = {}

    def _touched(self, i: int, level: int, most: int) -> Iterator[tuple] | None:
        first, last = (np.floor(x[:, i] / 2.0**level).astype(int) for x in (self.lo, self.hi))
        if np.prod((last - first + 1).astype(float)) > most:
            return None
        return itertools.product(*(range(a, b + 1) for a, b in zip(first, last, strict=True)))

    def add(self, i: int) -> None:
        level = int(np.ceil(np.log2((self.hi[:, i] - self.lo[:, i]).max())))
        self.all.setdefault(level, []).append(i)
        for cell in self._touched(i, level, 2**62) or ():
            self.cells.setdefault(level, {}).setdefault(cell, []).append(i)

    def near(self, i: int) -> np.ndarray:
        """All boxes that may share room with box i; where it touches more cells than a class has boxes, the whole class."""
        found: set[int] = set()
        for level, members in self.all.items():
            cells = self._touched(i, level, len(members))
            found.update(members if cells is None else (j for c in cells for j in self.cells[level].get(c, ())))
        return np.fromiter(found, int, len(found))


def band_join(left: DataFrame, right: DataFrame, key: str, at: str, band: int, per_key: int | None = None) -> DataFrame:
    """All pairs of the same key with |left.at - right.at| <= band. Needs left_id and right_id.

    A hot key is spread over its buckets of width band + 1. per_key: if given, of the found pairs of a key the first so
    many by hash are kept, the same at every run (the reference samples 5000 a document); by default none is dropped.
    """
    width = band + 1
    here = F.floor(F.col(at) / width)
    spread = left.select(key, at, "left_id", F.explode(F.array(here - 1, here, here + 1)).alias("__bucket"))
    marks = right.select(key, F.col(at).alias("__at"), "right_id", F.floor(F.col(at) / width).alias("__bucket"))
    near = spread.join(marks, [key, "__bucket"]).filter(F.abs(F.col(at) - F.col("__at")) <= band)
    pairs = near.select(key, "left_id", "right_id", (F.col("__at") - F.col(at)).alias("gap"))
    if per_key is None:
        return pairs
    pick = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64("left_id", "right_id"), "left_id", "right_id", "gap"))
    return pairs.withColumn("__rn", pick).filter(F.col("__rn") <= per_key).drop("__rn")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, 0 for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """|a and b| / |a or b| of two arrays as sets, 0 for two empty ones."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def endpoint_gate(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges (doc, src, dst) of which both ends are members (doc, item) of the doc."""
    m = members.select("doc", "item").distinct()
    first = edges.join(m.withColumnRenamed("item", "src"), ["doc", "src"], "left_semi")
    return first.join(m.withColumnRenamed("item", "dst"), ["doc", "dst"], "left_semi").select("doc", "src", "dst")


def ordered_pairs(members: DataFrame, edges: DataFrame) -> DataFrame:
    """All (src, dst), src <> dst, of a doc's item set with a label telling whether the edge exists. Pairs come from blocks of chunks."""
    pairs = item_pairs(members)
    both = pairs.select("doc", F.inline(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))))
    marked = edges.select("doc", "src", "dst").distinct().withColumn("label", F.lit(1))
    return both.join(marked, ["doc", "src", "dst"], "left").fillna(0, ["label"])


def negative_partner(rows: DataFrame, doc: str, row_id: str, buckets: int) -> DataFrame:
    """A partner row of a different document for each row, the same at every run: the next one by hash inside a
    bucket of rows that is of another document, wrapping round the bucket. A row of a bucket with one document only gets
    a row of the next bucket that has another. Rows without a document count as one document; row_id is not null. Only
    where all rows are of one document has a row no partner, and is left out.
    """
    hashed = rows.select(doc, row_id, F.pmod(F.xxhash64(row_id), F.lit(buckets)).alias("__bucket"), F.xxhash64(row_id, F.lit(7)).alias("__h"))
    me = F.struct("__h", F.col(row_id).alias("id"), F.col(doc).alias("doc"))
    back = Window.partitionBy("__bucket").orderBy(F.desc("__h"), F.desc(row_id), F.desc(doc))  # backwards, so that what follows is a growing frame
    whole = Window.partitionBy("__bucket")
    before = F.lead(me).over(back)
    runs = hashed.withColumn("__start", F.when(before.isNotNull() & ~before["doc"].eqNullSafe(F.col(doc)), me))
    ahead = runs.withColumn("__next", F.last("__start", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)))
    ahead = ahead.withColumn("__first", F.min(me).over(whole)).withColumn("__second", F.min("__start").over(whole))
    round_ = F.when(~F.col("__first.doc").eqNullSafe(F.col(doc)), F.col("__first")).otherwise(F.col("__second"))
    own = ahead.select(doc, row_id, "__bucket", F.coalesce("__next", round_).alias("__partner"))
    # One row per bucket: its first row, and its first row of another document.
    ends = runs.groupBy("__bucket").agg(F.min(me).alias("__first"), F.min("__start").alias("__second"))
    lone = ends.filter("__second IS NULL").select(F.col("__bucket").alias("__lone"), F.col("__first.doc").alias("__doc"))
    other = F.when(~F.col("__first.doc").eqNullSafe(F.col("__doc")), F.col("__first")).otherwise(F.col("__second"))
    far = lone.join(F.broadcast(ends)).select("__lone", F.pmod(F.col("__bucket") - F.col("__lone"), F.lit(buckets)).alias("__far"), other.alias("__other")).filter("__other IS NOT NULL")
    far = far.groupBy(F.col("__lone").alias("__bucket")).agg(F.min_by("__other", "__far").alias("__other"))
    partner = F.coalesce("__partner", "__other")
    found = own.join(F.broadcast(far), "__bucket", "left").withColumn("__partner", partner).filter("__partner IS NOT NULL")
    return found.select(doc, row_id, F.col("__partner.id").alias("partner"), F.col("__partner.doc").alias("partner_doc"))


#: Names that one automaton holds (some tens of megabytes); more are looked for in further passes.
NAME_BLOCK = 100_000


def mentions(texts: DataFrame, names: DataFrame, block: int = NAME_BLOCK) -> DataFrame:
    """A row (name) for each text and each name that it contains, whole words or not; one pass over a text for all names.

    texts: (text), names: (name); null and empty names are in no text. The automaton (Aho-Corasick) is built once per task.
    """
    wanted = names.select("name").filter("name <> ''").distinct()
    blocks = max(1, -(-wanted.count() // block))
    out = None
    for b in range(blocks):
        mine = wanted if blocks == 1 else wanted.filter(F.pmod(F.xxhash64("name"), F.lit(blocks)) == b)
        found = texts.select("text").filter("text IS NOT NULL").mapInPandas(_finder(sorted(r.name for r in mine.collect())), "name string")
        out = found if out is None else out.unionByName(found)
    return out


def _finder(words: list[str]):  # noqa: ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for w in words:
                automaton.add_word(w, w)
            if words:
                automaton.make_automaton()
            within = lambda text: {w for _, w in automaton.iter(text)} if words else ()
        except ImportError:  # each name by itself; the same result
            within = lambda text: [w for w in words if w in text]
        for pdf in batches:
            yield pd.DataFrame({"name": [w for text in pdf["text"] for w in within(text)]}, dtype=object)

    return run


def nearest_number(rows: DataFrame, targets: list[float], value: str, name: str, preferred: Column, window: float) -> DataFrame:
    """For each target the row with the nearest value; inside the window a preferred row beats nearer others.

    One pass with two conditional aggregates per target (a short list of numbers); ties by name.
    """
    gap = lambda t: F.abs(F.col(value) - F.lit(t))
    picks = []
    for t in targets:
        favoured = F.min(F.when(preferred & (gap(t) <= window), F.struct(gap(t).alias("gap"), F.col(name).alias("name"))))
        any_ = F.min(F.when(F.col(value).isNotNull(), F.struct(gap(t).alias("gap"), F.col(name).alias("name"))))
        picks.append(F.struct(F.lit(t).alias("target"), F.coalesce(favoured, any_).alias("pick"), favoured.isNotNull().alias("preferred")))
    return rows.agg(F.array(*picks).alias("a")).select(F.inline("a")).select("target", "pick.name", "pick.gap", "preferred")
