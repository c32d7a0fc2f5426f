"""Corpus statistics over stage sequences and item sets.

Every operator is a DataFrame -> DataFrame function over generic columns: doc, stage, pos for sequences; doc, item
for memberships. Partial aggregation runs before each shuffle; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oreloom.session import cut

#: Items of a doc per chunk when pairs of them are formed.
PAIR_CHUNK = 64


def in_parts(seq: DataFrame) -> DataFrame:
    """The rows cut into ranges of (doc, pos), ``__part`` telling them apart: a hot doc is spread over as many as its share.

    Checkpointed, since the borders of a range order are drawn anew at every run and two readers must see the same.
    """
    return cut(seq.repartitionByRange("doc", "pos")).withColumn("__part", F.spark_partition_id())


def _with_carried(inside: DataFrame, ends: DataFrame, carried: Column) -> DataFrame:
    """inside with ``__carried``, what the other parts of its doc hand over: one row per part that a doc reaches, few with anything."""
    over = ends.select(F.col("__part").alias("__p"), F.col("doc").alias("__d"), carried.alias("__carried")).filter("__carried IS NOT NULL")
    return inside.join(over, (F.col("__part") == F.col("__p")) & F.col("doc").eqNullSafe(F.col("__d")), "left").drop("__p", "__d")


def beside(parts: DataFrame, value: str, name: str, ahead: bool) -> DataFrame:
    """Adds the value of the next (ahead) or previous row of the doc; null at its end."""
    kept = F.struct(value)  # tells a null value from no row
    move = F.lead if ahead else F.lag
    inside = parts.withColumn("__own", move(kept).over(Window.partitionBy("__part", "doc").orderBy("pos")))
    edge = (F.min_by if ahead else F.max_by)(kept, "pos")
    ends = parts.groupBy("__part", "doc").agg(edge.alias("edge"))
    found = _with_carried(inside, ends, move("edge").over(Window.partitionBy("doc").orderBy("__part")))
    return found.withColumn(name, F.coalesce("__own", "__carried")[value]).drop("__own", "__carried")


def ranked(parts: DataFrame, name: str) -> DataFrame:
    """Adds the number of the row in its doc, from 1."""
    inside = parts.withColumn("__own", F.row_number().over(Window.partitionBy("__part", "doc").orderBy("pos")))
    ends = parts.groupBy("__part", "doc").agg(F.count("*").alias("n"))
    found = _with_carried(inside, ends, F.sum("n").over(Window.partitionBy("doc").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)))
    return found.withColumn(name, F.col("__own") + F.coalesce("__carried", F.lit(0))).drop("__own", "__carried")


def collapse_repeats(seq: DataFrame) -> DataFrame:
    """Drop null stages and those equal to the previous one within doc; positions are renumbered from 1."""
    parts = in_parts(seq.filter(F.col("stage").isNotNull()))
    kept = beside(parts, "stage", "__before", ahead=False).filter(~F.col("stage").eqNullSafe(F.col("__before"))).drop("__before")
    return ranked(kept, "__n").select("doc", "stage", F.col("__n").cast("int").alias("pos"))


def transitions(seq: DataFrame) -> DataFrame:
    """(doc, src, dst) of adjacent stages; the last stage of a doc has none."""
    return beside(in_parts(seq), "stage", "dst", ahead=True).select("doc", F.col("stage").alias("src"), "dst").filter("dst IS NOT NULL")


def transition_counts(edges: DataFrame, self_loops: bool = True) -> DataFrame:
    """A2 (without self-loops) and A3 (with them): n occurrences and n_docs of each (src, dst)."""
    kept = edges if self_loops else edges.filter("src <> dst")
    return kept.groupBy("src", "dst").agg(F.count("*").alias("n"), F.count_distinct("doc").alias("n_docs"))


def support(members: DataFrame, min_docs: int = 1) -> DataFrame:
    """A4: docs that contain each item, with HAVING n_docs >= min_docs."""
    return members.groupBy("item").agg(F.count_distinct("doc").alias("n_docs")).filter(F.col("n_docs") >= min_docs)


def item_pairs(members: DataFrame, chunk: int = PAIR_CHUNK) -> DataFrame:
    """(doc, a, b), a < b, of all pairs of a doc's distinct items, null items left out.

    A doc's items are spread over chunks by hash; every pair of chunks, a chunk with itself too, is a block of its own, so
    that no task forms more than about chunk x chunk pairs of a doc at a time, however many items it has.
    """
    items = members.select("doc", "item").filter("item IS NOT NULL").distinct()
    sizes = items.groupBy(F.col("doc").alias("__d")).agg(F.ceil(F.count("*") / F.lit(chunk)).alias("k"))
    spot = F.pmod(F.xxhash64("item"), F.col("k")).cast("int")
    sized = items.join(sizes, F.col("doc").eqNullSafe(F.col("__d"))).select("doc", "item", "k", spot.alias("i"))
    blocks = F.transform(F.sequence(F.lit(0), F.col("k").cast("int") - 1), lambda j: F.struct(F.least("i", j).alias("lo"), F.greatest("i", j).alias("hi")))
    spread = sized.select("doc", "item", "i", F.inline(blocks)).groupBy("doc", "lo", "hi")
    side = lambda end: F.array_sort(F.collect_list(F.when(F.col("i") == F.col(end), F.col("item"))))
    sides = spread.agg(side("lo").alias("l"), side("hi").alias("r"))
    pairs = sides.select("doc", "lo", "hi", "r", F.explode("l").alias("x")).select("doc", "lo", "hi", "x", F.explode("r").alias("y"))
    pairs = pairs.filter((F.col("lo") < F.col("hi")) | (F.col("x") < F.col("y")))
    return pairs.select("doc", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def joint_support(members: DataFrame) -> DataFrame:
    """A5: docs containing both items, the diagonal included; pairs are counted before either order of them is told."""
    counted = item_pairs(members).groupBy("a", "b").agg(F.count("*").alias("n_docs"))
    alone = support(members.filter("item IS NOT NULL")).select(F.col("item").alias("a"), F.col("item").alias("b"), "n_docs")
    return counted.unionByName(counted.select(F.col("b").alias("a"), F.col("a").alias("b"), "n_docs")).unionByName(alone)


def conditional_probability(joint: DataFrame) -> DataFrame:
    """P(b | a) = joint(a, b) / joint(a, a); items without support give none."""
    diagonal = joint.filter("a = b").select("a", F.col("n_docs").alias("n_a"))
    return joint.join(diagonal, "a").select("a", "b", (F.col("n_docs") / F.col("n_a")).alias("p"))


def mean_of_present(members: DataFrame, prob: DataFrame) -> DataFrame:
    """Score of candidate b for a doc: mean of P(b | a) over the doc's items a (absent cells count as 0)."""
    size = members.groupBy("doc").agg(F.count_distinct("item").alias("k"))
    hits = members.distinct().join(prob, members["item"] == prob["a"]).groupBy("doc", "b").agg(F.sum("p").alias("s"))
    return hits.join(size, "doc").select("doc", "b", (F.col("s") / F.col("k")).alias("score"))


def numeric_summary(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Count, mean, exact median, max; 0.0 where a group has no number."""
    v = F.col(value)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return values.groupBy(*keys).agg(
        F.count(v).alias("n"), zero(F.avg(v)).alias("mean"), zero(F.median(v)).alias("median"), zero(F.max(v)).alias("max")
    )


def summary_by_name(values: DataFrame, key: str, names: list[str]) -> DataFrame:
    """min/mean/max per named quantity as columns; 0.0 where missing."""
    wide = values.groupBy(key).pivot("name", names).agg(F.min("value").alias("min"), F.avg("value").alias("mean"), F.max("value").alias("max"))
    return wide.select(key, *[F.coalesce(F.col(f"{n}_{s}"), F.lit(0.0)).alias(f"{n}_{s}") for n in names for s in ("min", "mean", "max")])


def mean_of_means(values: DataFrame, outer: str, inner: str) -> DataFrame:
    """A10: mean per inner group, then the mean of those per outer group."""
    first = values.groupBy(outer, inner).agg(F.avg("value").alias("m"))
    return first.groupBy(outer).agg(F.avg("m").alias("mean_of_means"))


def first_by_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each composite key in a stated order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__rn", rank).filter("__rn = 1").drop("__rn")


def share_of_total(counts: DataFrame, doc: str, name: str, n: str, decimals: int = 1) -> DataFrame:
    """Rounded percentage of the doc's total, and whether the class is the doc's primary one (first name on ties)."""
    whole = Window.partitionBy(doc)
    best = Window.partitionBy(doc).orderBy(F.desc(n), name)
    return counts.select(
        doc, name, n, F.round(100.0 * F.col(n) / F.sum(n).over(whole), decimals).alias("pct"), (F.row_number().over(best) == 1).alias("primary")
    )


def membership_frequency(members: DataFrame, total: int) -> DataFrame:
    """Docs per item and their percentage of all docs."""
    return support(members).withColumn("pct", 100.0 * F.col("n_docs") / F.lit(total))


def weighted_vote(votes: DataFrame, query: str, label: str, weight: str) -> DataFrame:
    """Normalised weight of each label among a query's votes."""
    per = votes.groupBy(query, label).agg(F.sum(weight).alias("w"))
    return per.withColumn("score", F.col("w") / F.sum("w").over(Window.partitionBy(query))).drop("w")


def weighted_average(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """sum(v * w) / sum(w); null where the weights are zero."""
    return rows.groupBy(*keys).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("weighted"))


def max_where(rows: DataFrame, keys: list[str], value: str, floor: float) -> DataFrame:
    """Maximum of the values that reach the floor."""
    return rows.filter(F.col(value) >= floor).groupBy(*keys).agg(F.max(value).alias("best"))


def degrees(edges: DataFrame) -> DataFrame:
    """In- and out-degree of each node of a doc over distinct edges, and whether it is terminal."""
    both = edges.distinct().select(
        "doc", F.inline(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                                F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
    )
    return both.groupBy("doc", "node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out")).withColumn("terminal", F.col("n_out") == 0)


def normalised_order(seq: DataFrame) -> DataFrame:
    """Position scaled to [0, 1] within doc; a single stage has 0. The ends come from an aggregate, not from a hot doc's window."""
    ends = seq.groupBy(F.col("doc").alias("__d")).agg(F.min("pos").alias("__lo"), F.max("pos").alias("__hi"))
    joined = seq.join(ends, F.col("doc").eqNullSafe(F.col("__d")))
    scaled = F.try_divide((F.col("pos") - F.col("__lo")).cast("double"), (F.col("__hi") - F.col("__lo")).cast("double"))
    return joined.withColumn("order", F.coalesce(scaled, F.lit(0.0))).drop("__d", "__lo", "__hi")


def vocabulary(seq: DataFrame) -> DataFrame:
    """Ids of stages in order of first appearance (doc, then position)."""
    first = seq.groupBy("stage").agg(F.min(F.struct("doc", "pos")).alias("at"))
    return first.select("stage", (F.row_number().over(Window.orderBy("at", "stage")) - 1).alias("vocab_id"))


def stage_statistics(seq: DataFrame, edges: DataFrame) -> DataFrame:
    """Per stage the docs, mean scaled order, mean degrees, distinct neighbours and share of starts and ends."""
    ordered = normalised_order(seq)
    per = ordered.groupBy("stage").agg(
        F.count_distinct("doc").alias("n_docs"),
        F.avg("order").alias("mean_order"),
        F.avg((F.col("order") == 0).cast("double")).alias("start_share"),
        F.avg((F.col("order") == 1).cast("double")).alias("end_share"),
    )
    deg = degrees(edges).groupBy(F.col("node").alias("stage")).agg(F.avg("n_in").alias("mean_in"), F.avg("n_out").alias("mean_out"))
    parents = edges.groupBy(F.col("dst").alias("stage")).agg(F.count_distinct("src").alias("n_parents"))
    children = edges.groupBy(F.col("src").alias("stage")).agg(F.count_distinct("dst").alias("n_children"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return per.join(deg, "stage", "left").join(parents, "stage", "left").join(children, "stage", "left").select(
        "stage", "n_docs", "mean_order", "start_share", "end_share", zero("mean_in"), zero("mean_out"), zero("n_parents"), zero("n_children")
    )


def association_rules(conditions: DataFrame, members: DataFrame, min_support: int = 5, min_confidence: float = 0.6) -> DataFrame:
    """Condition -> item rules; support counts docs with the condition, confidence those of them with the item."""
    cond = conditions.distinct()
    base = cond.groupBy("condition").agg(F.count("*").alias("support")).filter(F.col("support") >= min_support)
    both = cond.join(members.distinct(), "doc").groupBy("condition", "item").agg(F.count("*").alias("n_both"))
    rules = both.join(base, "condition").withColumn("confidence", F.col("n_both") / F.col("support"))
    return rules.filter(F.col("confidence") >= min_confidence)


def edge_prior(counts: DataFrame, joint: DataFrame) -> DataFrame:
    """min(1, transition count / joint support); the clamp matters as counts may exceed the support."""
    near = joint.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("n_docs").alias("joint"))
    return counts.join(near, ["src", "dst"]).select("src", "dst", F.least(F.lit(1.0), F.col("n") / F.col("joint")).alias("prior"))


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The k first rows of each group; Spark prunes before the shuffle (window group limit)."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)


def top_or_fallback(rows: DataFrame, group: str, score: str, name: str, floor: float, k: int) -> DataFrame:
    """All rows at or above the floor; a group without any keeps its k best."""
    whole = Window.partitionBy(group)
    best = Window.partitionBy(group).orderBy(F.desc(score), name)
    marked = rows.withColumn("__any", F.max((F.col(score) >= floor).cast("int")).over(whole)).withColumn("__rn", F.row_number().over(best))
    keep = F.when(F.col("__any") == 1, F.col(score) >= floor).otherwise(F.col("__rn") <= k)
    return marked.filter(keep).drop("__any", "__rn")


def min_max_scale(rows: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """(x - min) / (max - min), a zero range divides by 1, nulls and NaN give 0."""
    if keys:
        bounds = rows.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
        joined = rows.join(bounds, keys)
    else:
        lo, hi = rows.agg(F.min(value), F.max(value)).first()
        joined = rows.withColumn("__lo", F.lit(lo)).withColumn("__hi", F.lit(hi))
    span = F.col("__hi") - F.col("__lo")
    scaled = (F.col(value) - F.col("__lo")) / F.when(span == 0, F.lit(1.0)).otherwise(span)
    return joined.withColumn("scaled", F.coalesce(F.nanvl(scaled.cast("double"), F.lit(0.0)), F.lit(0.0))).drop("__lo", "__hi")


def upper_median(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Count, min, max and the element n/2 of the sorted values (not the mean of the middle two)."""
    by = Window.partitionBy(key).orderBy(value)
    numbered = rows.filter(F.col(value).isNotNull()).withColumn("__i", F.row_number().over(by) - 1).withColumn("__n", F.count("*").over(Window.partitionBy(key)))
    return numbered.groupBy(key).agg(
        F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"),
        F.max(F.when(F.col("__i") == F.floor(F.col("__n") / 2), F.col(value))).alias("upper_median"),
    )


def coverage(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Share of rows where each column is neither null nor zero, one row per column."""
    shares = rows.agg(*[F.avg((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) != 0).cast("double")).alias(c) for c in columns])
    return shares.unpivot([], columns, "column", "share")


def influence_matrix(importance: DataFrame) -> DataFrame:
    """Summed importance per (section, stage), each stage scaled by its largest section."""
    sums = importance.groupBy("section", "stage").agg(F.sum("importance").alias("s"))
    top = F.max("s").over(Window.partitionBy("stage"))
    return sums.select("section", "stage", F.coalesce(F.try_divide(F.col("s"), top), F.lit(0.0)).alias("influence"))
