"""Model fitting and scoring on Spark aggregates and spark.ml."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oreloom.operators.evaluate import tuned_threshold
from oreloom.operators.neighbors import nearest_others
from oreloom.session import cut


def hash_split(key: Column, shares: list[tuple[str, float]]) -> Column:
    """A split by the first 8 hex digits of the key's MD5: the same at every run, engine and cluster."""
    spot = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("double") / float(2**32)
    out = F.lit(shares[-1][0])
    for i in range(len(shares) - 2, -1, -1):
        out = F.when(spot < sum(s for _, s in shares[: i + 1]), shares[i][0]).otherwise(out)
    return out


def fold(key: Column, k: int) -> Column:
    """Document-wise cross-validation fold."""
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") % k).cast("int")


def tf_idf(tokens: DataFrame, n_docs: int, n_features: int = 200) -> DataFrame:
    """L1: (doc, term, weight): the n_features terms in most documents (ties by term), idf = ln((1 + n) / (1 + df)) + 1, rows of
    Euclidean length 1. tokens: (doc, term) with repeats.
    """
    tf = tokens.groupBy("doc", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    kept = df.orderBy(F.desc("df"), "term").limit(n_features)  # the feature limit is the operator's
    weighted = tf.join(F.broadcast(kept), "term").withColumn("w", F.col("tf") * (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc")))
    return weighted.select("doc", "term", (F.col("w") / length).alias("weight"))


#: The stop words of Spark's English list, in its order; written out, since oracles are made before any session and where no jar of Spark lies.
ENGLISH_STOPS = tuple(
    (
        "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them "
        "their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a "
        "an the and but if or because as until while of at by for with about against between into through during before after above below to from up "
        "down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor "
        "not only own same so than too very s t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd "
        "i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't "
        "won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's what's when's where's who's "
        "why's would"
    ).split()
)


def stop_words(spark: SparkSession, language: str = "english") -> list[str]:
    """The stop words that Spark ships for a language."""
    from pyspark.ml.feature import StopWordsRemover

    return sorted(StopWordsRemover.loadDefaultStopWords(language))


def section_tf_idf(tokens: DataFrame, n_features: int, stops: list[str]) -> DataFrame:
    """L1: tf_idf of each section by itself: tokens (section, doc, term) -> (section, doc, term, weight), stop words left out.

    A document counts once per section; the n_features terms in most of a section's documents are kept, ties by term.
    """
    told = tokens.filter(~F.col("term").isin(*stops))
    sizes = tokens.groupBy("section").agg(F.count_distinct("doc").alias("n"))
    tf = told.groupBy("section", "doc", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("section", "term").agg(F.count("*").alias("df"))
    best = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("df"), "term"))
    kept = df.withColumn("__rn", best).filter(F.col("__rn") <= n_features).drop("__rn").join(sizes, "section")
    weighted = tf.join(kept, ["section", "term"]).withColumn("w", F.col("tf") * (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1))
    length = weighted.groupBy("section", "doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("__l"))
    return weighted.join(length, ["section", "doc"]).select("section", "doc", "term", (F.col("w") / F.col("__l")).alias("weight"))


@dataclass(frozen=True)
class Components:
    """Right singular vectors (features x k), signs fixed by the largest part, and singular values of one section."""

    features: list[str]
    vectors: np.ndarray
    values: np.ndarray

    def top_terms(self) -> list[str]:
        return [self.features[int(i)] for i in np.abs(self.vectors).argmax(0)]


def section_svd(rows: DataFrame, k: int) -> dict[str, Components]:
    """L2: k components of each section of (section, doc, term, weight) rows.

    Executors add up the Gram matrices, features x features of a few hundred terms a section; only they reach the driver.
    """
    named: dict[str, list[str]] = {}
    for r in rows.select("section", "term").distinct().collect():  # the features asked for, a few hundred a section
        named.setdefault(r.section, []).append(r.term)
    features = {s: sorted(ts) for s, ts in named.items()}
    spot = {s: {t: i for i, t in enumerate(ts)} for s, ts in features.items()}

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {s: np.zeros((len(ts), len(ts))) for s, ts in features.items()}
        for pdf in batches:
            for s, terms, weights in zip(pdf["section"], pdf["terms"], pdf["weights"], strict=True):
                at, w = np.array([spot[s][t] for t in terms]), np.asarray(weights, float)
                total[s][np.ix_(at, at)] += np.outer(w, w)
        for s, m in total.items():
            i, j = np.nonzero(m)
            yield pd.DataFrame({"section": s, "i": i.astype("int32"), "j": j.astype("int32"), "v": m[i, j]})

    packed = rows.groupBy("section", "doc").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"))
    cells = packed.mapInPandas(gram, "section string, i int, j int, v double").groupBy("section", "i", "j").agg(F.sum("v").alias("v"))
    matrices = {s: np.zeros((len(ts), len(ts))) for s, ts in features.items()}
    for r in cells.collect():
        matrices[r.section][r.i, r.j] = r.v
    return {s: Components(features[s], *_components(m, k)) for s, m in matrices.items()}


def _components(gram: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(values)[::-1][:k]
    vectors = vectors[:, order]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return vectors, np.sqrt(np.maximum(values[order], 0))


def polynomial_fit(rows: DataFrame, x: str, ys: list[str], degree: int = 2) -> dict[str, np.ndarray]:
    """L3: least-squares coefficients (constant first) per target from power sums: one pass, (2 degree + 1) numbers each."""
    powers = [F.sum(F.pow(F.col(x), F.lit(float(i)))).alias(f"p{i}") for i in range(2 * degree + 1)]
    moments = [F.sum(F.pow(F.col(x), F.lit(float(i))) * F.col(y)).alias(f"{y}__{i}") for y in ys for i in range(degree + 1)]
    s = rows.dropna(subset=[x, *ys]).agg(*powers, *moments).first()
    a = np.array([[s[f"p{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)])
    return {y: np.linalg.lstsq(a, np.array([s[f"{y}__{i}"] for i in range(degree + 1)]), rcond=None)[0] for y in ys}


def predict_polynomial(x: Column, coefficients: np.ndarray) -> Column:
    """L3: Horner form of a fitted polynomial."""
    out = F.lit(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        out = out * x + F.lit(float(c))
    return out


def postprocess_counts(rows: DataFrame, label: str, raw: str, mandatory: list[str]) -> DataFrame:
    """L3: predicted counts rounded half to even and clipped at 0; mandatory labels occur at least once."""
    count = F.greatest(F.bround(raw, 0), F.lit(0.0)).cast("int")
    return rows.withColumn("count", F.when(F.col(label).isin(*mandatory), F.greatest(count, F.lit(1))).otherwise(count))


def boosted_trees(rows: DataFrame, features: list[str], label: str, depth: int = 4, trees: int = 20, seed: int = 42):  # noqa: ANN201
    """Boosted trees for a 0/1 label, positives weighted by the ratio of classes (spark.ml)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    counts = rows.agg(F.sum(F.col(label)).alias("pos"), F.count("*").alias("n")).first()
    ratio = (counts["n"] - counts["pos"]) / max(1, counts["pos"])
    weighted = rows.withColumn("__w", F.when(F.col(label) == 1, F.lit(float(ratio))).otherwise(1.0))
    assemble = VectorAssembler(inputCols=features, outputCol="__features", handleInvalid="keep")
    fit = GBTClassifier(featuresCol="__features", labelCol=label, weightCol="__w", maxDepth=depth, maxIter=trees, seed=seed, predictionCol="__y")
    fit = fit.setProbabilityCol("__p").setRawPredictionCol("__raw")
    return Pipeline(stages=[assemble, fit]).fit(weighted)


def score_trees(model, rows: DataFrame, name: str = "prob") -> DataFrame:  # noqa: ANN001
    """Probability of the positive class as a column."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(rows).withColumn(name, vector_to_array("__p")[1]).drop("__features", "__raw", "__p", "__y", "__w")


def oversampled(rows: DataFrame, features: list[str], label: str, key: str, neighbours: int = 3, seed: int = 7) -> DataFrame:
    """The rows and made-up positives between a positive and one of its nearest, until the classes are about even.

    Neighbours come from the exact search over the distinct vectors of the positives; the mixing share and the number of copies
    follow from hashes, so that every run makes the same rows. With fewer than two positives nothing is made. The rows made are
    kept, since a fit reads them many times.
    """
    n, pos = rows.agg(F.count("*"), F.sum(F.col(label).cast("bigint"))).first()
    copies = min(10, (n - (pos or 0)) // pos - 1) if pos and pos > 1 else 0
    kept = rows.select(*features, label)
    if copies <= 0:
        return kept
    vec = F.array(*[F.col(c).cast("double") for c in features])
    points = cut(rows.filter(F.col(label) == 1).select(F.xxhash64(key).alias("id"), vec.alias("vec")).dropDuplicates(["id"]))
    made = nearest_others(points, neighbours)
    made = made.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(int(copies) - 1)))).filter(F.col("copy") % neighbours == F.col("rank") - 1)
    share = F.pmod(F.xxhash64("id", "copy", F.lit(seed)), F.lit(1000)) / 1000.0
    mixed = F.zip_with("vec", "other", lambda a, b: a + (b - a) * share)
    return kept.unionByName(cut(made.select(*[mixed[i].alias(c) for i, c in enumerate(features)], F.lit(1).alias(label))))


@dataclass(frozen=True)
class Link:
    """One label of a chain: its model, features, threshold and the F1 of its out-of-fold scores."""

    label: str
    model: object
    features: list[str]
    threshold: float
    f1: float


def fold_sets(rows: DataFrame, features: list[str], label: str, key: str, folds: int) -> list[DataFrame]:
    """For each fold the oversampled rows of the others; the same for every setting of a grid."""
    marked = rows.withColumn("__fold", fold(F.col(key), folds))
    return [oversampled(marked.filter(F.col("__fold") != k), features, label, key) for k in range(folds)]


def out_of_fold(rows: DataFrame, sets: list[DataFrame], features: list[str], label: str, key: str, **how: int) -> DataFrame:
    """(key, label, prob): every row scored by a model of the other folds; sets: those of fold_sets."""
    marked, out = rows.withColumn("__fold", fold(F.col(key), len(sets))), None
    for k, others in enumerate(sets):
        model = boosted_trees(others, features, label, **how)
        part = score_trees(model, marked.filter(F.col("__fold") == k)).select(key, label, "prob")
        out = part if out is None else out.unionByName(part)
    return cut(out)


def tuned_chain(rows: DataFrame, features: list[str], labels: list[str], key: str, grid: list[dict[str, int]], folds: int = 3) -> list[Link]:
    """Labels by descending frequency (ties by name), each seeing the out-of-fold scores of those before it.

    For each label the settings of the grid are compared by the F1 of their out-of-fold scores at the tuned threshold; the
    best fits the whole. No row is ever scored by a model that saw it, so thresholds and features carry no leak.
    """
    totals = rows.agg(*[F.sum(x).alias(x) for x in labels]).first()
    order = sorted((x for x in labels if (totals[x] or 0) >= 2), key=lambda x: (-totals[x], x))
    chain, seen = [], list(features)
    for x in order:
        best, sets = None, fold_sets(rows, seen, x, key, folds)
        for how in grid:
            scored = out_of_fold(rows, sets, seen, x, key, **how)
            row = tuned_threshold(scored.withColumn("__label", F.lit(x)), "__label", "prob", x).first()
            if best is None or row["f_beta"] > best[0]:
                best = (row["f_beta"], row["threshold"], scored, how)
        f1, threshold, scored, how = best
        model = boosted_trees(oversampled(rows, seen, x, key), seen, x, **how)
        chain.append(Link(x, model, list(seen), float(threshold), float(f1)))
        name = f"chain_{x}"
        rows = cut(rows.join(scored.select(key, F.col("prob").alias(name)), key))
        seen.append(name)
    return chain


def score_tuned_chain(chain: list[Link], rows: DataFrame) -> DataFrame:
    """Predictions in chain order, each label's score fed to the next; columns <label> and chain_<label>."""
    for link in chain:
        rows = score_trees(link.model, rows, f"chain_{link.label}")
        rows = rows.withColumn(link.label, (F.col(f"chain_{link.label}") >= link.threshold).cast("int"))
    return rows


def pseudo_labels(scored: DataFrame, prob: str, high: float = 0.85, low: float = 0.15) -> DataFrame:
    """Confident predictions as labels; the others are left for the next round."""
    return scored.withColumn("label", F.when(F.col(prob) > high, 1).when(F.col(prob) < low, 0)).filter("label IS NOT NULL")


def pseudo_label_rounds(known: DataFrame, unknown: DataFrame, features: list[str], key: str, rounds: int = 2, **how: int) -> DataFrame:
    """(key, features, label, round) of the rows that some round was confident about; each round learns from those before."""
    found = None
    for n in range(1, rounds + 1):
        told = known if found is None else known.unionByName(found.select(*known.columns))
        left = unknown if found is None else unknown.join(found.select(key), key, "left_anti")
        model = boosted_trees(told, features, "label", **how)
        new = cut(pseudo_labels(score_trees(model, left), "prob").select(key, *features, "label", F.lit(n).alias("round")))
        found = new if found is None else found.unionByName(new)
    return found


def ablation(model, rows: DataFrame, groups: dict[str, list[str]], label: str, threshold: float = 0.5) -> list[tuple[str, float]]:  # noqa: ANN001
    """Loss of F1 on ``rows`` when the features of a group are set to 0, largest first, ties by name. One pass scores all groups."""
    base = rows.withColumn("__id", F.monotonically_increasing_id())
    variants = F.explode(F.array(*[F.lit(g) for g in ["", *groups]]))
    spread = base.withColumn("__out", variants)
    for g, names in groups.items():
        spread = spread.withColumns({c: F.when(F.col("__out") == g, F.lit(0.0)).otherwise(F.col(c)) for c in names})
    hit = F.col("prob") >= threshold
    counts = score_trees(model, spread).groupBy("__out").agg(
        F.count_if(hit & (F.col(label) == 1)).alias("tp"), F.count_if(hit & (F.col(label) == 0)).alias("fp"), F.count_if(~hit & (F.col(label) == 1)).alias("fn")
    )
    f1 = {r["__out"]: 2 * r["tp"] / max(1, 2 * r["tp"] + r["fp"] + r["fn"]) for r in counts.collect()}
    return sorted(((g, f1.get("", 0.0) - f1.get(g, 0.0)) for g in groups), key=lambda x: (-x[1], x[0]))


def score_pairs(pairs: DataFrame, left: str, right: str, scorer: Callable[[list[str], list[str]], Sequence[float]] | None = None, name: str = "relevance") -> DataFrame:
    """The hook for a relevance model: a column of scores from two text columns, batch by batch through Arrow.

    scorer: (left texts, right texts) -> scores; it is built into each task once. The default is the share of common words.
    Null texts count as empty.
    """
    score = scorer or common_words

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series(np.asarray(score(a.fillna("").tolist(), b.fillna("").tolist()), float))

    return pairs.withColumn(name, run(F.col(left), F.col(right)))


def common_words(left: list[str], right: list[str]) -> list[float]:
    """Jaccard similarity of the sets of lower-case words between blanks; 0 for two empty texts."""
    out = []
    for a, b in zip(left, right, strict=True):
        x, y = set(a.lower().split()), set(b.lower().split())
        out.append(len(x & y) / len(x | y) if x | y else 0.0)
    return out


#: Features of a pair of stages: transitions either way, how often each and both occur, and the share of transitions.
PAIR_FEATURES = ["n_there", "n_back", "n_src", "n_dst", "n_both", "rate"]


def pair_features(pairs: DataFrame, edges: DataFrame, members: DataFrame, own: bool) -> DataFrame:
    """Pairs (doc, src, dst, label) with counts over the documents of ``edges`` and ``members``.

    own: the pairs' documents are among those; what a row itself adds is taken off, so that no row sees its own label.
    """
    from oreloom.operators.corpus import joint_support, support

    counts = edges.groupBy("src", "dst").agg(F.count_distinct("doc").alias("n"))
    singles = support(members)
    joint = joint_support(members).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("n_docs").alias("n_both"))
    back = counts.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("n").alias("n_back"))
    rows = pairs.join(counts.withColumnRenamed("n", "n_there"), ["src", "dst"], "left").join(back, ["src", "dst"], "left").join(joint, ["src", "dst"], "left")
    for end in ("src", "dst"):
        rows = rows.join(singles.select(F.col("item").alias(end), F.col("n_docs").alias(f"n_{end}")), end, "left")
    less = 1.0 if own else 0.0
    zero = lambda c: F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    mine = {"n_there": zero("n_there") - less * F.col("label"), "n_back": zero("n_back"), "n_src": zero("n_src") - less, "n_dst": zero("n_dst") - less, "n_both": zero("n_both") - less}
    rows = rows.withColumns(mine)
    return rows.withColumn("rate", F.coalesce(F.try_divide("n_there", "n_both"), F.lit(0.0)))


def lexical_relevance(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """Relevance of the given (left_id, right_id) pairs as cosine of their tf-idf rows; the place of a heavier scorer.

    weights: (doc, term, weight) of both sides. Both joins have a pair's id in their key, so a hot term meets only its pairs.
    Pairs without a common term have relevance 0.
    """
    asked = pairs.select("left_id", "right_id").distinct()
    mine = asked.join(weights.select(F.col("doc").alias("left_id"), "term", F.col("weight").alias("wa")), "left_id")
    both = mine.join(weights.select(F.col("doc").alias("right_id"), "term", F.col("weight").alias("wb")), ["right_id", "term"])
    scored = both.groupBy("left_id", "right_id").agg(F.sum(F.col("wa") * F.col("wb")).alias("relevance"))
    return asked.join(scored, ["left_id", "right_id"], "left").fillna(0.0, ["relevance"])


def with_mandatory(pred: DataFrame, mandatory: list[str], label: str, prob: str, threshold: float) -> DataFrame:
    """Labels that pass the threshold or are mandatory."""
    return pred.filter((F.col(prob) >= threshold) | F.col(label).isin(*mandatory))
