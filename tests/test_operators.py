"""Operators without a full SQL oracle: hand cases, brute force and invariants."""

import importlib.util
import itertools
import random
import threading

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark
import pytest
from pyspark.sql import functions as F

from oreloom.functions import plant, text
from oreloom.operators import chain, corpus, evaluate, graphs, joins, learn, neighbors, tables
from oreloom.plans import model_queries, registry
from oreloom.sources import results, sinks
from oreloom.streaming import ingest


def one(spark, value, kind, column):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("copper_flotation_unit", "flotation"), ("tailings_thickener_01", "thickener"), ("jaw_crusher_a", "crusher"), ("cu_au", "cu_au"), ("grasshopper", "grasshopper"),
        ("copper_roaster", "roaster"), ("counter_current_decantation", "thickener"), ("ball_mills", "mill"), (None, None),
    ],
)
def test_normalise_id(spark, raw, want):
    assert one(spark, raw, "string", text.normalise_id(F.col("v"))) == want


@pytest.mark.parametrize(
    ("fn", "value", "want"),
    [
        (text.parse_number, " 1,234.5% ", 1234.5), (text.parse_number, "abc", None), (text.parse_number, "1_000", None), (text.parse_number, "$1e3", 1000.0), (text.first_number, "about 12.5 and 3", 12.5), (text.first_number, "none", None),
        (text.size_kb, "7,234 KB", 7234), (text.size_kb, "1.5 MB", 1536), (text.size_kb, "x", None), (text.section_group, " 14 ", "resource_estimate"), (text.section_group, "14.1", None), (text.filing_year, "a_13_nov_2025_10.pdf", 2025),
        (text.filing_year, "a_13_xyz_2025.pdf", None), (text.effective_year, "Effective Date: 31 December 2021", 2021), (text.table_number, "Tabla 14-2: x", "14-2"), (text.table_number, "x", None),
        (text.unfence_json, 'Sure:\n```json\n{"a": 1}\n```', '{"a": 1}'), (text.unfence_json, "no", None), (text.clean_header, " edarG \n", "Grade"), (text.clean_header, "Grade  %", "Grade %"),
        (text.strip_contents_lines, "1.1 Intro ... 3\nReal prose here.\nTable 14-1 x\na .... 5", "Real prose here."),
    ],
)
def test_scalars(spark, fn, value, want):
    assert one(spark, value, "string", fn(F.col("v"))) == want


def test_study_votes(spark):
    vote = lambda *t: one(spark, list(t), "array<string>", text.study_type(F.col("v")))
    assert vote("Pre-Feasibility Study", "Mineral Resource Estimate") == "PFS"
    assert vote("Feasibility Study", "Preliminary Economic Assessment") == "FS"
    assert vote("Mineral Resource Update") == "MRE" and vote("Report") == "TR" and vote(None) == "TR"


def test_header_inference():
    rows = [["Name", "Copper", "", "note"], ["", "(percent)", "", ""], ["alpha\nbeta", "1.50\n2.25", "", ""], ["gamma", "3.75", None, ""]]
    headers, data = tables.infer_header(rows)
    assert headers == ["Name", "note Copper (percent)"] and data == [["alpha", "1.50"], ["beta", "2.25"], ["gamma", "3.75"]]
    assert tables.infer_header([]) == ([], []) and tables.infer_header([["only", "text"]])[1] == [["only", "text"]]
    assert tables.infer_header([["name", "name"], ["1.25", "2.25"]])[0] == ["name", "name_2"]


def test_newline_rows():
    assert tables.expand_newlines([["ZnSO\nCuSO", "1\n2"], ["4", ""]]) == [["ZnSO", "1"], ["CuSO4", "2"]]


def test_drop_empty_columns(spark):
    rows = [["a", "", None, "b"], ["c", " ", "", ""], ["d"]]
    assert one(spark, rows, "array<array<string>>", text.drop_empty_columns(F.col("v"))) == [["a", "b"], ["c", ""], ["d", ""]]


def test_canonical_stage(spark):
    column = tables.canonical_stage(F.col("v"), {"mill": "mill", "noise": None, "big_cell": "cell"}, ["copper"])
    got = {v: one(spark, v, "string", column) for v in ("copper_mill", "noise", "old_mill_x", "copper_big_cell", "q", None)}
    assert got == {"copper_mill": "mill", "noise": None, "old_mill_x": "mill", "copper_big_cell": "cell", "q": None, None: None}


# --- joins --------------------------------------------------------------------------------------------------------------


def test_nearest_and_asof_match_brute_force(spark):
    rnd = random.Random(1)
    left = [(rnd.choice("ab"), rnd.randint(0, 60), i) for i in range(80)]
    right = [(rnd.choice("ab"), rnd.randint(0, 60), f"s{rnd.randint(0, 5)}") for _ in range(25)]
    a = spark.createDataFrame(left, "k string, t int, near_id int")
    b = spark.createDataFrame(right, "k string, t int, s string")
    got = {r.near_id: r.near for r in joins.nearest_within(a, b, "k", "t", 3, "s").collect()}
    for k, t, i in left:
        c = [(abs(y - t), y, s) for x, y, s in right if x == k and abs(y - t) <= 3]
        assert got[i] == (min(c)[2] if c else None)
    got = {r.near_id: r.last_value for r in joins.asof_backward(a, b, "k", "t", "s", 7).collect()}
    for k, t, i in left:
        c = [(y, s) for x, y, s in right if x == k and y <= t]
        assert got[i] == (max(c)[1] if c else None)


def test_greedy_overlap(spark):
    df = spark.createDataFrame([("g", "a", 0, 10), ("g", "b", 2, 6), ("g", "c", 9, 14), ("g", "d", 20, 21), ("h", "a", 0, 1)], "g string, n string, lo int, hi int")
    assert {(r.g, r.n) for r in joins.greedy_disjoint(df, "g", "n", [("lo", "hi")]).collect()} == {("g", "a"), ("g", "c"), ("g", "d"), ("h", "a")}


def test_greedy_overlap_of_boxes(spark):
    boxes = [("p", "big", 0, 10, 0, 10), ("p", "inside", 2, 4, 2, 4), ("p", "corner", 9, 13, 9, 13), ("p", "line", 3, 3, 0, 9), ("p", "same", 0, 10, 0, 10)]
    df = spark.createDataFrame(boxes, "g string, n string, x0 int, x1 int, y0 int, y1 int")
    assert {r.n for r in joins.greedy_disjoint(df, "g", "n", [("x0", "x1"), ("y0", "y1")]).collect()} == {"big", "corner", "line"}


def test_band_join_is_capped_the_same_way(spark):
    left = spark.createDataFrame([("d", 5, "t1"), ("d", 50, "t2")], "k string, p int, left_id string")
    right = spark.createDataFrame([("d", 6, i) for i in range(20)] + [("d", 11, 99)], "k string, p int, right_id int")
    rows = joins.band_join(left, right, "k", "p", 5, 4).collect()
    assert len(rows) == 4 and {r.left_id for r in rows} == {"t1"} and all(r.gap == 1 for r in rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, joins.band_join(left, right, "k", "p", 5, 4).collect()))


def test_band_join_keeps_all_pairs_of_a_hot_key(spark):
    rnd = random.Random(5)
    left = [("hot", rnd.randint(1, 40), f"t{i}") for i in range(30)] + [("d", 5, "t"), ("none", 5, "t")]
    right = [("hot", rnd.randint(1, 40), i) for i in range(600)] + [("d", 10, 1000), ("d", 11, 1001)]
    got = joins.band_join(spark.createDataFrame(left, "k string, p int, left_id string"), spark.createDataFrame(right, "k string, p int, right_id int"), "k", "p", 5)
    want = [(k, x, y, q - p) for k, p, x in left for j, q, y in right if k == j and abs(p - q) <= 5]
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_knn_blocks_match_brute_force(spark, metric):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 6)).round(3)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, vec array<double>")
    got = {}
    for r in neighbors.knn(df.filter("id % 5 = 0"), df, 4, metric, block=20, same=True).collect():
        got.setdefault(r.id, {})[r["rank"]] = r.neighbor
    for q in range(0, 90, 5):
        if metric == "cosine":
            s = x @ x[q] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[q])
        else:
            s = -np.linalg.norm(x - x[q], axis=1)
        want = [i for i in np.lexsort((np.arange(90), -np.round(s, 9))) if i != q][:4]
        assert [got[q][k] for k in (1, 2, 3, 4)] == want


def test_knn_with_fewer_rows_than_k(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "id bigint, vec array<double>")
    assert neighbors.knn(df, df, 5, same=True).count() == 2


def test_negative_partner_is_of_another_document(spark):
    df = spark.createDataFrame([(f"d{i % 3}", i) for i in range(60)], "doc string, id int")
    rows = joins.negative_partner(df, "doc", "id", 4).collect()
    assert rows and all(r.doc != r.partner_doc for r in rows)


@pytest.mark.parametrize("buckets", [1, 4, 500])
def test_negative_partner_for_every_row(spark, buckets):
    docs = {i: "hot" if i % 10 < 7 else None if i % 10 == 7 else f"d{i % 23}" for i in range(200)}
    df = spark.createDataFrame([(d, i) for i, d in docs.items()], "doc string, id int")
    rows = joins.negative_partner(df, "doc", "id", buckets).collect()
    assert sorted(r.id for r in rows) == sorted(docs)
    assert all(r.doc == docs[r.id] and r.partner_doc == docs[r.partner] and r.doc != r.partner_doc for r in rows)
    assert joins.negative_partner(df.filter("doc = 'hot'"), "doc", "id", buckets).count() == 0


@pytest.mark.parametrize("positives", [12, 60])
def test_tuned_threshold_matches_brute_force(spark, positives):
    rnd = random.Random(positives)
    rows = [("x", rnd.randint(200, 999) / 1000 + 0.0005, 1) for _ in range(positives)] + [("x", rnd.randint(0, 700) / 1000 + 0.0005, 0) for _ in range(90)] + [("none", 0.7005, 0)]
    b2 = 2.25 if positives < 25 else 1.0

    def score(t):
        passed = [y for k, p, y in rows if k == "x" and p >= t / 100]
        return round((1 + b2) * sum(passed) / (b2 * positives + len(passed)), 12)

    best = max(range(15, 86, 5), key=lambda t: (score(t), -t))
    best = max(range(best - 5, best + 6), key=lambda t: (score(t), t == best, -t))
    got = {r.k: r for r in evaluate.tuned_threshold(spark.createDataFrame(rows, "k string, p double, y int"), "k", "p", "y").collect()}
    assert round(got["x"].threshold * 100) == best and got["x"].f_beta == pytest.approx(score(best))
    assert got["none"].threshold == 0.5 and got["none"].f_beta == 0


# --- evaluation and corpus -----------------------------------------------------------------------------------------------


def test_lcs_and_tau(spark):
    rnd = random.Random(2)
    left, right, want = [], [], {}
    for d in range(12):
        items = list("abcdefg")[: rnd.randint(1, 7)]
        other = rnd.sample(items, len(items))
        left += [(f"d{d}", x, i) for i, x in enumerate(items)]
        right += [(f"d{d}", x, i) for i, x in enumerate(other)]
        best = max(len(s) for k in range(len(items) + 1) for s in itertools.combinations(other, k) if list(s) == sorted(s))
        pairs = list(itertools.combinations(items, 2))
        tau = sum(1 if other.index(a) < other.index(b) else -1 for a, b in pairs) / len(pairs) if pairs else 0.0
        want[f"d{d}"] = (best / len(items), tau)
    a, b = (spark.createDataFrame(x, "doc string, item string, pos int") for x in (left, right))
    lcs = {r.doc: r.lcs for r in evaluate.lcs_ratio(a, b).collect()}
    tau = {r.doc: r.tau for r in evaluate.kendall_tau(a, b).collect()}
    for d, (x, y) in want.items():
        assert lcs[d] == pytest.approx(x) and tau[d] == pytest.approx(y)


def test_empty_sides_of_evaluation(spark):
    none = spark.createDataFrame([], "doc string, item string")
    assert evaluate.outcomes(none, none, ["doc", "item"]).count() == 0
    assert evaluate.per_document_f1(evaluate.outcomes(none, none, ["doc", "item"])).count() == 0


def test_edge_prior_is_clamped(spark):
    counts = spark.createDataFrame([("a", "b", 7)], "src string, dst string, n int")
    joint = spark.createDataFrame([("a", "b", 4)], "a string, b string, n_docs int")
    assert corpus.edge_prior(counts, joint).first().prior == 1.0


# --- graphs --------------------------------------------------------------------------------------------------------------


def edges_of(spark, pairs):
    return spark.createDataFrame([("d", a, b) for a, b in pairs], "doc string, src string, dst string")


def test_orders_differ_and_cycles_come_last(spark):
    df = edges_of(spark, [("a", "z"), ("b", "c"), ("z", "y"), ("c", "b2"), ("s", "s"), ("s", "t")])
    heap = [r.node for r in graphs.topological_order(df).orderBy("pos").collect()]
    fifo = [r.node for r in graphs.topological_order(df, False).orderBy("pos").collect()]
    assert heap == ["a", "b", "c", "b2", "z", "y", "s", "t"] and fifo == ["a", "b", "z", "c", "y", "b2", "s", "t"]


def test_reachability_back_edges_and_drawing(spark):
    df = edges_of(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("x", "x"), ("p", "q")])
    reach = {(r.src, r.dst) for r in graphs.reachability(df).collect()}
    assert ("a", "a") not in reach and ("a", "c") in reach and ("c", "b") in reach and ("p", "q") in reach
    back = {(r.src, r.dst): (r.is_back, r.src_depth) for r in graphs.back_edges_and_depth(df).collect()}
    assert back["c", "a"][0] and back["x", "x"][0] and not back["a", "b"][0] and back["p", "q"] == (False, 0)
    drawn = {(r.src, r.dst, r.derived) for r in graphs.drawn_edges(df).collect()}
    assert ("x", "x", False) not in drawn and ("a", "p", True) in drawn and ("a", "x", True) in drawn


def test_pathways_of_a_large_vocabulary(spark, monkeypatch):
    from oreloom.plans import graph_queries

    names = [f"n{i:02}" for i in range(75)]  # 5550 edges
    edges = spark.createDataFrame([("d", a, b) for a in names for b in names if a != b], "doc string, src string, dst string")
    monkeypatch.setattr(graph_queries, "_edges", lambda spark, sf: edges)
    assert {r["rank"]: r.path for r in graph_queries.h8_pathways(spark, "").collect()}[0] == names


def test_pathways():
    got = graphs.pathways(pd.DataFrame({"src": ["a", "b", "c", "a"], "dst": ["b", "c", "a", "d"], "n": [50, 40, 1, 2]}))
    assert got[0] == ["a", "b", "c"]


def test_votes_add_up(spark):
    near = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.1), (1, 4, 0.0)], "id bigint, neighbor bigint, distance double")
    labels = spark.createDataFrame([(2, "x"), (3, "y"), (4, "y")], "neighbor bigint, label string")
    assert graphs.vote_trace(near, labels).agg(F.sum("weight")).first()[0] == pytest.approx(1.0)


# --- models and plant --------------------------------------------------------------------------------------------------


def test_polynomial_recovers_coefficients(spark):
    df = spark.range(50).select((F.col("id") / 10).alias("x"), (2 + 3 * F.col("id") / 10 - 0.5 * (F.col("id") / 10) ** 2).alias("y"))
    assert learn.polynomial_fit(df, "x", ["y"], 2)["y"] == pytest.approx([2, 3, -0.5], abs=1e-6)


def test_counts_are_rounded_clipped_and_mandatory(spark):
    df = spark.createDataFrame([("mill", -0.4), ("tank", 2.6), ("jig", 0.2), ("crusher", -1.0)], "label string, raw double")
    got = {r.label: r["count"] for r in learn.postprocess_counts(df, "label", "raw", ["crusher", "mill"]).collect()}
    assert got == {"mill": 1, "tank": 3, "jig": 0, "crusher": 1}


def test_svd_matches_numpy(spark):
    rng = np.random.default_rng(0)
    m = {"a": rng.random((30, 5)), "b": rng.random((12, 4))}
    df = spark.createDataFrame([(s, f"d{i}", f"t{j}", float(x)) for s, v in m.items() for i, row in enumerate(v) for j, x in enumerate(row)], "section string, doc string, term string, weight double")
    for s, found in learn.section_svd(df, 3).items():
        assert found.values == pytest.approx(np.linalg.svd(m[s])[1][:3]) and np.abs(found.vectors.T @ found.vectors - np.eye(3)).max() < 1e-9
        assert len(found.top_terms()) == 3
    assert learn.section_svd(df.limit(0), 3) == {}


def test_section_weights_have_unit_rows_and_no_stop_words(spark):
    stops = learn.stop_words(spark)
    df = spark.createDataFrame([("s", "d1", t) for t in "the ore the mill ore".split()] + [("s", "d2", t) for t in "mill of water".split()] + [("t", "d1", "ore")], "section string, doc string, term string")
    rows = learn.section_tf_idf(df, 2, stops).collect()
    assert {(r.section, r.doc, r.term) for r in rows} == {("s", "d1", "mill"), ("s", "d1", "ore"), ("s", "d2", "mill"), ("t", "d1", "ore")}
    one = {r.term: r.weight for r in rows if r.section == "s" and r.doc == "d1"}
    idf = {"mill": np.log(3 / 3) + 1, "ore": np.log(3 / 2) + 1}
    raw = {"mill": idf["mill"], "ore": 2 * idf["ore"]}
    assert one == pytest.approx({t: w / np.hypot(*raw.values()) for t, w in raw.items()})


def test_section_oracle_names_the_stop_words_where_no_jar_of_spark_lies(spark, monkeypatch):
    monkeypatch.setattr(pyspark, "__file__", "/nowhere/pyspark/__init__.py")
    monkeypatch.setattr(registry, "QUERIES", {})
    monkeypatch.setattr(registry, "ORACLES", {})
    spec = importlib.util.spec_from_file_location("oreloom.plans.again", model_queries.__file__)
    spec.loader.exec_module(importlib.util.module_from_spec(spec))
    assert "NOT IN ('i', 'me', 'my'," in registry.ORACLES["l1_section_tf_idf"]
    assert sorted(learn.ENGLISH_STOPS) == learn.stop_words(spark)  # the query and its oracle leave out what Spark ships


def _two_classes(spark, n, positive):
    rng = np.random.default_rng(4)
    rows = [(f"k{i}", float(rng.normal(3.0 if i < positive else 0.0)), float(rng.normal()), int(i < positive), int(i < positive and i % 4 > 0)) for i in range(n)]
    return spark.createDataFrame(rows, "key string, a double, b double, y int, z int")


def test_made_up_positives_lie_between_positives(spark):
    df = _two_classes(spark, 120, 20)
    out = learn.oversampled(df, ["a", "b"], "y", "key").collect()
    real = {(r.a, r.b) for r in df.collect()}
    made = [r for r in out if (r.a, r.b) not in real]
    assert len(out) - len(made) == 120 and len(made) == 80 and all(r.y == 1 for r in made)
    pos = np.array([(r.a, r.b) for r in df.collect() if r.y])
    assert all((pos.min(0) <= (r.a, r.b)).all() and ((r.a, r.b) <= pos.max(0)).all() for r in made)
    assert learn.oversampled(df.filter("y = 0"), ["a", "b"], "y", "key").count() == 100


def test_repeated_vectors_are_searched_once(spark, monkeypatch):
    rnd = random.Random(2)
    rows = [(i * 7919 % 1009, [float(rnd.randint(0, 3)), float(rnd.randint(0, 2)) / 3]) for i in range(300)]
    searched, knn = [], neighbors.knn
    monkeypatch.setattr(neighbors, "knn", lambda queries, base, *a, **k: searched.append((queries.count(), base.count())) or knn(queries, base, *a, **k))
    got = {}
    for r in neighbors.nearest_others(spark.createDataFrame(rows, "id bigint, vec array<double>"), 3).collect():
        got.setdefault(r.id, []).append((r["rank"], r.neighbor, r.other))
    assert searched == [(12, 12)]
    for i, v in rows:
        want = sorted((round(float(np.hypot(v[0] - w[0], v[1] - w[1])), 9), j, w) for j, w in rows if j != i)[:3]
        assert sorted(got[i]) == [(n, j, w) for n, (_, j, w) in enumerate(want, 1)]
    few = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, None)], "id bigint, vec array<double>")
    assert sorted((r.id, r.neighbor) for r in neighbors.nearest_others(few, 3).collect()) == [(1, 2), (2, 1)]


def test_oversampled_rows_are_made_once_per_fold_whatever_the_grid(spark, monkeypatch):
    made, oversampled = [], learn.oversampled
    monkeypatch.setattr(learn, "oversampled", lambda *a, **k: made.append(1) or oversampled(*a, **k))
    learn.tuned_chain(_two_classes(spark, 120, 30), ["a", "b"], ["y"], "key", [{"depth": 1, "trees": 1}, {"depth": 2, "trees": 1}], folds=2)
    assert len(made) == 3


def test_tuned_chain_beats_chance_on_rows_it_never_saw(spark):
    df = _two_classes(spark, 300, 90).withColumn("split", learn.hash_split(F.col("key"), [("train", 0.6), ("rest", 0.4)]))
    chain = learn.tuned_chain(df.filter("split = 'train'"), ["a", "b"], ["z", "y"], "key", [{"depth": 2, "trees": 3}], folds=2)
    assert [x.label for x in chain] == ["y", "z"] and chain[1].features == ["a", "b", "chain_y"] and all(0.1 <= x.threshold <= 0.9 for x in chain)
    rest = df.filter("split = 'rest'")
    got = learn.score_tuned_chain(chain, rest.drop("y", "z")).select("key", F.col("y").alias("p")).join(rest, "key").collect()
    assert sum(r.p == r.y for r in got) / len(got) > 0.85


def test_the_chain_learns_every_name(spark, tmp_path):
    from oreloom.plans.model_queries import l5_classifier_chain

    names = [f"mill_{i}" for i in range(7)]
    held = {f"d{i:03d}": [x for k, x in enumerate(names) if i % (k + 2) == 0] + (["kiln"] if i == 3 else []) for i in range(240)}
    rows = [(d, "2026-01-01", xs, [x.upper() for x in xs], "gold", "test", 0.5) for d, xs in held.items()]
    rows += [("nothing", "2026-01-01", None, None, None, None, None), ("nulls", "2026-01-01", [None], [None], None, None, float("nan"))]
    schema = "doc_id string, produced_at string, ground_truth array<string>, xgb_stages array<string>, commodity string, split string, doc_f1 double"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/test_predictions.parquet")
    out = l5_classifier_chain(spark, str(tmp_path))
    assert out.columns == ["doc", *[f"y{i}" for i in range(8)]]  # all seven names that can be learnt, and the one that cannot
    got = {r.doc: [r[f"y{i}"] for i in range(8)] for r in out.collect()}
    split = learn.hash_split(F.col("doc"), [("train", 0.6), ("rest", 0.4)])
    assert set(got) == {r.doc for r in spark.createDataFrame([(r[0],) for r in rows], "doc string").filter(split == "rest").collect()}
    assert all(got[d] == [int(x in held.get(d, [])) for x in names] + [0] for d in got)


def _team(n, work):
    """Results of work(team) in n threads that are a team."""
    told, barrier, out = [""] * n, threading.Barrier(n), [None] * n

    def tell(rank, said):
        told[rank] = said
        barrier.wait()
        return told

    def run(rank):
        team = chain.Team(rank, ["127.0.0.1"] * n, lambda said: tell(rank, said))
        out[rank] = work(team)
        team.close()

    threads = [threading.Thread(target=run, args=(r,)) for r in range(n)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(60)
    return out


def _chain_batch(at):
    rnd = random.Random(8)
    rows = [(i, i % 2, float(rnd.randint(0, 9)), [x for x in "abc" if rnd.random() < 0.3], [x for x in "abc" if rnd.random() < 0.1 + i % 5 / 10]) for i in range(200)]
    ids, folds, plain, names, held = zip(*[r for r in rows if at(r[0])], strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(folds, pa.int32()), pa.array(plain), pa.array(names), pa.array(held)], ["id", "fold", "p0", "names", "held"])


def test_a_chain_does_not_depend_on_how_rows_are_spread():
    scheme = chain.Scheme(["a", "b", "c"], [np.arange(9.0)], ["a", "b", "c"], 2)

    def work(team):
        trainer = chain.Trainer(team, scheme, iter([_chain_batch(lambda i: i * 7 // 5 % team.size == team.rank)]))
        return [trainer.learn(k, [{"depth": 2, "trees": 2}, {"depth": 3, "trees": 3}]) for k in range(3)]

    alone = work(chain.Team())
    assert all(x == alone for x in _team(3, work))
    assert any(f >= 4 for trees, _, _ in alone[1:] for t in trees for f in t[0])  # scores of the labels before are features


def test_partners_are_the_nearest_of_all_tasks():
    rnd = np.random.default_rng(5)
    x, ids, folds = rnd.integers(0, 4, (150, 3)).astype(float), rnd.permutation(150), rnd.integers(0, 2, 150)
    scheme = chain.Scheme(["a"], [np.arange(3.0)], ["a"], 2)

    def work(team):
        mine = np.flatnonzero(np.arange(150) % team.size == team.rank)
        trainer = chain.Trainer(team, scheme, iter([]))
        distance, who, _, _ = trainer.partners(x[mine], ids[mine], folds[mine])
        return {(int(ids[m]), k): [(d, i) for d, i in zip(distance[k, j].tolist(), who[k, j].tolist(), strict=True)] for j, m in enumerate(mine) for k in range(2)}

    got = {k: v for part in _team(3, work) for k, v in part.items()}
    for i in range(150):
        for k in range(2):
            assert got[int(ids[i]), k] == sorted((float(((x[i] - x[j]) ** 2).sum()), int(ids[j])) for j in range(150) if j != i and folds[j] == k)[:3]


def test_thresholds_of_the_chain_are_those_of_l8(spark):
    rnd = random.Random(6)
    for n in (12, 60, 400):
        rows = [("x", round(rnd.random(), 3), int(rnd.random() < 0.3)) for _ in range(n)]
        want = evaluate.tuned_threshold(spark.createDataFrame(rows, "label string, prob double, y int"), "label", "prob", "y").first()
        reach = [[r for r in rows if r[1] >= t / 100 - 1e-12] if t > 9 else rows for t in range(9, 91)]
        got = chain.best_threshold(np.array([len(r) for r in reach]), np.array([sum(y for _, _, y in r) for r in reach]))
        assert got == (pytest.approx(want.threshold), pytest.approx(want.f_beta))


def test_pseudo_labels_take_two_rounds(spark):
    df = _two_classes(spark, 200, 80)
    known, unknown = df.filter(learn.fold(F.col("key"), 3) == 0).select("key", "a", "b", F.col("y").alias("label")), df.select("key", "a", "b")
    found = learn.pseudo_label_rounds(known, unknown.join(known.select("key"), "key", "left_anti"), ["a", "b"], "key", trees=3).collect()
    assert len({r.key for r in found}) == len(found) and {r.round for r in found} <= {1, 2} and 1 in {r.round for r in found}
    assert not {r.key for r in known.collect()} & {r.key for r in found}


def test_pair_features_do_not_see_their_own_label(spark):
    edges = spark.createDataFrame([("d1", "a", "b"), ("d2", "a", "b"), ("d3", "b", "a")], "doc string, src string, dst string")
    members = spark.createDataFrame([(d, i) for d in ("d1", "d2", "d3") for i in "ab"], "doc string, item string")
    pairs = joins.ordered_pairs(members, edges)
    rows = {(r.doc, r.src): r for r in learn.pair_features(pairs, edges, members, own=True).collect()}
    assert (rows["d1", "a"].n_there, rows["d3", "a"].n_there, rows["d1", "a"].n_both, rows["d1", "b"].n_there) == (1.0, 2.0, 2.0, 1.0)
    apart = {(r.doc, r.src): r for r in learn.pair_features(pairs, edges.filter("doc <> 'd1'"), members.filter("doc <> 'd1'"), own=False).collect()}
    assert (apart["d1", "a"].n_there, apart["d1", "a"].n_back, apart["d1", "a"].n_both) == (1.0, 1.0, 2.0)


def test_ablation_ranks_the_telling_group_first(spark):
    df = _two_classes(spark, 200, 80)
    model = learn.boosted_trees(df, ["a", "b"], "y", trees=3)
    ranked = learn.ablation(model, df, {"noise": ["b"], "signal": ["a"]}, "y")
    assert [g for g, _ in ranked] == ["signal", "noise"] and ranked[0][1] > 0.2


def test_pairs_are_scored_by_a_given_model(spark):
    df = spark.createDataFrame([("a b", "b c", 1), ("", None, 2), (None, "x", 3)], "l string, r string, k int")
    assert {r.k: round(r.relevance, 4) for r in learn.score_pairs(df, "l", "r").collect()} == {1: 0.3333, 2: 0.0, 3: 0.0}
    longer = lambda a, b: [len(x) - len(y) for x, y in zip(a, b)]
    assert {r.k: r.s for r in learn.score_pairs(df, "l", "r", longer, "s").collect()} == {1: 0.0, 2: 0.0, 3: -1.0}


def test_boosted_trees_beat_chance(spark, sf):
    from oreloom.plans.model_queries import l4_boosted_trees

    rows = l4_boosted_trees(spark, sf).collect()
    assert sum((r.y0_prob > 0.5) == bool(r.y0) for r in rows) / len(rows) > 0.6


@pytest.mark.parametrize("dims", [1, 2])
def test_disjoint_boxes_match_plain_greedy(spark, dims):
    rng = np.random.default_rng(dims)
    lo = rng.uniform(-50, 50, (200, dims)).round(1)
    hi = lo + rng.choice([0.0, 0.5, 3.0, 20.0, 70.0], (200, dims))
    rows = [("p", f"b{i:03d}", *[float(x) for d in range(dims) for x in (lo[i, d], hi[i, d])]) for i in range(200)]
    sides = [(f"lo{d}", f"hi{d}") for d in range(dims)]
    df = spark.createDataFrame(rows, ", ".join(["g string", "name string", *[f"{c} double" for s in sides for c in s]]))
    area, kept = (hi - lo).prod(1), []
    for i in sorted(range(200), key=lambda i: (-area[i], i)):
        common = [np.maximum(np.minimum(hi[i], hi[j]) - np.maximum(lo[i], lo[j]), 0).prod() for j in kept]
        if not any(min(area[i], area[j]) > 0 and c >= 0.5 * min(area[i], area[j]) for c, j in zip(common, kept)):
            kept.append(i)
    assert {r.name for r in joins.greedy_disjoint(df, "g", "name", sides).collect()} == {f"b{i:03d}" for i in kept}


def test_mentions_match_plain_search(spark):
    texts, names = ["the ball mill feeds", "a jig", None, "", "ball millball mill and jigs"], ["ball mill", "ball", "jig", "mill", "", None, "zz"]
    df, ns = spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(n,) for n in names * 2], "name string")
    want = sorted(n for t in texts if t for n in ("ball mill", "ball", "jig", "mill", "zz") if n in t)
    assert sorted(r.name for r in joins.mentions(df, ns).collect()) == sorted(r.name for r in joins.mentions(df, ns, block=2).collect()) == want
    assert joins.mentions(df, ns.limit(0)).count() == 0


def test_sql_functions_equal_the_columns(spark):
    from oreloom.functions.register import register_functions, register_stage

    register_functions(spark)
    df = spark.createDataFrame([(x,) for x in ("copper_flotation_unit", "cu_au", "ball_mills", "a 12.5 b", "$1,200%", "Table 4-2: x", None, "incl", "jaw_crusher_a")], "raw string")
    df.createOrReplaceTempView("raws")
    got = spark.sql("SELECT normalize_id(raw) AS a, first_number(raw) AS b, parse_number(raw) AS c, content_id(raw) AS d, table_number(raw) AS e FROM raws").collect()
    r = F.col("raw")
    assert got == df.select(text.normalise_id(r).alias("a"), text.first_number(r).alias("b"), text.parse_number(r).alias("c"), text.content_id(r).alias("d"), text.table_number(r).alias("e")).collect()
    mapping, noise = {"mill": "milling", "drum": None}, ["copper"]
    register_stage(spark, "stage_v1", mapping, noise)
    ids = spark.createDataFrame([(x,) for x in ("copper_mill", "Mill ", "big_drum_mill_x", "mill_drum", "none", None)], "raw string")
    ids.createOrReplaceTempView("ids")
    assert spark.sql("SELECT stage_v1(raw) AS s FROM ids").collect() == ids.select(tables.canonical_stage(F.col("raw"), mapping, noise).alias("s")).collect()


def test_split_is_stable_and_near_its_shares(spark):
    df = spark.range(4000).select(learn.hash_split(F.col("id"), [("train", 0.7), ("val", 0.2), ("test", 0.1)]).alias("s"))
    n = {r.s: r["count"] for r in df.groupBy("s").count().collect()}
    assert abs(n["train"] / 4000 - 0.7) < 0.03 and abs(n["test"] / 4000 - 0.1) < 0.02


def test_grinding_keeps_mass(spark):
    arr = lambda *xs: F.array(*[F.lit(float(x)) for x in xs])
    df = spark.range(1).select(plant.grind(arr(50, 30, 20), arr(8, 4, 2), arr(4, 2, 1), arr(0.5, 0.4, 0.0), F.lit(2.5)).alias("t"))
    out = df.first().t
    assert sum(out) == pytest.approx(100) and out[0] < 50 and out[2] > 20


def test_views_and_cyclone(spark, sf):
    from oreloom.session import register_views

    assert "region" in register_views(spark, sf)
    assert spark.sql("SELECT count(*) AS n FROM region").first().n == 5
    lit = [F.lit(x) for x in (66.0, 20.0, 25.0, 15.0, 150.0, 5000.0, 30.0)]
    row = spark.range(1).select(plant.cyclone_pressure(*lit).alias("kpa"), plant.cyclone_cut(*lit).alias("d50")).first()
    assert row.kpa == pytest.approx(51.27 * 1.88 * 5000**1.78 * np.exp(0.165) / (66**0.37 * 20**0.94 * 150**0.28 * 850**0.87))
    assert row.d50 == pytest.approx(0.0387 * 50.5 * 66**0.46 * 20**0.6 * 25**1.21 * np.exp(1.89) / (15**0.71 * 150**0.38 * 5000**0.45 * 1.7))


def test_bond_inverts(spark):
    wi, f80, p80 = (F.lit(x) for x in (14.0, 10_000.0, 150.0))
    e = plant.bond_energy(wi, f80, p80)
    assert spark.range(1).select(plant.sag_product(wi, f80, e).alias("p")).first().p == pytest.approx(150.0)


# --- sources, sinks, streaming ----------------------------------------------------------------------------------------


def test_json_scan_rejects_what_is_broken(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"document_id": "d1", "unknown": 1, "tables": [{"caption": "c", "rows": [["1"]]}], "flowsheets": {"i": {"units": [{"id": "u"}], "connections": [{"from_type": "a", "to_type": "b"}]}, "bad": {"error": "x", "units": [{"id": "no"}]}}}')
    (tmp_path / "broken.json").write_text('{"document_id": ')
    (tmp_path / "nokey.json").write_text('{"filename": "x"}')
    good, rejected = results.read_json_documents(spark, str(tmp_path), results.RESULT, "document_id")
    assert [r.stem for r in good.collect()] == ["good"] and {r.stem for r in rejected.collect()} == {"broken", "nokey"}
    back = sinks.import_result(good)
    assert back["tables"].first().table_id == "d1_table_0"
    assert [tuple(r) for r in back["connections"].collect()] == [("d1", "i", "a", "b")]
    assert [(r.image_id, r.id, r.cells) for r in back["units"].collect()] == [("i", "u", 1)]
    assert back["documents"].first().n_flowsheets == 2 and back["documents"].first().n_errors == 0
    assert results.document_index(spark, str(tmp_path)).count() == 1


def test_key_pairs(spark):
    df = spark.createDataFrame([('{"a|b|c": 2, "nomark": 1}',), ("broken",), (None,)], "j string")
    assert [tuple(r) for r in results.key_pairs(df, "j").collect()] == [("a", "b|c", 2.0)]


def test_documents_of_a_listing_and_their_heads(spark, tmp_path):
    import json as js

    for i in range(3):
        (tmp_path / "bucket" / f"k{i}").mkdir(parents=True)
        (tmp_path / "bucket" / f"k{i}" / f"r{i}.json").write_text(js.dumps({"document_id": f"d\u00e9 {i}", "filename": "x" * 2000, "status": "done"}))
    (tmp_path / "bucket" / "k0" / "late.json").write_text(js.dumps({"pad": "y" * 900, "document_id": "unseen"}))
    (tmp_path / "bucket" / "k0" / "note.txt").write_text('{"document_id": "no json"}')
    uri = f"file://{tmp_path}/bucket/*"  # a listing by URI, as of an object store
    good, bad = results.read_json_documents(spark, f"{uri}/*.json", results.RESULT, "document_id")
    assert good.count() == 4 and bad.count() == 0
    index = {r.document_id: r.file for r in results.document_index(spark, uri).collect()}
    assert set(index) == {"d\u00e9 0", "d\u00e9 1", "d\u00e9 2"} and index["d\u00e9 1"].endswith("k1/r1.json")


def test_graph_corpus_scan(spark, tmp_path):
    import json as js

    node = lambda kind: {"type": kind, "features": {"n": 1.0}}
    for name, nodes in (("a", [node("context")] * 4), ("b", [node("context")] * 3 + [node("stage")]), ("corpus_meta", [node("context")] * 9)):
        (tmp_path / f"{name}.json").write_text(js.dumps({"document_id": name, "nodes": nodes}))
    (tmp_path / "broken.json").write_text("{")
    kind = spark.createDataFrame([], "document_id string, nodes array<struct<type:string,features:map<string,double>>>").schema
    found = results.scan_graphs(spark, str(tmp_path), kind, ["corpus_meta"])
    assert [r.document_id for r in found.collect()] == ["a"]


def test_manifest_is_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "manifest.json")
    for n in (3, 1):
        sinks.write_manifest(spark, [{"file": f"f{i}", "score": i / 2} for i in range(n)], path)
        assert {tuple(r) for r in sinks.read_manifest(spark, path, "file string, score double").collect()} == {(f"f{i}", i / 2) for i in range(n)}
    assert [p.name for p in tmp_path.iterdir() if p.name.endswith(".tmp")] == []


def test_sinks(spark, tmp_path):
    assert not sinks.write_table(spark.range(0), str(tmp_path / "none")) and sinks.write_table(spark.range(3), str(tmp_path / "some"))
    assert spark.read.parquet(str(tmp_path / "some")).count() == 3
    sinks.write_csv(spark.createDataFrame([(1, ["a"])], "i int, xs array<string>"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first().i == "1"
    old = spark.createDataFrame([("k", 1)], "k string, run int")
    new = spark.createDataFrame([("k", 2), ("n", 4), ("n", 3)], "k string, run int")
    assert {tuple(r) for r in sinks.first_writer_wins(old, new, ["k"], [F.col("run")]).collect()} == {("k", 1), ("n", 3)}


def test_streaming_ingest_equals_batch(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    schema = "k string, v int, seq int"
    spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], schema).coalesce(1).write.parquet(source)
    spark.createDataFrame([("a", 2, 2)], schema).coalesce(1).write.mode("append").parquet(source)
    kind = spark.createDataFrame([], schema).schema
    for _ in range(2):  # the second run sees no new files
        ingest.ingest_files(spark, source, kind, target, checkpoint, ["k"], "seq", 1).awaitTermination()
    spark.createDataFrame([("b", 9, 3)], schema).coalesce(1).write.mode("append").parquet(source)
    ingest.ingest_files(spark, source, kind, target, checkpoint, ["k"], "seq", 1).awaitTermination()
    assert {tuple(r) for r in ingest.latest_version(spark, target).collect()} == {("a", 2, 2), ("b", 9, 3)}


def test_streaming_merge_rewrites_only_touched_parts(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    schema = "k string, v int, seq int"
    kind = spark.createDataFrame([], schema).schema
    assert ingest.latest_version(spark, target) is None
    spark.createDataFrame([(f"k{i}", i, 1) for i in range(200)], schema).coalesce(1).write.parquet(source)
    for n in range(3):
        spark.createDataFrame([("k7", 100 + n, 2 + n)], schema).coalesce(1).write.mode("append").parquet(source)
        ingest.ingest_files(spark, source, kind, target, checkpoint, ["k"], "seq", 1, parts=8).awaitTermination()
    rows = {r.k: r.v for r in ingest.latest_version(spark, target).collect()}
    assert len(rows) == 200 and rows["k7"] == 102 and rows["k8"] == 8
    written = {p.name: sorted(x.name for x in p.iterdir() if x.is_dir()) for p in (tmp_path / "out").iterdir()}
    full = [v for v, parts in written.items() if len(parts) >= 7]
    assert len(full) == 1 and all(len(parts) <= 1 for v, parts in written.items() if v not in full)  # superseded parts are gone


def test_streaming_windows_equal_batch(spark, tmp_path):
    rows = [(f"2024-01-01 0{i % 3}:15:00", "e", 1.0) for i in range(9)]
    df = spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "ev"))
    q = ingest.windowed_counts(stream, "ts").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, ingest.windowed_counts(df, "ts").collect()))


def test_store_is_created_once_and_checked(spark, tmp_path):
    from oreloom.sources import store

    path = str(tmp_path / "store")
    store.create_store(spark, path)
    store.create_store(spark, path)
    tables_ = store.open_store(spark, path)
    assert store.check_store(tables_).count() == 0
    images = spark.createDataFrame([("i", "nodoc"), ("i", "nodoc"), (None, None)], "image_id string, document_id string")
    for f in tables_["images"].schema:
        if f.name not in images.columns:
            images = images.withColumn(f.name, F.lit(None).cast(f.dataType))
    got = {(r.kind, r.table, r.column): r.n for r in store.check_store(tables_ | {"images": images.select(*tables_["images"].columns)}).collect()}
    assert got == {("key", "images", "image_id"): 2, ("reference", "images", "document_id"): 1}
    assert spark.sql("SELECT count(*) FROM documents").first()[0] == 0


def test_rewrite_text_leaves_other_columns(spark):
    from oreloom.sources import store

    row = store.rewrite_text(spark.createDataFrame([("The Mills of  ores 12", 3, None)], "a string, b int, c string"), ["the", "of"]).first()
    assert tuple(row) == ("mill ore 12", 3, None)


def test_keyword_classes_match_counting_each_pattern(spark):
    import re

    from oreloom.functions.text import MINERAL_PATTERNS, mineral_pattern
    from oreloom.operators.classify import keyword_classes

    texts = ["Banded iron formation, lead-zinc ore with Zn and zn, COPPER and Cu cu; tin Sn sn", "U3O8 u3o8 rare earth REE", "", None, "gold_ Au-Ag au"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    want = set()
    for i, t in enumerate(texts):
        for m, names in MINERAL_PATTERNS.items():
            n = sum(len(re.findall(mineral_pattern(x), t or "", re.ASCII)) for x in names)
            if n:
                want.add((i, m, n))
    assert {tuple(r) for r in keyword_classes(df, "id", "t").collect()} == want


def test_a_hot_sequence_is_cut_into_parts_and_joined_again(spark, request):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    rnd = random.Random(6)
    seq = [("hot", rnd.choice("abc"), i * 7) for i in range(3000)] + [(f"d{i % 40}", rnd.choice(["a", "b", None]), i) for i in range(400)] + [(None, "a", 1), (None, "b", 2)]
    df = spark.createDataFrame(seq, "doc string, stage string, pos bigint").repartition(3)
    assert corpus.in_parts(df).filter("doc = 'hot'").select("__part").distinct().count() > 1
    want, kept = [], []
    for doc in {d for d, _, _ in seq}:
        own = [s for d, s, _ in sorted((x for x in seq if x[0] == doc), key=lambda x: x[2])]
        want += [(doc, a, b) for a, b in zip(own, own[1:]) if b is not None]
        named = [s for s in own if s is not None]
        kept += [(doc, s, i) for i, s in enumerate((s for j, s in enumerate(named) if not j or named[j - 1] != s), 1)]
    order = lambda rows: sorted(map(str, rows))
    assert order(tuple(r) for r in corpus.transitions(df).collect()) == order(want)
    assert order(tuple(r) for r in corpus.collapse_repeats(df).collect()) == order(kept)
    assert corpus.transitions(df.limit(0)).count() == 0


def test_pairs_of_large_sets_come_from_blocks(spark):
    rnd = random.Random(9)
    members = [("x", f"i{i:03d}") for i in range(90)] + [(f"d{i % 30}", f"i{rnd.randint(0, 50):03d}") for i in range(200)] + [("x", None), (None, "a"), (None, "b")]
    df = spark.createDataFrame(members + members[:9], "doc string, item string")
    sets = {}
    for d, i in members:
        if i is not None:
            sets.setdefault(d, set()).add(i)
    want = sorted(str((d, a, b)) for d, s in sets.items() for a in s for b in s if a < b)
    for chunk in (8, 64):
        assert sorted(str(tuple(r)) for r in corpus.item_pairs(df, chunk).collect()) == want


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_index_probes_few_cells_and_finds_most(spark, metric):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8)) * 8
    hot = [0] * 300 + list(range(12)) * 40  # one cell holds two fifths of the rows
    x = centres[hot] + rng.normal(size=(len(hot), 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(10**6, None)], "id bigint, vec array<double>")
    index = neighbors.fit_cells(df, 5, metric)
    assert index.probes <= len(index.centres) and len(index.centres) > 8
    exact = neighbors.knn(df, df, 5, metric, same=True)
    found = neighbors.knn(df, df, 5, metric, same=True, index=index, block=64)
    assert neighbors.recall(found, exact) >= 0.9
    assert found.select("id").distinct().count() == len(hot)
    again = neighbors.fit_cells(df.repartition(5), 5, metric)
    assert again.probes == index.probes and np.allclose(again.centres, index.centres)
    empty = df.limit(0)
    assert neighbors.knn(empty, empty, 5, index=neighbors.fit_cells(empty, 5)).count() == 0
