"""General training-data problems against brute force and hand-made edge cases."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oreloom.operators import hierarchy, nested, orphans, units

T = dt.datetime


# --- nested records -----------------------------------------------------------------------------------------------


def children(spark, rows):
    df = spark.createDataFrame(rows, "trace_id bigint, stages string, edges string, kind string")
    return sorted(map(tuple, nested.child_records(df).collect()))


def test_shapes_of_every_level(spark):
    a = [{"stage": " mill ", "sections": [{"section": "s1", "evidence": [{"page": "12"}, 7, {"page": 3.0}, {"table_id": "t"}, None]}, "s2", None]}]
    b = {"cell": {"sections": {"s3": 0.5, "s4": {"weight": 1, "evidence": {"page": 5}}}}, "tank": None}
    c = {"items": [{"stage": "jig", "sections": {"section": "s5", "weight": 0.1}}]}
    edges = [["a", "b", 3], {"src": "a", "dst": " c"}, {"from_type": "x", "to_type": "y"}, {"src": "a", "dst": None}, "p|q", None]
    got = children(
        spark,
        [
            (1, json.dumps(a), json.dumps(edges), "z"),
            (2, json.dumps(b), json.dumps({"a|b": 3, "c | d": {"support": 1}, "lost": 2}), None),
            (3, json.dumps(json.dumps(c)), json.dumps({"src": "m", "dst": "n", "support": 2}), None),
        ],
    )
    assert got == sorted(
        [
            (1, "stage", "", "mill"), (1, "section", "mill", "s1"), (1, "section", "mill", "s2"),
            (1, "evidence", "mill/s1", "12"), (1, "evidence", "mill/s1", "7"), (1, "evidence", "mill/s1", "3"),
            (1, "edge", "", "a>b"), (1, "edge", "", "a>c"), (1, "edge", "", "x>y"), (1, "edge", "", "p>q"),
            (2, "stage", "", "cell"), (2, "stage", "", "tank"), (2, "section", "cell", "s3"), (2, "section", "cell", "s4"),
            (2, "evidence", "cell/s4", "5"), (2, "edge", "", "a>b"), (2, "edge", "", "c>d"),
            (3, "stage", "", "jig"), (3, "section", "jig", "s5"), (3, "edge", "", "m>n"),
        ]
    )


def test_any_number_of_encodings_and_any_depth(spark):
    text = json.dumps([{"stage": "mill"}])
    for _ in range(9):
        text = json.dumps(text)
    deep = '[{"stage": "jig", "sections": ' + '{"items": ' * 40_000 + '["s"]' + "}" * 40_000 + "}]"
    rows = [(1, text, None, "z"), (2, deep, '[["a>b", "c"]]', "z"), (3, "{broken", "", "z"), (4, deep[:-2], None, "z"), (5, '"[1, "', None, "z")]
    assert children(spark, rows) == [(1, "stage", "", "mill"), (2, "edge", "", "a>b>c"), (2, "section", "jig", "s"), (2, "stage", "", "jig")]
    df = spark.createDataFrame(rows, "trace_id bigint, stages string, edges string, kind string")
    rejects = {(r.trace_id, r.field) for r in nested.rejected_fields(df, "trace_id", nested.TRACE_SHAPE).collect()}
    assert rejects == {(3, "stages"), (4, "stages"), (5, "stages")}
    edge = nested.trace_nodes(df).filter("kind = 'edge'").first()
    assert (edge.name, edge.name2) == ("a>b", "c")


def test_deep_loader_equals_the_plain_one():
    rnd = random.Random(8)

    def value(depth):
        kind = rnd.randint(0, 7 if depth else 5)
        return (None, True, -1.5e3, 7, 'q"\\\n', "")[kind] if kind < 6 else [value(depth - 1) for _ in range(rnd.randint(0, 3))] if kind == 6 else {f"k{i}": value(depth - 1) for i in range(rnd.randint(0, 3))}

    for _ in range(300):
        x = value(5)
        assert nested.loads_deep(json.dumps(x, indent=rnd.choice([None, 1]))) == x
    for broken in ("", "[", "[1,]", '{"a" 1}', '{"a": 1,}', "[1] 2", "{1: 2}", "tru", "[1 2]", "]"):
        with pytest.raises(ValueError):
            nested.loads_deep(broken)


def test_nameless_members_hide_what_they_hold(spark):
    a = [{"sections": [{"section": "hidden"}], "probability": 0.1}, {"stage": "  ", "sections": ["x"]}, {"stage": None, "sections": ["y"]}, {"stage": "ok", "sections": [{"weight": 1, "evidence": [1]}]}]
    assert children(spark, [(1, json.dumps(a), None, None)]) == [(1, "stage", "", "ok")]


def test_broken_null_empty_repeated(spark):
    good = json.dumps([{"stage": "a"}, {"stage": "a"}])
    rows = [(1, good, "[{", None), (1, good, "[{", None), (2, None, "", None), (None, "null", good, None), (3, "[" * 5000, "7", None)]
    assert children(spark, rows) == [(1, "stage", "", "a")]
    assert children(spark, []) == []


def test_interval_containment(spark):
    a = [{"stage": "s", "sections": ["p", "q"]}, {"stage": "t", "sections": ["p"]}]
    df = spark.createDataFrame([(1, json.dumps(a), None)], "trace_id bigint, stages string, edges string")
    rows = {(r.kind, r["name"], r.stage_name): r for r in nested.trace_nodes(df).collect()}
    s, t = rows["stage", "s", None], rows["stage", "t", None]
    assert s.pre < rows["section", "q", "s"].pre < rows["section", "q", "s"].post < s.post < t.pre
    assert ("section", "p", "t") in rows and len(rows) == 5


# --- units --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "number", "unit"),
    [
        ("1,234", 1234.0, ""), ("1,23", 1.23, ""), ("1.234", 1.234, ""), ("1,234.5", 1234.5, ""), ("1.234,5", 1234.5, ""), ("1.234.567", 1234567.0, ""),
        ("1'234'567", 1234567.0, ""), ("1 234", 1234.0, ""), ("1 234,5 kt", 1234.5, "kt"), ("1.5e+3 t", 1500.0, "t"), ("~0.5%", 0.5, "%"), ("c. 2*", 2.0, ""),
        ("approx. 3 g / t", 3.0, "g/t"), ("US$ 1.2* M", 1.2, "us$m"), ("CAD 5 mn", 5.0, "cadmn"), ("ca. 7", 7.0, ""), ("12 t x 1000", 12.0, "tx1000"),
        ("0.2-0.3", None, None), ("<5", None, None), ("> 7", None, None), ("n/a", None, None), ("", None, None), ("see text", None, None), ("1 to 2", None, None), (None, None, None),
    ],
)
def test_values(spark, text, number, unit):
    n, u = (units.split_value(F.col("v"))[k] for k in ("number", "unit"))
    row = spark.createDataFrame([(text,)], "v string").select(n.alias("n"), u.alias("u")).first()
    assert (row.n, row.u) == (number, unit)


FEATURES = "feature_id bigint, document_id string, table_id string, price_year int, grade_values array<string>, grade_unit string, tonnage_mean string, tonnage_unit string, capex_mean string, capex_unit string, alias string"
TABLES = "table_id string, headers array<string>, caption string, text_before string, value string"


def converted(spark, features, tables, rates=(("USD", 2020, 1.0), ("CAD", 2020, 0.75))):
    f = spark.createDataFrame(features, FEATURES)
    t = spark.createDataFrame(tables, TABLES)
    r = spark.createDataFrame(list(rates), "currency_code string, fx_year int, usd_per_unit double")
    return sorted(map(tuple, units.common_values(f, t, r).collect()))


def test_nearest_statement_wins(spark):
    features = [
        (1, "d", "t1", 2020, ["1", "2 %", None, "3 foo"], "g/t", "5", "n/a", "7", "", None),
        (1, "d", "t1", 2020, ["1", "2 %", None, "3 foo"], "g/t", "5", "n/a", "7", "", None),
        (2, "d", "t2", 2020, ["1"], "-", "5", None, "CAD 2 M", "USD", None),
        (3, "d", "t3", None, None, None, "1,000", "st", "CAD 2 M", None, None),
        (4, "d", "zz", None, ["4"], None, None, None, "2", "US$ million", None),
        (5, "d", None, 1900, ["9"], "", "8", "", "CAD 1", "", None),
    ]
    tables = [
        ("t1", ["Zone", "Cu grade [ppm]", "Ore mass, kt", "Capex (US$ k)"], "Table 1-1: x", None, None),
        ("t2", ["Grade", "Ore mass"], "Table 1-2: y (all grades expressed in %; ore masses: tons (long))", "The capital costs below are in CAD.", None),
        ("t2", ["Grade", "Ore mass"], "Table 1-2: y (all grades expressed in %; ore masses: tons (long))", "The capital costs below are in CAD.", None),
        ("t3", None, None, "Note that grades are reported as wt. %.", None),
    ]
    assert converted(spark, features, tables) == [
        (1, "capex_mean", 0, 7000), (1, "grade_values", 0, 1000), (1, "grade_values", 1, 20_000_000), (1, "tonnage_mean", 0, 5000),
        (2, "capex_mean", 0, 1_500_000), (2, "grade_values", 0, 10_000_000), (2, "tonnage_mean", 0, 5),
        (3, "tonnage_mean", 0, 907), (4, "capex_mean", 0, 2_000_000),
    ]


def test_empty_tables_of_units(spark):
    assert converted(spark, [], []) == []


def test_header_of_other_quantity_is_no_statement(spark):
    features = [(1, "d", "t", 2020, ["1"], None, "5", None, None, None, None)]
    assert converted(spark, features, [("t", ["Ore mass, kt"], None, None, None)]) == [(1, "tonnage_mean", 0, 5000)]


# --- orphan references ----------------------------------------------------------------------------------------------


def brute_orphans(refs, parents):
    out = set()
    for field, row, image, key, at in refs:
        mine = [(c, d) for i, k, c, d in parents if (i, k) == (image, key)]
        if at is not None and any(c is not None and c <= at and (d is None or d > at) for c, d in mine):
            continue
        born = at is not None and any(c is not None and c <= at for c, _ in mine)
        out.add((field, row, at.strftime("%Y-%m") if at else None, "missing" if not mine else "deleted" if born else "late"))
    return out


def run_orphans(spark, refs, parents):
    r = spark.createDataFrame(refs, "ref_field string, row_id bigint, image_id string, key string, at timestamp")
    p = spark.createDataFrame(parents, "image_id string, key string, created timestamp, deleted timestamp")
    found = orphans.find_orphans(r.filter("key IS NOT NULL"), p.filter("key IS NOT NULL"), ["image_id", "key"], max(1, len(parents)))
    return {tuple(x) for x in found.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_orphans_match_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(orphans, "SPANS_PER_CHUNK", 2)
    rnd = random.Random(seed)
    day = lambda: T(2020, rnd.randint(1, 12), rnd.randint(1, 28))
    parents = [(f"i{rnd.randint(0, 2)}", f"k{rnd.randint(0, 9)}", rnd.choice([day(), day(), day(), None]), rnd.choice([None, day(), day()])) for _ in range(120)]
    refs = [("f", i, f"i{rnd.randint(0, 3)}", f"k{rnd.randint(0, 14)}", rnd.choice([day(), day(), day(), day(), None])) for i in range(300)]
    assert run_orphans(spark, refs + refs[:50], parents) == brute_orphans(refs, parents)


def test_orphans_of_empty_tables(spark):
    at = T(2020, 1, 1)
    assert run_orphans(spark, [], []) == set()
    assert run_orphans(spark, [("f", 1, "i", "k", at)], []) == {("f", 1, "2020-01", "missing")}
    assert run_orphans(spark, [], [("i", "k", at, None)]) == set()


def test_filter_never_denies_a_parent(spark, monkeypatch):
    keys = spark.range(50_000).select(F.xxhash64("id").alias("h"))
    strangers = spark.range(10**6, 10**6 + 5000).select(F.xxhash64("id").alias("h"))
    slots, n = orphans.bloom_slots(keys, "h", 50_000)
    for most in (n, 0):  # broadcast, and joined by slot: the same bits at any size
        monkeypatch.setattr(orphans, "BROADCAST_SLOTS", most)
        assert orphans.might_contain(keys, "h", slots, n).filter("NOT maybe").count() == 0
        assert orphans.might_contain(strangers, "h", slots, n).filter("maybe").count() < 250
    plan = orphans.might_contain(keys, "h", slots, n)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in plan
    none, n = orphans.bloom_slots(keys.limit(0), "h", 0)
    assert orphans.might_contain(strangers, "h", none, n).filter("maybe").count() == 0


def test_orphans_of_a_larger_table_are_the_same(spark, monkeypatch):
    parents = spark.createDataFrame([("u", f"k{i}", T(2020, 1, 1 + i % 9), T(2020, 2, 1) if i % 3 else None) for i in range(60)], "target string, key string, created timestamp, deleted timestamp")
    refs = spark.createDataFrame([("f", i, "u", f"k{i % 90}", T(2020, 1 + i % 3, 3)) for i in range(300)], "ref_field string, row_id bigint, target string, key string, at timestamp")
    more = parents.union(parents.selectExpr("target", "concat('other', key)", "created", "deleted"))
    found = lambda p, n: {tuple(r) for r in orphans.find_orphans(refs, p, ["target", "key"], n).collect()}
    once = found(parents, 60)
    assert once == found(more, 120) == found(parents, 1)
    monkeypatch.setattr(orphans, "BROADCAST_SLOTS", 0)
    assert once == found(more, 120)


# --- hierarchies ------------------------------------------------------------------------------------------------------


def brute_tree(links):
    nodes, parent = set(), {}
    for g, p, c in links:
        nodes |= {(g, x) for x in (p, c) if x is not None}
        if p is not None and c is not None:
            parent[g, c] = min(p, parent.get((g, c), p))
    below = {n: set() for n in nodes}
    out = set()
    for g, v in nodes:
        path, at = [v], v
        while (g, at) in parent and len(path) <= len(nodes):
            at = parent[g, at]
            path.append(at)
            if at == v:
                break
        for up in path[1:]:
            below[g, up].add((g, v))
        if (g, at) not in parent:
            out.add((g, v, at, len(path) - 1, ">".join(reversed(path))))
        else:
            out.add((g, v, "", -1 if v in path[1:] else -2, ""))
    return {(*o, len(below[o[0], o[1]] - {(o[0], o[1])})) for o in out}


@pytest.mark.parametrize(("seed", "finish"), [(1, 10**6), (2, 40), (3, 8)])
def test_hierarchies_match_brute_force(spark, seed, finish):
    rnd = random.Random(seed)
    links = []
    for g in ("a", "b"):
        for i in range(1, 40):
            links.append((g, f"n{rnd.randint(max(0, i - 3), i - 1)}", f"n{i}"))
        links += [(g, "n5", "n3"), (g, "x", "x"), (g, "x", "y"), (g, None, "lone"), (g, "lone2", None), (g, None, None), (g, "n1", "n2")]
    chain = [("c", f"c{i:02d}", f"c{i + 1:02d}") for i in range(30)] + [("c", "c30", "c20"), ("d", "p", "q"), ("d", "q", "p")]
    links += chain
    links += links[:7]
    df = spark.createDataFrame(links, "g string, parent string, child string")
    got = hierarchy.hierarchies(df, finish)
    assert {tuple(r) for r in got.collect()} == brute_tree(links)
    assert got.count() == len(brute_tree(links))


def test_hierarchies_empty_and_without_group(spark):
    df = spark.createDataFrame([], "g string, parent string, child string")
    assert hierarchy.hierarchies(df).count() == 0
    df = spark.createDataFrame([(None, "a", "b")], "g string, parent string, child string")
    for finish in (0, 10):
        assert {tuple(r) for r in hierarchy.hierarchies(df, finish).collect()} == {(None, "a", "a", 0, "a", 1), (None, "b", "a", 1, "a>b", 0)}


def test_descendants(spark):
    df = spark.createDataFrame([("g", "a>1", "b"), ("g", "b", "c")], "g string, parent string, child string")
    for rows in (0, 10):
        known = hierarchy.hierarchies(df, rows, steps=True)
        assert {tuple(r) for r in hierarchy.descendants(known).collect()} == {("g", "a>1", "b"), ("g", "a>1", "c"), ("g", "b", "c")}


def test_contraction_takes_steps_and_few_of_them():
    n = 50_000
    chain = hierarchy.Contraction(np.arange(n) - 1, np.ones(n, np.int64), np.arange(n), np.arange(n), np.ones(n, np.int64))
    chain.run()
    assert 10 < len(chain.steps) < 150  # grows with the logarithm of the depth
    assert (chain.depth == np.arange(n)).all() and (chain.total == n - np.arange(n)).all() and (chain.root == 0).all()
    offsets, flat = chain.paths(np.array([4, 0, 2]))
    assert offsets.tolist() == [0, 5, 6, 9] and flat.tolist() == [0, 1, 2, 3, 4, 0, 0, 1, 2]


def test_hierarchies_stream_many_groups_and_spell_deep_paths(spark, monkeypatch):
    links = [(f"g{i % 97:02d}", f"n{j}", f"n{j + 1}") for i in range(97) for j in range(i % 13 + 1)]
    df = spark.createDataFrame(links, "g string, parent string, child string")
    monkeypatch.setattr(hierarchy, "PATH_BLOCK", 50)
    for rows in (20, 5):  # several chunks of whole groups per task; some groups across parts
        assert {tuple(r) for r in hierarchy.hierarchies(df, rows).collect()} == brute_tree(links)


def test_a_table_twice_gives_the_same_hierarchies(spark, sf):
    once = spark.read.parquet(f"{sf}/flow_connections.parquet").selectExpr("image_id as g", "lower(trim(parent_id)) as parent", "lower(trim(child_id)) as child")
    rows = [{tuple(r) for r in hierarchy.hierarchies(df, part).collect()} for df, part in ((once, 50_000), (once.union(once), 50_000), (once, 60))]
    assert rows[0] == rows[1] == rows[2]
