"""Training-data operators against brute force, exact round trips and edge cases."""

import math
import random
import re
import string
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oreloom.llm import canonical, cooccur, packing, pages, tokens

tiktoken = pytest.importorskip("tiktoken")


# --- co-occurrence ----------------------------------------------------------------------------------------------------


def brute_pairs(baskets, min_support, min_lift):
    out = set()
    for name in {b[1] for b in baskets}:
        sets = [set(items) for _, n, items in baskets if n == name and items]
        single, pair = Counter(), Counter()
        for s in sets:
            single.update(s)
            pair.update((a, b) for a in s for b in s if a < b)
        for (a, b), n in pair.items():
            if n >= min_support and n * len(sets) >= min_lift * single[a] * single[b]:
                out.add((name, a, b, single[a], single[b], n, len(sets)))
    return out


@pytest.mark.parametrize("chunk", [2, 7, 8, 128])
def test_pairs_match_brute_force(spark, chunk):
    rnd = random.Random(chunk)
    baskets = []
    for i in range(150):
        topic = rnd.randint(0, 4)
        items = {f"t{topic}_{rnd.randint(0, 5)}" for _ in range(4)} | {f"w{rnd.randint(0, 60)}" for _ in range(rnd.choice([1, 3, 40]))}
        baskets.append((str(i), rnd.choice(["x", "y"]), sorted(items | {"everywhere"})))
    df = spark.createDataFrame(baskets, "basket string, list_name string, items array<string>")
    got = cooccur.cooccurrences(df, 3, 2.0, chunk)
    assert {tuple(r)[:7] for r in got.collect()} == brute_pairs(baskets, 3, 2.0)
    row = got.first()
    assert row.lift == pytest.approx(row.n_ab * row.n / (row.n_a * row.n_b)) and row.pmi == pytest.approx(math.log2(row.lift))


def test_baskets_take_the_latest_row_and_clean_names(spark):
    rows = [
        ("d", 1, ["old"], None, "z"), ("d", 2, [" A ", "a", None, "", "B"], [], "z"), ("d", 2, [" A ", "a", None, "", "B"], [], "z"),
        ("e", None, ["x"], ["y"], "z"), ("f", 5, None, None, "z"),
    ]
    df = spark.createDataFrame(rows, "doc_id string, produced_at int, ground_truth array<string>, xgb_stages array<string>, items string")
    got = {(r.basket, r.list_name, tuple(sorted(r["items"]))) for r in cooccur.stage_baskets(df).collect()}
    assert got == {("d", "ground_truth", ("a", "b")), ("e", "ground_truth", ("x",)), ("e", "xgb_stages", ("y",))}
    assert cooccur.cooccurrences(cooccur.stage_baskets(df.limit(0))).count() == 0


def test_planted_records_go_through_blocks(spark, sf):
    from oreloom.session import table

    counts = cooccur.blocked_baskets(cooccur.stage_baskets(table(spark, sf, "test_predictions"))).collect()
    assert all(r.n_large > 0 and r.n_blocks >= 3 * r.n_large for r in counts)
    items = spark.createDataFrame([("x", 7, 3, i, [f"{i}a", f"{i}b"]) for i in range(3)], "list_name string, basket bigint, chunks int, i int, items array<string>")
    assert sorted((r.lo, r.hi) for r in cooccur.large_blocks(items).collect()) == [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]


# --- canonical list ----------------------------------------------------------------------------------------------------

ENTRIES = [(1, "jaw crusher"), (1, "chancadora de quijadas"), (2, "ball mill"), (3, "rod mill"), (4, "jig"), (5, "dust collector"), (5, "baghouse"), (6, "flocculant dosing skid"), (7, "air blower"), (7, "gebläse")]


def damerau(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_matches_brute_force():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 13))) for _ in range(60)]
    trie = canonical.Trie(list(enumerate(words)))
    for _ in range(400):
        w = list(rnd.choice(words))
        for _ in range(rnd.randint(0, 4)):
            i = rnd.randrange(len(w) + 1)
            w[i : i + rnd.randint(0, 1)] = rnd.choice(["", "a", "b", "d"])
        w = "".join(w)
        reach = [(damerau(w, x), -len(x), i) for i, x in enumerate(words) if damerau(w, x) <= canonical.allowed(len(x)) and (damerau(w, x) <= 1 or w[:1] == x[0])]
        assert trie.within(w) == sorted(reach)
        assert trie.nearest(w) == min(reach, default=None)


@pytest.mark.parametrize(
    ("text", "canon"),
    [
        ("JAW CRUSHER", 1), ("Jaw_Crusher", 1), ("JawCrusher #2", 1), ("jaw crushers", 1), ("2 x jaw crsher (36 m dia)", 1), ("Crusher, Jaw", 1), ("jw crshr", 1),
        ("chan. de quij.", 1), ("ja wcrusher HX-148", 1), ("STANDBY BALL MILL / LINE 1", 2), ("rod nill", 3), ("jigs", 4), ("jog", 0), ("baghuose", 5),
        ("flcclnt dsng skd", 6), ("Geblaese", 7), ("GEBLÄSE", 7), ("truck shop", 0), ("x", 0), ("", 0), ("12", 0), ("é" * 300, 0),
    ],
)
def test_free_entries(text, canon):
    match = canonical.Trie(ENTRIES).match(text)
    assert (match[3] if match else 0) == canon


def test_a_long_list_is_searched_in_blocks_and_other_rows_do_not_matter(spark, monkeypatch):
    texts = ["jaw crsher", "chan. de quij.", "bal mills", "gat house", "gatehouse", "baghuose", "rod, mill", "bll mil", "jw crshr"]
    vocab = spark.createDataFrame([(i, n, [m]) for i, (c, n) in enumerate(ENTRIES, 1) for m in [n.upper()]], "canon_id int, canon_name string, alt_names array<string>")
    units = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "unit_rid bigint, unit_type string, label string")
    more = units.union(spark.createDataFrame([(100 + i, t, None) for i, t in enumerate(["gate house", "bat house", "raw mill"] * 50)], units.schema))
    once = {tuple(r) for r in canonical.canonical_units(units, vocab).collect()}
    monkeypatch.setattr(canonical, "TRIE_ENTRIES", 3)
    monkeypatch.setattr(canonical.entry_blocks, "__defaults__", (3,))
    assert {tuple(r) for r in canonical.canonical_units(more, vocab).collect() if r.unit_rid < 100} == once


def test_units_end_to_end(spark):
    rows = [(i, "gate house", None, "q") for i in range(6)] + [(10, "gat house", None, "q"), (11, None, "Jaw Crusher", "q"), (12, "n/a", "misc", "q"), (13, None, None, "q"), (14, "jaw crusher", "x", "q"), (15, "Jaw crusher", None, "q"), (15, "Jaw crusher", None, "q")]
    units = spark.createDataFrame(rows, "unit_rid bigint, unit_type string, label string, text string")
    vocab = spark.createDataFrame([(i, n, "c", [m for j, m in ENTRIES if j == i]) for i, n in {i: n for i, n in reversed(ENTRIES)}.items()], "canon_id int, canon_name string, category string, alt_names array<string>")
    got = {r.unit_rid: r.canon_id for r in canonical.canonical_units(units, vocab).collect()}
    assert got == {**dict.fromkeys(range(6), 0), 10: 0, 11: 1, 12: 0, 13: 0, 15: 1}
    assert canonical.canonical_units(units.limit(0), vocab).count() == 0
    assert {r.canon_id for r in canonical.canonical_units(units, vocab.limit(0)).collect()} == {0}
    report = {r.meant: r.n_units for r in canonical.unmatched_values(units, vocab).collect()}
    assert report["gate house"] == 6 and report[None] == 2


def test_candidates_may_begin_with_another_letter(spark):
    texts = ["gat house", "kaw crushers", "nal mill", "xtruck shop"]
    units = spark.createDataFrame([(t, None) for t in texts], "unit_type string, label string")
    vocab = spark.createDataFrame([(i, n, []) for i, n in ENTRIES], "canon_id int, canon_name string, alt_names array<string>")
    want = {}
    for t in texts:
        for i, n in ENTRIES[:9]:  # the last is folded, not typed so
            a, b = t.replace(" ", ""), n.replace(" ", "")
            if (d := damerau(a, b)) <= canonical.allowed(len(b)):
                want[t, i] = min(d, want.get((t, i), 9))
    assert ("gat house", 5) in want and ("kaw crushers", 1) in want and ("nal mill", 2) in want
    assert {(r.text, r.canon_id): r.distance for r in canonical.candidates(units, vocab).collect()} == want
    assert canonical.Trie(ENTRIES).match("gat house") is None  # not what it means


def test_candidates_are_all_entries_in_reach(spark):
    units = spark.createDataFrame([("bod mill", None), ("bod mill", None), ("n/a", "jaw crushr"), (None, None), ("truck shop", None)], "unit_type string, label string")
    vocab = spark.createDataFrame([(i, n, []) for i, n in ENTRIES[:4:2]] + [(3, "rod mill", ["mod mill"])], "canon_id int, canon_name string, alt_names array<string>")
    assert {tuple(r) for r in canonical.candidates(units, vocab).collect()} == {("bod mill", 3, 1), ("jaw crushr", 1, 1)} | ({("bod mill", 2, 2)} if damerau("bodmill", "ballmill") <= 2 else set())


# --- tokens --------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=tokens.load_ranks(), special_tokens={})


def odd_texts(n, seed):
    rnd = random.Random(seed)
    parts = ["a", "the", "  ", " ", "\n", "\t", " ", "é", "中文", "12", ".", "'s", "'LL", "!!", "\r\n", "   ", "\x1c", "\x85", "​", "<|endoftext|>", "😀", "‮", "Ω"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(n)]


def test_ids_match_the_public_encoder(spark, reference):
    texts = odd_texts(3000, 1) + [None, "", " ", "word " * 20_000, "x" * 50_000, " " * 1000 + "end", "a  b   c    ", "ab" * 3000]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in tokens.encode_corpus(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == reference.encode_ordinary(t or ""), repr(t)[:80]
    sizes = {r.doc_id: r.n_tokens for r in tokens.encode_corpus(df, count_only=True).collect()}
    assert sizes == {i: len(x) for i, x in got.items()}


def test_empty_corpus(spark):
    assert tokens.encode_corpus(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_transducer_is_minimal_and_exact():
    rnd = random.Random(2)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 9))).encode() for _ in range(300)} | {b"running", b"jumping", b"sing"})
    parts = tokens.build_transducer(words, {w: [len(w), i] for i, w in enumerate(words)})
    asked = [w.decode() for w in words] + ["", "zz", "ru", "runningg"]
    found = tokens.look_up(parts, pa.array(asked))
    assert list(found) == list(range(len(words))) + [-1] * 4
    states = defaultdict(list)
    for key, goal in zip(parts["key"], parts["goal"], strict=True):
        states[int(key) // 256].append((int(key) % 256, int(goal)))
    shapes = [(int(parts["final"][s]), tuple(states[s])) for s in range(len(parts["final"]))]
    assert len(set(shapes)) == len(shapes)  # no two states with the same future


def test_merge_of_long_pieces(reference):
    ranks = tokens.load_ranks()
    rnd = random.Random(3)
    for _ in range(50):
        piece = "".join(rnd.choice(string.ascii_lowercase) for _ in range(rnd.randint(1, 200)))
        assert tokens.merge(piece.encode(), ranks) == reference.encode_ordinary(piece)


# --- packing -----------------------------------------------------------------------------------------------------------


def check_packing(rows, sizes, capacity):
    used, pieces = Counter(), defaultdict(list)
    for r in rows:
        used[r.container_id] += r.n_tokens
        pieces[r.doc_id].append((r.piece, r.token_from, r.n_tokens))
    assert max(used.values(), default=0) <= capacity
    assert set(pieces) == {d for d, _, _ in sizes}
    for d, _, n in sizes:
        own = sorted(pieces[d])
        assert sum(x[2] for x in own) == (n or 0)
        assert len(own) == max(1, math.ceil((n or 0) / capacity))  # split only beyond the capacity
        assert [x[1] for x in own] == [i * capacity for i in range(len(own))]
    return used


@pytest.mark.parametrize("bucket", [10**9, 20_000])
def test_packing(spark, bucket):
    rnd = random.Random(7)
    sizes = [(i, rnd.choice(["a", "a", "a", "b", None]), rnd.choice([0, 5, 100, 400, 2048, 2049, 7000, rnd.randint(1, 900)])) for i in range(800)]
    df = spark.createDataFrame([(*s, 1) for s in sizes], "doc_id bigint, source string, n_tokens int, bucket int")
    rows = packing.pack_items(df, bucket_tokens=bucket, window_containers=8).collect()
    used = check_packing(rows, sizes, 2048)
    total = sum(n for _, _, n in sizes)
    assert total / (2048 * len(used)) > 0.93
    assert rows == packing.pack_items(df, bucket_tokens=bucket, window_containers=8).collect() or bucket < 10**9


def test_packing_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, source string, n_tokens int")
    assert packing.pack_items(df).count() == 0
    one = spark.createDataFrame([(1, None, None)], "doc_id bigint, source string, n_tokens int")
    assert [tuple(r)[:5] for r in packing.pack_items(one).collect()] == [(1, 0, 0, 0, 0)]


def test_mixture_follows_the_targets():
    n = 4000
    rows = packing.pack_bucket(list(range(n)), [64] * n, ["a" if i % 4 else "b" for i in range(n)], {}, {"a": 0.75, "b": 0.25}, 2048, 2048 * 8)
    by = defaultdict(Counter)
    for _, _, container, _, _, size, source in rows:
        by[container // 8][source] += size
    for window in list(by)[:-1]:
        assert abs(by[window]["b"] / sum(by[window].values()) - 0.25) < 0.02


def test_a_carried_deficit_is_paid_first():
    rows = packing.pack_bucket(list(range(200)), [100] * 200, ["a", "b"] * 100, {"b": 3000.0}, {"a": 0.5, "b": 0.5}, 2048, 2048)
    first = Counter(r[6] for r in rows[:50])
    assert first["b"] > first["a"]


def test_given_targets_hold_until_a_source_is_drained(spark):
    rnd = random.Random(3)
    sizes = [(i, "abc"[i % 3], rnd.randint(1, 300)) for i in range(3000)]
    df = spark.createDataFrame(sizes, "doc_id bigint, source string, n_tokens int")
    targets = {"a": 3.0, "b": 1.0}
    rows = packing.pack_items(df, window_containers=8, targets=targets).collect()
    check_packing(rows, sizes, 2048)
    by = defaultdict(Counter)
    for r in rows:
        by[r.window_id][r.source] += r.n_tokens
    both = [by[w] for w in sorted(by) if by[w]["a"] and not by[w]["c"]]
    assert len(both) > 8
    for mix in both[:-1]:
        assert abs(mix["a"] / sum(mix.values()) - 0.75) < 0.06
    want = {w: max(abs(m[s] / sum(m.values()) - t) for s, t in (("a", 0.75), ("b", 0.25), ("c", 0.0))) for w, m in by.items()}
    got = {r.window_id: r.deviation for r in packing.window_mixture(spark.createDataFrame(rows), targets).collect()}
    assert got == pytest.approx(want)


def test_items_without_tokens_are_spread_over_buckets(spark):
    df = spark.range(1000).selectExpr("id AS doc_id", "'a' AS source", "CAST(NULL AS INT) AS n_tokens")
    rows = packing.pack_items(df, bucket_items=100).collect()
    assert len(rows) == 1000 and len({r.container_id >> 32 for r in rows}) == 10


def test_audit_sees_what_is_wrong(spark):
    docs = spark.createDataFrame([(i,) for i in range(5)], "doc_id bigint")
    cols = "doc_id bigint, piece int, container_id bigint, window_id bigint, token_from bigint, n_tokens int, source string"
    good = [(0, 0, 0, 0, 0, 5, "a"), (1, 0, 0, 0, 0, 3, "a"), (2, 0, 1, 0, 0, 8, "a"), (2, 1, 0, 0, 8, 0, "a"), (3, 0, 2, 0, 0, 0, "a"), (4, 0, 2, 0, 0, 8, "a")]
    row = tuple(packing.packing_audit(spark.createDataFrame(good, cols), docs, 8).first())
    assert row == (5, 0, 1, 0, 0)  # item 2 has a piece more than it needs
    bad = [*good[:2], (2, 0, 0, 1, 0, 8, "a"), (3, 0, 2, 0, 0, 0, "a"), (9, 0, 2, 0, 0, 8, "a")]
    assert tuple(packing.packing_audit(spark.createDataFrame(bad, cols), docs, 8).first()) == (5, 2, 0, 1, 1)


# --- pages ----------------------------------------------------------------------------------------------------------------

PROSE = "The operator reported that the mill was stopped for two days because the liners had to be replaced. "


@pytest.mark.parametrize(
    ("text", "spam"),
    [
        (PROSE * 6, False),
        (PROSE * 3 + "See https://a.example/x for the report. " * 2 + PROSE * 3, False),
        (PROSE * 4 + "\nReferences\n[1] Smith, Mills, 2010. https://a.example/1\n[2] Jones, Pumps, 2011.", False),
        (PROSE * 4 + "\nTags: mill, pump, screen", False),
        ("1.1 recovery .......... 3\n1.2 recovery .......... 7\n2.1 recovery ......... 12\n3.1 grade ........ 20\n", False),
        ("mill | 302 | 50.5 | kW\npump | 12 | 7.5 | kW\nmill | 31 | 5.5 | kW\nmill | 30 | 9.1 | kW", False),
        ("Figure 3: section of the mill", False), ("", False), (None, False), (" \n ", False), ("word", False),
        ("cheap pump; " * 60, True), ("#pump #mill #screen #crusher #jig #filter " * 5, True),
        ("\n".join(f"https://shop{i}.example/p/{i}" for i in range(20)), True),
        ("\n".join(f"[pump {i}](http://a.example/{i}) | [mill {i}](http://b.example/{i})" for i in range(12)), True),
        (PROSE + "\n" + "jaw crusher price, jaw crusher cheap, jaw crusher sale, " * 30, True),
        ("Buy jig price and jig cheap and jig. Looking for jig? Jig in stock jig online. " * 5, True),
        ("from the ball mill by Karazo in ball mill or ball mill at ball mill for ball mill to ball mill " * 6, True),
    ],
)
def test_pages(text, spam):
    assert (pages.other_share(text) > pages.MAX_OTHER) == spam


KEYWORDS = ["насос мельница грохот дробилка", "αντλία μύλος κόσκινο σπαστήρας", "مضخة مطحنة غربال كسارة", "球磨机 配件 水泵 价格", "ポンプ 部品 価格 通販", "球磨机配件水泵价格", "ポンプ部品価格通販"]
SENTENCES = [
    "На участке {} содержание меди составило 4.11 % при крупности 334 мкм. ", "Το εργοστάσιο {} λειτουργεί από το 2011. ", "بلغت نسبة الاسترداد 79.8٪ في موقع {}. ",
    "{}选矿厂的回收率为95.53%，处理量为1325吨每小时。 ", "{}の浮選槽の回収率は90.5%で、2016年に更新された。 ",
]


@pytest.mark.parametrize("joint", [" ", "\n"])
def test_stuffed_pages_in_every_script(joint):
    for words in KEYWORDS:
        text = joint.join([words] * 200) if " " in words else words * 200
        assert pages.other_share(text) > pages.MAX_OTHER, words
    for sentence in SENTENCES:
        text = joint.join(sentence.format(name) for name in "Beldbruk Lomovale Miradal Toskdal Nevazo Irrmere Kolmepuro Oradal".split() * 3)
        assert pages.other_share(text) == 0.0, sentence


def test_pages_end_to_end(spark):
    rows = [(1, PROSE * 5, "x"), (2, "cheap pump; " * 60, "x"), (2, "cheap pump; " * 60, "x"), (3, None, "x"), (4, "pump " * 50_000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, other_share string")
    assert sorted(r.doc_id for r in pages.spam_pages(df).collect()) == [2, 4]
    assert pages.spam_pages(df.limit(0)).count() == 0


def test_weights_are_fitted_on_a_bounded_sample_in_any_language(spark):
    rnd = random.Random(4)
    wares, verbs = [f"ware{c}" for c in "abcdefghijklmnop"], [f"verbo{c}" for c in "abcdefghijklmnop"]
    prose = [" ".join(f"li {rnd.choice(verbs)} da {rnd.choice(verbs)} mu {rnd.choice(verbs)} os {rnd.choice(verbs)}." for _ in range(8)) for _ in range(150)]
    lists = [" | ".join(rnd.sample(wares, 12)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate([*prose, *lists, None, ""])), "doc_id bigint, text string").repartition(3)
    weights = pages.fit_weights(df)
    assert min(weights[v] for v in verbs) > 1 and max(weights[w] for w in wares) < -1
    assert weights == pages.fit_weights(df.repartition(7)) and len(weights) <= pages.FIT_TERMS
    assert 0 < len(pages.fit_weights(df, most=60)) <= len(weights)
    salad = " ".join(f"{rnd.choice(['da', 'os'])} {' '.join(rnd.sample(wares, 2))}{'.' if i % 5 == 4 else ''}" for i in range(20))  # little words between wares
    assert pages.other_share(salad) <= pages.MAX_OTHER < pages.other_share(salad, weights)
    assert pages.other_share(prose[0], weights) == 0.0
    assert pages.fit_weights(spark.createDataFrame([(i, PROSE * 5) for i in range(9)], "doc_id bigint, text string")) == {}  # nothing to tell apart


def test_weights_are_fitted_on_every_document(spark):
    texts = [f"the pump of line {i % 7} is at the mill and it runs to the end of the day" if i % 3 else f"cheap pumps | best pumps | buy mill{'s' * (i % 5)} | pump sale | top deals" for i in range(9000)]
    told, other = Counter(), Counter()
    for t in texts:
        pages.count_terms(t, told, other)
    got = pages.fit_weights(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    assert sum(told.values()) and sum(other.values())
    assert got == pytest.approx(pages.fitted([(w, told[w], other[w]) for w in told | other]))


def test_words_of_a_unit_are_what_the_pattern_finds():
    rnd = random.Random(8)
    for _ in range(3000):
        unit = "".join(rnd.choice("aBz_1 .,|#\t-0=\x1c\x7f" + "é²½٣中ßÀ" * (rnd.random() < 0.5)) for _ in range(rnd.randint(0, 60)))
        assert pages.words_of(unit) == pages._WORD.findall(unit.lower())


def test_only_units_that_are_no_plain_sentences_are_scored_one_by_one(monkeypatch):
    scored, emission = [], pages.emission
    monkeypatch.setattr(pages, "emission", lambda unit, *rest: scored.append(unit) or emission(unit, *rest))
    assert pages.other_share(PROSE * 9 + "\nmill | pump\n" + "Die Mühle läuft an der Linie und es ist in der Nacht so. " * 3) == 0.0
    assert scored == ["mill | pump"]


def test_units_measured_at_once_are_what_each_is_alone(monkeypatch):
    rnd = random.Random(5)
    parts = ["the mill", "of a", "cheap;", "pumps,", "a-b", "x - y", "\t–\t", "....", "..", "#1", "3.5", "a_1", "m²", "насос", "球磨机", "ÀİΣ", "𐐀𠀀", "é", "http://a.example/x", "\n", "\n", ". ", "• » /", "12 14 15 17", "\u200b"]
    texts = ["".join(rnd.choice(parts) + " " * rnd.randint(0, 2) for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    units = [u for t in texts for u in pages.line_units(t)]
    words, ends, found = pages.measured(units)
    for u, a, b, f in zip(units, [0, *ends[:-1]], ends, found, strict=True):
        own = pages._WORD.findall(u.lower())
        assert words[a:b] == own
        assert (f[0], f[2], f[3] > 0, f[4]) == (sum(len(w) <= pages.SHORT for w in own), u.count(","), bool(pages._MARKED(u)), len(re.findall(r"[\d_]+", u)))
        assert f[1] == len(pages._SEPARATOR.findall(u)) or (f[1] == -1 and re.search(r"\s[-–—]", u))
    weights = {w: rnd.randint(-9, 9) / 4 for w in sorted(set(words))[::2]}
    together = [list(pages.labelled(texts, fitted)) for fitted in (None, weights)]
    assert together == [[next(pages.labelled([t], fitted)) for t in texts] for fitted in (None, weights)]
    monkeypatch.setattr(pages, "SLICE_UNITS", 7)
    monkeypatch.setattr(pages, "SLICE_CHARS", 900)
    assert together == [list(pages.labelled(texts, fitted)) for fitted in (None, weights)]
    ascii_units = [u for u in units if u.isascii()]
    words, ends, _ = pages.measured(ascii_units)
    assert pages.weigh_all(words, ends, weights).tolist() == [pages.weigh(u, words[a:b], weights) for u, a, b in zip(ascii_units, [0, *ends[:-1]], ends, strict=True)]


def test_labels_of_lines():
    units, labels = pages.label_units(PROSE + "\n" + PROSE + "\n" + "\n".join(f"http://a{i}.example/p" for i in range(9)))
    assert labels[:2] == [pages.PROSE] * 2 and labels[-9:] == [pages.LINKS] * 9 and len(units) == len(labels)


def test_registered_queries_have_the_stated_columns(spark, sf):
    from oreloom.llm.queries import queries

    want = {"p2_found": ["list_name", "stage_a", "stage_b"], "p6_found": ["unit_rid", "canon_id"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id"]}
    for name, columns in want.items():
        df = queries()[name](spark, sf)
        assert df.columns == columns and df.count() == df.distinct().count()
    assert F.col("x") is not None
