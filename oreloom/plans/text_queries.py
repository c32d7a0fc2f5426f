"""Queries of the scalar functions, predicates and table shapes (F*, T*, R*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreloom.functions import text as T
from oreloom.functions.register import register_functions
from oreloom.operators import corpus as C
from oreloom.operators import joins as J
from oreloom.operators.classify import domain_keyword_counts, keyword_classes
from oreloom.plans.base import LATEST, latest_predictions
from oreloom.plans.registry import query
from oreloom.session import table

_R = lambda c, d=6: F.round(c, d).alias(c)
_DOCS = "(SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL) d"


def _docs(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text", *more).filter("text IS NOT NULL")


@query("SELECT unit_rid, label FROM flow_units WHERE unit_type = 'jaw crusher' AND cells = 1")
def f1_equality(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "flow_units").filter("unit_type = 'jaw crusher' AND cells = 1").select("unit_rid", "label")


@query("SELECT DISTINCT table_id, section_number, page_number, table_index FROM extracted_tables WHERE starts_with(section_number, '1')")
def f2_prefix(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "extracted_tables").filter(F.col("section_number").startswith("1"))
    return rows.select("table_id", "section_number", "page_number", "table_index").distinct().orderBy("page_number", "table_index", "table_id")


_COUNTS = " UNION ALL ".join(
    f"SELECT doc_id, '{m}' AS class, (" + " + ".join(f"len(regexp_extract_all(text, '{T.mineral_pattern(x)}'))" for x in names) + ")::INT AS n FROM documents WHERE text IS NOT NULL"
    for m, names in T.MINERAL_PATTERNS.items()
)


def _class_counts(spark: SparkSession, sf: str) -> DataFrame:
    return keyword_classes(_docs(spark, sf), "doc_id", "text").select("doc_id", "class", F.col("n").cast("int").alias("n"))


@query(f"SELECT * FROM ({_COUNTS}) WHERE n > 0")
def f3_keyword_classes(spark: SparkSession, sf: str) -> DataFrame:
    return _class_counts(spark, sf)


@query("SELECT table_id, bool_or((contains(lower(caption), 'table') OR contains(lower(caption), 'figure')) AND (contains(lower(caption), 'inventory') OR contains(lower(caption), 'plan'))) AS hit FROM extracted_tables WHERE caption IS NOT NULL GROUP BY 1")
def f4_caption(spark: SparkSession, sf: str) -> DataFrame:
    hit = T.contains_both(F.col("caption"), ["table", "figure"], ["inventory", "plan"])
    return table(spark, sf, "extracted_tables").filter("caption IS NOT NULL").groupBy("table_id").agg(F.bool_or(hit).alias("hit"))


_NUM = "try_cast(replace(replace(replace(trim(v), ',', ''), '%', ''), '$', '') AS DOUBLE)"


@query(f"SELECT DISTINCT feature_id, x FROM (SELECT feature_id, {_NUM} AS x FROM (SELECT feature_id, unnest(grade_values) AS v FROM doc_features)) WHERE x BETWEEN 0.01 AND 100")
def f5_bounded_number(spark: SparkSession, sf: str) -> DataFrame:
    values = table(spark, sf, "doc_features").select("feature_id", F.explode("grade_values").alias("v"))
    return values.select("feature_id", T.bounded(T.parse_number(F.col("v")), 0.01, 100).alias("x")).filter("x IS NOT NULL").distinct()


@query(r"SELECT DISTINCT feature_id, try_cast(nullif(regexp_extract(tonnage_mean, '(\d+\.?\d*)', 1), '') AS DOUBLE) AS x FROM doc_features")
def f6_first_number(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "doc_features").select("feature_id", T.first_number(F.col("tonnage_mean")).alias("x")).distinct()


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    """(table_id, col, header, row, value) of distinct tables, rows located by position."""
    tables = table(spark, sf, "extracted_tables").select("table_id", "headers", "cell_rows").distinct()
    heads = tables.select("table_id", "cell_rows", F.posexplode("headers").alias("col", "header"))
    return heads.select("table_id", "col", "header", F.posexplode(F.transform("cell_rows", lambda r: F.get(r, F.col("col")))).alias("row", "value"))


_CELLS = "h AS (SELECT table_id, cell_rows, unnest(headers) AS header, generate_subscripts(headers, 1) - 1 AS col FROM (SELECT DISTINCT table_id, headers, cell_rows FROM extracted_tables)), c AS (SELECT table_id, col, header, v FROM (SELECT table_id, col, header, unnest(list_transform(cell_rows, lambda r: r[col + 1])) AS v FROM h))"


@query(
    f"WITH {_CELLS}, n AS (SELECT *, {_NUM} AS x FROM c) SELECT 'grade_cu' AS name, count(*) AS n, round(min(x), 3) AS lo, round(max(x), 3) AS hi FROM n WHERE regexp_matches(lower(header), '\\bcu\\b|\\bcopper\\b') AND x BETWEEN 0.01 AND 10"
    " UNION ALL SELECT 'tonnage', count(*), round(min(x), 3), round(max(x), 3) FROM n WHERE regexp_matches(lower(header), '\\btonn[a-z]*\\b|\\btons\\b|\\bmt\\b') AND x BETWEEN 0.001 AND 1e9"
    " UNION ALL SELECT 'capex', count(*), round(min(x), 3), round(max(x), 3) FROM n WHERE regexp_matches(lower(header), '\\bcapex\\b|\\bcapital\\s*cost') AND x BETWEEN 0 AND 1e12"
)
def f7_named_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Columns picked by header pattern (a header may match several), cells validated by bounds."""
    names = {k: T.COLUMN_PATTERNS[k] for k in ("grade_cu", "tonnage", "capex")}
    dim = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(lo).cast("double").alias("lo"), F.lit(hi).cast("double").alias("hi"), F.col("header").rlike(p).alias("hit")) for k, (p, lo, hi) in names.items()])
    cells = _cells(spark, sf).select(T.parse_number(F.col("value")).alias("x"), F.inline(F.filter(dim, lambda d: d["hit"])))
    kept = cells.filter("x BETWEEN lo AND hi")
    return kept.groupBy("name").agg(F.count("*").alias("n"), F.round(F.min("x"), 3).alias("lo"), F.round(F.max("x"), 3).alias("hi"))


@query(f"WITH {_CELLS}, n AS (SELECT *, {_NUM} AS x FROM c) SELECT table_id, round(avg(x), 5) AS grade FROM n WHERE regexp_matches(lower(header), 'cu|copper') AND NOT regexp_matches(lower(header), 'ppm|g/t|dist|rec|ratio') AND x BETWEEN 0.15 AND 3 GROUP BY 1")
def f8_grade_columns(spark: SparkSession, sf: str) -> DataFrame:
    h = F.lower("header")
    cells = _cells(spark, sf).filter(h.rlike("cu|copper") & ~h.rlike("ppm|g/t|dist|rec|ratio"))
    kept = cells.select("table_id", T.bounded(T.parse_number(F.col("value")), 0.15, 3.0).alias("x")).filter("x IS NOT NULL")
    return kept.groupBy("table_id").agg(F.round(F.avg("x"), 5).alias("grade"))


@query(
    "WITH t AS (SELECT DISTINCT table_id, headers, cell_rows, caption FROM extracted_tables) SELECT DISTINCT table_id, CASE WHEN len(list_filter(headers, lambda h: contains(lower(h), 'cu'))) > 0 THEN 'column' WHEN len(list_filter(cell_rows, lambda r: contains(lower(r[1]), 'cu'))) > 0 THEN 'row' WHEN contains(lower(caption), 'inventory') THEN 'context' ELSE 'none' END AS branch FROM t"
)
def f9_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Which of three ways finds a table's values: a column, else rows by their first cell, else the context text."""
    has = lambda c: F.coalesce(F.contains(F.lower(c), F.lit("cu")), F.lit(False))
    branch = (
        F.when(F.exists("headers", has), "column").when(F.exists("cell_rows", lambda r: has(F.get(r, F.lit(0)))), "row")
        .when(F.contains(F.lower("caption"), F.lit("inventory")), "context").otherwise("none")
    )
    return table(spark, sf, "extracted_tables").select("table_id", branch.alias("branch")).distinct()


@query(f"WITH n AS (SELECT * FROM ({_COUNTS}) WHERE n > 0), p AS (SELECT *, round(100.0 * n / sum(n) OVER (PARTITION BY doc_id), 1) AS pct FROM n) SELECT doc_id, class, n, pct FROM p WHERE pct >= 5")
def f10_relevant_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Share rounded to one decimal before it is compared."""
    return C.share_of_total(_class_counts(spark, sf), "doc_id", "class", "n").filter("pct >= 5").drop("primary")


@query("WITH m AS (SELECT DISTINCT table_id, min(caption) AS caption FROM extracted_tables GROUP BY 1), f AS (SELECT DISTINCT feature_id, table_id FROM doc_features) SELECT CASE WHEN m.table_id IS NULL THEN 'missing' WHEN contains(lower(caption), 'inventory') THEN 'accepted' ELSE 'skipped' END AS route, count(*) AS n FROM f LEFT JOIN m ON m.table_id = f.table_id GROUP BY 1")
def f11_routing(spark: SparkSession, sf: str) -> DataFrame:
    manifest = table(spark, sf, "extracted_tables").groupBy("table_id").agg(F.min("caption").alias("caption")).withColumn("known", F.lit(True))
    files = table(spark, sf, "doc_features").select("feature_id", "table_id").distinct()
    route = F.when(F.col("known").isNull(), "missing").when(F.contains(F.lower("caption"), F.lit("inventory")), "accepted").otherwise("skipped")
    return files.join(manifest, "table_id", "left").groupBy(route.alias("route")).agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, s_name, regexp_matches(' ' || lower(s_name) || ' ', '[^a-z]supplier[^a-z]') AS hit FROM supplier")
def f12_whole_word(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select("s_suppkey", "s_name", T.has_word(F.col("s_name"), "supplier").alias("hit"))


@query("SELECT DISTINCT feature_id FROM doc_features WHERE len(list_filter(grade_values, lambda v: v IS NULL OR trim(v) = '')) > 0")
def f13_exists(spark: SparkSession, sf: str) -> DataFrame:
    empty = F.exists("grade_values", lambda v: v.isNull() | (F.trim(v) == ""))
    return table(spark, sf, "doc_features").filter(empty).select("feature_id").distinct()


@query("SELECT CASE WHEN o_totalprice IS NULL THEN 'missing' WHEN o_totalprice < 50000 THEN 'too_low' WHEN o_totalprice > 300000 THEN 'too_high' ELSE 'kept' END AS reason, count(*) AS n FROM orders GROUP BY 1")
def f14_window_counts(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("o_totalprice")
    reason = F.when(p.isNull(), "missing").when(p < 50000, "too_low").when(p > 300000, "too_high").otherwise("kept")
    return table(spark, sf, "orders").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("WITH u AS (SELECT image_id, count(*) AS nu FROM flow_units GROUP BY 1), c AS (SELECT image_id, count(*) AS nc FROM flow_connections GROUP BY 1), s AS (SELECT image_id, count(*) AS ns FROM flow_stages GROUP BY 1) SELECT CASE WHEN s.ns IS NULL THEN 'no_stages' WHEN c.nc IS NULL THEN 'disconnected' WHEN nu > 3 * nc THEN 'sparse' ELSE 'sound' END AS bucket, count(*) AS n FROM u LEFT JOIN c USING (image_id) LEFT JOIN s USING (image_id) GROUP BY 1")
def f15_audit(spark: SparkSession, sf: str) -> DataFrame:
    per = lambda t, n: table(spark, sf, t).groupBy("image_id").agg(F.count("*").alias(n))
    joined = per("flow_units", "nu").join(per("flow_connections", "nc"), "image_id", "left").join(per("flow_stages", "ns"), "image_id", "left")
    bucket = F.when(F.col("ns").isNull(), "no_stages").when(F.col("nc").isNull(), "disconnected").when(F.col("nu") > 3 * F.col("nc"), "sparse").otherwise("sound")
    return joined.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query(
    "SELECT doc_id, length(array_to_string(list_filter(string_split(text, E'\\n'), lambda l: NOT regexp_matches(l, '(?i)\\.{4,}|^\\s*(?:table|figure)\\s+\\d+[-.]\\d+|^\\s*\\d+(?:\\.\\d+)*\\s+\\S|^.{0,80}?\\s\\d{1,3}\\s*$')), E'\\n'))::INT AS n_left"
    " FROM documents WHERE text IS NOT NULL"
)
def f16_contents_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.length(T.strip_contents_lines(F.col("text"))).alias("n_left"))


@query("WITH l AS (SELECT DISTINCT doc_id, source, trim(unnest(string_split(text, E'\\n'))) AS line FROM documents WHERE text IS NOT NULL) SELECT source, line, count(*) AS n FROM l WHERE length(line) BETWEEN 15 AND 160 GROUP BY 1, 2 HAVING count(*) >= 3")
def f17_running_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines repeated over at least three pages of a source, each counted once per page."""
    lines = _docs(spark, sf, "source").select("doc_id", "source", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), F.trim))).alias("line"))
    kept = lines.filter(F.length("line").between(15, 160))
    return kept.groupBy("source", "line").agg(F.count("*").alias("n")).filter("n >= 3")


@query("SELECT DISTINCT table_id FROM extracted_tables WHERE contains(lower(array_to_string(headers, ' ')), 'grade') OR contains(lower(caption), 'grade') OR len(list_filter(cell_rows, lambda r: contains(lower(r[1]), 'grade'))) > 0")
def f18_table_filter(spark: SparkSession, sf: str) -> DataFrame:
    has = lambda c: F.coalesce(F.contains(F.lower(c), F.lit("grade")), F.lit(False))
    hit = has(F.array_join("headers", " ")) | has(F.col("caption")) | F.coalesce(F.exists("cell_rows", lambda r: has(F.get(r, F.lit(0)))), F.lit(False))
    return table(spark, sf, "extracted_tables").filter(hit).select("table_id").distinct()


@query("SELECT 'p_retailprice' AS feature, round(var_pop(p_retailprice), 4) AS variance FROM part UNION ALL SELECT 'p_size', round(var_pop(p_size), 4) FROM part")
def f19_variance_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Population variance per feature; features at or below the threshold are left out."""
    row = table(spark, sf, "part").agg(*[F.round(F.var_pop(c), 4).alias(c) for c in ("p_size", "p_retailprice")])
    return row.unpivot([], ["p_size", "p_retailprice"], "feature", "variance").filter("variance > 0.0")


@query("SELECT p_partkey, p_size::BIGINT * 1024 AS kb FROM part")
def f20_size_kb(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", T.size_kb(F.concat(F.col("p_size").cast("string"), F.lit(" MB"))).alias("kb"))


@query("SELECT p_partkey, lower(regexp_replace(regexp_replace(p_name || '_' || p_brand, '[^A-Za-z0-9.\\-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g')) AS name FROM part")
def f21_safe_filename(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", T.safe_filename(F.col("p_name"), F.col("p_brand")).alias("name"))


_IDS = (
    "base AS (SELECT raw, regexp_replace(regexp_replace(regexp_replace(lower(trim(raw)), '_unit$', ''), '_\\d+$', ''), '_[a-b]$', '') AS low FROM raws),"
    f" words AS (SELECT raw, low, list_filter(string_split(low, '_'), lambda t: t NOT IN ({', '.join(repr(w) for w in T.ID_REMOVABLE)})) AS ws FROM base),"
    " syn AS (SELECT MAP {" + ", ".join(f"{k!r}: {'NULL' if v is None else repr(v)}" for k, v in T.ID_SYNONYMS.items()) + "} AS m),"
    " mapped AS (SELECT raw, low, ws, list_filter(list_transform(ws, lambda t: CASE WHEN map_contains(m, t) THEN m[t] ELSE t END), lambda t: t IS NOT NULL) AS ms FROM words, syn),"
    f" ids AS (SELECT raw, CASE WHEN len(ws) = 0 THEN low WHEN len(ms) = 0 THEN array_to_string(ws, '_') ELSE coalesce(list_filter([{', '.join(repr(g) for g in T.ID_GROUPS)}], lambda g: list_contains(ms, g))[1], array_to_string(ms, '_')) END AS grp FROM mapped)"
)


@query(f'WITH raws AS (SELECT DISTINCT unnest(xgb_stages) AS raw FROM test_predictions), {_IDS} SELECT raw, grp AS "group" FROM ids WHERE raw IS NOT NULL')
def t1_normalise_id(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "test_predictions").select(F.explode("xgb_stages").alias("raw")).filter("raw IS NOT NULL").distinct()
    return raw.select("raw", T.normalise_id(F.trim("raw")).alias("group"))


@query(f'WITH {LATEST}, pairs AS (SELECT doc, unnest(ground_truth) AS raw FROM latest), raws AS (SELECT DISTINCT raw FROM pairs WHERE raw IS NOT NULL), {_IDS} SELECT grp AS "group", count(DISTINCT doc) AS n_docs FROM pairs JOIN ids USING (raw) GROUP BY 1')
def t2_group_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Stage names of documents mapped to groups (null names are noise), counted."""
    raw = latest_predictions(spark, sf).select("doc", F.explode("ground_truth").alias("raw")).filter("raw IS NOT NULL")
    return raw.groupBy(T.normalise_id(F.trim("raw")).alias("group")).agg(F.count_distinct("doc").alias("n_docs"))


@query(f"SELECT doc_id, len(list_filter(list_transform(string_split(text, E'\\n\\n'), lambda p: trim(p, E' \t\n\r\f')), lambda p: len(string_split_regex(p, '[ \\t\\n\\r\\f]+')) > 1))::INT AS n FROM {_DOCS}")
def t6_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.size(T.paragraphs(F.col("text"))).alias("n"))


_DOMAIN = ", ".join(f"('{g}', '{k}')" for g, ks in T.DOMAIN_KEYWORDS.items() for k in ks)


@query(
    f"SELECT doc_id, grp, keyword, len(regexp_extract_all(lower(text), replace(keyword, '_', '[_ ]')))::INT AS n FROM {_DOCS}, (VALUES {_DOMAIN}) AS k(grp, keyword) "
    "WHERE regexp_matches(lower(text), replace(keyword, '_', '[_ ]'))"
)
def t7_keyword_counts(spark: SparkSession, sf: str) -> DataFrame:
    return domain_keyword_counts(_docs(spark, sf), "doc_id", "text")


@query("SELECT DISTINCT table_id, trim(coalesce(caption, '') || ' | ' || coalesce(array_to_string(headers, ' '), '') || ' | ' || coalesce(array_to_string(flatten(cell_rows[1:5]), ' '), '')) AS s FROM extracted_tables")
def t8_serialize_table(spark: SparkSession, sf: str) -> DataFrame:
    s = T.serialize_table(F.col("caption"), F.col("headers"), F.col("cell_rows"))
    return table(spark, sf, "extracted_tables").select("table_id", s.alias("s")).distinct()


@query(r"SELECT DISTINCT table_id, nullif(regexp_extract(caption, '(?i)(?:table|tabla|tableau)\s+(\d+[-.]\d+)', 1), '') AS num FROM extracted_tables")
def t9_table_number(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "extracted_tables").select("table_id", T.table_number(F.col("caption")).alias("num")).distinct()


# Five shapes each of file names and sentences: dated, dated in capitals, dated later or across a line or too far, undated.
_NAMES = "CASE o_orderkey % 5 WHEN 0 THEN 'report_' || lower(strftime(d, '%-d_%b_%Y')) || '_10_36.pdf' WHEN 1 THEN 'R_' || upper(strftime(d, '%-d_%b_%Y')) || '.PDF' WHEN 2 THEN 'report_' || strftime(d, '%Y') || '.pdf' WHEN 3 THEN 'a_1_foo_1999_' || lower(strftime(d, '%-d_%b_%Y')) ELSE NULL END"
_SAID = "CASE o_orderkey % 5 WHEN 0 THEN 'The effective date of this report is ' || strftime(d, '%-d %B %Y') || '.' WHEN 1 THEN 'EFFECTIVE  DATE: ' || strftime(d, '%Y-%m-%d') || ' (filed 2031)' WHEN 2 THEN 'effective date ' || repeat('x', 70) || strftime(d, '%Y') WHEN 3 THEN 'Effective date' || chr(10) || strftime(d, '%Y') ELSE 'dated ' || strftime(d, '%Y') END"


@query(
    f"WITH s AS (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders), t AS (SELECT o_orderkey, d, {_NAMES} AS f, {_SAID} AS e FROM s)"
    " SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 1, 3) AND len(f) > 0 THEN year(d)::INT END AS filed, CASE WHEN position('date' IN lower(e)) > 0 AND o_orderkey % 5 < 2 THEN year(d)::INT END AS effective FROM t"
)
def t10_years(spark: SparkSession, sf: str) -> DataFrame:
    """Years out of file names and sentences of several shapes, three of five without one that counts."""
    k, d = F.col("o_orderkey") % 5, F.col("o_orderdate").cast("date")
    short, year = F.date_format(d, "d_MMM_yyyy"), F.date_format(d, "yyyy")
    named = F.when(k == 0, F.concat(F.lit("report_"), F.lower(short), F.lit("_10_36.pdf"))).when(k == 1, F.concat(F.lit("R_"), F.upper(short), F.lit(".PDF")))
    named = named.when(k == 2, F.concat(F.lit("report_"), year, F.lit(".pdf"))).when(k == 3, F.concat(F.lit("a_1_foo_1999_"), F.lower(short)))
    said = F.when(k == 0, F.concat(F.lit("The effective date of this report is "), F.date_format(d, "d MMMM yyyy"), F.lit("."))).when(k == 1, F.concat(F.lit("EFFECTIVE  DATE: "), d.cast("string"), F.lit(" (filed 2031)")))
    said = said.when(k == 2, F.concat(F.lit("effective date " + "x" * 70), year)).when(k == 3, F.concat(F.lit("Effective date\n"), year)).otherwise(F.concat(F.lit("dated "), year))
    return table(spark, sf, "orders").select("o_orderkey", T.filing_year(named).alias("filed"), T.effective_year(said).alias("effective"))


# Titles that a report's pages may bear, and what each counts for; written in one word, the last is both a PFS and an FS to the fixed patterns.
_TITLES = ("Pre-Feasibility Study", "Feasibility Study", "Preliminary Economic Assessment", "Scoping Study", "Mineral Resource Estimate", "Annual Report", "PREFEASIBILITY STUDY update")
_COUNTS_FOR = ("PFS", "FS", "PEA", "PEA", "MRE", "TR", "PFS")


@query(
    f"WITH k AS (SELECT * FROM (VALUES {', '.join(f'({i}, {chr(39)}{c}{chr(39)})' for i, c in enumerate(_COUNTS_FOR))}) AS t(i, c)), p AS (SELECT p_partkey, unnest([p_size % 7, p_partkey % 7, (p_size + p_partkey) % 7]) AS i FROM part),"
    " v AS (SELECT p_partkey, count(*) FILTER (c = 'FS' OR i = 6) AS f, count(*) FILTER (c = 'PFS') AS p, count(*) FILTER (c = 'PEA') AS e, count(*) FILTER (c = 'MRE') AS m FROM p JOIN k USING (i) GROUP BY 1)"
    " SELECT p_partkey, CASE WHEN f + p + e > 0 THEN CASE WHEN f >= p AND f >= e THEN 'FS' WHEN p >= e THEN 'PFS' ELSE 'PEA' END WHEN m > 0 THEN 'MRE' ELSE 'TR' END AS study FROM v"
)
def t11_study_type(spark: SparkSession, sf: str) -> DataFrame:
    """The vote over three titles of each row, every mixture of kinds among them."""
    titles = F.array(*[F.lit(t) for t in _TITLES])
    picks = F.array(*[F.get(titles, x.cast("int")) for x in (F.col("p_size") % 7, F.col("p_partkey") % 7, (F.col("p_size") + F.col("p_partkey")) % 7)])
    return table(spark, sf, "part").select("p_partkey", T.study_type(picks).alias("study"))


@query(
    "WITH h AS (SELECT DISTINCT unnest(headers) AS h FROM extracted_tables), b AS (SELECT h FROM h WHERE h IS NOT NULL UNION SELECT reverse(h) FROM h WHERE h IS NOT NULL), f AS (SELECT h, trim(regexp_replace(h, '\\s+', ' ', 'g')) AS flat FROM b)"
    " SELECT h, CASE WHEN len(list_intersect(string_split_regex(lower(flat), '[^a-z0-9_]+'), w)) = 0 AND len(list_intersect(string_split_regex(lower(reverse(flat)), '[^a-z0-9_]+'), w)) > 0 THEN reverse(flat) ELSE flat END AS clean"
    " FROM f, (SELECT ['grade', 'recovery', 'tonnage', 'total', 'sample', 'depth', 'zone', 'mass', 'cost'] AS w)"
)
def t12_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Every header as it stands and turned round."""
    heads = table(spark, sf, "extracted_tables").select(F.explode("headers").alias("h")).filter("h IS NOT NULL").distinct()
    both = heads.unionByName(heads.select(F.reverse("h").alias("h"))).distinct()
    return both.select("h", T.clean_header(F.col("h")).alias("clean"))


@query("SELECT event_id, props AS json FROM events")
def t13_unfence(spark: SparkSession, sf: str) -> DataFrame:
    fenced = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```"))
    return table(spark, sf, "events").select("event_id", T.unfence_json(fenced).alias("json"))


@query(f"SELECT doc_id, sha256(text) AS id FROM {_DOCS}")
def t14_content_id(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", T.content_id(F.col("text")).alias("id"))


@query("SELECT c_custkey, round(sign(c_acctbal) * ln(1 + abs(c_acctbal)), 6) AS y FROM customer")
def t16_signed_log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", F.round(T.signed_log(F.col("c_acctbal")), 6).alias("y"))


@query("SELECT p_partkey, round(round(ln(1 + p_size) / ln(1.8) + ln(1 + length(p_name)) / ln(1.8), 4), 3) AS w FROM part")
def t17_log_weight(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.round(T.log_weight(F.col("p_size"), F.length("p_name")), 3).alias("w"))


@query(f"WITH k AS (SELECT doc_id, len(regexp_extract_all(lower(text), 'flotation')) * 1000.0 / length(text) AS d FROM {_DOCS} WHERE length(text) > 0) SELECT doc_id, round(d / (SELECT max(d) FROM k), 6) AS density FROM k")
def t18_density(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword density per 1,000 characters, scaled by the corpus maximum (one number, found first)."""
    d = _docs(spark, sf).filter("length(text) > 0").select("doc_id", (T.keyword_count(F.col("text"), "flotation") * 1000.0 / F.length("text")).alias("d"))
    top = d.agg(F.max("d")).first()[0] or 1.0
    return d.select("doc_id", F.round(F.col("d") / F.lit(top), 6).alias("density"))


@query("SELECT p_partkey, p_brand || '/' || p_type || '/' || p_size AS label FROM part")
def t19_label(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.concat_ws("/", "p_brand", "p_type", "p_size").alias("label"))


@query(
    "WITH t AS (SELECT DISTINCT table_id, cell_rows FROM extracted_tables), w AS (SELECT table_id, cell_rows, list_max(list_transform(cell_rows, lambda r: len(r))) AS w FROM t)"
    " SELECT table_id, len(cell_rows)::INT AS n_rows, coalesce(len(list_filter(range(w), lambda i: len(list_filter(cell_rows, lambda r: trim(coalesce(r[i + 1], '')) <> '')) > 0)), 0)::INT AS n_columns FROM w"
)
def r3_drop_empty_columns(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "extracted_tables").select("table_id", "cell_rows").distinct()
    kept = T.drop_empty_columns(F.col("cell_rows"))
    return rows.select("table_id", F.size("cell_rows").alias("n_rows"), F.coalesce(F.size(F.get(kept, F.lit(0))), F.lit(0)).alias("n_columns"))


_GROUP_CASE = "CASE try_cast(trim(section_number) AS INT) " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in T.SECTION_GROUPS.items()) + " END"


@query(f"SELECT document_id, g AS section, count(*) AS n_tables FROM (SELECT DISTINCT table_id, document_id, {_GROUP_CASE} AS g FROM extracted_tables) WHERE g IS NOT NULL GROUP BY 1, 2")
def r5_section_groups(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "extracted_tables").select("table_id", "document_id", T.section_group(F.col("section_number")).alias("section")).distinct()
    return rows.filter("section IS NOT NULL").groupBy("document_id", "section").agg(F.count("*").alias("n_tables"))


@query("SELECT p_partkey, coalesce(nullif(p_size - 25, 0), nullif(length(p_name), 0), 0)::INT AS v FROM part")
def r6_fallback_chain(spark: SparkSession, sf: str) -> DataFrame:
    """First non-zero value of an ordered chain; zero counts as missing."""
    zero_is_null = lambda c: F.nullif(c, F.lit(0))
    return table(spark, sf, "part").select("p_partkey", F.coalesce(zero_is_null(F.col("p_size") - 25), zero_is_null(F.length("p_name")), F.lit(0)).cast("int").alias("v"))


@query(
    "SELECT document_id, "
    + ", ".join(f"count(*) FILTER (section_group = '{s}') AS {s}" for s in ("economics", "geology", "summary"))
    + " FROM (SELECT DISTINCT * FROM doc_features) GROUP BY 1"
)
def r7_flatten_document(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed-width vector per document: pivot with a stated list, one shuffle."""
    names = ["economics", "geology", "summary"]
    rows = table(spark, sf, "doc_features").distinct()
    return rows.groupBy("document_id").agg(*[F.count_if(F.col("section_group") == s).alias(s) for s in names])


@query(f"WITH {LATEST}, v AS (SELECT doc, unnest(xgb_stages) AS s FROM latest) SELECT doc, max((s = 'jaw_crusher')::INT) AS jaw, max((contains(s, 'mill'))::INT) AS mill FROM v GROUP BY 1")
def r8_multi_hot(spark: SparkSession, sf: str) -> DataFrame:
    rows = latest_predictions(spark, sf).select("doc", F.explode("xgb_stages").alias("s"))
    return rows.groupBy("doc").agg(F.max((F.col("s") == "jaw_crusher").cast("int")).alias("jaw"), F.max(F.contains(F.col("s"), F.lit("mill")).cast("int")).alias("mill"))


@query("WITH s AS (SELECT document_id, image_id, count(*) AS n, bool_or(contains(lower(unit_type), 'flotation')) AS f FROM flow_units GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY coalesce(f, false) DESC, n DESC, image_id) AS rn FROM s) SELECT document_id, image_id, n FROM r WHERE rn = 1")
def r9_primary_flowsheet(spark: SparkSession, sf: str) -> DataFrame:
    """Of a document's flowsheets one with flotation, then the largest, then the first id."""
    sheets = table(spark, sf, "flow_units").groupBy("document_id", "image_id").agg(
        F.count("*").alias("n"), F.coalesce(F.bool_or(F.contains(F.lower("unit_type"), F.lit("flotation"))), F.lit(False)).alias("f")
    )
    best = F.min(F.struct((~F.col("f")).alias("f"), (-F.col("n")).alias("m"), "image_id")).alias("b")
    return sheets.groupBy("document_id").agg(best).select("document_id", "b.image_id", (-F.col("b.m")).alias("n"))


@query(f"WITH {LATEST} SELECT doc, round(len(list_intersect(g, x)) / len(list_distinct(list_concat(g, x))), 6) AS jaccard FROM (SELECT doc, list_distinct(list_filter(ground_truth, lambda v: v IS NOT NULL)) AS g, list_distinct(list_filter(xgb_stages, lambda v: v IS NOT NULL)) AS x FROM latest) WHERE len(g) > 0 AND len(x) > 0")
def r10_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    rows = latest_predictions(spark, sf).select("doc", *[F.array_distinct(F.array_compact(c)).alias(c) for c in ("ground_truth", "xgb_stages")])
    rows = rows.filter("size(ground_truth) > 0 AND size(xgb_stages) > 0")
    return rows.select("doc", F.round(J.jaccard(F.col("ground_truth"), F.col("xgb_stages")), 6).alias("jaccard"))


@query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 5) AS c FROM embeddings")
def r10_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.round(J.cosine(F.col("embedding"), F.reverse("embedding")), 5).alias("c"))


@query(f"WITH {LATEST}, r AS (SELECT doc, commodity, row_number() OVER (PARTITION BY commodity ORDER BY doc_f1 DESC NULLS LAST, doc) AS k FROM latest) SELECT commodity, doc, 'Report ' || chr((64 + k)::INT) AS label FROM r WHERE k <= 5")
def w12_labels(spark: SparkSession, sf: str) -> DataFrame:
    top = C.top_per_group(latest_predictions(spark, sf), ["commodity"], [F.col("doc_f1").desc_nulls_last(), F.col("doc")], 5)
    return top.select("commodity", "doc", T.consecutive_label(F.col("rank")).alias("label"))


@query(f'WITH raws AS (SELECT DISTINCT unnest(xgb_stages) AS raw FROM test_predictions), {_IDS} SELECT raw, grp AS "group" FROM ids WHERE raw IS NOT NULL')
def t1_sql_function(spark: SparkSession, sf: str) -> DataFrame:
    """The grouping key through the registered SQL function."""
    register_functions(spark)
    table(spark, sf, "test_predictions").createOrReplaceTempView("__predictions")
    return spark.sql("SELECT raw, normalize_id(trim(raw)) AS `group` FROM (SELECT DISTINCT explode(xgb_stages) AS raw FROM __predictions) WHERE raw IS NOT NULL")


@query("SELECT vec_id, len(embedding) AS size, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def r11_embedding_column(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings kept as JSON text and read back as arrays of numbers."""
    stored = table(spark, sf, "embeddings").select("vec_id", F.to_json("embedding").alias("json"))
    vec = T.embedding(F.col("json"))
    total = F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return stored.select("vec_id", F.size(vec).cast("bigint").alias("size"), F.round(total, 4).alias("total"))
