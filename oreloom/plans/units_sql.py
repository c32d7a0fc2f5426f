"""The unit conversion of problem 3 as one ANSI query, an independent statement of the rules for DuckDB."""

from __future__ import annotations

# The sizes of units, stated here by themselves: milligrams per tonne, tonnes, multiples; names without blanks.
_ALIASES = """
grade(name, factor) AS (VALUES
  ('%', 10000000.0), ('pct', 10000000.0), ('percent', 10000000.0), ('wt%', 10000000.0), ('wt.%', 10000000.0), ('weightpercent', 10000000.0), ('%w/w', 10000000.0),
  ('kg/t', 1000000.0), ('kgpertonne', 1000000.0), ('g/kg', 1000000.0), ('gramsperkilogram', 1000000.0),
  ('g/t', 1000.0), ('gpt', 1000.0), ('gramspertonne', 1000.0), ('grampertonne', 1000.0), ('ppm', 1000.0), ('partspermillion', 1000.0), ('mg/kg', 1000.0), ('gpertonne', 1000.0), ('g/tonne', 1000.0),
  ('ppb', 1.0), ('partsperbillion', 1.0), ('mg/t', 1.0), ('mgpertonne', 1.0), ('ug/kg', 1.0), ('µg/kg', 1.0),
  ('oz/st', 31103.4768 / 0.90718474), ('ozpershortton', 31103.4768 / 0.90718474), ('troyozpershortton', 31103.4768 / 0.90718474), ('ozt/st', 31103.4768 / 0.90718474),
  ('oz/shortton', 31103.4768 / 0.90718474), ('troyouncespershortton', 31103.4768 / 0.90718474),
  ('lb/st', 500000.0), ('lbpershortton', 500000.0), ('lbs/shortton', 500000.0), ('lbs/st', 500000.0), ('lb/shortton', 500000.0), ('poundspershortton', 500000.0)),
mass(name, factor) AS (VALUES
  ('t', 1.0), ('tonne', 1.0), ('tonnes', 1.0), ('metrictonne', 1.0), ('metrictonnes', 1.0), ('metrictons', 1.0), ('metricton', 1.0),
  ('st', 0.90718474), ('shortton', 0.90718474), ('shorttons', 0.90718474), ('tons(short)', 0.90718474),
  ('lt', 1.0160469088), ('longton', 1.0160469088), ('longtons', 1.0160469088), ('tons(long)', 1.0160469088)),
money(name, code) AS (VALUES
  ('usd', 'USD'), ('us$', 'USD'), ('cad', 'CAD'), ('c$', 'CAD'), ('cad$', 'CAD'), ('aud', 'AUD'), ('a$', 'AUD'), ('eur', 'EUR'), ('€', 'EUR'), ('zar', 'ZAR'),
  ('clp', 'CLP'), ('clp$', 'CLP'), ('pen', 'PEN'), ('s/', 'PEN'), ('s/.', 'PEN'), ('brl', 'BRL'), ('r$', 'BRL')),
scale(mark, times, mass_too) AS (VALUES
  ('k', 1e3, true), ('thousand', 1e3, true), ('000', 1e3, true), ('''000', 1e3, true), ('000s', 1e3, false),
  ('m', 1e6, true), ('million', 1e6, true), ('mm', 1e6, true), ('mn', 1e6, true), ('millions', 1e6, false), ('b', 1e9, true), ('bn', 1e9, true), ('billion', 1e9, true)),
alias(quantity, alias, currency, factor) AS (
  SELECT 'grade_values', name, NULL, factor::DOUBLE FROM grade
  UNION SELECT 'tonnage_mean', name, NULL, factor::DOUBLE FROM mass
  UNION SELECT 'tonnage_mean', mark || name, NULL, factor::DOUBLE * times FROM mass, scale WHERE mass_too
  UNION SELECT 'tonnage_mean', name || 'x' || times::BIGINT, NULL, factor::DOUBLE * times FROM mass, (VALUES (1e3), (1e6)) AS n(times)
  UNION SELECT 'capex_mean', name, code, 1.0 FROM money
  UNION SELECT 'capex_mean', name || mark, code, times FROM money, scale
  UNION SELECT 'capex_mean', mark || name, code, times FROM money, scale)"""

_GROUP = "[ \u00a0\u2009\u202f'\u2019]"
_NUMBER = rf"\d{{1,3}}(?:{_GROUP}\d{{3}})+(?:[.,]\d+)?|\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?|\d{{1,3}}(?:\.\d{{3}})+,\d+|\d{{1,3}}(?:\.\d{{3}}){{2,}}|\d+(?:[.,]\d+)?(?:[eE][+-]?\d+)?"
_VALUE = rf"^\s*([^\d<>≤≥+\-–]*?)\s*({_NUMBER})\s*((?:[^\d<>≤≥±\-–]|\b000s?\b|\bx\s*1000\b)*)$"
_ABOUT = r"(^|[^a-z])(?:approximately|approx\.?|about|around|roughly|circa|ca\.|ca\b|c\.)"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _squash(expr: str) -> str:
    return f"lower(regexp_replace({expr}, '[\\s\u00a0\u202f]+', '', 'g'))"


def _said(words: str) -> str:
    return rf"(?i)\b(?:{words})\b(?:\s+(?:below|above|here))?(?:\s+(?:are|is))?(?:\s+(?:given|reported|expressed|stated|shown|quoted))?\s*(?:\bin\b|\bas\b|:)\s*"


def common_values_sql() -> str:
    heads = {
        "grade_values": r"(?i)^\s*(?:(?:head|cu|au|ag)\s+)?(?:grade|cu|au|ag)\b",
        "tonnage_mean": r"(?i)^\s*(?:ore\s+)?(?:mass|tonnage|tonnes)\b",
        "capex_mean": r"(?i)^\s*(?:initial\s+)?(?:capex|capital\s+cost)\b",
    }
    words = {"grade_values": "grades?", "tonnage_mean": "ore masses|tonnages?|ore tonnages?", "capex_mean": "capital costs?|capex"}
    stated = []
    for q in heads:
        own = f"list_filter(headers, lambda h: regexp_matches(h, {_quote(heads[q])}))"
        in_head = (
            r"coalesce(nullif(regexp_extract(h, '\[(.*)\]\s*$', 1), ''), nullif(regexp_extract(h, '^[^(\[,]*\((.*)\)\s*$', 1), ''), nullif(regexp_extract(h, '^[^(\[,]*,\s*(.*)$', 1), ''))"
        )
        header = f"list_filter(list_transform({own}, lambda h: {in_head}), lambda u: u IS NOT NULL)[1]"
        caption = f"regexp_extract(caption, {_quote(_said(words[q]) + r'([^;]*?)(?:\s*;|\)?\s*$)')}, 1)"
        before = f"regexp_extract(text_before, {_quote(_said(words[q]) + r'(.*?)(?:\.?\s*$|\s*;|\.\s+(?:The|Note|In|All|Rounded|See|Totals)\b)')}, 1)"
        unit = f"coalesce(nullif({_squash(header)}, ''), nullif({_squash(caption)}, ''), nullif({_squash(before)}, ''))"
        stated.append(f"SELECT table_id, {_quote(q)} AS quantity, {unit} AS unit FROM extracted_tables WHERE table_id IS NOT NULL")
    return f"""
WITH {_ALIASES},
val AS (
  SELECT DISTINCT * FROM (
    SELECT feature_id, price_year, table_id, 'grade_values' AS quantity, (generate_subscripts(grade_values, 1) - 1)::INT AS item_pos, unnest(grade_values) AS v, grade_unit AS u FROM doc_features
    UNION ALL SELECT feature_id, price_year, table_id, 'tonnage_mean', 0, tonnage_mean, tonnage_unit FROM doc_features
    UNION ALL SELECT feature_id, price_year, table_id, 'capex_mean', 0, capex_mean, capex_unit FROM doc_features) WHERE v IS NOT NULL),
cleaned AS (SELECT *, regexp_replace(regexp_replace(v, {_quote('(?i)' + _ABOUT)}, '\\1 ', 'g'), '[~≈*†‡]', ' ', 'g') AS c FROM val),
cut AS (SELECT *, regexp_extract(c, {_quote(_VALUE)}, 2) AS num, {_squash(f"regexp_extract(c, {_quote(_VALUE)}, 1) || regexp_extract(c, {_quote(_VALUE)}, 3)")} AS own FROM cleaned),
num AS (
  SELECT *, regexp_replace(num, {_quote(_GROUP)}, '', 'g') AS n FROM cut WHERE num <> ''),
parsed AS (
  SELECT feature_id, price_year, table_id, quantity, item_pos, own, {_squash("u")} AS u, try_cast(CASE
    WHEN regexp_matches(n, '^\\d{{1,3}}(\\.\\d{{3}})+,\\d+$') OR regexp_matches(n, '^\\d{{1,3}}(\\.\\d{{3}}){{2,}}$') THEN replace(replace(n, '.', ''), ',', '.')
    WHEN regexp_matches(n, '^\\d+(,\\d{{3}})+(\\.\\d+)?$') THEN replace(n, ',', '') ELSE replace(n, ',', '.') END AS DOUBLE) AS x FROM num),
stated AS ({' UNION ALL '.join(stated)}),
one AS (SELECT table_id, quantity, min(unit) AS unit FROM stated WHERE unit IS NOT NULL GROUP BY 1, 2),
unit AS (
  SELECT p.*, CASE WHEN p.own <> '' THEN a.alias WHEN b.alias IS NOT NULL THEN b.alias ELSE t.unit END AS unit
  FROM parsed p LEFT JOIN alias a ON a.quantity = p.quantity AND a.alias = p.own LEFT JOIN alias b ON b.quantity = p.quantity AND b.alias = p.u
  LEFT JOIN one t ON t.table_id = p.table_id AND t.quantity = p.quantity),
rated AS (
  SELECT unit.*, al.factor, CASE WHEN al.currency IS NULL OR al.currency = 'USD' THEN 1.0 ELSE fx.usd_per_unit END AS rate
  FROM unit JOIN alias al ON al.quantity = unit.quantity AND al.alias = unit.unit
  LEFT JOIN fx_rates fx ON fx.currency_code = al.currency AND fx.fx_year = unit.price_year)
SELECT DISTINCT feature_id, quantity, item_pos, round(round(x * factor * rate, 6), 0)::BIGINT AS common_value FROM rated WHERE rate IS NOT NULL AND x IS NOT NULL
"""
