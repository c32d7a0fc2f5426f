"""Quantities recorded in different units (problem 3).

Declarative SQL throughout: regexp_extract splits number and unit, the unit alias is normalised by a join with a
small alias table, the nearest statement of a unit is taken by coalesce, then factor and offset apply.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oreloom.functions.keys import strip
from oreloom.session import cut

# Exact international sizes in kilograms.
POUND_KG = 0.45359237
TROY_OUNCE_KG = 0.0311034768
SHORT_TON_KG = 907.18474
LONG_TON_KG = 1016.0469088

#: Grade units in mg per tonne.
GRADE_UNITS = {
    1e9 * 0.01: ("%", "pct", "percent", "per cent", "wt%", "wt. %", "weight percent", "% w/w"),
    1e6: ("kg/t", "kg per tonne", "g/kg", "grams per kilogram"),
    1e3: ("g/t", "gpt", "grams per tonne", "gram per tonne", "ppm", "parts per million", "mg/kg", "g per tonne", "g/tonne"),
    1.0: ("ppb", "parts per billion", "mg/t", "mg per tonne", "ug/kg", "µg/kg"),
    1e9 * TROY_OUNCE_KG / SHORT_TON_KG: ("oz/st", "oz per short ton", "troy oz per short ton", "ozt/st", "oz/short ton", "troy ounces per short ton"),
    1e9 * POUND_KG / SHORT_TON_KG: ("lb/st", "lb per short ton", "lbs/short ton", "lbs/st", "lb/short ton", "pounds per short ton"),
}
#: Mass units in metric tonnes, and how scales are written before or after them.
MASS_UNITS = {
    1.0: ("t", "tonne", "tonnes", "metric tonne", "metric tonnes", "metric tons", "metric ton"),
    SHORT_TON_KG / 1000: ("st", "short ton", "short tons", "tons (short)"),
    LONG_TON_KG / 1000: ("lt", "long ton", "long tons", "tons (long)"),
}
MASS_SCALES = {1e3: ("k", "thousand", "000", "'000"), 1e6: ("m", "million", "mm", "mn"), 1e9: ("b", "bn", "billion")}
CURRENCIES = {
    "USD": ("usd", "us$"), "CAD": ("cad", "c$", "cad$"), "AUD": ("aud", "a$"), "EUR": ("eur", "€"),
    "ZAR": ("zar",), "CLP": ("clp", "clp$"), "PEN": ("pen", "s/", "s/."), "BRL": ("brl", "r$"),
}
MONEY_SCALES = {1e3: ("k", "thousand", "000", "000s", "'000"), 1e6: ("m", "mm", "mn", "million", "millions"), 1e9: ("b", "bn", "billion")}

ABOUT = r"(?:approximately|approx\.?|about|around|roughly|circa|ca\.|ca(?![A-Za-z])|c\.|[~≈*†‡])"
NUMBER = (
    r"\d{1,3}(?:[ \u00a0\u2009\u202f'’]\d{3})+(?:[.,]\d+)?"
    r"|\d{1,3}(?:,\d{3})+(?:\.\d+)?"
    r"|\d{1,3}(?:\.\d{3})+,\d+|\d{1,3}(?:\.\d{3}){2,}"
    r"|\d+(?:[.,]\d+)?(?:[eE][+-]?\d+)?"
)
#: before, number, after; a sign, a bound or a second number anywhere leaves no match.
VALUE = rf"^\s*([^\d<>≤≥+\-–]*?)\s*({NUMBER})\s*((?:[^\d<>≤≥±\-–]|\b000s?\b|\bx\s*1000\b)*)$"

QUANTITY_WORDS = {
    "grade_values": r"grades?",
    "tonnage_mean": r"ore masses|tonnages?|ore tonnages?",
    "capex_mean": r"capital costs?|capex",
}
QUANTITY_HEADERS = {
    "grade_values": r"(?i)^\s*(?:(?:head|cu|au|ag)\s+)?(?:grade|cu|au|ag)\b",
    "tonnage_mean": r"(?i)^\s*(?:ore\s+)?(?:mass|tonnage|tonnes)\b",
    "capex_mean": r"(?i)^\s*(?:initial\s+)?(?:capex|capital\s+cost)\b",
}


def alias_key(col: Column) -> Column:
    """How an alias is compared: lower case, all white space removed."""
    return F.lower(F.regexp_replace(col, r"[\s\u00a0\u202f]+", ""))


def _alias_rows() -> Iterable[tuple[str, str, str | None, float]]:
    squash = lambda s: "".join(s.lower().split())
    for factor, names in GRADE_UNITS.items():
        for name in names:
            yield "grade_values", squash(name), None, factor
    for factor, names in MASS_UNITS.items():
        for name in names:
            yield "tonnage_mean", squash(name), None, factor
            for scale, marks in MASS_SCALES.items():
                for mark in marks:
                    yield "tonnage_mean", squash(mark + name), None, factor * scale
            yield "tonnage_mean", squash(name + "x1000"), None, factor * 1e3
            yield "tonnage_mean", squash(name + "x1000000"), None, factor * 1e6
    for code, names in CURRENCIES.items():
        for name in names:
            yield "capex_mean", name, code, 1.0
            for scale, marks in MONEY_SCALES.items():
                for mark in marks:
                    yield "capex_mean", name + mark, code, scale
                    yield "capex_mean", mark + name, code, scale


def unit_aliases(spark: SparkSession) -> DataFrame:
    """quantity, alias, currency, factor, shift: a few hundred rows generated from the unit and scale names."""
    rows = sorted(set(_alias_rows()), key=str)
    return spark.createDataFrame([(*r, 0.0) for r in rows], "quantity string, alias string, currency string, factor double, shift double")


_PLAIN = r"^[0-9]+(\.[0-9]+)?$"
_MARK = "\x01"


def split_value(text: Column) -> Column:
    """Struct (number double, unit text squashed, '' if none) of a single value; null where it is none.

    Bare numbers, the commonest values, are told by one short pattern; only the others meet the long one, once.
    """
    trimmed = F.trim(text)
    clean = F.translate(F.regexp_replace(text, rf"(?i)(?<![A-Za-z]){ABOUT}", " "), _MARK, " ")
    split = F.split(F.regexp_replace(clean, VALUE, f"$2{_MARK}$1$3"), _MARK)
    read = lambda parts: F.when(
        F.size(parts) == 2, F.struct(plain_number(F.get(parts, F.lit(0))).alias("number"), alias_key(F.get(parts, F.lit(1))).alias("unit"))
    )
    # The transform binds the split text, so that number and unit are taken from one match.
    rest = F.get(F.transform(F.array(split), read), F.lit(0))
    return F.when(trimmed.rlike(_PLAIN), F.struct(trimmed.try_cast("double").alias("number"), F.lit("").alias("unit"))).otherwise(rest)


def plain_number(number: Column) -> Column:
    """Number as double: grouping marks go, a lone comma is decimal unless exactly three digits follow."""
    n = F.regexp_replace(number, r"[ \u00a0\u2009\u202f'’]", "")
    dots_group = n.rlike(r"^\d{1,3}(\.\d{3})+,\d+$") | n.rlike(r"^\d{1,3}(\.\d{3}){2,}$")
    commas_group = n.rlike(r"^\d+(,\d{3})+(\.\d+)?$")
    one_mark = F.length(n) - F.length(F.translate(n, ",.", "")) <= 1
    plain = (
        F.when(one_mark & ~F.contains(n, F.lit(",")), n)
        .when(dots_group, F.replace(F.replace(n, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(commas_group, F.replace(n, F.lit(","), F.lit("")))
        .otherwise(F.replace(n, F.lit(","), F.lit(".")))
    )
    return plain.try_cast("double")


def feature_values(features: DataFrame) -> DataFrame:
    """One row per recorded value, from one scan: feature_id, quantity, item_pos, value, unit_field, price_year, table_id."""
    one = lambda q, i, v, u: F.struct(F.lit(q).alias("quantity"), i.alias("item_pos"), v.alias("value"), F.col(u).alias("unit_field"))
    grades = F.transform(F.coalesce("grade_values", F.array().cast("array<string>")), lambda v, i: one("grade_values", i, v, "grade_unit"))
    plain = [one(q, F.lit(0), F.col(q), u) for q, u in (("tonnage_mean", "tonnage_unit"), ("capex_mean", "capex_unit"))]
    recorded = F.filter(F.concat(grades, F.array(*plain)), lambda x: x["value"].isNotNull())
    return features.select("feature_id", "price_year", "table_id", F.inline(recorded))


def table_statements(tables: DataFrame) -> DataFrame:
    """Units stated by a table, from one scan: table_id, quantity, unit_table (squashed alias): header, else caption, else text before.

    Rows of the same table that differ are told apart by the nearest kind of statement, then by the alias.
    """
    empty = lambda c: F.nullif(alias_key(c), F.lit(""))
    close = lambda c: F.when(c.rlike(r"\([^)]*$"), F.concat(c, F.lit(")"))).otherwise(c)
    stated = []
    for quantity, words in QUANTITY_WORDS.items():
        own = F.filter("headers", lambda h: F.coalesce(h.rlike(QUANTITY_HEADERS[quantity]), F.lit(False)))
        inner = lambda h: F.coalesce(
            F.nullif(F.regexp_extract(h, r"\[(.*)\]\s*$", 1), F.lit("")),
            F.nullif(F.regexp_extract(h, r"^[^(\[,]*\((.*)\)\s*$", 1), F.lit("")),
            F.nullif(F.regexp_extract(h, r"^[^(\[,]*,\s*(.*)$", 1), F.lit("")),
        )
        header = F.get(F.filter(F.transform(own, inner), lambda s: s.isNotNull()), F.lit(0))
        said = rf"(?i)\b(?:{words})\b(?:\s+(?:below|above|here))?(?:\s+(?:are|is))?(?:\s+(?:given|reported|expressed|stated|shown|quoted))?\s*(?:\bin\b|\bas\b|:)\s*"
        caption = F.array(F.regexp_extract("caption", said + r"([^;]*?)(?:\s*;|\)?\s*$)", 1))
        before = F.regexp_extract("text_before", said + r"(.*?)(?:\.?\s*$|\s*;|\.\s+(?=[A-Z][a-z]))", 1)
        units = F.array(empty(header), empty(F.get(F.transform(caption, close), F.lit(0))), empty(before))
        stated.append(F.struct(F.lit(quantity).alias("quantity"), units.alias("units")))
    nearest = lambda s: F.transform(s["units"], lambda u, i: F.struct(i.alias("kind"), u.alias("unit")))
    found = tables.filter("table_id IS NOT NULL").select("table_id", F.inline(F.array(*stated)))
    said_any = F.filter(nearest(found), lambda x: x["unit"].isNotNull())
    best = found.select("table_id", "quantity", F.get(said_any, F.lit(0)).alias("s")).filter("s IS NOT NULL")
    return best.groupBy("table_id", "quantity").agg(F.min("s").alias("s")).select("table_id", "quantity", F.col("s.unit").alias("unit_table"))


def common_values(features: DataFrame, tables: DataFrame, rates: DataFrame) -> DataFrame:
    """feature_id, quantity, item_pos, common_value (bigint), distinct; only single numbers with a known unit.

    The nearest statement wins: in the value, else in the unit column if that names a unit, else in the table.
    A value whose own text is no known unit is none, whatever the column says.
    """
    spark = features.sparkSession
    aliases = F.broadcast(unit_aliases(spark))
    values = (
        feature_values(features)
        .select("feature_id", "quantity", "item_pos", "price_year", "table_id", "unit_field", split_value(F.col("value")).alias("v"))
        .filter("v.number IS NOT NULL AND NOT isnan(v.number)")
        .select("feature_id", "quantity", "item_pos", "price_year", "table_id", "unit_field", F.col("v.number").alias("number"), F.col("v.unit").alias("own"))
    )
    values = cut(values)  # read twice below; the parsing is the expensive part
    pick = lambda name: aliases.select(
        "quantity", F.col("alias").alias(name), F.struct("currency", "factor", "shift").alias(f"by_{name}")
    )
    values = values.withColumn("own", F.nullif("own", F.lit(""))).withColumn("unit_field", alias_key(strip(F.col("unit_field"))))
    known = (
        values.join(pick("own"), ["quantity", "own"], "left")
        .join(pick("unit_field"), ["quantity", "unit_field"], "left")
        .filter(F.col("own").isNull() | F.col("by_own").isNotNull())
    )
    near = F.coalesce("by_own", "by_unit_field")
    stated = table_statements(tables).join(pick("unit_table"), ["quantity", "unit_table"]).select(
        "table_id", "quantity", "by_unit_table"
    )
    # Rows that state their unit need no table; they get no join key, so neither they nor their hot keys are looked up.
    asked = known.withColumn("__table", F.when(near.isNull(), F.col("table_id")))
    here = asked.filter(near.isNotNull()).select("*", near.alias("unit"))
    there = (
        asked.filter(near.isNull() & F.col("__table").isNotNull())
        .join(stated, ["table_id", "quantity"])
        .select(*asked.columns, F.col("by_unit_table").alias("unit"))
    )
    fx = rates.select(F.col("currency_code").alias("__code"), F.col("fx_year").alias("__year"), "usd_per_unit").distinct()  # broadcast if its size allows
    converted = (
        here.unionByName(there)
        .join(fx, (F.col("unit.currency") == F.col("__code")) & (F.col("price_year") == F.col("__year")), "left")
        .withColumn(
            "rate",
            F.when(F.col("unit.currency").isNull() | (F.col("unit.currency") == "USD"), F.lit(1.0)).otherwise(F.col("usd_per_unit")),
        )
        .filter(F.col("rate").isNotNull())
    )
    exact = F.col("number") * F.col("unit.factor") * F.col("rate") + F.col("unit.shift")
    return converted.select("feature_id", "quantity", "item_pos", F.round(F.round(exact, 6), 0).try_cast("bigint").alias("common_value")).filter(
        F.col("common_value").isNotNull()
    ).distinct()
