"""The plant chain once more as plain SQL with literal constants, for DuckDB to check the Column expressions against."""

from __future__ import annotations

CHAIN_ROWS = "SELECT p_partkey AS id, 1000.0 + p_size AS tph, 0.004 + (p_size % 10) / 2000.0 AS grade, 150.0 + p_size AS p80, 1.4 + (p_size % 5) / 10.0 AS gas FROM part"


def flotation_sql(source: str, name: str, bubble_f: float, froth_m: float, size_um: str, minutes: float, cells: str, volume: float) -> str:
    """Common table expressions that end in ``name``: source with a column r, the recovery of the bank."""
    return f"""
{name}_0 AS (SELECT *, {size_um} * 1e-6::DOUBLE AS d, gas / 100.0 AS jg, {cells} AS nc,
  0.07243 - 8.314 * 296.15 * 0.000005 * ln(230.0 * 50 / 102170.0 + 1) AS sigma, 1200.0::DOUBLE / (0.25 * 1.225 + 0.75 * 0.3 * 2800 + 0.7 * 1000) AS e FROM {source}),
{name}_1 AS (SELECT *, {bubble_f} * pow(2.11 * sigma / (1000 * pow(15 * e, 0.66)), 0.6) AS db, 2800 * pi() * pow(d, 3) / 6 AS m FROM {name}_0),
{name}_2 AS (SELECT *, pow(0.4 * pow(0.5 * e, 4.0 / 9) * pow(d, 7.0 / 9) * pow(1e-6, -1.0 / 3) * pow(1.8, 2.0 / 3), 2) AS u1, 2 * pow(0.5 * e * db, 2.0 / 3) AS u2 FROM {name}_1),
{name}_3 AS (SELECT *, sqrt(u2) * db / 1e-6 AS re, pow(2, 1.5) * sqrt(pi()) * pow(0.5 * (d + db), 2) * sqrt(u1 + u2) AS beta,
  exp(-1e-18 / (0.5 * m * u1)) AS att, sigma * pi() * pow(d / 2, 2) * pow(1 - cos(radians(55)), 2) AS adh, 0.5 * m * pow(0.7 * (d + db) * sqrt(15 * e / 1e-6), 2) AS ke FROM {name}_2),
{name}_4 AS (SELECT *, least(1.0, pow(tanh(sqrt(1.5 * (1 + (3.0 / 16 * re) / (1 + 0.249 * pow(re, 0.56)))) * d / db), 2)) AS col, exp(-(adh + 1e-18) / ke) AS det,
  db * pow((1 - 0.001275) / (1.8 * 2 * pow(db / d, 2)), 1.0 / 3) AS lift, (jg * 25 / ({volume} / ({minutes} / nc * 60))) / 4 AS w FROM {name}_3),
{name}_5 AS (SELECT *, 60 * beta * 0.25 / (pi() * pow(db, 3) / 6) * att * col * (1 - det) * {minutes} AS kt,
  least(1.0, 1.2 * exp(-0.05 * {froth_m} / jg * exp(2.0 * d / lift)) + (CASE WHEN w > 1 THEN 0.1 ELSE w END) * exp(-0.0325 * 1.8 - 0.063 * d * 1e6)) AS rf FROM {name}_4),
{name} AS (SELECT * EXCLUDE (d, jg, nc, sigma, e, db, m, u1, u2, re, beta, att, adh, ke, col, det, lift, w, kt, rf),
  (kt / (1 + kt)) * rf / ((kt / (1 + kt)) * rf + 1 - kt / (1 + kt)) AS r FROM {name}_5)"""


def chain_sql(leach: bool) -> str:
    """All stages of the reference case over CHAIN_ROWS, the last being ``done``."""
    metal = "conc_t * conc_grade"
    kept = "(0.9025 / (1 - (1 - 0.9025) * (1 - 0.03)))"
    out = "least(0.95, 1 - pow(greatest(1 - 500 * exp(-70000 / (8.314 * 473.15)) * pow(12.0, 0.7) * 14400, 0), 3))"
    product = f"{metal} * {out} * {kept}" if leach else metal
    return f"""
WITH src AS ({CHAIN_ROWS}),
ground AS (SELECT *, tph * 2.8 AS sag_kw, greatest(140 * (1 / sqrt(p80) - 1 / sqrt(150000.0)) - 2.8, 0) * tph AS mill_kw, tph * 3.5 AS mill_feed_t,
  (pow(2.8 / 140 + 1 / sqrt(150000.0), -2) + p80 * 2.5) / 3.5 AS mill_feed_um, 140 * (1 / sqrt(150000.0) - 1 / sqrt(300000.0)) / 0.95 * tph AS crusher_kw, tph * 0.7 / 0.81 AS water_t FROM src),
celled AS (SELECT *, greatest(1.0, ceil((tph / 2.7 + water_t) * 0.3 * 1.2 / 0.75 / 500)) AS cells FROM ground),
{flotation_sql("celled", "rough", 0.90, 0.15, "p80", 18.0, "cells", 500.0)},
capped AS (SELECT * EXCLUDE (r), least(r + (1 - r) * 0.5, 0.9 * greatest(1 - greatest(p80 - 150, 0) * 0.0013, 0.5) * greatest(1 - greatest(gas - 1.6, 0) * 0.25, 0.7) * greatest(1 - 0.2 * 0.35, 0.9)) AS rougher_r FROM rough),
pulled AS (SELECT *, tph * grade * rougher_r AS cm, tph * (1 - grade) * 0.1 AS cg FROM capped),
conc AS (SELECT *, cm + cg AS rougher_t, cm / (cm + cg) AS c, least((cm + cg) * (100.0 / 35 - 1), water_t) AS rougher_water FROM pulled),
reground AS (SELECT *, greatest(140 * (1 / sqrt(30.0) - 1 / sqrt(p80)), 0) * rougher_t AS regrind_kw FROM conc),
{flotation_sql("reground", "clean", 0.60, 0.08, "30.0", 12.0, "6", 50.0)},
eff AS (SELECT *, greatest(0.8, least(0.99, r)) AS rm, cm / (tph * grade) AS om, cg / (tph * (1 - grade)) AS og FROM clean),
want AS (SELECT *, rm * c * 0.74 / (0.26 * (1 - c)) AS w FROM eff),
pull AS (SELECT *, greatest(0.04, least(0.2, w * (1 - og) / greatest(1e-9, 1 - w * og))) AS rg FROM want),
looped AS (SELECT *, cm * least(0.999, rm / (1 - om * (1 - rm))) AS fm, cg * least(0.999, rg / (1 - og * (1 - rg))) AS fg FROM pull),
wet AS (SELECT *, fm + fg AS conc_t, fm / (fm + fg) AS conc_grade, tph - fm - fg AS tails_t, (tph * grade - fm) / (tph - fm - fg) AS tails_grade, least(fm + fg, rougher_water) AS conc_water FROM looped),
thick AS (SELECT *, 1.25 * conc_t / (2.7 * (4 * 8.0 / 0.4 * 4.6 * pow(3.6, 3.6) / pow(5.6, 5.6))) AS thickener_m2, least(conc_t * (100.0 / 65 - 1), conc_water) AS uf FROM wet),
press AS (SELECT *, conc_t * 1000 / uf AS s, 1e-3 * 1e11 * (conc_t * 1000 / uf) / 140000 AS qa, 1e-3 * 1e10 / 70000 AS qb FROM thick),
dry AS (SELECT *, s * (sqrt(qb * qb + 240 * qa) - qb) / (2 * qa) AS loading FROM press),
done AS (SELECT *, conc_t * 1000 / 3600 * 200 / loading AS filter_m2, loading / 2 AS cake_mm, least(conc_t * 0.09 / 0.91, uf) AS cake_water,
  {f"{metal} * {out} * {kept}" if leach else "0.0"} AS cathode_t, {f"{metal} * {out} * 6170" if leach else "0.0"} AS acid_kg, {product} / (tph * grade) AS recovery FROM dry)"""
