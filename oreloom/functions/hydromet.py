"""Leaching and what follows it as Column expressions: tank and heap leach, solvent extraction,
electrowinning, neutralisation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kg of acid per kg of copper leached; Faraday constant; molar mass and charge of copper.
ACID_PER_COPPER, FARADAY, COPPER_MOLAR, COPPER_CHARGE = 6.17, 96485.0, 63.5, 2
# Molar masses in g/mol of acid, lime, gypsum, iron, arsenic, and the mean of the base-metal sulfates.
ACID_MOLAR, LIME_MOLAR, GYPSUM_MOLAR, IRON_MOLAR, ARSENIC_MOLAR, SULFATE_MOLAR = 98.08, 74.09, 172.17, 55.85, 74.92, 175.0
# The extraction isotherm's constants a, b, c, d, f.
ISOTHERM = (0.99, 1.02, 1.01, 35.15, 27.15)


def leach_acid(copper_tph: Column) -> Column:
    """kg/h of acid for the copper that dissolves."""
    return copper_tph * (1000.0 * ACID_PER_COPPER)


def tank_volume(slurry_m3_h: Column, hours: float, tanks: int) -> Column:
    return slurry_m3_h * (hours * tanks)


def heap_pad_area(ore_tph: Column, days: float = 365.0, height_m: float = 8.0, bulk: float = 1.7) -> Column:
    """m2 of pad under the ore that lies on it during a cycle."""
    return ore_tph * (24.0 * days / (bulk * height_m))


def heap_liquor(copper_tph: Column, grams_per_litre: float = 4.0) -> Column:
    """m3/h of pregnant liquor that carries the copper."""
    return copper_tph * (1000.0 / grams_per_litre)


def isotherm(ph: Column, feed_gpl: Column, barren_gpl: float, max_load: float) -> tuple[Column, Column]:
    """(A, B) of the equilibrium A x / (x + B) of the loaded organic."""
    a, b, c, d, f = ISOTHERM
    return F.lit(a * max_load), F.pow(F.lit(10.0), -ph * b) / max_load**c * (feed_gpl * d + f * barren_gpl)


def extraction_stage(
    feed_gpl: Column, organic_gpl: Column, aqueous_m3_h: Column, organic_m3_h: Column, top: Column, half: Column, transfer: float, efficiency: float,
    aqueous_m3: float, organic_m3: float,
) -> tuple[Column, Column]:
    """(raffinate, loaded organic) in g/l of a mixer at steady state, solved in closed form.

    With a = Qa / Va and q = Qo / Vo, both balances leave a (x0 - x) = c (A x / (x + B) - y0), where c = K q eta / (q + K):
    a quadratic in x whose positive root is the steady state.
    """
    a, q = aqueous_m3_h / aqueous_m3, organic_m3_h / organic_m3
    c = q * (transfer * efficiency) / (q + transfer)
    linear = c * (top - organic_gpl) - a * (feed_gpl - half)
    constant = -(a * feed_gpl + c * organic_gpl) * half
    x = (F.sqrt(linear * linear - 4.0 * a * constant) - linear) / (2.0 * a)
    equilibrium = (1.0 - efficiency) * organic_gpl + efficiency * (top * x / (x + half))
    return x, (q * organic_gpl + transfer * equilibrium) / (q + transfer)


def operating_current(copper_gpl: Column, share: float = 0.4) -> Column:
    """A/m2: a share of the limiting current density, 18.6 per g/l of copper."""
    return copper_gpl * (18.6 * share)


def cathode_grams(current: Column, plate_m2: float = 1.2, efficiency: float = 0.92) -> Column:
    """g/h plated on one cathode (Faraday)."""
    return current * (plate_m2 * 3600.0 * COPPER_MOLAR * efficiency / (COPPER_CHARGE * FARADAY))


def cell_voltage(current: Column, plate_m2: float = 1.2, resistivity: float = 0.5, gap_cm: float = 5.0, overhead: float = 1.96) -> Column:
    """V: ohmic drop between the plates and what the reactions take."""
    return current * (plate_m2 * resistivity * gap_cm / (plate_m2 * 1e4)) + overhead


def cells_needed(copper_tph: Column, grams: Column, plates: int = 60) -> Column:
    return F.ceil(copper_tph * 1e6 / (grams * plates))


def electrowinning_kw(cells: Column, current: Column, volts: Column, plate_m2: float = 1.2, plates: int = 60) -> Column:
    return cells * (plates * plate_m2 / 1000.0) * current * volts


def neutralisation(acid_kg: Column, iron_kg: Column, arsenic_kg: Column, sulfate_kg: Column, purity: float = 0.95) -> tuple[Column, Column, Column]:
    """(lime, gypsum in kg/h, whether iron is short of three per arsenic) of two stages.

    First the acid, mole for mole, with iron and arsenic precipitating in pairs (six moles of lime beyond the acid's and
    seven of gypsum for two of each); then the base-metal sulfates, mole for mole.
    """
    iron, arsenic = iron_kg * (1000.0 / IRON_MOLAR), arsenic_kg * (1000.0 / ARSENIC_MOLAR)
    pairs = F.least(iron, arsenic) / 2.0
    even = acid_kg * (1000.0 / ACID_MOLAR) + sulfate_kg * (1000.0 / SULFATE_MOLAR)
    lime = (even + 6.0 * pairs) * (LIME_MOLAR / 1000.0 / purity)
    return lime, (even + 7.0 * pairs) * (GYPSUM_MOLAR / 1000.0), (arsenic > 0) & (iron < 3.0 * arsenic)
