"""A whole concentrator over scenario rows: every stage adds columns, so a sweep of any size is one
scan without a UDF, and the balance at the end is taken over the streams that really leave.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreloom.functions import hydromet, plant, separation

# Water and air density, water viscosity (SI), surface tension of water, gas constant.
WATER, AIR, VISCOSITY, PURE_TENSION, GAS = 1000.0, 1.225, 0.001, 0.07243, 8.314
# Adsorption constants of each frother: surface excess, affinity, molar mass in mg.
FROTHERS = {
    "MIBC": (0.000005, 230.0, 102170.0),
    "PPG400": (0.000001, 1700000.0, 134170.0),
    "Octanol": (0.000008, 2200.0, 130230.0),
    "Pentanol": (0.000006, 55.0, 88150.0),
}
# Per mineralogy the ceilings of flotation recovery and pressure leach, and the heap extraction.
MINERALOGY = {
    "chalcopyrite": (0.90, 0.95, 0.30),
    "chalcocite": (0.85, 0.95, 0.72),
    "chalcocite/oxide": (0.50, 0.85, 0.80),
    "oxide": (0.05, 0.00, 0.85),
    "bornite": (0.92, 0.95, 0.30),
    "IOCG": (0.90, 0.95, 0.30),
}
# Energy of regrind mills against a ball mill.
REGRIND_ENERGY = {"ball": 1.00, "tower": 0.75, "isamill": 0.60}


@dataclass(frozen=True)
class Cell:
    """Constants of a mechanical flotation cell. Sizes in metres, energies in J, power in kW/m3, gas in cm/s."""

    froth_b: float = 2.0
    froth_alpha: float = 0.05
    bubble_f: float = 0.90
    detach_f: float = 0.7
    bulk: float = 0.5
    impeller: float = 15.0
    barrier: float = 1e-18
    drag: float = 1.0
    gravity: float = 2.8
    area: float = 25.0
    bubble_ratio: float = 1.2
    angle_deg: float = 55.0
    power: float = 1.2
    air: float = 0.25
    solids: float = 0.30
    froth_m: float = 0.15
    frother: str = "MIBC"
    frother_ppm: float = 50.0
    celsius: float = 23.0


@dataclass(frozen=True)
class Settings:
    """What does not differ between scenarios; the values of the reference case."""

    rougher: Cell = Cell()
    cleaner: Cell = Cell(bubble_f=0.60, froth_m=0.08)
    mineralogy: str = "chalcopyrite"
    crusher_index: float = 14.0
    crusher_f80_um: float = 300_000.0
    crusher_p80_um: float = 150_000.0
    sag_kwh_t: float = 2.8
    mill_index: float = 14.0
    circulating_load: float = 2.5
    cyclone_solids_pct: float = 55.0
    gangue: float = 0.10
    scavenger: float = 0.50
    cap: float = 0.90
    minutes: float = 18.0
    cell_m3: float = 500.0
    froth_factor: float = 1.2
    liberation: tuple[float, float, float] = (150.0, 0.0013, 0.5)  # reference size, loss per um above it, floor
    flooding: tuple[float, float, float] = (1.6, 0.25, 0.70)  # reference gas rate, loss per cm/s above it, floor
    stripping: tuple[float, float, float] = (1.0, 0.35, 0.90)  # reference power, loss per kW/m3 above it, floor
    concentrate_pct: float = 35.0
    regrind_mill: str = "ball"
    regrind_index: float = 14.0
    regrind_um: float = 30.0
    cleaner_minutes: float = 12.0
    cleaner_m3: float = 50.0
    cleaner_slope: float = 0.0020
    target_grade: float = 0.26
    underflow_pct: float = 65.0
    moisture: float = 0.09
    leach: bool = False
    leach_hours: float = 4.0
    leach_celsius: float = 200.0
    oxygen_bar: float = 12.0
    pass_efficiency: float = 0.95 * 0.95
    bleed: float = 0.03


def surface_tension(cell: Cell) -> float:
    """N/m of the frothed water (Szyszkowski)."""
    excess, affinity, molar = FROTHERS[cell.frother]
    return PURE_TENSION - GAS * (273.15 + cell.celsius) * excess * math.log(affinity * cell.frother_ppm / molar + 1.0)


def with_flotation(rows: DataFrame, name: str, cell: Cell, size_um: Column, gas_cm_s: Column, minutes: float, cells: Column, cell_m3: float) -> DataFrame:
    """Adds ``name``: recovery of a well-mixed bank from bubble, collision, attachment, detachment and froth.

    Everything about the bubbles is a number of the cell; particle size, gas rate and the number of cells are columns.
    """
    nu, tension, density = VISCOSITY / WATER, surface_tension(cell), cell.gravity * 1000.0
    mean = cell.power * 1000.0 / (cell.air * AIR + (1.0 - cell.air) * cell.solids * density + (1.0 - cell.solids) * WATER)
    bulk, impeller = cell.bulk * mean, cell.impeller * mean
    bubble = cell.bubble_f * (2.11 * tension / (WATER * impeller**0.66)) ** 0.6
    per_m3 = cell.air / (math.pi / 6.0 * bubble**3)
    bubble_speed = 2.0 * (bulk * bubble) ** (2 / 3)
    stages = rows.withColumn("__d", size_um * 1e-6).withColumn("__jg", gas_cm_s / 100.0)
    d = F.col("__d")
    settle = 0.4 * bulk ** (4 / 9) * nu ** (-1 / 3) * (density / WATER - 1.0) ** (2 / 3)
    stages = stages.withColumns({"__m": F.pow(d, F.lit(3.0)) * (density * math.pi / 6.0), "__u": F.pow(F.pow(d, F.lit(7 / 9)) * settle, F.lit(2.0))})
    m, u = F.col("__m"), F.col("__u")
    reynolds = math.sqrt(bubble_speed) * bubble / nu
    grazing = math.sqrt(1.5 * (1.0 + (3.0 / 16.0 * reynolds) / (1.0 + 0.249 * reynolds**0.56))) / bubble
    adhesion = d * d * (tension * math.pi / 4.0 * (1.0 - math.cos(math.radians(cell.angle_deg))) ** 2)
    shear = (d + bubble) * (cell.detach_f * math.sqrt(impeller / nu))
    coverage = 2.0 * bubble * bubble / (d * d)
    buoyant = bubble * F.pow((1.0 - 0.001275) / ((cell.gravity - 1.0) * coverage), F.lit(1 / 3))
    water_m3_s = cell_m3 / (minutes * 60.0)
    drained = F.col("__jg") * cell.area / (water_m3_s * cells) / 4.0
    stages = stages.withColumns({
        "__collide": (d + bubble) * (d + bubble) * F.sqrt(u + bubble_speed) * (2.0**1.5 * math.sqrt(math.pi) / 4.0),
        "__attach": F.exp(-cell.barrier / (m * u * (0.5 / cell.drag**2))),
        "__graze": F.least(F.lit(1.0), F.pow(F.tanh(d * grazing), F.lit(2.0))),
        "__detach": F.exp(-(adhesion + cell.barrier) / (m * shear * shear * 0.5)),
        "__froth": cell.bubble_ratio * F.exp(-cell.froth_alpha * cell.froth_m / F.col("__jg") * F.exp(cell.froth_b * d / buoyant)),
        "__water": F.when(drained > 1.0, 0.1).otherwise(drained),
    })
    rate = F.col("__collide") * F.col("__attach") * F.col("__graze") * (1.0 - F.col("__detach")) * (per_m3 * 60.0)
    carried = F.col("__water") * F.exp(-0.063e6 * d - 0.0325 * (density - WATER) / 1000.0)
    stages = stages.withColumns({"__kt": rate * minutes, "__rf": F.least(F.col("__froth") + carried, F.lit(1.0))})
    stages = stages.withColumn("__rc", F.col("__kt") / (1.0 + F.col("__kt")))
    through = F.col("__rc") * F.col("__rf")
    return stages.withColumn(name, through / (through + 1.0 - F.col("__rc"))).drop(
        "__d", "__jg", "__m", "__u", "__collide", "__attach", "__graze", "__detach", "__froth", "__water", "__kt", "__rf", "__rc"
    )


def _penalty(value: Column | float, rule: tuple[float, float, float]) -> Column:
    """1 up to the reference, then falling linearly to a floor."""
    at = value if isinstance(value, Column) else F.lit(value)
    return F.greatest(1.0 - F.greatest(at - rule[0], F.lit(0.0)) * rule[1], F.lit(rule[2]))


def _between(value: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), value))


def _cells(solids_tph: Column, water_tph: Column, minutes: float, s: Settings, cell_m3: float) -> Column:
    volume = (solids_tph / 2.7 + water_tph) * (minutes / 60.0 * s.froth_factor / (1.0 - s.rougher.air))
    return F.greatest(F.lit(1.0), F.ceil(volume / cell_m3).cast("double"))


def with_grinding(rows: DataFrame, s: Settings) -> DataFrame:
    """Crusher, SAG and ball mill in closed circuit: crusher_kw, sag_kw, mill_kw, mill_feed_t, mill_feed_um, water_t."""
    bond = lambda index, f80, p80: plant.bond_energy(F.lit(index), f80, p80)
    p80 = F.col("p80")
    share = 1.0 + s.circulating_load
    sag_um = plant.sag_product(F.lit(s.mill_index), F.lit(s.crusher_p80_um), F.lit(s.sag_kwh_t))
    left = F.greatest(bond(s.mill_index, F.lit(s.crusher_p80_um), p80) - s.sag_kwh_t, F.lit(0.0))
    phi = s.rougher.solids
    rows = rows.withColumns({
        "crusher_kw": plant.crusher_power(F.lit(s.crusher_index), F.lit(s.crusher_f80_um), F.lit(s.crusher_p80_um), F.col("tph")),
        "sag_kw": F.col("tph") * s.sag_kwh_t,
        "mill_kw": left * F.col("tph"),
        "mill_feed_t": F.col("tph") * share,
        "mill_feed_um": (sag_um + p80 * s.circulating_load) / share,
    })
    return rows.withColumn("water_t", F.col("tph") * ((1.0 - phi) / (2.7 * phi)))


def with_rougher(rows: DataFrame, s: Settings) -> DataFrame:
    """Rougher with scavenger: cells, rougher_r, rougher_t, rougher_grade, rougher_water, tails."""
    sized = rows.withColumn("cells", _cells(F.col("tph"), F.col("water_t"), s.minutes, s, s.cell_m3))
    sized = with_flotation(sized, "__r", s.rougher, F.col("p80"), F.col("gas"), s.minutes, F.col("cells"), s.cell_m3)
    ceiling = min(s.cap, MINERALOGY[s.mineralogy][0])
    limit = ceiling * _penalty(F.col("p80"), s.liberation) * _penalty(F.col("gas"), s.flooding) * _penalty(s.rougher.power, s.stripping)
    sized = sized.withColumn("rougher_r", plant.bank_recovery(F.col("__r"), F.lit(s.scavenger), limit)).drop("__r")
    metal, gangue = F.col("tph") * F.col("grade") * F.col("rougher_r"), F.col("tph") * (1.0 - F.col("grade")) * s.gangue
    sized = sized.withColumns({"rougher_t": metal + gangue, "rougher_grade": metal / (metal + gangue)})
    return sized.withColumn("rougher_water", F.least(F.col("rougher_t") * (100.0 / s.concentrate_pct - 1.0), F.col("water_t")))


def with_cleaner(rows: DataFrame, s: Settings) -> DataFrame:
    """Regrind and a cleaner whose tails return to the rougher: regrind_kw, conc_t, conc_grade, conc_water, tails_t, tails_grade.

    The gangue that the bank may pull is solved for the target grade; both returns are closed by R / (1 - r (1 - R)).
    """
    small = 1e-9
    energy = plant.bond_energy(F.lit(s.regrind_index), F.col("p80"), F.lit(s.regrind_um)) * REGRIND_ENERGY[s.regrind_mill]
    rows = rows.withColumn("regrind_kw", F.greatest(energy, F.lit(0.0)) * F.col("rougher_t"))
    rows = with_flotation(rows, "__r", s.cleaner, F.lit(s.regrind_um), F.col("gas"), s.cleaner_minutes, F.lit(6.0), s.cleaner_m3)
    freed = min(1.05, max(0.85, 1.0 - s.cleaner_slope * (s.regrind_um - 30.0)))
    grade, c = F.col("grade"), F.col("rougher_grade")
    metal_in, gangue_in = F.col("rougher_t") * c, F.col("rougher_t") * (1.0 - c)
    rows = rows.withColumns({
        "__rm": _between(F.col("__r") * freed, 0.80, 0.99),
        "__om": metal_in / (F.col("tph") * grade),
        "__og": gangue_in / (F.col("tph") * (1.0 - grade)),
    })
    rm, om, og = F.col("__rm"), F.col("__om"), F.col("__og")
    wanted = rm * c * (1.0 - s.target_grade) / F.greatest(s.target_grade * (1.0 - c), F.lit(small))
    rows = rows.withColumn("__w", wanted)
    rows = rows.withColumn("__rg", _between(F.col("__w") * (1.0 - og) / F.greatest(1.0 - F.col("__w") * og, F.lit(small)), 0.04, 0.20))
    closed = lambda own, before: F.least(F.lit(0.999), own / F.greatest(1.0 - before * (1.0 - own), F.lit(small)))
    rows = rows.withColumns({"__metal": metal_in * closed(rm, om), "__gangue": gangue_in * closed(F.col("__rg"), og)})
    rows = rows.withColumns({"conc_t": F.col("__metal") + F.col("__gangue"), "tails_t": F.col("tph") - F.col("__metal") - F.col("__gangue")})
    rows = rows.withColumns({
        "conc_grade": F.col("__metal") / F.col("conc_t"),
        "conc_water": F.least(F.col("conc_t"), F.col("rougher_water")),
        "tails_grade": (F.col("tph") * grade - F.col("__metal")) / F.col("tails_t"),
    })
    return rows.drop("__r", "__rm", "__om", "__og", "__w", "__rg", "__metal", "__gangue")


def with_dewatering(rows: DataFrame, s: Settings) -> DataFrame:
    """Thickener and belt filter: thickener_m2, filter_m2, cake_mm, cake_water."""
    t = F.col("conc_t")
    rows = rows.withColumns({"thickener_m2": separation.thickener_area(t), "__uf": plant.underflow_water(t, F.col("conc_water"), F.lit(s.underflow_pct))})
    rows = rows.withColumn("__load", separation.cake_loading(t, F.col("__uf")))
    return rows.withColumns({
        "filter_m2": separation.filter_area(t, F.col("__load")),
        "cake_mm": separation.cake_thickness_mm(F.col("__load")),
        "cake_water": separation.cake_water(t, F.col("__uf"), s.moisture),
    }).drop("__uf", "__load")


def with_leach(rows: DataFrame, s: Settings) -> DataFrame:
    """Pressure leach of the concentrate, solvent extraction and electrowinning: cathode_t, bleed_t, residue_t (copper, t/h).

    The circuit's returns are closed like the cleaner's; only the bleed of the electrolyte leaves it for good.
    """
    metal = F.col("conc_t") * F.col("conc_grade")
    if not s.leach:
        return rows.withColumns({"cathode_t": F.lit(0.0), "bleed_t": F.lit(0.0), "residue_t": F.lit(0.0), "acid_kg": F.lit(0.0)})
    rate = plant.leach_rate(F.lit(500.0), F.lit(70.0), F.lit(s.leach_celsius), F.lit(s.oxygen_bar), F.lit(0.7))
    out = plant.leach_extraction(rate, F.lit(s.leach_hours * 3600.0), F.lit(MINERALOGY[s.mineralogy][1]))
    kept = s.pass_efficiency / (1.0 - (1.0 - s.pass_efficiency) * (1.0 - s.bleed))
    return rows.withColumns({
        "cathode_t": metal * out * kept, "bleed_t": metal * out * (1.0 - kept), "residue_t": metal * (1.0 - out), "acid_kg": hydromet.leach_acid(metal * out),
    })


def simulate(rows: DataFrame, s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """Runs the chain over rows (tph, grade, p80 in um, gas in cm/s) and adds recovery and closure.

    closure is the relative difference between the copper that came in and what leaves in concentrate or cathode, bleed,
    residue and tails; null where a row has no copper.
    """
    for stage in (with_grinding, with_rougher, with_cleaner, with_dewatering, with_leach):
        rows = stage(rows, s)
    inflow = F.col("tph") * F.col("grade")
    shipped = F.lit(0.0) if s.leach else F.col("conc_t") * F.col("conc_grade")
    product = shipped + F.col("cathode_t")
    leaving = product + F.col("bleed_t") + F.col("residue_t") + F.col("tails_t") * F.col("tails_grade")
    return rows.withColumns({"recovery": F.try_divide(product, inflow), "closure": F.try_divide(F.abs(inflow - leaving), inflow)})
