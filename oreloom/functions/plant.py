"""Plant unit operations as Column expressions of a scenario row. No economics: prices are left out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Coefficients of the Plitt hydrocyclone model and the gas constant.
PLITT_CUT, PLITT_DROP, PLITT_SPLIT, PLITT_SHARP = 0.0387, 51.27, 0.1953, 0.1762
GAS_CONSTANT = 8.314


def bond_energy(work_index: Column, f80_um: Column, p80_um: Column) -> Column:
    """kWh per tonne from feed size to product size (third theory of comminution)."""
    return work_index * 10.0 * (1 / F.sqrt(p80_um) - 1 / F.sqrt(f80_um))


def crusher_power(work_index: Column, f80_um: Column, p80_um: Column, tph: Column, drive: float = 0.95, lump: float = 1.0, idle_kw: float = 0.0) -> Column:
    """kW drawn: idle plus Bond energy over the drive's efficiency."""
    return F.lit(idle_kw) + bond_energy(work_index, f80_um, p80_um) * lump / drive * tph


def sag_product(work_index: Column, f80_um: Column, kwh_per_t: Column) -> Column:
    """Product size that a specific energy reaches (Bond inverted)."""
    return F.pow(kwh_per_t / (10.0 * work_index) + 1 / F.sqrt(f80_um), F.lit(-2.0))


def breakage_t10(a: Column, b: Column, kwh_per_t: Column) -> Column:
    """Drop-weight t10 = A (1 - exp(-b E))."""
    return a * (1 - F.exp(-b * kwh_per_t))


def cyclone_cut(dc: Column, di: Column, do: Column, du: Column, h: Column, flow_lpm: Column, vol_pct: Column, rho_s: float = 2.7, rho_f: float = 1.0) -> Column:
    """d50 in micrometres (Plitt); cyclone, inlet, overflow and underflow diameters and free height in cm."""
    top = 50.5 * F.pow(dc, F.lit(0.46)) * F.pow(di, F.lit(0.6)) * F.pow(do, F.lit(1.21)) * F.exp(0.063 * vol_pct)
    return PLITT_CUT * top / (F.pow(du, F.lit(0.71)) * F.pow(h, F.lit(0.38)) * F.pow(flow_lpm, F.lit(0.45)) * (rho_s - rho_f))


def cyclone_pressure(dc: Column, di: Column, do: Column, du: Column, h: Column, flow_lpm: Column, vol_pct: Column) -> Column:
    """Pressure drop in kPa (Plitt)."""
    top = 1.88 * F.pow(flow_lpm, F.lit(1.78)) * F.exp(0.0055 * vol_pct)
    return PLITT_DROP * top / (F.pow(dc, F.lit(0.37)) * F.pow(di, F.lit(0.94)) * F.pow(h, F.lit(0.28)) * F.pow(du * du + do * do, F.lit(0.87)))


def cyclone_split(dc: Column, do: Column, du: Column, h: Column, head_m: Column, vol_pct: Column) -> Column:
    """Flow split S (Plitt)."""
    top = 1.9 * F.pow(du / do, F.lit(3.31)) * F.pow(h, F.lit(0.54)) * F.pow(du * du + do * do, F.lit(0.36)) * F.exp(0.0054 * vol_pct)
    return PLITT_SPLIT * top / (F.pow(head_m, F.lit(0.24)) * F.pow(dc, F.lit(1.11)))


def cyclone_sharpness(do: Column, split: Column, flow_lpm: Column) -> Column:
    """Slope of the efficiency curve; the water recovery is S / (S + 1)."""
    return PLITT_SHARP * 1.94 * F.exp(-1.58 * (split / (split + 1)) * F.pow(do * do / flow_lpm, F.lit(0.15)))


def to_underflow(size_um: Column, d50: Column, sharpness: Column) -> Column:
    """Share of particles of a size that report to the underflow."""
    return 1 - F.exp(-0.693 * F.pow(size_um / d50, sharpness))


def bank_recovery(cell: Column, scavenger: Column, cap: Column) -> Column:
    """Rougher plus scavenger on its tails, capped."""
    return F.least(cell + (1 - cell) * scavenger, cap)


def repeated_cells(cell: Column, n: Column) -> Column:
    """Recovery of n equal cells in a row, each on the tails of the one before."""
    return 1 - F.pow(1 - cell, n)


def underflow_water(solids_tph: Column, water_tph: Column, target_pct: Column) -> Column:
    """P5: water leaving a thickener with the solids at the target percentage, at most what came in."""
    return F.least(solids_tph * (100.0 / target_pct - 1.0), water_tph)


def leach_rate(k0: Column, ea_kj: Column, celsius: Column, oxygen_bar: Column, order: Column) -> Column:
    """Rate constant per second: k0 exp(-Ea / RT) P^n."""
    return k0 * F.exp(-ea_kj * 1000.0 / (GAS_CONSTANT * (celsius + 273.15))) * F.pow(oxygen_bar, order)


def leach_extraction(rate: Column, seconds: Column, ceiling: Column) -> Column:
    """Shrinking particle, 1 - (1 - kt)^3, complete once kt reaches 1, capped at the ceiling."""
    left = F.greatest(1 - rate * seconds, F.lit(0.0))
    return F.least(ceiling, 1 - left * left * left)


def mix(parts: list[tuple[Column, Column]]) -> Column:
    """Mass-weighted mean of (mass, value) streams; null without mass."""
    mass = sum((m for m, _ in parts[1:]), parts[0][0])
    return F.try_divide(sum((m * v for m, v in parts[1:]), parts[0][0] * parts[0][1]), mass)


def closure_error(inflow: Column, outflows: list[Column]) -> Column:
    """Relative mass-balance error."""
    return F.abs(inflow - sum(outflows[1:], outflows[0])) / F.greatest(F.abs(inflow), F.lit(1e-12))


def breakage_matrix(top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
    """Lower-triangular distribution of broken material: class j receives from class i by the distance j - i alone,
    and the finest class takes what is left of each column.
    """
    n = len(top)
    passed = (1 - np.exp(-bottom / top[0])) / (1 - np.exp(-1.0))
    first = -np.diff(np.concatenate([[1.0], passed]))
    out = np.zeros((n, n))
    for i in range(n):
        out[i:, i] = first[: n - i]
        out[n - 1, i] = 1 - out[: n - 1, i].sum()
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def grind(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Size distribution after a number of breakage cycles (tonnage, top, bottom, selection arrays, cycles);
    between whole numbers of cycles the two results are interpolated. Mass is kept.
    """
    for tonnage, top, bottom, selection, cycles in batches:
        out = []
        for t, a, b, s, k in zip(tonnage, top, bottom, selection, cycles, strict=True):
            t, a, b, s = (np.asarray(x, float) for x in (t, a, b, s))
            step = breakage_matrix(a, b) @ np.diag(s) + np.eye(len(t)) - np.diag(s)
            low = int(np.floor(k))
            before = np.linalg.matrix_power(step, low) @ t
            out.append(((step @ before) * (k - low) + before * (low + 1 - k)).tolist())
        yield pd.Series(out)
