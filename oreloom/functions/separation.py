"""Sizing of separators as Column expressions: thickener, belt filter, vibrating screen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Short tons per tonne, square feet per square metre, feet per metre, pounds per cubic foot of 1 t/m3.
SHORT_TONS, SQUARE_FEET, FEET, POUNDS_PER_CUBIC_FOOT = 1.10231, 10.7639, 3.28084, 62.4280


def thickener_area(solids_tph: Column, settling_m_h: float = 8.0, crowding: float = 0.4, n: float = 4.6, density: float = 2.7, safety: float = 1.25) -> Column:
    """m2 that keep the feed flux below the largest that hindered settling (Richardson-Zaki) lets through."""
    flux = 4.0 * settling_m_h / crowding * n * (n - 1.0) ** (n - 1.0) / (n + 1.0) ** (n + 1.0)
    return solids_tph * safety / (density * flux)


def diameter(area: Column) -> Column:
    """Diameter of a round tank."""
    return F.sqrt(area * 4.0 / math.pi)


def cake_loading(
    solids_tph: Column, water_tph: Column, resistance: float = 1e11, medium: float = 1e10, pressure_pa: float = 70_000.0, forming_s: float = 60.0, viscosity: float = 1e-3
) -> Column:
    """kg of dry cake per m2 at constant pressure (Ruth): the positive root of the quadratic in filtrate per area; 0 without water."""
    per_volume = F.try_divide(solids_tph * 1000.0, water_tph)
    a = per_volume * (viscosity * resistance / (2.0 * pressure_pa))
    b = viscosity * medium / pressure_pa
    filtrate = F.try_divide(F.sqrt(4.0 * forming_s * a + b * b) - b, 2.0 * a)
    return F.coalesce(per_volume * filtrate, F.lit(0.0))


def cake_thickness_mm(loading: Column, bulk_kg_m3: float = 2000.0) -> Column:
    return loading * 1000.0 / bulk_kg_m3


def filter_area(solids_tph: Column, loading: Column, cycle_s: float = 200.0) -> Column:
    """m2 of belt for a throughput; null where no cake forms."""
    return F.try_divide(solids_tph * (1000.0 / 3600.0 * cycle_s), loading)


def cake_water(solids_tph: Column, water_tph: Column, moisture: float) -> Column:
    """t/h of water that leave with the cake at the stated moisture, at most what came in."""
    return F.least(solids_tph * (moisture / (1.0 - moisture)), water_tph)


def deck_area(undersize_tph: Column, base: float = 4.5, factors: float = 1.0) -> Column:
    """m2 of a screen deck: tonnage that passes over the base capacity (short tons per hour and square foot) times its factors."""
    return undersize_tph * SHORT_TONS / (base * factors) / SQUARE_FEET


def bed_depth_in(oversize_tph: Column, width_m: float = 2.4, travel_fpm: float = 75.0, bulk_t_m3: float = 1.6) -> Column:
    """Depth in inches of the bed at the discharge end of a deck."""
    cubic_feet = 2000.0 / (bulk_t_m3 * POUNDS_PER_CUBIC_FOOT)
    return oversize_tph * SHORT_TONS * cubic_feet / (5.0 * travel_fpm * width_m * FEET)


def bed_is_shallow(depth_in: Column, aperture_mm: float, most: float = 4.0) -> Column:
    """Whether the bed is at most so many apertures deep."""
    return depth_in <= most * aperture_mm / 25.4
