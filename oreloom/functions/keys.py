"""Key and name normalisation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from oreloom.session import WHITESPACE


def strip(col: Column) -> Column:
    """Remove white space (Unicode too) at both ends."""
    return F.btrim(col, F.lit(WHITESPACE))


def norm_key(col: Column) -> Column:
    """Normalised key: stripped, lower case, blank counts as null."""
    return F.nullif(F.lower(strip(col)), F.lit(""))
