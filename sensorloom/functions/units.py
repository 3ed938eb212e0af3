"""Units and the kind of quantity each implies."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

# The unit vocabulary of the measurement catalog.
KIND_BY_UNIT = {
    "%": "ratio",
    "ratio": "ratio",
    "1/100": "other",
    "count": "count",
    "#/0.1L": "count",
    "bytes": "other",
    "ppb": "concentration",
    "ppm": "concentration",
    "ug/m3": "concentration",
    "A": "physical_property",
    "V": "physical_property",
    "MOhm": "physical_property",
    "bpm": "physical_property",
    "dBm": "physical_property",
    "deg": "physical_property",
    "degC": "physical_property",
    "g/m3": "physical_property",
    "hPa": "physical_property",
    "kg": "physical_property",
    "lux": "physical_property",
    "m/s": "physical_property",
    "mm": "physical_property",
    "s": "physical_property",
    "uR/h": "physical_property",
    "um": "physical_property",
}

# The four data-quality fields, in catalog order, with units.
QUALITY_FIELD_UNITS = {
    "completeness_ratio": "ratio",
    "observed": "count",
    "expected": "count",
    "largest_gap_seconds": "s",
}


def quantity_kind(unit: Column) -> Column:
    """Kind of quantity, null for an unknown, blank or missing unit."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(KIND_BY_UNIT.items())])
    return F.try_element_at(table, unit)
