"""Column helpers."""

from strandline.functions.exact import exact_sum, from_units, units

__all__ = ["exact_sum", "from_units", "units"]
