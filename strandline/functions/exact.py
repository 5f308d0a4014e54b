"""Sums that do not depend on the order in which partitions are added up.

Floating point addition gives other last digits for other partitionings. Columns with a fixed number
of decimal places are turned into whole units instead, and added without loss or overflow.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# A whole number is added as two parts, each in a bigint of its own: the low 20 bits, whose sum is
# safe for 2**43 rows, and the rest, whose sum is safe while the values' mean times their number is below 2**83. Decimal sums are as exact but take over three times as long.
LOW_BITS = 20
LOW_MASK = (1 << LOW_BITS) - 1


def units(column: Column | str, scale: int) -> Column:
    """A column with ``scale`` decimal places as a whole number of its smallest units.

    A value with more decimal places than that raises an error: it is further from a whole number of units than
    a double's own rounding takes it.
    """
    column = F.col(column) if isinstance(column, str) else column
    scaled = column * 10**scale
    whole = F.rint(scaled)
    off = F.abs(scaled - whole) > F.greatest(F.abs(scaled) * 1e-15, F.lit(1e-6))
    wrong = F.raise_error(F.format_string(f"%s has more than {scale} decimal places", column.cast("string"))).cast("double")
    return F.when(off, wrong).otherwise(whole).cast("bigint")


def exact_sum(whole: Column | str) -> Column:
    """The sum of a bigint column, as a decimal. Either part overflows, with an error, beyond 2**63:
    with values near the limit of a bigint after about 2**20 rows, with values below 2**50 not before 2**33."""
    whole = F.col(whole) if isinstance(whole, str) else whole
    low = F.sum(whole.bitwiseAND(F.lit(LOW_MASK).cast("bigint"))).cast("decimal(20,0)")
    high = F.sum(F.shiftright(whole, LOW_BITS)).cast("decimal(20,0)")
    return high * F.lit(1 << LOW_BITS).cast("decimal(8,0)") + low


def from_units(total: Column | str, scale: int) -> Column:
    """A total of units back as a double."""
    total = F.col(total) if isinstance(total, str) else total
    return total.cast("double") / float(10**scale)
