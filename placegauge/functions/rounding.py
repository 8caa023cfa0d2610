"""Rounding and summing that agree with IEEE arithmetic to the last bit.

``bround`` works on the shortest decimal text of a double, so 0.15 counts as a tie there although
the stored value is below it.  ``round_half_even`` decides on the stored value instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2**27 + 1, cuts a double into two halves of 26 bits


def round_half_even(x: Column, digits: int = 0) -> Column:
    """Nearest multiple of 10**-digits to the stored double, ties to even. Null stays null."""
    x = x.cast("double")
    if digits == 0:
        return F.rint(x)
    scale = F.lit(float(10**digits))
    scaled = x * scale
    # What the multiplication lost: the two halves times the scale are both exact.
    head = x * F.lit(_SPLIT) - (x * F.lit(_SPLIT) - x)
    lost = (head * scale - scaled) + (x - head) * scale
    floor = F.floor(scaled).cast("double")
    on_tie = (scaled - floor) == F.lit(0.5)
    units = (
        F.when(on_tie & (lost > 0), floor + 1.0)
        .when(on_tie & (lost < 0), floor)
        .otherwise(F.rint(scaled))
    )
    return units / scale


def compensated_sum(terms: list[Column]) -> Column:
    """Sum in list order with the rounding error carried along (Neumaier)."""

    def add(state: tuple[Column, Column], term: Column) -> tuple[Column, Column]:
        total, carry = state
        new = total + term
        error = F.when(F.abs(total) >= F.abs(term), (total - new) + term).otherwise(
            (term - new) + total
        )
        return new, carry + error

    total, carry = reduce(add, terms, (F.lit(0.0), F.lit(0.0)))
    return total + carry
