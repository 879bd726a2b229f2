"""Spherical Mercator on the unit square: x to the east, y to the south."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

FULL_TURN = 2 * math.pi


def mercator_x(lon: Column) -> Column:
    return F.radians(lon) / FULL_TURN


def mercator_y(lat: Column) -> Column:
    return -F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) / FULL_TURN


GRID_BITS = 16
_SPREAD = ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555))


def grid(value: Column, low: float, high: float) -> Column:
    """The cell of a coordinate among 2^16 between low and high; beyond them the first or last, NaN and NULL none."""
    cells = 1 << GRID_BITS
    scaled = F.floor((value.cast("double") - low) / (high - low) * cells)
    known = value.isNotNull() & ~F.isnan(value.cast("double"))
    return F.when(known, F.greatest(F.lit(0), F.least(scaled, F.lit(cells - 1)))).cast("long")


def morton(x: Column, y: Column) -> Column:
    """Bits of two cells in turn: cells of a coarser grid share the leading bits of their codes."""

    def spread(v: Column) -> Column:
        for shift, mask in _SPREAD:
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return v

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))
