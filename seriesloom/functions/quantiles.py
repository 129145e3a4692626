"""The six quantile conventions of the data model, over arrays (bounded); over groups of any size: ``selection``.

Each operator states which one it uses; they differ in how positions between two
values and empty inputs are treated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Turns a median absolute deviation into a standard deviation (fixed value).
MAD_SCALE = 1.4826


def finite(x: Column) -> Column:
    """``x``, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def linear(x: Column, p: float) -> Column:
    """Interpolated at (n - 1) p; values that are not finite are left out."""
    return F.percentile(finite(x), p)


def sorted_at(values: Column, place: Column) -> Column:
    """Element ``place`` (from 0) of the sorted array; null for an empty one."""
    return F.when(F.size(values) > 0, F.element_at(F.array_sort(values), place.cast("int") + 1))


def array_median(values: Column) -> Column:
    """Mean of the two middle elements."""
    n = F.size(values)
    return (sorted_at(values, F.floor(n / 2)) + sorted_at(values, F.floor((n - 1) / 2))) / 2


def array_median_upper(values: Column) -> Column:
    return sorted_at(values, F.floor(F.size(values) / 2))


def array_median_lower(values: Column) -> Column:
    return sorted_at(values, F.floor((F.size(values) - 1) / 2))


def array_floor(values: Column, p: float) -> Column:
    """The element at floor(p (n - 1))."""
    return sorted_at(values, F.floor(F.lit(p) * (F.size(values) - 1)))
