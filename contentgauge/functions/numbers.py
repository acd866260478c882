"""Number helpers shared by every operator."""

from __future__ import annotations

from functools import reduce

import math

from pyspark.sql import Column, functions as F


def half_even(c: Column, digits: int) -> Column:
    """Round to ``digits`` decimals, ties to even, on the double itself."""
    scale = float(10 ** digits)
    return F.rint(c * F.lit(scale)) / F.lit(scale)


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, null when b is 0 or either is null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def clean_number(c: Column) -> Column:
    """NaN and the infinities become null."""
    d = c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == F.lit(math.inf)), None).otherwise(d)


def flag(c: Column) -> Column:
    """1 when true, 0 when false or null."""
    return F.when(c, F.lit(1)).otherwise(F.lit(0))


def cap_width(c: Column, n: int) -> Column:
    """Trim, keep n characters, empty becomes null."""
    from contentgauge.functions.text import strip

    return F.nullif(F.left(strip(c), F.lit(n)), F.lit(""))


def _iso_part(c: Column, pattern: str, unit: str) -> Column:
    digits = F.regexp_extract(c, pattern, 1) if unit == "" else F.regexp_extract(c, rf"(\d+){unit}", 1)
    # null, not a wrong number, where the digits exceed a long
    return F.when(digits == "", F.lit(0).cast("long")).otherwise(digits.try_cast("bigint"))


def iso_seconds(c: Column, with_days: bool = False) -> Column:
    """ISO-8601 duration to seconds.

    Without days: only ``PT..`` forms are read and a zero length is null. With
    days: ``P1DT..`` is read as well and zero stays zero.
    """
    full = r"^P(?:\d+D)?T(?:\d+H)?(?:\d+M)?(?:\d+S)?$" if with_days else r"^PT(?:\d+H)?(?:\d+M)?(?:\d+S)?$"
    clock = F.regexp_extract(c, r"T(.*)$", 1)
    parts = [(_iso_part(clock, "", "H"), 3600), (_iso_part(clock, "", "M"), 60), (_iso_part(clock, "", "S"), 1)]
    if with_days:
        parts.append((_iso_part(c, r"^P(\d+)D", ""), 86400))
    total = reduce(F.try_add, [F.try_multiply(part, F.lit(unit)) for part, unit in parts])
    if not with_days:
        total = F.nullif(total, F.lit(0).cast("long"))
    return F.when(F.regexp_like(c, F.lit(full)), total)
