"""Instants as microseconds, so both engines print the same number."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def stamp(c: Column | str) -> Column:
    return F.unix_micros(F.col(c) if isinstance(c, str) else c)


stamp.sql = lambda expression: f"epoch_us({expression})"
