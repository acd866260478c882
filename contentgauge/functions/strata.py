"""Stratum columns, shared by the sample and by everything measured against it."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from contentgauge.functions import lexicons as L
from contentgauge.functions.text import sql_list


def lookup(table: dict[str, str], key: Column) -> Column:
    pairs = sql_list(x for item in table.items() for x in item)
    return F.try_element_at(F.expr(f"map({pairs})"), key)


def category_format(category_id: Column) -> Column:
    return lookup(L.CATEGORY_FORMAT, F.coalesce(category_id, F.lit("")))


def category_name(category_id: Column, default: str | None = None) -> Column:
    name = lookup(L.CATEGORY_NAMES, F.coalesce(category_id, F.lit("")))
    return name if default is None else F.coalesce(name, F.lit(default))


def category_id(name: Column) -> Column:
    return lookup({v: k for k, v in L.CATEGORY_NAMES.items()}, F.coalesce(name, F.lit("")))


def duration_bucket(seconds: Column) -> Column:
    return (
        F.when(seconds < L.MIN_SECONDS, None)
        .when(seconds < L.SHORT_SECONDS, "corto")
        .when(seconds < L.MEDIUM_SECONDS, "medio")
        .when(seconds <= L.MAX_SECONDS, "largo")
    )
