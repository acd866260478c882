"""Links and time marks in descriptions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from contentgauge.functions import lexicons as L


def _hosts(hosts: list[str]) -> str:
    return "(?i)(" + "|".join(re.escape(h) for h in hosts) + ")"


SOCIAL = _hosts(L.SOCIAL_HOSTS)
TRACEABLE = _hosts(L.TRACEABLE_HOSTS)
TIME_MARK = r"(?<![\p{L}\p{N}_])\d{1,2}:\d{2}(?::\d{2})?(?![\p{L}\p{N}_])"


def links(description: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(description, F.lit("")), F.lit(L.URL_PATTERN), F.lit(0))


def external(urls: Column) -> Column:
    return F.filter(urls, lambda u: ~F.regexp_like(u, F.lit(SOCIAL)))


def traceable(urls: Column) -> Column:
    return F.filter(urls, lambda u: F.regexp_like(u, F.lit(TRACEABLE)))


def time_marks(description: Column) -> Column:
    return F.regexp_count(F.coalesce(description, F.lit("")), F.lit(TIME_MARK))
