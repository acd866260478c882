"""Building blocks that hold when one key owns a third of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

SALTS = 32
ROWS_PER_TASK = 2_000_000


def histogram(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows per (keys, value), nulls left out. Combined before the shuffle, so a hot
    key sends one row per distinct value and task."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("freq"))


def quantile(value: str | Column, shares: float | Sequence[float], freq: str | Column = "freq") -> Column:
    """Exact interpolated quantiles over a histogram, null without rows."""
    freq = F.col(freq) if isinstance(freq, str) else freq
    if isinstance(shares, (int, float)):
        return F.percentile(value, F.lit(float(shares)), freq)
    return F.percentile(value, F.array(*[F.lit(float(s)) for s in shares]), freq)


def median_by(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    return histogram(df, keys, value).groupBy(*keys).agg(quantile(value, 0.5).alias(name))


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, spread: Column, salts: int = SALTS,
    rank: str = "rank",
) -> DataFrame:
    """First k rows of every group, exact, in two steps: first the best k of every
    slice of the group, then the best k of those. ``spread`` places rows in slices."""
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(spread), F.lit(salts)))
    first = Window.partitionBy(*keys, "_slice").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    best = sliced.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k)
    return best.drop("_slice", "_r").withColumn(rank, F.row_number().over(final)).where(F.col(rank) <= k)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of every key; an aggregate, so duplicates of a hot key are folded
    before the shuffle instead of being sorted in one task."""
    rest = [c for c in df.columns if c not in keys]
    folded = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return folded.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def hot_keys(df: DataFrame, key: str | Sequence[str], per_task: int) -> DataFrame:
    """(key, _salts): keys with more rows than a task should hold, and over how many to deal them."""
    keys = [key] if isinstance(key, str) else list(key)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > per_task)
    return counts.select(*keys, F.ceil(F.col("_n") / per_task).cast("int").alias("_salts"))


def salted_join(
    rows: DataFrame, lookup: DataFrame, key: str | Sequence[str], row_id: str, how: str = "inner",
    per_task: int = ROWS_PER_TASK, raw: DataFrame | None = None,
) -> DataFrame:
    """rows ⋈ lookup on ``key`` (one column or several) where a few keys may hold most of ``rows``.

    Rows of a hot key are dealt over as many tasks as its own count asks for, and only the
    lookup rows of hot keys are repeated as often. Keys are counted on ``raw``, a cheaper table
    with the same keys (``rows`` where there is none). Plan side only, no action.
    """
    # no more keys than rows / per_task, half a million for 10^12 rows
    keys = [key] if isinstance(key, str) else list(key)
    hot = F.broadcast(hot_keys(raw if raw is not None else rows, keys, per_task))
    dealt = rows.join(hot, keys, "left").withColumn(
        "_salt", F.coalesce(F.pmod(F.xxhash64(row_id), F.col("_salts")).cast("int"), F.lit(0))).drop("_salts")
    copies = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    repeated = lookup.join(hot, keys, "left").withColumn("_salt", F.explode(copies)).drop("_salts")
    return dealt.join(repeated, [*keys, "_salt"], how).drop("_salt")


def previous_in_time(
    df: DataFrame, key: str, ts: str, tie: str, name: str = "previous", every: str = "day"
) -> DataFrame:
    """``name``: the preceding ``ts`` of the same key, null for the first.

    A key's rows are cut into periods. Inside a period the window sees that period
    only; its first row takes the end of the key's previous period, from a table
    with one row per key and period.
    """
    cut = df.withColumn("_period", F.date_trunc(every, F.col(ts)))
    inside = Window.partitionBy(key, "_period").orderBy(ts, tie)
    ends = cut.where(F.col(ts).isNotNull()).groupBy(key, "_period").agg(F.max(ts).alias("_end"))
    ends = ends.select(
        key, "_period", F.lag("_end").over(Window.partitionBy(key).orderBy("_period")).alias("_before")
    )
    joined = cut.withColumn("_lag", F.lag(ts).over(inside)).join(ends, [key, "_period"], "left")
    return joined.withColumn(name, F.coalesce("_lag", "_before")).drop("_period", "_lag", "_before")


def running_total(
    df: DataFrame, key: str, ts: str, tie: str, value: str, name: str, every: str = "day"
) -> DataFrame:
    """Running sum of ``value`` per key in time order, cut into periods likewise."""
    cut = df.withColumn("_period", F.date_trunc(every, F.col(ts)))
    inside = Window.partitionBy(key, "_period").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    sums = cut.groupBy(key, "_period").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(key).orderBy("_period").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, "_period", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    joined = cut.withColumn("_inside", F.sum(value).over(inside)).join(sums, [key, "_period"])
    return joined.withColumn(name, F.col("_inside") + F.col("_offset")).drop("_period", "_inside", "_offset")


def _cell(column: str, low: str, span: str, cells: int) -> Column:
    share = (F.col(column) - F.col(low)).cast("double") * cells / F.col(span)
    return F.least(F.floor(share), F.lit(cells - 1)).cast("int")


def numbered(df: DataFrame, value: str, row_id: str, name: str = "position", cells: int = 4096) -> DataFrame:
    """0-based position of every row ordered by (value desc, row_id asc), without one
    global sort: the place inside a (value, id cell) plus the sizes of what precedes.

    ``value`` is numeric and ``row_id`` a unique integer. Their ranges are cut into
    cells: one window sees the value cells only, the next the values of one value cell,
    the next the id cells of one value, the last the rows of one id cell, which are no
    more than the ids that fit in it.
    """
    span = df.agg(
        F.min(row_id).alias("_ilo"), (F.max(row_id) - F.min(row_id) + 1).alias("_ispan"),
        F.min(value).alias("_vlo"), (F.max(value) - F.min(value) + 1).alias("_vspan"))
    placed = df.join(F.broadcast(span)).withColumns({
        "_cell": _cell(row_id, "_ilo", "_ispan", cells), "_vcell": _cell(value, "_vlo", "_vspan", cells),
    }).drop("_ilo", "_ispan", "_vlo", "_vspan")
    sizes = placed.groupBy("_vcell", value, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    by_value = sizes.groupBy("_vcell", value).agg(F.sum("_n").alias("_vn"))
    by_range = by_value.groupBy("_vcell").agg(F.sum("_vn").alias("_rn"))

    def preceding(column: str, window) -> Column:
        return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    by_range = by_range.select("_vcell", preceding("_rn", Window.orderBy(F.desc("_vcell"))).alias("_r0"))
    by_value = by_value.select(
        "_vcell", value, preceding("_vn", Window.partitionBy("_vcell").orderBy(F.desc(value))).alias("_v0"))
    starts = sizes.select(
        "_vcell", value, "_cell", preceding("_n", Window.partitionBy("_vcell", value).orderBy("_cell")).alias("_c0"))
    starts = starts.join(by_value, ["_vcell", value]).join(F.broadcast(by_range), "_vcell").select(
        value, "_cell", (F.col("_r0") + F.col("_v0") + F.col("_c0")).alias("_start"))
    inside = Window.partitionBy(value, "_cell").orderBy(row_id)
    return (
        placed.withColumn("_r", F.row_number().over(inside) - 1).join(starts, [value, "_cell"])
        .withColumn(name, F.col("_start") + F.col("_r")).drop("_cell", "_vcell", "_r", "_start")
    )
