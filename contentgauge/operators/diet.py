"""Viewing diets: when, how long, how dense, how varied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from contentgauge.functions.numbers import flag, half_even, ratio
from contentgauge.operators.skew import median_by, previous_in_time, running_total

ZONE = "Europe/Paris"
BURST_MINUTES = 30


def local_time(ts: Column, zone: str = ZONE) -> Column:
    return F.from_utc_timestamp(ts, zone)


def age_days(watched: Column, uploaded: Column) -> Column:
    """Whole days from upload to viewing, rounded down."""
    micros = F.unix_micros(watched) - F.unix_micros(uploaded.cast("timestamp"))
    return F.floor(micros / F.lit(86_400_000_000.0)).cast("long")


def gaps(watches: DataFrame, viewer: str = "user_id", ts: str = "watched_at", tie: str = "event_id") -> DataFrame:
    """dieta_gap_min since the viewer's previous viewing and the burst flag."""
    d = previous_in_time(watches, viewer, ts, tie, "_previous")
    minutes = (F.unix_micros(ts) - F.unix_micros("_previous")) / F.lit(60_000_000.0)
    return d.withColumn("dieta_gap_min", minutes).drop("_previous").withColumn(
        "dieta_en_rafaga", flag(F.col("dieta_gap_min") < BURST_MINUTES))


def diet_rows(watches: DataFrame, items: DataFrame, key: str = "content_id") -> DataFrame:
    """One row per viewing. ``items``: key, duration_seconds, upload_date."""
    local = local_time(F.col("watched_at"))
    timed = gaps(watches).withColumns({
        "dieta_hora_local": F.hour(local), "dieta_dia": F.date_format(local, "yyyy-MM-dd")})
    from contentgauge.operators.skew import salted_join

    slim = items.select(key, "duration_seconds", "upload_date")
    joined = salted_join(timed, slim, key, "event_id", "left", raw=watches.select(key))
    return joined.select(
        "event_id", "user_id", key, age_days(F.col("watched_at"), F.col("upload_date")).alias("dieta_edad_al_ver_dias"),
        "dieta_hora_local", "dieta_dia", half_even(F.col("dieta_gap_min"), 6).alias("dieta_gap_min"),
        "dieta_en_rafaga", (F.col("duration_seconds") / 60.0).alias("dieta_minutos"))


def bursts(watches: DataFrame, viewer: str = "user_id") -> DataFrame:
    """Viewing bursts: runs of viewings under 30 minutes apart, one row per burst."""
    opened = gaps(watches, viewer).withColumn("_opens", F.lit(1) - F.col("dieta_en_rafaga"))
    numbered = running_total(opened, viewer, "watched_at", "event_id", "_opens", "rafaga")
    return numbered.groupBy(viewer, "rafaga").agg(
        F.count(F.lit(1)).alias("videos"), F.min("watched_at").alias("desde"), F.max("watched_at").alias("hasta"))


def minutes_per_day(diet: DataFrame, viewer: str = "user_id") -> DataFrame:
    """Total minutes, active days, minutes per active day. Summed per (viewer, day)
    first, so a hot viewer is folded before it reaches one task."""
    daily = diet.groupBy(viewer, "dieta_dia").agg(F.sum("dieta_minutos").alias("m"))
    return daily.groupBy(viewer).agg(F.sum("m").alias("m"), F.count(F.lit(1)).alias("dias")).select(
        viewer, half_even(F.col("m"), 6).alias("minutos"), "dias",
        half_even(ratio(F.col("m"), F.col("dias")), 6).alias("minutos_por_dia"))


def freshness(diet: DataFrame, viewer: str = "user_id") -> DataFrame:
    """Median age at viewing and share of viewings inside a burst."""
    age = median_by(diet, [viewer], "dieta_edad_al_ver_dias", "frescura_mediana")
    share = diet.groupBy(viewer).agg(half_even(F.avg("dieta_en_rafaga"), 6).alias("p_rafaga"))
    return share.join(age, viewer, "left")


def channel_concentration(watched: DataFrame, viewer: str = "user_id") -> DataFrame:
    """HHI of channels by viewings and by minutes, and the top channel's share."""
    parts = watched.groupBy(viewer, "channel").agg(
        F.count(F.lit(1)).cast("double").alias("v"), F.sum("minutos").alias("m"))
    hhi = lambda c: half_even(ratio(F.sum(F.col(c) * F.col(c)), F.sum(c) * F.sum(c)), 6)
    return parts.groupBy(viewer).agg(
        hhi("v").alias("hhi_videos"), hhi("m").alias("hhi_minutos"),
        half_even(ratio(F.max("v"), F.sum("v")), 6).alias("top1_videos"),
        half_even(ratio(F.max("m"), F.sum("m")), 6).alias("top1_minutos"))


def share_of_minutes(watched: DataFrame, condition: Column, name: str, viewer: str = "user_id") -> DataFrame:
    sums = watched.groupBy(viewer).agg(
        F.sum(F.when(condition, F.col("minutos")).otherwise(0.0)).alias("a"), F.sum("minutos").alias("b"))
    return sums.select(viewer, half_even(ratio(F.col("a"), F.col("b")), 6).alias(name))


def category_denominators(watched: DataFrame, category: str = "category_id") -> DataFrame:
    """Share of every category by viewings and by minutes."""
    sums = watched.groupBy(category).agg(F.count(F.lit(1)).alias("videos"), F.sum("minutos").alias("m"))
    total = sums.agg(F.sum("videos").alias("_v"), F.sum("m").alias("_m"))
    return sums.join(F.broadcast(total)).select(
        category, "videos", half_even(ratio(F.col("videos"), F.col("_v")), 6).alias("p_videos"),
        half_even(ratio(F.col("m"), F.col("_m")), 6).alias("p_minutos"))


def weekly_rollup(placed: DataFrame, zone: str = ZONE) -> DataFrame:
    """Median percentile per (local week, format, descriptor)."""
    week = F.date_format(F.date_trunc("week", local_time(F.col("watched_at"), zone)), "yyyy-MM-dd")
    return median_by(placed.withColumn("semana", week), ["semana", "formato", "descriptor"], "percentil", "mediana")


def daily_totals(watched: DataFrame) -> DataFrame:
    """Viewings and minutes per viewer and local day."""
    day = F.date_format(local_time(F.col("watched_at")), "yyyy-MM-dd")
    return watched.groupBy("user_id", day.alias("dia")).agg(
        F.count(F.lit(1)).alias("videos"), half_even(F.sum("minutos"), 6).alias("minutos"))
