"""Validation statistics: correlation, explained variance, concentration, agreement."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from contentgauge.functions import lexicons as L
from contentgauge.functions.numbers import half_even, ratio
from contentgauge.operators.skew import quantile
from contentgauge.session import cut_lineage


def explained_variance(long: DataFrame, group: str) -> DataFrame:
    """Share of a descriptor's variance explained by a grouping, per descriptor.
    Null under 12 rows, under 3 distinct values, or without variance."""
    rows = long.where(F.col("value").isNotNull() & F.col(group).isNotNull())
    by_group = rows.groupBy("descriptor", group).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    distinct = rows.groupBy("descriptor").agg(F.count_distinct("value").alias("d"))
    total = by_group.groupBy("descriptor").agg(
        F.sum("n").alias("rows"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    parts = by_group.join(F.broadcast(total), "descriptor").groupBy("descriptor").agg(
        F.max("rows").alias("rows"), F.sum(F.col("n") * F.pow(F.col("m") - F.col("mean"), 2)).alias("between"),
        F.sum(F.col("n") * F.col("v")).alias("within"))
    usable = (F.col("rows") >= 12) & (F.col("d") >= 3)
    eta = F.when(usable, ratio(F.col("between"), F.col("between") + F.col("within")))
    return parts.join(F.broadcast(distinct), "descriptor").select("descriptor", half_even(eta, 6).alias("eta2"))


def log_seconds(c: str = "duration_seconds") -> Column:
    return F.when(F.col(c) > 0, F.ln(F.col(c).cast("double")))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson over the complete pairs, null when one side is constant."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def duration_correlation(long: DataFrame) -> DataFrame:
    """Pearson of every descriptor with ln(duration), over all rows."""
    return long.groupBy("descriptor").agg(
        F.count("value").alias("n"),
        half_even(safe_corr(F.col("value"), log_seconds()), 6).alias("corr_log_dur_global"))


def duration_correlation_in_cells(long: DataFrame, min_rows: int = 8) -> DataFrame:
    """The same inside each cell (8 rows, over 2 distinct values): the strongest with
    its sign, and the mean."""
    rows = long.where("formato is not null and duracion is not null")
    per_cell = rows.groupBy("descriptor", "formato", "duracion").agg(
        F.count("value").alias("n"), F.count_distinct("value").alias("d"),
        safe_corr(F.col("value"), log_seconds()).alias("r")).where(f"n >= {min_rows} and d > 2 and r is not null")
    return per_cell.groupBy("descriptor").agg(
        F.count(F.lit(1)).alias("celdas"),
        half_even(F.max_by("r", F.abs("r")), 6).alias("corr_log_dur_intra_max"),
        half_even(F.avg("r"), 6).alias("corr_log_dur_intra_media"))


def correlation_matrix(wide: DataFrame, columns: Sequence[str] = tuple(L.PANEL)) -> DataFrame:
    """Pairwise complete Pearson of every pair, one pass, one row per pair."""
    pairs = list(combinations(columns, 2))
    row = wide.agg(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"),
                 safe_corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("r")).alias(f"p{i}")
        for i, (a, b) in enumerate(pairs)
    ])
    return row.select(F.inline(F.array(*[F.col(f"p{i}") for i in range(len(pairs))]))).withColumn(
        "r", half_even(F.col("r"), 6))


def strongest_pairs(matrix: DataFrame, k: int = 5) -> DataFrame:
    return matrix.where("r is not null").orderBy(F.desc(F.abs("r")), "a", "b").limit(k)


def concentration(df: DataFrame, key: Column, weight: Column | None = None) -> DataFrame:
    """Herfindahl-Hirschman index, top share and number of keys."""
    part = F.count(F.lit(1)) if weight is None else F.sum(weight)
    parts = df.groupBy(key.alias("k")).agg(part.cast("double").alias("x"))
    return parts.agg(F.sum("x").alias("t"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.max("x").alias("m"),
                     F.count(F.lit(1)).alias("claves")).select(
        half_even(ratio(F.col("xx"), F.col("t") * F.col("t")), 6).alias("hhi"),
        half_even(ratio(F.col("m"), F.col("t")), 6).alias("top1"), "claves")


# ------------------------------------------------------------------ agreement


def cohen_kappa(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """n, raw agreement and Cohen's kappa; null when there is nothing to correct."""
    counts = pairs.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    both = counts.select(F.inline(F.array(
        F.struct(F.col("a").alias("label"), F.col("n").alias("na"), F.lit(0).cast("long").alias("nb")),
        F.struct(F.col("b").alias("label"), F.lit(0).cast("long").alias("na"), F.col("n").alias("nb")))))
    margins = both.groupBy("label").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb")).agg(
        F.sum(F.col("na").cast("double") * F.col("nb")).alias("cross"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
                       F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    observed = ratio(F.col("same"), F.col("n"))
    expected = ratio(F.col("cross"), F.col("n").cast("double") * F.col("n"))
    kappa = F.when(expected < 1, ratio(observed - expected, 1 - expected))
    return total.join(F.broadcast(margins)).select(
        "n", F.col("same").alias("acuerdos"), half_even(observed, 6).alias("acuerdo"),
        half_even(kappa, 6).alias("kappa")).withColumn("lectura", kappa_band(F.col("kappa")))


def kappa_band(k: Column) -> Column:
    return (
        F.when(k.isNull(), "no calculable").when(k < 0.20, "pobre").when(k < 0.40, "debil").when(k < 0.60, "moderado")
        .when(k < 0.80, "sustancial").otherwise("casi perfecto")
    )


def cross_table(pairs: DataFrame, labels: Sequence[str], a: str = "a", b: str = "b") -> DataFrame:
    """Rows: a; one column per label of b; zeros filled, label rows always there."""
    spine = pairs.sparkSession.createDataFrame([(x,) for x in labels], f"{a} string")
    counts = pairs.groupBy(a).pivot(b, list(labels)).count()
    return spine.join(F.broadcast(counts), a, "left").fillna(0)


# ------------------------------------------------------------------ paired instruments


def average_ranks(hist: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Average rank of every distinct value, from its histogram."""
    before = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("freq").over(before), F.lit(0))
    return hist.select(*keys, value, (below + (F.col("freq") + 1) / 2.0).alias("rank"))


def weighted_corr(x: str, y: str, freq: str = "freq") -> Column:
    """Pearson over a joint histogram whose columns are centred, null when one side is constant."""
    total = lambda a, b: F.sum(F.col(freq) * F.col(a) * F.col(b))
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varies, F.try_divide(total(x, y), F.sqrt(total(x, x)) * F.sqrt(total(y, y))))


def calibration(pairs: DataFrame) -> DataFrame:
    """Two instruments on the same items. ``pairs``: descriptor, x, y, pct_x, pct_y,
    tramo_x, tramo_y. Correlations, median relative change, percentile shift and the
    share of items that change tercile.

    ``pairs`` is read once, into its joint histogram: items that agree in everything (0 with
    both instruments above all) are one row of it before anything is shuffled, and ranks,
    moments and quantiles are taken from its rows and their counts.
    """
    joint = cut_lineage(pairs.where("x is not null and y is not null").groupBy(
        "descriptor", "x", "y", "pct_x", "pct_y", "tramo_x", "tramo_y").agg(F.count(F.lit(1)).alias("freq")))
    side = lambda v: average_ranks(
        joint.groupBy("descriptor", v).agg(F.sum("freq").alias("freq")), ["descriptor"], v).withColumnRenamed("rank", f"r{v}")
    ranked = joint.join(side("x"), ["descriptor", "x"]).join(side("y"), ["descriptor", "y"])
    # the mean of average ranks is known, that of the values is counted: a row per descriptor
    means = joint.groupBy("descriptor").agg(
        F.sum("freq").alias("_n"), *[(F.sum(F.col(v) * F.col("freq")) / F.sum("freq")).alias(f"_m{v}") for v in "xy"])
    centred = ranked.join(F.broadcast(means), "descriptor").withColumns({
        **{f"_c{v}": F.col(v) - F.col(f"_m{v}") for v in "xy"},
        **{f"_r{v}": F.col(f"r{v}") - (F.col("_n") + 1) / 2.0 for v in "xy"}})
    comparable = F.col("tramo_x").isNotNull() & F.col("tramo_y").isNotNull()
    counted = lambda condition: F.sum(F.when(condition, F.col("freq")).otherwise(0))
    relative = F.when(F.col("x") != 0, half_even(F.abs((F.col("y") - F.col("x")) / F.col("x")), 6))
    base = centred.groupBy("descriptor").agg(
        F.sum("freq").alias("n"),
        half_even(weighted_corr("_cx", "_cy"), 6).alias("corr_pearson"),
        half_even(weighted_corr("_rx", "_ry"), 6).alias("corr_spearman"),
        counted(comparable).alias("n_comparables"),
        counted(F.col("tramo_x") != F.col("tramo_y")).alias("_moved"),
        half_even(quantile(relative, 0.5), 6).alias("cambio_relativo_mediano"),
        quantile(F.abs(F.col("pct_y") - F.col("pct_x")), [0.5, 0.9]).alias("_s"),
    )
    return base.select(
        "descriptor", "n", "corr_pearson", "corr_spearman", "n_comparables", "cambio_relativo_mediano",
        half_even(F.col("_s")[0], 6).alias("desplaz_percentil_mediana"), half_even(F.col("_s")[1], 6).alias("desplaz_percentil_p90"),
        half_even(100.0 * ratio(F.col("_moved"), F.col("n_comparables")), 6).alias("pct_cambian_de_tramo"))
