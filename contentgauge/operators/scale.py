"""The reference scale: which descriptors get which cuts, and the cuts.

Everything is derived from one histogram (descriptor, format, duration, value,
rows). Descriptors are stored rounded, so the histogram is bounded by their
decimals, whatever the size of the corpus; texts are read once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from contentgauge.functions import lexicons as L
from contentgauge.functions.numbers import half_even, ratio
from contentgauge.operators.shuffles import Tested, shuffled_ranges
from contentgauge.operators.skew import ROWS_PER_TASK, histogram, quantile, salted_join
from contentgauge.session import cut_lineage

GRID = [i / 100 for i in range(101)]
ALL = "_todos"


def long_form(wide: DataFrame, keys: Sequence[str], descriptors: Sequence[str] = tuple(L.PANEL)) -> DataFrame:
    """(keys, descriptor, value): one row per item and descriptor."""
    return wide.select(*keys, *[F.col(d).cast("double").alias(d) for d in descriptors]).unpivot(
        list(keys), list(descriptors), "descriptor", "value"
    )


def value_histogram(wide: DataFrame, descriptors: Sequence[str] = tuple(L.PANEL)) -> DataFrame:
    """Histogram of the measurable rows; needs formato and duracion columns."""
    measurable = wide.where("v_apto_panel = 1")
    return histogram(long_form(measurable, ["formato", "duracion"], descriptors),
                     ["descriptor", "formato", "duracion"], "value")


def grid(freq: str = "freq", where: Column | None = None) -> Column:
    """101 percentiles with 6 decimals; empty under three values."""
    value = F.col("value") if where is None else F.when(where, F.col("value"))
    rows = F.sum(F.col(freq)) if where is None else F.sum(F.when(where, F.col(freq)))
    points = F.transform(quantile(value, GRID, F.col(freq)), lambda g: half_even(g, 6))
    return F.when(rows >= 3, points).otherwise(F.array().cast("array<double>"))


def locate(value: Column, points: Column) -> Column:
    """Percentile of a value in a grid: points at or below it less one, in 0..100."""
    at_most = F.size(F.filter(points, lambda g: g <= value)) - 1
    bounded = F.least(F.lit(100), F.greatest(F.lit(0), at_most)).cast("double")
    return F.when(value.isNotNull() & (F.size(points) > 0), bounded)


def kinds(hist: DataFrame) -> DataFrame:
    """Per descriptor: rows, share of zeros, and continuous or presence."""
    zero = F.sum(F.when(F.col("value") == 0, F.col("freq")).otherwise(F.lit(0)))
    return hist.groupBy("descriptor").agg(F.sum("freq").alias("n"), zero.alias("n_cero")).select(
        "descriptor", "n", ratio(F.col("n_cero"), F.col("n")).alias("frac_cero"),
    ).withColumn("tipo", F.when(F.col("frac_cero") > L.ZERO_SHARE_LIMIT, "presencia").otherwise("continuo"))


# ------------------------------------------------------------------ permutation test


def group_range(grouped: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Range between groups of the cut (continuous) or of the share above zero.

    ``grouped`` is a histogram with keys, tipo, grupo, value, freq.
    """
    share = ratio(F.sum(F.when(F.col("value") > 0, F.col("freq")).otherwise(0)), F.sum("freq"))
    stat = F.when(F.first("tipo") == "presencia", share).otherwise(quantile("value", 1.0 / 3.0))
    return grouped.groupBy(*keys, "grupo").agg(stat.alias("s")).groupBy(*keys).agg(
        half_even(F.max("s") - F.min("s"), 9).alias("rango")
    )


def permutation_test(
    rows: DataFrame, permutations: int = L.PERMUTATIONS, seed: int = 20260812, types: DataFrame | None = None,
    hist: DataFrame | None = None,
) -> DataFrame:
    """Do groups differ more than shuffled labels would make them differ?

    ``rows``: descriptor, id, grupo, value, one row per descriptor and id. Returns descriptor,
    tipo, frac_cero, n, rango and p_permutacion: the share of shuffles whose range reaches the
    real one, null under 40 rows or 2 groups.

    A shuffle orders the ids by md5(id:shuffle:seed); the groups take the rows of a descriptor in
    that order. One order serves all descriptors, and the same rule holds for every size.
    ``hist``: stored rows per (descriptor, grupo, value) of stored ``rows``, where they are there already.
    """
    if hist is None:
        rows = cut_lineage(rows.select("descriptor", "id", "grupo", "value"))  # the only reading of the texts
        hist = cut_lineage(histogram(rows, ["descriptor", "grupo"], "value"))
    types = kinds(hist) if types is None else types
    usable = hist.where(F.col("grupo").isNotNull())
    typed = usable.join(F.broadcast(types.select("descriptor", "tipo")), "descriptor")
    real = group_range(typed, ["descriptor"])
    sizes = typed.groupBy("descriptor", "tipo", "grupo").agg(F.sum("freq").alias("m"))
    # a row per descriptor and group
    groups: dict[tuple[str, str], list[int]] = {}
    for r in sorted(sizes.collect()):
        groups.setdefault((r["descriptor"], r["tipo"]), []).append(r["m"])
    tested = [Tested(d, tipo == "presencia", tuple(m)) for (d, tipo), m in groups.items() if sum(m) >= 40 and len(m) >= 2]
    if tested:
        null = shuffled_ranges(rows.where(F.col("grupo").isNotNull()), tested, permutations, seed)
        reached = null.withColumnRenamed("rango", "azar").join(F.broadcast(real), "descriptor").groupBy("descriptor").agg(
            F.avg(F.when(F.col("azar") >= F.col("rango"), 1.0).otherwise(0.0)).alias("p"))
    else:
        reached = types.select("descriptor", F.lit(None).cast("double").alias("p"))
    return (
        types.join(F.broadcast(real), "descriptor", "left").join(F.broadcast(reached), "descriptor", "left")
        .select("descriptor", "tipo", "frac_cero", "n", "rango", half_even(F.col("p"), 4).alias("p_permutacion"))
    )


# ------------------------------------------------------------------ the scale


def decide(tested: DataFrame) -> DataFrame:
    """Scope per descriptor: per format where the test rejects, else global."""
    per_format = F.coalesce(F.col("p_permutacion") < L.PERMUTATION_ALPHA, F.lit(False))
    return tested.withColumn("ambito", F.when(per_format, "por_formato").otherwise("global"))


def reference_blocks(hist: DataFrame) -> DataFrame:
    """Per descriptor and scope (each format and ``_todos``): counts, grids, cuts.
    Scopes under 8 values give no row. One pass over the histogram."""
    present = F.col("value") > 0
    out = hist.groupingSets([["descriptor", "formato"], ["descriptor"]], "descriptor", "formato").agg(
        F.grouping_id().alias("_g"),
        F.sum("freq").alias("n"),
        F.sum(F.when(present, F.col("freq")).otherwise(F.lit(0))).alias("n_presentes"),
        F.sum(F.when(F.col("value") == 0, F.col("freq")).otherwise(F.lit(0))).alias("_zero"),
        grid().alias("grid"),
        grid(where=present).alias("grid_presentes"),
        quantile("value", [0.25, 0.5, 0.75]).alias("_q"),
        quantile(F.when(present, F.col("value")), 0.5, F.col("freq")).alias("_mp"),
    )
    return out.where("n >= 8 and (_g = 1 or formato is not null)").select(
        "descriptor", F.when(F.col("_g") == 0, F.col("formato")).otherwise(F.lit(ALL)).alias("scope"), "n",
        "n_presentes", half_even(ratio(F.col("_zero"), F.col("n")), 4).alias("p_ausencia"), "grid",
        "grid_presentes", *[half_even(F.col("_q")[i], 4).alias(f"p{p}") for i, p in enumerate((25, 50, 75))],
        half_even(F.col("_mp"), 4).alias("mediana_presentes"),
    )


def build_scale(hist: DataFrame, plan: DataFrame, frame: str = L.FRAME_VERSION) -> DataFrame:
    """Every block a descriptor needs under its plan, one row per scope.

    Presence descriptors carry the grid of the present values, continuous ones the
    grid of all. Rows: descriptors x (formats + 1); always small enough to broadcast.
    """
    presence = F.col("tipo") == "presencia"
    return (
        reference_blocks(hist).join(F.broadcast(plan.select("descriptor", "tipo", "ambito", "frac_cero",
                                                            "p_permutacion")), "descriptor")
        .where((F.col("ambito") == "por_formato") | (F.col("scope") == ALL))
        .select(
            F.lit(frame).alias("frame_version"), "descriptor", "tipo", "ambito",
            F.when(F.col("ambito") == "global", "global").otherwise(F.col("scope")).alias("bloque"), "scope", "n",
            F.when(presence, F.col("p_ausencia")).alias("p_ausencia"),
            F.when(presence, F.col("n_presentes")).alias("n_presentes"),
            F.when(~presence, F.col("p25")).alias("p25"),
            F.when(presence, F.col("mediana_presentes")).otherwise(F.col("p50")).alias("p50"),
            F.when(~presence, F.col("p75")).alias("p75"),
            "p_permutacion", half_even(F.col("frac_cero"), 4).alias("frac_cero"),
            F.when(presence, F.col("grid_presentes")).otherwise(F.col("grid")).alias("grid"),
        )
    )


def cell_cuts(hist: DataFrame, min_rows: int = 15, cell_rows: DataFrame | None = None,
              frame: str = L.FRAME_VERSION) -> DataFrame:
    """Tercile cuts per (format, duration) cell, the global ones where a cell has
    under ``min_rows`` items or no cut. ``cell_rows``: formato, duracion, n_util."""
    def cuts(keys: list[str], prefix: str) -> DataFrame:
        agg = hist.groupBy(*keys).agg(
            F.sum("freq").alias("_n"), F.count_distinct("value").alias("_d"),
            quantile("value", [1 / 3, 0.5, 2 / 3]).alias("_q"), F.min("value").alias("_min"),
            F.max("value").alias("_max"),
        ).where("_n >= 3 and _d >= 3")
        fields = [F.col("_q")[0], F.col("_q")[1], F.col("_q")[2], F.col("_min"), F.col("_max")]
        return agg.select(*keys, F.struct(*[
            half_even(f, 4).alias(name) for f, name in zip(fields, ("p33", "p50", "p67", "min", "max"))
        ]).alias(prefix))

    spine = cells(hist.sparkSession)
    spine = spine.join(F.broadcast(cell_rows), ["formato", "duracion"], "left").fillna(0, ["n_util"])
    names = hist.sparkSession.createDataFrame([(d,) for d in L.PANEL], "descriptor string")
    by_cell = cuts(["descriptor", "formato", "duracion"], "own")
    overall = cuts(["descriptor"], "overall")
    out = (
        spine.join(F.broadcast(names)).join(by_cell, ["descriptor", "formato", "duracion"], "left")
        .join(F.broadcast(overall), "descriptor", "left")
        .withColumn("own", F.when(F.col("n_util") >= min_rows, F.col("own")))
        .withColumn("cut", F.coalesce("own", "overall")).where("cut is not null")
    )
    return out.select(
        F.lit(frame).alias("frame_version"), "formato", "duracion", "descriptor", F.col("n_util").cast("long"),
        "cut.p33", "cut.p50", "cut.p67", "cut.min", "cut.max", F.col("own").isNull().alias("fallback_global"),
    )


def cells(spark) -> DataFrame:
    """The 12 (format, duration) cells."""
    return spark.createDataFrame([(f, d) for f in L.FORMATS for d in L.DURATIONS], "formato string, duracion string")


def cell_sizes(measurable: DataFrame) -> DataFrame:
    return measurable.groupBy("formato", "duracion").agg(F.count(F.lit(1)).alias("n_util"))


def uncut(hist: DataFrame) -> DataFrame:
    """Where no cut exists and why: too few values, or too few distinct ones."""
    per = hist.groupingSets([["descriptor", "formato", "duracion"], ["descriptor"]],
                            "descriptor", "formato", "duracion").agg(
        F.grouping_id().alias("_g"), F.sum("freq").alias("n"), F.count_distinct("value").alias("distintos"))
    few = F.col("n") < 3
    return per.where("(_g = 3 or (formato is not null and duracion is not null)) and (n < 3 or distintos < 3)").select(
        F.when(F.col("_g") == 3, "GLOBAL").otherwise(F.concat_ws("/", "formato", "duracion")).alias("donde"),
        "descriptor", F.when(few, "pocos_valores").otherwise("pocos_distintos").alias("motivo"),
        F.when(few, F.col("n")).otherwise(F.col("distintos")).alias("cuantos"),
    )


def terciles(hist: DataFrame) -> DataFrame:
    """Per descriptor the 1/3 and 2/3 cuts, null where there is too little to cut."""
    return hist.groupBy("descriptor").agg(
        F.sum("freq").alias("_n"), F.count_distinct("value").alias("_d"), quantile("value", [1 / 3, 2 / 3]).alias("_q")
    ).select("descriptor", F.when((F.col("_n") >= 9) & (F.col("_d") >= 3), F.col("_q")).alias("cuts"))


def tercile_levels(wide: DataFrame, hist: DataFrame, inverted: Sequence[str] = ()) -> DataFrame:
    """nivel_* columns: bajo, medio, alto, sin_dato, insuficiente (measurable rows)."""
    table = terciles(hist).agg(F.map_from_entries(F.collect_list(F.struct("descriptor", "cuts"))).alias("_cuts"))
    out = wide.join(F.broadcast(table))
    for d in [d for d in L.PANEL if d in wide.columns]:
        low, high = ("alto", "bajo") if d in inverted else ("bajo", "alto")
        cuts, v = F.try_element_at("_cuts", F.lit(d)), F.col(d)
        out = out.withColumn(f"nivel_{d}", F.when(F.col("v_apto_panel") != 1, "sin_dato")
                             .when(cuts.isNull(), "insuficiente").when(v.isNull(), "sin_dato")
                             .when(v <= cuts[0], low).when(v <= cuts[1], "medio").otherwise(high))
    return out.drop("_cuts")


def tercile_place(value: Column, p33: Column, p67: Column) -> Column:
    return (
        F.when(value.isNull() | p33.isNull(), "sin_dato").when(value <= p33, "bajo").when(value <= p67, "medio")
        .otherwise("alto")
    )


def strict_percentile(values: DataFrame, hist: DataFrame, row_id: str = "content_id", per_task: int = ROWS_PER_TASK) -> DataFrame:
    """100 * share of reference values strictly below, 1 decimal.

    ``values``: descriptor, value, ``row_id`` (+ keys); read twice, so give it written. Ranks
    are taken over the distinct values of both sides. Many items share a value (0 above all):
    its rows are dealt over as many tasks as their count asks for.
    """
    wanted = values.where("value is not null").groupBy("descriptor", "value").agg(F.count(F.lit(1)).alias("_own"))
    merged = hist.select("descriptor", "value", "freq", F.lit(0).alias("_own")).unionByName(
        wanted.withColumn("freq", F.lit(0))).groupBy("descriptor", "value").agg(
        F.sum("freq").alias("freq"), F.sum("_own").alias("_own"))
    before = Window.partitionBy("descriptor").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("descriptor")
    ranked = merged.select(
        "descriptor", "value", "_own", F.coalesce(F.sum("freq").over(before), F.lit(0)).alias("_below"),
        F.sum("freq").over(whole).alias("_all"),
    ).where("_own > 0").drop("_own")
    joined = salted_join(values, ranked, ["descriptor", "value"], row_id, "left", per_task)
    return joined.withColumn(
        "percentil", half_even(F.when(F.col("_all") > 0, F.lit(100.0) * F.col("_below") / F.col("_all")), 1)
    ).drop("_below", "_all")
