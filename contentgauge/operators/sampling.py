"""The reference sample: candidates, strata, the draw, its audit and its refill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from contentgauge.functions import lexicons as L, strata
from contentgauge.functions.numbers import flag, half_even, ratio
from contentgauge.functions.text import looks_spanish
from contentgauge.operators.queue import PERMANENT
from contentgauge.operators.scale import cells
from contentgauge.operators.skew import top_per_group
from contentgauge.session import cut_lineage

CELL = ["stratum_format", "stratum_duration"]


def draw_key(id_: str | Column, seed: str, salt: str = "") -> Column:
    """A reproducible order: the same id, seed and salt always give the same key."""
    return F.md5(F.concat_ws(":", id_, F.lit(seed), F.lit(salt)))


def reject_reason(public: Column, restricted: Column, seconds: Column, category: Column, language: Column,
                  text: Column) -> Column:
    """First rule a candidate breaks, or ACEPTADO."""
    declared = F.lower(F.coalesce(F.nullif(language, F.lit("")), F.lit("")))
    return (
        F.when(~F.coalesce(public, F.lit(False)), "no_publico").when(restricted, "restringido_por_region")
        .when(seconds.isNull(), "duracion_ilegible")
        .when(seconds < L.MIN_SECONDS, "corto_menos_2min (Shorts y clips)")
        .when(seconds > L.MAX_SECONDS, "largo_mas_3h (streams)")
        .when(strata.category_format(category).isNull(),
              F.concat(F.lit("categoria_no_mapeada ("), F.coalesce(category, F.lit("None")), F.lit(")")))
        .when((declared != "") & ~F.startswith(declared, F.lit("es")),
              F.concat(F.lit("idioma_declarado_no_es ("), F.left(declared, F.lit(5)), F.lit(")")))
        .when((declared == "") & ~looks_spanish(text), "idioma_no_detectado_como_es").otherwise("ACEPTADO")
    )


def assign_strata(df: DataFrame, category: str = "category_id", seconds: str = "duration_seconds") -> DataFrame:
    return df.withColumns({
        "stratum_format": strata.category_format(F.col(category)),
        "stratum_duration": strata.duration_bucket(F.col(seconds)),
    })


def discard_funnel(reasons: DataFrame, reason: str = "reason") -> DataFrame:
    """Rows and share per reason."""
    counts = reasons.groupBy(reason).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    return counts.join(F.broadcast(total)).select(reason, "n", half_even(ratio(F.col("n"), F.col("_t")), 6).alias("share"))


def sample_per_channel(cands: DataFrame, k: int, seed: str, id_: str = "external_id", channel: str = "channel_id") -> DataFrame:
    """A reproducible draw of at most k candidates of every channel."""
    return top_per_group(cands.withColumn("_key", draw_key(id_, seed, "canal")), [channel],
                         [F.col("_key"), F.col(id_)], k, F.col(id_)).drop("_key", "rank")


# ------------------------------------------------------------------ the draw


def contenders(cands: DataFrame, total: int, cap: int, reserve: int, seed: str) -> DataFrame:
    """(external_id, channel_id, cell, _key, _able) of all candidates that can take part in the draw or the reserve.

    Nothing reachable is lost: a channel gives a cell at most ``cap`` items, so its best
    ``cap`` there are enough. The draw takes ``total`` items, so at most that many
    channels are ever used; a cell that walks its channels in order of their best
    candidate meets its quota within the first ``total`` + quota of them. The reserve
    holds the best items left, at most quota + ``reserve`` places down the cell's
    order. What stays does not depend on the number of candidates.
    """
    quota = max(1, total // 12)
    slim = cands.select("external_id", F.coalesce("channel_id", F.lit("?")).alias("channel_id"), *CELL,
                        draw_key("external_id", seed, "sorteo").alias("_key"))
    keyed = slim.join(F.broadcast(cells(cands.sparkSession).withColumnsRenamed(dict(zip(["formato", "duracion"], CELL)))), CELL,
            "left_semi")
    order = [F.col("_key"), F.col("external_id")]
    own = top_per_group(keyed, [*CELL, "channel_id"], order, cap, F.col("external_id"), rank="_in_channel")
    best = own.where("_in_channel = 1").select(*CELL, "channel_id", "_key", "external_id")
    channels = top_per_group(best, CELL, order, total + quota, F.col("channel_id")).select(*CELL, "channel_id")
    able = own.join(channels, [*CELL, "channel_id"], "left_semi").drop("_in_channel")
    spare = top_per_group(keyed, CELL, order, quota + reserve, F.col("external_id")).drop("rank")
    kept = able.withColumn("_able", F.lit(True)).unionByName(
        spare.join(able.select("external_id"), "external_id", "left_anti").withColumn("_able", F.lit(False)))
    # at most 12 x ((total + quota) x cap + quota + reserve) rows, whatever the pool
    return kept


def stratified_draw(cands: DataFrame, total: int = 396, cap: int = 2, reserve: int = 20, seed: str = "7") -> DataFrame:
    """Equal allocation over the 12 cells with a corpus-wide cap per channel.

    Rounds: every cell short of its quota proposes its best free candidates; where a
    channel is wanted more often than it may still give, the proposals with the lowest
    key stay, so no cell has priority. A first pass takes unused channels only, later
    passes go up to the cap. A round that accepts nothing ends the pass. Returns the
    candidates with sample_rank 'principal' or 'reserva'.

    The large table is read once for the draw, by ``contenders``, and once more for the columns of what is
    drawn. The rounds are a fixed point on one written table of contenders, each with the round that took
    it; how often a channel gave and how full a cell is are windows over it. A round writes the table
    once and asks whether it took anything.
    """
    quota = max(1, total // 12)
    state = cut_lineage(contenders(cands, total, cap, reserve, seed).withColumn("_round", F.lit(None).cast("int")))
    by_cell, by_channel = Window.partitionBy(*CELL), Window.partitionBy("channel_id")
    order = [F.col("_key"), F.col("external_id")]
    round_ = 0
    for limit in range(1, cap + 1):
        while True:
            round_ += 1
            counted = state.withColumns({
                "_used": F.count("_round").over(by_channel), "_filled": F.count("_round").over(by_cell)})
            free = F.col("_able") & F.col("_round").isNull() & (F.col("_used") < limit) & (F.col("_filled") < quota)
            asked = counted.withColumn("_free", free).withColumn(
                "_place", F.row_number().over(by_cell.orderBy(F.desc("_free"), *order)))
            asked = asked.withColumns({
                "_asks": F.col("_free") & (F.col("_place") <= quota - F.col("_filled")),
                "_lot": F.md5(F.concat_ws(":", "channel_id", *CELL, F.lit(round_), F.lit(seed)))})
            asked = asked.withColumn("_turn", F.row_number().over(by_channel.orderBy(F.desc("_asks"), "_lot", *order)))
            taken = F.col("_asks") & (F.col("_turn") <= limit - F.col("_used"))
            state = cut_lineage(asked.withColumn("_round", F.when(taken, F.lit(round_)).otherwise(F.col("_round"))).select(state.columns))
            if state.where(F.col("_round") == round_).isEmpty():
                break
    last = F.row_number().over(Window.partitionBy(*CELL, F.col("_round").isNull()).orderBy(*order))
    rank = F.when(F.col("_round").isNotNull(), "principal").when(last <= reserve, "reserva")
    drawn = state.withColumn("sample_rank", rank).where("sample_rank is not null").drop("_key", "_able", "_round")
    # no more rows than the sample asks for; the join is left to the optimizer, which knows their size
    return cands.drop("channel_id", *CELL).join(cut_lineage(drawn), "external_id")


def feasibility(cands: DataFrame, total: int, cap: int) -> DataFrame:
    """Distinct channels, the most items they can give, and whether that is enough."""
    return cands.agg(F.count_distinct("channel_id").alias("canales")).select(
        "canales", (F.col("canales") * cap).alias("techo"), (F.col("canales") * cap >= total).alias("alcanza"))


def rebuild_reserve(cands: DataFrame, stored: DataFrame, per_cell: int, seed: str) -> DataFrame:
    """Candidates not stored yet, the first ``per_cell`` of every cell in draw order.
    Ids are ranked; the few that stay fetch their columns."""
    slim = cands.select("external_id", *CELL, draw_key("external_id", seed, "banco").alias("_key"))
    free = slim.join(stored.select("external_id"), "external_id", "left_anti")
    best = top_per_group(free, CELL, [F.col("_key"), F.col("external_id")], per_cell, F.col("external_id"), rank="orden")
    return cands.join(best.select("external_id", "orden"), "external_id")


# ------------------------------------------------------------------ state and refill


def stratum_state(items: DataFrame, target: int) -> DataFrame:
    """Queued, with text, pending, failed, projection and shortfall per cell."""
    status, words = F.col("enrichment_status"), F.coalesce("transcript_word_count", F.lit(0))
    final = F.coalesce(status.isin(PERMANENT), F.lit(False))
    sums = items.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("encolados"), F.sum(flag(words > 0)).alias("con_texto"),
        F.sum(flag(~final)).alias("pendientes"), F.sum(flag(final & (words == 0))).alias("fallidos"))
    return sums.withColumn("proyeccion", F.col("con_texto") + F.col("pendientes")).withColumn(
        "faltan", F.greatest(F.lit(0), target - F.col("proyeccion")))


def refill(state: DataFrame, reserve: DataFrame, stored: DataFrame, target: int, seed: str) -> DataFrame:
    """Unused reserves for every short cell, as many as it lacks. The number lacking is
    at most ``target``, so that bounds the first ranking."""
    ranked = rebuild_reserve(reserve, stored, target, seed)
    short = state.where("faltan > 0").select(*CELL, "faltan")
    return ranked.join(F.broadcast(short), CELL).where("orden <= faltan").drop("faltan")


def uncovered(state: DataFrame, refilled: DataFrame) -> DataFrame:
    got = refilled.groupBy(*CELL).agg(F.count(F.lit(1)).alias("repuestos"))
    return state.where("faltan > 0").join(F.broadcast(got), CELL, "left").fillna(0, ["repuestos"]).select(
        *CELL, "repuestos", (F.col("faltan") - F.col("repuestos")).alias("sin_cubrir"))


def stratum_fill(items: DataFrame) -> DataFrame:
    """Candidates, enriched, with transcript and distinct channels per stratum."""
    return items.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("candidatos"), F.sum(flag(F.col("enrichment_status") == "ok")).alias("enriquecidos"),
        F.sum(flag(F.col("transcript_word_count") > 0)).alias("con_transcripcion"),
        F.count_distinct("channel_id").alias("canales_distintos"))


# ------------------------------------------------------------------ reports on a sample


def design_table(sample: DataFrame) -> DataFrame:
    """Formats x durations with totals."""
    counts = sample.groupBy("stratum_format").pivot("stratum_duration", L.DURATIONS).count().fillna(0)
    total = F.col("corto") + F.col("medio") + F.col("largo")
    whole = counts.agg(F.lit("TOTAL").alias("stratum_format"), *[F.sum(d).alias(d) for d in L.DURATIONS])
    return counts.unionByName(whole).withColumn("total", total)


def shortfalls(sample: DataFrame, cands: DataFrame, quota: int) -> DataFrame:
    """Cells under the quota, how many they lack and how many candidates there were."""
    spine = cells(sample.sparkSession).withColumnsRenamed(dict(zip(["formato", "duracion"], CELL)))
    n = lambda df, name: F.broadcast(df.groupBy(*CELL).agg(F.count(F.lit(1)).alias(name)))
    return spine.join(n(sample, "n"), CELL, "left").join(n(cands, "candidatos"), CELL, "left").fillna(0).where(
        F.col("n") < quota).select(*CELL, (quota - F.col("n")).alias("faltan"), "candidatos")


def provenance(sample: DataFrame, by: Column, name: str) -> DataFrame:
    counts = sample.groupBy(by.alias(name)).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    return counts.join(F.broadcast(total)).select(name, "n", half_even(ratio(F.col("n"), F.col("_t")), 6).alias("share"))


def duration_summary(sample: DataFrame) -> DataFrame:
    """Hours in all and the upper median of minutes, from a histogram of seconds."""
    hist = sample.groupBy("duration_seconds").agg(F.count(F.lit(1)).alias("freq"))
    upto = Window.orderBy("duration_seconds").rowsBetween(Window.unboundedPreceding, 0)
    ranked = hist.withColumn("_upto", F.sum("freq").over(upto))
    total = hist.agg(F.sum("freq").alias("_n"), F.sum(F.col("freq") * F.col("duration_seconds")).alias("_s"))
    return ranked.join(F.broadcast(total)).where(F.col("_upto") > F.floor(F.col("_n") / 2)).groupBy("_n", "_s").agg(
        F.min("duration_seconds").alias("m")).select(
        F.col("_n").alias("videos"), half_even(F.col("_s") / 3600.0, 6).alias("horas"),
        half_even(F.col("m") / 60.0, 6).alias("mediana_min"))


def audit(sample: DataFrame, cands: DataFrame, frame: str = L.FRAME_VERSION) -> DataFrame:
    """Per cell: sampled, candidates, the weight that undoes equal allocation, sources."""
    spine = cells(sample.sparkSession)
    names = dict(zip(CELL, ["formato", "duracion"]))
    drawn = sample.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n_muestra"), F.sum(flag(F.col("sampling_source") == "chart_canal")).alias("n_chart_canal"))
    offered = cands.where(F.col(CELL[0]).isNotNull() & F.col(CELL[1]).isNotNull()).groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n_candidatos"))
    joined = spine.join(F.broadcast(drawn.withColumnsRenamed(names)), ["formato", "duracion"], "left").join(
        F.broadcast(offered.withColumnsRenamed(names)), ["formato", "duracion"], "left").fillna(0)
    whole = joined.agg(F.sum("n_muestra").alias("_m"), F.sum("n_candidatos").alias("_c"))
    weight = ratio(ratio(F.col("n_candidatos"), F.col("_c")), F.nullif(ratio(F.col("n_muestra"), F.col("_m")), F.lit(0.0)))
    return joined.join(F.broadcast(whole)).select(
        F.lit(frame).alias("frame_version"), "formato", "duracion", "n_muestra", "n_candidatos",
        half_even(weight, 4).alias("peso_reponderacion"), "n_chart_canal",
        (F.col("n_muestra") - F.col("n_chart_canal")).alias("n_busqueda_semilla"))
