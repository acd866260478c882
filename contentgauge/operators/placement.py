"""Where items fall on the reference scale, and what their owner's history looks like on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from contentgauge.functions import lexicons as L
from contentgauge.functions.numbers import clean_number, flag, half_even, ratio
from contentgauge.functions.text import blank_words
from contentgauge.operators.scale import ALL, locate
from contentgauge.operators.skew import quantile

OUT_OF_FRAME = "fuera_del_marco"


def place(long: DataFrame, scale: DataFrame) -> DataFrame:
    """State and percentile of every (item, descriptor).

    ``long``: descriptor, value, formato (+ keys). The block of the item's format is
    taken, or the one of all formats. The scale has at most descriptors x (formats
    + 1) rows, so it is broadcast.
    """
    block = F.struct("n", "p_ausencia", "n_presentes", "p50", "grid")
    own = scale.select("descriptor", F.col("scope").alias("formato"), block.alias("_own"))
    everyone = scale.where(F.col("scope") == ALL).select(
        "descriptor", F.struct("n", "p_ausencia", "n_presentes", "p50", "grid").alias("_all"), "tipo", "ambito")
    joined = long.join(F.broadcast(everyone), "descriptor", "left").join(
        F.broadcast(own), ["descriptor", "formato"], "left"
    )
    ref, v, presence = F.coalesce("_own", "_all"), F.col("value"), F.col("tipo") == "presencia"
    joined = joined.withColumn("_ref", ref)
    known = v.isNotNull() & F.col("_ref").isNotNull()
    measured = known & (~presence | (v > 0))
    return joined.withColumns({
        "estado": F.when(~known, "sin_dato").when(~presence, "medido").when(v > 0, "presente").otherwise("ausente"),
        "percentil": F.when(measured, locate(v, F.col("_ref.grid"))),
        "p_ausencia": F.when(known & presence, F.col("_ref.p_ausencia")),
        "n_presentes": F.when(measured & presence, F.col("_ref.n_presentes")),
        "mediana_corpus": F.when(known & ~presence, F.col("_ref.p50")),
        "unidad": unit(F.col("descriptor")),
    }).drop("_ref", "_own", "_all")


def unit(descriptor: Column) -> Column:
    pairs = [F.lit(x) for item in L.PANEL_UNITS.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), descriptor)


def panel_rows(wide: DataFrame, scale: DataFrame, key: str = "content_id") -> DataFrame:
    """One row per item with the panel as an array in the fixed descriptor order.

    The array is built inside the row: no shuffle, the scale arrives as one map.
    """
    block = F.struct("tipo", "ambito", "n", "p_ausencia", "n_presentes", "p50", "grid")
    table = scale.agg(F.map_from_entries(F.collect_list(
        F.struct(F.concat_ws("|", "descriptor", "scope"), block))).alias("_scale"))
    joined = wide.join(F.broadcast(table))
    entries = []
    for d in L.PANEL:
        everyone = F.try_element_at("_scale", F.lit(f"{d}|{ALL}"))
        own = F.try_element_at("_scale", F.concat(F.lit(f"{d}|"), F.col("formato")))
        ref, v = F.coalesce(own, everyone), F.col(d).cast("double")
        presence = everyone["tipo"] == "presencia"
        known = v.isNotNull() & ref.isNotNull()
        measured = known & (~presence | (v > 0))
        state = F.when(~known, "sin_dato").when(~presence, "medido").when(v > 0, "presente").otherwise("ausente")
        entries.append(F.struct(
            F.lit(d).alias("clave"), F.lit(L.PANEL_UNITS[d]).alias("unidad"), v.alias("valor"),
            everyone["tipo"].alias("tipo"), everyone["ambito"].alias("ambito"), state.alias("estado"),
            F.when(measured, locate(v, ref["grid"])).alias("percentil"),
            F.when(known & presence, ref["p_ausencia"]).alias("p_ausencia"),
            F.when(measured & presence, ref["n_presentes"]).alias("n_presentes"),
            F.when(known & ~presence, ref["p50"]).alias("mediana_corpus"),
        ))
    return joined.withColumn("panel", F.array(*entries)).drop("_scale")


def panel_percentile(panel: Column, descriptor: str) -> Column:
    return F.try_element_at(F.map_from_entries(F.transform(
        panel, lambda e: F.struct(e["clave"], e["percentil"]))), F.lit(descriptor))


def history_table(wide: DataFrame, scale: DataFrame, key: str = "content_id") -> DataFrame:
    """Measurable history items: value, pct_* and est_* per descriptor, minutes, stratum."""
    rows = panel_rows(wide.where("v_apto_panel = 1"), scale, key)
    columns = [
        F.col(key), F.coalesce("formato", F.lit(OUT_OF_FRAME)).alias("formato"),
        F.coalesce("duracion", F.lit(OUT_OF_FRAME)).alias("duracion"),
        half_even(F.coalesce("duration_seconds", F.lit(0)) / 60.0, 1).alias("minutos"),
    ]
    for i, d in enumerate(L.PANEL):
        columns += [F.col(d), F.col("panel")[i]["percentil"].alias(f"pct_{d}"),
                    F.col("panel")[i]["estado"].alias(f"est_{d}")]
    return rows.select(*columns)


def history_long(table: DataFrame) -> DataFrame:
    """descriptor, value, percentil, estado, minutos, formato, duracion per item."""
    entries = F.array(*[
        F.struct(F.lit(d).alias("descriptor"), F.col(d).cast("double").alias("value"),
                 F.col(f"pct_{d}").alias("percentil"), F.col(f"est_{d}").alias("estado")) for d in L.PANEL
    ])
    return table.select("formato", "duracion", "minutos", F.inline(entries))


def tramo(percentile: Column) -> Column:
    return F.when(percentile <= 33, "bajo").when(percentile <= 67, "medio").when(percentile <= 100, "alto")


def denominator_contrast(long: DataFrame) -> DataFrame:
    """Tercile shares by items and by minutes; the flag marks a shift of 12 points or more."""
    by = long.where("percentil is not null").groupBy("descriptor")
    sums = [F.count(F.lit(1)).alias("n"), F.sum("minutos").alias("m")]
    for level in ("bajo", "medio", "alto"):
        inside = tramo(F.col("percentil")) == level
        sums += [F.sum(flag(inside)).alias(f"n_{level}"), F.sum(F.when(inside, F.col("minutos")).otherwise(0.0)).alias(f"m_{level}")]
    out = by.agg(*sums)
    shares = [half_even(100.0 * ratio(F.col(f"n_{x}"), F.col("n")), 6).alias(f"videos_{x}") for x in ("bajo", "medio", "alto")]
    shares += [half_even(100.0 * F.coalesce(ratio(F.col(f"m_{x}"), F.col("m")), F.lit(0.0)), 6).alias(f"minutos_{x}")
               for x in ("bajo", "medio", "alto")]
    out = out.select("descriptor", *shares)
    shift = half_even(F.col("minutos_alto") - F.col("videos_alto"), 6)
    return out.withColumn("cambio_alto", shift).withColumn("inversion", flag(F.abs("cambio_alto") >= 12))


def joint_histogram(long: DataFrame) -> DataFrame:
    """Items per (descriptor, value, percentile, state): what medians and shares of a history need, in one pass.

    Values are rounded and percentiles whole numbers, so its rows are bounded by the descriptors' decimals.
    """
    return long.groupBy("descriptor", "value", "percentil", "estado").agg(F.count(F.lit(1)).alias("freq"))


def history_medians(long: DataFrame) -> DataFrame:
    """Median percentile and median raw value per descriptor, nulls left out."""
    both = joint_histogram(long).groupBy("descriptor").agg(
        quantile("percentil", 0.5).alias("mediana_percentil"), quantile("value", 0.5).alias("mediana_valor"))
    return both.where(F.col("mediana_valor").isNotNull()).select("descriptor", "mediana_valor", "mediana_percentil")


def presence_contrast(long: DataFrame, scale: DataFrame) -> DataFrame:
    """Presence descriptors: share having it, in the history and in the corpus."""
    corpus = scale.where((F.col("scope") == ALL) & (F.col("tipo") == "presencia")).select("descriptor", "p_ausencia")
    present = F.sum(flag(F.col("estado") == "presente") * F.col("freq"))
    mine = joint_histogram(long).groupBy("descriptor").agg(
        ratio(present, F.sum("freq")).alias("tuyos"), quantile("percentil", 0.5).alias("mediana_percentil"))
    return mine.join(F.broadcast(corpus), "descriptor").select(
        "descriptor", half_even(F.col("tuyos"), 6).alias("tuyos"),
        half_even(1.0 - F.col("p_ausencia"), 6).alias("corpus"), "mediana_percentil")


def minutes_by_format(table: DataFrame) -> DataFrame:
    """Items, minutes and share of minutes per format."""
    sums = table.groupBy("formato").agg(F.count(F.lit(1)).alias("videos"), F.sum("minutos").alias("m"))
    total = sums.agg(F.sum("m").alias("_total"))
    return sums.join(F.broadcast(total)).select(
        "formato", "videos", half_even(F.col("m"), 6).alias("minutos"),
        half_even(F.coalesce(100.0 * ratio(F.col("m"), F.col("_total")), F.lit(0.0)), 6).alias("pct_minutos"))


def top_stratum(table: DataFrame) -> DataFrame:
    """The (format, duration) with most minutes and its share."""
    sums = table.groupBy("formato", "duracion").agg(half_even(F.sum("minutos"), 6).alias("m"))
    return sums.agg(
        F.max_by(F.struct("formato", "duracion", "m"), F.struct("m", "formato", "duracion")).alias("top"),
        F.sum("m").alias("total"),
    ).select("top.formato", "top.duracion", F.col("top.m").alias("minutos"),
             half_even(100.0 * ratio(F.col("top.m"), F.col("total")), 6).alias("pct_total"))


# ------------------------------------------------------------------ gold rows


def not_measurable_reason(wide_has_text: Column, complete: Column, metadata: Column) -> Column:
    return (
        F.when(wide_has_text == 0, "sin_transcripcion").when(complete == 0, "transcripcion_incompleta")
        .when(metadata == 0, "sin_metadatos")
    )


def gold_rows(placed: DataFrame, computed_at: Column, frame: str = L.FRAME_VERSION, key: str = "content_id") -> DataFrame:
    """One stored row per item, also for those that are not measurable (with the
    reason and no panel)."""
    apt = F.col("v_apto_panel") == 1
    pct = [F.when(apt, F.col("panel")[i]["percentil"]).alias(f"{d}_pct") for i, d in enumerate(L.PANEL)]
    raw = [clean_number(F.col(d)).alias(d) for d in L.PANEL]
    tags = F.struct(*[F.col(c) for c in ("et_porcion", "et_formato", "et_caducidad", "et_promesa",
                                         "et_trazabilidad", "et_navegabilidad", "et_calidad_dato",
                                         "et_idioma", "et_categoria_yt")])
    return placed.select(
        F.col(key).alias("content_item_id"), F.lit(L.PANEL_VERSION).alias("features_version"),
        computed_at.alias("computed_at"), F.lit(frame).alias("frame_version"), "formato", apt.alias("apto"),
        F.col("v_cobertura_transcripcion").alias("cobertura_transcripcion"),
        not_measurable_reason(F.col("v_tiene_transcripcion"), F.col("v_transcripcion_completa"),
                              F.col("v_tiene_metadatos")).alias("motivo_no_apto"),
        F.when(apt, F.col("panel")).alias("panel"), tags.alias("etiquetas"),
        F.nullif(F.size(blank_words(F.col("transcript"))), F.lit(0)).alias("n_words"),
        "duration_seconds", F.col("et_idioma").alias("lang"), "transcript_source",
        (F.col("v_tiene_descripcion") == 1).alias("has_description"), (F.col("n_tags") > 0).alias("has_tags"),
        *raw, *pct,
    )


def same_frame(gold: DataFrame, frame: str) -> DataFrame:
    """Rows of one frame only; percentiles of different frames are never mixed."""
    return gold.where(F.col("frame_version") == frame)


def split_by_freshness(items: DataFrame, gold: DataFrame, frame: str = L.FRAME_VERSION,
                       version: str = L.PANEL_VERSION) -> tuple[DataFrame, DataFrame]:
    """(stored rows still valid, items to compute again).

    Valid: same frame, same features version, a panel, and a transcript not fetched
    after the computation.
    """
    stored = same_frame(gold, frame).where(F.col("features_version") == version).where("panel is not null")
    pair = items.select(F.col("id").alias("content_item_id"), "transcript_fetched_at")
    fresh = F.coalesce(F.col("transcript_fetched_at") <= F.col("computed_at"), F.lit(True))
    hits = stored.join(pair, "content_item_id").where(fresh).drop("transcript_fetched_at")
    misses = items.join(hits.select(F.col("content_item_id").alias("id")), "id", "left_anti")
    return hits, misses


def language_warning(lang: Column) -> Column:
    declared = F.lower(F.coalesce(F.nullif(lang, F.lit("")), F.lit("es")))
    return F.when(~F.startswith(declared, F.lit("es")), F.concat(
        F.lit("La transcripción está en '"), F.coalesce(lang, F.lit("")),
        F.lit("'. La escala de referencia es de videos en español: los percentiles no son estrictamente comparables."),
    ))


def scale_metadata(scale: DataFrame) -> DataFrame:
    """The scale without its grids."""
    return scale.drop("grid")


