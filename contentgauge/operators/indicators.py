"""Per-item indicators: validity gate, text indicators and rule labels.

Everything here is a column expression, so the same code serves batch and
stream. The registry is the extension point: ``register_indicator`` adds a
column to the wide table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, functions as F

from contentgauge.functions import lexicons as L, links
from contentgauge.functions.numbers import flag, half_even, ratio
from contentgauge.operators.shape import once, spread
from contentgauge.functions.text import (
    PhraseScan, WORD_CHAR, contains_any, count_phrases, fold, lexicon_language, sql_list, strip, tokens,
)

Indicator = Callable[["Parts"], Column]

# columns an item table may lack, with their types
OPTIONAL_COLUMNS = {
    "title": "string", "description": "string", "tags": "array<string>", "category_id": "string",
    "category_name": "string", "duration_seconds": "int", "n_chapters": "int", "transcript": "string",
    "transcript_source": "string", "transcript_is_generated": "boolean", "transcript_lang": "string",
    "video_language": "string", "ritmo_cv": "double", "p_tramo_silencioso": "double",
}


@dataclass
class Parts:
    """The intermediate columns indicators are made of."""

    lexicons: dict[str, dict[str, list[str]]]
    scan: PhraseScan
    done: dict[str, Column] = field(default_factory=dict)

    n = property(lambda self: F.col("n_words"))
    toks = property(lambda self: F.col("_toks"))
    folded = property(lambda self: F.col("_folded"))
    lang = property(lambda self: F.col("et_idioma"))
    minutes = property(lambda self: F.col("_minutes"))
    title = property(lambda self: F.col("_title_folded"))

    def phrases(self, key: str) -> Column:
        lists = self.lexicons[key]
        es = self.scan.count("_hits", "_folded", lists["es"])
        en = self.scan.count("_hits", "_folded", lists["en"])
        return F.when(self.lang == "en", en).otherwise(es)

    def rate(self, key: str, per: int = 1000) -> Column:
        return ratio(self.phrases(key), self.n) * F.lit(float(per))


def not_stop(token: str, lang: str) -> str:
    """SQL: in neither the stop list of the language nor the English one."""
    en, es = sql_list(L.STOP_WORDS["en"]), sql_list(dict.fromkeys(L.STOP_WORDS["es"]))
    return f"{token} not in ({en}) and ({lang} = 'en' or {token} not in ({es}))"


def not_digits(token: str) -> str:
    return f"not ({token} >= '0' and {token} < ':' and {token} rlike '^[0-9]+$')"


def moving_type_token_ratio(toks: Column, window: int = 200) -> Column:
    """Mean share of distinct tokens over windows a quarter window apart."""
    n = F.size(toks)
    starts = F.sequence(F.lit(1), n - F.lit(window - 1), F.lit(max(1, window // 4)))
    distinct = F.transform(starts, lambda i: F.size(F.array_distinct(F.slice(toks, i, F.lit(window)))))
    total = F.aggregate(distinct, F.lit(0), lambda acc, x: acc + x)
    return (
        F.when(n == 0, None)
        .when(n < window, F.size(F.array_distinct(toks)) / n)
        .otherwise(total / (F.size(starts) * F.lit(float(window))))
    )


def once_only_share(ordered: Column) -> Column:
    """Types seen once over all types. ``ordered`` is a column of sorted tokens: an
    expression here would be sorted again for every element."""
    single = F.filter(
        ordered,
        lambda x, i: ~F.get(ordered, i - 1).eqNullSafe(x) & ~F.get(ordered, i + 1).eqNullSafe(x),
    )
    return ratio(F.size(single), F.size(F.array_distinct(ordered)))


NUMBER = r"(?<![a-z])\p{Nd}[\p{Nd}.,]*(?![a-z])"
YEAR = rf"(?<!{WORD_CHAR})(?:1[6-9]\p{{Nd}}{{2}}|20[0-4]\p{{Nd}})(?!{WORD_CHAR})"
PERCENT = rf"\p{{Nd}}+\s*%|(?<!{WORD_CHAR})(?:por\s?ciento|percent)(?!{WORD_CHAR})"


def _validity(p: Parts) -> dict[str, Column]:
    marks, n = F.col("_marks"), p.n
    coverage = ratio(n, p.minutes * 150.0)
    complete = F.coalesce((n > 0) & coverage.between(0.45, 1.6), F.lit(False))
    return {
        "v_tiene_transcripcion": flag(n > 0),
        "v_fuente_transcripcion": F.coalesce(F.nullif(F.col("transcript_source"), F.lit("")), F.lit("ninguna")),
        "v_transcripcion_auto": flag(F.col("transcript_is_generated")),
        "v_palabras_por_signo": half_even(ratio(n, marks), 1),
        "v_tiene_puntuacion": flag(ratio(n, marks) < 60),
        "v_cobertura_transcripcion": F.when(n > 0, half_even(coverage, 2)),
        "v_transcripcion_completa": flag(complete),
        "v_tiene_metadatos": flag(F.col("category_id").isNotNull()),
        "v_tiene_descripcion": flag(strip(F.col("description")) != ""),
        "v_apto_panel": flag(complete & F.col("category_id").isNotNull()),
    }


def _speech(p: Parts) -> dict[str, Column]:
    n, punctuated = p.n, F.col("v_tiene_puntuacion") == 1
    content = F.col("_content")
    return {
        "ritmo_ppm": F.when(n > 0, half_even(ratio(n, p.minutes), 1)),
        "palabras_por_frase": F.when(punctuated, half_even(ratio(n, F.col("_marks")), 1)),
        "preguntas_1000w": F.when(punctuated, half_even(ratio(F.col("_questions"), n) * 1000.0, 2)),
        "mattr_200": half_even(moving_type_token_ratio(p.toks), 4),
        "p_palabras_contenido": half_even(ratio(F.size(content), n), 3),
        "hapax_ratio": half_even(once_only_share(F.col("_content_sorted")), 3),
        "long_media_palabra": half_even(ratio(F.length(F.array_join(p.toks, "")), n), 2),
        "muletillas_1000w": half_even(p.rate("muletillas"), 2),
    }


def _evidence(p: Parts) -> dict[str, Column]:
    n, t = p.n, p.folded
    per_mille = lambda count: half_even(ratio(count, n) * 1000.0, 2)
    numbers = F.regexp_count(t, F.lit(NUMBER)) + p.scan.count("_hits", "_folded", L.NUMBER_WORDS)
    return {
        "cifras_100w": half_even(ratio(numbers, n) * 100.0, 2),
        "anios_1000w": per_mille(F.regexp_count(t, F.lit(YEAR))),
        "porcentajes_1000w": per_mille(F.regexp_count(t, F.lit(PERCENT))),
        "unidades_1000w": per_mille(p.scan.count("_hits", "_folded", L.UNITS)),
        "atribucion_1000w": half_even(p.rate("atribucion"), 2),
    }


def _reasoning(p: Parts) -> dict[str, Column]:
    return {
        "conectores_1000w": half_even(p.rate("conectores"), 2),
        "matizadores_1000w": half_even(p.rate("matizadores"), 2),
        "absolutos_1000w": half_even(p.rate("absolutos"), 2),
        "marcadores_estructura_1000w": half_even(p.rate("estructura"), 2),
        "capitulos_10min": half_even(ratio(F.col("n_chapters"), p.minutes / 10.0), 2),
        "tiene_indice": flag(F.col("n_chapters") >= 2),
        "cta_1000w": half_even(p.rate("cta"), 2),
        "patrocinio_1000w": half_even(p.rate("patrocinio"), 2),
        "anticipacion_1000w": half_even(p.rate("anticipacion"), 2),
        "promocional_1000w": half_even(p.rate("cta") + p.rate("patrocinio"), 2),
    }


def _description(p: Parts) -> dict[str, Column]:
    urls, text = F.col("_links"), F.coalesce(F.col("description"), F.lit(""))
    return {
        "enlaces_total": F.size(urls),
        "enlaces_externos": F.size(links.external(urls)),
        "enlaces_fuente": F.size(links.traceable(urls)),
        "tiene_fuentes_externas": flag(F.size(links.external(urls)) > 0),
        "desc_caracteres": F.length(text),
        "desc_timestamps": links.time_marks(text),
    }


def _title(p: Parts) -> dict[str, Column]:
    keys, topical, raw = F.col("_keys"), F.col("_topical"), F.col("title")
    measurable = (F.size(keys) > 0) & (p.n > 0)
    hits = F.size(F.filter(topical, lambda b: b))
    distinct = F.array_distinct(keys)
    return {
        "titulo_palabras_clave": F.size(keys),
        "cobertura_titulo": F.when(
            measurable, half_even(ratio(F.size(F.array_intersect(distinct, p.toks)), F.size(distinct)), 3)
        ),
        "foco_promesa": F.when(
            measurable & (hits > 0), half_even(ratio(F.array_position(topical, True) - 1, p.n), 3)
        ),
        "densidad_tema_100w": F.when(measurable & (hits > 0), half_even(ratio(hits, p.n) * 100.0, 2)),
        "n_tags": F.greatest(F.size(F.coalesce(F.col("tags"), F.array())), F.lit(0)),
        "titulo_p_mayusculas": half_even(
            ratio(F.regexp_count(raw, F.lit(r"\p{Lu}")), F.regexp_count(raw, F.lit(r"\p{L}"))), 3
        ),
        "titulo_exclamaciones": F.coalesce(F.regexp_count(raw, F.lit("[!¡]")), F.lit(0)),
        "titulo_es_pregunta": flag(F.regexp_like(raw, F.lit("[?¿]"))),
        "titulo_superlativos": count_phrases(p.title, L.SUPERLATIVES),
        "titulo_numero_lista": flag(F.regexp_like(p.title, F.lit(rf"^\s*(?:top\s*)?\p{{Nd}}{{1,2}}(?!{WORD_CHAR})"))),
    }


def _composed(p: Parts) -> dict[str, Column]:
    return {
        "ratio_matiz_absoluto": half_even(
            (F.col("matizadores_1000w") + 0.5) / (F.col("absolutos_1000w") + 0.5), 3
        ),
        "titulo_banderas": flag(F.col("titulo_p_mayusculas") > 0.5)
        + flag(F.col("titulo_exclamaciones") > 0)
        + flag(F.col("titulo_superlativos") > 0),
    }


def portion_label(seconds: Column) -> Column:
    minutes = seconds / 60.0
    return (
        F.when(minutes.isNull(), "desconocida")
        .when(minutes <= 1, "short").when(minutes <= 10, "corto").when(minutes <= 30, "medio")
        .when(minutes <= 60, "largo").otherwise("muy_largo")
    )


def _labels(p: Parts) -> dict[str, Column]:
    blob, title, category = F.col("_title_tags"), p.title, F.col("et_categoria_yt")
    chapters = F.coalesce(F.col("n_chapters"), F.lit(0))
    long_talk = F.coalesce(F.col("duration_seconds") / 60.0 > 45, F.lit(False)) & (chapters >= 3)
    listed = F.col("titulo_numero_lista") == 1
    return {
        "et_porcion": portion_label(F.col("duration_seconds")),
        "et_formato": (
            F.when(contains_any(blob, L.TALK_WORDS) | long_talk, "conversacion_larga")
            .when(contains_any(blob, L.RECAP_WORDS), "resumen_evento")
            .when(F.regexp_like(title, F.lit(L.HOWTO_PREFIX)), "instructivo")
            .when(listed | contains_any(blob, L.RANKING_WORDS), "lista_ranking")
            .when(contains_any(blob, L.LIVE_WORDS), "directo")
            .when(contains_any(blob, L.EXPLAINER_WORDS), "explicativo")
            .when(contains_any(blob, L.REVIEW_WORDS), "opinion_review")
            .when(category == "News & Politics", "actualidad")
            .when(category.isin("Education", "Science & Technology"), "divulgacion")
            .otherwise("sin_clasificar")
        ),
        "et_caducidad": F.when(count_phrases(blob, L.PERISHABLE) > 0, "perecedero").otherwise("perenne"),
        "et_promesa": (
            F.when(F.col("titulo_es_pregunta") == 1, "pregunta")
            .when(listed, "lista")
            .when(F.regexp_like(title, F.lit(L.IMPERATIVE_PREFIX)), "imperativa")
            .otherwise("declarativa")
        ),
        "et_trazabilidad": (
            F.when(F.col("enlaces_fuente") > 0, "con_fuentes_verificables")
            .when(F.col("tiene_fuentes_externas") == 1, "con_enlaces_externos")
            .when(F.col("enlaces_total") > 0, "solo_enlaces_propios")
            .otherwise("sin_enlaces")
        ),
        "et_navegabilidad": (
            F.when(F.col("n_chapters") >= 2, "con_indice")
            .when(F.col("desc_timestamps") >= 2, "timestamps_en_descripcion")
            .otherwise("bloque_continuo")
        ),
        "et_calidad_dato": (
            F.when(F.col("v_tiene_transcripcion") == 0, "sin_transcripcion")
            .when(F.col("v_transcripcion_completa") == 0, "transcripcion_parcial")
            .when(F.col("v_transcripcion_auto") == 1, "transcripcion_automatica")
            .otherwise("transcripcion_humana")
        ),
    }


_EXTRA: dict[str, Indicator] = {}


def register_indicator(name: str, build: Indicator) -> None:
    """Add a column to the wide table. ``build`` gets the parts, returns a Column."""
    _EXTRA[name] = build


_STAGES: dict[tuple, list[dict[str, Column]]] = {}


def _stages(lexicons: dict[str, dict[str, list[str]]], language_first: str) -> list[dict[str, Column]]:
    """The columns of the wide table in the order they build on one another. Columns
    do not depend on a table, so they are made once per process and list set."""
    key = (id(SparkContext._gateway), repr(lexicons), language_first, tuple(_EXTRA.items()))
    if key in _STAGES:
        return _STAGES[key]
    listed = [p for lists in lexicons.values() for phrases in lists.values() for p in phrases]
    parts = Parts(lexicons, PhraseScan(listed + L.UNITS + L.NUMBER_WORDS))
    tag_text = F.array_join(F.coalesce(F.col("tags"), F.array().cast("array<string>")), " ")
    category = F.coalesce(F.nullif(F.col("category_name"), F.lit("")), F.lit("sin_categoria"))
    text = F.coalesce(F.col("transcript"), F.lit(""))
    inputs = {
        "et_idioma": lexicon_language(F.col("video_language"), F.col("transcript_lang"), language_first),
        "et_categoria_yt": category,
        "_folded": fold(F.col("transcript")),
        "_title_folded": fold(F.col("title")),
        "_title_tags": fold(F.concat_ws(" ", F.coalesce(F.col("title"), F.lit("")), tag_text)),
        "_minutes": F.nullif(F.col("duration_seconds"), F.lit(0)) / 60.0,
        "_marks": F.regexp_count(text, F.lit("[.!?…]")),
        "_questions": F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit(""))),
        "_links": links.links(F.col("description")),
    }
    words = {
        "_hits": parts.scan.hits(F.col("_folded")),
        "_title_toks": tokens(F.col("_title_folded")),
    }
    counted = {
        "n_words": F.size("_toks"),
        "_content": F.expr(f"filter(_toks, t -> {not_stop('t', 'et_idioma')} and {not_digits('t')})"),
        "_keys": F.expr(f"filter(_title_toks, t -> length(t) > 3 and {not_stop('t', 'et_idioma')})"),
    }
    gate = {
        "_content_sorted": F.sort_array("_content"),
        "_topical": F.transform("_toks", lambda t: F.array_contains(F.col("_keys"), t)),
        **_validity(parts),
    }
    measured = {
        **_speech(parts), **_evidence(parts), **_reasoning(parts), **_description(parts), **_title(parts),
    }
    composed = {**_composed(parts), **{name: build(parts) for name, build in _EXTRA.items()}}
    _STAGES[key] = [inputs, words, counted, gate, measured, composed, _labels(parts)]
    return _STAGES[key]


def describe(
    items: DataFrame,
    lexicons: dict[str, dict[str, list[str]]] | None = None,
    language_first: str = "transcript",
) -> DataFrame:
    """The wide table: one row per item, every indicator and label.

    Texts are folded, tokenised and scanned once per row; no shuffle. A caller
    who selects few indicators pays for those only, the rest is pruned.
    """
    missing = {n: F.lit(None).cast(kind) for n, kind in OPTIONAL_COLUMNS.items() if n not in items.columns}
    df = spread(items)
    df = df.withColumns(missing) if missing else df
    made: list[str] = []
    for stage in _stages(lexicons or L.LEXICONS, language_first):
        df = df.withColumns(stage)
        made += stage
        if "_folded" in stage:
            df = once(df, _toks=tokens(F.col("_folded")))
            made.append("_toks")
    return df.drop(*[c for c in made if c.startswith("_")])


# ------------------------------------------------------------------ pace


def pace_bins(segments: DataFrame, key: str = "content_id", seconds: int = 30) -> DataFrame:
    """Words per (item, 30-second bin) from transcript segments (start_s, text)."""
    from contentgauge.functions.text import raw_word_count

    return segments.groupBy(key, F.floor(F.col("start_s") / seconds).cast("int").alias("bin")).agg(
        F.sum(raw_word_count(F.col("text"))).alias("words")
    )


def bin_count(seconds: Column, width: int = 30) -> Column:
    return F.greatest(F.lit(1), F.ceil(seconds / float(width)).cast("int"))


def pace_spine(items: DataFrame, segments: DataFrame, key: str = "content_id") -> DataFrame:
    """Every bin of every item with its words, empty bins included."""
    spine = items.where("duration_seconds > 0").select(
        key, F.explode(F.sequence(F.lit(0), bin_count(F.col("duration_seconds")) - 1)).alias("bin")
    )
    return spine.join(pace_bins(segments, key), [key, "bin"], "left").fillna(0, ["words"])


def pace(items: DataFrame, segments: DataFrame, key: str = "content_id") -> DataFrame:
    """ritmo_cv and p_tramo_silencioso per item.

    The empty bins never become rows: the mean and the deviation follow from the
    number of bins, the sum and the sum of squares; an empty bin is always below
    0.4 of a positive mean.
    """
    sized = items.where("duration_seconds > 0").select(
        key, bin_count(F.col("duration_seconds")).cast("long").alias("bins")
    )
    filled = pace_bins(segments, key).join(sized, key).where("bin < bins")
    sums = filled.groupBy(key).agg(
        F.max("bins").alias("bins"), F.sum("words").alias("s1"), F.sum(F.col("words") * F.col("words")).alias("s2"),
        F.count(F.lit(1)).alias("filled"),
    )
    quiet = (
        filled.join(sums.select(key, "s1"), key)
        .groupBy(key).agg(F.sum(flag(F.col("words") < 0.4 * (F.col("s1") / F.col("bins")))).alias("quiet"))
    )
    return (
        sums.where("s1 > 0").join(quiet, key)
        .select(
            key,
            half_even(F.sqrt((F.col("bins") * F.col("s2") - F.col("s1") * F.col("s1")).cast("double")) / F.col("s1"), 3)
            .alias("ritmo_cv"),
            half_even((F.col("bins") - F.col("filled") + F.col("quiet")) / F.col("bins"), 3)
            .alias("p_tramo_silencioso"),
        )
    )
