"""The retired letter score, kept for comparison with the panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from contentgauge.functions.numbers import half_even, ratio
from contentgauge.functions.text import WORD_CHAR, blank_words
from contentgauge.operators.shape import spread

# fixed values
WEIGHTS = {"title": 0.15, "duration": 0.08, "lexical_richness": 0.15, "data_density": 0.15, "source_presence": 0.10,
           "readability": 0.04, "repetition": 0.08, "category": 0.10, "engagement": 0.05, "description": 0.10}
EMOTIONAL_WORDS = ["increíble", "impactante", "sorprendente", "shocking", "amazing", "brutal", "épico", "viral",
                   "secreto", "verdad", "jamás", "nunca", "terrible", "horrible", "wow", "crazy", "insane",
                   "urgente", "alerta", "exclusivo", "escándalo", "trampa", "engaño", "revelación", "peligro",
                   "gratis", "hack", "truco", "fácil", "rápido", "simple"]
SOURCE_WORDS = ["según", "estudio", "investigación", "fuente", "paper", "research", "evidencia", "datos",
                "estadística", "encuesta", "informe", "journal", "universidad", "científico", "according", "study",
                "evidence", "publicó", "reportó", "demostró", "análisis", "hallazgo"]
CATEGORY_SCORES = {"27": 0.95, "28": 0.90, "25": 0.80, "26": 0.70, "29": 0.65, "22": 0.50, "23": 0.45, "24": 0.40,
                   "1": 0.40, "17": 0.45, "20": 0.35, "10": 0.40, "19": 0.45, "15": 0.35, "2": 0.35}
LABEL_SHORT = "⚡ Formato corto / consumo rápido"
LABEL_LONG = "⏱️ Contenido largo"
LABEL_ATTENTION = "🧠 Requiere atención sostenida"
LABEL_BACKGROUND = "🎙️ Consumo de fondo / pasivo"
LABEL_EDUCATION = "🎓 Contenido educativo / científico"
LABEL_NEWS = "📰 Noticias y análisis"
LABEL_EMOTIONAL = "🎣 Título de alto estímulo emocional"
LABEL_SOURCES = "📚 Cita fuentes o evidencia"
LABEL_DATA = "📊 Rico en datos y cifras"
LABEL_THIN = "🎯 Baja densidad informativa"
LABEL_OPINION = "🎯 Opinión sin fuentes primarias"
LABEL_CONCEPTS = "📖 Alta densidad conceptual"
LABEL_REPETITIVE = "🔁 Vocabulario muy repetitivo"
LABEL_NO_TEXT = "⚠️ Sin transcript disponible"
LABEL_ENGAGEMENT = "💬 Alto engagement de la comunidad"

WORDS = rf"{WORD_CHAR}+"
EDGE = rf"(?:(?<={WORD_CHAR})(?!{WORD_CHAR})|(?<!{WORD_CHAR})(?={WORD_CHAR}))"
FIGURES = rf"{EDGE}\p{{Nd}}+[.,]?\p{{Nd}}*\s*%?{EDGE}"


def distinct_hits(lowered: Column, words: list[str]) -> Column:
    """How many of the words occur in the text, as substrings."""
    total = F.lit(0)
    for word in words:
        total = total + F.contains(lowered, F.lit(word)).cast("int")
    return total


def _or_neutral(known: Column, score: Column) -> Column:
    return F.coalesce(F.when(known, half_even(score, 3)), F.lit(0.5))


def title_score(title: Column) -> Column:
    upper = ratio(F.regexp_count(title, F.lit(r"\p{Lu}")), F.length(title))
    bangs = F.least(F.regexp_count(title, F.lit("!")), F.lit(3))
    hits = F.least(distinct_hits(F.lower(title), EMOTIONAL_WORDS), F.lit(4))
    return _or_neutral(title != "", F.greatest(F.lit(0.0), 1.0 - (upper * 0.3 + bangs * 0.1 + hits * 0.1)))


def duration_score(seconds: Column) -> Column:
    return (
        F.when(seconds.isNull() | (seconds == 0), 0.5).when(seconds < 60, 0.10).when(seconds < 180, 0.30)
        .when(seconds < 600, 0.55).when(seconds < 1800, 0.80).otherwise(0.95)
    )


def steps(value: Column, cuts: list[tuple[float, float]], below: float) -> Column:
    out = F.when(value >= cuts[0][0], cuts[0][1])
    for cut, score in cuts[1:]:
        out = out.when(value >= cut, score)
    return out.otherwise(below)


def engagement_score(views: Column, likes: Column, comments: Column) -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0))
    like = steps(ratio(zero(likes), views), [(0.05, 1.0), (0.03, 0.8), (0.01, 0.6), (0.005, 0.45)], 0.3)
    comment = steps(ratio(zero(comments), views), [(0.005, 1.0), (0.002, 0.7), (0.001, 0.5)], 0.3)
    return _or_neutral(views >= 100, like * 0.6 + comment * 0.4)


def description_score(description: Column) -> Column:
    text = F.coalesce(description, F.lit(""))
    length = steps(F.size(blank_words(text)), [(200, 1.0), (100, 0.75), (50, 0.55)], 0.35)
    link = F.regexp_like(text, F.lit("https?://")).cast("int") * 0.15
    sources = F.least(distinct_hits(F.lower(text), SOURCE_WORDS) / 3.0, F.lit(1.0)) * 0.10
    return F.when(F.length(F.trim(text)) < 20, 0.2).otherwise(half_even(F.least(length + (link + sources), F.lit(1.0)), 3))


def category_score(category: Column) -> Column:
    pairs = ", ".join(f"'{k}', {v}D" for k, v in CATEGORY_SCORES.items())
    return F.coalesce(F.try_element_at(F.expr(f"map({pairs})"), F.coalesce(category, F.lit(""))), F.lit(0.5))


def flesch_ease(text: Column, words: Column) -> Column:
    """Reading ease from sentence marks, words and vowel groups. The former score took
    it from a third-party counter, so its values differ."""
    n = F.greatest(words, F.lit(1))
    sentences = F.greatest(F.regexp_count(text, F.lit("[.!?]+")), F.lit(1))
    groups = F.regexp_count(F.lower(text), F.lit("[aeiouyáéíóúüàèìòùâêîôûäö]+"))
    return 206.835 - 1.015 * (n / sentences) - 84.6 * (groups / n)


def score(items: DataFrame) -> DataFrame:
    """Ten signals, the weighted number, its letter and up to three labels.

    Needs title, duration_seconds, transcript, category_id, view_count, like_count,
    comment_count, description.
    """
    text = F.coalesce("transcript", F.lit(""))
    d = spread(items).withColumns({
        "_text": text, "_lower": F.lower(text), "_blank": F.size(blank_words(text)),
    })
    d = d.withColumn("_w", F.regexp_extract_all("_lower", F.lit(WORDS), F.lit(0)))
    n = F.size("_w")
    pairs = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.concat(F.get("_w", i), F.lit("_"), F.get("_w", i + 1)))
    ease = flesch_ease(F.col("_text"), n)
    band = (F.when(ease.between(30, 60), 1.0).when(ease < 10, 0.5).when(ease < 30, 0.75).when(ease < 80, 0.65).otherwise(0.3))
    has = F.col("_blank") >= 50
    figures = F.regexp_count("_text", F.lit(FIGURES))
    d = d.withColumns({
        "has_transcript": has,
        "s_title": title_score(F.col("title")),
        "s_duration": duration_score(F.col("duration_seconds")),
        "s_lexical_richness": _or_neutral(has & (n >= 200), F.greatest(F.lit(0.0), F.least(
            F.lit(1.0), (ratio(F.size(F.array_distinct("_w")), n) - 0.2) / 0.5))),
        "s_data_density": F.when(~has, 0.5).when(n == 0, 0.0).otherwise(half_even(
            F.least(F.lit(1.0), figures / (n / 100.0) / 5.0), 3)),
        "s_source_presence": _or_neutral(has, F.least(F.lit(1.0), distinct_hits(F.col("_lower"), SOURCE_WORDS) / 5.0)),
        "s_readability": F.when(has, band).otherwise(0.5),
        "s_repetition": _or_neutral(has & (n >= 20), ratio(F.size(F.array_distinct(F.when(n >= 20, pairs))), n - 1)),
        "s_category": category_score(F.col("category_id")),
        "s_engagement": engagement_score(F.col("view_count"), F.col("like_count"), F.col("comment_count")),
        "s_description": description_score(F.col("description")),
    })
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + F.col(f"s_{name}") * weight
    d = d.withColumn("score_numeric", half_even(total * 100.0, 1))
    x = F.col("score_numeric")
    d = d.withColumn("score_letter", F.when(x >= 80, "A").when(x >= 60, "B").when(x >= 40, "C").when(x >= 20, "D").otherwise("E"))
    return d.withColumn("score_labels", labels()).drop("_text", "_lower", "_blank", "_w")


def labels() -> Column:
    """The first three labels that apply, in order."""
    has, sec = F.col("has_transcript"), F.coalesce("duration_seconds", F.lit(0))
    lex, data, src = F.col("s_lexical_richness"), F.col("s_data_density"), F.col("s_source_presence")
    density = F.when(has, (lex + data + src) / 3.0)
    length = F.when((sec > 0) & (sec < 180), LABEL_SHORT).when(
        sec >= 600, F.when(density >= 0.45, LABEL_ATTENTION).when(density <= 0.35, LABEL_BACKGROUND).otherwise(LABEL_LONG))
    category = F.when(F.col("category_id").isin("27", "28"), LABEL_EDUCATION).when(F.col("category_id") == "25", LABEL_NEWS)
    evidence = F.when(~has, LABEL_NO_TEXT).when(src >= 0.6, LABEL_SOURCES).when(data >= 0.6, LABEL_DATA).when(
        density < 0.25, LABEL_THIN).when((src < 0.2) & (data < 0.2), LABEL_OPINION)
    words = F.when(has & (lex >= 0.7), LABEL_CONCEPTS).when(has & (lex <= 0.25), LABEL_REPETITIVE)
    rules = [length, category, F.when(F.col("s_title") < 0.5, LABEL_EMOTIONAL), evidence, words,
             F.when(F.col("s_engagement") >= 0.75, LABEL_ENGAGEMENT)]
    return F.slice(F.array_compact(F.array(*rules)), 1, 3)
