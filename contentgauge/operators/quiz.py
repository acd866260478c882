"""Retention quizzes: item controls, scoring and retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from contentgauge.functions.numbers import flag, half_even, ratio
from contentgauge.functions.text import blank_words, contains_any, quiz_fold
from contentgauge.operators.shape import once, spread

OPTIONS = 4
# fixed values
EMPTY_WORDS = ["el", "la", "los", "las", "un", "una", "unos", "unas", "de", "del", "al", "y", "o", "que", "en",
               "con", "por", "para", "su", "sus", "es", "son", "the", "of", "and", "to", "in", "a", "mas", "no",
               "se", "lo"]
INFERENCE_TYPES = ["argumento", "relacion", "definicion"]
ADVERT_PHRASES = ["patrocina", "patrocinado por", "codigo de descuento", "cupon de descuento", "usa mi codigo",
                  "link en la descripcion", "enlace en la descripcion", "suscribite al canal",
                  "suscribete al canal", "dale like", "activa la campanita", "este video es posible gracias a",
                  "entradas ya a la venta", "consegui tus entradas", "mi curso", "nuestra tienda",
                  "invitado de hoy es gracias a"]
UNBACKED_FORMS = ["conversacion_larga", "directo", "opinion_review", "resumen_evento", "sin_clasificar"]
FIRST_WINDOWS, SECOND_WINDOWS = (0.00, 0.50, 1.00), (0.15, 0.42, 0.78)


def words_of(folded: Column) -> Column:
    return F.filter(F.split(folded, " "), lambda w: w != "")


# ------------------------------------------------------------------ anchoring


def longest_run(words: Column, text: Column) -> Column:
    """Length of the longest run of consecutive ``words`` found in ``text``.

    What a run contains is found too, so while the end moves right the best length
    grows by at most one: one search per word.
    """
    def step(best: Column, end: Column) -> Column:
        run = F.array_join(F.slice(words, end - best, best + 1), " ")
        return F.when((end > best) & F.contains(text, run), best + 1).otherwise(best)

    return F.when(F.size(words) > 0, F.aggregate(F.sequence(F.lit(1), F.size(words)), F.lit(0), step)).otherwise(0)


def anchoring(quotes: DataFrame, quote: str = "cita", transcript: str = "transcript") -> DataFrame:
    """anclada, motivo_anclaje: does the quote occur in the transcript?"""
    d = once(spread(quotes), _q=quiz_fold(F.col(quote)), _t=quiz_fold(F.col(transcript)))
    d = d.withColumn("_w", words_of(F.col("_q")))
    n = F.size("_w")
    literal = F.contains("_t", F.col("_q"))
    d = once(d, _best=F.when((n >= 6) & ~literal, longest_run(F.col("_w"), F.col("_t"))))
    best = F.col("_best")
    partial = (best >= 6) | (best >= F.lit(0.6) * n)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    d = d.withColumns({
        "anclada": F.when(n < 6, False).otherwise(F.coalesce(literal, F.lit(False)) | F.coalesce(partial, F.lit(False))),
        "motivo_anclaje": F.when(n == 0, "cita_vacia")
        .when(n < 6, text("cita_demasiado_corta_", n, "_palabras")).when(literal, "literal")
        .when(partial, text("parcial_", best, "_de_", n)).otherwise(text("no_encontrada_max_", best, "_palabras")),
    })
    return d.drop("_q", "_t", "_w", "_best")


def sufficiency(answer: Column, quote_words: Column, kind: Column) -> Column:
    """struct(ok, motivo): do the words of the answer occur in the quote? The words of
    the quote come as a column; they are looked up for every word of the answer."""
    content = F.filter(words_of(quiz_fold(answer)), lambda w: (F.length(w) > 1) & ~w.isin(EMPTY_WORDS))
    in_quote = F.size(F.filter(content, lambda w: F.array_contains(quote_words, w)))
    n, infers = F.size(content), F.coalesce(kind.isin(INFERENCE_TYPES), F.lit(False))
    least = F.when(infers, 1).otherwise(F.greatest(F.lit(1), F.floor((n + 1) / 2).cast("int")))
    label = F.when(infers, "inferencia").otherwise("dato")
    ok = (n > 0) & (in_quote >= least)
    motive = (
        F.when(n == 0, "respuesta_vacia")
        .when(ok, F.concat(label, F.lit("_"), in_quote.cast("string"), F.lit("_de_"), n.cast("string")))
        .otherwise(F.concat(label, F.lit("_solo_"), in_quote.cast("string"), F.lit("_de_"), n.cast("string"),
                            F.lit("_pedia_"), least.cast("string")))
    )
    return F.struct(ok.alias("ok"), motive.alias("motivo"))


def magnitude(option: Column) -> Column:
    """First number of an option, 'mil' and 'millon' resolved; null without a number."""
    t = quiz_fold(option)
    v = F.nullif(F.regexp_extract(t, r"(\d+(?:[.,]\d+)?)", 1), F.lit(""))
    v = F.replace(v, F.lit(","), F.lit(".")).cast("double")
    return v * F.when(F.contains(t, F.lit("millon")), 1e6).when(
        F.contains(t, F.lit("mil ")) | F.endswith(t, F.lit(" mil")), 1e3).otherwise(1.0)


def unit_of(option: Column) -> Column:
    """Last word of an option that is neither a number nor an empty word."""
    words = F.filter(words_of(quiz_fold(option)), lambda w: ~F.regexp_like(w, F.lit(r"^\d+$")) & ~w.isin(EMPTY_WORDS))
    return F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit(""))


def balance(options: Column, correct: Column) -> Column:
    """struct(ok, motivo): does the form of the right option give it away?"""
    n = F.size(options)
    numeric = F.size(F.filter(options, lambda o: F.regexp_like(o, F.lit(r"\d"))))
    short = F.forall(options, lambda o: F.size(blank_words(o)) <= 4)
    units = F.array_sort(F.array_distinct(F.filter(F.transform(options, unit_of), lambda u: u != "")))
    values = F.filter(F.transform(options, magnitude), lambda v: v > 0)
    spread = ratio(F.array_max(values), F.array_min(values))
    others = F.sort_array(F.transform(F.filter(options, lambda o, i: i != correct), lambda o: F.length(o)))
    middle = F.get(others, F.floor(F.size(others) / 2).cast("int"))
    share = ratio(F.length(F.get(options, correct)), middle)
    two = lambda v: F.format_string("%.2f", half_even(v, 2))
    motive = (
        F.when(n < 2, "faltan_opciones")
        .when((numeric >= n - 1) & short & (F.size(units) > 1),
              F.concat(F.lit("unidades_mezcladas_["),
                       F.array_join(F.transform(units, lambda u: F.concat(F.lit("'"), u, F.lit("'"))), ", "), F.lit("]")))
        .when((F.size(values) == n) & (spread > 50),
              F.concat(F.lit("magnitudes_dispares_x"), half_even(spread, 0).cast("long").cast("string")))
        .when(share > 1.6, F.concat(F.lit("correcta_mas_larga_x"), two(share)))
        .when(share < 0.5, F.concat(F.lit("correcta_mas_corta_x"), two(share)))
        .otherwise("equilibradas")
    )
    return F.struct((motive == "equilibradas").alias("ok"), motive.alias("motivo"))


def is_advert(quote: Column, phrases: Sequence[str] = ADVERT_PHRASES) -> Column:
    """Does the folded quote hold a phrase? It is folded once, as the element of an array: inside the
    lambda of an array function it would be folded again for every phrase."""
    return F.exists(F.array(quiz_fold(quote)), lambda folded: contains_any(folded, phrases))


def shuffled_options(options: Column, correct: Column, key: Column, seed: str) -> Column:
    """struct(opciones, correcta): options in md5 order and the new place of the right one."""
    dealt = F.array_sort(F.transform(options, lambda o, i: F.struct(
        F.md5(F.concat_ws(":", key, F.lit(seed), i, o)).alias("h"), i.alias("i"), o.alias("o"))))
    place = F.array_position(F.transform(dealt, lambda s: s["i"]), correct) - 1
    return F.struct(F.transform(dealt, lambda s: s["o"]).alias("opciones"), place.cast("int").alias("correcta"))


# ------------------------------------------------------------------ the cascade


def form_fault(question: Column, options: Column, correct: Column) -> Column:
    """First fault of form, null when there is none."""
    n = F.size(options)
    distinct = F.size(F.array_distinct(F.transform(options, quiz_fold)))
    # an index may count from the end, as long as it stays inside the list
    valid = correct.isNotNull() & correct.between(-OPTIONS, OPTIONS - 1)
    return (
        F.when(options.isNull() | (n != OPTIONS) | (F.coalesce(F.trim(question), F.lit("")) == ""), "formato_invalido")
        .when(distinct != OPTIONS, "opciones_duplicadas").when(~valid, "indice_correcto_invalido")
    )


def control(questions: DataFrame, seed: str = "20260820") -> DataFrame:
    """Every control in order; the first that fails names the discard.

    ``questions``: pregunta_id, pregunta, opciones, correcta, cita, tipo, transcript,
    control_eleccion (the answer of the outside model, or null when it failed).
    """
    d = questions.withColumns({"cita": F.trim("cita"), "_form": form_fault(F.col("pregunta"), F.col("opciones"), F.col("correcta"))})
    at = F.when(F.col("correcta") < 0, F.col("correcta") + OPTIONS).otherwise(F.col("correcta"))
    d = once(d, _mix=shuffled_options(F.col("opciones"), at.cast("int"), F.col("pregunta_id"), seed))
    d = d.withColumns({
        "_answer": F.when(F.col("_form").isNull(), F.get(F.col("opciones"), at)),
        "opciones": F.when(F.col("_form").isNull(), F.col("_mix.opciones")).otherwise(F.col("opciones")),
        "correcta": F.when(F.col("_form").isNull(), F.col("_mix.correcta")),
    }).drop("_mix")
    d = anchoring(d)
    d = once(d, _quote=words_of(quiz_fold(F.col("cita"))))
    d = once(d, _suf=sufficiency(F.col("_answer"), F.col("_quote"), F.col("tipo")),
             _bal=balance(F.col("opciones"), F.col("correcta")))
    formed = F.col("_form").isNull()
    anchored = formed & F.col("anclada")
    justified = anchored & F.col("_suf.ok")
    balanced = justified & F.col("_bal.ok")
    kept = balanced & ~is_advert(F.col("cita"))
    trivial = F.when(kept, F.col("control_eleccion") == F.col("correcta"))
    d = d.withColumns({
        "descarte": F.when(~formed, F.col("_form")).when(~anchored, "cita_no_verificable")
        .when(~justified, "cita_no_justifica").when(~balanced, "opciones_desbalanceadas")
        .when(~kept, "pregunta_sobre_publicidad").when(trivial.isNull(), "control_fallo"),
        "justificada": F.when(anchored, F.col("_suf.ok")), "motivo_justificacion": F.when(anchored, F.col("_suf.motivo")),
        "equilibrada": F.when(justified, F.col("_bal.ok")), "motivo_equilibrio": F.when(justified, F.col("_bal.motivo")),
        "anclada": anchored, "motivo_anclaje": F.when(formed, F.col("motivo_anclaje")),
        "linea_base_acerto": trivial,
    })
    return d.withColumns({
        "dificil": ~F.col("linea_base_acerto"), "sobrevive": F.col("descarte").isNull(),
    }).drop("_form", "_answer", "_quote", "_suf", "_bal")


def recontrol(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """New outside answers on frozen questions. Only questions that had a baseline are
    touched; the former values are kept beside the new ones. ``answers``: pregunta_id,
    nueva_eleccion."""
    d = questions.join(answers, "pregunta_id", "left")
    had = F.col("linea_base_acerto").isNotNull() & F.col("correcta").isNotNull()
    failed = had & F.col("nueva_eleccion").isNull()
    hit = F.when(had & ~failed, F.col("nueva_eleccion") == F.col("correcta")).otherwise(F.col("linea_base_acerto"))
    return d.withColumns({
        "trivial_previo": F.when(had, F.col("linea_base_acerto")),
        "control_eleccion": F.when(had & ~failed, F.col("nueva_eleccion")).otherwise(F.col("control_eleccion")),
        "_hit": hit,
        "sobrevive": F.when(failed, False).when(had, True).otherwise(F.col("sobrevive")),
        "descarte": F.when(failed, "control_fallo").when(had, None).otherwise(F.col("descarte")),
    }).withColumns({"linea_base_acerto": F.col("_hit"), "dificil": ~F.col("_hit")}).drop("_hit", "nueva_eleccion")


def funnel(questions: DataFrame) -> DataFrame:
    """generated, anchored, justified, usable, usable per video, baseline hits, hard."""
    return questions.groupBy("content_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(flag(F.col("anclada"))).alias("a"),
        F.sum(flag(F.col("justificada"))).alias("j"), F.sum(flag(F.col("sobrevive"))).alias("s"),
        F.sum(flag(F.col("linea_base_acerto"))).alias("b"), F.sum(flag(F.col("dificil"))).alias("d"),
    ).agg(
        F.count(F.lit(1)).alias("videos"), F.sum("n").alias("generadas"), F.sum("a").alias("ancladas"),
        F.sum("j").alias("justificadas"), F.sum("s").alias("utilizables"), F.sum("b").alias("base_acerto"),
        F.sum("d").alias("dificiles"), half_even(F.sum("s") / F.count(F.lit(1)), 6).alias("por_video"))


def discards(questions: DataFrame) -> DataFrame:
    return questions.where("descarte is not null").groupBy(F.split_part("descarte", F.lit(":"), F.lit(1)).alias("motivo")).agg(
        F.count(F.lit(1)).alias("n"))


def by_type(questions: DataFrame) -> DataFrame:
    return questions.groupBy("tipo").agg(F.count(F.lit(1)).alias("generadas"), F.sum(flag(F.col("sobrevive"))).alias("sobreviven"))


# ------------------------------------------------------------------ text samples


def _window(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start + 1, size), " ")


def sampled_text(text: Column, words: Column, size: int, fractions: tuple[float, ...]) -> Column:
    """Windows of a text at the given fractions; the text itself when short enough."""
    n, width = F.size(words), max(30, size // len(fractions))
    last = n - F.lit(width)
    starts = [F.least(F.greatest(F.lit(0), F.floor(F.lit(f) * last).cast("int")), last) for f in fractions]
    parts = [_window(words, F.greatest(s, F.lit(0)), F.lit(width)) for s in starts]
    return F.when(n <= size, text).otherwise(F.concat_ws("\n[...]\n", *parts))


def thirds(text: Column, words: Column, size: int) -> Column:
    """Head, middle and tail of a text that is longer than ``size`` words."""
    n, third = F.size(words), size // 3
    half = F.floor(n / 2).cast("int")
    parts = [
        _window(words, F.lit(0), F.lit(third)),
        _window(words, F.greatest(half - third // 2, F.lit(0)), F.lit(2 * (third // 2))),
        _window(words, F.greatest(n - third, F.lit(0)), F.lit(third)),
    ]
    return F.when(n <= size, text).otherwise(F.concat_ws("\n[...]\n", *parts))


def even_picks(df: DataFrame, value: str, row_id: str, wanted: int) -> DataFrame:
    """``wanted`` rows spread evenly over the order (value desc, row_id)."""
    from contentgauge.operators.skew import numbered

    total = df.agg(F.count(F.lit(1)).alias("_total"))
    # smallest pick i whose place floor(i * total / wanted) reaches the position
    placed = numbered(df, value, row_id).join(F.broadcast(total))
    pick = F.ceil(F.col("position") * F.lit(float(wanted)) / F.col("_total"))
    chosen = (pick < wanted) & (F.floor(pick * F.col("_total") / F.lit(float(wanted))) == F.col("position"))
    return placed.where(chosen | (F.col("_total") <= wanted)).drop("_total")


# ------------------------------------------------------------------ answers and retention


def score_answers(answers: DataFrame, questions: DataFrame, watched: DataFrame | None = None,
                  skipped: DataFrame | None = None) -> DataFrame:
    """acierto and days since viewing; answers on skipped videos are left out.

    ``answers``: persona_id, pregunta_id, eleccion, respondido_at. ``watched`` (optional):
    content_id, watched_at. ``skipped``: persona_id, content_id.
    """
    from contentgauge.operators.skew import salted_join

    d = salted_join(answers, questions.select("pregunta_id", "content_id", "correcta"), "pregunta_id", "respondido_at")
    if skipped is not None:
        d = d.join(skipped, ["persona_id", "content_id"], "left_anti")
    if watched is not None:
        days = (F.unix_micros("respondido_at") - F.unix_micros("watched_at")) / F.lit(86_400_000_000.0)
        d = salted_join(d, watched, "content_id", "respondido_at", "left").withColumn("dias_transcurridos", half_even(days, 2))
    return d.withColumn("acierto", F.col("eleccion") == F.col("correcta"))


def retention(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Retention per (person, video): raw, on the hard items, corrected for guessing.

    ``answers``: persona_id, pregunta_id, acierto, respondido_at, dias. Answers are
    folded per (person, question) first; a question everybody answers is then dealt
    over several tasks.
    """
    from contentgauge.operators.skew import salted_join

    folded = answers.groupBy("persona_id", "pregunta_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(flag(F.col("acierto"))).alias("ok"),
        F.max("respondido_at").alias("t"), F.sum("dias").alias("days"), F.count("dias").alias("n_days"))
    usable = questions.where("utilizable").select("pregunta_id", "content_id", "dificil", "linea_base_acerto")
    hard, base = flag(F.col("dificil")), flag(F.col("linea_base_acerto"))
    agg = salted_join(folded, usable, "pregunta_id", "persona_id").groupBy("persona_id", F.col("content_id").alias("content_item_id")).agg(
        F.sum("n").alias("n_items"), F.sum("ok").alias("aciertos"), F.sum(F.col("n") * hard).alias("n_dificiles"),
        F.sum(F.col("ok") * hard).alias("aciertos_dificiles"), F.sum(F.col("n") * base).alias("_base"),
        F.max("t").alias("respondido_at"), F.sum("days").alias("_days"), F.sum("n_days").alias("_ndays"))
    raw, b = ratio(F.col("aciertos"), F.col("n_items")), ratio(F.col("_base"), F.col("n_items"))
    return agg.withColumns({
        "retencion_bruta": half_even(raw, 4),
        "retencion_dificil": half_even(ratio(F.col("aciertos_dificiles"), F.col("n_dificiles")), 4),
        "tasa_linea_base": half_even(b, 4),
        "retencion_corregida": F.when(b < 1, half_even(ratio(raw - b, 1 - b), 4)),
        "dias_transcurridos": half_even(ratio(F.col("_days"), F.col("_ndays")), 6),
    }).drop("_base", "_days", "_ndays")


def retention_dataset(answers: DataFrame, questions: DataFrame, items: DataFrame, features: DataFrame) -> DataFrame:
    """Retention rows with duration, format and percentiles of the item. ``features``
    keeps its columns; both sides have one row per item."""
    seconds = F.greatest(F.col("duration_seconds"), F.lit(1)).cast("double")
    return (
        retention(answers, questions)
        .join(items.select(F.col("content_id").alias("content_item_id"), "duration_seconds"), "content_item_id")
        .join(features, "content_item_id").withColumn("log_duracion", half_even(F.ln(seconds), 6))
    )


def unanswered(questions: DataFrame, answers: DataFrame, person: str) -> DataFrame:
    """Questions of videos the person has answered nothing about; all for ''."""
    if not person:
        return questions
    done = answers.where(F.col("persona_id").cast("string") == person).select("pregunta_id").distinct()
    seen = done.join(questions.select("pregunta_id", "content_id"), "pregunta_id").select("content_id").distinct()
    return questions.join(seen, "content_id", "left_anti")


def first_videos(questions: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` videos in order, each with its questions as an array."""
    videos = questions.groupBy("content_id").agg(F.min(F.struct(*order)).alias("_o"))
    chosen = videos.orderBy("_o", "content_id").limit(limit)
    rows = questions.join(F.broadcast(chosen.select("content_id")), "content_id")
    return rows.groupBy("content_id").agg(F.array_sort(F.collect_list(F.struct("pregunta_id", "correcta"))).alias("preguntas"))


# ------------------------------------------------------------------ format check


def unbacked(fmt: Column, form: Column) -> Column:
    """The rule says informativo though the editorial form does not back it."""
    return (fmt == "informativo") & (form.isNull() | form.isin(UNBACKED_FORMS))


def consistency(passes: Column) -> Column:
    """struct(autoconsistente, observado) from the labels of several passes."""
    seen = F.filter(passes, lambda p: p.isNotNull())
    one = F.size(F.array_distinct(seen)) == 1
    return F.struct(one.alias("autoconsistente"), F.when(one, F.get(seen, F.lit(0))).alias("observado"))
