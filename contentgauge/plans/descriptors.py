"""Registered queries: text functions (H), indicators (I) and the first scale steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentgauge.functions import lexicons as L, numbers, text as T
from contentgauge.operators import indicators as I, scale as S
from contentgauge.plans import sql_features as Q, views as V
from contentgauge.plans.common import described
from contentgauge.plans.registry import query
from contentgauge.plans.sql_features import rounded, text


def longs(df, *names):
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# ------------------------------------------------------------------ H: scalar functions


@query("h01_fold", """select doc_id, length(f)::bigint as chars, md5(f) as folded from
 (select doc_id, strip_accents(lower(text)) f from documents)""")
def h01(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", T.fold(F.col("text")).alias("f"))
    return d.select("doc_id", F.length("f").cast("long").alias("chars"), F.md5("f").alias("folded"))


@query("h02_quiz_fold", r"""select doc_id, md5(trim(regexp_replace(regexp_replace(
   strip_accents(lower(text)), '[^a-z0-9ñ ]+', ' ', 'g'), '\s+', ' ', 'g'))) as folded from documents""")
def h02(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", F.md5(T.quiz_fold(F.col("text"))).alias("folded"))


@query("h03_tokens", """select content_id, n::bigint as tokens, len(list_distinct(toks))::bigint as types from tok""", Q.TOKENS)
def h03(spark, sf):
    d = V.content(spark, sf).select("content_id", T.fold(F.col("transcript")).alias("f"))
    d = d.select("content_id", T.tokens(F.col("f")).alias("t"))
    return d.select("content_id", F.size("t").cast("long").alias("tokens"),
                    F.size(F.array_distinct("t")).cast("long").alias("types"))


COUNTED = ["of the", "the", "de la", "la", "is", "that is", "in the", "y", "et"]


@query("h04_phrase_counts", f"select content_id, {Q.phrase_count(COUNTED)}::bigint as hits from tok", Q.TOKENS)
def h04(spark, sf):
    d = V.content(spark, sf).select("content_id", T.fold(F.col("transcript")).alias("f"))
    return d.select("content_id", T.count_phrases(F.col("f"), COUNTED).cast("long").alias("hits"))


RATES = {f"{k}_1000w": k for k in ("conectores", "atribucion", "matizadores", "absolutos", "muletillas", "cta",
                                   "patrocinio", "anticipacion")}
RATES["marcadores_estructura_1000w"] = "estructura"


@query("h05_i07_lexicon_rates", "select content_id, "
       + ", ".join(f"{rounded(Q.rate(k), 2)} as {c}" for c, k in RATES.items()) + " from tok", Q.TOKENS)
def h05(spark, sf):
    return described(spark, sf).select("content_id", *RATES)


@query("h06_character_shares", r"""select doc_id, len(regexp_extract_all(text, '[!¡]'))::bigint as exclamations,
   len(regexp_extract_all(text, '\?'))::bigint as questions,
   round(len(regexp_extract_all(text, '\p{Lu}')) / nullif(len(regexp_extract_all(text, '\p{L}')), 0)::double, 6) as upper_share
 from documents""")
def h06(spark, sf):
    t = F.col("text")
    return V.table(spark, sf, "documents").select(
        "doc_id", F.regexp_count(t, F.lit("[!¡]")).cast("long").alias("exclamations"),
        (F.length(t) - F.length(F.replace(t, F.lit("?"), F.lit("")))).cast("long").alias("questions"),
        F.round(numbers.ratio(F.regexp_count(t, F.lit(r"\p{Lu}")), F.regexp_count(t, F.lit(r"\p{L}"))), 6).alias("upper_share"))


YEAR_SQL = rf"len(regexp_extract_all({Q.WORDY}, '[^\p{{L}}\p{{N}}_](?:1[6-9][0-9]{{2}}|20[0-4][0-9])[^\p{{L}}\p{{N}}_]'))"
PCT_SQL = (rf"(len(regexp_extract_all(tnorm, '[0-9]+\s*%')) + len(regexp_extract_all({Q.WORDY}, "
           r"'[^\p{L}\p{N}_](?:por\s{0,2}ciento|percent)[^\p{L}\p{N}_]')))")


@query("h07_i10_i11_quantities", f"""select content_id, {Q.COLUMNS['cifras_100w']} as cifras_100w,
 {rounded(YEAR_SQL + " / nullif(n, 0)::double * 1e3", 2)} as anios_1000w,
 {rounded(PCT_SQL + " / nullif(n, 0)::double * 1e3", 2)} as porcentajes_1000w,
 {rounded(Q.phrase_count(L.UNITS) + " / nullif(n, 0)::double * 1e3", 2)} as unidades_1000w from tok""", Q.TOKENS)
def h07(spark, sf):
    return described(spark, sf).select("content_id", "cifras_100w", "anios_1000w", "porcentajes_1000w", "unidades_1000w")


TS_SQL = r"len(regexp_extract_all(' ' || regexp_replace({c}, '([^\p{{L}}\p{{N}}_:])', '\1\1', 'g') || ' ', '[^\p{{L}}\p{{N}}_][0-9]{{1,2}}:[0-9]{{2}}(?::[0-9]{{2}})?[^\p{{L}}\p{{N}}_]'))"


@query("h08_h09_page_links", f"""select page_id, len(u)::bigint as links,
 len(list_filter(u, lambda x: not regexp_matches(x, {Q.SOCIAL})))::bigint as external,
 len(list_filter(u, lambda x: regexp_matches(x, {Q.TRACEABLE})))::bigint as traceable
 from (select page_id, regexp_extract_all(html || ' ' || url, {text(L.URL_PATTERN)}) as u from pages)""")
def h08(spark, sf):
    from contentgauge.functions import links as K
    p = V.table(spark, sf, "pages").select("page_id", K.links(F.concat_ws(" ", "html", "url")).alias("u"))
    return p.select("page_id", F.size("u").cast("long").alias("links"), F.size(K.external(F.col("u"))).cast("long").alias("external"),
                    F.size(K.traceable(F.col("u"))).cast("long").alias("traceable"))


# lengths of the texts as seconds, written as durations with days (from a day on) or without; the other texts stand for what is no duration
@query("h10_iso_durations", """select doc_id, case when lang <> 'es' then s end as with_days, case when lang = 'en' or lang <> 'es' and s < 86400 then nullif(s, 0) end as clock_only
 from (select doc_id, lang, n_chars * 97 as s from documents)""")
def h10(spark, sf):
    s = F.col("n_chars") * 97
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))).otherwise("")
    whole = lambda n: F.floor(n).cast("long")
    clock = F.concat(part(whole(s % 3600 / 60), "M"), part(s % 60, "S"))
    iso = F.when(F.col("lang") == "en", F.concat(F.lit("PT"), part(whole(s / 3600), "H"), clock)).when(
        F.col("lang") != "es", F.concat(F.lit("P"), part(whole(s / 86400), "D"), F.lit("T"), part(whole(s % 86400 / 3600), "H"), clock)
    ).otherwise(F.col("text"))
    d = V.table(spark, sf, "documents").select("doc_id", iso.alias("iso"))
    return d.select("doc_id", numbers.iso_seconds(F.col("iso"), True).alias("with_days"), numbers.iso_seconds(F.col("iso")).alias("clock_only"))


HINTS = ["error", "view", "zzz"]


@query("h11_hint_match", "select event_id, (" + " or ".join(f"contains(lower(event_type || props), '{h}')" for h in HINTS)
       + ")::int as hit from events")
def h11(spark, sf):
    blob = F.lower(F.concat("event_type", "props"))
    return V.table(spark, sf, "events").select("event_id", numbers.flag(T.contains_any(blob, HINTS)).alias("hit"))


@query("h12_h13_local_time", """select event_id, extract(hour from l)::int as hora, strftime(l, '%Y-%m-%d') as dia,
   floor(extract(epoch from (ts - timestamp '2023-06-15 00:00:00')) / 86400)::bigint as edad
 from (select event_id, ts, ts at time zone 'UTC' at time zone 'Europe/Paris' as l from events)""")
def h12(spark, sf):
    from contentgauge.operators.diet import age_days, local_time
    e = V.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    local = local_time(F.col("ts"))
    return e.select("event_id", F.hour(local).alias("hora"), F.date_format(local, "yyyy-MM-dd").alias("dia"),
                    age_days(F.col("ts"), F.lit("2023-06-15 00:00:00").cast("timestamp")).alias("edad"))


# whole texts as JSON lists of their words, next to texts that are no JSON and objects that are no list
@query("h14_json_lists", """select 'words' as kind, doc_id as id, coalesce(len(string_split(text, ' ')), 0)::bigint as n, md5(coalesce(text, '')) as words from documents
 union all select 'text', doc_id, 0, md5('') from documents union all select 'props', event_id, 0, md5('') from events""")
def h14(spark, sf):
    docs, events = V.table(spark, sf, "documents"), V.table(spark, sf, "events")
    rows = docs.select(F.lit("words").alias("kind"), F.col("doc_id").alias("id"), F.to_json(F.split("text", " ")).alias("raw")).unionByName(
        docs.select(F.lit("text").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("raw"))).unionByName(
        events.select(F.lit("props").alias("kind"), F.col("event_id").alias("id"), F.col("props").alias("raw")))
    listed = rows.select("kind", "id", T.json_list(F.col("raw")).alias("l"))
    return listed.select("kind", "id", F.size("l").cast("long").alias("n"), F.md5(F.array_join("l", " ")).alias("words"))


@query("h15_json_path", """select event_id, json_extract_string(props, '$.k') as k from events""")
def h15(spark, sf):
    return V.table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("h16_language_base", """select doc_id, split_part(lang || '-419', '-', 1) as base from documents""")
def h16(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", T.language_base(F.concat("lang", F.lit("-419"))).alias("base"))


@query("h17_magnitudes", """select event_id, replace(regexp_extract(v, '([0-9]+)', 1), ',', '.')::double
  * case when event_id % 3 = 0 then 1e6 when event_id % 3 = 1 then 1e3 else 1e0 end as value
 from (select event_id, floor(value)::bigint::varchar as v from events)""")
def h17(spark, sf):
    from contentgauge.operators.quiz import magnitude
    e = F.col("event_id")
    option = F.concat(F.floor("value").cast("long").cast("string"),
                      F.when(e % 3 == 0, " millones de euros").when(e % 3 == 1, " mil euros").otherwise(" euros"))
    return V.table(spark, sf, "events").select("event_id", magnitude(option).alias("value"))


@query("h18_clean_numbers", """select event_id, case when event_id % 5 = 0 then null else value end as v from events""")
def h18(spark, sf):
    e = F.col("event_id")
    dirty = F.when(e % 10 == 0, F.lit(float("nan"))).when(e % 10 == 5, F.lit(float("inf"))).otherwise(F.col("value"))
    return V.table(spark, sf, "events").select("event_id", numbers.clean_number(dirty).alias("v"))


# ------------------------------------------------------------------ I: indicators


@query("i01_validity_gate", f"""select content_id, (n > 0)::int as v_tiene_transcripcion,
  'ninguna' as v_fuente_transcripcion, 0 as v_transcripcion_auto,
  {rounded('n / nullif(marks, 0)::double', 1)} as v_palabras_por_signo,
  (marks > 0 and n / nullif(marks, 0)::double < 60)::int as v_tiene_puntuacion,
  case when n > 0 then {rounded('ratio', 2)} end as v_cobertura_transcripcion, complete::int as v_transcripcion_completa,
  (category_id is not null)::int as v_tiene_metadatos, (coalesce(trim(description), '') <> '')::int as v_tiene_descripcion,
  apt::int as v_apto_panel from gate""", Q.TOKENS)
def i01(spark, sf):
    cols = [c for c in described(spark, sf).columns if c.startswith("v_")]
    return described(spark, sf).select("content_id", *cols)


@query("i02_i04_speech", rf"""select content_id, {Q.COLUMNS['ritmo_ppm']} as ritmo_ppm,
  case when p then {rounded('n / nullif(marks, 0)::double', 1)} end as palabras_por_frase,
  case when p then {rounded("len(regexp_extract_all(transcript, '[?]')) / nullif(n, 0)::double * 1e3", 2)} end as preguntas_1000w
  from (select *, marks > 0 and n / nullif(marks, 0)::double < 60 as p from gate)""", Q.TOKENS)
def i02(spark, sf):
    return described(spark, sf).select("content_id", "ritmo_ppm", "palabras_por_frase", "preguntas_1000w")


PACE_SQL = """
sized as (select content_id, duration_seconds as secs, greatest(1, ceil(duration_seconds / 3e1))::int as bins
  from content_v where duration_seconds > 0),
spine as (select content_id, bins, unnest(range(0, bins)) as bin from sized),
counted as (select content_id, floor(start_s / 30)::int as bin, sum(len(regexp_extract_all(text, '[a-zA-ZáéíóúüñÁÉÍÓÚÜÑ0-9'']+')))::bigint as words
  from segment_v group by all),
filled as (select s.content_id, s.bins, s.bin::int as bin, coalesce(c.words, 0)::bigint as words from spine s left join counted c using (content_id, bin))"""


@query("c12_pace_bins", "select content_id, bin, words from filled", PACE_SQL)
def c12(spark, sf):
    return I.pace_spine(V.content(spark, sf), V.segments(spark, sf))


@query("i03_pace", f"""select content_id, {rounded('stddev_pop(words) / avg(words)', 3)} as ritmo_cv,
  {rounded('avg((words < 0.4e0 * m)::int::double)', 3)} as p_tramo_silencioso
  from (select *, avg(words) over (partition by content_id) as m from filled) group by content_id having avg(words) > 0""", PACE_SQL)
def i03(spark, sf):
    return I.pace(V.content(spark, sf), V.segments(spark, sf))


@query("i05_mattr", f"select content_id, {Q.COLUMNS['mattr_200']} as mattr_200 from tok", Q.TOKENS)
def i05(spark, sf):
    return described(spark, sf).select("content_id", "mattr_200")


@query("i06_vocabulary", f"""select content_id, {rounded('len(content) / nullif(n, 0)::double', 3)} as p_palabras_contenido,
  {rounded("(select count(*) filter (c = 1) / nullif(count(*), 0)::double from (select count(*) as c from (select unnest(content) as w) group by w))", 3)} as hapax_ratio,
  {rounded("list_sum(list_transform(toks, lambda t: length(t)))::double / nullif(n, 0)", 2)} as long_media_palabra from tok""", Q.TOKENS)
def i06(spark, sf):
    return described(spark, sf).select("content_id", "p_palabras_contenido", "hapax_ratio", "long_media_palabra")


@query("i08_i09_compositions", f"""select content_id, {Q.COLUMNS['promocional_1000w']} as promocional_1000w,
  {rounded(f"({rounded(Q.rate('matizadores'), 2)} + 0.5e0) / ({rounded(Q.rate('absolutos'), 2)} + 0.5e0)", 3)} as ratio_matiz_absoluto
  from tok""", Q.TOKENS)
def i08(spark, sf):
    return described(spark, sf).select("content_id", "promocional_1000w", "ratio_matiz_absoluto")


@query("i12_chapters", f"""select content_id, {rounded('n_chapters / (minutes / 1e1)', 2)} as capitulos_10min,
  coalesce((n_chapters >= 2)::int, 0) as tiene_indice from tok""", Q.TOKENS)
def i12(spark, sf):
    return described(spark, sf).select("content_id", "capitulos_10min", "tiene_indice")


DESCRIPTION_SQL = f"""select content_id, len(urls)::bigint as enlaces_total, {Q.COLUMNS['enlaces_externos']}::bigint as enlaces_externos,
  len(list_filter(urls, lambda u: regexp_matches(u, {Q.TRACEABLE})))::bigint as enlaces_fuente,
  ({Q.COLUMNS['enlaces_externos']} > 0)::int as tiene_fuentes_externas,
  length(coalesce(description, ''))::bigint as desc_caracteres, {TS_SQL.format(c="coalesce(description, '')")}::bigint as desc_timestamps from tok"""


@query("i13_description_links", DESCRIPTION_SQL, Q.TOKENS)
def i13(spark, sf):
    names = ["enlaces_total", "enlaces_externos", "enlaces_fuente", "desc_caracteres", "desc_timestamps"]
    return longs(described(spark, sf).select("content_id", "tiene_fuentes_externas", *names), *names)


@query("i14_title_promise", f"""select content_id, len(keys)::bigint as titulo_palabras_clave, {Q.COLUMNS['cobertura_titulo']} as cobertura_titulo,
  case when hits > 0 then {rounded('(list_position(found, true) - 1) / nullif(n, 0)::double', 3)} end as foco_promesa,
  case when hits > 0 then {rounded('hits / nullif(n, 0)::double * 1e2', 2)} end as densidad_tema_100w
  from (select *, len(list_filter(found, lambda b: b)) as hits from (select *, list_transform(toks, lambda t: list_contains(keys, t)) as found from tok))""", Q.TOKENS)
def i14(spark, sf):
    return longs(described(spark, sf).select("content_id", "titulo_palabras_clave", "cobertura_titulo", "foco_promesa",
                                             "densidad_tema_100w"), "titulo_palabras_clave")


@query("i15_i16_title_flags", rf"""select *, ((titulo_p_mayusculas > 0.5e0)::int + (titulo_exclamaciones > 0)::int + (titulo_superlativos > 0)::int)::int as titulo_banderas
  from (select content_id, 0 as n_tags,
  {rounded(r"len(regexp_extract_all(title, '\p{Lu}')) / nullif(len(regexp_extract_all(title, '\p{L}')), 0)::double", 3)} as titulo_p_mayusculas,
  len(regexp_extract_all(title, '[!¡]'))::int as titulo_exclamaciones, regexp_matches(title, '[?¿]')::int as titulo_es_pregunta,
  {Q.phrase_count(L.SUPERLATIVES, 'title_dbl')}::int as titulo_superlativos,
  regexp_matches(title_n || ' ', '^\s*(?:top\s*)?[0-9]{{1,2}}[^\p{{L}}\p{{N}}_]')::int as titulo_numero_lista from tok)""", Q.TOKENS)
def i15(spark, sf):
    return described(spark, sf).select("content_id", "n_tags", "titulo_p_mayusculas", "titulo_exclamaciones",
                                       "titulo_es_pregunta", "titulo_superlativos", "titulo_numero_lista", "titulo_banderas")


def _any(words, c="title_n"):
    return "(" + " or ".join(f"contains({c}, {text(w)})" for w in words) + ")"


LABELS_SQL = rf"""select content_id,
  case when duration_seconds is null then 'desconocida' when duration_seconds <= 60 then 'short' when duration_seconds <= 600 then 'corto'
    when duration_seconds <= 1800 then 'medio' when duration_seconds <= 3600 then 'largo' else 'muy_largo' end as et_porcion,
  case when {_any(L.TALK_WORDS, 'blob')} or (coalesce(duration_seconds, 0) > 2700 and coalesce(n_chapters, 0) >= 3) then 'conversacion_larga'
    when {_any(L.RECAP_WORDS, 'blob')} then 'resumen_evento' when regexp_matches(title_n, {text(L.HOWTO_PREFIX)}) then 'instructivo'
    when listed or {_any(L.RANKING_WORDS, 'blob')} then 'lista_ranking' when {_any(L.LIVE_WORDS, 'blob')} then 'directo'
    when {_any(L.EXPLAINER_WORDS, 'blob')} then 'explicativo' when {_any(L.REVIEW_WORDS, 'blob')} then 'opinion_review'
    when cat = 'News & Politics' then 'actualidad' when cat in ('Education', 'Science & Technology') then 'divulgacion'
    else 'sin_clasificar' end as et_formato,
  case when {Q.phrase_count(L.PERISHABLE, 'title_dbl')} > 0 then 'perecedero' else 'perenne' end as et_caducidad,
  case when regexp_matches(title, '[?¿]') then 'pregunta' when listed then 'lista'
    when regexp_matches(title_n, {text(L.IMPERATIVE_PREFIX)}) then 'imperativa' else 'declarativa' end as et_promesa,
  case when len(list_filter(urls, lambda u: regexp_matches(u, {Q.TRACEABLE}))) > 0 then 'con_fuentes_verificables'
    when {Q.COLUMNS['enlaces_externos']} > 0 then 'con_enlaces_externos' when len(urls) > 0 then 'solo_enlaces_propios'
    else 'sin_enlaces' end as et_trazabilidad,
  case when n_chapters >= 2 then 'con_indice' when {TS_SQL.format(c="coalesce(description, '')")} >= 2 then 'timestamps_en_descripcion' else 'bloque_continuo' end as et_navegabilidad,
  case when n = 0 then 'sin_transcripcion' when not complete then 'transcripcion_parcial' else 'transcripcion_humana' end as et_calidad_dato,
  lang as et_idioma, cat as et_categoria_yt
  from (select *, title_n || ' ' as blob, coalesce({Q.category_name_case()}, 'sin_categoria') as cat,
    regexp_matches(title_n || ' ', '^\s*(?:top\s*)?[0-9]{{1,2}}[^\p{{L}}\p{{N}}_]') as listed from gate)"""


@query("i17_i24_labels", LABELS_SQL, Q.TOKENS)
def i17(spark, sf):
    return described(spark, sf).select("content_id", "et_porcion", "et_formato", "et_caducidad", "et_promesa",
                                       "et_trazabilidad", "et_navegabilidad", "et_calidad_dato", "et_idioma", "et_categoria_yt")


LEVELS = ["ritmo_ppm", "mattr_200", "conectores_1000w", "enlaces_externos", "cobertura_titulo"]


@query("i25_terciles", "select content_id, " + ", ".join(
    f"""case when not apt then 'sin_dato' when n_{d} < 9 or d_{d} < 3 then 'insuficiente' when {d} is null then 'sin_dato'
    when {d} <= q_{d}[1] then 'bajo' when {d} <= q_{d}[2] then 'medio' else 'alto' end as nivel_{d}""" for d in LEVELS)
    + " from feat, (select " + ", ".join(
    f"quantile_cont({d}::double, [1e0/3e0, 2e0/3e0]) as q_{d}, count({d}) as n_{d}, count(distinct {d}) as d_{d}" for d in LEVELS)
    + " from feat where apt)", Q.PANEL)
def i25(spark, sf):
    wide = described(spark, sf).select("content_id", "formato", "duracion", "v_apto_panel", *LEVELS)
    hist = S.value_histogram(wide, LEVELS)
    return S.tercile_levels(wide, hist).select("content_id", *[f"nivel_{d}" for d in LEVELS])


@query("i26_wide_table", "select content_id, formato, duracion, lang as et_idioma, n::bigint as n_words, apt::int as v_apto_panel, "
       + ", ".join(L.PANEL) + " from feat", Q.PANEL)
def i26(spark, sf):
    return longs(described(spark, sf).select("content_id", "formato", "duracion", "et_idioma", "n_words", "v_apto_panel",
                                             *L.PANEL), "n_words")


@query("b01_gate_filter", "select content_id, corpus from gate where apt", Q.TOKENS)
def b01(spark, sf):
    return described(spark, sf).where("v_apto_panel = 1").select("content_id", "corpus")
