"""Registered queries: diets (L), quizzes, raters and retention (M), the legacy score (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentgauge.functions import numbers, strata, text as T
from contentgauge.operators import diet as D, legacy_score as J, quiz as QZ, skew as SK, stats as ST
from contentgauge.operators.indicators import portion_label
from contentgauge.operators.shape import once, spread
from contentgauge.plans import sql_features as Q, views as V
from contentgauge.plans.common import described
from contentgauge.plans.descriptors import LABELS_SQL
from contentgauge.plans.registry import ORACLES, query
from contentgauge.plans.sql_features import rounded, text
from contentgauge.plans.times import stamp

# ------------------------------------------------------------------ L, E: diets

UPLOAD = "timestamp '2023-06-15 00:00:00'"
DIET_SQL = f"""
gap_v as materialized (select *, epoch_us(watched_at) - epoch_us(lag(watched_at) over (partition by user_id order by watched_at, event_id)) as gap_us from watch_v),
diet_v as materialized (select g.event_id, g.user_id, g.content_id, g.watched_at, c.channel, c.category_id, c.title, c.duration_seconds,
  floor(extract(epoch from (watched_at - ({UPLOAD} + to_days((content_id % 90)::int)))) / 86400)::bigint as dieta_edad_al_ver_dias,
  extract(hour from watched_at at time zone 'UTC' at time zone 'Europe/Paris')::int as dieta_hora_local,
  strftime(watched_at at time zone 'UTC' at time zone 'Europe/Paris', '%Y-%m-%d') as dieta_dia,
  {rounded('gap_us / 6e7', 6)} as dieta_gap_min, coalesce((gap_us / 6e7 < 30)::int, 0) as dieta_en_rafaga, duration_seconds / 6e1 as dieta_minutos
  from gap_v g left join content_v c using (content_id))"""


def dated(spark, sf):
    i = F.col("content_id")
    at = F.lit("2023-06-15 00:00:00").cast("timestamp") + F.make_dt_interval(days=(i % 90).cast("int"))
    return V.content(spark, sf).withColumn("upload_date", at)


def diet(spark, sf):
    return D.diet_rows(V.watches(spark, sf), dated(spark, sf))


def watched(spark, sf, *columns):
    """Viewings with item columns; items are joined once per (viewer, item)."""
    items = V.content(spark, sf).select("content_id", "duration_seconds", *columns)
    d = SK.salted_join(V.watches(spark, sf), items, "content_id", "event_id")
    return d.withColumn("minutos", F.col("duration_seconds") / 60.0)


@query("e01_e02_n07_gaps", "select event_id, dieta_gap_min, dieta_en_rafaga from diet_v", DIET_SQL)
def e01(spark, sf):
    return D.gaps(V.watches(spark, sf)).select("event_id", numbers.half_even(F.col("dieta_gap_min"), 6).alias("dieta_gap_min"), "dieta_en_rafaga")


@query("l01_diet_rows", "select event_id, user_id, content_id, dieta_edad_al_ver_dias, dieta_hora_local, dieta_dia, dieta_gap_min, dieta_en_rafaga, dieta_minutos from diet_v", DIET_SQL)
def l01(spark, sf):
    return diet(spark, sf)


@query("l02_minutes_per_day", f"select user_id, {rounded('sum(dieta_minutos)', 6)} as minutos, count(distinct dieta_dia)::bigint as dias, {rounded('sum(dieta_minutos) / count(distinct dieta_dia)', 6)} as minutos_por_dia from diet_v group by 1", DIET_SQL)
def l02(spark, sf):
    return D.minutes_per_day(diet(spark, sf))


@query("l03_freshness", f"select user_id, {rounded('avg(dieta_en_rafaga)', 6)} as p_rafaga, quantile_cont(dieta_edad_al_ver_dias::double, 5e-1) as frescura_mediana from diet_v group by 1", DIET_SQL)
def l03(spark, sf):
    return D.freshness(diet(spark, sf))


@query("l04_channel_concentration", f"""select user_id, {rounded('sum(v * v) / (sum(v) * sum(v))', 6)} as hhi_videos, {rounded('sum(m * m) / (sum(m) * sum(m))', 6)} as hhi_minutos,
  {rounded('max(v) / sum(v)', 6)} as top1_videos, {rounded('max(m) / sum(m)', 6)} as top1_minutos from (select user_id, channel, count(*)::double as v, sum(dieta_minutos) as m from diet_v group by all) group by 1""", DIET_SQL)
def l04(spark, sf):
    return D.channel_concentration(watched(spark, sf, "channel"))


STAND_IN_PERISHABLE = ["the", "is", "la", "final", "und"]


@query("l05_perishable_minutes", f"""select user_id, {rounded(f'sum(case when {Q.phrase_count(STAND_IN_PERISHABLE, "dbl")} > 0 then dieta_minutos else 0 end) / nullif(sum(dieta_minutos), 0)', 6)} as p_perecedero
  from (select *, {Q.doubled("strip_accents(lower(title))")} as dbl from diet_v) group by 1""", DIET_SQL)
def l05(spark, sf):
    items = V.content(spark, sf).select("content_id", "duration_seconds", (T.count_phrases(T.fold(F.col("title")), STAND_IN_PERISHABLE) > 0).alias("perishable"))
    d = SK.salted_join(V.watches(spark, sf), items, "content_id", "event_id").withColumn("minutos", F.col("duration_seconds") / 60.0)
    return D.share_of_minutes(d, F.col("perishable"), "p_perecedero")


@query("l06_category_denominators", f"select category_id, count(*)::bigint as videos, {rounded('count(*) / sum(count(*)) over ()::double', 6)} as p_videos, {rounded('sum(dieta_minutos) / sum(sum(dieta_minutos)) over ()', 6)} as p_minutos from diet_v group by 1", DIET_SQL)
def l06(spark, sf):
    return D.category_denominators(watched(spark, sf, "category_id"))


@query("n07_bursts", f"""select user_id, rafaga::bigint as rafaga, count(*)::bigint as videos, {stamp.sql('min(watched_at)')} as desde, {stamp.sql('max(watched_at)')} as hasta from (
  select *, sum(1 - dieta_en_rafaga) over (partition by user_id order by watched_at, event_id rows unbounded preceding) as rafaga from diet_v) group by 1, 2""", DIET_SQL)
def n07(spark, sf):
    return D.bursts(V.watches(spark, sf)).select("user_id", F.col("rafaga").cast("long").alias("rafaga"), "videos",
                                                 stamp("desde").alias("desde"), stamp("hasta").alias("hasta"))


@query("n08_daily_totals", f"select user_id, dieta_dia as dia, count(*)::bigint as videos, {rounded('sum(dieta_minutos)', 6)} as minutos from diet_v group by 1, 2", DIET_SQL)
def n08(spark, sf):
    return D.daily_totals(watched(spark, sf))


@query("n02_first_seen", f"select content_id, min(event_id)::bigint as event_id, {stamp.sql('min(watched_at)')} as t from watch_v group by 1", DIET_SQL)
def n02(spark, sf):
    first = V.watches(spark, sf).groupBy("content_id").agg(F.min_by(F.struct("event_id", "watched_at"), F.struct("watched_at", "event_id")).alias("r"))
    return first.select("content_id", "r.event_id", stamp("r.watched_at").alias("t"))


THROTTLE_SQL = """
seconds_v as materialized (select distinct user_id as item, epoch_us(ts) // 1000000 as sec from events)"""
COOL_DOWN = 86_400


@query("n03_throttled_attempts")
def n03(spark, sf):
    """Attempts a cool-down lets through, as the stream processor does it."""
    from contentgauge.streaming.feed import throttle_rows
    e = V.table(spark, sf, "events").select(F.col("user_id").alias("item"), F.col("ts").cast("timestamp").alias("at"))
    return throttle_rows(e, seconds=COOL_DOWN)


ORACLES["n03_throttled_attempts"] = "with recursive " + V.SQL_VIEWS + "," + THROTTLE_SQL + f""",
chain as (select item, min(sec)::bigint as sec from seconds_v group by item
  union all select c.item, min(s.sec)::bigint from chain c join seconds_v s on s.item = c.item and s.sec >= c.sec + {COOL_DOWN} group by c.item)
select item, sec as "at" from chain"""


# ------------------------------------------------------------------ M: raters


@query("m08_cohen_kappa", f"""select n::bigint as n, same::bigint as acuerdos, {rounded('same / n', 6)} as acuerdo, {rounded('(same / n - e) / (1 - e)', 6)} as kappa,
  case when (same / n - e) / (1 - e) < 0.2 then 'pobre' when (same / n - e) / (1 - e) < 0.4 then 'debil' when (same / n - e) / (1 - e) < 0.6 then 'moderado'
   when (same / n - e) / (1 - e) < 0.8 then 'sustancial' else 'casi perfecto' end as lectura
  from (select count(*)::double as n, count(*) filter (a = b)::double as same,
   (count(*) filter (a = 'si') * count(*) filter (b = 'si') + count(*) filter (a = 'no') * count(*) filter (b = 'no')) / (count(*) * count(*))::double as e from rater_v)""")
def m08(spark, sf):
    return ST.cohen_kappa(V.raters(spark, sf))


@query("d17_cross_table", "select r as a, count(*) filter (a = r and b = 'si')::bigint as si, count(*) filter (a = r and b = 'no')::bigint as no, count(*) filter (a = r and b = 'quizas')::bigint as quizas from rater_v, (select unnest(['si', 'no', 'quizas']) as r) group by r")
def d17(spark, sf):
    return ST.cross_table(V.raters(spark, sf), ["si", "no", "quizas"])


PASSES_SQL = """
passes as (select doc_id as content_id, ['informativo', 'entretenimiento'][(doc_id % 2 + 1)::int] as formato,
  [case when quality = 1 then 'informativo' else null end, case when toxic = 1 then 'entretenimiento' when doc_id % 3 = 0 then null else 'informativo' end] as p from labels),
seen as (select *, list_filter(p, lambda x: x is not null) as s from passes),
checked as (select *, len(list_distinct(s)) = 1 as ok, case when len(list_distinct(s)) = 1 then s[1] end as obs from seen)"""


def passes(spark, sf):
    i = F.col("doc_id")
    p = F.array(F.when(F.col("quality") == 1, "informativo"),
                F.when(F.col("toxic") == 1, "entretenimiento").when(i % 3 == 0, None).otherwise("informativo"))
    d = V.table(spark, sf, "labels").select(i.alias("content_id"), F.when(i % 2 == 0, "informativo").otherwise("entretenimiento").alias("formato"), p.alias("p"))
    return d.withColumn("r", QZ.consistency(F.col("p"))).select("content_id", "formato", "p", "r.*")


@query("m09_self_consistency", "select content_id, ok as autoconsistente, obs as observado, coalesce(obs <> formato, false) as desacuerdo_firme from checked", PASSES_SQL)
def m09(spark, sf):
    return passes(spark, sf).select("content_id", "autoconsistente", "observado",
                                    F.coalesce(F.col("observado") != F.col("formato"), F.lit(False)).alias("desacuerdo_firme"))


@query("m09b_intra_rater", f"""select n::bigint as n, {rounded('same / n', 6)} as acuerdo from (select count(*)::double as n, count(*) filter (s[1] = s[2]) as same from seen where len(s) >= 2)""", PASSES_SQL)
def m09b(spark, sf):
    pairs = passes(spark, sf).where(F.size(F.array_compact("p")) >= 2).select(F.get("p", F.lit(0)).alias("a"), F.get("p", F.lit(1)).alias("b"))
    return ST.cohen_kappa(pairs).select("n", "acuerdo")


# the format is what the raters say, where none did that of the category
@query("b14_unbacked", f"""select content_id, coalesce(case quality when 1 then 'informativo' when 0 then 'entretenimiento' end, {Q.category_case()}) = 'informativo'
   and et_formato in {tuple(QZ.UNBACKED_FORMS)} as sin_respaldo
  from ({LABELS_SQL}) join (select content_id, category_id from content_v) using (content_id) left join labels on doc_id = content_id""", Q.TOKENS)
def b14(spark, sf):
    rated = V.table(spark, sf, "labels").select(F.col("doc_id").alias("content_id"), "quality")
    items = described(spark, sf).select("content_id", "formato", "et_formato").join(rated, "content_id", "left")
    said = F.when(F.col("quality") == 1, "informativo").when(F.col("quality") == 0, "entretenimiento").otherwise(F.col("formato"))
    return items.select("content_id", QZ.unbacked(said, F.col("et_formato")).alias("sin_respaldo"))


# ------------------------------------------------------------------ M: item controls

# one question per document, quoting it word for word, with a word put in, or backwards
QUOTES_SQL = r"""
pieces as materialized (select doc_id, text, list_slice(w, len(w) // 3 + 1, len(w) // 3 + 4 + (doc_id % 20)::int) as p
  from (select doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as w from documents)),
quoted as materialized (select doc_id as pregunta_id, doc_id as content_id, text as transcript, array_to_string(case when doc_id % 3 = 0 then p
  when doc_id % 3 = 1 then list_concat(list_concat(list_slice(p, 1, 7), ['zzz']), list_slice(p, 8, len(p))) else list_reverse(p) end, ' ') as cita from pieces),
folded as (select pregunta_id, content_id, trim(regexp_replace(regexp_replace(strip_accents(lower(cita)), '[^a-z0-9ñ ]+', ' ', 'g'), '\s+', ' ', 'g')) as q,
  trim(regexp_replace(regexp_replace(strip_accents(lower(transcript)), '[^a-z0-9ñ ]+', ' ', 'g'), '\s+', ' ', 'g')) as t from quoted),
runs as (select *, case when q = '' then [] else string_split(q, ' ') end as w from folded),
best as materialized (select *, len(w) as n, case when contains(t, q) then len(w) else coalesce(list_max(list_transform(range(1, len(w) + 1), lambda i:
   coalesce(list_max(list_transform(range(i, len(w) + 1), lambda j: case when contains(t, array_to_string(list_slice(w, i, j), ' ')) then j - i + 1 else 0 end)), 0))), 0) end as b from runs)"""


def quoted(spark, sf):
    i = F.col("doc_id")
    d = V.table(spark, sf, "documents").select("doc_id", "text", T.blank_words(F.col("text")).alias("_w"))
    third = F.floor(F.size("_w") / 3).cast("int")
    d = once(d, _p=F.slice("_w", third + 1, (4 + i % 20).cast("int")))
    broken = F.concat(F.slice("_p", 1, 7), F.array(F.lit("zzz")), F.slice("_p", F.lit(8), F.size("_p")))
    words = F.when(i % 3 == 0, F.col("_p")).when(i % 3 == 1, broken).otherwise(F.reverse("_p"))
    return d.select(i.alias("pregunta_id"), i.alias("content_id"), F.col("text").alias("transcript"),
                    F.array_join(words, " ").alias("cita"))


@query("m02_quote_anchoring", """select pregunta_id, content_id, n >= 6 and (contains(t, q) or b >= 6 or b >= 6e-1 * n) as anclada,
  case when n = 0 then 'cita_vacia' when n < 6 then 'cita_demasiado_corta_' || n || '_palabras' when contains(t, q) then 'literal'
   when b >= 6 or b >= 6e-1 * n then 'parcial_' || b || '_de_' || n else 'no_encontrada_max_' || b || '_palabras' end as motivo_anclaje from best""", QUOTES_SQL)
def m02(spark, sf):
    return QZ.anchoring(quoted(spark, sf)).select("pregunta_id", "content_id", "anclada", "motivo_anclaje")


EMPTY = Q.values_list(QZ.EMPTY_WORDS)


@query("m03_sufficiency", f"""select pregunta_id, content_id, len(a) > 0 and hits >= least_ as ok, case when len(a) = 0 then 'respuesta_vacia' when hits >= least_ then kind || '_' || hits || '_de_' || len(a)
   else kind || '_solo_' || hits || '_de_' || len(a) || '_pedia_' || least_ end as motivo from (
  select *, len(list_filter(a, lambda x: list_contains(w, x))) as hits, case when kind = 'inferencia' then 1 else greatest(1, (len(a) + 1) // 2) end as least_ from (
   select pregunta_id, content_id, w, case when pregunta_id % 3 = 0 then 'inferencia' else 'dato' end as kind,
    list_filter(list_slice(string_split(t, ' '), 1, (pregunta_id % 5)::int), lambda x: length(x) > 1 and not list_contains({EMPTY}, x)) as a from runs))""", QUOTES_SQL)
def m03(spark, sf):
    i = F.col("pregunta_id")
    answer = F.array_join(F.slice(F.split(T.quiz_fold(F.col("transcript")), " "), F.lit(1), (i % 5).cast("int")), " ")
    kind = F.when(i % 3 == 0, "argumento").otherwise("dato")
    d = once(quoted(spark, sf), _a=answer, _q=QZ.words_of(T.quiz_fold(F.col("cita"))))
    return d.select("pregunta_id", "content_id", QZ.sufficiency(F.col("_a"), F.col("_q"), kind).alias("r")).select("pregunta_id", "content_id", "r.*")


OPTIONS_SQL = f"""
opts as (select event_id, [floor(value)::bigint || case when event_id % 3 = 0 then ' euros' else ' goles' end, (event_id % 90 + 1) || ' euros',
   (event_id % 7 + 2) || case when event_id % 11 = 0 then ' millones de euros' else ' euros' end, props] as o1,
   [event_type, repeat('x', (event_id % 12 + 1)::int), event_type || ' y algo', 'otra cosa'] as o2, (event_id % 4)::int as c from events),
picked as (select event_id, case when event_id % 2 = 0 then o1 else o2 end as o, c from opts),
form as (select *, list_transform(o, lambda x: trim(regexp_replace(regexp_replace(strip_accents(lower(x)), '[^a-z0-9ñ ]+', ' ', 'g'), '\\s+', ' ', 'g'))) as f from picked),
parts as (select *, list_transform(f, lambda x: coalesce(list_filter(string_split(x, ' '), lambda w: w <> '' and not regexp_full_match(w, '[0-9]+') and not list_contains({EMPTY}, w))[-1], '')) as units,
  list_filter(list_transform(f, lambda x: replace(nullif(regexp_extract(x, '([0-9]+(?:[.,][0-9]+)?)', 1), ''), ',', '.')::double * case when contains(x, 'millon') then 1e6 when contains(x, 'mil ') or x like '% mil' then 1e3 else 1 end), lambda v: v > 0) as vals,
  len(list_filter(o, lambda x: regexp_matches(x, '[0-9]'))) as numeric, list_sort(list_transform(list_filter(range(0, 4), lambda i: i <> c), lambda i: length(o[i + 1])))[2] as mid from form),
judged as (select *, list_sort(list_distinct(list_filter(units, lambda u: u <> ''))) as us, list_max(vals) / nullif(list_min(vals), 0) as spread, length(o[c + 1]) / nullif(mid, 0)::double as share,
  len(list_filter(o, lambda x: len(regexp_split_to_array(trim(x), '\\s+')) > 4)) = 0 as short from parts)"""


@query("m04_option_balance", """select event_id, case when numeric >= 3 and short and len(us) > 1 then 'unidades_mezcladas' when len(vals) = 4 and spread > 50 then 'magnitudes_dispares'
  when share > 16e-1 then 'correcta_mas_larga' when share < 5e-1 then 'correcta_mas_corta' else 'equilibradas' end as motivo from judged""", OPTIONS_SQL)
def m04(spark, sf):
    e, s = F.col("event_id"), lambda c: c.cast("string")
    one = F.array(
        F.concat(s(F.floor("value").cast("long")), F.when(e % 3 == 0, " euros").otherwise(" goles")),
        F.concat(s(e % 90 + 1), F.lit(" euros")),
        F.concat(s(e % 7 + 2), F.when(e % 11 == 0, " millones de euros").otherwise(" euros")), F.col("props"))
    two = F.array(F.col("event_type"), F.repeat(F.lit("x"), (e % 12 + 1).cast("int")), F.concat("event_type", F.lit(" y algo")), F.lit("otra cosa"))
    d = V.table(spark, sf, "events").select("event_id", F.when(e % 2 == 0, one).otherwise(two).alias("o"), (e % 4).cast("int").alias("c"))
    r = QZ.balance(F.col("o"), F.col("c"))["motivo"]
    return d.select("event_id", F.regexp_replace(r, r"_(?:x[0-9.]+|\[.*)$", "").alias("motivo"))





def folded_sql(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(strip_accents(lower({c})), '[^a-z0-9ñ ]+', ' ', 'g'), '\s+', ' ', 'g'))"


# every line of a text is a quote; stand-ins for the real phrases, as in the lists of the indicators
STAND_IN_ADVERTS = ["of the", "et de", "und die", "de la", "by this"]


@query("m05_advert_quotes", f"""select doc_id, len(q)::bigint as citas, len(list_filter(q, lambda l: {' or '.join(f"contains({folded_sql('l')}, {text(p)})" for p in STAND_IN_ADVERTS)}))::bigint as anuncios
  from (select doc_id, string_split(text, chr(10)) as q from documents)""")
def m05(spark, sf):
    d = spread(V.table(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("q")))
    adverts = F.filter("q", lambda quote: QZ.is_advert(quote, STAND_IN_ADVERTS))
    return d.select("doc_id", F.size("q").cast("long").alias("citas"), F.size(adverts).cast("long").alias("anuncios"))


# lines two to five of a text are the options, the sixth is the question, its length says which is right
@query("m01_form_check", f"""select doc_id, case when len(o) <> 4 or coalesce(trim(l[6]), '') = '' then 'formato_invalido'
  when len(list_distinct(list_transform(o, lambda x: {folded_sql('x')}))) <> 4 then 'opciones_duplicadas'
  when n_chars % 7 - 1 not between -4 and 3 then 'indice_correcto_invalido' end as falta
  from (select doc_id, n_chars, l, list_slice(l, 2, 5) as o from (select doc_id, n_chars, string_split(text, chr(10)) as l from documents))""")
def m01(spark, sf):
    d = spread(V.table(spark, sf, "documents").select("doc_id", "n_chars", F.split("text", "\n").alias("l")))
    fault = QZ.form_fault(F.get("l", F.lit(5)), F.slice("l", 2, 4), F.col("n_chars") % 7 - 1)
    return d.select("doc_id", fault.alias("falta"))


def generated(spark, sf):
    """Quiz questions on the documents, their options taken from the quote."""
    i = F.col("pregunta_id")
    d = quoted(spark, sf).withColumn("_w", F.array_distinct(F.filter(F.split(T.quiz_fold(F.col("cita")), " "), lambda w: F.length(w) > 1)))
    option = lambda n, word: F.coalesce(F.get("_w", F.lit(n)), F.lit(word))
    return d.select(
        "pregunta_id", "content_id", "transcript", "cita",
        F.lit("¿Qué se dijo?").alias("pregunta"), F.when(i % 3 == 0, "argumento").when(i % 3 == 1, "dato").otherwise("definicion").alias("tipo"),
        F.when(i % 9 == 8, F.array(F.lit("a"))).otherwise(F.array(option(0, "zeta"), option(1, "yota"), option(2, "xilo"), F.lit("vacio"))).alias("opciones"),
        (i % 4).cast("int").alias("correcta"), F.when(F.col("content_id") % 10 != 0, (F.col("content_id") % 4).cast("int")).alias("control_eleccion"))


FUNNEL_SQL = QUOTES_SQL + f""",
words_v as (select best.*, list_filter(w, lambda x: length(x) > 1) as lw from best),
opt_v as (select *, list_filter(lw, lambda x, i: list_position(lw, x) = i) as u from words_v),
answers_v as (select *, [coalesce(u[1], 'zeta'), coalesce(u[2], 'yota'), coalesce(u[3], 'xilo'), 'vacio'] as o, (pregunta_id % 4 + 1)::int as c from opt_v),
form_v as (select *, o[c] as ans, list_sort(list_transform(list_filter(range(1, 5), lambda i: i <> c), lambda i: length(o[i])))[2] as mid,
  n >= 6 and (contains(t, q) or b >= 6 or b >= 6e-1 * n) as anchored from answers_v),
staged as materialized (select pregunta_id as qid, content_id, case when pregunta_id % 3 = 0 then 'argumento' when pregunta_id % 3 = 1 then 'dato' else 'definicion' end as tipo,
  o, c, pregunta_id % 9 = 8 as bad_form, len(list_distinct(o)) < 4 as dup, anchored, not list_contains({EMPTY}, ans) and list_contains(w, ans) as enough, length(ans) / mid::double as share from form_v),
cascade as materialized (select *, case when bad_form then 'formato_invalido' when dup then 'opciones_duplicadas' when not anchored then 'cita_no_verificable' when not enough then 'cita_no_justifica'
  when share > 16e-1 or share < 5e-1 then 'opciones_desbalanceadas' when content_id % 10 = 0 then 'control_fallo' end as descarte,
  list_position(list_transform(list_sort(list_transform(range(0, 4), lambda i: md5(qid || ':20260820:' || i || ':' || o[i + 1]) || '|' || i)), lambda h: split_part(h, '|', 2)::int), c - 1) - 1 as place from staged)"""


@query("m06_f11_control_cascade", """select qid as pregunta_id, descarte, descarte is null as sobrevive, case when not bad_form and not dup then place::int end as correcta,
  case when descarte is null then place = content_id % 4 end as linea_base_acerto from cascade""", FUNNEL_SQL)
def m06(spark, sf):
    return QZ.control(generated(spark, sf)).select("pregunta_id", "descarte", "sobrevive", "correcta", "linea_base_acerto")


@query("d16_quiz_funnel", f"""select count(distinct content_id)::bigint as videos, count(*)::bigint as generadas, count(*) filter (not bad_form and not dup and anchored)::bigint as ancladas,
  count(*) filter (not bad_form and not dup and anchored and enough)::bigint as justificadas, count(*) filter (descarte is null)::bigint as utilizables,
  count(*) filter (descarte is null and place = content_id % 4)::bigint as base_acerto, count(*) filter (descarte is null and place <> content_id % 4)::bigint as dificiles,
  {rounded('count(*) filter (descarte is null) / count(distinct content_id)::double', 6)} as por_video from cascade""", FUNNEL_SQL)
def d16(spark, sf):
    return QZ.funnel(QZ.control(generated(spark, sf)))


@query("d16b_discards", "select descarte as motivo, count(*)::bigint as n from cascade where descarte is not null group by 1", FUNNEL_SQL)
def d16b(spark, sf):
    return QZ.discards(QZ.control(generated(spark, sf)))


@query("d16c_by_type", "select tipo, count(*)::bigint as generadas, count(*) filter (descarte is null)::bigint as sobreviven from cascade group by 1", FUNNEL_SQL)
def d16c(spark, sf):
    return QZ.by_type(QZ.control(generated(spark, sf)))


@query("m07_recontrol", """select pregunta_id, case when item % 5 = 0 and base is not null then false when base is not null then true else base end as sobrevive,
  case when base is null or item % 5 = 0 then base else item % 3 = correcta end as linea_base_acerto, base as trivial_previo from (
  select pregunta_id, pregunta_id as item, correcta, case when utilizable then linea_base_acerto end as base from question_v)""")
def m07(spark, sf):
    q = V.questions(spark, sf)
    i = F.col("pregunta_id")
    q = q.withColumns({"linea_base_acerto": F.when(F.col("utilizable"), F.col("linea_base_acerto")), "control_eleccion": F.lit(0),
                       "sobrevive": F.when(F.col("utilizable"), True), "descarte": F.lit(None).cast("string")})
    answers = q.where(i % 5 != 0).select("pregunta_id", (i % 3).cast("int").alias("nueva_eleccion"))
    return QZ.recontrol(q, answers).select("pregunta_id", "sobrevive", "linea_base_acerto", "trivial_previo")


# ------------------------------------------------------------------ M: answers and retention


ANSWERED_SQL = """
scored as materialized (select a.*, q.content_id, q.correcta, a.eleccion = q.correcta as acierto, q.utilizable, q.dificil, q.linea_base_acerto from answer_v a join question_v q using (pregunta_id)),
base as materialized (select persona_id, content_id as content_item_id, count(*)::bigint as n_items, count(*) filter (acierto)::bigint as aciertos, count(*) filter (dificil)::bigint as n_dificiles,
  count(*) filter (dificil and acierto)::bigint as aciertos_dificiles, avg(linea_base_acerto::int::double) as b, max(respondido_at) as t, avg(dias) as dias from scored where utilizable group by 1, 2)"""
RETENTION_SQL = f"""n_items, aciertos, n_dificiles, aciertos_dificiles, {stamp.sql('t')} as respondido_us, {rounded('aciertos / n_items::double', 4)} as retencion_bruta,
  {rounded('aciertos_dificiles / nullif(n_dificiles, 0)::double', 4)} as retencion_dificil, {rounded('b', 4)} as tasa_linea_base,
  case when b < 1 then {rounded('(aciertos / n_items::double - b) / (1 - b)', 4)} end as retencion_corregida, {rounded('dias', 6)} as dias_transcurridos"""


def scored(spark, sf):
    return QZ.score_answers(V.answers(spark, sf), V.questions(spark, sf))


@query("m10_answer_scoring", f"""select persona_id, pregunta_id, {stamp.sql('respondido_at')} as t, eleccion, acierto, {rounded('(epoch_us(respondido_at) - epoch_us(w)) / 864e8', 2)} as dias_transcurridos
  from scored left join (select content_id, min(watched_at) as w from watch_v group by 1) using (content_id)
  where not (persona_id % 7 = 0 and content_id % 3 = 0)""", ANSWERED_SQL)
def m10(spark, sf):
    seen = V.watches(spark, sf).groupBy("content_id").agg(F.min("watched_at").alias("watched_at"))
    about = V.answers(spark, sf).join(V.questions(spark, sf), "pregunta_id")
    skipped = about.where("persona_id % 7 = 0 and content_id % 3 = 0").select("persona_id", "content_id").distinct()
    d = QZ.score_answers(V.answers(spark, sf), V.questions(spark, sf), seen, skipped)
    return d.select("persona_id", "pregunta_id", stamp("respondido_at").alias("t"), "eleccion", "acierto", "dias_transcurridos")


@query("m11_d04_retention", f"select persona_id, content_item_id, {RETENTION_SQL} from base", ANSWERED_SQL)
def m11(spark, sf):
    r = QZ.retention(scored(spark, sf), V.questions(spark, sf))
    return r.withColumn("respondido_us", stamp("respondido_at")).drop("respondido_at")


@query("c05_retention_dataset", f"""select persona_id, content_item_id, {RETENTION_SQL}, c.duration_seconds, {Q.category_case('c.category_id')} as formato, {rounded('ln(greatest(c.duration_seconds, 1)::double)', 6)} as log_duracion
  from base join content_v c on c.content_id = content_item_id where c.category_id is not null""", ANSWERED_SQL)
def c05(spark, sf):
    items = V.content(spark, sf)
    features = items.where("category_id is not null").select(F.col("content_id").alias("content_item_id"), strata.category_format(F.col("category_id")).alias("formato"))
    r = QZ.retention_dataset(scored(spark, sf), V.questions(spark, sf), items, features)
    return r.withColumn("respondido_us", stamp("respondido_at")).drop("respondido_at")


@query("d05_scalar_counts", """select (select count(distinct content_id) from question_v where utilizable)::bigint as total_utilizables,
  (select count(distinct content_id) from scored where persona_id = 3)::bigint as ya_contestados""", ANSWERED_SQL)
def d05(spark, sf):
    q = V.questions(spark, sf)
    usable = q.where("utilizable").agg(F.count_distinct("content_id").alias("total_utilizables"))
    mine = V.answers(spark, sf).where("persona_id = 3").select("pregunta_id").distinct().join(q, "pregunta_id")
    done = mine.agg(F.count_distinct("content_id").alias("ya_contestados"))
    return usable.join(F.broadcast(done))


@query("c04_unanswered", "select pregunta_id, content_id from question_v where content_id not in (select q.content_id from answer_v a join question_v q using (pregunta_id) where a.persona_id = 3)")
def c04(spark, sf):
    return QZ.unanswered(V.questions(spark, sf), V.answers(spark, sf), "3").select("pregunta_id", "content_id")


@query("e06_first_videos", """select content_id, count(*)::bigint as preguntas from question_v where content_id in (
  select content_id from question_v group by content_id order by min(-pregunta_id), content_id limit 4) group by 1""")
def e06(spark, sf):
    v = QZ.first_videos(V.questions(spark, sf), [-F.col("pregunta_id")], 4)
    return v.select("content_id", F.size("preguntas").cast("long").alias("preguntas"))


@query("m12_resume", "select content_id from content_v where content_id not in (select doc_id from labels where quality = 1)")
def m12(spark, sf):
    done = V.table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("content_id"))
    return V.content(spark, sf).select("content_id").join(done, "content_id", "left_anti")


# ------------------------------------------------------------------ text samples

WORDS_SQL = r"w as materialized (select doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as p from documents)"


@query("f10_text_windows", """select doc_id, md5(case when len(p) <= 300 then text else array_to_string(list_slice(p, 1, 100), ' ') || E'\\n[...]\\n' || array_to_string(list_slice(p, floor(5e-1 * (len(p) - 100))::int + 1, floor(5e-1 * (len(p) - 100))::int + 100), ' ')
   || E'\\n[...]\\n' || array_to_string(list_slice(p, len(p) - 99, len(p)), ' ') end) as muestra,
  md5(case when len(p) <= 150 then text else array_to_string(list_slice(p, 1, 50), ' ') || E'\\n[...]\\n' || array_to_string(list_slice(p, len(p) // 2 - 24, len(p) // 2 + 25), ' ')
   || E'\\n[...]\\n' || array_to_string(list_slice(p, len(p) - 49, len(p)), ' ') end) as tercios from w""", WORDS_SQL)
def f10(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", "text", T.blank_words(F.col("text")).alias("w"))
    return d.select("doc_id", F.md5(QZ.sampled_text(F.col("text"), F.col("w"), 300, QZ.FIRST_WINDOWS)).alias("muestra"),
                    F.md5(QZ.thirds(F.col("text"), F.col("w"), 150)).alias("tercios"))


@query("h20_joined_parts", r"""select content_id, md5(trim(regexp_replace(string_agg(text, ' ' order by start_s, text), '\s+', ' ', 'g'))) as digest from segment_v group by 1""")
def h20(spark, sf):
    from contentgauge.sources.captions import content_text
    parts = F.transform(F.array_sort(F.collect_list(F.struct("start_s", "text"))), lambda s: F.struct(s["text"].alias("text")))
    d = V.segments(spark, sf).groupBy("content_id").agg(parts.alias("parts"))
    return d.select("content_id", F.md5(content_text(F.lit(None).cast("string"), F.col("parts"))).alias("digest"))


@query("h19_salvaged_questions", """select content_id::bigint as content_id, case when content_id % 3 = 0 then turns - 1 else turns end::bigint as preguntas from (
  select conv_id as content_id, count(*) as turns from conversations group by 1) where not (content_id % 3 = 0 and turns = 1)""")
def h19(spark, sf):
    """Generated JSON, every third text cut inside its last question."""
    from contentgauge.sources.quiz_files import parse_questions
    q = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: F.struct(
        s["text"].alias("pregunta"), F.array(F.lit("a"), F.lit("b")).alias("opciones"), F.lit(0).alias("correcta"),
        F.lit("c").alias("cita"), F.lit("dato").alias("tipo")))
    d = V.table(spark, sf, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(q.alias("preguntas"))).alias("j"))
    cut = F.when(F.col("conv_id") % 3 == 0, F.left("j", F.length("j") - 9)).otherwise(F.col("j"))
    raw = d.select(F.col("conv_id").alias("content_id"), cut.alias("crudo"))
    return parse_questions(raw, "crudo", ["content_id"]).groupBy("content_id").agg(F.count(F.lit(1)).alias("preguntas"))


# ------------------------------------------------------------------ J: the legacy score

J_SQL = rf"""
jraw as (select *, coalesce(transcript, '') as x, lower(coalesce(transcript, '')) as lx, (content_id * 37 % 5000)::bigint as views, (content_id * 13 % 400)::bigint as likes, (content_id * 7 % 30)::bigint as comments from content_v),
jtok as materialized (select *, len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> '')) >= 50 as has, regexp_extract_all(lx, '[\p{{L}}\p{{N}}_]+') as w,
  len(regexp_extract_all(regexp_replace(x, '\p{{L}}', 'a', 'g'), '\b\d+[.,]?\d*\s*%?\b')) as figures from jraw),
jsig as materialized (select content_id, duration_seconds, category_id, has,
  coalesce({rounded(f"greatest(0e0, 1 - (len(regexp_extract_all(title, '\\p{{Lu}}')) / nullif(length(title), 0)::double * 0.3e0 + least(len(regexp_extract_all(title, '!')), 3) * 0.1e0 + least(" + " + ".join(f"contains(lower(title), {text(w)})::int" for w in J.EMOTIONAL_WORDS) + ", 4) * 0.1e0))", 3)}, 0.5e0) as s_title,
  case when coalesce(duration_seconds, 0) = 0 then 0.5e0 when duration_seconds < 60 then 0.1e0 when duration_seconds < 180 then 0.3e0 when duration_seconds < 600 then 0.55e0 when duration_seconds < 1800 then 0.8e0 else 0.95e0 end as s_duration,
  case when has and len(w) >= 200 then {rounded('greatest(0e0, least(1e0, (len(list_distinct(w)) / len(w)::double - 0.2e0) / 0.5e0))', 3)} else 0.5e0 end as s_lexical_richness,
  case when not has then 0.5e0 when len(w) = 0 then 0e0 else {rounded('least(1e0, figures / (len(w) / 1e2) / 5e0)', 3)} end as s_data_density,
  case when has then {rounded("least(1e0, (" + " + ".join(f"contains(lx, {text(v)})::int" for v in J.SOURCE_WORDS) + ") / 5e0)", 3)} else 0.5e0 end as s_source_presence,
  case when has and len(w) >= 20 then {rounded("len(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1]))) / (len(w) - 1)::double", 3)} else 0.5e0 end as s_repetition,
  coalesce(case category_id {' '.join(f"when '{k}' then {v}e0" for k, v in J.CATEGORY_SCORES.items())} end, 0.5e0) as s_category,
  case when views < 100 then 0.5e0 else {rounded('''(case when likes / views::double >= 0.05e0 then 1e0 when likes / views::double >= 0.03e0 then 0.8e0 when likes / views::double >= 0.01e0 then 0.6e0 when likes / views::double >= 0.005e0 then 0.45e0 else 0.3e0 end) * 0.6e0
    + (case when comments / views::double >= 0.005e0 then 1e0 when comments / views::double >= 0.002e0 then 0.7e0 when comments / views::double >= 0.001e0 then 0.5e0 else 0.3e0 end) * 0.4e0''', 3)} end as s_engagement,
  case when length(trim(coalesce(x, ''))) < 20 then 0.2e0 else {rounded("least(1e0, (case when n >= 200 then 1e0 when n >= 100 then 0.75e0 when n >= 50 then 0.55e0 else 0.35e0 end) + ((regexp_matches(x, 'https?://'))::int * 0.15e0 + least((" + " + ".join(f"contains(lx, {text(v)})::int" for v in J.SOURCE_WORDS) + ") / 3e0, 1e0) * 0.1e0))", 3)} end as s_description
  from (select *, len(list_filter(regexp_split_to_array(x, '\s+'), lambda v: v <> '')) as n from jtok))"""
SIGNALS = ["s_title", "s_duration", "s_lexical_richness", "s_data_density", "s_source_presence", "s_repetition", "s_category", "s_engagement", "s_description"]


def legacy_scores(spark, sf):
    i = F.col("content_id")
    d = V.content(spark, sf).withColumns({
        "view_count": i * 37 % 5000, "like_count": i * 13 % 400, "comment_count": i * 7 % 30, "description": F.col("transcript")})
    return J.score(d)


@query("j01_j10_e08_signals", "select content_id, " + ", ".join(SIGNALS) + " from jsig", J_SQL)
def j01(spark, sf):
    return legacy_scores(spark, sf).select("content_id", *SIGNALS)


# reading ease: words per sentence mark and vowel groups per word
LETTER_SQL = J_SQL + rf""",
jease as (select content_id, has, 206.835e0 - 1.015e0 * (n::double / s) - 84.6e0 * (g::double / n) as ease from (
  select content_id, has, greatest(len(w), 1) as n, greatest(len(regexp_extract_all(x, '[.!?]+')), 1) as s,
   len(regexp_extract_all(lx, '[aeiouyáéíóúüàèìòùâêîôûäö]+')) as g from jtok)),
jread as (select *, case when not has then 0.5e0 when ease >= 30 and ease <= 60 then 1e0 when ease < 10 then 0.5e0 when ease < 30 then 0.75e0 when ease < 80 then 0.65e0 else 0.3e0 end as s_readability from jease),
jnum as (select content_id, s_readability, {rounded('(0e0 + ' + ' + '.join(f's_{k} * {v}e0' for k, v in J.WEIGHTS.items()) + ') * 1e2', 1)} as score_numeric
  from jsig join jread using (content_id))"""


@query("j06_j11_letter", """select *, case when score_numeric >= 80 then 'A' when score_numeric >= 60 then 'B' when score_numeric >= 40 then 'C'
  when score_numeric >= 20 then 'D' else 'E' end as score_letter from jnum""", LETTER_SQL)
def j11(spark, sf):
    """The weighted number and letter; reading ease is our own count."""
    return legacy_scores(spark, sf).select("content_id", "s_readability", "score_numeric", "score_letter")


def _label_sql() -> str:
    t = {k: text(v) for k, v in vars(J).items() if k.startswith("LABEL_")}
    return f"""list_slice(list_filter([
  case when coalesce(duration_seconds, 0) > 0 and duration_seconds < 180 then {t['LABEL_SHORT']} when duration_seconds >= 600 then case when has and dens >= 0.45e0 then {t['LABEL_ATTENTION']} when has and dens <= 0.35e0 then {t['LABEL_BACKGROUND']} else {t['LABEL_LONG']} end end,
  case when category_id in ('27', '28') then {t['LABEL_EDUCATION']} when category_id = '25' then {t['LABEL_NEWS']} end, case when s_title < 0.5e0 then {t['LABEL_EMOTIONAL']} end,
  case when not has then {t['LABEL_NO_TEXT']} when s_source_presence >= 0.6e0 then {t['LABEL_SOURCES']} when s_data_density >= 0.6e0 then {t['LABEL_DATA']} when dens < 0.25e0 then {t['LABEL_THIN']} when s_source_presence < 0.2e0 and s_data_density < 0.2e0 then {t['LABEL_OPINION']} end,
  case when has and s_lexical_richness >= 0.7e0 then {t['LABEL_CONCEPTS']} when has and s_lexical_richness <= 0.25e0 then {t['LABEL_REPETITIVE']} end,
  case when s_engagement >= 0.75e0 then {t['LABEL_ENGAGEMENT']} end], lambda l: l is not null), 1, 3)"""


@query("j12_labels", f"select content_id, array_to_string({_label_sql()}, ' / ') as etiquetas from (select *, (s_lexical_richness + s_data_density + s_source_presence) / 3e0 as dens from jsig)", J_SQL)
def j12(spark, sf):
    return legacy_scores(spark, sf).select("content_id", F.array_join("score_labels", " / ").alias("etiquetas"))


@query("i17_portions", "select o_orderkey, case when d <= 60 then 'short' when d <= 600 then 'corto' when d <= 1800 then 'medio' when d <= 3600 then 'largo' else 'muy_largo' end as et_porcion from (select o_orderkey, (floor(o_totalprice)::bigint % 9000)::int as d from orders)")
def i17b(spark, sf):
    return V.table(spark, sf, "orders").select("o_orderkey", portion_label((F.floor("o_totalprice") % 9000).cast("int")).alias("et_porcion"))
