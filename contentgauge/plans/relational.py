"""Registered queries: merges and sinks (A), filters (B), joins (C), aggregates (D),
windows (E), ordering and draws (F), set operations (G), queue timing (N5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentgauge.functions import lexicons as L, numbers, strata, text as T
from contentgauge.operators import merge as M, queue as QU, sampling as SA, skew as SK, stats as ST

from contentgauge.plans import sql_features as Q, views as V
from contentgauge.plans.registry import query
from contentgauge.plans.sql_features import rounded, text
from contentgauge.plans.times import stamp

NOW = "2024-06-01 00:00:00"
STATES = [None, "ok", "error", "no_subs", "partial", "failed", "exhausted"]

ITEMS_SQL = f"""
items_v as materialized (select o_orderkey as id, o_orderkey::varchar as external_id, 'c' || o_custkey as channel_id,
  list_extract([null, 'ok', 'error', 'no_subs', 'partial', 'failed', 'exhausted'], (o_orderkey % 7 + 1)::int) as enrichment_status,
  case when o_orderkey % 4 = 0 then null when o_orderkey % 4 = 1 then '' else 'three plain words' end as transcript,
  case when o_orderkey % 4 >= 2 then 3 end as transcript_word_count,
  case when o_orderkey % 5 = 0 then null else (o_orderkey % 6)::int end as attempts,
  case when o_orderkey % 3 = 0 then null else o_orderdate + to_days((o_orderkey % 40)::int) end as next_attempt_at,
  o_orderdate as created_at, case when o_orderkey % 9 = 0 then null else 'd' end as description,
  (floor(o_totalprice)::bigint % 12000)::int as duration_seconds,
  list_extract(['25', '26', '24', '20', '29', '27', null], (o_custkey % 7 + 1)::int) as category_id,
  case when o_orderkey % 4 = 3 then 'historial' else 'referencia' end as corpus,
  case when o_orderkey % 2 = 0 then 'chart_canal' else 'busqueda_semilla' end as sampling_source from orders),
strata_v as materialized (select *, {Q.category_case()} as stratum_format, {Q.duration_case()} as stratum_duration from items_v)"""


def items(spark, sf):
    o = V.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    made = F.col("o_orderdate").cast("timestamp")
    pick = lambda values, i: F.get(F.array(*[F.lit(v).cast("string") for v in values]), i)
    return o.select(
        k.alias("id"), k.cast("string").alias("external_id"), F.concat(F.lit("c"), "o_custkey").alias("channel_id"),
        pick(STATES, (k % 7).cast("int")).alias("enrichment_status"),
        F.when(k % 4 == 0, None).when(k % 4 == 1, "").otherwise("three plain words").alias("transcript"),
        F.when(k % 4 >= 2, 3).alias("transcript_word_count"),
        F.when(k % 5 == 0, None).otherwise((k % 6).cast("int")).alias("attempts"),
        F.when(k % 3 == 0, None).otherwise(made + F.make_dt_interval(days=(k % 40).cast("int"))).alias("next_attempt_at"),
        made.alias("created_at"), F.when(k % 9 == 0, None).otherwise("d").alias("description"),
        (F.floor("o_totalprice") % 12000).cast("int").alias("duration_seconds"),
        pick(["25", "26", "24", "20", "29", "27", None], (F.col("o_custkey") % 7).cast("int")).alias("category_id"),
        F.when(k % 4 == 3, "historial").otherwise("referencia").alias("corpus"),
        F.when(k % 2 == 0, "chart_canal").otherwise("busqueda_semilla").alias("sampling_source"),
    )


def stratified(spark, sf):
    return SA.assign_strata(items(spark, sf))


def now():
    return F.lit(NOW).cast("timestamp")


# ------------------------------------------------------------------ A: ingest and merges


@query("a01_load_corpus", "select content_id, channel, transcript_lang, duration_seconds, category_id, n_chapters from content_v where corpus = 'referencia'")
def a01(spark, sf):
    return V.content(spark, sf).where("corpus = 'referencia'").select(
        "content_id", "channel", "transcript_lang", "duration_seconds", "category_id", "n_chapters")


@query("a09_assemble_transcripts", r"""select content_id, length(t)::bigint as chars, md5(t) as digest, case when t is not null then 'youtube_manual' end as transcript_source from (
  select content_id, nullif(trim(regexp_replace(regexp_replace(string_agg(text, ' ' order by start_s, text),
   '\[[^\]]{0,40}\]|\([^)]{0,40}\)|♪[^♪]*♪', ' ', 'g'), '\s+', ' ', 'g')), '') as t from segment_v group by content_id)""")
def a09(spark, sf):
    from contentgauge.sources.captions import assemble
    t = assemble(V.segments(spark, sf), "content_id")
    return t.select("content_id", F.length("transcript").cast("long").alias("chars"), F.md5("transcript").alias("digest"), "transcript_source")


TRACK_LANGS = ["es-419", "fr", "en-US", "pt-BR", "es", "de-AT", "fr-CA"]


@query("a10_pick_track", """select item, arg_min(lang, o) as lang, arg_min(is_generated, o) as is_generated, arg_min(pos, o) as pos from (
  select *, row(is_generated, case when r is not null then 0 when split_part(lang, '-', 1) in ('es', 'en') or split_part(lang, '-', 1) = own then 1 else 2 end, coalesce(r, 0), pos) as o
  from (select *, coalesce(nullif(list_position(['es', 'es-419', 'es-ES', 'en', 'en-US', 'en-GB'], lang), 0), case when lang = own then 7 end) as r
   from (select event_id // 4 as item, list_extract(['es-419', 'fr', 'en-US', 'pt-BR', 'es', 'de-AT', 'fr-CA'], (event_id * 7 % 11 % 7 + 1)::int) as lang,
    event_id % 3 <> 0 as is_generated, event_id as pos, case when event_id // 4 % 2 = 0 then 'fr' end as own from events))) group by item""")
def a10(spark, sf):
    e = F.col("event_id")
    item = F.floor(e / 4).cast("long")
    langs = F.array(*[F.lit(x) for x in TRACK_LANGS])
    tracks = V.table(spark, sf, "events").select(
        item.alias("item"), F.get(langs, (e * 7 % 11 % 7).cast("int")).alias("lang"), (e % 3 != 0).alias("is_generated"),
        e.alias("pos"), F.when(item % 2 == 0, "fr-FR").alias("own_language"))
    return QU.pick_track(tracks)


LEGACY_SQL = """
videos as materialized (select 'c' || o_custkey as youtube_id, o_orderpriority as title, o_orderstatus as channel, (floor(o_totalprice)::bigint % 9000)::int as duration,
  case when o_orderkey % 3 = 0 then '' when o_orderkey % 3 = 1 then null else '["a","b"]' end as tags,
  case when o_orderkey % 4 = 0 then null else 'B' end as score_letter, o_totalprice as score_numeric,
  case when o_orderkey % 5 = 0 then null else o_orderdate + to_hours(1) end as watched_at, o_orderdate + to_microseconds(o_orderkey) as created_at from orders)"""


def legacy(spark, sf):
    k = F.col("o_orderkey")
    made = F.col("o_orderdate").cast("timestamp")
    return V.table(spark, sf, "orders").select(
        F.concat(F.lit("c"), "o_custkey").alias("youtube_id"), F.lit(None).cast("string").alias("url"),
        F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("channel"),
        (F.floor("o_totalprice") % 9000).cast("int").alias("duration"),
        F.when(k % 3 == 0, "").when(k % 3 == 1, None).otherwise('["a","b"]').alias("tags"),
        F.when(k % 4 == 0, None).otherwise("B").alias("score_letter"), F.col("o_totalprice").alias("score_numeric"),
        F.when(k % 5 == 0, None).otherwise(made + F.make_dt_interval(hours=F.lit(1))).alias("watched_at"),
        F.timestamp_micros(F.unix_micros(made) + k).alias("created_at"))


@query("a13_legacy_items", """select youtube_id as external_id, 'youtube' as source, arg_min(title, created_at) as title, arg_min(duration, created_at) as duration_seconds,
  (case when arg_min(coalesce(tags, ''), created_at) = '' then -1 else 2 end)::int as n_tags from videos group by youtube_id""", LEGACY_SQL)
def a13(spark, sf):
    made, _, _ = M.split_legacy(legacy(spark, sf))
    return made.select("external_id", "source", "title", "duration_seconds", F.coalesce(F.size("tags"), F.lit(-1)).alias("n_tags"))


@query("a13b_legacy_scores", "select youtube_id as external_id, '1.0' as scorer_version, score_letter, score_numeric from videos where score_letter is not null", LEGACY_SQL)
def a13b(spark, sf):
    return M.split_legacy(legacy(spark, sf))[1].select("external_id", "scorer_version", "score_letter", "score_numeric")


@query("a13c_legacy_events", f"""select {stamp.sql('coalesce(watched_at, created_at)')} as received_us, 'chrome_extension' as source,
  json_object('video_id', youtube_id, 'title', title, 'channel', channel, 'duration_seconds', duration)::varchar as payload from videos""", LEGACY_SQL)
def a13c(spark, sf):
    return M.split_legacy(legacy(spark, sf))[2].select(stamp("received_at").alias("received_us"), "source", "payload")


MERGE_SQL = """
old_v as (select o_orderkey as k, o_custkey as a, o_totalprice as b, o_orderstatus as c from orders where o_orderkey % 3 <> 0),
new_all as (select o_orderkey as k, case when o_orderkey % 10 = 0 then null else o_custkey + 1 end as a, o_totalprice * 2 as b, 'N' as c, l_linenumber as v
  from orders join lineitem on l_orderkey = o_orderkey where o_orderkey % 2 = 0),
new_v as (select k, a + v as a, b + v as b, c, v from new_all qualify row_number() over (partition by k order by v desc) = 1)"""


def merge_sides(spark, sf):
    o = V.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    old = o.where(k % 3 != 0).select(k.alias("k"), F.col("o_custkey").alias("a"), F.col("o_totalprice").alias("b"),
                                     F.col("o_orderstatus").alias("c"))
    lines = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("v"))
    new = o.where(k % 2 == 0).select(
        k.alias("k"), F.when(k % 10 == 0, None).otherwise(F.col("o_custkey") + 1).alias("a"),
        (F.col("o_totalprice") * 2).alias("b"), F.lit("N").alias("c")).join(lines, "k")
    return old, new.withColumns({"a": F.col("a") + F.col("v"), "b": F.col("b") + F.col("v")})


@query("a16_e03_upsert_rows", "select k, a, b, c from old_v where k not in (select k from new_v) union all select k, a, b, c from new_v", MERGE_SQL)
def a16(spark, sf):
    old, new = merge_sides(spark, sf)
    return M.overwrite(old, new, ["k"], ["v"])


@query("a17_upsert_some_columns", """select k, case when n.k is not null then n.a else o.a end as a, coalesce(o.b, n.b) as b, case when n.k is not null then n.c else o.c end as c
  from old_v o full outer join new_v n using (k)""", MERGE_SQL)
def a17(spark, sf):
    old, new = merge_sides(spark, sf)
    return M.overwrite_columns(old, new, ["k"], ["a", "c"], ["v"])


@query("a18_upsert_touched", f"""select k, case when n.k is not null then n.a else o.a end as a, case when o.k is not null and n.k is not null then 1 else 0 end::bigint as respondido_at
  from old_v o full outer join new_v n using (k)""", MERGE_SQL)
def a18(spark, sf):
    old, new = merge_sides(spark, sf)
    zero = F.lit(0).cast("long")
    out = M.overwrite_columns(old.withColumn("respondido_at", zero), new.withColumn("respondido_at", zero), ["k"], ["a"], ["v"],
                              touched={"respondido_at": F.lit(1).cast("long")})
    return out.select("k", "a", "respondido_at")


@query("a19_c09_insert_absent", """select l_partkey as k, min(l_orderkey * 10 + l_linenumber)::bigint as first_line from lineitem
  where l_partkey not in (select p_partkey from part where p_partkey % 2 = 0) group by 1""")
def a19(spark, sf):
    stored = V.table(spark, sf, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("k"))
    new = V.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first_line"))
    return M.insert_absent(stored, new, "k", ["first_line"])


@query("a20_coalesce_merge", """select o.k, coalesce(n.a, o.a) as a, coalesce(n.b, o.b) as b, case when n.k is not null then n.c else o.c end as c,
  case when n.k is not null and n.a is not null then 1 else 0 end::bigint as fetched from old_v o left join new_v n using (k)""", MERGE_SQL)
def a20(spark, sf):
    old, new = merge_sides(spark, sf)
    one = M.one_per_key(new, ["k"], ["v"])
    return M.coalesce_merge(old.withColumn("fetched", F.lit(0).cast("long")), one, "k", ["a", "b"], ["c"],
                            {"fetched": F.col("_new.a").isNotNull()}, F.lit(1).cast("long"))


@query("a22_schema_evolution", """select c_custkey as id, c_acctbal as balance, c_nationkey::bigint as nation, c_mktsegment as c_mktsegment, 'historial' as corpus from customer
  union all select s_suppkey, s_acctbal, s_nationkey::bigint, null, 'historial' from supplier""")
def a22(spark, sf):
    c = V.table(spark, sf, "customer").drop("c_name").withColumnsRenamed({"c_custkey": "id", "c_acctbal": "balance", "c_nationkey": "nation"})
    s = M.evolve(V.table(spark, sf, "supplier"), dropped=["s_name"], renamed={"s_suppkey": "id", "s_acctbal": "balance", "s_nationkey": "nation"})
    return M.evolve(M.union_schemas(c, s), {"corpus": F.lit("historial")}, {"nation": "bigint"})


@query("a23_backfill", r"""select doc_id, case when doc_id % 3 = 0 or length(text) = 0 then 'youtube_manual' else 'supadata' end as transcript_source,
  case when doc_id % 2 = 0 then 7 else len(regexp_split_to_array(trim(text), '\s+')) end::int as transcript_word_count from documents""")
def a23(spark, sf):
    i = F.col("doc_id")
    rows = V.table(spark, sf, "documents").select(
        "doc_id", F.col("text").alias("transcript"), F.when(i % 3 == 0, "youtube_manual").alias("transcript_source"),
        F.lit(None).cast("boolean").alias("transcript_is_generated"), F.when(i % 2 == 0, 7).alias("transcript_word_count"))
    return M.backfill_transcripts(rows).select("doc_id", "transcript_source", "transcript_word_count")


@query("a24_width_cap", "select doc_id, nullif(left(trim(case when doc_id % 7 = 0 then '   ' else '  ' || lang || source || '  ' end), 5), '') as capped from documents")
def a24(spark, sf):
    raw = F.when(F.col("doc_id") % 7 == 0, "   ").otherwise(F.concat(F.lit("  "), "lang", "source", F.lit("  ")))
    return V.table(spark, sf, "documents").select("doc_id", numbers.cap_width(raw, 5).alias("capped"))


SAMPLE_SQL = ITEMS_SQL + ", sample_v as (select * from strata_v where stratum_format is not null and stratum_duration is not null and id % 5 = 0)"


def sample(spark, sf):
    return stratified(spark, sf).where("stratum_format is not null and stratum_duration is not null and id % 5 = 0")


@query("a26_d10_audit", f"""select {text(L.FRAME_VERSION)} as frame_version, f as formato, d as duracion, coalesce(m, 0)::bigint as n_muestra, coalesce(c, 0)::bigint as n_candidatos,
  {rounded('(c / sum(c) over ()) / nullif(m / sum(m) over (), 0)', 4)} as peso_reponderacion, coalesce(ch, 0)::bigint as n_chart_canal, (coalesce(m, 0) - coalesce(ch, 0))::bigint as n_busqueda_semilla
  from (select unnest(['informativo','practico_personal','entretenimiento','deporte_gaming']) as f), (select unnest(['corto','medio','largo']) as d)
  left join (select stratum_format, stratum_duration, count(*)::double as m, count(*) filter (sampling_source = 'chart_canal') as ch from sample_v group by all) a on a.stratum_format = f and a.stratum_duration = d
  left join (select stratum_format, stratum_duration, count(*)::double as c from strata_v where stratum_format is not null and stratum_duration is not null group by all) b on b.stratum_format = f and b.stratum_duration = d""", SAMPLE_SQL)
def a26(spark, sf):
    return SA.audit(sample(spark, sf), stratified(spark, sf))


# ------------------------------------------------------------------ B: filters


REASON_SQL = f"""
marks as (select doc_id, regexp_extract_all(strip_accents(lower(text)), '[a-z]+') as w from documents),
judged as materialized (select d.doc_id, case when d.doc_id % 13 = 0 then 'no_publico' when d.doc_id % 17 = 0 then 'restringido_por_region' when d.n_chars = 2 then 'duracion_ilegible'
  when d.n_chars < 120 then 'corto_menos_2min (Shorts y clips)' when d.n_chars > 10800 then 'largo_mas_3h (streams)'
  when cat = '29' then 'categoria_no_mapeada (29)' when d.doc_id % 3 = 0 and d.lang not like 'es%' then 'idioma_declarado_no_es (' || left(d.lang, 5) || ')'
  when d.doc_id % 3 <> 0 and not (len(w) >= 8 and len(list_filter(w, lambda x: list_contains({Q.values_list(L.SPANISH_MARKERS)}, x))) / greatest(len(w), 1)::double >= 0.12) then 'idioma_no_detectado_como_es'
  else 'ACEPTADO' end as reason from (select *, case when doc_id % 15 = 14 then '29' else '25' end as cat from documents) d join marks m using (doc_id))"""


def judged(spark, sf):
    i = F.col("doc_id")
    d = V.table(spark, sf, "documents")
    reason = SA.reject_reason(i % 13 != 0, i % 17 == 0, F.when(F.col("n_chars") != 2, F.col("n_chars")),
                              F.when(i % 15 == 14, "29").otherwise("25"), F.when(i % 3 == 0, F.col("lang")), F.col("text"))
    return d.select("doc_id", reason.alias("reason"))


@query("b02_candidate_reasons", "select doc_id, reason from judged", REASON_SQL)
def b02(spark, sf):
    return judged(spark, sf)


@query("d06_discard_funnel", f"select reason, count(*)::bigint as n, {rounded('count(*) / sum(count(*)) over ()::double', 6)} as share from judged group by reason", REASON_SQL)
def d06(spark, sf):
    return SA.discard_funnel(judged(spark, sf))


DUE = "(transcript is null or length(transcript) = 0) and (enrichment_status is null or enrichment_status not in ('ok','no_subs','geo_blocked','unavailable','exhausted'))"


@query("b03_work_queue", f"select id, coalesce(attempts, 0) as attempts from items_v where {DUE} and (next_attempt_at is null or next_attempt_at <= timestamp '{NOW}')", ITEMS_SQL)
def b03(spark, sf):
    return QU.due(items(spark, sf), now()).select("id", "attempts")


@query("f02_queue_head", f"select id from items_v where {DUE} and (next_attempt_at is null or next_attempt_at <= timestamp '{NOW}') order by next_attempt_at nulls first, created_at, external_id limit 10", ITEMS_SQL)
def f02(spark, sf):
    return QU.due(items(spark, sf), now(), limit=10).select("id")


@query("b03b_long_run_queue", "select id from items_v where (transcript is null or length(transcript) = 0 or description is null or enrichment_status is null) and (enrichment_status is null or enrichment_status not in ('ok','no_subs','geo_blocked','unavailable','exhausted'))", ITEMS_SQL)
def b03b(spark, sf):
    return QU.due(items(spark, sf), now(), worker=False).select("id")


@query("b04_retry", f"select id from items_v where coalesce(trim(transcript), '') = '' and (enrichment_status is null or enrichment_status = 'error') and (next_attempt_at is null or timestamp '{NOW}' - next_attempt_at >= interval 90 second)", ITEMS_SQL)
def b04(spark, sf):
    return items(spark, sf).where(QU.should_retry(F.col("transcript"), F.col("enrichment_status"), F.col("next_attempt_at"), now())).select("id")


@query("b05_c03_pending_panels", "select id from items_v where coalesce(trim(transcript), '') <> '' and corpus = 'referencia' and id not in (select l_orderkey from lineitem where l_linenumber = 2)", ITEMS_SQL)
def b05(spark, sf):
    gold = V.table(spark, sf, "lineitem").where("l_linenumber = 2").select(F.col("l_orderkey").alias("content_item_id"))
    return QU.pending_panels(items(spark, sf), gold, "referencia").select("id")


@query("b06_eligible_videos", f"""select c.content_id, {Q.category_case()} as formato from content_v c join labels l on l.doc_id = c.content_id
  where l.quality = 1 and {Q.category_case()} = 'informativo' and corpus = 'referencia' and transcript is not null and len(regexp_split_to_array(trim(transcript), '\\s+')) >= 50""")
def b06(spark, sf):
    c = V.content(spark, sf).withColumn("formato", strata.category_format(F.col("category_id")))
    good = V.table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("content_id"))
    c = c.where("formato = 'informativo' and corpus = 'referencia' and transcript is not null").join(good, "content_id")
    return c.where(F.size(F.split(F.trim("transcript"), r"\s+")) >= 50).select("content_id", "formato")


@query("b07_drop_disagreements", "select content_id from content_v where content_id not in (select content_id from rater_v where a <> b)")
def b07(spark, sf):
    flagged = V.raters(spark, sf).where("a <> b").select("content_id")
    return V.content(spark, sf).select("content_id").join(flagged, "content_id", "left_anti")


@query("b08_null_safe_filter", "select id from items_v where enrichment_status is distinct from 'ok'", ITEMS_SQL)
def b08(spark, sf):
    return items(spark, sf).where(~F.col("enrichment_status").eqNullSafe("ok")).select("id")


@query("b10_no_text_answer", f"""select id, case when m is not null then 0 end::int as apto, m as motivo, case when m is null then 'procesando' end as estado from (select id,
  case when enrichment_status = 'error' and id % 2 = 0 then 'limite_de_ritmo' when enrichment_status = 'no_subs' then 'sin_subtitulos' when enrichment_status = 'exhausted' then 'sin_creditos'
   when enrichment_status = 'error' then 'error_de_transcripcion' when timestamp '{NOW}' - created_at > interval 240 second then 'enriquecimiento_incompleto' end as m from items_v)""", ITEMS_SQL)
def b10(spark, sf):
    error = F.when(F.col("id") % 2 == 0, "rate_limit: 429").otherwise("timeout")
    answer = QU.no_text_answer(F.col("enrichment_status"), error, F.col("created_at"), now())
    return items(spark, sf).select("id", answer.alias("r")).select("id", F.col("r.apto").cast("int").alias("apto"), "r.motivo", "r.estado")


@query("b11_service_status", "select event_id, case event_type when 'view' then 'no_subs' when 'click' then 'ok' else 'error' end as status from events")
def b11(spark, sf):
    state = F.when(F.col("event_type") == "view", "vacio").when(F.col("event_type") == "click", "ok").otherwise(F.col("event_type"))
    return V.table(spark, sf, "events").select("event_id", QU.stored_status(state).alias("status"))


# what a fetch brought back: the whole text is read for hints where it is too short to be a transcript
STAND_IN_HINTS = {"geo": ["und der", "nicht"], "gone": ["les de", " avec "], "no_subs": ["de la", "that "]}
SHORT_TEXT = 1000


def _hinted(key: str) -> str:
    return "(" + " or ".join(f"contains(lower(transcript), {text(h)})" for h in STAND_IN_HINTS[key]) + ")"


@query("b12_b13_outcome", f"""select content_id, case when meta and has_text then 'ok' when not has_text and {_hinted('geo')} then 'geo_blocked'
  when not has_text and {_hinted('gone')} then 'unavailable' when not has_text and {_hinted('no_subs')} then 'no_subs'
  when meta or has_text then 'partial' else 'failed' end as status
  from (select content_id, transcript, category_id is not null as meta, n_chars >= {SHORT_TEXT} as has_text from content_v)""")
def b12(spark, sf):
    state = QU.outcome(F.col("category_id").isNotNull(), F.col("n_chars") >= SHORT_TEXT, F.col("transcript"), **STAND_IN_HINTS)
    return V.content(spark, sf).select("content_id", state.alias("status"))


@query("b15_duration_choice", """select l_orderkey, l_linenumber, case when l_linenumber = 3 then s else a end as segundos,
  (l_linenumber <> 3 and abs(a - s) > greatest(5.0, 0.05 * a)) as discrepa from (select l_orderkey, l_linenumber, l_quantity::int * 20 as s, l_quantity::int * 20 + (l_partkey % 30)::int as a from lineitem)""")
def b15(spark, sf):
    s = F.col("l_quantity").cast("int") * 20
    api = F.when(F.col("l_linenumber") == 3, 0).otherwise(s + (F.col("l_partkey") % 30).cast("int"))
    return V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", QU.duration_choice(s, api).alias("r")).select(
        "l_orderkey", "l_linenumber", "r.segundos", "r.discrepa")


@query("b16_strata", "select id, stratum_format, stratum_duration from strata_v", ITEMS_SQL)
def b16(spark, sf):
    return stratified(spark, sf).select("id", "stratum_format", "stratum_duration")


@query("b17_spanish_detector", f"""select doc_id, len(w) >= 8 and len(list_filter(w, lambda x: list_contains({Q.values_list(L.SPANISH_MARKERS)}, x))) / greatest(len(w), 1)::double >= 0.12 as es
  from (select doc_id, regexp_extract_all(strip_accents(lower(text)), '[a-z]+') as w from documents)""")
def b17(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", T.looks_spanish(F.col("text")).alias("es"))


# ------------------------------------------------------------------ C: joins


@query("c01_gold_join", "select l_orderkey as id, l_linenumber, o_custkey from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus = 'F' and l_returnflag is not null")
def c01(spark, sf):
    gold = V.table(spark, sf, "lineitem").where("l_returnflag is not null").select(F.col("l_orderkey").alias("id"), "l_linenumber")
    return gold.join(V.table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), "o_custkey"), "id")


@query("c02_missing_counts", """select count(*) filter (transcript is not null and g.k is null)::bigint as sin_panel, count(*) filter (transcript is null)::bigint as sin_transcripcion
  from items_v i left join (select distinct l_orderkey as k from lineitem where l_linenumber = 2) g on g.k = i.id where corpus is distinct from 'referencia'""", ITEMS_SQL)
def c02(spark, sf):
    gold = V.table(spark, sf, "lineitem").where("l_linenumber = 2").select(F.col("l_orderkey").alias("id")).distinct().withColumn("has", F.lit(1))
    d = items(spark, sf).where(~F.col("corpus").eqNullSafe("referencia")).join(gold, "id", "left")
    return d.agg(F.count_if(F.col("transcript").isNotNull() & F.col("has").isNull()).alias("sin_panel"),
                 F.count_if(F.col("transcript").isNull()).alias("sin_transcripcion"))


@query("c07_legacy_key_join", "select o_orderkey, n_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey")
def c07(spark, sf):
    c = V.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = V.table(spark, sf, "nation").select("n_nationkey", "n_name")
    named = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    return V.table(spark, sf, "orders").join(named, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "n_name")


@query("c08_diet_merge", "select c.content_id, count(w.event_id)::bigint as vistas from content_v c left join watch_v w using (content_id) group by 1")
def c08(spark, sf):
    seen = V.watches(spark, sf).groupBy("content_id").agg(F.count(F.lit(1)).alias("vistas"))
    return V.content(spark, sf).select("content_id").join(seen, "content_id", "left").fillna(0, ["vistas"])


@query("c11_latest_score", """select c_custkey as content_item_id, s.p as score_numeric, s.p is not null as scoring_done from customer left join (
  select o_custkey, o_totalprice as p from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_totalprice desc) = 1) s on s.o_custkey = c_custkey""")
def c11(spark, sf):
    scores = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("content_item_id"), F.col("o_totalprice").alias("score_numeric"),
                                                 F.col("o_orderdate").alias("scored_at"))
    people = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("content_item_id"))
    return M.latest_score(people, scores).select("content_item_id", "score_numeric", "scoring_done")


# ------------------------------------------------------------------ D: aggregates


@query("d01_stratum_fill", """select stratum_format, stratum_duration, count(*)::bigint as candidatos, count(*) filter (enrichment_status = 'ok')::bigint as enriquecidos,
  count(*) filter (transcript_word_count > 0)::bigint as con_transcripcion, count(distinct channel_id)::bigint as canales_distintos from strata_v where corpus = 'referencia' group by all""", ITEMS_SQL)
def d01(spark, sf):
    return SA.stratum_fill(stratified(spark, sf).where("corpus = 'referencia'"))


STATE_SQL = ITEMS_SQL + """,
state_v as materialized (select *, (con_texto + pendientes)::bigint as proyeccion, greatest(0, 600 - con_texto - pendientes)::bigint as faltan from (
  select stratum_format, stratum_duration, count(*)::bigint as encolados, count(*) filter (coalesce(transcript_word_count, 0) > 0)::bigint as con_texto,
  count(*) filter (enrichment_status is null or enrichment_status not in ('ok','no_subs','geo_blocked','unavailable','exhausted'))::bigint as pendientes,
  count(*) filter (enrichment_status in ('ok','no_subs','geo_blocked','unavailable','exhausted') and coalesce(transcript_word_count, 0) = 0)::bigint as fallidos
  from strata_v where corpus = 'referencia' and stratum_format is not null and stratum_duration is not null group by all))"""


def state(spark, sf):
    d = stratified(spark, sf).where("corpus = 'referencia' and stratum_format is not null and stratum_duration is not null")
    return SA.stratum_state(d, 600)


@query("d02_stratum_state", "select * from state_v", STATE_SQL)
def d02(spark, sf):
    s = state(spark, sf)
    return s.withColumn("faltan", F.col("faltan").cast("long"))


@query("d03_status_report", f"select coalesce(enrichment_status, '(sin intentar)') as estado, count(*)::bigint as n, max(attempts) as max_intentos, {stamp.sql('min(next_attempt_at)')} as proximo from items_v group by 1", ITEMS_SQL)
def d03(spark, sf):
    return QU.status_report(items(spark, sf)).select("estado", "n", "max_intentos", stamp("proximo_turno").alias("proximo"))


@query("d07_concentration", f"select {rounded('sum(n * n) / (sum(n) * sum(n))::double', 6)} as hhi, {rounded('max(n) / sum(n)::double', 6)} as top1, count(*)::bigint as claves from (select count(*)::double as n from strata_v group by channel_id)", ITEMS_SQL)
def d07(spark, sf):
    return ST.concentration(items(spark, sf), F.col("channel_id"))


@query("d07b_concentration_minutes", f"select {rounded('sum(n * n) / (sum(n) * sum(n))::double', 6)} as hhi, {rounded('max(n) / sum(n)::double', 6)} as top1, count(*)::bigint as claves from (select sum(duration_seconds)::double as n from strata_v group by channel_id)", ITEMS_SQL)
def d07b(spark, sf):
    return ST.concentration(items(spark, sf), F.col("channel_id"), F.col("duration_seconds"))


@query("d08_design_table", """select coalesce(stratum_format, 'TOTAL') as stratum_format, count(*) filter (stratum_duration = 'corto')::bigint as corto, count(*) filter (stratum_duration = 'medio')::bigint as medio,
  count(*) filter (stratum_duration = 'largo')::bigint as largo, count(*)::bigint as total from sample_v group by rollup(stratum_format)""", SAMPLE_SQL)
def d08(spark, sf):
    return SA.design_table(sample(spark, sf))


@query("d08b_shortfalls", """select f as stratum_format, d as stratum_duration, (200 - coalesce(n, 0))::bigint as faltan, coalesce(c, 0)::bigint as candidatos
  from (select unnest(['informativo','practico_personal','entretenimiento','deporte_gaming']) as f), (select unnest(['corto','medio','largo']) as d)
  left join (select stratum_format, stratum_duration, count(*) as n from sample_v group by all) a on a.stratum_format = f and a.stratum_duration = d
  left join (select stratum_format, stratum_duration, count(*) as c from strata_v group by all) b on b.stratum_format = f and b.stratum_duration = d where coalesce(n, 0) < 200""", SAMPLE_SQL)
def d08b(spark, sf):
    s = SA.shortfalls(sample(spark, sf), stratified(spark, sf), 200)
    return s.withColumn("faltan", F.col("faltan").cast("long"))


@query("d09_provenance", f"select sampling_source as fuente, count(*)::bigint as n, {rounded('count(*) / sum(count(*)) over ()::double', 6)} as share from sample_v group by 1", SAMPLE_SQL)
def d09(spark, sf):
    return SA.provenance(sample(spark, sf), F.col("sampling_source"), "fuente")


@query("d09b_publication_years", f"select strftime(created_at, '%Y') as anio, count(*)::bigint as n, {rounded('count(*) / sum(count(*)) over ()::double', 6)} as share from sample_v group by 1", SAMPLE_SQL)
def d09b(spark, sf):
    return SA.provenance(sample(spark, sf), F.date_format("created_at", "yyyy"), "anio")


@query("d09c_duration_summary", f"select count(*)::bigint as videos, {rounded('sum(duration_seconds) / 36e2', 6)} as horas, {rounded('list_sort(list(duration_seconds))[count(*) // 2 + 1] / 6e1', 6)} as mediana_min from sample_v", SAMPLE_SQL)
def d09c(spark, sf):
    return SA.duration_summary(sample(spark, sf))


@query("d18_watched_totals", f"""select count(*)::bigint as videos, count(distinct channel)::bigint as canales, {rounded('sum(duration_seconds / 6e1)', 6)} as minutos,
  strftime(min(watched_at at time zone 'UTC' at time zone 'Europe/Paris'), '%Y-%m-%d') as desde, strftime(max(watched_at at time zone 'UTC' at time zone 'Europe/Paris'), '%Y-%m-%d') as hasta from watch_v join content_v using (content_id)""")
def d18(spark, sf):
    seen = V.watches(spark, sf).groupBy("content_id").agg(F.count(F.lit(1)).alias("n"), F.min("watched_at").alias("a"), F.max("watched_at").alias("b"))
    d = seen.join(V.content(spark, sf).select("content_id", "channel", "duration_seconds"), "content_id")
    day = lambda c: F.date_format(F.from_utc_timestamp(c, "Europe/Paris"), "yyyy-MM-dd")
    return d.agg(F.sum("n").alias("videos"), F.count_distinct("channel").alias("canales"),
                 numbers.half_even(F.sum(F.col("n") * F.col("duration_seconds")) / 60.0, 6).alias("minutos"),
                 day(F.min("a")).alias("desde"), day(F.max("b")).alias("hasta"))


@query("d19_outcome_counts", "select event_type as outcome, count(*)::bigint as n from events group by 1")
def d19(spark, sf):
    return V.table(spark, sf, "events").groupBy(F.col("event_type").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ E, F: windows, order, draws


@query("e04_rank_in_cell", "select id, rank from (select id, row_number() over (partition by stratum_format, stratum_duration order by md5(external_id || ':7:sorteo'), external_id)::int as rank from strata_v where stratum_format is not null and stratum_duration is not null) where rank <= 25", ITEMS_SQL)
def e04(spark, sf):
    d = stratified(spark, sf).where("stratum_format is not null and stratum_duration is not null").withColumn("_k", SA.draw_key("external_id", "7", "sorteo"))
    return SK.top_per_group(d, SA.CELL, [F.col("_k"), F.col("external_id")], 25, F.col("external_id")).select("id", "rank")


@query("e05_m12_even_picks", """select o_orderkey, position::bigint as position from (select o_orderkey, row_number() over (order by floor(o_totalprice / 100)::bigint desc, o_orderkey) - 1 as position, count(*) over () as n from orders)
  where position in (select floor(i * n / 40e0)::bigint from range(0, 40) t(i), (select count(*) as n from orders))""")
def e05(spark, sf):
    from contentgauge.operators.quiz import even_picks
    d = V.table(spark, sf, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") / 100).cast("long").alias("v"))
    return even_picks(d, "v", "o_orderkey", 40).select("o_orderkey", F.col("position").cast("long").alias("position"))


@query("e05b_global_positions", "select o_orderkey, (row_number() over (order by o_custkey desc, o_orderkey) - 1)::bigint as position from orders")
def e05b(spark, sf):
    d = V.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return SK.numbered(d, "o_custkey", "o_orderkey").select("o_orderkey", F.col("position").cast("long").alias("position"))


@query("f01_page", "select o_orderkey, o_totalprice from orders order by o_orderdate desc, o_orderkey desc limit 20 offset 40")
def f01(spark, sf):
    return V.table(spark, sf, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).offset(40).limit(20).select("o_orderkey", "o_totalprice")


@query("f03_top_channels", "select channel_id, count(*)::bigint as n from items_v group by 1 order by n desc, channel_id limit 5", ITEMS_SQL)
def f03(spark, sf):
    return items(spark, sf).groupBy("channel_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "channel_id").limit(5)


@query("f05_f09_sample_per_channel", "select id from items_v qualify row_number() over (partition by channel_id order by md5(external_id || ':11:canal'), external_id) <= 3", ITEMS_SQL)
def f05(spark, sf):
    return SA.sample_per_channel(items(spark, sf), 3, "11").select("id")


# the same rounds over the whole pool, without first looking for contenders
DRAW_SQL = ITEMS_SQL + """,
pool as materialized (select external_id, coalesce(channel_id, '?') as channel_id, stratum_format, stratum_duration, md5(external_id || ':7:sorteo') as key
  from strata_v where stratum_format is not null and stratum_duration is not null),
draw(external_id, channel_id, stratum_format, stratum_duration, key, taken, round, cap) as (
  select *, false, 1, 1 from pool
  union all
  select external_id, channel_id, stratum_format, stratum_duration, key, taken or accepted, round + 1,
    case when bool_or(accepted) over () then cap else cap + 1 end
  from (select *, asks and row_number() over (partition by channel_id order by asks desc, lot, key, external_id) <= cap - used as accepted
    from (select *, free and place <= 10 - filled as asks, md5(concat_ws(':', channel_id, stratum_format, stratum_duration, round, '7')) as lot
      from (select *, row_number() over (partition by stratum_format, stratum_duration order by free desc, key, external_id) as place
        from (select *, not taken and used < cap and filled < 10 as free
          from (select *, sum(taken::int) over (partition by channel_id) as used,
              sum(taken::int) over (partition by stratum_format, stratum_duration) as filled from draw where cap <= 2)))))),
drawn as (select * from draw where cap = 3)"""


@query("f06_stratified_draw", """select external_id, channel_id, stratum_format, stratum_duration, case when taken then 'principal' else 'reserva' end as sample_rank
  from drawn qualify taken or row_number() over (partition by stratum_format, stratum_duration, taken order by key, external_id) <= 5""", DRAW_SQL)
def f06(spark, sf):
    """Equal allocation with a channel cap."""
    return SA.stratified_draw(stratified(spark, sf), 120, 2, 5, "7").select(
        "external_id", "channel_id", "stratum_format", "stratum_duration", "sample_rank")


@query("f06b_feasibility", "select count(distinct channel_id)::bigint as canales, (count(distinct channel_id) * 2)::bigint as techo, count(distinct channel_id) * 2 >= 396 as alcanza from items_v", ITEMS_SQL)
def f06b(spark, sf):
    return SA.feasibility(items(spark, sf), 396, 2)


RESERVE_SQL = STATE_SQL + """,
bank as materialized (select *, row_number() over (partition by stratum_format, stratum_duration order by md5(external_id || ':5:banco'), external_id)::int as orden from strata_v
  where corpus = 'historial' and stratum_format is not null and stratum_duration is not null and id % 5 <> 0)"""


def bank_sides(spark, sf):
    d = stratified(spark, sf).where("stratum_format is not null and stratum_duration is not null")
    return d.where("corpus = 'historial'"), d.where("id % 5 = 0").select("external_id")


@query("f07_rebuild_reserve", "select id, orden from bank where orden <= 30", RESERVE_SQL)
def f07(spark, sf):
    cands, stored = bank_sides(spark, sf)
    return SA.rebuild_reserve(cands, stored, 30, "5").select("id", "orden")


@query("f08_refill", "select id from bank join state_v using (stratum_format, stratum_duration) where orden <= faltan", RESERVE_SQL)
def f08(spark, sf):
    cands, stored = bank_sides(spark, sf)
    return SA.refill(state(spark, sf), cands, stored, 600, "5").select("id")


@query("f08b_uncovered", """select stratum_format, stratum_duration, coalesce(r, 0)::bigint as repuestos, (faltan - coalesce(r, 0))::bigint as sin_cubrir from state_v
  left join (select stratum_format, stratum_duration, count(*) as r from bank join state_v using (stratum_format, stratum_duration) where orden <= faltan group by all) using (stratum_format, stratum_duration) where faltan > 0""", RESERVE_SQL)
def f08b(spark, sf):
    cands, stored = bank_sides(spark, sf)
    s = state(spark, sf)
    return SA.uncovered(s, SA.refill(s, cands, stored, 600, "5")).withColumn("sin_cubrir", F.col("sin_cubrir").cast("long"))


# ------------------------------------------------------------------ G: set operations


@query("g01_first_source_wins", "select k, arg_min(v, p) as v from (select l_partkey as k, 0 as p, 'a' as v from lineitem where l_linenumber = 1 union all select p_partkey, 1, 'b' from part) group by k")
def g01(spark, sf):
    a = V.table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("k"), F.lit("a").alias("v"))
    b = V.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.lit("b").alias("v"))
    return M.first_source_wins([a, b], "k")


@query("g02_difference", "select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_linenumber = 1)")
def g02(spark, sf):
    used = V.table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("p_partkey"))
    return V.table(spark, sf, "part").select("p_partkey").join(used, "p_partkey", "left_anti")


@query("g03_overlap", "select count(*)::bigint as solapan from part where p_partkey in (select l_partkey from lineitem where l_linenumber = 1)")
def g03(spark, sf):
    used = V.table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("p_partkey"))
    return V.table(spark, sf, "part").join(used, "p_partkey", "left_semi").agg(F.count(F.lit(1)).alias("solapan"))


@query("g04_distinct", "select distinct channel, transcript_lang from content_v")
def g04(spark, sf):
    return V.content(spark, sf).select("channel", "transcript_lang").distinct()


@query("g05_stop_words_present", f"select content_id, len(list_intersect(list_distinct(toks), {Q.values_list(L.STOP_WORDS['es'] + L.STOP_WORDS['en'])}))::bigint as n from tok", Q.TOKENS)
def g05(spark, sf):
    d = V.content(spark, sf).select("content_id", T.fold(F.col("transcript")).alias("f")).select("content_id", T.tokens(F.col("f")).alias("t"))
    lists = [F.expr(f"array({T.sql_list(L.STOP_WORDS[x])})") for x in ("es", "en")]
    return d.select("content_id", F.size(F.array_intersect("t", F.array_union(*lists))).cast("long").alias("n"))


# ------------------------------------------------------------------ N5


@query("n05_retry_schedule", f"""select id, case when done then s when tried > 4 then 'exhausted' else s end as status, tried as attempts,
  case when not done and tried <= 4 then {stamp.sql(f"timestamp '{NOW}' + to_minutes(list_extract([15, 60, 240, 1440], tried))")} end as next_us
  from (select id, coalesce(enrichment_status, 'failed') as s, coalesce(attempts, 0) + (coalesce(enrichment_status, 'failed') <> 'ok')::int as tried,
   coalesce(enrichment_status, 'failed') in ('ok','no_subs','geo_blocked','unavailable','exhausted') as done from items_v)""", ITEMS_SQL)
def n05(spark, sf):
    s = F.coalesce("enrichment_status", F.lit("failed"))
    return items(spark, sf).select("id", QU.schedule(s, F.col("attempts"), now()).alias("r")).select(
        "id", "r.status", "r.attempts", stamp("r.next_attempt_at").alias("next_us"))


@query("n05b_postpone", f"select id, {stamp.sql(f'''greatest(coalesce(next_attempt_at, timestamp '{NOW}'), timestamp '{NOW}' + to_hours(3))''')} as next_us from items_v", ITEMS_SQL)
def n05b(spark, sf):
    return items(spark, sf).select("id", stamp(QU.postpone(F.col("next_attempt_at"), now(), 3)).alias("next_us"))
