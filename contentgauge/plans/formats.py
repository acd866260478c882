"""Registered queries: file formats (A) read from columns derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentgauge.functions.numbers import half_even
from contentgauge.plans import sql_features as Q, views as V
from contentgauge.plans.registry import query
from contentgauge.plans.sql_features import rounded
from contentgauge.session import scratch_path
from contentgauge.sources import captions as C, media_api as A, quiz_files as Z, snapshots as S

# ------------------------------------------------------------------ captions


@query("a07_json3_captions", f"""select conv_id, (turn * 2 + h)::bigint as pos, md5(trim(text || case h when 0 then ' a' else 'b ' end, ' ')) as digest,
  {rounded('(turn * 1234 + h) / 1e3', 2)} as start, {rounded('case h when 0 then 0 else turn end / 1e3', 2)} as duration
  from conversations, (select unnest([0, 1]) as h)""")
def a07(spark, sf):
    """Two caption events per turn, one of them without a duration, among empty ones."""
    c = V.table(spark, sf, "conversations")
    event = lambda h, tail: F.struct(
        (F.col("turn") * 1234 + h).alias("tStartMs"), (F.lit(None) if h == 0 else F.col("turn")).cast("bigint").alias("dDurationMs"),
        F.array(F.struct(F.col("text").alias("utf8")), F.struct(F.lit(tail).alias("utf8"))).alias("segs"))
    empty = F.struct(F.lit(0).cast("bigint").alias("tStartMs"), F.lit(0).cast("bigint").alias("dDurationMs"),
                     F.array(F.struct(F.lit(" ").alias("utf8"))).alias("segs"))
    rows = c.select("conv_id", "turn", F.array(event(0, " a"), empty, event(1, "b ")).alias("events"))
    out = C.json3_segments(rows, ["conv_id", "turn"])
    return out.select("conv_id", (F.col("turn") * 2 + F.floor(F.col("pos") / 2)).cast("long").alias("pos"), F.md5("text").alias("digest"), "start", "duration")


@query("a08_cue_captions", f"""select conv_id as file, row_number() over (partition by conv_id order by turn) as cue, 'turno ' || turn || ' ' || md5(text) || ' fin' as text,
  {rounded('turn * 65.5e0', 2)} as start, {rounded('(turn * 65.5e0 + 2.25e0) - turn * 65.5e0', 2)} as duration from conversations""")
def a08(spark, sf):
    """A file per conversation, a cue per turn: a timing line, a tagged line twice, a header, the text's digest, a last line."""
    c = V.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    clock = lambda s: F.concat(F.lit("00:"), F.floor(s / 60).cast("string"), F.lit(":"), (s % 60).cast("string"))
    begin = F.col("turn") * 65.5
    lines = F.array(
        F.concat(clock(begin), F.lit(" --> "), clock(begin + 2.25), F.lit(" align:start")), F.concat(F.lit("<c>turno "), F.col("turn").cast("string"), F.lit("</c>")),
        F.concat(F.lit("turno "), F.col("turn").cast("string")), F.lit("NOTE nada"), F.md5("text"), F.lit(" fin "))
    rows = c.select(F.col("conv_id").alias("file"), "turn", F.posexplode(lines).alias("k", "line")).select(
        "file", (F.col("turn") * 10 + F.col("k")).alias("at"), "line")
    return C.cue_segments(rows, "file").select("file", F.col("cue").cast("long").alias("cue"), "text", "start", "duration")


# ------------------------------------------------------------------ API answers


def api_items(spark, sf):
    """Documents as the JSON texts of API items."""
    i = F.col("doc_id")
    n = F.col("n_chars")
    pick = lambda values, k: F.get(F.array(*[F.lit(v).cast("string") for v in values]), k.cast("int"))
    item = F.struct(
        F.concat(F.lit("v"), i.cast("string")).alias("id"),
        F.struct(F.left("text", F.lit(40)).alias("title"), F.col("source").alias("channelTitle"), F.concat(F.lit("  ch"), i.cast("string")).alias("channelId"),
                 pick(["25", "26", "99", None], i % 4).alias("categoryId"), pick(["2026-02-03T04:05:06Z", "bad", None], i % 3).alias("publishedAt"),
                 F.when(i % 2 == 0, F.array(F.lit("a"), F.lit("b"))).alias("tags"), F.when(i % 5 == 0, F.col("lang")).alias("defaultAudioLanguage"),
                 F.lit("es-AR").alias("defaultLanguage")).alias("snippet"),
        F.struct(F.concat(F.lit("PT"), (n % 60).cast("string"), F.lit("M"), (n % 7).cast("string"), F.lit("S")).alias("duration")).alias("contentDetails"),
        F.struct(F.when(i % 3 != 0, n.cast("string")).alias("viewCount"), F.lit("x").alias("likeCount")).alias("statistics"))
    raw = V.table(spark, sf, "documents").select(F.to_json(item).alias("j"))
    return raw.select(F.from_json("j", A.ITEM).alias("p")).select("p.*")


@query("a02_a11_api_metadata", f"""select 'v' || doc_id as external_id, coalesce(list_extract(['25', '26', '99', null], (doc_id % 4 + 1)::int), '') as category_id,
  coalesce({Q.category_name_case("list_extract(['25', '26', '99', null], (doc_id % 4 + 1)::int)")}, 'Other') as category_name, case when doc_id % 3 <> 0 then n_chars else 0 end::bigint as view_count,
  0::bigint as like_count, 0::bigint as comment_count, 'ch' || doc_id as channel_id, case when doc_id % 5 = 0 then lang else 'es-AR' end as video_language,
  case when doc_id % 3 = 0 then '2026-02-03' end as upload_date, nullif((n_chars % 60) * 60 + n_chars % 7, 0)::bigint as duration_seconds, case when doc_id % 2 = 0 then 2 else 0 end::int as n_tags from documents""")
def a11(spark, sf):
    m = A.item_metadata(api_items(spark, sf))
    return m.select("external_id", "category_id", "category_name", "view_count", "like_count", "comment_count", "channel_id", "video_language",
                    F.date_format("upload_date", "yyyy-MM-dd").alias("upload_date"), "duration_seconds", F.size("tags").alias("n_tags"))


@query("a12_extractor_metadata", f"""select 'v' || doc_id as external_id, case when doc_id % 2 = 0 then source else 'up' end as channel, case when doc_id % 3 = 0 then '23' when doc_id % 3 = 1 then null else '28' end as category_id,
  (doc_id % 4)::int as n_chapters, case when doc_id % 5 = 0 then null else '2026-02-03' end as upload_date from documents""")
def a12(spark, sf):
    i = F.col("doc_id")
    chapter = F.struct(F.lit("t").alias("title"), F.lit(0.0).alias("start_time"), F.lit(1.0).alias("end_time"))
    info = F.struct(
        F.concat(F.lit("v"), i.cast("string")).alias("id"), F.when(i % 2 == 0, F.col("source")).alias("channel"), F.lit("up").alias("uploader"),
        F.when(i % 3 == 0, F.array(F.lit("Comedy"))).when(i % 3 == 1, F.array(F.lit("Unheard of"))).otherwise(F.array(F.lit("Science & Technology"))).alias("categories"),
        F.when(i % 4 > 0, F.array_repeat(chapter, (i % 4).cast("int"))).alias("chapters"), F.when(i % 5 == 0, "2026").otherwise("20260203").alias("upload_date"))
    raw = V.table(spark, sf, "documents").select(F.to_json(info).alias("j")).select(F.from_json("j", A.EXTRACTED).alias("p")).select("p.*")
    return A.extracted_metadata(raw).select("external_id", "channel", "category_id", "n_chapters", F.date_format("upload_date", "yyyy-MM-dd").alias("upload_date"))


# ------------------------------------------------------------------ quiz files


def quiz_texts(spark, sf):
    """Conversations as quiz files: one question per turn."""
    i = F.col("turn")
    q = F.struct(F.left("text", F.lit(20)).alias("pregunta"), F.array(F.lit("a"), F.col("role")).alias("opciones"), F.lit("c").alias("cita"), F.col("role").alias("tipo"),
                 (i % 2 == 0).alias("sobrevive"), F.when(i % 3 != 0, (i % 2).cast("int")).alias("correcta"))
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", q.alias("q")))), lambda s: s["q"])
    v = V.table(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("preguntas"))
    video = F.struct(F.col("conv_id").alias("content_item_id"), F.lit("1").alias("version"), F.when(F.col("conv_id") % 7 == 0, "roto").alias("error"), "preguntas")
    return v.select(F.from_json(F.to_json(video), Z.QUIZ).alias("p")).select("p.*")


@query("a05_quiz_questions", """select conv_id as content_item_id, turn::int as n_orden, role as tipo, (turn % 2)::int as correcta, turn % 2 = 0 as utilizable from conversations where conv_id % 7 <> 0 and turn % 3 <> 0""")
def a05(spark, sf):
    return Z.quiz_questions(quiz_texts(spark, sf)).select("content_item_id", "n_orden", "tipo", "correcta", "utilizable")


@query("a29_flat_questions", """select conv_id as content_item_id, role as tipo, 'a' as op0, role as op1, '' as op2, '' as op3, case when turn % 3 <> 0 then (turn % 2)::int end as correcta, '' as descarte from conversations""")
def a29(spark, sf):
    return Z.flat_questions(quiz_texts(spark, sf)).select("content_item_id", "tipo", "op0", "op1", "op2", "op3", "correcta", "descarte")


@query("a06_answer_files", """select user_id::varchar as persona_id, event_id as pregunta_id, (event_id % 4)::int as eleccion, case when event_id % 3 = 0 then 2 else 1 end::int as intento from events where event_type = 'click'""")
def a06(spark, sf):
    e = F.col("event_id")
    answer = F.struct(e.alias("pregunta_id"), (e % 4).cast("int").alias("eleccion"), F.lit(True).alias("acierto"), F.when(e % 3 == 0, 2).alias("intento"))
    # one file per person and day, so a person with many answers is many files
    files = V.table(spark, sf, "events").where("event_type = 'click'").groupBy("user_id", F.to_date("ts")).agg(F.collect_list(answer).alias("respuestas"))
    whole = F.struct(F.col("user_id").cast("string").alias("persona_id"), "respuestas")
    parsed = files.select(F.from_json(F.to_json(whole), Z.ANSWERS).alias("p")).select("p.*")
    return Z.answer_rows(parsed).select("persona_id", "pregunta_id", "eleccion", "intento")


# ------------------------------------------------------------------ sinks read back


@query("a15_json_without_nan", "select event_id, case when event_id % 5 = 0 then null else value end as v from events")
def a15(spark, sf):
    e = F.col("event_id")
    d = V.table(spark, sf, "events").select("event_id", F.when(e % 10 == 0, float("nan")).when(e % 10 == 5, float("inf")).otherwise(F.col("value")).alias("v"))
    return S.without_nan(d)


@query("a14_a03_csv_round_trip", "select doc_id, md5(text) as digest, lang from documents")
def a14(spark, sf):
    """Whole texts written as CSV to the shared folder and read again."""
    from contentgauge.session import scratch_path
    path = scratch_path(spark, "csv")
    S.write_csv(V.table(spark, sf, "documents").select("doc_id", "text", "lang"), path)
    return S.read_items_csv(spark, path, "doc_id bigint, text string, lang string").select("doc_id", F.md5("text").alias("digest"), "lang")


@query("a25_appended_report", f"select event_type as outcome, sum(n)::bigint as n from (select event_type, count(*) as n from events group by 1 union all select event_type, count(*) from events where event_id % 2 = 0 group by 1) group by 1")
def a25(spark, sf):
    from contentgauge.session import scratch_path
    path = scratch_path(spark, "report")
    e = V.table(spark, sf, "events")
    for batch in (e, e.where("event_id % 2 = 0")):
        S.append_report(batch.groupBy(F.col("event_type").alias("outcome")).agg(F.count(F.lit(1)).alias("n")), path)
    back = spark.read.schema("outcome string, n bigint").option("header", True).csv(path)
    return back.groupBy("outcome").agg(F.sum("n").alias("n"))


@query("a04_dashboard_files", "select substring(text, 1, 60) as titulo, source as canal, lang as formato, '2026-01-01' as fecha, "
       + "round_even(n_chars / 6e2 * 1e1, 0)::double / 1e1 as minutos, n_chars::int as palabras, "
       + ", ".join(f"((doc_id + {i}) % 101)::int as p{i}" for i in range(8)) + " from documents")
def a04(spark, sf):
    """Dashboard rows written as positional JSON and read back."""
    d = V.table(spark, sf, "documents").select(
        F.substring("text", 1, 60).alias("titulo"), F.col("source").alias("canal"), F.col("lang").alias("formato"),
        F.lit("2026-01-01").alias("fecha"), half_even(F.col("n_chars") / 600.0, 1).alias("minutos"),
        F.col("n_chars").cast("int").alias("palabras"), *[((F.col("doc_id") + i) % 101).cast("int").alias(f"p{i}") for i in range(8)])
    path = scratch_path(spark, "dashboard")
    S.write_dashboard(d, path)
    return S.read_dashboard(spark, path)


@query("a15b_json_files", "select event_id, case when event_id % 5 = 0 then null else value end as v, props from events")
def a15b(spark, sf):
    """The JSON sink, read back: NaN and infinities were written as nulls."""
    e = F.col("event_id")
    d = V.table(spark, sf, "events").select(
        "event_id", F.when(e % 10 == 0, float("nan")).when(e % 10 == 5, float("inf")).otherwise(F.col("value")).alias("v"), "props")
    path = scratch_path(spark, "json-sink")
    S.write_json(d, path)
    return spark.read.schema(d.schema).json(path)
