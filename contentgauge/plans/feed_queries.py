"""Registered queries that run the feed: files written from the driver tables, streamed through
once, and the stores read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from contentgauge.functions import lexicons as L
from contentgauge.operators import placement as P
from contentgauge.operators.indicators import describe
from contentgauge.plans import views as V
from contentgauge.plans.common import reference_scale
from contentgauge.plans.people import DIET_SQL, watched
from contentgauge.plans.registry import query
from contentgauge.plans.scale_queries import PLACED
from contentgauge.plans.sql_features import rounded
from contentgauge.plans.times import stamp
from contentgauge.session import scratch_path
from contentgauge.streaming import feed as N, tables as T


def run(started) -> None:
    """Wait until everything that had arrived is through."""
    started.awaitTermination()
    if started.exception() is not None:
        raise started.exception()


def arrived(df: DataFrame, name: str) -> str:
    """The rows as JSON files of an input folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)
    return path


def payloads(spark, sf) -> DataFrame:
    """Events as payloads; every tenth is not JSON and every ninth lacks its url."""
    e = F.col("event_id")
    item = F.struct((e % 97).cast("string").alias("video_id"), F.concat_ws(" ", "event_type", e.cast("string")).alias("title"),
                    F.when(e % 9 != 0, F.col("props")).alias("url"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("tracked_at"))
    return V.table(spark, sf, "events").select("event_id", F.when(e % 10 == 0, F.concat(F.lit("{event "), e.cast("string"))).otherwise(F.to_json(item)).alias("value"))


PAYLOADS = """
sent as (select event_id, case when event_id % 10 = 0 or event_id % 9 = 0 or props is null then 'error' else 'ok' end as status,
  (event_id % 97)::varchar as external_id, event_type || ' ' || event_id as title, ts from events)"""


@query("n01_n10_stored_feed", "select status, count(*)::bigint as n, count(case when status = 'ok' then title end)::bigint as titles from sent group by status", PAYLOADS)
def n01(spark, sf):
    """Lines are stored verbatim by one stream and split by whether they parse by another."""
    folder = scratch_path(spark, "feed")
    payloads(spark, sf).select("value").write.text(folder)
    raw, good, dead = (scratch_path(spark, name) for name in ("raw", "good", "dead"))
    run(N.append_raw(N.read_lines(spark, folder), raw, scratch_path(spark, "raw-progress")))
    parsed = N.parse(N.read_lines(spark, folder))
    run(N.start(parsed, N.split_errors(parsed, good, dead), scratch_path(spark, "split-progress")))
    texts = spark.read.parquet(raw).select("payload")
    bad = spark.read.parquet(dead).join(texts, "payload", "left_semi").select("status", F.lit(None).cast("string").alias("title"))
    rows = bad.unionByName(spark.read.parquet(good).select(F.lit("ok").alias("status"), "title"))
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count("title").alias("titles"))


@query("a21_registered_items", """select external_id, title from sent where status = 'ok'
  qualify row_number() over (partition by external_id order by ts, title) = 1""", PAYLOADS)
def a21(spark, sf):
    """Items registered from the feed, one row per video whatever arrives later."""
    folder, path = scratch_path(spark, "feed"), scratch_path(spark, "items")
    payloads(spark, sf).select("value").write.text(folder)
    good = N.parse(N.read_lines(spark, folder)).where("status = 'ok'")
    run(N.start(good, N.register(path), scratch_path(spark, "progress")))
    return T.read_log(spark, path, N.ITEM).select("external_id", "title")


@query("n06_stored_outcomes", """select external_id, enrichment_status, case when enrichment_status <> 'ok' then enrichment_error end as enrichment_error from (
  select (event_id % 61)::varchar as external_id, case when event_id % 3 = 0 then 'ok' else 'failed' end as enrichment_status, event_type as enrichment_error, ts, event_id from events)
  qualify row_number() over (partition by external_id order by ts desc, event_id desc) = 1""")
def n06(spark, sf):
    """The latest attempt of every item, with the error of that attempt."""
    e = F.col("event_id")
    rows = V.table(spark, sf, "events").select(
        (e % 61).cast("string").alias("external_id"), F.when(e % 3 == 0, "ok").otherwise("failed").alias("enrichment_status"),
        F.col("event_type").alias("enrichment_error"), F.lit("v").alias("enricher_version"),
        F.col("ts").cast("timestamp").alias("enriched_at"))
    folder, path = arrived(rows, "outcomes"), scratch_path(spark, "outcome-log")
    stream = spark.readStream.schema(N.OUTCOME).json(folder)
    run(N.start(stream, N.write_outcomes(path), scratch_path(spark, "progress")))
    T.compact(spark, path, N.OUTCOME, ["external_id"], ["enriched_at"])
    return N.outcomes(spark, path).select("external_id", "enrichment_status", "enrichment_error")


# ------------------------------------------------------------------ stateful streams

CUT = "2024-01-15 00:00:00"
DELAY_US = 3_600_000_000  # how late a viewing may come


def in_two_arrivals(rows: DataFrame, at: str, build: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """What a stateful stream stored of rows that arrive in two runs, before and after ``CUT``: the second
    run begins with the state and the watermark of the first. ``batch`` tells when a row was stored."""
    spark = rows.sparkSession
    folder, out, progress = (scratch_path(spark, f"{name}-{x}") for x in ("in", "out", "progress"))
    schema = rows.schema
    cut = F.lit(CUT).cast("timestamp")
    for part in (rows.where(F.col(at) < cut), rows.where(F.col(at) >= cut)):
        part.write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(folder)
        stream = build(spark.readStream.schema(schema).json(folder))
        run(N.start(stream, lambda df, batch: T.write_batch(df, out, batch), progress))
    return spark.read.parquet(out)


@query("n02_first_seen_stream", f"""select content_id, case when min(watched_at) < timestamp '{CUT}' then 1 else 2 end::int as llegada, 1::bigint as veces
  from watch_v group by 1""")
def n02_stream(spark, sf):
    """Items by the arrival that brought them first; the second arrival's repeats meet the state of the first."""
    rows = V.watches(spark, sf).select(F.col("content_id").alias("video_id"), F.col("watched_at").alias("tracked_at"))
    seen = in_two_arrivals(rows, "tracked_at", lambda s: N.first_seen(s, "60 days"), "first-seen")
    early = F.col("tracked_at") < F.lit(CUT).cast("timestamp")
    return seen.groupBy(F.col("video_id").alias("content_id")).agg(
        F.min(F.when(early, 1).otherwise(2)).alias("llegada"), F.count(F.lit(1)).alias("veces"))


@query("n04_timed_out_work", f"""select item, us as started, 'enriquecimiento_incompleto' as motivo from fired""", f"""
steps_v as materialized (select item, us, done, row_number() over (partition by item order by us, done) as k from (
  select distinct user_id as item, epoch_us(ts) as us, event_type = 'view' as done from events)),
walk as (
  select item, k, case when done then null else us end as open, null::bigint as gone from steps_v where k = 1
  union all
  select s.item, s.k, case when s.done then null when w.open is null or s.us - w.open > {N.GIVE_UP_SECONDS * 40} * 1000000::bigint then s.us else w.open end,
    case when s.us - w.open > {N.GIVE_UP_SECONDS * 40} * 1000000::bigint then w.open end
  from walk w join steps_v s on s.item = w.item and s.k = w.k + 1),
fired as (
  select item, gone as us from walk where gone is not null
  union all
  select item, open from walk qualify row_number() over (partition by item order by k desc) = 1
    and open is not null and open // 1000 + {N.GIVE_UP_SECONDS * 40} * 1000 <= (select max(us) // 1000 from steps_v))""")
def n04(spark, sf):
    """Work that began with any event and was not ended by a view in time, from timers that fire and rows that come late."""
    rows = V.table(spark, sf, "events").select(
        F.col("user_id").alias("item"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") == "view").alias("done"))
    return in_two_arrivals(rows, "at", lambda s: N.time_out(s, N.GIVE_UP_SECONDS * 40), "time-out").select("item", "started", "motivo")


def _passed(end: str) -> str:
    """The stream stores a window when the watermark has passed its end."""
    return f"epoch_us({end}) // 1000 <= (select max(epoch_us(watched_at)) // 1000 - {DELAY_US // 1000} from watch_v)"


@query("n07_burst_stream", f"""select user_id, {stamp.sql('desde')} as desde, {stamp.sql('hasta')} as hasta, videos from (
  select user_id, min(watched_at) as desde, max(watched_at) + interval 30 minute as hasta, count(*)::bigint as videos from (
    select *, sum(coalesce((gap_us >= 1800000000)::int, 1)) over (partition by user_id order by watched_at, event_id rows unbounded preceding) as b from gap_v)
  group by user_id, b) where {_passed('hasta')}""", DIET_SQL)
def n07_stream(spark, sf):
    """Viewing bursts as session windows that were closed by the watermark."""
    rows = V.watches(spark, sf).select("user_id", "watched_at")
    found = in_two_arrivals(rows, "watched_at", N.burst_windows, "bursts")
    return found.select("user_id", stamp("start").alias("desde"), stamp("end").alias("hasta"), "videos")


@query("n08_daily_stream", f"""select user_id, dia, videos, minutos from (
  select user_id, dieta_dia as dia, count(*)::bigint as videos, {rounded('sum(dieta_minutos)', 6)} as minutos from diet_v group by 1, 2)
  where cast(dia as timestamp) + interval 1 day <= (select to_timestamp((max(epoch_us(watched_at)) // 1000 - {DELAY_US // 1000}) / 1e3) at time zone 'Europe/Paris' from watch_v)""", DIET_SQL)
def n08_stream(spark, sf):
    """Viewings and minutes of local days that were closed by the watermark."""
    rows = watched(spark, sf).select("user_id", "watched_at", "minutos")
    found = in_two_arrivals(rows, "watched_at", N.day_windows, "days")
    return found.select("user_id", "dia", "videos", "minutos")


# ------------------------------------------------------------------ gold rows

DAY = "2026-01-0{} 00:00:00"


@query("n09_gold_maintenance", f"""select g.content_id as content_item_id, case when g.content_id % 2 = 0 and (g.content_id % 5 = 0 or g.content_id % 3 = 0 or not g.apt)
   then '{DAY.format(4)}' else '{DAY.format(2)}' end as computed_at, g.apt as apto,
  case when n = 0 then 'sin_transcripcion' when not complete then 'transcripcion_incompleta' when category_id is null then 'sin_metadatos' end as motivo_no_apto,
  nullif(len(list_filter(regexp_split_to_array(trim(transcript, E' \\t\\n\\r'), '\\s+'), lambda w: w <> '')), 0)::bigint as n_words, p.ritmo_ppm_pct, p.mattr_200_pct
  from gate g left join (select content_id, max(percentil) filter (descriptor = 'ritmo_ppm') as ritmo_ppm_pct,
   max(percentil) filter (descriptor = 'mattr_200') as mattr_200_pct from placed group by content_id) p using (content_id)
  where corpus = 'historial' and (g.content_id % 5 <> 0 or g.content_id % 2 = 0)""", PLACED)
def n09(spark, sf):
    """Stored panels over two runs: the second brings new items, items whose transcript was fetched again, and
    items that are stored and fresh, which are not computed again."""
    items = V.content(spark, sf).where("corpus = 'historial'").withColumnRenamed("content_id", "id").drop("corpus")
    scale, one = reference_scale(spark, sf), F.col("id")
    day = lambda k: F.lit(DAY.format(k)).cast("timestamp")
    first = items.where(one % 5 != 0).withColumn("transcript_fetched_at", day(1))
    second = items.where(one % 2 == 0).withColumn("transcript_fetched_at", F.when(one % 3 == 0, day(3)).otherwise(day(1)))
    empty = spark.createDataFrame([], first.schema)
    gold = P.gold_rows(P.panel_rows(describe(N.with_strata(empty), L.STAND_IN_LEXICONS), scale, "id"), day(1), key="id").schema
    folder, path, progress = (scratch_path(spark, f"gold-{x}") for x in ("in", "log", "progress"))
    for rows, at in ((first, day(2)), (second, day(4))):
        rows.write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(folder)
        stream = spark.readStream.schema(first.schema).json(folder)
        run(N.start(stream, N.maintain_gold(path, scale, gold, L.STAND_IN_LEXICONS, computed_at=at), progress))
    now = T.current(T.read_log(spark, path, gold), ["content_item_id"], ["computed_at"])
    return now.select("content_item_id", F.date_format("computed_at", "yyyy-MM-dd HH:mm:ss").alias("computed_at"), "apto", "motivo_no_apto",
                      F.col("n_words").cast("long").alias("n_words"), "ritmo_ppm_pct", "mattr_200_pct")
