"""The driver tables seen as content, watch, segment, rater and quiz tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def size(spark: SparkSession, folder: str, name: str):
    """Rows of a table, as a value inside a plan."""
    return table(spark, folder, name).agg(F.count(F.lit(1))).scalar()


def content(spark: SparkSession, folder: str) -> DataFrame:
    """Items. Descriptions come from the pages, dealt over the documents."""
    docs = table(spark, folder, "documents").withColumn("_page", F.col("doc_id") % size(spark, folder, "pages"))
    pages = table(spark, folder, "pages").select("page_id", "url")
    d = docs.join(pages, F.col("_page") == F.col("page_id"), "left")
    doc_id = F.col("doc_id")
    return d.select(
        doc_id.alias("content_id"),
        F.col("text").alias("transcript"),
        F.col("source").alias("channel"),
        F.col("lang").alias("transcript_lang"),
        "n_chars",
        F.floor(F.col("n_chars").cast("double") * 10.0 / (30 + (doc_id * 37) % 300)).cast("int").alias("duration_seconds"),
        F.substring("text", 1, 60).alias("title"),
        F.col("url").alias("description"),
        F.when(doc_id % 17 == 0, None).when(doc_id % 15 == 14, "29").when(doc_id % 4 == 0, "25")
        .when(doc_id % 4 == 1, "26").when(doc_id % 4 == 2, "24").otherwise("20").alias("category_id"),
        F.when((doc_id % 4 == 3) | (doc_id % 11 == 0), "historial").otherwise("referencia").alias("corpus"),
        F.when(doc_id % 5 == 0, 3).when(doc_id % 7 == 0, None).otherwise(0).cast("int").alias("n_chapters"),
    )


def watches(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").where("event_type = 'view'").select(
        "event_id", "user_id", (F.col("event_id") % size(spark, folder, "documents")).alias("content_id"),
        F.col("ts").cast("timestamp").alias("watched_at"),
    )


def segments(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("content_id"), (F.col("turn") * 17.0).cast("double").alias("start_s"), "text"
    )


def raters(spark: SparkSession, folder: str) -> DataFrame:
    yes = lambda c: F.when(F.col(c) == 1, "si").otherwise("no")
    return table(spark, folder, "labels").select(
        F.col("doc_id").alias("content_id"), yes("quality").alias("a"), yes("toxic").alias("b")
    )


def questions(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("item_id")
    return table(spark, folder, "benchmark").select(
        i.alias("pregunta_id"), (i % size(spark, folder, "documents")).alias("content_id"), (i % 4).cast("int").alias("correcta"),
        (i % 9 != 0).alias("utilizable"), (i % 3 == 0).alias("linea_base_acerto"), (i % 3 != 0).alias("dificil"),
    )


def answers(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, folder, "events").where("event_type = 'click'").select(
        F.col("user_id").alias("persona_id"), (e % size(spark, folder, "benchmark")).alias("pregunta_id"),
        (F.floor("value").cast("int") % 4).alias("eleccion"),
        F.col("ts").cast("timestamp").alias("respondido_at"), (e % 14).alias("dias"),
    )


# The same tables for the oracle.
SQL_VIEWS = """
content_v as (
select d.doc_id as content_id, d.text as transcript, d.source as channel, d.lang as transcript_lang, d.n_chars,
  cast(floor(d.n_chars * 10.0 / (30 + (d.doc_id * 37) % 300)) as int) as duration_seconds,
  substring(d.text, 1, 60) as title, p.url as description,
  case when d.doc_id % 17 = 0 then null
       when d.doc_id % 15 = 14 then '29'
       when d.doc_id % 4 = 0 then '25' when d.doc_id % 4 = 1 then '26'
       when d.doc_id % 4 = 2 then '24' else '20' end as category_id,
  case when d.doc_id % 4 = 3 or d.doc_id % 11 = 0 then 'historial' else 'referencia' end as corpus,
  case when d.doc_id % 5 = 0 then 3 when d.doc_id % 7 = 0 then null else 0 end as n_chapters
from documents d left join pages p on p.page_id = d.doc_id % (select count(*) from pages)),
watch_v as (
select event_id, user_id, event_id % (select count(*) from documents) as content_id, ts as watched_at from events where event_type = 'view'),
segment_v as (
select conv_id as content_id, cast(turn * 17.0 as double) as start_s, text from conversations),
rater_v as (
select doc_id as content_id, case when quality = 1 then 'si' else 'no' end as a,
  case when toxic = 1 then 'si' else 'no' end as b from labels),
question_v as (
select item_id as pregunta_id, item_id % (select count(*) from documents) as content_id, cast(item_id % 4 as int) as correcta,
  item_id % 9 <> 0 as utilizable, item_id % 3 = 0 as linea_base_acerto, item_id % 3 <> 0 as dificil from benchmark),
answer_v as (
select user_id as persona_id, event_id % (select count(*) from benchmark) as pregunta_id, cast(floor(value) as int) % 4 as eleccion,
  ts as respondido_at, event_id % 14 as dias from events where event_type = 'click')"""
