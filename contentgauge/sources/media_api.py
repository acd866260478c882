"""Video-API and extractor answers as typed item columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from contentgauge.functions import strata
from contentgauge.functions.numbers import cap_width, iso_seconds
from contentgauge.operators.sampling import assign_strata, reject_reason

ITEM = """id STRING,
 snippet STRUCT<title: STRING, description: STRING, channelId: STRING, channelTitle: STRING, categoryId: STRING,
   publishedAt: STRING, tags: ARRAY<STRING>, defaultAudioLanguage: STRING, defaultLanguage: STRING>,
 contentDetails STRUCT<duration: STRING, regionRestriction: STRUCT<blocked: ARRAY<STRING>, allowed: ARRAY<STRING>>>,
 status STRUCT<privacyStatus: STRING>,
 statistics STRUCT<viewCount: STRING, likeCount: STRING, commentCount: STRING>"""

EXTRACTED = """id STRING, title STRING, channel STRING, uploader STRING, channel_id STRING, duration INT,
 description STRING, tags ARRAY<STRING>, categories ARRAY<STRING>, view_count BIGINT, like_count BIGINT,
 comment_count BIGINT, chapters ARRAY<STRUCT<title: STRING, start_time: DOUBLE, end_time: DOUBLE>>,
 upload_date STRING, language STRING"""


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """One API item per line."""
    return spark.read.schema(ITEM).json(path)


def read_extracted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXTRACTED).json(path)


def item_metadata(items: DataFrame) -> DataFrame:
    """Category name 'Other' by default, counts 0, date from the first ten characters,
    audio language before text language."""
    sn, stats = F.col("snippet"), F.col("statistics")
    count = lambda c: F.coalesce(stats[c].try_cast("bigint"), F.lit(0))
    category = F.coalesce(sn["categoryId"], F.lit(""))
    language = F.coalesce(F.nullif(sn["defaultAudioLanguage"], F.lit("")), F.nullif(sn["defaultLanguage"], F.lit("")))
    return items.select(
        F.col("id").alias("external_id"), F.coalesce(sn["description"], F.lit("")).alias("description"),
        F.coalesce(sn["tags"], F.array().cast("array<string>")).alias("tags"), category.alias("category_id"),
        strata.category_name(category, "Other").alias("category_name"), count("viewCount").alias("view_count"),
        count("likeCount").alias("like_count"), count("commentCount").alias("comment_count"),
        cap_width(sn["channelId"], 50).alias("channel_id"), sn["channelTitle"].alias("channel_title"),
        cap_width(language, 40).alias("video_language"),
        F.when(F.length(sn["publishedAt"]) >= 10, F.try_to_date(F.left(sn["publishedAt"], F.lit(10)), "yyyy-MM-dd")).alias("upload_date"),
        iso_seconds(F.col("contentDetails")["duration"]).alias("duration_seconds"),
    )


def candidates(items: DataFrame, source: str, seed: str) -> DataFrame:
    """Every item with its reason, strata and provenance; keep reason = 'ACEPTADO'."""
    sn = F.col("snippet")
    language = F.coalesce(F.nullif(sn["defaultAudioLanguage"], F.lit("")), F.nullif(sn["defaultLanguage"], F.lit("")))
    text = F.concat_ws(" ", F.coalesce(sn["title"], F.lit("")), F.left(F.coalesce(sn["description"], F.lit("")), F.lit(600)))
    flat = items.select(
        F.col("id").alias("external_id"), F.coalesce(F.nullif(sn["title"], F.lit("")), F.lit("(sin titulo)")).alias("title"),
        sn["channelTitle"].alias("channel"), sn["channelId"].alias("channel_id"),
        F.coalesce(sn["description"], F.lit("")).alias("description"),
        F.coalesce(sn["tags"], F.array().cast("array<string>")).alias("tags"), sn["categoryId"].alias("category_id"),
        iso_seconds(F.coalesce(F.col("contentDetails")["duration"], F.lit("")), True).alias("duration_seconds"),
        F.nullif(F.left(sn["publishedAt"], F.lit(10)), F.lit("")).alias("upload_date"),
        F.coalesce(F.lower(language), F.lit("es?")).alias("video_language"),
        F.lit(source).alias("sampling_source"), F.lit(seed).alias("sampling_seed"),
        (F.col("status")["privacyStatus"] == "public").alias("_public"),
        F.col("contentDetails")["regionRestriction"].isNotNull().alias("_restricted"),
        language.alias("_lang"), text.alias("_text"),
    )
    reason = reject_reason(F.col("_public"), F.col("_restricted"), F.col("duration_seconds"), F.col("category_id"),
                           F.col("_lang"), F.col("_text"))
    return assign_strata(flat.withColumn("reason", reason)).drop("_public", "_restricted", "_lang", "_text")


def extracted_metadata(infos: DataFrame) -> DataFrame:
    """Chapters as structs with their count, YYYYMMDD dates, category name to id."""
    name = F.get("categories", F.lit(0))
    chapters = F.coalesce("chapters", F.expr("cast(array() as array<struct<title:string,start_time:double,end_time:double>>)"))
    return infos.select(
        F.col("id").alias("external_id"), "title", F.coalesce(F.nullif("channel", F.lit("")), F.col("uploader")).alias("channel"),
        "channel_id", F.col("duration").alias("duration_seconds"), "description",
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), name.alias("category_name"),
        strata.category_id(name).alias("category_id"), "view_count", "like_count", "comment_count",
        chapters.alias("chapters"), F.size(chapters).alias("n_chapters"),
        F.when(F.length("upload_date") == 8, F.try_to_date("upload_date", "yyyyMMdd")).alias("upload_date"),
        F.col("language").alias("video_language"),
    )
