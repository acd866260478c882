"""Caption files to transcript segments, and segments to transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from contentgauge.functions.numbers import half_even

JSON3 = "events ARRAY<STRUCT<tStartMs: BIGINT, dDurationMs: BIGINT, segs: ARRAY<STRUCT<utf8: STRING>>>>"
NOISE = r"\[[^\]]{0,40}\]|\([^)]{0,40}\)|♪[^♪]*♪"
CUE_HEADERS = ("WEBVTT", "Kind:", "Language:", "NOTE")


def read_json3(spark: SparkSession, path: str) -> DataFrame:
    """(file, text, start, duration) from json3 caption files; empty events dropped."""
    files = spark.read.schema(JSON3).option("multiLine", True).json(path)
    return json3_segments(files.select(F.input_file_name().alias("file"), "events"), ["file"])


def json3_segments(df: DataFrame, keys: list[str]) -> DataFrame:
    """The same from a parsed ``events`` column."""
    events = df.select(*keys, F.posexplode("events").alias("pos", "e"))
    text = F.trim(F.array_join(F.transform("e.segs", lambda s: F.coalesce(s["utf8"], F.lit(""))), ""))
    seconds = lambda c: half_even(F.coalesce(F.col(c), F.lit(0)) / 1000.0, 2)
    return events.select(*keys, "pos", text.alias("text"), seconds("e.tStartMs").alias("start"),
                         seconds("e.dDurationMs").alias("duration")).where("text <> ''")


def clock_seconds(stamp: Column) -> Column:
    """[HH:]MM:SS.mmm to seconds; a comma may stand for the point."""
    parts = F.transform(F.reverse(F.split(F.replace(stamp, F.lit(","), F.lit(".")), ":")), lambda p: p.cast("double"))
    part = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(0.0))
    return part(2) * 3600.0 + part(1) * 60.0 + part(0)


def read_cues(spark: SparkSession, path: str) -> DataFrame:
    """(file, cue, text, start, duration) from cue files. Each file is one row and is cut
    into lines inside it, so line order does not depend on how files are split."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    lines = files.select("file", F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("at", "line"))
    return cue_segments(lines, "file")


def cue_segments(lines: DataFrame, key: str) -> DataFrame:
    """Cues from numbered lines (key, at, line).

    A timing line opens a cue. Its text lines lose their tags; headers go; a line equal
    to the one before it in the cue is dropped. A file is bounded, so the running count
    of timing lines is taken per file.
    """
    line = F.trim("line")
    timing = F.contains(line, F.lit("-->"))
    order = Window.partitionBy(key).orderBy("at")
    marked = lines.select(key, "at", line.alias("line"), timing.alias("timing"),
                          F.sum(timing.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("cue"))
    sides = F.split("line", "-->")
    stamp = lambda i: F.split(F.trim(F.get(sides, F.lit(i))), " ")[0]
    times = marked.where("timing").select(key, "cue", clock_seconds(stamp(0)).alias("_a"), clock_seconds(stamp(1)).alias("_b"))
    header = F.lit(False)
    for h in CUE_HEADERS:
        header = header | F.startswith("line", F.lit(h))
    text = marked.where(~F.col("timing") & (F.col("line") != "") & ~header & (F.col("cue") > 0)).withColumn(
        "clean", F.regexp_replace("line", "<[^>]+>", "")).where("clean <> ''")
    before = F.lag("clean").over(Window.partitionBy(key, "cue").orderBy("at"))
    kept = text.withColumn("_before", before).where(~F.col("clean").eqNullSafe(F.col("_before")))
    joined = kept.groupBy(key, "cue").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("at", "clean"))), lambda s: s["clean"]), " ").alias("text"))
    return joined.join(times, [key, "cue"]).select(
        key, "cue", "text", half_even(F.col("_a"), 2).alias("start"), half_even(F.col("_b") - F.col("_a"), 2).alias("duration"))


def clean_transcript(text: Column) -> Column:
    """Without [..], (..) and note marks, white space squeezed; empty becomes null."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(text, NOISE, " "), r"\s+", " ")), F.lit(""))


def assemble(segments: DataFrame, key: str, start: str = "start_s", text: str = "text", generated: Column | None = None) -> DataFrame:
    """One transcript per item from its segments in order of time.

    The result is one string per item, so an item's segments have to meet in one task.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(start).alias("s"), F.col(text).alias("t"))))
    joined = segments.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), " ").alias("_raw"))
    out = joined.select(key, clean_transcript(F.col("_raw")).alias("transcript"))
    source = F.when(generated, "youtube_auto").otherwise("youtube_manual") if generated is not None else F.lit("youtube_manual")
    return out.withColumn("transcript_source", F.when(F.col("transcript").isNotNull(), source))


def content_text(plain: Column, parts: Column) -> Column:
    """Text of an answer that is either one string or an array of parts with ``text``."""
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), " ")
    return F.trim(F.regexp_replace(F.coalesce(plain, joined, F.lit("")), r"\s+", " "))
