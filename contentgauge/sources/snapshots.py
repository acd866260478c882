"""Snapshot readers and sinks: dashboard rows, CSV and JSON outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from contentgauge.functions import lexicons as L
from contentgauge.functions.numbers import half_even

DASHBOARD = ["titulo", "canal", "formato", "fecha", "minutos", "palabras", *[f"p{i}" for i in range(8)]]
DASHBOARD_TYPES = ["string", "string", "string", "string", "double", "int"] + ["int"] * 8


def complete_panel(panel: Column) -> Column:
    """The panel, or an error when a descriptor is missing."""
    keys = F.transform(panel, lambda e: e["clave"])
    absent = F.array_except(F.expr(f"array({', '.join(repr(d) for d in L.PANEL)})"), keys)
    return F.when(F.size(absent) == 0, panel).otherwise(
        F.raise_error(F.concat(F.lit("panel without "), F.array_join(absent, ", "))))


def dashboard_rows(rows: DataFrame, keep: Sequence[str] = (), zone: str = "Europe/Paris") -> DataFrame:
    """Title, channel, format, local day, minutes, words and eight whole percentiles."""
    whole = rows.withColumn("panel", complete_panel(F.col("panel")))
    table = F.map_from_entries(F.transform("panel", lambda e: F.struct(e["clave"], e["percentil"])))
    whole = whole.withColumn("_p", table)
    day = F.date_format(F.from_utc_timestamp("watched_at", zone), "yyyy-MM-dd")
    return whole.select(
        *keep, F.coalesce(F.nullif("title", F.lit("")), F.lit("(sin titulo)")).alias("titulo"),
        F.coalesce(F.nullif("channel", F.lit("")), F.lit("(sin canal)")).alias("canal"), "formato", day.alias("fecha"),
        half_even(F.coalesce("duration_seconds", F.lit(0)) / 60.0, 1).alias("minutos"),
        F.col("n_words").cast("int").alias("palabras"),
        *[F.rint(F.try_element_at("_p", F.lit(d))).cast("int").alias(f"p{i}") for i, d in enumerate(L.PANEL)],
    )


def read_dashboard(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of 14-element arrays, as named columns."""
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.explode(F.from_json("value", "array<array<string>>")).alias("r"))
    return rows.select(*[F.col("r")[i].cast(t).alias(n) for i, (n, t) in enumerate(zip(DASHBOARD, DASHBOARD_TYPES))])


def write_dashboard(rows: DataFrame, path: str, per_file: int = 1_000) -> None:
    """The columns of ``DASHBOARD`` as files of about ``per_file`` rows, each a JSON array of arrays."""
    files = max(1, -(-rows.count() // per_file))
    place = F.pmod(F.xxhash64(*DASHBOARD), F.lit(files)).alias("file")
    text = F.concat(F.lit("["), F.array_join(F.collect_list("r"), ","), F.lit("]")).alias("value")
    values = [F.coalesce(F.to_json(F.array(F.col(c))), F.lit("[null]")) for c in DASHBOARD]
    row = F.concat(F.lit("["), F.array_join(F.array(*[F.substring(v, F.lit(2), F.length(v) - 2) for v in values]), ","), F.lit("]")).alias("r")
    rows.select(place, row).groupBy("file").agg(text).write.mode("overwrite").partitionBy("file").text(path)


def read_items_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An item export: header, quoted line breaks, doubled quotes."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"')


def without_nan(df: DataFrame) -> DataFrame:
    """NaN and infinities of every floating column become null."""
    floats = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float")]
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    return df.withColumns({c: F.when(~bad(F.col(c)), F.col(c)) for c in floats}) if floats else df


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("sep", sep).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    without_nan(df).write.mode(mode).json(path)


def append_report(df: DataFrame, path: str) -> None:
    """One more batch of run metrics; every part file carries the header."""
    write_csv(df, path, mode="append")
