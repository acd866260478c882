"""Derived tables the registered queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from contentgauge.functions import lexicons as L, strata
from contentgauge.operators import scale as S
from contentgauge.operators.indicators import describe
from contentgauge.operators.skew import histogram
from contentgauge.plans import views as V
from contentgauge.session import cut_lineage


def described(spark: SparkSession, folder: str, corpus: str | None = None) -> DataFrame:
    """Wide table with strata; the corpus filter is applied before any text work."""
    items = V.content(spark, folder)
    if corpus:
        items = items.where(F.col("corpus") == corpus)
    items = items.withColumns({
        "formato": strata.category_format(F.col("category_id")),
        "duracion": strata.duration_bucket(F.col("duration_seconds")),
        "category_name": strata.category_name(F.col("category_id")),
    })
    return describe(items, L.STAND_IN_LEXICONS)


def reference_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """The reference corpus as a histogram, written once per query."""
    return cut_lineage(S.value_histogram(described(spark, folder, "referencia")))


def reference_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(id, grupo, duracion, descriptor, value) of the measurable reference items, written once: the texts'
    only reading for the histogram and the test."""
    wide = described(spark, folder, "referencia").where("v_apto_panel = 1")
    renamed = wide.withColumnsRenamed({"content_id": "id", "formato": "grupo"})
    return cut_lineage(S.long_form(renamed, ["id", "grupo", "duracion"]))


def histogram_and_test(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The reference histogram, and the permutation test on the reference items with the scope decided."""
    rows = reference_rows(spark, folder)
    hist = cut_lineage(histogram(rows, ["descriptor", "grupo", "duracion"], "value"))
    by_group = hist.groupBy("descriptor", "grupo", "value").agg(F.sum("freq").alias("freq"))
    return hist.withColumnRenamed("grupo", "formato"), S.decide(S.permutation_test(rows, hist=by_group))


def tested(spark: SparkSession, folder: str) -> DataFrame:
    return histogram_and_test(spark, folder)[1]


def reference_scale(spark: SparkSession, folder: str) -> DataFrame:
    """Test, decision and scale."""
    hist, test = histogram_and_test(spark, folder)
    return cut_lineage(S.build_scale(hist, test))
