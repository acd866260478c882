"""Tables kept as a log of batches.

Every micro-batch owns one folder and overwrites it whole, so a batch that runs again
after a failure leaves the same rows. Readers take the latest row of every key; nothing
stored before is rewritten when a batch arrives.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from contentgauge.operators.skew import latest_per_key

BUCKETS = 64


def bucket_of(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(BUCKETS)).cast("int")


def write_batch(df: DataFrame, path: str, batch_id: int, key: str | None = None) -> None:
    """One batch; with a ``key`` its rows lie in folders by the key's hash."""
    target = f"{path}/batch={batch_id}"
    if key is None:
        df.write.mode("overwrite").parquet(target)
    else:
        df.withColumn("bucket", bucket_of(key)).write.mode("overwrite").partitionBy("bucket").parquet(target)


def read_log(spark: SparkSession, path: str, schema: StructType | str, keys: DataFrame | None = None) -> DataFrame:
    """All batches, or an empty table before the first one.

    ``keys`` (one column, the key the log was written with): only the folders these keys can lie
    in are read, so a micro-batch with few keys does not read the whole log.
    """
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    try:
        stored = spark.read.schema(fields).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], fields).withColumn("batch", F.lit(0).cast("long"))
    if keys is not None and "bucket" in stored.columns:
        wanted = [r[0] for r in keys.select(bucket_of(keys.columns[0])).distinct().collect()]  # BUCKETS numbers at most
        stored = stored.where(F.col("bucket").isin(wanted))
    return stored.select(*fields.fieldNames(), F.col("batch").cast("long").alias("batch"))


def current(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The latest row of every key."""
    return latest_per_key(log, keys, [F.col(c) for c in (*order, "batch")]).drop("batch")


def compact(spark: SparkSession, path: str, schema: StructType | str, keys: Sequence[str], order: Sequence[str]) -> None:
    """Leave the current rows only, as a batch older than any that follows.

    Run it between batches. The folders it replaces go after it is written; until then, and if it
    breaks off, their rows are repeated, which readers of the latest row do not see.
    """
    log = read_log(spark, path, schema)
    last = log.agg(F.max(F.abs("batch"))).first()[0]
    if last is None:
        return
    old = [r[0] for r in log.select("batch").distinct().collect()]  # a number per folder
    write_batch(current(log, keys, order), path, -(last + 1), keys[0])
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for batch in old:
        files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={batch}"), True)
