"""What several operators of this package share: stored tables and connected groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from contentgauge.session import scratch_path, ship

BLANK = r"[\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Before Python runs on the workers: send them this package, and bound what one batch of
    long texts takes."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


def store(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and go on from there.

    Cuts the lineage: what was computed survives lost executors and is not computed
    again by each of its readers. The shuffles of the plan are not read again once the table is there:
    Spark deletes their files then, not when the driver happens to collect garbage.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def store_texts(df: DataFrame, name: str) -> DataFrame:
    """As ``store``, for whole texts: half the disk for a little more work."""
    return store(df, name, "zstd")


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    spark = tables[0].sparkSession
    for folder in {f.rsplit("/", 1)[0] for df in tables for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def components(links: DataFrame, left: str = "a", right: str = "b", rounds: int = 40) -> DataFrame:
    """Connected groups of an undirected graph: (node, root), root the smallest node reached.

    Alternates two steps until nothing changes: every node hands the smallest node it
    knows to its larger neighbours, then to its smaller ones. Each step is one aggregate
    and one join, links stay distributed, and a round's links are a written table. The
    number of rounds grows with the logarithm of the graph; only nodes with a link appear.
    """
    edges = links.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b")
    edges = store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")

    def state(df):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"), F.col("a").alias("own"))
        small = small.select(F.explode(F.array(
            F.struct("a", "b"), F.struct(F.col("own").alias("a"), F.col("b"))
        )).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        old, edges = edges, store(small, "links")
        forget(old)
        now = state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("groups not settled")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
