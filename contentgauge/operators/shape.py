"""Shaping a plan: expressions made once, small inputs spread over all cores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SMALL_BYTES = 1 << 30


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed exactly once per row.

    A filter on a derived column is moved below the projection that made it, with the
    expression copied into it: a text would be tokenised for the filter and again for
    the rows that pass. The output of a generator stays where it is, so the columns
    are made as the single element of an array.
    """
    packed = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(packed)))


def spread(df: DataFrame, limit: int = SMALL_BYTES) -> DataFrame:
    """Deal a small input out to every core before heavy per-row work.

    A file of one row group is read by one task however many cores are idle. Moving
    under a gigabyte costs little; a larger input has enough row groups and is left
    alone, so no text is shuffled at scale. Streams are left alone as well.
    """
    if df.isStreaming:
        return df
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    read = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if read >= limit:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
