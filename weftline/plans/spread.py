"""Enough tasks for work that costs more than its bytes tell."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Spark reads no split smaller than this, so a table of fewer bytes than this a core leaves cores idle.
LEAST_SPLIT = 4 << 20


def spread(df: DataFrame, source: DataFrame) -> DataFrame:
    """``df``, a selection of ``source``, over all cores where the estimated size of the source would fill fewer tasks; unchanged otherwise, so nothing large is ever shuffled for this."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * LEAST_SPLIT else df
