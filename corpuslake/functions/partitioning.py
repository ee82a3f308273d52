"""Partitioning of scans."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: A table of more bytes has splits enough, or is too dear to exchange.
SMALL = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it is small and in fewer files than there are cores; else as it is.

    A small file may be one unsplittable row group.  The table's size is the optimiser's
    estimate, so nothing is read, and no table beyond ``SMALL`` bytes is ever exchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SMALL and len(df.inputFiles()) < cores else df
