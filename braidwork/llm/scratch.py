"""Written intermediate tables in the folder that all executors share, and bounded batches."""

from __future__ import annotations

from pyspark.sql import DataFrame

from braidwork.session import release, shared_dir
from braidwork.session import written as cut

__all__ = ["cut", "release", "shared_dir", "small_batches"]


def small_batches(df: DataFrame, size: str = "4m") -> DataFrame:
    """df, after bounding the session's Arrow batches by bytes.

    The default of 64 MB a batch is held several times over in each task's
    off-heap memory; long texts and vectors reach it.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return df
