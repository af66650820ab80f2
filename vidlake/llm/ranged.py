"""Tables dealt once into sorted partitions that stay: the ground of operators that work on neighbours."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from .common import shared_dir

#: Rows a sorted partition is meant to hold; the number of partitions grows with the table.
PART_ROWS = 200_000
#: Smaller tables are not cut finer than this.
LEAST_ROWS = 2_000


def sorted_parts(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` sorted over all by ``keys`` into fixed partitions, kept by checkpoint().

    Bounds come from a sample, so rows of a frequent first key spread as long
    as the further keys differ. Each partition keeps its number and its order
    in every later pass and on whichever executor it is read.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    rows, usual = df.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(math.ceil(rows / PART_ROWS), min(usual, math.ceil(rows / LEAST_ROWS)), 1)
    return df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).checkpoint()
