"""Places of rows in an order, without a window that holds a whole key."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.sources.tables import scratch


def placed(df: DataFrame, keys: Sequence[str], *order: str | Column, name: str = "i") -> DataFrame:
    """``df`` with each row's place among those of its keys, from 0.

    One sort, written once so that its ranges stay as they are, deals rows to partitions whatever key has how many; a row's place is its
    place in its partition, moved on by what the partitions before hold of its keys.
    """
    path = f"{scratch(df.sparkSession)}/placed-{uuid.uuid4().hex}"
    id_ = F.monotonically_increasing_id()
    df.orderBy(*keys, *order).select("*", F.shiftright(id_, 33).alias("_part"), id_.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    parts = rows.groupBy(*keys, "_part").agg(F.min("_at").alias("_low"), F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    parts = parts.select(*keys, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_low")).alias("_shift"))
    return rows.join(parts, [*keys, "_part"]).withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")
