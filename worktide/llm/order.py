"""Places in a total order, without a window over a hot key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worktide.llm.frames import materialise

#: Spark numbers rows as partition << 33 | place in the partition.
PLACE_BITS = 33


def in_order(df: DataFrame, *by: str) -> DataFrame:
    """The rows in written, range-partitioned order with (`part`, `seq`), which sort as `by` does.

    Rows that tie in all of `by` stand next to each other in any order. The table is written,
    so that every reader sees the same places.
    """
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("seq", F.monotonically_increasing_id())
    return materialise(placed.withColumn("part", F.shiftright("seq", PLACE_BITS)))


def ranked(placed: DataFrame, key: str) -> DataFrame:
    """Add `at`, a row's number from 0 among those of its key, and `total`, how many these are.

    `placed` comes from in_order(), ordered by the key first. Only one row for each key and
    partition is windowed, so a key with all rows costs as many rows as it has partitions.
    """
    sizes = placed.groupBy(key, "part").agg(F.count(F.lit(1)).alias("rows"), F.min("seq").alias("first"))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(key, "part", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"),
                           F.sum("rows").over(Window.partitionBy(key)).alias("total"))
    return placed.join(offsets, [key, "part"]).withColumn(
        "at", F.col("seq") - F.col("first") + F.col("before")).drop("first", "before")
