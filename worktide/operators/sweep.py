"""Covered time as one sweep over all instants, dealt out by range.

How long spans cover a window is the difference of two readings of a running integral. All
steps and readings are sorted by key and instant, cut by range into parts of like size, summed
within parts, and each part is raised by the total of those before it. Spans of a key end
within it, so what other keys add to the integral is the same at both readings of a window
and falls out: no key needs a task of its own, be it one for all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worktide.functions.time import micros
from worktide.session import materialise


def running_totals(rows: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """The columns `names` replaced by their running sums over all rows in the order of `by`."""
    placed = materialise(rows.repartitionByRange(*by).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy(*by)
    # One row for each part: as many as the shuffle has partitions.
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("part").agg(*[F.sum(n).alias(n) for n in names]).select(
        "part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__{n}") for n in names])
    near = placed.select(*[c for c in placed.columns if c not in names],
                         *[F.sum(n).over(inside).alias(n) for n in names])
    return near.join(parts, "part").select(
        *[c for c in rows.columns if c not in names], *[(F.col(n) + F.col(f"__{n}")).alias(n) for n in names])


def covered_time(spans: DataFrame, windows: DataFrame, keys: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """(keys, labels, micros): how long spans of the same keys cover the windows of each label.

    `spans` has (keys, start, end) and counts as often as spans lie over each other; `windows` has
    (keys, labels, start, end, sign), whose sign is 1, or -1 for time to be taken off again.
    Only labels with covered time are given. A row costs what its two ends cost.
    """
    def ends(df: DataFrame, columns: Sequence[str], sign) -> DataFrame:
        edges = F.array(F.struct(micros(F.col("start")).alias("p"), sign.alias("step")),
                        F.struct(micros(F.col("end")).alias("p"), (-sign).alias("step")))
        rows = df.where(F.col("end") > F.col("start")).select(*columns, F.explode(edges).alias("edge"))
        return rows.groupBy(*columns, "edge.p").agg(F.sum("edge.step").alias("step")).where("step <> 0")

    whole, none = "decimal(28,0)", F.lit(0).cast("decimal(28,0)")
    steps = ends(spans, keys, F.lit(1).cast("long")).select(
        *keys, "p", F.col("step").cast("decimal(20,0)").alias("depth"),
        (F.col("step") * F.col("p").cast("decimal(20,0)")).cast(whole).alias("offset"))
    readings = ends(windows, [*keys, *labels], -F.col("sign").cast("long"))
    label = F.struct(*[F.col(c) for c in labels])
    readings = readings.select(*keys, "p", none.cast("decimal(20,0)").alias("depth"), none.alias("offset"),
                               label.alias("label"), F.col("step").alias("sign"))
    kind = readings.schema["label"].dataType
    rows = steps.withColumns({"label": F.lit(None).cast(kind), "sign": F.lit(0).cast("long")}).unionByName(readings)
    swept = running_totals(rows, [*keys, "p"], ["depth", "offset"]).where("sign <> 0")
    # A reading counts minus at the start of a window and plus at its end, so often as windows share it.
    covered = F.col("depth") * F.col("p").cast("decimal(20,0)") - F.col("offset")
    return swept.groupBy(*keys, "label").agg((F.sum(covered * F.col("sign"))).cast("bigint").alias("micros")).where(
        "micros > 0").select(*keys, "label.*", "micros")
