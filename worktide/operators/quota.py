"""A shared quota's readings: cohorts of one reset, stale readings, adjacent pairs.

Readings are account-wide, so two or three streams hold all of them. Nothing here
windows a stream in one task: cohort facts are aggregates, and running values go
through `scan` in daily chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worktide.functions.time import micros
from worktide.operators.anchors import greedy_anchors
from worktide.operators.scan import latest, running_max, running_sum, scan, time_chunk
from worktide.session import materialise

# Fixed value: resets this close (seconds) to an earlier one are the same reset.
RESET_JITTER = 10


def stream_of() -> Column:
    return F.to_json(F.struct("bucket", "plan_type"), {"ignoreNullFields": "false"})


def quota_select(
    quota: DataFrame, limit_id: str, window_minutes: int, end: Column | None = None
) -> DataFrame:
    """Exact-distinct readings of one limit and window; all history before `end`."""
    if window_minutes <= 0:
        raise ValueError("quota window must be positive")
    chosen = quota.where(
        (F.col("limit_id") == limit_id) & (F.col("window_minutes") == window_minutes)
    )
    if end is not None:
        chosen = chosen.where(F.col("at") < end)
    return chosen.dropDuplicates(
        ["at", "limit_id", "plan_type", "bucket", "window_minutes", "resets_at", "used_percent"]
    ).withColumn("stream", stream_of())


def reset_cohorts(selected: DataFrame) -> DataFrame:
    """(stream, resets_at, cohort): the anchor each reset belongs to.

    A reset joins the first-seen anchor within the jitter, or becomes one. Resets that keep
    moving by a few seconds are one chain; it is decided block by block, see anchors.
    """
    values = selected.groupBy("stream", "resets_at").agg(F.min("at").alias("first_at"))
    return greedy_anchors(values, "stream", "resets_at", "first_at", RESET_JITTER).withColumnRenamed("anchor", "cohort")


def quota_moments(selected: DataFrame, cohorts: DataFrame) -> DataFrame:
    """One row per (stream, at). Two cohorts or two percentages at once conflict."""
    return (
        selected.join(cohorts, ["stream", "resets_at"])
        .groupBy("stream", "bucket", "plan_type", "at")
        .agg(
            F.min("cohort").alias("cohort"),
            ((F.min("cohort") != F.max("cohort"))
             | (F.min("used_percent") != F.max("used_percent"))).alias("conflict"),
            F.min("used_percent").alias("used_percent"),
            F.min("resets_at").alias("resets_at"),
        )
    )


def judge_readings(moments: DataFrame) -> DataFrame:
    """Verdict on every moment: conflict, retired, stale or accepted.

    A cohort is retired once a newer one has been seen, and a reading below an
    earlier one of its cohort is stale. Accepted readings carry the reading before
    them (`previous`), unless a conflict lies between.
    """
    moments = materialise(moments)
    # One row per cohort and stream: its first clean reading, and the next cohort's.
    seen = (
        moments.where("NOT conflict").groupBy("stream", "cohort").agg(F.min("at").alias("seen_at"))
    )
    retire = seen.select(
        "stream", "cohort",
        F.lead("seen_at").over(Window.partitionBy("stream").orderBy("seen_at")).alias("retired_at"),
    )
    counted = scan(
        moments.withColumn("chunk", time_chunk(micros(F.col("at")))), ["stream"], "chunk", ["at"],
        conflicts=running_sum(F.col("conflict").cast("bigint")),
    ).join(retire, ["stream", "cohort"], "left")
    live = materialise(
        counted.withColumn(
            "verdict",
            F.when(F.col("conflict"), "conflict").when(F.col("at") >= F.col("retired_at"), "retired"),
        )
    )
    high = scan(
        live.where("verdict IS NULL"), ["stream", "cohort"], "chunk", ["at"],
        high=running_max(F.col("used_percent"), inclusive=False),
    ).withColumn(
        "verdict",
        F.when(F.col("used_percent") < F.col("high"), "stale").otherwise("accepted"),
    )
    judged = materialise(high.drop("high"))
    paired = scan(
        judged.where("verdict = 'accepted'"), ["stream", "cohort"], "chunk", ["at"],
        before=latest(F.struct("at", "used_percent", "conflicts"), inclusive=False),
    ).withColumn(
        "previous",
        F.when(
            F.col("before.conflicts") == F.col("conflicts"),
            F.struct("before.at", "before.used_percent"),
        ),
    ).drop("before")
    none = F.lit(None).cast(paired.schema["previous"].dataType)
    rest = live.where("verdict IS NOT NULL").unionByName(judged.where("verdict = 'stale'"))
    return paired.unionByName(rest.withColumn("previous", none)).drop(
        "conflict", "chunk", "retired_at", "conflicts"
    )


def classify_pairs(
    judged: DataFrame, start: Column, end: Column, tz: str, max_gap_seconds: int
) -> DataFrame:
    """Pairs ending in the period: boundary, gap or candidate, with their points."""
    if max_gap_seconds <= 0:
        raise ValueError("maximum gap must be positive")
    day = F.to_date(F.from_utc_timestamp("at", tz))
    before = F.col("previous.at")
    kind = (
        F.when(before.isNull(), F.lit(None).cast("string"))
        .when((before < start) | (F.to_date(F.from_utc_timestamp(before, tz)) != day), "boundary")
        .when(micros(F.col("at")) - micros(before) > max_gap_seconds * 1_000_000, "gap")
        .otherwise("candidate")
    )
    return judged.where(
        (F.col("verdict") == "accepted") & (F.col("at") >= start) & (F.col("at") < end)
    ).withColumns(
        {
            "day": day,
            "kind": kind,
            "points": F.col("used_percent") - F.col("previous.used_percent"),
        }
    )


def latest_reading(accepted: DataFrame) -> DataFrame:
    """Newest accepted reading; two different ones at that instant leave it open."""
    body = F.struct("bucket", "plan_type", "resets_at", "used_percent")
    newest = (
        accepted.groupBy("at").agg(F.min(body).alias("low"), F.max(body).alias("body"))
        .orderBy(F.col("at").desc()).limit(1)
    )
    same = F.col("low") == F.col("body")
    return newest.select(
        "at",
        *[F.when(same, F.col(f"body.{n}")).alias(n)
          for n in ("bucket", "plan_type", "resets_at", "used_percent")],
        F.when(same, 100 - F.col("body.used_percent")).alias("remaining_percent"),
        F.when(same, F.array().cast("array<string>"))
        .otherwise(F.array(F.lit("ambiguous_latest_quota"))).alias("quality"),
    )
