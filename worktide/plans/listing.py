"""The session list, with live work shown up to now."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktide.evidence import Evidence
from worktide.functions.labels import safe_text
from worktide.functions.time import is_fresh, local_date
from worktide.operators.attribution import latest_model
from worktide.operators.select import archive_filter, same_path, search_sessions
from worktide.plans.time_reports import root_work, union_flags

SORTS = {"updated": "updated", "created": "created", "time": "total_micros"}


def latest_samples(samples: DataFrame) -> DataFrame:
    return samples.groupBy("session_id").agg(
        F.max_by(F.struct("state", "at", "turn_id", "uncertainty_seconds"), "at").alias("o")
    ).select("session_id", "o.*")


def _fresh(now: datetime):
    limit = F.greatest(F.lit(3.0), F.col("uncertainty_seconds") * 1.25)
    return is_fresh(F.col("at"), F.lit(now), limit)


def live_extrapolation(ev: Evidence, samples: DataFrame, now: datetime) -> Evidence:
    """Extend the open turn of each freshly working session to `now`; for display only."""
    working = latest_samples(samples).where((F.col("state") == "working") & _fresh(now))
    candidates = ev.turns.where("end IS NULL").select(
        "session_id", F.col("id").alias("candidate"), "start"
    ).join(working, "session_id")
    # A sample that names its turn needs no search among open turns.
    named = F.col("turn_id").isNotNull()
    chosen = candidates.where(
        F.when(named, F.col("turn_id") == F.col("candidate")).otherwise(F.col("start") <= F.col("at"))
    ).groupBy("session_id", "at").agg(
        F.max_by("candidate", F.struct("start", "candidate")).alias("turn_id")
    )
    extra = chosen.select("session_id", "turn_id", F.col("at").alias("start"), F.lit(now).alias("end"))
    marked = ev.turns.join(
        chosen.select("session_id", F.col("turn_id").alias("id"), F.lit(True).alias("live")),
        ["session_id", "id"], "left",
    ).withColumn(
        "quality",
        F.when(
            F.col("live"), F.array_union("quality", F.array(F.lit("live_sample_estimate")))
        ).otherwise(F.col("quality")),
    ).select(ev.turns.columns)
    return ev.with_tables(turns=marked, coverage=ev.coverage.unionByName(extra))


def session_list(
    ev: Evidence,
    now: datetime,
    tz: str,
    *,
    samples: DataFrame | None = None,
    cwd: str | None = None,
    archive: str = "active",
    sort: str = "updated",
    query: str = "",
) -> DataFrame:
    """Sessions with state, time today and in all, quality and latest model, newest first."""
    chosen = search_sessions(ev.sessions, query).where(
        archive_filter(F.col("archived"), archive)
    )
    if cwd is not None:
        chosen = chosen.where(same_path(F.col("cwd"), cwd))
    shown = ev if samples is None else live_extrapolation(ev, samples, now)
    facts = root_work(shown, tz, models=True, selected=chosen)
    today = local_date(F.lit(now), tz)
    none = F.array().cast("array<string>")
    time = facts.groupBy("session_id").agg(
        F.sum("micros").alias("total_micros"),
        F.sum(F.when(F.col("day") == today, F.col("micros"))).alias("today_micros"),
        union_flags("quality").alias("work_quality"),
    )
    flags = ev.turns.groupBy("session_id").agg(
        union_flags("quality").alias("turn_quality"),
        F.max(F.col("end").isNull()).alias("unfinished"),
    )
    rows = (
        chosen.withColumnRenamed("id", "session_id")
        .join(time, "session_id", "left")
        .join(flags, "session_id", "left")
        .join(latest_model(ev.contexts).drop("at"), "session_id", "left")
    )
    if samples is None:
        rows = rows.withColumn("state", F.lit("unknown"))
    else:
        fresh = latest_samples(samples).where(_fresh(now)).select("session_id", "state")
        rows = rows.join(fresh, "session_id", "left").withColumn(
            "state", F.coalesce("state", F.lit("unknown"))
        )
    child = F.col("is_child") | F.col("parent_id").isNotNull()
    quality = F.array_sort(
        F.array_distinct(
            F.concat(
                "quality", F.coalesce("turn_quality", none), F.coalesce("work_quality", none),
                F.array_compact(
                    F.array(F.when(F.col("unfinished"), F.lit("unfinished")),
                            F.when(child, F.lit("child_excluded")))
                ),
            )
        )
    )
    title = F.when(F.trim("title") != "", F.trim("title")).otherwise(
        F.concat(F.lit("Session "), F.left("session_id", F.lit(8)))
    )
    zero = F.lit(0).cast("bigint")
    return rows.select(
        "session_id",
        safe_text(title).alias("title"),
        safe_text(F.col("cwd")).alias("cwd"),
        "state",
        "archived",
        F.coalesce("today_micros", zero).alias("today_micros"),
        F.coalesce("total_micros", zero).alias("total_micros"),
        F.when(F.size(quality) == 0, F.array(F.lit("observed"))).otherwise(quality).alias("quality"),
        "model_id",
        "reasoning_level",
        "created",
        "updated",
    ).orderBy(F.col(SORTS[sort]).desc(), F.col("session_id").desc())


def top_sessions(rows: DataFrame, count: int = 20) -> tuple[DataFrame, DataFrame]:
    """The first rows of the list, and one row saying how many were left out."""
    newest = rows.orderBy(F.col("updated").desc(), F.col("session_id").desc()).limit(count)
    return newest, rows.agg(
        F.greatest(F.count("*") - count, F.lit(0)).cast("bigint").alias("omitted")
    )
