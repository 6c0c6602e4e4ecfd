"""Reports on working time: by day, directory and session, and by model."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worktide.evidence import Evidence
from worktide.operators.attribution import work_facts
from worktide.operators.intervals import clip, overlap_measure, turn_pieces
from worktide.operators.select import roots_only, same_path, select_sessions
from worktide.plans.period import Period
from worktide.session import materialise


def union_flags(column: str) -> Column:
    """Sorted union of flag arrays; only the distinct arrays are held."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(column))))


def _bounds(first: date | None, last: date | None, tz: str) -> tuple[Column | None, Column | None]:
    start = Period(first, first, tz).start if first else None
    end = Period(last, last, tz).end if last else None
    return start, end


def root_work(
    ev: Evidence,
    tz: str,
    start: Column | None = None,
    end: Column | None = None,
    *,
    models: bool = False,
    selected: DataFrame | None = None,
    cwd: str | None = None,
    facts: DataFrame | None = None,
) -> DataFrame:
    """Work facts of the selected root sessions; out of `facts`, where these are laid out already."""
    chosen = roots_only(ev.sessions if selected is None else selected).select(
        F.col("id").alias("session_id")
    )

    def of_roots(df: DataFrame) -> DataFrame:
        return df.join(chosen, "session_id", "left_semi")

    facts = of_roots(facts) if facts is not None else work_facts(
        of_roots(ev.turns),
        of_roots(ev.waits),
        ev.coverage,
        tz,
        contexts=ev.contexts if models else None,
        start=start,
        end=end,
    )
    return facts if cwd is None else facts.where(same_path(F.col("cwd"), cwd))


def shared_facts(ev: Evidence, period: Period, *, models: bool = True) -> DataFrame:
    """Work facts of all sessions in the period, children included, written for several reports.

    A session's facts depend on itself alone, so each report takes those of its sessions.
    """
    return materialise(work_facts(
        ev.turns, ev.waits, ev.coverage, period.tz, contexts=ev.contexts if models else None,
        start=period.start, end=period.end))


def history_report(
    ev: Evidence,
    tz: str,
    first: date | None = None,
    last: date | None = None,
    *,
    cwd: str | None = None,
    archive: str = "active",
    session_id: str | None = None,
) -> DataFrame:
    """Microseconds at levels total, day, directory and session.

    A selected root session without work is listed with zero.
    """
    selected = select_sessions(ev.sessions, ev.turns, cwd=cwd, archive=archive,
                               session_id=session_id)
    start, end = _bounds(first, last, tz)
    facts = root_work(ev, tz, start, end, selected=selected, cwd=cwd)
    cells = facts.groupBy("day", "cwd", "session_id").agg(F.sum("micros").alias("micros"))
    idle = roots_only(selected).select(
        F.lit(None).cast("date").alias("day"),
        F.lit(None).cast("string").alias("cwd"),
        F.col("id").alias("session_id"),
        F.lit(0).cast("bigint").alias("micros"),
    )
    levels = (
        cells.unionByName(idle)
        .groupingSets(
            [["day"], ["cwd"], ["session_id"], []], "day", "cwd", "session_id"
        )
        .agg(F.sum("micros").alias("micros"), F.grouping_id().alias("mask"))
    )
    # Bit set = column rolled away; day is the highest bit.
    level = (
        F.when(F.col("mask") == 3, "day").when(F.col("mask") == 5, "directory")
        .when(F.col("mask") == 6, "session").otherwise("total")
    )
    rows = levels.withColumn("level", level).drop("mask")
    return rows.where(
        ~((F.col("level") == "day") & F.col("day").isNull())
        & ~((F.col("level") == "directory") & F.col("cwd").isNull())
    ).select("level", "day", "cwd", "session_id", "micros")


def history_quality(ev: Evidence, *, cwd: str | None = None, archive: str = "active",
                    session_id: str | None = None) -> DataFrame:
    """Sorted union of flags of the selected root sessions and their turns, as one row."""
    selected = roots_only(
        select_sessions(ev.sessions, ev.turns, cwd=cwd, archive=archive, session_id=session_id)
    )
    flags = selected.select("quality").union(
        ev.turns.join(
            selected.select(F.col("id").alias("session_id")), "session_id", "left_semi"
        ).select("quality")
    )
    return flags.agg(union_flags("quality").alias("quality"))


def _uncertainty(ev: Evidence, facts: DataFrame, period: Period, labels: list[str]) -> DataFrame:
    """Sampling uncertainty of the turns active in each label, counted once per turn."""
    sampled = ev.turns.where("sampling_uncertainty_seconds > 0")
    working = clip(turn_pieces(sampled, ev.coverage), period.start, period.end).select(
        "session_id", "turn_id", "start", "end"
    )
    window = F.to_json(F.struct("turn_id", F.unix_micros("start").alias("us")))
    windows = working.withColumn("window", window)
    spans = facts.select("session_id", *labels, "start", "end")
    met = overlap_measure(windows, spans, ["session_id"], labels).select(
        "session_id", *labels, F.get_json_object("window", "$.turn_id").alias("turn_id")
    ).distinct()
    return met.join(
        sampled.select("session_id", F.col("id").alias("turn_id"), "sampling_uncertainty_seconds"),
        ["session_id", "turn_id"],
    )


def model_time_report(
    ev: Evidence,
    period: Period,
    *,
    cwd: str | None = None,
    archive: str = "all",
    model_only: bool = False,
    facts: DataFrame | None = None,
) -> DataFrame:
    """Working time per model and reasoning level, or per model, with Unknown kept.

    Sessions and uncertainty are counted distinct at the chosen grain, so the two
    grains are computed from the facts, never from each other.
    """
    selected = select_sessions(ev.sessions, ev.turns, cwd=cwd, archive=archive)
    facts = root_work(ev, period.tz, period.start, period.end, models=True, selected=selected,
                      cwd=cwd, facts=facts)
    if model_only:
        facts = facts.withColumn("reasoning_level", F.lit(None).cast("string"))
    facts = materialise(facts)
    grain = ["model_id", "reasoning_level"]
    per_session = (
        facts.groupBy("session_id", *grain)
        .agg(F.sum("micros").alias("micros"), union_flags("quality").alias("quality"))
        .join(
            ev.sessions.select(F.col("id").alias("session_id"), F.col("quality").alias("own")),
            "session_id",
        )
    )
    rows = per_session.groupBy(*grain).agg(
        F.sum("micros").alias("micros"),
        F.count("*").alias("session_count"),
        F.array_sort(
            F.array_distinct(
                F.concat(F.flatten(F.collect_set("quality")), F.flatten(F.collect_set("own")))
            )
        ).alias("quality"),
    )
    sampled = (
        _uncertainty(ev, facts, period, grain)
        .groupBy(*grain)
        .agg(F.sum("sampling_uncertainty_seconds").alias("uncertainty"))
        .select(*[F.col(g).alias(f"u_{g}") for g in grain], "uncertainty")
    )
    rows = rows.join(
        sampled,
        F.col("model_id").eqNullSafe(F.col("u_model_id"))
        & F.col("reasoning_level").eqNullSafe(F.col("u_reasoning_level")),
        "left",
    ).drop("u_model_id", "u_reasoning_level")
    return rank_models(rows.withColumn("uncertainty", F.coalesce("uncertainty", F.lit(0.0))))


def model_uncertainty_total(ev: Evidence, period: Period) -> DataFrame:
    """Overall uncertainty: every (session, turn) once, whatever models it met."""
    facts = materialise(root_work(ev, period.tz, period.start, period.end))
    met = _uncertainty(ev, facts.withColumn("label", F.lit("any")), period, ["label"])
    return met.agg(F.coalesce(F.sum("sampling_uncertainty_seconds"), F.lit(0.0)).alias("uncertainty"))


def rank_models(rows: DataFrame) -> DataFrame:
    """Known models by time, id and reasoning; Unknown last and unranked.

    Input has one row per model and reasoning level, so these unpartitioned
    windows see a report, not the evidence.
    """
    order = Window.orderBy(
        F.col("model_id").isNull(), F.col("micros").desc(), "model_id",
        F.coalesce("reasoning_level", F.lit("")),
    )
    total = F.sum("micros").over(Window.partitionBy())
    return rows.select(
        F.when(F.col("model_id").isNotNull(), F.row_number().over(order)).alias("rank"),
        "model_id",
        "reasoning_level",
        "micros",
        F.coalesce(F.try_divide(F.col("micros") * 100.0, total), F.lit(0.0)).alias("percentage"),
        "session_count",
        "quality",
        "uncertainty",
    )
