"""How fast a shared quota is used per matched working hour."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktide.evidence import Evidence
from worktide.functions.time import local_date
from worktide.operators.intervals import clip, merge_spans, overlap_join, split_by_local_day, turn_pieces
from worktide.operators.quota import (
    classify_pairs,
    judge_readings,
    latest_reading,
    quota_moments,
    quota_select,
    reset_cohorts,
)
from worktide.operators.sweep import covered_time
from worktide.plans.period import Period
from worktide.plans.time_reports import root_work
from worktide.session import materialise

ROW = ("day", "stream", "cohort")


@dataclass(frozen=True)
class BurnReport:
    """rows per (day, stream, cohort), their model mix, and the newest reading."""

    rows: DataFrame
    mix: DataFrame
    latest: DataFrame
    pairs: DataFrame


def _active_rows(pairs: DataFrame) -> DataFrame:
    """(day, stream, cohort) with pairs that may be matched; a handful a day."""
    return pairs.select(*ROW).distinct()


def _in_rows(windows: DataFrame, pairs: DataFrame, labels: list[str]) -> DataFrame:
    """(day, stream, cohort, labels, micros): windows (day, labels, start, end, sign) inside the pairs of each row.

    A pair lies within its local day, so a window meets the rows of its own day only.
    """
    spans = pairs.select(*ROW, F.col("previous.at").alias("start"), F.col("at").alias("end"))
    here = windows.join(_active_rows(pairs), "day")
    return covered_time(spans, here, list(ROW), labels)


def match_work(
    ev: Evidence, period: Period, pairs: DataFrame, facts: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(times, work, flags): shared time of candidate pairs with root work, and its evidence.

    `times` has each pair's time, `work` that of each row by model and level, `flags` the row's
    evidence. Work is laid out once as facts, and swept once for pairs and once for rows.
    """
    own = ev.sessions.select(F.col("id").alias("session_id"), F.col("quality").alias("own"))
    facts = materialise(
        root_work(ev, period.tz, period.start, period.end, models=True, facts=facts)
        .join(own, "session_id", "left")
        .select(
            "day", "start", "end", "model_id", "reasoning_level",
            F.array_union("quality", F.coalesce("own", F.array().cast("array<string>")))
            .alias("quality"),
        )
    )
    candidates = pairs.where("kind = 'candidate'")
    one = F.lit(1)
    windows = candidates.select(*ROW, "at", F.col("previous.at").alias("start"), F.col("at").alias("end"), one.alias("sign"))
    times = covered_time(facts, windows, [], [*ROW, "at"])
    labels = ["model_id", "reasoning_level", "quality"]
    measured = materialise(_in_rows(facts.withColumn("sign", one), candidates, labels))
    work = measured.groupBy(*ROW, "model_id", "reasoning_level").agg(F.sum("micros").alias("micros"))
    return times, work, measured.select(*ROW, F.explode("quality").alias("flag"))


def _uncertainty(ev: Evidence, period: Period, matched: DataFrame) -> DataFrame:
    """Sampling uncertainty of turns that work inside a row's matched pairs, once per turn."""
    sampled = ev.turns.where("sampling_uncertainty_seconds > 0")
    roots = ev.sessions.where("NOT is_child AND parent_id IS NULL").select(
        F.col("id").alias("session_id")
    )
    open_work = clip(turn_pieces(sampled, ev.coverage), period.start, period.end).join(
        roots, "session_id", "left_semi"
    ).select("session_id", "turn_id", "start", "end")
    # What the turn worked on is its span minus the waits of its whole session.
    waits = ev.waits.join(open_work.select("session_id").distinct(), "session_id", "left_semi")
    waited = overlap_join(open_work, merge_spans(waits, ["session_id"]), ["session_id"]).drop("micros")
    net = open_work.withColumn("sign", F.lit(1)).unionByName(waited.withColumn("sign", F.lit(-1)))
    met = _in_rows(split_by_local_day(net, period.tz).drop("micros"), matched, ["session_id", "turn_id"])
    return (
        met.join(
            sampled.select("session_id", F.col("id").alias("turn_id"),
                           "sampling_uncertainty_seconds"),
            ["session_id", "turn_id"],
        )
        .groupBy(*ROW)
        .agg(F.sum("sampling_uncertainty_seconds").alias("uncertainty"))
    )


def burn_report(
    ev: Evidence,
    period: Period,
    *,
    limit_id: str,
    window_minutes: int = 10080,
    max_gap_seconds: int = 600,
    facts: DataFrame | None = None,
) -> BurnReport:
    selected = quota_select(ev.quota, limit_id, window_minutes, period.end)
    cohorts = materialise(reset_cohorts(selected))
    judged = materialise(judge_readings(quota_moments(selected, cohorts)))
    day = local_date(F.col("at"), period.tz)
    here = judged.where(period.covers(F.col("at")))
    pairs = materialise(
        classify_pairs(judged, period.start, period.end, period.tz, max_gap_seconds)
    )
    times, work, flags = match_work(ev, period, pairs, facts)
    settled = materialise(
        pairs.join(times, [*ROW, "at"], "left").withColumn(
            "kind",
            F.when(
                F.col("kind") == "candidate",
                F.when(F.col("micros") > 0, "matched").otherwise("no_work"),
            ).otherwise(F.col("kind")),
        )
    )
    matched = settled.where("kind = 'matched'")
    # A pair continues a block when the reading it starts from ended a matched pair.
    ends = matched.select("stream", "cohort", F.col("at").alias("joint"), F.lit(1).alias("follows"))
    blocks = matched.withColumn("joint", F.col("previous.at")).join(
        ends, ["stream", "cohort", "joint"], "left"
    ).where("follows IS NULL").groupBy(*ROW).agg(F.count("*").alias("blocks"))

    def points(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("points"))), F.lit(0.0))

    zero = F.lit(0).cast("bigint")
    accepted = settled.groupBy(*ROW).agg(
        points("matched").alias("matched_points"),
        F.coalesce(F.sum(F.when(F.col("kind") == "matched", F.col("micros"))), zero).alias("micros"),
        F.count_if(F.col("kind") == "matched").alias("matched_windows"),
        points("gap").alias("gap_points"),
        points("no_work").alias("no_work_points"),
        points("boundary").alias("boundary_points"),
        F.array_distinct(F.collect_set("kind")).alias("kinds"),
    )
    late = here.where("verdict IN ('stale', 'retired')").withColumn("day", day).groupBy(*ROW).agg(
        F.count("*").alias("stale_readings"),
        F.max(F.col("verdict") == "retired").alias("retired"),
    )
    clash = (
        here.where("verdict = 'conflict'").select("stream", day.alias("day")).distinct()
        .join(cohorts.select("stream", "cohort").distinct(), "stream")
        .withColumn("clash", F.lit(True))
    )
    seen_flags = flags.groupBy(*ROW).agg(F.collect_set("flag").alias("work_flags"))
    rows = (
        accepted.join(late, list(ROW), "full")
        .join(clash, list(ROW), "full")
        .join(seen_flags, list(ROW), "left")
        .join(blocks, list(ROW), "left")
        .join(_uncertainty(ev, period, matched), list(ROW), "left")
    )
    hours = F.coalesce("micros", zero) / 3_600_000_000.0
    has = F.coalesce("kinds", F.array().cast("array<string>"))
    quality = F.array_sort(
        F.array_distinct(
            F.concat(
                F.array(F.lit("low_confidence"), F.lit("account_wide_allowance")),
                F.coalesce("work_flags", F.array().cast("array<string>")),
                F.array_compact(
                    F.array(
                        F.when(F.array_contains(has, "boundary"),
                               F.lit("calendar_boundary_excluded")),
                        F.when(F.array_contains(has, "gap"), F.lit("quota_observation_gap")),
                        F.when(F.array_contains(has, "no_work"), F.lit("quota_without_root_work")),
                        F.when(F.col("retired"), F.lit("retired_reset_reading")),
                        F.when(F.col("clash"), F.lit("conflicting_quota_observation")),
                    )
                ),
            )
        )
    )
    named = F.from_json("stream", "bucket STRING, plan_type STRING")
    none = F.lit(0.0)
    out = rows.withColumn("s", named).select(
        "day",
        F.col("s.bucket").alias("bucket"),
        F.col("s.plan_type").alias("plan_type"),
        F.col("cohort").alias("resets_at"),
        F.coalesce("matched_points", none).alias("matched_points"),
        F.coalesce("micros", zero).alias("micros"),
        hours.alias("working_hours"),
        F.try_divide(F.coalesce("matched_points", none), hours).alias("points_per_hour"),
        F.coalesce("matched_windows", zero).alias("matched_windows"),
        F.try_divide(F.coalesce("blocks", zero).cast("double"), hours).alias("rounding_sensitivity"),
        F.coalesce("gap_points", none).alias("gap_points"),
        F.coalesce("no_work_points", none).alias("no_work_points"),
        F.coalesce("boundary_points", none).alias("boundary_points"),
        F.coalesce("stale_readings", zero).alias("stale_readings"),
        quality.alias("quality"),
        F.coalesce("uncertainty", none).alias("uncertainty"),
    )
    whole = work.groupBy(*ROW).agg(F.sum("micros").alias("all_micros"))
    mix = work.join(whole, list(ROW)).withColumn("s", named).select(
        "day", F.col("s.bucket").alias("bucket"), F.col("s.plan_type").alias("plan_type"),
        F.col("cohort").alias("resets_at"), "model_id", "reasoning_level", "micros",
        (F.col("micros") * 100.0 / F.col("all_micros")).alias("percentage"),
    )
    return BurnReport(rows=out, mix=mix, latest=latest_reading(pairs), pairs=settled)


def all_time_snapshot(
    ev: Evidence, tz: str, *, limit_id: str, window_minutes: int = 10080
) -> DataFrame:
    """Newest reading on the latest quota date; an all-time period has no rows or rate."""
    selected = quota_select(ev.quota, limit_id, window_minutes)
    last = selected.agg(F.max("at").alias("at")).select(local_date(F.col("at"), tz)).first()
    if last is None or last[0] is None:
        return latest_reading(selected.where("false"))
    day = Period(last[0], last[0], tz)
    selected = quota_select(ev.quota, limit_id, window_minutes, day.end)
    judged = judge_readings(quota_moments(selected, reset_cohorts(selected)))
    return latest_reading(
        judged.where((F.col("verdict") == "accepted") & day.covers(F.col("at")))
    )


def observed_usage_total(burn_rows: DataFrame, recorded_micros: DataFrame) -> DataFrame:
    """One row of totals, given only while there is a single (plan, bucket) stream.

    `recorded_micros` is a one-row table (micros) of all recorded work.
    """
    total = burn_rows.agg(
        F.countDistinct(F.struct("plan_type", "bucket")).alias("streams"),
        F.countDistinct("resets_at").alias("cycles"),
        F.sum("matched_points").alias("matched_points"),
        F.sum(F.col("gap_points") + F.col("no_work_points")).alias("unmatched_points"),
        F.sum("boundary_points").alias("boundary_points"),
        F.sum("micros").alias("matched_micros"),
        F.lit(1).alias("one"),
    ).where("streams = 1")
    return (
        total.join(
            recorded_micros.select(F.col("micros").alias("recorded"), F.lit(1).alias("one")), "one"
        )
        .select(
            (F.col("matched_points") + F.col("unmatched_points")).alias("observed_points"),
            "cycles", "matched_points", "unmatched_points", "boundary_points", "matched_micros",
            (F.col("recorded") - F.col("matched_micros")).alias("outside_micros"),
        )
    )
