"""Allowance, tokens and model work for one resolved period."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date
from decimal import Decimal

from pyspark.sql import DataFrame

from worktide.evidence import Evidence
from worktide.plans.period import report_period
from worktide.plans.quota_reports import all_time_snapshot, burn_report
from worktide.plans.time_reports import model_time_report, shared_facts
from worktide.plans.token_reports import token_report
from worktide.sources.evidence import load_period


def overview(
    ev: Evidence,
    catalog: DataFrame,
    *,
    tz: str,
    limit_id: str,
    period: str = "day",
    selected: date | None = None,
    rate: Decimal | None = None,
    window_minutes: int = 10080,
    max_gap_seconds: int = 600,
    excluded_models: Iterable[str] = (),
) -> dict[str, DataFrame]:
    """Four reports over the same dates; for `all` the allowance is its newest reading.

    Work is laid out once, as facts of all sessions, and every report takes its share of them.
    """
    span = report_period(ev, period, selected, tz)
    near = load_period(ev, span, limit_id, window_minutes)
    facts = shared_facts(near, span)
    if period == "all":
        allowance = all_time_snapshot(
            near, tz, limit_id=limit_id, window_minutes=window_minutes)
        reports = {"latest": allowance}
    else:
        burn = burn_report(near, span, limit_id=limit_id, window_minutes=window_minutes,
                           max_gap_seconds=max_gap_seconds, facts=facts)
        reports = {"allowance": burn.rows, "mix": burn.mix, "latest": burn.latest}
    return {
        **reports,
        "token_usage": token_report(near, span, catalog, rate=rate,
                                    excluded_models=excluded_models, facts=facts),
        "model_totals": model_time_report(near, span, model_only=True, facts=facts),
        "reasoning": model_time_report(near, span, facts=facts),
    }
