"""The period of a report."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, date, datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktide.evidence import Evidence
from worktide.functions.time import calendar_dates, day_bounds, local_date, micros_of


@dataclass(frozen=True)
class Period:
    first: date
    last: date
    tz: str

    @property
    def start(self) -> Column:
        return F.timestamp_micros(F.lit(micros_of(day_bounds(self.first, self.last, self.tz)[0])))

    @property
    def end(self) -> Column:
        return F.timestamp_micros(F.lit(micros_of(day_bounds(self.first, self.last, self.tz)[1])))

    def covers(self, at: Column) -> Column:
        return (at >= self.start) & (at < self.end)


def evidence_dates(ev: Evidence, tz: str) -> DataFrame:
    """First and last local date over every instant in the evidence, as one row."""
    spans = [
        ev.quota.agg(F.min("at").alias("lo"), F.max("at").alias("hi")),
        ev.usage.agg(F.min("at"), F.max("at")),
        ev.sessions.agg(
            F.min(F.least("created", "updated")), F.max(F.greatest("created", "updated"))
        ),
        ev.turns.agg(F.min(F.least("start", "end")), F.max(F.greatest("start", "end"))),
        ev.coverage.join(
            ev.turns.select("session_id", F.col("id").alias("turn_id")),
            ["session_id", "turn_id"],
            "left_semi",
        ).agg(F.min("end"), F.max("end")),
    ]
    whole = spans[0]
    for span in spans[1:]:
        whole = whole.union(span)
    return whole.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select(
        local_date(F.col("lo"), tz).alias("first"), local_date(F.col("hi"), tz).alias("last")
    )


def report_period(
    ev: Evidence, period: str, selected: date | None, tz: str, now: datetime | None = None
) -> Period:
    """Resolve day, week, month or all. Only `all` reads the evidence: two dates."""
    today = (now or datetime.now(UTC)).astimezone(ZoneInfo(tz)).date()
    if period != "all":
        return Period(*calendar_dates(period, selected or today), tz)
    if selected is not None:
        raise ValueError("a date cannot be combined with all")
    row = evidence_dates(ev, tz).first()
    if row is None or row["first"] is None:
        return Period(today, today, tz)
    return Period(row["first"], row["last"], tz)
