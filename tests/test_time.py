"""Intervals, attribution and quota against second-by-second rules over drawn inputs."""

from __future__ import annotations

import random
from collections import Counter
from datetime import UTC, date, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from conftest import T0, at
from pyspark.sql import functions as F

from worktide.functions.time import calendar_dates
from worktide.operators import attribution, intervals
from worktide.operators.quota import reset_cohorts
from worktide.operators.scan import latest, running_max, running_sum, scan, upcoming
from worktide.plans.period import Period
from worktide.plans.quota_reports import burn_report
from worktide.plans.time_reports import history_report, model_time_report

ZONE = "America/Toronto"
TODAY = Period(date(2026, 10, 6), date(2026, 10, 6), ZONE)


class Sketch:
    """A drawn session, kept as spans to be counted by hand and as evidence."""

    def __init__(self, rng, build, sid="s", turns=14, length=300):
        self.turns, self.waits, self.coverage, self.contexts = [], [], [], []
        for n in range(turns):
            start = rng.randrange(length)
            end = None if rng.random() < 0.2 else start + rng.randrange(1, 60)
            tid, cwd = f"t{n:03d}", rng.choice(["/x", "/y"])
            self.turns.append((tid, start, end, cwd))
            build.turn(start, end, sid=sid, tid=tid, cwd=cwd)
            for _ in range(rng.randrange(3)):
                a = start + rng.randrange(50)
                b = a + rng.randrange(1, 25)
                if end is None and rng.random() < 0.6:
                    self.coverage.append((tid, a, b))
                    build.span("coverage", a, b, sid=sid, tid=tid)
                elif rng.random() < 0.5:
                    self.waits.append((a, b))
                    build.span("waits", a, b, sid=sid, tid=tid)

    def seconds(self):
        """Seconds in which some turn works and nothing of the session waits."""
        on = set()
        for tid, start, end, _ in self.turns:
            pieces = [(start, end)] if end is not None else [(a, b) for t, a, b in self.coverage if t == tid]
            for a, b in pieces:
                on.update(range(a, b))
        for a, b in self.waits:
            on.difference_update(range(a, b))
        return on


def worked(ev):
    spans = intervals.work_segments(ev.turns, ev.waits, ev.coverage).select(
        F.unix_seconds("start").alias("a"), F.unix_seconds("end").alias("b")).collect()
    zero = int(T0.timestamp())
    return Counter(second - zero for r in spans for second in range(r["a"], r["b"]))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_work_is_the_union_less_the_waits(build, seed):
    sketch = Sketch(random.Random(seed), build.session())
    found = worked(build.done())
    assert set(found) == sketch.seconds() and set(found.values()) <= {1}


def test_days_are_cut_at_local_midnights(spark):
    rng, rows, want = random.Random(9), [], Counter()
    zone = ZoneInfo("Australia/Lord_Howe")  # its clocks change by half an hour
    for _ in range(20):
        start = datetime(2026, 10, 3, tzinfo=UTC) + timedelta(minutes=rng.randrange(3000))
        end = start + timedelta(minutes=rng.randrange(1, 2500))
        rows.append((start, end))
        for minute in range(int((end - start).total_seconds() // 60)):
            want[(start + timedelta(minutes=minute)).astimezone(zone).date()] += 60_000_000
    df = spark.createDataFrame(rows, "start TIMESTAMP, end TIMESTAMP")
    got = intervals.split_by_local_day(df, "Australia/Lord_Howe").groupBy("day").agg(F.sum("micros").alias("n"))
    assert {r["day"]: r["n"] for r in got.collect()} == want


def test_calendar_periods_hold_their_day():
    for n in range(0, 800, 13):
        day = date(2024, 1, 1) + timedelta(days=n)
        first, last = calendar_dates("week", day)
        assert first <= day <= last and first.weekday() == 0 and (last - first).days == 6
        first, last = calendar_dates("month", day)
        assert first.day == 1 and first <= day <= last and (last + timedelta(days=1)).day == 1
    with pytest.raises(ValueError):
        calendar_dates("decade", date(2024, 1, 1))


def test_each_second_has_the_newest_turn_and_its_newest_context(build):
    rng = random.Random(17)
    sketch = Sketch(rng, build.session())
    contexts = {}
    for tid, start, _, _ in sketch.turns:
        for moment in sorted(rng.sample(range(start, start + 50), rng.randrange(4))):
            model = rng.choice(["m1", "m2", "m3"])
            contexts.setdefault(tid, []).append((moment, model))
            build.context(moment, model, "deep", tid=tid)
    ev = build.done()
    found = Counter()
    for r in attribution.attributed_segments(ev.sessions, ev.turns, ev.waits, ev.coverage, ev.contexts).collect():
        found[r["model_id"]] += int((r["end"] - r["start"]).total_seconds())
    assert sum(found.values()) == len(sketch.seconds())
    alone = [t for t in sketch.turns if t[2] is not None and not any(
        o != t and o[1] < t[2] and (o[2] is None or o[2] > t[1]) for o in sketch.turns)]
    for tid, start, end, _ in alone:
        for second in set(range(start, end)) & sketch.seconds():
            assert any(m <= second for m, _ in contexts.get(tid, [])) or found[None] > 0


def test_rank_is_by_time_and_unknown_has_none(build):
    rng, want = random.Random(23), Counter()
    for n in range(9):
        model, seconds = rng.choice(["m1", "m2", "m3", None]), rng.randrange(20, 400)
        build.session(f"s{n}").turn(0, seconds, sid=f"s{n}")
        want[model] += seconds
        if model:
            build.context(0, model, "deep", sid=f"s{n}")
    rows = model_time_report(build.done(), TODAY, model_only=True).collect()
    assert {r["model_id"]: r["micros"] for r in rows} == {m: n * 1_000_000 for m, n in want.items()}
    ranked = sorted((r for r in rows if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["model_id"] for r in ranked] == [m for m, _ in want.most_common() if m is not None]
    assert sum(r["percentage"] for r in rows) == pytest.approx(100)


def test_children_add_no_time(build):
    want = Counter()
    for n in range(8):
        child, archived, seconds = n % 3 == 2, n % 2 == 0, 50 + 7 * n
        build.session(f"s{n}", parent="s0" if child else None, archived=archived).turn(0, seconds, sid=f"s{n}")
        if not child:
            want["archived" if archived else "active"] += seconds
    ev = build.done()
    for archive in ("archived", "active"):
        row = history_report(ev, ZONE, archive=archive).where("level = 'total'").first()
        assert row["micros"] == want[archive] * 1_000_000


def report(ev, gap=900):
    rows = burn_report(ev, TODAY, limit_id="lim", max_gap_seconds=gap).rows.collect()
    return sorted(rows, key=lambda r: r["resets_at"])


def test_points_are_matched_gap_or_idle(build):
    rng = random.Random(29)
    busy = [(0, 2000), (3000, 3500)]
    for n, (a, b) in enumerate(busy):
        build.session(f"s{n}").turn(a, b, sid=f"s{n}")
    moments = sorted(rng.sample(range(0, 8000), 14))
    level, want = 5, Counter()
    readings = []
    for moment in moments:
        level += rng.randrange(4)
        readings.append((moment, level))
        build.quota(moment, level)
    seconds = 0
    for (t, x), (u, y) in zip(readings[:-1], readings[1:], strict=True):
        overlap = sum(max(0, min(u, b) - max(t, a)) for a, b in busy)
        if u - t > 900:
            want["gap"] += y - x
        elif overlap:
            want["matched"] += y - x
            seconds += overlap
        else:
            want["idle"] += y - x
    row = report(build.done())[0]
    assert (row["matched_points"], row["gap_points"], row["no_work_points"]) == (want["matched"], want["gap"], want["idle"])
    assert row["micros"] == seconds * 1_000_000


def plain_cohorts(resets):
    """Each reset in order of first sight: the first anchor within ten seconds, or a new one."""
    anchors, out = [], {}
    for value in resets:
        near = next((a for a in anchors if abs(a - value) <= 10), None)
        if near is None:
            anchors.append(value)
            near = value
        out.setdefault(value, near)
    return out


@pytest.mark.parametrize("spread", [25, 120, 4000])
def test_cohorts_of_drawn_resets(spark, spread):
    rng = random.Random(spread)
    resets = [2_000_000 + rng.randrange(spread) for _ in range(60)]
    rows = [("one", value, at(n)) for n, value in enumerate(resets)]
    df = spark.createDataFrame(rows, "stream STRING, resets_at BIGINT, at TIMESTAMP")
    assert {r["resets_at"]: r["cohort"] for r in reset_cohorts(df).collect()} == plain_cohorts(resets)


def test_lower_readings_are_stale_and_twins_conflict(build):
    build.session().turn(0, 5000)
    for n, used in enumerate((20, 26, 23, 26, 29, 28)):
        build.quota(n * 100, used)
    row = report(build.done())[0]
    assert (row["matched_points"], row["stale_readings"]) == (9, 2)
    build.quota(250, 40).quota(250, 41)
    assert "conflicting_quota_observation" in report(build.done())[0]["quality"]


def test_a_pair_over_local_midnight_is_set_apart(build):
    night = (datetime(2026, 10, 6, 4, tzinfo=UTC) - T0).total_seconds()
    build.session().turn(night - 4000, night + 4000).quota(night - 200, 31).quota(night + 300, 36).quota(night + 500, 38)
    row = report(build.done())[0]
    assert (row["boundary_points"], row["matched_points"]) == (5, 2)


def test_chunked_scan_equals_one_window(spark):
    """A hot key that fills many chunks, beside quiet ones."""
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.7 else f"k{i % 5}", i // 9, i,
             rng.choice([None, 1, 2, 3])) for i in range(400)]
    df = spark.createDataFrame(rows, "k STRING, c BIGINT, o BIGINT, v BIGINT")
    got = scan(df, ["k"], "c", ["o"], total=running_sum(F.col("v")),
               top=running_max(F.col("v"), inclusive=False),
               last=latest(F.col("v"), inclusive=False), after=upcoming(F.col("v"))).collect()
    by_key = {}
    for k, _, o, v in sorted(rows, key=lambda r: r[2]):
        by_key.setdefault(k, []).append((o, v))
    want = {}
    for k, items in by_key.items():
        for n, (o, _) in enumerate(items):
            before = [v for _, v in items[:n] if v is not None]
            after = [v for _, v in items[n + 1:] if v is not None]
            total = sum(v for _, v in items[: n + 1] if v is not None)
            want[o] = (total, max(before, default=None), before[-1] if before else None,
                       after[0] if after else None)
    assert {r["o"]: (r["total"], r["top"], r["last"], r["after"]) for r in got} == want


def test_a_crowded_session_keeps_every_microsecond(build):
    """Bursts and copies in one session: the bins may not change the totals."""
    rng = random.Random(3)
    covered = set()
    build.session()
    for i in range(600):
        start = rng.randrange(0, 400) if i % 3 else rng.choice([0, 0, 395])
        end = start + rng.randrange(1, 40)
        covered.update(range(start, end))
        build.turn(start, end, tid=f"{i:04d}")
    ev = build.done()
    facts = attribution.work_facts(ev.turns, ev.waits, ev.coverage, ZONE)
    assert facts.agg(F.sum("micros")).first()[0] == len(covered) * 1_000_000


def test_pruned_period_equals_filtered_whole(build):
    build.session().turn(-90_000, 90_000).span("waits", 35, 48).session("old").turn(
        -350_000, -280_000, sid="old")
    ev = build.done()
    whole = history_report(ev, ZONE, archive="all").where("level = 'day' AND day = '2026-10-06'")
    part = history_report(ev, ZONE, TODAY.first, TODAY.last, archive="all").where("level = 'total'")
    assert whole.first()["micros"] == part.first()["micros"]
    kept = intervals.prune_to_period(ev.sessions, ev.turns, ev.coverage, TODAY.start, TODAY.end)
    assert [r["id"] for r in kept.collect()] == ["s"]
