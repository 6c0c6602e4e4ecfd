"""Counters, prices and hierarchies against plain sequential rules over drawn inputs."""

from __future__ import annotations

import json
import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from conftest import T0, at, counts
from pyspark.sql import functions as F

from worktide.evidence import COUNTERS, SCHEMAS
from worktide.operators.hierarchy import root_sessions
from worktide.operators.normalize import normalize
from worktide.operators.pricing import price_rows, price_usage
from worktide.operators.usage import counter_delta
from worktide.plans.period import Period
from worktide.plans.token_reports import token_report
from worktide.sources.rollouts import read_rollouts


class Journal:
    """A session file that is written step by step; every step is five seconds later."""

    def __init__(self, **head):
        self.clock, self.rows = -5, []
        self.put("session_meta", {"id": "main", "cwd": "/srv", "source": "cli"} | head)

    def put(self, kind, payload, clock=None):
        self.clock = self.clock + 5 if clock is None else clock
        moment = (T0 + timedelta(seconds=self.clock)).strftime("%Y-%m-%dT%H:%M:%S.000Z")
        self.rows.append(json.dumps({"payload": payload, "timestamp": moment, "type": kind}))
        return self

    def context(self, model, cwd="/srv", turn="t9"):
        return self.put("turn_context", {"turn_id": turn, "cwd": cwd, "model": model})

    def event(self, name, **more):
        return self.put("event_msg", {"type": name} | more)

    def meter(self, total=None, step=None, clock=None):
        info = {key: {"input_tokens": 7 * n, "cached_input_tokens": 0, "output_tokens": n,
                      "reasoning_output_tokens": 0, "total_tokens": 8 * n}
                for key, n in (("total_token_usage", total), ("last_token_usage", step)) if n is not None}
        return self.put("event_msg", {"type": "token_count", "info": info}, clock)

    def noise(self):
        self.rows.append('{"cut off')
        return self

    def read(self, spark, home, held=None, ending="\n"):
        folder = home / "archived_sessions" / "2026"
        folder.mkdir(parents=True)
        (folder / "run.jsonl").write_text("\n".join(self.rows) + ending)
        return normalize(read_rollouts(spark, str(home)), held)


def outputs(ev):
    rows = ev.usage.orderBy("at").collect()
    return [None if r["delta"] is None else r["delta"]["output_tokens"] for r in rows], rows


def plain_deltas(readings):
    """Reading by reading: the difference from the last reading that was there."""
    held, out = None, []
    for now in readings:
        if now is None:
            out.append(None)
            continue
        if held is None:
            out.append(now)
        elif any(a is not None and b is not None and a < b for a, b in zip(now, held, strict=True)):
            out.append(None)
        else:
            out.append(tuple(None if a is None or b is None else a - b for a, b in zip(now, held, strict=True)))
        held = now
    return out


def test_increments_of_drawn_counters(spark):
    rng = random.Random(20)
    sources = {}
    for name in range(12):
        level, readings = [rng.randrange(50) for _ in COUNTERS], []
        for _ in range(rng.randrange(1, 40)):
            roll = rng.random()
            if roll < 0.15:
                readings.append(None)
                continue
            level = [rng.randrange(9) for _ in level] if roll < 0.25 else [v + rng.randrange(4) for v in level]
            readings.append(tuple(v if rng.random() < 0.9 else None for v in level))
        sources[f"f{name}"] = readings
    rows = [(name, place // 4, place, reading, reading) for name, all_ in sources.items() for place, reading in enumerate(all_)]
    kind = "struct<" + ",".join(f"{c}:bigint" for c in COUNTERS) + ">"
    df = spark.createDataFrame(rows, f"file_path STRING, block BIGINT, ord BIGINT, cumulative {kind}, last_usage {kind}")
    got = {(r["file_path"], r["ord"]): r["delta"] and tuple(r["delta"]) for r in counter_delta(df).collect()}
    assert got == {(name, place): d for name, all_ in sources.items() for place, d in enumerate(plain_deltas(all_))}


def test_attribution_follows_the_contexts_of_a_file(spark, tmp_path):
    log = Journal().context("m-one").meter(11).meter(11).context("m-two", "/opt", "t10").meter(30, 19).noise().meter(44, 14)
    got, rows = outputs(log.read(spark, tmp_path))
    assert got == [11, 0, 19, 14]
    assert [(r["model_id"], r["cwd"]) for r in rows] == [("m-one", "/srv"), ("m-one", "/srv"), ("m-two", "/opt"), (None, None)]
    assert [r["request_input_tokens"] for r in rows] == [None, None, 133, 98]
    assert "source_gap_attribution_unavailable" in rows[3]["diagnostics"]


@pytest.mark.parametrize(("head", "build", "want"), [
    ({}, lambda j: j.noise().meter(40).meter(52, 12), [None, 12]),
    ({"forked_from_id": "elder"}, lambda j: j.meter(70, clock=-300).meter(91, 21, clock=8), [21]),
    ({"source": {"subagent": {"thread_spawn": {"parent_thread_id": "elder"}}}}, lambda j: j.meter(500, 3).meter(537, 37), [None, 37]),
    ({}, lambda j: j.meter(90).meter(4).meter(step=2).meter(9, 5), [90, None, None, 5]),
], ids=["gap", "fork", "child", "reset"])
def test_missing_baselines(spark, tmp_path, head, build, want):
    assert outputs(build(Journal(**head).context("m-one")).read(spark, tmp_path))[0] == want


def test_what_is_stored_serves_as_baseline(spark, tmp_path):
    first = Journal().context("m-one").meter(33).read(spark, tmp_path / "first").usage
    more = Journal().context("m-one").meter(46, 13, clock=60)
    assert outputs(more.read(spark, tmp_path / "more", first))[0] == [13]
    late = Journal().context("m-one").meter(46, 13, clock=60).read(spark, tmp_path / "late").usage
    whole = Journal().context("m-one").meter(33).meter(46, 13, clock=60).read(spark, tmp_path / "whole", late)
    assert [r["delta"] for r in outputs(whole)[1] if "earlier_history_overlap" in r["diagnostics"]] == [None]


def test_open_lines_wait_and_odd_values_are_flagged(spark, tmp_path):
    log = Journal().context("m-one")
    log.put("event_msg", {"type": "token_count", "info": {"total_token_usage": {
        "input_tokens": -3, "output_tokens": 2.5, "cached_input_tokens": "7", "reasoning_output_tokens": 6}}})
    ev = log.meter(60).read(spark, tmp_path, ending="")
    row = ev.usage.collect()[0]
    assert ev.usage.count() == 1 and row["delta"]["reasoning_output_tokens"] == 6
    assert {f"invalid_{c}" for c in ("input_tokens", "output_tokens", "cached_input_tokens")} <= set(row["diagnostics"])


def test_turns_and_waits_of_a_file(spark, tmp_path):
    log = Journal().event("task_started", turn_id="p").put("response_item", {"type": "function_call", "name": "request_user_input", "call_id": "q"})
    log.put("response_item", {"type": "function_call_output", "call_id": "q"}, clock=29).event("turn_aborted", turn_id="p")
    ev = log.event("task_started", turn_id="r").context("m-two", "/opt", "r").event("task_complete").read(spark, tmp_path)
    turns = {r["id"]: (r["cwd"], r["outcome"], (r["end"] - r["start"]).seconds) for r in ev.turns.collect()}
    assert turns == {"p": ("/srv", "turn_aborted", 29), "r": ("/opt", "task_complete", 10)}
    assert [(r["end"] - r["start"]).seconds for r in ev.waits.collect()] == [19]


RATES = """
even   ordinary  -      3    1    -    8   -  -  -  -
apart  separate  -      3    1    4    8   -  -  -  -
steep  ordinary  50000  3    -    -    8   6  -  -  9
"""


def plain_bill(model, read, cached, written, out, request):
    """Micro-USD of one row where every count is known."""
    if model == "even":
        return 3 * (read - cached) + cached + 8 * out
    if model == "apart":
        return 3 * (read - cached - written) + cached + 4 * written + 8 * out
    return 6 * read + 9 * out if request > 50_000 else 3 * read + 8 * out


def test_bills_of_drawn_usage(spark, build):
    rng, want = random.Random(31), {}
    for n in range(60):
        model = rng.choice(["even", "apart", "steep"])
        read, out = rng.randrange(1, 90_000), rng.randrange(5_000)
        cached = 0 if model == "steep" else rng.randrange(read)
        written = rng.randrange(read - cached) if model == "apart" else None
        request = rng.choice([49_999, 50_000, 50_001])
        build.usage(f"u{n}", n, counts(input_tokens=read, cached_input_tokens=cached, cache_write_input_tokens=written,
                                       output_tokens=out, total_tokens=read + out), model=model, request=request)
        want[f"u{n}"] = Decimal(plain_bill(model, read, cached, written or 0, out, request))
    rows = price_usage(build.done().usage, price_rows(spark, RATES, date(2026, 5, 1))).collect()
    assert {r["id"]: r["micro_usd"] for r in rows} == want and all(r["complete"] for r in rows)


def test_unknown_parts_stay_unpriced(spark, build):
    known = dict(input_tokens=9_000, cached_input_tokens=2_000, output_tokens=500, total_tokens=9_500)
    build.usage("writes", 0, counts(**known), model="apart").usage("model", 1, counts(**known), model="nowhere")
    build.usage("none", 2, counts(), model="even").usage("zero", 3, counts(input_tokens=0, output_tokens=0, total_tokens=0), model="nowhere")
    rows = {r["id"]: r for r in price_usage(build.done().usage, price_rows(spark, RATES, date(2026, 5, 1))).collect()}
    assert (rows["writes"]["micro_usd"], rows["writes"]["unpriced_tokens"]) == (Decimal(2_000 + 8 * 500), 7_000)
    assert not rows["model"]["complete"] and rows["model"]["unpriced_tokens"] == 9_500
    assert not rows["none"]["available"] and rows["zero"]["complete"]


def climb(parents, one):
    """The root of a session, by walking up."""
    path = [one]
    while parents.get(path[-1]) is not None:
        above = parents[path[-1]]
        if above in path:
            return min(path[path.index(above):]) if one in path[path.index(above):] else one
        if above not in parents:
            return path[-1]
        path.append(above)
    return path[-1]


def test_roots_of_drawn_forests(spark):
    rng = random.Random(44)
    parents = {f"n{i:02d}": rng.choice([None, f"n{rng.randrange(i + 1):02d}" if i else None, "absent"]) for i in range(60)}
    parents = {k: None if v == k else v for k, v in parents.items()}
    for i in range(40):  # a deep chain
        parents[f"d{i:02d}"] = f"d{i - 1:02d}" if i else None
    parents |= {"ring1": "ring2", "ring2": "ring3", "ring3": "ring1"}
    rows = [(k, "/srv", "", at(0), at(0), False, v, v is not None, []) for k, v in parents.items()]
    got = {r["session_id"]: r["root_id"] for r in root_sessions(spark.createDataFrame(rows, SCHEMAS["sessions"])).collect()}
    assert got == {k: climb(parents, k) for k in parents}


def test_rollups_keep_every_token(spark, build):
    rng, tree = random.Random(52), {"top": None, "mid": "top", "low": "mid", "alone": None, "stray": "absent"}
    used, where = {}, {"top": "/srv", "mid": "/opt", "low": "/srv", "alone": "/opt", "stray": "/srv"}
    for name, parent in tree.items():
        build.session(name, where[name], parent, archived=name == "alone")
        for n in range(3):
            used[name, n] = rng.randrange(1, 1000)
            build.usage(f"{name}{n}", n, counts(input_tokens=used[name, n], cached_input_tokens=0, output_tokens=0,
                                                total_tokens=used[name, n]), sid=name, cwd=where[name])
    ev, prices = build.done(), price_rows(spark, RATES, date(2026, 5, 1))
    period = Period(date(2026, 10, 6), date(2026, 10, 6), "America/Toronto")

    def total(keep, **options):
        row = token_report(ev, period, prices, **options).where("level = 'total'").first()
        assert row["total_tokens"] == sum(v for (name, _), v in used.items() if keep(name))

    total(lambda name: True)
    total(lambda name: where[name] == "/opt", cwd="/opt")
    total(lambda name: name == "alone", archive="archived")
    total(lambda name: name in ("top", "mid", "low"), session_id="top")
    total(lambda name: name == "low", session_id="low")


def test_usage_belongs_to_the_local_day(spark, build):
    opening = datetime(2026, 3, 29, 0) - timedelta(hours=1)  # midnight of Berlin in UTC
    for n, minutes in enumerate((-1, 0, 23 * 60 - 1, 23 * 60)):  # that day has 23 hours
        build.usage(f"u{n}", (opening + timedelta(minutes=minutes) - T0.replace(tzinfo=None)).total_seconds(), counts(total_tokens=5))
    day = Period(date(2026, 3, 29), date(2026, 3, 29), "Europe/Berlin")
    report = token_report(build.session().done(), day, price_rows(spark, RATES, date(2026, 1, 1)))
    assert report.where("level = 'total'").agg(F.max("observations")).first()[0] == 2
