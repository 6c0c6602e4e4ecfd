"""Journals, snapshots, appends and consolidation."""

from __future__ import annotations

import json
import pickle
from datetime import UTC, date, datetime
from decimal import Decimal

import pytest
from conftest import Build, counts
from pyspark.sql import functions as F
from test_tokens import Journal

from worktide.operators.pricing import load_catalog, standard_catalog
from worktide.plans.period import Period
from worktide.plans.token_reports import fx_status
from worktide.sources.evidence import (
    load_evidence,
    load_fx,
    load_period,
    read_quota_journal,
    read_session_snapshots,
    read_usage_journal,
    upgrade_ledger_version,
)
from worktide.sources.growing import GrowingReader, Position, advance, lines_of, newest_epoch, pieces_between, store_of
from worktide.sources.rollouts import parse_lines, read_lines, stream_rollouts
from worktide.sources.sinks import append_quota, append_usage, consolidate, export, new_usage, write_daily_records
from worktide.streaming.usage import dedupe_stream

READING = {"at": "2026-10-06T16:00:00Z", "limit_id": "lim", "plan_type": None, "bucket": "primary",
           "window_minutes": 10080, "resets_at": 5, "used_percent": 10.0}
TURN = {"id": "t", "cwd": "/a", "start": "2026-10-06T16:00:00Z", "end": None,
        "coverage": [{"start": "2026-10-06T16:00:00Z", "end": "2026-10-06T16:00:05Z"}]}
DOC = {"id": "s", "cwd": "/a", "created": "2026-10-06T16:00:00Z",
       "updated": "2026-10-06T16:00:00Z", "turns": {"t": TURN}}


def put(path, *values):
    path.write_text("".join(json.dumps(v) + "\n" for v in values))
    return str(path)


def usage_row(uid, total):
    return {"id": uid, "session_id": "s", "at": "2026-10-06T16:00:00Z",
            "delta": {"total_tokens": total}}


def test_quota_journal(spark, tmp_path):
    assert read_quota_journal(spark, put(tmp_path / "q", READING, READING)).count() == 1
    bad = put(tmp_path / "bad", {**READING, "used_percent": 101.0})
    with pytest.raises(Exception, match="restore a valid backup"):
        read_quota_journal(spark, bad).collect()


def test_usage_journal(spark, tmp_path):
    assert read_usage_journal(
        spark, put(tmp_path / "u", usage_row("a", 1), usage_row("a", 1))).count() == 1
    clash = put(tmp_path / "c", usage_row("a", 1), usage_row("a", 2))
    with pytest.raises(Exception, match="conflicting usage identity"):
        read_usage_journal(spark, clash).collect()


def test_snapshots_and_old_versions(spark, tmp_path):
    tables = read_session_snapshots(spark, put(tmp_path / "s.json", DOC))
    assert tables["turns"].first()["quality"] == ["historical_upper_bound"]
    assert tables["coverage"].count() == 1
    wrong = put(tmp_path / "w.json", {**DOC, "turns": {"x": TURN}})
    with pytest.raises(Exception, match="identifier/key mismatch"):
        read_session_snapshots(spark, wrong)["sessions"].collect()
    old = upgrade_ledger_version(spark, put(tmp_path / "l.json",
                                            {"version": 2, "sessions": {"s": DOC}}))
    odd = upgrade_ledger_version(spark, put(tmp_path / "o.json", {"version": 2, "sessions": {"x": DOC}}))
    with pytest.raises(Exception, match="session key differs from its id"):
        odd.sessions.collect()
    assert old.sessions.count() == 1 and old.quota.count() == 0 and old.usage.count() == 0


def test_appends_are_idempotent(spark, tmp_path):
    ev = Build(spark).quota(0, 10).quota(1, 11, plan=None).usage("u", 0, counts(total_tokens=1)).done()
    path = str(tmp_path / "quota")
    append_quota(ev.quota, path, ev.quota.limit(0))
    append_quota(ev.quota, path, spark.read.parquet(path))
    assert spark.read.parquet(path).count() == 2
    other = Build(spark).usage("u", 0, counts(total_tokens=2)).done().usage
    assert new_usage(ev.usage, ev.usage).count() == 0
    with pytest.raises(Exception, match="conflicting usage observation identity"):
        new_usage(other, ev.usage).collect()


def test_consolidation_publishes_once_checked(spark, tmp_path):
    a = Build(spark).session().turn(0, 1).quota(0, 1).usage("u", 0, counts(total_tokens=1)).done()
    b = Build(spark).session().turn(0, 1).quota(5, 2).usage("u", 0, counts(total_tokens=1)).done()
    rows = {r["table"]: r["rows"] for r in consolidate(a, b, str(tmp_path / "out")).collect()}
    assert rows["sessions"] == 1 and rows["quota"] == 2 and rows["usage"] == 1
    export(b.turns, str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1


def test_daily_records_leave_no_stale_day(spark, tmp_path):
    path = str(tmp_path / "records")
    both = Build(spark).session().session("q").turn(0, 60).turn(90_000, 90_060, tid="u").turn(0, 30, sid="q").done()
    write_daily_records(both, path)
    assert spark.read.parquet(path).count() == 3
    less = Build(spark).session().turn(0, 60).done()
    write_daily_records(less, path)
    rows = spark.read.parquet(path).select("session_id", F.col("date").cast("string")).collect()
    assert sorted(map(tuple, rows)) == [("q", "2026-10-06"), ("s", "2026-10-06")]


def test_a_period_reads_its_folders_only(spark, tmp_path):
    ev = Build(spark).usage("u", 0, counts(total_tokens=1)).usage("v", 900_000, counts(total_tokens=2)).done()
    append_usage(ev.usage, str(tmp_path / "usage"), ev.usage.limit(0))
    day = Period(date(2026, 10, 6), date(2026, 10, 6), "America/Toronto")
    stored = load_evidence(spark, str(tmp_path)).with_tables(quota=ev.quota)
    part = load_period(stored, day, "lim", 10080).usage
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "date#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert [r["id"] for r in part.collect()] == ["u"]


def test_catalog_and_rates(spark, tmp_path):
    rate = {"input": "2", "output": "10"}
    good = {"models": {"m": {"model_id": "m", "short": rate}}}
    row = load_catalog(spark, put(tmp_path / "c.json", good)).first()
    assert (row["short"]["output"], row["cache_write_mode"]) == (Decimal("10"), "unsupported")
    bad = {"models": {"m": {"model_id": "n", "short": rate}}}
    with pytest.raises(Exception, match="invalid price entry"):
        load_catalog(spark, put(tmp_path / "b.json", bad)).collect()
    assert standard_catalog(spark).count() == 10
    rates = put(tmp_path / "fx", {"rate": 1.3, "observation_date": "2026-10-01"},
                {"rate": 1.35, "observation_date": "2026-10-05"}, {"rate": -1})
    fx = fx_status(load_fx(spark, rates), datetime(2026, 10, 6, tzinfo=UTC)).first()
    assert (fx["rate"], fx["age_days"], fx["status"]) == (Decimal("1.35"), 1, "stale")


def stream_into(spark, tmp_path, **options):
    """One run of the log stream, on from where the last one ended; all lines it ever gave."""
    stream = stream_rollouts(spark, str(tmp_path / "home"), str(tmp_path / "positions"), **options)
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).start(
        str(tmp_path / "lines"))
    query.processAllAvailable()
    query.stop()
    return spark.read.parquet(str(tmp_path / "lines"))


def values(lines):
    return [(r.epoch, r.value) for r in lines.orderBy("file_path", "block", "ord").collect()]


def test_a_log_that_grows_is_read_on(spark, tmp_path):
    log = tmp_path / "home" / "sessions" / "2026" / "a.jsonl"
    log.parent.mkdir(parents=True)
    old = tmp_path / "home" / "archived_sessions" / "b.jsonl"
    old.parent.mkdir()
    old.write_text("only\n")
    (tmp_path / "home" / "session_index.jsonl").write_text('{"id": "main"}\n')
    log.write_text("one\ntw")
    first = stream_into(spark, tmp_path)
    assert values(first) == [(0, "only"), (0, "one")]
    assert first.where("archived").count() == 1
    with log.open("a") as out:
        out.write("o\nthree")
    assert values(stream_into(spark, tmp_path)) == [(0, "only"), (0, "one"), (0, "two")]
    assert values(stream_into(spark, tmp_path)) == [(0, "only"), (0, "one"), (0, "two")]
    with log.open("a") as out:
        out.write("\r\n" + "x" * 50 + "\nfive\n")
    grown = stream_into(spark, tmp_path, max_bytes=7)
    assert values(grown) == [(0, "only"), *[(0, v) for v in ("one", "two", "three", "x" * 50, "five")]]
    log.write_text("one\ntwo\n")  # cut short
    assert values(stream_into(spark, tmp_path))[-2:] == [(1, "one"), (1, "two")]
    log.write_text("uno\ntwo\n")  # as long as before
    log_now = stream_into(spark, tmp_path)
    assert values(log_now)[-2:] == [(2, "uno"), (2, "two")]
    now = {(r.file_path.rpartition("/")[2], r.value) for r in newest_epoch(log_now).collect()}
    batch = {(r.file_path.rpartition("/")[2], r.value) for r in read_lines(spark, str(tmp_path / "home")).collect()}
    assert now == batch


def test_growth_over_changed_bytes_is_a_rewrite(tmp_path):
    log = tmp_path / "a.jsonl"
    store, path = store_of(str(log))

    def look(was, budget=1 << 30):
        stat = log.stat()
        return advance(store, path, stat.st_size, stat.st_mtime_ns, was, budget)

    log.write_text("head " * 100 + "\n" + "old tail\n")
    first = look(Position())
    log.write_text("head " * 100 + "\n" + "new tail\n" + "more\n")
    second = look(first)
    assert (second.epoch, second.consumed) == (1, log.stat().st_size)
    log.write_text("other " * 100 + "\n" + "new tail\n" + "more\n" * 200)
    assert look(second).epoch == 2
    log.write_text("")
    assert look(look(second)).consumed == 0
    assert look(Position(size=0, changed=log.stat().st_mtime_ns)) == Position(size=0, changed=log.stat().st_mtime_ns)


def test_a_reader_keeps_the_positions_it_handed_out(tmp_path, monkeypatch):
    """Their file is for a restart; tasks are sent none of them."""
    (tmp_path / "home" / "sessions").mkdir(parents=True)
    (tmp_path / "home" / "sessions" / "a.jsonl").write_text("one\ntwo\n")
    reader = GrowingReader(str(tmp_path / "home"), str(tmp_path / "positions"), 1 << 20)
    end = reader.latestOffset()
    again = GrowingReader(str(tmp_path / "home"), str(tmp_path / "positions"), 1 << 20)
    assert again._load(end["version"]) == reader._load(end["version"]) != {}
    assert pickle.loads(pickle.dumps(reader)).held == {}
    monkeypatch.setattr("worktide.sources.growing.json.loads", None)
    assert [r[2:4] for p in reader.partitions({"version": 0}, end) for r in p.ranges] == [(0, 8)]
    assert reader.latestOffset() == end


def test_pieces_cover_every_line_once(tmp_path):
    log = tmp_path / "a.jsonl"
    lines = [b"x" * (k * 7 % 23) for k in range(200)]
    log.write_bytes(b"\n".join(lines) + b"\n")
    store, path = store_of(str(log))
    size = log.stat().st_size
    for step in (1, 5, 64, 1000):
        got = [x for at in range(0, size, step) for x in lines_of(store, path, at, min(at + step, size), 0)]
        assert [line for _, line in got] == lines
        assert got[0][0] == 0 and got[-1][0] == size - 1 - len(lines[-1])
    old = {"a": Position(consumed=10), "b": Position(consumed=5)}
    new = {"a": Position(consumed=30), "b": Position(consumed=3, epoch=1), "c": Position(consumed=0)}
    assert [p.ranges for p in pieces_between(old, new)] == [[("a", 0, 10, 30, 10), ("b", 1, 0, 3, 0)]]


def test_records_of_a_streamed_log(spark, tmp_path):
    folder = tmp_path / "home" / "sessions"
    folder.mkdir(parents=True)
    log = Journal().meter(9).meter(12)
    (folder / "a.jsonl").write_text("\n".join(log.rows))  # its last line is still open
    rows = parse_lines(stream_into(spark, tmp_path)).orderBy("block", "ord").collect()
    assert [r["kind"] for r in rows] == ["session_meta", "event_msg"]


def test_repeats_in_a_stream(spark, tmp_path):
    ev = Build(spark).quota(0, 10).quota(0, 10).done()
    ev.quota.write.parquet(str(tmp_path / "q"))
    source = spark.readStream.schema(ev.quota.schema).parquet(str(tmp_path / "q"))
    query = dedupe_stream(source).writeStream.format("memory").queryName("once").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("once").count() == 1
