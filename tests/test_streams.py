"""Status, samples, and streams that must equal their batch form."""

from __future__ import annotations

from conftest import Build, at
from pyspark.sql import functions as F

from worktide.evidence import COUNTERS, SCHEMAS
from worktide.operators.status import session_status
from worktide.operators.usage import counter_delta
from worktide.streaming.samples import (
    gap_events,
    gap_stream,
    observation_gap,
    sample_pairs,
    sample_stream,
    samples_to_spans,
)
from worktide.streaming.usage import status_stream, usage_stream

RECORDS = ("file_path STRING, block BIGINT, ord BIGINT, at TIMESTAMP, kind STRING, event STRING, "
           "session_id STRING, cwd STRING, turn_id STRING, role STRING, message STRING, "
           "last_agent_message STRING, content ARRAY<STRUCT<type: STRING, text: STRING>>")


def record(n, event, path="f", turn=None, message=None, final=None):
    return (path, n // 2, n, at(n), "event_msg", event, None, None, turn, None, message, final, None)


def polls(spark, *rows):
    data = [(poll, "s", state, at(second), None, None, 1.0) for poll, state, second in rows]
    return spark.createDataFrame(data, SCHEMAS["samples"])


def drain(spark, stream, mode, name):
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name).collect()


def test_status_follows_the_lifecycle_only(spark):
    rows = [record(0, "task_started", turn="a"), record(1, "user_message", message="hi"),
            record(2, "agent_message", message="thinking")]
    busy = session_status(spark.createDataFrame(rows, RECORDS)).first()
    assert (busy["status"], busy["last_user_message"]) == ("mid_turn", "hi")
    rows += [record(3, "task_complete", turn="other"), record(4, "task_complete", turn="a",
                                                              final="done")]
    idle = session_status(spark.createDataFrame(rows, RECORDS)).first()
    assert (idle["status"], idle["last_assistant_message"]) == ("idle", "done")


def test_samples_become_bounded_spans(spark):
    ev = Build(spark).session().turn(0, None).done()
    samples = polls(spark, (1, "working", 0), (2, "working", 1), (3, "waiting", 2),
                    (4, "waiting", 3), (5, "working", 4), (6, "working", 5), (7, "idle", 6))
    spans = samples_to_spans(samples, ev.turns, 3, 1)
    got = {r["kind"]: r["s"] for r in spans.groupBy("kind").agg(
        F.sum(F.unix_seconds("end") - F.unix_seconds("start")).alias("s")).collect()}
    assert got == {"work": 4, "wait": 2}


def test_outage_is_flagged_and_not_bridged(spark):
    ev = Build(spark).session().turn(0, None).done()
    samples = polls(spark, (1, "working", 0), (2, "working", 1), (4, "working", 60),
                    (5, "working", 61))
    spans = samples_to_spans(samples, ev.turns, 3, 1).agg(
        F.sum(F.unix_seconds("end") - F.unix_seconds("start"))).first()[0]
    assert spans == 2
    assert "observation_gap" in observation_gap(samples, ev.turns, 3).first()["quality"]


def watched(spark, *rows):
    """Samples (poll, session, state, second), and what interrupted them."""
    data = [(poll, sid, state, at(second), None, None, 1.0) for poll, sid, state, second in rows]
    return spark.createDataFrame(data, SCHEMAS["samples"])


def flagged(spark, samples, ev, **options):
    got = observation_gap(samples, ev.turns, **options).collect()
    return {(r["session_id"], r["id"]) for r in got if "observation_gap" in r["quality"]}


def test_unknown_samples_flag_what_is_open_then(spark):
    """A turn that has ended since is flagged as well, one that begins later is not."""
    ev = Build(spark).session().turn(0, 130, tid="then").turn(140, None, tid="later").done()
    samples = watched(spark, (1, "s", "working", 0), (2, "s", "unknown", 60), (3, "s", "working", 120),
                      (4, "s", "working", 180))
    assert flagged(spark, samples, ev) == {("s", "then")}


def test_a_session_that_vanishes_is_flagged_at_the_next_poll(spark):
    """Nothing comes of it any more; a turn that ended before that poll was not interrupted."""
    build = Build(spark).session("gone").turn(0, None, "gone", "open").turn(-50, 30, "gone", "done").session("here")
    ev = build.turn(0, None, "here", "t").session("last").turn(0, None, "last", "t").done()
    samples = watched(spark, (1, "gone", "working", 0), (1, "here", "working", 0), (2, "here", "working", 60),
                      (2, "last", "working", 60), (3, "here", "working", 120), (3, "last", "working", 120))
    assert flagged(spark, samples, ev) == {("gone", "open")}
    events = [(r["session_id"], r["at"].timestamp() - at(0).timestamp(), r["reason"])
              for r in gap_events(samples, ev.turns).collect()]
    assert events == [("gone", 60.0, "vanished")]


def test_a_first_sample_interrupts_only_what_was_observed(spark):
    """After a restart the turn has evidence of before; without any, it is just new."""
    ev = Build(spark).session().turn(0, None, tid="seen").session("r").turn(0, None, "r", "new").done()
    samples = watched(spark, (7, "s", "working", 60), (7, "r", "working", 60))
    assert flagged(spark, samples, ev) == set()
    stored = Build(spark).span("coverage", 0, 30, tid="seen").done().coverage
    assert flagged(spark, samples, ev, evidence=stored) == {("s", "seen")}
    # Back after a poll without it: the turn that was seen before is flagged, a new one is not.
    ev = Build(spark).session().turn(0, 200, tid="old").turn(210, None, tid="fresh").done()
    samples = watched(spark, (1, "s", "working", 0), (2, "s", "working", 60), (3, "o", "idle", 120),
                      (4, "s", "working", 240), (5, "s", "working", 300))
    assert flagged(spark, samples, ev) == {("s", "old")}


def test_gap_stream_tells_what_batch_does(spark, tmp_path):
    samples = watched(
        spark, (1, "a", "working", 0), (1, "b", "working", 0), (2, "a", "unknown", 60), (2, "b", "working", 60),
        (3, "b", "working", 140), (3, "c", "idle", 140), (4, "b", "working", 200), (5, "b", "idle", 260),
        (6, "a", "working", 320), (6, "b", "working", 320), (7, "b", "working", 380), (8, "b", "idle", 440),
        (9, "b", "idle", 500))
    for low, high in ((0, 2), (2, 4), (4, 7), (7, 9)):
        samples.where(f"poll_id > {low} AND poll_id <= {high}").coalesce(1).write.mode("append").parquet(
            str(tmp_path / "in"))
    source = spark.readStream.schema(SCHEMAS["samples"]).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drain(spark, gap_stream(source), "append", "gap_stream")
    ev = Build(spark).session("a").session("b").session("c").done()
    want = gap_events(samples, ev.turns).collect()
    assert sorted((r["session_id"], r["reason"]) for r in got) == sorted((r["session_id"], r["reason"]) for r in want)
    assert {(r["session_id"], r["reason"]) for r in want} == {
        ("a", "unknown"), ("a", "vanished"), ("b", "spacing"), ("c", "vanished")}


def test_sample_stream_equals_batch(spark, tmp_path):
    samples = polls(spark, (1, "working", 0), (2, "waiting", 60), (3, "idle", 120),
                    (5, "working", 240), (6, "unknown", 300), (7, "working", 360))
    for low, high in ((0, 3), (3, 9)):
        samples.where(f"poll_id > {low} AND poll_id <= {high}").coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(SCHEMAS["samples"]).option("maxFilesPerTrigger", 1).parquet(
        str(tmp_path / "in"))
    got = drain(spark, sample_stream(source), "append", "sample_stream")
    want = sample_pairs(samples).collect()
    assert sorted((r["end"], r["kind"]) for r in got) == sorted((r["end"], r["kind"]) for r in want)


def test_usage_stream_equals_batch(spark, tmp_path):
    values = [100, 160, 10, 30, 30]
    rows = [("f", n, *([v] * 6)) for n, v in enumerate(values)]
    schema = "file_path STRING, ord BIGINT, " + ", ".join(f"{c} BIGINT" for c in COUNTERS)
    df = spark.createDataFrame(rows, schema)
    for low in (0, 2):
        df.where(f"ord >= {low} AND ord < {low + (2 if low == 0 else 9)}").coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(
        str(tmp_path / "in"))
    got = {r["ord"]: r["input_tokens"]
           for r in drain(spark, usage_stream(source), "append", "usage_stream")}
    whole = F.struct(*COUNTERS)
    batch = counter_delta(df.select(
        "file_path", F.lit(0).alias("block"), "ord", whole.alias("cumulative"),
        whole.alias("last_usage")))
    assert got == {r["ord"]: r["delta"] and r["delta"]["input_tokens"] for r in batch.collect()}
    assert got == {0: 100, 1: 60, 2: None, 3: 20, 4: 0}


def test_a_grown_source_adds_only_what_is_new(spark, tmp_path):
    schema = "file_path STRING, ord BIGINT, " + ", ".join(f"{c} BIGINT" for c in COUNTERS)
    values = [40, None, 55, 62]
    for number, size in enumerate((3, 4)):
        rows = [("f", n, *([v] * 6)) for n, v in enumerate(values[:size])]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r["ord"]: r["input_tokens"] for r in drain(spark, usage_stream(source), "append", "grown")}
    assert got == {0: 40, 1: None, 2: 15, 3: 7}


def test_an_unknown_turn_name_falls_back_on_the_open_turn(spark):
    ev = Build(spark).session().turn(0, None).done()
    rows = [(n, "s", "working", at(n), "no such turn", None, 1.0) for n in range(3)]
    spans = samples_to_spans(spark.createDataFrame(rows, SCHEMAS["samples"]), ev.turns, 3, 1)
    assert {(r["turn_id"], r["kind"]) for r in spans.collect()} == {("t", "work")}


def test_status_stream_ends_like_batch(spark, tmp_path):
    rows = [record(0, "task_started", turn="a"), record(1, "task_complete", turn="a"),
            record(2, "task_started", turn="b"), record(3, "task_started", "g", turn="c"),
            record(4, "task_complete", "g")]
    df = spark.createDataFrame(rows, RECORDS)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = {r["file_path"]: r["status"]
           for r in drain(spark, status_stream(source), "update", "status_stream")}
    assert got == {r["file_path"]: r["status"] for r in session_status(df).collect()}
    assert got == {"f": "mid_turn", "g": "idle"}
