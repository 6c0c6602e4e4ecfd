"""Live samples to bounded work and wait evidence, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from worktide.functions.time import micros
from worktide.operators.scan import latest, scan, time_chunk, upcoming

# One sample a minute; a whole missed minute is never bridged.
SAMPLE_SECONDS = 60.0
MAX_GAP_SECONDS = 75.0

SPANS = (
    "session_id STRING, kind STRING, start TIMESTAMP, end TIMESTAMP, turn_id STRING, "
    "uncertainty_seconds DOUBLE"
)


def sample_pairs(samples: DataFrame, max_gap: float = MAX_GAP_SECONDS,
                 cadence: float = SAMPLE_SECONDS) -> DataFrame:
    """Adjacent samples of a session in consecutive polls, judged.

    kind is work or wait for the earlier sample's state, gap where nothing may be
    bridged, none where neither holds.
    """
    ordered = samples.withColumn("chunk", time_chunk(F.col("poll_id"), 100_000))
    seen = scan(
        ordered, ["session_id"], "chunk", ["poll_id"],
        before=latest(F.struct("poll_id", "state", "at", "uncertainty_seconds"), inclusive=False),
    )
    elapsed = (micros(F.col("at")) - micros(F.col("before.at"))) / 1_000_000
    skipped = F.col("poll_id") != F.col("before.poll_id") + 1
    kind = (
        F.when(F.col("state") == "unknown", "gap")
        .when(F.col("before").isNull(), "none")
        .when(skipped, "gap")
        .when(elapsed <= 0, "none")
        .when(elapsed > max_gap, "gap")
        .when(F.col("before.state") == "working", "work")
        .when(F.col("before.state") == "waiting", "wait")
        .otherwise("none")
    )
    return seen.select(
        "session_id", kind.alias("kind"), F.col("before.at").alias("start"),
        F.col("at").alias("end"), "turn_id",
        F.greatest(F.lit(cadence), "before.uncertainty_seconds", "uncertainty_seconds", elapsed)
        .alias("uncertainty_seconds"),
    )


def _after(instant: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(instant) + 1)


def turn_around(pairs: DataFrame, turns: DataFrame) -> DataFrame:
    """Pairs with the turn they name, else with the latest-starting one open around them.

    A turn that ends where the pair starts is still around it.
    """
    open_turns = turns.select(
        "session_id", F.col("id").alias("candidate"), F.col("start").alias("turn_start"),
        F.col("end").alias("turn_end"))
    named = pairs.where("turn_id IS NOT NULL").join(
        open_turns.withColumnRenamed("candidate", "turn_id"), ["session_id", "turn_id"])
    # The newest start at or before the sample is found as a running value; older
    # turns are only looked at where that one had ended before the span began.
    lost = pairs.where("turn_id IS NOT NULL").join(
        open_turns.select("session_id", F.col("candidate").alias("turn_id")),
        ["session_id", "turn_id"], "left_anti")
    free = pairs.where("turn_id IS NULL").unionByName(lost).drop("turn_id")
    both = free.select(
        "session_id", F.col("end").alias("at"), F.struct(*free.columns).alias("pair"),
        F.lit(1).alias("late"), F.lit("").alias("tie"),
        F.lit(None).cast(
            "struct<candidate:string,turn_start:timestamp,turn_end:timestamp>").alias("turn"),
    ).unionByName(open_turns.select(
        "session_id", F.col("turn_start").alias("at"),
        F.lit(None).cast(_pair_type(free)).alias("pair"), F.lit(0).alias("late"),
        F.col("candidate").alias("tie"),
        F.struct("candidate", "turn_start", "turn_end").alias("turn"),
    )).withColumn("chunk", time_chunk(micros(F.col("at"))))
    guess = scan(both, ["session_id"], "chunk", ["at", "late", "tie"],
                 newest=latest(F.col("turn"))).where("pair IS NOT NULL")
    alive = F.coalesce(F.col("newest.turn_end") >= F.col("pair.start"), F.lit(True)) & F.col(
        "newest").isNotNull()
    direct = guess.where(alive).select("pair.*", F.col("newest.candidate").alias("turn_id"),
                                       "newest.turn_start", "newest.turn_end")
    rest = guess.where(~alive & F.col("newest").isNotNull()).select("pair.*")
    from worktide.operators.intervals import overlap_join

    spans = open_turns.select(
        "session_id", "candidate", "turn_start", "turn_end", F.col("turn_start").alias("start"),
        F.coalesce(_after(F.col("turn_end")), F.lit("9999-01-01").cast("timestamp")).alias("end"))
    limits = rest.groupBy("session_id").agg(_after(F.max("end")).alias("last"))
    spans = spans.join(limits, "session_id").withColumn("end", F.least("end", "last")).drop("last")
    older = overlap_join(
        rest.withColumns({"s": F.col("start"), "e": F.col("end"), "end": F.greatest(F.col("end"), _after(F.col("start")))}),
        spans, ["session_id"], 86_400
    ).drop("micros", "start", "end").groupBy(
        "session_id", "kind", "s", "e", "uncertainty_seconds"
    ).agg(F.max(F.struct("turn_start", "candidate", "turn_end")).alias("t")).select(
        "session_id", "kind", F.col("s").alias("start"), F.col("e").alias("end"),
        "uncertainty_seconds", F.col("t.candidate").alias("turn_id"), "t.turn_start", "t.turn_end")
    return named.unionByName(direct).unionByName(older)


def turn_for_sample(pairs: DataFrame, turns: DataFrame) -> DataFrame:
    """Spans clipped to their turn, where something of them is left."""
    return turn_around(pairs, turns).select(
        "session_id", "turn_id", "kind",
        F.greatest("start", "turn_start").alias("start"),
        F.least("end", F.coalesce("turn_end", "end")).alias("end"),
        "uncertainty_seconds",
    ).where(F.col("end") > F.col("start"))


def _pair_type(df: DataFrame) -> str:
    return df.schema.simpleString()


def samples_to_spans(samples: DataFrame, turns: DataFrame, max_gap: float = MAX_GAP_SECONDS,
                     cadence: float = SAMPLE_SECONDS) -> DataFrame:
    """(session_id, turn_id, kind work|wait, start, end, uncertainty_seconds)."""
    pairs = sample_pairs(samples, max_gap, cadence).where("kind IN ('work', 'wait')")
    return turn_for_sample(pairs, turns)


def gap_events(samples: DataFrame, turns: DataFrame, evidence: DataFrame | None = None,
               max_gap: float = MAX_GAP_SECONDS, cadence: float = SAMPLE_SECONDS) -> DataFrame:
    """(session_id, at, reason): instants at which a session's observation was interrupted.

    `unknown`: the sample says so. `spacing`: it follows the one of the poll before too late.
    `vanished`: the next poll has no sample of the session; at the time of the next poll there
    is. `restarted`: a sample without one in the poll before, of a turn that had been observed.
    `evidence` has spans (session_id, turn_id, start) that are stored already.
    """
    ordered = samples.withColumn("chunk", time_chunk(F.col("poll_id"), 100_000))
    seen = scan(ordered, ["session_id"], "chunk", ["poll_id"],
                before=latest(F.struct("poll_id", "at"), inclusive=False),
                after=upcoming(F.struct("poll_id")))
    first = F.coalesce(F.col("before.poll_id") != F.col("poll_id") - 1, F.lit(True))
    elapsed = (micros(F.col("at")) - micros(F.col("before.at"))) / 1_000_000
    unknown = F.col("state") == "unknown"
    late = seen.where(unknown | (~first & (elapsed > max_gap))).select(
        "session_id", "at", F.when(unknown, "unknown").otherwise("spacing").alias("reason"))
    # A poll is known by the samples of any session.
    polls = samples.groupBy("poll_id").agg(F.max("at").alias("polled")).withColumns(
        {"all": F.lit(0), "chunk": time_chunk(F.col("poll_id"), 100_000)})
    polls = scan(polls, ["all"], "chunk", ["poll_id"], next=upcoming(F.struct("polled"))).where(
        "next IS NOT NULL").select("poll_id", F.col("next.polled").alias("gone"))
    gone = F.coalesce(F.col("after.poll_id") != F.col("poll_id") + 1, F.lit(True))
    vanished = seen.where(gone).select("session_id", "poll_id").join(polls, "poll_id").select(
        "session_id", F.col("gone").alias("at"), F.lit("vanished").alias("reason"))
    pairs = seen.where(first & ~unknown).select(
        "session_id", F.lit("none").alias("kind"), F.col("at").alias("start"), F.col("at").alias("end"), "turn_id",
        "uncertainty_seconds")
    observed = samples_to_spans(samples, turns, max_gap, cadence).select("session_id", "turn_id", "start")
    if evidence is not None:
        observed = observed.unionByName(evidence.select("session_id", "turn_id", "start"))
    observed = observed.groupBy("session_id", "turn_id").agg(F.min("start").alias("observed"))
    restarted = turn_around(pairs, turns).join(observed, ["session_id", "turn_id"]).where(
        F.col("observed") < F.col("end")).select(
        "session_id", F.col("end").alias("at"), F.lit("restarted").alias("reason"))
    return late.unionByName(vanished).unionByName(restarted)


def observation_gap(samples: DataFrame, turns: DataFrame, max_gap: float = MAX_GAP_SECONDS,
                    evidence: DataFrame | None = None) -> DataFrame:
    """Turns that were open when their session's observation was interrupted get `observation_gap`.

    Each turn looks for the first interruption from its start on, as a running value; whether
    it has ended since makes no difference.
    """
    gaps = gap_events(samples, turns, evidence, max_gap)
    kind = turns.select(F.struct(*turns.columns).alias("turn")).schema["turn"].dataType
    both = turns.select("session_id", F.col("start").alias("at"), F.lit(0).alias("late"), F.col("id").alias("tie"),
                        F.struct(*turns.columns).alias("turn")).unionByName(
        gaps.groupBy("session_id", "at").agg(F.min("reason").alias("tie")).select(
            "session_id", "at", F.lit(1).alias("late"), "tie", F.lit(None).cast(kind).alias("turn")))
    found = scan(both.withColumn("chunk", time_chunk(micros(F.col("at")))), ["session_id"], "chunk",
                 ["at", "late", "tie"], gap=upcoming(F.when(F.col("turn").isNull(), F.struct("at"))))
    open_then = F.col("gap").isNotNull() & F.coalesce(F.col("gap.at") < F.col("turn.end"), F.lit(True))
    flagged = F.array_union("turn.quality", F.array(F.lit("observation_gap")))
    return found.where("turn IS NOT NULL").select(
        "turn.*", F.when(open_then, flagged).otherwise(F.col("turn.quality")).alias("now")
    ).drop("quality").withColumnRenamed("now", "quality").select(turns.columns)


class GapProcessor(StatefulProcessor):
    """Interruptions of one session's observation, with a timer for the poll that should follow.

    The state is the last sample and the time of its timer. A sample that comes before the
    timer fires moves it; a timer that fires is a poll without the session.
    """

    def __init__(self, max_gap: float, cadence: float):
        self.max_gap, self.cadence = max_gap, cadence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "poll_id BIGINT, at_us BIGINT, timer BIGINT")

    def handleInputRows(self, key, rows, timerValues):
        frame = pd.concat(list(rows)).sort_values("poll_id")
        poll, at, timer = self.last.get() if self.last.exists() else (None, None, None)
        now = frame["at"].astype("datetime64[us]").astype("int64")
        before_poll = frame["poll_id"].shift(1).fillna(-1 if poll is None else poll)
        before_at = now.shift(1).fillna(0 if at is None else at)
        fresh = before_poll + 1 != frame["poll_id"]
        unknown = frame["state"] == "unknown"
        spacing = ~fresh & ~unknown & (now - before_at > self.max_gap * 1e6)
        out = pd.DataFrame({"at": frame["at"], "reason": np.select([unknown, spacing], ["unknown", "spacing"], "")})
        # Polls inside the batch, or since the last one, that did not have the session.
        skipped = fresh & (before_poll >= 0)
        if timer is None and len(skipped):
            skipped.iloc[0] = False  # the timer of the last sample has told that
        gone = pd.DataFrame({"at": pd.to_datetime(before_at[skipped] + self.cadence * 1e6, unit="us"), "reason": "vanished"})
        out = pd.concat([out[out["reason"] != ""], gone])
        if timer is not None:
            self.handle.deleteTimer(timer)
        due = int(now.iloc[-1] / 1000 + self.max_gap * 1000) + 1
        self.handle.registerTimer(due)
        self.last.update((int(frame["poll_id"].iloc[-1]), int(now.iloc[-1]), due))
        if len(out):
            yield out.assign(session_id=key[0])[["session_id", "at", "reason"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        poll, at, _ = self.last.get()
        self.last.update((poll, at, None))
        gone = pd.to_datetime([at + int(self.cadence * 1e6)], unit="us")
        yield pd.DataFrame({"session_id": [key[0]], "at": gone, "reason": ["vanished"]})

    def close(self) -> None:
        pass


def gap_stream(samples: DataFrame, max_gap: float = MAX_GAP_SECONDS, cadence: float = SAMPLE_SECONDS) -> DataFrame:
    """(session_id, at, reason): `unknown`, `spacing` and `vanished` of gap_events, as they happen.

    `samples` is a stream. Its watermark on `at` moves with any session's samples, so a session
    that none come of any more is noticed once the others are more than `max_gap` ahead; `at` is
    then the time at which its next sample was due. What was `restarted` follows from stored
    spans and is left to gap_events. Needs the RocksDB state store, which is set here for
    the session; state is a few numbers for each session.
    """
    spark = samples.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = samples.withWatermark("at", "0 seconds")
    return timed.groupBy("session_id").transformWithStateInPandas(
        GapProcessor(max_gap, cadence), "session_id STRING, at TIMESTAMP, reason STRING", "append", "EventTime")


def sample_stream(samples: DataFrame, max_gap: float = MAX_GAP_SECONDS,
                  cadence: float = SAMPLE_SECONDS) -> DataFrame:
    """Streaming form of sample_pairs: the last sample of a session is its state."""
    state_type = "poll_id BIGINT, state STRING, at TIMESTAMP, uncertainty_seconds DOUBLE"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
        rows = pd.concat(list(batches)).sort_values("poll_id")
        last = state.get if state.exists else None
        out = []
        for row in rows.itertuples():
            kind, start, unsure = "none", None, None
            if last is not None:
                start = last[2]
                elapsed = (row.at - start).total_seconds()
                unsure = max(cadence, last[3], row.uncertainty_seconds, elapsed)
                if row.poll_id != last[0] + 1 or elapsed > max_gap:
                    kind = "gap"
                elif elapsed > 0:
                    kind = {"working": "work", "waiting": "wait"}.get(last[1], "none")
            if row.state == "unknown":
                kind = "gap"
            out.append((key[0], kind, start, row.at, row.turn_id, unsure))
            last = (int(row.poll_id), row.state, row.at, float(row.uncertainty_seconds))
        state.update(last)
        yield pd.DataFrame(out, columns=["session_id", "kind", "start", "end", "turn_id",
                                         "uncertainty_seconds"])

    return samples.groupBy("session_id").applyInPandasWithState(
        step, SPANS, state_type, "append", GroupStateTimeout.NoTimeout)
