"""Counter increments and status kept up by micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from worktide.evidence import COUNTERS, Evidence
from worktide.plans.time_reports import root_work
from worktide.sources.evidence import QUOTA_KEY

INCREMENTS = "file_path STRING, ord BIGINT, reset BOOLEAN, " + ", ".join(
    f"{name} BIGINT" for name in COUNTERS)


def usage_stream(readings: DataFrame) -> DataFrame:
    """Increments per source across micro-batches, as `counter_delta` gives them in batch.

    `readings` has (file_path, ord, and the six counters as columns), and `block` if it comes
    from `stream_rollouts`. The state is the last place read and the last reading that had any
    counter; it outlives a rewrite of the source, which has places of its own. Rows up to the
    last place are passed over. Batches are bounded in bytes, and each is one shifted
    subtraction per source.
    """
    counters = list(COUNTERS)
    state_type = "block BIGINT, ord BIGINT, seen BOOLEAN, " + ", ".join(f"{name} BIGINT" for name in counters)
    if "block" not in readings.columns:
        readings = readings.withColumn("block", F.lit(0).cast("long"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
        block, last, seen, *held = state.get if state.exists else (-1, -1, False, *[None] * len(counters))
        rows = pd.concat(list(batches)).drop_duplicates(["block", "ord"]).sort_values(["block", "ord"])
        new = (rows["block"] > block) | ((rows["block"] == block) & (rows["ord"] > last))
        rows = rows[new].reset_index(drop=True)
        if rows.empty:
            return
        now = rows[counters].astype("Int64")
        whole = now.notna().any(axis=1)
        start = pd.DataFrame([[pd.NA if v is None else v for v in held]], columns=counters).astype("Int64")
        # The reading before, skipping those without counters.
        known = pd.concat([start, now[whole]], ignore_index=True)
        before = known.iloc[whole.cumsum().shift(1, fill_value=0)].reset_index(drop=True)
        first = ~((whole.cumsum().shift(1, fill_value=0) > 0) | seen)
        delta = now - before
        delta[first & whole] = now[first & whole]
        falls = (delta < 0).fillna(False).any(axis=1) & ~first
        delta[falls] = pd.NA
        tail = known.iloc[-1]
        state.update((int(rows["block"].iloc[-1]), int(rows["ord"].iloc[-1]), bool(seen or whole.any()),
                      *[None if pd.isna(v) else int(v) for v in tail]))
        yield delta.assign(file_path=key[0], ord=rows["ord"], reset=falls)[
            ["file_path", "ord", "reset", *counters]]

    return readings.groupBy("file_path").applyInPandasWithState(
        step, INCREMENTS, state_type, "append", GroupStateTimeout.NoTimeout)


STATUS = "file_path STRING, status STRING, last_updated TIMESTAMP"


def status_stream(records: DataFrame) -> DataFrame:
    """mid_turn or idle per source, kept up to date; the state is the open turn's id."""
    state_type = "open BOOLEAN, turn_id STRING, last_updated TIMESTAMP"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
        rows = pd.concat(list(batches)).sort_values(["block", "ord"])
        is_open, turn, updated = state.get if state.exists else (False, None, None)
        newest = rows["at"].max()
        if updated is None or (pd.notna(newest) and newest > updated):
            updated = None if pd.isna(newest) else newest
        marks = rows[(rows["kind"] == "event_msg") & rows["event"].isin(
            ["task_started", "task_complete", "turn_aborted"])]
        for event, tid in zip(marks["event"], marks["turn_id"]):
            if event == "task_started":
                is_open, turn = True, tid
            elif tid is None or turn is None or tid == turn:
                is_open, turn = False, None
        state.update((is_open, turn, updated))
        yield pd.DataFrame(
            {"file_path": [key[0]], "status": ["mid_turn" if is_open else "idle"],
             "last_updated": [updated]})

    return records.groupBy("file_path").applyInPandasWithState(
        step, STATUS, state_type, "update", GroupStateTimeout.NoTimeout)


def dedupe_stream(observations: DataFrame, watermark: str = "1 day",
                  keys: list[str] | None = None) -> DataFrame:
    """Drop repeats that arrive within the watermark, with bounded state.

    Older repeats pass; the appends in sinks remove them exactly.
    """
    return observations.withWatermark("at", watermark).dropDuplicatesWithinWatermark(
        keys or QUOTA_KEY)


def refresh_changed(
    evidence: Callable[[], Evidence], path: str, tz: str
) -> Callable[[DataFrame, int], None]:
    """foreachBatch step: recompute the work of the sessions a batch touched.

    Output is partitioned by batch; the newest batch of a session is its truth, so
    a repeated batch overwrites itself and nothing else.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        changed = batch.select("session_id").where("session_id IS NOT NULL").distinct()
        ev = evidence()
        touched = ev.sessions.join(
            changed, ev.sessions["id"] == changed["session_id"], "left_semi")
        facts = root_work(ev, tz, selected=touched)
        facts.groupBy("session_id", "day", "cwd").agg(F.sum("micros").alias("micros")).write.mode(
            "overwrite").parquet(f"{path}/batch_id={batch_id}")

    return step


def current_work(refreshed: DataFrame) -> DataFrame:
    """Work by session from the newest batch that touched it."""
    newest = refreshed.groupBy("session_id").agg(F.max("batch_id").alias("batch_id"))
    return refreshed.join(newest, ["session_id", "batch_id"])
