"""Which model and reasoning level owned a stretch of work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktide.functions.time import instant, micros
from worktide.operators.intervals import (
    clip,
    fuse_slots,
    owned_slots,
    overlap_join,
    owner_of,
    span_marks,
    turn_pieces,
)
from worktide.operators.scan import latest, scan, time_chunk, upcoming

def _readings(contexts: DataFrame, keys: list[str]) -> DataFrame:
    """One setting per (keys, at); disagreement at one instant is Unknown."""
    setting = F.struct("model_id", "reasoning_level")
    same = F.min(setting) == F.max(setting)
    unknown = F.struct(
        F.lit(None).cast("string").alias("model_id"),
        F.lit(None).cast("string").alias("reasoning_level"),
    )
    return contexts.groupBy(*keys, "at").agg(
        F.when(same, F.max(setting)).otherwise(unknown).alias("setting"),
        (~same).alias("conflict"),
    )


def _effective(turns: DataFrame, contexts: DataFrame) -> DataFrame:
    """Settings by the instant (µs) they take effect in their turn.

    The first evidence covers the turn from its start, later evidence begins at
    its own instant, and of several effective at once the last stands.
    """
    keys = ["session_id", "turn_id"]
    readings = _readings(contexts, keys)
    opening = (
        contexts.groupBy(*keys)
        .agg(F.min("at").alias("first_at"))
        .join(
            turns.select(
                "session_id", F.col("id").alias("turn_id"), micros(F.col("start")).alias("begin")
            ),
            keys,
        )
    )
    return (
        readings.join(opening, keys)
        .withColumn(
            "us",
            F.when(F.col("at") == F.col("first_at"), F.col("begin")).otherwise(
                F.greatest(micros(F.col("at")), "begin")
            ),
        )
        .groupBy(*keys, "us")
        .agg(F.max_by("setting", "at").alias("setting"))
        .withColumn("chunk", time_chunk(F.col("us")))
    )


def context_timeline(
    turns: DataFrame, contexts: DataFrame, *, collapse: bool = True
) -> DataFrame:
    """Setting in force from `start` to `end` (null for the last) in every turn.

    Repeats of a setting collapse unless told otherwise; attribution does not
    need that and saves a pass.
    """
    keys = ["session_id", "turn_id"]
    changes = _effective(turns, contexts)
    if collapse:
        before = scan(
            changes, keys, "chunk", ["us"], earlier=latest(F.struct("setting"), inclusive=False)
        )
        changes = before.where(
            F.col("earlier").isNull() | ~F.col("earlier.setting").eqNullSafe(F.col("setting"))
        ).drop("earlier")
    return scan(changes, keys, "chunk", ["us"], until=upcoming(F.col("us"))).select(
        *keys,
        instant(F.col("us")).alias("start"),
        instant(F.col("until")).alias("end"),
        "setting.model_id",
        "setting.reasoning_level",
    )


def context_conflicts(contexts: DataFrame) -> DataFrame:
    """Instants of a turn with more than one setting."""
    return _readings(contexts, ["session_id", "turn_id"]).where("conflict").select(
        "session_id", "turn_id", "at"
    )


def latest_model(contexts: DataFrame) -> DataFrame:
    """Newest setting of each session; Unknown when the newest instant disagrees."""
    return (
        _readings(contexts, ["session_id"])
        .groupBy("session_id")
        .agg(F.max_by("setting", "at").alias("setting"), F.max("at").alias("at"))
        .select("session_id", "setting.model_id", "setting.reasoning_level", "at")
    )


def modelled_pieces(pieces: DataFrame, timeline: DataFrame) -> DataFrame:
    """Cut turn pieces where the setting of their turn changes.

    A finished turn is one span, so its timeline rows are the cut. Observed
    coverage is many spans; it meets the timeline in time bins. Time with no
    setting in force stays as its own Unknown piece.
    """
    keys = ["session_id", "turn_id"]
    spans = timeline.select(
        *keys,
        F.col("start").alias("from"),
        F.coalesce("end", F.lit("9999-01-01").cast("timestamp")).alias("until"),
        "model_id",
        "reasoning_level",
    )
    done = pieces.where("NOT unfinished").join(spans, keys, "left")
    done = (
        done.withColumn("start", F.greatest("start", "from"))
        .withColumn("end", F.least("end", "until"))
        .where(F.col("end") > F.col("start"))
        .drop("from", "until")
    )
    # A timeline starts with its turn, so a turn with any evidence has no uncovered part.
    known = spans.select(*keys).distinct()
    open_pieces = pieces.where("unfinished")
    seen = open_pieces.join(known, keys, "left_anti").withColumns(
        {"model_id": F.lit(None).cast("string"), "reasoning_level": F.lit(None).cast("string")}
    )
    bounds = open_pieces.groupBy(*keys).agg(F.max("end").alias("last_end"))
    cut = overlap_join(
        open_pieces,
        spans.join(bounds, keys).select(
            *keys,
            F.col("from").alias("start"),
            F.least("until", "last_end").alias("end"),
            "model_id",
            "reasoning_level",
        ),
        keys,
    ).drop("micros")
    return done.unionByName(seen).unionByName(cut)


def _with_reasons(quality: Column, owner: Column) -> Column:
    extra = F.array(
        F.when(owner["unfinished"], F.lit("unfinished")),
        F.when(owner["model_id"].isNull(), F.lit("unknown_model")),
        F.when(owner["reasoning_level"].isNull(), F.lit("unknown_reasoning")),
    )
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(quality, extra))))


def work_marks(
    turns: DataFrame, waits: DataFrame, coverage: DataFrame, contexts: DataFrame | None = None
) -> DataFrame:
    """Instants where the pieces of these tables may begin or end."""
    marks = span_marks(turns, waits, coverage)
    return marks if contexts is None else marks.unionByName(contexts.select("session_id", "at"))


def work_facts(
    turns: DataFrame,
    waits: DataFrame,
    coverage: DataFrame,
    tz: str,
    *,
    contexts: DataFrame | None = None,
    start: Column | None = None,
    end: Column | None = None,
) -> DataFrame:
    """Counted work per slot: session, local day, owner's directory and setting.

    Spans outside [start, end) are cut off before anything is shuffled, and so are the marks
    that size bins and the contexts of turns that are not in view.
    """
    pieces = turn_pieces(turns, coverage)
    marks = work_marks(turns, waits, coverage, contexts)
    if start is not None:
        marks = marks.where(F.col("at") >= start)
    if end is not None:
        marks = marks.where(F.col("at") < end)
    if contexts is None:
        pieces = pieces.withColumn("owner", owner_of())
    else:
        in_view = turns if end is None else turns.where(F.col("start") < end)
        if start is not None:
            in_view = in_view.where(F.col("end").isNull() | (F.col("end") > start))
        if start is not None or end is not None:
            # A context of a turn in view counts whenever it was set.
            contexts = contexts.join(
                in_view.select("session_id", F.col("id").alias("turn_id")), ["session_id", "turn_id"], "left_semi")
        pieces = modelled_pieces(
            clip(pieces, start, end), context_timeline(in_view, contexts, collapse=False)
        ).withColumn("owner", owner_of("model_id", "reasoning_level"))
    slots = owned_slots(clip(pieces, start, end), clip(waits, start, end), tz, marks=marks)
    base = ["session_id", "day", "start", "end", "micros", F.col("owner.cwd").alias("cwd")]
    if contexts is None:
        return slots.select(*base, F.col("owner.turn_id").alias("owner_turn"), "quality")
    return slots.select(
        *base,
        F.col("owner.turn_id").alias("owner_turn"),
        F.col("owner.model_id").alias("model_id"),
        F.col("owner.reasoning_level").alias("reasoning_level"),
        _with_reasons(F.col("quality"), F.col("owner")).alias("quality"),
    )


def attributed_segments(
    sessions: DataFrame,
    turns: DataFrame,
    waits: DataFrame,
    coverage: DataFrame,
    contexts: DataFrame,
) -> DataFrame:
    """Work segments of root sessions, cut where the owner's setting changes."""
    roots = sessions.where("NOT is_child AND parent_id IS NULL").select(
        F.col("id").alias("session_id"), F.col("quality").alias("session_quality")
    )
    pieces = modelled_pieces(
        turn_pieces(turns, coverage), context_timeline(turns, contexts, collapse=False)
    ).withColumn("owner", owner_of("model_id", "reasoning_level"))
    marks = work_marks(turns, waits, coverage, contexts)
    slots = owned_slots(pieces, waits, marks=marks, with_turn_ids=True).select(
        "session_id",
        "start",
        "end",
        F.col("owner.cwd").alias("cwd"),
        F.col("owner.turn_id").alias("owner_turn"),
        "turn_ids",
        F.col("owner.model_id").alias("model_id"),
        F.col("owner.reasoning_level").alias("reasoning_level"),
        _with_reasons(F.col("quality"), F.col("owner")).alias("quality"),
    )
    fused = fuse_slots(
        slots, ["cwd", "owner_turn", "turn_ids", "model_id", "reasoning_level", "quality"]
    )
    return fused.join(roots, "session_id").withColumn(
        "quality", F.array_sort(F.array_union("quality", "session_quality"))
    ).drop("session_quality")
