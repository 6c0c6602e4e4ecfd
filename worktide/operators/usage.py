"""Token counter readings of a source to attributed increments.

Sources are read in file order: `block` is the split a row lies in, `ord` its
place, and every carried value crosses blocks through `scan`, so one long source
is worked on by many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktide.evidence import COUNTERS, COUNTS
from worktide.operators.scan import latest, parted, scan
from worktide.session import materialise

RAW_COUNTS = "STRUCT<" + ", ".join(f"{name}: STRING" for name in COUNTERS) + ">"


#: How counters are read from a JSON text: as whole numbers, and as they are written.
COUNT_SHAPES = {
    "typed": lambda raw: F.from_json(raw, COUNTS),
    "text": lambda raw: F.from_json(raw, RAW_COUNTS),
}


def validate_counts(raw: Column) -> tuple[Column, Column]:
    """Counters from a JSON text, and a flag for each one that is not a whole number >= 0."""
    return checked_counts(raw, *[parse(raw) for parse in COUNT_SHAPES.values()])


def checked_counts(raw: Column, typed: Column, text: Column) -> tuple[Column, Column]:
    """As `validate_counts`, of a text that was read in both shapes before."""
    valid = F.struct(
        *[F.when(typed[name] >= 0, typed[name]).alias(name) for name in COUNTERS]
    )
    is_object = F.ltrim(raw).startswith("{")
    flags = F.array_compact(
        F.array(
            F.when(raw.isNotNull() & ~is_object, F.lit("invalid_token_counts")),
            *[
                F.when(
                    is_object & text[name].isNotNull()
                    & (typed[name].isNull() | (typed[name] < 0)),
                    F.lit(f"invalid_{name}"),
                )
                for name in COUNTERS
            ],
        )
    )
    return F.when(is_object, valid), flags


def usage_identity(session_id: str, at: str, cumulative: str, last_usage: str) -> Column:
    """Content hash of a reading; equal evidence has one id however often it is read."""
    keep = {"ignoreNullFields": "false"}
    return F.sha2(
        F.to_json(
            F.array(
                F.col(session_id),
                F.unix_micros(at).cast("string"),
                F.to_json(F.col(cumulative), keep),
                F.to_json(F.col(last_usage), keep),
            )
        ),
        256,
    )


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def request_input(delta: Column, last: Column) -> Column:
    """Request size, known only when the increment is exactly the last request."""
    same = _all([delta[name].eqNullSafe(last[name]) for name in COUNTERS])
    present = _all(
        [delta[name].isNotNull() for name in ("input_tokens", "output_tokens", "total_tokens")]
    )
    proven = delta.isNotNull() & last.isNotNull() & same & present & (delta["total_tokens"] != 0)
    return F.when(proven, delta["input_tokens"])


def _increment(row: DataFrame, forked: Column, gap: Column, child: Column) -> DataFrame:
    """delta and its diagnostics from `cumulative`, `last_usage` and `previous`."""
    now, last, old = F.col("cumulative"), F.col("last_usage"), F.col("previous")
    first = old.isNull()
    inherited = child & first & request_input(now, last).isNull()
    falls = _any([F.coalesce(now[n] < old[n], F.lit(False)) for n in COUNTERS])
    step = F.struct(*[(now[n] - old[n]).alias(n) for n in COUNTERS])
    unbased = first & (forked | gap)
    delta = (
        F.when(inherited | now.isNull() | unbased | (~first & falls), F.lit(None).cast(COUNTS))
        .when(first, now)
        .otherwise(step)
    )
    moved = ~inherited & now.isNotNull() & ~first & ~falls
    still = _all([F.coalesce(now[n] - old[n], F.lit(0)) == 0 for n in COUNTERS])
    newborn = _any([now[n].isNotNull() & old[n].isNull() for n in COUNTERS])
    reasons = F.array_compact(
        F.array(
            F.when(inherited, F.lit("child_baseline_unavailable")),
            F.when(~inherited & now.isNull(), F.lit("missing_cumulative_usage")),
            F.when(
                ~inherited & now.isNotNull() & unbased,
                F.when(forked, F.lit("fork_baseline_unavailable")).otherwise(
                    F.lit("baseline_unavailable")
                ),
            ),
            F.when(~inherited & now.isNotNull() & ~first & falls, F.lit("counter_reset")),
            F.when(moved & still, F.lit("repeated_cumulative_usage")),
            F.when(moved & newborn, F.lit("category_baseline_unavailable")),
        )
    )
    return row.withColumns({"delta": delta, "reasons": reasons})


def counter_delta(readings: DataFrame) -> DataFrame:
    """Increment of every reading over the last cumulative of its source.

    Takes (file_path, block, ord, cumulative, last_usage); optional booleans
    `forked`, `gap` and `child` say what a missing baseline means. Appends `delta`
    and `diagnostics`.
    """
    no = F.lit(False)
    flags = [
        F.coalesce(F.col(name), no) if name in readings.columns else no
        for name in ("forked", "gap", "child")
    ]
    held = scan(
        readings, ["file_path"], "block", ["ord"],
        before=latest(F.when(F.col("cumulative").isNotNull(), F.struct("cumulative")), False),
    ).withColumn("previous", F.col("before.cumulative"))
    return (
        _increment(held, *flags)
        .withColumnRenamed("reasons", "diagnostics")
        .drop("before", "previous")
    )


def usage_from_lines(
    lines: DataFrame, stored: DataFrame | None = None, several: Sequence[str] | None = None,
) -> DataFrame:
    """Usage observations from the lines of sources.

    `lines` has (file_path, block, ord, at, kind, session_id, cwd, model_id, turn_id,
    forked, child, cumulative, last_usage, diagnostics) with kind meta, context,
    start, tokens or gap; `turn_id` is the turn the line refers to. With a column `closed`,
    which marks lines that only say that the open turn ended, a context without a turn refers
    to the turn that is open there. `stored` is earlier durable usage: it seeds a shortened
    source and outranks older history. `several` names the sources of several blocks, if they
    are known; all others are read in one sort, without what blocks carry.
    """
    parts = [_observed(part, stored, run) for part, run in parted(lines, "file_path", several)]
    observed = reduce(DataFrame.unionByName, parts)
    # The same content read twice is one observation: the earliest stands.
    columns = [c for c in observed.columns if c not in ("id", "place")]
    single = observed.groupBy("id").agg(
        F.min_by(F.struct(*columns), "place").alias("o")
    ).select("id", "o.*")
    return single if stored is None else earlier_history_overlap(single, stored)


def _observed(lines: DataFrame, stored: DataFrame | None, run: Callable[..., DataFrame]) -> DataFrame:
    """Every reading as an observation at its `place`, by a scan over blocks or in one sort."""
    if "closed" in lines.columns:
        lines = _in_open_turns(lines, run)
    of = {kind: F.col("kind") == kind for kind in ("meta", "context", "start", "tokens", "gap")}
    has_cwd = (of["meta"] | of["context"]) & F.col("cwd").isNotNull()
    first = run(
        lines, ["file_path"], "block", ["ord"],
        meta=latest(
            F.when(of["meta"], F.struct("session_id", F.col("at").alias("created"), "forked",
                                        "child"))
        ),
        before=latest(F.when(of["tokens"] & F.col("cumulative").isNotNull(),
                             F.struct("cumulative")), False),
        file_cwd=latest(F.when(has_cwd, F.struct("cwd"))),
        context_at=latest(F.when(of["context"], F.col("at"))),
        turn=latest(F.when(of["context"] | of["start"], F.struct("turn_id"))),
    ).where("meta IS NOT NULL OR kind = 'gap'")
    inherited = F.coalesce(F.col("at") < F.col("meta.created"), F.lit(False))
    first = first.withColumn(
        "counts", of["tokens"] & F.col("cumulative").isNotNull() & ~inherited
    ).withColumn("inherited", of["tokens"] & inherited)
    if run is scan:
        first = materialise(first.withColumn("row", F.monotonically_increasing_id()))
    narrow = first.where(~of["start"])
    if run is scan:
        # What follows reads a few columns over and over; readings join them again by `row`.
        narrow = narrow.select("row", "file_path", "block", "ord", "kind", "model_id", "cwd", "file_cwd",
                               "counts", "inherited")

    # A gap stays open until the next counted cumulative reading.
    opened = run(
        narrow, ["file_path"], "block", ["ord"],
        gap=latest(
            F.when(of["gap"], F.lit(True)).when(F.col("counts"), F.lit(False)), inclusive=False
        ),
    ).withColumn("gap", F.coalesce("gap", F.lit(False)))
    blind = of["tokens"] & ~F.col("inherited") & F.col("gap")
    unknown = F.struct(F.lit(None).cast("string").alias("model_id"))
    held = run(
        opened, ["file_path"], "block", ["ord"],
        model=latest(
            F.when(of["context"], F.struct("model_id")).when(blind, unknown)
        ),
        cwd_known=latest(
            F.when(of["context"] & F.col("cwd").isNotNull(), F.lit(True))
            .when(blind, F.lit(False))
        ),
    )
    # Two more scans over blocks read these rows several times; in one sort they are read once.
    held = materialise(held) if run is scan else held

    # Changed since the last counted reading: some neighbours in the order
    # (carried value, context, context, ...) differ.
    seen = run(
        held, ["file_path"], "block", ["ord"],
        prior_model=latest(
            F.when(of["context"] | F.col("counts"), F.struct("model.model_id")), False
        ),
        prior_cwd=latest(F.when(has_cwd | F.col("counts"), F.struct("file_cwd.cwd")), False),
    )
    new_model = F.col("prior_model").isNotNull() & ~F.col("model_id").eqNullSafe(
        F.col("prior_model.model_id")
    )
    new_cwd = F.col("prior_cwd").isNotNull() & ~F.col("cwd").eqNullSafe(F.col("prior_cwd.cwd"))
    judged = run(
        seen, ["file_path"], "block", ["ord"],
        model_changed=latest(
            F.when(of["context"] & new_model, F.lit(True)).when(F.col("counts"), F.lit(False)),
            inclusive=False,
        ),
        cwd_changed=latest(
            F.when(of["context"] & F.col("cwd").isNotNull() & new_cwd, F.lit(True))
            .when(F.col("counts"), F.lit(False)),
            inclusive=False,
        ),
    ).where(of["tokens"] & ~F.col("inherited"))
    if run is scan:
        judged = judged.select("row", "gap", "model", "cwd_known", "model_changed", "cwd_changed")
        judged = first.where(of["tokens"] & ~F.col("inherited")).drop("model_id", "cwd").join(judged, "row")
    judged = _seed(judged.select(
        "file_path", "block", "ord", "at", "meta", "before", "file_cwd", "context_at", "turn", "cumulative",
        "last_usage", "diagnostics", "gap", "model", "cwd_known", "model_changed", "cwd_changed"), stored)
    if stored is not None:
        # A baseline taken from storage is compared with the context at hand.
        new_model_seed = F.col("seed_model").isNotNull() & ~F.col("seed_model.model_id").eqNullSafe(
            F.col("model.model_id"))
        new_cwd_seed = F.col("seed_model").isNotNull() & ~F.col("seed_model.cwd").eqNullSafe(
            F.col("file_cwd.cwd"))
    else:
        new_model_seed = new_cwd_seed = F.lit(False)

    no = F.lit(False)
    priced = _increment(
        judged, F.coalesce("meta.forked", no), F.col("gap"), F.coalesce("meta.child", no)
    ).withColumn("request_input_tokens", request_input(F.col("delta"), F.col("last_usage")))
    unproven = F.col("request_input_tokens").isNull()
    model_changed = F.coalesce("model_changed", no) | new_model_seed
    cwd_changed = F.coalesce("cwd_changed", no) | new_cwd_seed
    late = F.coalesce(F.col("context_at") > F.col("at"), no)
    model = F.when(
        ~F.col("gap") & ~late & ~(model_changed & unproven), F.col("model.model_id")
    )
    cwd = F.when(
        ~F.col("gap") & ~late & ~(cwd_changed & unproven) & F.coalesce("cwd_known", F.lit(True))
        & (F.col("file_cwd.cwd") != ""),
        F.col("file_cwd.cwd"),
    )
    reasons = F.array_compact(
        F.array(
            F.when(F.col("gap"), F.lit("source_gap_attribution_unavailable")),
            F.when(late, F.lit("context_timestamp_after_usage")),
            F.when(model_changed & unproven, F.lit("ambiguous_model_attribution")),
            F.when(cwd_changed & unproven, F.lit("ambiguous_directory_attribution")),
            F.when(model.isNull(), F.lit("unknown_model")),
            F.when(cwd.isNull(), F.lit("unknown_directory")),
            F.when(
                F.col("delta").isNotNull() & unproven
                & ~F.array_contains("reasons", "repeated_cumulative_usage"),
                F.lit("request_billing_evidence_unavailable"),
            ),
        )
    )
    return priced.select(
        F.col("meta.session_id").alias("session_id"),
        "at",
        cwd.alias("cwd"),
        model.alias("model_id"),
        F.col("turn.turn_id").alias("turn_id"),
        "cumulative",
        "last_usage",
        "delta",
        "request_input_tokens",
        F.concat(F.coalesce("diagnostics", F.array().cast("array<string>")), "reasons",
                 reasons).alias("diagnostics"),
        F.struct("file_path", "block", "ord").alias("place"),
    ).withColumn("id", usage_identity("session_id", "at", "cumulative", "last_usage"))


def _in_open_turns(lines: DataFrame, run: Callable[..., DataFrame]) -> DataFrame:
    """Lines with the turn they refer to, without those that only tell that a turn was closed."""
    turn = F.when(F.col("kind") == "start", F.struct("turn_id"))
    shut = F.struct(F.lit(None).cast("string").alias("turn_id"))
    rows = run(lines, ["file_path"], "block", ["ord"], open=latest(turn.when(F.col("closed"), shut)))
    own = F.coalesce("turn_id", F.when(F.col("kind") == "context", F.col("open.turn_id")))
    return rows.withColumn("turn_id", own).where("NOT closed").drop("open", "closed")


def _seed(readings: DataFrame, stored: DataFrame | None) -> DataFrame:
    """`previous` cumulative; from storage where the source itself has none yet."""
    own = F.col("before.cumulative")
    if stored is None:
        return readings.withColumn("previous", own).drop("before")
    # Few readings stand before all cumulatives of their source; the others meet no storage.
    rows = materialise(readings)
    # Stored readings join the scan as lines of their own in (session, time) order.
    width = 30 * 86_400_000_000
    chunk = F.floor(F.unix_micros("at") / width).cast("bigint")
    order = F.struct(F.unix_micros("at").alias("us"), F.lit(1).alias("late"))
    early = rows.where("before IS NULL")
    asked = early.select(
        F.col("meta.session_id").alias("sid"), "at", "file_path", "block", "ord",
        F.lit(None).cast(f"STRUCT<cumulative: {COUNTS}, model_id: STRING, cwd: STRING>").alias(
            "known"),
        order.alias("pos"),
    )
    known = stored.where("cumulative IS NOT NULL").select(
        F.col("session_id").alias("sid"), "at",
        F.lit(None).cast("string").alias("file_path"),
        F.lit(None).cast(rows.schema["block"].dataType).alias("block"),
        F.lit(None).cast(rows.schema["ord"].dataType).alias("ord"),
        F.struct("cumulative", "model_id", "cwd").alias("known"),
        # A stored reading at the same instant is not earlier.
        F.struct(F.unix_micros("at").alias("us"), F.lit(2).alias("late")).alias("pos"),
    )
    both = asked.unionByName(known).withColumn("chunk", chunk)
    found = scan(both, ["sid"], "chunk", ["pos"], seed=latest(F.col("known"), False)).where(
        "file_path IS NOT NULL"
    ).select("file_path", "block", "ord", "seed")
    early = early.join(found, ["file_path", "block", "ord"], "left").withColumn(
        "previous", F.col("seed.cumulative")).withColumn(
        "seed_model", F.when(F.col("seed").isNotNull(), F.struct("seed.model_id", "seed.cwd")))
    nothing = F.lit(None).cast("STRUCT<model_id: STRING, cwd: STRING>")
    late = rows.where("before IS NOT NULL").withColumns({"previous": own, "seed_model": nothing})
    return late.drop("before").unionByName(early.drop("before", "seed"))


def earlier_history_overlap(usage: DataFrame, stored: DataFrame) -> DataFrame:
    """New readings older than stored evidence are kept, but not charged again.

    Readings whose id is stored already are left out.
    """
    newest = stored.groupBy("session_id").agg(F.max("at").alias("newest"))
    fresh = usage.join(stored.select("id"), "id", "left_anti").join(newest, "session_id", "left")
    late = F.coalesce(F.col("newest") > F.col("at"), F.lit(False))
    return fresh.withColumns(
        {
            "delta": F.when(~late, F.col("delta")),
            "request_input_tokens": F.when(~late, F.col("request_input_tokens")),
            "diagnostics": F.when(
                late, F.array_append("diagnostics", F.lit("earlier_history_overlap"))
            ).otherwise(F.col("diagnostics")),
        }
    ).drop("newest").select(usage.columns)
