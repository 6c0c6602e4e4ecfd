"""Interval algebra over [start, end) columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktide.functions.time import instant, local_date, local_midnight, micros
from worktide.operators.scan import latest, running_sum, scan, time_chunk, upcoming
from worktide.session import materialise

# Rows wanted per (key, bin) before a day is cut into finer bins.
BIN_TARGET = 64
MAX_SPLITS = 1 << 16


def _edges(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Both ends of every non-empty span, as signed steps."""
    return df.where(F.col("end") > F.col("start")).select(
        *keys,
        F.explode(
            F.array(
                F.struct(micros(F.col("start")).alias("p"), F.lit(1).alias(name)),
                F.struct(micros(F.col("end")).alias("p"), F.lit(-1).alias(name)),
            )
        ).alias("edge"),
    ).select(*keys, "edge.*")


def _regions(points: DataFrame, keys: Sequence[str], now: Column, before: Column) -> DataFrame:
    """Maximal runs where a state holds, from the points where it may change."""
    toggles = points.where(now != before).select(
        *keys, "p", now.alias("opens"), time_chunk(F.col("p")).alias("chunk")
    )
    paired = scan(toggles, keys, "chunk", ["p"], closing=upcoming(F.col("p")))
    return paired.where("opens").select(
        *keys, instant(F.col("p")).alias("start"), instant(F.col("closing")).alias("end")
    )


def merge_spans(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of overlapping or touching spans per key; empty spans vanish."""
    steps = (
        _edges(df, keys, "step")
        .groupBy(*keys, "p")
        .agg(F.sum("step").alias("step"))
        .where("step <> 0")
        .withColumn("chunk", time_chunk(F.col("p")))
    )
    depth = scan(steps, keys, "chunk", ["p"], depth=running_sum(F.col("step")))
    return _regions(depth, keys, F.col("depth") > 0, F.col("depth") > F.col("step"))


def subtract_spans(work: DataFrame, waits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merged work minus merged waits."""
    steps = (
        _edges(work, keys, "work")
        .withColumn("wait", F.lit(0))
        .unionByName(_edges(waits, keys, "wait").withColumn("work", F.lit(0)))
        .groupBy(*keys, "p")
        .agg(F.sum("work").alias("work"), F.sum("wait").alias("wait"))
        .where("work <> 0 OR wait <> 0")
        .withColumn("chunk", time_chunk(F.col("p")))
    )
    depth = scan(
        steps, keys, "chunk", ["p"],
        works=running_sum(F.col("work")), waiting=running_sum(F.col("wait")),
    )
    return _regions(
        depth,
        keys,
        (F.col("works") > 0) & (F.col("waiting") == 0),
        (F.col("works") > F.col("work")) & (F.col("waiting") == F.col("wait")),
    )


def split_by_local_day(df: DataFrame, tz: str) -> DataFrame:
    """Cut spans at local midnights. A day is as long as its zone makes it."""
    last_instant = instant(micros(F.col("end")) - 1)
    days = df.where(F.col("end") > F.col("start")).withColumn(
        "day",
        F.explode(
            F.sequence(
                F.least(local_date(F.col("start"), tz), local_date(last_instant, tz)),
                F.greatest(local_date(F.col("start"), tz), local_date(last_instant, tz)),
            )
        ),
    )
    clipped = days.withColumns(
        {
            "start": F.greatest("start", local_midnight(F.col("day"), tz)),
            "end": F.least("end", local_midnight(F.date_add("day", 1), tz)),
        }
    )
    return clipped.where(F.col("end") > F.col("start")).withColumn(
        "micros", micros(F.col("end")) - micros(F.col("start"))
    )


def overlap_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], bin_seconds: int = 3600
) -> DataFrame:
    """Rows for every overlapping pair that shares the keys, clipped to one time bin.

    Both sides are spread over fixed bins and joined on (keys, bin). Each shared
    microsecond appears once, so sums over the result are exact.
    """
    width = bin_seconds * 1_000_000

    def spread(df: DataFrame, prefix: str) -> DataFrame:
        others = [c for c in df.columns if c not in (*keys, "start", "end")]
        return (
            df.where(F.col("end") > F.col("start"))
            .select(
                *keys,
                *others,
                micros(F.col("start")).alias(f"{prefix}_s"),
                micros(F.col("end")).alias(f"{prefix}_e"),
            )
            .withColumn(
                "bin",
                F.explode(
                    F.sequence(
                        time_chunk(F.col(f"{prefix}_s"), width),
                        time_chunk(F.col(f"{prefix}_e") - 1, width),
                    )
                ),
            )
        )

    joined = spread(left, "l").join(spread(right, "r"), [*keys, "bin"])
    start = F.greatest("l_s", "r_s", F.col("bin") * width)
    end = F.least("l_e", "r_e", (F.col("bin") + 1) * width)
    return (
        joined.where((F.col("l_s") < F.col("r_e")) & (F.col("r_s") < F.col("l_e")))
        .withColumn("start", instant(start))
        .withColumn("end", instant(end))
        .where(F.col("end") > F.col("start"))
        .withColumn("micros", end - start)
        .drop("bin", "l_s", "l_e", "r_s", "r_e")
    )


def overlap_measure(
    windows: DataFrame, spans: DataFrame, keys: Sequence[str], labels: Sequence[str]
) -> DataFrame:
    """Shared microseconds of every window with the spans of each label.

    `windows` has (keys, window, start, end), `spans` has (keys, labels, start, end).
    Covered time up to an instant is a running sum over span edges, so a window
    costs two lookups per label however many spans it crosses: no pairs are formed.
    """
    tags = [*keys, *labels]
    steps = _edges(spans, tags, "step").groupBy(*tags, "p").agg(F.sum("step").alias("step"))
    known = steps.select(*tags).distinct()
    probes = windows.where(F.col("end") > F.col("start")).select(
        *keys,
        "window",
        F.explode(
            F.array(
                F.struct(micros(F.col("start")).alias("p"), F.lit(-1).alias("sign")),
                F.struct(micros(F.col("end")).alias("p"), F.lit(1).alias("sign")),
            )
        ).alias("probe"),
    ).select(*keys, "window", "probe.*").join(known, list(keys))
    # Nullable labels become a struct: a usable scan key that keeps null apart from values.
    tag = F.to_json(F.struct(*labels), {"ignoreNullFields": "false"}).alias("tag")
    lanes = (
        steps.select(*keys, tag, *labels, "p", F.col("step").cast("bigint"),
                     F.lit(None).cast("string").alias("window"), F.lit(0).alias("sign"))
        .unionByName(
            probes.select(*keys, tag, *labels, "p", F.lit(0).cast("bigint").alias("step"),
                          F.col("window").cast("string"), "sign")
        )
        .withColumn("chunk", time_chunk(F.col("p")))
    )
    lane = scan(
        lanes, [*keys, "tag"], "chunk", ["p"],
        depth=running_sum(F.col("step")),
        offset=running_sum((F.col("step") * F.col("p").cast("decimal(20,0)")).cast("decimal(28,0)")),
    )
    covered = F.col("depth") * F.col("p").cast("decimal(20,0)") - F.col("offset")
    return (
        lane.where("sign <> 0")
        .groupBy(*keys, "window", *labels)
        .agg(F.sum(covered * F.col("sign")).cast("bigint").alias("micros"))
        .where("micros > 0")
    )


def prune_to_period(
    sessions: DataFrame, turns: DataFrame, coverage: DataFrame, start: Column, end: Column
) -> DataFrame:
    """Drop sessions whose turns and coverage cannot meet [start, end)."""
    meets = (F.col("start") < end) & (F.col("end") > start) & (F.col("end") > F.col("start"))
    open_turns = turns.where(F.col("end").isNull()).select(
        "session_id", F.col("id").alias("turn_id")
    )
    alive = (
        turns.where(meets)
        .select("session_id")
        .union(
            coverage.where(meets)
            .join(open_turns, ["session_id", "turn_id"], "left_semi")
            .select("session_id")
        )
        .distinct()
    )
    return sessions.join(alive, sessions["id"] == alive["session_id"], "left_semi")


def _splits(count: Column) -> Column:
    """Parts to cut a group of this many span ends into; a power of two."""
    return F.least(
        F.lit(MAX_SPLITS), F.pow(2, F.ceil(F.log2(count / BIN_TARGET))).cast("bigint")
    )


def _bin_of(us: Column, parts: Column) -> Column:
    """Start of the bin an instant of [dawn, dusk) falls in."""
    width = F.ceil((F.col("dusk") - F.col("dawn")) / parts).cast("bigint")
    return F.col("dawn") + F.floor((us - F.col("dawn")) / width).cast("bigint") * width


def _daily(df: DataFrame, tz: str, *columns: str) -> DataFrame:
    return split_by_local_day(df, tz).select(
        "session_id",
        "day",
        micros(local_midnight(F.col("day"), tz)).alias("dawn"),
        micros(local_midnight(F.date_add("day", 1), tz)).alias("dusk"),
        micros(F.col("start")).alias("s"),
        micros(F.col("end")).alias("e"),
        *columns,
    )


def _bins(daily: DataFrame, marks: DataFrame, tz: str) -> DataFrame:
    """Cut daily spans into bins that hold about BIN_TARGET span ends each.

    `marks` (session_id, at) are the instants where spans may begin or end; they
    only size the bins. A busy (session, day) is cut evenly; what is still crowded
    - a burst - is cut once more. Quiet data has no busy days and one bin a day.
    """
    placed = marks.where("at IS NOT NULL").withColumn("day", local_date(F.col("at"), tz))
    days = (
        placed.groupBy("session_id", "day").agg(F.count("*").alias("n"))
        .where(F.col("n") > BIN_TARGET)
        .select("session_id", "day", _splits(F.col("n")).alias("parts"))
    )
    crowd = (
        placed.join(days, ["session_id", "day"])
        .withColumns(
            {
                "dawn": micros(local_midnight(F.col("day"), tz)),
                "dusk": micros(local_midnight(F.date_add("day", 1), tz)),
            }
        )
        .withColumn("coarse", _bin_of(micros(F.col("at")), F.col("parts")))
        .groupBy("session_id", "day", "coarse")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > 4 * BIN_TARGET)
        .select("session_id", "coarse", _splits(F.col("n")).alias("finer"))
    )
    cut = (
        daily.join(days, ["session_id", "day"], "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1).cast("bigint")))
        .withColumn("width", F.ceil((F.col("dusk") - F.col("dawn")) / F.col("parts")).cast("bigint"))
        .withColumn("coarse", _every("s", "e", "dawn", "width"))
    )
    low, high = F.greatest("s", "coarse"), F.least("e", F.col("coarse") + F.col("width"))
    return (
        cut.withColumns({"s": low, "e": high})
        .join(crowd, ["session_id", "coarse"], "left")
        .withColumn(
            "narrow",
            F.ceil(F.col("width") / F.coalesce("finer", F.lit(1).cast("bigint"))).cast("bigint"),
        )
        .withColumn("bin", _every("s", "e", "coarse", "narrow"))
        .withColumns(
            {"s": F.greatest("s", "bin"), "e": F.least("e", F.col("bin") + F.col("narrow"))}
        )
    )


def _every(start: str, end: str, origin: str, width: str) -> Column:
    """Starts of the cells of a grid that [start, end) meets."""
    first = F.floor((F.col(start) - F.col(origin)) / F.col(width)).cast("bigint")
    last = F.floor((F.col(end) - 1 - F.col(origin)) / F.col(width)).cast("bigint")
    return F.explode(
        F.transform(F.sequence(first, last), lambda i: F.col(origin) + i * F.col(width))
    )


def owned_slots(
    pieces: DataFrame,
    waits: DataFrame,
    tz: str = "UTC",
    *,
    marks: DataFrame | None = None,
    with_turn_ids: bool = False,
) -> DataFrame:
    """Elementary slots of a session that some piece works on and no wait covers.

    `pieces` has (session_id, start, end, owner STRUCT, quality); the greatest
    owner active in a slot owns it. Slots never cross a local midnight of `tz`.

    Spans are cut into bins sized by their density (see `_bins`). Spans with equal
    bounds in a bin - copies, and everything that covers the bin whole - collapse
    to one row before they are shuffled to it. A bin therefore holds a bounded
    number of rows, whatever the size of its session, and slots are matched with
    spans inside it.
    """
    owner_type = pieces.schema["owner"].dataType
    if marks is None:
        marks = span_marks(pieces, waits)
    rows = pieces.select(
        "session_id", "start", "end", "owner", "quality", F.lit(False).alias("wait")
    ).unionByName(
        waits.select(
            "session_id",
            "start",
            "end",
            F.lit(None).cast(owner_type).alias("owner"),
            F.array().cast("array<string>").alias("quality"),
            F.lit(True).alias("wait"),
        )
    )
    binned = _bins(_daily(rows, tz, "owner", "quality", "wait"), marks, tz)
    ids = [F.collect_set("owner.turn_id").alias("turn_ids")] if with_turn_ids else []
    spans = binned.groupBy("session_id", "day", "bin", "s", "e").agg(
        F.max("owner").alias("owner"),
        F.max("wait").alias("wait"),
        F.collect_set("quality").alias("flags"),
        *ids,
    )
    fields = ["s", "e", "owner", "wait", "flags", *(["turn_ids"] if with_turn_ids else [])]
    bins = spans.groupBy("session_id", "day", "bin").agg(
        F.collect_list(F.struct(*fields)).alias("spans")
    )
    points = F.array_sort(F.array_distinct(F.concat("spans.s", "spans.e")))
    slots = bins.withColumn("points", points).select(
        "session_id",
        "day",
        "spans",
        F.explode(
            F.arrays_zip(
                F.expr("slice(points, 1, size(points) - 1)").alias("p"),
                F.expr("slice(points, 2, size(points) - 1)").alias("q"),
            )
        ).alias("slot"),
    )
    active = slots.select(
        "session_id",
        "day",
        F.col("slot.p").alias("p"),
        F.col("slot.q").alias("q"),
        F.filter(
            "spans", lambda x: (x["s"] <= F.col("slot.p")) & (x["e"] >= F.col("slot.q"))
        ).alias("active"),
    ).where(F.col("active.owner").isNotNull() & ~F.exists("active", lambda x: x["wait"]))
    return active.select(
        "session_id",
        "day",
        instant(F.col("p")).alias("start"),
        instant(F.col("q")).alias("end"),
        (F.col("q") - F.col("p")).alias("micros"),
        F.array_max("active.owner").alias("owner"),
        F.array_sort(F.array_distinct(F.flatten(F.flatten("active.flags")))).alias("quality"),
        *(
            [F.array_sort(F.array_distinct(F.flatten("active.turn_ids"))).alias("turn_ids")]
            if with_turn_ids
            else []
        ),
    ).where("owner IS NOT NULL")


def span_marks(*spans: DataFrame) -> DataFrame:
    """Where spans begin and end: the density that sizes bins."""
    ends = None
    for df in spans:
        both = df.select("session_id", F.explode(F.array("start", "end")).alias("at"))
        ends = both if ends is None else ends.unionByName(both)
    return ends


def fuse_slots(slots: DataFrame, values: Sequence[str]) -> DataFrame:
    """Join touching slots of a session that agree in every value column."""
    marked = materialise(
        slots.withColumns(
            {
                "s": micros(F.col("start")),
                "e": micros(F.col("end")),
                "print": F.sha2(
                    F.to_json(F.struct(*values), {"ignoreNullFields": "false"}), 256
                ),
            }
        ).withColumn("chunk", time_chunk(F.col("s")))
    )
    here = F.struct("s", "e", "print")
    seen = scan(
        marked, ["session_id"], "chunk", ["s"],
        earlier=latest(here, inclusive=False), later=upcoming(here),
    )
    opens = ~F.coalesce(
        (F.col("earlier.e") == F.col("s")) & (F.col("earlier.print") == F.col("print")),
        F.lit(False),
    )
    closes = ~F.coalesce(
        (F.col("later.s") == F.col("e")) & (F.col("later.print") == F.col("print")), F.lit(False)
    )
    rims = seen.withColumns({"opens": opens, "closes": closes}).where("opens OR closes")
    paired = scan(
        rims, ["session_id"], "chunk", ["s"], finish=upcoming(F.when(F.col("closes"), F.col("e")))
    )
    return paired.where("opens").select(
        "session_id",
        "start",
        F.when(F.col("closes"), F.col("end")).otherwise(instant(F.col("finish"))).alias("end"),
        *values,
    )


def turn_pieces(turns: DataFrame, coverage: DataFrame, *tags: str) -> DataFrame:
    """What a turn may work on: its own span once finished, else its observed coverage."""
    columns = [
        "session_id",
        F.col("id").alias("turn_id"),
        "cwd",
        "quality",
        micros(F.col("start")).alias("turn_start"),
        F.col("end").isNull().alias("unfinished"),
        *tags,
    ]
    done = turns.where("end IS NOT NULL").select(*columns, "start", "end")
    open_turns = turns.where("end IS NULL").select(*columns)
    seen = open_turns.join(
        coverage.select("session_id", "turn_id", "start", "end"), ["session_id", "turn_id"]
    )
    return done.unionByName(seen).where(F.col("end") > F.col("start"))


def owner_of(*extra: str) -> Column:
    """Latest-starting turn first, ties by id."""
    return F.struct("turn_start", "turn_id", "cwd", "unfinished", *extra)


def clip(df: DataFrame, start: Column | None, end: Column | None) -> DataFrame:
    """Restrict spans to [start, end); the bare comparisons reach the file scan."""
    if start is not None:
        df = df.where(F.col("end") > start).withColumn("start", F.greatest("start", start))
    if end is not None:
        df = df.where(F.col("start") < end).withColumn("end", F.least("end", end))
    return df


def work_segments(turns: DataFrame, waits: DataFrame, coverage: DataFrame) -> DataFrame:
    """Disjoint counted work of every session with its owner and all active turns."""
    pieces = turn_pieces(turns, coverage).withColumn("owner", owner_of())
    slots = owned_slots(pieces, waits, with_turn_ids=True).select(
        "session_id",
        "start",
        "end",
        F.col("owner.cwd").alias("cwd"),
        F.col("owner.turn_id").alias("owner_turn"),
        "turn_ids",
        "quality",
    )
    return fuse_slots(slots, ["cwd", "owner_turn", "turn_ids", "quality"])
