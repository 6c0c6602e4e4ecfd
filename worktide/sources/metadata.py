"""Thread, turn and title tables kept beside the logs, and how they join the evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktide.sources.rollouts import ancestry

THREADS = ("id", "cwd", "created_at", "updated_at")
TURNS = ("thread_id", "turn_id", "status", "started_at", "completed_at")


def _has(df: DataFrame, names: tuple[str, ...]) -> bool:
    return set(names) <= set(df.columns)


def _instant(df: DataFrame, name: str) -> Column:
    """Milliseconds where they are given and positive, else seconds."""
    seconds = F.timestamp_micros((F.col(name) * 1_000_000).cast("bigint"))
    if f"{name}_ms" not in df.columns:
        return seconds
    ms = F.col(f"{name}_ms")
    return F.when(ms > 0, F.timestamp_micros((ms * 1000).cast("bigint"))).otherwise(seconds)


def _optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def read_threads(threads: DataFrame) -> DataFrame | None:
    """Normalised thread rows; None when the table lacks a required column."""
    if not _has(threads, THREADS):
        return None
    parent, child = ancestry(_optional(threads, "source"), _optional(threads, "parent_thread_id"))
    return threads.where("id IS NOT NULL AND cwd IS NOT NULL").select(
        "id", "cwd", _instant(threads, "created_at").alias("created"),
        _instant(threads, "updated_at").alias("updated"),
        F.when(F.trim(_optional(threads, "name")) != "", F.trim(_optional(threads, "name")))
        .alias("title"),
        (_optional(threads, "archived", "int") != 0).alias("archived"),
        parent.alias("parent_id"), child.alias("is_child"),
    ).where("created IS NOT NULL AND updated IS NOT NULL")


def read_turns(turns: DataFrame) -> DataFrame | None:
    if not _has(turns, TURNS):
        return None
    return turns.where("turn_id IS NOT NULL AND started_at IS NOT NULL").select(
        F.col("thread_id").alias("session_id"), F.col("turn_id").alias("id"),
        F.timestamp_micros((F.col("started_at") * 1_000_000).cast("bigint")).alias("start"),
        F.timestamp_micros((F.col("completed_at") * 1_000_000).cast("bigint")).alias("end"),
        F.col("status").cast("string").alias("outcome"),
    )


def read_titles(index: DataFrame, order: str = "ord") -> DataFrame:
    """Last non-blank name of each id."""
    named = index.where(F.col("id").isNotNull() & (F.trim("thread_name") != ""))
    return named.groupBy("id").agg(F.max_by(F.trim("thread_name"), order).alias("title"))


def spawn_edges(sessions: DataFrame, edges: DataFrame) -> DataFrame:
    """An edge sets the parent and marks the child."""
    known = edges.where("parent_thread_id IS NOT NULL").groupBy(
        F.col("child_thread_id").alias("id")).agg(F.max("parent_thread_id").alias("spawned_by"))
    return sessions.join(known, "id", "left").withColumns(
        {
            "parent_id": F.coalesce("spawned_by", "parent_id"),
            "is_child": F.col("is_child") | F.col("spawned_by").isNotNull(),
        }
    ).select(sessions.columns)


def merge_metadata(
    sessions: DataFrame, threads: DataFrame, edges: DataFrame | None = None,
    titles: DataFrame | None = None,
) -> DataFrame:
    """Earliest creation, latest update, either side's child mark; metadata names and places."""
    told = threads.select(*[F.col(c).alias(f"m_{c}") for c in threads.columns])
    both = sessions.join(told, F.col("id") == F.col("m_id"), "full")
    none = F.array().cast("array<string>")
    merged = both.select(
        F.coalesce("id", "m_id").alias("id"),
        F.coalesce("m_cwd", "cwd").alias("cwd"),
        F.coalesce("m_title", "title", F.lit("")).alias("title"),
        F.least("created", "m_created").alias("created"),
        F.greatest("updated", "m_updated").alias("updated"),
        F.coalesce("m_archived", "archived", F.lit(False)).alias("archived"),
        F.coalesce("m_parent_id", "parent_id").alias("parent_id"),
        (F.coalesce("is_child", F.lit(False)) | F.coalesce("m_is_child", F.lit(False)))
        .alias("is_child"),
        F.coalesce("quality", none).alias("quality"),
    )
    if titles is not None:
        explicit = titles.select("id", F.col("title").alias("explicit"))
        merged = merged.join(explicit, "id", "left").withColumn(
            "title", F.coalesce("explicit", "title")).drop("explicit")
    return merged if edges is None else spawn_edges(merged, edges)


def merge_turns(precise: DataFrame, estimated: DataFrame, sessions: DataFrame) -> DataFrame:
    """Log turns over whole-second metadata turns; metadata only fills what is missing."""
    owner = sessions.select(F.col("id").alias("session_id"), F.col("cwd").alias("session_cwd"))
    told = estimated.join(owner, "session_id").select(
        "session_id", "id", *[F.col(c).alias(f"m_{c}") for c in ("start", "end", "outcome")],
        "session_cwd",
    )
    both = precise.withColumn("logged", F.lit(True)).join(told, ["session_id", "id"], "full")
    start = F.coalesce("start", "m_start")
    fills = F.col("end").isNull() & (F.col("m_end") >= start)
    fills = F.coalesce(fills, F.lit(False))
    logged = F.coalesce("logged", F.lit(False))
    flags = F.concat(
        F.when(logged, F.col("quality")).otherwise(
            F.array(*map(F.lit, ("historical_upper_bound", "metadata_cwd_estimate",
                                 "metadata_start_estimate")))),
        F.when(fills, F.array(F.lit("metadata_reconciled"), F.lit("metadata_end_estimate")))
        .otherwise(F.array().cast("array<string>")),
    )
    sources = F.when(~logged, F.array(F.lit("sqlite"))).when(
        fills, F.array_union("provenance", F.array(F.lit("sqlite")))).otherwise(F.col("provenance"))
    return both.select(
        "session_id", "id", F.coalesce("cwd", "session_cwd").alias("cwd"), start.alias("start"),
        F.when(fills, F.col("m_end")).otherwise(F.col("end")).alias("end"),
        F.when(fills, F.col("m_outcome")).otherwise(F.col("outcome")).alias("outcome"),
        flags.alias("quality"), sources.alias("provenance"),
        F.coalesce("sampling_uncertainty_seconds", F.lit(0.0))
        .alias("sampling_uncertainty_seconds"),
    )
