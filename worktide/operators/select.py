"""Which sessions and rows a report looks at."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalise_path(path: Column) -> Column:
    """Lexical path equality: '//', '/.', '/x/..' and trailing '/' do not count."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, p: F.when(
            p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        ).otherwise(F.array_append(done, p)),
    )
    return F.concat(
        F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(kept, "/")
    )


def same_path(column: Column, cwd: str) -> Column:
    return normalise_path(column) == normalise_path(F.lit(cwd))


def roots_only(sessions: DataFrame) -> DataFrame:
    return sessions.where("NOT is_child AND parent_id IS NULL")


def archive_filter(archived: Column, archive: str) -> Column:
    if archive not in ("all", "active", "archived"):
        raise ValueError("archive must be active, archived or all")
    return F.lit(True) if archive == "all" else archived == F.lit(archive == "archived")


def select_sessions(
    sessions: DataFrame,
    turns: DataFrame,
    *,
    cwd: str | None = None,
    archive: str = "all",
    session_id: str | None = None,
) -> DataFrame:
    """Sessions by archive state, id, and directory of the session or any of its turns."""
    chosen = sessions.where(archive_filter(F.col("archived"), archive))
    if session_id is not None:
        chosen = chosen.where(F.col("id") == session_id)
    if cwd is None:
        return chosen
    there = (
        sessions.where(same_path(F.col("cwd"), cwd))
        .select("id")
        .union(turns.where(same_path(F.col("cwd"), cwd)).select("session_id"))
        .distinct()
    )
    return chosen.join(there, "id", "left_semi")


def search_sessions(sessions: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring over id, title and directory."""
    haystack = F.lower(F.concat_ws(" ", "id", F.coalesce("title", F.lit("")), "cwd"))
    return sessions.where(haystack.contains(text.casefold()))


def exclude_models(usage: DataFrame, model_ids: Iterable[str]) -> DataFrame:
    """Mark rows whose model leaves token and cost totals but keeps its evidence."""
    ids = list(model_ids)
    listed = F.col("model_id").isin(ids) if ids else F.lit(False)
    return usage.withColumn("excluded", F.coalesce(listed, F.lit(False)))
