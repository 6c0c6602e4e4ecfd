"""The parent forest of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktide.session import materialise


def root_sessions(sessions: DataFrame) -> DataFrame:
    """(session_id, root_id, flags) for every session.

    Chains are shortened by pointer doubling: after round k a session knows its
    ancestor 2^k steps up, so the rounds grow with the logarithm of the depth.
    Sessions that reached a resolved one leave the loop. A round that frees none
    leaves only sessions that lead into cycles - of others the one nearest its top
    would have gone - and those double on until the least id seen is stable.
    """
    base = sessions.select("id", "parent_id", "is_child")
    known = base.select(F.col("id").alias("up_id"), F.col("parent_id").alias("up_parent"),
                        F.col("is_child").alias("up_child"))
    orphan, none = F.array(F.lit("orphaned_child")), F.array().cast("array<string>")
    alone = base.where("parent_id IS NULL").select(
        F.col("id").alias("session_id"),
        F.col("id").alias("root_id"),
        F.when(F.col("is_child"), orphan).otherwise(none).alias("flags"),
    )
    linked = materialise(
        base.where("parent_id IS NOT NULL").join(
            known, F.col("parent_id") == F.col("up_id"), "left"
        )
    )
    lost = linked.where("up_id IS NULL").select(
        F.col("id").alias("session_id"), F.col("id").alias("root_id"), orphan.alias("flags")
    )
    # A top is where a chain ends: no parent named, or one that is not there.
    resolved = alone.unionByName(lost)
    chains = linked.where("up_id IS NOT NULL").select(
        "id", F.col("parent_id").alias("ptr"), F.col("id").alias("least")
    )
    left = None
    while True:
        ends = resolved.select(F.col("session_id").alias("ptr"), "root_id", "flags")
        stepped = materialise(chains.join(ends, "ptr", "left"))
        resolved = resolved.unionByName(
            stepped.where("root_id IS NOT NULL").select(
                F.col("id").alias("session_id"), "root_id", "flags"
            )
        )
        chains = stepped.where("root_id IS NULL").select("id", "ptr", "least")
        remaining = chains.count()
        if remaining == 0:
            return resolved
        if remaining == left:
            break
        left = remaining
        chains = _double(chains, stepped)
    while True:
        wider = materialise(_double(chains, chains))
        changed = wider.where("least < narrow").limit(1).count()
        chains = wider.select("id", "ptr", "least")
        if not changed:
            break
    return resolved.unionByName(
        chains.select(
            F.col("id").alias("session_id"),
            F.col("least").alias("root_id"),
            F.array(F.lit("cyclic_child_ancestry")).alias("flags"),
        )
    )


def _double(chains: DataFrame, onward: DataFrame) -> DataFrame:
    """Jump from each pointer to that session's pointer.

    Who did not resolve this round points to a session that was unresolved when the
    round began, so `onward`, the sessions of that round, holds every jump.
    """
    ahead = onward.select(
        F.col("id").alias("mid"), F.col("ptr").alias("next_ptr"), F.col("least").alias("next_least")
    )
    return chains.join(ahead, F.col("ptr") == F.col("mid")).select(
        "id",
        F.col("next_ptr").alias("ptr"),
        F.least("least", "next_least").alias("least"),
        F.col("least").alias("narrow"),
    )
