"""Tokens and cost over the session hierarchy, with missing evidence explicit."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktide.evidence import COUNTERS, Evidence
from worktide.operators.attribution import work_facts
from worktide.operators.hierarchy import root_sessions
from worktide.operators.pricing import price_usage
from worktide.operators.select import archive_filter, exclude_models, same_path
from worktide.plans.period import Period
from worktide.plans.time_reports import root_work, shared_facts, union_flags
from worktide.session import materialise

KEYS = ("cwd", "root_id", "session_id", "model_id")


def dedupe_usage(usage: DataFrame) -> DataFrame:
    """One observation per id. Two bodies under one id are a storage fault, see sinks."""
    return usage.dropDuplicates(["id"])


def fx_convert(micro_usd: Column, rate: Decimal | None) -> tuple[Column, Column]:
    """(usd, cad) from millionths of a dollar; no rate gives no amount."""
    # Precisions are chosen so that neither product has to give up scale.
    usd = micro_usd.cast("decimal(29,6)") * F.lit(Decimal("0.000001")).cast("decimal(6,6)")
    if rate is None:
        return usd, F.lit(None).cast("decimal(38,18)")
    return usd, usd.cast("decimal(27,12)") * F.lit(rate).cast("decimal(10,6)")


def fx_status(fx: DataFrame, now: datetime) -> DataFrame:
    """Age in days and unavailable, stale or cached for a row of load_fx."""
    at = F.lit(now)
    # greatest() skips nulls; a date or check that is missing must stay missing.
    age = F.when(
        F.col("observation_date").isNotNull(),
        F.greatest(F.datediff(F.to_date(at), F.col("observation_date")), F.lit(0)),
    )
    check = F.when(
        F.col("last_success").isNotNull(),
        F.greatest(F.unix_micros(at) - F.unix_micros("last_success"), F.lit(0)) / 1_000_000,
    )
    stale = F.col("last_error").isNotNull() | F.coalesce(check > 86_400, F.lit(True))
    return fx.withColumns(
        {
            "age_days": age,
            "check_age_seconds": check,
            "status": F.when(F.col("rate").isNull(), "unavailable")
            .when(stale, "stale")
            .otherwise("cached"),
        }
    )


def _with_root(df: DataFrame, roots: DataFrame, sessions: DataFrame) -> DataFrame:
    """Root of each row's session, its flags, and the archive state that counts."""
    state = sessions.select(F.col("id").alias("root_id"), F.col("archived").alias("root_archived"))
    return (
        df.join(roots, "session_id", "left")
        .withColumns(
            {
                "root_id": F.coalesce("root_id", "session_id"),
                "flags": F.coalesce("flags", F.array(F.lit("orphaned_child"))),
            }
        )
        .join(state, "root_id", "left")
    )


def _included(
    df: DataFrame, cwd: str | None, archive: str, session_id: str | None
) -> DataFrame:
    df = df.where(archive_filter(F.col("root_archived"), archive))
    if session_id is not None:
        df = df.where((F.col("session_id") == session_id) | (F.col("root_id") == session_id))
    return df if cwd is None else df.where(same_path(F.col("cwd"), cwd))


def token_cells(
    ev: Evidence,
    period: Period,
    catalog: DataFrame,
    *,
    cwd: str | None = None,
    archive: str = "all",
    session_id: str | None = None,
    excluded_models: Iterable[str] = (),
    roots: DataFrame | None = None,
    facts: DataFrame | None = None,
) -> DataFrame:
    """Additive facts per (directory, root, session, model), gaps included.

    Increments are priced row by row and reduced before anything else happens.
    Recorded work without usage adds cells with no observations. Such a cell of a
    child only counts below the total (`attached`) where its root has a row anyway.
    """
    roots = root_sessions(ev.sessions) if roots is None else roots
    usage = dedupe_usage(ev.usage.where(period.covers(F.col("at"))))
    priced = price_usage(exclude_models(usage, excluded_models), catalog)
    delta = F.col("delta")
    per_session = (
        priced.withColumn(
            "reasons", F.array_distinct(F.concat("reasons", "diagnostics"))
        )
        .groupBy("session_id", "cwd", "model_id", "excluded")
        .agg(
            F.count("*").alias("observations"),
            F.count_if(delta.isNull() | delta["total_tokens"].isNull()).alias("uncertain"),
            *[F.sum(delta[name]).alias(name) for name in COUNTERS],
            F.sum("priced_tokens").alias("priced_tokens"),
            F.sum("unpriced_tokens").alias("unpriced_tokens"),
            F.sum("micro_usd").cast("decimal(38,6)").alias("micro_usd"),
            F.bool_and("complete").alias("complete"),
            union_flags("reasons").alias("reasons"),
        )
    )
    seen = materialise(
        _included(_with_root(per_session, roots, ev.sessions), cwd, archive, session_id)
    )
    evidence = seen.where("NOT excluded").select(
        F.coalesce("cwd", F.lit("")).alias("cwd"),
        "root_id",
        "session_id",
        "model_id",
        "observations",
        "uncertain",
        *COUNTERS,
        "priced_tokens",
        "unpriced_tokens",
        "micro_usd",
        "complete",
        F.array_union("reasons", "flags").alias("reasons"),
        F.lit(False).alias("missing"),
        F.lit(False).alias("omitted"),
        F.lit(True).alias("attached"),
    )
    gaps = coverage_gaps(ev, period, seen, roots, cwd=cwd, archive=archive, session_id=session_id, facts=facts)
    empty = {
        "model_id": F.lit(None).cast("string"),
        "observations": F.lit(0).cast("bigint"),
        "uncertain": F.lit(0).cast("bigint"),
        **{name: F.lit(None).cast("bigint") for name in COUNTERS},
        "priced_tokens": F.lit(0).cast("bigint"),
        "unpriced_tokens": F.lit(0).cast("bigint"),
        "micro_usd": F.lit(0).cast("decimal(38,6)"),
        "complete": F.lit(True),
        "reasons": F.array().cast("array<string>"),
    }
    # Excluded usage marks the total even where no work was recorded for it.
    left_out = seen.where("excluded").select(
        F.coalesce("cwd", F.lit("")).alias("cwd"), "root_id", "session_id",
        F.lit(False).alias("missing"), F.lit(True).alias("omitted"), F.lit(False).alias("attached"),
    )
    return evidence.unionByName(
        gaps.select("cwd", "root_id", "session_id", "missing", "omitted", "attached")
        .unionByName(left_out)
        .withColumns(empty)
    )


def coverage_gaps(
    ev: Evidence,
    period: Period,
    seen: DataFrame,
    roots: DataFrame,
    *,
    cwd: str | None = None,
    archive: str = "all",
    session_id: str | None = None,
    facts: DataFrame | None = None,
) -> DataFrame:
    """Recorded work of (session, directory) in the period without counted usage.

    `missing` rows have no usage at all, `omitted` ones only usage of excluded
    models. Children count here too: their work adds no time but its usage is due.
    """
    if facts is None:
        facts = work_facts(
            ev.turns, ev.waits, ev.coverage, period.tz, start=period.start, end=period.end
        )
    worked = _included(
        _with_root(facts.select("session_id", "cwd").distinct(), roots, ev.sessions),
        cwd, archive, session_id,
    )
    usage = seen.where("cwd IS NOT NULL").groupBy("session_id", "cwd").agg(
        F.max("excluded").alias("some_excluded")
    )
    child = ev.sessions.where("is_child OR parent_id IS NOT NULL").select(
        F.col("id").alias("session_id"), F.lit(True).alias("is_child")
    )
    judged = materialise(
        worked.join(usage, ["session_id", "cwd"], "left")
        .join(child, "session_id", "left")
        .select(
            "session_id", "cwd", "root_id",
            F.coalesce("is_child", F.lit(False)).alias("is_child"),
            F.col("some_excluded").isNull().alias("missing"),
            F.coalesce("some_excluded", F.lit(False)).alias("omitted"),
        )
        .where("missing OR omitted")
    )
    rows = (
        seen.where("NOT excluded")
        .select(F.coalesce("cwd", F.lit("")).alias("cwd"), "root_id")
        .union(judged.where("NOT is_child").select("cwd", "root_id"))
        .distinct()
        .withColumn("has_row", F.lit(True))
    )
    return judged.join(rows, ["cwd", "root_id"], "left").withColumn(
        "attached", ~F.col("is_child") | F.coalesce("has_row", F.lit(False))
    ).drop("has_row")


def usage_summary() -> list[Column]:
    """Measures of a report row over token cells. Sums stay null when nothing was measured."""
    return [
        F.sum("observations").alias("observations"),
        F.sum("uncertain").alias("uncertain"),
        *[F.sum(name).alias(name) for name in COUNTERS],
        F.sum("priced_tokens").alias("priced_tokens"),
        F.sum("unpriced_tokens").alias("unpriced_tokens"),
        F.sum("micro_usd").cast("decimal(38,6)").alias("micro_usd"),
        F.bool_and("complete").alias("complete"),
        union_flags("reasons").alias("reasons"),
        F.bool_or("omitted").alias("omitted"),
        F.countDistinct(F.when(F.col("missing"), F.col("session_id"))).alias(
            "unavailable_sessions"
        ),
    ]


def _finish(rows: DataFrame, rate: Decimal | None) -> DataFrame:
    usd, cad = fx_convert(F.col("micro_usd"), rate)
    lacking = F.col("unavailable_sessions") > 0
    return rows.select(
        "level",
        "cwd",
        "root_id",
        "child_id",
        "model_id",
        F.when(
            F.col("observations") == 0,
            F.when(F.col("omitted") & ~lacking, "excluded").otherwise("unavailable"),
        )
        .when((F.col("uncertain") > 0) | lacking, "partial")
        .otherwise("recorded")
        .alias("status"),
        *COUNTERS,
        "observations",
        F.col("uncertain").alias("uncertain_observations"),
        "unavailable_sessions",
        "priced_tokens",
        "unpriced_tokens",
        ((F.col("observations") > 0) & ~lacking & (F.col("uncertain") == 0) & F.col("complete"))
        .alias("cost_complete"),
        "micro_usd",
        usd.alias("usd"),
        cad.alias("cad"),
        F.when(
            lacking,
            F.array_sort(
                F.array_union("reasons", F.array(F.lit("usage_unavailable_for_recorded_work")))
            ),
        ).otherwise(F.col("reasons")).alias("diagnostics"),
    )


def token_rollup(cells: DataFrame, rate: Decimal | None = None) -> DataFrame:
    """Summaries at total, model, directory, directory+model, root, root+model and child level."""
    blank = {name: F.lit(None).cast("string") for name in KEYS}
    total = cells.agg(*usage_summary()).withColumns({"level": F.lit("total"), **blank}).where(
        "observations IS NOT NULL"
    )
    sets = [["model_id"], ["cwd"], ["cwd", "model_id"], ["cwd", "root_id"],
            ["cwd", "root_id", "model_id"], list(KEYS)]
    attached = cells.where("attached")
    grouped = attached.groupingSets(sets, *KEYS).agg(
        *[m for m in usage_summary()], F.grouping_id().alias("mask")
    )
    # Bits, high to low: cwd, root, session, model; set when rolled away.
    level = (
        F.when(F.col("mask") == 14, "model").when(F.col("mask") == 7, "directory")
        .when(F.col("mask") == 6, "directory_model").when(F.col("mask") == 3, "session")
        .when(F.col("mask") == 2, "session_model").otherwise("child")
    )
    rows = grouped.withColumn("level", level).drop("mask").where(
        ~(F.col("level").isin("model", "directory_model", "session_model")
          & (F.col("observations") == 0))
        & ~((F.col("level") == "child")
            & ((F.col("session_id") == F.col("root_id"))
               | ((F.col("observations") == 0) & (F.col("unavailable_sessions") == 0))))
    )
    return _finish(total.unionByName(rows).withColumnRenamed("session_id", "child_id"), rate)


def token_report(
    ev: Evidence,
    period: Period,
    catalog: DataFrame,
    *,
    rate: Decimal | None = None,
    cwd: str | None = None,
    archive: str = "all",
    session_id: str | None = None,
    excluded_models: Iterable[str] = (),
    roots: DataFrame | None = None,
    facts: DataFrame | None = None,
) -> DataFrame:
    cells = token_cells(
        ev, period, catalog, cwd=cwd, archive=archive, session_id=session_id,
        excluded_models=excluded_models, roots=roots, facts=facts,
    )
    return token_rollup(materialise(cells), rate)


def projects_report(
    ev: Evidence,
    period: Period,
    catalog: DataFrame,
    *,
    rate: Decimal | None = None,
    cwd: str | None = None,
    archive: str = "all",
    session_id: str | None = None,
    excluded_models: Iterable[str] = (),
    roots: DataFrame | None = None,
    facts: DataFrame | None = None,
) -> DataFrame:
    """Working time and usage by directory and root session; either side may be alone."""
    chosen = ev.sessions.where(archive_filter(F.col("archived"), archive))
    if session_id is not None:
        chosen = chosen.where(F.col("id") == session_id)
    # Once for both: time counts roots, gaps in usage count children too.
    facts = shared_facts(ev, period, models=False) if facts is None else facts
    work = root_work(ev, period.tz, period.start, period.end, selected=chosen, cwd=cwd, facts=facts)
    time = work.groupBy("cwd", F.col("session_id").alias("root_id")).agg(
        F.sum("micros").alias("micros"), union_flags("quality").alias("work_quality")
    )
    tokens = materialise(
        token_report(
            ev, period, catalog, rate=rate, cwd=cwd, archive=archive, session_id=session_id,
            excluded_models=excluded_models, roots=roots, facts=facts,
        ).where(F.col("level").isin("session", "directory"))
    )
    named = ev.sessions.select(
        F.col("id").alias("root_id"), "title", F.col("quality").alias("own_quality")
    )
    none = F.array().cast("array<string>")
    usage = tokens.drop("child_id", "model_id")
    per_session = (
        time.join(usage.where("level = 'session'").drop("level"), ["cwd", "root_id"], "full")
        .join(named, "root_id", "left")
        .withColumns(
            {
                "level": F.lit("session"),
                "micros": F.coalesce("micros", F.lit(0).cast("bigint")),
                "title": F.coalesce("title", F.lit("")),
                "quality": F.array_sort(
                    F.array_union(F.coalesce("work_quality", none), F.coalesce("own_quality", none))
                ),
            }
        )
        .drop("work_quality", "own_quality")
    )
    per_session = materialise(per_session)
    per_directory = (
        per_session.groupBy("cwd")
        .agg(F.sum("micros").alias("micros"), union_flags("quality").alias("quality"))
        .join(usage.where("level = 'directory'").drop("level", "root_id"), "cwd", "left")
        .withColumns({"level": F.lit("directory"), "root_id": F.lit(None).cast("string"),
                      "title": F.lit("")})
    )
    # One row: the total of a report that has already been aggregated.
    total = per_session.agg(F.sum("micros").alias("all_micros"))
    return (
        per_session.unionByName(per_directory)
        .withColumn("one", F.lit(1))
        .join(F.broadcast(total.withColumn("one", F.lit(1))), "one")
        .withColumn(
            "share_percent",
            F.coalesce(F.try_divide(F.col("micros") * 100.0, F.col("all_micros")), F.lit(0.0)),
        )
        .drop("one", "all_micros")
    )
