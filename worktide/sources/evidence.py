"""Evidence tables from journals, snapshots and stored tables."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worktide.evidence import COUNTERS, SCHEMAS, Evidence
from worktide.functions.time import day_bounds
from worktide.plans.period import Period

SPAN = "STRUCT<start: TIMESTAMP, end: TIMESTAMP>"
TURN = (
    "STRUCT<id: STRING, cwd: STRING, start: TIMESTAMP, end: TIMESTAMP, "
    "model_contexts: ARRAY<STRUCT<at: TIMESTAMP, model_id: STRING, reasoning_level: STRING>>, "
    f"waits: ARRAY<{SPAN}>, coverage: ARRAY<{SPAN}>, quality: ARRAY<STRING>, outcome: STRING, "
    "provenance: ARRAY<STRING>, sampling_uncertainty_seconds: DOUBLE>"
)
SESSION = (
    "id STRING, cwd STRING, title STRING, created TIMESTAMP, updated TIMESTAMP, archived BOOLEAN, "
    f"parent_id STRING, is_child BOOLEAN, quality ARRAY<STRING>, turns MAP<STRING, {TURN}>"
)
QUOTA_KEY = ["at", "limit_id", "plan_type", "bucket", "window_minutes", "resets_at",
             "used_percent"]


def _require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """Fail the job on a row that breaks the condition: bad history is not read past.

    It is a filter, so no later projection can prune it away.
    """
    return df.where(
        F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(
            F.raise_error(F.lit(message)).cast("boolean")
        )
    )


def read_quota_journal(spark: SparkSession, path: str) -> DataFrame:
    """Exact-distinct readings. A partial line or an invalid reading fails the job."""
    rows = spark.read.schema(SCHEMAS["quota"]).option("mode", "FAILFAST").json(path)
    valid = (
        F.col("at").isNotNull() & F.length("limit_id").between(1, 128)
        & F.coalesce(F.length("plan_type") <= 128, F.lit(True))
        & F.col("bucket").isin("primary", "secondary") & (F.col("window_minutes") > 0)
        & (F.col("resets_at") >= 0) & F.col("used_percent").between(0, 100)
    )
    return _require(
        rows, valid, "invalid quota journal; restore a valid backup"
    ).dropDuplicates(QUOTA_KEY)


def usage_body() -> Column:
    return F.sha2(F.to_json(F.struct(*[c for c in _names("usage") if c != "id"]),
                            {"ignoreNullFields": "false"}), 256)


def _names(table: str) -> list[str]:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(SCHEMAS[table]).names


def usage_conflicts(usage: DataFrame) -> DataFrame:
    """Ids that stand for more than one body."""
    bodies = usage.select("id", usage_body().alias("body"))
    return bodies.groupBy("id").agg(F.min("body").alias("lo"), F.max("body").alias("hi")).where(
        "lo <> hi").select("id")


def unique_usage(usage: DataFrame) -> DataFrame:
    """One row per id; two bodies under one id fail the job."""
    columns = _names("usage")
    single = usage.withColumn("body", usage_body()).groupBy("id").agg(
        F.min("body").alias("lo"), F.max("body").alias("hi"),
        F.any_value(F.struct(*[c for c in columns if c != "id"])).alias("o"),
    )
    return _require(single, F.col("lo") == F.col("hi"), "conflicting usage identity").select(
        "id", "o.*").select(columns)


def read_usage_journal(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(SCHEMAS["usage"]).option("mode", "FAILFAST").json(path)
    negative = F.lit(False)
    for part in ("cumulative", "last_usage", "delta"):
        for name in COUNTERS:
            negative = negative | F.coalesce(F.col(f"{part}.{name}") < 0, F.lit(False))
    ok = (F.length("id") > 0) & (F.length("session_id") > 0) & F.col("at").isNotNull() & ~negative
    return unique_usage(_require(rows, ok, "invalid usage journal"))


def explode_sessions(snapshots: DataFrame) -> dict[str, DataFrame]:
    """Session documents with nested turns to the flat tables."""
    ok = F.col("id").isNotNull() & (
        F.coalesce(F.size(F.filter(F.map_entries("turns"), lambda t: ~t["key"].eqNullSafe(
            t["value"]["id"]))), F.lit(0)) <= 0)
    docs = _require(snapshots, ok, "identifier/key mismatch")
    none = F.array().cast("array<string>")
    turns = docs.select(F.col("id").alias("session_id"), F.explode(F.map_values("turns")).alias("t"))

    def spans(name: str) -> DataFrame:
        return turns.select("session_id", F.col("t.id").alias("turn_id"),
                            F.explode(f"t.{name}").alias("s")).select("session_id", "turn_id", "s.*")

    return {
        "sessions": docs.select(
            "id", "cwd", F.coalesce("title", F.lit("")).alias("title"), "created", "updated",
            F.coalesce("archived", F.lit(False)).alias("archived"), "parent_id",
            F.coalesce("is_child", F.lit(False)).alias("is_child"),
            F.coalesce("quality", none).alias("quality")),
        "turns": turns.select(
            "session_id", "t.id", "t.cwd", "t.start", "t.end", "t.outcome",
            F.coalesce("t.quality", F.array(F.lit("historical_upper_bound"))).alias("quality"),
            F.coalesce("t.provenance", F.array(F.lit("rollout"))).alias("provenance"),
            F.coalesce("t.sampling_uncertainty_seconds", F.lit(0.0))
            .alias("sampling_uncertainty_seconds")),
        "waits": spans("waits"),
        "coverage": spans("coverage"),
        "contexts": spans("model_contexts"),
    }


def read_session_snapshots(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    docs = spark.read.schema(SESSION).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return explode_sessions(docs)


def upgrade_ledger_version(spark: SparkSession, path: str) -> Evidence:
    """A whole-store document of version 1 to 4; lists an older one lacks are empty."""
    fields = ", ".join(f.replace(" ", ": ", 1) for f in _split(SESSION))
    schema = (
        f"version INT, sessions MAP<STRING, STRUCT<{fields}>>, "
        f"quota_observations ARRAY<STRUCT<{_typed('quota')}>>, "
        f"usage_observations ARRAY<STRUCT<{_typed('usage')}>>, diagnostics ARRAY<STRING>"
    )
    doc = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    doc = _require(doc, F.col("version").between(1, 4), "unsupported version")
    docs = _require(doc.select(F.explode("sessions").alias("key", "s")),
                    F.col("key") == F.col("s.id"), "session key differs from its id").select("s.*")
    return Evidence(
        **explode_sessions(docs),
        quota=doc.select(F.explode("quota_observations").alias("q")).select("q.*").dropDuplicates(
            QUOTA_KEY),
        usage=unique_usage(doc.select(F.explode("usage_observations").alias("u")).select("u.*")),
        diagnostics=doc.select(F.explode("diagnostics").alias("reason")).select(
            "reason", F.lit(None).cast("timestamp").alias("at"),
            F.lit(1).cast("bigint").alias("occurrences")),
    )


def _split(ddl: str) -> list[str]:
    from pyspark.sql.types import StructType

    return [f"{f.name} {f.dataType.simpleString()}" for f in StructType.fromDDL(ddl).fields]


def _typed(table: str) -> str:
    return ", ".join(part.replace(" ", ": ", 1) for part in _split(SCHEMAS[table]))


def load_evidence(spark: SparkSession, root: str) -> Evidence:
    """Evidence stored as one parquet table per name below `root`."""

    def table(name: str):
        # Usage is stored by UTC date; the column lets a period skip whole folders.
        schema = SCHEMAS[name] + (", date DATE" if name == "usage" else "")
        return lambda: spark.read.schema(schema).parquet(f"{root}/{name}")

    return Evidence(**{name: table(name) for name in SCHEMAS})


def load_period(ev: Evidence, period: Period, limit_id: str, window_minutes: int) -> Evidence:
    """The period's usage, but all earlier quota history of the limit: baselines lie there.

    Both conditions are plain comparisons and reach the file scan.
    """
    usage = ev.usage.where(period.covers(F.col("at")))
    if "date" in ev.usage.columns:
        low, high = day_bounds(period.first, period.last, period.tz)
        usage = usage.where(F.col("date").isNull() | F.col("date").between(
            F.lit(low.astimezone(UTC).date()), F.lit(high.astimezone(UTC).date()))).drop("date")
    return ev.with_tables(
        usage=usage,
        quota=ev.quota.where(
            (F.col("limit_id") == limit_id) & (F.col("window_minutes") == window_minutes)),
    )


def load_fx(spark: SparkSession, path: str) -> DataFrame:
    """Latest valid USD to CAD rate, as at most one row; malformed lines are ignored."""
    schema = ("rate DECIMAL(12,6), observation_date DATE, base STRING, quote STRING, "
              "last_success TIMESTAMP, last_error STRING")
    rows = spark.read.schema(schema).json(path)
    return rows.where(
        (F.col("rate") > 0) & F.col("observation_date").isNotNull()
        & (F.coalesce("base", F.lit("USD")) == "USD") & (F.coalesce("quote", F.lit("CAD")) == "CAD")
    ).orderBy(F.col("observation_date").desc(), F.col("last_success").desc_nulls_last()).limit(1)
