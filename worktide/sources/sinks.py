"""Appending evidence, daily records, exports and consolidation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worktide.evidence import Evidence
from worktide.functions.time import instant, local_date, micros
from worktide.operators.intervals import split_by_local_day, work_segments
from worktide.operators.select import roots_only
from worktide.session import materialise
from worktide.sources.evidence import QUOTA_KEY, unique_usage, usage_body, usage_conflicts

RECORD_ZONE = "America/Toronto"


def new_quota(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """Readings that are not stored yet, each once."""
    same = None
    held = stored.select(*[F.col(c).alias(f"s_{c}") for c in QUOTA_KEY])
    for name in QUOTA_KEY:
        part = F.col(name).eqNullSafe(F.col(f"s_{name}")) if name == "plan_type" else (
            F.col(name) == F.col(f"s_{name}"))
        same = part if same is None else same & part
    return fresh.dropDuplicates(QUOTA_KEY).join(held, same, "left_anti")


def new_usage(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """Observations with new ids; an id stored with another body fails the job."""
    held = stored.select("id", usage_body().alias("stored_body"))
    judged = unique_usage(fresh).withColumn("body", usage_body()).join(held, "id", "left")
    clash = F.col("stored_body").isNotNull() & (F.col("stored_body") != F.col("body"))
    # One expression decides: a conflict fails before the row could be filtered out.
    verdict = F.when(
        clash, F.raise_error(F.lit("conflicting usage observation identity")).cast("boolean")
    ).otherwise(F.col("stored_body").isNull())
    return judged.where(verdict).drop("body", "stored_body")


def append_quota(fresh: DataFrame, path: str, stored: DataFrame) -> None:
    materialise(new_quota(fresh, stored)).write.mode("append").parquet(path)


def append_usage(fresh: DataFrame, path: str, stored: DataFrame) -> None:
    """Partitioned by UTC date, so that a period reads its own days only."""
    materialise(new_usage(fresh, stored)).withColumn("date", F.to_date("at")).write.mode(
        "append").partitionBy("date").parquet(path)


def daily_records(segments: DataFrame, sessions: DataFrame, tz: str = RECORD_ZONE) -> DataFrame:
    """One record per root segment and local day, with a content-derived id."""
    roots = roots_only(sessions).select(F.col("id").alias("session_id"))
    rows = split_by_local_day(segments.join(roots, "session_id", "left_semi"), tz)
    identity = F.to_json(
        F.struct("session_id", "turn_ids", "cwd", micros(F.col("start")).alias("s"),
                 micros(F.col("end")).alias("e")))

    def key(text):
        return F.substring(F.sha2(text, 256), 1, 24)

    return rows.select(
        key(identity).alias("id"), F.col("day").alias("date"), "session_id", "start", "end",
        key(F.col("cwd")).alias("project"), "cwd", F.lit(False).alias("is_billable"),
        F.concat(
            F.array(F.concat(F.lit("session:"), "session_id")),
            F.transform("turn_ids", lambda t: F.concat(F.lit("turn:"), t)),
        ).alias("tags"),
    )


def write_daily_records(ev: Evidence, path: str, tz: str = RECORD_ZONE) -> None:
    """Replace all records of the sessions in `ev`; records of other sessions stay.

    Pass whole sessions. Days these sessions had or have records on are rewritten, and a
    day that is left without records is removed.
    """
    spark = ev.sessions.sparkSession
    records = daily_records(work_segments(ev.turns, ev.waits, ev.coverage), ev.sessions, tz)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target = hadoop(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(target):
        records.write.partitionBy("date").parquet(path)
        return
    records = materialise(records)
    stored = spark.read.schema(records.schema).parquet(path)
    mine = ev.sessions.select(F.col("id").alias("session_id"))
    days = materialise(stored.join(mine, "session_id", "left_semi").select("date").union(
        records.select("date")).distinct())
    others = stored.join(days, "date", "left_semi").join(mine, "session_id", "left_anti")
    whole = materialise(records.unionByName(others.select(records.columns)))
    whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "date").parquet(path)
    # One row for each day that is left empty.
    for day in days.join(whole.select("date").distinct(), "date", "left_anti").collect():
        files.delete(hadoop(f"{path}/date={day['date']}"), True)


def export(df: DataFrame, path: str, fmt: str) -> None:
    """JSON lines, or CSV with nested columns as JSON text."""
    if fmt == "json":
        df.write.mode("overwrite").json(path)
    elif fmt == "csv":
        flat_columns(df).write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ValueError("format must be json or csv")


def flat_columns(df: DataFrame) -> DataFrame:
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(*[
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
        for f in df.schema.fields])


def verify_evidence(ev: Evidence) -> DataFrame:
    """(check, value) counts; `*_conflicts` and `session_duplicates` must be zero."""

    def row(name: str, df: DataFrame, value=None) -> DataFrame:
        return df.agg((F.count("*") if value is None else value).cast("bigint").alias("value")
                      ).select(F.lit(name).alias("check"), "value")

    # Duplicates by grouping, so that no distinct set meets in one task.
    repeats = ev.sessions.groupBy("id").count().where("count > 1")
    checks = [
        row("sessions", ev.sessions),
        row("turns", ev.turns),
        row("session_duplicates", repeats),
        row("quota_lines", ev.quota),
        row("quota_unique", ev.quota.select(QUOTA_KEY).distinct()),
        row("usage_lines", ev.usage),
        row("usage_unique", ev.usage.select("id").distinct()),
        row("usage_conflicts", usage_conflicts(ev.usage)),
    ]
    whole = checks[0]
    for check in checks[1:]:
        whole = whole.union(check)
    return whole


def consolidate(legacy: Evidence, current: Evidence, path: str) -> DataFrame:
    """Union two stores, check them, publish, and return a manifest of the tables.

    Nothing is written to `path` unless sessions are distinct, no usage id has two
    bodies and the distinct counts of the result are those of the inputs.
    """
    flat_tables = ("sessions", "turns", "waits", "coverage", "contexts")
    merged = {
        name: materialise(
            getattr(legacy, name).unionByName(getattr(current, name), allowMissingColumns=True)
            .distinct())
        for name in flat_tables
    }
    quota = legacy.quota.unionByName(current.quota, allowMissingColumns=True)
    usage = legacy.usage.unionByName(current.usage, allowMissingColumns=True)
    merged["quota"] = materialise(quota.dropDuplicates(QUOTA_KEY))
    merged["usage"] = materialise(unique_usage(usage))
    checks = {r["check"]: r["value"] for r in verify_evidence(Evidence(**merged)).collect()}
    if checks["session_duplicates"] or checks["usage_conflicts"]:
        raise ValueError(f"evidence conflicts; nothing was published: {checks}")
    if checks["usage_unique"] != usage.select("id").distinct().count() or (
        checks["quota_unique"] != quota.select(QUOTA_KEY).distinct().count()
    ):
        raise ValueError("counts differ; nothing was published")
    # Staged whole beside the target and published by one rename: all tables or none.
    spark = usage.sparkSession
    staged = f"{path.rstrip('/')}-staged-{uuid.uuid4().hex}"
    for name, df in merged.items():
        df.write.mode("errorifexists").parquet(f"{staged}/{name}")
        if spark.read.schema(df.schema).parquet(f"{staged}/{name}").count() != df.count():
            raise ValueError(f"{name} was not written whole; nothing was published")
    _publish(spark, staged, path)
    manifest = None
    for name, df in merged.items():
        spark = df.sparkSession
        # Order-free content hash: the whole digest of each row, added up in four parts.
        digest = F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)
        parts = [F.sum(F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)"))
                 for at in (1, 17, 33, 49)]
        # Read back what was published, so that the manifest speaks of the files.
        row = spark.read.schema(df.schema).parquet(f"{path}/{name}").agg(
            F.count("*").alias("rows"),
            F.concat_ws("-", *[F.coalesce(p, F.lit(0)).cast("string") for p in parts]).alias("hash"))
        row = row.select(F.lit(name).alias("table"), "rows", "hash")
        manifest = row if manifest is None else manifest.union(row)
    return manifest


def _publish(spark: SparkSession, staged: str, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    source, target = hadoop(staged), hadoop(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(target) or not files.rename(source, target):
        raise ValueError(f"{path} exists or cannot be written; the tables stay in {staged}")


def report_parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one report that the other lacks, counted with repeats."""
    columns = a.columns
    other = b.select(columns)
    return a.exceptAll(other).withColumn("side", F.lit("left")).unionByName(
        other.exceptAll(a).withColumn("side", F.lit("right")))
