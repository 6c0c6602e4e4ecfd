"""Session settings the operators rely on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    # Elapsed time is computed on UTC instants; calendars name their zone.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Set-valued aggregates stay in their hash map; their sets are small by design.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "65536",
    # A hot session or parent on the probe side of a join is split at run time.
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that `spark.checkpoint.dir` names.

    Without one, a session on one machine takes a temporary folder, which its tasks
    share; a cluster has no such folder, and the job is refused.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="worktide-checkpoint-"))


def shared_folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Compute an intermediate that is read more than once a single time.

    It is written to the cluster's checkpoint folder and read back: the table
    outlives executors, cuts the plan, and gives what follows a known size.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/worktide-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
