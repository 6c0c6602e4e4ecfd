from __future__ import annotations

import sys
from datetime import UTC, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from worktide.evidence import COUNTERS, SCHEMAS, Evidence  # noqa: E402
from worktide.session import prepare  # noqa: E402

T0 = datetime(2026, 10, 6, 16, tzinfo=UTC)
UPPER = ["historical_upper_bound"]


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def counts(**values) -> tuple:
    return tuple(values.get(name) for name in COUNTERS)


class Build:
    """Evidence from short rows; seconds are offsets from T0."""

    def __init__(self, spark):
        self.spark = spark
        self.rows = {name: [] for name in SCHEMAS}

    def session(self, sid="s", cwd="/a", parent=None, child=False, archived=False, title="",
                quality=()):
        self.rows["sessions"].append((sid, cwd, title, at(0), at(0), archived, parent,
                                      child or parent is not None, list(quality)))
        return self

    def turn(self, start, end, sid="s", tid="t", cwd="/a", quality=UPPER, unsure=0.0):
        self.rows["turns"].append((sid, tid, cwd, at(start), None if end is None else at(end),
                                   None, list(quality), ["rollout"], unsure))
        return self

    def span(self, table, start, end, sid="s", tid="t"):
        self.rows[table].append((sid, tid, at(start), at(end)))
        return self

    def context(self, second, model, level=None, sid="s", tid="t"):
        self.rows["contexts"].append((sid, tid, at(second), model, level))
        return self

    def quota(self, second, used, resets=1_000_000, bucket="primary", plan="pro"):
        self.rows["quota"].append((at(second), "lim", plan, bucket, 10080, resets, float(used)))
        return self

    def usage(self, uid, second, delta, sid="s", cwd="/a", model="A", request=None, reasons=()):
        self.rows["usage"].append((uid, sid, at(second), cwd, model, None, None, None, delta,
                                   request, list(reasons)))
        return self

    def done(self) -> Evidence:
        return Evidence(**{n: self.spark.createDataFrame(self.rows[n], SCHEMAS[n])
                           for n in SCHEMAS})


@pytest.fixture
def build(spark):
    return Build(spark)
