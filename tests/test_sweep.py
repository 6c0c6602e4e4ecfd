"""Covered time by one sweep, against sums over pairs."""

from __future__ import annotations

import random

import pytest
from conftest import at
from pyspark.sql import functions as F

from worktide.operators.sweep import covered_time, running_totals


def plain(spans, windows):
    out = {}
    for key, label, low, high, sign in windows:
        met = sum(max(0, min(high, e) - max(low, s)) for k, s, e in spans if k == key)
        out[key, label] = out.get((key, label), 0) + sign * met * 1_000_000
    return {k: v for k, v in out.items() if v > 0}


@pytest.mark.parametrize("keys", [1, 4])
def test_covered_time_is_the_sum_over_pairs(spark, keys):
    rng = random.Random(keys)

    def interval():
        low = rng.randint(0, 400)
        return low, low + rng.choice([0, 1, 7, 60, 300])

    spans = [(rng.choice([None, "a", "b", "c"][:keys]), *interval()) for _ in range(300)]
    windows = [(rng.choice([None, "a", "b", "c"][:keys]), rng.choice([None, "x", "y"]), *interval(), 1) for _ in range(200)]
    # What is taken off was covered before: the same window again, with the other sign.
    windows += [(k, label, low, high, -1) for k, label, low, high, _ in rng.sample(windows, 40)]
    made = spark.createDataFrame([(k, at(s), at(e)) for k, s, e in spans], "key string, start timestamp, end timestamp")
    asked = spark.createDataFrame([(k, x, at(s), at(e), n) for k, x, s, e, n in windows],
                                  "key string, label string, start timestamp, end timestamp, sign int")
    got = {(r.key, r.label): r.micros for r in covered_time(made, asked, ["key"], ["label"]).collect()}
    assert got == plain(spans, windows)


def test_no_key_and_no_rows(spark):
    spans = spark.createDataFrame([(at(0), at(10)), (at(5), at(15))], "start timestamp, end timestamp")
    windows = spark.createDataFrame([(1, at(2), at(7), 1), (2, at(20), at(30), 1), (3, at(0), at(99), 1)],
                                    "w int, start timestamp, end timestamp, sign int")
    got = {r.w: r.micros for r in covered_time(spans, windows, [], ["w"]).collect()}
    assert got == {1: 7_000_000, 3: 20_000_000}
    assert covered_time(spans.limit(0), windows, [], ["w"]).collect() == []
    assert covered_time(spans, windows.limit(0), [], ["w"]).collect() == []


def test_one_key_is_summed_in_many_parts(spark):
    """Four of five rows on one key, yet no part is much larger than another."""
    n = 20_000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(n).select(F.when(F.col("id") % 5 > 0, 0).otherwise(F.col("id")).alias("key"),
                                     F.col("id").alias("p"), F.lit(1).cast("long").alias("step"))
        out = running_totals(rows, ["key", "p"], ["step"])
        got = [r.step for r in out.orderBy("key", "p").collect()]
        sizes = [len(x) for x in rows.repartitionByRange("key", "p").rdd.glom().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == list(range(1, n + 1))
    assert max(sizes) < 3 * (sum(sizes) / len(sizes))
