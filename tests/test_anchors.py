"""Resets that move by seconds: blocks against the sequential rule."""

from __future__ import annotations

import random

import pytest
from conftest import at

from worktide.operators.anchors import block_table, fold, greedy_anchors, settle
from worktide.operators.quota import reset_cohorts


def plain(values, reach):
    """value -> anchor, for values in their order."""
    anchors, out = [], {}
    for v in values:
        near = [a for a in anchors if abs(a - v) <= reach]
        if not near:
            anchors.append(v)
        out[v] = near[0] if near else v
    return {v: next(a for a in anchors if abs(a - v) <= reach) for v in out}


ORDERS = {"rising": sorted, "falling": lambda v: sorted(v, reverse=True), "mixed": list}


@pytest.mark.parametrize("order", ORDERS)
@pytest.mark.parametrize("reach,width", [(1, 3), (3, 9), (10, 21), (10, 64)])
def test_blocks_settle_as_the_sequence_does(order, reach, width):
    rng = random.Random(reach * width)
    for _ in range(60):
        span = rng.choice([30, 120, 300])
        values = ORDERS[order](rng.sample(range(500, 500 + span), rng.randint(1, span)))
        placed = list(enumerate(values))
        blocks = sorted({v // width for v in values})
        seen = {}
        for b in blocks:
            low, high = b * width, (b + 1) * width
            seen[b] = ([x for x in placed if low <= x[1] < high], [x for x in placed if low - reach <= x[1] < low],
                       [x for x in placed if high <= x[1] < high + reach])
        chains = []
        for b in blocks:
            if not chains or chains[-1][-1] != b - 1:
                chains.append([])
            chains[-1].append(b)
        got = set()
        for chain in chains:
            for b, edges in zip(chain, settle([block_table(b * width, *seen[b], reach, width) for b in chain])):
                inner, left, right = seen[b]
                beyond = [x for x in left + right if x[1] in edges]
                got |= {v for _, v in fold(inner, beyond, reach) if v // width == b}
        assert got == set(plain(values, reach).values())


def test_rolling_resets_are_cut_into_blocks(spark):
    """A hundred thousand resets, one second apart: one chain in two streams of other orders."""
    n = 50_000
    rng = random.Random(1)
    shuffled = rng.sample(range(n), n)
    rows = [("up", 1_706_000_000 + k, at(k)) for k in range(n)] + [
        ("any", 1_706_000_000 + v, at(k)) for k, v in enumerate(shuffled)]
    df = spark.createDataFrame(rows, "stream string, resets_at bigint, at timestamp")
    got = {(r.stream, r.resets_at): r.cohort for r in reset_cohorts(df).collect()}
    for stream in ("up", "any"):
        want = plain_fast([v for s, v, _ in rows if s == stream])
        assert {v: got[stream, v] for s, v, _ in rows if s == stream} == want


def plain_fast(values, reach=10):
    anchors, first = set(), {}
    for v in values:
        if v not in first:
            anchors.add(v)
            for near in range(v - reach, v + reach + 1):
                first.setdefault(near, v)
    return {v: first[v] for v in values}


def test_repeats_ties_and_empty_tables(spark):
    rows = [("s", 100, at(5)), ("s", 100, at(1)), ("s", 108, at(1)), ("s", 118, at(2)), ("t", 100, at(0))]
    df = spark.createDataFrame(rows, "stream string, resets_at bigint, at timestamp")
    got = {(r.stream, r.resets_at, r.cohort) for r in reset_cohorts(df).collect()}
    assert got == {("s", 100, 100), ("s", 108, 100), ("s", 118, 118), ("t", 100, 100)}
    assert greedy_anchors(df.limit(0).withColumnRenamed("at", "first_at"), "stream", "resets_at", "first_at", 10).count() == 0
