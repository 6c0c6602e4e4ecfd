"""Greedy anchors on a line of whole numbers, decided block by block.

Values come in some order. One within `reach` of an earlier anchor joins the first such
anchor, any other becomes one. What a value becomes depends on its neighbours alone, but
their decisions hang on theirs, so a long run of near values is one chain.

The line is cut into blocks. Two anchors are more than `reach` apart, so of the values that
a block can see beyond an edge at most one is an anchor. For each choice of these two a block
is folded, and gives the anchors it shows to its neighbours in turn: a table of at most
(reach + 1)^2 rows. Tables of neighbours compose, and exactly one choice fits along a chain.
A task folds the values of one block, which are no more than it is wide; only the tables of
a key's touching blocks meet, and they are as many as the line has blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktide.session import materialise

BLOCK = 1024
#: An edge beyond which there is no anchor.
NONE = -1

Value = tuple[int, int]  # (place in the order, value)


def fold(values: Iterable[Value], beyond: Iterable[Value], reach: int) -> list[Value]:
    """Anchors among `values`, in their order; those of `beyond` are anchors already decided."""
    known = set(beyond)
    anchors: list[Value] = []
    covered: set[int] = set()
    for place, value in sorted([*values, *known]):
        if (place, value) in known or value not in covered:
            anchors.append((place, value))
            covered.update(range(value - reach, value + reach + 1))
    return anchors


def choices(edge: Sequence[Value]) -> list[list[Value]]:
    """What may be an anchor beyond an edge: nothing, or one of the values there."""
    return [[], *[[v] for v in edge]]


def shown(anchors: Iterable[Value], low: int, high: int) -> int:
    return next((v for _, v in anchors if low <= v <= high), NONE)


def block_table(
    start: int, inner: Sequence[Value], left: Sequence[Value], right: Sequence[Value], reach: int, width: int
) -> list[tuple[int, int, int, int]]:
    """(anchor beyond the left edge, beyond the right, own near the left, own near the right)."""
    rows = []
    end = start + width
    for a in choices(left):
        for b in choices(right):
            own = [x for x in fold(inner, a + b, reach) if start <= x[1] < end]
            rows.append((a[0][1] if a else NONE, b[0][1] if b else NONE,
                         shown(own, start, start + reach - 1), shown(own, end - reach, end - 1)))
    return rows


def settle(tables: Sequence[Sequence[tuple[int, int, int, int]]]) -> list[tuple[int, int]]:
    """The anchors beyond both edges of each block in a chain of touching blocks."""
    # For each anchor beyond the right edge: how the chain so far ends, and what led there.
    ends = {NONE: NONE}
    back: list[dict[int, tuple[int, int]]] = []
    for table in tables:
        now, led = {}, {}
        for left, right, own_left, own_right in table:
            # `ends` has what stands left of the edge, given what this block shows there.
            if ends.get(own_left) == left:
                now[right], led[right] = own_right, (left, own_left)
        if len(back) == 0:
            now = {r: o for left, r, _, o in table if left == NONE}
            led = {r: (NONE, o) for left, r, o, _ in table if left == NONE}
        ends = now
        back.append(led)
    out, right = [], NONE
    for led in reversed(back):
        left, own_left = led[right]
        out.append((left, right))
        right = own_left
    return out[::-1]


def greedy_anchors(values: DataFrame, key: str, value: str, order: str, reach: int, width: int = BLOCK) -> DataFrame:
    """(key, value, anchor) of distinct (key, value); `order` and then the value tell which come first."""
    place = F.struct(F.unix_micros(order).alias("place"), F.col(value).alias("value"))
    block = F.floor(F.col(value) / width).cast("bigint")
    offset = F.col(value) - block * width
    # A value goes to its own block, and to the neighbour that can see it.
    homes = F.array_compact(F.array(
        F.struct(block.alias("block"), F.lit(0).alias("side")),
        F.when(offset < reach, F.struct((block - 1).alias("block"), F.lit(1).alias("side"))),
        F.when(offset >= width - reach, F.struct((block + 1).alias("block"), F.lit(-1).alias("side")))))
    rows = values.select(F.col(key).alias("key"), place.alias("v"), F.explode(homes).alias("h")).select("key", "v", "h.*")
    sides = {-1: "left", 0: "inner", 1: "right"}
    blocks = rows.groupBy("key", "block").agg(*[
        F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("v")))).alias(name) for s, name in sides.items()
    ]).where("size(inner) > 0")
    blocks = materialise(blocks)

    def pairs(items) -> list[Value]:
        return [(int(x["place"]), int(x["value"])) for x in items]

    def tables(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [block_table(b * width, pairs(i), pairs(x), pairs(y), reach, width)
                     for b, i, x, y in zip(frame["block"], frame["inner"], frame["left"], frame["right"])]
            yield frame[["key", "block"]].assign(
                table=[[dict(zip("abcd", row)) for row in rows] for rows in found])

    def chosen(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block", ignore_index=True)
        rows = [[(x["a"], x["b"], x["c"], x["d"]) for x in t] for t in frame["table"]]
        chain = (frame["block"].diff() != 1).cumsum()
        out = [x for _, at in frame.groupby(chain).groups.items() for x in settle([rows[k] for k in at])]
        return frame[["key", "block"]].assign(a=[x[0] for x in out], b=[x[1] for x in out])

    def joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples():
                inner = pairs(row.inner)
                beyond = [v for v in [*pairs(row.left), *pairs(row.right)] if v[1] in (row.a, row.b)]
                first: dict[int, int] = {}
                for _, anchor in fold(inner, beyond, reach):
                    for near in range(anchor - reach, anchor + reach + 1):
                        first.setdefault(near, anchor)
                out += [(row.key, v, first[v]) for _, v in inner]
            yield pd.DataFrame(out, columns=["key", value, "anchor"])

    # A block that sees nothing beyond its edges needs no table.
    touching = blocks.where("size(left) + size(right) > 0")
    kind = values.schema[key].dataType.simpleString()
    told = touching.mapInPandas(tables, f"key {kind}, block bigint, table array<struct<a:bigint,b:bigint,c:bigint,d:bigint>>")
    told = told.groupBy("key").applyInPandas(chosen, f"key {kind}, block bigint, a bigint, b bigint")
    both = blocks.join(told, ["key", "block"], "left").withColumns(
        {"a": F.coalesce("a", F.lit(NONE)), "b": F.coalesce("b", F.lit(NONE))})
    out = both.mapInPandas(joined, f"key {kind}, {value} bigint, anchor bigint")
    return out.withColumnRenamed("key", key)
