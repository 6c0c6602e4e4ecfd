"""Running aggregates over one key that may hold most of the rows.

A window over a session, a source file or a quota stream puts the whole key in
one task. Here the key is cut into ordered chunks. Rows are windowed inside
their chunk, every chunk is reduced to one row, the chunk rows are windowed
per key, and the carried value is joined back. The result equals the plain
window; only the chunk summaries of a key ever meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worktide.session import materialise

DAY_MICROS = 86_400_000_000

Frame = tuple[int, int]


@dataclass(frozen=True)
class Running:
    """How one running column is taken in a chunk, reduced, carried and combined."""

    value: Column
    inside: Callable[[Column], Column]
    total: Callable[[Column, Column], Column]
    across: Callable[[Column], Column]
    combine: Callable[[Column, Column], Column]
    forward: bool = True
    inclusive: bool = True
    settle: Callable[[Column], Column] = lambda near: near


def _plus(near: Column, far: Column) -> Column:
    return F.coalesce(near, F.lit(0)) + F.coalesce(far, F.lit(0))


def running_sum(value: Column, inclusive: bool = True) -> Running:
    return Running(
        value, F.sum, lambda v, o: F.sum(v), F.sum, _plus, inclusive=inclusive,
        settle=lambda near: F.coalesce(near, F.lit(0)),
    )


def running_max(value: Column, inclusive: bool = True) -> Running:
    return Running(
        value, F.max, lambda v, o: F.max(v), F.max, lambda a, b: F.greatest(a, b),
        inclusive=inclusive,
    )


def running_min(value: Column, inclusive: bool = True) -> Running:
    return Running(
        value, F.min, lambda v, o: F.min(v), F.min, lambda a, b: F.least(a, b),
        inclusive=inclusive,
    )


def latest(value: Column, inclusive: bool = True) -> Running:
    """Last non-null value so far. Wrap the value in a struct to carry nulls."""
    return Running(
        value,
        lambda v: F.last(v, ignorenulls=True),
        lambda v, o: F.max_by(v, F.when(v.isNotNull(), o)),
        lambda v: F.last(v, ignorenulls=True),
        F.coalesce,
        inclusive=inclusive,
    )


def upcoming(value: Column) -> Running:
    """First non-null value after the row."""
    return Running(
        value,
        lambda v: F.first(v, ignorenulls=True),
        lambda v, o: F.min_by(v, F.when(v.isNotNull(), o)),
        lambda v: F.first(v, ignorenulls=True),
        F.coalesce,
        forward=False,
        inclusive=False,
    )


def _frame(spec: Running) -> Frame:
    if spec.forward:
        return Window.unboundedPreceding, 0 if spec.inclusive else -1
    return 1, Window.unboundedFollowing


def scan(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: Sequence[str],
    **columns: Running,
) -> DataFrame:
    """Append running columns. `chunk` must rise with `order`; keys must not be null.

    `order` must be total inside a key for `latest` and `upcoming`.
    """
    part = [*keys, chunk]
    inner = Window.partitionBy(*part).orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(chunk)
    position = F.struct(*order)
    near = df.select(
        "*",
        *[
            spec.inside(spec.value).over(inner.rowsBetween(*_frame(spec))).alias(f"__near_{name}")
            for name, spec in columns.items()
        ],
    )
    totals = df.groupBy(*part).agg(
        *[spec.total(spec.value, position).alias(f"__all_{name}") for name, spec in columns.items()]
    )
    carried = totals.select(
        *part,
        *[
            spec.across(F.col(f"__all_{name}"))
            .over(
                outer.rowsBetween(Window.unboundedPreceding, -1)
                if spec.forward
                else outer.rowsBetween(1, Window.unboundedFollowing)
            )
            .alias(f"__far_{name}")
            for name, spec in columns.items()
        ],
    )
    return near.join(carried, part).select(
        *df.columns,
        *[
            spec.combine(F.col(f"__near_{name}"), F.col(f"__far_{name}")).alias(name)
            for name, spec in columns.items()
        ],
    )


def whole(
    df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], **columns: Running,
) -> DataFrame:
    """As `scan`, of keys that have one chunk each: nothing is carried, so one sort serves many in a row."""
    inner = Window.partitionBy(*keys, chunk).orderBy(*order)
    return df.select("*", *[
        spec.settle(spec.inside(spec.value).over(inner.rowsBetween(*_frame(spec)))).alias(name)
        for name, spec in columns.items()])


def parted(df: DataFrame, key: str, several: Sequence[str] | None) -> list[tuple[DataFrame, Callable[..., DataFrame]]]:
    """`df` in parts, each with the scan that fits it: `several` names the keys of several chunks, if they are known."""
    if several is None:
        return [(df, scan)]
    if not several:
        return [(df, whole)]
    long = F.col(key).isin(list(several))
    return [(df.where(~long), whole), (df.where(long), scan)]


def chunk_scan(
    df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], **columns: Running,
) -> tuple[DataFrame, DataFrame]:
    """The two halves of `scan`, written down: rows with `near_*`, and `far_*` a chunk.

    For inclusive `latest` and `running_sum`: a chunk's last row holds what the chunk comes to,
    so `df` is read once. A reader combines the halves over the columns and rows it needs.
    """
    part = [*keys, chunk]
    inner = Window.partitionBy(*part).orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    whole = df.dropna(subset=part)
    near = materialise(whole.select(
        "*",
        *[spec.inside(spec.value).over(inner.rowsBetween(*_frame(spec))).alias(f"near_{name}")
          for name, spec in columns.items()],
        F.lead(F.lit(1)).over(inner).isNull().alias("ends"),
    ))
    far = near.where("ends").select(
        *part, *[spec.across(F.col(f"near_{name}")).over(outer).alias(f"far_{name}") for name, spec in columns.items()])
    return near.drop("ends"), materialise(far)


def time_chunk(micros: Column, width: int = DAY_MICROS) -> Column:
    return F.floor(micros / F.lit(width)).cast("bigint")
