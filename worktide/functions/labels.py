"""Readable labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def duration_label(us: Column) -> Column:
    """`1h 2m 3s`; short non-zero work keeps its fraction."""
    whole = F.greatest(us, F.lit(0))
    total = F.floor(whole / MICROS).cast("bigint")
    hours = F.floor(total / 3600).cast("string")
    minutes = F.floor(total % 3600 / 60).cast("string")
    seconds = (total % 60).cast("string")
    fraction = F.concat(
        F.lit("0."), F.regexp_replace(F.lpad(whole.cast("string"), 6, "0"), "0+$", ""), F.lit("s")
    )
    return (
        F.when((whole > 0) & (whole < MICROS), fraction)
        .when(total >= 3600, F.concat(hours, F.lit("h "), minutes, F.lit("m "), seconds, F.lit("s")))
        .when(total >= 60, F.concat(minutes, F.lit("m "), seconds, F.lit("s")))
        .otherwise(F.concat(seconds, F.lit("s")))
    )


def clock_label(seconds: Column) -> Column:
    """`h:mm:ss`."""
    total = F.greatest(F.floor(seconds), F.lit(0)).cast("bigint")
    return F.format_string(
        "%d:%02d:%02d", F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60
    )


def compact_tokens(value: Column) -> Column:
    """`1.5M`; null is unavailable, never zero."""

    def scaled(size: int, suffix: str) -> Column:
        # Half-even at two decimals.
        amount = F.bround((value.cast("decimal(20,0)") / F.lit(size)).cast("decimal(30,9)"), 2)
        text = F.regexp_replace(amount.cast("decimal(20,2)").cast("string"), r"\.?0+$", "")
        return F.concat(text, F.lit(suffix))

    return (
        F.when(value.isNull(), "unavailable")
        .when(value >= 1_000_000_000, scaled(1_000_000_000, "B"))
        .when(value >= 1_000_000, scaled(1_000_000, "M"))
        .when(value >= 1_000, scaled(1_000, "k"))
        .otherwise(value.cast("string"))
    )


def money_label(amount: Column, currency: str) -> Column:
    exact = amount.cast("decimal(38,12)")
    rounded = F.bround(exact, 2)
    return F.concat(
        F.lit(currency + " "),
        F.when(amount.isNull(), "unavailable")
        .when((exact > 0) & (exact < 0.01), "<0.01")
        .otherwise(F.format_number(rounded, 2)),
    )


def share_label(percent: Column) -> Column:
    return F.when((percent > 0) & (percent < 0.1), "<0.1%").otherwise(
        F.format_string("%.1f%%", percent)
    )


#: Notes, in their order, and beginnings of the flags that call for them.
NOTES = {
    "waits are sampled": ("sampled_waits",),
    "some work is estimated": ("historical_upper_bound",),
    "recording gaps": ("observation_gap",),
    "unfinished work": ("unfinished_observed_only", "unfinished"),
}
OTHER_NOTE = "some recording evidence is uncertain"


def quality_note(quality: Column) -> Column:
    """One sentence for the flags of a row; nothing where there are none."""
    table = F.array(*[F.struct(F.lit(note).alias("note"), F.array(*map(F.lit, flags)).alias("flags"))
                      for note, flags in NOTES.items()])

    def called(row: Column) -> Column:
        # Only the first of them stands for a family of flags, the others are whole.
        family = row["note"] == next(iter(NOTES))
        return F.exists(quality, lambda q: F.array_contains(row["flags"], q) | (family & q.startswith(row["flags"][0])))

    notes = F.transform(F.filter(table, called), lambda row: row["note"])
    text = F.array_join(F.when(F.size(notes) > 0, notes).otherwise(F.array(F.lit(OTHER_NOTE))), "; ")
    sentence = F.concat(F.upper(F.left(text, F.lit(1))), F.right(text, F.length(text) - 1), F.lit("."))
    return F.when(F.size(quality) > 0, sentence).otherwise("")


def diagnostic_note(count: Column) -> Column:
    return (
        F.when(count == 0, "")
        .when(count == 1, "1 recording notice.")
        .otherwise(F.concat(count.cast("string"), F.lit(" recording notices.")))
    )


def safe_text(text: Column) -> Column:
    """No control characters: line breaks and tabs become spaces, others '?'."""
    return F.regexp_replace(F.regexp_replace(text, "[\\r\\n\\t]", " "), "\\p{C}", "?")


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
