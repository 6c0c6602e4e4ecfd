"""The evidence tables, and the schemas they are read with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

COUNTERS = (
    "input_tokens",
    "cached_input_tokens",
    "cache_write_input_tokens",
    "output_tokens",
    "reasoning_output_tokens",
    "total_tokens",
)
COUNTS = "STRUCT<" + ", ".join(f"{name}: BIGINT" for name in COUNTERS) + ">"

SCHEMAS = {
    "sessions": "id STRING, cwd STRING, title STRING, created TIMESTAMP, updated TIMESTAMP, "
    "archived BOOLEAN, parent_id STRING, is_child BOOLEAN, quality ARRAY<STRING>",
    "turns": "session_id STRING, id STRING, cwd STRING, start TIMESTAMP, end TIMESTAMP, "
    "outcome STRING, quality ARRAY<STRING>, provenance ARRAY<STRING>, "
    "sampling_uncertainty_seconds DOUBLE",
    "waits": "session_id STRING, turn_id STRING, start TIMESTAMP, end TIMESTAMP",
    "coverage": "session_id STRING, turn_id STRING, start TIMESTAMP, end TIMESTAMP",
    "contexts": "session_id STRING, turn_id STRING, at TIMESTAMP, model_id STRING, "
    "reasoning_level STRING",
    "quota": "at TIMESTAMP, limit_id STRING, plan_type STRING, bucket STRING, "
    "window_minutes BIGINT, resets_at BIGINT, used_percent DOUBLE",
    "usage": "id STRING, session_id STRING, at TIMESTAMP, cwd STRING, model_id STRING, "
    f"turn_id STRING, cumulative {COUNTS}, last_usage {COUNTS}, delta {COUNTS}, "
    "request_input_tokens BIGINT, diagnostics ARRAY<STRING>",
    "samples": "poll_id BIGINT, session_id STRING, state STRING, at TIMESTAMP, turn_id STRING, "
    "cwd STRING, uncertainty_seconds DOUBLE",
    "diagnostics": "reason STRING, at TIMESTAMP, occurrences BIGINT",
}


class Evidence:
    """One consistent set of evidence tables.

    A table is a DataFrame, or a function giving one that is called on first use.
    """

    sessions: DataFrame
    turns: DataFrame
    waits: DataFrame
    coverage: DataFrame
    contexts: DataFrame
    quota: DataFrame
    usage: DataFrame
    samples: DataFrame
    diagnostics: DataFrame

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame]) -> None:
        unknown = set(tables) - set(SCHEMAS)
        if unknown:
            raise ValueError(f"unknown evidence tables: {sorted(unknown)}")
        self._tables = tables

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._tables:
            raise AttributeError(name)
        table = self._tables[name]
        if callable(table):
            table = self._tables[name] = table()
        return table

    def __contains__(self, name: str) -> bool:
        return name in self._tables

    def with_tables(self, **tables: DataFrame | Callable[[], DataFrame]) -> "Evidence":
        return Evidence(**{**self._tables, **tables})


def empty_evidence(spark: SparkSession) -> Evidence:
    return Evidence(**{name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()})
