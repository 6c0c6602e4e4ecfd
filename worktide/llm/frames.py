"""Small helpers shared by the text operators."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktide.session import materialise

__all__ = ["ascii_lower", "capitals_free", "digest", "discard", "map_rows", "materialise", "named"]

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII strings take the faster built-in."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, CAPITALS, CAPITALS.lower()))


def capitals_free(text: str) -> bytes:
    """UTF-8 of a text with A-Z lower-cased; bytes.lower() leaves all other letters alone."""
    return text.encode("utf-8", "surrogatepass").lower()


def digest(*columns: Column) -> tuple[Column, Column]:
    """128 bits of a value as two longs; equal values alone share both in practice."""
    return F.xxhash64(*columns), F.xxhash64(F.lit(7), *columns)


def named(df: DataFrame, **columns: str) -> DataFrame:
    """Only the given columns, under the operator's own names: `named(docs, row="doc_id")`.

    Whatever else the input carries is left behind, so that its names cannot clash.
    """
    return df.select(*[df[f"`{old}`"].alias(new) for new, old in columns.items()])


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more, and let go of the shuffles behind them.

    Long operators write some ten tables; without this all of them, and the shuffle files of every
    finished step, stay on disk until the driver happens to collect its garbage.
    """
    spark = tables[0].sparkSession
    for table in tables:
        folder, _, name = table.inputFiles()[0].rpartition("/")[0].rpartition("/")
        if not name.startswith("worktide-"):
            raise ValueError(f"not a written table: {folder}/{name}")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def map_rows(
    df: DataFrame,
    work: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]],
    schema: str,
) -> DataFrame:
    """mapInArrow over dicts of Python lists, some hundred rows of a batch at a time."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for batch in source:
            for at in range(0, batch.num_rows, 256):
                yield batch.slice(at, 256).to_pydict()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in work(batches(source)):
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return df.mapInArrow(run, schema)
