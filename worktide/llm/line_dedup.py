"""Line dedup: lines that many documents share stay in one of them.

Lines are split out, their normalised keys hashed, and the distinct documents of
each hash counted. Of a line held by too many documents only the copy in the
largest document id stays; the others are dropped and the texts put together
again by position. DataFrame functions only.

Scale: the hashes, not the lines, are shuffled to be counted; a line that a third
of all documents hold is one row per (hash, document) before it is reduced, and is
matched with its verdict by a skew join that AQE splits. Whole texts move once, to
meet the positions of their dropped lines.

Defined cases: a null or empty text is one empty line. Rows that share an id are
one document; a null id is a document too, smaller than all others. Repeated rows
each come back. Extra input columns are ignored by `line_dedup`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktide.llm.frames import ascii_lower, digest, materialise

BLANKS = " \t\n\x0b\f\r"


def line_keys(text: Column) -> Column:
    """Keys of a text's lines, in order."""
    return F.transform(F.split(ascii_lower(text), "\n"), lambda line: F.btrim(line, F.lit(BLANKS)))


def shared_lines(rows: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """Hashes of keys that at least `min_docs` documents hold, and the largest of these."""
    keys = F.array_distinct(
        F.filter(line_keys(F.col("text")), lambda key: F.char_length(key) >= min_chars)
    )
    held = rows.select("row", F.explode(keys).alias("key"))
    one, two = digest(F.col("key"))
    once = held.select(one.alias("h1"), two.alias("h2"), "row").distinct()
    # max() passes over a null id, which is only the largest where it is the only one.
    counted = once.groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("docs"), F.max("row").alias("owner")
    )
    return counted.filter(F.col("docs") >= min_docs).select("h1", "h2", "owner")


def dropped_positions(rows: DataFrame, shared: DataFrame, min_chars: int) -> DataFrame:
    """(row, version, positions) of lines that go; `version` tells texts of one id apart."""
    lines = rows.select("row", "version", F.posexplode(line_keys(F.col("text"))).alias("at", "key"))
    lines = lines.filter(F.char_length("key") >= min_chars)
    one, two = digest(F.col("key"))
    placed = lines.select(one.alias("h1"), two.alias("h2"), "row", "version", "at")
    gone = placed.join(shared, ["h1", "h2"]).filter(~F.col("row").eqNullSafe(F.col("owner")))
    return gone.groupBy("row", "version").agg(F.collect_set("at").alias("gone"))


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    min_docs: int = 3,
    min_chars: int = 20,
    carry: list[str] | None = None,
) -> DataFrame:
    """One row (id, text, n_lines, n_dropped) for each input row; `text` holds the kept lines.

    Columns named in `carry` come back as they are, in a struct `carried`.
    """
    text = F.coalesce(docs[f"`{text_col}`"], F.lit(""))
    rows = docs.select(
        docs[f"`{id_col}`"].alias("row"), text.alias("text"), F.xxhash64(text).alias("version"),
        *([F.struct(*[docs[f"`{c}`"] for c in carry]).alias("carried")] if carry else []))
    # Written, so that the join with it has an exchange on both sides and AQE can split a hot line.
    shared = materialise(shared_lines(rows, min_docs, min_chars))
    gone = dropped_positions(rows, shared, min_chars)
    gone = gone.select(F.col("row").alias("r"), F.col("version").alias("v"), "gone")
    same = F.col("row").eqNullSafe(F.col("r")) & (F.col("version") == F.col("v"))
    both = rows.join(gone, same, "left")

    def rebuilt(lines: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(lines) - 1)
        kept = F.array_except(every, F.coalesce("gone", F.array().cast("array<int>")))
        return F.struct(
            F.array_join(F.transform(kept, lambda at: F.get(lines, at)), "\n").alias("text"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(kept)).cast("long").alias("n_dropped"),
        )

    # The lines are bound once by the lambda, not split again for every position.
    done = F.transform(F.array(F.split("text", "\n")), rebuilt)[0]
    more = ["carried"] if carry else []
    out = both.select("row", F.explode(F.array(done)).alias("done"), *more)
    return out.select(F.col("row").alias(id_col), *[
        F.col(f"done.{name}").alias(name) for name in ("text", "n_lines", "n_dropped")
    ], *more)
