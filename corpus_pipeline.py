"""Corpus pipeline: five stages over `documents`, each written as Parquet and read by the next.

1. quality classifier: documents whose perplexity is out of their language's range go;
2. line dedup: lines that many documents share stay in one of them;
3. n-gram Jaccard join: of each group of near duplicates (five-word shingles, similarity
   0.8 or more) the smallest id stays;
4. benchmark decontamination: documents that hold a benchmark passage go;
5. SentencePiece encoding: what is left becomes sampled piece sequences.

Each stage works on all rows its predecessor kept. All but the last return the columns of
`documents`. Tables go to the shared folder that `spark.checkpoint.dir` names.

Defined cases, besides those of the operators: a text that line dedup empties stays as an
empty document; an empty input gives empty tables of the same columns.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from worktide.llm.decontaminate import without_passages  # noqa: E402
from worktide.llm.frames import materialise  # noqa: E402
from worktide.llm.jaccard import one_of_each  # noqa: E402
from worktide.llm.kneser_ney import without_rejected  # noqa: E402
from worktide.llm.line_dedup import line_dedup  # noqa: E402
from worktide.llm.pieces import encode  # noqa: E402
from worktide.llm.queries import table, trusted_ids  # noqa: E402


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_rejected(docs, trusted_ids(spark, sf_dir))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Kept lines in the place of the texts; `n_chars` follows, other columns stay."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    done = line_dedup(docs, carry=rest)
    columns = {c: F.col(f"carried.`{c}`") for c in rest}
    columns |= {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return done.select(*[columns[c].alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, width=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_passages(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, sample, ids, log_prob, inclusion), two samples of a document."""
    return encode(docs, paths=2).select("doc_id", "sample", "ids", "log_prob", "inclusion")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("SentencePiece encoding", pieces),
]

#: SQL cannot express the language model, the tree search or the sampled segmentations;
#: the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return materialise(STAGES[-1][1](spark, docs, sf_dir))
