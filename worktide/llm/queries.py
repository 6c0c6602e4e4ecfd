"""Registered queries of the text operators: each over whole tables, with production settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktide.llm import licences, merkle, repair, toxicity
from worktide.llm.chat import preference_pairs
from worktide.llm.decontaminate import find_passages
from worktide.llm.frames import ascii_lower
from worktide.llm.html import extract
from worktide.llm.jaccard import jaccard_components
from worktide.llm.kneser_ney import classify
from worktide.llm.line_dedup import line_dedup
from worktide.llm.neighbours import nearest
from worktide.llm.pieces import decode, encode
from worktide.llm.secrets import labelled_samples, secret_spans, train

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ends = F.filter("spans", lambda x, i: i % 2 == 1)
    starts = F.filter("spans", lambda x, i: i % 2 == 0)
    hit = F.aggregate(F.zip_with(ends, starts, lambda e, s: (e - s).cast("long")),
                      F.lit(0).cast("long"), lambda a, b: a + b)
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    spans = secret_spans(docs, train(labelled_samples(docs)))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def text(spans):
        return F.array_join(F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return spans.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
        count("hex").alias("n_hex"), F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )


@query
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled good and not toxic: the text that the quality model learns from."""
    return table(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0").select("doc_id")


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify(table(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir))
    return found.select("doc_id", "lang", "chars", F.round("perplexity", 6).alias("perplexity"),
                        F.round("threshold", 6).alias("threshold"), "rejected")


@query
def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = encode(table(spark, sf_dir, "documents"))
    made = made.withColumn("n_pieces", F.size("ids")).withColumn("ids_hash", F.xxhash64("ids"))
    back = decode(made).withColumn("restored", F.xxhash64("text") == F.col("mark"))
    return back.select("doc_id", "sample", "n_pieces", "ids_hash", F.round("log_prob", 3).alias("log_prob"),
                       F.round("inclusion", 6).alias("inclusion"), "restored")


@query
def op3_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2p and 2p + 1 are the chosen and the rejected one of pair p."""
    turns = table(spark, sf_dir, "conversations")
    turns = turns.withColumn("pair", F.floor(F.col("conv_id") / 2)).withColumn("side", F.col("conv_id") % 2 == 0)
    found = preference_pairs(turns, "pair", "side")

    def spans(mask: str):
        return F.array_join(F.transform(mask, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")

    return found.select(
        F.col("pair").alias("pair_id"), F.col("prompt_turns").cast("long").alias("prompt_turns"),
        F.sha2("prompt", 256).alias("prompt_sha256"), F.sha2("chosen", 256).alias("chosen_sha256"),
        spans("chosen_mask").alias("chosen_mask"), F.sha2("rejected", 256).alias("rejected_sha256"),
        spans("rejected_mask").alias("rejected_mask"))


@query
def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", F.char_length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"),
                      "text")


@query
def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


@query
def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = table(spark, sf_dir, "labels")
    model = licences.fit(docs, labelled=labelled)
    found = licences.candidates(docs, model)
    model = licences.calibrate(model, found, docs, labelled=labelled)
    return licences.document_licences(docs, model, found=found).select(
        "doc_id", "n_paragraphs", F.array_join("families", ",").alias("families"))


@query
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, toxicity.known_labels(table(spark, sf_dir, "labels")))
    held = F.coalesce(toxicity.remainder(F.col("row")) == 1, F.lit(False))
    return toxicity.scored(docs, model).select(
        F.col("row").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves whose id's checksum 3 divides are checked with a lower-cased text."""
    docs = table(spark, sf_dir, "documents")
    plain = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = docs.select(
        merkle.tree_name(F.col("lang")).alias("tree"), F.col("doc_id").alias("id"),
        merkle.leaf_hash(*plain, F.col("text")).alias("hash"),
        F.when(changed, merkle.leaf_hash(*plain, ascii_lower(F.col("text")))).alias("changed"))
    found = merkle.manifest(rows).with_proofs()
    sides = F.zip_with("before", "after", lambda b, a: F.concat(b, a))
    found = found.withColumn("folded_root", merkle.folded(F.coalesce("changed", "hash"), "before", "after"))
    return found.select(
        F.col("id").alias("doc_id"), F.col("hash").alias("leaf"), "subroot", "root",
        F.sha2(F.array_join(sides, ""), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    found = repair.repaired(repair.damaged(turns))
    every = turns.select("conv_id").distinct().withColumn("conv", repair.conversation(F.col("conv_id")))
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c)
               for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, "conv", "left").select(
        "conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)
