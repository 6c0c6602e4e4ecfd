"""Approximate nearest neighbours by inner product: collision counting, query-aware windows.

Vectors are put on the unit sphere of one more dimension, where the largest inner product
is the smallest distance. Each of `projections` random lines gives one sorted array of
positions. Around a query's own position every array has a window; as the search radius
grows by `growth`, the windows are widened in place (virtual rehashing). A vector that lies
in the windows of enough lines, `threshold` of them, is verified by its exact product. A
query ends when its k-th best distance is within the radius; a radius of two takes in all.

Scale: vectors and the stated queries are dealt into blocks by a hash of the id. Every
pair of a vector block and a query block is one group of bounded size with its own sorted
arrays; the k best of each are merged per query. Work and traffic follow queries x vectors
/ block, as a set of queries against all rows must. Nothing is collected but three numbers.

Defined cases: vectors that are null, zero, of another dimension than most, or hold null,
NaN or infinity take no part, nor do null ids. Rows that share an id are one vector, the
smallest. Copies of a vector collide alike, so ties are all verified and go to smaller ids.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worktide.llm.frames import named

VECTOR_BLOCK = 65_536
QUERY_BLOCK = 512


class Index:
    """Sorted arrays of one block of vectors."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, longest: float, projections: int, seed: int):
        self.vectors, self.ids, self.longest = vectors, ids, longest
        rng = np.random.default_rng(seed)
        self.lines = rng.standard_normal((vectors.shape[1] + 1, projections))
        unit = vectors / longest
        last = np.sqrt(np.maximum(0.0, 1.0 - (unit * unit).sum(axis=1)))
        spots = unit @ self.lines[:-1] + last[:, None] * self.lines[-1]
        self.order = np.argsort(spots, axis=0, kind="stable").T.copy()
        self.spots = np.sort(spots, axis=0).T.copy()

    def search(self, query: np.ndarray, own: int, k: int, threshold: int, start: float,
               growth: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, products) of the best found, at most k and all ties of the last."""
        unit = query / math.sqrt(float(query @ query))
        middle = unit @ self.lines[:-1]
        lines, size = self.order.shape
        low = np.array([np.searchsorted(s, x) for s, x in zip(self.spots, middle, strict=True)])
        high = low.copy()
        counts = np.zeros(size, dtype=np.int32)
        open_ = self.ids != own
        found, products = np.empty(0, dtype=np.int64), np.empty(0)
        radius = start
        while True:
            if radius >= 2.0:
                fresh = np.nonzero(open_)[0]
            else:
                parts = []
                for i in range(lines):
                    wide = np.searchsorted(self.spots[i], (middle[i] - radius, middle[i] + radius))
                    parts += [self.order[i, wide[0] : low[i]], self.order[i, high[i] : wide[1]]]
                    low[i], high[i] = min(low[i], wide[0]), max(high[i], wide[1])
                counts += np.bincount(np.concatenate(parts), minlength=size).astype(np.int32)
                fresh = np.nonzero(open_ & (counts >= threshold))[0]
            open_[fresh] = False
            found = np.concatenate((found, fresh))
            products = np.concatenate((products, self.vectors[fresh] @ query))
            if len(found) > k:
                least = np.partition(products, len(products) - k)[len(products) - k]
                near = products >= least - 1e-9 * self.longest * math.sqrt(float(query @ query))
                found, products = found[near], products[near]
            if radius >= 2.0:
                break
            if len(found) >= k:
                least = np.partition(products, len(products) - k)[len(products) - k]
                cosine = least / (self.longest * math.sqrt(float(query @ query)))
                if math.sqrt(max(0.0, 2.0 - 2.0 * cosine)) <= radius:
                    break
            radius *= growth
        # Summed in one order for every vector, so that copies have equal products.
        exact = np.zeros(len(found))
        for j in range(self.vectors.shape[1]):
            exact += self.vectors[found, j] * query[j]
        return self.ids[found], exact


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name).combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    *,
    k: int = 20,
    projections: int = 64,
    threshold: float = 0.60,
    start: float = 0.05,
    growth: float = 1.1,
    seed: int = 17,
    vector_block: int = VECTOR_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, nearest first.

    `threshold` is the share of lines a vector must collide on. A vector at the radius
    does so on 0.683 of them on average; `threshold` sets the recall.
    """

    def sound(frame: DataFrame) -> DataFrame:
        rows = named(frame, id=id_col, v=vector_col).select("id", F.col("v").cast("array<double>").alias("v"))
        finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < F.lit(math.inf), F.lit(False)) & ~F.isnan(x))
        rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull())
        rows = rows.filter(finite & F.exists("v", lambda x: x != 0))
        return rows.groupBy("id").agg(F.min("v").alias("v"))

    base = sound(vectors)
    usual = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = f"query_id {dict(vectors.dtypes)[id_col]}, vec_id {dict(vectors.dtypes)[id_col]}, score double"
    if usual is None:
        return vectors.sparkSession.createDataFrame([], schema).select(
            "query_id", F.lit(1).alias("rank"), "vec_id", "score")
    size = usual["d"]
    base = base.filter(F.size("v") == size)
    asked = sound(queries).filter(F.size("v") == size)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    stats = base.agg(F.count(F.lit(1)), F.max(F.sqrt(square))).first()
    blocks = -(-stats[0] // vector_block)
    lots = max(1, -(-asked.count() // query_block))
    longest = stats[1] * (1 + 1e-12)
    need = math.ceil(threshold * projections)

    each_lot = F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot")
    each_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    left = asked.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(lots)).cast("int").alias("lot"), each_block)
    right = base.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), each_lot)

    def run(mine: pa.Table, others: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if mine.num_rows and others.num_rows:
            ids = others.column("id").to_numpy()
            index = Index(_matrix(others, "v"), ids, longest, projections, seed)
            for own, query in zip(mine.column("id").to_pylist(), _matrix(mine, "v"), strict=True):
                found, score = index.search(query, own, k, need, start, growth)
                best = np.lexsort((found, -score))[:k]
                out["query_id"] += [own] * len(best)
                out["vec_id"] += found[best].tolist()
                out["score"] += score[best].tolist()
        kind = mine.schema.field("id").type
        return pa.table({"query_id": pa.array(out["query_id"], kind), "vec_id": pa.array(out["vec_id"], kind),
                         "score": pa.array(out["score"], pa.float64())})

    met = left.groupBy("block", "lot").cogroup(right.groupBy("block", "lot")).applyInArrow(run, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
