"""Exact top-k inner products by multi-resolution segment statistics.

A vector is cut into segments, of which mean and deviation are kept, at several
resolutions. For each segment of length n,

    q . x  <=  n * mean(q) * mean(x) + n * dev(q) * dev(x)

so the sum over segments bounds the score (for vectors of one norm: bounds the
distance from below). Bounds are taken coarse to fine, each only for the pairs
that the last one left, and exact scores only for the survivors. A bound of all
pairs of a tile is itself a matrix product of the statistics.

Queries go to the workers in blocks of a fixed size, with one pass over all
rows for each block; each task returns its best k of each query.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_folder, small_batches

QUERY_BLOCK = 16_384
ROWS = 8_192
QUERIES = 256
RESOLUTIONS = (1, 4, 16)


def whole_vectors(column: pa.Array, ids: pa.Array, scale: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: (ids, floor(scale * x)) of the vectors that are finite throughout."""
    known = pc.and_(pc.is_valid(column), pc.is_valid(ids))
    column, ids = column.filter(known), ids.filter(known).to_numpy(zero_copy_only=False)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(size) - size
    out = {}
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        x = values[start[rows][:, None] + np.arange(n)]
        finite = np.isfinite(x).all(axis=1)
        if finite.any():
            out[n] = (ids[rows[finite]].astype(np.int64), np.floor(scale * x[finite]))
    return out


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Scaled means, then deviations, of each row's segments: their products bound inner products."""
    cuts = np.unique(np.linspace(0, x.shape[1], segments + 1).round().astype(int))
    if len(cuts) < 2:
        return np.zeros((len(x), 2))
    size = np.diff(cuts)
    mean = np.add.reduceat(x, cuts[:-1], axis=1) / size
    square = np.add.reduceat(x * x, cuts[:-1], axis=1) / size
    dev = np.sqrt(np.maximum(square - mean * mean, 0))
    return np.concatenate([mean * np.sqrt(size), dev * np.sqrt(size)], axis=1)


class Best:
    """The k best (score, id) of each query so far: higher scores first, then smaller ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.stats = [statistics(vectors, s) for s in RESOLUTIONS]
        self.query = np.empty(0, np.int64)
        self.score = np.empty(0)
        self.row = np.empty(0, np.int64)
        self.least = np.full(len(ids), -np.inf)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        stats = [statistics(vectors, s) for s in RESOLUTIONS]
        for a in range(0, len(self.ids), QUERIES):
            tile = slice(a, a + QUERIES)
            least = self.least[tile]
            bound = self.stats[0][tile] @ stats[0].T
            q, x = np.nonzero(_reaches(bound, least[:, None]))
            for own, other in zip(self.stats[1:], stats[1:]):
                if len(q) * 4 > bound.size:  # most are left: all at once
                    near = _reaches(own[tile] @ other.T, least[:, None])[q, x]
                else:
                    near = _reaches(_pairs(own[tile], other, q, x), least[q])
                q, x = q[near], x[near]
            if len(q) * 4 > bound.size:
                score = (self.vectors[tile] @ vectors.T)[q, x]
            else:
                score = _pairs(self.vectors[tile], vectors, q, x)
            fit = (score >= least[q]) & (ids[x] != self.ids[tile][q])
            self._merge(q[fit] + a, score[fit], ids[x[fit]])

    def _merge(self, q: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        if not len(q):
            return
        touched = np.zeros(len(self.ids), bool)
        touched[q] = True
        old = touched[self.query]
        q, score, row = np.r_[self.query[old], q], np.r_[self.score[old], score], np.r_[self.row[old], row]
        order = np.lexsort((row, -score, q))
        q, score, row = q[order], score[order], row[order]
        start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        place = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
        keep = place < self.k
        full = place == self.k - 1
        self.least[q[full]] = score[full]
        self.query, self.score, self.row = np.r_[self.query[~old], q[keep]], np.r_[self.score[~old], score[keep]], np.r_[self.row[~old], row[keep]]


def _reaches(bound: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether a bound, with room for rounding, reaches the least score wanted."""
    return bound * (1 + 1e-9 * np.sign(bound)) + 1e-6 >= least


def _pairs(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i))
    for at in range(0, len(i), 1 << 16):
        s = slice(at, at + (1 << 16))
        out[s] = np.einsum("ij,ij->i", a[i[s]], b[j[s]])
    return out


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """-> (query_id, rank int, vec_id, score long): for each row that is_query
    holds for, the k rows of other ids with the highest inner products of
    floor(scale * component), ties to the smaller id.

    Null vectors, vectors with a null, NaN or infinite component and rows with
    a null id take no part. Only vectors of one length are compared. A repeated
    id is a row each, as query and as candidate, but no candidate to itself.
    Fewer than k candidates give all; no rows give no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    pair = [F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")]
    rows, asked = vectors.select(*pair), vectors.where(is_query).select(*pair)
    blocks = max(1, -(-asked.count() // query_block))
    if blocks == 1:
        return _searched(rows, _shared(asked, scale), k, scale)
    # Queries are read once and kept by block; one block is in memory at a time, and its result is written.
    path = f"{shared_folder(spark)}/topk-{uuid.uuid4().hex}"
    asked.withColumn("lm_block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).write.partitionBy("lm_block").parquet(f"{path}/queries")
    kept = spark.read.parquet(f"{path}/queries")
    for b in range(blocks):
        shared = _shared(kept.where(F.col("lm_block") == b).select("id", "v"), scale)
        found = _searched(rows, shared, k, scale)
        found.write.mode("append").parquet(f"{path}/found")
        shared.destroy()
    return spark.read.schema(found.schema).parquet(f"{path}/found")


def _shared(asked: DataFrame, scale: float):
    """The queries of one block, query_block at most, as a broadcast."""
    arrow = asked.toArrow().combine_chunks()
    sets = whole_vectors(arrow.column("v").combine_chunks(), arrow.column("id").combine_chunks(), scale) if arrow.num_rows else {}
    return asked.sparkSession.sparkContext.broadcast(sets)


def _searched(rows: DataFrame, shared, k: int, scale: float) -> DataFrame:
    """Each task has a best list for each query; those are ranked together."""
    found = rows.mapInArrow(_searcher(shared, k, scale), "block int, q int, query_id long, vec_id long, score long")
    best = Window.partitionBy("block", "query_id", "q").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _searcher(shared, k: int, scale: float):
    def search(batches):
        best = {n: Best(ids, x, k) for n, (ids, x) in shared.value.items()}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                piece = batch.slice(at, ROWS)
                for n, (ids, x) in whole_vectors(piece.column(1), piece.column(0), scale).items():
                    if n in best:
                        best[n].add(ids, x)
        for n, b in best.items():
            if len(b.query):
                columns = [np.full(len(b.query), n, np.int32), b.query.astype(np.int32), b.ids[b.query], b.row, b.score.astype(np.int64)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["block", "q", "query_id", "vec_id", "score"])

    return search


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
